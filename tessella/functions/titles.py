"""Title tokens for code that runs outside the JVM; the column form is in `text`."""

import re

_CHAR = re.compile("[一-鿿぀-ヿ가-힯]")


def title_tokens(title: str) -> set[str]:
    low = title.lower().strip()
    return {*_CHAR.findall(low), *re.findall("[a-z0-9]{2,}", _CHAR.sub(" ", low))}


def title_similarity(a: str, b: str) -> float:
    x, y = title_tokens(a), title_tokens(b)
    return len(x & y) / len(x | y) if x and y else 0.0
