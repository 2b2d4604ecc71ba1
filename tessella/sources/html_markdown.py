"""Web pages -> Markdown: headings, paragraphs, lists, tables, code, links and images."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SKIPPED = frozenset("script style noscript template head svg".split())
BLOCKS = frozenset("p div section article main header footer aside nav ul ol table tr blockquote figure form h1 h2 h3 h4 h5 h6 pre li br hr dl dt dd".split())


class _Writer(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.blocks: list[str] = []
        self.line, self.lead = "", ""
        self.skip = 0
        self.lists: list[list] = []
        self.row: list[str] | None = None
        self.rows: list[list[str]] = []
        self.code = self.cell = False
        self.link: list[tuple[str, int]] = []

    def close_line(self) -> None:
        text = self.line if self.code else re.sub(r"\s+", " ", self.line).strip()
        if text.strip():
            self.blocks.append(f"```\n{text.strip(chr(10))}\n```" if self.code else self.lead + text)
        self.line, self.lead = "", ""

    def close_cell(self) -> None:
        if self.cell:
            self.row.append(re.sub(r"\s+", " ", self.line).strip().replace("|", "\\|"))
            self.cell, self.line = False, ""

    def close_row(self) -> None:
        self.close_cell()
        if self.row is not None:
            self.rows.append(self.row)
            self.row = None

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in SKIPPED:
            self.skip += 1
        if self.skip:
            return
        got = dict(attrs)
        if tag in BLOCKS and self.row is None:
            self.close_line()
        if re.fullmatch("h[1-6]", tag):
            self.lead = "#" * int(tag[1]) + " "
        elif tag in ("ul", "ol"):
            self.lists.append([tag, 0])
        elif tag == "li" and self.lists:
            self.lists[-1][1] += 1
            self.lead = "  " * (len(self.lists) - 1) + (f"{self.lists[-1][1]}. " if self.lists[-1][0] == "ol" else "- ")
        elif tag == "table":
            self.rows = []
        elif tag == "tr":
            self.close_row()
            self.row = []
        elif tag in ("td", "th"):
            self.close_cell()
            self.cell, self.line = self.row is not None, ""
        elif tag == "pre":
            self.code = True
        elif tag == "br" and self.row is not None:
            self.line += " "
        elif tag == "img":
            self.line += f"![{got.get('alt') or ''}]({got.get('src') or ''})"
        elif tag in ("b", "strong"):
            self.line += "**"
        elif tag == "a":
            self.link.append((got.get("href") or "", len(self.line)))

    def handle_endtag(self, tag: str) -> None:
        if tag in SKIPPED:
            self.skip = max(0, self.skip - 1)
            return
        if self.skip:
            return
        if tag in ("td", "th"):
            self.close_cell()
        elif tag == "tr":
            self.close_row()
        elif tag == "table":
            self.close_row()
            wide = max(map(len, self.rows), default=0)
            if wide:
                lines = ["| " + " | ".join(r + [""] * (wide - len(r))) + " |" for r in self.rows]
                self.blocks.append("\n".join([lines[0], "|" + " --- |" * wide, *lines[1:]]))
            self.rows, self.line = [], ""
        elif tag in ("ul", "ol") and self.lists:
            self.close_line()
            self.lists.pop()
        elif tag == "pre":
            self.close_line()
            self.code = False
        elif tag in ("b", "strong"):
            self.line += "**"
        elif tag == "a" and self.link:
            href, at = self.link.pop()
            name = self.line[at:]
            if href and name.strip():
                self.line = f"{self.line[:at]}[{name.strip()}]({href})"
        elif tag in BLOCKS and self.row is None:
            self.close_line()

    def handle_data(self, data: str) -> None:
        if not self.skip:
            self.line += data


def to_markdown(html: str) -> str:
    w = _Writer()
    w.feed(html or "")
    w.close()
    w.close_line()
    return "\n\n".join(w.blocks)


def convert_pages(pages: DataFrame, html_col: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """Adds nothing but markdown to the kept columns; a page that cannot be read is empty. No shuffle."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch[list(keep)].assign(markdown=[to_markdown(x) for x in batch[html_col]])

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pages.schema if f.name in keep)
    source = pages.select(*keep, F.coalesce(F.col(html_col), F.lit("")).alias(html_col))
    return source.mapInPandas(run, f"{fields}, markdown string")
