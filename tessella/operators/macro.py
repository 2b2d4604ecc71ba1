"""Macro chunks by heading structure, and the steps from there to chunks that an embedder can take."""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections.abc import Callable
from dataclasses import dataclass, replace

import numpy as np
from pyspark.sql import DataFrame

from tessella.operators.chunking import FENCE, HEADING, Chunk, _table_line, per_document, split_sentences, tokens_of


@dataclass
class Macro:
    path: str
    h1: str
    h2: str | None
    content: str
    tokens: int
    atomic: bool = False


# What is no title, what is code, what is no heading though it is marked as one.
_NOT_TITLE = tuple(
    re.compile(p, f)
    for p, f in (
        (r"^(图|表)\s*[\d一二三四五六七八九十]", 0),
        (r"^(Figure|Fig\.?|Table|Tab\.?)\s*\d", re.I),
        (r"\*\*.+?\*\*", 0),
        (r"^[-*•]\s", 0),
        (r"^\d+[.、)]\s", 0),
        (r"^[a-zA-Z_][a-zA-Z0-9_.-]*\s*:\s", 0),
        (r"^(bash|sh|zsh|docker|kubectl|helm|python|python3|node|git|curl|wget|redis-cli|mysql|psql|npm|yarn|pip)\s", re.I),
        (r"^(tag|image|version|name|label|env)\s*:\s", re.I),
        (r"^[/\\|]|[/\\|]{2,}|\*{2,}|\|\s*$", 0),
        (r"\b\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}\b", 0),
        (r"^\d{4}/\d{2}/\d{2}\s", 0),
        (r"^127\.0\.0\.1.*>\s", 0),
        (r"(&gt;|&lt;|&amp;)", 0),
        (r"^\+", 0),
        (r"^db\d+[:\s]", re.I),
        (r"^[A-Z][a-z]{1,11}$", 0),
        (r"^[A-Z][A-Z_]{1,14}$", 0),
        (r"[。！？.!?，,；;：:）)》>、]$", 0),
    )
)
_INSTRUCTION = re.compile(r"^(FROM|RUN|COPY|ADD|CMD|ENTRYPOINT|ENV|ARG|WORKDIR|USER|EXPOSE|VOLUME|LABEL|HEALTHCHECK|MAINTAINER|ONBUILD)\s", re.I)
_CODE = tuple(
    re.compile(p)
    for p in (
        r"(&&|&amp;&amp;|\|\||&gt;|&lt;|`)",
        r"\\\s*$",
        r"^(tar|yum|dnf|apt|apt-get|brew|cd|cp|mv|rm|mkdir|rmdir|chmod|chown|chgrp|ln|touch|echo|export|unset|cat|tee|head|tail|wc|sort|uniq|wget|curl|pip|pip3|npm|pnpm|yarn|systemctl|service|kubectl|docker|podman|make|gcc|g\+\+|clang|cmake|java|javac|python|python3|node|git|svn|unzip|gzip|gunzip|bzip2|xz|sed|awk|grep|find|sudo|nohup|exec|source|sh|bash|zsh)\b",
        r"^(\./|\.\./)",
        r"\.(rpm|tar|gz|tgz|bz2|xz|zip|deb|conf|cfg|yml|yaml|sh|bash|service|ini|env|properties|war|jar|whl)\b",
        r"^[A-Z_][A-Z0-9_]*\s*[:?+]?=",
        r"(\$\(.*\)|\$\{[^}]+\}|\$[A-Z_][A-Z0-9_]*)",
    )
)
_NOT_HEADING = (
    re.compile("[，。：；！？]"),
    re.compile("^-{1,2}[A-Za-z]"),
    _INSTRUCTION,
    re.compile("^(Keyspace|Server|Clients|Memory|Persistence|Stats|Replication|CPU|Commandstats|Latencystats|Errorstats|Cluster|Modules)$", re.I),
    re.compile("^(检查|进入|查看|执行|运行|启动|停止|创建|删除|修改|配置|安装|部署).{0,13}$"),
)
_CONTENTS = re.compile("(table of contents|目录|目次|contents)")
_DATE = re.compile(r"\d{4}[-/]\d{1,2}[-/]\d{1,2}")
SMALL_SECTION, BREADCRUMB, SNIPPET = 100, 80, 60


def plain_title(line: str, above_empty: bool, below_empty: bool) -> bool:
    """Whether an unmarked line can be a title."""
    t = line.strip()
    if not 4 <= len(t) <= 80 or t.startswith(("![", "|", FENCE, "#")) or not (above_empty or below_empty):
        return False
    return not any(p.search(t) for p in _NOT_TITLE) and not ("=" in t and " = " not in t)


def code_line(line: str) -> bool:
    t = line.strip()
    return bool(t) and (bool(_INSTRUCTION.search(t)) or any(p.search(t) for p in _CODE))


def macro_split(text: str) -> list[Macro]:
    """Chunks along headings, marked or only looking like it; code blocks and tables are chunks of their own.

    A document without a level 1 takes its level 2 as the root. Marked lines among code and
    lines that cannot be headings are body text.
    """
    lines = text.split("\n")
    bare = [x.strip() for x in lines]
    out: list[Macro] = []
    stack: list[str] = []
    held: list[str] = []
    real_root = False

    def add(content: str, atomic: bool = False) -> None:
        out.append(Macro(" > ".join(filter(None, stack)), stack[0] if stack else "", (stack[1] if len(stack) > 1 else "") or None, content, tokens_of(content), atomic))

    def close() -> None:
        content = "\n".join(held).strip()
        held.clear()
        if not content:
            return
        m = HEADING.match(content) if "\n" not in content else None
        lone = "\n" not in content and not (m and len(m[1]) <= 2) and (m is not None or content in stack)
        if not lone:
            add(content)

    def empty(k: int) -> bool:
        return not bare[k]

    def title_at(k: int) -> bool:
        return plain_title(lines[k], k == 0 or empty(k - 1), k + 1 < len(lines) and empty(k + 1))

    k = 0
    while k < len(lines):
        line = lines[k]
        m = HEADING.match(line)
        if bare[k].startswith(FENCE):
            close()
            end = next((j for j in range(k + 1, len(lines)) if bare[j].startswith(FENCE)), len(lines))
            add("\n".join([bare[k], "\n".join(lines[k + 1 : end]), FENCE]), True)
            k = end + 1
            continue
        if _table_line(line):
            close()
            end = next((j for j in range(k, len(lines)) if not _table_line(lines[j])), len(lines))
            add("\n".join(lines[k:end]), True)
            k = end
            continue
        if m:
            level, name = len(m[1]), m[2].strip()
            in_code = any(map(code_line, lines[max(0, k - 3) : k])) and any(map(code_line, lines[k + 1 : k + 4]))
            if name and not in_code and not any(p.search(name) for p in _NOT_HEADING):
                close()
                if level == 1 or (level == 2 and not real_root):
                    stack[:] = [name]
                    real_root = level == 1
                else:
                    stack[:] = [*(stack[: level - 1] + [""] * level)[: level - 1], name]
        elif title_at(k):
            below = next((j for j in range(k + 1, len(lines)) if bare[j] and not bare[j].startswith("![") and not title_at(j) and len(bare[j]) >= 8), None)
            if below is not None:
                close()
                stack[:] = [*stack[:1], bare[k]]
        held.append(line)
        k += 1
    close()
    return out


def coalesce_macros(macros: list[Macro], least: int) -> list[Macro]:
    """Neighbours of one top section are joined up to `least` tokens; the later path stands."""
    top = lambda m: m.path.split(" > ")[0]
    out: list[Macro] = []
    open_ = False
    for m in macros:
        last = out[-1] if out and open_ else None
        if last and not m.atomic and last.tokens + m.tokens <= least and top(last) and top(last) == top(m):
            out[-1] = Macro(m.path, m.h1, m.h2, f"{last.content}\n\n{m.content}", last.tokens + m.tokens)
        else:
            out.append(replace(m))
        open_ = not m.atomic
    return out


def least_macro(chunk_most: int) -> float:
    return max(400, 0.4 * chunk_most)


# -- by a converter's structure ----------------------------------------------


def numbered_level(text: str) -> int:
    m = re.match(r"(\d+(?:\.\d+)*)\s", text.strip())
    return min(m[1].count(".") + 2, 6) if m else 3


class _Finder:
    """Where a section's name stands next, behind marks (# and a space) if it does anywhere.

    What follows the marks is cut out once for each length of a name and looked up by equality, so that
    a long text isn't gone through again for every section and level; only a name without marks is.
    """

    def __init__(self, text: str):
        self.text = text
        self.marks = [(m.end(), len(m[0]) - 1) for m in re.finditer("#+ ", text)]
        self.lines: dict[int, dict[str, list[tuple[int, int]]]] = {}
        self.starts: dict[tuple[str, int], list[int]] = {}

    def _starts(self, name: str, h: int) -> list[int]:
        """Places of h marks, a space and the name."""
        if (name, h) not in self.starts:
            if len(name) not in self.lines:
                cut = self.lines[len(name)] = {}
                for end, size in self.marks:
                    cut.setdefault(self.text[end : end + len(name)], []).append((end, size))
            self.starts[name, h] = [end - 1 - h for end, size in self.lines[len(name)].get(name, ()) if size >= h]
        return self.starts[name, h]

    def first(self, level: int, name: str, cursor: int) -> int:
        for h in (min(x, 6) for x in (level, 2, 1, 3, 4, 5, 6)):
            if h < 1:
                at = self.text.find(f" {name}", cursor)
            else:
                own = self._starts(name, h)
                k = bisect_left(own, cursor)
                at = own[k] if k < len(own) else -1
            if at >= 0:
                return at
        return self.text.find(name, cursor)


def structure_split(text: str, sections: list[dict], most: int) -> list[Macro]:
    """Chunks along the sections (text, level) that a converter found, cut by chapters, then by subsections, then by lines."""
    if not sections:
        return []
    levels = {s.get("level") if s.get("level") is not None else 99 for s in sections}
    found: list[tuple[int, str, int]] = []
    cursor = 0
    ahead = _Finder(text)
    for s in sections:
        name = (s.get("text") or "").strip()
        level = numbered_level(s.get("text") or "") if len(levels) == 1 else s.get("level")
        if not name or level is None:
            continue
        at = ahead.first(level, name, cursor)
        if at >= 0:
            found.append((at, name, level))
            cursor = at + len(name)
    if not found:
        return []
    proper = [f for f in found if not _CONTENTS.fullmatch(f[1].lower())]
    chapters = [f for f in proper if f[2] <= 2 and not _DATE.fullmatch(f[1])] or [f for f in proper if f[2] <= 3]
    if len(chapters) <= 1:
        body = text[found[0][0] :].strip()
        name = chapters[0][1] if chapters else "Document"
        return [Macro(name, name, None, body, tokens_of(body))] if body else []
    out: list[Macro] = []
    below = [f for f in found if f[2] > 2]  # in order of their places, as they were found
    places = [f[0] for f in below]
    for (start, name, _), end in zip(chapters, [*(c[0] for c in chapters[1:]), len(text)], strict=True):
        body = text[start:end].strip()
        if not body:
            continue
        n = tokens_of(body)
        inner = below[bisect_left(places, start) : bisect_left(places, end)]
        if n <= most:
            out.append(Macro(name, name, None, body, n))
        elif not inner:
            out += _lines(body, name, name, None, most) if n > 1.5 * most else [Macro(name, name, None, body, n)]
        else:
            bounds = [(start, name, 2), *inner]
            for (a, title, level), b in zip(bounds, [*(x[0] for x in bounds[1:]), end], strict=True):
                part = text[a:b].strip()
                if not part:
                    continue
                path, h2, k = (name, None, tokens_of(part)) if level <= 2 else (f"{name} > {title}", title, tokens_of(part))
                last = out[-1] if out else None
                if k < SMALL_SECTION and last and (last.path == path or last.h1 == name):
                    last.content += "\n\n" + part
                    last.tokens += k
                else:
                    out += _lines(part, path, name, h2, most) if k > 1.5 * most else [Macro(path, name, h2, part, k)]
            if not out or out[-1].h1 != name:
                out.append(Macro(name, name, None, body, n))
    return out


def _lines(text: str, path: str, h1: str, h2: str | None, most: int) -> list[Macro]:
    return [Macro(path, h1, h2, "\n".join(part), size) for part, size in _budget(text.split("\n"), tokens_of, most)]


def _budget(items: list[str], cost: Callable[[str], float], most: float) -> list[tuple[list[str], float]]:
    """Runs of items of at most `most` in cost; a larger item is a run of its own."""
    out: list[tuple[list[str], float]] = []
    held, size = [], 0
    for x in items:
        c = cost(x)
        if held and size + c > most:
            out.append((held, size))
            held, size = [], 0
        held.append(x)
        size += c
    return [*out, (held, size)] if held else out


# -- semantic boundaries -----------------------------------------------------


def boundaries(sentences: list[str], most: int, embed: Callable[[list[str]], np.ndarray], threshold: float = 0.55, jump: int = 1) -> list[int]:
    """Sentence numbers where a new chunk starts: at valleys of neighbouring similarity, and wherever `most` tokens are full.

    A valley within `jump` of the last one is passed over if what lies between is small.
    """
    if len(sentences) <= 1:
        return []
    vectors = np.asarray(embed(sentences), dtype=float)
    vectors = vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-12)
    alike = (vectors[:-1] * vectors[1:]).sum(axis=1)
    size = [max(1, len(s) // 2) for s in sentences]
    cuts: list[int] = []
    for b in (np.flatnonzero(alike < threshold) + 1).tolist():
        if not (cuts and b - cuts[-1] <= jump and sum(size[cuts[-1] : b]) < int(most * 1.2)):
            cuts.append(b)
    out, start = set(cuts), 0
    for end in [*cuts, len(sentences)]:
        total = 0
        for k in range(start, end):
            if total and total + size[k] > most:
                out.add(k)
                total = 0
            total += size[k]
        start = end
    return sorted(b for b in out if 0 < b < len(sentences))


def micro_split(macros: list[Macro], most: int, embed: Callable[[list[str]], np.ndarray] | None = None, threshold: float = 0.55) -> list[Chunk]:
    """Macro chunks that are too large are cut at semantic boundaries, or by lines where there is no embedder or no boundary."""
    safe = most - BREADCRUMB
    large = [not m.atomic and m.tokens > safe and len(split_sentences(m.content)) > 1 for m in macros]
    if not any(large):
        return [Chunk(m.path or "Untitled", m.content, m.tokens, m.path) for m in macros]
    out: list[Chunk] = []
    for m, cut in zip(macros, large, strict=True):
        parts = split_sentences(m.content) if cut else []
        at = boundaries(parts, safe, embed, threshold) if cut and embed else []
        if at:
            for lo, hi in zip([0, *at], [*at, len(parts)], strict=True):
                body = "".join(parts[lo:hi])
                out.append(Chunk(chunk_title(m.path, body), body, sum(max(1, len(s) / 2) for s in parts[lo:hi]), m.path))
        elif m.tokens > safe:
            for lines, size in _budget(m.content.split("\n"), lambda x: max(1, len(x) / 2), safe):
                body = "\n".join(lines)
                out.append(Chunk(chunk_title(m.path, body), body, size, m.path))
        else:
            out.append(Chunk(chunk_title(m.path, m.content), m.content, m.tokens, m.path))
    return [c for c in out if c.content.strip()]


def chunk_title(path: str, content: str) -> str:
    """The path and the first sentence, cut to 60 characters; a sentence under ten characters says nothing."""
    clean = re.sub(r"^#{1,6}\s+[^\n]*\n?", "", content, flags=re.M).strip()
    first = next(iter(split_sentences(clean)), "")
    snippet = first[:SNIPPET].rstrip() + "…" if len(first) > SNIPPET else first
    return f"{path or 'Untitled'} — {snippet}" if len(snippet) >= 10 else path or "Untitled"


def pack_chunks(chunks: list[Chunk], most: int) -> list[Chunk]:
    """Neighbours with one path are joined while they fit; blank ones are dropped."""
    if len(chunks) <= 1:
        return chunks
    out: list[Chunk] = []
    for c in chunks:
        if not c.content.strip():
            continue
        if out and out[-1].path == c.path and out[-1].tokens + c.tokens <= most:
            body = f"{out[-1].content}\n\n{c.content}"
            out[-1] = Chunk(chunk_title(c.path, body), body, out[-1].tokens + c.tokens, c.path)
        else:
            out.append(replace(c))
    return out


def breadcrumbs(chunks: list[Chunk]) -> list[Chunk]:
    lead = lambda c: f"[{c.path}]\n"
    return [Chunk(c.title, lead(c) + c.content, c.tokens + math.ceil(len(lead(c)) / 2), c.path) if c.path else c for c in chunks]


# -- what an embedder can take -----------------------------------------------


def safe_lines(text: str, most: int) -> list[tuple[str, int]]:
    """(content, tokens) by lines; a line over the limit is a piece of its own."""
    out, held, size = [], "", 0
    for line in text.split("\n"):
        n = tokens_of(line)
        if held and size + n > most:
            out.append((held.strip(), size))
            held, size = "", 0
        held += line + "\n"
        size += n
    if held.strip():
        out.append((held.strip(), size))
    return out or [(text, tokens_of(text))]


def table_rows(text: str, most: int) -> list[tuple[str, int]] | None:
    """A table cut by rows, each part with its header; None unless the text is mostly a table of four lines or more that can be cut."""
    row, rule = re.compile(r"\s*\|.*\|\s*$"), re.compile(r"\s*\|[\s:|-]+\|\s*$")
    lines = text.split("\n")
    start = next((k for k, x in enumerate(lines) if row.match(x)), len(lines))
    end = next((k for k in range(start, len(lines)) if not row.match(lines[k])), len(lines))
    table = lines[start:end]
    if len(table) < 4 or tokens_of("\n".join(table)) < 0.6 * tokens_of(text):
        return None
    heads = 2 if rule.match(table[1]) else 1
    head, rows = "\n".join(table[:heads]), table[heads:]
    before, after = re.sub(r"\n+$", "", "\n".join(lines[:start])), "\n".join(lines[end:]).strip()
    fixed = tokens_of(head + "\n") + (tokens_of(before + "\n\n") if before else 0)
    room = most - fixed - (tokens_of("\n\n" + after) if after else 0)
    if not rows or fixed + tokens_of(rows[0] + "\n") > most or room <= 0:
        return None
    groups = _budget(rows, lambda r: tokens_of(r + "\n"), room)
    if len(groups) <= 1:
        return None
    bodies = ["\n".join([*([before] if k == 0 and before else []), head, *g, *(["", after] if k == len(groups) - 1 and after else [])]) for k, (g, _) in enumerate(groups)]
    return [(b, tokens_of(b)) for b in bodies]


def cut_short(text: str, most: int) -> str:
    width = math.floor(most * 1.5)
    if len(text) <= width:
        return text
    stop = text[:width].rfind("\n")
    return text[:stop] if stop > width * 0.5 else text[:width]


def embedding_safe(chunks: list[Chunk], most: int) -> list[Chunk]:
    out: list[Chunk] = []
    for c in chunks:
        n = tokens_of(c.content)
        if n <= most:
            out.append(Chunk(c.title, c.content, n, c.path))
            continue
        parts = table_rows(c.content, most) or safe_lines(c.content, most)
        if len(parts) <= 1:
            body = cut_short(c.content, most)
            out.append(Chunk(c.title, body, tokens_of(body), c.path))
        else:
            base = c.path or c.title or "Untitled"
            out += [Chunk(chunk_title(f"{base} (part {k + 1}/{len(parts)})", body), body, size, c.path) for k, (body, size) in enumerate(parts)]
    return out


def resplit_oversize(chunks: list[Chunk], most: int) -> list[tuple[int, Chunk]]:
    """(index, chunk): chunks over the embedder's context are cut; their parts take indexes after the end."""
    kept = [(k, c) for k, c in enumerate(chunks) if tokens_of(c.content) <= most]
    at = max((k for k, _ in kept), default=-1)
    for c in chunks:
        if tokens_of(c.content) <= most:
            continue
        parts = safe_lines(c.content, most)
        parts = parts if len(parts) > 1 else [(c.content[: math.floor(most * 1.5)], most)]
        for k, (body, size) in enumerate(parts):
            at += 1
            kept.append((at, Chunk(f"{c.title} (part {k + 1}/{len(parts)})" if len(parts) > 1 else c.title, body, size, c.path)))
    return kept


def refine_headings(macros: list[Macro], answers: list[dict] | None) -> list[Macro]:
    """Headings as a reviewer answered ({index, h1, h2}); a missing answer keeps the last valid ones, no answers change nothing."""
    if not answers:
        return macros
    by = {a.get("index"): a for a in answers if isinstance(a, dict)}
    out, h1, h2 = [], "", None
    for k, m in enumerate(macros):
        a = by.get(k, {})
        if (a.get("h1") or "").strip():
            h1, h2 = a["h1"].strip(), (a.get("h2") or "").strip() or None
        elif not h1:
            h1, h2 = m.h1, m.h2
        out.append(replace(m, h1=h1, h2=h2, path=" > ".join(filter(None, (h1, h2)))))
    return out


def outline_chunks(docs: DataFrame, most: int, embed: Callable[[list[str]], np.ndarray] | None = None, **cols: str) -> DataFrame:
    """The whole way: macro chunks, coalesced, cut, packed, made safe, with breadcrumbs."""

    def rows(text: str) -> list[tuple]:
        macros = coalesce_macros(macro_split(text), least_macro(most))
        cut = pack_chunks(micro_split(macros, most, embed), most - BREADCRUMB)
        return [(k, c.title, c.content, float(c.tokens), c.path) for k, c in enumerate(breadcrumbs(embedding_safe(cut, most)))]

    return per_document(docs, rows, "idx int, title string, content string, tokens double, path string", **cols)
