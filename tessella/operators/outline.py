"""Outlines as trees, and markers of images and diagrams in drafts."""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame

from tessella.operators.chunking import per_document

# Lines of an outline, default words by depth.
_HEADING = re.compile(r"(#{2,6})\s+(.+?)\s*$")
_POINTS = re.compile(r"(?:keypoints|要点|写作要点)\s*[:：]\s*(.+)$", re.I)
_WORDS = re.compile(r"(?:字数|words|estimatedWords|预估字数)\s*[:：]\s*(\d[\d,]*)\s*$", re.I)
_ITEM = re.compile(r"[-*•·]\s+(.+)$")
_LEADS = (re.compile(r"^第[一二三四五六七八九十百零\d]+[章节部分篇]\s*"), re.compile(r"^\d+([.．]\d+)*[、\s:：]?\s*"))
WORDS_BY_DEPTH = (2000, 800, 500, 300, 200)


@dataclass
class Section:
    title: str
    num: str = ""
    words: int | None = None
    description: str | None = None
    points: list[str] = field(default_factory=list)
    children: list[Section] = field(default_factory=list)


def parse_outline(text: str) -> list[Section]:
    """Headings of level 2 to 6 as a tree; key points, list items and word counts belong to the heading above."""
    roots: list[Section] = []
    above: list[tuple[int, Section]] = []
    last = None
    for line in (x.strip() for x in text.splitlines()):
        if m := _HEADING.match(line):
            title = m[2]
            for lead in _LEADS:
                title = lead.sub("", title)
            if not title.strip():
                continue
            last = Section(title.strip())
            while above and above[-1][0] >= len(m[1]):
                above.pop()
            (above[-1][1].children if above else roots).append(last)
            above.append((len(m[1]), last))
        elif last is None:
            continue
        elif m := _POINTS.match(line):
            last.points += [p.strip() for p in re.split("[；;。\n，,]", m[1]) if p.strip()]
        elif m := _WORDS.match(line):
            last.words = int(m[1].replace(",", "")) or last.words
        elif m := _ITEM.match(line):
            last.points.append(m[1].strip())
    return roots


def by_dotted_numbers(sections: list[Section]) -> list[Section]:
    """A flat list with numbers such as 2.1 as a tree; a section without its parent is a root."""
    if any(s.children for s in sections) or not any(re.fullmatch(r"\d+(\.\d+)+", s.num) for s in sections):
        return sections
    known = {s.num: s for s in sections}
    roots = []
    for s in known.values():
        parent = known.get(s.num.rpartition(".")[0]) if "." in s.num else None
        (parent.children if parent else roots).append(s)
    return roots


def renumber(sections: list[Section], prefix: str = "") -> list[Section]:
    for k, s in enumerate(sections, 1):
        s.num = f"{prefix}.{k}" if prefix else str(k)
        renumber(s.children, s.num)
    return sections


def fill_words(sections: list[Section], parent: int | None = None, depth: int = 0) -> list[Section]:
    """Missing word counts: an equal share of the parent's, 200 at least, else by depth."""
    for s in sections:
        if not s.words or s.words <= 0:
            s.words = max(200, int(parent / len(sections) + 0.5)) if parent else (WORDS_BY_DEPTH[depth] if depth < len(WORDS_BY_DEPTH) else 300)
        fill_words(s.children, s.words, depth + 1)
    return sections


def flatten(sections: list[Section], path: tuple[int, ...] = ()) -> list[tuple[tuple[int, ...], Section]]:
    return [x for k, s in enumerate(sections) for x in ((path + (k,), s), *flatten(s.children, path + (k,)))]


def outline_stats(sections: list[Section]) -> dict:
    """Leaves, depth, words (of all sections) and what leaves lack."""
    every = flatten(sections)
    leaves = [s for _, s in every if not s.children]
    return {"leaves": len(leaves), "depth": max((len(p) for p, _ in every), default=1), "words": sum(s.words or 0 for _, s in every), "missing_description": sum(not (s.description or "").strip() for s in leaves), "missing_points": sum(not s.points for s in leaves)}


def outline_issues(sections: list[Section], top: tuple[int, int] = (4, 8), least_depth: int = 2, least_leaves: int = 8, details: bool = True) -> list[str]:
    got, n = outline_stats(sections), len(sections)
    checks = ((n < top[0], f"Expected at least {top[0]} top-level sections, got {n}"), (n > top[1], f"Expected at most {top[1]} top-level sections, got {n}"), (got["depth"] < least_depth, f"Expected hierarchy depth of at least {least_depth}, got {got['depth']}"), (got["leaves"] < least_leaves, f"Expected at least {least_leaves} leaf sections, got {got['leaves']}"))
    out = [text for bad, text in checks if bad]
    for key, what in (("missing_description", "description"), ("missing_points", "keyPoints")):
        if details and got[key]:
            out.append(f"{got[key]} leaf section{'s are' if got[key] > 1 else ' is'} missing {what}")
    return out


def at_path(sections: list[Section], path: list[int]) -> Section | None:
    for k in path:
        if not 0 <= k < len(sections):
            return None
        found, sections = sections[k], sections[k].children
    return found if path else None


def edit(sections: list[Section], path: list[int], change: Callable[[Section], Section | None]) -> list[Section]:
    """A new tree with the section at path changed, or removed if change gives None."""
    if not path:
        return sections
    out = []
    for k, s in enumerate(sections):
        if k != path[0]:
            out.append(s)
        elif len(path) > 1:
            out.append(Section(s.title, s.num, s.words, s.description, s.points, edit(s.children, path[1:], change)))
        elif (new := change(s)) is not None:
            out.append(new)
    return out


def add_child(sections: list[Section], path: list[int], child: Section) -> list[Section]:
    if not path:
        return [*sections, child]
    return edit(sections, path, lambda s: Section(s.title, s.num, s.words, s.description, s.points, [*s.children, child]))


def outline_rows(docs: DataFrame, **cols: str) -> DataFrame:
    """(id, idx, path, parent, depth, num, title, words, points) of Markdown outlines, numbered and with words filled in."""

    def rows(text: str) -> list[tuple]:
        tree = fill_words(renumber(parse_outline(text)))
        return [(k, ",".join(map(str, p)), ",".join(map(str, p[:-1])) or None, len(p) - 1, s.num, s.title, s.words, s.points) for k, (p, s) in enumerate(flatten(tree))]

    return per_document(docs, rows, "idx int, path string, parent string, depth int, num string, title string, words int, points array<string>", **cols)


# -- markers -----------------------------------------------------------------

_MARKER = re.compile(r"\[(IMAGE_REQUEST|DIAGRAM_REQUEST|IMAGE|DIAGRAM):\s*([\s\S]*?)\]")
_REQUEST = re.compile(r"\[(IMAGE_REQUEST|DIAGRAM_REQUEST):\s*([\s\S]*?)\]")
_FIELD = re.compile(r"(\w+)=(.*)$")
DEFAULTS = {"image": {"type": "illustration", "title": "Illustration"}, "diagram": {"type": "architecture", "title": "Untitled Diagram"}}


def _fields(kind: str, body: str) -> dict[str, str]:
    if kind.endswith("REQUEST"):
        return {m[1]: m[2] for line in body.split("\n") if (m := _FIELD.match(line.strip()))}
    pairs = (p.partition("=") for p in body.strip().split("|")[1:])
    return {k.strip(): v.strip() for k, eq, v in pairs if eq and k}


def _made_id(raw: str, at: int) -> str:
    """Four hexadecimal digits that depend on the marker and its place."""
    return hashlib.md5(f"{at}:{raw}".encode()).hexdigest()[:4]


def parse_markers(text: str) -> list[dict]:
    """Markers in order: kind, id, raw, start, end, params. A request without an id gets one; an asset without one is passed over."""
    out = []
    for m in _MARKER.finditer(text):
        kind = "image" if m[1].startswith("IMAGE") else "diagram"
        got = _fields(m[1], m[2])
        request = m[1].endswith("REQUEST")
        if not request and not got.get("id"):
            continue
        params = DEFAULTS[kind] | {k: v for k, v in got.items() if k != "id" and v}
        if kind == "image":
            params["prompt"] = got.get("prompt") or got.get("description") or ""
        out.append({"kind": kind, "request": request, "id": got.get("id") or _made_id(m[0], m.start()), "raw": m[0], "start": m.start(), "end": m.end(), "params": params})
    return out


def inject_ids(text: str) -> str:
    """Every request gets its id written in."""

    def put(m: re.Match) -> str:
        if _fields(m[1], m[2]).get("id"):
            return m[0]
        first, newline, rest = m[2].partition("\n")
        made = f"id={_made_id(m[0], m.start())}"
        return f"[{m[1]}: {made}\n{rest}]" if newline else f"[{m[1]}: {made} {first.strip()}]"

    return _REQUEST.sub(put, text)


def replace_marker(text: str, marker_id: str, by: str) -> str:
    found = next((m for m in parse_markers(text) if m["id"] == marker_id), None)
    return text if found is None else text[: found["start"]] + by + text[found["end"] :]


def segment_content(text: str) -> list[dict]:
    """Text, assets and requests in order; text is trimmed, and left out where nothing is left."""
    out, at = [], 0
    for m in [*_MARKER.finditer(text), None]:
        part = text[at : m.start() if m else len(text)].strip()
        if part:
            out.append({"kind": "text", "content": part})
        if m:
            kind = ("image" if m[1].startswith("IMAGE") else "diagram") + ("_request" if m[1].endswith("REQUEST") else "_asset")
            got = _fields(m[1], m[2])
            lead = m[2].strip().split("|")[0].strip()
            out.append({"kind": kind, "content": m[0], "asset_id": None if kind.endswith("request") else lead, "params": got})
            at = m.end()
    return out


def requests_and_text(text: str) -> tuple[list[dict], str]:
    """The requests, and the text without them."""
    found = [m for m in parse_markers(text) if m["request"]]
    return found, re.sub(r"\n{3,}", "\n\n", _REQUEST.sub("", text)).strip()


def marker_rows(docs: DataFrame, **cols: str) -> DataFrame:
    return per_document(docs, lambda t: [(k, m["kind"], m["request"], m["id"], m["start"], m["end"], m["params"]) for k, m in enumerate(parse_markers(t))], "idx int, kind string, request boolean, marker_id string, start int, stop int, params map<string,string>", **cols)


def content_rows(docs: DataFrame, **cols: str) -> DataFrame:
    return per_document(docs, lambda t: [(k, s["kind"], s["content"]) for k, s in enumerate(segment_content(t))], "idx int, kind string, content string", **cols)


def outline_json(sections: list[Section]) -> str:
    plain = lambda s: {"num": s.num, "title": s.title, "estimatedWords": s.words, "keyPoints": s.points, "children": [plain(c) for c in s.children]}
    return json.dumps([plain(s) for s in sections], ensure_ascii=False)
