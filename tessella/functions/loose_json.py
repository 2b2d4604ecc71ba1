"""JSON out of model replies: fences, prose around it, trailing commas. Nothing here raises."""

from __future__ import annotations

import json
import re
from typing import Any


def _load(text: str) -> Any:
    try:
        return json.loads(text)
    except ValueError:
        return None


def first_object(raw: str) -> dict | None:
    """The whole reply, else its first balanced object."""
    text = re.sub(r"```(?:json)?\s*", "", raw or "").strip()
    whole = _load(text)
    if isinstance(whole, (dict, list)):
        return whole
    start = text.find("{")
    if start < 0:
        return None
    depth = 0
    for m in re.finditer(r'"(?:\\.|[^"\\])*"|[{}]', text[start:], re.S):
        depth += {"{": 1, "}": -1}.get(m[0], 0)
        if depth == 0:
            got = _load(text[start : start + m.end()])
            return got if isinstance(got, (dict, list)) else None
    return None


def outermost_object(raw: str) -> dict | None:
    """From the first brace to the last, inside a fence if there is one; commas before a closing bracket are forgiven."""
    fence = re.search(r"```(?:json)?\s*([\s\S]*?)```", (raw or "").strip())
    m = re.search(r"\{[\s\S]*\}", fence[1] if fence else raw or "")
    if not m:
        return None
    got = _load(m[0])
    return got if got is not None else _load(re.sub(r",(\s*[}\]])", r"\1", m[0]))


def segment_plan(raw: str) -> dict | None:
    got = outermost_object(raw)
    return got if isinstance(got, dict) and isinstance(got.get("segments"), list) else None


def tags(raw: str, most: int = 7) -> list[str]:
    """Lower-cased tags of 1 to 50 characters, from a JSON list, else from what stands between brackets."""
    got = _load(re.sub(r"```(?:json)?\s*", "", raw or "").strip())
    if got is None:
        m = re.search(r"\[([^\]]+)\]", raw or "")
        got = [re.sub("[\"']", "", t) for t in m[1].split(",")] if m else []
    found = [t.lower().strip() for t in got if isinstance(t, str)] if isinstance(got, list) else []
    return [t for t in found if 0 < len(t) <= 50][:most]


def audit(raw: str) -> dict:
    """{passed, score, issues}: a reply that cannot be read fails with one critical issue."""
    bad = lambda why: {"passed": False, "score": 0, "issues": [{"rule": "audit_parse_error", "severity": "critical", "detail": why}]}
    m = re.search(r"\{[\s\S]*\}", raw or "")
    if not m:
        return bad("no JSON object in the reply")
    got = _load(m[0])
    if not isinstance(got, dict):
        return bad("the JSON object cannot be read")
    issues = [{"rule": i["rule"], "severity": i.get("severity") or "info", "detail": i["detail"]} for i in got.get("issues") or [] if isinstance(i, dict) and i.get("rule") and i.get("detail")]
    score = got.get("score")
    number = isinstance(score, (int, float)) and not isinstance(score, bool)
    return {"passed": got.get("passed") is not False and all(i["severity"] != "critical" for i in issues), "score": max(0, min(100, score)) if number else 100, "issues": issues}


def string_batches(items: list[str], most: int) -> list[list[str]]:
    """Runs of strings of at most `most` characters; a longer one is alone."""
    out: list[list[str]] = []
    size = 0
    for x in items:
        if not out or (out[-1] and size + len(x) > most):
            out.append([])
            size = 0
        out[-1].append(x)
        size += len(x)
    return out


# How many of each kind count, and the least length of a content.
MOST = {"topics": 3, "concepts": 4, "claims": 3}
LEAST_CONTENT = 80


def knowledge(raw: str, least: int = LEAST_CONTENT, most: dict[str, int] | None = None) -> dict | None:
    """{micro_summary, topics, concepts, claims} of a reply, each kind up to its cap; null if it is no JSON object.

    Entries need a title of two characters and a content that says something; a claim without a
    confidence has 0.7, others are brought between 0 and 1.
    """
    got = first_object(raw)
    if not isinstance(got, dict):
        return None
    said = got.get("microSummary")
    out: dict = {"micro_summary": said[:120] if isinstance(said, str) else ""}
    for kind, cap in (most or MOST).items():
        found = []
        for e in got.get(kind) if isinstance(got.get(kind), list) else ():
            title, content = (e.get("title"), e.get("content")) if isinstance(e, dict) else (None, None)
            if not (isinstance(title, str) and isinstance(content, str)) or len(title.strip()) < 2 or len(content.strip()) < least:
                continue
            entry = {"title": title.strip(), "content": content.strip()}
            if kind == "claims":
                c = e.get("confidence")
                entry["confidence"] = max(0.0, min(1.0, float(c))) if isinstance(c, (int, float)) and not isinstance(c, bool) else 0.7
            found.append(entry)
        out[kind] = found[:cap]
    return out
