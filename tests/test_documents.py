import math
import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from tessella.functions import loose_json
from tessella.operators import chunking as ch
from tessella.operators import macro as mc
from tessella.operators import outline as ol

BOOK = "\n".join(f"# Chapter {c}\n" + "\n".join(f"## Part {c}.{p}\n" + "A sentence that is repeated here. " * 100 for p in range(3)) for c in range(2))

markdown = st.lists(st.sampled_from(["# One", "## Two", "### Three", "", "Plain text. More of it! Yes?", "| a | b |", "| --- | --- |", "```", "x = 1", "第一章 标题", "中文。句子！A", "- item", "1.1 Numbered part"]), max_size=40).map("\n".join)


def test_tokens():
    assert ch.tokens_of("") == 1 and ch.tokens_of("a" * 3) == 2 and ch.tokens_of("a" * 4) == math.ceil(4 / 1.5)


def test_small_document_is_one_chunk():
    (c,) = ch.split_markdown("# Title\n\nbody", 500)
    assert (c.title, c.path, c.content) == ("Title", "Title", "# Title\n\nbody")


def test_headings_give_paths():
    got = ch.split_markdown(BOOK, 500)
    assert len(got) >= 6
    assert any(c.path == "Chapter 1 > Part 1.0" or c.path == "Part 1.0" for c in got)
    assert sum(c.content.count("A sentence") for c in got) == 600


def test_heading_after_heading_takes_its_place():
    assert ch.heading_sections("# A\n## B\ntext\n# C\nmore") == [(2, "B", "text"), (1, "C", "more")]


def test_overlap_leads_the_next_chunk():
    got = ch.pack_sections([(1, "A", "x" * 600), (1, "B", "y" * 600)], 500, 100, 20)
    assert got[1].content.startswith("x" * 30 + "\n\n")


def test_titles_without_marks():
    text = "\n\n".join(f"{n}、标题部分\n\n" + "内容。" * 200 for n in "一二三四")
    assert len(ch.section_titles(text)) == 4
    assert [c.path for c in ch.split_markdown(text, 450)][0] == "一、标题部分"


@settings(max_examples=80, deadline=None)
@given(st.text(alphabet="ab. 。\n", max_size=3000), st.integers(20, 200))
def test_lines_keep_all_text(text, most):
    strip = lambda s: "".join(s.split())
    assert strip("".join(c.content for c in ch.split_by_lines(text, most, 10))) == strip(text)


@settings(max_examples=150, deadline=None)
@given(markdown)
def test_sentences_join_to_the_text(text):
    assert "".join(ch.split_sentences(text)) == text


@settings(max_examples=150, deadline=None)
@given(markdown)
def test_atoms_are_ordered_and_segments_cover(text):
    atoms = ch.atoms_of(text)
    assert [a.index for a in atoms] == list(range(len(atoms)))
    assert all(a.end <= b.start or a.start <= b.start for a, b in zip(atoms, atoms[1:], strict=False))
    windows = ch.windows_of(atoms, 30)
    assert [k for w in windows for k in range(w.start, w.end + 1)] == list(range(len(atoms)))
    for segs in (ch.bucket_segments(atoms), ch.contiguous_segments([ch.Segment(str(k), k, k, 1.0) for k in range(0, len(atoms), 3)], atoms)):
        assert [k for s in segs for k in range(s.start, s.end + 1)] == list(range(len(atoms))) or not atoms


def synthetic(n):
    return [ch.Atom(k, "heading" if k % 10 == 0 else "paragraph", f"t{k}", 100, 1 if k % 10 == 0 else None, None, None, k, k) for k in range(n)]


def test_small_segments_join():
    got = ch.contiguous_segments([ch.Segment("a", 0, 9, 1.0), ch.Segment("b", 10, 11, 1.0), ch.Segment("c", 12, 30, 1.0)], synthetic(30))
    assert [(s.title, s.start, s.end) for s in got] == [("a · b", 0, 11), ("c", 12, 29)]


def test_plan_moves_to_headings():
    atoms = synthetic(40)
    windows = ch.windows_of(atoms, 500)
    got, moved = ch.refine_plan([{"title": "x", "startWindowIndex": 0, "endWindowIndex": 2}, {"startWindowIndex": 3, "endWindowIndex": 99}], atoms, windows)
    assert got[0].start == 0 and got[-1].end == 39 and atoms[got[0].end].kind == "heading" and moved and got[1].title == "Segment 2"
    assert got[1].start == got[0].end + 1 or got[1].start > got[0].end


def test_pages_and_paths():
    atoms = ch.atoms_of("# 标题\n\ntext\n\n## Sub\n\nmore", {"标题": 3})
    assert [(a.kind, a.path, a.page) for a in atoms] == [("heading", "标题", 3), ("paragraph", "标题", 3), ("heading", "标题 > Sub", 3), ("paragraph", "标题 > Sub", 3)]


def test_sanitize():
    assert ch.sanitize_markdown("a\n\n\n\nb ![ x ](p.png) ![](q)\n######## h\n1 Intro\t6\n") == "a\n\nb [Image: x] \n###### h\n1 Intro\n"


def test_macro_levels():
    got = mc.macro_split("## Root\ntext one here\n## Other\ntext two here\n### Deep\ntext three\n```\n# no\n```\n| a |\n| - |")
    assert [(m.path, m.atomic) for m in got] == [("Root", False), ("Other", False), ("Other > Deep", False), ("Other > Deep", True), ("Other > Deep", True)]
    assert mc.coalesce_macros([mc.Macro("A", "A", None, "x", 10), mc.Macro("A > B", "A", "B", "y", 10), mc.Macro("C", "C", None, "z", 10)], 50)[0].path == "A > B"


def test_structure_split():
    text = "intro\n## 1 One\n" + "a " * 300 + "\n## 2 Two\nshort\n### 2.1 Sub\n" + "b " * 300
    got = mc.structure_split(text, [{"text": "1 One", "level": 1}, {"text": "2 Two", "level": 1}, {"text": "2.1 Sub", "level": 1}], 100)
    assert {m.h1 for m in got} == {"1 One", "2 Two"} and any(m.h2 == "2.1 Sub" for m in got)
    assert not any("intro" in m.content for m in got)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 400), min_size=2, max_size=40), st.integers(40, 150))
def test_no_segment_over_the_limit(sizes, most):
    sentences = ["x" * n for n in sizes]
    rng = random.Random(sum(sizes))
    cuts = [0, *mc.boundaries(sentences, most, lambda s: np.array([[rng.random(), rng.random()] for _ in s])), len(sentences)]
    for lo, hi in zip(cuts, cuts[1:], strict=False):
        assert hi - lo == 1 or sum(max(1, len(s) // 2) for s in sentences[lo:hi]) <= most


def test_safe_chunks():
    table = "| h | i |\n| - | - |\n" + "\n".join(f"| row {k} | {'v' * 20} |" for k in range(60))
    got = mc.embedding_safe([ch.Chunk("T", table, 0, "P")], 200)
    assert len(got) > 1 and all(c.tokens <= 200 and c.content.startswith("| h | i |\n| - | - |") for c in got)
    assert mc.embedding_safe([ch.Chunk("T", "z" * 5000, 0, "P")], 100)[0].tokens <= 100
    again = mc.resplit_oversize([ch.Chunk("a", "x", 1, ""), ch.Chunk("b", "line\n" * 200, 1, ""), ch.Chunk("c", "y", 1, "")], 100)
    assert [k for k, _ in again][:2] == [0, 2] and [k for k, _ in again] == sorted(k for k, _ in again)
    assert mc.chunk_title("A > B", "## A\nA first sentence of it. Next.") == "A > B — A first sentence of it."
    assert mc.breadcrumbs([ch.Chunk("t", "c", 1, "A")])[0].content == "[A]\nc"
    assert len(mc.pack_chunks([ch.Chunk("t", "one", 2, "A"), ch.Chunk("t", "two", 2, "A"), ch.Chunk("t", "x", 2, "B")], 10)) == 2


def test_loose_json():
    plan = '{"segments": [{"title": "a"},]}'
    assert loose_json.segment_plan(f"Sure:\n```json\n{plan}\n```")["segments"] == [{"title": "a"}]
    assert loose_json.segment_plan("no json") is None and loose_json.segment_plan('{"x": 1}') is None
    assert loose_json.first_object('Here: {"a": "}{", "b": {"c": 1}} and {') == {"a": "}{", "b": {"c": 1}}
    assert loose_json.tags('["A", " b ", 3, ""]') == ["a", "b"] and loose_json.tags("tags: ['X', Y]") == ["x", "y"]
    assert loose_json.audit("nothing")["passed"] is False
    assert loose_json.audit('{"score": 140, "issues": [{"rule": "r", "detail": "d", "severity": "critical"}]}')["passed"] is False
    assert loose_json.string_batches(["aa", "bb", "c" * 9], 5) == [["aa", "bb"], ["c" * 9]]


def test_outline():
    tree = ol.fill_words(ol.renumber(ol.parse_outline("## 第一章 Begin\nkeyPoints: a；b\nwords: 1,200\n### 1.1 Inner\n- item\n## Next\n")))
    assert [(s.num, s.title, s.words) for _, s in ol.flatten(tree)] == [("1", "Begin", 1200), ("1.1", "Inner", 1200), ("2", "Next", 2000)]
    assert tree[0].points == ["a", "b"] and ol.outline_stats(tree)["depth"] == 2
    flat = ol.by_dotted_numbers([ol.Section("a", "1"), ol.Section("b", "1.1"), ol.Section("c", "2.1")])
    assert [s.title for s in flat] == ["a", "c"] and flat[0].children[0].title == "b"
    assert ol.at_path(ol.edit(tree, [0, 0], lambda s: None), [0, 0]) is None and len(ol.add_child(tree, [1], ol.Section("n"))[1].children) == 1
    assert any("top-level" in x for x in ol.outline_issues(tree))


def test_markers():
    text = "Start\n[IMAGE_REQUEST:\nid=ab12\ntitle=Pic\nprompt=draw]\nmid [DIAGRAM: 7|id=d1|title=Flow] [IMAGE: 9|title=none]\n[DIAGRAM_REQUEST:\ntype=flow]"
    got = ol.parse_markers(text)
    assert [(m["kind"], m["id"]) for m in got[:2]] == [("image", "ab12"), ("diagram", "d1")] and len(got) == 3
    assert got == ol.parse_markers(text)
    assert len([m for m in ol.parse_markers(ol.inject_ids(text)) if m["request"]]) == 2
    assert [s["kind"] for s in ol.segment_content(text)] == ["text", "image_request", "text", "diagram_asset", "image_asset", "diagram_request"]
    assert ol.replace_marker(text, "d1", "X").count("X") == 1
    assert ol.requests_and_text(text)[1].startswith("Start\n\nmid [DIAGRAM")


def test_titles_cut_a_text_that_joins_again():
    body = "some words of a long line without an end, " * 40
    text = f"{body}\nA. First\n\n{body}\nB. Second\n{body}\n\nC. Third\n end \n"
    assert len(ch.section_titles(text)) == 3
    bare = lambda t: "".join(c for c in t if c not in " \t\n\x0b\f\r")
    for most in (100, 400, 1000, 2000):
        got = ch.split_markdown(text, most, 100)
        assert bare("".join(c.content for c in got)) == bare(text)
    assert any(c.path == "Preface" for c in got)


def test_structure_is_found_without_going_through_the_text_again():
    class Text(str):
        looked = 0

        def find(self, *a):
            Text.looked += 1
            return str.find(self, *a)

    n = 60
    text = Text("# Book\n" + "".join(f"## Part {k}\n\nwords of {k}\n" for k in range(n)))
    sections = [{"text": "Book", "level": 1}] + [{"text": f"Part {k}", "level": 2 if k % 3 == 0 else 3} for k in range(n)]
    got = mc.structure_split(text, sections, 8)
    assert "".join("".join(m.content for m in got).split()) == "".join(text.split())
    assert Text.looked == 0
