import random

import numpy as np

from tessella.operators import macro, semantic


def embed(texts):
    """A direction for each first letter, so that sentences of one letter are alike."""
    out = np.zeros((len(texts), 8))
    for k, t in enumerate(texts):
        out[k, ord(t.strip()[:1] or "a") % 8] = 1 + len(t)
        out[k, (len(t) * 7) % 8] += 3
    return out


def made(n, seed):
    rng = random.Random(seed)
    return ["".join(rng.choice("abcd") + "x" * rng.choice([3, 20, 90]) + ". " for _ in range(rng.choice([0, 1, 2, 40]))) for _ in range(n)]


def test_numbers_are_the_boundaries_of_each_document(spark):
    rng = random.Random(1)
    docs = {k: [rng.choice("abcde") * rng.choice([2, 30, 90, 300]) for _ in range(rng.choice([1, 2, 3, 60]))] for k in range(30)} | {99: ["a" * 40] * 400}
    rows = [(k, i, max(1, len(s) // 2), [float(x) for x in embed([s])[0]]) for k, ss in docs.items() for i, s in enumerate(ss)]
    df = spark.createDataFrame(rows, "doc_id int, idx int, tokens int, embedding array<double>").repartition(7)
    for most, threshold, jump in ((100, 0.55, 1), (60, 0.9, 3), (400, 0.3, 0)):
        got = {}
        for r in semantic.semantic_numbers(df, most, threshold, jump).collect():
            got.setdefault(r.doc_id, []).append((r.idx, r.chunk))
        for k, ss in docs.items():
            at = macro.boundaries(ss, most, embed, threshold, jump)
            assert [c for _, c in sorted(got[k])] == [sum(i >= b for b in at) for i in range(len(ss))]
    assert semantic.semantic_numbers(df.limit(0), 10).count() == 0


def test_chunks_hold_the_whole_texts(spark):
    texts = made(12, 3)
    docs = spark.createDataFrame([*enumerate(texts), (50, None)], "doc_id int, text string")
    got = {}
    for r in semantic.semantic_chunks(docs, embed, 50).collect():
        got.setdefault(r.doc_id, []).append((r.chunk, r.content))
    for k, t in enumerate(texts):
        assert "".join(c for _, c in sorted(got.get(k, []))).split() == t.split()
    assert max(map(len, got.values())) > 3


def test_structure_rows_cut_texts_in_order(spark):
    text = "intro\n# One\n" + "a " * 300 + "\n## Sub\n" + "b " * 400 + "\n# Two\nshort\n"
    texts = spark.createDataFrame([(1, text), (2, "no sections"), (3, None), (4, "# Lost\nx")], "doc_id int, text string")
    sections = [(1, 2, "Two", 1), (1, 0, "One", 1), (1, 1, "Sub", 3), (4, 0, "elsewhere", 1), (5, 0, "no text", 1), (3, 0, "x", 1)]
    got = semantic.structure_chunks(texts, spark.createDataFrame(sections, "doc_id int, idx int, text string, level int"), 300).orderBy("doc_id", "idx").collect()
    want = macro.structure_split(text, [{"text": t, "level": v} for _, _, t, v in sorted(s for s in sections if s[0] == 1)], 300)
    assert [(r.path, r.content, r.tokens) for r in got if r.doc_id == 1] == [(m.path, m.content, m.tokens) for m in want]
    assert {r.path for r in got} >= {"One", "Two"} and {r.doc_id for r in got} == {1}
