import re

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessella.llm._base import components
from tessella.llm.signature_trees import SignatureTree, _bitmap, _folded, _survivors, keep_one_of_each, linked, shingles, similar_documents
from tessella.llm.vector_forest import LEAF, MOST, TREES, fit_forest, leaves_of, near_duplicates

DOCS = "doc_id long, text string, node long, n long, component_id string"


def words_of(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return [w for w in re.split(r"[\x20\x09-\x0D]+", low) if w]


def shingle_set(text):
    w = words_of(text)
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def brute(rows):
    sets = [shingle_set(t) for _, t in rows]
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if a and b and 100 * len(a & b) >= 80 * len(a | b) and group[i] != group[j]:
                old, new = group[i], group[j]
                group = [new if g == old else g for g in group]
    return [(len(s), min((rows[k][0] for k in range(len(rows)) if group[k] == group[i] and rows[k][0] is not None), default=None)) for i, s in enumerate(sets)]


def noisy(rng, base, changes):
    w = base.split()
    for k in rng.integers(0, len(w), changes):
        w[k] = f"x{rng.integers(1e6)}"
    return " ".join(w)


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(3)
    bases = [" ".join(f"w{x}" for x in rng.integers(0, 5000, n)) for n in (40, 120, 121, 300, 9)]
    hot = "the very common passage that stands in all of these documents and is fairly long so that it is shared"
    out = [(k, noisy(rng, bases[k % 5], int(rng.integers(0, 4)))) for k in range(60)]
    out += [(100 + k, hot + " " + noisy(rng, bases[0], 30)) for k in range(15)]
    edge = " ".join(f"e{x}" for x in rng.integers(0, 10**6, 1010))
    out += [(400, edge), (401, noisy(rng, edge, 5)), (402, edge + " " + " ".join(f"t{x}" for x in range(30))), (403, edge + " " + " ".join(f"t{x}" for x in range(400)))]
    chain = [f"c{k}" for k in range(200)]
    out += [(200 + k, " ".join(chain[4 * k : 4 * k + 60])) for k in range(10)]  # neighbours are alike, ends are not
    out += [(300, None), (301, ""), (302, " \t\n"), (303, "one"), (304, "ONE"), (305, "a b c d"), (306, "a B c d"), (307, bases[3].upper()), (308, "word " * 9000), (309, "word word word word word"), (None, bases[1]), (None, "nobody else says this"), (5, bases[3]), (303, "one")]
    return out


def test_components_against_brute_force(spark, rows):
    docs = spark.createDataFrame([(i, t, 1, 2, "x") for i, t in rows], DOCS).repartition(3)
    got = {(r.doc_id, r.n_shingles, r.component_id) for r in similar_documents(docs, chunk=8).collect()}
    assert got == {(i, n, c) for (i, _), (n, c) in zip(rows, brute(rows), strict=True)}


def test_keep_one_of_each(spark, rows):
    docs = spark.createDataFrame([(i, t, 1, 2, "x") for i, t in rows], DOCS)
    out = keep_one_of_each(docs)
    assert out.columns == docs.columns
    want = {(i, t) for (i, t), (_, c) in zip(rows, brute(rows), strict=True) if i == c}
    assert sorted((r.doc_id is None, r.doc_id or 0, r.text or "") for r in out.collect()) == sorted((i is None, i or 0, t or "") for i, t in want)


def test_similarity_empty(spark):
    assert similar_documents(spark.createDataFrame([], DOCS)).count() == 0
    assert keep_one_of_each(spark.createDataFrame([], DOCS)).count() == 0


@settings(max_examples=40, deadline=None)
@given(st.lists(st.lists(st.integers(0, 60), min_size=1, max_size=40, unique=True), min_size=1, max_size=40))
def test_tree_loses_no_link(lists):
    class Words(dict):
        def __missing__(self, w):
            import xxhash

            return xxhash.xxh3_64_intdigest(w)

    sets = [shingles(" ".join(f"t{x}" for x in s).encode(), Words(), 1) for s in lists]
    n = np.array([len(s) for s in sets])
    bits = np.stack([_bitmap(s) for s in sets]).view(np.uint64)
    slack = n - np.array([np.bitwise_count(b).sum() for b in bits])
    tree = SignatureTree(bits, n, slack, np.arange(len(sets)))
    found = set(zip(*(x.tolist() for x in tree.pairs()), strict=True))
    for i in range(len(sets)):
        for j in range(i + 1, len(sets)):
            if linked(len(np.intersect1d(sets[i], sets[j])), n[i], n[j]):
                assert (i, j) in found


def bucket_rows(sets, buckets, labels):
    """Rows of the traversal, sorted by bucket; each bucket has its documents in another order."""
    rng, out = np.random.default_rng(9), []
    for token in range(buckets):
        out += [(token, 0, 0, 0, 0, int(k), labels[k], len(sets[k]), _bitmap(sets[k]).tobytes()) for k in rng.permutation(len(sets))]
    kinds = (pa.int64(), *[pa.int32()] * 4, *[pa.int64()] * 3, pa.binary())
    names = ["token", "band", "lo", "hi", "own", "node", "label", "n", "bits"]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names)


@pytest.mark.parametrize("buckets", [1, 30])
@pytest.mark.parametrize("grouped", [False, True])
def test_traversal_makes_a_forest(buckets, grouped):
    rng = np.random.default_rng(8)
    bases = [np.unique(rng.integers(0, 2**63, 400).astype(np.uint64)) for _ in range(3)]
    sets = [np.unique(np.concatenate([bases[k % 3][rng.permutation(400)[:385]], rng.integers(0, 2**63, 15).astype(np.uint64)])) for k in range(240)]
    labels = [k % 12 if grouped else k for k in range(240)]  # 3 groups of alike sets
    made = [(a, b) for batch in _survivors(iter([bucket_rows(sets, buckets, labels)])) for a, b in zip(*(c.to_pylist() for c in batch.columns), strict=True)]
    # As few edges as join the 240 nodes to 3 trees, however many buckets they share and pairs they are.
    assert len(made) == 237
    assert all(a % 3 == b % 3 for a, b in made)
    group = list(range(240))
    for a, b in made:
        old, new = group[a], group[b]
        group = [new if g == old else g for g in group]
    assert len(set(group)) == 3


def test_folded_bitmaps():
    rng = np.random.default_rng(2)
    for n in (1023, 1024, 5000):
        h = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))[:n]
        small = np.zeros(2048, np.uint8)
        small[(h & np.uint64(2047)).astype(int)] = 1
        assert np.array_equal(_folded(_bitmap(h).tobytes(), 2048), np.packbits(small).view(np.uint64))


def test_components_of_chains_and_stars(spark):
    chain = [(k, k + 1) for k in range(50)]
    star = [(1000, 1000 + k) for k in range(1, 80)]
    edges = spark.createDataFrame([*chain, *star, (7, 7), (5000, 5000), (None, 3)], "a long, b long")
    got = dict(map(tuple, components(edges).collect()))
    assert got == {**dict.fromkeys(range(51), 0), **dict.fromkeys(range(1000, 1080), 1000), 5000: 5000}
    assert components(edges.limit(0)).count() == 0


VECTORS = "vec_id long, embedding array<float>, rep long, copies long, v string"


def test_vectors_against_brute_force(spark):
    rng = np.random.default_rng(5)
    base = rng.standard_normal((60, 16))
    rows = [(k, (base[k % 60] + 0.06 * rng.standard_normal(16) * (k % 4)).astype("f4").tolist()) for k in range(400)]
    rows += [(500 + k, rows[0][1]) for k in range(50)]
    odd = [(600, None), (601, []), (602, [0.0] * 16), (603, [float("nan")] * 16), (604, [float("inf")] + [1.0] * 15), (605, [None] + [1.0] * 15), (606, [1.0, 2.0]), (607, [2.0, 4.0]), (608, [x * 1e30 for x in rows[1][1]])]
    frame = spark.createDataFrame([(i, v, 1, 2, "x") for i, v in [*rows, *odd, (None, rows[0][1])]], VECTORS)
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in near_duplicates(frame, leaf=32, chunk=40, sample_rows=200).collect()}
    good = [(i, np.array(v, "f4").astype(float)) for i, v in [*rows, odd[-1]]]
    x = np.stack([v / np.linalg.norm(v) for _, v in good])
    near = x @ x.T >= 0.95
    np.fill_diagonal(near, False)
    ids = np.array([i for i, _ in good])
    label = ids.copy()
    for _ in range(len(ids)):
        new = np.array([min([label[k], *label[near[k]]]) for k in range(len(ids))])
        if (new == label).all():
            break
        label = new
    links = sum(got[i][0] for i in ids.tolist())
    assert links >= 0.97 * near.sum() and all(got[i][0] <= n for i, n in zip(ids.tolist(), near.sum(1), strict=True))
    assert sum(got[i][1] != c for i, c in zip(ids.tolist(), label.tolist(), strict=True)) <= 0.03 * len(ids)
    assert got[606] == (1, 606, True) and got[607] == (1, 606, False)
    assert all(got[i] == (0, i, True) for i in range(600, 606))
    assert got[None] == (0, None, False)
    assert near_duplicates(frame.limit(0)).count() == 0


def test_recall_on_the_table(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    more = e.union(e.select(F.col("vec_id") + 10_000, F.transform("embedding", lambda x: x + F.lit(0.02).cast("float"))))
    got = {r.vec_id: r.n_links for r in near_duplicates(more, leaf=64).collect()}
    rows = more.collect()
    x = np.array([r.embedding for r in rows], float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    want = (x @ x.T >= 0.95).sum(1) - 1
    assert want.sum() > 500
    assert sum(got[r.vec_id] for r in rows) >= 0.9 * want.sum()


def test_forest_is_bounded_by_its_sample():
    rng = np.random.default_rng(4)
    units = rng.standard_normal((2000, 64))
    units /= np.linalg.norm(units, axis=1, keepdims=True)
    small, large = fit_forest(units, 10**6), fit_forest(units, 10**12)
    for a, b in zip(small, large, strict=True):
        assert len(a.nodes) <= len(b.nodes) == len(b.ends) - 1 < 2000 and b.tails.size < 2000 * 48
    # Below the sampled nodes, the shared thresholds go on splitting.
    sizes = lambda f: np.unique(np.concatenate(leaves_of(units, f)), return_counts=True)[1]
    assert sizes(large).max() < sizes(small).max() < 2000 and np.median(sizes(large)) <= 4


def test_places_of_near_copies_are_bounded():
    """Cuts through a group of near copies sent each of its vectors into hundreds of leaves at millions of rows."""
    rng = np.random.default_rng(7)
    units = rng.standard_normal((8000, 64))
    units[:400] = units[0] + 0.02 * rng.standard_normal((400, 64))
    units /= np.linalg.norm(units, axis=1, keepdims=True)
    for rows in (10**5, 10**7, 10**9):
        found = leaves_of(units, fit_forest(units, rows))
        assert max(map(len, found)) <= TREES * MOST and min(map(len, found)) >= TREES
        sets = [set(x.tolist()) for x in found[:400]]
        assert all(sets[0] & x for x in sets)


def test_recall_with_shipped_parameters(spark):
    rng = np.random.default_rng(6)
    base = rng.standard_normal((3000, 32))
    x = (base[rng.integers(0, 3000, 9000)] + 0.12 * rng.standard_normal((9000, 32))).astype("f4")
    frame = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<float>").repartition(4)
    got = {r.vec_id: r.n_links for r in near_duplicates(frame).collect()}
    u = x.astype(float)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    want = (u @ u.T >= 0.95).sum(1) - 1
    assert len(x) > 4 * LEAF and want.sum() > 5000
    assert all(got[k] <= n for k, n in enumerate(want.tolist())) and sum(got.values()) >= 0.9 * want.sum()
