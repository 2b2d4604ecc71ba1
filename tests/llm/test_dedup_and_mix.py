import hashlib
import re
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from tessella.llm.exact_dedup import exact_dedup, keep_first_copies
from tessella.llm.mixing import mix_sources, source_targets, take_mix

SCHEMA = "doc_id long, text string, source string, kept string, h string, size long"
ROWS = [
    (5, "a b", "x", "clash", "h", 1),
    (3, "a\t\n b", "x", "clash", "h", 1),
    (3, "a b", "x", "clash", "h", 1),
    (3, "a b", "x", "clash", "h", 1),
    (7, None, "y", None, None, None),
    (8, "", None, "k", "h", 2),
    (9, " a b", "y", "k", "h", 2),
    (None, "a b", "", "k", "h", 2),
    (None, "only", "x", "k", "h", 2),
    (10, "w " * 3000, "y", "k", "h", 2),
]


def norm(t):
    return re.sub(r"[\x20\x09-\x0D]+", " ", t or "")


def test_exact_dedup_edges(spark):
    got = exact_dedup(spark.createDataFrame(ROWS, SCHEMA)).collect()
    assert len(got) == len(ROWS)
    texts = defaultdict(list)
    for r in ROWS:
        texts[norm(r[1])].append(r[0])
    by = Counter()
    for r in got:
        same = next(v for k, v in texts.items() if hashlib.sha256(k.encode()).hexdigest() == r.text_sha256)
        assert r.group_size == len(same)
        assert r.keep_id == min((x for x in same if x is not None), default=None)
        by[r.text_sha256] += r.kept
    assert set(by.values()) == {1}


def test_exact_dedup_compares_bytes(spark):
    docs = spark.createDataFrame([(1, "a"), (2, "b"), (3, "a"), (4, "c")], "doc_id long, text string")
    got = {r.doc_id: (r.keep_id, r.group_size, r.kept) for r in exact_dedup(docs, content_hash=lambda c: F.lit("same")).collect()}
    assert got == {1: (1, 2, True), 2: (2, 1, True), 3: (1, 2, False), 4: (4, 1, True)}


def test_keep_first_copies_keeps_columns(spark):
    docs = spark.createDataFrame(ROWS, SCHEMA)
    out = keep_first_copies(docs)
    assert out.columns == docs.columns
    assert sorted(norm(r.text) for r in out.collect()) == sorted({norm(r[1]) for r in ROWS})


def test_dedup_empty(spark):
    assert exact_dedup(spark.createDataFrame([], SCHEMA)).count() == 0
    assert keep_first_copies(spark.createDataFrame([], SCHEMA)).count() == 0


def fill(sizes, weights, most):
    """Water-filling, one capped source at a time."""
    total, target, open_ = sum(sizes.values()), {}, dict(weights)
    while open_:
        left = total - sum(target.values())
        share = {s: left * w / sum(open_.values()) for s, w in open_.items()}
        over = [s for s in open_ if share[s] > most * sizes[s]]
        if not over:
            return target | share
        for s in over:
            target[s] = most * sizes[s]
            del open_[s]
    return target


def test_targets_water_filling(spark):
    sizes = {"a": 1, "b": 1000, "c": 10, "d": 500, "e": 0, "f": 7}
    got = {r.source: r.target for r in source_targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long")).collect()}
    want = fill(sizes, dict(zip(sorted(sizes), (1, 2, 3, 1, 2, 3), strict=True)), 3)
    assert all(abs(got[s] - want[s]) < 1e-6 * max(1, want[s]) for s in sizes)


def test_mix_whole_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    a, b = (sorted(map(tuple, mix_sources(docs.repartition(n)).drop("copies").collect())) for n in (3, 7))
    assert a == b and len(a) == docs.count()
    taken, target, longest = Counter(), {}, Counter()
    for _, source, size, _, want, took in a:
        taken[source] += took
        target[source] = want
        longest[source] = max(longest[source], size)
        assert took <= 3 * size and (size == 0 or took % size == 0)
    assert all(abs(taken[s] - target[s]) <= longest[s] + 1 for s in target)


def test_mix_edges(spark):
    docs = spark.createDataFrame(ROWS, SCHEMA)
    got = mix_sources(docs).collect()
    assert len(got) == len(ROWS)
    assert {r.size for r in got if r.doc_id in (7, 8)} == {0}
    out = take_mix(docs)
    assert out.columns == docs.columns
    assert out.count() == sum(r.copies for r in got)
    assert mix_sources(spark.createDataFrame([], SCHEMA)).count() == 0
    assert take_mix(spark.createDataFrame([], SCHEMA)).count() == 0
