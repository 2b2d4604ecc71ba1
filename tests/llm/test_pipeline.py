import re
from collections import Counter

import corpus_pipeline
import pytest
from pyspark.sql import functions as F
from tessella.llm import quality_crf
from tests.llm.test_similarity import brute


def test_stages_against_their_own_input(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, seen = docs.columns, {"in": docs.collect()}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, sf_dir).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        seen[name] = docs.collect()
        if name != "encode":
            assert docs.columns == columns
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    good = {r.doc_id for r in seen["quality"]}
    held = [r.doc_id for r in seen["in"] if quality_crf.held_out(r.doc_id) and r.doc_id in labels]
    assert all((i in good) >= labels[i] for i in held) and len(good) < len(seen["in"])

    first = {}
    for r in sorted(seen["quality"], key=lambda r: r.doc_id):
        first.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", r.text), r.doc_id)
    assert sorted(r.doc_id for r in seen["exact_dedup"]) == sorted(first.values())

    rows = [(r.doc_id, r.text) for r in seen["exact_dedup"]]
    assert sorted(r.doc_id for r in seen["near_dedup"]) == sorted(i for (i, _), (_, c) in zip(rows, brute(rows), strict=True) if i == c)

    before, after = {r.doc_id: r for r in seen["near_dedup"]}, Counter(r.doc_id for r in seen["mix"])
    assert all(before[r.doc_id] == r for r in seen["mix"]) and max(after.values()) <= 3
    words = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t))
    total, taken = sum(words(r.text) for r in seen["near_dedup"]), sum(words(r.text) for r in seen["mix"])
    assert abs(taken / total - 1) < 0.25

    assert Counter(r.doc_id for r in seen["encode"]) == after and all(r.lossless for r in seen["encode"])
    run = corpus_pipeline.run(spark, sf_dir).collect()
    assert sorted(map(str, run)) == sorted(map(str, seen["encode"]))


CLASHES = "id key n part node hub own_sha own_key gone_id gone_sha g_id g_key maybe p_id p_source p_size p_copies p_n p_words p_each p_copy sieve_word sieve_bits word bits h1 h2 score size taken _t_id _t_key".split()


@pytest.fixture(scope="module")
def labels_dir(spark, tmp_path_factory):
    """A folder with labels for the rows below."""
    d = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame([(k, int(k % 2), 0) for k in range(12)], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    return d


def stages(spark, docs, d, tmp_path):
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, d).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        yield name, docs


def test_stages_with_odd_rows(spark, labels_dir, tmp_path):
    text = "A plain sentence about the river and the town, with some more words in it. " * 3
    rows = [(k, f"{text} Number {k} of many others that are not the same {k * 7}.", "ab"[k % 2], "en") for k in range(12)]
    rows += [(0, rows[0][1], "a", "en"), (0, rows[0][1], "a", "en"), (50, rows[3][1], None, None), (None, text, None, None), (None, text, None, None), (60, None, None, None), (61, "", "b", "en"), (62, "word " * 60_000, "b", "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string").withColumns({c: F.lit(c) for c in CLASHES})
    for name, out in stages(spark, docs, labels_dir, tmp_path):
        if name != "encode":
            assert out.columns == docs.columns
        got = out.collect()
        assert all(r[c] == c for r in got for c in CLASHES if name != "encode")
        ids = Counter(r.doc_id for r in got)
        if name == "exact_dedup":
            assert ids[0] <= 1 and not ids[50] and ids[None] <= 1
        if name == "near_dedup":
            assert max(ids.values(), default=1) == 1


def test_stages_of_an_empty_table(spark, labels_dir, tmp_path):
    docs = spark.createDataFrame([], "doc_id long, text string, source string, lang string")
    assert [out.count() for _, out in stages(spark, docs, labels_dir, tmp_path)] == [0] * 5
