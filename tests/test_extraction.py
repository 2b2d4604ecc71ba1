import random
import re

from pyspark.sql import functions as F

from tessella.operators import extraction

CHUNKS = "chunk_id string, content string"


def made(n, seed=1):
    rng = random.Random(seed)
    names = ["Ada", "Babbage", "Engine", "London", "Byron", "Lovelace"]
    return [(f"d{k % 5}/{k}", " ".join(rng.choice(names) if rng.random() < 0.5 else "and" for _ in range(6)) + (" boom" if k == 3 else "")) for k in range(n)] + [("d9/1", None), ("d9/2", "")]


def extractor(log):
    def run(texts):
        with open(log, "a") as f:
            f.writelines(f"{t!r}\n" for t in texts)
        if any("boom" in t for t in texts):
            raise RuntimeError("no answer")
        out = []
        for t in texts:
            found = re.findall("[A-Z][a-z]+", t)
            entities = [{"name": f" {w} ", "type": "Person" if len(w) < 5 else "planet", "description": f"{w} in {len(t)}"} for w in dict.fromkeys(found)]
            out.append({"entities": [*entities, {"name": ""}], "relations": [{"source": a, "target": b, "weight": 2} for a, b in zip(found, found[1:], strict=False)]})
        return out

    return run


def tables(df_pair):
    return [sorted(map(tuple, df.select(*sorted(df.columns)).collect())) for df in df_pair]


def test_each_distinct_text_is_handed_over_once(spark, tmp_path):
    log, store = str(tmp_path / "log"), str(tmp_path / "store")
    rows = made(30)
    rows += [(f"copy/{k}", rows[k][1]) for k in range(10)]
    chunks = spark.createDataFrame(rows, CHUNKS)
    got = extraction.extract(chunks, extractor(log), store, ("person", "place")).collect()
    texts = {t or "" for _, t in rows}
    assert len(got) == len(texts) and [r.error for r in got if r.error] == ["RuntimeError: no answer"]
    calls = open(log).read().splitlines()
    lone = [c for c in calls if calls.count(c) > 1]
    assert {c for c in calls} == {repr(t) for t in texts} and len(lone) <= 2 * 16  # only the list with the failure was asked again
    assert {e.type for r in got for e in r.entities} == {"person", "other"}
    before = len(calls)
    more = spark.createDataFrame([*rows, ("new/1", "Ada and Turing")], CHUNKS)
    extraction.extract(more, extractor(log), store)
    assert set(open(log).read().splitlines()[before:]) == {repr("Ada and Turing"), repr(rows[3][1])}  # new, and failed before


def test_purge_gives_the_graph_of_the_other_documents(spark, tmp_path):
    chunks = spark.createDataFrame(made(40, seed=4), CHUNKS)
    results = extraction.extract(chunks, extractor(str(tmp_path / "log")), str(tmp_path / "store"))
    said = extraction.mentions(chunks, results)
    nodes, edges = extraction.merge_mentions(*said)
    ada = nodes.where("id = 'Ada'").first()
    want = {c for c, t in made(40, seed=4) if t and "boom" not in t and "Ada" in t}
    assert set(ada.source_id.split("<SEP>")) == want and ada.entity_type == "person"
    total = sum(sum({a, b} == {"Ada", "Engine"} for a, b in zip(w, w[1:], strict=False)) for t in (t for _, t in made(40, seed=4)) if t and "boom" not in t for w in [re.findall("[A-Z][a-z]+", t)])
    assert edges.where("source = 'Ada' AND target = 'Engine'").first().weight == 2.0 * total
    for gone in (["d1"], ["d0", "d2", "d3", "d4"], ["d0", "d1", "d2", "d3", "d4"], ["none"]):
        out = extraction.purge(nodes, edges, *said, spark.createDataFrame([(g,) for g in gone], "doc_id string"))
        left = chunks.where(~F.substring_index("chunk_id", "/", 1).isin(gone))
        assert tables(out) == tables(extraction.merge_mentions(*extraction.mentions(left, results)))
