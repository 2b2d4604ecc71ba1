from tessella.operators import retrieval

V = {"a": [1.0, 0.0], "b": [0.9, 0.3], "c": [0.0, 1.0], "d": [-1.0, 0.0]}


def tables(spark):
    chunks = spark.createDataFrame([(f"c{k}", V[v], 10) for k, v in enumerate("abcdab")], "chunk string, embedding array<double>, tokens int")
    entities = spark.createDataFrame([("A", V["a"], ["c3", "c0", "c5"]), ("B", V["b"], ["c1", "c0"]), ("C", V["c"], ["c0", "c2"]), ("D", V["d"], ["c3"])], "name string, embedding array<double>, chunk_ids array<string>")
    relations = spark.createDataFrame([("A", "B", V["d"], ["c4"]), ("A", "C", V["c"], ["c2", "c3"]), ("A", "A", V["c"], ["c5"])], "source string, target string, embedding array<double>, chunk_ids array<string>")
    return chunks, entities, relations


def got(spark, mode, **more):
    return [(r.chunk, r.origin) for r in retrieval.graph_retrieve(mode, *tables(spark), V["a"], V["c"], **more).orderBy("nth").collect()]


def test_modes_differ(spark):
    # c0 is shared by both neighbours of A, so it comes before c3, which is listed first.
    local = [("c0", "local"), ("c3", "local"), ("c5", "local"), ("c1", "local")]
    assert got(spark, "local") == local
    assert got(spark, "global") == [("c5", "global"), ("c2", "global"), ("c3", "global")]
    assert got(spark, "hybrid") == [("c0", "local"), ("c5", "global"), ("c3", "local"), ("c2", "global"), ("c1", "local")]
    assert got(spark, "naive") == [("c0", "vector"), ("c4", "vector"), ("c1", "vector"), ("c5", "vector")]
    assert got(spark, "mix") == [("c0", "vector"), ("c5", "global"), ("c4", "vector"), ("c3", "local"), ("c2", "global"), ("c1", "vector")]
    assert got(spark, "anything") == got(spark, "hybrid") and got(spark, "bypass") == []


def test_budget_and_scores(spark):
    assert got(spark, "hybrid", budget=25) == [("c0", "local"), ("c5", "global")]
    rows = {r.chunk: round(r.score, 4) for r in retrieval.graph_retrieve("mix", *tables(spark), V["a"], V["c"]).collect()}
    assert rows["c0"] == 0.75 and rows["c3"] == round(0.75 - 0.35 * 3 / 5, 4)  # a cosine of 1 is capped; the fourth of six by its place
