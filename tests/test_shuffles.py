"""What is shuffled: keys and narrow rows, no texts."""

import re

from tessella.operators import analytics, chunking, extraction, graph, wiki
from tessella.plans import catalog


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def exchanges(df):
    return len(re.findall(r"\bExchange (?!SinglePartition)", plan(df)))


def test_texts_of_segments_are_made_within_the_row(spark, sf_dir):
    got = catalog.queries()["book_segment_texts"](spark, sf_dir)
    assert exchanges(got) == 1 and "Join" not in plan(got)
    assert exchanges(catalog.queries()["segment_texts"](spark, sf_dir)) == 0


def test_segment_texts_by_another_plan(spark):
    docs = spark.createDataFrame([(1, "# A\n\none\n\n# B\n\ntwo"), (2, None)], "doc_id int, text string")
    by_two = lambda atoms: [chunking.Segment("", k, min(k + 1, len(atoms) - 1), 1.0) for k in range(0, len(atoms), 2)]
    got = chunking.segment_texts(docs, by_two).orderBy("doc_id", "segment").collect()
    assert [tuple(r) for r in got] == [(1, 0, "A\n\none"), (1, 1, "B\n\ntwo")]


def test_chunks_meet_their_segment_within_the_row(spark, sf_dir):
    got = catalog.queries()["book_context"](spark, sf_dir)
    assert exchanges(got) == 1 and "Join" not in plan(got)
    long = "\n\n".join(f"## Part {k}\n\n" + f"word{k} " * 1500 for k in range(4))
    docs = spark.createDataFrame([(1, long), (2, "# A\n\nshort"), (3, ""), (4, None)], "doc_id int, text string")
    rows = chunking.graph_chunks(docs, 2000, 500).orderBy("doc_id", "idx").collect()
    segments = {(r.doc_id, r.idx): r for r in chunking.segments(docs.where("doc_id = 1")).collect()}
    atoms, n = chunking.atoms(docs.where("doc_id = 1")).count(), sum(r.doc_id == 1 for r in rows)
    assert len(segments) > 1 and [r.content for r in rows if r.doc_id > 1] == ["# A\n\nshort", "", ""]
    for r in rows[:n]:
        seg = segments[1, r.segment]
        assert seg.start_atom <= int(r.idx / n * atoms) <= seg.end_atom
        assert r.content.startswith(f'[Context: Segment "{seg.title}"]\n{seg.summary[:600].strip(" ")}\n[Section: ')


def test_depths_join_only_what_is_not_done(spark, monkeypatch):
    sizes, write = [], graph.written
    monkeypatch.setattr(graph, "written", lambda df: (sizes.append(df.count()), write(df))[1])
    tree = spark.range(1000).selectExpr("id", "CAST(CASE WHEN id BETWEEN 1 AND 8 THEN id - 1 WHEN id > 990 THEN id + 9 END AS bigint) AS parent_id")
    tree = tree.union(spark.createDataFrame([(5000, 5001), (5001, 5000), (5002, 5001)], "id long, parent_id long"))
    got = {r.id: r.depth for r in graph.depths(tree).collect()}
    assert got == {k: k if k <= 8 else 1 if k > 990 else 0 for k in range(1000)} | dict.fromkeys((5000, 5001, 5002))
    assert sizes[0] == 1003 and sizes[1] == 20 and all(n <= 20 for n in sizes[1:])  # roots, that all share a null, are in no join


def test_parts_in_one_split_are_dealt_before_python(spark, sf_dir):
    for name in ("content_markers", "content_segments", "content_replaced", "extracted_tags"):
        steps = plan(catalog.queries()[name](spark, sf_dir))
        assert re.search(r"(?s)MapInArrow.*Exchange hashpartitioning\(p_partkey.*REPARTITION_BY_COL.*Scan parquet", steps), name


def test_links_are_dealt_by_their_number(spark, monkeypatch):
    monkeypatch.setattr(wiki, "ROWS", 100)
    new = spark.range(2000).selectExpr("id % 50 AS from_id", "id % 37 AS to_id", "'with' AS relation")
    got = wiki.upsert_links(new.where("from_id < 9"), new)
    assert sorted(map(tuple, got.collect())) == sorted({(k % 50, k % 37, "with") for k in range(2000)})
    assert re.search(r"hashpartitioning\(from_id#\d+L?, 24\), REPARTITION_BY_NUM", plan(got))  # 2,000 and 360 rows, 100 a part


def test_overview_counts_its_nodes_once(spark):
    edges = spark.range(4000).selectExpr("concat('p', id) AS source", "concat('s', id % 90) AS target")
    nodes = edges.selectExpr("source AS id", "concat(substr(source, 2) % 3, '/c') AS source_id").union(edges.selectExpr("target", "'0/c<SEP>1/c'").distinct())
    got = graph.overview(nodes, edges, 40, 1)
    assert "Aggregate" in plan(got) and "concat(p" not in plan(got)  # degrees are read from what was written
    assert "WindowGroupLimit" in plan(got)  # a document's best are told before its nodes meet in one task
    rows = {r.node: r for r in got.collect()}
    assert len(rows) == 40 and all(r.degree >= 44 for n, r in rows.items() if n[0] == "s")
    assert sum(n[0] == "s" for n in rows) == 31 and sum(n[0] == "p" for n in rows) == 9  # 13 shared, 9 of the third document, 18 of the rest


def test_segments_bring_the_atoms_of_their_document(spark, sf_dir):
    for name in ("book_segment_metrics", "segment_metrics"):
        got = catalog.queries()[name](spark, sf_dir)
        assert plan(got).count("MapInArrow") == 1 and "Join" not in plan(got)  # texts are read once
    cut = spark.createDataFrame([(1, 10, 0, 1, 8), (1, 13, 2, 3, 8), (2, 5, 0, 2, 3)], "doc_id int, tokens long, start_atom int, end_atom int, doc_atoms int")
    assert sorted(map(tuple, analytics.segmentation_metrics(cut).collect())) == [(1, 2, 12, 13, 0.5), (2, 1, 5, 5, 1.0)]


def test_extractor_sees_lists_of_a_batch_from_arrow(spark, tmp_path):
    def lengths(texts):
        return [{"entities": [{"name": f"n{len(texts)}"}], "relations": [{"source": t, "target": "x"}]} for t in texts]

    chunks = spark.range(0, 70, 1, 1).selectExpr("concat('d/', id) AS chunk_id", "concat('text ', id) AS content")
    texts = chunks.coalesce(1)
    got = extraction.extract(texts, lengths, str(tmp_path / "store"), batch=8).collect()
    assert len(got) == 70 and {e.name for r in got for e in r.entities} <= {f"n{k}" for k in range(1, 9)}
    assert sorted(r.relations[0].source for r in got) == sorted(f"text {k}" for k in range(70))
    assert all(r.error is None and r.relations[0].weight == 1.0 and r.entities[0].type == "other" for r in got)


def test_extraction_holds_no_frames_of_whole_batches(spark, tmp_path, monkeypatch):
    seen, made = [], type(spark.range(1)).mapInArrow
    monkeypatch.setattr(type(spark.range(1)), "mapInArrow", lambda df, *a, **k: (seen.append(1), made(df, *a, **k))[1])
    extraction.extract(spark.createDataFrame([("d/1", "One"), ("d/2", None)], "chunk_id string, content string"), lambda t: [{} for _ in t], str(tmp_path / "s"))
    assert seen
