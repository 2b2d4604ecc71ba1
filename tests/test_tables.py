import sqlite3

import pytest
from pyspark.sql import functions as F

from tessella.operators import analytics, drafts, fulltext, fusion, graph, lookups, tasks, vector, wiki
from tessella.sources import files
from tessella.sources.html_markdown import to_markdown


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) if len(cols) > 1 else r[cols[0]] for r in df.collect())


def test_bm25_agrees_with_sqlite(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").where("lang = 'en'").select("doc_id", "text")
    c = sqlite3.connect(":memory:")
    c.execute("CREATE VIRTUAL TABLE f USING fts5(text, tokenize=\"unicode61 remove_diacritics 0 tokenchars '_'\")")
    for r in docs.collect():
        c.execute("INSERT INTO f(rowid, text) VALUES (?, ?)", (r.doc_id, r.text))
    for query, match in (("the license", '"the" OR "license"'), ("and the license version", '("and" "the" "license") OR ("the" "license" "version")')):
        want = dict(c.execute("SELECT rowid, rank FROM f WHERE f MATCH ?", (match,)).fetchall())
        got = {r.doc_id: r["rank"] for r in fulltext.bm25_rank(docs, query, "doc_id", ["text"]).collect()}
        assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-5 for k in want)
    index = fulltext.postings(docs)
    n, avg = docs.count(), docs.select(F.avg(F.size(fulltext.tx.tokens(F.col("text"))))).first()[0]
    via = {r.doc_id: r["rank"] for r in fulltext.search_postings(index, n, avg, "and the license version").collect()}
    assert via.keys() == got.keys() and all(abs(via[k] - got[k]) < 1e-9 for k in got)


def test_query_groups():
    assert fulltext.query_groups("a b a") == [["a"], ["b"]]
    assert fulltext.query_groups("w x y z") == [["w", "x", "y"], ["x", "y", "z"]]


def hits(spark, *h):
    return spark.createDataFrame([(d, c, t, x, float(s)) for d, c, t, x, s in h], "doc_id string, chunk_id string, title string, content string, score double")


def test_fusion_order(spark):
    direct = hits(spark, ("d", "1", "t", "x", 0.9), ("d", "2", "t", "x", 0.5))
    keyword = hits(spark, ("d", "2", "t", "x", 1.0), ("d", "3", "t", "x", 0.7))
    got = fusion.fuse({"direct": direct, "keyword": keyword, "graph": hits(spark, ("d", "3", "t", "x", 0.75), ("e", "1", "t", "x", 0.2))}, "nothing").collect()
    assert [(r.doc_id, r.chunk_id, r.source, r.score) for r in got] == [("d", "1", "direct", 0.9), ("d", "3", "fused", 0.75), ("d", "2", "fused", 0.5), ("e", "1", "graph", 0.2)]
    boosted = fusion.fuse({"direct": hits(spark, ("d", "1", "The exact words", "x", 0.2), ("d", "2", "t", "has the Exact words", 0.3))}, "exact words").collect()
    assert [r.chunk_id for r in boosted] == ["1", "2"] and boosted[0].score == 0.34


def test_graph_scores(spark):
    r = spark.createDataFrame([(None, 1), (None, 3), (0.9, 1), (0.1, 1)], "v double, nth int")
    assert [round(x[0], 3) for x in r.select(fusion.graph_branch_score(F.col("v"), F.col("nth"), F.lit(3.0))).collect()] == [0.75, 0.4, 0.75, 0.1]


def test_retries_wait_by_the_attempt_that_failed(spark):
    t = spark.createDataFrame([(1, 0), (2, 1), (3, 2)], "id int, attempt int").withColumns({"status": F.lit("failed"), "error": F.lit("timeout"), "finished_at": F.timestamp_seconds(F.lit(0))})
    got = tasks.retries(t).select("id", "attempt", F.unix_seconds("not_before").alias("s"))
    assert rows(got, "id", "attempt", "s") == [(1, 1, 120), (2, 2, 600)]


def test_vector_edges(spark):
    e = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, [1.0]), (4, [1.0, 1.0])], "vec_id long, embedding array<float>")
    assert rows(vector.search(e, [1.0, 0.0]), "vec_id", "score") == [(1, 1.0), (4, 0.707)]


def test_evidence_tiers(spark):
    e = spark.createDataFrame([("Alpha", ["d1/c1", "d1/c2"]), ("alpha", ["d2/c1"]), ("Alphabet", ["d3/c1"]), ("Beta", [])], "name string, chunk_ids array<string>")
    ask = lambda n: [r.chunk_id for r in graph.evidence(e, spark.createDataFrame([(n,)], "entity string"), 8).orderBy("nth").collect()]
    assert ask("Alpha") == ["d1/c1", "d1/c2"] and sorted(ask("ALPHA")) == ["d1/c1", "d1/c2", "d2/c1"] and ask("phabe") == ["d3/c1"] and ask(" ") == [] and ask("Beta") == []


def test_core_relaxes(spark):
    star = spark.createDataFrame([("hub", f"n{k}", 1) for k in range(10)], "source string, target string, weight int")
    assert graph.core(star, 50, 2).count() == 11
    ring = spark.createDataFrame([(f"n{k}", f"n{(k + 1) % 12}", 1) for k in range(12)] + [("n0", f"leaf{k}", 1) for k in range(3)] + [("n0", f"n{k}", 1) for k in range(2, 11)], "source string, target string, weight int")
    assert not [n for n in rows(graph.core(ring, 50, 2), "node") if n.startswith("leaf")]


def test_graph_mutations(spark):
    nodes = spark.createDataFrame([("a", "x", "A", "d1/c<SEP>d2/c"), ("b", None, "B", "d1/c"), ("c", "y", "C", "d2/c")], "id string, entity_type string, description string, source_id string")
    edges = spark.createDataFrame([("a", "b", 1), ("b", "c", 2), ("a", "c", 3)], "source string, target string, weight int")
    assert rows(graph.purge_documents(nodes, ["d1"]), "id", "source_id") == [("a", "d2/c"), ("c", "d2/c")]
    n, e = graph.merge_entities(nodes, edges, spark.createDataFrame([("b", "a")], "old string, new string"))
    assert rows(n, "id") == ["a", "c"] and rows(e, "source", "target", "weight") == [("a", "c", 5)]
    n, e = graph.delete_entities(nodes, edges, spark.createDataFrame([("a",)], "id string"))
    assert rows(n, "id") == ["b", "c"] and e.count() == 1
    tree = spark.createDataFrame([(1, None), (2, 1), (3, 2), (4, 99)], "id long, parent_id long")
    assert rows(graph.depths(tree), "id", "depth") == [(1, 0), (2, 1), (3, 2), (4, 1)]
    chain = spark.createDataFrame([(k, k - 1 if k else None) for k in range(300)] + [(1000, 1001), (1001, 1002), (1002, 1000), (1003, 1000)], "id long, parent_id long")
    got = {r.id: r.depth for r in graph.depths(chain).collect()}
    assert got == {**{k: k for k in range(300)}, **dict.fromkeys(range(1000, 1004))} and graph.depths(chain.limit(0)).count() == 0


def test_wiki_merge(spark):
    schema = "user_id string, type string, title string, slug string, content string, refs array<string>, confidence double, seq int"
    old = spark.createDataFrame([("u", "topic", "Machine learning basics", "ml", "old", ["c1"], 0.98, 0)], schema)
    new = spark.createDataFrame([("u", "claim", "Something else entirely", "se", "x" * 4000, ["c3"], 0.5, 0), ("u", "topic", "machine learning basics", "ml2", "new", ["c1", "c2"], 0.5, 1), ("u", "claim", "Something else entirely!", "se", "y", ["c4"], 0.5, 2)], schema)
    got = {r.title: r for r in wiki.merge_batch(old, new, "2024-01-01").collect()}
    a, b = got["Machine learning basics"], got["Something else entirely"]
    assert a.content == "old\n\n--- Update 2024-01-01 ---\nnew" and a.confidence == 1.0 and a.refs == ["c1", "c2"] and a.action == "update"
    assert len(got) == 2 and b.action == "create" and b.refs == ["c3", "c4"] and len(b.content) > 3000


def test_refs(spark):
    raw = spark.createDataFrame([(1, '[{"documentId":"d","chunkId":"c"},{"documentId":"e","chunkId":"c"},{"documentId":"d","chunkIndex":1},{"documentId":"d","chunkIndex":1}]'), (2, "{bad"), (3, None)], "id int, raw string")
    assert rows(raw.select("id", F.size(wiki.dedupe_refs(wiki.parse_refs(F.col("raw")))).alias("n")), "id", "n") == [(1, 2), (2, 0), (3, 0)]


def test_usage_reconciles(spark, sf_dir):
    from tessella.plans import fixtures as fx

    got = analytics.usage_by_dimension(fx.usage(spark, sf_dir), fx.models(spark, sf_dir)).groupBy("kind").agg(F.sum("tokens_in").alias("t"), F.sum("calls").alias("c")).collect()
    assert len({(r.t, r.c) for r in got}) == 1 and len(got) == 3


def test_tasks(spark):
    t = spark.createDataFrame(
        [(1, "document_convert", "completed", 10, None, 1, None), (2, "document_convert", "completed", 20, None, 1, None), (3, "rag_index", "completed", 21, 2, 1, None), (4, "rag_index", "failed", 22, 3, 1, None), (5, "rag_index", "failed", 11, 1, 1, None), (6, "other", "pending", 30, 99, 1, None)],
        "id long, type string, status string, at int, parent_id long, document_id long, operation_id string",
    ).withColumn("created_at", F.timestamp_seconds("at"))
    assert rows(tasks.latest_round(t), "id") == [2, 3, 4]
    assert rows(tasks.descendants(t, spark.createDataFrame([(2,)], "root long")), "id") == [3, 4]
    q = spark.createDataFrame([(1, "a", "pending", 3), (2, "a", "running", 5), (3, "a", "pending", 1), (4, "b", "pending", 2)], "id long, type string, status string, at int").withColumns({"created_at": F.timestamp_seconds("at"), "not_before": F.lit(None).cast("timestamp"), "user_id": F.lit(1)})
    assert rows(tasks.queue_positions(q), "id", "place", "total") == [(1, 4, 4), (2, 1, 4), (3, 2, 4), (4, 3, 4)]
    assert rows(tasks.claimable(q, "2024-01-01", {"a": 2, "b": 1}), "id") == [3, 4]
    f = spark.createDataFrame([(1, 1, "running", 1), (1, 2, "completed", 2), (1, 2, "running", 3), (1, 1, "failed", 9)], "task_id long, generation int, status string, at int").withColumn("at", F.timestamp_seconds("at"))
    assert [(r.generation, r.status) for r in tasks.fenced(f).collect()] == [(2, "completed")]


def test_pipeline_view(spark):
    cols = "doc_id int, status string, uploaded boolean, converted boolean, convert string, embed string, graph string, wiki string, convert_progress int, embed_progress int, graph_progress int, wiki_progress int"
    data = [(1, "processing", True, True, "running", None, None, None, 50, 0, 0, 0), (2, "processing", True, True, "completed", "running", None, None, 0, 70, 0, 0), (3, "x", True, True, "completed", "completed", "completed", "completed", 0, 0, 0, 0), (4, "x", True, True, "failed", "running", None, None, 0, 10, 0, 0), (5, "ready", True, True, None, None, None, None, 0, 0, 0, 0), (6, "x", True, True, "completed", "completed", "running", None, 0, 0, 40, 0)]
    got = {r.doc_id: r for r in tasks.pipeline(spark.createDataFrame(data, cols)).collect()}
    assert (got[1].convert_stage, got[1].split_stage, got[1].embed_stage, got[1].percent) == ("done", "active", "pending", 36)
    assert (got[2].embed_stage, got[2].index_stage) == ("done", "active") and got[2].display == "processing"
    assert got[3].ready and got[3].percent == 100 and got[3].display == "ready"
    assert got[4].failed and got[4].embed_stage == "active"
    assert got[5].ready and got[6].display == "enhancing"


def test_drafts(spark):
    s = spark.createDataFrame([("1", "a", "pending", None, None), ("2", "b", "locked", "old", 3)], "section_id string, title string, status string, content string, words long")
    v = spark.createDataFrame([("2", 1, "old")], "section_id string, version long, content string")
    locked, versions = drafts.confirm(s, v, spark.createDataFrame([("1", "two words 中文")], "section_id string, content string"))
    assert rows(locked, "section_id", "status", "words") == [("1", "locked", 4), ("2", "locked", 3)] and rows(versions, "section_id", "version") == [("1", 1), ("2", 1)]
    sec = spark.createDataFrame([("1", None, 0, "a", 10), ("2", "1", 1, "b", 20)], "id string, parent_id string, idx int, title string, words int")
    p = spark.createDataFrame([("2", None, None, None, None, "delete"), ("1", None, None, "A", None, "update"), ("tmp1", None, 2, "n", 5, "create"), ("tmp2", "tmp1", 3, "m", 5, "create")], "id string, parent_id string, idx int, title string, words int, action string")
    got = {r.title: r for r in drafts.patch_outline(sec, p).collect()}
    assert set(got) == {"A", "n", "m"} and got["m"].parent_id == got["n"].id and got["A"].words == 10
    m = spark.createDataFrame([("u", 1, ["chat"], [], False), ("u", 2, ["writing"], ["draft"], False), ("v", 3, ["embed"], [], True)], "user_id string, id int, capabilities array<string>, default_for array<string>, is_default boolean")
    assert rows(lookups.resolve_model(m, "draft", "chat"), "id") == [2]


def test_draft_export(spark):
    d = spark.createDataFrame([("d", "Title")], "draft_id string, title string")
    s = spark.createDataFrame([("d", "1", None, 0, "One", "see [IMAGE:a1] and [DIAGRAM:zz]", "confirmed"), ("d", "2", "1", 1, "Two", "text", "locked"), ("d", "3", None, 2, "No", "x", "pending")], "draft_id string, id string, parent_id string, idx int, title string, content string, status string")
    a = spark.createDataFrame([("d", "a1", "Pic", "p.png")], "draft_id string, asset_id string, title string, path string")
    got = wiki.draft_markdown(d, s, graph.depths(s), a).first().markdown
    assert got == "# Title\n\n## One\n\nsee ![Figure: Pic](p.png) and [DIAGRAM:zz]\n\n### Two\n\ntext"


def test_files(spark, tmp_path):
    (tmp_path / "a.txt").write_text("hello")
    (tmp_path / "b.html").write_text("<h1>T</h1><p>x <b>y</b></p>")
    (tmp_path / "c.exe").write_text("no")
    (tmp_path / "d.md").write_text("")
    up = files.uploads(spark, str(tmp_path))
    assert rows(up.where("accepted"), "name") == ["a.txt", "b.html"]
    assert rows(files.convert_text(up.where("accepted")), "markdown") == ["# T\n\nx **y**", "hello"]
    (tmp_path / "v").mkdir()
    (tmp_path / "v/e.bin").write_bytes(files.pack_vectors([[1.0, 2.0], [3.0, 4.0]]))
    (tmp_path / "v/bad.bin").write_bytes(b"\x01\x00\x00\x00\x02")
    assert [list(r.embedding) for r in files.read_packed_vectors(spark, str(tmp_path / "v")).orderBy("offset").collect()] == [[1.0, 2.0], [3.0, 4.0]]
    assert rows(files.kv_store(spark, '{"a": {"chunk_ids": ["1"]}, "b": {}}'), "name") == ["a", "b"] and files.kv_store(spark, "{bad").count() == 0 and files.kv_store(spark, None).count() == 0
    names = spark.createDataFrame([("chunk_10.md",), ("chunk_2.md",), ("other.md",)], "name string")
    assert [r.name for r in files.order_chunk_files(names).collect()] == ["chunk_2.md", "chunk_10.md", "other.md"]
    sse = spark.createDataFrame([('event: a\ndata: {"x":1}\n\ndata: {bad\n\n',)], "raw string")
    assert [(r.event, r.data and r.data.x) for r in files.sse_parse(sse, "x int").collect()][0] == ("a", 1)
    assert files.valid_checkpoint('{"version":1,"inputHash":"h","completed":[]}', "h") and files.valid_checkpoint("x", "h") is None


def test_markdown_of_pages():
    page = "<html><head><title>t</title></head><body><h2>H</h2><p>a <a href='u'>l</a><br>b</p><ol><li>x<li>y</ol><table><tr><th>k<th>v</tr><tr><td>1</td><td>2|3</td></tr></table><pre>c  d\n</pre><script>no()</script></body>"
    assert to_markdown(page) == "## H\n\na [l](u)\n\nb\n\n1. x\n\n2. y\n\n| k | v |\n| --- | --- |\n| 1 | 2\\|3 |\n\n```\nc  d\n```"


def test_streams(spark, tmp_path):
    from tessella.streaming import live

    src = tmp_path / "in"
    spark.createDataFrame([(1, 0, "running"), (1, 60, "running"), (2, 30, "completed"), (3, 900, "running")], "task_id long, s int, status string").select("task_id", F.timestamp_seconds("s").alias("ts"), "status").write.parquet(str(src))
    stream = spark.readStream.schema("task_id long, ts timestamp, status string").parquet(str(src))
    q = live.stalls(stream).writeStream.format("memory").queryName("stalled").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    assert rows(spark.table("stalled"), "task_id") == [1]
    q = live.incremental(stream, lambda b: b.groupBy("task_id").count(), str(tmp_path / "out"), str(tmp_path / "c2")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 3
    u = spark.readStream.schema("task_id long, ts timestamp, status string").parquet(str(src)).select("ts", F.col("status").alias("module"), F.lit(1).alias("tokens_in"), F.lit(2).alias("tokens_out"))
    q = live.usage_trend(u).writeStream.format("memory").queryName("trend").outputMode("complete").option("checkpointLocation", str(tmp_path / "c3")).start()
    q.processAllAvailable()
    q.stop()
    assert rows(spark.table("trend"), "module", "tokens") == [("completed", 3), ("running", 9)]


def test_search_api(spark):
    from tessella.plans import search

    c = spark.createDataFrame([("d", "1", "t", "alpha beta", [1.0, 0.0]), ("d", "2", "t", "beta gamma", [0.0, 1.0])], "doc_id string, chunk_id string, title string, content string, embedding array<float>")
    nodes = spark.createDataFrame([("gamma", ["d/2"])], "name string, chunk_ids array<string>")
    got = search.semantic(c, "gamma", [1.0, 0.0], nodes=nodes).collect()
    assert {r.chunk_id for r in got} == {"1", "2"} and [r.source for r in got if r.chunk_id == "2"] == ["fused"]
    docs = spark.createDataFrame([("d", "Doc")], "doc_id string, name string")
    assert [(r.chunk_id, r.document_name, r.content) for r in search.entity_evidence(nodes, c, docs, "GAMMA").collect()] == [("d/2", "Doc", "beta gamma")]


@pytest.mark.parametrize("query", ["", "!!!"])
def test_empty_queries(spark, query):
    d = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    assert fulltext.keyword_search(d, query).count() == 0


def test_details(spark):
    from tessella.functions import text as tx
    from tessella.operators import details

    t = spark.createDataFrame([("## 1.2 My Title\n\nbody", "My title"), ("## 1.2 My Title\n\nbody", "My Title"), ("My Title:\nbody", "3. **My Title**"), ("", "x")], "c string, t string")
    assert [r[0] for r in t.select(details.strip_leading_title(F.col("c"), F.col("t"))).collect()] == ["## 1.2 My Title\n\nbody", "body", "body", ""]
    task = spark.createDataFrame([(1, "failed", 0, "Lock TIMEOUT", 5), (2, "failed", 2, "timeout", 5), (3, "failed", 0, "bad", 5)], "id int, status string, attempt int, error string, at int").withColumn("finished_at", F.timestamp_seconds("at"))
    assert rows(details.cleanup_retries(task, 2, 60_000), "id", "attempt") == [(1, 1)]
    h = spark.createDataFrame([(k, "x" * 600) for k in range(1, 8)], "rank int, content string")
    assert details.domain_context(h).first().context.count("[") == 5
    q = spark.createDataFrame([("  Hello  WORLD ", "https://h/v1/chat/completions/", "12", "d/c")], "q string, u string, r string, k string")
    got = q.select(tx.normalise_query(F.col("q")), tx.api_base(F.col("u")), tx.retry_after_seconds(F.col("r")), tx.document_of_chunk(F.col("k")), tx.strip_number(F.lit("1.2 Name")), tx.truncate(F.lit("abcdef"), 3), tx.sanitize_filename(F.lit("a/b")), F.size(tx.triples(F.array(*map(F.lit, "abcd")))), details.document_locale(F.lit("标题"))).first()
    assert list(got) == ["hello world", "https://h/v1", 12, "d", "Name", "abc…", "a_b", 2, "zh-CN"]
    terms = q.select(tx.query_terms(F.lit("search 知识图谱检索 x")), tx.search_terms(F.lit("One two, one a")), tx.rewrite_image_urls(F.lit("![a](images/p.png)"), "/api")).first()
    assert terms[0] == ["search 知识图谱检索 x", "search", "知识", "图谱", "检索"] and terms[1] == ["One", "two"] and terms[2] == "![a](/api/p.png)"


def test_document_delete(spark):
    from tessella.operators import details

    docs = spark.createDataFrame([(1, 1), (2, 1), (3, 2)], "doc_id int, user_id int")
    chunks = spark.createDataFrame([(1, "1a"), (1, "1b"), (2, "2a"), (3, "3a")], "doc_id int, chunk_id string")
    tags = spark.createDataFrame([(1, "x"), (3, "y")], "doc_id int, tag string")
    index = spark.createDataFrame([("1a", "t"), ("1b", "t"), ("2a", "t"), ("3a", "u"), ("old", "t")], "chunk_id string, term string")
    asked = spark.createDataFrame([(1,), (1,), (3,), (9,)], "doc_id int")
    left, kids, found, outcome = details.delete_documents(docs, asked, 1, {"chunks": chunks, "tags": tags}, index)
    values = lambda df, c: sorted(r[c] for r in df.collect())
    assert values(left, "doc_id") == [2, 3]
    assert values(kids["chunks"], "chunk_id") == ["2a", "3a"] and values(kids["tags"], "tag") == ["y"]
    assert values(found, "chunk_id") == ["2a", "3a"]  # with the orphan of an earlier delete swept
    assert {r.doc_id: r.outcome for r in outcome.collect()} == {1: "deleted", 3: "not found", 9: "not found"}
