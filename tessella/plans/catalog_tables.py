"""Queries of the table operators that no other query runs."""

from __future__ import annotations

import re

from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tessella.functions import backoff, diagrams
from tessella.functions import text as tx
from tessella.operators import analytics, details, drafts, extraction, fulltext, fusion, graph, lookups, retrieval, tasks, vector, wiki
from tessella.plans import fixtures as fx
from tessella.plans import search
from tessella.plans.catalog import PHRASE, SEARCH, _nearest, query
from tessella.sources import files, stores
from tessella.storage import scratch

# -- sources


@query
def upload_layers(spark, d):
    """Suppliers as documents, their lines as pages: the text layer, the route, and whether a conversion lost too much."""
    li = fx.read(spark, d, "lineitem")
    place = F.row_number().over(W.partitionBy("l_suppkey").orderBy("l_orderkey", "l_linenumber", "l_partkey")) - 1
    pages = li.select(F.col("l_suppkey").alias("doc_id"), place.alias("page"), F.repeat(F.lit("x"), (F.col("l_quantity") * 2).cast("int")).alias("text"))
    got = files.text_layer(pages)
    poor = files.poor_coverage(F.col("doc_id") % 10, F.lit(10), F.col("pages"), F.col("pages") + 400)
    return got.select("doc_id", "pages", F.round("ratio", 6).alias("ratio"), files.takes_bypass(F.col("pages"), F.col("ratio")).alias("bypass"), poor.alias("poor"))


@query
def synthesized_headings(spark, d):
    k = F.col("p_partkey")
    line = F.when(k % 4 == 0, F.concat(F.lit("1.2 "), F.col("p_name"))).when(k % 4 == 1, F.concat(F.lit("Chapter 3 "), F.col("p_name"))).when(k % 4 == 2, F.concat(F.lit("4. "), F.col("p_name"), F.lit("."))).otherwise(F.col("p_name"))
    return files.synthesize_headings(fx.read(spark, d, "part").select("p_partkey", line.alias("line")))


@query
def structure_buckets(spark, d):
    labels = F.element_at(F.array(*[F.lit(x) for x in ("title", "text", "table", "picture", "section_header")]), (F.col("l_linenumber") % 5 + 1).cast("int"))
    li = fx.read(spark, d, "lineitem")
    items = li.select(F.col("l_orderkey").alias("doc_id"), F.concat_ws("-", "l_linenumber", "l_partkey", "l_suppkey").alias("idx"), labels.alias("label"), F.col("l_linestatus").alias("text"), F.lit(1).alias("level"), F.col("l_linenumber").alias("page"))
    got = files.structure(items)
    return got.select("doc_id", *[F.size(b).alias(b) for b in ("sections", "texts", "tables", "pictures")])


@query
def image_manifest(spark, d):
    docs = fx.read(spark, d, "documents")
    return files.image_manifest(docs.select((F.col("doc_id") % 50).alias("doc_id"), F.col("doc_id").alias("idx"), F.encode(F.col("text"), "UTF-8").alias("content"))).select("doc_id", "filename")


@query
def conversion_cache(spark, d):
    docs = fx.read(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("hash"), F.octet_length("text").alias("size"))
    done = docs.select("hash", "size", F.when(F.col("doc_id") % 3 == 0, "v2").otherwise("v1").alias("version"), (F.col("doc_id") % 2 == 0).alias("complete"))
    return files.conversion_misses(docs, done, "v2").select("doc_id")


@query
def event_stream_text(spark, d):
    """Events written as a stream of text and read again; every seventh one is cut off."""
    e = fx.read(spark, d, "events")
    raw = files.sse_encode(F.col("event_type"), F.struct("event_id", F.floor("value").cast("long").alias("n")))
    cut = e.select(F.when(F.col("event_id") % 7 == 0, F.concat(F.lit("event: "), "event_type", F.lit("\ndata: {bad\n\n"))).otherwise(raw).alias("raw"))
    return files.sse_parse(cut, "event_id long, n long").select("event", "data.event_id", "data.n").groupBy("event").agg(F.count("*").alias("events"), F.count("event_id").alias("whole"), F.sum("n").alias("total"))


@query
def model_catalog(spark, d):
    p = fx.read(spark, d, "part")
    return lookups.model_catalog(p.select(F.concat(F.lit(" "), "p_brand", F.lit(" ")).alias("model"), (F.length("p_brand") * 100 - 700).alias("context")))


@query
def usage_sink(spark, d):
    u = fx.usage(spark, d)
    return analytics.record_usage(u.withColumns({"tokens_in": F.when(F.col("tokens_in") % 3 > 0, F.col("tokens_in") % 3), "tokens_out": F.col("tokens_out") % 2})).select("id", "tokens_in", "tokens_out")


@query
def packed_vector_scan(spark, d):
    """The embeddings as packed files, and read back in byte ranges."""
    stores.register(spark)
    at = scratch(spark)
    fx.read(spark, d, "embeddings").select("embedding").write.format("packed_vectors").option("rowsPerFile", 10_000).mode("append").save(at)
    got = spark.read.format("packed_vectors").option("spanBytes", 1 << 16).load(at)
    return got.select(F.size("embedding").alias("dimensions"), F.round(F.get("embedding", F.lit(0)).cast("double"), 6).alias("first"), F.round(F.get("embedding", F.lit(63)).cast("double"), 6).alias("last"))


@query
def event_text_scan(spark, d):
    """The events as event-stream text, and read back through the source."""
    stores.register(spark)
    at = scratch(spark)
    e = fx.read(spark, d, "events")
    e.select(F.concat(F.lit("event: "), "event_type", F.lit("\ndata: "), F.to_json(F.struct("event_id", "user_id")), F.lit("\n"))).write.text(at)
    got = spark.read.format("event_text").option("spanBytes", 1 << 16).load(at).withColumn("d", F.from_json("data", "event_id long, user_id long"))
    return got.groupBy("event").agg(F.count("*").alias("events"), F.sum("d.event_id").alias("ids"), F.countDistinct("d.user_id").alias("users"))


@query
def key_value_scan(spark, d):
    """Part names by brand with their suppliers as JSON files, read back as the store that the setting names."""
    at = scratch(spark)
    li = fx.read(spark, d, "lineitem").join(fx.read(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    ids = li.groupBy("p_brand", F.concat_ws(" ", "p_name", "p_partkey").alias("name")).agg(F.array_sort(F.collect_set(F.col("l_suppkey").cast("string"))).alias("chunk_ids"))
    text = ids.groupBy("p_brand").agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("name", F.struct("chunk_ids"))))).alias("value"))
    text.write.partitionBy("p_brand").text(at)
    settings = {"tessella.store.kv": "kv_store", "tessella.store.kv.path": at, "tessella.store.kv.ending": ".txt"}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        got = stores.open_store(spark, "kv")
    finally:
        for k in settings:
            spark.conf.unset(k)
    return got.select("name", F.size("chunk_ids").alias("sources"), F.concat_ws(",", "chunk_ids").alias("chunk_ids"))


@query
def orphan_folders(spark, d):
    folders = fx.read(spark, d, "orders").select((F.col("o_orderkey") % 3000).alias("doc_id")).distinct()
    return files.orphans(folders, fx.read(spark, d, "customer").select(F.col("c_custkey").alias("doc_id")))


@query
def okf_entries(spark, d):
    p = fx.read(spark, d, "part")
    e = p.select(F.format_string("%07d", "p_partkey").alias("slug"), F.col("p_name").alias("title"), F.col("p_type").alias("type"), (F.col("p_partkey") % 4 / 4).alias("confidence"), F.array("p_brand").alias("refs"), F.col("p_brand").alias("content"))
    return files.okf_entries(e).select("slug", F.md5("text").alias("digest"))


@query
def log_markdown(spark, d):
    o = fx.read(spark, d, "orders")
    changes = o.select((F.col("o_custkey") % 20).alias("user_id"), F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("created_at"), F.col("o_orderstatus").alias("action"), F.col("o_orderpriority").alias("summary"))
    return wiki.log_markdown(changes, 50).select("user_id", F.md5("markdown").alias("digest"))


@query
def draft_markdown(spark, d):
    """Drafts of orders: every second order hangs below the one before; images by marker, one in three without a file."""
    o = fx.read(spark, d, "orders")
    sections = o.select(F.col("o_custkey").alias("draft_id"), F.col("o_orderkey").alias("id"), F.when(F.col("o_orderkey") % 2 == 1, F.col("o_orderkey") - 1).alias("parent_id"), F.col("o_orderkey").alias("idx"), F.col("o_orderpriority").alias("title"), F.concat(F.lit("See [IMAGE:a"), (F.col("o_orderkey") % 3).cast("string"), F.lit("] and [DIAGRAM:zz]")).alias("content"), F.when(F.col("o_orderstatus") == "O", "pending").otherwise("confirmed").alias("status"))
    c = fx.read(spark, d, "customer")
    assets = c.select(F.col("c_custkey").alias("draft_id"), F.explode(F.array(*[F.struct(F.lit(f"a{k}").alias("asset_id"), F.lit(f"Pic {k}").alias("title"), F.lit(None if k == 2 else f"p{k}.png").alias("path")) for k in range(3)])).alias("a")).select("draft_id", "a.*")
    got = wiki.draft_markdown(c.select(F.col("c_custkey").alias("draft_id"), F.col("c_name").alias("title")), sections, graph.depths(sections), assets)
    return got.select("draft_id", F.md5("markdown").alias("digest"))


# -- search


@query
def indexed_keyword_search(spark, d):
    """Postings with chunks with documents: the stored postings of the query's terms, then the chunks that were found, then their documents."""
    docs = fx.read(spark, d, "documents")
    hits = fx.search_index(spark, d).rank(SEARCH).select("doc_id", "rank").orderBy("rank", "doc_id").limit(30)
    chunks = docs.select("doc_id", F.concat("source", F.lit("/"), F.col("doc_id").cast("string")).alias("chunk_id"))
    names = docs.groupBy("source").agg(F.count("*").alias("documents"))
    found = vector.with_content(hits, chunks, "doc_id")
    return found.join(names, F.substring_index("chunk_id", "/", 1) == F.col("source")).select("doc_id", "chunk_id", F.round("rank", 6).alias("rank"), "documents")


@query
def refreshed_postings(spark, d):
    docs = fx.read(spark, d, "documents")
    changed = docs.where("doc_id % 5 = 0").withColumn("text", F.col("source"))
    return fulltext.refresh_postings(fulltext.postings(docs), changed).groupBy("doc_id").agg(F.count("*").alias("terms"), F.sum("tf").alias("tokens"))


@query
def hybrid_search(spark, d):
    """Three branches: vectors, keywords, and chunks of entities, fused."""
    docs = fx.read(spark, d, "documents").select("doc_id", F.lit(0).alias("chunk_id"), F.substring("text", 1, 80).alias("title"), F.col("text").alias("content"))
    direct = vector.with_content(_nearest(spark, d, 40), docs, "doc_id")
    keyword = vector.with_content(fx.search_index(spark, d).search(PHRASE, 40).select("doc_id", "score"), docs, "doc_id")
    hits = fx.read(spark, d, "documents").select("doc_id", F.row_number().over(W.orderBy((F.col("doc_id") * 53 % 997), "doc_id")).alias("nth")).where("nth <= 40")  # a top-k
    entity = vector.with_content(hits.select("doc_id", fusion.graph_branch_score(F.lit(None).cast("double"), F.col("nth"), F.lit(40.0)).alias("score")), docs, "doc_id")
    return fusion.fuse({"direct": direct, "keyword": keyword, "graph": entity}, "Licensed under", 30).select("doc_id", "source", "score", "fusion", "rank")


def _graph(spark, d):
    """Documents as chunks, parts as entities, parts that follow each other in an order as relations; vectors by number."""
    e = fx.read(spark, d, "embeddings").select("vec_id", "embedding")
    vectors = e.count()  # one number
    chunk = F.concat(F.lit("d"), (F.col("l_orderkey") % vectors).cast("string"))
    li = fx.read(spark, d, "lineitem").select("l_partkey", "l_orderkey", "l_linenumber", chunk.alias("chunk"))
    lists = lambda *keys: F.array_sort(F.collect_set("chunk")).alias("chunk_ids")
    entities = li.groupBy("l_partkey").agg(lists()).join(e, F.col("l_partkey") % vectors == F.col("vec_id")).select(F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("name"), "embedding", "chunk_ids")
    before = F.lag("l_partkey").over(W.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey"))
    pairs = li.withColumn("before", before).where("before IS NOT NULL AND before <> l_partkey").select(F.least("before", "l_partkey").alias("a"), F.greatest("before", "l_partkey").alias("b"), "chunk")
    relations = pairs.groupBy("a", "b").agg(lists()).join(e, (F.col("a") * 7 + F.col("b")) % vectors == F.col("vec_id")).select(F.concat(F.lit("p"), F.col("a").cast("string")).alias("source"), F.concat(F.lit("p"), F.col("b").cast("string")).alias("target"), "embedding", "chunk_ids")
    chunks = e.select(F.concat(F.lit("d"), F.col("vec_id").cast("string")).alias("chunk"), "embedding", (F.col("vec_id") % 90 + 10).alias("tokens"))
    low, high = (list(e.where(F.col("vec_id") == k).first()["embedding"]) for k in (0, 1))
    return chunks, entities, relations, low, high


@query
def graph_retrieval(spark, d):
    """The chunks of each mode over one graph, within a budget of tokens."""
    parts = [retrieval.graph_retrieve(m, *_graph(spark, d), 10, 2000).withColumn("mode", F.lit(m)) for m in ("local", "global", "hybrid", "mix", "naive")]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.select("mode", "nth", "chunk", "origin", F.round("score", 6).alias("score"))


def capitalised(texts: list[str]) -> list[dict]:
    """An extractor by rule, in place of a language model: long capitalised words, and those that follow each other."""
    out = []
    for t in texts:
        found = re.findall("[A-Z][a-z]{6,}", t)
        kinds = [{"name": w, "type": "concept" if len(w) > 9 else "component", "description": w[:3]} for w in dict.fromkeys(found)]
        out.append({"entities": kinds, "relations": [{"source": a, "target": b} for a, b in zip(found, found[1:], strict=False)]})
    return out


def _extracted(spark, d):
    chunks = fx.read(spark, d, "documents").select(F.concat("source", F.lit("/"), F.col("doc_id").cast("string")).alias("chunk_id"), F.col("text").alias("content"))
    said = extraction.mentions(chunks, extraction.extract(chunks, capitalised, scratch(spark)))
    return said, extraction.merge_mentions(*said)


@query
def extracted_graph(spark, d):
    """Nodes and edges that an extractor finds in all documents, with their sources."""
    _, (nodes, edges) = _extracted(spark, d)
    n = nodes.select(F.col("id").alias("a"), F.lit("").alias("b"), F.col("entity_type").alias("kind"), F.lit(0.0).alias("weight"), "source_id")
    e = edges.select(F.col("source").alias("a"), F.col("target").alias("b"), F.lit("edge").alias("kind"), "weight", "source_id")
    return n.unionByName(e).withColumn("source_id", F.md5("source_id"))


@query
def extracted_graph_purged(spark, d):
    """The same after the documents of one source are deleted."""
    said, graph_tables = _extracted(spark, d)
    nodes, edges = extraction.purge(*graph_tables, *said, spark.createDataFrame([("src1",)], "doc_id string"))
    n = nodes.select(F.col("id").alias("a"), F.lit("").alias("b"), F.col("entity_type").alias("kind"), F.lit(0.0).alias("weight"), "source_id")
    e = edges.select(F.col("source").alias("a"), F.col("target").alias("b"), F.lit("edge").alias("kind"), "weight", "source_id")
    return n.unionByName(e).withColumn("source_id", F.md5("source_id"))


@query
def entity_lookup(spark, d):
    """The chunks of an entity with their documents' names."""
    li = fx.read(spark, d, "lineitem").join(fx.read(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    full = F.concat(F.col("l_suppkey").cast("string"), F.lit("/"), F.col("l_orderkey").cast("string"))
    nodes = li.groupBy(F.col("p_name").alias("name")).agg(F.array_sort(F.collect_set(full)).alias("chunk_ids"))
    chunks = fx.read(spark, d, "lineitem").select(F.col("l_suppkey").alias("doc_id"), F.col("l_orderkey").alias("chunk_id"), F.lit("line").alias("content")).distinct()
    documents = fx.read(spark, d, "supplier").select(F.col("s_suppkey").alias("doc_id"), F.col("s_name").alias("name"))
    return search.entity_evidence(nodes, chunks, documents, "LARGE RING").select("nth", "chunk_id", "document_name", "content", "score")


@query
def distinct_images(spark, d):
    e = fx.read(spark, d, "events")
    return fusion.distinct_first(e.select("user_id", "event_type", "event_id", "value"), ["user_id", "event_type"], [F.desc("value"), "event_id"])


@query
def domain_context(spark, d):
    docs = fx.read(spark, d, "documents").orderBy(F.desc("n_chars"), "doc_id").limit(9)
    hits = docs.withColumn("rank", F.row_number().over(W.orderBy(F.desc("n_chars"), "doc_id"))).select("rank", F.col("text").alias("content"))  # a top-k
    return details.domain_context(hits).select(F.md5("context").alias("digest"))


# -- graph


@query
def graph_summary(spark, d):
    e = fx.edges(spark, d)
    nodes = e.select(F.col("source").alias("id")).union(e.select("target")).distinct()
    return graph.summary(nodes, e).withColumn("labels", F.lit(graph.labels(nodes, "P1").count()))


@query
def graph_flat_nodes(spark, d):
    p = fx.read(spark, d, "part")
    nodes = p.select(F.col("p_partkey").alias("id"), F.when(F.col("p_size") % 2 == 0, F.col("p_type")).otherwise("").alias("entity_type"), F.concat("p_name", F.lit("<SEP>"), "p_brand").alias("description"), F.concat(F.lit(" d1/c"), F.lit("<SEP>d2/c")).alias("source_id"))
    return graph.flatten_nodes(nodes)


@query
def graph_deletion(spark, d):
    e = fx.edges(spark, d)
    nodes = e.select(F.col("source").alias("id")).union(e.select("target")).distinct()
    left, kept = graph.delete_entities(nodes, e, nodes.where("id RLIKE '^s[0-9]*[02468]$'"))
    return kept.select("source", "target", "weight").unionByName(left.select(F.col("id").alias("source"), F.lit(None).cast("string").alias("target"), F.lit(0).cast("long").alias("weight")))


@query
def graph_checks(spark, d):
    """Entities that an insert lost, graph folders without a document, documents without a folder."""
    docs = fx.read(spark, d, "customer").select(F.col("c_custkey").alias("doc_id"))
    folders = fx.read(spark, d, "orders").select((F.col("o_custkey") * 2).alias("doc_id")).distinct()
    lost = graph.missing_after_insert(fx.read(spark, d, "part").select(F.col("p_partkey").alias("id")), fx.read(spark, d, "lineitem").where("l_partkey % 3 > 0").select(F.col("l_partkey").alias("id")).distinct(), "id")
    return graph.health(folders, docs).unionByName(lost.select(F.col("id").alias("doc_id"), F.lit("lost").alias("issue")))


@query
def cross_document_nodes(spark, d):
    li = fx.read(spark, d, "lineitem")
    nodes = li.groupBy(F.col("l_partkey").alias("id")).agg(F.array_join(F.collect_set(F.concat(F.lit("d"), (F.col("l_suppkey") % 3).cast("string"), F.lit("/c"))), graph.SEPARATOR).alias("source_id"))
    return graph.cross_document(nodes).select("id")


@query
def graph_modes(spark, d):
    return fx.read(spark, d, "part").select("p_partkey", vector.graph_allowed(F.col("p_size") * 100).alias("mode"))


@query
def topology_edges(spark, d):
    got = analytics.topology_edges(fx.references(spark, d))
    return got.select("draft_id", "document_name", "weight", F.size("section_ids").alias("sections"), F.element_at("section_ids", 1).alias("first"), F.size("chunks").alias("chunks"))


# -- wiki


@query
def wiki_links(spark, d):
    """Links between parts that stand in one order, added twice, seen from both ends."""
    li = fx.read(spark, d, "lineitem").select("l_orderkey", "l_partkey")
    a, b = li.select("l_orderkey", F.col("l_partkey").alias("from_id")), li.select("l_orderkey", F.col("l_partkey").alias("to_id"))
    links = a.join(b, "l_orderkey").where("from_id < to_id").select("from_id", "to_id", F.lit("with").alias("relation"))
    every = wiki.upsert_links(links.where("from_id % 2 = 0"), links)
    got = wiki.with_links(fx.read(spark, d, "part").select(F.col("p_partkey").alias("id")), every)
    n = lambda c: F.coalesce(F.size(F.col(c)), F.lit(0))
    return got.select("id", F.when(F.col("outgoing").isNull(), 0).otherwise(n("outgoing")).alias("outgoing"), F.when(F.col("backlinks").isNull(), 0).otherwise(n("backlinks")).alias("backlinks"))


@query
def wiki_tags(spark, d):
    docs = fx.read(spark, d, "documents")
    old = docs.select("doc_id", F.col("lang").alias("tag"))
    return wiki.upsert_tags(old, docs.select("doc_id", F.concat(F.lit(" "), F.upper("lang"), F.when(F.col("doc_id") % 2 == 0, "").otherwise("x")).alias("tag")))


@query
def wiki_hits_page(spark, d):
    """The second page of entries found by keywords, in the order of the hits, of some documents only."""
    docs = fx.read(spark, d, "documents")
    entries = docs.select(F.col("doc_id").alias("id"), F.lit("topic").alias("type"), F.lit("active").alias("status"), F.substring("text", 1, 40).alias("title"), F.col("text").alias("content"), F.array(F.struct(F.col("source").alias("documentId"))).alias("refs"), F.col("n_chars").alias("updated_at"), F.concat(F.lit("hit "), "lang").alias("snippet"))
    hits = fulltext.keyword_search(docs, PHRASE, 40)
    ids = hits.select(F.col("doc_id").alias("id"), F.row_number().over(W.orderBy("rank", "doc_id")).alias("pos"))  # a page of hits
    return wiki.list_entries(entries, documents=["src1", "src2", "src3"], ids=ids, page=2, limit=3).select("id", "pos", "preview", "ref_count")


# -- tasks


def lineage(spark, d):
    """orders as tasks of the customer's documents: every fourth one converts, the others hang below an earlier one or nothing."""
    o = fx.read(spark, d, "orders")
    k = F.col("o_orderkey")
    kind = F.when(k % 4 == 0, "document_convert").when(k % 4 == 1, "rag_embed_index").when(k % 4 == 2, "rag_index").otherwise("wiki_index")
    status = F.when(F.col("o_orderstatus") == "F", "completed").when(F.col("o_orderstatus") == "O", "failed").otherwise("running")
    at = F.col("o_orderdate").cast("timestamp")
    return o.select(k.alias("id"), kind.alias("type"), status.alias("status"), at.alias("created_at"), F.col("o_custkey").alias("document_id"), F.when(k % 4 > 0, k - k % 4).alias("parent_id"), F.when(k % 8 == 0, k.cast("string")).when((k % 8 < 4) & (k % 3 == 0), (k - k % 8).cast("string")).alias("operation_id"), (k % 3).cast("int").alias("attempt"), F.when(k % 2 == 0, "request timed out").otherwise("bad input").alias("error"), (at + F.expr("INTERVAL 1 HOUR")).alias("finished_at"), (at + F.expr("INTERVAL 5 MINUTES")).alias("lease_until"), (k % 5 == 0).alias("cancel_requested"), F.when(k % 6 == 0, F.lit("1990-01-01").cast("timestamp")).alias("not_before"))


@query
def task_descendants(spark, d):
    t = lineage(spark, d)
    return tasks.descendants(t, t.where("type = 'document_convert'").select(F.col("id").alias("root")))


@query
def deep_descendants(spark, d):
    """Orders as tasks, each below the customer's order before; all tasks below every seventh order, at any depth."""
    o = fx.read(spark, d, "orders")
    before = F.lag("o_orderkey").over(W.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey"))
    t = o.select(F.col("o_orderkey").alias("id"), before.alias("parent_id"))
    return tasks.descendants(t, t.where("id % 7 = 0").select(F.col("id").alias("root")))


@query
def latest_attempts(spark, d):
    return tasks.latest(lineage(spark, d), ["document_id", "type"]).select("document_id", "type", "id", "attempt")


@query
def processing_round(spark, d):
    return tasks.latest_round(lineage(spark, d)).select("document_id", "id", "type")


@query
def claimable_tasks(spark, d):
    t = lineage(spark, d).withColumn("status", F.when(F.col("status") == "failed", "pending").when(F.col("id") % 50 == 0, "running").otherwise("completed"))
    caps = {"document_convert": 100, "rag_embed_index": 200, "rag_index": 50}
    return tasks.claimable(t, "2030-01-01", caps, 300).select("id", "type")


@query
def task_recovery(spark, d):
    """Expired leases, retries of failed tasks, and retries of clean-ups."""
    t = lineage(spark, d)
    lease = tasks.expired_leases(t, "1996-01-01").select("id", F.col("status").alias("what"), F.lit(None).cast("timestamp").alias("not_before"))
    again = tasks.retries(t, 2).select("id", F.lit("retry").alias("what"), "not_before")
    clean = details.cleanup_retries(t.withColumn("error", F.when(F.col("id") % 2 == 0, "lock TIMEOUT").otherwise("bad")), 1, 60_000).select("id", F.lit("clean").alias("what"), "not_before")
    return lease.unionByName(again).unionByName(clean).select("id", "what", F.unix_seconds("not_before").alias("not_before"))


@query
def task_identity(spark, d):
    o = fx.read(spark, d, "orders")
    raw = F.when(F.col("o_orderkey") % 5 == 0, F.lit("{bad")).otherwise(F.to_json(F.struct(F.col("o_custkey").alias("documentId"))))
    t = o.select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderkey") % 2 == 0, F.col("o_custkey") + 1).alias("document_id"), raw.alias("raw"))
    return t.select("id", tasks.identity("document_id", "raw", "documentId").alias("document"))


@query
def resumed_work(spark, d):
    return tasks.resume(fx.read(spark, d, "documents").select("doc_id"), fx.read(spark, d, "labels").select("doc_id"), "doc_id")


@query
def reply_markers(spark, d):
    c = fx.read(spark, d, "conversations")
    text = F.concat("text", F.when(F.col("turn") % 3 == 1, " DIRECTION_CONFIRMED SECTION_BY_SECTION").when(F.col("turn") % 3 == 2, " NEEDS_GATHERED GENERATE_DIRECT").otherwise(""))
    return c.select("conv_id", "turn", tasks.marker(text).alias("marker"))


# -- drafts


def references(spark, d):
    li = fx.read(spark, d, "lineitem")
    return li.select(F.col("l_orderkey").alias("section_id"), F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("chunk_id"), F.col("l_suppkey").alias("document_id"), (F.col("l_discount") * 10).alias("score"), F.col("l_returnflag").alias("kind"))


@query
def section_references(spark, d):
    """The best references of one request: of documents 1 to 60, half of them where the wiki covers the section."""
    r = references(spark, d)
    few = drafts.select_references(r, 3, list(range(1, 61))).withColumn("wiki", F.lit(True))
    return few.unionByName(drafts.select_references(r, 0).withColumn("wiki", F.lit(False))).select("chunk_id", "score", "wiki")


@query
def merged_references(spark, d):
    """References of the wiki before those of chunks; sections with new ones lose their old ones."""
    r = references(spark, d)
    both = drafts.union_references(r.where("kind = 'R'"), r.where("kind <> 'R'"))
    new = r.where("section_id % 3 = 0 AND kind = 'N'").select("section_id", "chunk_id")
    kept = drafts.replace_references(both.select("section_id", "chunk_id"), new)
    return both.select("section_id", "chunk_id", "position").unionByName(kept.select("section_id", "chunk_id", F.lit(0).alias("position")))


@query
def graph_references(spark, d):
    r = references(spark, d).select("section_id", "chunk_id", F.col("score").alias("relevance"), F.lit("doc").alias("document_name"), F.lit("rag_chunk").alias("source_type"))
    new = r.where("section_id % 10 = 0").select("section_id", "chunk_id", F.lit(None).cast("double").alias("relevance"), F.lit("").alias("document_name"))
    got = drafts.append_graph_references(r, new)
    return got.groupBy("source_type", "document_name").agg(F.count("*").alias("rows"), F.round(F.sum("relevance"), 3).alias("relevance"))


@query
def reference_views(spark, d):
    r = references(spark, d)
    images = F.when(F.col("kind") == "R", F.lit('[{"filename":"a.png","url":"u"}]')).when(F.col("kind") == "A", F.lit("{bad")).otherwise(F.lit(None).cast("string"))
    view = drafts.reference_view(r.select("chunk_id", F.when(F.col("kind") == "R", "wiki").otherwise(F.col("kind")).alias("source_type"), images.alias("images")))
    return view.select("chunk_id", "source_type", F.size("images").alias("images"))


def sections(spark, d):
    o = fx.read(spark, d, "orders")
    k = F.col("o_orderkey")
    status = F.element_at(F.array(*[F.lit(x) for x in ("pending", "generating", "reviewing", "failed", "locked")]), (k % 5 + 1).cast("int"))
    return o.select(k.alias("section_id"), F.col("o_custkey").alias("draft_id"), status.alias("status"), F.when(k % 3 == 0, F.col("o_orderpriority")).alias("content"), F.when(k % 2 == 0, F.lit("one")).alias("candidate_a"), F.when(k % 7 > 0, F.lit("two")).alias("candidate_b"), (k % 100).alias("words"))


@query
def section_states(spark, d):
    """What is generated with and without overwriting, what is compared, what is shown, and whose version it is."""
    s = sections(spark, d)
    shown = drafts.display_state(s).select("section_id", "comparing", "shown", drafts.version_source(F.col("shown"), F.col("candidate_a"), F.col("candidate_b")).alias("source"))
    for name, overwrite in (("fresh", False), ("again", True)):
        shown = shown.join(drafts.generation_targets(s, overwrite).select("section_id", F.lit(True).alias(name)), "section_id", "left")
    return shown.select("section_id", "comparing", "shown", "source", F.coalesce("fresh", F.lit(False)).alias("fresh"), F.coalesce("again", F.lit(False)).alias("again"))


@query
def confirmed_sections(spark, d):
    s = sections(spark, d).select("section_id", "status", "content", "words")
    versions = s.where("section_id % 4 = 0").select("section_id", F.lit(1).cast("long").alias("version"), F.lit("old").alias("content"))
    locked, every = drafts.confirm(s, versions, s.where("section_id % 2 = 0").select("section_id", F.concat(F.lit("New text of "), F.col("section_id").cast("string")).alias("content")))
    last = drafts.history(every).groupBy("section_id").agg(F.max("version").alias("version"))
    return locked.join(last, "section_id", "left").select("section_id", "status", "words", "version")


@query
def patched_outline(spark, d):
    o = fx.read(spark, d, "orders")
    k = F.col("o_orderkey")
    rows = o.select(k.cast("string").alias("id"), F.when(k % 2 == 1, (k - 1).cast("string")).alias("parent_id"), k.cast("int").alias("idx"), F.col("o_orderpriority").alias("title"), (k % 900).cast("int").alias("words"))
    none = F.lit(None)
    patches = rows.where("idx % 5 = 0").select("id", none.cast("string").alias("parent_id"), none.cast("int").alias("idx"), none.cast("string").alias("title"), none.cast("int").alias("words"), F.lit("delete").alias("action"))
    patches = patches.union(rows.where("idx % 5 = 1").select("id", none.cast("string"), none.cast("int"), F.lit("changed"), none.cast("int"), F.lit("update")))
    patches = patches.union(rows.where("idx % 5 = 2").select(F.concat(F.lit("tmp"), "id"), F.concat(F.lit("tmp"), "id"), "idx", none.cast("string"), "words", F.lit("create")))
    return drafts.patch_outline(rows, patches)


@query
def outline_parents(spark, d):
    from tessella.operators import outline
    from tessella.plans.catalog_text import outlines

    return drafts.parents_by_path(outline.outline_rows(outlines(spark, d))).select("doc_id", "path", "parent", "parent_idx")


@query
def updated_embeddings(spark, d):
    e = fx.read(spark, d, "embeddings")
    chunks = e.select(F.col("vec_id").alias("chunk_id"), "embedding")
    new = e.where("vec_id % 3 = 0").select(F.when(F.col("vec_id") % 2 == 0, F.col("vec_id")).otherwise(F.col("vec_id") + 10_000_000).alias("chunk_id"), F.array(F.lit(0.5).cast("float")).alias("embedding"))
    return details.update_embeddings(chunks, new).select("chunk_id", F.size("embedding").alias("dimensions"))


@query
def document_deletion(spark, d):
    """Suppliers as documents of users: an even one is asked for by a user who owns half of them."""
    docs = fx.read(spark, d, "supplier").select(F.col("s_suppkey").alias("doc_id"), (F.col("s_suppkey") % 4).alias("user_id"))
    chunks = fx.read(spark, d, "lineitem").select(F.col("l_suppkey").alias("doc_id"), F.concat_ws("-", "l_suppkey", "l_orderkey").alias("chunk_id")).distinct()
    index = chunks.select("chunk_id", F.lit("t").alias("term")).union(chunks.select(F.concat(F.lit("old-"), "chunk_id"), F.lit("t")))
    left, kids, found, outcome = details.delete_documents(docs, docs.where("doc_id % 2 = 0").select("doc_id"), 2, {"chunks": chunks}, index)
    n = lambda name, df: df.agg(F.count("*").alias("rows")).select(F.lit(name).alias("what"), "rows")
    return n("documents", left).union(n("chunks", kids["chunks"])).union(n("index", found)).union(n("deleted", outcome.where("outcome = 'deleted'"))).union(n("not found", outcome.where("outcome = 'not found'")))


# -- scalar rules


@query
def result_badges(spark, d):
    """Parts as hits: some without a score, some without a vector score, every fourth one of the keyword mode."""
    k = F.col("p_partkey")
    score = F.when(k % 10 > 0, (k % 131 - 15) / F.lit(100.0))
    shown = tx.badge(score, F.when(k % 3 > 0, (k % 113) / F.lit(107.0)), k % 4 == 0)
    return fx.read(spark, d, "part").select(k.alias("id"), shown.alias("b")).select("id", "b.percent", "b.level")


@query
def retry_delays(spark, d):
    """Hints in seconds, as dates before and after the call, broken or missing; what the call waits, and whether waiting helps at all."""
    e = fx.read(spark, d, "events")
    k, now = F.col("event_id"), F.col("ts").cast("timestamp")
    date = F.date_format(now + F.make_interval(secs=(k % 900 - 100).cast("decimal(18,6)")), "EEE, dd MMM yyyy HH:mm:ss 'GMT'")
    header = F.when(k % 5 == 0, (k % 1000).cast("string")).when(k % 5 == 1, date).when(k % 5 == 2, "soon").when(k % 5 == 3, "-10")
    whole = F.date_trunc("second", now)
    wait = F.when(k % 5 == 1, backoff.retry_after_ms(header, whole)).otherwise(backoff.retry_after_ms(header, now))
    body = F.when(k % 3 == 0, "Error: Insufficient_Quota").otherwise("slow down")
    reset = backoff.duration_ms(F.when(k % 4 == 0, F.concat((k % 3).cast("string"), F.lit("m"), (k % 60).cast("string"), F.lit("s"))).when(k % 4 == 1, F.concat((k % 900).cast("string"), F.lit("ms"))).when(k % 4 == 2, F.concat((k % 90).cast("string"), F.lit(".5"))).otherwise("never"))
    return e.select("event_id", wait.alias("hint_ms"), backoff.backoff_ms(F.when(k % 5 != 1, header), k % 5, now, (k % 21 - 10) / 10).alias("wait_ms"), backoff.account_spent((F.lit(400) + k % 30).cast("int"), body).alias("spent"), reset.alias("reset_ms"))


@query
def diagram_needs(spark, d):
    """Sections (parts) that ask for a diagram, and of which type."""
    p = fx.read(spark, d, "part")
    k = F.col("p_partkey")
    words = F.element_at(F.array(*[F.lit(x) for x in ("the Data Flow", "a pipeline", "nothing", "Include a Flowchart", "部署拓扑", "a roadmap, phased", "sequence of calls", "需要一张图", "HIGH availability", "plain")]), (k % 10 + 1).cast("int"))
    text = diagrams.section_text(F.col("p_name"), words, F.when(k % 2 == 0, F.col("p_type")))
    return p.select("p_partkey", diagrams.needs_diagram(text).alias("needs"), diagrams.diagram_type(text).alias("type"))


@query
def edited_entities(spark, d):
    """Parts as entities: some created, of which a few are refused, and some edited."""
    p = fx.read(spark, d, "part")
    nodes = p.where("p_partkey % 3 > 0").select(F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("id"), F.col("p_type").alias("entity_type"), F.col("p_name").alias("description"), F.col("p_brand").alias("source_id"))
    new = p.where("p_partkey % 4 = 0").select(F.concat(F.lit(" p"), F.col("p_partkey").cast("string")).alias("id"), F.lit("new").alias("entity_type"), F.col("p_name").alias("description"))
    more, _ = graph.create_entities(nodes, new)
    edits = p.select(F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("id"), F.when(F.col("p_partkey") % 5 == 0, "name").when(F.col("p_partkey") % 5 == 1, "entity_type").otherwise("description").alias("field"), F.col("p_brand").alias("value"), F.col("p_partkey").alias("seq"))
    out, refused = graph.edit_entities(more, edits)
    return out.unionByName(refused.select("id", F.lit("refused").alias("entity_type"), F.col("field").alias("description"), F.col("error").alias("source_id")))


@query
def text_rules(spark, d):
    p = fx.read(spark, d, "part")
    k, name = F.col("p_partkey"), F.col("p_name")
    return p.select(
        k.alias("id"),
        tx.strip_marks(F.concat(F.lit("<mark>"), name, F.lit("</mark>"))).alias("plain"),
        tx.strip_number(F.concat(F.lit("1.2. "), name)).alias("title"),
        tx.truncate(name, 6).alias("short"),
        tx.sanitize_filename(F.concat(F.col("p_brand"), F.lit(":/"), name)).alias("file"),
        tx.api_base(F.concat(F.lit(" https://h/v1"), F.when(k % 3 == 0, "/chat/completions/").when(k % 3 == 1, "/embeddings").otherwise("//"))).alias("base"),
        tx.retry_after_seconds(F.when(k % 2 == 0, k.cast("string")).otherwise(F.lit("soon"))).alias("wait"),
        F.size(tx.triples(F.split(F.concat_ws(" ", name, F.col("p_type"), F.col("p_brand"), F.lit("end")), " "))).alias("triples"),
        F.array_join(tx.search_terms(F.concat(name, F.lit(", "), F.upper(name), F.lit(" a"))), "|").alias("terms"),
        tx.rewrite_image_urls(F.concat(F.lit("![a](images/"), k.cast("string"), F.lit(".png)")), "/api").alias("image"),
        details.document_locale(F.when(k % 2 == 0, F.lit("中")).otherwise(name)).alias("locale"),
        details.strip_leading_title(F.concat(F.lit("## 1. "), name, F.lit("\n\nbody")), F.when(k % 2 == 0, name).otherwise(F.lit("x"))).alias("body"),
        drafts.tag_archetype(F.col("p_type"), F.col("p_brand"), ["LARGE", "SMALL", "Brand#7"]).alias("archetype"),
        F.size(drafts.key_points(F.when(k % 3 == 0, F.lit('["a","b"]')).when(k % 3 == 1, name))).alias("points"),
        F.size(drafts.effective_constraints(F.lit('{"a":"1","b":"2"}'), F.when(k % 2 == 0, F.lit('{"b":"3","c":"4"}')).otherwise(F.lit("bad")))).alias("constraints"),
        drafts.retrieval_query(name, F.col("p_type"), F.lit(None).cast("string"), F.array(F.lit("p"), F.lit("q")), F.lit(" h")).alias("query"),
    )
