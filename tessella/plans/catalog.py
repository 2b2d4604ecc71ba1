"""The query registry: name -> (function of a session and a folder, DuckDB SQL or None)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tessella.functions import text as tx
from tessella.operators import analytics, chunking, details, drafts, fulltext, fusion, graph, lookups, macro, tasks, vector, wiki
from tessella.plans import fixtures as fx
from tessella.plans import oracles
from tessella.sources import files

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


# -- analytics


@query
def usage_by_dimension(spark, d):
    return analytics.usage_by_dimension(fx.usage(spark, d), fx.models(spark, d))


@query
def usage_daily_trend(spark, d):
    return analytics.usage_trend(fx.usage(spark, d), fx.AS_OF, 14)


@query
def usage_totals(spark, d):
    return analytics.usage_totals(fx.usage(spark, d), fx.AS_OF, 14)


@query
def recent_usage(spark, d):
    return analytics.recent_usage(fx.usage(spark, d)).select("id", "module", "tokens_in", "tokens_out")


@query
def tag_counts(spark, d):
    docs = fx.read(spark, d, "documents")
    return analytics.tag_counts(docs.select("doc_id", F.explode(F.array("source", "lang")).alias("tag")))


@query
def document_list_page(spark, d):
    docs = fx.read(spark, d, "documents").join(fx.read(spark, d, "labels"), "doc_id", "left")
    view = docs.select("doc_id", F.col("source").alias("name"), F.col("n_chars").alias("size"), F.lit("ready").alias("status"), F.col("lang").alias("format"), F.col("doc_id").alias("created_at"), F.col("n_chars").alias("tokens"), "quality")
    doc_tags = docs.select("doc_id", F.col("source").alias("tag"))
    return analytics.document_page(view, fmt="en", tags=["SRC1", "src2", "src3"], doc_tags=doc_tags, sort="size_desc", page=2, limit=10).select("doc_id", "name", "size", "quality")


@query
def content_dedupe(spark, d):
    docs = fx.read(spark, d, "documents")
    existing = docs.where("source = 'src0'").select(F.lit(1).alias("user_id"), F.sha2("text", 256).alias("hash"))
    uploads = docs.where("source <> 'src0'").select(F.col("doc_id").alias("id"), F.col("text").alias("content"), F.lit(1).alias("user_id"))
    return analytics.new_uploads(uploads, existing).select("id", "hash")


@query
def topology(spark, d):
    return analytics.topology(fx.references(spark, d))


@query
def topology_stats(spark, d):
    refs = fx.references(spark, d)
    secs = fx.sections(spark, d).select((F.col("section_id") % 100).alias("draft_id"), "section_id", "status")
    return analytics.topology_stats(secs, refs).select("draft_id", "total_references", "sections_with_references", "total_sections", "completed_sections", "documents", "most_referenced", "coverage")


@query
def draft_progress(spark, d):
    return analytics.draft_progress(fx.sections(spark, d))


@query
def storage_bytes(spark, d):
    docs = fx.read(spark, d, "documents")
    return analytics.storage(docs.select(F.col("lang").alias("user_id"), F.octet_length("text").cast("long").alias("original_size"), F.col("n_chars").alias("markdown_size")))


@query
def latency_p95(spark, d):
    return analytics.nearest_rank(fx.read(spark, d, "events"), ["event_type"], "value", 95)


@query
def latency_ewma(spark, d):
    e = fx.read(spark, d, "events")
    values = e.groupBy("user_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("event_id", "value"))), lambda x: x["value"]).alias("v"))
    return values.select("user_id", F.round(analytics.ewma(F.col("v")), 6).alias("ewma"))


@query
def latency_ewma_all(spark, d):
    values = fx.read(spark, d, "events").groupBy("user_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("event_id", "value"))), lambda x: x["value"]).alias("v"))
    return values.select("user_id", F.round(analytics.ewma(F.col("v")), 6).alias("ewma"))


@query
def conversation_tail(spark, d):
    return analytics.conversation_tail(fx.read(spark, d, "conversations"), 500)


@query
def conversation_latest(spark, d):
    return analytics.latest_messages(fx.read(spark, d, "conversations"), 3).select("conv_id", "turn", "role", "back")


@query
def length_replies(spark, d):
    r = analytics.replies(fx.read(spark, d, "conversations"))
    return r.select("conv_id", "turn", "previous_role", tasks.states_length(F.col("role"), F.col("text"), F.col("previous_role"), F.col("previous_text")).alias("states_length"))


@query
def quality_groups(spark, d):
    docs = fx.read(spark, d, "documents").join(fx.read(spark, d, "labels"), "doc_id", "left")
    return docs.groupBy("lang").agg(F.count("*").alias("documents"), F.count_if(F.col("quality") == 1).alias("good"), F.count_if(F.col("quality").isNull()).alias("unlabelled"), F.sum("n_chars").alias("chars"))


# -- tasks


@query
def latest_task(spark, d):
    return tasks.latest(fx.tasks(spark, d), ["document_id", "type"]).select("document_id", "type", "id", "status")


@query
def queue_position(spark, d):
    t = fx.tasks(spark, d).withColumn("user_id", F.col("document_id") % 10)
    return tasks.queue_positions(t)


@query
def task_list(spark, d):
    return tasks.task_list(fx.tasks(spark, d), "pending, running", "1-URGENT", 500).select("id", "status", "document_id")


@query
def document_durations(spark, d):
    t = fx.tasks(spark, d)
    kinds = {"1-URGENT": "document_convert", "2-HIGH": "rag_embed_index"}
    named = t.where(F.col("type").isin(*kinds)).withColumn("type", F.when(F.col("type") == "1-URGENT", "document_convert").otherwise("rag_embed_index"))
    return tasks.durations(named.withColumns({"started_at": F.col("created_at"), "finished_at": F.when(F.col("status") == "completed", F.col("created_at") + F.expr("INTERVAL 1 HOUR"))}), ["document_convert", "rag_embed_index"])


@query
def pipeline_progress(spark, d):
    c = fx.read(spark, d, "orders")
    status = F.when(F.col("o_orderstatus") == "F", "completed").when(F.col("o_orderstatus") == "O", "running").otherwise("failed")
    at = lambda n, s: F.when(F.col("o_orderkey") % 5 >= n, s)
    docs = c.select(F.col("o_orderkey").alias("doc_id"), F.lit("processing").alias("status"), F.lit(True).alias("uploaded"), (F.col("o_orderkey") % 2 == 0).alias("converted"), at(1, F.when(F.col("o_orderkey") % 5 > 1, F.lit("completed")).otherwise(status)).alias("convert"), at(2, F.when(F.col("o_orderkey") % 5 > 2, F.lit("completed")).otherwise(status)).alias("embed"), at(3, status).alias("graph"), at(4, status).alias("wiki"), *[(F.col("o_orderkey") % 101).alias(f"{s}_progress") for s in ("convert", "embed", "graph", "wiki")])
    return tasks.pipeline(docs).groupBy("display").agg(F.count("*").alias("documents"), F.sum("percent").alias("percent_sum"), F.count_if(F.col("basic_ready")).alias("basic_ready"))


@query
def lockouts(spark, d):
    e = fx.read(spark, d, "events").where("event_type = 'error'")
    out = tasks.lockouts(e.select(F.col("user_id").alias("key"), "ts"), 2, 24 * 60, 6 * 60)
    return out.select("key", F.col("window_start").cast("timestamp_ntz").alias("window_start"), "failures", F.col("locked_until").cast("timestamp_ntz").alias("locked_until"))


@query
def generation_fence(spark, d):
    e = fx.read(spark, d, "events")
    u = e.select(F.col("user_id").alias("task_id"), F.to_date("ts").alias("generation"), F.when(F.col("event_type") == "purchase", "completed").when(F.col("event_type") == "error", "failed").otherwise("running").alias("status"), "ts", F.col("event_id").alias("eid"))
    u = u.withColumn("at", F.col("ts").cast("timestamp"))
    return tasks.fenced(u).select("task_id", F.col("generation").cast("string").alias("generation"), "status")


# -- scalar functions


@query
def token_word_estimate(spark, d):
    t = F.col("text")
    return fx.read(spark, d, "documents").select("doc_id", tx.estimate_tokens(t).alias("tokens"), tx.count_words(t).alias("words"), tx.whitespace_words(t).alias("pieces"), (tx.estimate_tokens(t) > 2 * 900).alias("split"))


@query
def title_scalars(spark, d):
    p = fx.read(spark, d, "part")
    size = F.col("p_partkey") * 777
    return p.select("p_partkey", tx.slugify(F.col("p_name")).alias("slug"), tx.format_file_size(size).alias("size"), tx.relevance(F.col("p_size") / 50).alias("label"), tx.document_of_chunk(F.concat("p_brand", F.lit("/chunk_"), F.col("p_size").cast("string"))).alias("document"), F.size(tx.title_tokens(F.col("p_name"))).alias("n_tokens"), tx.normalise_query(F.col("p_type")).alias("key"))


@query
def search_excerpt(spark, d):
    return fx.read(spark, d, "documents").select("doc_id", tx.excerpt(F.col("text"), F.lit("License"), 120).alias("excerpt"))


@query
def processing_estimate(spark, d):
    docs = fx.read(spark, d, "documents").groupBy("source").agg((F.sum("n_chars") * 100).alias("bytes"), F.count("*").alias("files"))
    e = tx.processing_estimate(F.col("bytes"), F.col("files"), "graph")
    return docs.select("source", e["level"].alias("level"), e["min_minutes"].alias("min_minutes"), e["max_minutes"].alias("max_minutes"))


@query
def graph_error_types(spark, d):
    e = fx.read(spark, d, "events")
    message = F.concat(F.col("event_type"), F.lit(" failed: HTTP "), (F.lit(395) + F.col("event_id") % 110).cast("string"))
    return e.select("event_id", tx.graph_error(message)["type"].alias("type"), tx.graph_error(message)["retryable"].alias("retryable"))


# -- search

SEARCH = "and the license version"
PHRASE = "licensed under"


@query
def bm25_keyword_search(spark, d):
    hits = fx.search_index(spark, d).search(PHRASE, 20)
    return hits.select("doc_id", F.round("rank", 6).alias("rank"), "score")


@query
def bm25_match_groups(spark, d):
    return fx.search_index(spark, d).rank(SEARCH).select("doc_id", "length", F.round("rank", 6).alias("rank"))


@query
def bm25_scan_groups(spark, d):
    """The same ranks by a scan of all texts, without an index."""
    ranked = fulltext.bm25_rank(fx.read(spark, d, "documents"), SEARCH, "doc_id", ["text"])
    return ranked.select("doc_id", "length", F.round("rank", 6).alias("rank"))


@query
def keyword_snippets(spark, d):
    """A page of hits with the best window of each text, hits marked."""
    index = fx.search_index(spark, d)
    return index.snippets(index.search(PHRASE, 20), fx.read(spark, d, "documents"), PHRASE).select("doc_id", "score", "snippet")


@query
def index_statistics(spark, d):
    """Documents, tokens and terms of the stored index by document group; a group without documents has no row."""
    index = fx.search_index(spark, d)
    terms = index.postings().groupBy("part").agg(F.sum("tf").alias("places"))
    return index.statistics().join(terms, "part").agg(F.sum("documents").alias("documents"), F.sum("tokens").alias("tokens"), F.sum("places").alias("places"))


@query
def postings_index(spark, d):
    return fulltext.postings(fx.read(spark, d, "documents")).groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))


@query
def postings_index_all(spark, d):
    return fulltext.postings(fx.read(spark, d, "documents")).groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))


def _query_vector(spark, d):
    row = fx.read(spark, d, "embeddings").where("vec_id = 0").select("embedding").first()
    return list(row[0])


@query
def cosine_topk(spark, d):
    e = fx.read(spark, d, "embeddings")
    return e.select("vec_id", F.round(vector.cosine(F.col("embedding"), F.lit(_query_vector(spark, d))), 6).alias("cosine")).orderBy(F.desc("cosine"), "vec_id").limit(20)


@query
def cosine_threshold(spark, d):
    return vector.search(fx.read(spark, d, "embeddings"), _query_vector(spark, d), 50, 0.1)


@query
def adjacent_similarity(spark, d):
    return vector.adjacent_similarity(fx.read(spark, d, "embeddings"), "label", "vec_id").withColumn("similarity", F.round("similarity", 6))


@query
def rrf_fusion(spark, d):
    docs = fx.read(spark, d, "documents").select("doc_id", F.lit(0).alias("chunk_id"), F.substring("text", 1, 80).alias("title"), F.col("text").alias("content"))
    direct = vector.with_content(_nearest(spark, d, 40), docs, "doc_id")
    keyword = fulltext_content(docs, fx.search_index(spark, d).search(PHRASE, 40).select("doc_id", "score"))
    return fusion.fuse({"direct": direct, "keyword": keyword}, "Licensed under", 20).select("doc_id", "source", "score", "fusion", "label", "rank")


def _nearest(spark, d, limit):
    """Documents by the cosine of their vectors (the vector with a document's number) to that of document 0."""
    return vector.search(fx.read(spark, d, "embeddings"), _query_vector(spark, d), limit, 0.0).select(F.col("vec_id").alias("doc_id"), "score")


def fulltext_content(docs, hits):
    return vector.with_content(hits, docs, "doc_id")


@query
def phrase_boosts(spark, d):
    docs = fx.read(spark, d, "documents")
    return docs.select("doc_id", fusion.phrase_boost(F.substring("text", 1, 20), F.col("text"), "License, Version").alias("boost"))


@query
def wiki_section_query(spark, d):
    b = fx.read(spark, d, "documents")
    entries = b.select(F.col("doc_id").alias("id"), F.substring("text", 1, 60).alias("title"), F.col("text").alias("content"), F.lit("active").alias("status"), ((F.col("doc_id") % 10) / 10).alias("confidence"))
    return fulltext.wiki_section_query(entries, "public license", 20).select("id", "raw", F.round("score", 6).alias("score"))


# -- graph


@query
def graph_degree(spark, d):
    return graph.popular(fx.edges(spark, d), 100)


@query
def graph_khop(spark, d):
    seeds = spark.createDataFrame([("p1",)], "node string")
    return graph.neighbourhood(fx.edges(spark, d), seeds, 2, 10_000)


@query
def graph_core(spark, d):
    return graph.core(fx.edges(spark, d), 50, 2)


@query
def graph_overview(spark, d):
    e = fx.edges(spark, d)
    li = fx.read(spark, d, "lineitem")
    source = F.concat((F.col("l_orderkey") % 8).cast("string"), F.lit("/c"))
    nodes = li.select(F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("id"), source.alias("s")).union(li.select(F.concat(F.lit("p"), F.col("l_partkey").cast("string")), source))
    nodes = nodes.groupBy("id").agg(F.array_join(F.array_sort(F.collect_set("s")), graph.SEPARATOR).alias("source_id"))
    return graph.overview(nodes, e, 80, 2).select("node", "degree", F.array_join("doc_ids", ",").alias("documents"))


@query
def graph_overview_all(spark, d):
    e = fx.edges(spark, d)
    li = fx.read(spark, d, "lineitem")
    source = F.concat((F.col("l_orderkey") % 8).cast("string"), F.lit("/c"))
    nodes = li.select(F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("id"), source.alias("s")).union(li.select(F.concat(F.lit("p"), F.col("l_partkey").cast("string")), source))
    nodes = nodes.groupBy("id").agg(F.array_join(F.array_sort(F.collect_set("s")), graph.SEPARATOR).alias("source_id"))
    return graph.overview(nodes, e, 80, 2).select("node", "degree", F.array_join("doc_ids", ",").alias("documents"))


@query
def entity_evidence(spark, d):
    li = fx.read(spark, d, "lineitem").join(fx.read(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    entities = li.groupBy(F.col("p_name").alias("name")).agg(F.transform(F.array_sort(F.collect_set("l_orderkey")), lambda x: x.cast("string")).alias("chunk_ids"))
    wanted = fx.read(spark, d, "part").where("p_partkey <= 5").select(F.upper("p_name").alias("entity"))
    return graph.evidence(entities, wanted)


@query
def entity_evidence_all(spark, d):
    li = fx.read(spark, d, "lineitem").join(fx.read(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    entities = li.groupBy(F.col("p_name").alias("name")).agg(F.transform(F.array_sort(F.collect_set("l_orderkey")), lambda x: x.cast("string")).alias("chunk_ids"))
    return graph.evidence(entities, fx.read(spark, d, "part").select(F.upper("p_name").alias("entity")))


@query
def graph_purge(spark, d):
    li = fx.read(spark, d, "lineitem")
    nodes = li.groupBy(F.col("l_partkey").alias("id")).agg(F.array_join(F.array_sort(F.collect_set(F.concat(F.lit("d"), (F.col("l_suppkey") % 20).cast("string"), F.lit("/c")))), graph.SEPARATOR).alias("source_id"))
    return graph.purge_documents(nodes, [f"d{k}" for k in range(10)])


# -- wiki


@query
def title_jaccard_merge(spark, d):
    p = fx.read(spark, d, "part")
    existing = p.where("p_size <= 5").select(F.format_string("%08d", "p_partkey").alias("slug"), F.col("p_name").alias("title"))
    candidates = p.where("p_size > 5").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("title"))
    return wiki.best_titles(candidates, existing).withColumn("score", F.round("score", 6))


def _merged_wiki(spark, d):
    """Parts of small sizes as entries of three users, the others as candidates."""
    p = fx.read(spark, d, "part")
    kind = F.element_at(F.array(*[F.lit(x) for x in ("doc_summary", "topic", "concept", "claim")]), (F.col("p_partkey") % 4 + 1).cast("int"))
    title = F.concat_ws(" ", "p_name", F.col("p_brand"), F.lit("size"), F.col("p_size").cast("string"))
    rows = p.select((F.col("p_partkey") % 3).alias("user_id"), kind.alias("type"), title.alias("title"), tx.slugify(F.col("p_name")).alias("slug"), F.col("p_type").alias("content"), F.array("p_brand", F.concat(F.lit("p"), F.col("p_partkey").cast("string"))).alias("refs"), (F.col("p_size") / 100).alias("confidence"), F.col("p_partkey").alias("seq"), "p_size")
    return wiki.merge_entries(rows.where("p_size <= 5").drop("p_size"), rows.where("p_size > 5").drop("p_size"), "2024-01-01")


@query
def wiki_merge(spark, d):
    """A batch merged into the entries of three users, every decision seeing the ones before, fold by fold of components."""
    return _merged_wiki(spark, d).select("user_id", "type", "title", "action", "merges", F.md5("content").alias("content"), F.concat_ws(",", "refs").alias("refs"), F.round("confidence", 6).alias("confidence"))


@query
def wiki_merge_statistics(spark, d):
    return wiki.merge_statistics(_merged_wiki(spark, d))


def _wiki_entries(spark, d):
    li = fx.read(spark, d, "lineitem")
    ref = F.struct(F.col("l_suppkey").cast("string").alias("documentId"), F.concat("l_suppkey", F.lit("-"), "l_linenumber").alias("chunkId"), F.col("l_linenumber").alias("chunkIndex"), F.lit(None).cast("string").alias("entityId"))
    raw = li.groupBy(F.col("l_orderkey").alias("id")).agg(F.to_json(F.sort_array(F.collect_list(ref))).alias("raw"))
    kind = F.element_at(F.array(*[F.lit(x) for x in ("topic", "concept", "claim", "doc_summary")]), (F.col("id") % 4 + 1).cast("int"))
    broken = F.when(F.col("id") % 97 == 0, F.concat(F.lit("{"), F.col("raw"))).otherwise(F.col("raw"))
    return raw.select("id", kind.alias("type"), F.lit("active").alias("status"), wiki.dedupe_refs(wiki.parse_refs(broken)).alias("refs"))


@query
def source_ref_sweep(spark, d):
    docs = fx.read(spark, d, "supplier").where("s_suppkey % 9 <> 0").select(F.col("s_suppkey").alias("doc_id"))
    gone = fx.read(spark, d, "supplier").where("s_suppkey % 2 = 0").select(F.col("s_suppkey").alias("doc_id"))
    return wiki.sweep_documents(_wiki_entries(spark, d), docs, gone).select("id", "action", F.size("refs").alias("refs"))


@query
def wiki_stats(spark, d):
    return wiki.wiki_stats(_wiki_entries(spark, d))


@query
def unique_slugs(spark, d):
    p = fx.read(spark, d, "part")
    return wiki.unique_slugs(p.select(F.col("p_partkey").alias("id"), F.col("p_type").alias("title"), F.lit(1).alias("user_id"))).select("id", "slug")


@query
def budgeted_context(spark, d):
    docs = fx.read(spark, d, "documents")
    return wiki.budgeted(docs.select("source", "doc_id", "text"), ["source"], "doc_id", "text", 12_000, 2_500).select("source", "doc_id", F.length("text").alias("n"))


# -- joins and sets


@query
def semi_anti_joins(spark, d):
    docs, labels = fx.read(spark, d, "documents"), fx.read(spark, d, "labels")
    known = docs.join(labels, "doc_id", "left_semi").select("doc_id", F.lit("labelled").alias("side"))
    return known.unionByName(docs.join(labels, "doc_id", "left_anti").select("doc_id", F.lit("unlabelled").alias("side")))


@query
def range_join(spark, d):
    o = fx.read(spark, d, "orders").select(F.col("o_custkey").alias("doc"), F.col("o_orderkey").alias("seg"), "o_orderdate")
    s = o.withColumn("end", F.coalesce(F.lead("o_orderdate").over(W.partitionBy("doc").orderBy("o_orderdate", "seg")), F.lit("2100-01-01").cast("timestamp")))
    x = fx.read(spark, d, "orders").select(F.col("o_custkey").alias("x_doc"), F.col("o_orderkey").alias("x"), (F.col("o_orderdate") + F.expr("INTERVAL 12 HOURS")).alias("at"))
    return x.join(s, (F.col("x_doc") == F.col("doc")) & (F.col("at") >= F.col("o_orderdate")) & (F.col("at") < F.col("end"))).select("x", "seg")


@query
def earlier_summaries(spark, d):
    o = fx.sections(spark, d).select("draft_id", F.col("section_id").alias("idx"), "status", F.col("words").cast("string").alias("summary"))
    return analytics.earlier_summaries(o).select("draft_id", "idx", F.size("earlier").alias("n"), F.array_join("earlier", "|").alias("earlier"))


# -- chunking


@query
def split_sentences(spark, d):
    each = chunking.sentences(fx.read(spark, d, "documents"), every=True)
    return each.groupBy("doc_id").agg(F.when(F.count("sentence") > 0, F.count("idx")).alias("sentences"), F.sum(F.length("sentence")).alias("chars"))  # a null text has neither


@query
def split_chunks(spark, d):
    return chunking.chunks(fx.read(spark, d, "documents"), 400, 100).select("doc_id", "idx", "tokens", F.md5("content").alias("digest"))


@query
def atoms_windows_segments(spark, d):
    s = chunking.segments(fx.read(spark, d, "documents"), every=True)
    return s.select("doc_id", "idx", "title", "start_atom", "end_atom", "tokens")


@query
def document_atoms(spark, d):
    return chunking.atoms(fx.read(spark, d, "documents"), every=True).select("doc_id", "idx", "kind", "tokens", "char_start", "char_end")


@query
def html_to_markdown(spark, d):
    from tessella.sources.html_markdown import convert_pages

    return convert_pages(fx.read(spark, d, "pages")).select("page_id", F.length("markdown").alias("chars"), F.md5("markdown").alias("digest"))


# -- more of the tables


@query
def wiki_list(spark, d):
    docs = fx.read(spark, d, "documents")
    refs = F.array(F.struct(F.col("source").alias("documentId")))
    entries = docs.select(F.col("doc_id").alias("id"), F.col("lang").alias("type"), F.lit("active").alias("status"), F.substring("text", 1, 40).alias("title"), F.col("text").alias("content"), refs.alias("refs"), F.col("n_chars").alias("updated_at"))
    return wiki.list_entries(entries, kind="en", search="license", documents=["src1", "src2", "src3", "src4"], limit=15).select("id", F.length("preview").alias("preview"), "ref_count")


@query
def citation_confidence(spark, d):
    o = fx.read(spark, d, "orders")
    entries = fx.read(spark, d, "customer").select(F.col("c_custkey").alias("id"), ((F.col("c_custkey") % 10) / 10).alias("confidence"))
    return wiki.cite(entries, o.select(F.col("o_custkey").alias("id"))).select("id", F.round("confidence", 6).alias("confidence"))


@query
def index_markdown(spark, d):
    p = fx.read(spark, d, "part")
    entries = p.select(F.col("p_brand").alias("user_id"), F.col("p_type").alias("type"), F.col("p_name").alias("title"), F.format_string("%07d", "p_partkey").alias("slug"), F.lit("active").alias("status"))
    return wiki.index_markdown(entries).select("user_id", F.md5("markdown").alias("digest"), F.length("markdown").alias("n"))


@query
def draft_assemble(spark, d):
    c = fx.read(spark, d, "conversations")
    sections = c.select(F.col("conv_id").alias("draft_id"), F.col("turn").alias("idx"), F.col("role").alias("title"), F.col("text").alias("content"), F.when(F.col("role") == "assistant", "confirmed").otherwise("pending").alias("status"))
    return drafts.assemble(sections).select("draft_id", F.md5("content").alias("digest"))


@query
def embedding_manifest(spark, d):
    e = fx.read(spark, d, "embeddings")
    return files.embedding_manifest(e.select(F.col("label").alias("doc_id"), F.col("vec_id").alias("chunk_id"), F.col("vec_id").alias("idx")))


@query
def model_resolution(spark, d):
    c = fx.read(spark, d, "customer")
    k = F.col("c_custkey")
    models = c.select(F.col("c_nationkey").alias("user_id"), k.alias("id"), F.array(F.when(k % 3 == 0, "chat").when(k % 3 == 1, "writing").otherwise("embed")).alias("capabilities"), F.when(k % 17 == 0, F.array(F.lit("draft"))).otherwise(F.array().cast("array<string>")).alias("default_for"), (k % 11 == 0).alias("is_default"))
    return lookups.resolve_model(models, "draft", "chat").select("user_id", "id")


@query
def stalled_tasks(spark, d):
    t = fx.tasks(spark, d).withColumns({"heartbeat_at": F.lit(None).cast("timestamp"), "started_at": F.col("created_at")})
    return tasks.stalled(t, "1998-01-01 00:00:00", 60 * 24 * 30).select("id")


@query
def section_prefix(spark, d):
    o = fx.sections(spark, d)
    idx = F.row_number().over(W.partitionBy("draft_id").orderBy("section_id")) - 1
    return tasks.completed_prefix(o.select("draft_id", idx.alias("idx"), (F.col("status") == "confirmed").alias("done")), ["draft_id"])


@query
def section_depth(spark, d):
    o = fx.read(spark, d, "orders").select(F.col("o_orderkey").alias("id"))
    up = F.when(F.col("id") % 16 > 0, F.col("id") - F.when(F.col("id") % 2 == 1, 1).when(F.col("id") % 4 == 2, 2).when(F.col("id") % 8 == 4, 4).otherwise(8))
    return graph.depths(o.withColumn("parent_id", up))


@query
def entity_merge(spark, d):
    e = fx.edges(spark, d)
    nodes = e.select(F.col("source").alias("id")).union(e.select("target")).distinct().select("id", F.lit("entity").alias("entity_type"), F.lit("").alias("description"), F.lit("d/c").alias("source_id"))
    renames = nodes.where("id RLIKE '^s[0-9]*[13579]$'").select(F.col("id").alias("old"), F.concat(F.lit("s"), (F.substring("id", 2, 9).cast("int") - 1).cast("string")).alias("new"))
    return graph.merge_entities(nodes, e, renames)[1]


@query
def related_images(spark, d):
    docs, pages = fx.read(spark, d, "documents"), fx.read(spark, d, "pages")
    hits = docs.select("doc_id", "source").orderBy(F.desc("n_chars"), "doc_id").limit(50)
    images = pages.select((F.col("page_id") % 1000).alias("doc_id"), F.col("url").alias("filename"))
    return fusion.attach_images(hits, images).select("doc_id", F.size("images").alias("images"))


@query
def segment_metrics(spark, d):
    return analytics.segmentation_metrics(chunking.segments(fx.read(spark, d, "documents"), every=True))


@query
def contextual_chunks(spark, d):
    from tessella.sources.html_markdown import convert_pages

    pages = convert_pages(fx.read(spark, d, "pages")).select(F.col("page_id").alias("doc_id"), F.col("markdown").alias("text"))
    return chunking.graph_chunks(pages, 300, 50).select("doc_id", "idx", F.md5("content").alias("digest"), "segment")


@query
def outline_chunks(spark, d):
    from tessella.sources.html_markdown import convert_pages

    pages = convert_pages(fx.read(spark, d, "pages")).select(F.col("page_id").alias("doc_id"), F.col("markdown").alias("text"))
    return macro.outline_chunks(pages, 500).select("doc_id", "idx", "path", F.md5("content").alias("digest"))


@query
def sanitized_markdown(spark, d):
    docs = fx.read(spark, d, "documents")
    return chunking.per_document(docs, lambda t: [(len(chunking.sanitize_markdown(t)),)], "n int")


@query
def segment_texts(spark, d):
    return chunking.segment_texts(fx.read(spark, d, "documents"), every=True).select("doc_id", "segment", F.md5("text").alias("digest"))


@query
def document_detail(spark, d):
    docs = fx.read(spark, d, "documents")
    view = docs.select("doc_id", F.col("source").alias("name"), F.when(F.col("doc_id") % 10 > 0, F.col("doc_id") - F.col("doc_id") % 10).alias("parent_id"))
    lines = docs.select("doc_id", F.explode(F.split("text", "\n")).alias("line"))
    tags = docs.select("doc_id", F.explode(F.array("lang", "source")).alias("tag"))
    return details.document_detail(view, lines, tags).select("doc_id", "parent_name", F.when(F.col("children").isNull(), 0).otherwise(F.size("children")).alias("children"), "chunks", F.array_join("tags", ",").alias("tags"))


@query
def page_backfill(spark, d):
    o = fx.read(spark, d, "orders")
    atoms = o.select(F.col("o_custkey").alias("doc_id"), F.col("o_orderkey").alias("idx"), F.when(F.col("o_orderstatus") == "F", "heading").otherwise("paragraph").alias("kind"), F.concat(F.lit(" "), F.col("o_orderpriority")).alias("content"))
    sections = o.where("o_orderkey % 3 = 0").select(F.col("o_custkey").alias("doc_id"), F.col("o_orderkey").alias("pos"), F.upper("o_orderpriority").alias("text"), (F.col("o_orderkey") % 50).cast("int").alias("page"))
    return details.backfill_pages(atoms, sections).select("doc_id", "idx", "page")


@query
def cross_references(spark, d):
    p = fx.read(spark, d, "part")
    refs = p.where("p_partkey <= 20").select(F.substring_index("p_name", " ", 1).alias("from_title"), F.substring_index("p_name", " ", -1).alias("to_title"), F.lit("relates").alias("relation"))
    return details.cross_references(p.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("title")), refs)


@query
def cross_references_all(spark, d):
    p = fx.read(spark, d, "part")
    refs = p.select(F.substring_index("p_name", " ", 1).alias("from_title"), F.substring_index("p_name", " ", -1).alias("to_title"), F.lit("relates").alias("relation")).distinct()
    return details.cross_references(p.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("title")), refs)


def queries() -> dict[str, Query]:
    from tessella.plans import catalog_tables, catalog_text  # noqa: F401  # they register their queries

    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    from tessella.plans import oracles_tables, oracles_text

    every = oracles.SQL | oracles_text.SQL | oracles_tables.SQL
    return {k: v for k, v in every.items() if k in queries()}
