"""Draft tables: references, patches, versions, generation targets, views."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tessella.functions import text as tx

LEAST_SECTION_SCORE = 0.4


def select_references(hits: DataFrame, wiki_hits: int, documents: list[str] | None = None, least: float = LEAST_SECTION_SCORE) -> DataFrame:
    """The best references of a section: eight, or four where the wiki covers it with three entries or more."""
    out = hits.where(F.col("score") >= least)
    if documents:
        out = out.where(F.col("document_id").isin(documents))
    return out.orderBy(F.desc("score"), "chunk_id").limit(4 if wiki_hits >= 3 else 8)


def retrieval_query(intent: Column, title: Column, description: Column, points: Column, hints: Column) -> Column:
    """The intent counts three times."""
    empty = F.lit("")
    return F.trim(F.regexp_replace(F.concat_ws(" ", *[F.coalesce(intent, empty)] * 3, F.coalesce(title, empty), F.coalesce(description, empty), F.array_join(F.coalesce(points, F.array().cast("array<string>")), " "), F.coalesce(hints, empty)), r"\s+", " "))


def union_references(wiki: DataFrame, chunks: DataFrame) -> DataFrame:
    """All wiki references, then all others, in their own order."""
    both = wiki.withColumn("branch", F.lit(0)).unionByName(chunks.withColumn("branch", F.lit(1)))
    return both.withColumn("position", F.row_number().over(W.partitionBy("section_id").orderBy("branch", F.desc("score"), "chunk_id")))


def replace_references(stored: DataFrame, new: DataFrame) -> DataFrame:
    """Sections that have new references lose their old ones."""
    return stored.join(new.select("section_id").distinct(), "section_id", "left_anti").unionByName(new)


def append_graph_references(stored: DataFrame, new: DataFrame) -> DataFrame:
    filled = new.withColumns({"relevance": F.coalesce("relevance", F.lit(0.7)), "document_name": F.coalesce(F.nullif("document_name", F.lit("")), F.lit("Knowledge graph")), "source_type": F.lit("rag_graph")})
    return stored.unionByName(filled.select(*stored.columns))


def reference_view(references: DataFrame) -> DataFrame:
    """Unknown source types are chunks; malformed image lists are empty."""
    kind = F.when(F.col("source_type").isin("rag_chunk", "rag_graph", "wiki"), F.col("source_type")).otherwise("rag_chunk")
    images = F.coalesce(F.from_json("images", "array<struct<filename:string,url:string>>"), F.array().cast("array<struct<filename:string,url:string>>"))
    return references.withColumn("source_type", kind).withColumn("images", images)


def generation_targets(sections: DataFrame, overwrite: bool) -> DataFrame:
    busy = F.col("status").isin("generating", "revising")
    wanted = ~busy if overwrite else F.col("status").isin("pending", "failed") | ((F.col("status") == "reviewing") & (F.coalesce("content", F.lit("")) == ""))
    return sections.where(wanted)


def version_source(selected: Column, a: Column, b: Column) -> Column:
    return F.when(selected == a, "model_a").when(selected == b, "model_b").otherwise("edited")


def display_state(sections: DataFrame) -> DataFrame:
    two = F.col("candidate_a").isNotNull() & F.col("candidate_b").isNotNull()
    return sections.withColumns({"comparing": (F.col("status") == "reviewing") & two & F.col("content").isNull(), "shown": F.coalesce("content", "candidate_a", "candidate_b")})


def confirm(sections: DataFrame, versions: DataFrame, confirmed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Confirmed texts (section_id, content) lock their sections and add a version; words count Latin runs and CJK characters."""
    n = versions.groupBy("section_id").agg(F.count("*").alias("n"))
    added = confirmed.join(n, "section_id", "left").select("section_id", (F.coalesce("n", F.lit(0)) + 1).alias("version"), "content")
    new = confirmed.select("section_id", F.col("content").alias("new_content"))
    locked = sections.join(new, "section_id", "left")
    hit = F.col("new_content").isNotNull()
    locked = locked.withColumns({"content": F.coalesce("new_content", "content"), "words": F.when(hit, tx.count_words(F.col("new_content"))).otherwise(F.col("words")), "status": F.when(hit, "locked").otherwise(F.col("status"))}).drop("new_content")
    return locked, versions.unionByName(added.select(*versions.columns))


def history(versions: DataFrame, section_id=None) -> DataFrame:
    out = versions if section_id is None else versions.where(F.col("section_id") == section_id)
    return out.orderBy("section_id", F.desc("version"))


def version(versions: DataFrame, section_id, number: int) -> DataFrame:
    return versions.where((F.col("section_id") == section_id) & (F.col("version") == number))


def patch_outline(sections: DataFrame, patches: DataFrame) -> DataFrame:
    """Sections (id, parent_id, idx, title, words) after patches (the same with action delete, update, create).

    Null fields of an update keep their value; temporary ids of new sections ("tmp...") become
    stable ones, also where a new child names a new parent.
    """
    real = lambda c: F.when(F.col(c).startswith("tmp"), F.concat(F.lit("new-"), F.substring(F.md5(c), 1, 12))).otherwise(F.col(c))
    gone = patches.where("action = 'delete'").select("id")
    change = patches.where("action = 'update'").select("id", *[F.col(c).alias(f"p_{c}") for c in ("parent_id", "idx", "title", "words")])
    kept = sections.join(gone, "id", "left_anti").join(change, "id", "left")
    kept = kept.select("id", F.coalesce(F.when(~F.col("p_parent_id").startswith("tmp"), F.col("p_parent_id")), "parent_id").alias("parent_id"), *[F.coalesce(f"p_{c}", c).alias(c) for c in ("idx", "title", "words")])
    made = patches.where("action = 'create'").select(real("id").alias("id"), real("parent_id").alias("parent_id"), F.coalesce("idx", F.lit(0)).alias("idx"), F.coalesce("title", F.lit("")).alias("title"), "words")
    return kept.unionByName(made)


def parents_by_path(rows: DataFrame) -> DataFrame:
    """Sections of flattened outlines (doc_id, path, parent path) with the index of their parent."""
    up = rows.select("doc_id", F.col("path").alias("parent"), F.col("idx").alias("parent_idx"))
    return rows.join(up, ["doc_id", "parent"], "left")


def assemble(sections: DataFrame) -> DataFrame:
    """(draft_id, content): confirmed sections below plain second-level headings."""
    part = F.concat(F.lit("## "), F.col("title"), F.lit("\n\n"), F.coalesce("content", F.lit("")))
    kept = sections.where(F.col("status").isin("confirmed", "locked"))
    return kept.groupBy("draft_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("idx", part.alias("p")))), lambda x: x["p"]), "\n\n").alias("content"))


def effective_constraints(general: Column, own: Column) -> Column:
    """JSON maps merged, the section's own values first; malformed ones are empty."""
    read = lambda c: F.coalesce(F.from_json(c, "map<string,string>"), F.create_map().cast("map<string,string>"))
    return F.map_concat(F.map_filter(read(general), lambda k, v: ~F.map_contains_key(read(own), k)), read(own))


def key_points(raw: Column) -> Column:
    """A JSON list, or one plain string."""
    return F.coalesce(F.from_json(raw, F.lit("array<string>")), F.when(F.length(F.trim(raw)) > 0, F.array(raw)), F.array().cast("array<string>"))


def tag_archetype(primary: Column, secondary: Column, known: list[str]) -> Column:
    fix = lambda c: F.when(c.isin(known), c)
    return F.concat_ws("+", F.coalesce(fix(primary), F.lit("general")), F.when(fix(secondary) != primary, fix(secondary)))
