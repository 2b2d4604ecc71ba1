"""Entity graph over node and edge tables (undirected edges, one row each: source, target, weight)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tessella.operators.matching import holding
from tessella.storage import written

SEPARATOR = "<SEP>"


def both_ways(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("source").alias("node"), F.col("target").alias("other")).union(edges.select("target", "source"))


def degrees(edges: DataFrame) -> DataFrame:
    """(node, degree); a self-loop counts twice."""
    return both_ways(edges).groupBy("node").agg(F.count("*").alias("degree"))


def flatten_nodes(nodes: DataFrame) -> DataFrame:
    first = lambda c: F.trim(F.split(F.coalesce(F.col(c), F.lit("")), SEPARATOR)[0])
    return nodes.select("id", F.coalesce(F.nullif("entity_type", F.lit("")), F.lit("entity")).alias("type"), F.substring(first("description"), 1, 200).alias("description"), first("source_id").alias("source_id"))


def popular(edges: DataFrame, most: int) -> DataFrame:
    return degrees(edges).orderBy(F.desc("degree"), "node").limit(most)


def labels(nodes: DataFrame, keyword: str | None = None) -> DataFrame:
    out = nodes.select("id").distinct()
    return out.where(F.contains(F.lower("id"), F.lit(keyword.lower()))) if keyword else out


def summary(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    return nodes.agg(F.countDistinct("id").alias("entities")).crossJoin(edges.agg(F.count("*").alias("relations")))  # one row each


def neighbourhood(edges: DataFrame, seeds: DataFrame, depth: int = 2, most: int = 100, degree: DataFrame | None = None) -> DataFrame:
    """(node, hops) within `depth` edges of the seeds (node), nearest first, then by degree; at most `most`.

    One join for each hop; the frontier holds new nodes only, so no edge is followed twice. Each
    frontier that is followed further is written, so that its lineage does not grow with the hops.
    degree (node, degree) are those of all nodes, counted here if they aren't given.
    """
    ways = both_ways(edges)
    seen = frontier = seeds.select("node").distinct().withColumn("hops", F.lit(0))
    for hop in range(1, depth + 1):
        near = ways.join(frontier.select(F.col("node").alias("at")), F.col("node") == F.col("at"), "left_semi").select(F.col("other").alias("node")).distinct()
        frontier = near.join(seen, "node", "left_anti").withColumn("hops", F.lit(hop))
        if hop < depth:
            frontier = written(frontier)
        seen = seen.union(frontier)
    ranked = seen.join(degrees(edges) if degree is None else degree, "node", "left")
    return ranked.orderBy("hops", F.desc_nulls_last("degree"), "node").limit(most).select("node", "hops")


def induced(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with both ends among the nodes (node)."""
    keep = nodes.select("node").distinct()
    a = edges.join(keep, edges["source"] == keep["node"], "left_semi")
    return a.join(keep, a["target"] == keep["node"], "left_semi")


def core(edges: DataFrame, most: int = 50, least_degree: int = 2) -> DataFrame:
    """(node, degree) around the node of the highest degree: two hops, inner degree of at least `least_degree`.

    If fewer than eight nodes (or all, of a smaller neighbourhood) are left, all of the neighbourhood stay.
    """
    edges = written(edges.select("source", "target"))
    degree = written(degrees(edges))
    centre = degree.orderBy(F.desc("degree"), "node").limit(1).select("node")
    near = written(neighbourhood(edges, centre, 2, most, degree))
    inner = degrees(induced(edges, near))
    known = near.join(inner, "node", "left").join(centre.withColumn("centre", F.lit(True)), "node", "left").select("node", "hops", F.coalesce("degree", F.lit(0)).alias("degree"), F.coalesce("centre", F.lit(False)).alias("centre"))
    kept = (F.col("degree") >= least_degree) | F.col("centre")
    totals = known.agg(F.count_if(kept).alias("kept"), F.count("*").alias("all"))
    relaxed = F.col("kept") < F.least(F.lit(8), F.col("all"))
    return known.crossJoin(F.broadcast(totals)).where(kept | relaxed).select("node", "degree")  # one row of totals


def overview(nodes: DataFrame, edges: DataFrame, most: int = 80, least_degree: int = 2) -> DataFrame:
    """(node, degree, doc_ids) over all documents: shared entities first, then each document's best, then the best of the rest.

    nodes: id, source_id with chunk ids "<document>/..." between separators. A third of `most`
    is kept for entities of several documents; each document has at least five.
    """
    parts = F.transform(F.split(F.coalesce("source_id", F.lit("")), SEPARATOR), lambda c: F.trim(c))
    docs = F.array_sort(F.array_distinct(F.transform(F.filter(parts, lambda c: F.contains(c, F.lit("/"))), lambda c: F.substring_index(c, "/", 1))))
    known = nodes.select(F.col("id").alias("node"), docs.alias("doc_ids")).join(degrees(edges), "node", "left").withColumn("degree", F.coalesce("degree", F.lit(0)))
    known = written(known)  # read six times below
    shared = known.where(F.size("doc_ids") > 1)
    by_doc = known.select("node", "degree", F.explode("doc_ids").alias("doc"))
    budget = shared.agg(F.least(F.count("*"), F.lit(most // 3)).alias("cross")).crossJoin(by_doc.agg(F.greatest(F.countDistinct("doc"), F.lit(1)).alias("docs")))
    budget = F.broadcast(budget.select("cross", F.greatest(F.floor((most - F.col("cross")) / F.col("docs")), F.lit(5)).alias("per_doc")))  # one row
    best = [F.desc("degree"), "node"]
    top_shared = shared.orderBy(*best).limit(most // 3).select("node")
    # No document has more than the bound, which is known before the budget: each task passes on so many of it only.
    ranked = by_doc.withColumn("k", F.row_number().over(W.partitionBy("doc").orderBy(*best))).where(F.col("k") <= max(most, 5))
    top_doc = ranked.crossJoin(budget).where("k <= per_doc").select("node")
    chosen = top_shared.union(top_doc).distinct()
    spare = F.broadcast(chosen.agg(F.greatest(F.lit(most) - F.count("*"), F.lit(0)).alias("spare")))
    rest = known.join(chosen, "node", "left_anti").orderBy(*best).limit(most)
    fill = rest.withColumn("k", F.row_number().over(W.orderBy(*best))).crossJoin(spare).where("k <= spare").select("node")  # at most `most` rows
    selected = known.join(chosen.union(fill), "node", "left_semi")
    if least_degree > 1:
        share = F.broadcast(selected.agg((F.count_if(F.col("degree") >= least_degree) < 0.6 * F.count("*")).alias("relax")))
        selected = selected.crossJoin(share).where(F.col("degree") >= F.when(F.col("relax"), 1).otherwise(least_degree)).drop("relax")
    return selected.select("node", "degree", "doc_ids")


def cross_document(nodes: DataFrame) -> DataFrame:
    parts = F.transform(F.split(F.coalesce("source_id", F.lit("")), SEPARATOR), lambda c: F.substring_index(F.trim(c), "/", 1))
    return nodes.where(F.size(F.array_distinct(parts)) > 1)


def evidence(entities: DataFrame, wanted: DataFrame, most: int = 8) -> DataFrame:
    """(entity, nth, chunk_id) for each wanted entity: an exact name, else the same in any case, else one that holds the other.

    entities: name, chunk_ids; wanted: entity (the query side, a list of names asked for).
    Only names of the best tier count; chunks are those of its names in order, each once.
    """
    asked = wanted.select(F.trim("entity").alias("entity")).where("entity <> ''").distinct()
    low, name = F.lower("entity"), F.lower("name")
    held = entities.where(F.size("chunk_ids") > 0)
    # Names that are equal but for case are joined by equality; only names without one are searched for inside others.
    same = held.join(asked, name == low).withColumn("tier", F.when(F.col("name") == F.col("entity"), 0).otherwise(1))
    left = written(asked.join(held.select(name.alias("n")).distinct(), low == F.col("n"), "left_anti").select("entity", low.alias("low")))
    names = held.select("name", "chunk_ids", name.alias("n"))
    inside = holding(names, left, "n", "low").unionByName(holding(left, names, "low", "n"))
    parts = inside.select("name", "chunk_ids", "entity").dropDuplicates(["entity", "name"]).withColumn("tier", F.lit(2))
    pairs = same.unionByName(parts)
    found = pairs.groupBy("entity").agg(F.min("tier").alias("best"))
    mine = pairs.join(found, "entity").where("tier = best").select("entity", "name", F.posexplode("chunk_ids").alias("at", "chunk_id"))
    once = mine.groupBy("entity", "chunk_id").agg(F.min(F.struct("name", "at")).alias("first"))
    nth = F.row_number().over(W.partitionBy("entity").orderBy("first"))
    return once.withColumn("nth", nth).where(F.col("nth") <= most).select("entity", "nth", "chunk_id")


def merge_entities(nodes: DataFrame, edges: DataFrame, renames: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges after renames (old, new): sources are united, parallel edges summed, loops of merged nodes dropped."""
    to = lambda df, c: df.join(renames.select(F.col("old").alias(c), F.col("new").alias(f"{c}_new")), c, "left").withColumn(c, F.coalesce(f"{c}_new", c)).drop(f"{c}_new")
    moved = to(nodes, "id")
    merged = moved.groupBy("id").agg(F.first("entity_type", ignorenulls=True).alias("entity_type"), F.array_join(F.array_sort(F.collect_set("description")), SEPARATOR).alias("description"), F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.split("source_id", SEPARATOR))))), SEPARATOR).alias("source_id"))
    e = to(to(edges, "source"), "target").where("source <> target")
    e = e.select(F.least("source", "target").alias("source"), F.greatest("source", "target").alias("target"), "weight")
    return merged, e.groupBy("source", "target").agg(F.sum("weight").alias("weight"))


EDITABLE = ("entity_type", "description", "source_id")


def create_entities(nodes: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes with the new ones (id, entity_type, description), (id, error)): a name that is taken, empty or asked for twice is refused."""
    asked = new.withColumn("id", F.trim("id")).withColumn("nth", F.row_number().over(W.partitionBy("id").orderBy("entity_type", "description")))
    known = nodes.select(F.col("id").alias("k")).distinct()
    marked = asked.join(known, F.col("id") == F.col("k"), "left")
    error = F.when(F.coalesce("id", F.lit("")) == "", "empty").when(F.col("k").isNotNull() | (F.col("nth") > 1), "exists")
    judged = written(marked.withColumn("error", error))
    made = judged.where("error IS NULL").select("id", "entity_type", "description", F.lit("").alias("source_id"))
    return nodes.unionByName(made), judged.where("error IS NOT NULL").select("id", "error")


def edit_entities(nodes: DataFrame, edits: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes after edits (id, field, value, seq), (id, field, error)): the last edit of a field counts; an unknown node or field is refused."""
    known = nodes.select(F.col("id").alias("k")).distinct()
    error = F.when(~F.col("field").isin(*EDITABLE), "field").when(F.col("k").isNull(), "missing")
    judged = written(edits.join(known, F.col("id") == F.col("k"), "left").withColumn("error", error))
    last = judged.where("error IS NULL").groupBy("id").pivot("field", list(EDITABLE)).agg(F.max_by(F.struct("value"), "seq"))
    last = last.select(F.col("id").alias("e_id"), *[F.col(f).alias(f"e_{f}") for f in EDITABLE])
    met = nodes.join(last, F.col("id") == F.col("e_id"), "left")
    out = met.select(*[F.when(F.col(f"e_{c}").isNotNull(), F.col(f"e_{c}.value")).otherwise(F.col(c)).alias(c) if c in EDITABLE else F.col(c) for c in nodes.columns])
    return out, judged.where("error IS NOT NULL").select("id", "field", "error")


def delete_entities(nodes: DataFrame, edges: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    g = gone.select("id").distinct()
    left = edges.join(g, edges["source"] == g["id"], "left_anti")
    return nodes.join(g, "id", "left_anti"), left.join(g, left["target"] == g["id"], "left_anti")


def purge_documents(nodes: DataFrame, gone: list[str], column: str = "source_id") -> DataFrame:
    """Rows (nodes or edges) without the sources of the deleted documents; rows with no source left go."""
    parts = F.filter(F.split(column, SEPARATOR), lambda c: ~F.substring_index(F.trim(c), "/", 1).isin(gone) & (F.trim(c) != ""))
    return nodes.withColumn(column, F.array_join(parts, SEPARATOR)).where(F.col(column) != "")


def missing_after_insert(expected: DataFrame, committed: DataFrame, key: str) -> DataFrame:
    """What was to be inserted and is not there; empty for a good insert."""
    return expected.join(committed, key, "left_anti")


def health(folders: DataFrame, documents: DataFrame) -> DataFrame:
    """Graph folders of documents that no longer exist, and documents without a folder."""
    stale = folders.join(documents, "doc_id", "left_anti").select("doc_id", F.lit("stale").alias("issue"))
    missing = documents.join(folders, "doc_id", "left_anti").select("doc_id", F.lit("missing").alias("issue"))
    return stale.union(missing)


def depths(tree: DataFrame) -> DataFrame:
    """(id, depth) of a forest (id, parent_id) of any depth: 0 for roots, 1 below a parent that is missing; null on and below a cycle.

    Pointer jumping: each round, every node that isn't done points twice as far up, so that the rounds are the
    logarithm of the depth. Nodes that are done share a null, which would be one key of the join.
    """
    nodes = written(tree.groupBy("id").agg(F.max("parent_id").alias("up")))
    known = nodes.select(F.col("id").alias("k"))
    # Nodes that point to nothing are done and only looked up; a missing parent is a root of its own.
    found = nodes.where("up IS NOT NULL").join(known, F.col("up") == F.col("k"), "left")
    here = written(found.select("id", F.when(F.col("k").isNotNull(), F.col("up")).alias("up"), F.lit(1).cast("long").alias("depth")))
    roots = nodes.where("up IS NULL").select("id", "up", F.lit(0).cast("long").alias("depth"))
    live, done = here.where("up IS NOT NULL"), roots.union(here.where("up IS NULL"))
    last = -1
    while (left := live.count()) and left != last:
        last = left
        above = done.union(live).select(F.col("id").alias("a"), F.col("up").alias("a_up"), F.col("depth").alias("a_depth"))
        here = written(live.join(above, F.col("up") == F.col("a")).select("id", F.col("a_up").alias("up"), (F.col("depth") + F.col("a_depth")).alias("depth")))
        live, done = here.where("up IS NOT NULL"), done.union(here.where("up IS NULL"))
    return done.select("id", "depth").union(live.select("id", F.lit(None).cast("long")))


def connected(edges: DataFrame, a: str = "source", b: str = "target") -> DataFrame:
    """(node, component) for each node of an edge; a component is named by its smallest node.

    Alternating stars: each node's larger neighbours are hung onto the smallest node around it, then
    its smaller ones, until nothing changes. Minima are partial aggregates, so that a hub is summed
    up before it is shuffled; each round is written.
    """
    links = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u IS NOT NULL AND v IS NOT NULL")
    nodes = written(links.select(F.col("u").alias("node")).union(links.select("v")).distinct())

    def star(rows: DataFrame, large: bool) -> DataFrame:
        both = rows.union(rows.select(F.col("v").alias("u"), F.col("u").alias("v")))
        seen = both if large else both.where("v < u")
        least = seen.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("m_u"), F.least("u", "m").alias("m"))
        met = seen.join(least, F.col("u") == F.col("m_u"))
        if large:
            return met.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        return met.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("m_u", "m")).where("u <> v").distinct()

    live, before = written(links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()), None
    while True:
        mark = live.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == before:
            break
        before = mark
        live = written(star(written(star(live, True)), False))
    return nodes.join(live, F.col("node") == F.col("u"), "left").select("node", F.coalesce("v", "node").alias("component"))
