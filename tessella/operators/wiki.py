"""The synthesized knowledge layer: title merging, source references, sweeps, statistics, exports."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tessella.functions import text as tx
from tessella.storage import written

DUPLICATE = 0.45
CONTENT_LIMIT = 3000
FEW = 100_000  # tokens of titles that are broadcast
REF = "struct<documentId:string,chunkId:string,chunkIndex:int,entityId:string>"


def parse_refs(raw: Column) -> Column:
    """References in a JSON text; anything malformed is an empty list."""
    got = F.from_json(raw, F.lit(f"array<{REF}>"))
    return F.coalesce(F.filter(got, lambda r: r.isNotNull()), F.array().cast(f"array<{REF}>"))


def ref_key(r: Column) -> Column:
    whole = F.concat(F.coalesce(r["documentId"], F.lit("undefined")), F.lit(":"), F.coalesce(r["chunkIndex"], F.lit(-1)).cast("string"))
    return F.coalesce(F.nullif(r["chunkId"], F.lit("")), F.nullif(r["entityId"], F.lit("")), whole)


def dedupe_refs(refs: Column) -> Column:
    """Of references with one key, the first."""
    keys = F.transform(refs, ref_key)
    numbered = F.transform(refs, lambda r, i: F.struct(r.alias("r"), i.alias("i")))
    return F.transform(F.filter(numbered, lambda x: F.array_position(keys, ref_key(x["r"])) == x["i"] + 1), lambda x: x["r"])


def best_titles(candidates: DataFrame, existing: DataFrame, threshold: float = DUPLICATE) -> DataFrame:
    """(id, action, slug, score): each candidate (id, title) with the most similar existing title (slug, title).

    Titles of equal tokens are one on either side. They meet on the first tokens of both in the
    order of their frequency (prefix filter): a pair of a similarity of at least `threshold`
    shares one of them, and hot tokens come last. The score is 0 where no title reaches the
    threshold. Ties go to the smaller slug.
    """
    tokens = F.array_sort(tx.title_tokens(F.col("title")))
    c = written(candidates.select("id", tokens.alias("x")))
    e = written(existing.select("slug", tokens.alias("y")).groupBy("y").agg(F.min("slug").alias("slug")))
    often = written(e.select(F.explode("y").alias("token")).groupBy("token").agg(F.count("*").alias("df")))

    def heads(rows: DataFrame, name: str) -> DataFrame:
        ranked = rows.withColumn("token", F.explode(name)).join(often, "token", "left").groupBy(*rows.columns).agg(F.sort_array(F.collect_list(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "token"))).alias("r"))
        n = F.size("r")
        return ranked.select(*rows.columns, F.explode(F.slice("r", F.lit(1), n - F.ceil(n * threshold - 1e-9).cast("int") + 1)).alias("head")).select(*rows.columns, F.col("head.token").alias("token"))

    k = F.size(F.array_intersect("x", "y"))
    score = k / (F.size("x") + F.size("y") - k)
    pairs = heads(c.select("x").distinct(), "x").join(heads(e, "y"), "token").select("x", "slug", score.alias("score")).where(F.col("score") >= threshold)
    best = pairs.groupBy("x").agg(F.min(F.struct((-F.col("score")).alias("s"), "slug")).alias("b"))
    out = c.join(best, "x", "left").select("id", F.col("b.slug").alias("slug"), F.coalesce(-F.col("b.s"), F.lit(0.0)).alias("score"))
    return out.select("id", F.when(F.col("slug").isNotNull(), "update").otherwise("create").alias("action"), "slug", "score")


def unique_slugs(entries: DataFrame, user: str = "user_id") -> DataFrame:
    """Adds slug: the title's, numbered from -2 on for further entries with the same one."""
    base = tx.slugify(F.col("title"))
    named = entries.withColumn("_base", F.when(base == "", F.concat(F.lit("entry-"), F.col("id").cast("string"))).otherwise(base))
    nth = F.row_number().over(W.partitionBy(user, "_base").orderBy("id"))
    return named.withColumn("_nth", nth).withColumn("slug", F.concat("_base", F.when(F.col("_nth") > 1, F.concat(F.lit("-"), F.col("_nth").cast("string"))).otherwise(""))).drop("_base", "_nth")


def merge_batch(existing: DataFrame, candidates: DataFrame, as_of: str, user: str = "user_id", fuse: Callable[[str, str], str] | None = None) -> DataFrame:
    """Entries of each user after merging candidates in order of (rank of type, seq); every decision sees the ones before.

    Inputs have (user, type, title, slug, content, refs array<string>, confidence, seq); refs are
    keys. A title that is like an existing one updates it (content appended or fused, confidence
    up by 0.05, references united); else it creates an entry. A user's wiki is one task.
    """
    from tessella.functions.titles import title_similarity

    kinds = {"doc_summary": 0, "topic": 1, "concept": 2, "claim": 3}
    cols = [user, "type", "title", "slug", "content", "refs", "confidence"]
    schema = f"{user} string, type string, title string, slug string, content string, refs array<string>, confidence double, action string"

    def run(part: pd.DataFrame) -> pd.DataFrame:
        base = part[part["_new"] == 0].sort_values("seq")
        rows = [dict(r, refs=list(r["refs"]), action="keep") for r in base[cols].to_dict("records")]
        new = part[part["_new"] == 1]
        new = new.assign(_k=new["type"].map(kinds).fillna(9)).sort_values(["_k", "seq"])
        for c in new[cols].to_dict("records"):
            scores = [title_similarity(c["title"], r["title"]) for r in rows]
            top = max(range(len(rows)), key=lambda k: (scores[k], -k), default=None)
            text = c["content"][:CONTENT_LIMIT]
            if top is not None and scores[top] >= DUPLICATE:
                r = rows[top]
                joined = fuse(r["content"], text) if fuse else f"{r['content']}\n\n--- Update {as_of} ---\n{text}"
                r |= {"content": joined[: 2 * CONTENT_LIMIT], "confidence": min(1.0, r["confidence"] + 0.05), "refs": list(dict.fromkeys([*r["refs"], *c["refs"]])), "action": "update" if r["action"] == "keep" else r["action"]}
            else:
                slug, k, taken = c["slug"], 2, {r["slug"] for r in rows}
                while slug in taken:
                    slug, k = f"{c['slug']}-{k}", k + 1
                rows.append(c | {"slug": slug, "content": text, "refs": list(c["refs"]), "action": "create"})
        return pd.DataFrame(rows, columns=[*cols, "action"])

    both = existing.select(*cols, "seq", F.lit(0).alias("_new")).unionByName(candidates.select(*cols, "seq", F.lit(1).alias("_new")))
    return both.groupBy(user).applyInPandas(run, schema)


def title_pairs(left: DataFrame, right: DataFrame, user: str = "user_id", threshold: float = DUPLICATE) -> DataFrame:
    """(x, y, alike) of nodes of one user whose token sets are alike: both sides are (user, node, tokens), distinct.

    They meet on the first tokens of both in the order of their frequency: a pair of a similarity of
    at least `threshold` shares one of them, and hot tokens come last. A pair is given at the first
    token on which it meets only. The right side is broadcast after it was counted, if it is small.
    """
    often = written(right.select(user, F.explode("tokens").alias("token")).groupBy(user, "token").agg(F.count("*").alias("df")))

    def heads(rows: DataFrame, name: str) -> DataFrame:
        ranked = rows.withColumn("token", F.explode("tokens")).join(often, [user, "token"], "left").groupBy(user, "node", "tokens").agg(F.sort_array(F.collect_list(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "token"))).alias("r"))
        n = F.size("r")
        head = F.transform(F.slice("r", F.lit(1), n - F.ceil(n * threshold - 1e-9).cast("int") + 1), lambda h: h["token"])
        return ranked.select(user, F.col("node").alias(name), F.col("tokens").alias(f"{name}_t"), head.alias(f"{name}_h")).select("*", F.explode(f"{name}_h").alias("token"))

    k = F.size(F.array_intersect("x_t", "y_t"))
    few = (often.agg(F.sum("df")).first()[0] or 0) <= FEW
    met = heads(left, "x").join(F.broadcast(heads(right, "y")) if few else heads(right, "y").hint("merge"), [user, "token"]).where((F.col("x") != F.col("y")) & (F.col("token") == F.element_at(F.array_intersect("x_h", "y_h"), 1)))
    return met.select("x", "y", (k / (F.size("x_t") + F.size("y_t") - k)).alias("alike")).where(F.col("alike") >= threshold)


def first_alone(links: DataFrame) -> DataFrame:
    """(node) of those nodes of links (a, b), a before b, that no earlier node that stays is linked with, among nodes with a link.

    In rounds: a node without an earlier undecided one stays, and what follows it by a link goes. Each
    round writes the links between undecided nodes only, so that they shrink.
    """
    spark = links.sparkSession
    left = written(links.select("a", "b"))
    kept = []
    while not left.isEmpty():
        stays = written(left.select(F.col("a").alias("node")).distinct().join(left.select(F.col("b").alias("node")), "node", "left_anti"))
        goes = written(left.join(stays, F.col("a") == F.col("node"), "left_semi").select(F.col("b").alias("node")).distinct())
        # A node all of whose earlier ones went has no link left as the later end; without any link left it stays.
        some = left.join(goes, F.col("a") == F.col("node"), "left_anti").join(goes, F.col("b") == F.col("node"), "left_anti").join(stays, F.col("a") == F.col("node"), "left_anti")
        ends = left.select(F.col("a").alias("node")).union(left.select("b")).distinct().join(stays.union(goes), "node", "left_anti")
        left = written(some)
        lone = ends.join(left.select(F.col("a").alias("node")).union(left.select("b")), "node", "left_anti")
        kept += [stays, written(lone)]
    out = spark.createDataFrame([], links.select(F.col("a").alias("node")).schema)
    for part in kept:
        out = out.union(part)
    return out


def merge_entries(existing: DataFrame, candidates: DataFrame, as_of: str, user: str = "user_id", fuse: Callable[[str, str], str] | None = None) -> DataFrame:
    """The entries of `merge_batch`, with `merges` (candidates that were merged into an entry), decided by distinct token sets.

    Where a candidate goes depends on its tokens and on which entries were there before it. Of equal
    sets only the first entry can win, and a set creates an entry only when it comes first and nothing
    before it is alike; then all later ones of it go there. So sets that are like no existing one are
    decided among themselves by `first_alone`, each set then has the few steps at which a created entry
    becomes its best one, and each candidate takes the step of its place. Titles without tokens are like
    nothing, not even their equals. Entries then gather their candidates in order; texts stream past
    by entry and order, so that neither a user's wiki nor an entry's candidates are one task's memory.
    Slugs are numbered afterwards, in the order of creation, among those of one stem only.
    """
    cols = [user, "type", "title", "slug", "content", "refs", "confidence"]
    both = existing.select(*cols, "seq", F.lit(0).alias("new")).unionByName(candidates.select(*cols, "seq", F.lit(1).alias("new")))
    tokens = F.array_sort(tx.title_tokens(F.coalesce("title", F.lit(""))))
    owner = F.coalesce(F.concat(F.lit("="), F.col(user).cast("string")), F.lit(""))
    named = both.withColumns({"tokens": tokens, "owner": owner, "rank": _kind_rank(F.col("type"))})
    node = F.when(F.size("tokens") > 0, F.concat_ws("\x00", "owner", F.array_join("tokens", " ")))
    rows = written(named.withColumns({"node": node, "id": F.monotonically_increasing_id()}))
    # Existing entries come before all others, by seq; candidates by the rank of their type, then by seq.
    place = F.struct(F.col("new"), F.when(F.col("new") == 1, F.col("rank")).otherwise(0).alias("rank"), "seq", "id")
    sets = written(rows.where("node IS NOT NULL").groupBy("owner", "node", "new").agg(F.first("tokens").alias("tokens"), F.min(place).alias("place")))
    old, new = sets.where("new = 0"), sets.where("new = 1")
    side = lambda d: d.select("owner", "node", "tokens")
    first_old = old.select(F.col("node").alias("y"), F.col("place").alias("y_place"))
    equal = new.select(F.col("node").alias("x")).join(first_old, F.col("x") == F.col("y")).select("x", F.lit(1.0).alias("alike"), "y_place")
    others = new.join(old.select("node"), "node", "left_anti")
    near = title_pairs(side(others), side(old), "owner").join(first_old, "y").select("x", "alike", "y_place")
    best = written(equal.unionByName(near).groupBy("x").agg(F.min(F.struct((-F.col("alike")).alias("away"), F.col("y_place").alias("place"))).alias("best")))
    free = written(new.join(best, F.col("node") == F.col("x"), "left_anti"))
    at = free.select("node", "place")
    links = title_pairs(side(free), side(free), "owner").join(at.select(F.col("node").alias("x"), F.col("place").alias("x_place")), "x").join(at.select(F.col("node").alias("y"), F.col("place").alias("y_place")), "y")
    links = written(links.where("x_place < y_place").select(F.col("x").alias("a"), F.col("y").alias("b")))
    ends = links.select(F.col("a").alias("node")).union(links.select("b"))
    made = written(free.join(first_alone(links).union(at.select("node").join(ends, "node", "left_anti")), "node", "left_semi"))
    came = made.select(F.col("node").alias("y"), F.col("place").alias("y_place"))
    own = came.select(F.col("y").alias("x"), F.lit(1.0).alias("alike"), "y_place")
    later = title_pairs(side(new), side(made), "owner").join(came, "y").select("x", "alike", "y_place").unionByName(own)
    every = later.join(best, "x", "left").where(F.col("best").isNull() | (-F.col("alike") < F.col("best.away")))
    steps = every.select("x", F.struct(F.col("y_place").alias("place"), F.col("alike")).alias("s")).unionByName(best.select("x", F.struct(F.col("best.place").alias("place"), (-F.col("best.away")).alias("alike")).alias("s")))
    steps = steps.groupBy("x").agg(F.sort_array(F.collect_list("s")).alias("s"))
    # Of entries that are alike to one degree the first one stays the best, so only steps up count.
    up = F.aggregate("s", F.slice("s", 1, 0), lambda acc, v: F.when((F.size(acc) == 0) | (F.try_element_at(acc, F.lit(-1))["alike"] < v["alike"]), F.concat(acc, F.array(v))).otherwise(acc))
    steps = written(steps.select("x", up.alias("s")))
    mine = rows.select("id", "node", "new", place.alias("place"))
    met = mine.where("new = 1").join(steps, F.col("node") == F.col("x"), "left")
    last = F.element_at(F.filter("s", lambda v: v["place"] <= F.col("place")), -1)
    goes = written(met.select("id", "place", F.coalesce(last["place"]["id"], F.col("id")).alias("entry")))
    heads = rows.join(goes.where("id <> entry").select("id"), "id", "left_anti").drop("tokens", "owner", "node")
    cut = F.substring("content", 1, CONTENT_LIMIT)
    joined = rows.join(goes.where("id <> entry").select("id", "entry", "place"), "id")
    gathered = joined.groupBy("entry").agg(F.count("*").alias("merges"), F.sort_array(F.collect_list(F.struct("place", "refs"))).alias("more")).withColumnRenamed("entry", "g_entry")
    texts = joined.select("entry", "place", F.lit(1).alias("more"), cut.alias("text")).unionByName(heads.join(gathered.select("g_entry"), F.col("id") == F.col("g_entry"), "left_semi").select(F.col("id").alias("entry"), place.alias("place"), F.lit(0).alias("more"), F.when(F.col("new") == 1, cut).otherwise(F.col("content")).alias("text")))

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        entry, text = None, ""
        for b in batches:
            out = []
            for e, more, t in zip(b["entry"], b["more"], b["text"], strict=True):
                if not more:
                    if entry is not None:
                        out.append((entry, text))
                    entry, text = e, t
                elif fuse:
                    text = fuse(text, t)[: 2 * CONTENT_LIMIT]
                elif len(text) != 2 * CONTENT_LIMIT:
                    text = f"{text}\n\n--- Update {as_of} ---\n{t}"[: 2 * CONTENT_LIMIT]
            yield pd.DataFrame(out, columns=["t_entry", "t"])
        if entry is not None:
            yield pd.DataFrame([(entry, text)], columns=["t_entry", "t"])

    told = texts.repartition("entry").sortWithinPartitions("entry", "more", "place").select("entry", "more", "text").mapInPandas(fold, "t_entry long, t string")
    merged = heads.join(gathered, F.col("id") == F.col("g_entry"), "left").join(told, F.col("id") == F.col("t_entry"), "left")
    n = F.coalesce("merges", F.lit(0)).cast("long")
    sure = F.aggregate(F.sequence(F.lit(1).cast("long"), n), F.col("confidence").cast("double"), lambda acc, _: F.least(F.lit(1.0), acc + 0.05))
    has = F.col("g_entry").isNotNull()
    merged = merged.select(user, "type", "title", "slug", F.when(has, F.col("t")).when(F.col("new") == 1, cut).otherwise(F.col("content")).alias("content"), F.when(has, F.array_distinct(F.concat("refs", F.flatten(F.transform("more", lambda m: m["refs"]))))).otherwise(F.col("refs")).alias("refs"), F.when(has, sure).otherwise(F.col("confidence").cast("double")).alias("confidence"), F.when(F.col("new") == 1, "create").when(has, "update").otherwise("keep").alias("action"), n.alias("merges"), "new", "rank", F.col("seq").cast("long").alias("seq"))
    return _numbered(written(merged), user).select(*cols, "action", "merges")


_KINDS = ("doc_summary", "topic", "concept", "claim")


def _kind_rank(kind: Column) -> Column:
    out = F.lit(9)
    for k, name in enumerate(_KINDS):
        out = F.when(kind == name, k).otherwise(out)
    return out


def _numbered(merged: DataFrame, user: str) -> DataFrame:
    """Created entries get the first free one of slug, slug-2, slug-3 and so on; only stems with a collision are gone through."""
    stem = F.regexp_replace("slug", r"(-\d+)+$", "")
    marked = merged.withColumn("stem", stem)
    hit = marked.groupBy(user, "stem", "slug").agg(F.count("*").alias("n"), F.max("new").alias("made")).where("n > 1 AND made = 1").select(F.col(user).alias("h_user"), F.col("stem").alias("h_stem")).distinct()
    on = F.col(user).eqNullSafe(F.col("h_user")) & (F.col("stem") == F.col("h_stem"))
    calm = marked.join(hit, on, "left_anti").drop("stem")
    clash = marked.join(hit, on, "left_semi")
    narrow = clash.select(user, "stem", "slug", "new", "rank", "seq")

    def assign(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["new", "rank", "seq"], kind="stable").reset_index(drop=True)
        taken, out, following = set(part.loc[part["new"] == 0, "slug"]), [], {}
        for slug, new in zip(part["slug"], part["new"], strict=True):
            own, k = slug, following.get(slug, 2)
            while new and own in taken:
                own, k = f"{slug}-{k}", k + 1
            following[slug] = k
            taken.add(own)
            out.append(own)
        return part.assign(named=out)

    named = narrow.groupBy(user, "stem").applyInPandas(assign, narrow.schema.simpleString()[7:-1].replace(":", " ").replace(",", ", ") + ", named string").select(F.col(user).alias("n_user"), F.col("new").alias("n_new"), F.col("rank").alias("n_rank"), F.col("seq").alias("n_seq"), "named", F.col("slug").alias("n_slug"))
    same = F.col(user).eqNullSafe(F.col("n_user")) & (F.col("new") == F.col("n_new")) & (F.col("rank") == F.col("n_rank")) & (F.col("seq") == F.col("n_seq")) & (F.col("slug") == F.col("n_slug"))
    renamed = clash.join(named, same).withColumn("slug", F.col("named")).select(*calm.columns)
    return calm.unionByName(renamed)


def merge_statistics(merged: DataFrame, user: str = "user_id", fused: bool = False) -> DataFrame:
    """(user, created, updated, skipped, fusion_calls) of `merge_entries`."""
    updated = F.sum("merges")
    return merged.groupBy(user).agg(F.count_if(F.col("action") == "create").alias("created"), updated.alias("updated"), F.lit(0).cast("long").alias("skipped"), (updated if fused else F.lit(0).cast("long")).alias("fusion_calls"))


def sweep_documents(entries: DataFrame, documents: DataFrame, gone: DataFrame) -> DataFrame:
    """(id, action, refs): entries after documents (doc_id) are deleted; action is keep, update, delete or purge.

    A reference goes if its document is deleted now or does not exist; an entry without any left
    goes too, as a purge if none of its documents is deleted now. refs is array of struct.
    """
    each = entries.where("status = 'active'").select("id", F.posexplode_outer("refs").alias("at", "r"))
    id_of = lambda df, here: df.select(F.col("doc_id").cast("string").alias("d_id"), F.lit(here).alias("here"))
    state = id_of(documents, True).union(id_of(gone, False)).groupBy("d_id").agg(F.max("here").alias("here"), (~F.min("here")).alias("now"))  # one table of documents, one join
    marked = each.withColumn("doc", F.coalesce("r.documentId", F.lit(""))).join(state, F.col("doc") == F.col("d_id"), "left")
    now = F.coalesce("now", F.lit(False))
    dead = now | ((F.col("doc") != "") & ~F.coalesce("here", F.lit(False)))
    has = F.col("at").isNotNull()
    out = marked.groupBy("id").agg(F.count_if(has).alias("n"), F.count_if(has & ~dead).alias("left"), F.count_if(now).alias("now"), F.sort_array(F.collect_list(F.when(has & ~dead, F.struct("at", "r")))).alias("kept"))
    action = F.when((F.col("n") > 0) & (F.col("left") == 0), F.when(F.col("now") == 0, "purge").otherwise("delete")).when(F.col("left") < F.col("n"), "update").otherwise("keep")
    return out.select("id", action.alias("action"), F.transform("kept", lambda x: x["r"]).alias("refs"))


def wiki_stats(entries: DataFrame) -> DataFrame:
    """Counts by type, entries of several sources, and references, of active entries."""
    live = entries.where("status = 'active'")
    n = F.size("refs")
    return live.agg(F.count("*").alias("total"), *[F.count_if(F.col("type") == t).alias(a) for t, a in (("doc_summary", "doc_summary"), ("topic", "topics"), ("concept", "concepts"), ("claim", "claims"))], F.count_if(n >= 2).alias("multi_source"), F.coalesce(F.sum(n), F.lit(0)).cast("long").alias("source_refs"))


def list_entries(entries: DataFrame, kind: str | None = None, search: str | None = None, documents: list[str] | None = None, ids: DataFrame | None = None, page: int = 1, limit: int = 20) -> DataFrame:
    """A page of active entries; with ids (id, pos) only those, in that order, else the newest first."""
    out = entries.where("status = 'active'")
    if kind:
        out = out.where(F.col("type") == kind)
    if search:
        out = out.where(F.contains(F.lower("title"), F.lit(search.lower())) | F.contains(F.lower("content"), F.lit(search.lower())))
    if documents:
        out = out.where(F.exists("refs", lambda r: r["documentId"].isin(documents)))
    order = [F.desc("updated_at"), "id"]
    if ids is not None:
        out, order = out.join(ids, "id"), ["pos"]
    preview = F.coalesce(F.nullif("snippet", F.lit("")), F.substring("content", 1, 200)) if "snippet" in entries.columns else F.substring("content", 1, 200)
    return out.orderBy(*order).offset((page - 1) * limit).limit(limit).withColumn("preview", preview).withColumn("ref_count", F.size("refs"))


def cite(entries: DataFrame, citations: DataFrame) -> DataFrame:
    """Confidence up by 0.03 for each citation (id), to 1 at most."""
    n = citations.groupBy("id").agg(F.count("*").alias("_n"))
    return entries.join(n, "id", "left").withColumn("confidence", F.least(F.lit(1.0), F.col("confidence") + 0.03 * F.coalesce("_n", F.lit(0)))).drop("_n")


def with_links(entries: DataFrame, links: DataFrame) -> DataFrame:
    """Each entry with its outgoing links and backlinks."""
    out = links.groupBy(F.col("from_id").alias("id")).agg(F.sort_array(F.collect_list(F.struct("relation", "to_id"))).alias("outgoing"))
    back = links.groupBy(F.col("to_id").alias("id")).agg(F.sort_array(F.collect_list(F.struct("relation", "from_id"))).alias("backlinks"))
    return entries.join(out, "id", "left").join(back, "id", "left")


#: Rows that a task holds at once to tell which are equal.
ROWS = 1 << 20


def upsert_links(links: DataFrame, new: DataFrame) -> DataFrame:
    """Links with the new ones, each once, dealt by from_id into parts of some `ROWS`, however many there are."""
    every = written(links.unionByName(new))
    parts = max(links.sparkSession.sparkContext.defaultParallelism, -(-every.count() // ROWS))
    return every.repartition(parts, "from_id").dropDuplicates(["from_id", "to_id", "relation"])


def upsert_tags(tags: DataFrame, new: DataFrame) -> DataFrame:
    clean = new.select("doc_id", F.lower(F.trim("tag")).alias("tag")).where((F.length("tag") > 0) & (F.length("tag") <= 50))
    return tags.unionByName(clean).dropDuplicates(["doc_id", "tag"])


def index_markdown(entries: DataFrame) -> DataFrame:
    """(user_id, markdown): the index of a wiki, by type and title."""
    line = F.concat(F.lit("- ["), F.col("title"), F.lit("]("), F.col("slug"), F.lit(".md)"))
    groups = entries.where("status = 'active'").groupBy("user_id", "type").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("title", line.alias("line")))), lambda x: x["line"]), "\n").alias("lines"), F.count("*").alias("n"))
    part = F.concat(F.lit("## "), F.col("type"), F.lit(" ("), F.col("n").cast("string"), F.lit(")\n\n"), F.col("lines"))
    return groups.groupBy("user_id").agg(F.concat(F.lit("# Index\n\n"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("type", part.alias("part")))), lambda x: x["part"]), "\n\n")).alias("markdown"))


def log_markdown(changes: DataFrame, most: int = 200) -> DataFrame:
    nth = F.row_number().over(W.partitionBy("user_id").orderBy(F.desc("created_at"), F.desc("id")))
    line = F.concat(F.lit("- "), F.date_format("created_at", "yyyy-MM-dd HH:mm:ss"), F.lit(" **"), F.col("action"), F.lit("** "), F.col("summary"))
    last = changes.withColumn("_nth", nth).where(F.col("_nth") <= most).select("user_id", "_nth", line.alias("line"))
    return last.groupBy("user_id").agg(F.concat(F.lit("# Log\n\n"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("_nth", "line"))), lambda x: x["line"]), "\n")).alias("markdown"))


def draft_markdown(drafts: DataFrame, sections: DataFrame, depths: DataFrame, assets: DataFrame | None = None) -> DataFrame:
    """(draft_id, markdown): confirmed sections by index below the draft's title, headings by depth, asset markers as images."""
    kept = sections.where(F.col("status").isin("confirmed", "locked", "completed")).join(depths, "id", "left")
    if assets is not None:
        known = assets.groupBy("draft_id").agg(F.map_from_entries(F.collect_list(F.struct("asset_id", F.struct("title", "path")))).alias("assets"))
        kept = kept.join(known, "draft_id", "left")
        marker = r"\[(?:IMAGE|DIAGRAM):([A-Za-z0-9_-]+)\]"
        parts = F.split("content", rf"(?=\[(?:IMAGE|DIAGRAM):)|(?<=\[(?:IMAGE|DIAGRAM):[A-Za-z0-9_-]{{1,64}}\])", -1)

        def image(p: Column) -> Column:
            a = F.try_element_at("assets", F.regexp_extract(p, marker, 1))
            figure = F.concat(F.lit("!["), F.when(F.coalesce(a["title"], F.lit("")) == "", "Figure").otherwise(F.concat(F.lit("Figure: "), a["title"])), F.lit("]("), a["path"], F.lit(")"))
            lost = F.concat(F.lit("*"), F.coalesce(F.nullif(a["title"], F.lit("")), F.lit("Image")), F.lit(" unavailable*"))
            return F.when(p.rlike(f"^{marker}$") & a.isNotNull(), F.coalesce(figure, lost)).otherwise(p)

        kept = kept.withColumn("content", F.when(F.col("assets").isNotNull(), F.array_join(F.transform(parts, image), "")).otherwise(F.col("content")))
    level = F.least(F.lit(6), F.coalesce("depth", F.lit(0)) + 2)
    body = F.concat(F.repeat(F.lit("#"), level), F.lit(" "), F.col("title"), F.lit("\n\n"), F.coalesce("content", F.lit("")))
    joined = kept.groupBy("draft_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("idx", body.alias("b")))), lambda x: x["b"]), "\n\n").alias("body"))
    return drafts.join(joined, "draft_id").select("draft_id", F.concat(F.lit("# "), F.col("title"), F.lit("\n\n"), F.col("body")).alias("markdown"))


def budgeted(items: DataFrame, keys: list[str], order: str, text: str, total: int, each: int) -> DataFrame:
    """Items in order while their truncated texts fit into `total` characters; the one that does not fit is cut short and is the last."""
    cut = items.withColumn("_t", F.substring(text, 1, each))
    before = F.coalesce(F.sum(F.length("_t")).over(W.partitionBy(*keys).orderBy(order).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    left = cut.withColumn("_before", before).where(F.col("_before") < total)
    return left.withColumn(text, F.expr(f"substring(_t, 1, {total} - _before)")).drop("_t", "_before")
