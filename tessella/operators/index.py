"""A stored full-text index: positional postings by document group, refreshed group by group, and snippets from it."""

from __future__ import annotations

from bisect import bisect_left

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessella.functions import text as tx
from tessella.operators import fulltext

WIDTH = 40


class StoredIndex:
    """Three Parquet tables under one folder, all partitioned by document group (part).

    postings: term, id, tf, length, positions - sorted by term within a group, so that a search reads
    the row groups of its terms only, and no text. documents: id, length. statistics: documents and
    tokens of each group, so that a search needs no pass over the documents.

    A document's group is the hash of its id modulo `parts`; a group is meant to be what one task can
    rewrite. A refresh reads and overwrites the groups of the changed documents and leaves the others
    alone. Positions count the tokens of the last column, the one that snippets are cut from.
    """

    def __init__(self, spark: SparkSession, path: str, parts: int = 64, id_col: str = "doc_id", columns: tuple[str, ...] = ("text",)):
        self.spark, self.path, self.parts, self.id_col, self.columns = spark, path, parts, id_col, columns

    def part_of(self, key: Column) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(self.parts)).cast("int")

    def _tokens(self, docs: DataFrame) -> DataFrame:
        """(part, id, w, at): tokens of all columns; `at` is where the last column begins."""
        every = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in self.columns]
        split = [tx.tokens(c) for c in every]
        before = F.size(F.concat(*split[:-1])) if len(split) > 1 else F.lit(0)
        rows = docs.select(F.col(self.id_col).alias("id"), F.concat(*split).alias("w"), before.alias("at"))
        return rows.withColumn("part", self.part_of(F.col("id")))

    def _tables(self, docs: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Postings and documents. A document's postings are made within its row: its tokens are sorted, each run is a term."""
        dealt = self._tokens(docs)
        size = F.size("w").alias("length")
        documents = dealt.select("part", "id", size)
        places = F.array_sort(F.transform("w", lambda t, i: F.struct(t.alias("t"), i.alias("i"))))
        one = dealt.select("part", "id", size, "at", places.alias("p"))
        starts = F.filter(F.sequence(F.lit(0), F.col("length") - 1), lambda k: (k == 0) | (F.get("p", k)["t"] != F.get("p", k - 1)["t"]))
        one = one.select("*", F.when(F.col("length") > 0, starts).alias("s"))  # no filter: it would tokenise again
        ends = lambda k: F.coalesce(F.get("s", k + 1), F.col("length"))
        own = F.transform("s", lambda a, k: F.struct(F.get("p", a)["t"].alias("term"), F.slice("p", a + 1, ends(k) - a).alias("own")))
        each = one.select("part", "id", "length", "at", F.explode(own).alias("o"))
        place = F.filter(F.transform("o.own", lambda x: x["i"] - F.col("at")), lambda x: x >= 0)
        return each.select("part", F.col("o.term").alias("term"), "id", F.size("o.own").cast("long").alias("tf"), "length", place.alias("positions")), documents

    def _write(self, name: str, rows: DataFrame, touched: DataFrame) -> None:
        """Overwrite the touched groups (part); one without rows is left with a row of nulls, which readers pass over."""
        keys = [F.lit(None).cast(f.dataType).alias(f.name) for f in rows.schema.fields if f.name != "part"]
        rows = rows.unionByName(touched.select("part", *keys))
        order = ["part", "term"] if "term" in rows.columns else ["part"]
        dealt = rows.repartition(self.parts, "part").sortWithinPartitions(*order)
        dealt.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("part").parquet(f"{self.path}/{name}")

    def _summed(self, documents: DataFrame) -> DataFrame:
        return documents.groupBy("part").agg(F.count("*").alias("documents"), F.sum("length").alias("tokens"))

    def build(self, docs: DataFrame) -> StoredIndex:
        postings, _ = self._tables(docs)
        every = self.spark.range(self.parts).select(F.col("id").cast("int").alias("part"))
        self._write("postings", postings, every)
        # Lengths come from the written postings, so that texts are tokenised once; a document without tokens has none there.
        lengths = self.postings().groupBy("part", "id").agg(F.max("length").alias("length"))
        ids = docs.select(F.col(self.id_col).alias("id")).withColumn("part", self.part_of(F.col("id")))
        self._write("documents", ids.join(lengths, ["part", "id"], "left").select("part", "id", F.coalesce("length", F.lit(0)).alias("length")), every)
        self._write("statistics", self._summed(self.documents()), every)
        return self

    def _read(self, name: str, must: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{name}").where(F.col(must).isNotNull())

    def postings(self) -> DataFrame:
        return self._read("postings", "term")

    def documents(self) -> DataFrame:
        return self._read("documents", "id")

    def statistics(self) -> DataFrame:
        return self._read("statistics", "documents")

    def refresh(self, changed: DataFrame | None = None, deleted: DataFrame | None = None) -> None:
        """Replace the changed documents and take out the deleted ones (a column of ids); documents that were not there are added."""
        ids = [df.select(F.col(self.id_col).alias("id")) for df in (changed, deleted) if df is not None]
        if not ids:
            return
        gone = ids[0].unionByName(ids[1]) if len(ids) > 1 else ids[0]
        gone = gone.distinct()
        parts = [r["part"] for r in gone.select(self.part_of(F.col("id")).alias("part")).distinct().collect()]  # at most `parts`
        if not parts:
            return
        touched = self.spark.createDataFrame([(p,) for p in parts], "part int")
        old_p, old_d = (t.where(F.col("part").isin(parts)).join(gone, "id", "left_anti") for t in (self.postings(), self.documents()))
        if changed is not None:
            new_p, new_d = self._tables(changed.dropDuplicates([self.id_col]))
            old_p, old_d = old_p.unionByName(new_p), old_d.unionByName(new_d)
        self._write("postings", old_p, touched)
        self._write("documents", old_d, touched)
        self._write("statistics", self._summed(self.documents().where(F.col("part").isin(parts))), touched)

    def rank(self, query: str) -> DataFrame:
        """(id, length, rank) of all documents that match; the postings of the query's terms and the statistics are all that is read."""
        groups = fulltext.query_groups(query)
        terms = list(dict.fromkeys(t for g in groups for t in g))
        mine = self.postings().where(F.col("term").isin(terms)).select("term", "id", "tf", "length")
        totals = self.statistics().agg(F.sum("documents").alias("n"), (F.sum("tokens") / F.sum("documents")).alias("avgdl"))
        many = mine.groupBy("term").agg(F.count("*").alias("df"))
        known = F.broadcast(many.crossJoin(totals))  # a row for each term of the query
        idf = F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
        k1, b = fulltext.K1, fulltext.B
        part = F.when(idf > 0, idf).otherwise(1e-6) * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("length") / F.col("avgdl")))
        got = mine.join(known, "term").select("id", "length", "term", part.alias("part"))
        # A hit is one row with the part of each term, so that groups are told apart without a further shuffle.
        wide = got.groupBy("id").agg(F.max("length").alias("length"), *[F.max(F.when(F.col("term") == t, F.col("part"))).alias(f"p{k}") for k, t in enumerate(terms)])
        total, hit = F.lit(0.0), F.lit(False)
        for g in groups:
            cols = [F.col(f"p{terms.index(t)}") for t in g]
            every = F.lit(True)
            for c in cols:
                every = every & c.isNotNull()
            total, hit = total + F.when(every, sum(cols[1:], cols[0])).otherwise(0.0), hit | every
        return wide.where(hit).select(F.col("id").alias(self.id_col), "length", (-total).alias("rank"))

    def search(self, query: str, limit: int = 20, offset: int = 0) -> DataFrame:
        """A page of hits (id, rank, score), as `fulltext.keyword_search` gives it."""
        return fulltext.page(self.rank(query), limit, offset, self.id_col)

    def snippets(self, hits: DataFrame, texts: DataFrame, query: str, width: int = WIDTH, opened: str = "<mark>", closed: str = "</mark>", dots: str = "...") -> DataFrame:
        """The hits (a page of them, with the id) with a snippet of the last column: the best window of `width` tokens, hits marked.

        Windows start at a hit (then centred) or at the sentence that holds it. A window counts 1000
        for each term of a matched group that it holds and 1 for each further place, a sentence's start
        100 more (120 at the very start); the first best one is taken. texts: id, last column.
        """
        groups = fulltext.query_groups(query)
        terms = list(dict.fromkeys(t for g in groups for t in g))
        page = hits.select(F.col(self.id_col).alias("id"))
        places = self.postings().where(F.col("term").isin(terms)).join(page, "id", "left_semi").groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("term", "positions"))).alias("places"))
        seen = texts.select(F.col(self.id_col).alias("id"), F.coalesce(F.col(self.columns[-1]).cast("string"), F.lit("")).alias("body")).join(page, "id", "left_semi")
        seen = seen.join(places, "id", "left")
        own = [F.coalesce(F.try_element_at("places", F.lit(t)), F.array().cast("array<int>")) for t in terms]
        known = [F.col("places").isNotNull() & F.map_contains_key(F.coalesce("places", F.create_map().cast("map<string,array<int>>")), F.lit(t)) for t in terms]
        phrases = []
        for g in groups:  # only the terms of groups that match as a whole
            every = F.lit(True)
            for t in g:
                every = every & known[terms.index(t)]
            phrases += [F.when(every, own[terms.index(t)]).otherwise(F.array().cast("array<int>")) for t in g]
        gaps, words = F.split("body", tx.TOKEN, -1), tx.all_matches(F.col("body"), tx.TOKEN)
        cut = seen.select("id", gaps.alias("gaps"), words.alias("words"), F.array(*phrases).alias("phrases") if phrases else F.array().cast("array<array<int>>").alias("phrases"))
        heads = F.filter(F.sequence(F.lit(0), F.greatest(F.size("words") - 1, F.lit(0))), lambda i: (i == 0) | F.rlike(F.get("gaps", i), F.lit(r"[.:][ \t\n\r]+$")))
        cut = cut.withColumn("start", _best_start(F.col("phrases"), heads, F.size("words"), F.lit(width)))
        marked = F.array_distinct(F.flatten("phrases"))
        last = F.col("start") + width - 1
        span = F.sequence(F.col("start"), F.least(last, F.size("words") - 1))
        piece = F.transform(span, lambda i: F.concat(F.when(F.array_contains(marked, i), F.concat(F.lit(opened), F.get("words", i), F.lit(closed))).otherwise(F.get("words", i)), F.when(i < F.least(last, F.size("words") - 1), F.get("gaps", i + 1)).otherwise("")))
        front = F.when(F.col("start") > 0, F.lit(dots)).otherwise(F.get("gaps", F.lit(0)))
        back = F.when(last >= F.size("words") - 1, F.get("gaps", F.size("words"))).otherwise(F.lit(dots))
        done = F.when(F.size("words") == 0, F.element_at("gaps", 1)).otherwise(F.concat(front, F.array_join(piece, ""), back))
        return hits.join(cut.select(F.col("id").alias(self.id_col), done.alias("snippet")), self.id_col, "left")


def best_start(phrases: list[list[int]], heads: list[int], size: int, width: int) -> int:
    """The first token of the best window over the places of each phrase (a token each)."""
    places = sorted((p, k) for k, own in enumerate(phrases) for p in own)
    at = [p for p, _ in places]

    def score(start: int) -> tuple[int, int]:
        a, b = bisect_left(at, start), bisect_left(at, start + width)
        inside = places[a:b]
        if not inside:
            return 0, 0
        distinct = len({k for _, k in inside})
        first, end = inside[0][0], inside[-1][0] + 1
        centred = first - int((width - (end - first)) / 2)
        return 999 * distinct + len(inside), max(0, min(centred, size - width))

    best, found = 0, 0
    for p in at:
        s, start = score(p)
        if s > best:
            best, found = s, start
        if heads and size > width:
            head = heads[max(0, bisect_left(heads, p + 1) - 1)]
            if head < p:
                s = score(head)[0] + (120 if head == 0 else 100)
                if s > best:
                    best, found = s, head
    return found


@F.pandas_udf(T.IntegerType())
def _best_start(phrases: pd.Series, heads: pd.Series, size: pd.Series, width: pd.Series) -> pd.Series:
    plain = lambda x: [int(v) for v in x]
    return pd.Series([best_start([plain(p) for p in ps], plain(h), int(n), int(w)) for ps, h, n, w in zip(phrases, heads, size, width, strict=True)], dtype="int32")
