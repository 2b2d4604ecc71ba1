"""Keyword search: BM25 over all columns, groups of query tokens, page scores.

A query has few tokens, so a search needs no inverted index: one narrow scan counts the query's
tokens in each row and the corpus totals are one aggregate. `postings` builds the index for
those who search often; `search_postings` reads only the terms asked for.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tessella.functions import text as tx

K1, B = 1.2, 0.75
_CJK = "぀-ヿ一-鿿"
_PY_TOKEN = re.compile(rf"[{_CJK}]|(?:(?![{_CJK}])\w)+")


def query_groups(query: str) -> list[list[str]]:
    """Up to three distinct tokens are alternatives; more are runs of three that must stand in a row together."""
    tokens = list(dict.fromkeys(_PY_TOKEN.findall(query.lower())))
    return [[t] for t in tokens] if len(tokens) <= 3 else [tokens[i : i + 3] for i in range(len(tokens) - 2)]


def _scored(counted: DataFrame, groups: list[list[str]], terms: list[str], stats: DataFrame) -> Column:
    def part(t: int) -> Column:
        f, df, n = F.col(f"f{t}"), F.col(f"df{t}"), F.col("corpus_n")
        idf = F.log((n - df + 0.5) / (df + 0.5))
        idf = F.when(idf > 0, idf).otherwise(F.lit(1e-6))
        return idf * f * (K1 + 1) / (f + K1 * (1 - B + B * F.col("length") / F.col("avgdl")))

    total = F.lit(0.0)
    for g in groups:
        at = [terms.index(t) for t in g]
        hit = F.lit(True)
        for t in at:
            hit = hit & (F.col(f"f{t}") > 0)
        total = total + F.when(hit, sum((part(t) for t in at[1:]), part(at[0]))).otherwise(0.0)
    return -total


def bm25_rank(docs: DataFrame, query: str, id_col: str, columns: list[str]) -> DataFrame:
    """(id, length, rank) of all rows that match a group; rank is lower for better rows. All columns weigh the same."""
    groups = query_groups(query)
    terms = list(dict.fromkeys(t for g in groups for t in g))
    if not terms:
        return docs.select(F.col(id_col), F.lit(0).alias("length"), F.lit(0.0).alias("rank")).limit(0)
    low = F.lower(F.concat_ws(" ", *[F.coalesce(F.col(c), F.lit("")) for c in columns]))
    seen = docs.select(F.col(id_col), low.alias("t"))
    # Totals are one pass that counts tokens; the second one counts in texts that hold a term at all.
    stats = seen.agg(F.count("*").alias("corpus_n"), F.avg(F.regexp_count("t", F.lit(tx.TOKEN))).alias("avgdl"), *[F.count_if(_stands("t", t)).alias(f"df{k}") for k, t in enumerate(terms)])
    some = F.lit(False)
    for t in terms:
        some = some | F.contains("t", F.lit(t))
    counted = seen.where(some).select(id_col, F.regexp_count("t", F.lit(tx.TOKEN)).alias("length"), *[F.when(F.contains("t", F.lit(t)), F.regexp_count("t", F.lit(_whole(t)))).otherwise(0).alias(f"f{k}") for k, t in enumerate(terms)])
    joined = counted.crossJoin(F.broadcast(stats))  # one row of totals
    ranked = joined.select(id_col, "length", _scored(counted, groups, terms, stats).alias("rank"), *[F.col(f"f{k}") for k in range(len(terms))])
    any_group = F.lit(False)
    for g in groups:
        hit = F.lit(True)
        for t in g:
            hit = hit & (F.col(f"f{terms.index(t)}") > 0)
        any_group = any_group | hit
    return ranked.where(any_group).select(id_col, "length", "rank")


def _whole(term: str) -> str:
    """A pattern for the term as a whole token; one that is no token stands nowhere."""
    if re.fullmatch(f"[{_CJK}]", term):
        return term
    return rf"(?<!{tx.WORD_CHAR})(?=(?:{tx.TOKEN})){term}(?!{tx.WORD_CHAR})"


def _stands(text: str, term: str) -> Column:
    return F.contains(text, F.lit(term)) & F.rlike(F.col(text), F.lit(_whole(term)))


def keyword_search(docs: DataFrame, query: str, limit: int = 20, offset: int = 0, id_col: str = "doc_id", columns: list[str] | None = None) -> DataFrame:
    """A page of hits (id, rank, score): score is 1 for the best hit of the page, falling to 0 for its last, in two places."""
    return page(bm25_rank(docs, query, id_col, columns or ["text"]), limit, offset, id_col)


def page(ranked: DataFrame, limit: int, offset: int, id_col: str) -> DataFrame:
    page = ranked.orderBy("rank", id_col).offset(offset).limit(limit)
    every = W.partitionBy(F.lit(0))  # the rows of one page
    low, high = F.min("rank").over(every), F.max("rank").over(every)
    score = 1 - (F.col("rank") - low) / F.when(high == low, 1.0).otherwise(high - low)
    return page.select(id_col, "rank", tx.round_half_up(tx.clamp(score), 2).alias("score"))


def postings(docs: DataFrame, id_col: str = "doc_id", columns: list[str] | None = None) -> DataFrame:
    """(term, id, tf, length); write it partitioned or bucketed by term. Refreshing a document replaces its rows.

    A document is one row; its sorted tokens have a run for each term, so that nothing is shuffled.
    """
    words = tx.tokens(F.concat_ws(" ", *[F.coalesce(F.col(c), F.lit("")) for c in columns or ["text"]]))
    rows = docs.select(id_col, F.array_sort(words).alias("w")).select(id_col, "w", F.size("w").alias("length"))
    starts = F.filter(F.sequence(F.lit(0), F.col("length") - 1), lambda k: (k == 0) | (F.get("w", k) != F.get("w", k - 1)))
    rows = rows.select("*", F.when(F.col("length") > 0, starts).alias("s"))  # no filter: it would tokenise again
    runs = F.transform("s", lambda a, k: F.struct(F.get("w", a).alias("term"), (F.coalesce(F.get("s", k + 1), F.col("length")) - a).cast("long").alias("tf")))
    return rows.select(id_col, "length", F.explode(runs).alias("r")).select("r.term", id_col, "length", "r.tf")


def search_postings(index: DataFrame, documents: int, average_length: float, query: str, id_col: str = "doc_id") -> DataFrame:
    """(id, rank) over an index; only rows of the query's terms are read."""
    groups = query_groups(query)
    terms = list(dict.fromkeys(t for g in groups for t in g))
    mine = index.where(F.col("term").isin(terms))
    df = mine.groupBy("term").agg(F.count("*").alias("df"))
    idf = F.log((documents - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = F.when(idf > 0, idf).otherwise(1e-6) * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("length") / average_length))
    spread = index.sparkSession.createDataFrame([(k, t, len(g)) for k, g in enumerate(groups) for t in g], "g int, term string, need int")
    scored = mine.join(df, "term").select("term", id_col, part.alias("part")).join(F.broadcast(spread), "term")  # the query's groups
    hit = scored.groupBy(id_col, "g", "need").agg(F.sum("part").alias("part"), F.count("*").alias("n")).where("n = need")
    return hit.groupBy(id_col).agg((-F.sum("part")).alias("rank"))


def refresh_postings(index: DataFrame, changed: DataFrame, id_col: str = "doc_id", columns: list[str] | None = None) -> DataFrame:
    kept = index.join(changed.select(id_col).distinct(), id_col, "left_anti")
    return kept.unionByName(postings(changed, id_col, columns))


def wiki_search(entries: DataFrame, query: str, limit: int, id_col: str = "id") -> DataFrame:
    """Active entries by BM25 over title and content, best first; the rank is not normalised."""
    return bm25_rank(entries.where("status = 'active'"), query, id_col, ["title", "content"]).orderBy("rank", id_col).limit(limit).select(id_col, "rank")


def wiki_section_query(entries: DataFrame, query: str, limit: int = 5, rewritten: list[str] | None = None, bonus: str = "reference", id_col: str = "id") -> DataFrame:
    """Entries for a section: (id, raw, score), best first.

    Candidates are keyword hits, and titles that are like the query where those are few. A term
    counts 3 in the title and 1 in the content, twice that if only the rewritten query has it;
    raw scores under 2 are dropped. The hit bonus shrinks as a hit gets better ("reference");
    "monotone" grows with it.
    """
    found = list(dict.fromkeys(_PY_TOKEN.findall(query)))
    base = list({t.lower(): t for t in reversed([t for t in found if len(t) >= 2])}.values())[::-1][:20]
    extra = [t for t in rewritten or [] if t.strip() and t.strip().lower() not in {b.lower() for b in base}]
    terms = [*base, *extra][:30]
    active = entries.where("status = 'active'")
    hits = wiki_search(entries, query, limit * 4, id_col)
    title_hit = F.lit(False)
    for t in terms:
        title_hit = title_hit | F.contains(F.lower("title"), F.lit(t.lower()))
    few = hits.agg((F.count("*") < limit * 2).alias("few"))
    like = active.where(title_hit).join(hits, id_col, "left_anti").where(tx.jaccard(tx.title_tokens(F.lit(query)), tx.title_tokens(F.col("title"))) >= 0.34).orderBy(id_col).limit(limit * 8)
    like = like.crossJoin(F.broadcast(few)).where("few").select(id_col, F.lit(None).cast("double").alias("rank"))  # one row
    both = active.join(hits.unionByName(like), id_col)
    raw = F.lit(0)
    for t in terms:
        w = 2 if t in extra else 1
        raw = raw + F.when(F.contains(F.lower("title"), F.lit(t.lower())), 3 * w).otherwise(0) + F.when(F.contains(F.lower("content"), F.lit(t.lower())), w).otherwise(0)
    closeness = 1 / (1 + F.abs("rank"))
    more = F.when(F.col("rank") < 0, 0.5 * (closeness if bonus == "reference" else 1 - closeness)).otherwise(0.0)
    out = both.select(id_col, raw.alias("raw"), (raw * (0.5 + F.col("confidence") * 0.5) + more).alias("score"))
    return out.where("raw >= 2 AND score > 0").orderBy(F.desc("score"), id_col).limit(limit)
