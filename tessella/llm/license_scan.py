"""License scans: exact phrases, and an exact set-similarity join of text blocks with notice templates."""

from __future__ import annotations

import re
from collections import defaultdict

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.llm._base import ascii_lower, checkpointed, text_or_empty

# Word characters, the base phrases with their labels, and the notice templates.
_IN = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"
_OUT = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"
PHRASES = (("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit"))
TEMPLATES = (
    ("gpl", "this work is licensed under the gnu general public license version 3"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("lgpl", "licensed under the gnu lesser general public license"),
    ("apache", "licensed under the apache license version 2 0"),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-sa", "licensed under cc by sa 4 0"),
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license"),
    ("all-rights-reserved", "all rights reserved"),
)
#: What tells a license from others of nearly the same words: words that stand consecutively, and words that never follow them.
DISTINCT = {
    "gpl": ("gnu", ("lesser", "library", "affero", "free")),
    "lgpl": ("gnu lesser", ()),
    "apache": ("apache", ()),
    "cc-by": ("attribution", ("noncommercial", "non", "sharealike", "share", "noderivatives", "noderivs", "no")),
    "cc-by-nc": ("by nc", ("sa", "nd")),
    "cc-by-sa": ("by sa", ()),
    "mit": ("mit", ()),
    "mpl": ("mozilla", ()),
}
THRESHOLD = 0.8
BLOCK = 64


def _alternation(words: list[str]) -> str:
    """A pattern for any of the words as a whole word; words are grouped by first letter so that a mismatch is found early."""
    by = defaultdict(list)
    for w in sorted(words):
        by[w[0]].append(re.escape(w[1:]))
    return rf"(?<!{_IN})(?i:" + "|".join(f"{a}(?:{'|'.join(sorted(rest, key=lambda r: -len(r)))})" for a, rest in by.items()) + rf")(?!{_IN})"


def _need(n: int, threshold: float) -> int:
    """The smallest overlap that holds threshold of n tokens."""
    k = int(n * threshold)
    while k < n and k < n * threshold - 1e-9:
        k += 1
    return max(k, 1)


def scan_licenses(docs: DataFrame, templates: tuple = TEMPLATES, phrases: tuple = PHRASES, threshold: float = THRESHOLD, block: int = BLOCK, id_col: str = "doc_id", text_col: str = "text", across_lines: bool = False, distinct: dict | None = None) -> DataFrame:
    """One row per input row: id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    Base: every place where a phrase's words stand consecutively. The method's labels come from
    a set-similarity join: a text block is a line, or, of a longer line, each window of `block`
    words at every half window; a template matches a block that holds at least `threshold` of
    its distinct words. With across_lines, the windows of the whole text, whose words run on over
    line ends, are blocks besides the lines. Templates of over block / 2 words, of any length, meet
    windows of a size of their own, the least doubling of block that is twice as long, so that any
    stretch of a line, or with across_lines of the text, as long as a template lies whole in some
    block.

    With distinct, a template that holds its label's distinguishing words matches only if the
    block holds them too and they stand consecutively in the text, not followed by a word that
    makes them another license; so licenses that differ by one word are not taken for each other.

    The join is exact. Template words are ordered by document frequency over all of docs, rarest
    first. A block can only match a template if it holds one of the template's first
    n - need + 1 words (prefix filter), `need` words of any template at all (length filter), and
    if enough words of both are left behind the shared one in that order (positional filter);
    what is left is verified on the sets. Texts without any prefix word are never cut to blocks.
    The template index is the only thing broadcast; it is as large as `templates`.

    score is the largest share of a template found, 1 where a base phrase stands. Null or empty
    text: no words, no places, empty labels, score 0. Null ids and repeated rows are scanned as
    they are, an empty table gives no rows, other columns are ignored.
    """
    sets = [(label, sorted(set(text.split()))) for label, text in templates]
    window = [next(block << k for k in range(32) if len(text.split()) <= (block << k) // 2) for _, text in templates]
    vocabulary = sorted({w for _, words in sets for w in words})
    base = docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text"))

    # Corpus statistics: in how many documents each template word stands.
    seen = base.select(F.explode(F.array_distinct(F.transform(F.regexp_extract_all("text", F.lit("(" + _alternation(vocabulary) + ")"), F.lit(1)), ascii_lower))).alias("w"))
    frequency = {r["w"]: r["n"] for r in seen.groupBy("w").agg(F.count("*").alias("n")).collect()}  # one row for each template word at most
    order = {w: i for i, w in enumerate(sorted(vocabulary, key=lambda w: (frequency.get(w, 0), w)))}
    index, prefix_words, least = [], set(), {}
    for t, (label, words) in enumerate(sets):
        ranked, need = sorted(words, key=order.get), _need(len(words), threshold)
        least[window[t]] = min(need, least.get(window[t], need))
        for at, w in enumerate(ranked[: len(words) - need + 1]):
            index.append((w, at, t, label, len(words), need, ranked, window[t]))
            prefix_words.add(w)

    gate = _alternation(sorted(prefix_words | {p.split()[0] for p, _ in phrases}))
    counted = base.withColumn("n_words", F.regexp_count("text", F.lit(_IN + "+")).cast("long"))
    # Words are cut out and lower-cased only in texts that hold a prefix word or a phrase's first word.
    scanned = counted.withColumn("lines", F.when(F.col("text").rlike(gate), F.split("text", F.lit("\n"), -1)))
    words_of = lambda line: F.transform(F.regexp_extract_all(line, F.lit("(" + _IN + "+)"), F.lit(1)), ascii_lower)
    scanned = scanned.withColumn("words", F.transform("lines", words_of)).withColumn("flat", F.flatten("words"))
    at = lambda i, j: F.get(F.col("flat"), i + j)

    def stands(parts: list[str]):
        return lambda s: _all([s["w"] == parts[0], *[at(s["i"], j) == p for j, p in enumerate(parts) if j]])

    starts = F.transform(F.col("flat"), lambda w, i: F.struct(w.alias("w"), i.alias("i")))
    columns, found = {}, []
    for k, (phrase, label) in enumerate(phrases):
        columns[f"p{k}"] = F.transform(F.filter(starts, stands(phrase.split())), lambda s: s["i"].cast("long"))
        found.append((f"p{k}", label))
    places = F.concat(*[F.col(c) for c, _ in found])
    named = F.array_sort(F.array_distinct(F.filter(F.array(*[F.when(F.size(c) > 0, F.lit(label)) for c, label in found]), lambda x: x.isNotNull())))
    lone = scanned.withColumns(columns).withColumn("base", F.when(F.col("flat").isNotNull(), places)).withColumn("base_set", F.when(F.col("flat").isNotNull(), named))

    # Blocks: lines, and half-overlapping windows of longer ones, as sets of template words in global order.
    ranks = F.create_map(*[x for w, i in order.items() for x in (F.lit(w), F.lit(i))])
    to_set = lambda ws: F.array_sort(F.array_distinct(F.filter(F.transform(ws, lambda w: ranks[w]), lambda r: r.isNotNull())))

    def cut(size: int):
        half = size // 2
        return lambda ws: F.when(F.size(ws) <= size, F.array(ws)).otherwise(F.transform(F.sequence(F.lit(0), F.ceil((F.size(ws) - size) / half).cast("int")), lambda i: F.slice(ws, i * half + 1, F.lit(size))))

    def block_sets(size: int, fewest: int) -> Column:
        """Sets of one size of block, with that size and the fewest words that any of its templates needs."""
        lines, whole = F.flatten(F.transform("words", cut(size))), cut(size)(F.col("flat"))
        blocks = lines if not across_lines else whole if size > block else F.when(F.size("lines") > 1, F.concat(lines, whole)).otherwise(lines)
        found = F.array_distinct(F.filter(F.transform(blocks, to_set), lambda s: F.size(s) >= fewest))
        return F.transform(found, lambda s: F.struct(F.lit(size).alias("block"), F.lit(fewest).alias("least"), s.alias("words")))

    sets_of = F.concat(*[block_sets(size, fewest) for size, fewest in sorted(least.items())])
    keys = {label: words for label, (words, _) in (distinct or {}).items()}
    tells = lambda words, never: lambda s: _all([stands(words.split())(s), F.coalesce(~at(s["i"], len(words.split())).isin(*never), F.lit(True)) if never else F.lit(True)])
    told = F.filter(F.array(*[F.when(F.exists(starts, tells(*d)), F.lit(label)) for label, d in distinct.items()]), lambda x: x.isNotNull()) if distinct else F.array().cast("array<string>")
    return _joined(lone.withColumn("sets", sets_of).withColumn("told", F.when(F.size("sets") > 0, told)), index, order, id_col, keys)


def _all(conditions: list[Column]) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out & c
    return out


def _joined(lone: DataFrame, index: list, order: dict, id_col: str, keys: dict[str, str]) -> DataFrame:
    spark = lone.sparkSession
    schema = "w int, t_at int, t int, label string, t_n int, need int, t_set array<int>, key array<int>, block int"
    key = lambda label, ranked: [order[x] for x in keys[label].split()] if label in keys and set(keys[label].split()) <= set(ranked) else None
    small = spark.createDataFrame([(order[w], at, t, label, n, need, [order[x] for x in ranked], key(label, ranked), size) for w, at, t, label, n, need, ranked, size in index], schema)
    kept = checkpointed(lone.select("id", "n_words", "base", "base_set", "sets", "told").withColumn("row", F.monotonically_increasing_id()))
    blocks = kept.where(F.size("sets") > 0).select("row", "told", F.explode("sets").alias("s")).select("row", "told", "s.block", "s.least", F.col("s.words").alias("b_set"))
    heads = blocks.select("row", "told", "block", "b_set", F.posexplode(F.slice("b_set", F.lit(1), F.size("b_set") - F.col("least") + 1)).alias("b_at", "w"))
    pairs = heads.join(F.broadcast(small), ["w", "block"])  # one row for each prefix word of the templates
    pairs = pairs.where((F.size("b_set") >= F.col("need")) & (1 + F.least(F.size("b_set") - F.col("b_at") - 1, F.col("t_n") - F.col("t_at") - 1) + F.least("b_at", "t_at") >= F.col("need")))
    pairs = pairs.where(F.col("key").isNull() | (F.array_contains("told", F.col("label")) & (F.size(F.array_except("key", "b_set")) == 0)))
    share = F.size(F.array_intersect("b_set", "t_set"))
    hits = pairs.withColumn("overlap", share).where("overlap >= need").groupBy("row").agg(F.collect_set("label").alias("more"), F.max(F.col("overlap") / F.col("t_n")).alias("share"))
    out = kept.join(hits, "row", "left")
    none = F.array().cast("array<string>")
    own, more = F.coalesce("base_set", none), F.coalesce("more", none)
    return out.select(
        F.col("id").alias(id_col),
        "n_words",
        F.when(F.col("base").isNull(), 0).otherwise(F.size("base")).cast("long").alias("n_base"),
        F.array_min("base").alias("first_word"),
        F.array_max("base").alias("last_word"),
        F.array_join(own, ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union(own, more)), ",").alias("labels"),
        F.when(F.size(own) > 0, 1.0).otherwise(F.coalesce("share", F.lit(0.0))).alias("score"),
    )
