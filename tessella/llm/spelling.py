"""Spelling variant grouping by anagram hashing.

A word's anagram key is the sum of its letters' fifth powers, so it doesn't depend on their order.
Two words that differ by one inserted or deleted letter have keys that differ by that letter's
power; two that differ by one replaced letter have equal keys once the power of the differing
letter is taken from each. So each word gives, for each of its positions, its key less that
letter's power (a removal value): removal values meet whole keys (insertion, deletion) and each
other (exchange). Letter order is verified by a second key of what is left, a polynomial in the
position, that meets in the same equality. No string travels more than once for a word, however
long it is: a word of L letters gives L rows of integers.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessella.llm._base import ascii_lower, text_or_empty, written

#: A form occurs at least so many times as often as its variant.
RATIO = 10
MIN_LENGTH = 7
MIN_COUNT = 2
#: The contract's query damages runs whose hash this divides.
DAMAGED = 31
_BASE = np.uint64(0x9E3779B97F4A7C15)  # odd, so that it has an inverse modulo 2^64
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_LETTERS = 500_000
_OUT = 200_000


def runs_of_letters(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_length: int = MIN_LENGTH, damaged: int = DAMAGED) -> DataFrame:
    """One row (word) for each maximal run of Latin letters of at least min_length code points, A-Z lower-cased.

    Runs whose crc32 over "<id>:<run>" is divisible by `damaged` lose the letter at hash modulo
    length; those that are then shorter than min_length are left out. Null texts give nothing, a
    null id counts as empty.
    """
    run = F.col("run")
    runs = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("doc"), F.explode(F.regexp_extract_all(text_or_empty(text_col), F.lit(rf"[A-Za-zÀ-ÿ]{{{min_length},}}"), F.lit(0))).alias("run"))
    runs = runs.select("doc", ascii_lower(run).alias("run")).withColumn("h", F.crc32(F.concat("doc", F.lit(":"), "run")))
    at = (F.col("h") % F.length(run)).cast("int")
    less = F.concat(F.substring(run, F.lit(1), at), F.substring(run, at + 2, F.length(run)))
    return runs.select(F.when(F.col("h") % damaged == 0, less).otherwise(run).alias("word")).where(F.length("word") >= min_length)


def word_counts(words: DataFrame, min_count: int = MIN_COUNT, word_col: str = "word") -> DataFrame:
    """(word, n) of the words that occur at least min_count times; summed up before they are shuffled."""
    return words.groupBy(F.col(word_col).alias("word")).agg(F.count("*").alias("n")).where(F.col("n") >= min_count)


def _letters(words: pd.Series) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Code points of all words, the word of each, its place, and sums of both keys before each (one more than letters)."""
    points = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    size = words.map(len).to_numpy()
    first = np.cumsum(size) - size
    word = np.repeat(np.arange(len(words)), size)
    place = np.arange(len(points)) - first[word]
    with np.errstate(over="ignore"):
        power = points**np.uint64(5)  # modulo 2^64; exact sums for Latin letters
        scale = np.full(int(size.max(initial=0)) + 1, _BASE, np.uint64)
        scale[0] = 1
        scale = np.cumprod(scale)
        mixed = (points * np.uint64(0xD6E8FEB86659FD93)) ^ (points * points * np.uint64(0xA0761D6478BD642F))
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(power)])
        order = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mixed * scale[place])])
    return points, word, place, sums, order


def keys(words: pd.Series) -> tuple[np.ndarray, np.ndarray]:
    """(anagram key, order key) of whole words."""
    size = words.map(len).to_numpy()
    *_, sums, order = _letters(words)
    end = np.cumsum(size)
    return sums[end] - sums[end - size], order[end] - order[end - size]


def removals(words: pd.Series) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For each letter of each word: (word, place, anagram key and order key of the rest, whether the next letter differs)."""
    size = words.map(len).to_numpy()
    points, word, place, sums, order = _letters(words)
    begin, end = (np.cumsum(size) - size)[word], np.cumsum(size)[word]
    at = np.arange(len(points))
    with np.errstate(over="ignore"):
        rest = (sums[end] - sums[begin]) - (sums[at + 1] - sums[at])
        # What follows moves up by one place, so its share is divided by the base.
        turned = (order[at] - order[begin]) + (order[end] - order[at + 1]) * _INVERSE
    last = np.ones(len(points), bool)
    last[:-1] = (points[1:] != points[:-1]) | (word[1:] != word[:-1])
    return word, place, rest, turned, last


def _signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def _pieces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Runs of a batch's rows with about _LETTERS letters each, one word at least, so that long words don't add up."""
    for b in batches:
        part = np.cumsum(b["word"].map(len).to_numpy()) // _LETTERS
        for at in np.split(np.arange(len(b)), np.flatnonzero(np.diff(part)) + 1):
            if len(at):
                yield b.iloc[at].reset_index(drop=True)


def _whole(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in _pieces(batches):
        a, o = keys(b["word"])
        yield pd.DataFrame({"k_wid": b["wid"], "k_n": b["n"], "k_rest": _signed(a), "k_turned": _signed(o)})


def _removed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in _pieces(batches):
        word, place, rest, turned, last = removals(b["word"])
        wid, n = b["wid"].to_numpy(), b["n"].to_numpy()
        for s in range(0, len(word), _OUT):
            w = word[s : s + _OUT]
            yield pd.DataFrame({"wid": wid[w], "n": n[w], "place": place[s : s + _OUT], "rest": _signed(rest[s : s + _OUT]), "turned": _signed(turned[s : s + _OUT]), "last": last[s : s + _OUT]})


def variants(counts: DataFrame, ratio: int = RATIO) -> DataFrame:
    """One row per row of counts (word, n; words are distinct): word, form, root, n, n_near, form_n.

    Two words are near if they differ by exactly one inserted, deleted or replaced code point.
    The form is the near word of largest n (ties: smallest in code-point order) if its n is at
    least ratio times the word's; the root follows forms to the last. Rows with a null word or n
    are left out; an empty table gives no rows; other columns are ignored.

    1. Words are numbered in code-point order, so that ties are decided by numbers.
    2. Exchange: words that leave the same rest at the same place stand in one window. They differ
       in one letter there, so a window holds no more rows than the alphabet has letters.
    3. Insertion, deletion: removal values meet whole keys. Of a run of equal letters only the last
       one is removed, so each pair is met once.
    4. n grows by the ratio with each step to a form, so that chains are short: as many rounds of
       pointer doubling as the largest n asks for.
    """
    clean = counts.select(F.col("word").cast("string").alias("word"), F.col("n").cast("long").alias("n")).where("word IS NOT NULL AND n IS NOT NULL")
    words = written(clean.orderBy("word").withColumn("wid", F.monotonically_increasing_id()))
    letters = words.where("word <> ''")
    removed = letters.mapInPandas(_removed, "wid long, n long, place long, rest long, turned long, last boolean")
    whole = words.mapInPandas(_whole, "k_wid long, k_n long, k_rest long, k_turned long")
    better = lambda n, w: F.struct((-F.col(n)).alias("m"), F.col(w).alias("w"))

    same = Window.partitionBy("rest", "turned", "place")
    ranked = same.orderBy(F.desc("n"), "wid")
    met = removed.withColumns({"many": F.count("*").over(same), "rank": F.row_number().over(ranked), "first": F.first(better("n", "wid")).over(ranked), "next": F.lead(better("n", "wid")).over(ranked)})
    exchanged = met.where("many > 1").select("wid", (F.col("many") - 1).alias("near"), F.when(F.col("rank") == 1, F.col("next")).otherwise(F.col("first")).alias("best"))

    pairs = removed.where("last").join(whole, (F.col("rest") == F.col("k_rest")) & (F.col("turned") == F.col("k_turned")))
    both = F.explode(F.array(F.struct(F.col("wid"), better("k_n", "k_wid").alias("best")), F.struct(F.col("k_wid").alias("wid"), better("n", "wid").alias("best")))).alias("x")
    inserted = pairs.select(both).select("x.wid", F.lit(1).cast("long").alias("near"), "x.best")

    near = exchanged.union(inserted).groupBy("wid").agg(F.sum("near").alias("n_near"), F.min("best").alias("best")).withColumnRenamed("wid", "near_wid")
    known = words.join(near, F.col("wid") == F.col("near_wid"), "left")
    best_n = -F.col("best.m")
    has_form = F.coalesce(best_n >= ratio * F.col("n"), F.lit(False))
    known = written(known.select("wid", "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(has_form, F.col("best.w")).alias("form_wid"), F.when(has_form, best_n).alias("form_n")))

    most = known.agg(F.max("n")).first()[0] or 1
    steps = max(1, math.floor(math.log(max(most, 2), max(ratio, 2))) + 1)
    roots = known.where("form_wid IS NOT NULL").select("wid", F.col("form_wid").alias("to"))
    for _ in range(math.ceil(math.log2(steps)) if steps > 1 else 0):
        roots = written(roots)
        on = roots.select(F.col("wid").alias("on"), F.col("to").alias("onward"))
        roots = roots.join(on, F.col("to") == F.col("on"), "left").select("wid", F.coalesce("onward", "to").alias("to"))
    ends = roots.select(F.col("wid").alias("r_wid"), F.col("to").alias("root_wid"))
    name = lambda a, b: words.select(F.col("wid").alias(a), F.col("word").alias(b))
    out = known.where("form_wid IS NOT NULL").join(ends, F.col("wid") == F.col("r_wid")).join(name("f", "form"), F.col("form_wid") == F.col("f")).join(name("r", "root"), F.col("root_wid") == F.col("r"))
    alone = known.where("form_wid IS NULL").select("word", F.lit(None).cast("string").alias("form"), F.col("word").alias("root"), "n", "n_near", "form_n")
    return out.select("word", "form", "root", "n", "n_near", "form_n").union(alone)


def spelling_variants(docs: DataFrame, ratio: int = RATIO, min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT, damaged: int = DAMAGED) -> DataFrame:
    """`variants` of all words of the documents' whole texts, as `runs_of_letters` and `word_counts` take them."""
    return variants(word_counts(runs_of_letters(docs, min_length=min_length, damaged=damaged), min_count), ratio)
