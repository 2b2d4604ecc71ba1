"""Embedding near-dedup with a forest of random-projection trees.

Each tree splits the unit vectors near the median along one random direction for each level; a
vector close to a split goes down both sides (spill). Vectors that share a leaf of any tree are
compared in double precision, and pairs at or above the threshold are linked and united. With a
spill of half the standard deviation of a borderline pair's projections, one tree of depth d
misses such a pair with probability of about 0.02 d, four trees with that to the fourth power.
A cut stands where few vectors spill, so it passes beside a group of near copies; and of the
leaves that a vector spills into, each tree keeps the MOST reached by the fewest crossings.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessella.llm._base import checkpointed, components, small_batches, with_groups, written

THRESHOLD = 0.95
TREES = 4
LEAF = 1024
#: Vectors that the cuts are taken from. All vectors are indexed.
SAMPLE = 16_384
SPILL = 0.5
#: Leaves of one vector in each tree, whatever the depth: shuffled places are at most TREES * MOST times the vectors.
MOST = 4
#: Share of a node's vectors that a cut may send down both sides.
BOTH = 0.3
#: Vectors of a leaf that one task compares with as many others.
CHUNK = 2048
_LEAST = 16


@dataclass
class Tree:
    """Directions by level; thresholds of inner nodes by number (children of k are 2k and 2k + 1).

    Where the sample is spent, a node has no children of its own but thresholds for the levels
    below it, which all nodes below it share. The tree is as large as the sample, not as the table.
    """

    directions: np.ndarray
    nodes: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    cuts: np.ndarray = field(default_factory=lambda: np.zeros(0))
    ends: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    tails: np.ndarray = field(default_factory=lambda: np.zeros((0, 0)))


def fit_forest(sample: np.ndarray, rows: int, trees: int = TREES, leaf: int = LEAF, threshold: float = THRESHOLD, spill: float = SPILL, seed: int = 11, max_depth: int = 48) -> list[Tree]:
    """Trees over unit vectors, each split until a leaf holds about `leaf` of `rows` rows.

    A node splits by its sampled vectors where `_cut` says; one with fewer than 2 * _LEAST of
    them takes the cuts along all further directions at once. A direction along which every cut
    would take too many vectors down both sides is passed over: its level splits nothing there.
    """
    rng = np.random.default_rng(seed)
    dim = sample.shape[1]
    margin = _margin(dim, threshold, spill)
    forest = []
    for _ in range(trees):
        directions = rng.standard_normal((max_depth, dim))
        directions /= np.linalg.norm(directions, axis=1, keepdims=True)
        inner: dict[int, float] = {}
        tails: dict[int, list[float]] = {}
        todo = [(1, 0, np.arange(len(sample)), float(rows))] if len(sample) else []
        while todo:
            node, depth, pool, size = todo.pop()
            if len(pool) >= 2 * _LEAST and size > leaf and depth < max_depth:
                at = sample[pool] @ directions[depth]
                cut, both = _cut(at, margin)
                if both <= BOTH:
                    inner[node] = cut
                    for child, inside in ((2 * node, at <= cut + margin), (2 * node + 1, at > cut - margin)):
                        todo.append((child, depth + 1, pool[inside], size * inside.mean()))
                    continue
            tails[node] = _tail(sample[pool] @ directions.T, depth, size, leaf, margin)
        nodes, ends = np.array(sorted(inner), np.int64), np.array(sorted(tails), np.int64)
        width = max((len(t) for t in tails.values()), default=0)
        table = np.full((len(ends), width), np.nan)
        for k, node in enumerate(ends.tolist()):
            table[k, : len(tails[node])] = tails[node]
        forest.append(Tree(directions, nodes, np.array([inner[n] for n in nodes.tolist()]), ends, table))
    return forest


def _tail(at: np.ndarray, depth: int, size: float, leaf: int, margin: float) -> list[float]:
    """Thresholds of the levels below a node, until about `leaf` rows are left; infinity where a level splits nothing."""
    out = []
    for level in range(depth, at.shape[1]):
        if size <= leaf:
            break
        cut, both = _cut(at[:, level], margin)
        out.append(cut if both <= BOTH else np.inf)
        size *= (1 + both) / 2 if both <= BOTH else 1
    while out and out[-1] == np.inf:
        out.pop()
    return out


def _cut(at: np.ndarray, margin: float) -> tuple[float, float]:
    """Of cuts with a quarter of the values or more on each side, the one that sends the fewest down both for what it tells apart; and their share."""
    x = np.sort(at)
    ends = np.arange(max(1, len(x) // 4), max(2, len(x) - len(x) // 4 + 1))
    ends = ends[ends < len(x)]
    if not len(ends):
        return 0.0, 1.0
    cuts = (x[ends - 1] + x[ends]) / 2
    both = (np.searchsorted(x, cuts + margin, "right") - np.searchsorted(x, cuts - margin, "left")) / len(x)
    p = ends / len(x)
    cost = np.log1p(both) / -(p * np.log(p) + (1 - p) * np.log(1 - p))
    best = int(np.argmin(cost + 1e-9 * np.abs(p - 0.5)))
    return float(cuts[best]), float(both[best])


def _margin(dim: int, threshold: float, spill: float) -> float:
    return spill * float(np.sqrt(max(0.0, 2 - 2 * threshold) / dim))


def _find(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where wanted stands in sorted keys, and whether it does."""
    if not len(keys):
        return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return at, keys[at] == wanted


def _fewest(who: np.ndarray, cost: np.ndarray, most: int) -> np.ndarray:
    """Places of the `most` rows of least cost of each vector."""
    order = np.lexsort((cost, who))
    first = np.searchsorted(who[order], who[order], "left")
    return order[np.arange(len(who)) - first < most]


def leaves_of(vectors: np.ndarray, forest: list[Tree], threshold: float = THRESHOLD, spill: float = SPILL, most: int = MOST) -> list[np.ndarray]:
    """Sorted leaf numbers of each vector over all trees, at most `most` in each: those reached by the fewest and nearest crossings of a cut."""
    margin = _margin(vectors.shape[1], threshold, spill)
    found_v, found_l = [], []
    for t, tree in enumerate(forest):
        along = vectors @ tree.directions.T
        who, node, cost = np.arange(len(vectors)), np.ones(len(vectors), np.int64), np.zeros(len(vectors))
        row, depth = np.full(len(vectors), -1), 0  # row of the tails, once below a node where the sample was spent
        start = np.zeros(len(vectors), np.int64)
        left_at: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        while len(who):
            at, inner = _find(tree.nodes, node)
            cut = np.where(inner & (row < 0), tree.cuts[at] if len(tree.cuts) else 0.0, np.nan)
            new = (row < 0) & ~inner
            spent, known = _find(tree.ends, node)
            row, start = np.where(new & known, spent, row), np.where(new & known, depth, start)
            below = row >= 0
            if tree.tails.shape[1]:
                level = np.minimum(depth - start, tree.tails.shape[1] - 1)
                cut = np.where(below & (depth - start < tree.tails.shape[1]), tree.tails[np.maximum(row, 0), level], cut)
            done = np.isnan(cut)
            left_at.append((who[done], node[done], cost[done]))
            who, node, row, start, cut, cost = who[~done], node[~done], row[~done], start[~done], cut[~done], cost[~done]
            if not len(who):
                break
            a = along[who, depth]
            left, right = a <= cut + margin, a > cut - margin  # an infinite cut sends all to the left
            pick = np.concatenate([np.flatnonzero(left), np.flatnonzero(right)])
            node = np.concatenate([2 * node[left], 2 * node[right] + 1])
            crossed = np.concatenate([a[left] > cut[left], a[right] <= cut[right]])
            cost = cost[pick] + np.where(crossed, 1 + np.abs(np.where(crossed, a[pick] - cut[pick], 0.0)) / (margin or 1.0), 0.0)
            who, row, start, depth = who[pick], row[pick], start[pick], depth + 1
            kept = _fewest(who, cost, most)
            who, node, row, start, cost = who[kept], node[kept], row[kept], start[kept], cost[kept]
        v, leaf, cost = (np.concatenate(x) for x in zip(*left_at, strict=True))
        kept = _fewest(v, cost, most)
        found_v.append(v[kept])
        found_l.append(leaf[kept] * len(forest) + t)
    v, leaf = np.concatenate(found_v), np.concatenate(found_l)
    order = np.lexsort((leaf, v))
    return np.split(leaf[order], np.cumsum(np.bincount(v, minlength=len(vectors)))[:-1])


def compare(ids: np.ndarray, side: np.ndarray, vectors: np.ndarray, copies: np.ndarray, leaves: list[np.ndarray], leaf: int, threshold: float) -> tuple[list, dict]:
    """Within one leaf, links of the first chunk (side 0) to itself or, if there is one, to the second (side 1).

    Returns (spanning links, links of each id weighed by the partner's copies). A pair that
    shares several leaves counts in the smallest of them only.
    """
    widest = max(map(len, leaves))
    table = np.full((len(leaves), widest), -1, np.int64)
    for k, x in enumerate(leaves):
        table[k, : len(x)] = x
    a, b = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
    within = not len(b)
    b = a if within else b
    root = np.arange(len(ids))

    def top(k: int) -> int:
        while root[k] != k:
            root[k] = root[root[k]]
            k = root[k]
        return k

    spans = []

    def unite(left: np.ndarray, right: np.ndarray) -> None:
        for p, q in zip(left.tolist(), right.tolist(), strict=True):
            x, y = top(p), top(q)
            if x != y:
                root[max(x, y)] = min(x, y)
                spans.append((int(ids[p]), int(ids[q])))

    total = np.zeros(len(ids), np.int64)
    for lo in range(0, len(a), 512):
        part = a[lo : lo + 512]
        x, y = np.nonzero(vectors[part] @ vectors[b].T >= threshold)
        i, j = part[x], b[y]
        if within:
            i, j = i[i < j], j[i < j]
        first = np.ones(len(i), bool)
        for s in range(0, len(i), 65536):
            ti, tj = table[i[s : s + 65536]], table[j[s : s + 65536]]
            both = (ti[:, :, None] == tj[:, None, :]).any(axis=2) & (ti >= 0)
            first[s : s + 65536] = np.where(both, ti, np.iinfo(np.int64).max).min(axis=1) == leaf
        i, j = i[first], j[first]
        np.add.at(total, i, copies[j])
        np.add.at(total, j, copies[i])
        # First one link of each vector, then those that are left between different classes: in a group of copies, hardly any.
        some = np.union1d(np.unique(i, return_index=True)[1], np.unique(j, return_index=True)[1])
        unite(i[some], j[some])
        at = np.array([top(k) for k in range(len(ids))])
        apart = at[i] != at[j]
        unite(i[apart], j[apart])
    counts = {int(ids[k]): int(total[k]) for k in np.flatnonzero(total)}
    return spans, counts


def near_duplicates(rows: DataFrame, threshold: float = THRESHOLD, trees: int = TREES, leaf: int = LEAF, sample_rows: int = SAMPLE, chunk: int = CHUNK, spill: float = SPILL, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """One row per input row: id, n_links, component_id, kept.

    1. Equal vectors are grouped first (a partial aggregate): one representative is indexed, its
       copies count as links of each other and of whatever it links. Rows and representatives
       meet again by two 64-bit hashes of the vector, so that no vector is shuffled for that.
    2. The trees are fitted on at most sample_rows representatives, those of least hash, and
       every representative is sent to its leaves with its vector (in single precision if it
       came so) and the list of its leaves.
    3. A leaf of over `chunk` vectors is dealt out to tasks by pairs of chunks, so that neither a
       hot leaf nor its pairs are gathered in one task, and nothing is left out.
    4. Tasks give links counted by vector and spanning links only, never all pairs of a group.

    Null, empty and zero vectors and vectors with null or non-finite components link with
    nothing; vectors of different lengths never link. Rows with a null id link with nothing and
    have a null component. Rows repeated with one id count as further vectors. An empty table
    gives no rows; other columns are ignored.
    """
    spark = rows.sparkSession
    small_batches(spark)
    v = F.col("v")
    single = isinstance(rows.schema[vector_col].dataType, T.ArrayType) and isinstance(rows.schema[vector_col].dataType.elementType, T.FloatType)
    kind = "<f4" if single else "<f8"
    base = rows.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<float>" if single else "array<double>").alias("v"))
    sound = F.col("id").isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    marks = lambda n: F.when(F.coalesce(sound, F.lit(False)), F.xxhash64(F.lit(n), v))  # noqa: E731  # null keys join with nothing
    keyed = base.withColumns({"h1": marks(1), "h2": marks(2)})
    grouped = keyed.where("h1 IS NOT NULL").groupBy("h1", "h2").agg(F.min("id").alias("least"), F.count("*").alias("copies"), F.first("v").alias("v"))
    reps = written(grouped.withColumn("rep", F.monotonically_increasing_id()))
    sizes = {r["d"]: r["n"] for r in reps.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n")).limit(16).collect()}
    sampled = reps.orderBy("h1", "h2").limit(sample_rows).select("v").collect()
    forests = {}
    for dim, n in sizes.items():
        mine = np.array([r["v"] for r in sampled if len(r["v"]) == dim], dtype=float).reshape(-1, dim)
        forests[dim] = fit_forest(_units(mine), n, trees, leaf, threshold, spill)
    sent = spark.sparkContext.broadcast(forests)  # directions by level; nodes and tails over at least _LEAST sampled vectors each

    def index(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            length = batch["v"].map(len)
            for dim, part in batch.groupby(length):
                forest = sent.value.get(dim) or [Tree(np.zeros((1, dim)))]
                vectors = _units(np.array(part["v"].tolist(), dtype=float))
                found = leaves_of(vectors, forest, threshold, spill)
                n = [len(x) for x in found]
                yield pd.DataFrame({
                    "rep": np.repeat(part["rep"].to_numpy(), n), "copies": np.repeat(part["copies"].to_numpy(), n), "dim": dim, "leaf": np.concatenate(found),
                    "leaves": np.repeat(np.array([x.astype("<i8").tobytes() for x in found], dtype=object), n), "v": np.repeat(np.array([np.asarray(x, kind).tobytes() for x in part["v"]], dtype=object), n),
                })

    placed = reps.select("rep", "copies", "v").mapInPandas(index, "rep long, copies long, dim int, leaf long, leaves binary, v binary")
    heads = checkpointed(placed.groupBy("dim", "leaf").agg(F.count("*").alias("n")).where("n > 1").withColumn("chunks", F.ceil(F.col("n") / chunk).cast("int")).select(F.col("dim").alias("h_dim"), F.col("leaf").alias("h_leaf"), "chunks"))
    dealt = placed.join(heads, (F.col("dim") == F.col("h_dim")) & (F.col("leaf") == F.col("h_leaf"))).withColumn("own", F.pmod(F.xxhash64("rep"), F.col("chunks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).withColumn("lo", F.least("own", "other")).withColumn("hi", F.greatest("own", "other"))

    def link(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        _, at, lo, hi = key
        vectors = _units(np.frombuffer(b"".join(part["v"]), kind).reshape(len(part), -1).astype(float))
        side = (part["own"].to_numpy() != lo).astype(int)
        if lo != hi and not (side.any() and (side == 0).any()):
            return pd.DataFrame({"a": [], "b": [], "n": []})
        leaves = [np.frombuffer(x, "<i8") for x in part["leaves"]]
        spans, counts = compare(part["rep"].to_numpy(), side, vectors, part["copies"].to_numpy(), leaves, int(at), threshold)
        return pd.DataFrame({"a": [p for p, _ in spans] + list(counts), "b": [q for _, q in spans] + [-1] * len(counts), "n": [0] * len(spans) + list(counts.values())})

    found = checkpointed(dealt.groupBy("dim", "leaf", "lo", "hi").applyInPandas(link, "a long, b long, n long"))
    links = found.where("b < 0").groupBy(F.col("a").alias("l_rep")).agg(F.sum("n").alias("links"))
    classes = components(found.where("b >= 0")).select(F.col("node").alias("c_rep"), F.col("component").alias("class"))
    known = reps.select("rep", "h1", "h2", "least", "copies").join(links, F.col("rep") == F.col("l_rep"), "left").join(classes, F.col("rep") == F.col("c_rep"), "left")
    known = written(known.select("h1", "h2", "least", "copies", F.coalesce("class", "rep").alias("class"), F.coalesce("links", F.lit(0)).alias("links")))
    names = written(known.groupBy(F.col("class").alias("name")).agg(F.min("least").alias("component"), F.count("*").alias("size")))
    final = with_groups(known, names, {"class": "name"}, "size", known.count())
    final = written(final.select(F.col("h1").alias("k1"), F.col("h2").alias("k2"), "copies", (F.col("links") + F.col("copies") - 1).alias("n_links"), "component"))
    # Of hot groups of equal vectors, the one row with its result is broadcast.
    ids = keyed.select("id", "h1", "h2")
    out = with_groups(ids, final, {"h1": "k1", "h2": "k2"}, "copies", known.agg(F.sum("copies")).first()[0] or 0, "left")
    own = F.coalesce("component", "id")
    return out.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), own.alias("component_id"), F.coalesce(F.col("id") == own, F.lit(False)).alias("kept"))


def _units(x: np.ndarray) -> np.ndarray:
    """Scaled by the largest component first, so that no finite vector over- or underflows."""
    if not len(x):
        return x
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)
