"""Hard-negative mining with a vantage-point tree over norm-augmented vectors.

With R^2 the largest squared norm, a row x becomes (x, sqrt(R^2 - |x|^2)) and an anchor q becomes
(q, 0). Their squared distance is R^2 + |q|^2 - 2 x.q, so that a high inner product is a short
distance, the rows in order of score are the rows in order of distance, and a window of scores is
an annulus around the anchor. A vantage-point tree cuts the rows by their distance to a chosen row
at the median; by the triangle inequality every node holds rows of a known range of distances
from an anchor only. Nodes are visited nearest first, those inside or outside of the annulus are
passed over, and the search ends once the next node is farther than the k-th row found.

The tree has two parts. The upper one is fitted on a bounded sample and deals all rows to cells;
the lower one is built over the rows of one piece of a cell where they are searched.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessella.llm._base import written

K = 5
#: Rows of a cell that are searched together; a larger cell is dealt out to several tasks.
PIECE = 4096
#: Rows of the smallest node of the lower tree.
LEAF = 128
#: Rows that the upper tree is fitted on: those of least hash. All rows are indexed.
SAMPLE = 16_384
#: Anchors that one task searches together.
BLOCK = 128
_FAR = 1 << 62


@dataclass
class VantageTree:
    """Node k has a vantage point, a radius and two children (inside, outside); a negative child c is leaf -c - 1."""

    points: np.ndarray
    radius: np.ndarray
    children: np.ndarray
    leaves: int


def fit_tree(points: np.ndarray, leaf: float, seed: int = 5) -> tuple[VantageTree, np.ndarray]:
    """Tree over augmented points, split until a node holds at most `leaf` of them; and the leaf of each point.

    The vantage point is the one of a few random rows from which distances vary most. Rows that
    all stand equally far from it are not split.
    """
    rng = np.random.default_rng(seed)
    vantage, radius, children = [], [], []
    where = np.zeros(len(points), np.int64)
    leaves = 0
    todo = [(np.arange(len(points)), -1, 0)]
    while todo:
        pool, parent, side = todo.pop()
        node = -leaves - 1
        if len(pool) > max(leaf, 1):
            tried = pool[rng.integers(0, len(pool), 5)]
            seen = pool if len(pool) <= 512 else pool[rng.integers(0, len(pool), 512)]
            spread = _apart(points[tried], points[seen]).std(axis=1)
            best = points[tried[int(np.argmax(spread))]]
            far = _apart(best[None], points[pool])[0]
            cut = float(np.median(far))
            if not (far > cut).any():  # the median is the largest: cut below it
                less = far[far < cut]
                cut = float(less.max()) if len(less) else cut
            inside = far <= cut
            if not inside.all():
                node = len(radius)
                vantage.append(best)
                radius.append(cut)
                children.append([0, 0])
                todo += [(pool[inside], node, 0), (pool[~inside], node, 1)]
        if parent >= 0:
            children[parent][side] = node
        if node < 0:
            where[pool] = leaves
            leaves += 1
    width = points.shape[1]
    return VantageTree(np.array(vantage).reshape(-1, width), np.array(radius), np.array(children, np.int64).reshape(-1, 2), leaves), where


def _apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distances of augmented points: all have the same norm."""
    return np.sqrt(np.maximum((a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1)[None] - 2 * (a @ b.T), 0))


def route(tree: VantageTree, points: np.ndarray) -> np.ndarray:
    """The leaf of each augmented point."""
    where = np.zeros(len(points), np.int64)
    todo = [(0, np.arange(len(points)))] if len(tree.radius) else []
    while todo:
        node, pool = todo.pop()
        inside = _apart(tree.points[node][None], points[pool])[0] <= tree.radius[node]
        for child, part in zip(tree.children[node], (pool[inside], pool[~inside]), strict=True):
            if child < 0:
                where[part] = -child - 1
            elif len(part):
                todo.append((int(child), part))
    return where


def ranges(tree: VantageTree, anchors: np.ndarray, reach: float) -> tuple[np.ndarray, np.ndarray]:
    """Least and largest distance of any row of each leaf from each anchor (anchors in rows), a little wider than they are."""
    low, high = np.zeros((len(anchors), tree.leaves)), np.full((len(anchors), tree.leaves), np.inf)
    if not len(tree.radius):
        return low, high
    augmented = np.hstack([anchors, np.zeros((len(anchors), 1))])
    far = _apart(augmented, tree.points)
    slack = 1e-6 * (reach + np.sqrt((anchors * anchors).sum(axis=1)))[:, None]
    todo = [(0, np.zeros(len(anchors)), np.full(len(anchors), np.inf))]
    while todo:
        node, lo, hi = todo.pop()
        d, r = far[:, node], tree.radius[node]
        for child, a, b in ((tree.children[node, 0], np.maximum(lo, d - r), np.minimum(hi, d + r)), (tree.children[node, 1], np.maximum(lo, r - d), hi)):
            if child < 0:
                low[:, -child - 1], high[:, -child - 1] = a, b
            else:
                todo.append((int(child), a, b))
    return low - slack, high + slack


def augment(x: np.ndarray, square: float) -> np.ndarray:
    return np.hstack([x, np.sqrt(np.maximum(square - (x * x).sum(axis=1), 0))[:, None]])


class Piece:
    """Rows that are searched together, in a vantage-point tree of their own."""

    def __init__(self, key: np.ndarray, ids: np.ndarray, label: np.ndarray, x: np.ndarray, square: float, exact: bool, leaf: int = LEAF):
        self.square, self.exact = square, exact
        self.tree, where = fit_tree(augment(x.astype(float), square), leaf)
        order = np.lexsort((ids, where))
        self.key, self.ids, self.label, self.x = key[order], ids[order], label[order], x[order]
        self.start = np.searchsorted(where[order], np.arange(self.tree.leaves + 1))

    def search(self, key: np.ndarray, label: np.ndarray, q: np.ndarray, owner: np.ndarray, low: np.ndarray, high: np.ndarray, same: bool, k: int = K) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For probes (anchor `owner`, scores low to high): (probe, score, id) of the first k rows by score, ties by id.

        Leaves are taken nearest first; a probe ends when its next leaf is farther than its k-th row.
        """
        near, far = ranges(self.tree, q.astype(float), float(np.sqrt(self.square)))
        base = self.square + (q.astype(float) ** 2).sum(axis=1)
        limit = lambda s: np.sqrt(np.maximum(base[owner] - 2.0 * s, 0))
        nearest = np.argsort(near, axis=1, kind="stable")
        best_s, best_i = np.full((len(owner), k), -_FAR, np.int64), np.full((len(owner), k), np.iinfo(np.int64).max)
        filled = np.zeros(len(owner), np.int64)
        inner, live = limit(high), np.flatnonzero(low <= high)
        for turn in range(self.tree.leaves):
            floor = np.where(filled >= k, np.maximum(low, best_s[:, k - 1]), low)
            outer = limit(floor)
            leaf = nearest[owner[live], turn]
            keep = near[owner[live], leaf] <= outer[live]
            live, leaf = live[keep], leaf[keep]
            if not len(live):
                break
            hit = far[owner[live], leaf] >= inner[live]
            probes, at = live[hit], leaf[hit]
            for one in np.unique(at):
                a, b = self.start[one], self.start[one + 1]
                p = probes[at == one]
                mine, back = np.unique(owner[p], return_inverse=True)
                s = self.scores(q[mine], a, b)[back]
                alike = self.label[a:b][None] == label[owner[p]][:, None]
                fits = (alike == same) & (self.key[a:b][None] != key[owner[p]][:, None]) & (s >= floor[p][:, None]) & (s <= high[p][:, None])
                any_fit = fits.any(axis=1)
                if not any_fit.any():
                    continue
                p, s, fits = p[any_fit], s[any_fit], fits[any_fit]
                s = np.where(fits, s, -_FAR)
                top = np.argsort(-s, axis=1, kind="stable")[:, :k]  # rows of a leaf stand by id
                new_s = np.take_along_axis(s, top, axis=1)
                new_i = np.where(new_s > -_FAR, self.ids[a:b][top], np.iinfo(np.int64).max)
                all_s, all_i = np.hstack([best_s[p], new_s]), np.hstack([best_i[p], new_i])
                pick = np.lexsort((all_i, -all_s), axis=1)[:, :k]
                best_s[p], best_i[p] = np.take_along_axis(all_s, pick, axis=1), np.take_along_axis(all_i, pick, axis=1)
                filled[p] = (best_s[p] > -_FAR).sum(axis=1)
        row, col = np.nonzero(best_s > -_FAR)
        return row, best_s[row, col], best_i[row, col]

    def scores(self, q: np.ndarray, a: int, b: int) -> np.ndarray:
        if self.exact:  # whole numbers below 2^53 stay exact in double precision
            return (q.astype(float) @ self.x[a:b].astype(float).T).astype(np.int64)
        return q.astype(np.int64) @ self.x[a:b].astype(np.int64).T


def _vectors(part: pd.Series, kind: str, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(part), kind).reshape(len(part), dim)


def mine_negatives(rows: DataFrame, every: int = 100, k: int = K, scale: float = 256.0, low_percent: int = 80, high_percent: int = 100, piece: int = PIECE, leaf: int = LEAF, sample_rows: int = SAMPLE, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """One row per negative: anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    A component x counts as floor(scale * x), a row's score is its integer inner product with the
    anchor, higher scores come first and ties by smaller id. Anchors are rows whose id `every`
    divides, an anchor's positives its first k other rows of the same label, a positive's negatives
    the first k rows of other labels with low_percent * positive_score <= 100 * score <= high_percent *
    positive_score (none for a negative positive_score).

    1. All rows are dealt to cells by the upper tree and written, with row keys of their own. A
       cell of more than `piece` rows is dealt out by hash, so that no task holds a hot cell.
    2. A search visits each anchor's own cell first; the k-th score found there bounds the cells
       that can hold more, and only those are visited then. Pieces stay whole in a task while
       anchors stream past in blocks; each visit yields at most k rows a window.
    3. Positives are searched with an open window, negatives with one window for each positive.

    The result is exact. How many cells a search visits depends on the data: on vectors without
    clusters nearly all of them.

    Rows with a null id, label or vector or with a null or non-finite component take no part.
    Vectors meet those of the same length only; an empty vector scores 0. Rows repeated with one
    id are rows of their own (each is an anchor, and a positive or negative of others). An
    inner product has to fit a long, else a ValueError is raised. An empty table gives no rows;
    other columns are ignored.
    """
    spark = rows.sparkSession
    v = F.col("v")
    base = rows.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).alias("label"), F.col(vector_col).cast("array<double>").alias("v")).where("id IS NOT NULL AND label IS NOT NULL AND v IS NOT NULL")
    base = base.where(F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))
    label = F.col("label").cast("long") if dict(rows.dtypes)[label_col] in ("tinyint", "smallint", "int", "bigint") else F.xxhash64("label")
    base = base.select("id", label.alias("label"), F.transform(v, lambda x: F.floor(x * scale).cast("long")).alias("v"))
    square = F.aggregate(F.transform(v, lambda x: x.cast("double") * x), F.lit(0.0), lambda a, x: a + x)
    most = base.agg(F.count("*").alias("n"), F.max(square).alias("square"), F.max(F.array_max(F.transform(v, F.abs))).alias("part")).first()
    n, square, part = most["n"], float(most["square"] or 0), int(most["part"] or 0)
    if square >= float(1 << 62):
        raise ValueError("inner products don't fit a long")
    exact = square < float(1 << 52)
    kind = "<i2" if part < 1 << 15 else "<i4" if part < 1 << 31 else "<i8"

    sampled = base.orderBy(F.xxhash64("v"), "id").limit(sample_rows).select("v").collect()
    trees = {}
    for dim in {len(r["v"]) for r in sampled}:
        mine = [r["v"] for r in sampled if len(r["v"]) == dim]
        mine = np.array(mine, float).reshape(len(mine), dim)
        trees[dim] = fit_tree(augment(mine, square), max(1.0, piece * len(sampled) / max(n, 1) / 2))[0]
    sent = spark.sparkContext.broadcast(trees)  # at most as many vantage points as the sample has rows
    lone = VantageTree(np.zeros((0, 1)), np.zeros(0), np.zeros((0, 2), np.int64), 1)

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for dim, some in batch.groupby(batch["v"].map(len)):
                x = np.array(some["v"].tolist(), np.int64).reshape(len(some), dim)
                cell = route(sent.value.get(dim, lone), augment(x.astype(float), square))
                yield pd.DataFrame({"key": some["key"], "id": some["id"], "label": some["label"], "dim": dim, "cell": cell, "v": [r.tobytes() for r in x.astype(kind)]})

    placed = base.withColumn("key", F.monotonically_increasing_id()).mapInPandas(deal, "key long, id long, label long, dim int, cell long, v binary")
    placed = written(placed)
    cells = placed.groupBy(F.col("dim").alias("c_dim"), F.col("cell").alias("c_cell")).agg(F.count("*").alias("n")).select("c_dim", "c_cell", F.ceil(F.col("n") / piece).cast("int").alias("pieces"))
    cells = written(cells)
    in_cell = lambda d: (d["dim"] == cells["c_dim"]) & (d["cell"] == cells["c_cell"])
    cells = F.broadcast(cells)  # no more rows than the sample has, and one for each length of vectors beyond it
    stored = placed.join(cells, in_cell(placed)).withColumn("piece", F.pmod(F.xxhash64("key"), F.col("pieces")).cast("int"))

    def visits(first: bool):
        """Rows of the cells that an anchor has to see: its own, or all others within reach."""

        def go(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                if first:
                    yield batch
                    continue
                for dim, some in batch.groupby("dim"):
                    tree = sent.value.get(dim, lone)
                    for lo in range(0, len(some), BLOCK):
                        b = some.iloc[lo : lo + BLOCK]
                        q = _vectors(b["v"], kind, dim).astype(float)
                        near, far = ranges(tree, q, float(np.sqrt(square)))
                        of = square + (q * q).sum(axis=1)
                        least = np.array([min(x) if len(x) else _FAR for x in b["low"]], float)
                        most = np.array([max(x) if len(x) else -_FAR for x in b["high"]], float)
                        outer, inner = np.sqrt(np.maximum(of - 2 * least, 0)), np.sqrt(np.maximum(of - 2 * most, 0))
                        fits = (near <= outer[:, None]) & (far >= inner[:, None]) & (least <= most)[:, None]
                        fits[np.arange(len(b)), b["cell"].to_numpy()] = False
                        who, cell = np.nonzero(fits)
                        yield b.iloc[who].assign(cell=cell)

        return go

    def meet(same: bool):
        def go(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            at, held, tree = None, [], None
            for batch in batches:
                for (dim, cell, no, asks), some in batch.groupby(["dim", "cell", "piece", "asks"], sort=True):
                    if (dim, cell, no) != at:
                        at, held, tree = (dim, cell, no), [], None
                    if not asks:
                        held.append(some)
                        continue
                    if not held:
                        continue
                    if tree is None:
                        data = pd.concat(held)
                        tree = Piece(data["key"].to_numpy(), data["id"].to_numpy(), data["label"].to_numpy(), _vectors(data["v"], kind, dim), square, exact, leaf)
                    for lo in range(0, len(some), BLOCK):
                        b = some.iloc[lo : lo + BLOCK]
                        count = b["low"].map(len).to_numpy()
                        owner = np.repeat(np.arange(len(b)), count)
                        window = np.concatenate([np.arange(c) for c in count]) if len(owner) else owner
                        p, s, i = tree.search(b["key"].to_numpy(), b["label"].to_numpy(), _vectors(b["v"], kind, dim), owner, np.concatenate(list(b["low"])).astype(np.int64), np.concatenate(list(b["high"])).astype(np.int64), same, k)
                        yield pd.DataFrame({"anchor": b["key"].to_numpy()[owner[p]], "window": window[p], "score": s, "id": i})

        return go

    ask = "key long, label long, dim int, cell long, v binary, low array<long>, high array<long>"

    def ranked(found: DataFrame) -> DataFrame:
        first = Window.partitionBy("anchor", "window").orderBy(F.desc("score"), "id")
        return found.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= k)

    def visited(asked: DataFrame, same: bool) -> DataFrame:
        asked = asked.join(cells, in_cell(asked)).withColumn("piece", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)))
        none = F.lit(None).cast("array<long>")
        both = stored.select("key", "id", "label", "dim", "cell", "piece", F.lit(0).alias("asks"), "v", none.alias("low"), none.alias("high")).unionByName(asked.select("key", F.lit(0).cast("long").alias("id"), "label", "dim", "cell", "piece", F.lit(1).alias("asks"), "v", "low", "high"))
        both = both.repartition("dim", "cell", "piece").sortWithinPartitions("dim", "cell", "piece", "asks")
        return written(both.mapInPandas(meet(same), "anchor long, window int, score long, id long"))

    def search(queries: DataFrame, same: bool) -> DataFrame:
        queries = written(queries.select(*[c.split()[0] for c in ask.split(", ")]))
        own = visited(queries.mapInPandas(visits(True), ask), same)
        kth = ranked(own).where(F.col("rank") == k).groupBy(F.col("anchor").alias("q_key")).agg(F.map_from_entries(F.collect_list(F.struct("window", "score"))).alias("kth"))
        low = F.transform("low", lambda x, j: F.greatest(x, F.coalesce(F.try_element_at("kth", j), x)))
        tight = queries.join(kth, F.col("key") == F.col("q_key"), "left").withColumn("low", F.when(F.col("kth").isNull(), F.col("low")).otherwise(low))
        rest = visited(tight.select(*queries.columns).mapInPandas(visits(False), ask), same)
        return written(ranked(own.union(rest)))

    anchors = placed.where(F.col("id") % every == 0)
    open_window = anchors.withColumns({"low": F.array(F.lit(-_FAR + 1)), "high": F.array(F.lit(_FAR - 1))})
    positives = search(open_window, True)
    score = F.col("score").cast("decimal(20,0)")  # times a percent, a score may not fit a long
    up, down = (F.ceil(score * low_percent / 100).cast("long"), F.floor(score * high_percent / 100).cast("long"))
    windows = positives.withColumns({"lo": up, "hi": down}).groupBy(F.col("anchor").alias("w_key")).agg(F.array_sort(F.collect_list(F.struct("rank", "lo", "hi"))).alias("w"))
    asked = anchors.join(windows, F.col("key") == F.col("w_key")).withColumns({"low": F.col("w.lo"), "high": F.col("w.hi")})
    negatives = search(asked, False)
    p = positives.select(F.col("anchor").alias("p_anchor"), (F.col("rank") - 1).alias("p_window"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    names = anchors.select(F.col("key").alias("a_key"), F.col("id").alias("anchor_id"))
    out = negatives.join(p, (F.col("anchor") == F.col("p_anchor")) & (F.col("window") == F.col("p_window"))).join(names, F.col("anchor") == F.col("a_key"))
    return out.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
