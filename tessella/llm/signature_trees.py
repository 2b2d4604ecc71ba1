"""N-gram Jaccard join with signature trees.

Documents are sets of distinct word shingles. A pair that reaches the threshold shares one of
the first tokens of both sets in any fixed order of tokens (prefix filter), so each document is
sent to the buckets of its first tokens only. In a bucket, a signature tree holds documents as
bitmaps of their tokens; its nodes carry the OR of the bitmaps below and the range of sizes. The
tree is traversed against itself: a pair of nodes is dropped when the largest overlap that any
two documents below can have is too small, when their sizes are too far apart, or when all
documents below are linked already. Pairs that are left are verified on whole sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm._base import SHARE, checkpointed, components, fresh, sieve, sifted, small_batches, trimmed, with_groups, written

WORDS, PERCENT = 5, 80
#: Bits of a document's bitmap by size band: (largest size but one, bits). A document up to a quarter over a band's
#: floor has partners in the band below and stands in both, with its bitmap folded.
BANDS = ((1024, 2048), (4096, 8192), (2**62, 32768))
#: Counters of the frequency sketch, documents of a bucket compared in one task, children of a node.
SKETCH_BITS, CHUNK, FAN = 20, 1024, 4
#: Tasks whose sketches are summed in one group of the first round, and documents that are verified against one other in a group.
TASKS, HUB_CHUNK = 256, 256
#: A task's forest of nodes to be compared is started anew beyond so many nodes; that only repeats pairs.
FOREST = 1_000_000
#: Lists of up to so many ids are broadcast (some 10 MB); longer ones are joined by a shuffle.
FEW_IDS = 100_000
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


class _Words(dict):
    """Word hashes of a task, started anew before they fill the memory."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 1_000_000:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def shingles(text: bytes, words: dict, size: int = WORDS) -> np.ndarray:
    """Sorted 64-bit hashes of a text's distinct shingles. bytes.lower and bytes.split know A-Z and ASCII white space only."""
    found = text.lower().split()
    if not found:
        return np.zeros(0, np.uint64)
    h = np.array(list(map(words.__getitem__, found)), np.uint64)
    k = min(size, len(h))
    n = len(h) - k + 1
    out = np.full(n, k, np.uint64)
    for j in range(k):
        out = (out ^ h[j : j + n]) * _A
        out ^= out >> np.uint64(31)
    out *= _B
    return np.unique(out ^ (out >> np.uint64(32)))


def need(n: np.ndarray | int, percent: int = PERCENT):
    """The smallest overlap that a set of n tokens can have with a partner."""
    return -(-percent * n // 100)


def linked(overlap, a, b, percent: int = PERCENT):
    return 100 * overlap >= percent * (a + b - overlap)


def _slot(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)


def _width(n: int) -> int:
    return next(bits for least, bits in BANDS if n < least)


def _bitmap(h: np.ndarray, width: int = 0) -> np.ndarray:
    width = width or _width(len(h))
    bits = np.zeros(width, np.uint8)
    bits[(h & np.uint64(width - 1)).astype(np.int64)] = 1
    return np.packbits(bits)


def _folded(bits: bytes, width: int) -> np.ndarray:
    """A bitmap as words of 64 bits, folded to `width` bits: that is the bitmap of the same tokens at that width."""
    return np.bitwise_or.reduce(np.frombuffer(bits, np.uint64).reshape(-1, width // 64), axis=0)


def _bands(n):
    """The bands that a document of n tokens stands in."""
    floors = [0, *(least for least, _ in BANDS[:-1])]
    own = F.lit(0)
    below = F.lit(False)
    for k, floor in enumerate(floors[1:], 1):
        own = F.when(n >= floor, k).otherwise(own)
        below = F.when(n >= floor, PERCENT * n <= 100 * floor).otherwise(below)
    return F.when(below, F.array(own - 1, own)).otherwise(F.array(own))


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("key"), text.alias("text"))


def _bytes(column: pa.Array) -> list[bytes]:
    return column.cast(pa.binary()).to_pylist()


def frequency_classes(docs: DataFrame, size: int = WORDS, id_col: str = "doc_id", text_col: str = "text") -> tuple[np.ndarray, float]:
    """A class for each slot of hashes: 0 for the usual document frequency, one more for each doubling; and the usual frequency.

    Every document is counted. The counters are summed by task first, then block by block over
    groups of TASKS tasks, then over those groups; what comes to the driver is one counter for
    each of the 2^SKETCH_BITS slots, whatever the input.
    """
    block = 1 << 14

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, sums, some = _Words(), np.zeros(1 << SKETCH_BITS, np.int64), False
        for batch in batches:
            for text in _bytes(batch.column("text")):
                s = shingles(text, words, size)
                if len(s):
                    np.add.at(sums, _slot(s), 1)
                    some = True
        if some:
            parts = sums.reshape(-1, block).astype("<i4")
            group = pa.array([TaskContext.get().partitionId() // TASKS] * len(parts), pa.int32())
            yield pa.RecordBatch.from_arrays([group, pa.array(range(len(parts)), pa.int32()), pa.array([p.tobytes() for p in parts], pa.binary())], ["tasks", "block", "sums"])

    def add(table: pa.Table) -> pa.Table:
        total = np.zeros(block, np.int64)
        for x in table.column("sums"):
            total += np.frombuffer(x.as_buffer(), "<i4" if len(x.as_buffer()) == 4 * block else "<i8")
        return table.slice(0, 1).set_column(2, "sums", pa.array([total.tobytes()], pa.binary()))

    schema = "tasks int, block int, sums binary"
    parts = _texts(docs, id_col, text_col).select("text").mapInArrow(trimmed(count), schema)
    some = parts.groupBy("tasks", "block").applyInArrow(add, schema)
    got = {r["block"]: np.frombuffer(r["sums"], "<i8") for r in some.groupBy("block").applyInArrow(add, schema).collect()}
    if not got:
        return np.zeros(1 << SKETCH_BITS, np.uint8), 1.0
    sums = np.concatenate([got[b] for b in sorted(got)])
    usual = max(1.0, float(np.median(sums)) * 1.25)
    return np.clip(np.ceil(np.log2(np.maximum(sums, 1) / usual)), 0, 31).astype(np.uint8), usual


def features(docs: DataFrame, classes: np.ndarray, size: int = WORDS, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, key, uid, n, h1, h2, prefix, bits) of each row.

    key is a hash of the text, uid a number of the row that holds once the rows are written; h1
    and h2 are a 128-bit hash of the whole set, null without words.

    The order of tokens is (frequency class, hash): common passages come last, so that they
    are no bucket unless a document has little else.
    """
    known = docs.sparkSession.sparkContext.broadcast(classes)  # 2^SKETCH_BITS bytes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, rank = _Words(), known.value.astype(np.uint64)
        at = TaskContext.get().partitionId() << 33
        for batch in batches:
            cols = [[] for _ in range(5)]
            for text in _bytes(batch.column("text")):
                s = shingles(text, words, size)
                n = len(s)
                if not n:
                    for c, v in zip(cols, (0, None, None, None, None), strict=True):
                        c.append(v)
                    continue
                key = np.sort((rank[_slot(s)] << np.uint64(58)) | (s >> np.uint64(6)))
                whole = xxhash.xxh3_128_digest(s.tobytes())
                cols[0].append(n)
                cols[1].append(int.from_bytes(whole[:8], "big", signed=True))
                cols[2].append(int.from_bytes(whole[8:], "big", signed=True))
                cols[3].append(key[: n - int(need(n, percent)) + 1].astype(np.int64))
                cols[4].append(_bitmap(s).tobytes())
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("key"), pa.array(range(at, at + batch.num_rows), pa.int64()), *[pa.array(c, k) for c, k in zip(cols, kinds, strict=True)]], ["id", "key", "uid", "n", "h1", "h2", "prefix", "bits"])
            at += batch.num_rows

    kind = docs.schema[id_col].dataType.simpleString()
    return _texts(docs, id_col, text_col).mapInArrow(trimmed(run), f"id {kind}, key long, uid long, n long, h1 long, h2 long, prefix array<long>, bits binary")


def _few(ids: DataFrame) -> DataFrame:
    """Marked for broadcast if there are few; else the join is left to a shuffle."""
    return F.broadcast(ids) if ids.limit(FEW_IDS + 1).count() <= FEW_IDS else ids


def sets_of(docs: DataFrame, wanted: DataFrame, size: int = WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(h1, h2, tokens) of one document of each wanted node (least, text_key): whole sets, made again from those texts only.

    Rows repeated with one id and text give their set as often.
    """
    ids = wanted.select(F.col("least").alias("w_id"), F.col("text_key").alias("w_key")).distinct()
    chosen, few = _texts(docs, id_col, text_col), _few(ids)
    if few is ids:  # only texts that pass the sieve are shuffled
        chosen = sifted(chosen, F.xxhash64("id", "key"), sieve(ids.select(F.xxhash64("w_id", "w_key").alias("at"))), "maybe").where("maybe")
    chosen = chosen.join(few, F.col("id").eqNullSafe(F.col("w_id")) & (F.col("key") == F.col("w_key")), "left_semi")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _Words()
        for batch in batches:
            made = [shingles(t, words, size).tobytes() for t in _bytes(batch.column("text"))]
            whole = [xxhash.xxh3_128_digest(m) for m in made]
            halves = [pa.array([int.from_bytes(w[k : k + 8], "big", signed=True) for w in whole], pa.int64()) for k in (0, 8)]
            yield pa.RecordBatch.from_arrays([*halves, pa.array(made, pa.binary())], ["h1", "h2", "tokens"])

    return chosen.select("text").mapInArrow(trimmed(run), "h1 long, h2 long, tokens binary")


def _grouped(batches: Iterator[pa.RecordBatch], keys: tuple[str, ...]) -> Iterator[pa.Table]:
    """The groups of batches that are sorted by keys; a group is held until its last row is seen."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        k = np.column_stack([batch.column(c).to_numpy(zero_copy_only=False) for c in keys])
        cuts = [0, *(np.flatnonzero((k[1:] != k[:-1]).any(axis=1)) + 1).tolist(), len(k)]
        for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
            at = tuple(k[lo].tolist())
            if held and at != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(lo, hi - lo))
            last = at
    if held:
        yield pa.Table.from_batches(held)


class SignatureTree:
    """A tree over documents in a given order; level 0 holds the documents, each level above FAN nodes in one.

    Documents have one label or several (columns); those that agree in any are not compared.
    """

    def __init__(self, bits: np.ndarray, n: np.ndarray, slack: np.ndarray, label: np.ndarray):
        label = label.reshape(len(n), -1)
        self.levels = [(bits, n, n, slack, label, np.ones(label.shape, bool))]
        while len(self.levels[-1][1]) > 1:
            b, lo, hi, s, c, one = self.levels[-1]
            at = np.arange(0, len(lo), FAN)
            least, most = np.minimum.reduceat(c, at, axis=0), np.maximum.reduceat(c, at, axis=0)
            self.levels.append((np.bitwise_or.reduceat(b, at, axis=0), np.minimum.reduceat(lo, at), np.maximum.reduceat(hi, at), np.maximum.reduceat(s, at), least, np.logical_and.reduceat(one, at, axis=0) & (least == most)))

    def pairs(self, side: np.ndarray | None = None, percent: int = PERCENT) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of documents i < j that no bound rules out; with sides, only pairs of both sides."""
        x = y = np.zeros(1, np.int64)
        for depth in range(len(self.levels) - 1, -1, -1):
            bits, lo, hi, slack, label, one = self.levels[depth]
            # Labels and sizes first: bitmaps cost more.
            fits = ~(one[x] & one[y] & (label[x] == label[y])).any(axis=1) & (np.minimum(hi[x], hi[y]) >= need(np.maximum(lo[x], lo[y]), percent))
            x, y = x[fits], y[fits]
            most = np.empty(len(x), np.int64)
            for s in range(0, len(x), 65536):
                most[s : s + 65536] = np.bitwise_count(bits[x[s : s + 65536]] & bits[y[s : s + 65536]]).sum(axis=1, dtype=np.int64)
            # An overlap has a bit in both nodes for each token, but for tokens of one document that share a bit.
            most = np.minimum(most + np.minimum(slack[x], slack[y]), np.minimum(hi[x], hi[y]))
            least = np.maximum(lo[x], lo[y])
            keep = most >= need(least, percent)
            if depth == 0:
                keep &= linked(most, lo[x], lo[y], percent) & (x != y)
            x, y = x[keep], y[keep]
            if depth == 0 or not len(x):
                break
            below = len(self.levels[depth - 1][1])
            step = np.arange(FAN)
            cx = np.repeat(x * FAN, FAN * FAN) + np.tile(np.repeat(step, FAN), len(x))
            cy = np.repeat(y * FAN, FAN * FAN) + np.tile(np.tile(step, FAN), len(x))
            fits = (cx < below) & (cy < below) & (cx <= cy)
            x, y = cx[fits], cy[fits]
        if side is not None:
            across = side[x] != side[y]
            x, y = x[across], y[across]
        return x, y


def _tree(group: pa.Table, label: np.ndarray) -> tuple[np.ndarray, SignatureTree, np.ndarray | None]:
    """The group's rows in tree order (labels from the last column on, size), their tree, and their chunk sides if it is a pair of chunks."""
    n = group.column("n").to_numpy()
    order = np.lexsort((n, *label.reshape(len(n), -1).T))
    width = BANDS[group.column("band")[0].as_py()][1]
    if "bits" in group.column_names:
        bits = np.stack([_folded(b, width) for b in group.column("bits").to_pylist()])
    else:
        bits = np.stack([_bitmap(np.frombuffer(t, np.uint64), width).view(np.uint64) for t in group.column("tokens").to_pylist()])
    slack = n - np.bitwise_count(bits).sum(axis=1, dtype=np.int64)
    tree = SignatureTree(bits[order], n[order], slack[order], label[order])
    lo, hi = group.column("lo")[0].as_py(), group.column("hi")[0].as_py()
    return order, tree, None if lo == hi else group.column("own").to_numpy()[order]


_KEYS = ("token", "band", "lo", "hi")


def _top(root: dict[int, int], k: int) -> int:
    """The node that stands for all that k is joined to; the way there is halved."""
    while (up := root.get(k, k)) != k:
        root[k] = root.get(up, up)
        k = root[k]
    return k


def _spanning(x: np.ndarray, y: np.ndarray, root: dict[int, int]) -> list[tuple[int, int]]:
    """The pairs (x, y) that the forest in root lacks to join what they join; they are added to it."""
    out = []
    for p, q in zip(x.tolist(), y.tolist(), strict=True):
        a, b = _top(root, p), _top(root, q)
        if a != b:
            root[max(a, b)] = root[min(a, b)] = min(a, b)
            out.append((p, q))
    return out


def _survivors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A forest (a, b) over the pairs that no bound rules out, one for all buckets of the task.

    Nodes that it joins are compared with each other in any case, so that buckets of much the
    same nodes are not traversed again. It is started anew before it fills the memory.
    """
    root: dict[int, int] = {}
    for group in _grouped(batches, _KEYS):
        if len(root) > FOREST:
            root.clear()
        node, label = group.column("node").to_numpy(), group.column("label").to_numpy()
        joined = np.array([_top(root, k) if k in root else -1 - c for k, c in zip(node.tolist(), label.tolist(), strict=True)], np.int64)
        order, tree, side = _tree(group, np.column_stack([label, joined]))
        x, y = tree.pairs(side)
        forest = _spanning(node[order[x]], node[order[y]], root)
        if forest:
            yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in forest], pa.int64()), pa.array([q for _, q in forest], pa.int64())], ["a", "b"])


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Spanning links (a, b) of each bucket; pairs of documents that are linked by then are not compared."""
    for group in _grouped(batches, _KEYS):
        order, tree, side = _tree(group, group.column("label").to_numpy())
        nodes, labels = group.column("node").to_numpy()[order], group.column("label").to_numpy()[order].tolist()
        sets = [np.frombuffer(t, np.uint64) for t in group.column("tokens").take(order).to_pylist()]
        root: dict[int, int] = {}
        out = []
        x, y = tree.pairs(side)
        for i, j in zip(x.tolist(), y.tolist(), strict=True):
            p, q = _top(root, labels[i]), _top(root, labels[j])
            if p != q and linked(len(np.intersect1d(sets[i], sets[j], assume_unique=True)), len(sets[i]), len(sets[j])):
                root[max(p, q)] = min(p, q)
                out.append((int(nodes[i]), int(nodes[j])))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in out], pa.int64()), pa.array([b for _, b in out], pa.int64())], ["a", "b"])


def _possible(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pairs (a, b) whose bitmaps leave an overlap that is large enough."""
    for batch in batches:
        n, m = batch.column("n_a").to_numpy(), batch.column("n_b").to_numpy()
        most = np.empty(len(n), np.int64)
        for k, (x, y) in enumerate(zip(batch.column("bits_a").to_pylist(), batch.column("bits_b").to_pylist(), strict=True)):
            width = 8 * min(len(x), len(y))
            p, q = _folded(x, width), _folded(y, width)
            most[k] = np.bitwise_count(p & q).sum() + min(n[k] - np.bitwise_count(p).sum(dtype=np.int64), m[k] - np.bitwise_count(q).sum(dtype=np.int64))
        yield batch.select(["a", "b"]).filter(pa.array(linked(np.minimum(most, np.minimum(n, m)), n, m)))


def _pairs_verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pairs (a, b) whose sets are alike; a group has the set of b (side 1) and sets of its partners."""
    for group in _grouped(batches, ("b", "part")):
        side, nodes, tokens = group.column("side").to_numpy(), group.column("node").to_pylist(), group.column("tokens")
        y = np.frombuffer(tokens[int(np.argmax(side))].as_buffer(), np.uint64)
        found = []
        for k in np.flatnonzero(side == 0).tolist():
            x = np.frombuffer(tokens[k].as_buffer(), np.uint64)
            if linked(len(np.intersect1d(x, y, assume_unique=True)), len(x), len(y)):
                found.append(nodes[k])
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.int64()), pa.array([group.column("b")[0].as_py()] * len(found), pa.int64())], ["a", "b"])


def _size_step(n):
    """Two steps for a factor of 1.25: sizes that can be linked are at most two steps apart."""
    return F.floor(2 * F.log(n) / F.lit(float(np.log(1.2501))))


def similar_documents(docs: DataFrame, size: int = WORDS, percent: int = PERCENT, chunk: int = CHUNK, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, n_shingles, component_id.

    1. Features of all documents (two scans: frequencies, then sets) are written. Equal sets, by
       128 bits, are one node from here on, summed up before the shuffle; the number of the row
       that names it tells a node from all others.
    2. Prefix tokens are grouped; those of one node only are dropped. Tokens that the sketch
       takes for common are summed up before they meet their rows again.
    3. In each bucket, every node is verified against the least node. Groups of near copies
       thereby fall into few classes, with as many comparisons as nodes.
    4. Buckets that still hold two classes go through their signature tree, nodes without a
       partner of fitting size left out; of buckets with the same nodes, one does. A bucket over
       `chunk` nodes is dealt out by pairs of chunks. The first traversal needs bitmaps only and
       returns a forest for each task over the pairs that are left, with fewer edges than it has
       nodes; the second, over each component of the forests, compares whole sets and gives
       spanning links.
    5. Links of both steps are united to components.

    Null or wordless text has no shingles and links with nothing. A row with a null id takes
    part, but a component of such rows only has a null id. Repeated rows are equal sets. An
    empty table gives no rows; other columns are ignored.
    """
    return _marked(docs, size, percent, chunk, id_col, text_col).drop("_t_key")


def _marked(docs: DataFrame, size: int = WORDS, percent: int = PERCENT, chunk: int = CHUNK, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """similar_documents with _t_key, a hash of the text that tells rows of one id apart."""
    if percent != PERCENT:
        raise ValueError("the traversals are compiled for PERCENT")
    small_batches(docs.sparkSession)
    ranks, usual = frequency_classes(docs, size, id_col, text_col)
    every = written(features(docs, ranks, size, percent, id_col, text_col))
    sound = every.where("h1 IS NOT NULL")
    one = F.struct(F.col("id").isNull().alias("none"), "id", "uid", F.col("key"), "n")
    heads = sound.groupBy("h1", "h2").agg(F.min(one).alias("m"), F.count("*").alias("copies"))
    names = written(heads.select("h1", "h2", F.col("m.uid").alias("node"), F.col("m.id").alias("least"), F.col("m.key").alias("text_key"), F.col("m.n").alias("n"), "copies"))
    total = names.agg(F.sum("copies")).first()[0] or 0
    copies = written(sound.select("uid").join(names.select("node"), F.col("uid") == F.col("node"), "left_anti").select(F.col("uid").alias("c_uid")))
    rows = sifted(sound.select("uid", "n", "prefix", "bits"), F.xxhash64("uid"), sieve(copies.select(F.xxhash64("c_uid").alias("at"))), "maybe")
    told = rows.where("maybe").join(copies, F.col("uid") == F.col("c_uid"), "left_anti")
    single = rows.where("NOT maybe").unionByName(told).drop("maybe").withColumnRenamed("uid", "node")
    nodes = written(single.select("node", "n", "bits"))

    # A token of class c stands in at most usual * 2^c documents; the class is its first bits.
    common = next((c for c in range(32) if usual * 2.0**c * SHARE > total), 32)
    cut = F.lit(common << 58) if common < 32 else F.lit(None).cast("long")
    rows = single.select("node", F.col("n").cast("int").alias("n"), F.explode("prefix").alias("token"))
    hub = lambda r: r.groupBy("token").agg(F.min(F.struct("node", "n")).alias("hub"), F.max("node").alias("last")).where("hub.node <> last").select(F.col("token").alias("h_token"), F.col("hub.node").alias("hub"), F.col("hub.n").alias("hub_n"))
    meet = lambda r, h: r.join(h, F.col("token") == F.col("h_token")).select("token", "node", "n", "hub", "hub_n")
    usual_rows = rows.where(F.coalesce(F.col("token") < cut, F.lit(True))).repartition("token")  # one exchange for the sums and the join
    common_rows = rows.where(F.col("token") >= cut)
    shared = written(meet(usual_rows, hub(usual_rows)).unionByName(meet(common_rows, written(hub(common_rows)))))

    # Every node against the least one of its buckets: bitmaps first, then whole sets.
    fits = 100 * F.least("n", "hub_n") >= percent * F.greatest("n", "hub_n")
    near = written(shared.where(F.col("node") != F.col("hub")).where(fits).select(F.col("node").alias("a"), F.col("hub").alias("b")).distinct())
    among = lambda ids: nodes.join(_few(ids.distinct()), F.col("node") == F.col(ids.columns[0]), "left_semi")
    marks = lambda c: among(near.select(F.col(c).alias("x"))).select(F.col("node").alias(f"{c}_node"), F.col("n").alias(f"n_{c}"), F.col("bits").alias(f"bits_{c}"))
    hubs = written(near.groupBy("b").agg(F.count("*").alias("size")).join(marks("b"), F.col("b") == F.col("b_node")).drop("b"))
    first = with_groups(near, hubs, {"b": "b_node"}, "size", near.count()).join(marks("a"), F.col("a") == F.col("a_node"))
    first = checkpointed(first.select("a", "b", "n_a", "n_b", "bits_a", "bits_b").mapInArrow(trimmed(_possible), "a long, b long"))
    parts = first.groupBy("b").agg(F.ceil(F.count("*") / HUB_CHUNK).cast("int").alias("parts")).withColumnRenamed("b", "p_b")
    left = first.join(parts, F.col("b") == F.col("p_b")).select("b", F.pmod(F.xxhash64("a"), F.col("parts")).cast("int").alias("part"), "a")
    ends_of = left.select("b", "part", F.col("a").alias("node"), F.lit(0).alias("side")).unionByName(parts.select(F.col("p_b").alias("b"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.col("p_b").alias("node"), F.lit(1).alias("side")))
    known = names.select(F.col("node").alias("w_node"), "h1", "h2", "least", "text_key")
    wanted = checkpointed(ends_of.join(known, F.col("node") == F.col("w_node")).select("b", "part", "node", "side", F.col("h1").alias("w1"), F.col("h2").alias("w2"), "least", "text_key"))
    same = (F.col("h1") == F.col("w1")) & (F.col("h2") == F.col("w2"))
    paired = sets_of(docs, wanted, size, id_col, text_col).join(_few(wanted.drop("least", "text_key")), same).select("b", "part", "node", "side", "tokens")
    links = checkpointed(paired.repartition("b", "part").sortWithinPartitions("b", "part").mapInArrow(trimmed(_pairs_verified), "a long, b long"))

    # Buckets that still hold two classes, one for each set of nodes.
    classes = written(components(links))
    labelled = written(shared.select("token", "node", "n").join(classes.select(F.col("node").alias("c_node"), "component"), F.col("node") == F.col("c_node"), "left").select("token", "node", "n", F.coalesce("component", "node").alias("label")))
    buckets = labelled.groupBy("token").agg(F.min("node").alias("hub"), F.count("*").alias("size"), F.min("label").alias("l0"), F.max("label").alias("l1"), F.expr("bit_xor(xxhash64(node))").alias("m0"), F.expr("bit_xor(xxhash64(node, 1))").alias("m1")).where("l0 <> l1")
    picked = written(buckets.groupBy("size", "m0", "m1").agg(F.min("token").alias("p_token"), F.min("hub").alias("hub")).select("p_token", "hub", "size", F.ceil(F.col("size") / chunk).cast("int").alias("chunks")))
    few = _few(picked)
    live = labelled.join(few, F.col("token") == F.col("p_token")) if few is not picked else with_groups(labelled, picked, {"token": "p_token"}, "size", labelled.count())
    # The least node of a bucket has been compared with all others there.
    live = written(live.where("node <> hub").select("token", "node", "label", "n", "chunks", _size_step(F.col("n")).alias("step")))
    around = live.select(F.col("token").alias("a_token"), F.explode(F.sequence(F.col("step") - 2, F.col("step") + 2)).alias("a_step"), "label")
    around = around.groupBy("a_token", "a_step").agg(F.min("label").alias("l0"), F.max("label").alias("l1")).where("l0 <> l1")
    live = live.join(around, (F.col("token") == F.col("a_token")) & (F.col("step") == F.col("a_step")), "left_semi")
    live = checkpointed(live.withColumn("band", F.explode(_bands(F.col("n")))))
    live = live.join(among(live.select(F.col("node").alias("x"))).select(F.col("node").alias("n_node"), "bits"), F.col("node") == F.col("n_node"))
    live = live.withColumn("own", F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    live = live.select("token", "band", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "own", "node", "label", "n", "bits")
    forest = checkpointed(live.repartition(*_KEYS).sortWithinPartitions(*_KEYS).mapInArrow(trimmed(_survivors), "a long, b long"))

    # Whole sets, each once: pairs that are left lie inside the components of what is left.
    open_ = components(forest).select(F.col("node").alias("o_node"), F.col("component").alias("token"))
    open_ = names.join(open_, F.col("node") == F.col("o_node")).join(classes.select(F.col("node").alias("c_node"), F.col("component").alias("class")), F.col("node") == F.col("c_node"), "left")
    open_ = checkpointed(open_.select("token", F.explode(_bands(F.col("n"))).alias("band"), "node", F.coalesce("class", "node").alias("label"), "n", "least", "text_key", F.col("h1").alias("w1"), F.col("h2").alias("w2")))
    counts = open_.groupBy("token", "band").agg(F.ceil(F.count("*") / chunk).cast("int").alias("chunks")).select(F.col("token").alias("k_token"), F.col("band").alias("k_band"), "chunks")
    dealt = open_.join(counts, (F.col("token") == F.col("k_token")) & (F.col("band") == F.col("k_band")))
    dealt = dealt.withColumn("own", F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    dealt = checkpointed(dealt.select("token", "band", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "own", "node", "w1", "w2", "label", "n"))
    whole = sets_of(docs, open_, size, id_col, text_col).join(_few(dealt), same).select(*_KEYS, "own", "node", "label", "n", "tokens")
    found = checkpointed(links.unionByName(whole.repartition(*_KEYS).sortWithinPartitions(*_KEYS).mapInArrow(trimmed(_verified), "a long, b long")))

    ends = components(found).select(F.col("node").alias("e_node"), "component")
    named = written(ends.join(names, F.col("e_node") == F.col("node")).select("node", "component", "least"))
    least = written(named.groupBy(F.col("component").alias("name")).agg(F.min("least").alias("component_id"), F.count("*").alias("size")))
    final = with_groups(named.select("node", "component"), least, {"component": "name"}, "size", named.count()).select(F.col("node").alias("f_node"), "component_id")
    lone = names.join(final, F.col("node") == F.col("f_node"), "left").select(F.col("h1").alias("o1"), F.col("h2").alias("o2"), "copies", F.coalesce("component_id", "least").alias("component_id"))
    out = with_groups(every.select("id", "key", "n", "h1", "h2"), written(lone), {"h1": "o1", "h2": "o2"}, "copies", total, "left")
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.when(F.col("h1").isNull(), F.col("id")).otherwise(F.col("component_id")).alias("component_id"), F.col("key").alias("_t_key"))


def keep_one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that are the least of their component, with all their columns.

    Of rows repeated with one id and text, one stays. Rows without an id are dropped if their
    component has a row with one; else those of different text all stay. Only rows that are
    dropped or repeated (a sieve tells) are shuffled; all others stay where they are.
    """
    marks = written(_marked(docs, id_col=id_col, text_col=text_col).select(F.col(id_col).alias("g_id"), F.col("_t_key").alias("g_key"), (~F.col(id_col).eqNullSafe(F.col("component_id"))).alias("drop")))
    marks = written(marks.groupBy("g_id", "g_key").agg(F.max("drop").alias("drop"), F.count("*").alias("n")).where("drop OR n > 1"))
    g_id, g_key, own, maybe = fresh(docs, "g_id", "g_key", "own_key", "maybe")
    gone = marks.where("drop").select(F.col("g_id").alias(g_id), F.col("g_key").alias(g_key))
    key = F.xxhash64(F.coalesce(F.col(text_col).cast("string"), F.lit("")))
    rows = sifted(docs, F.xxhash64(F.col(id_col), key), sieve(marks.select(F.xxhash64("g_id", "g_key").alias("at"))), maybe)
    told = rows.where(F.col(maybe)).drop(maybe).withColumn(own, key)
    told = told.join(gone, F.col(id_col).eqNullSafe(F.col(g_id)) & (F.col(own) == F.col(g_key)), "left_anti")
    return rows.where(~F.col(maybe)).drop(maybe).unionByName(told.dropDuplicates([id_col, own]).drop(own))
