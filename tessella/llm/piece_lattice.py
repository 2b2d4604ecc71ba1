"""SentencePiece segmentations sampled from the piece lattice, and lossless decoding.

A text is cut where no piece of the vocabulary can span: before a run of spaces, and around
line ends. Each such unit has its own lattice, so forward filtering and backward sampling run
unit by unit, vectorised over all units of a batch that have the same length. The random
number of each backward step is a hash of (row key, unit number, position): the segmentation
of a row depends on its key and text only, never on batches, partitions or retries.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessella.llm._base import small_batches, text_or_empty, trimmed

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE, MARK, NEWLINE, LITERAL, PAD = 0x20, 0x2581, 0x0A, 0x110000, 0x110001
_M = np.uint64(0x9E3779B97F4A7C15)
_SLOTS = 20
#: Code points that are encoded at a time.
SLICE = 2_000_000
#: Units up to this length are filtered without logarithms, with this factor (its logarithm) for each character.
LINEAR, TILT = 40, 8.0


def _step(h: np.ndarray, c: np.ndarray) -> np.ndarray:
    return (h + c.astype(np.uint64) + np.uint64(1)) * _M


@dataclass
class Vocabulary:
    """Every prefix of a piece in one hash table (so that a search can stop early), log weights, byte pieces."""

    pieces: list[bytes]
    hashes: np.ndarray
    piece_of: np.ndarray
    slots: np.ndarray
    spare: np.ndarray
    ids: np.ndarray
    weights: np.ndarray
    longest: int
    byte_ids: np.ndarray
    byte_weight: float

    def look_up(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which hashes are of a prefix, and the number of the piece that is this prefix (-1: none)."""
        at = self.slots[(h >> np.uint64(64 - _SLOTS)).astype(np.int32)]
        hit = self.hashes[at] == h
        if len(self.spare):
            miss = np.flatnonzero(~hit & (at >= 0))
            where = np.searchsorted(self.hashes[self.spare], h[miss])
            found = self.spare[np.minimum(where, len(self.spare) - 1)]
            good = self.hashes[found] == h[miss]
            at[miss[good]], hit[miss[good]] = found[good], True
        return hit, np.where(hit, self.piece_of[at], -1)


@lru_cache(maxsize=2)
def load(model: bytes, alpha: float) -> Vocabulary:
    """A BPE model scores a piece by its merge rank: its weight is Zipf's, -log(1 + rank). A unigram model gives log probabilities."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_proto=model)
    n = sp.vocab_size()
    usable = [i for i in range(n) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
    text = {i: sp.id_to_piece(i) for i in usable}
    if any("\n" in p or (chr(MARK) in p.lstrip(chr(MARK))) for p in text.values()):
        raise ValueError("a piece spans words: units can't be sampled apart")
    byte_ids = np.full(256, -1, np.int32)
    pieces = [b""] * n
    for i in range(n):
        if sp.is_byte(i):
            byte_ids[int(sp.id_to_piece(i)[3:5], 16)] = i
            pieces[i] = bytes([int(sp.id_to_piece(i)[3:5], 16)])
    if (byte_ids < 0).any():
        raise ValueError("the model has no byte fallback: not every text can be encoded")
    score = np.array([sp.get_score(i) for i in usable])
    ranked = score.min() < -1000
    weight = alpha * (-np.log1p(-score - (-score).min()) if ranked else score)
    prefixes: dict[int, int] = {}
    for k, i in enumerate(usable):
        for h in _hashes(text[i]):
            prefixes.setdefault(h, -1)
        prefixes[h] = k
    hashes = np.array(sorted(prefixes), dtype=np.uint64)
    piece_of = np.array([prefixes[h] for h in hashes.tolist()], np.int32)
    slots = np.full(1 << _SLOTS, -1, np.int32)
    slot = (hashes >> np.uint64(64 - _SLOTS)).astype(np.int64)
    first = np.append(True, slot[1:] != slot[:-1])  # sorted by hash, so by slot
    slots[slot[first]] = np.flatnonzero(first)
    spare = np.flatnonzero(~first)
    for i in usable:
        pieces[i] = text[i].replace(chr(MARK), " ").encode()
    return Vocabulary(pieces, hashes, piece_of, slots, spare, np.array(usable, np.int32), weight, max(map(len, text.values())), byte_ids, float(weight.min()) - 1.0)


def _hashes(piece: str) -> list[int]:
    """Of each prefix."""
    h, out = np.zeros(1, np.uint64), []
    for c in piece:
        h = _step(h, np.array([ord(c)]))
        out.append(int(h[0]))
    return out


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def row_key(value) -> int:
    """A 64-bit key of a row's id."""
    h = np.zeros(1, np.uint64)
    for c in str(value):
        h = _step(h, np.array([ord(c)]))
    return int(_mix(h)[0])


def _padded(length: np.ndarray) -> np.ndarray:
    """Units are grouped by length, longer ones by a few lengths that they are padded to."""
    wide = np.maximum(length, 1)
    step = (1 << np.maximum(np.floor(np.log2(wide)).astype(np.int64) - 2, 0)).astype(np.int64)
    return np.where(length <= 16, length, -(-length // step) * step)


def encode(texts: list[str], keys: list[int], vocabulary: Vocabulary) -> list[np.ndarray]:
    """Ids of one sampled segmentation for each text."""
    out: list[list[np.ndarray]] = [[] for _ in texts]
    codes = [np.frombuffer((" " + t).encode("utf-32-le"), "<u4") for t in texts]  # with the model's dummy prefix
    batch, size = [], 0
    for i, c in enumerate(codes):
        c = np.where(c == MARK, LITERAL, c).astype(np.int32)
        if len(c):
            c[0] = SPACE
        c = np.where(c == SPACE, MARK, c).astype(np.int32)
        before = np.concatenate([[NEWLINE], c[:-1]])
        starts = np.flatnonzero(((c == MARK) & (before != MARK)) | (c == NEWLINE) | (before == NEWLINE))
        ends = np.append(starts[1:], len(c))
        number = 0
        while number < len(starts):
            room = max(1, SLICE - size)
            last = max(number + 1, int(np.searchsorted(ends, starts[number] + room, side="right")))
            batch.append((i, number, c[starts[number] : ends[last - 1]], starts[number:last] - starts[number], ends[number:last] - starts[number]))
            size += int(ends[last - 1] - starts[number])
            number = last
            if size >= SLICE:
                _encode_slice(batch, keys, vocabulary, out)
                batch, size = [], 0
    _encode_slice(batch, keys, vocabulary, out)
    return [np.concatenate(x) if x else np.zeros(0, np.int32) for x in out]


def _encode_slice(batch: list, keys: list[int], v: Vocabulary, out: list) -> None:
    if not batch:
        return
    base = np.cumsum([0] + [len(b[2]) for b in batch])
    chars = np.concatenate([b[2] for b in batch])
    starts = np.concatenate([b[3] + o for b, o in zip(batch, base, strict=False)])
    length = np.concatenate([b[4] - b[3] for b in batch])
    seed = np.concatenate([_mix(np.uint64(keys[b[0]]) + np.arange(b[1], b[1] + len(b[3]), dtype=np.uint64) * _M) for b in batch])
    wide = _padded(length)
    pieces: list[np.ndarray] = []  # unit, place from the unit's end, id
    count = np.zeros(len(starts), np.int64)
    order = np.argsort(wide, kind="stable")
    for group in np.split(order, np.flatnonzero(np.diff(wide[order])) + 1):
        for part in np.array_split(group, min(len(group), max(1, len(group) * int(wide[group[0]]) // SLICE))):
            pieces += _sample(part, chars, starts[part], length[part], int(wide[part[0]]), seed[part], v, count)
    unit, back, ids = (np.concatenate([p[k] for p in pieces]) for k in range(3))
    at = np.concatenate([[0], np.cumsum(count)])
    flat = np.empty(at[-1], np.int32)
    flat[at[unit] + count[unit] - 1 - back] = ids
    first = np.cumsum([0] + [len(b[3]) for b in batch])
    for b, lo, hi in zip(batch, first[:-1], first[1:], strict=True):
        out[b[0]].append(flat[at[lo] : at[hi]])


def _sample(units, chars, starts, length, wide, seed, v: Vocabulary, count) -> list:
    place = starts + np.arange(wide)[:, None]
    text = np.where(np.arange(wide)[:, None] < length, chars[np.minimum(place, len(chars) - 1)], PAD)
    h = np.zeros(len(units), np.uint64)
    for j in range(wide):
        h = _step(h, text[j])
    _, first, same = np.unique(h, return_index=True, return_inverse=True)
    distinct = text[:, first]
    if not np.array_equal(text, distinct[:, same]):  # two units with one hash
        same, distinct = np.arange(len(units)), text
    m = distinct.shape[1]
    piece = _pieces(distinct, v)
    longest = len(piece)
    # Weights at -2 are for bytes, at -1 for nothing. Every segmentation of a unit has the same length, so a factor for
    # each character changes nothing; with it, units of up to LINEAR characters stay inside a double without logarithms.
    weights = np.append(v.weights, [v.byte_weight, -np.inf])
    linear = wide <= LINEAR
    forward = np.full((wide + 1, m), 0.0 if linear else -np.inf)
    forward[0] = 1.0 if linear else 0.0
    by_length = [np.exp(weights + TILT * n) for n in range(longest + 1)] if linear else None
    for j in range(1, wide + 1):
        total = forward[j]
        if linear:
            np.multiply(forward[j - 1], by_length[1][piece[0][j - 1]], out=total)
        else:
            total[:] = forward[j - 1] + weights[piece[0][j - 1]]
        for n in range(2, min(j, longest) + 1):
            p = piece[n - 1][j - n]
            some = np.flatnonzero(p >= 0)
            if len(some):
                if linear:
                    total[some] += forward[j - n, some] * by_length[n][p[some]]
                else:
                    total[some] = np.logaddexp(total[some], forward[j - n, some] + weights[p[some]])
    out, rows, end, back = [], np.arange(len(units)), length.copy(), np.zeros(len(units), np.int64)
    while len(rows):
        d, e = same[rows], end[rows]
        u = (_mix(seed[rows] + e.astype(np.uint64)) >> np.uint64(11)).astype(np.float64) * 2.0**-53
        whole_mass = forward[e, d]
        goal = u * whole_mass if linear else u
        chosen, took = np.full(len(rows), -1, np.int32), np.zeros(len(rows), np.int64)
        open_, run = np.arange(len(rows)), np.zeros(len(rows))
        for n in range(1, longest + 1):
            if n > 1:
                open_ = open_[e[open_] >= n]
            if not len(open_):
                break
            p = piece[n - 1][e[open_] - n, d[open_]]
            real = np.flatnonzero(p != -1)
            fits = open_[real]
            chosen[fits], took[fits] = p[real], n  # the last one stands if rounding leaves a gap
            before = forward[e[fits] - n, d[fits]]
            run[fits] += before * by_length[n][p[real]] if linear else np.exp(before + weights[p[real]] - whole_mass[fits])
            open_ = open_[run[open_] <= goal[open_]]
        spelt = chosen == -2
        whole = rows[~spelt]
        out.append((units[whole], back[whole], v.ids[chosen[~spelt]]))
        back[whole] += 1
        if spelt.any():
            some = rows[spelt]
            for value, present in _utf8_backwards(distinct[e[spelt] - 1, d[spelt]]):
                out.append((units[some[present]], back[some[present]], v.byte_ids[value[present]]))
                back[some[present]] += 1
        end[rows] -= took
        rows = rows[end[rows] > 0]
    count[units] = back
    return out


def _pieces(distinct: np.ndarray, v: Vocabulary) -> list[np.ndarray]:
    """[n - 1][i]: for each unit, the piece of length n that starts at i; -1 none, -2 a character to spell in bytes."""
    wide, m = distinct.shape
    flat = distinct.ravel()
    at, h, piece = np.arange(flat.size), np.zeros(flat.size, np.uint64), []
    for n in range(1, min(wide, v.longest) + 1):
        h = _step(h, flat[at + (n - 1) * m])
        known, number = v.look_up(h)
        made = np.full((wide - n + 1) * m, -1, np.int32)
        made[at] = number
        piece.append(made.reshape(-1, m))
        more = known & (at < (wide - n) * m)
        at, h = at[more], h[more]
        if not len(at):
            break
    piece[0][piece[0] < 0] = -2
    return piece


def _utf8_backwards(code: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The bytes of each code point, last byte first: (value, present)."""
    code = np.where(code == LITERAL, MARK, code)
    n = 1 + (code >= 0x80) + (code >= 0x800) + (code >= 0x10000)
    lead = np.array([0, 0, 0xC0, 0xE0, 0xF0])[n]
    for k in range(4):
        tail = 0x80 | ((code >> (6 * k)) & 0x3F)
        yield np.where(k == n - 1, lead | (code >> (6 * k)), tail).astype(np.int64) & 0xFF, n > k


def decode(ids: np.ndarray | list[int], vocabulary: Vocabulary) -> str:
    return b"".join([vocabulary.pieces[i] for i in ids]).decode()[1:]


def _read(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def encode_pieces(docs: DataFrame, model_path: str = MODEL, alpha: float = 1.0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, n_chars, n_pieces, ids array<int>, lossless boolean (the ids decode to the text).

    alpha sharpens (> 1) or flattens (< 1) the distribution over segmentations. The model file
    is read on the driver and sent along with the task, so executors need no copy of it. Null or
    empty text has no piece but the dummy prefix, which decoding takes off again. Rows with
    equal id and text get equal ids; null ids have the key of the string "None". Other columns
    are ignored; an empty table gives no rows.
    """
    small_batches(docs.sparkSession)
    model = docs.sparkSession.sparkContext.broadcast(_read(model_path))  # one vocabulary file
    schema = "id string, n_chars long, n_pieces long, ids array<int>, lossless boolean"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        v = load(model.value, alpha)
        for batch in batches:
            texts = list(batch["text"])
            got = encode(texts, [row_key(i) for i in batch["id"]], v)
            yield pd.DataFrame({"id": batch["id"], "n_chars": [len(t) for t in texts], "n_pieces": [len(g) for g in got], "ids": got, "lossless": [decode(g.tolist(), v) == t for g, t in zip(got, texts, strict=True)]})

    kind = docs.schema[id_col].dataType
    rows = docs.select(F.col(id_col).cast("string").alias("id"), text_or_empty(text_col).alias("text")).mapInPandas(trimmed(run), schema)
    return rows.select(F.col("id").cast(kind).alias(id_col), "n_chars", "n_pieces", "ids", "lossless")


def decode_pieces(encoded: DataFrame, model_path: str = MODEL, ids_col: str = "ids") -> DataFrame:
    """Adds text to rows of ids; null ids give null."""
    small_batches(encoded.sparkSession)
    model = encoded.sparkSession.sparkContext.broadcast(_read(model_path))

    @F.pandas_udf(T.StringType())
    def read(ids: pd.Series) -> pd.Series:
        v = load(model.value, 1.0)
        return pd.Series([None if x is None else decode(x, v) for x in ids], dtype=object)

    return encoded.withColumn("text", read(F.col(ids_col)))
