"""Language-model scoring with an Elias-Fano trie of word pairs, sharded by context.

The model is p(w | v) = max(c(vw) - D, 0) / c(v) + D * s(v) / c(v) * p(w), with s(v) the number of
different successors of v and p(w) = (c(w) + 1) / (N + V + 1): absolute discounting, interpolated
with the add-one unigrams, so that it sums to one over the known words and one unknown word. A text
starts behind a start mark and closes with an end mark, which counts as a token. Discounted pair
probabilities stand in the trie as 8-bit codes; counts of single words stay exact.

Words are told apart by a 64-bit hash, successors within a shard by 48 bits of it.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.llm._base import text_or_empty, written
from tessella.llm.elias_fano import Trie

DISCOUNT = 0.75
#: Bytes of text that are tokenised and counted together.
CHUNK = 5 << 20
#: Bytes that are hashed at once.
SLICE = 1 << 20
#: Training tokens for each shard of the trie, on average.
SHARD = 1 << 20
#: Occurrences beyond which a context is dealt out over shards by its successors; contexts beyond N / HOT at most.
PART = 1 << 20
HOT = 100_000
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_48 = np.uint64(16)
#: Hashes of the end of a text (a token) and of its start (a context only).
END, START = np.uint64(0x5851F42D4C957F2D), np.uint64(0x14057B7EF767814F)


def _mix(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
        x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
        return x ^ (x >> np.uint64(33))


class _Powers:
    """Powers of the hash's base and of its inverse, as many as were asked for."""

    up = down = np.ones(1, np.uint64)

    @classmethod
    def to(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n:
            for name, base in (("up", _BASE), ("down", _INVERSE)):
                a = np.full(n, base, np.uint64)
                a[0] = 1
                setattr(cls, name, np.cumprod(a))
        return cls.up[:n], cls.down[:n]


def word_hashes(text: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word, its first byte) of a byte array that holds texts from the given starts on; A-Z are lower-cased."""
    if not len(text):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    black = ~_SPACE[text]
    edge = np.zeros(len(text) + 1, bool)
    edge[starts] = True
    edge[[0, -1]] = True
    first = np.flatnonzero(black & (edge[:-1] | ~np.concatenate([[False], black[:-1]])))
    last = np.flatnonzero(black & (edge[1:] | ~np.concatenate([black[1:], [False]]))) + 1
    up, down = _Powers.to(len(text))
    with np.errstate(over="ignore"):
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((_LOWER[text].astype(np.uint64) + np.uint64(1)) * up)])
        h = (sums[last] - sums[first]) * down[first] + (last - first).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    return _mix(h), first


def tokenise(text: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all words, number of words by text); text i lies between offsets i and i + 1. Long inputs go in slices that end at white space."""
    hashes, counts = [], np.zeros(len(offsets) - 1, np.int64)
    at = 0
    while at < len(text):
        end = min(len(text), at + SLICE)
        while end < len(text) and not _SPACE[text[end]]:
            more = np.flatnonzero(_SPACE[text[end : end + SLICE]])
            end = end + int(more[0]) if len(more) else min(len(text), end + SLICE)
        inside = offsets[(offsets >= at) & (offsets < end)] - at
        h, first = word_hashes(text[at:end], inside)
        hashes.append(h)
        counts += np.bincount(np.searchsorted(offsets, first + at, side="right") - 1, minlength=len(counts))[: len(counts)]
        at = end
    return (np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)), counts


@dataclass
class Chunk:
    """Tokenised texts: words by falling frequency, tokens as numbers of words (each text closed by its end), tokens of each text, whether it trains."""

    words: np.ndarray
    tokens: np.ndarray
    sizes: np.ndarray
    trains: np.ndarray

    @classmethod
    def of(cls, hashes: np.ndarray, counts: np.ndarray, trains: np.ndarray) -> Chunk:
        sizes = counts + 1
        seq = np.full(int(sizes.sum()), END, np.uint64)
        inner = np.ones(len(seq), bool)
        inner[np.cumsum(sizes) - 1] = False
        seq[inner] = hashes
        words, number, many = np.unique(seq, return_inverse=True, return_counts=True)
        order = np.argsort(-many, kind="stable")
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        return cls(words[order], place[number], sizes, trains)

    def pack(self) -> dict[str, bytes]:
        """Numbers of words go as three planes of bytes, of which the upper ones compress well."""
        t = self.tokens.astype("<u4").view(np.uint8).reshape(-1, 4)
        return {"words": self.words.astype("<u8").tobytes(), "tokens": t[:, 0].tobytes() + zlib.compress(t[:, 1:].T.tobytes(), 1), "sizes": self.sizes.astype("<i4").tobytes(), "trains": self.trains.astype(np.uint8).tobytes()}

    @classmethod
    def unpack(cls, row: pd.Series) -> Chunk:
        sizes = np.frombuffer(row["sizes"], "<i4").astype(np.int64)
        n = int(sizes.sum())
        t = np.zeros((n, 4), np.uint8)
        t[:, 0] = np.frombuffer(row["tokens"], np.uint8, n)
        t[:, 1:] = np.frombuffer(zlib.decompress(row["tokens"][n:]), np.uint8).reshape(3, n).T
        return cls(np.frombuffer(row["words"], "<u8"), t.view("<u4")[:, 0].astype(np.int64), sizes, np.frombuffer(row["trains"], np.uint8).astype(bool))

    def pairs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Distinct (context, word) by number, how often they train, and the pair of each token; context len(words) is the start."""
        n = len(self.words)
        context = np.empty(len(self.tokens), np.int64)
        context[1:] = self.tokens[:-1]
        context[np.cumsum(self.sizes) - self.sizes] = n
        key, of = np.unique(context * n + self.tokens, return_inverse=True)
        train = np.bincount(of, np.repeat(self.trains, self.sizes), len(key)).astype(np.int64)
        return key // n, key % n, train, of

    def shards(self, context: np.ndarray, word: np.ndarray, hot: dict[int, int], shards: int, part: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Shard of each pair; and (context, shard) of all parts of the hot contexts that occur here."""
        names = np.append(self.words, START)
        parts = np.ones(len(names), np.int64)
        for k in np.flatnonzero(np.isin(names, np.array(list(hot), np.uint64))) if hot else ():
            parts[k] = -(-hot[int(names[k])] // part)
        place = lambda c, p: (_mix(names[c] + _mix(p.astype(np.uint64))) % np.uint64(shards)).astype(np.int64)
        split = parts[context] > 1
        own = np.zeros(len(context), np.int64)
        own[split] = (self.words[word[split]] % parts[context[split]].astype(np.uint64)).astype(np.int64)
        many = np.unique(context[split])
        all_c = np.repeat(many, parts[many])
        all_p = np.concatenate([np.arange(p) for p in parts[many]]) if len(many) else all_c
        both = np.unique(np.stack([all_c, place(all_c, all_p)], axis=1), axis=0) if len(all_c) else np.zeros((0, 2), np.int64)
        return place(context, own), both[:, 0], both[:, 1]


def _requests(chunk: Chunk, hot: dict[int, int], shards: int, part: int):
    """(shard, contexts, pairs of each, pairs by number) of each shard, hot contexts without a pair there included."""
    context, word, train, of = chunk.pairs()
    shard, extra_c, extra_s = chunk.shards(context, word, hot, shards, part)
    order = np.argsort(shard, kind="stable")  # pairs stand by context and word
    wide = len(chunk.words) + 1
    key = shard[order] * wide + context[order]
    first = np.flatnonzero(np.diff(key, prepend=-1))
    heads, many = key[first], np.diff(np.append(first, len(key)))
    if len(extra_c):
        bare = np.setdiff1d(extra_s * wide + extra_c, heads)
        heads, many = np.concatenate([heads, bare]), np.concatenate([many, np.zeros(len(bare), np.int64)])
        by = np.argsort(heads, kind="stable")
        heads, many = heads[by], many[by]
    bounds = np.append(np.flatnonzero(np.diff(heads // wide, prepend=-1)), len(heads))
    begin = np.concatenate([[0], np.cumsum(many)])
    for a, b in zip(bounds[:-1], bounds[1:], strict=True):
        yield int(heads[a] // wide), heads[a:b] % wide, many[a:b], order[begin[a] : begin[b]], word, train, of


def train_shard(heads: np.ndarray, many: np.ndarray, word: np.ndarray, train: np.ndarray, hot: dict[int, int], discount: float = DISCOUNT) -> tuple[Trie, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(trie, code of each pair, contexts, count of each, successors of each) from runs of pairs by context.

    heads and many: the context of each run and its number of pairs; word, train: the pairs, of which
    the repeated ones are summed up.
    """
    contexts, at = np.unique(heads, return_inverse=True)
    words, rank = np.unique(word, return_inverse=True)
    key, back = np.unique(np.repeat(at, many) * len(words) + rank, return_inverse=True)
    total = np.bincount(back, train, len(key)).astype(np.int64)
    c, w = key // max(len(words), 1), key % max(len(words), 1)
    seen = total > 0
    count, successors = (np.bincount(c[seen], x, len(contexts)).astype(np.int64) for x in (total[seen], None))
    for k in np.flatnonzero(np.isin(contexts, np.array(list(hot), np.uint64))) if hot else ():
        count[k] = hot[int(contexts[k])]
    log_p = np.log10((total[seen] - discount) / count[c[seen]]) if seen.any() else np.zeros(0)
    trie = Trie.build(contexts[c[seen]], words[w[seen]], log_p)
    return trie, trie.lookup(contexts[c], words[w])[back], contexts, count, successors


def score_texts(docs: DataFrame, held_out: Column, discount: float = DISCOUNT, chunk: int = CHUNK, shard: int = SHARD, part: int = PART, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    The model learns from the rows where held_out is false and scores all. base_score is the sum of
    log10((c + 1) / (N + V + 1)) over the tokens, score the trie model's log10 probability.

    1. Texts are tokenised in bulk and written as chunks of numbers, once.
    2. Word counts of the chunks are summed up: N, V and the contexts that occur more than `part`
       times, of which there are at most HOT (they are broadcast).
    3. Each chunk asks for its distinct pairs, with their training counts, at the shards of their
       contexts. A shard sums the counts of all chunks, builds its trie and answers each chunk by a
       code for each pair, and count and number of successors for each context. A hot context is
       dealt out over shards by its successors; the chunks sum up its parts. A pair of many
       occurrences is one entry of each chunk, so no shard holds what one pair or context has.
    4. Chunk and answers meet again, and texts are scored where their tokens lie.

    docs is read once. Null texts are empty: their end is their only token. A null id is kept (whether
    it trains is for held_out to say; null counts as false). Repeated rows count as often as they
    stand there. Without training rows, all probabilities are those of the unknown word; an empty
    table gives no rows; other columns are ignored.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(held_out, F.lit(False)).alias("held_out"), text_or_empty(text_col).alias("text"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        held: list[tuple] = []
        size = no = 0

        def close() -> pa.RecordBatch:
            nonlocal held, size, no
            ids, outs, hashes, counts = zip(*held, strict=True)
            outs = pa.concat_arrays(outs)
            packed = Chunk.of(np.concatenate(hashes), np.concatenate(counts), ~outs.to_numpy(zero_copy_only=False).astype(bool)).pack()
            sink = pa.concat_arrays(ids)
            known = sink.is_valid().to_numpy(zero_copy_only=False).astype(np.uint8)
            row = {"chunk": (TaskContext.get().partitionId() << 33) + no, "ids": sink.fill_null(0).to_numpy().astype("<i8").tobytes(), "known": known.tobytes()} | packed
            held, size, no = [], 0, no + 1
            return pa.RecordBatch.from_pylist([row], schema=chunk_type)

        for batch in batches:
            text = batch.column("text").cast(pa.large_binary())
            offsets = np.frombuffer(text.buffers()[1], "<i8")[text.offset : text.offset + len(text) + 1]
            body = np.frombuffer(text.buffers()[2] or b"", np.uint8)
            a = 0
            while a < len(text):
                b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + chunk, side="right")) - 1)
                h, n = tokenise(body[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                held.append((batch.column("doc_id").slice(a, b - a), batch.column("held_out").slice(a, b - a), h, n))
                size += int(offsets[b] - offsets[a])
                a = b
                if size >= chunk:
                    yield close()
        if held:
            yield close()

    columns = "chunk long, ids binary, known binary, words binary, tokens binary, sizes binary, trains binary"
    chunk_type = pa.schema([(c.split()[0], pa.int64() if c.endswith("long") else pa.binary()) for c in columns.split(", ")])
    chunks = written(rows.mapInArrow(read, columns))

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for _, row in batch.iterrows():
                c = Chunk.unpack(row)
                n = np.bincount(c.tokens, np.repeat(c.trains, c.sizes), len(c.words)).astype(np.int64)
                yield pd.DataFrame({"word": c.words.view("<i8")[n > 0], "n": n[n > 0]})

    totals = chunks.mapInPandas(count, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))
    totals = written(totals)
    n_all, v_all = totals.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    part = max(part, -(-n_all // HOT))
    hot = {r["word"] % (1 << 64): r["n"] for r in totals.where(F.col("n") > part).collect()}  # at most HOT of them
    ends = totals.where(F.col("word") == int(END.astype(np.int64))).first()
    ends = ends["n"] if ends else 0
    if ends > part:
        hot[int(START)] = ends
    shards = max(1, -(-n_all // shard))
    sent = spark.sparkContext.broadcast(hot)

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for _, row in batch.iterrows():
                c = Chunk.unpack(row)
                names = np.append(c.words, START)
                out = []
                for s, heads, many, pairs, word, train, _ in _requests(c, sent.value, shards, part):
                    w = (c.words[word[pairs]] >> _48).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]
                    out.append({"chunk": row["chunk"], "shard": s, "heads": names[heads].astype("<u8").tobytes(), "many": zlib.compress(many.astype("<u4").tobytes(), 1), "next": w.tobytes(), "train": zlib.compress(train[pairs].astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes(), 1)})
                    if len(out) == 256:
                        yield pd.DataFrame(out)
                        out = []
                if out:
                    yield pd.DataFrame(out)

    def answer(part_rows: pd.DataFrame) -> pd.DataFrame:
        heads = [np.frombuffer(x, "<u8") for x in part_rows["heads"]]
        many = [np.frombuffer(zlib.decompress(x), "<u4") for x in part_rows["many"]]
        ends = np.cumsum([int(m.sum()) for m in many])
        w = np.zeros((int(ends[-1]), 8), np.uint8)
        w[:, :6] = np.frombuffer(b"".join(part_rows["next"]), np.uint8).reshape(-1, 6)
        word = w.view("<u8")[:, 0]
        train = np.concatenate([np.ascontiguousarray(np.frombuffer(zlib.decompress(x), np.uint8).reshape(4, -1).T).view("<u4")[:, 0] for x in part_rows["train"]]).astype(np.int64)
        asked = np.concatenate(heads)
        trie, codes, contexts, count, successors = train_shard(asked, np.concatenate(many), word, train, sent.value, discount)
        head_ends = np.cumsum([len(h) for h in heads])
        at = np.searchsorted(contexts, asked)
        c, s = count[at], successors[at]
        cut = lambda x, e: [p.tobytes() for p in np.split(x, e[:-1])]
        return pd.DataFrame({"chunk": part_rows["chunk"], "shard": part_rows["shard"], "codes": cut(codes, ends), "counts": cut(c.astype("<i8"), head_ends), "successors": cut(s.astype("<i4"), head_ends), "book": trie.book.astype("<f8").tobytes()})

    asked = chunks.mapInPandas(ask, "chunk long, shard long, heads binary, many binary, next binary, train binary")
    answers = asked.groupBy("shard").applyInPandas(answer, "chunk long, shard long, codes binary, counts binary, successors binary, book binary")

    def score(mine: pd.DataFrame, told: pd.DataFrame) -> pd.DataFrame:
        out = []
        told = {int(r["shard"]): r for _, r in told.iterrows()}
        for _, row in mine.iterrows():
            c = Chunk.unpack(row)
            n = len(c.words)
            count, spread = np.zeros(n + 1, np.int64), np.zeros(n + 1, np.int64)
            direct = of = word = None
            for s, heads, _, pairs, word, _, of in _requests(c, sent.value, shards, part):
                if direct is None:
                    direct = np.zeros(len(word))
                a = told[s]
                code = np.frombuffer(a["codes"], np.uint8)
                book = np.frombuffer(a["book"], "<f8")
                direct[pairs] = np.where(code > 0, 10.0 ** book[code], 0.0)
                count[heads] = np.maximum(count[heads], np.frombuffer(a["counts"], "<i8"))
                spread[heads] += np.frombuffer(a["successors"], "<i4")
            names = np.append(c.words, START)
            for k in np.flatnonzero(np.isin(names, np.array(list(sent.value), np.uint64))) if sent.value else ():
                count[k] = sent.value[int(names[k])]
            single = count[:n].copy()
            single[c.words == END] = ends
            p1 = (single + 1) / (n_all + v_all + 1)
            context = np.empty(len(c.tokens), np.int64)
            context[1:] = c.tokens[:-1]
            context[np.cumsum(c.sizes) - c.sizes] = n
            spare = np.where(count > 0, discount * spread / np.maximum(count, 1), 1.0)
            p = direct[of] + spare[context] * p1[c.tokens]
            first = np.cumsum(c.sizes) - c.sizes
            add = lambda x, first=first: np.add.reduceat(x, first)
            ids = pd.array(np.frombuffer(row["ids"], "<i8"), dtype="Int64")
            ids[~np.frombuffer(row["known"], np.uint8).astype(bool)] = pd.NA
            out.append(pd.DataFrame({"doc_id": ids, "held_out": ~c.trains, "n_tokens": c.sizes, "n_known": add((single > 0)[c.tokens].astype(np.int64)), "train_tokens": n_all, "base_score": add(np.log10(p1)[c.tokens]), "score": add(np.log10(p))}))
        return pd.concat(out) if out else pd.DataFrame({k: [] for k in ("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")})

    return chunks.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInPandas(score, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
