import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.llm.elias_fano import EliasFano, Trie, quantise
from tessella.llm.lm_scoring import DISCOUNT, END, START, Chunk, score_texts, tokenise
from tessella.llm.queries import queries

HELD = "crc32(coalesce(cast(doc_id AS string), '')) % 7 = 2"


def words(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return [w for w in re.split(r"[\x20\x09-\x0D]+", low) if w]


def held(i):
    return zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2


def brute(rows, rule=held):
    one, pair, follow = Counter(), Counter(), Counter()
    texts = [(i, rule(i), ["<s>", *words(t), "</s>"]) for i, t in rows]
    for _, out, w in texts:
        if not out:
            one.update(w[1:])
            pair.update(zip(w, w[1:], strict=False))
    total = Counter()
    for (v, _), n in pair.items():
        total[v] += n
        follow[v] += 1
    n_all, v_all = sum(one.values()), len(one)
    p1 = lambda w: (one[w] + 1) / (n_all + v_all + 1)
    def p2(v, w):
        if not total[v]:
            return p1(w)
        return max(pair[v, w] - DISCOUNT, 0) / total[v] + DISCOUNT * follow[v] / total[v] * p1(w)
    out = [(i, h, len(w) - 1, sum(one[x] > 0 for x in w[1:]), n_all, sum(math.log10(p1(x)) for x in w[1:]), sum(math.log10(p2(v, x)) for v, x in zip(w, w[1:], strict=False))) for i, h, w in texts]
    return out, p1, p2, one


def check(df, want, loose):
    assert df.columns == ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    key = lambda r: (r[0] is None, r[0] or 0, r[2], r[5])
    got, want = sorted(map(tuple, df.collect()), key=key), sorted(want, key=key)
    assert [g[:5] for g in got] == [w[:5] for w in want]
    assert np.allclose([g[5] for g in got], [w[5] for w in want], rtol=1e-9)
    for g, w in zip(got, want, strict=True):
        assert abs(g[6] - w[6]) <= loose * w[2]  # half a bin of log10 for each token


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    vocabulary = [f"w{k}" for k in range(300)] + ["Über", "é"]
    pick = lambda n: " ".join(vocabulary[int(rng.paretovariate(0.5)) % len(vocabulary)] for _ in range(n))
    out = [(k, pick(rng.randint(1, 60))) for k in range(300)]
    out += [(400 + k, "the common pair\tstands here\nhere The common PAIR " * 10) for k in range(50)]
    return [*out, (500, None), (501, ""), (502, " \n\x0b "), (503, "x"), (503, "x"), (None, "w1 w2"), (504, "w1 " * 20_000), (505, "z" * 3_000_000 + " w1"), (506, "one word here")]


def test_scores_against_brute_force(spark, rows):
    df = spark.createDataFrame([(i, t, 1.0) for i, t in rows], "doc_id long, text string, score double")
    want, p1, p2, one = brute(rows)
    check(score_texts(df, F.expr(HELD)), want, 0.012)
    # Many chunks, many shards, hot contexts dealt out over shards: the same counts.
    check(score_texts(df, F.expr(HELD), chunk=3000, shard=500, part=60), want, 0.012)
    known = sum(p2("the", w) for w in one)
    assert abs(known + p2("the", "never seen") - 1) < 1e-9


def test_empty_tables_and_no_training_rows(spark):
    schema = "doc_id long, text string"
    assert score_texts(spark.createDataFrame([], schema), F.expr(HELD)).count() == 0
    rows = [(1, "a b"), (2, None)]
    check(score_texts(spark.createDataFrame(rows, schema), F.lit(True)), brute(rows, lambda i: True)[0], 1e-9)


def test_tokens_of_slices_are_those_of_the_whole():
    texts = ["", "A b", "", "longer words here", "x" * 3_000_000, "end ", ""]
    body = "".join(texts).encode()
    offsets = np.cumsum([0, *(len(t.encode()) for t in texts)])
    h, n = tokenise(np.frombuffer(body, np.uint8), offsets)
    assert n.tolist() == [len(t.split()) for t in texts]
    again = [tokenise(np.frombuffer(w.encode(), np.uint8), np.array([0, len(w)]))[0][0] for t in texts for w in t.lower().split()]
    assert h.tolist() == [int(x) for x in again] and len(set(h.tolist())) == len(h)
    c = Chunk.of(h, n, np.array([True, False, True, True, False, True, True]))
    back = Chunk.unpack(c.pack())
    assert (back.words == c.words).all() and (back.tokens == c.tokens).all() and (back.sizes == c.sizes).all() and (back.trains == c.trains).all()
    assert END in c.words and START not in c.words


def test_elias_fano_access_and_successors():
    rng = np.random.default_rng(0)
    for values in ([], [0], [5], [2**64 - 1], [0, 0, 1, 1, 1], sorted(rng.integers(0, 1000, 500)), sorted(rng.integers(0, 2**63, 3000)), [3] * 200, list(range(200)), [0] + [2**63] * 3):
        v = np.array(values, np.uint64)
        e = EliasFano.of(v)
        assert (e.access(np.arange(len(v))) == v).all()
        q = np.concatenate([v, v + np.uint64(1), rng.integers(0, 2000, 100).astype(np.uint64), np.array([0, 2**64 - 1], np.uint64)])
        assert (e.successor(q) == np.searchsorted(v, q)).all()


def test_trie_lookup_mapped_from_files(tmp_path):
    rng = np.random.default_rng(1)
    pairs = np.unique(np.stack([rng.integers(0, 500, 20_000), rng.integers(0, 3000, 20_000) ** 2], axis=1), axis=0).astype(np.uint64)
    log_p = -5 * rng.random(len(pairs))
    Trie.build(pairs[:, 0], pairs[:, 1], log_p).save(str(tmp_path))
    trie = Trie.open(str(tmp_path))
    assert isinstance(trie.levels["successors"].low, np.memmap)
    held = {(int(a), int(b)): x for (a, b), x in zip(pairs, log_p, strict=True)}
    ask = np.concatenate([pairs, np.stack([rng.integers(0, 600, 5000), rng.integers(0, 3000, 5000) ** 2], axis=1).astype(np.uint64)])
    codes = trie.lookup(ask[:, 0], ask[:, 1])
    for (a, b), code in zip(ask.tolist(), codes.tolist(), strict=True):
        assert (code > 0) == ((a, b) in held)
        assert not code or abs(trie.book[code] - held[a, b]) < 0.05
    assert sum(a.nbytes for a in trie.arrays().values()) < 4 * len(pairs)


def test_few_values_are_quantised_without_loss():
    values = np.log10(np.arange(1, 200) / 200)
    codes, book = quantise(values)
    assert np.allclose(book[codes], values, rtol=1e-12)


def test_query_on_the_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    want = brute([(r.doc_id, r.text) for r in docs])[0]
    got = queries()["op12_elias_fano_trie"](spark, sf_dir)
    check(got, want, 0.012)
    held_out = got.where("held_out").agg(F.sum("score"), F.sum("base_score")).first()
    assert held_out[0] > held_out[1]
