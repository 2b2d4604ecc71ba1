import random
import zlib

import duckdb
import pandas as pd
from pyspark.sql import functions as F

from tessella.llm.oracle import oracle_sql
from tessella.llm.queries import queries
from tessella.llm.spelling import keys, removals, runs_of_letters, spelling_variants, variants, word_counts


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    if len(a) > len(b):
        a, b = b, a
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(counts, ratio=10):
    forms, out = {}, {}
    for w, n in counts.items():
        near = [x for x in counts if x != w and one_edit(w, x)]
        best = min(near, key=lambda x: (-counts[x], x), default=None)
        forms[w] = best if best is not None and counts[best] >= ratio * n else None
        out[w] = len(near)
    def root(w):
        while forms[w] is not None:
            w = forms[w]
        return w
    return {w: (forms[w], root(w), n, out[w], counts.get(forms[w])) for w, n in counts.items()}


def found(df):
    rows = df.collect()
    assert len(rows) == len({r.word for r in rows})
    return {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in rows}


def test_variants_against_brute_force(spark):
    rng = random.Random(1)
    words = {"".join(rng.choice("abç") for _ in range(rng.choice([5, 6, 7]))) for _ in range(400)}
    words |= {"a" * k for k in range(1, 30)} | {"", "z", "zz", "𝒜bc", "𝒜c"}  # runs of one letter, an empty word, letters beyond two bytes
    counts = {w: rng.choice([2, 5, 20, 50, 200, 2000]) for w in sorted(words)}
    rows = [(w, n, "x") for w, n in counts.items()]
    got = found(variants(spark.createDataFrame([*rows, (None, 3, "x"), ("left", None, "x")], "word string, n long, wid string")))
    want = brute(counts)
    assert got == want
    assert sum(v[0] is not None and v[0] != v[1] for v in want.values()) > 10  # chains of forms


def test_whole_query_on_odd_rows(spark):
    rng = random.Random(2)
    base = ["edition", "éditions", "language", "straßen", "abcdefgh", "Abcdefgi"]
    texts = [" ".join(rng.choice(base) for _ in range(rng.randint(1, 60))) for _ in range(120)]
    rows = [(k, t, 1) for k, t in enumerate(texts)] + [(None, "language language", 1), (5, texts[5], 1), (200, None, 1), (201, "", 1), (202, "ab cd ×× 1234567", 1), (203, "q" * 300_000 + "7" + "q" * 300_000, 1), (204, "sevenes sevenes", 1)]
    counts = {}
    for d, t, _ in rows:
        run = ""
        for c in (t or "") + " ":
            if c.isascii() and c.isalpha() or "À" <= c <= "ÿ":
                run += chr(ord(c) + 32) if "A" <= c <= "Z" else c
                continue
            if run:
                h = zlib.crc32(f"{'' if d is None else d}:{run}".encode())
                w = run[: h % len(run)] + run[h % len(run) + 1 :] if h % 31 == 0 else run
                if len(w) >= 7:
                    counts[w] = counts.get(w, 0) + 1
            run = ""
    counts = {w: n for w, n in counts.items() if n >= 2}
    assert found(spelling_variants(spark.createDataFrame(rows, "doc_id long, text string, word int"))) == brute(counts)
    assert any(len(w) == 300_000 for w in counts)


def test_keys_of_rests_are_the_keys_of_words():
    words = pd.Series(["ab", "aab", "éa", "x" * 50])
    word, place, rest, turned, last = removals(words)
    left = [words[w][:i] + words[w][i + 1 :] for w, i in zip(word, place, strict=True)]
    a, o = keys(pd.Series(left))
    assert (a == rest).all() and (o == turned).all()
    assert [bool(x) for x in last[2:5]] == [False, True, True]


def test_empty_table(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert spelling_variants(none).count() == 0
    assert runs_of_letters(none).count() == 0 and word_counts(runs_of_letters(none)).count() == 0


def test_query_against_sql(spark, sf_dir):
    duckdb.sql(f"CREATE OR REPLACE VIEW documents AS SELECT * FROM '{sf_dir}/documents.parquet'")
    want = {r[0]: r[1:] for r in duckdb.sql("SELECT word, form, root, n, n_near, form_n FROM (" + oracle_sql()["op13_anagram_variants"] + ")").fetchall()}
    got = queries()["op13_anagram_variants"](spark, sf_dir)
    assert got.where(F.col("form").isNotNull()).count() > 0
    assert found(got) == want
