import duckdb
import numpy as np

from tessella.llm.hard_negatives import Piece, augment, fit_tree, mine_negatives, ranges, route
from tessella.llm.oracle import oracle_sql
from tessella.llm.queries import queries

COLUMNS = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]


def brute(rows, every, k=5):
    kept = [(i, y, [int(np.floor(256 * x)) for x in v]) for i, v, y in rows if i is not None and y is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for a, (i, y, q) in enumerate(kept):
        if i % every:
            continue
        scored = sorted((-sum(x * z for x, z in zip(q, v, strict=True)), j, w == y) for b, (j, w, v) in enumerate(kept) if b != a and len(v) == len(q))
        for p, j, _ in [r for r in scored if r[2]][:k]:
            negative = [r for r in scored if not r[2] and 80 * -p <= 100 * -r[0] <= 100 * -p][:k]
            out += [(i, j, n, m, -p, -s) for n, (s, m, _) in enumerate(negative, 1)]
    return sorted(out)


def got(df):
    assert df.columns[:6] == COLUMNS
    return sorted(tuple(r[c] for c in COLUMNS) for r in df.collect())


def made(rng, n, dim=8, groups=12):
    centres = rng.standard_normal((groups, dim))
    v = centres[rng.integers(0, groups, n)] + 0.3 * rng.standard_normal((n, dim))
    return (v / np.linalg.norm(v, axis=1, keepdims=True)).astype(np.float32).astype(float)


def test_against_brute_force_with_small_pieces(spark):
    rng = np.random.default_rng(4)
    v = made(rng, 700).tolist()
    rows = [(k, v[k], int(rng.integers(0, 3))) for k in range(700)]
    rows += [(1000 + k, v[0], k % 3) for k in range(150)]  # a hot vector, and ties
    rows += [(2000, None, 1), (2001, v[1], None), (None, v[1], 1), (2002, [*v[1][:-1], None], 1), (2003, [*v[1][:-1], float("nan")], 1), (2004, [*v[1][:-1], float("inf")], 1), (2010, [], 1), (2020, [], 2), (2030, v[1][:3], 1), (2031, v[2][:3], 2), (2040, [0.0] * 8, 1), (-20, v[5], 2), (20, v[20], rows[20][2]), (20, v[21], 2)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<double>, label int, cell string")
    want = brute(rows, 10)
    assert len(want) > 500
    assert got(mine_negatives(df, every=10, piece=64, leaf=8)) == want
    assert got(mine_negatives(df, every=10, piece=64, leaf=8, sample_rows=40)) == want
    assert got(mine_negatives(df, every=10)) == want


def test_large_components_and_empty_tables(spark):
    rng = np.random.default_rng(5)
    rows = [(k, (1e6 * rng.standard_normal(4)).tolist(), k % 2) for k in range(60)]
    schema = "vec_id long, embedding array<double>, label int"
    assert got(mine_negatives(spark.createDataFrame(rows, schema), every=5)) == brute(rows, 5)
    assert got(mine_negatives(spark.createDataFrame([], schema))) == []
    assert got(mine_negatives(spark.createDataFrame([(100, [1.0], 1)], schema))) == []


def test_ranges_hold_and_far_leaves_are_left_out():
    rng = np.random.default_rng(6)
    x = made(rng, 3000, groups=40)
    square = float((x * x).sum(axis=1).max())
    tree, where = fit_tree(augment(x, square), 50)
    assert (route(tree, augment(x, square)) == where).all()
    assert np.bincount(where).max() <= 50
    low, high = ranges(tree, x[:20], square**0.5)
    far = np.sqrt(square + (x[:20] ** 2).sum(axis=1)[:, None] - 2 * x[:20] @ x.T)
    assert (low[:, where] <= far).all() and (far <= high[:, where]).all()

    whole = np.floor(256 * x).astype(np.int64)
    piece = Piece(np.arange(3000), np.arange(3000), np.zeros(3000, np.int64), whole, float((whole**2).sum(axis=1).max()), True, 50)
    seen, plain = [], piece.scores
    piece.scores = lambda q, a, b: seen.append(len(q) * (b - a)) or plain(q, a, b)
    n = 20
    p, s, i = piece.search(np.arange(n), np.zeros(n, np.int64), whole[:n], np.arange(n), np.full(n, -(1 << 61)), np.full(n, 1 << 61), True)
    want = [sorted((-int(whole[a] @ whole[b]), b) for b in range(3000) if b != a)[:5] for a in range(n)]
    assert [[(-int(s[j]), int(i[j])) for j in np.flatnonzero(p == a)] for a in range(n)] == want
    assert sum(seen) < 0.5 * n * 3000  # nearest first, most rows are never compared


def test_query_against_sql(spark, sf_dir):
    duckdb.sql(f"CREATE OR REPLACE VIEW embeddings AS SELECT * FROM '{sf_dir}/embeddings.parquet'")
    want = duckdb.sql(f"SELECT {', '.join(COLUMNS)} FROM ({oracle_sql()['op11_vantage_negatives']})").fetchall()
    assert len(want) and got(queries()["op11_vantage_negatives"](spark, sf_dir)) == sorted(want)
