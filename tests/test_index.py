import random
import sqlite3

import pytest
from pyspark.sql import functions as F

from tessella.operators import fulltext
from tessella.operators.index import StoredIndex, best_start

SCHEMA = "doc_id long, title string, text string"


def made(n, seed=7):
    rng = random.Random(seed)
    words = ["alpha", "beta", "Gamma", "delta", "licensed", "Under", "terms", "of", "x1", "and"]
    out = []
    for k in range(n):
        body = ""
        for _ in range(rng.choice([0, 3, 30, 90, 300])):
            body += rng.choice(words if rng.random() < 0.4 else [f"w{rng.randint(0, 400)}"]) + rng.choice([" "] * 12 + [". ", ": ", ".\n", ", ", " (", ".", "  "])
        out.append((k, rng.choice(["alpha title", "Licensed", "none"]), body))
    return out


@pytest.fixture(scope="module")
def index(spark, tmp_path_factory):
    rows = made(150)
    return StoredIndex(spark, str(tmp_path_factory.mktemp("index")), 5, columns=("title", "text")).build(spark.createDataFrame(rows, SCHEMA)), rows


@pytest.mark.parametrize("query", ["licensed", "licensed under", "alpha beta terms", "licensed under alpha of terms"])
def test_ranks_and_snippets_agree_with_sqlite(spark, index, query):
    stored, rows = index
    c = sqlite3.connect(":memory:")
    c.execute("CREATE VIRTUAL TABLE f USING fts5(title, text)")
    c.executemany("INSERT INTO f(rowid, title, text) VALUES (?, ?, ?)", rows)
    match = " OR ".join("(" + " ".join(f'"{t}"' for t in g) + ")" for g in fulltext.query_groups(query))
    want = {r[0]: r[1:] for r in c.execute("SELECT rowid, rank, snippet(f, 1, '<mark>', '</mark>', '...', 40) FROM f WHERE f MATCH ?", (match,))}
    hits = stored.rank(query)
    texts = spark.createDataFrame(rows, SCHEMA)
    got = {r.doc_id: (r.rank, r.snippet) for r in stored.snippets(hits, texts, query).collect()}
    assert len(want) > 5 and got.keys() == want.keys()
    for k, (rank, snippet) in want.items():
        assert got[k][1] == snippet
        assert abs(got[k][0] - rank) < 1e-6 * max(1, abs(rank))
    assert any(0 < s.find("<mark>") and s.startswith("...") for _, s in want.values())


def test_a_window_with_more_terms_wins_over_one_with_more_places():
    assert best_start([[100, 101, 102], [500], []], [0], 600, 40) == 82  # three places of one term: 1002, centred
    assert best_start([[100, 480], [500]], [0], 600, 40) == 471
    assert best_start([[5]], [0, 3], 100, 40) == 3  # the sentence that holds it
    assert best_start([[5]], [0], 100, 40) == 0  # the sentence at the very start
    assert best_start([[], []], [0], 100, 40) == 0
    assert best_start([[7]], [0], 10, 40) == 0


def test_search_after_a_refresh_is_search_over_a_fresh_scan(spark, tmp_path):
    rows = {r[0]: r for r in made(80)}
    stored = StoredIndex(spark, str(tmp_path), 6, columns=("title", "text")).build(spark.createDataFrame(list(rows.values()), SCHEMA))
    files = lambda: {r.f for r in stored.postings().select(F.input_file_name().alias("f")).distinct().collect()}
    before = files()
    fresh = {k: (k, "alpha", t) for k, _, t in made(6, seed=9)} | {1000: (1000, None, "licensed under new terms"), 1001: (1001, "beta", None)}
    gone = [11, 12, 4242]
    stored.refresh(spark.createDataFrame(list(fresh.values()), SCHEMA), spark.createDataFrame([(k,) for k in gone], "doc_id long"))
    rows = {k: v for k, v in (rows | fresh).items() if k not in gone}
    docs = spark.createDataFrame(list(rows.values()), SCHEMA)
    for query in ("licensed under", "alpha beta gamma delta", "nowhere", "?!"):
        want = {(r.doc_id, r.length, round(r.rank, 9)) for r in fulltext.bm25_rank(docs, query, "doc_id", ["title", "text"]).collect()}
        assert {(r.doc_id, r.length, round(r.rank, 9)) for r in stored.rank(query).collect()} == want
    page = [(r.doc_id, r.score) for r in stored.search("licensed", 5, 2).collect()]
    assert page == [(r.doc_id, r.score) for r in fulltext.keyword_search(docs, "licensed", 5, 2, columns=["title", "text"]).collect()]
    # Groups that hold no changed document keep their files.
    one = spark.createDataFrame([(0,)], "doc_id long")
    kept = files()
    stored.refresh(deleted=one)
    part = one.select(stored.part_of(F.col("doc_id"))).first()[0]
    assert {f for f in kept if f"/part={part}/" not in f} <= files() and kept != before


def test_groups_may_run_empty(spark, tmp_path):
    docs = spark.createDataFrame([(1, "a", "one"), (2, "b", "two")], SCHEMA)
    stored = StoredIndex(spark, str(tmp_path), 3).build(docs)
    stored.refresh(deleted=docs.select("doc_id"))
    assert stored.rank("one").count() == 0 and stored.documents().count() == 0
    stored.refresh(changed=docs)
    assert [r.doc_id for r in stored.rank("one").collect()] == [1]
    stored.refresh()
    assert StoredIndex(spark, str(tmp_path) + "/none", 3).build(docs.limit(0)).rank("one").count() == 0


def test_a_search_reads_terms_and_no_text(index):
    plan = index[0].rank("licensed under")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [In(term" in plan.replace("IsNotNull(term), ", "") and "positions" not in plan


def test_postings_are_made_within_a_row(spark, tmp_path):
    docs = spark.createDataFrame([(1, "b a B", "x A a, a b"), (2, None, None), (3, "", "c")], SCHEMA)
    stored = StoredIndex(spark, str(tmp_path), 3, columns=("title", "text"))._tables(docs)[0]
    assert sorted((r.id, r.term, r.tf, r.length, r.positions) for r in stored.collect()) == [(1, "a", 4, 8, [1, 2, 3]), (1, "b", 3, 8, [4]), (1, "x", 1, 8, [0]), (3, "c", 1, 1, [0])]
    plain = fulltext.postings(docs, columns=["title", "text"])
    assert sorted((r.doc_id, r.term, r.tf, r.length) for r in plain.collect()) == [(1, "a", 4, 8), (1, "b", 3, 8), (1, "x", 1, 8), (3, "c", 1, 1)]
    for made_here in (stored, plain):
        assert "Exchange" not in made_here._jdf.queryExecution().executedPlan().toString()
