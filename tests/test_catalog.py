import duckdb
import pandas as pd
import pytest

from tessella.plans import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, sf_dir, duck, name, tmp_path):
    catalog.queries()[name](spark, sf_dir).write.parquet(str(tmp_path / "out"))
    got = duckdb.sql(f"SELECT * FROM '{tmp_path}/out/*.parquet'").df()
    if name not in catalog.oracle_sql():
        assert len(got)
        return
    want = duck.sql(catalog.oracle_sql()[name]).df()
    cols = sorted(want.columns)
    assert cols == sorted(got.columns)
    order = lambda d: d[cols].sort_values(cols).reset_index(drop=True)
    pd.testing.assert_frame_equal(order(want), order(got), check_dtype=False, rtol=1e-9)


def test_ewma_of_every_user(spark, sf_dir):
    want = {}
    for r in sorted(spark.read.parquet(f"{sf_dir}/events.parquet").collect(), key=lambda r: r.event_id):
        want[r.user_id] = 0.2 * r.value + 0.8 * want.get(r.user_id, r.value)
    got = {r.user_id: r.ewma for r in catalog.queries()["latency_ewma_all"](spark, sf_dir).collect()}
    assert got.keys() == want.keys()
    assert all(abs(got[u] - want[u]) < 1e-5 for u in want)


def test_whole_jobs_hold_more_than_what_is_asked_for(spark, sf_dir):
    n = lambda name: catalog.queries()[name](spark, sf_dir)
    assert n("postings_index_all").count() > 200
    assert n("entity_evidence_all").select("entity").distinct().count() > n("entity_evidence").select("entity").distinct().count()
    assert n("cross_references_all").count() > n("cross_references").count()
    sql = catalog.oracle_sql()
    for name in ("entity_evidence", "cross_references"):
        assert len(sql[f"{name}_all"]) < len(sql[name])
