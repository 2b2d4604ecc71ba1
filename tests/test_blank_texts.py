"""Documents without a text: each has its row, as in the SQL."""

import duckdb
import pytest

from tessella.operators import chunking
from tessella.plans import catalog

BLANK = ["", None, " ", "   ", "\n", "\n\n", " \n\t ", "\u00a0", "\u3000 "]


@pytest.fixture(scope="module")
def odd_dir(spark, sf_dir, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("odd"))
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    docs.union(spark.createDataFrame([(10_000 + k, t) for k, t in enumerate(BLANK)], docs.schema)).write.parquet(f"{at}/documents.parquet")
    return at


@pytest.mark.parametrize("name", ["atoms_windows_segments", "document_atoms", "segment_metrics", "segment_texts", "split_sentences"])
def test_blank_documents_have_their_row(spark, odd_dir, name):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{odd_dir}/documents.parquet/*.parquet'")
    want = con.sql(catalog.oracle_sql()[name])
    got = catalog.queries()[name](spark, odd_dir).select(*want.columns).collect()
    order = lambda rows: sorted(rows, key=lambda r: tuple(map(str, r)))
    assert order(map(tuple, got)) == order(want.fetchall())
    assert len(got) == 200 + len(BLANK)


def test_operators_leave_blank_texts_out_unless_asked(spark):
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(BLANK)], "doc_id int, text string")
    assert chunking.segments(docs).count() == chunking.atoms(docs).count() == chunking.segment_texts(docs).count() == 0
    assert {r.doc_id for r in chunking.sentences(docs).collect()} == {k for k, t in enumerate(BLANK) if t}
