"""The queries opN_<name> over the smallest tables: against SQL where there is some, else their rows."""

import duckdb
import pytest

from evidentia.llm.catalog import oracle_sql, queries

SF = "/root/testdata/sf0.001"


def plain(x):
    return repr(float(x)) if isinstance(x, (int, float)) and not isinstance(x, bool) else x


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in ("documents", "benchmark", "conversations", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_like_sql(spark, duck, name):
    df = queries()[name](spark, SF)
    cursor = duck.execute(oracle_sql()[name])
    names = [c[0] for c in cursor.description]
    assert sorted(df.columns) == sorted(names)
    got = sorted((tuple(plain(r[c]) for c in names) for r in df.collect()), key=repr)
    assert got == sorted((tuple(map(plain, r)) for r in cursor.fetchall()), key=repr)


@pytest.mark.parametrize("name", sorted(set(queries()) - set(oracle_sql())))
def test_one_row_per_document(spark, name):
    ids = sorted(r.doc_id for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id").collect())
    assert sorted(r.doc_id for r in queries()[name](spark, SF).collect()) == ids


def test_simhash_by_brute_force(spark):
    from .test_duplicates import brute_components, brute_fingerprint

    fps = {r.doc_id: brute_fingerprint(r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    want = brute_components(fps)
    for r in queries()["op7_simhash"](spark, SF).collect():
        assert r.fingerprint == f"{fps[r.doc_id]:016x}" and r.component_id == want[r.doc_id]
