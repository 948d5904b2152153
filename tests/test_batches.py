"""Batch stores and restartable linkage, CSV, and the contract's entry points."""

import pytest
from pyspark.sql import functions as F

from panellink.plans import batch
from panellink.sources import panel as P
from tests.test_linkage import FAMILY, ids, link_panel, panel


@pytest.fixture(scope="module")
def store(spark, tmp_path_factory):
    rows = [(f"{r[0]}{k}", *r[1:-2], f"{r[-2]}-{k}", r[-1]) for k in (1, 2, 3) for r in FAMILY]
    path = str(tmp_path_factory.mktemp("b") / "in")
    df = panel(spark, rows)
    summary = {r["batch"]: r for r in P.batch_panel(df, path, n_batches=10).collect()}
    return df, path, summary


def test_whole_organizations(spark, store):
    df, path, summary = store
    assert set(summary) == {"1", "2", "3"} and all((r["records"], r["orgs"], r["max_org"], r["cost"]) == (10, 2, 8, 68.0) for r in summary.values())
    back = P.read_panel(spark, path)
    assert spark.conf.get("spark.sql.sources.partitionColumnTypeInference.enabled") == "true"
    assert back.count() == 30 and back.groupBy("ein").agg(F.countDistinct("batch").alias("n")).where("n > 1").count() == 0 and dict(back.dtypes)["batch"] == "string"
    with pytest.raises(Exception, match="already exists|PATH_ALREADY_EXISTS"):
        P.batch_panel(df, path, n_batches=10)
    with pytest.raises(ValueError, match="unique"):
        P.batch_panel(df.union(df), path + "-x")
    with pytest.raises(ValueError):
        P.batch_panel(df.drop("OBJECTID"), path + "-x")


def test_batched_equals_unbatched_and_resumes(spark, store, tmp_path):
    df, path, _ = store
    out = str(tmp_path / "out")
    first = batch.link_panel_batched(spark, path, out, batches=["1", "2"])
    assert [r.status for r in first] == ["done", "done"] and first[0].records == 10 and first[0].persons == 4
    second = {r.batch: r.status for r in batch.link_panel_batched(spark, path, out)}
    assert second == {"1": "complete", "2": "complete", "3": "done"}
    whole = ids(link_panel(df).panel)
    assert ids(batch.read_linked(spark, path, out)) == whole
    assert spark.read.parquet(f"{out}/profiles").count() == 12
    assert {r["batch"]: r["state"] for r in batch.batch_status(spark, out)} == {"1": "done", "2": "done", "3": "done"}
    with pytest.raises(ValueError, match="no batch files"):
        batch.link_panel_batched(spark, path, out, batches=["9"])


def test_failures_interruptions_and_retries(spark, store, tmp_path):
    _, path, _ = store
    out = str(tmp_path / "out")
    bad = batch.link_panel_batched(spark, path, out, steps=("link",), batches=["1"], link_args={"method": "none"})
    assert bad[0].status == "failed" and "unknown method" in bad[0].error
    assert batch.link_panel_batched(spark, path, out, steps=("link",), batches=["1"], retry_failed=False)[0].status == "skipped: failed earlier"
    assert batch.link_panel_batched(spark, path, out, steps=("profile",), batches=["1"])[0].status == "skipped: no emp-map"
    store = batch._Store(spark, out)
    store.write_text("run-ledger.csv", store.read_text("run-ledger.csv") + "2020-01-01 00:00:00,link,2,started,999999999,\n")
    assert [r for r in batch.batch_status(spark, out) if r["batch"] == "2"][0]["state"] == "interrupted"
    assert batch.ledger_recover(spark, out) == ["2"]
    assert batch.link_panel_batched(spark, path, out, steps=("link",), batches=["1", "2"])[1].status == "done"


def test_csv(spark, tmp_path):
    d = spark.createDataFrame([('a"b', "x,y"), (None, "line\\n")], "p string, q string")
    P.write_csv(d, str(tmp_path / "c"))
    assert sorted(map(str, P.read_csv(spark, str(tmp_path / "c")).collect())) == sorted(map(str, d.collect()))


def test_contract(spark):
    import __spark_entry__ as e

    q, o = e.queries(), e.oracle_sql()
    assert set(o) <= set(q) and len(o) >= 40
    df = e.entry(spark)
    assert df.count() > 0 and "EMP_ID" in df.columns


def test_oracles_agree_on_the_smallest_tables(spark):
    import glob
    import math
    import os

    import duckdb

    from panellink import queries

    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for p in glob.glob(f"{sf}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM read_parquet('{p}')")

    def plain(v):
        return None if v is None or isinstance(v, float) and math.isnan(v) else round(float(v), 6) if isinstance(v, (int, float)) and not isinstance(v, bool) else v

    for name, sql in queries.oracle_sql().items():
        got, want = queries.queries()[name](spark, sf), con.sql(sql)
        cols = sorted(got.columns)
        assert cols == sorted(want.columns), name
        a = sorted(str([plain(r[c]) for c in cols]) for r in got.collect())
        b = sorted(str([plain(dict(zip(want.columns, r))[c]) for c in cols]) for r in want.fetchall())
        assert a == b, name
