"""Ingestion, streaming twins, plan shapes, and the catalogue against DuckDB."""

import datetime as dt
import os
import re

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from caseloom.operators import listing, state
from caseloom.plans import catalogue, ingest
from caseloom.sources import tables
from caseloom.streaming import twins

SMALL = "/root/testdata/sf0.001"
needs_tables = pytest.mark.skipif(not os.path.isdir(SMALL), reason="no driver tables")


def test_ingestion_with_stub_engines(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(b"one")
    (tmp_path / "b.png").write_bytes(b"bad")
    (tmp_path / "c.exe").write_bytes(b"no")
    files = tables.blobs(spark, str(tmp_path))

    def ocr(content):
        if content == b"bad":
            raise ValueError("unreadable")
        return ["Hb  13", "g/dl"]

    def model(prompt):
        assert "Hb 13 g/dl" in prompt
        return '```json\n{"hospital": {"name": "H"}, "doctor": {"name": "D"}, "report": {"date": "2024-01-02"}}\n```'

    got = {r["name"]: r for r in ingest.gold(ingest.silver(ingest.bronze(files, ocr)), model).collect()}
    assert set(got) == {"a.pdf", "b.png"}
    assert (got["a.pdf"].ocr_status, got["a.pdf"].hospital_name, got["a.pdf"].doctor_name, got["a.pdf"].report_date) == ("completed", "H", "D", dt.date(2024, 1, 2))
    assert got["b.png"].ocr_status == "failed" and got["b.png"].lines_error == "unreadable" and got["b.png"].hospital_name is None
    idle = ingest.silver(ingest.bronze(files, None)).collect()
    assert {r.ocr_status for r in idle} == {"in_progress"}


def run_stream(spark, df, name, mode):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    return spark.table(name)


@pytest.fixture
def stream(spark, tmp_path):
    base = dt.datetime(2026, 1, 1)
    rows = [(f"u{i % 3}", base + dt.timedelta(minutes=i * 4), "FFSFFFSF"[i % 8] == "F") for i in range(60)]
    df = spark.createDataFrame(rows, "user_id string, ts timestamp, bad boolean")
    path = str(tmp_path / "events")
    df.coalesce(1).write.parquet(path)
    return df, spark.readStream.schema(df.schema).parquet(path)


def test_streams_agree_with_batches(spark, stream):
    batch, live = stream
    want = {tuple(r) for r in state.unread(batch, "user_id", ~F.col("bad")).collect()}
    assert {tuple(r) for r in run_stream(spark, twins.unread(live, "user_id", ~F.col("bad")), "t_unread", "complete").collect()} == want
    want = {tuple(r) for r in state.over_limit(batch, "user_id", "ts", limit=1).collect()}
    assert {tuple(r) for r in run_stream(spark, twins.over_limit(live, "user_id", "ts", limit=1), "t_rate", "update").collect()} == want
    want = {tuple(r) for r in state.latest(batch, "user_id", "ts", "bad").collect()}
    assert {tuple(r) for r in run_stream(spark, twins.latest(live, "user_id", "ts", "bad"), "t_latest", "complete").collect()} == want
    want = {tuple(r) for r in state.attempts(batch, "user_id", "ts", F.col("bad")).collect()}
    got = run_stream(spark, twins.attempts(live, "user_id", "string", "ts", F.col("bad")), "t_attempts", "update")
    assert {tuple(r) for r in got.collect()} == want


def test_code_stream_joins_within_its_life(spark, tmp_path):
    base = dt.datetime(2026, 1, 1)
    a = spark.createDataFrame([("u", "1", base), ("v", "2", base)], "user_id string, code string, at timestamp")
    b = spark.createDataFrame([("u", "1", base + dt.timedelta(minutes=9)), ("v", "2", base + dt.timedelta(minutes=11))], "user_id string, code string, at timestamp")
    a.write.parquet(str(tmp_path / "a"))
    b.write.parquet(str(tmp_path / "b"))
    read = lambda p: spark.readStream.schema(a.schema).parquet(str(tmp_path / p))
    assert [r.user_id for r in run_stream(spark, twins.codes(read("a"), read("b")), "t_codes", "append").collect()] == ["u"]


def test_send_each_without_a_way_to_deliver(spark):
    tables.send_each(None)(spark.range(3), 0)


@needs_tables
def test_scans_are_pruned_and_pages_are_top_k(spark):
    page = catalogue.page_owner_search(spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in page and "EqualTo(o_orderstatus,O)" in page
    assert "o_orderstatus" in page and "o_totalprice" in page
    semi = catalogue.lookup_owner_semi(spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "LeftSemi" in semi and "l_extendedprice" not in semi
    counted = catalogue.rate_limit(spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert counted.count("Exchange") == 1 and "partial_count" in counted
    where = catalogue._priority()
    total = listing.totals(spark.read.parquet(f"{SMALL}/orders.parquet"), where, 1, 10)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("ReadSchema.*o_totalprice", total)


@needs_tables
@pytest.mark.parametrize("name", sorted(catalogue.SQL))
def test_catalogue_matches_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for f in os.listdir(SMALL):
        con.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SMALL}/{f}'")
    df = catalogue.QUERIES[name](spark, SMALL)
    cols = sorted(df.columns)
    cur = con.execute(catalogue.SQL[name])
    names = [c[0] for c in cur.description]
    assert sorted(names) == cols

    def norm(v):
        if isinstance(v, float):
            return round(v, 6)
        return v.isoformat() if hasattr(v, "isoformat") else v

    got = sorted(([norm(v) for v in r] for r in df.select(cols).collect()), key=str)
    want = sorted(([norm(r[names.index(c)]) for c in cols] for r in cur.fetchall()), key=str)
    assert got == want


def test_entry_names_are_consistent():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(catalogue.QUERIES) <= set(entry.queries())
