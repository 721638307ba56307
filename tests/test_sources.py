"""Stored tables, the delivery ledger, the schema journal, unique keys and parallel database reads."""

import glob
import hashlib

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from caseloom.sources import journal, keyed, ledger, tables
from caseloom.sources.store import Conflict, Stored


def digests(path):
    return {f: hashlib.sha256(open(f, "rb").read()).hexdigest() for f in glob.glob(f"{path}/data/**/*.parquet", recursive=True)}


def test_changes_rewrite_only_files_with_matches(spark, tmp_path):
    path = str(tmp_path / "t")
    df = spark.range(1000).select("id", (F.col("id") % 7).alias("k"), F.lit(False).alias("soft_delete"), F.lit(None).cast("timestamp").alias("deleted_at"))
    t = Stored.create(df.repartitionByRange(10, "id"), path)
    before = digests(path)
    live = F.col("id").between(105, 110) & ~F.col("soft_delete")
    c = t.update(live, {"soft_delete": F.lit(True), "k": F.col("k") + 100})
    assert (c.version, c.rewritten, c.untouched) == (1, 1, 9)
    assert sorted(tuple(r) for r in c.rows.select("id", "k", "soft_delete").collect()) == [(i, i % 7 + 100, True) for i in range(105, 111)]
    after = digests(path)
    assert all(after[f] == h for f, h in before.items())
    assert t.read().filter("soft_delete").count() == 6 and t.read(0).filter("soft_delete").count() == 0 and t.read().count() == 1000
    again = t.update(live, {"soft_delete": F.lit(True)})
    assert (again.version, again.rewritten) == (1, 0) and again.rows.collect() == [] and t.versions() == [0, 1] and digests(path) == after
    gone = t.delete(F.col("id") < 20)
    assert gone.rows.count() == 20 and t.read().count() == 980
    assert t.insert(spark.createDataFrame([(5000, 1, None, None)], "id long, k long, soft_delete boolean, deleted_at timestamp")).version == 3 and t.read().count() == 981
    # a null test is no match, and a table may become empty
    assert t.update(F.col("soft_delete") & (F.col("id") == 5000), {"k": F.lit(0)}).rewritten == 0
    assert t.delete(F.lit(True)).rows.count() == 981 and t.read().count() == 0
    assert Stored(spark, path).update(F.lit(True), {"k": F.lit(1)}).rewritten == 0
    with pytest.raises(Conflict):
        t._commit(2, [], df.schema.json())


def test_a_repeated_batch_sends_each_row_once(spark, tmp_path):
    out, box = str(tmp_path / "ledger"), tmp_path / "box"
    box.mkdir()

    def deliver(key, row, box=str(box)):
        if row["bad"]:
            raise ConnectionError(f"no way to {row['to']}")
        with open(f"{box}/{key}", "a") as f:
            f.write("x")

    df = spark.createDataFrame([(f"m{i}", f"u{i}", i == 3) for i in range(8)] + [("m1", "u1", False), (None, "nobody", False)], "id string, to string, bad boolean").repartition(3)
    send = ledger.sender(out, "id", deliver)
    send(df, 0)
    send(df, 0)
    assert {p.name: p.read_text() for p in box.iterdir()} == {f"m{i}": "x" for i in range(8) if i != 3}
    got = {r.key: (r.status, r.attempts) for r in ledger.outcome(spark, out).collect()}
    assert got == {None: ("failed", 2), "m3": ("failed", 2)} | {f"m{i}": ("sent", 1) for i in range(8) if i != 3}
    assert ledger.entries(spark, out).filter("key = 'm3'").first().error == "ConnectionError: no way to u3"
    other = str(tmp_path / "other")
    ledger.sender(other, "id", None)(df, 0)
    assert {r.status for r in ledger.outcome(spark, other).collect()} == {"skipped", "failed"}
    assert ledger.entries(spark, str(tmp_path / "none")).count() == 0


def test_a_stream_sends_once_over_restarts(spark, tmp_path):
    src, out, check, box = (str(tmp_path / n) for n in ("src", "ledger", "check", "box"))
    import os

    os.mkdir(box)
    spark.createDataFrame([(i,) for i in range(5)], "id long").write.parquet(src)
    state = {"broken": True}

    def deliver(key, row, box=box):
        with open(f"{box}/{key}", "a") as f:
            f.write("x")

    send = ledger.sender(out, "id", deliver)

    def once(df, batch):
        send(df, batch)
        if state["broken"]:
            state["broken"] = False
            raise RuntimeError("the driver fails after the batch was sent")

    for _ in range(2):
        q = spark.readStream.schema("id long").parquet(src).writeStream.foreachBatch(once).option("checkpointLocation", check).trigger(availableNow=True).start()
        try:
            q.awaitTermination(120)
        except Exception:
            pass
    assert {open(f).read() for f in glob.glob(f"{box}/*")} == {"x"} and len(glob.glob(f"{box}/*")) == 5


def test_files_of_each_version_read_as_the_newest(spark, tmp_path):
    path = str(tmp_path / "t")
    j = journal.Journal("id long, data string, old int")
    j.write(spark.createDataFrame([(1, '{"a": 1}', 5)], j.first), path)
    j2 = j.then(journal.add("status", "string", F.lit("new")), journal.rename("data", "body"))
    j2.write(spark.createDataFrame([(2, "[2]", 6, "seen")], "id long, body string, old int, status string"), path)
    j3 = j2.then(journal.drop("old"), journal.retype("body", "variant"), journal.retype("id", "string"))
    assert sorted((r.id, str(r.body), r.status) for r in j3.read(spark, path).collect()) == [("1", '{"a":1}', "new"), ("2", "[2]", "seen")]
    assert sorted(tuple(r) for r in j2.read(spark, path).collect()) == [(1, '{"a": 1}', 5, "new"), (2, "[2]", 6, "seen")]
    with pytest.raises(ValueError):
        j.read(spark, path)
    with pytest.raises(ValueError):
        j3.write(spark.range(1), path)
    assert j3.read(spark, str(tmp_path / "none")).count() == 0


def test_duplicates_are_refused_by_name(spark):
    kept = spark.createDataFrame([(1, "a@x", "u1"), (2, None, "u2")], "id long, email string, user_name string")
    new = spark.createDataFrame([(3, "a@x", "u3"), (4, "b@x", "u2"), (5, "c@x", "u5"), (6, "c@x", "u6"), (7, None, "u7"), (8, None, "u8"), (9, "a@x", "u1")], kept.schema)
    good, bad = keyed.admitted(new, kept, ("email",), ("user_name",), order="id")
    assert sorted(r.id for r in good.collect()) == [5, 7, 8] and good.columns == new.columns
    assert {r.id: r.refused for r in bad.collect()} == {3: ["email"], 4: ["user_name"], 6: ["email"], 9: ["email", "user_name"]}


def test_a_lookup_reads_one_row_group(spark, tmp_path):
    path = str(tmp_path / "k")
    df = spark.range(60_000).select(F.md5(F.col("id").cast("string")).alias("id"), F.sha2(F.col("id").cast("string"), 256).alias("email"))
    keyed.write_keyed(df, path, "id", "email", row_group=200_000, files=3)
    want = hashlib.md5(b"777").hexdigest()
    groups = hits = 0
    for f in glob.glob(f"{path}/*.parquet"):
        meta = pq.ParquetFile(f).metadata
        for g in range(meta.num_row_groups):
            s = meta.row_group(g).column(0).statistics
            groups, hits = groups + 1, hits + (s.min <= want <= s.max)
    assert groups > 12 and hits == 1
    assert spark.read.parquet(path).filter(F.col("id") == want).count() == 1
    assert spark.read.parquet(path).filter(F.col("email") == hashlib.sha256(b"5").hexdigest()).count() == 1


def test_parallel_reads_of_a_database(spark):
    """The embedded database that comes with Spark: partitions by key, predicates and columns pushed down."""
    url = "jdbc:derby:memory:caseloom;create=true"
    jvm = spark._jvm
    jvm.java.lang.Class.forName("org.apache.derby.iapi.jdbc.AutoloadedDriver")
    con = jvm.java.sql.DriverManager.getConnection(url)
    try:
        st = con.createStatement()
        st.execute("CREATE TABLE people (id INT PRIMARY KEY, name VARCHAR(20), age INT)")
        st.execute("INSERT INTO people VALUES " + ", ".join(f"({i}, 'n{i}', {i % 90})" for i in range(1, 501)))
        st.close()
        df = tables.scan_jdbc(spark, url, "people", "id", 1, 501, 5, driver="org.apache.derby.iapi.jdbc.AutoloadedDriver")
        assert df.rdd.getNumPartitions() == 5 and df.count() == 500
        assert sorted(r.ID for r in df.filter("age = 7").collect()) == [i for i in range(1, 501) if i % 90 == 7]
        plan = df.filter("age = 7 and name like 'n9%'").select("id")._jdf.queryExecution().executedPlan().toString()
        assert "EqualTo(AGE,7)" in plan and "StringStartsWith(NAME,n9)" in plan and "ReadSchema: struct<ID:int>" in plan
        sizes = df.groupBy(F.spark_partition_id()).count().collect()
        assert sorted(r["count"] for r in sizes) == [100] * 5
        spark.conf.set("spark.sql.catalog.derby", "org.apache.spark.sql.execution.datasources.v2.jdbc.JDBCTableCatalog")
        for k, v in {"url": url, "driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver", "pushDownAggregate": "true", "pushDownLimit": "true"}.items():
            spark.conf.set(f"spark.sql.catalog.derby.{k}", v)
        counted = spark.sql("SELECT count(*) AS n, max(age) AS m FROM derby.APP.PEOPLE WHERE age < 10")
        assert tuple(counted.first()) == (sum(i % 90 < 10 for i in range(1, 501)), 9)
        assert "PushedAggregates: [COUNT(*), MAX(AGE)]" in counted._jdf.queryExecution().executedPlan().toString()
    finally:
        con.close()
