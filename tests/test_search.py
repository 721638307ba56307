"""Indexed search and deep pages against full scans."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from caseloom.operators import deep, listing
from caseloom.operators.predicates import search
from caseloom.sources import textindex


@pytest.fixture(scope="module")
def indexed(spark, tmp_path_factory):
    rng = random.Random(3)
    words = ["".join(rng.choice("abcdefghäöüß ") for _ in range(rng.randint(2, 9))) for _ in range(300)]
    rows = [(i, rng.choice(words) + " " + rng.choice(words).upper(), None if i % 7 == 0 else f"note {i // 50} 100%_x\\y {rng.choice(words)}") for i in range(2000)]
    rows += [(5000, "ΟΔΟΣ ΣΟΦΙΑΣ Iİ", ""), (5001, None, None), (5002, "ab", "c")]
    df = spark.createDataFrame(rows, "id long, title string, note string")
    path = str(tmp_path_factory.mktemp("index"))
    textindex.add(df.filter("id < 1000").coalesce(1), ["title", "note"], path, 50)
    textindex.add(df.filter("id >= 1000").coalesce(1), ["title", "note"], path, 50)
    return path, df


@pytest.mark.parametrize("needle", ["note 7 ", "NOTE 17", "ab", "a", "", "100%_x", "100\\%\\_x", "x\\y", "\\", "note%7 1", "n_te 3", "ΟΔΟΣ", "σοφια", "Iİ", "no such thing", "%%%", "gÄÖ", "bc"])
def test_rows_are_those_of_a_scan(spark, indexed, needle):
    path, df = indexed
    got = textindex.search_index(spark, path, needle, "title", "note")
    where = search(needle, "title", "note")
    want = df if where is None else df.filter(where)
    assert sorted(r.id for r in got.rows.collect()) == sorted(r.id for r in want.collect())
    assert got.files >= 41 and got.files_read <= got.files
    if needle in ("note 7 ", "NOTE 17", "no such thing"):
        assert got.files_read < got.files // 4
    if len(needle) < 3:
        assert got.files_read == got.files


def test_an_index_of_nothing(spark, tmp_path):
    textindex.add(spark.createDataFrame([], "id long, title string"), ["title"], str(tmp_path / "none"))
    got = textindex.search_index(spark, str(tmp_path / "none"), "abc", "title", where=F.col("id") > 0)
    assert got.rows.collect() == [] and got.files_read == 0


def test_deep_pages_concatenate_to_the_list(spark, monkeypatch):
    rng = random.Random(5)
    rows = [(i, rng.choice([None, "a", "b", "c"]), rng.choice([None, dt.date(2024, 1, rng.randint(1, 28))]), rng.choice([1.5, float("nan"), -2.0, None])) for i in range(1500)]
    df = spark.createDataFrame(rows, "id long, s string, d date, x double").repartition(5)
    monkeypatch.setattr(deep, "RANGES", 6)
    for pairs in ([("s", True), ("d", False), ("id", False)], [("x", False), ("id", True)], [("x", True), ("s", False), ("id", False)]):
        keys = [(F.col(c), d) for c, d in pairs]
        whole = [r.id for r in df.filter("id % 3 > 0").orderBy(*[listing.order_key(c, d) for c, d in keys]).collect()]
        for page in (0, 1, 4, 9, 10, 33, 99, 100, 150):
            got = deep.deep_page(df, F.col("id") % 3 > 0, keys, page, 10, first=0, few=40).collect()
            assert [r.id for r in got] == whole[page * 10 : page * 10 + 10]


def test_what_is_sorted_is_bounded(spark):
    df = spark.range(200_000).withColumn("k", F.pmod(F.xxhash64("id"), F.lit(1_000_003)))
    keys = [(F.col("k"), True), (F.col("id"), False)]
    span, offset = deep.Span(None, None, 200_000, 0), 150_000
    while span.rows > 5_000:
        span = deep.narrowed(df, keys, span, offset)
    assert span.before <= offset < span.before + span.rows
    plan = deep.deep_page(df, F.lit(True), keys, 15_001, 10, few=5_000)
    assert [r.id for r in plan.collect()] == [r.id for r in df.orderBy(F.desc("k"), "id").offset(150_000).limit(10).collect()]


def test_equal_keys_end(spark):
    df = spark.range(300).withColumn("k", F.lit(1))
    assert deep.deep_page(df, F.lit(True), [(F.col("k"), False)], 20, 10, few=10).count() == 10
    assert deep.deep_page(df.limit(0), F.lit(True), [(F.col("k"), False)], 3, 10).collect() == []
