"""The registered queries: names, columns and row counts on the smallest tables, and their SQL."""

import os

import pytest

import __spark_entry__ as entry

SMALL = "/root/testdata/sf0.001"
COLUMNS = {
    1: ["doc_id", "start", "n_tokens", "ids_crc32"],
    2: ["doc_id", "held_out", "score", "predicted"],
    3: ["doc_id", "held_out", "lang_pred", "score"],
    4: ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"],
    5: ["vec_id", "n_links", "component_id", "kept"],
    6: ["doc_id", "n_shingles", "component_id"],
    7: ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"],
    8: ["doc_id", "item_id"],
    9: ["doc_id", "size", "source_size", "target", "taken"],
    10: ["doc_id", "n_removed", "text"],
    11: ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"],
    12: ["page_id", "url", "text", "n_chars"],
    13: ["vec_id", "code", "error", "label_error", "codebooks_sha256"],
}

TABLES = {5: "embeddings", 12: "pages", 13: "embeddings"}


def name_of(n):
    return next(q for q in entry.queries() if q.startswith(f"op{n}_"))


def test_all_are_registered():
    assert all(name_of(n) for n in COLUMNS) and "pipeline" in entry.queries()
    assert all(sum(q.startswith(f"op{n}_") for q in entry.queries()) == 1 for n in COLUMNS)


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="no driver tables")
@pytest.mark.parametrize("n", COLUMNS)
def test_query(spark, n):
    df = entry.queries()[name_of(n)](spark, SMALL)
    assert set(COLUMNS[n]) <= set(df.columns)
    rows = df.collect()
    table = spark.read.parquet(f"{SMALL}/{TABLES.get(n, 'documents')}.parquet")
    if n not in (8, 11):
        assert len(rows) == table.count()
    if (sql := entry.oracle_sql().get(name_of(n))) is None:
        return
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for f in os.listdir(SMALL):
        con.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SMALL}/{f}'")
    cur = con.execute(sql)
    names = [c[0] for c in cur.description]
    assert sorted(names) == sorted(df.columns)
    want = sorted(tuple(r[names.index(c)] for c in df.columns) for r in cur.fetchall())
    assert sorted(map(tuple, rows)) == want
