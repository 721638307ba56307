"""Token files: exact round trips against the tokenizers library."""

import random
import zlib

import numpy as np
import pytest

from caseloom.llm import tokens
from tests.llm.util import docs_frame, rows_of

P = pytest.importorskip("public_tokenizers")
PATH = P.path("byte_bpe_50k.json")


def reference(rows):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(PATH)
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
    out, at = [], 0
    for d, t in order:
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, tokens.END_ID]
        out.append((d, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    return sorted(out, key=str)


ODD = ["", " ", "a  b", "a\n\nb", " lead", "tail ", "x\ty z", "don't 've 's", "a\r\nb", "12 34 5.6", "\n", "a　 b", "é à\n\tq", "x  y", "\x1c a", "z\u0085y", "<|endoftext|> x", "a<|endoftext|>", "no <|endoftext|> here <|endoftext|><|endoftext|>", "<|endoftex",  "日本 語\n中", "\U0001f600 a"]


def test_files_hold_the_ids_of_every_text(spark):
    rng = random.Random(1)
    rows = [(i * 3, " ".join(rng.choice(["the", "tion", "é", "x.y", "ß", "\n"]) + str(rng.randint(0, 30)) for _ in range(rng.randint(0, 300)))) for i in range(80)]
    rows += [(1000 + i, t) for i, t in enumerate(ODD)] + [(5, None), (5, "twice"), (5, "twice"), (None, "no id"), (7, "long " * 30000)]
    assert rows_of(tokens.token_output(docs_frame(spark, rows), PATH)) == reference(rows)


def test_empty_table_and_extra_columns(spark):
    assert rows_of(tokens.token_output(docs_frame(spark, []), PATH)) == []
    df = spark.createDataFrame([(1, "a b", 3, "x")], "doc_id long, text string, part int, payload string")
    assert rows_of(tokens.token_output(df, PATH)) == reference([(1, "a b")])


def test_cache_that_is_full_changes_nothing(monkeypatch):
    from caseloom.llm.common import bytes_of
    import pyarrow as pa

    texts = [f"w{i} v{i % 7} end" for i in range(300)]
    full = tokens.Encoder(PATH).encode(*bytes_of(pa.array(texts)))
    monkeypatch.setattr(tokens, "CACHE_ENTRIES", 5)
    small = tokens.Encoder(PATH)
    for _ in range(2):
        got = small.encode(*bytes_of(pa.array(texts)))
        assert (got[0] == full[0]).all() and (got[1] == full[1]).all()


def test_whole_table_is_what_the_library_gives(spark):
    """Every text of a driver table, against the library itself."""
    import os

    path = "/root/testdata/sf0.001/documents.parquet"
    if not os.path.exists(path):
        pytest.skip("no driver tables")
    df = spark.read.parquet(path)
    assert rows_of(tokens.token_output(df, PATH)) == reference([(r.doc_id, r.text) for r in df.collect()])


def test_no_pair_is_left_that_is_frequent():
    rng = np.random.default_rng(9)
    for first, ids in ((300, rng.zipf(1.3, 60_000) % 300), (70_000, np.repeat(rng.integers(0, 70_000, 40), 50)), (50257, np.full(5000, 7))):
        symbols, rules = tokens.repair(ids.astype(np.uint32), first)
        assert (tokens.expand(symbols, rules, first) == ids).all() and len(rules)
        places, last = {}, {}
        for i, p in enumerate(zip(symbols[:-1].tolist(), symbols[1:].tolist(), strict=True)):
            if last.get(p, -2) != i - 1:  # overlapping places count once
                places[p], last[p] = places.get(p, 0) + 1, i
        assert max(places.values(), default=0) < tokens.LEAST_COUNT
        shard = tokens.Shard(tokens.pack(ids.astype(np.uint32), np.arange(1), np.array([len(ids)]), first))
        assert (shard.ids() == ids).all() and shard.decode_range(10, 20).tolist() == ids[10:20].tolist()


@pytest.mark.parametrize("seed", range(4))
def test_repair_round_trip_and_ranges(seed):
    rng = np.random.default_rng(seed)
    ids = rng.choice([1, 1, 1, 2, 3, 500, 50256], 4000 + seed).astype(np.uint16)
    counts = np.array([0, 1500, 2500 + seed])
    shard = tokens.Shard(tokens.pack(ids, np.arange(3), counts, 50257))
    assert (shard.ids() == ids).all() and len(shard.symbols) < len(ids) and len(shard.rules)
    for _ in range(50):
        a, b = sorted(rng.integers(0, len(ids) + 1, 2))
        assert (shard.decode_range(int(a), int(b)) == ids[a:b]).all()
    assert (shard.document(1) == ids[:1500]).all() and len(shard.document(0)) == 0
    assert shard.lengths.tolist() == [len(tokens.expand(np.array([50257 + i]), shard.rules, 50257)) for i in range(len(shard.rules))]


def test_tiny_and_empty_shards():
    for n in (0, 1, 3):
        s = tokens.Shard(tokens.pack(np.arange(n, dtype=np.uint16), np.arange(1), np.array([n]), 50257))
        assert s.ids().tolist() == list(range(n))


def test_a_range_is_read_without_the_rest():
    """decode_range touches as many rules as its answer needs, and equals the slice."""
    import time

    rng = np.random.default_rng(0)
    words = [rng.integers(1, 300, rng.integers(2, 40)) for _ in range(200)]
    ids = np.concatenate([words[i] for i in (rng.zipf(1.3, 60_000) % 200)]).astype(np.uint32)[: 1 << 20]
    counts = np.full(len(ids) // 1000, 1000)
    ids = ids[: counts.sum()]
    shard = tokens.Shard(tokens.pack(ids, np.arange(len(counts)), counts, 300))
    assert len(shard.rules) > 500 and (shard.ids() == ids).all()
    shard.decode_range(0, 1)
    start = time.perf_counter()
    for k in rng.integers(0, len(counts), 50).tolist():
        assert (shard.document(k) == ids[1000 * k : 1000 * k + 1000]).all()
    assert (time.perf_counter() - start) / 50 < 0.01
    for a, b in ((0, len(ids)), (5, 6), (len(ids) - 1, len(ids)), (777, 55_555), (9, 9)):
        assert (shard.decode_range(a, b) == ids[a:b]).all()


def test_symbols_stay_two_bytes_where_four_save_nothing():
    rng = np.random.default_rng(1)
    seq = np.repeat(rng.integers(0, 64_000, (9_000, 2)), 24, axis=0)
    seq = seq[rng.permutation(len(seq))].ravel()
    symbols, rules = tokens.repair(seq, 64_000)
    assert 64_000 + len(rules) <= 1 << 16 and (tokens.expand(symbols, rules, 64_000) == seq).all()
