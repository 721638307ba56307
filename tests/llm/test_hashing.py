"""Hashes keep apart what polynomials modulo 2**64 don't: strings in the order of Thue and Morse."""

import numpy as np
import pyarrow as pa
import pytest

from caseloom.llm import hashing, jaccard, spans, suffix
from caseloom.llm.common import bytes_of
from tests.llm.test_suffix import brute as suffix_brute
from tests.llm.test_text_operators import span_brute
from tests.llm.util import docs_frame, rows_of


def twins(n, a="a", b="b"):
    bits = [bin(i).count("1") % 2 for i in range(n)]
    return "".join((a, b)[x] for x in bits), "".join((b, a)[x] for x in bits)


PAIRS = [twins(n) for n in (8, 64, 1024, 2048)] + [twins(1024, "abcdefg0", "abcdefg1"), twins(512, "0123456789abcdefX", "0123456789abcdefY")]


def test_words_windows_and_runs_differ():
    for x, y in PAIRS:
        data, off = bytes_of(pa.array([x, y]))
        h, s, e, _ = hashing.words(data, off)
        assert len(h) == 2 and h[0] != h[1]
        assert hashing.ranges(data, s, e, 1)[0] != hashing.ranges(data, s, e, 2)[0]
        k = len(x) - 1
        if k >= 8:
            w = hashing.fixed(data, k)
            texts = [(x + y)[i : i + k] for i in range(len(w))]
            assert len(w) == len(x) + len(y) - k + 1 and len(set(texts)) == len(set(w.tolist()))
    # sequences of words
    x, y = twins(2048, "left. ", "right. ")
    data, off = bytes_of(pa.array([x, y]))
    h, _, _, at = hashing.words(data, off)
    assert len({int(v) for v in hashing.windows(h, 2048)[at[:-1]]}) == 2


@pytest.mark.parametrize("n", [1, 7, 8, 9, 16, 23])
def test_equal_ranges_have_equal_hashes(n):
    rng = np.random.default_rng(n)
    data = rng.integers(0, 3, 4000).astype(np.uint8)
    s = np.arange(len(data) - n + 1)
    h = hashing.ranges(data, s, s + n)
    texts = [data[i : i + n].tobytes() for i in s]
    assert len(set(texts)) == len(set(h.tolist())) == len(set(zip(texts, h.tolist(), strict=True)))


def test_operators_keep_them_apart(spark):
    rows = [(i, t) for i, t in enumerate(t for p in PAIRS for t in p)]
    assert rows_of(jaccard.components(docs_frame(spark, rows))) == sorted([(i, 1, i) for i, _ in rows], key=str)
    assert rows_of(suffix.substring_dedup(docs_frame(spark, rows))) == suffix_brute(rows)
    assert rows_of(suffix.substring_dedup(docs_frame(spark, rows), hot_units=1)) == suffix_brute(rows)
    lines = list(enumerate("\n".join(t.split()) for t in twins(2048, "left ", "right ")))
    assert rows_of(spans.sentence_span_dedup(docs_frame(spark, lines))) == span_brute(lines)


def test_encoder_compares_bytes(monkeypatch):
    P = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    from caseloom.llm import tokens

    path = P.path("byte_bpe_50k.json")
    tok = Tokenizer.from_file(path)
    texts = [t for p in PAIRS for t in p] + ["one two", "three two one", "two", " two"]
    want = [tok.encode(t, add_special_tokens=False).ids for t in texts]

    def ids(enc):
        flat, count = enc.encode(*bytes_of(pa.array(texts)))
        return [x.tolist() for x in np.split(flat, np.cumsum(count)[:-1])]

    enc = tokens.Encoder(path)
    assert ids(enc) == want and ids(enc) == want
    # a hash that knows nothing but the first letter still gives each text its own ids
    monkeypatch.setattr(tokens, "sums", lambda x, place, begin, length, seed=0: x[begin] & np.uint64(0xFF))
    enc = tokens.Encoder(path)
    assert ids(enc) == want and ids(enc) == want
