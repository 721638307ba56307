"""Quality and language: held-out accuracy and odd rows."""

import random
import zlib

import numpy as np
import pytest

from caseloom.llm import language, quality
from tests.llm.util import docs_frame


def is_held(d):
    return zlib.crc32(str(d).encode()) % 5 == 0


def words(rng, letters, n):
    return " ".join("".join(rng.choice(letters) for _ in range(rng.randint(2, 8))) for _ in range(n))


def quality_rows(n=700):
    rng = random.Random(2)
    docs, labels = [], []
    for i in range(n):
        good = i % 4 != 0
        t = words(rng, "aeinrst", rng.randint(5, 120))
        if not good:
            t = t.upper().replace(" ", "!! ") if i % 8 else " ".join(w for w in t.split()[:9] for _ in range(12))
        docs.append((i, t))
        labels.append((i, int(good), 0))
    return docs, labels


def test_quality_learns_and_holds_out(spark):
    docs, labels = quality_rows()
    odd = [(10_001, None), (10_002, ""), (10_003, "word " * 60_000), (None, "plain text"), (3, "twice")]
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = quality.quality(docs_frame(spark, docs + odd), lab).collect()
    assert len(got) == len(docs) + len(odd)
    truth = {d: q for d, q, _ in labels}
    held = [r for r in got if r.doc_id is not None and r.doc_id < 10_000 and is_held(r.doc_id)]
    assert all(r.held_out == (r.doc_id is not None and is_held(r.doc_id)) for r in got)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    assert np.mean([r.predicted == truth[r.doc_id] for r in held]) > 0.9
    by = {r.doc_id: r.score for r in got}
    assert by[10_001] == by[10_002]


def test_quality_without_labels_or_rows(spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert [r.score for r in quality.quality(docs_frame(spark, [(1, "a")]), none).collect()] == [1.0]
    assert quality.quality(docs_frame(spark, []), none).collect() == []


def test_quality_keeps_columns_with_clashing_names(spark):
    docs, labels = quality_rows(400)
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    df = docs_frame(spark, docs).selectExpr("doc_id", "text", "'k' AS quality_score", "1 AS quality")
    kept = quality.keep_good(df, lab)
    assert kept.columns == df.columns
    good = {d for d, q, _ in labels if q}
    ids = {r.doc_id for r in kept.collect()}
    assert len(ids & good) / len(good) > 0.97 and len(ids - good) < 0.3 * (len(labels) - len(good))


def test_chunks_of_long_texts_equal_one_pass():
    rng = np.random.default_rng(0)
    docs, labels = quality_rows(200)
    net = quality.train([t.encode() for _, t in docs], np.array([q for _, q, _ in labels], np.float32))
    data = rng.integers(32, 120, 3_000_000).astype(np.uint8)
    both = net.scores(data, np.array([0, 10, len(data)]))
    sym, begin = quality.symbols(data[10:], np.array([0, len(data) - 10]))
    whole = net.chunks(sym).max(0, keepdims=True)
    logit = net.head(whole)[2]
    assert abs(both[1] - 1 / (1 + np.exp(-logit[0]))) < 1e-5
    alone = net.scores(data[:10], np.array([0, 10]))
    assert abs(both[0] - alone[0]) < 1e-6


def plain_network(net, text):
    """The forward pass by loops over one text: symbols, chunks of two halves, maximum, dense layer."""
    b, symbol = text.encode(), []
    for i, c in enumerate(b):
        again = i >= 3 + quality.LAGS and any(b[i - 3 : i + 1] == b[i - 3 - lag : i + 1 - lag] for lag in range(1, quality.LAGS + 1))
        symbol.append(c + 256 * again)
    halves = max(2, -(-len(b) // quality.HALF))
    symbol += [quality.PAD] * (halves * quality.HALF - len(b))
    best = np.full(quality.FILTERS, -np.inf)
    for i in range(halves - 1):
        x = np.concatenate([net.emb[k] for k in symbol[i * quality.HALF : (i + 2) * quality.HALF]])
        best = np.maximum(best, x.astype(float) @ net.filt.astype(float))
    hidden = np.tanh(np.maximum(best + net.bias, 0) @ net.dense.astype(float) + net.dense_bias)
    return 1 / (1 + np.exp(-(hidden @ net.out + net.out_bias[0] + net.shift)))


def test_scores_are_those_of_a_plain_forward_pass(spark):
    rng = random.Random(4)
    docs, labels = quality_rows(300)
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    df = docs_frame(spark, docs + [(5000, None), (5001, ""), (5002, "a"), (5003, "é ß " * 9), (5004, words(rng, "abc", 900)), (5005, "aaaaaaaaaaaaaaaaaaaaaaaaa" * 3), (5006, "12345678"), (5007, "123456789")])
    net = quality.fit(df, lab)
    got = {(r.doc_id, r.text): r.quality_score for r in quality.score(df, net).collect()}
    assert len(got) == len(docs) + 8
    for (_, t), p in got.items():
        assert abs(p - plain_network(net, t or "")) < 1e-4


def plain_bayes(rows, counts, text, bits=language.BITS):
    """log P(lang) + log P(gram | lang) over all grams, in plain Python."""
    def columns(t):
        low = [(c.lower() if len(c.lower()) == 1 else c) if c.isalpha() else " " for c in t]
        out = []
        for i in range(len(low)):
            h = 0
            for n in range(language.ORDERS):
                if i + n < len(low):
                    h = (h + ord(low[i + n]) + 1) * int(language._MUL[n]) % 2**32
                    x = h ^ (h >> 15)
                    out.append((n, (x * 0x2C1B3C6D % 2**32) >> (32 - bits)))
        return out

    logs = {}
    for lang in counts:
        seen = [dict() for _ in range(language.ORDERS)]
        for _, t, y in rows:
            if y == lang:
                for n, c in columns(t):
                    seen[n][c] = seen[n].get(c, 0) + 1
        total = [sum(s.values()) + language.ALPHA * 2**bits for s in seen]
        logs[lang] = np.log(counts[lang] / sum(counts.values())) + sum(np.log((seen[n].get(c, 0) + language.ALPHA) / total[n]) for n, c in columns(text))
    top = max(logs.values())
    best = max(counts, key=lambda k: logs[k])
    return best, 1 / sum(np.exp(v - top) for v in logs.values())


def test_language_is_plain_naive_bayes(spark):
    rng = random.Random(6)
    kinds = {"aa": "abcde", "bb": "abcdx", "zz": "äÖüßn"}
    rows = [(i, words(rng, kinds[k], rng.randint(1, 12)), k) for i, k in enumerate(rng.choice(list(kinds)) for _ in range(90))]
    rows += [(500, "", "aa"), (501, None, "bb"), (502, "A, B-C", None), (503, "x", None), (504, "ß9é", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    train = [(d, t or "", y) for d, t, y in rows if y and not is_held(d)]
    counts = {k: sum(y == k for *_, y in train) for k in kinds}
    got = {r.doc_id: r for r in language.language(df).collect()}
    for d, t, _ in rows:
        if not any(c.isalpha() for c in t or ""):
            assert (got[d].lang_pred, got[d].score) == ("und", 0.0)
            continue
        best, p = plain_bayes(train, counts, t)
        assert got[d].lang_pred == best and abs(got[d].score - p) < 1e-3


def test_every_language_is_learnt(spark, monkeypatch):
    rng = random.Random(7)
    letters = [chr(0x4E00 + 7 * k) + chr(0x4E00 + 7 * k + 1) for k in range(300)]
    rows = [(i, words(rng, letters[i % 300], 6), f"l{i % 300}") for i in range(1500)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    monkeypatch.setattr(language, "MATRIX_BYTES", 8 << 20)
    assert language.bits_for(300) < language.BITS
    got = language.language(df).filter("held_out").collect()
    assert np.mean([r.lang_pred == f"l{r.doc_id % 300}" for r in got]) > 0.95


def test_labels_that_teach_nothing(spark):
    docs, labels = quality_rows(300)
    extra = [(100_000 + i, 0, 0) for i in range(3000)] + [(1, 0, 0), (1, 1, 0), (2, 1, 0), (2, 1, 0), (None, 1, 0), (3, None, 0), (4, 7, 0)]
    schema = "doc_id long, quality int, toxic int"
    known = [(d, q) for d, q, _ in labels if d != 1 and not is_held(d)]
    from caseloom.llm.training import agreed, sample_ids

    lab = spark.createDataFrame(labels + extra, schema).filter("quality in (0, 1) and doc_id is not null").selectExpr("doc_id", "quality AS label")
    picked, counts = sample_ids(agreed(lab, docs_frame(spark, docs)).filter("crc32(cast(cast(doc_id as string) as binary)) % 5 <> 0"), 40)
    assert counts == {y: sum(q == y for _, q in known) for y in (0, 1)}
    assert len(picked) == len(set(picked)) == 80 and set(picked) <= set(known)


def test_nothing_that_fits_is_an_error(spark, monkeypatch):
    import pytest

    monkeypatch.setattr(language, "TRAIN_BYTES", 3)
    df = spark.createDataFrame([(i, "far too long", "aa") for i in range(9)], "doc_id long, text string, lang string")
    with pytest.raises(ValueError, match="none of the picked texts"):
        language.language(df)


def test_language(spark):
    rng = random.Random(5)
    kinds = {"aa": "abcde", "bb": "vwxyz", "zz": "äöüßn"}
    rows = [(i, words(rng, list(kinds.values())[i % 3], rng.randint(3, 60)), list(kinds)[i % 3] if i % 11 else None) for i in range(400)]
    odd = [(1001, None, "aa"), (1002, "", None), (1003, "12 -- !", "bb"), (1004, "\U0001f600 \U00020000", None), (None, "abc abc", "aa"), (1005, "vw " * 200_000, None)]
    df = spark.createDataFrame(rows + odd, "doc_id long, text string, lang string").selectExpr("*", "'x' AS lang_pred", "0 AS score")
    got = {r.doc_id: r for r in language.language(df).collect()}
    assert len(got) == len(rows) + len(odd)
    held = [(list(kinds)[i % 3], got[i].lang_pred) for i in range(400) if is_held(i)]
    assert np.mean([a == b for a, b in held]) > 0.97
    assert [got[i].lang_pred for i in (1001, 1002, 1003)] == ["und"] * 3 and got[1001].score == 0
    assert got[1004].lang_pred in kinds and got[1005].lang_pred == "bb" and got[None].lang_pred == "aa"
    assert all(0 <= r.score <= 1 for r in got.values())


def test_sample_passes_over_texts_that_do_not_fit(spark):
    from caseloom.llm.training import sample_texts

    for long in range(6):  # whichever comes first by hash
        docs = docs_frame(spark, [(i, "x" * (100 if i == long else 10)) for i in range(6)] + [(9, None)])
        got = sample_texts(docs, [(i, "aa") for i in (*range(6), 9)], 50)
        assert sorted(d for d, _, _ in got) == [i for i in (*range(6), 9) if i != long]
        assert sum(len(t) for _, t, _ in got) == 50


def test_language_without_labels(spark):
    df = spark.createDataFrame([(1, "abc", None)], "doc_id long, text string, lang string")
    assert [(r.lang_pred, r.score) for r in language.language(df).collect()] == [("und", 0.0)]
    assert language.language(df.limit(0)).collect() == []


def test_many_languages_in_bounded_memory():
    """Hundreds of languages, a long text and many short ones: steps stay small, answers are those of a plain sum."""
    import tracemalloc

    names = ["".join(chr(97 + i // 26**k % 26) for k in range(3)) for i in range(400)]
    model = language.train([(i, f"{x} " * 20, x) for i, x in enumerate(names)], dict.fromkeys(names, 1))
    assert model.bits < language.BITS and model.matrix.nbytes <= language.MATRIX_BYTES * 1.01
    texts = [f"{names[17]} " * 60_000, *[names[5]] * 20_000, "", names[399]]
    raw = "".join(texts).encode()
    off = np.concatenate(([0], np.cumsum([len(t) for t in texts])))
    tracemalloc.start()
    k, p = model.predict(np.frombuffer(raw, np.uint8), off)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 200 << 20
    cols = language.grams(np.frombuffer(names[5].encode(), np.uint8), np.array([0, 3]), model.bits)[0]
    plain = model.prior + sum(model.matrix[c].astype(float).sum(0) for c in cols)
    assert k[0] == 17 and (k[1:-2] == plain.argmax()).all() and k[-2] == -1 and k[-1] == 399
    assert abs(p[1] - 1 / np.exp(plain - plain.max()).sum()) < 1e-6
    with pytest.raises(ValueError):
        language.bits_for(1_000_000)
