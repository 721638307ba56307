"""Base spans against the plain patterns; proposals, thresholds and redaction."""

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from caseloom.llm import pii
from tests.llm.util import docs_frame

PLAIN = (
    ("email", re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")),
    ("ip", re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")),
    ("card", re.compile(r"[0-9]([\x20-]?[0-9])+")),
    ("phone", re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")),
)


def digits(s):
    return re.sub("[^0-9]", "", s)


def luhn(d):
    return sum(v if i % 2 == 0 else (2 * v - 9 if v > 4 else 2 * v) for i, v in enumerate(int(c) for c in reversed(d))) % 10 == 0


TEST = {
    "email": lambda s: True,
    "ip": lambda s: all(int(p) <= 255 for p in s.split(".")),
    "card": lambda s: 14 <= len(digits(s)) <= 19 and luhn(digits(s)),
    "phone": lambda s: 10 <= len(digits(s)) <= 15,
}


def base(text):
    out = []
    for k, (kind, p) in enumerate(PLAIN):
        out += [(m.start(), k, m.end(), kind) for m in p.finditer(text or "") if TEST[kind](m.group())]
    out.sort()
    joined = ",".join(f"{kind}:{a}:{z}" for a, _, z, kind in out)
    return [sum(1 for x in out if x[1] == k) for k in range(4)], hashlib.sha256(joined.encode()).hexdigest(), joined


@pytest.fixture(scope="module")
def model(spark):
    return pii.fit(spark)


CASES = [
    None, "", "a@b.c", "x a@b.c_x@d.e y", "a@b..c", "a@b.c.@d.e", "@a.b", "é.a@b.de\U0001f600 z@y.x", "a%b+c-d@x-y.z-1.q", "a@b@c.d", "a.b@c.d@e.f.g", "1.2.3.4", "1.2.3.4.5.6.7.8.9", "999.1.2.3.4", "0255.000.1.1", "1.2.3", "1.2.3.4.256.1.1.1.1",
    "4111111111111111", "4111 1111 1111 1111", "4111-1111 1111-1111", "4111  1111 1111 1111", "41111111111111112", "x4111111111111111x", "9 4111111111111111", "4111111111111111 9", "4111111111111111 ", "1-2-3-4-5-6-7-8-9-0-1-2-3-4", "000000000000000000 0",
    "+1 (017) 555-7713", "+1 2", "+12345678901234567", "++1234567890", "+1234567890+2345678901", "+1.......234567890.", "+1 (2) 3-4.5 6 7 8 9 0 1 2 3 4", "+1" + " " * 300 + "234567890",
    "a" * 30_000, "1" * 30_000, "1 " * 20_000, "1.2." * 5_000, "a@" * 3_000, "a.b@" * 500 + "c.d", "+1 " * 3_000,
]


def test_base_spans(spark, model):
    rng = random.Random(4)
    parts = ["a@b.c", "1.2.3.4", "4111111111111111", "+1 234 567 8901", ".", " ", "-", "@", "9", "+", "x", "é", "\n", "_", "256.1"]
    texts = CASES + ["".join(rng.choice(parts) for _ in range(rng.randint(1, 25))) for _ in range(300)]
    got = {r.doc_id: r for r in pii.personal_data(docs_frame(spark, enumerate(texts)), model).collect()}
    for i, t in enumerate(texts):
        n, sha, joined = base(t)
        r = got[i]
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == n, (t or "")[:80]
        assert r.base_sha256 == sha, (t or "")[:80]
        assert set(filter(None, joined.split(","))) <= set(r.spans.split(",")) and len(list(filter(None, r.spans.split(",")))) == sum(n) + r.n_added


def test_added_spans(spark, model):
    texts = ["please call tel (555) 123-4567 now", "contact ann at example dot com today", "the order 555-123-4567 shipped", "version 1:22:3:44", "host 2001:db8:1:2:3:4:5:6 is up", "we met at noon. then left"]
    got = {r.doc_id: r for r in pii.personal_data(docs_frame(spark, enumerate(texts)), model).collect()}
    assert got[0].n_added == 1 and got[0].spans == "phone:16:30"
    assert got[1].n_added == 1 and got[1].spans.startswith("email:")
    assert got[4].n_added == 1 and got[4].spans.startswith("ip:")
    assert got[2].n_added == got[3].n_added == got[5].n_added == 0


def plain_features(text, start, kind, end, m):
    before, after, last = text[max(start - pii.CONTEXT, 0) : start].lower(), text[end : end + 1], text[max(start - 1, 0) : start]
    count = lambda p: len(m) - len(re.sub(p, "", m))
    groups = [g for g in re.split("[^A-Za-z0-9]+", m) if g]
    said = [bool(re.search(pii.WORDS_FOR[k], before)) for k in pii.KINDS]
    first = re.search("[0-9]", m)
    value = {
        "kind": kind, "n_digits": count("[0-9]"), "n_letters": count("[A-Za-z]"), "n_signs": count("[^A-Za-z0-9 ]"), "n_groups": len(groups), "longest": max(map(len, groups), default=0), "checks": bool(digits(m)) and luhn(digits(m)), "at_sign": "@" in m,
        "n_dots": count(r"\."), "ends_as_domain": bool(re.search(r"[. )\]](?:com|org|net|edu|gov|io|de|fr|es|uk|info|dev)$", m.lower())), "says_kind": said[kind], "says_other": any(s for k, s in enumerate(said) if k != kind), "says_no": bool(re.search(pii.WORDS_AGAINST, before)),
        "touches": bool(re.search("[A-Za-z0-9]", last + after)), "first_digit": int(first.group()) if first else -1, "spaces": count(" "), "brackets": count(r"[\[\](){}<>]"),
    }
    return [float(value[f]) for f in pii.FEATURES]


def plain_spans(text, model):
    """Base spans, and what generators, trees and selection add, by lists."""
    fixed = [(m.start(), k, m.end()) for k, (kind, p) in enumerate(PLAIN) for m in p.finditer(text) if TEST[kind](m.group())]
    asked = []
    for k, kind in enumerate(pii.KINDS):
        if re.search(pii.MAY_WIDE[kind], text):
            asked += [(m.start(), k, m.end(), m.group()) for m in re.finditer(pii.WIDE[kind], text)]
    scored = []
    for s, k, e, m in asked:
        if any(s < z and a < e for a, _, z in fixed):
            continue
        x, logit = plain_features(text, s, k, e, m), model.start
        for t in model.trees:
            while isinstance(t, tuple):
                t = t[2] if x[t[0]] <= t[1] else t[3]
            logit += t
        p = 1 / (1 + np.exp(-logit))
        if p >= model.thresholds[k]:
            scored.append((-p, s, k, e))
    added = []
    for _, s, k, e in sorted(scored):
        if not any(s < z and a < e for a, _, z in added):
            added.append((s, k, e))
    return ",".join(f"{pii.KINDS[k]}:{s}:{e}" for s, k, e in sorted(fixed + added)), len(added)


def test_all_spans_are_those_of_plain_lists(spark, model):
    """The whole method by brute force: generators as plain patterns, trees walked, overlaps settled one by one."""
    rng = random.Random(12)
    num = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    make = [
        lambda: rng.choice(["call me ", "tel ", "my card ", "visa ending ", "host ", "order ", "invoice no ", "mail me under ", "version ", "x", ". ", "\n", " "]), lambda: f"({num(3)}) {num(3)}-{num(4)}", lambda: f"{num(3)}-{num(3)}-{num(4)}", lambda: f"00{num(2)} {num(3)} {num(4)} {num(3)}",
        lambda: "ann at example dot com", lambda: "bob (at) host.net", lambda: "x@y.de", lambda: f"{num(4)}/{num(4)}/{num(4)}/{num(4)}", lambda: "4111_1111_1111_1111", lambda: "4111.1111.1111.1111", lambda: num(16), lambda: "4111111111111111 " + num(16),
        lambda: ":".join(f"{rng.randrange(65536):x}" for _ in range(rng.randint(3, 8))), lambda: f"{num(1)}.{num(2)}.{num(3)}.{num(2)}", lambda: f"+1 ({num(3)}) {num(3)}-{num(4)}", lambda: num(rng.randint(1, 20)), lambda: " " * rng.randint(1, 40) + "word ",
    ]
    texts = ["".join(rng.choice(make)() + rng.choice(["", " ", ", "]) for _ in range(rng.randint(1, 14))) for _ in range(500)] + ["", "z" * 2000 + " call me (555) 123-4567 " * 100]
    got = {r.doc_id: (r.spans, r.n_added) for r in pii.personal_data(docs_frame(spark, enumerate(texts)), model).collect()}
    want = {i: plain_spans(t, model) for i, t in enumerate(texts)}
    assert got == want
    assert sum(n for _, n in want.values()) > 200


def test_cards_that_touch_other_digits(spark, model):
    # base spans join the runs and drop them; of the runs themselves those that pass the check are cards
    texts = ["eauenque de mentle 7536784127813050 4845168114407329 tre oile", "esanwh 2353820953013749 4550997810720808 thheed hand", "esanwh 2353820953013749 thheed 9807915762804490 hand", "pay 378282246310005 378282246310006 now"]
    got = {r.doc_id: r for r in pii.personal_data(docs_frame(spark, enumerate(texts)), model).collect()}
    assert [got[i].spans for i in range(4)] == ["card:19:35,card:36:52", "card:24:40", "", "card:4:19"]
    assert [got[i].n_added for i in range(4)] == [2, 1, 0, 1] and all(t <= 1 for t in model.thresholds)


def test_a_kind_without_threshold_is_said():
    x = np.zeros((300, len(pii.FEATURES)))
    with pytest.warns(UserWarning, match="no threshold for email"):
        assert pii.boost(x, np.arange(300) % 2 * 1.0).thresholds[0] == 2.0


def test_trees_tell_unseen_sentences_apart(spark, model):
    from pyspark.sql import functions as F

    rows = pii.synthetic(1500, seed=99)
    df = spark.createDataFrame(rows, "n int, text string, a int, z int").select("n", "a", "z", F.col("text"), F.explode(pii.wide_spans(F.col("text"))).alias("s"))
    got = df.select("a", "z", "s.kind", "s.start", "s.end", model.probability(pii.features(F.col("text"), F.col("s"))).alias("p"), pii.features(F.col("text"), F.col("s")).alias("f")).collect()
    truth = np.array([r.a == r.start and r.z == r.end for r in got])
    p = np.array([r.p for r in got])
    assert np.allclose(p, 1 / (1 + np.exp(-model.logit(np.array([list(r.f) for r in got])))))
    chosen = p >= np.array([model.thresholds[r.kind] for r in got])
    assert truth[chosen].mean() > 0.93 and chosen[truth].mean() > 0.6


def test_redaction_and_clashing_columns(spark, model):
    df = docs_frame(spark, [(1, "mail a@b.c or +1 234 567 8901!"), (2, None)]).selectExpr("text", "doc_id", "1 AS base", "'s' AS spans", "2 AS wide")
    out = pii.redact(df, model)
    assert out.columns == df.columns
    got = {r.doc_id: r for r in out.collect()}
    assert got[1].text == "mail <email> or <phone>!" and got[1].base == 1 and got[2].text == ""
    assert pii.personal_data(docs_frame(spark, []), model).collect() == []


def test_main_path_has_no_python(spark, model):
    plan = pii.personal_data(docs_frame(spark, [(1, "a")]), model)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_added_spans_do_not_overlap(spark):
    """Of overlapping proposals the most probable stays; base spans stay as they are."""
    rng = random.Random(11)
    part = lambda: rng.choice(["12", "1234", "5678", "x at y dot com", "a.b@c.de", "555-7713", "(017)", "+1 (017) 555-7713", "4845168114407329", "7536784127813050", "fe80:1:2:3:4:5:6:7", " ", "-", ".", " call ", " card "])
    rows = [(i, "".join(part() + rng.choice(["", " "]) for _ in range(rng.randint(1, 25)))) for i in range(120)]
    # thresholds of 0 let every clear proposal stand
    model = pii.Trees(0.0, [(2, 3.0, 0.4, -0.2)], [0.0] * 4)
    got = pii.find(docs_frame(spark, rows), model).collect()
    wide = {r.doc_id: r.w for r in docs_frame(spark, rows).select("doc_id", pii.wide_spans(F.col("text")).alias("w")).collect()}
    over = lambda a, b: a.start < b.end and b.start < a.end
    letters = lambda s: sum(c.isalpha() and c.isascii() for c in s.found)
    n = 0
    for r in got:
        want = []
        for s in sorted((s for s in wide[r.doc_id] if not any(over(s, b) for b in r.base)), key=lambda s: (letters(s) > 3, s.start, s.kind, s.end)):
            if not any(over(s, c) for c in want):
                want.append(s)
        assert [tuple(x) for x in r.added] == [tuple(x) for x in want]
        n += len(want)
    assert n > 50


def test_long_texts_are_judged_like_short_ones(spark, model):
    """Many spans over many pieces of a text: scores from the whole text, overlaps told apart pair by pair."""
    rng = random.Random(12)
    part = lambda: rng.choice(["call (017) 555-7713", "12", "4845168114407329", "7536784127813050 ", "ann at x dot com", "a.b@c.de", "+1 (017) 555-7713", "fe80:1:2:3:4:5:6:7", "order 123 456 7890", "\U0001f600", " card "])
    rows = [(i, "".join(part() + rng.choice(["", " ", ", "]) for _ in range(1200))) for i in range(3)]
    docs = docs_frame(spark, rows)
    s, text = F.col("s"), F.col("text")
    scored = docs.select("doc_id", text, F.explode(pii.wide_spans(text)).alias("s")).select("doc_id", s, model.probability(pii.features(text, s)).alias("p")).collect()
    over = lambda a, b: a.start < b.end and b.start < a.end
    for r in pii.find(docs, model).collect():
        standing = [x for x in scored if x.doc_id == r.doc_id and x.p >= model.thresholds[x.s.kind] and not any(over(x.s, b) for b in r.base)]
        want = []
        for x in sorted(standing, key=lambda x: (-x.p, x.s)):
            if not any(over(x.s, c) for c in want):
                want.append(x.s)
        assert [tuple(x) for x in r.added] == [tuple(x) for x in want]
        assert [(len(rows[r.doc_id][1][: x.start]), x.found) for x in r.spans] == [(x.start, rows[r.doc_id][1][x.start : x.end]) for x in r.spans]
        assert len(want) > pii.BLOCK and len(r.base) > pii.BLOCK
    assert max(len(t) for _, t in rows) > 10 * pii.PIECE
