"""PII: candidate generators, boosted trees over format and context, calibrated thresholds.

The main path is column expressions alone.  For each kind, base spans are the
leftmost non-overlapping matches of a fixed pattern that pass a fixed test; they
always stay.  High-recall generators propose further, overlapping spans
(written-out mail addresses, numbers without a country sign, cards with other
separators or a failed check digit, addresses of eight groups).  Boosted trees
score every proposal by its format and the words beside it; a proposal stands if
its probability reaches its kind's threshold and it overlaps no base span.  Of
proposals that overlap one another the most probable is selected (then the
first, then the kind listed first).

The trees are trained on synthetic sentences (``TRAIN_ROWS``, a fixed seed),
once a driver: Spark computes their features by the same expressions, numpy
grows the trees, and a second part of the rows sets the thresholds, the lowest
with a precision of ``PRECISION``.  The sentences lead in with phrases of their
own (``LEADS``), of which some hold a word that the features look for and some
don't.  The trees then become CASE expressions.

Positions are code points, ends exclusive.  Patterns are written with
possessive parts and look-behinds so that they match what the plain ones do in
linear time, in very long runs too.

Rows: null text counts as empty and has no spans; rows with one id are judged
one by one; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import random
import warnings
from dataclasses import dataclass
from functools import lru_cache, reduce

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")
TRAIN_ROWS = 6000
PRECISION = 0.98
TREES = 24
DEPTH = 3
RATE = 0.3
CONTEXT = 24
BLOCK = 128
#: Code points a piece of a text; longer than a proposal and its context.
PIECE = 1024

_SPAN = "struct<start:int,kind:int,end:int,found:string>"
_SCORED = "struct<p:double,start:int,kind:int,end:int,found:string>"
_LOCAL = r"[A-Za-z0-9._%+-]"
#: The base patterns, as linear equivalents: a match begins at a run's start, or where the last match ended.
BASE = {
    "email": rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    # whole runs of digits with single separators, of 14 to 19 digits
    "card": r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?+[0-9]){13,18}+(?![ -]?[0-9])",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
#: Cheap tests that a text must pass before its patterns are tried.
MAY = {"email": "@", "ip": ".", "card": None, "phone": "+"}
#: High-recall generators.
WIDE = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+ ?[\[({<]? ?(?:@|\b(?:at|AT)\b) ?[\])}>]? ?[A-Za-z0-9-]{1,63}+(?: ?[\[({<]? ?(?:\.|\b(?:dot|DOT)\b) ?[\])}>]? ?[A-Za-z0-9-]{1,63}+){1,4}",
    "ip": r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:){3,7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])",
    "card": r"(?<![0-9])[0-9]{4}[ ._/-]?[0-9]{4,6}[ ._/-]?[0-9]{4,5}(?:[ ._/-]?[0-9]{1,4})?(?![0-9])",
    "phone": r"(?<![0-9+])(?:00[0-9]{1,3}[ .-])?\(?[0-9]{2,4}\)?[ ./-][0-9]{3,4}[ .-]?[0-9]{2,4}(?:[ .-][0-9]{2,4})?(?![0-9])",
}
MAY_WIDE = {"email": r"@|\b(?:at|AT)\b", "ip": r"[0-9A-Fa-f]:[0-9A-Fa-f]", "card": r"[0-9]{4}", "phone": r"[0-9][ ./)-]"}
#: Words beside a span that speak for its kind, or against any.
WORDS_FOR = {"email": "mail|contact|write|reply", "ip": "ip|host|server|addr|ping", "card": "card|visa|credit|pay|debit", "phone": "phone|tel|call|mobile|fax|cell"}
WORDS_AGAINST = "order|invoice|isbn|version|date|serial|ref|item|build|total|page|year|time"


#: Phrases before the number or address of a training sentence.
LEADS = {
    "email": ["mail me under", "my e-mail", "you reach me by", "write to", "send it over to", "inbox", "signed", "contact"],
    "ip": ["logged in from", "the server", "seen at", "host", "connect to", "node", "from address"],
    "card": ["charged to", "credit card", "billed on", "visa ending", "payment by", "holder number", "debit"],
    "phone": ["call me", "my number", "ring", "phone", "fax", "text me on", "reach us under", "mobile"],
}
OTHER_LEADS = ["order", "invoice no", "isbn", "version", "due date", "serial", "ref", "part", "build", "sum", "page", "year", "at the time", "section", "lot", "weighs"]


def carried(items: Column, move, each, kind: str) -> Column:
    """``each(item, state)`` of every item, in order; the state starts at 0 and is moved by each item before.

    Results are gathered in blocks of ``BLOCK`` and the blocks joined, so that a long array isn't copied at each step.
    """
    empty = F.array().cast(f"array<{kind}>")

    def heads(blocks: Column) -> Column:
        zero = F.struct(F.lit(0).alias("state"), F.array().cast("array<int>").alias("heads"))
        step = lambda acc, b: F.struct(F.aggregate(b, acc["state"], move).alias("state"), F.array_append(acc["heads"], acc["state"]).alias("heads"))
        return F.aggregate(blocks, zero, step, lambda acc: acc["heads"])

    def run(block: Column, head: Column) -> Column:
        step = lambda acc, x: F.struct(move(acc["state"], x).alias("state"), F.array_append(acc["out"], each(x, acc["state"])).alias("out"))
        return F.aggregate(block, F.struct(head.alias("state"), empty.alias("out")), step, lambda acc: acc["out"])

    cut = lambda xs: F.transform(F.sequence(F.lit(1), F.greatest(F.size(xs), F.lit(1)), F.lit(BLOCK)), lambda i: F.slice(xs, i, F.lit(BLOCK)))
    return _let(_let(items, cut), lambda blocks: F.flatten(F.zip_with(blocks, heads(blocks), run)))


def _let(value: Column, use) -> Column:
    """``use(value)``, with the value computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def located(text: Column, pattern: str, kind: int, keep) -> Column:
    """Spans (start, kind, end, found) of all matches that pass ``keep``, in order."""
    # the text behind the last match comes as a pair without a match
    pairs = F.zip_with(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1), lambda m, g: F.struct(m.alias("m"), g.alias("g")))

    def span(x: Column, at: Column) -> Column:
        a = at + F.length(x["g"])
        return F.struct(a.alias("start"), F.lit(kind).alias("kind"), (a + F.length(x["m"])).alias("end"), x["m"].alias("found"))

    spans = carried(pairs, lambda at, x: at + F.length(x["g"]) + F.length(x["m"]), span, _SPAN)
    return F.filter(spans, lambda s: s["found"].isNotNull() & keep(s["found"]))


def uncovered(wide: Column, base: Column) -> Column:
    """The spans of ``wide`` that overlap none of ``base``: one walk by position, with the farthest end of the base spans begun."""
    begun = F.transform(base, lambda b: F.struct(b["start"].alias("at"), F.lit(True).alias("base"), b.alias("s")))
    asked = F.transform(wide, lambda s: F.struct(s["end"].alias("at"), F.lit(False).alias("base"), s.alias("s")))
    move = lambda till, e: F.when(e["base"], F.greatest(till, e["s"]["end"])).otherwise(till)
    clear = lambda e, till: F.when(~e["base"] & (till <= e["s"]["start"]), e["s"])
    return F.filter(carried(F.array_sort(F.concat(begun, asked)), move, clear, _SPAN), lambda s: s.isNotNull())


def select(standing: Column) -> Column:
    """Of overlapping spans (p, start, kind, end, found) the one that comes first by p, then the next that is clear of it.

    Spans that overlap no other are taken at once; only the rest are held against one another.
    """
    over = lambda a, b: (a["start"] < b["end"]) & (b["start"] < a["end"])
    placed = F.array_sort(F.transform(standing, lambda s: F.struct(s["start"].alias("at"), s.alias("s"))))
    apart = lambda x, till: F.struct((till <= x["at"]).alias("apart"), x["s"].alias("s"))
    marked = carried(placed, lambda till, x: F.greatest(till, x["s"]["end"]), apart, f"struct<apart:boolean,s:{_SCORED}>")
    alone = lambda x, y: F.struct((x["apart"] & (y["s"].isNull() | (y["s"]["start"] >= x["s"]["end"]))).alias("alone"), x["s"].alias("s"))
    told = _let(marked, lambda xs: F.filter(F.zip_with(xs, F.slice(xs, F.lit(2), F.size(xs)), alone), lambda x: x["s"].isNotNull()))

    def best(chosen: Column, s: Column) -> Column:
        return F.when(F.exists(chosen, lambda c: over(c, s)), chosen).otherwise(F.array_append(chosen, s))

    def join(xs: Column) -> Column:
        part = lambda alone: F.transform(F.filter(xs, lambda x: x["alone"] == alone), lambda x: x["s"])
        return F.array_sort(F.concat(part(True), F.aggregate(F.array_sort(part(False)), F.array().cast(f"array<{_SCORED}>"), best)))

    return _let(told, join)


def digits(found: Column) -> Column:
    return F.regexp_replace(found, "[^0-9]", "")


def luhn(found: Column) -> Column:
    d = F.reverse(digits(found))

    def step(acc: Column, i: Column) -> Column:
        v = F.substring(d, i, F.lit(1)).cast("int") * F.when(i % 2 == 0, 2).otherwise(1)
        return acc + F.when(v > 9, v - 9).otherwise(v)

    n = F.length(d)
    return (n > 0) & (F.aggregate(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), F.lit(0), step) % 10 == 0)


def _between(n: Column, low: int, high: int) -> Column:
    return (n >= low) & (n <= high)


TESTS = {
    "email": lambda m: F.lit(True),
    "ip": lambda m: F.forall(F.split(m, r"\."), lambda p: (F.length(F.regexp_replace(p, "^0+", "")) <= 3) & (F.substring(F.concat(F.lit("000"), F.regexp_replace(p, "^0+", "")), -3, 3) <= "255")),
    "card": lambda m: _between(F.length(digits(m)), 14, 19) & luhn(m),
    "phone": lambda m: _between(F.length(digits(m)), 10, 15),
}


def _none() -> Column:
    return F.array().cast(f"array<{_SPAN}>")


def base_spans(text: Column) -> Column:
    parts = []
    for k, kind in enumerate(KINDS):
        may = F.contains(text, F.lit(MAY[kind])) if MAY[kind] else text.rlike("[0-9]")
        parts.append(F.when(may, located(text, BASE[kind], k, TESTS[kind])).otherwise(_none()))
    return F.array_sort(F.concat(*parts))


def wide_spans(text: Column) -> Column:
    parts = []
    for k, kind in enumerate(KINDS):
        parts.append(F.when(text.rlike(MAY_WIDE[kind]), located(text, WIDE[kind], k, lambda m: F.lit(True))).otherwise(_none()))
    return F.array_sort(F.concat(*parts))


FEATURES = (
    "kind", "n_digits", "n_letters", "n_signs", "n_groups", "longest", "checks", "at_sign", "n_dots", "ends_as_domain", "says_kind", "says_other", "says_no", "touches", "first_digit", "spaces", "brackets",
)


def features(text: Column, span: Column) -> Column:
    """The numbers that the trees read, as a struct of doubles."""
    m = span["found"]
    before = F.lower(F.substring(text, F.greatest(span["start"] - CONTEXT, F.lit(0)) + 1, F.least(span["start"], F.lit(CONTEXT))))
    after = F.substring(text, span["end"] + 1, F.lit(1))
    last = F.substring(text, span["start"], F.when(span["start"] > 0, 1).otherwise(0))
    count = lambda p: F.length(m) - F.length(F.regexp_replace(m, p, ""))
    groups = F.filter(F.split(m, "[^A-Za-z0-9]+"), lambda g: F.length(g) > 0)
    says = reduce(lambda acc, k: F.when(span["kind"] == k, before.rlike(WORDS_FOR[KINDS[k]])).otherwise(acc), range(len(KINDS)), F.lit(False))
    other = reduce(lambda a, b: a | b, [(span["kind"] != k) & before.rlike(WORDS_FOR[KINDS[k]]) for k in range(len(KINDS))])
    value = {
        "kind": span["kind"], "n_digits": count("[0-9]"), "n_letters": count("[A-Za-z]"), "n_signs": count("[^A-Za-z0-9 ]"), "n_groups": F.size(groups),
        "longest": F.array_max(F.transform(groups, F.length)), "checks": luhn(m), "at_sign": F.contains(m, F.lit("@")), "n_dots": count(r"\."),
        "ends_as_domain": F.lower(m).rlike(r"[. )\]](?:com|org|net|edu|gov|io|de|fr|es|uk|info|dev)$"), "says_kind": says, "says_other": other, "says_no": before.rlike(WORDS_AGAINST),
        "touches": last.rlike("[A-Za-z0-9]") | after.rlike("[A-Za-z0-9]"), "first_digit": F.coalesce(F.regexp_extract(m, "[0-9]", 0).try_cast("int"), F.lit(-1)), "spaces": count(" "), "brackets": count(r"[\[\](){}<>]"),
    }
    return F.struct(*[F.coalesce(value[f].cast("double"), F.lit(0.0)).alias(f) for f in FEATURES])


# --- trees -------------------------------------------------------------------


@dataclass
class Trees:
    """Each tree is nested (feature, cut, left, right) with leaf values; thresholds are by kind."""

    start: float
    trees: list
    thresholds: list[float]

    def logit(self, x: np.ndarray) -> np.ndarray:
        def value(t, rows):
            if not isinstance(t, tuple):
                return np.full(len(rows), t)
            out = np.empty(len(rows))
            left = x[rows, t[0]] <= t[1]
            out[left], out[~left] = value(t[2], rows[left]), value(t[3], rows[~left])
            return out

        rows = np.arange(len(x))
        return self.start + sum((value(t, rows) for t in self.trees), np.zeros(len(x)))

    def probability(self, row: Column) -> Column:
        def case(t) -> Column:
            if not isinstance(t, tuple):
                return F.lit(float(t))
            return F.when(row[FEATURES[t[0]]] <= t[1], case(t[2])).otherwise(case(t[3]))

        total = reduce(lambda a, b: a + b, [case(t) for t in self.trees], F.lit(float(self.start)))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))


def _grow(x: np.ndarray, g: np.ndarray, h: np.ndarray, rows: np.ndarray, depth: int):
    leaf = float(RATE * -g[rows].sum() / (h[rows].sum() + 1.0))
    if depth == 0 or len(rows) < 40:
        return leaf
    best, pick = 1e-6, None
    total_g, total_h = g[rows].sum(), h[rows].sum()
    base = total_g**2 / (total_h + 1)
    for f in range(x.shape[1]):
        for cut in np.unique(x[rows, f])[:-1]:
            left = x[rows, f] <= cut
            if min(left.sum(), (~left).sum()) < 20:
                continue
            lg, lh = g[rows[left]].sum(), h[rows[left]].sum()
            gain = lg**2 / (lh + 1) + (total_g - lg) ** 2 / (total_h - lh + 1) - base
            if gain > best:
                best, pick = gain, (f, float(cut), left)
    if pick is None:
        return leaf
    f, cut, left = pick
    return (f, cut, _grow(x, g, h, rows[left], depth - 1), _grow(x, g, h, rows[~left], depth - 1))


def boost(x: np.ndarray, y: np.ndarray) -> Trees:
    """Gradient boosting on the logistic loss; one row in three is kept for the thresholds."""
    fit = np.arange(len(x)) % 3 != 0
    a, b = x[fit], y[fit]
    share = min(max(b.mean(), 1e-3), 1 - 1e-3)
    model = Trees(float(np.log(share / (1 - share))), [], [2.0] * len(KINDS))
    logit = np.full(len(a), model.start)
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-logit))
        tree = _grow(a, p - b, p * (1 - p), np.arange(len(a)), DEPTH)
        model.trees.append(tree)
        logit += Trees(0.0, [tree], []).logit(a)
    p = 1 / (1 + np.exp(-model.logit(x[~fit])))
    for k in range(len(KINDS)):
        mine = x[~fit][:, 0] == k
        order = np.argsort(-p[mine], kind="stable")
        score, good = p[mine][order], np.cumsum(y[~fit][mine][order])
        last = np.append(score[1:] != score[:-1], True) if len(score) else np.zeros(0, bool)
        ok = np.flatnonzero((good / np.arange(1, len(score) + 1) >= PRECISION) & last)
        if len(ok):
            model.thresholds[k] = max(0.5, float(score[ok[-1]]))
        else:
            warnings.warn(f"no threshold for {KINDS[k]} reaches a precision of {PRECISION}: none is added", stacklevel=2)
    return model


def synthetic(rows: int = TRAIN_ROWS, seed: int = 7) -> list[tuple[int, str, int, int]]:
    """(n, sentence, start, end): sentences with one number or address; an empty span if it is no personal data."""
    rng = random.Random(seed)
    num = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    word = lambda: "".join(rng.choice("abcdefghijklmnoprstuvw") for _ in range(rng.randint(2, 9)))

    def card(n: int = 16, off: int = 0) -> str:
        """n digits that pass the check, or miss it by ``off``."""
        d = [int(c) for c in num(n - 1)]
        s = sum(v if i % 2 else (2 * v - 9 if v > 4 else 2 * v) for i, v in enumerate(reversed(d)))
        return "".join(map(str, [*d, (off - s) % 10]))

    out = []
    for n in range(rows):
        kind, good = rng.choice(KINDS), rng.random() < 0.5
        sep, left, right = rng.choice(" -./_"), "", ""
        lead = rng.choice(LEADS[kind]) if rng.random() < (0.85 if good else 0.05) else word()
        if kind == "email":
            at, dot = rng.choice([(" at ", " dot "), (" [at] ", " [dot] "), ("(at)", "(dot)"), (" @ ", "."), ("@", " dot "), (" (at) ", ".")])
            host = rng.choice(["com", "org", "net", "de", "io"]) if good else word()
            span = f"{word()}{at}{word()}{dot}{host}" if good else f"{word()} at {word()}{rng.choice(['. ', ' dot ', '.'])}{host}"
        elif kind == "ip":
            span = ":".join(f"{rng.randrange(1, 65536):x}" for _ in range(8)) if good else rng.choice([f"{num(2)}:{num(2)}:{num(2)}:{num(2)}", f"{num(1)}:{num(2)}:{num(1)}:{num(2)}:{num(1)}"])
        elif kind == "card":
            if rng.random() < 0.5:  # a plain run: the check digit tells; good ones stand alone or beside one that fails
                n_digits, lead = rng.choice([16, 16, 16, 14, 15, 17, 18, 19]), rng.choice([lead, word()])
                span = card(n_digits, 0 if good else rng.randint(1, 9))
                beside = card(n_digits, rng.randint(1, 9)) if good else ""
                left, right = rng.choice([("", ""), (f"{beside} ", ""), ("", f" {beside}")]) if good else ("", "")
            else:
                c = card() if rng.random() < 0.7 else num(16)
                span = sep.join(c[i : i + 4] for i in (0, 4, 8, 12)) if good else rng.choice([num(13), f"{num(4)}{sep}{num(4)}{sep}{num(4)}", f"{num(4)}-{num(5)}-{num(4)}-{num(2)}"])
        else:
            a, b, c = num(3), num(3), num(4)
            span = rng.choice([f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a} {b} {c}", f"00{num(2)} {a} {b}{c}", f"{a}.{b}.{c}"]) if good else rng.choice([f"{num(4)}-{num(3)}-{num(2)}", f"{num(2)}/{num(3)}-{num(3)}", f"{num(3)}.{num(3)} {num(2)}", f"{a} {b} {num(3)}", f"{num(3)} {num(3)}"])
        if not good and rng.random() < 0.6:
            lead = rng.choice(OTHER_LEADS)
        head = f"{word()} {word()} {lead}{rng.choice([': ', ' ', ' is '])}{left}"
        out.append((n, f"{head}{span}{right} {word()} {word()}.", len(head) if good else -1, len(head) + len(span)))
    return out


@lru_cache(maxsize=1)
def fit(spark: SparkSession) -> Trees:
    """The same trees each time; grown once for a session."""
    data = spark.createDataFrame(synthetic(), "n int, text string, a int, z int")
    got = data.select("n", "text", "a", "z", F.explode(wide_spans(F.col("text"))).alias("s")).select(
        "n", "a", "z", "s.kind", "s.start", "s.end", features(F.col("text"), F.col("s")).alias("f")
    )
    rows = sorted(got.collect(), key=lambda r: (r.n, r.start, r.kind, r.end))
    x = np.array([list(r.f) for r in rows], float).reshape(-1, len(FEATURES))
    y = np.array([float(r.a == r.start and r.z == r.end) for r in rows])
    return boost(x, y)


# --- operator ----------------------------------------------------------------


def _joined(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def find(docs: DataFrame, model: Trees | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, base and all spans (arrays of start, kind, end, found; by start, then kind), and the columns asked for."""
    model = model or fit(docs.sparkSession)
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("_t"), *keep)
    rows = rows.withColumn("base", base_spans(F.col("_t"))).withColumn("wide", wide_spans(F.col("_t")))
    least = F.array(*[F.lit(t) for t in model.thresholds])

    fields = ("start", "kind", "end", "found")

    def scored(s: Column) -> Column:
        """The span behind minus its probability, or behind 1 where it stays under the threshold."""
        # two pieces hold the span and what lies beside it: a place far into a long text is slow to reach
        piece = F.floor(F.greatest(s["start"] - CONTEXT, F.lit(0)) / PIECE).cast("int")
        near = F.concat(F.get("pieces", piece), F.coalesce(F.get("pieces", piece + 1), F.lit("")))
        there = F.struct((s["start"] - piece * PIECE).alias("start"), s["kind"].alias("kind"), (s["end"] - piece * PIECE).alias("end"), s["found"].alias("found"))
        seen = _let(F.struct(near.alias("text"), there.alias("span")), lambda x: features(x["text"], x["span"]))
        behind = lambda p: F.struct(F.when(p >= F.get(least, s["kind"]), -p).otherwise(1.0).alias("p"), *[s[c].alias(c) for c in fields])
        return _let(_let(seen, model.probability), behind)

    standing = F.filter(F.transform(uncovered(F.col("wide"), F.col("base")), scored), lambda s: s["p"] <= 0)
    added = F.transform(select(standing), lambda s: F.struct(*[s[c].alias(c) for c in fields]))
    pieces = F.regexp_extract_all("_t", F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0))
    rows = rows.withColumn("pieces", F.when(F.size("wide") > 0, pieces))
    rows = rows.withColumn("added", F.when(F.size("wide") > 0, added).otherwise(_none()))
    return rows.withColumn("spans", F.when(F.size("added") > 0, F.array_sort(F.concat("base", "added"))).otherwise(F.col("base"))).drop("wide", "pieces")


def personal_data(docs: DataFrame, model: Trees | None = None) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added) of each row."""
    rows = find(docs, model)
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    return rows.select("doc_id", *[count(k).alias(f"n_{kind}") for k, kind in enumerate(KINDS)], F.sha2(_joined(F.col("base")), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans"), F.size("added").cast("long").alias("n_added"))


def redact(docs: DataFrame, model: Trees | None = None) -> DataFrame:
    """The documents' columns, with each span in ``text`` replaced by its kind in angle brackets."""
    names = docs.columns
    rows = find(docs.select("doc_id", "text", *[F.col(c).alias(f"_k_{c}") for c in names if c not in ("doc_id", "text")]), model, tuple(f"_k_{c}" for c in names if c not in ("doc_id", "text")))
    kinds = F.array(*[F.lit(f"<{k}>") for k in KINDS])

    def step(acc: Column, s: Column) -> Column:
        gap = F.substring(F.col("_t"), acc["at"] + 1, F.greatest(s["start"] - acc["at"], F.lit(0)))
        text = F.when(s["start"] >= acc["at"], F.concat(acc["out"], gap, F.get(kinds, s["kind"]))).otherwise(acc["out"])
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), text.alias("out"))

    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    text = F.aggregate("spans", start, step, lambda acc: F.concat(acc["out"], F.substring(F.col("_t"), acc["at"] + 1, F.length("_t"))))
    return rows.select(*[("doc_id" if c == "doc_id" else text.alias("text") if c == "text" else F.col(f"_k_{c}").alias(c)) for c in names])
