"""Pages far into a sorted list, without sorting what comes before.

The page's rows lie between two keys.  A bounded sample parts the list into
ranges, one pass counts each range, and the range that holds the page's first
row is parted again, until it has few rows; only these and the page are
ordered.  What is sorted depends on the page, not on its offset; nothing is
shuffled but counts, and all columns are read for the last range alone.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caseloom.operators.listing import DEFAULT_PAGE, order_key, page_bounds

#: Keys that come to the driver in a round, ranges that they part, and rows that are few.
SAMPLE = 20_000
RANGES = 16
FEW = 50_000

Keys = list[tuple[Column, bool]]


@dataclass(frozen=True)
class Span:
    """Rows from ``low`` (inclusive, None: the first) to ``high`` (exclusive, None: the last), how many, and how many are before."""

    low: tuple | None
    high: tuple | None
    rows: int
    before: int


def _before(keys: Keys, bound: tuple) -> Column:
    """Whether a row stands before a bound; nulls are the largest value."""
    out = F.lit(False)
    for (c, descending), b in zip(reversed(keys), reversed(bound), strict=True):
        if b is None:
            less, same = (F.lit(False) if descending else c.isNotNull()), c.isNull()
        else:
            value = F.lit(b)
            less = (c.isNull() | (c > value)) if descending else F.coalesce(c < value, F.lit(False))
            same = F.coalesce(c == value, F.lit(False))
        out = less | (same & out)
    return out


def _range(keys: Keys, bounds: list[tuple], first: int = 0) -> Column:
    """The number of bounds at or before a row, by halving."""
    if not bounds:
        return F.lit(first)
    m = len(bounds) // 2
    return F.when(_before(keys, bounds[m]), _range(keys, bounds[:m], first)).otherwise(_range(keys, bounds[m + 1 :], first + m + 1))


def _within(keys: Keys, span: Span) -> Column:
    low = F.lit(True) if span.low is None else ~_before(keys, span.low)
    return low if span.high is None else low & _before(keys, span.high)


def narrowed(rows: DataFrame, keys: Keys, span: Span, offset: int) -> Span:
    """The part of a span that holds the row at ``offset``; the span itself where its keys can't be parted."""
    named = rows.filter(_within(keys, span)).select(*[c.alias(f"k{i}") for i, (c, _) in enumerate(keys)])
    own = [(F.col(f"k{i}"), d) for i, (_, d) in enumerate(keys)]
    some = named.sample(min(1.0, SAMPLE / span.rows), seed=7).orderBy(*[order_key(c, d) for c, d in own]).limit(2 * SAMPLE).collect()
    cut = sorted({len(some) * i // RANGES for i in range(1, RANGES)} - {0})
    bounds = list(dict.fromkeys(tuple(some[i]) for i in cut))
    # a bound with NaN or the like equals itself in Spark's order, so equal ones are one
    count = {r.r: r["count"] for r in named.groupBy(_range(own, bounds).alias("r")).count().collect()}
    at = span.before
    for i in range(len(bounds) + 1):
        n = count.get(i, 0)
        if at + n > offset:
            return Span(bounds[i - 1] if i else span.low, bounds[i] if i < len(bounds) else span.high, n, at)
        at += n
    return span


def deep_page(df: DataFrame, where: Column, keys: Keys, page: int, limit: int = DEFAULT_PAGE, first: int = 1, few: int = FEW) -> DataFrame:
    """A page of the rows of ``where`` in the order of (column, descending) keys, as ``listing.rows_of_page`` gives it.

    The keys should end with one that tells rows apart; rows with equal keys stand in any order, as there.
    """
    offset, limit = page_bounds(page, limit, first)
    rows = df.filter(where)
    span = Span(None, None, rows.count(), 0)
    if offset >= span.rows:
        return rows.limit(0)
    while span.rows > few:
        part = narrowed(rows, keys, span, offset)
        if part.rows == span.rows:
            break
        span = part
    # the page may run on past the range; what follows it is ordered no further than the page
    start = rows if span.low is None else rows.filter(~_before(keys, span.low))
    order = [order_key(c, d) for c, d in keys]
    skip = offset - span.before
    if span.high is None or skip + limit <= span.rows:
        start = start if span.high is None else start.filter(_before(keys, span.high))
    return start.orderBy(*order).offset(skip).limit(limit)
