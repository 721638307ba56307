"""Dates, numbers, tokens and ids."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def plus_minutes(ts: Column, minutes: int | Column) -> Column:
    n = F.lit(minutes) if isinstance(minutes, int) else minutes
    return ts + F.make_dt_interval(mins=n)


# Seconds of each unit; what no duration says counts as seven days.
UNIT_SECONDS = {"s": 1, "m": 60, "h": 3600, "d": 86400}
FALLBACK_SECONDS = 7 * 86400


def duration_seconds(c: Column) -> Column:
    """``15m`` is 900; anything else than digits and one unit is seven days."""
    n = F.regexp_extract(c, r"^([0-9]+)[smhd]\z", 1).try_cast("bigint")
    unit = F.regexp_extract(c, r"^[0-9]+([smhd])\z", 1)
    scale = F.lit(None).cast("bigint")
    for u, s in UNIT_SECONDS.items():
        scale = F.when(unit == u, F.lit(s).cast("bigint")).otherwise(scale)
    return F.coalesce(n * scale, F.lit(FALLBACK_SECONDS).cast("bigint"))


def expires(ts: Column, duration: Column) -> Column:
    return ts + F.make_dt_interval(secs=duration_seconds(duration).cast("decimal(18,6)"))


# Texts that mean no date.
NO_DATE = ("", "Not Found")


# The forms of a date besides the ISO one, with what tells each.
DATE_FORMS = (
    (r"^[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}\z", "M/d/y"), (r"^[0-9]{4}/[0-9]{1,2}/[0-9]{1,2}\z", "y/M/d"), (r"^[0-9]{1,2}-[0-9]{1,2}-[0-9]{4}\z", "M-d-y"),
    (r"^[A-Z][a-z]{2} [0-9]{1,2},? [0-9]{4}\z", "MMM d y"), (r"^[A-Z][a-z]{3,8} [0-9]{1,2},? [0-9]{4}\z", "MMMM d y"),
    (r"^[0-9]{1,2} [A-Z][a-z]{2} [0-9]{4}\z", "d MMM y"), (r"^[0-9]{1,2} [A-Z][a-z]{3,8} [0-9]{4}\z", "d MMMM y"),
)


def read_date(c: Column) -> Column:
    """A date in ISO form, as month/day/year, year/month/day, or with the month's English name; null for anything else."""
    low = F.initcap(F.trim(c))
    other = F.lit(None).cast("date")
    for shape, form in reversed(DATE_FORMS):
        other = F.when(low.rlike(shape), F.try_to_timestamp(F.replace(low, F.lit(","), F.lit("")), F.lit(form)).cast("date")).otherwise(other)
    return F.coalesce(F.try_to_date(c), other)


def date_or_null(c: Column) -> Column:
    """Sentinels and null give null; what is no date too (``is_bad_date`` tells it)."""
    return F.when(c.isin(*NO_DATE), F.lit(None)).otherwise(read_date(c)).cast("date")


def is_bad_date(c: Column) -> Column:
    return F.coalesce(c.isNotNull() & ~c.isin(*NO_DATE) & read_date(c).isNull(), F.lit(False))


def number_or(c: Column, default: float) -> Column:
    """A finite number or the default."""
    n = F.trim(c).try_cast("double")
    return F.when(n.isNotNull() & ~F.isnan(n) & (F.abs(n) != float("inf")), n).otherwise(F.lit(float(default)))


def truth(c: Column) -> Column:
    return F.coalesce(c == "true", F.lit(False))


def token_hash(c: Column) -> Column:
    return F.sha2(c, 256)


def bearer(c: Column) -> Column:
    """The token of ``Bearer token``; null for any other header."""
    part = F.split(c, " ")
    return F.when((F.get(part, F.lit(0)) == "Bearer") & (F.coalesce(F.get(part, F.lit(1)), F.lit("")) != ""), F.get(part, F.lit(1)))


def base_name(c: Column) -> Column:
    return F.element_at(F.split(c, "/"), -1)


def full_name(first: Column, last: Column) -> Column:
    """Both names, or null unless both are given."""
    return F.when((F.coalesce(first, F.lit("")) != "") & (F.coalesce(last, F.lit("")) != ""), F.concat_ws(" ", first, last))


def decode_json(c: Column, ddl: str) -> Column:
    """Base64 of a JSON object."""
    return F.from_json(F.unbase64(c).cast("string"), ddl)


def one_time_code(seed: int) -> Column:
    """Six digits, uniform from 100000 to 999999."""
    return F.floor(F.rand(seed) * 900_000 + 100_000).cast("int").cast("string")


def patient_code(seed: int, prefix: str = "") -> Column:
    return F.concat(F.lit(prefix), F.floor(F.rand(seed) * 990_000 + 10_000).cast("int").cast("string"))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with the value computed once a row however often the body reads it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))
