"""Supply arithmetic of prescriptions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The unit of each medication type, and of any other.
UNITS = {"TABLET": "PILLS", "CAPSULE": "PILLS", "SYRUP": "ML", "DROP": "DROPS", "INJECTION": "UNITS"}
OTHER_UNIT = "PILLS"


def unit_of(kind: Column) -> Column:
    out = F.lit(OTHER_UNIT)
    for k, u in UNITS.items():
        out = F.when(kind == k, F.lit(u)).otherwise(out)
    return out


def daily(dose: Column, times: Column) -> Column:
    return (dose * times).cast("bigint")


def end_date(quantity: Column, per_day: Column, start: Column, ongoing: Column) -> Column:
    """The day after the last covered one; null if ongoing or nothing is taken."""
    days = F.ceil(F.try_divide(quantity.cast("double"), per_day.cast("double"))).cast("int")
    return F.when(~ongoing, F.date_add(start.cast("date"), days))


def remaining(quantity: Column, per_day: Column, start: Column, as_of: Column) -> Column:
    """What is left at as_of after whole days from the start, never below 0; nothing is used before the start."""
    days = F.greatest(F.datediff(as_of.cast("date"), start.cast("date")), F.lit(0))
    return F.greatest(quantity.cast("bigint") - days * per_day, F.lit(0).cast("bigint"))


def supply(dose: Column, times: Column, quantity: Column, start: Column, ongoing: Column, kind: Column, as_of: Column) -> Column:
    d = daily(dose, times)
    return F.struct(d.alias("daily_consumption"), end_date(quantity, d, start, ongoing).alias("end_date"), remaining(quantity, d, start, as_of).alias("remaining_quantity"), unit_of(kind).alias("unit"))
