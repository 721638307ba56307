"""Projections of stored rows for the outside: what is hidden, what answers look like."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Patient columns that never leave.
HIDDEN = ("blocked_at", "login_attempts", "otp", "otp_expired_date_time", "otp_send_date_time", "otp_verified_at", "password")


def public_patient(df: DataFrame) -> DataFrame:
    return df.drop(*HIDDEN)


def answer(data: Column, message: Column, code: int = 200, page: Column | None = None, ok: bool = True) -> Column:
    """The reply as JSON: data (an empty object for null), page if there is one, and the status."""
    status = F.struct(message.alias("description"), F.lit("SUCCESS" if ok else "ERROR").alias("status"), F.lit(code).alias("statusCode"))
    empty = F.lit("{}")
    parts = [F.lit('{"data":'), F.coalesce(F.to_json(data), empty)]
    if page is not None:
        parts += [F.lit(',"page":'), F.coalesce(F.to_json(page), empty)]
    return F.concat(*parts, F.lit(',"status":'), F.to_json(status), F.lit("}"))
