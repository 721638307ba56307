"""Table schemas, ordered enums and column defaults."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Enum members in their order, which is their sort order.
ENUMS: dict[str, tuple[str, ...]] = {
    "document_type": ("family", "medical_document", "medication", "insurance", "other"),
    "file_type": ("application/document", "image/jpeg", "application/pdf", "image/png", "text/plain", "image/jpg"),
    "ocr_status": ("completed", "failed", "in_progress", "pending"),
    "user_status": ("ACTIVE", "BLOCKED", "INACTIVE"),
    "gender": ("female", "male"),
    "medication_type": ("TABLET", "CAPSULE", "SYRUP", "DROP", "INJECTION"),
    "frequency_type": ("ONCE_DAILY", "TWICE_DAILY", "THREE_TIMES_DAILY", "AS_NEEDED"),
    "food_type": ("BEFORE_FOOD", "AFTER_FOOD"),
    "best_taken": ("MORNING", "NOON", "NIGHT", "CUSTOM"),
    "medication_unit": ("PILLS", "ML", "DROPS", "UNITS"),
}

_AUDIT = "soft_delete BOOLEAN NOT NULL, deleted_at TIMESTAMP_NTZ, created_at TIMESTAMP_NTZ NOT NULL, updated_at TIMESTAMP_NTZ NOT NULL"

# Column names and types.
DDL: dict[str, str] = {
    "patients": "id STRING NOT NULL, patient_code STRING NOT NULL, user_name STRING NOT NULL, first_name STRING NOT NULL, last_name STRING NOT NULL, full_name STRING NOT NULL, email STRING NOT NULL, password STRING NOT NULL, status STRING NOT NULL, login_attempts INT NOT NULL, blocked_at TIMESTAMP_NTZ, otp STRING, otp_send_date_time TIMESTAMP_NTZ, otp_expired_date_time TIMESTAMP_NTZ, is_verified BOOLEAN NOT NULL, otp_verified_at TIMESTAMP_NTZ, gender STRING NOT NULL, age INT NOT NULL, phone STRING NOT NULL, profile_image_key STRING, "
    + _AUDIT,
    "documents": "id STRING NOT NULL, user_id STRING NOT NULL, document_type STRING NOT NULL, file_name STRING NOT NULL, file_path STRING NOT NULL, s3_bucket STRING, s3_key STRING, file_type STRING NOT NULL, file_size INT NOT NULL, ocr_status STRING, ocr_extracted_text STRING, structured_extracted_data STRING, report_date DATE, hospital_name STRING, doctor_name STRING, remarks STRING, "
    + _AUDIT,
    "medications": "id STRING NOT NULL, user_id STRING NOT NULL, patient_code STRING NOT NULL, medication_name STRING NOT NULL, medication_type STRING NOT NULL, prescribed_by STRING, dose_per_intake INT, frequency STRING NOT NULL, medication_times ARRAY<STRUCT<time: STRING, period: STRING>>, best_taken ARRAY<STRING>, food_frequency STRING, start_date DATE NOT NULL, end_date DATE, ongoing BOOLEAN NOT NULL, total_quantity INT, remaining_quantity INT, dose_reminders BOOLEAN, unit STRING NOT NULL, daily_consumption INT NOT NULL, refill_alert BOOLEAN, reminder_before_minutes INT NOT NULL, notes STRING, created_at TIMESTAMP_NTZ NOT NULL, updated_at TIMESTAMP_NTZ NOT NULL, soft_delete BOOLEAN NOT NULL",
    "notifications": "id STRING NOT NULL, user_id STRING NOT NULL, title STRING NOT NULL, body STRING NOT NULL, data STRING, is_read BOOLEAN NOT NULL, created_at TIMESTAMP_NTZ NOT NULL, updated_at TIMESTAMP_NTZ NOT NULL",
    "sessions": "id STRING NOT NULL, user_id STRING NOT NULL, refresh_token_hash STRING NOT NULL, refresh_token_expires_at TIMESTAMP_NTZ NOT NULL, login_time TIMESTAMP_NTZ NOT NULL, logout_time TIMESTAMP_NTZ, device_token STRING, is_active BOOLEAN NOT NULL, soft_delete BOOLEAN NOT NULL, created_at TIMESTAMP_NTZ NOT NULL, updated_at TIMESTAMP_NTZ NOT NULL",
    "ai_summary": "id STRING NOT NULL, user_id STRING NOT NULL, user_message STRING, ai_summary_data STRING, soft_delete BOOLEAN NOT NULL, created_at TIMESTAMP_NTZ NOT NULL, updated_at TIMESTAMP_NTZ NOT NULL",
}

#: Children of a patient: removed with it. Notifications are not.
CASCADE = {"documents": "user_id", "sessions": "user_id", "medications": "user_id", "ai_summary": "user_id"}


def schema(table: str) -> T.StructType:
    return T.StructType.fromDDL(DDL[table])


def ordinal(enum: str | tuple[str, ...], column: Column) -> Column:
    """1-based place in the enum; 0 for a stranger, null for null. Enum columns sort by it, not by their letters."""
    members = ENUMS[enum] if isinstance(enum, str) else enum
    return F.array_position(F.array(*[F.lit(m) for m in members]), column)


def in_domain(enum: str, column: Column) -> Column:
    return column.isin(*ENUMS[enum])


def grown(enum: str | tuple[str, ...], member: str, before: str | None = None) -> tuple[str, ...]:
    """The members with one more, at the end or before another; places of stored values follow from it, values stay."""
    members = ENUMS[enum] if isinstance(enum, str) else enum
    if member in members:
        return members
    at = len(members) if before is None else members.index(before)
    return (*members[:at], member, *members[at:])


def retyped(df: DataFrame, kinds: dict[str, str]) -> DataFrame:
    """Columns in other types, in place; text becomes ``variant`` by reading it as JSON. What can't be read is an error, as in a migration."""
    to = lambda c, k: F.parse_json(F.col(c)) if k.lower() == "variant" else F.col(c).cast(k)
    return df.withColumns({c: to(c, k) for c, k in kinds.items()})


# Defaults of omitted columns; AS_OF stands for the time of the statement and UUID for a fresh id.
AS_OF, UUID = object(), object()
DEFAULTS: dict[str, dict[str, object]] = {
    "patients": {"id": UUID, "status": "ACTIVE", "login_attempts": 0, "is_verified": False, "soft_delete": False, "created_at": AS_OF, "updated_at": AS_OF},
    "documents": {"id": UUID, "ocr_status": "pending", "soft_delete": False, "created_at": AS_OF, "updated_at": AS_OF},
    "medications": {"id": UUID, "ongoing": False, "total_quantity": 0, "remaining_quantity": 0, "dose_reminders": False, "daily_consumption": 0, "refill_alert": False, "reminder_before_minutes": 5, "soft_delete": False, "created_at": AS_OF, "updated_at": AS_OF},
    "notifications": {"id": UUID, "is_read": False, "created_at": AS_OF, "updated_at": AS_OF},
    "sessions": {"id": UUID, "login_time": AS_OF, "is_active": True, "soft_delete": False, "created_at": AS_OF, "updated_at": AS_OF},
    "ai_summary": {"id": UUID, "soft_delete": False, "created_at": AS_OF, "updated_at": AS_OF},
}


def with_defaults(rows: DataFrame, table: str, as_of: Column) -> DataFrame:
    """All columns of the table, in its order and types; omitted or null ones get their default."""
    out = []
    for f in schema(table).fields:
        given = F.col(f.name) if f.name in rows.columns else F.lit(None)
        rule = DEFAULTS[table].get(f.name)
        default = as_of if rule is AS_OF else F.uuid() if rule is UUID else F.lit(rule)
        out.append((F.coalesce(given.cast(f.dataType), default.cast(f.dataType)) if rule is not None else given.cast(f.dataType)).alias(f.name))
    return rows.select(*out)


def to_camel(name: str) -> str:
    head, *rest = name.split("_")
    return head + "".join(w.capitalize() for w in rest)


def camel(df: DataFrame) -> DataFrame:
    return df.withColumnsRenamed({c: to_camel(c) for c in df.columns})
