"""Rules that turn a row into an array of issues (field, message), in rule order."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caseloom.functions.scalar import date_or_null, is_bad_date
from caseloom.sources.schema import ENUMS

# Patterns, bounds and lists of the record rules.
EMAIL = r"^[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}\z"
UUID = r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}\z"
# white space as requests count it, for trimming and in names
SPACES = "".join(chr(i) for i in (*range(0x09, 0x0E), 0x20, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000, 0xFEFF))
LETTERS = r"^[A-Za-z\x09-\x0D\x20\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]+\z"
NAME = r"^[a-zA-Z0-9]*\z"
PHONE = r"^[0-9]{10}\z"
PASSWORD = (("upper", "[A-Z]"), ("lower", "[a-z]"), ("digit", "[0-9]"), ("symbol", r"[@$!%*?&]"))
MAX_FILE = 26_214_400
SLOTS = {"ONCE_DAILY": 1, "TWICE_DAILY": 2, "THREE_TIMES_DAILY": 3}


@dataclass(frozen=True)
class Rule:
    """kind: "check"; "fatal" (missing, or of no known kind), after which rules between fields are not asked; "late", such a rule."""

    field: str
    message: str
    bad: Column
    kind: str = "check"


def issues(rules: list[Rule]) -> Column:
    """In rule order, late rules last. A null test is no issue."""
    bad = lambda r: F.coalesce(r.bad, F.lit(False))
    told = lambda r: F.when(bad(r), F.struct(F.lit(r.field).alias("field"), F.lit(r.message).alias("message")))
    early, late = ([r for r in rules if (r.kind == "late") == is_late] for is_late in (False, True))
    fatal = [bad(r) for r in early if r.kind == "fatal"]
    out = F.array_compact(F.array(*map(told, early)))
    if not late:
        return out
    asked = ~reduce(lambda a, b: a | b, fatal) if fatal else F.lit(True)
    return F.when(asked, F.concat(out, F.array_compact(F.array(*map(told, late))))).otherwise(out)


def first_message(found: Column) -> Column:
    """What a caller is told: the first issue alone."""
    return F.get(found, F.lit(0))["message"]


def checked(df: DataFrame, rules: list[Rule]) -> tuple[DataFrame, DataFrame]:
    """(rows without issues, the others with them)."""
    told = df.withColumn("issues", issues(rules))
    return told.filter(F.size("issues") == 0).drop("issues"), told.filter(F.size("issues") > 0)


def required(field: str) -> Rule:
    return Rule(field, "required", F.col(field).isNull(), "fatal")


def trimmed(c: Column) -> Column:
    return F.btrim(c, F.lit(SPACES))


def length(c: Column) -> Column:
    """In UTF-16 units, as requests count: characters past the basic plane are two."""
    return F.length(c) + F.length(F.regexp_replace(c, r"[^\x{10000}-\x{10FFFF}]", ""))


def shorter(c: Column, than: int) -> Column:
    """Units are no fewer than characters, so most texts are told by these."""
    return (F.length(c) < than) & (length(c) < than)


def longer(c: Column, than: int) -> Column:
    """Units are no more than bytes and no fewer than characters."""
    return (F.octet_length(c) > than) & ((F.length(c) > than) | (length(c) > than))


def text(field: str, low: int, high: int, pattern: str | None = None) -> list[Rule]:
    c = trimmed(F.col(field))
    out = [Rule(field, f"shorter than {low}", shorter(c, low))] if low else []
    out.append(Rule(field, f"longer than {high}", longer(c, high)))
    return out + ([Rule(field, "wrong characters", ~c.rlike(pattern))] if pattern else [])


def whole(field: str, low: int, high: int | None = None) -> list[Rule]:
    c = F.col(field)
    out = [Rule(field, f"below {low}", c < low), Rule(field, "not whole", c != F.floor(c))]
    return out + ([Rule(field, f"above {high}", c > high)] if high is not None else [])


def member(field: str, enum: str) -> Rule:
    return Rule(field, "not one of the choices", ~F.col(field).isin(*ENUMS[enum]), "fatal")


def uuid(field: str) -> list[Rule]:
    return [required(field), Rule(field, "not a UUID", ~F.col(field).rlike(UUID))]


def password(field: str) -> list[Rule]:
    return text(field, 8, 64) + [Rule(field, f"no {what}", ~F.col(field).rlike(p)) for what, p in PASSWORD]


def changed(*fields: str) -> Rule:
    """An update says something."""
    return Rule("request", "nothing to change", reduce(lambda a, b: a & b, [F.col(f).isNull() for f in fields]))


def json_object(field: str) -> Rule:
    c = F.col(field)
    return Rule(field, "not an object", c.isNotNull() & (F.from_json(c, "map<string,string>").isNull() | ~c.rlike(r"^\s*\{")), "fatal")


def page_rules(first: int = 1, most: int = 100) -> list[Rule]:
    """Page and limit of a request row; values out of bounds are refused, not clamped."""
    return [Rule("page", f"below {first}", F.col("page") < first), Rule("limit", "below 1", F.col("limit") < 1), Rule("limit", f"above {most}", F.col("limit") > most)]


def list_rules(sorts: tuple[str, ...], enums: dict[str, str], first: int = 1) -> list[Rule]:
    """Of a list request: sort name and direction, enum filters, page."""
    known = [Rule("sort_by", "not a sort name", ~F.col("sort_by").isin(*sorts)), Rule("order_by", "not a direction", ~F.col("order_by").isin("asc", "desc"))]
    return [*known, *[member(f, e) for f, e in enums.items()], *page_rules(first)]


def patient_rules() -> list[Rule]:
    names = [r for f in ("first_name", "last_name") for r in (required(f), *text(f, 2, 255, LETTERS))]
    return [
        *names, required("user_name"), *text("user_name", 2, 255, NAME), required("email"), *text("email", 8, 255, EMAIL), required("password"), *password("password"),
        required("age"), *whole("age", 1, 150), required("gender"), member("gender", "gender"), required("phone"), Rule("phone", "not ten digits", ~F.col("phone").rlike(PHONE)),
    ]


def patient_update_rules() -> list[Rule]:
    """Of a change to a patient: absent fields are null."""
    fields = ("age", "email", "first_name", "last_name", "gender", "password", "phone", "profile_image_key", "status", "user_name")
    return [
        *whole("age", 1, 150), *text("email", 8, 255, EMAIL), *text("first_name", 2, 255, LETTERS), *text("last_name", 2, 255, LETTERS), member("gender", "gender"), *password("password"),
        Rule("phone", "not ten digits", ~F.col("phone").rlike(PHONE)), member("status", "user_status"), *text("user_name", 2, 255, NAME), changed(*fields),
    ]


def patient_update(df: DataFrame) -> DataFrame:
    """What a valid change sets: texts trimmed, the address in lower case, and a full name where both names come."""
    names = {f: trimmed(F.col(f)) for f in ("first_name", "last_name", "user_name", "password", "profile_image_key")}
    full = F.when((names["first_name"] != "") & (names["last_name"] != ""), F.concat(names["first_name"], F.lit(" "), names["last_name"]))
    return df.withColumns(names | {"email": F.lower(trimmed(F.col("email"))), "full_name": full})


def document_update_rules() -> list[Rule]:
    """Of a change to a document; one that says nothing sets the default status."""
    return [
        *text("doctor_name", 0, 255), *text("hospital_name", 0, 255), json_object("ocr_extracted_text"), member("ocr_status", "ocr_status"),
        Rule("report_date", "not a date", is_bad_date(F.col("report_date")), "fatal"), json_object("structured_extracted_data"),
    ]


def document_update(df: DataFrame) -> DataFrame:
    """What a valid change sets: names trimmed, the date read, and the status in_progress unless another is given."""
    return df.withColumns({"doctor_name": trimmed(F.col("doctor_name")), "hospital_name": trimmed(F.col("hospital_name")), "ocr_status": F.coalesce("ocr_status", F.lit("in_progress")), "report_date": date_or_null(F.col("report_date"))})


def document_rules() -> list[Rule]:
    """Columns that the table can't leave null are required, and so are bucket and key."""
    return [
        required("document_type"), member("document_type", "document_type"), required("file_name"), *text("file_name", 2, 255), required("file_path"), *text("file_path", 1, 2**31 - 1)[:1], required("file_size"), *whole("file_size", 1, MAX_FILE),
        required("file_type"), member("file_type", "file_type"), required("s3_bucket"), *text("s3_bucket", 1, 255), required("s3_key"), *text("s3_key", 1, 500),
    ]


def _choices() -> list[Rule]:
    """Between the fields of a prescription: how many times and choices its frequency allows."""
    times, taken = F.size("medication_times"), F.size("best_taken")
    limit = F.lit(None).cast("int")
    for name, n in SLOTS.items():
        limit = F.when(F.col("frequency") == name, F.lit(n)).otherwise(limit)
    known = F.col("frequency").isNotNull()
    custom = F.size(F.filter("best_taken", lambda x: x == "CUSTOM")) > 1
    return [
        Rule("medication_times", "more than the frequency allows", times > limit, "late"), Rule("best_taken", "more than one CUSTOM", known & custom, "late"),
        Rule("best_taken", "more than the frequency allows", taken > limit, "late"), Rule("best_taken", "not as many as times", known & F.col("best_taken").isNotNull() & (taken != times), "late"),
    ]


#: Fields of a prescription that its rows may lack; what rows have of them is checked where it is named.
OPTIONAL = ("prescribed_by", "food_frequency", "reminder_before_minutes", "notes")


def _parts(least_taken: int, optional: Sequence[str]) -> list[Rule]:
    """Fields that a new prescription and a change to one share."""
    more = {
        "prescribed_by": text("prescribed_by", 0, 255), "food_frequency": [member("food_frequency", "food_type")],
        "reminder_before_minutes": [Rule("reminder_before_minutes", "not whole", F.col("reminder_before_minutes") != F.floor("reminder_before_minutes"))], "notes": text("notes", 0, 1000),
    }
    other = lambda x: ~F.coalesce(x.isin(*ENUMS["best_taken"]), F.lit(False))
    bad_time = lambda t: t["time"].isNull() | ~F.coalesce(t["period"].isin("AM", "PM"), F.lit(False))
    return [
        *text("medication_name", 2, 255), member("medication_type", "medication_type"), *whole("dose_per_intake", 1), member("frequency", "frequency_type"),
        Rule("medication_times", "not a time and AM or PM", F.exists("medication_times", bad_time), "fatal"), Rule("medication_times", "none given", F.size("medication_times") < 1),
        Rule("best_taken", "not one of the choices", F.exists("best_taken", other), "fatal"), *([Rule("best_taken", "none given", F.size("best_taken") < least_taken)] if least_taken else []),
        member("unit", "medication_unit"), *whole("total_quantity", 0), *[r for f in OPTIONAL if f in optional for r in more[f]],
    ]


def medication_rules(optional: Sequence[str] = ()) -> list[Rule]:
    """Of a new prescription."""
    must = ("medication_name", "medication_type", "dose_per_intake", "frequency", "medication_times", "start_date", "unit", "total_quantity")
    return [
        *[required(f) for f in must], *_parts(1, optional),
        Rule("dose_per_intake", "more than the quantity", F.col("dose_per_intake") > F.col("total_quantity"), "late"),
        Rule("end_date", "before the start", ~F.coalesce("ongoing", F.lit(False)) & (F.col("end_date") < F.col("start_date")), "late"), *_choices(),
    ]


def medication_update_rules(optional: Sequence[str] = ()) -> list[Rule]:
    """Of a change to a prescription: absent fields are null, a change of nothing is one."""
    return [*_parts(0, optional), *whole("remaining_quantity", 0), Rule("dose_per_intake", "more than the quantity", F.col("dose_per_intake") > F.col("total_quantity"), "late"), *_choices()]


def auth_rules(kind: str) -> list[Rule]:
    """Of the payloads login, refresh, email, verify and reset."""
    mail = [required("email"), *text("email", 8, 255, EMAIL)]
    if kind == "refresh":
        return [required("refresh_token"), Rule("refresh_token", "empty", F.col("refresh_token") == "")]
    if kind == "email":
        return mail
    if kind == "verify":
        return [*mail, required("otp"), Rule("otp", "not six characters", length(trimmed(F.col("otp"))) != 6)]
    if kind in ("login", "reset"):
        return [*mail, required("password"), *password("password"), *(session_rules() if kind == "login" else [])]
    raise KeyError(kind)


def notification_defaults(title: str, body: str) -> dict[str, Column]:
    return {"title": F.coalesce("title", F.lit(title)), "body": F.coalesce("body", F.lit(body))}


def notification_rules() -> list[Rule]:
    return [required("user_id"), Rule("user_id", "empty", F.col("user_id") == "")]


def session_rules() -> list[Rule]:
    return [Rule("device_token", "longer than 500", longer(F.col("device_token"), 500))]
