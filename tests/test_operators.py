"""Hand-derived vectors for what the driver's tables never hold: nulls, escapes, flags, fences, enum order."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from caseloom.functions import medication, scalar, text
from caseloom.operators import listing, lookups, mutations, predicates, projection, state, validate
from caseloom.sources import schema, tables

NTZ = dt.datetime(2026, 5, 14)


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def lit_ts(s):
    return F.lit(s).cast("timestamp_ntz")


@pytest.mark.parametrize(
    ("message", "want"),
    [("Please SUMMARIZE my tablet list", "SUMMARY"), ("what medicine i should take?", "MEDICATION"), ("is a slot available", "LAB_REPORT"), ("hello", "GENERAL_CHAT"), ("my condition", "DIAGNOSIS"), ("Blood Report", "LAB_REPORT")],
)
def test_intent(spark, message, want):
    assert one(spark, text.intent(F.lit(message)))[0] == want


def test_units(spark):
    for kind, want in {"TABLET": "PILLS", "CAPSULE": "PILLS", "SYRUP": "ML", "DROP": "DROPS", "INJECTION": "UNITS", "unknown": "PILLS", None: "PILLS"}.items():
        assert one(spark, medication.unit_of(F.lit(kind)))[0] == want


@pytest.mark.parametrize(
    ("as_of", "ongoing", "end", "left"),
    [("2026-05-14", False, dt.date(2026, 5, 20), 22), ("2026-05-14", True, None, 22), ("2026-05-01", False, dt.date(2026, 5, 20), 30), ("2026-06-30", False, dt.date(2026, 5, 20), 0)],
)
def test_supply(spark, as_of, ongoing, end, left):
    s = one(spark, medication.supply(F.lit(1), F.lit(4), F.lit(30), F.lit("2026-05-12").cast("date"), F.lit(ongoing), F.lit("TABLET"), lit_ts(as_of)))[0]
    assert (s.daily_consumption, s.end_date, s.remaining_quantity, s.unit) == (4, end, left, "PILLS")


def test_supply_without_dose(spark):
    s = one(spark, medication.supply(F.lit(0), F.lit(4), F.lit(30), F.lit("2026-05-12").cast("date"), F.lit(False), F.lit("DROP"), lit_ts("2026-05-20")))[0]
    assert s.end_date is None and s.remaining_quantity == 30


@pytest.mark.parametrize(("given", "seconds"), [("15m", 900), ("7d", 604800), ("12h", 43200), ("30s", 30), ("abc", 604800), ("15m\n", 604800), ("", 604800), (None, 604800)])
def test_duration(spark, given, seconds):
    assert one(spark, scalar.duration_seconds(F.lit(given)))[0] == seconds


def test_cleaning(spark):
    fence = chr(96) * 3
    assert one(spark, text.clean_ocr(F.lit("  a\n\nb  \x1c")))[0] == "a b"
    assert one(spark, text.clean_reply(F.lit(f'{fence}json\n{{"a": "éx"}}\n{fence}')))[0] == '{"a": "x"}'
    assert one(spark, text.unfence(F.lit(f"\n{fence}json\n[1,\n2]{fence} ")))[0] == "[1,\n2]"
    assert one(spark, text.trim(F.lit("　 a b\n\n")))[0] == "a b"
    assert one(spark, text.clean_ocr(F.lit(None).cast("string")))[0] is None


def test_extraction(spark):
    t = "Ref By: Dr. Ann Lee\n City General Hospital, 12 Jan 2024 10:30 Hb 13.5 g/dl 12-16\nRemarks: all fine Thanks"
    r = one(spark, text.report_fields(F.lit(t)))[0]
    assert r.doctor_name.startswith("Dr. Ann Lee") and r.hospital_name.endswith("City General Hospital")
    assert r.report_date == "12 Jan 2024 10:30 " and r.remarks == "all fine"
    assert ("Hb", "13.5", "g/dl", "12-16") in [tuple(p) for p in r.parameters]
    none = one(spark, text.report_fields(F.lit("nothing here")))[0]
    assert none.doctor_name is None and none.hospital_name is None and none.report_date is None and none.remarks is None and none.parameters == []


def test_template(spark):
    got = one(spark, text.render_in("[{{{content}}}]", "{{ a }}{{{a}}}{{none}}{{b}}", {"a": F.lit("<x> & {{b}}"), "b": F.lit(None).cast("string")}))[0]
    assert got == "[&lt;x&gt; &amp; {{b}}<x> & {{b}}]"


@pytest.mark.parametrize(
    ("needle", "hits"),
    [("a_c", ["abc", "a_c"]), ("a\\_c", ["a_c"]), ("A%", ["abc", "a_c", "ac", "a\\d"]), ("a\\d", ["a\\d"]), ("b", ["abc"]), ("a\\", ["a\\d"])],
)
def test_search_keeps_wildcards(spark, needle, hits):
    df = spark.createDataFrame([(x,) for x in ("abc", "a_c", "ac", "a\\d", None)], "s string")
    assert sorted(r.s for r in df.filter(predicates.search(needle, "s")).collect()) == sorted(hits)


def test_search_over_null_columns_and_empty_needle(spark):
    df = spark.createDataFrame([(None, "x"), ("x", None), (None, None)], "a string, b string")
    assert df.filter(predicates.search("X", "a", "b")).count() == 2
    assert predicates.search("", "a") is None and predicates.search(None, "a") is None
    assert df.filter(predicates.all_of(None, predicates.equals("a", ""))).count() == 3


def test_soft_delete_guards(spark):
    df = spark.createDataFrame([(1, False), (2, True), (3, None)], "id int, soft_delete boolean")
    assert [r.id for r in df.filter(predicates.not_deleted()).collect()] == [1]
    assert [r.id for r in df.filter(predicates.not_deleted_or_unknown()).orderBy("id").collect()] == [1, 3]


def test_null_and_enum_order(spark):
    df = spark.createDataFrame([(1, "other"), (2, "family"), (3, None), (4, "medication"), (5, "insurance"), (6, "medical_document")], "id int, k string")
    key = schema.ordinal("document_type", F.col("k"))
    up = [r.k for r in df.orderBy(listing.order_key(key, False)).collect()]
    assert up == ["family", "medical_document", "medication", "insurance", "other", None]
    assert [r.k for r in df.orderBy(listing.order_key(key, True)).collect()] == [None, *up[:-1][::-1]]


def test_pages_concatenate_to_the_sorted_list(spark):
    n = 23
    df = spark.createDataFrame([(str(i), i % 4, None if i % 5 == 0 else f"t{i % 3}", i % 2 == 0) for i in range(n)], "id string, user_id int, title string, is_read boolean").withColumn("body", F.lit("x")).withColumn("created_at", F.lit(NTZ))
    spec = listing.listing("notifications")
    where = spec.where(isRead=False)
    full = [r.id for r in df.filter(where).orderBy(*spec.sorts.keys("title", "asc")).collect()]
    pages = [spec.page(df, where, p, 4, "title", "asc") for p in range(4)]
    assert [r.id for rows, _ in pages for r in rows.collect()] == full
    assert pages[0][1].first().total_records == len(full) and pages[0][1].first().total_pages == -(-len(full) // 4)
    assert spec.page(df, F.lit(False), 0, 10)[1].first().total_pages == 0


def test_page_bounds():
    assert listing.page_bounds(2, 10) == (10, 10) and listing.page_bounds(2, 10, first=0) == (20, 10)
    for page, limit in ((0, 10), (1, 0), (1, 101)):
        with pytest.raises(ValueError, match="must be"):
            listing.page_bounds(page, limit)


def test_lists_refuse_unknown_filters_and_scope_by_owner(spark):
    spec = listing.listing("documents")
    with pytest.raises(ValueError, match="no filter"):
        spec.where(owner="u", colour="red")
    df = spark.createDataFrame([("1", "u", "family", "f", None), ("2", "v", "family", "f", False), ("3", "u", "other", "g", True)], "id string, user_id string, document_type string, file_name string, soft_delete boolean")
    assert [r.id for r in df.filter(spec.where(owner="u", type="family", title="f")).collect()] == ["1"]
    assert df.filter(spec.where(owner="u", createdBy="v")).count() == 0
    for name in ("documents", "medications", "patients"):
        assert listing.listing(name).sorts.keys("nonsense")
    assert listing.listing("documents", "get").sorts.descending


def test_updates_and_deletes(spark):
    rows = [("1", "u", False, False), ("2", "u", True, False), ("3", "v", False, True)]
    df = spark.createDataFrame(rows, "id string, user_id string, is_read boolean, soft_delete boolean").withColumn("updated_at", lit_ts("2020-01-01")).withColumn("deleted_at", F.lit(None).cast("timestamp_ntz"))
    now = lit_ts("2026-01-01")
    state_, gone = mutations.soft_delete(df, F.col("id").isin("1", "3"), now)
    assert [r.id for r in gone.collect()] == ["1"] and state_.filter("soft_delete").count() == 2
    assert state_.filter("deleted_at is not null").count() == 1
    read, told = mutations.mark_read(df, predicates.owned_by("u"), now)
    assert read.filter("is_read").count() == 2 and told.count() == 2
    live, _ = mutations.update_live(df, "3", {"user_id": "w"}, now)
    assert live.filter("user_id = 'w'").count() == 0
    patched = mutations.overlay(df, {"user_id": None}, F.col("id") == "1")
    assert patched.filter("user_id is null").count() == 1
    kept, out = mutations.hard_delete(df, F.col("deleted_at") > now)
    assert kept.count() == 3 and out.count() == 0


def test_cascade_leaves_notifications(spark):
    p = spark.createDataFrame([("1",), ("2",)], "id string")
    child = spark.createDataFrame([("a", "1"), ("b", "2")], "id string, user_id string")
    got = mutations.cascade(p, p.filter("id = '1'"), {"documents": child, "notifications": child})
    assert got["patients"].count() == 1 and got["documents"].count() == 1 and got["notifications"].count() == 2


def test_defaults_and_insert(spark, tmp_path):
    new = spark.createDataFrame([("u", "t", "b", None)], "user_id string, title string, body string, is_read boolean")
    table, made = mutations.insert(schema.with_defaults(new.limit(0), "notifications", lit_ts("2026-01-01")), "notifications", new, lit_ts("2026-01-01"))
    r = made.first()
    assert len(r.id) == 36 and r.is_read is False and r.created_at == dt.datetime(2026, 1, 1) and table.count() == 1
    path = str(tmp_path / "n")
    written = tables.insert(path, "notifications", new, lit_ts("2026-01-01"))
    assert written.first().id == spark.read.parquet(path).first().id
    for name in schema.DDL:
        assert schema.schema(name).fieldNames()[0] == "id"
    assert "isRead" in schema.camel(made).columns


def test_lookups(spark):
    new = spark.createDataFrame([("1", "a@x"), ("2", "b@x"), ("3", None)], "id string, email string")
    taken = spark.createDataFrame([("2", "b@x"), ("9", "a@x")], "id string, email string")
    assert sorted(r.id for r in lookups.free_names(new, taken, "email").collect()) == ["3"]
    assert sorted(r.id for r in lookups.free_names(new, taken, "email", "id").collect()) == ["2", "3"]
    assert one(spark, lookups.mapped(tables.FOLDERS, F.lit("nope")))[0] is None
    assert one(spark, tables.object_key(F.lit("PATIENT_DOCUMENT"), lit_ts("1970-01-01 00:00:01"), F.lit("f.pdf")))[0] == "uploads/1000-f.pdf"


def test_scalars(spark):
    assert one(spark, scalar.bearer(F.lit("Bearer abc")), scalar.bearer(F.lit("Basic abc")), scalar.bearer(F.lit("Bearer ")), scalar.bearer(F.lit(None).cast("string"))) == ("abc", None, None, None)
    got = one(spark, *[scalar.date_or_null(F.lit(x)).alias(f"c{i}") for i, x in enumerate(("", "Not Found", None, "2024-02-03", "soon"))])
    assert tuple(got) == (None, None, None, dt.date(2024, 2, 3), None)
    assert one(spark, scalar.is_bad_date(F.lit("soon")), scalar.is_bad_date(F.lit("")), scalar.is_bad_date(F.lit(None).cast("string"))) == (True, False, False)
    assert one(spark, scalar.number_or(F.lit("x"), 5), scalar.number_or(F.lit(" 7 "), 5), scalar.number_or(F.lit("NaN"), 5)) == (5.0, 7.0, 5.0)
    assert one(spark, scalar.full_name(F.lit("A"), F.lit("B")), scalar.full_name(F.lit("A"), F.lit(""))) == ("A B", None)
    code = one(spark, scalar.one_time_code(3))[0]
    assert 100_000 <= int(code) <= 999_999
    assert one(spark, scalar.decode_json(F.base64(F.lit('{"a": 1}').cast("binary")), "a int"))[0].a == 1


def test_validation_tells_issues_in_order(spark):
    good = ("Ann", "Lee", "ann1", "ann@x.org", "Passw0rd!", 30, "female", "0123456789")
    bad = ("A", "L33", "a b", "ann@x", "short", 151, "other", "123\n")
    df = spark.createDataFrame([good, bad, (None,) * 8], "first_name string, last_name string, user_name string, email string, password string, age int, gender string, phone string")
    ok, wrong = validate.checked(df, validate.patient_rules())
    assert ok.count() == 1 and wrong.count() == 2
    rows = wrong.select("first_name", "issues", validate.first_message(F.col("issues")).alias("first")).collect()
    told = {r.first_name: ([i.field for i in r.issues], r.first) for r in rows}
    assert told["A"][1] == "shorter than 2" and {"first_name", "last_name", "user_name", "email", "password", "age", "gender", "phone"} == set(told["A"][0])
    assert told[None][1] == "required"
    empty = spark.createDataFrame([(None,) * 8, ("letter", "x", " ", 0, "image/gif", "\t", "", "b")], "document_type string, file_name string, file_path string, file_size long, file_type string, s3_bucket string, s3_key string, user_id string")
    told = [[i.field for i in r.i] for r in empty.withColumn("i", validate.issues([*validate.document_rules(), *validate.notification_rules()])).collect()]
    assert told == [["document_type", "file_name", "file_path", "file_size", "file_type", "s3_bucket", "s3_key", "user_id"], ["document_type", "file_name", "file_path", "file_size", "file_type", "s3_bucket", "s3_key"]]


def test_auth_rules(spark):
    row = [("ann@x.org", "Passw0rd!", "12345", "", "d" * 501, "nope")]
    df = spark.createDataFrame(row, "email string, password string, otp string, refresh_token string, device_token string, id string")
    want = {"email": [], "reset": [], "verify": ["otp"], "refresh": ["refresh_token"], "login": ["device_token"]}
    for kind, fields in want.items():
        assert [i.field for i in df.select(validate.issues(validate.auth_rules(kind))).first()[0]] == fields
    assert [i.message for i in df.select(validate.issues(validate.uuid("id"))).first()[0]] == ["not a UUID"]
    with pytest.raises(KeyError):
        validate.auth_rules("other")


def test_answers_and_templates(spark, tmp_path):
    page = F.struct(F.lit(10).alias("pageLimit"))
    got = one(spark, projection.answer(F.lit(None).cast("struct<a:int>"), F.lit('say "x"'), page=page))[0]
    assert got == '{"data":{},"page":{"pageLimit":10},"status":{"description":"say \\"x\\"","status":"SUCCESS","statusCode":200}}'
    df = spark.createDataFrame([("1", "p")], "id string, password string")
    assert projection.public_patient(df).columns == ["id"]
    (tmp_path / "t.html").write_text("Hi {{a}}\n")
    assert tables.template(spark, str(tmp_path / "t.html")) == "Hi {{a}}\n"


def test_lenient_list_drops_unknown_filters(spark):
    df = spark.createDataFrame([("1", "u", False, "TABLET")], "id string, user_id string, soft_delete boolean, medication_type string")
    assert df.filter(listing.listing("medications").where(owner="u", ongoing=True, medicationType="TABLET")).count() == 1


def test_medication_rules(spark):
    t = [("08:00", "AM")]
    ddl = "medication_name string, medication_type string, dose_per_intake int, total_quantity int, frequency string, unit string, medication_times array<struct<time:string,period:string>>, best_taken array<string>, start_date date, end_date date, ongoing boolean"
    d = dt.date(2026, 1, 2)
    rows = [
        ("mm", "TABLET", 1, 30, "ONCE_DAILY", "PILLS", t, ["MORNING"], d, d, False),
        ("mm", "TABLET", 40, 30, "ONCE_DAILY", "PILLS", t * 2, ["CUSTOM", "CUSTOM"], d, dt.date(2026, 1, 1), False),
        ("mm", "TABLET", 1, 30, "AS_NEEDED", "PILLS", t * 9, None, d, dt.date(2025, 1, 1), True),
    ]
    df = spark.createDataFrame(rows, ddl).withColumn("i", validate.issues(validate.medication_rules()))
    got = [[(x.field, x.message) for x in r.i] for r in df.collect()]
    assert got[0] == [] and got[2] == []
    assert [m for _, m in got[1]] == ["more than the quantity", "before the start", "more than the frequency allows", "more than one CUSTOM", "more than the frequency allows"]


def test_attempts(spark):
    seq = {"a": "FFSFFFS", "b": "FFSFF", "c": "S", "d": "FFF", "e": "FSF"}
    rows = [(k, NTZ + dt.timedelta(minutes=i), c == "F") for k, s in seq.items() for i, c in enumerate(s)]
    df = spark.createDataFrame(rows, "user_id string, ts timestamp_ntz, bad boolean")
    got = {r.user_id: (r.login_attempts, r.status, r.blocked_at) for r in state.attempts(df, "user_id", "ts", F.col("bad")).collect()}
    assert got["a"] == (3, "BLOCKED", NTZ + dt.timedelta(minutes=5)) and got["d"][1] == "BLOCKED"
    assert got["b"] == (2, "ACTIVE", None) and got["c"] == (0, "ACTIVE", None) and got["e"] == (1, "ACTIVE", None)


def test_gates_and_codes(spark):
    now = lit_ts("2026-01-01 10:00:00")
    late, soon = lit_ts("2026-01-01 09:00:00"), lit_ts("2026-01-01 10:00:00")
    got = one(spark, state.code_state(F.lit("1"), F.lit("1"), soon, now), state.code_state(F.lit("1"), F.lit("1"), late, now), state.code_state(F.lit("1"), F.lit("2"), soon, now), state.code_state(F.lit(None).cast("string"), F.lit("2"), soon, now))
    assert tuple(got) == ("VALID", "EXPIRED", "WRONG", "WRONG")
    assert tuple(one(spark, *[state.gate(F.lit(s)) for s in ("BLOCKED", "INACTIVE", "ACTIVE")])) == ("REJECT_BLOCKED", "REJECT_INACTIVE", "PASS")
    assert tuple(one(spark, state.may_reset(late, now), state.may_reset(soon, now), state.may_reset(F.lit(None).cast("timestamp_ntz"), now))) == (False, True, False)
    assert tuple(one(spark, state.ocr_status(F.lit(False), F.lit(None).cast("boolean")), state.ocr_status(F.lit(True), F.lit(None).cast("boolean")), state.ocr_status(F.lit(True), F.lit(True)), state.ocr_status(F.lit(True), F.lit(False)))) == ("pending", "in_progress", "completed", "failed")
