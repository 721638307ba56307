"""Text cleaning, extraction, intent, prompts and templates as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# The white space of Unicode strings.
SPACE = r"\t-\r\x1c-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"


_SPACES = "".join(chr(i) for i in (*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000))


def trim(c: Column) -> Column:
    """Drops Unicode white space at both ends; reads no more than the ends."""
    return F.btrim(c, F.lit(_SPACES))


def clean_ocr(c: Column) -> Column:
    """One blank for each run of white space, none at the ends."""
    return F.trim(F.regexp_replace(c, rf"[{SPACE}]+", " "))


def join_lines(lines: Column) -> Column:
    return F.array_join(lines, " ")


def clean_reply(c: Column) -> Column:
    """Of a chat model: blanks, printable ASCII alone, no code fences, trimmed, in this order (so double blanks may stay)."""
    one = F.regexp_replace(c, rf"[{SPACE}\x{{FEFF}}]+", " ")
    return F.trim(F.replace(F.replace(F.regexp_replace(one, r"[^\x20-\x7E]", ""), F.lit("```json"), F.lit("")), F.lit("```"), F.lit("")))


def unfence(c: Column) -> Column:
    """Of a structuring model: drops code fences and outer white space."""
    return trim(F.replace(F.replace(c, F.lit("```json"), F.lit("")), F.lit("```"), F.lit("")))


# Intents in order of precedence, with the parts of words that tell them.
INTENTS = (
    ("SUMMARY", ("summary", "summarize")),
    ("MEDICATION", ("medicine", "medication", "tablet")),
    ("DIAGNOSIS", ("diagnosis", "disease", "condition")),
    ("LAB_REPORT", ("lab", "blood report", "test result")),
)
OTHER_INTENT = "GENERAL_CHAT"


def intent(message: Column) -> Column:
    """The first intent one of whose keywords stands anywhere in the message."""
    low = F.lower(message)
    return reduce(lambda rest, one: F.when(reduce(lambda a, b: a | b, [F.contains(low, F.lit(k)) for k in one[1]]), F.lit(one[0])).otherwise(rest), reversed(INTENTS), F.lit(OTHER_INTENT))


#: What each intent asks of the model; the reply's shape is fixed by ``parse_summary``.
TASKS = {
    "SUMMARY": "Summarise the medical record below in plain words.",
    "MEDICATION": "From the medical record below, explain each medicine: what it is for and how it is taken.",
    "DIAGNOSIS": "From the medical record below, explain the diagnosis and what it means.",
    "LAB_REPORT": "From the medical record below, explain the test results and which values are out of range.",
}
REPLY_SHAPE = '{"summary": "", "importantFindings": [], "simpleExplanation": []}'


def build_prompt(kind: Column, message: Column, record: Column) -> Column:
    """Task, question and record; kinds without a task of their own get the summary's."""
    task = reduce(lambda rest, one: F.when(kind == one[0], F.lit(one[1])).otherwise(rest), TASKS.items(), F.lit(TASKS["SUMMARY"]))
    return F.concat(task, F.lit(f"\nAnswer in JSON: {REPLY_SHAPE}\nQuestion: "), F.coalesce(message, F.lit("")), F.lit("\nRecord: "), F.coalesce(record, F.lit("")))


def structure_prompt(record: Column, graphs: Column) -> Column:
    """Asks for the nested record of ``RECORD``; graphs are put in as JSON."""
    return F.concat(F.lit("Fill this JSON from the medical record; leave unknown fields empty. Shape: "), F.lit(RECORD), F.lit("\nRecord: "), record, F.lit("\nGraphs: "), F.coalesce(F.to_json(graphs), F.lit("[]")))


# The structured record and the chat reply.
RECORD = (
    "patient STRUCT<name: STRING, age: STRING, gender: STRING>, doctor STRUCT<name: STRING>, hospital STRUCT<name: STRING>, report STRUCT<type: STRING, date: STRING>, "
    "parameters ARRAY<STRUCT<name: STRING, value: STRING, unit: STRING, status: STRING>>, medicines ARRAY<STRUCT<name: STRING, dosage: STRING, frequency: STRING>>, "
    "diagnosis ARRAY<STRING>, observations ARRAY<STRING>, graphs ARRAY<STRUCT<type: STRING, observation: STRING, trend: STRING>>, remarks STRING"
)
SUMMARY = "summary STRING, importantFindings ARRAY<STRING>, simpleExplanation ARRAY<STRING>"


def parse_record(c: Column) -> Column:
    return F.from_json(unfence(c), RECORD)


def parse_summary(c: Column) -> Column:
    return F.from_json(clean_reply(c), SUMMARY)


# --- extraction --------------------------------------------------------------

_S = rf"[{SPACE}]"
# Patterns of the report fields.
DOCTOR = rf"(?:Dr\.?|DR|Doctor|Physician|Consultant|Ref\.?{_S}*By){_S}*[:\-]?{_S}*([A-Za-z{SPACE}.]+)"
HOSPITAL = rf"([A-Z][A-Za-z{SPACE}]{{3,80}}(?:Hospital|Clinic|Diagnostics|Lab|Laboratory|Medical Center))"
_MONTH = "(?:Jan|January|Feb|February|Mar|March|Apr|April|May|Jun|June|Jul|July|Aug|August|Sep|September|Oct|October|Nov|November|Dec|December)"
_CLOCK = r"[0-9]{1,2}:[0-9]{2}(?::[0-9]{2})?"
DATE_TIME = (
    rf"\b(?:[0-9]{{1,2}}[{SPACE}/-]?{_MONTH}[{SPACE},/-]?[0-9]{{2,4}}[{SPACE},]*{_CLOCK}{_S}?(?:AM|PM|am|pm)?"
    rf"|[0-9]{{1,2}}[/-][0-9]{{1,2}}[/-][0-9]{{2,4}}[{SPACE}T]?{_CLOCK}|[0-9]{{4}}[/-][0-9]{{1,2}}[/-][0-9]{{1,2}}[{SPACE}T]{_CLOCK})\b"
)
_HEAD = "(?:Interpretation|Conclusion|Remarks|Notes)"
_ENDS = "Thanks|End of Report|Signature"
_GAP = rf"{_S}*+[:\-]?+{_S}*+"
#: Group 1 is the conclusion if group 2, what ends it, is not empty. Where a line has no end for it, the match goes on to
#: the line's end, or to a heading that nothing but blanks parts from the next line, so that no part is read once for each
#: heading before it. Reads texts with ``\\0`` added.
_BLANK = SPACE.replace(r"\t-\r", r"\t\x0B-\r")
CONCLUSION = rf"{_HEAD}{_GAP}(?:([^\n]*?)({_ENDS}|\n?\x00\z)|(?:(?!{_HEAD}[{_BLANK}]*+[:\-]?+[{_BLANK}]*+\n)[^\n])*+)"
_LETTER = r"A-Za-z()%\-"
_NAME = rf"[{_LETTER}{SPACE}]"
#: A name ends before the first run of white space that a digit follows; a name that is white space alone leaves one of it to part them.
PARAMETER = rf"({_S}(?={_S}++[0-9])|(?:[{_LETTER}]++|{_S}++(?![0-9]))++){_S}++([0-9]+\.?[0-9]*){_S}*([A-Za-z/%µgdl]*){_S}*([0-9.\-to{SPACE}]*)"


def _first(c: Column, pattern: str, group: int) -> Column:
    """The group of the first match, which is never empty; null without a match."""
    return F.nullif(F.regexp_extract(c, pattern, group), F.lit(""))


def doctor(c: Column) -> Column:
    return trim(_first(c, DOCTOR, 1))


def hospital(c: Column) -> Column:
    return F.when(c.rlike("Hospital|Clinic|Diagnostics|Lab|Medical Center"), _first(c, HOSPITAL, 1))


def date_time(c: Column) -> Column:
    return _first(c, DATE_TIME, 0)


def conclusion(c: Column) -> Column:
    """What follows the first heading up to a closing word on its line, or to the end of the text."""
    ended = F.concat(c, F.lit("\0"))
    found = F.regexp_extract_all(ended, F.lit(CONCLUSION), F.lit(0))
    # a match without an end closes with none of the words, and with the last character only if the text has it elsewhere too
    first = F.get(F.filter(found, lambda m: m.rlike(rf"(?:{_ENDS})\z") | (F.endswith(m, F.lit("\0")) & F.endswith(ended, m))), F.lit(0))
    return F.when(c.rlike(_HEAD), trim(F.regexp_extract(first, rf"^{CONCLUSION}", 1)))


def parameters(c: Column) -> Column:
    """name, value, unit and reference of every number that follows a name.

    A match can begin only where a run of name characters does, or where the
    last match ended; saying so keeps long texts without numbers linear.  One pass
    puts marks around the groups of each match, which then are split at them.
    """
    # the marks are no part of any match; where a text has them, another character that is none stands for them
    clear = F.translate(c, "\1\2", "\3\3")
    marked = F.regexp_replace(clear, rf"(?:\G|(?<!{_NAME})){PARAMETER}", "\2$1\1$2\1$3\1$4\1")
    hits = F.transform(F.filter(F.split(marked, "\2"), lambda _, i: i > 0), lambda m: F.split(m, "\1"))
    return F.transform(hits, lambda g: F.struct(*[trim(F.get(g, F.lit(i))).alias(n) for i, n in enumerate(("name", "value", "unit", "reference"))]))


def report_fields(c: Column) -> Column:
    return F.struct(hospital(c).alias("hospital_name"), doctor(c).alias("doctor_name"), date_time(c).alias("report_date"), conclusion(c).alias("remarks"), parameters(c).alias("parameters"))


# --- templates ---------------------------------------------------------------

# Characters that a template escapes.
ESCAPES = (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;"), ("/", "&#x2F;"), ("`", "&#x60;"), ("=", "&#x3D;"))


def escape_html(c: Column) -> Column:
    return reduce(lambda acc, e: F.replace(acc, F.lit(e[0]), F.lit(e[1])), ESCAPES, c)


def render(template: str, values: dict[str, Column]) -> Column:
    """``{{{x}}}`` puts a value in as it is, ``{{x}}`` escaped; null and unknown names give nothing. Values are never read as templates."""
    parts, at = [], 0
    while (i := template.find("{{", at)) >= 0:
        raw = template.startswith("{{{", i)
        close = "}}}" if raw else "}}"
        j = template.find(close, i)
        if j < 0:
            break
        parts.append(F.lit(template[at:i]))
        name = template[i + len(close) : j].strip()
        if name in values:
            value = F.coalesce(values[name].cast("string"), F.lit(""))
            parts.append(value if raw else escape_html(value))
        at = j + len(close)
    parts.append(F.lit(template[at:]))
    return F.concat(*parts)


def render_in(base: str, inner: str, values: dict[str, Column]) -> Column:
    """The inner template, put as ``content`` into the base."""
    return render(base, values | {"content": render(inner, values)})
