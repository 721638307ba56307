"""Lists and pages: filter, whitelist sort, offset page, totals."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caseloom.operators.predicates import all_of, not_deleted, not_deleted_or_unknown, owned_by, search
from caseloom.sources.schema import ordinal

# Bounds of a page.
MAX_PAGE = 100
DEFAULT_PAGE = 10


def order_key(column: Column, descending: bool) -> Column:
    """Nulls are the largest value: last upward, first downward."""
    return column.desc_nulls_first() if descending else column.asc_nulls_last()


@dataclass(frozen=True)
class Sorts:
    """Which API names sort, by which column or expression; others fall back."""

    names: dict[str, Column | str]
    fallback: str = "created_at"
    tie: str = "id"
    descending: bool = True

    def keys(self, name: str | None = None, direction: str | None = None) -> list[Column]:
        descending = self.descending if direction is None else direction == "desc"
        by = self.names.get(name or "", self.fallback)
        return [order_key(F.col(by) if isinstance(by, str) else by, descending), F.col(self.tie).asc()]


def page_bounds(page: int, limit: int = DEFAULT_PAGE, first: int = 1) -> tuple[int, int]:
    """(offset, limit) of a page counted from ``first``; values out of bounds are refused, not clamped."""
    if not first <= page:
        raise ValueError(f"page must be {first} or more")
    if not 1 <= limit <= MAX_PAGE:
        raise ValueError(f"limit must be between 1 and {MAX_PAGE}")
    return (page - first) * limit, limit


def rows_of_page(df: DataFrame, where: Column, order: list[Column], page: int, limit: int = DEFAULT_PAGE, first: int = 1) -> DataFrame:
    offset, limit = page_bounds(page, limit, first)
    return df.filter(where).orderBy(*order).offset(offset).limit(limit)


def totals(df: DataFrame, where: Column, page: int, limit: int) -> DataFrame:
    """One row: page_limit, page_number, total_records, total_pages."""
    n = df.filter(where).agg(F.count(F.lit(1)).alias("total_records"))
    return n.select(F.lit(limit).alias("page_limit"), F.lit(page).alias("page_number"), "total_records", F.ceil(F.col("total_records") / limit).cast("bigint").alias("total_pages"))


@dataclass(frozen=True)
class Listing:
    """A list endpoint: what it searches, filters and sorts by, and how its pages count.

    Unknown filters are refused, or dropped where ``lenient_filters`` says so.
    ``instead`` names filters that count only where another is not given;
    ``trimmed`` those whose value loses its outer white space.  Two filters on
    one column both hold.
    """

    searched: tuple[str, ...]
    filters: dict[str, str]
    sorts: Sorts
    first_page: int = 1
    owner: str | None = "user_id"
    deleted: str | None = "strict"
    lenient_filters: bool = False
    instead: tuple[tuple[str, str], ...] = ()
    trimmed: tuple[str, ...] = ()

    def where(self, owner: object = None, **given: object) -> Column:
        """Owner first, then the delete flag, each given filter, and the search."""
        unknown = set(given) - set(self.filters) - {"search"}
        if unknown and not self.lenient_filters:
            raise ValueError(f"no filter {sorted(unknown)}")
        given = {k: v for k, v in given.items() if v is not None and v != ""}
        for second, main in self.instead:
            if main in given:
                given.pop(second, None)
        given = {k: v.strip() if k in self.trimmed and isinstance(v, str) else v for k, v in given.items()}
        guard = {"strict": not_deleted, "lenient": not_deleted_or_unknown}.get(self.deleted or "")
        return all_of(
            owned_by(owner, self.owner) if self.owner and owner is not None else None,
            guard() if guard else None,
            *[F.col(self.filters[k]) == F.lit(v) for k, v in given.items() if k in self.filters],
            search(given.get("search"), *self.searched),
        )

    def page(self, df: DataFrame, where: Column, page: int, limit: int = DEFAULT_PAGE, sort: str | None = None, direction: str | None = None) -> tuple[DataFrame, DataFrame]:
        return rows_of_page(df, where, self.sorts.keys(sort, direction), page, limit, self.first_page), totals(df, where, page, limit)


def _documents_filter() -> dict[str, str]:
    # API names of columns; title and type are second names.
    return {"documentType": "document_type", "type": "document_type", "fileName": "file_name", "title": "file_name", "fileType": "file_type", "ocrStatus": "ocr_status", "hospitalName": "hospital_name", "doctorName": "doctor_name", "createdBy": "user_id"}


# Fixed values below: searched columns, filter and sort names of each list.


def listing(table: str, variant: str = "page") -> Listing:
    """The list of a table. Built on demand: enum sorts need a session."""
    enum = lambda e, c: ordinal(e, F.col(c))
    if table == "documents" and variant == "get":
        return Listing(("file_name", "hospital_name", "doctor_name"), {"documentType": "document_type"}, Sorts({"createdAt": "created_at", "fileName": "file_name", "reportDate": "report_date", "documentType": enum("document_type", "document_type")}), deleted="lenient")
    if table == "documents":
        sorts = {"createdAt": "created_at", "title": "file_name", "fileName": "file_name", "hospitalName": "hospital_name", "doctorName": "doctor_name", "reportDate": "report_date", "documentType": "document_type", "type": enum("document_type", "document_type"), "fileType": enum("file_type", "file_type")}
        return Listing(("file_name", "hospital_name", "doctor_name", "remarks", "document_type"), _documents_filter(), Sorts(sorts, descending=False), deleted="lenient", instead=(("type", "documentType"),), trimmed=("documentType", "type"))
    if table == "medications":
        sorts = {"createdAt": "created_at", "medicationName": "medication_name", "startDate": "start_date", "medicationType": enum("medication_type", "medication_type"), "frequency": enum("frequency_type", "frequency")}
        return Listing(("medication_name", "prescribed_by", "notes", "medication_type", "frequency", "food_frequency"), {"medicationType": "medication_type", "frequency": "frequency", "foodFrequency": "food_frequency"}, Sorts(sorts), lenient_filters=True)
    if table == "notifications":
        return Listing(("title", "body"), {"userId": "user_id", "isRead": "is_read"}, Sorts({"createdAt": "created_at", "title": "title"}), first_page=0, owner=None, deleted=None)
    if table == "patients":
        sorts = {"createdAt": "created_at", "fullName": "full_name", "email": "email", "age": "age", "status": enum("user_status", "status")}
        return Listing(("full_name", "email", "patient_code"), {"status": "status", "gender": "gender"}, Sorts(sorts), owner=None)
    raise KeyError(table)


__all__ = ["DEFAULT_PAGE", "Listing", "MAX_PAGE", "Sorts", "listing", "order_key", "page_bounds", "rows_of_page", "totals"]
