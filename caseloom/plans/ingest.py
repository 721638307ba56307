"""From uploaded files to structured records: bronze, silver, gold.

OCR and the language model are functions over pandas batches that the caller
gives; without them the plan still runs, with null results and their status.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from caseloom.functions.contours import LEVEL, MIN_AREA, contours_of, grey
from caseloom.functions.scalar import date_or_null
from caseloom.functions.text import clean_ocr, join_lines, parse_record, structure_prompt
from caseloom.operators.state import ocr_status

# The OCR reply and its graphs.
GRAPHS = "array<struct<type:string,coordinates:array<struct<x:int,y:int>>,width:int,height:int>>"
OCR_REPLY = f"success boolean, ocr_text string, graphs {GRAPHS}, error string, trace string"


def each(df: DataFrame, column: str, out: str, work: Callable[[bytes | str], object] | None, kind: str) -> DataFrame:
    """``out``: work(column) by batches; null where work fails or is not given, with the error beside it."""
    if work is None:
        return df.withColumns({out: F.lit(None).cast(kind), f"{out}_error": F.lit(None).cast("string")})

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            got, errors = [], []
            for value in pdf[column]:
                try:
                    got.append(work(value))
                    errors.append(None)
                except Exception as e:  # a bad file is a row with an error, not a failed job
                    got.append(None)
                    errors.append(str(e))
            yield pdf.assign(**{out: pd.Series(got, dtype=object, index=pdf.index), f"{out}_error": pd.Series(errors, dtype=object, index=pdf.index)})

    base = ", ".join(f"`{n}` {t}" for n, t in df.dtypes)
    return df.mapInPandas(run, f"{base}, `{out}` {kind}, `{out}_error` string")


def ocr_lines(pages: Column) -> Column:
    """Line texts of an engine's first page: [[box, [text, score]], ...] as nested arrays of strings."""
    return F.transform(F.get(pages, F.lit(0)), lambda line: F.get(line, F.lit(0)))


def contour_points(contours: Column, height: Column) -> Column:
    """Graphs of contours (points, area): small ones go, y is turned upward, and each keeps its own points."""
    large = F.filter(contours, lambda c: c["area"] >= MIN_AREA)
    flip = lambda c: F.transform(c["points"], lambda p: F.struct(p["x"].cast("int").alias("x"), (height - p["y"]).cast("int").alias("y")))
    return F.transform(large, lambda c: F.struct(F.lit("graph").alias("type"), flip(c).alias("coordinates")))


#: Pixels that are searched together.
PIXELS = 1 << 20

GRAPH = "origin string, n int, type string, area double, coordinates array<struct<x:int,y:int>>, width int, height int"


def images(spark: SparkSession, path: str) -> DataFrame:
    """(origin, height, width, nChannels, mode, data) of image files under a path; a file that is none (a PDF, a broken one) has height -1 and no data."""
    return spark.read.format("image").option("dropInvalid", False).load(path).select("image.*")


def graphs(pictures: DataFrame, least: float = MIN_AREA) -> DataFrame:
    """The graphs in image rows, one row each: contours of dark shapes, those of small area left out, y turned upward.

    n counts an image's graphs from 0, the last found first. An image that can't be read, is empty or
    whose bytes aren't height x width x channels has none. Images of one width that follow one another
    are searched together, a bounded number of pixels at a time; a larger image is alone.
    """
    names = ["origin", "n", "type", "area", "coordinates", "width", "height"]
    kinds = [pa.string(), pa.int32(), pa.string(), pa.float64(), pa.list_(pa.struct([("x", pa.int32()), ("y", pa.int32())])), pa.int32(), pa.int32()]

    def rows_of(held: list[tuple]) -> Iterator[tuple]:
        for (origin, h, w, _), found in zip(held, contours_of([x[3] for x in held], least), strict=True):
            for i, (a, points) in enumerate(found):
                yield origin, i, "graph", a, [{"x": x, "y": h - y} for x, y in points], w, h

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def emit(held: list[tuple]) -> Iterator[pa.RecordBatch]:
            rows = list(rows_of(held))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)

        for batch in batches:
            held, size = [], 0
            for origin, height, width, channels, data in zip(*(batch[c] for c in ("origin", "height", "width", "nChannels", "data")), strict=True):
                h, w, k, raw = (x.as_py() for x in (height, width, channels, data))
                if not raw or None in (h, w, k) or min(h, w) < 1 or k not in (1, 3, 4) or len(raw) != h * w * k:
                    continue
                if held and (w != held[0][2] or size + h * w > PIXELS):
                    yield from emit(held)
                    held, size = [], 0
                held.append((origin.as_py(), h, w, grey(raw, h, w, k) <= LEVEL))
                size += h * w
            if held:
                yield from emit(held)

    return pictures.select("origin", "height", "width", "nChannels", "data").mapInArrow(run, GRAPH)


def graphs_of_files(files: DataFrame, found: DataFrame) -> DataFrame:
    """Files (path) with ``graphs``: an array of their graphs in order, empty where there are none."""
    of = found.groupBy("origin").agg(F.sort_array(F.collect_list(F.struct("n", "type", "coordinates", "width", "height"))).alias("_g"))
    one = F.transform("_g", lambda g: g.dropFields("n"))
    return files.join(of, F.col("path") == F.col("origin"), "left").withColumn("graphs", F.coalesce(one.cast(GRAPHS), F.array().cast(GRAPHS))).drop("origin", "_g")


def bronze(files: DataFrame, ocr: Callable[[bytes], list[str]] | None) -> DataFrame:
    """Files with their OCR lines."""
    return each(files, "content", "lines", ocr, "array<string>").drop("content")


def silver(rows: DataFrame) -> DataFrame:
    """Clean text and the status of each file."""
    return rows.withColumns({"ocr_text": clean_ocr(join_lines("lines")), "ocr_status": ocr_status(F.lit(True), F.when(F.col("lines_error").isNotNull(), False).when(F.col("lines").isNotNull(), True))})


def gold(rows: DataFrame, model: Callable[[str], str] | None) -> DataFrame:
    """The structured record and its projected fields; the date is the record's report.date."""
    asked = rows.withColumn("prompt", structure_prompt(F.col("ocr_text"), F.lit(None).cast(GRAPHS)))
    told = each(asked, "prompt", "reply", model, "string").withColumn("record", parse_record(F.col("reply")))
    return told.select(
        *rows.columns, "record", F.col("record.hospital.name").alias("hospital_name"), F.col("record.doctor.name").alias("doctor_name"),
        date_or_null(F.col("record.report.date")).alias("report_date"), F.col("record.remarks").alias("remarks"),
    )
