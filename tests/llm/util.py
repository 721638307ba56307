from pyspark.sql import DataFrame


def docs_frame(spark, rows) -> DataFrame:
    return spark.createDataFrame(list(rows), "doc_id long, text string").repartition(3)


def rows_of(df: DataFrame) -> list[tuple]:
    return sorted((tuple(r) for r in df.collect()), key=str)
