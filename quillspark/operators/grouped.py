"""Rows of text from positioned pieces, as an ordered fold of each row."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def text_rows(spans: DataFrame, gap: float = 12.0) -> DataFrame:
    """(page, row, text): spans of a row joined, " | " where they stand apart by over ``gap``. Takes (page, row, x0, x1, text); one ordered fold a row."""
    listed = spans.groupBy("page", "row").agg(F.array_sort(F.collect_list(F.struct("x0", "x1", "text"))).alias("s"))
    start = F.struct(F.lit(None).cast("double").alias("end"), F.lit("").alias("out"))
    fold = F.aggregate("s", start, lambda a, x: F.struct(x["x1"].alias("end"), F.when(a["end"].isNull(), x["text"]).when(x["x0"] - a["end"] > gap, F.concat(a["out"], F.lit(" | "), x["text"])).otherwise(F.concat(a["out"], F.lit(" "), x["text"])).alias("out")))
    return listed.select("page", "row", fold["out"].alias("text"))
