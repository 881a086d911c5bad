"""Writers: packages by report, upserts of keys, append-only histories and the feedback trail."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.sequences import numbered


def write_package(tables: dict[str, DataFrame], root: str, report_id: str) -> None:
    """Replace one report's partition of each table; other reports stay. The commit of each write is atomic."""
    for name, rows in tables.items():
        keyed = rows.drop("report_id").withColumn("report_id", F.lit(report_id))
        keyed.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("report_id").parquet(f"{root}/{name}")


def flatten_index(sections: DataFrame) -> DataFrame:
    """Nested sections (id, seq, units array) to one row a unit with a running number over all sections."""
    rows = sections.select("id", "seq", F.posexplode("units").alias("place", "unit"))
    found = numbered(rows.select(F.col("id").alias("section_id"), "seq", "place", "unit"), "seq", "place", name="order")
    return found.select("section_id", "unit.*", "order")


def upsert(current: DataFrame, changes: DataFrame, *keys: str) -> DataFrame:
    """``current`` with the rows of ``changes`` in place of those with their keys."""
    return current.join(changes.select(*keys).distinct(), list(keys), "left_anti").unionByName(changes)


def append(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").parquet(path)


def next_number(spark: SparkSession, history: DataFrame, column: str = "sno") -> int:
    """One above the largest number so far; for a single writer."""
    return (history.agg(F.max(column)).first()[0] or 0) + 1


def unique_names(rows: DataFrame, stem: str, second: str) -> DataFrame:
    """Adds ``name``: stem and second, -2, -3 ... for those of the same stem and second."""
    n = F.row_number().over(Window.partitionBy(stem, second).orderBy("id"))
    return rows.withColumn("_n", n).withColumn("name", F.concat_ws("-", stem, second, F.when(F.col("_n") > 1, F.col("_n").cast("string")))).drop("_n")


def latest_state(events: DataFrame, key: str, at: str, *columns: str) -> DataFrame:
    """The last event of each key: its state."""
    return events.groupBy(key).agg(F.max_by(F.struct(*columns), at).alias("s")).select(key, "s.*")
