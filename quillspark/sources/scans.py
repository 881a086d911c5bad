"""Scans of packages, pages, listings and histories, and read-only SQL over them."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import natural_key

#: Rows of a package's tables; all start with the report's id, by which they are partitioned.
LINES = T.StructType([T.StructField(n, t) for n, t in (("report_id", T.StringType()), ("id", T.StringType()), ("section_id", T.StringType()), ("unit_id", T.StringType()), ("seq", T.LongType()), ("pdf_page", T.LongType()), ("label", T.StringType()), ("kind", T.StringType()), ("note_ref", T.StringType()))])
VALUES = T.StructType([T.StructField(n, t) for n, t in (("report_id", T.StringType()), ("line_id", T.StringType()), ("col", T.LongType()), ("heading", T.StringType()), ("period_end", T.StringType()), ("period_label", T.StringType()), ("raw", T.StringType()), ("value", T.DoubleType()), ("nil", T.BooleanType()))])
EDGES = T.StructType([T.StructField(n, T.StringType()) for n in ("report_id", "src", "dst", "kind", "method", "confidence", "evidence")])
CHECKS = T.StructType([T.StructField(n, t) for n, t in (("report_id", T.StringType()), ("kind", T.StringType()), ("subject", T.StringType()), ("status", T.StringType()), ("expected", T.DoubleType()), ("actual", T.DoubleType()), ("message", T.StringType()))])
TABLES = {"lines": LINES, "values": VALUES, "edges": EDGES, "checks": CHECKS}


def report_files(spark: SparkSession, folder: str, pattern: str = "*.pdf") -> DataFrame:
    """path, name and size of the reports of a folder, in natural order; contents are not read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder).select("path", F.col("length").alias("size"))
    name = F.element_at(F.split("path", "/"), -1)
    return files.withColumn("name", name).orderBy(natural_key(F.col("name")))


def report_hashes(spark: SparkSession, folder: str, pattern: str = "*.pdf") -> DataFrame:
    """path and SHA-256 of each report: the id that survives a new name."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder).select("path", F.sha2("content", 256).alias("report_id"))


def pages_of_text(spark: SparkSession, folder: str) -> DataFrame:
    """page and text of transcribed pages (page-007.md), one row a file."""
    rows = spark.read.text(f"{folder}/page-*.md", wholetext=True).select(F.col("_metadata.file_name").alias("name"), F.col("value").alias("text"))
    return rows.select(F.regexp_extract("name", "([0-9]+)", 1).cast("int").alias("page"), "text")


def package_table(spark: SparkSession, root: str, name: str, report_id: str | None = None) -> DataFrame:
    """A table of the package store; an absent one is empty. The report's id prunes partitions."""
    path = f"{root}/{name}"
    hpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not hpath.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hpath):
        return spark.createDataFrame([], TABLES[name])
    rows = spark.read.schema(TABLES[name]).parquet(path)
    return rows if report_id is None else rows.where(F.col("report_id") == report_id)


def read_only_query(spark: SparkSession, sql: str, args: list | None = None, **tables: DataFrame) -> DataFrame:
    """SQL with ? parameters over named tables; anything but a query is refused."""
    if not re.match(r"\s*(select|with)\b", sql, re.I):
        raise ValueError("only SELECT is allowed")
    for name, df in tables.items():
        df.createOrReplaceTempView(name)
    return spark.sql(sql, args=args or [])


def page_spec(spec: str) -> list[int]:
    """Sorted distinct pages of "405-407, 410"; a range spans at most a hundred pages."""
    pages: set[int] = set()
    for part in filter(None, (p.strip() for p in spec.split(","))):
        m = re.fullmatch(r"(\d+)(?:\s*-\s*(\d+))?", part)
        if not m:
            raise ValueError(f"not a page or a range: {part!r}")
        first, last = int(m[1]), int(m[2] or m[1])
        if last < first or last - first > 100:
            raise ValueError(f"not a range of pages: {part!r}")
        pages.update(range(first, last + 1))
    return sorted(pages)


def page_spec_column(spec) -> object:
    """The same for a column of specs, as an array; null where ``page_spec`` raises an error."""
    parts = F.filter(F.transform(F.split(spec, ","), lambda p: F.trim(p)), lambda p: p != "")
    first = lambda p: F.regexp_extract(p, "^([0-9]+)", 1).try_cast("int")
    last = lambda p: F.coalesce(F.regexp_extract(p, "-\\s*([0-9]+)$", 1).try_cast("int"), first(p))
    fine = lambda p: p.rlike(r"^[0-9]+(\s*-\s*[0-9]+)?$") & (last(p) >= first(p)) & (last(p) - first(p) <= 100)
    pages = F.flatten(F.transform(parts, lambda p: F.when(fine(p), F.sequence(first(p), last(p)))))
    return F.when(F.forall(parts, fine), F.array_sort(F.array_distinct(pages)))


#: Fixed value: the first bytes of a package file, in hex.
PACKAGE_HEAD = "53514C69746520666F726D6174203300"


def import_problem(head: Column, version: Column, sha256: Column, major: str = "1") -> Column:
    """Why a file can't be imported as a package (its first bytes, its schema version, the hash of its report), or null."""
    wrong_head = ~F.coalesce(F.hex(F.substring(head, 1, 16)) == PACKAGE_HEAD, F.lit(False))
    wrong_version = ~F.coalesce(F.split_part(version, F.lit("."), F.lit(1)) == major, F.lit(False))
    return F.when(wrong_head, "not a package").when(wrong_version, "another version").when(~F.coalesce(sha256.rlike("^[0-9a-f]{64}$"), F.lit(False)), "no report")


def history_entry(text: Column) -> Column:
    """meta (map of the "Key: value" lines before the first empty line) and question (what follows it)."""
    head = F.split_part(text, F.lit("\n\n"), F.lit(1))
    lines = F.filter(F.split(head, "\n"), lambda x: x.rlike("^[A-Za-z ]+: "))
    meta = F.map_from_entries(F.transform(lines, lambda x: F.struct(F.regexp_extract(x, "^([A-Za-z ]+): ", 1).alias("key"), F.regexp_extract(x, "^[A-Za-z ]+: (.*)$", 1).alias("value"))))
    return F.struct(meta.alias("meta"), F.substr(text, F.length(head) + 3).alias("question"))


def find_models(registry: DataFrame, key: str) -> DataFrame:
    """The models whose hash is ``key``, or whose id is ``key`` or starts with it and a hyphen; ``supported`` unless pending."""
    found = (F.col("sha256") == key) | (F.col("id") == key) | F.col("id").startswith(key + "-")
    return registry.where(found).withColumn("supported", ~F.col("pending"))


def current_manifest(manifest: DataFrame, files: DataFrame, prompt_version: int) -> DataFrame:
    """Each file's manifest (name, size, mtime, done): kept only if size, time and prompt version are those it was made for, else it starts anew."""
    old = manifest.select("name", F.col("size").alias("_size"), F.col("mtime").alias("_mtime"), "prompt_version", "done")
    same = (F.col("size") == F.col("_size")) & (F.col("mtime") == F.col("_mtime")) & (F.col("prompt_version") == prompt_version)
    return files.join(old, "name", "left").select("name", "size", "mtime", F.when(same, F.col("done")).otherwise(0).alias("done"))
