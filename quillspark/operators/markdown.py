"""Transcribed pages in Markdown as blocks, and their tables as rows.

A line is blank, a heading, a row of a table, a list item or text; a block is a run of lines of one kind, and each heading is one. So blocks
are islands of a window over the lines of a page, and a table's head is what stands above its first separator. Takes pages (page, text);
a null text has no blocks. Blocks are those of ``layout``, so ``layout.coverage`` proves them against ``plain_lines``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# How lines of Markdown begin, totals, and note references.
HEADING, ITEM = r"^(#{1,6})\s+(.*)$", r"^(?:[-*•]|\d{1,2}[.)])\s+(.*)$"
SEPARATOR = r"^\|?\s*:?-{2,}:?\s*(\|\s*:?-{2,}:?\s*)*\|?$"
TOTAL_LABEL, NOTE_REF, NOTE_HEADS = r"(?i)^total\b", r"^[0-9]{1,2}[a-z]?$|^'[A-Z]{1,2}'$", ("notes", "note", "schedule")


def cells(line: Column) -> Column:
    return F.transform(F.split(F.regexp_replace(F.trim(line), r"^\|+|\|+$", ""), r"\|"), lambda c: F.trim(c))


def lines(pages: DataFrame) -> DataFrame:
    """(page, n, s, kind): the lines of each page without the space around them, and what they are."""
    rows = pages.where("text is not null").select("page", F.posexplode(F.split("text", r"\r\n|\n|\r")).alias("n", "s"))
    rows = rows.withColumn("s", F.regexp_replace("s", r"^\s+|\s+$", ""))
    s = F.col("s")
    return rows.withColumn("kind", F.when(s == "", "blank").when(s.rlike(HEADING), "heading").when(s.startswith("|"), "table").when(s.rlike(ITEM), "list").otherwise("paragraph"))


def _numbered(rows: DataFrame) -> DataFrame:
    order = Window.partitionBy("page").orderBy("n")
    new = (F.col("kind") == "heading") | ~F.col("kind").eqNullSafe(F.lag("kind").over(order))
    rows = rows.withColumn("run", F.sum(F.when(new, 1).otherwise(0)).over(order)).where("kind <> 'blank'")
    return rows.withColumn("place", F.dense_rank().over(Window.partitionBy("page").orderBy("run")) - 1)


def blocks(pages: DataFrame) -> DataFrame:
    """(page, place, kind, level, text, items, markers, value, label, labels, source, head, rows) in the order written."""
    rows = _numbered(lines(pages))
    rule = (F.col("kind") == "table") & F.col("s").rlike(SEPARATOR)
    below = F.max(F.when(rule, 1).otherwise(0)).over(Window.partitionBy("page", "run").orderBy("n").rowsBetween(Window.unboundedPreceding, -1))
    ruled = F.max(F.when(rule, 1).otherwise(0)).over(Window.partitionBy("page", "run"))
    rows = rows.withColumn("head", (F.coalesce(below, F.lit(0)) == 0) & (ruled == 1)).where(~rule)
    rows = rows.withColumn("item", F.regexp_extract("s", ITEM, 1)).withColumn("own", F.when(F.col("kind") == "heading", F.trim(F.regexp_extract("s", HEADING, 2))).otherwise(F.col("s")))
    listed = rows.groupBy("page", "place", "kind").agg(F.array_sort(F.collect_list(F.struct("n", "head", "own", "item", "s"))).alias("a"))
    part = lambda head: F.transform(F.filter("a", lambda x: x["head"] == F.lit(head)), lambda x: cells(x["s"]))
    of = lambda kind, value: F.when(F.col("kind") == kind, value)
    none = F.lit(None).cast("string")
    marks = F.length(F.regexp_extract(F.get("a", F.lit(0))["s"], HEADING, 1))
    return listed.select(
        "page", "place", "kind", of("heading", F.least(F.lit(3), F.greatest(F.lit(1), marks - 1))).alias("level"), F.when(F.col("kind").isin("heading", "paragraph"), F.array_join("a.own", " ")).alias("text"),
        of("list", F.col("a.item")).alias("items"), of("list", F.lit("")).alias("markers"), none.alias("value"), none.alias("label"), F.lit(None).cast("array<string>").alias("labels"),
        of("table", F.lit("markdown")).alias("source"), of("table", part(True)).alias("head"), of("table", part(False)).alias("rows"),
    )


def plain_lines(pages: DataFrame) -> DataFrame:
    """(page, t): the lines without the marks that blocks don't show."""
    s = F.col("s")
    bare = F.when((F.col("kind") == "table") & s.rlike(SEPARATOR), "").when(F.col("kind") == "heading", F.regexp_extract(s, HEADING, 2)).when(F.col("kind") == "table", F.array_join(cells(s), " ")).when(F.col("kind") == "list", F.regexp_extract(s, ITEM, 1)).otherwise(s)
    return lines(pages).select("page", bare.alias("t"))


def _plain(label: Column) -> Column:
    return F.trim(F.replace(label, F.lit("**"), F.lit("")))


def table_rows(found: DataFrame, ties: DataFrame | None = None) -> DataFrame:
    """(page, place, row, kind, label, cells, notes_col): the rows of the tables of ``blocks`` as header, section, text, data or total.

    The first row is the header unless it is empty. A row without figures is a section if it is bold or ends in a colon, else text. A total says
    so, has no label, or holds a figure that ties (``ties`` has page and figure, as printed). ``notes_col`` is the first column of note references.
    """
    tables = found.where("kind = 'table'").withColumn("all", F.concat("head", "rows"))
    tables = tables.withColumn("width", F.array_max(F.transform("all", lambda r: F.size(r))) - 1)
    if ties is not None:
        known = ties.groupBy("page").agg(F.collect_set("figure").alias("tied"))
        tables = tables.join(known, "page", "left")
    else:
        tables = tables.withColumn("tied", F.lit(None).cast("array<string>"))
    places = F.when(F.col("width") > 0, F.sequence(F.lit(1), F.col("width"))).otherwise(F.array().cast("array<int>"))
    said = lambda r: F.transform(places, lambda k: _plain(F.coalesce(F.get(r, k), F.lit(""))))
    tables = tables.select("page", "place", "width", "tied", F.transform("all", lambda r: F.struct(_plain(F.get(r, F.lit(0))).alias("label"), said(r).alias("cells"), F.trim(F.get(r, F.lit(0))).rlike(r"^\*\*.+\*\*$").alias("bold"), F.exists(r, lambda c: c != "").alias("filled"))).alias("all"))
    none = F.array().cast("array<string>")

    def read(r: Column, i: Column) -> Column:
        label, empty = r["label"], ~F.exists(r["cells"], lambda c: c != "")
        sums = (label == "") | label.rlike(TOTAL_LABEL) | F.exists(r["cells"], lambda c: (c != "") & F.coalesce(F.array_contains("tied", c), F.lit(False)))
        kind = (
            F.when(i == 0, F.when(r["filled"], "header")).when(empty & (label == ""), None)
            .when(empty, F.when(r["bold"] | label.endswith(":"), "section").otherwise("text")).when(sums, "total").otherwise("data")
        )
        return F.struct(kind.alias("kind"), label.alias("label"), r["cells"].alias("cells"))

    tables = tables.withColumn("all", F.transform("all", read)).withColumn("all", F.filter("all", lambda r: r["kind"].isNotNull()))

    def of_notes(k: Column) -> Column:
        """The header names the column, or it has cells below and all are note references."""
        own = F.filter("all", lambda r: r["kind"].isin("data", "total") & (F.get(r["cells"], k) != ""))
        named = F.exists("all", lambda r: (r["kind"] == "header") & F.lower(F.get(r["cells"], k)).isin(*NOTE_HEADS))
        return named | ((F.size(own) > 0) & F.forall(own, lambda r: F.get(r["cells"], k).rlike(NOTE_REF)))

    notes = F.get(F.filter(F.transform(places, lambda k: k - 1), of_notes), F.lit(0)).alias("notes_col")
    rows = tables.select("page", "place", notes, F.posexplode_outer("all").alias("row", "r")).where("row is not null")
    cut = F.when(F.col("r.kind").isin("section", "text"), none).otherwise(F.col("r.cells"))
    return rows.select("page", "place", "row", "r.kind", "r.label", cut.alias("cells"), "notes_col")
