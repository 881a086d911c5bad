"""Statement tables of a page from its positioned cells: parts, columns, header bands, group headings, wrapped labels, the notes column.

Cells are shuffled once, by page; all that follows is grouped within a page, which is bounded by what a sheet holds. What
hangs on the row before it (columns by their right edges, labels that run on) are folds over the ordered rows of one table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions.figures import let

# Figures, note references, the lines that divide a statement, and the distances in points.
VALUE = r"^\(?[-–−]?\s*[₹$]?\s*[0-9,]+(\.[0-9]+)?\)?%?$|^[-–—]$"
NOTE_REF = r"^[0-9]{1,2}[a-z]?$|^'[A-Z]{1,2}'$"
SIGNATURE_LINE = r"(?i)^As per our report"
UNIT_LINE = r"(?i)In\s*₹\s*Million|₹\s*in\s*Million"
UNIT_WORDS = ("in", "₹", "million", "in ₹", "₹ million", "in ₹ million", "₹ in million")
UNIT_LABEL = "₹ in Million"
PART_LINE = r"^[A-Z]\.\s+[A-Z][A-Z &,'()\-:]+(\(CONTD\.?\))?$"
REFER_NOTE = r"(?i)^\(Refer note [\w, ()]+\)$"
SECTION_LINE = r"^([IVX]+\.|[A-Z]\.|[A-Z][A-Z &/,'\-()]{3,}$)|:$"
TOTAL_LINE = r"(?i)^(total|net (cash|increase|decrease)|profit (for|before)|cash and cash equivalents at)"
NOTES_HEADS = ("notes", "schedule")
COLUMN_GAP, EDGE_REACH, LEAST_OVERLAP, CENTRE_REACH = 6.0, 4.0, 0.4, 12.0

_CELLS = "array<struct<first:int,last:int,centre:double,text:string>>"
_ROW = "struct<step:int,kind:string,label:string,cells:array<string>,spans:array<struct<span:int,text:string>>>"


def is_value(text: Column) -> Column:
    return text.rlike(VALUE) | text.rlike(NOTE_REF)


def stacked(words: Column) -> Column:
    """Words set beside or above one another as one text; nothing stands between a hyphen at an end and the next word."""
    kept = F.filter(F.transform(words, lambda w: F.trim(w)), lambda w: w != "")
    return F.aggregate(kept, F.lit(""), lambda out, w: F.concat(out, F.when((out == "") | out.endswith("-"), "").otherwise(" "), w))


def _places(n: Column) -> Column:
    """0 to n - 1; none for 0."""
    return F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))


def page_rows(cells: DataFrame, page: list[str], title: str | None) -> DataFrame:
    """(page, part, row, unit, cells): printed rows without the repeated title and what follows a signature; cells know whether they are figures."""
    listed = F.array_sort(F.collect_list(F.struct("x0", "x1", "text")))
    known = cells.where("row is not null and x0 is not null and x1 is not null and text is not null").repartition(*page)
    rows = known.groupBy(*page, "row", *([title] if title else [])).agg(listed.alias("cells")).withColumn("line", F.array_join("cells.text", " "))
    signed = F.min(F.when(F.col("line").rlike(SIGNATURE_LINE), F.col("row"))).over(Window.partitionBy(*page))
    rows = rows.withColumn("_signed", signed).where("_signed is null or row < _signed")
    if title:
        rows = rows.where(F.coalesce(tx.norm_heading(F.col("line")) != tx.norm_heading(F.col(title)), F.lit(True)))
    unit = F.col("line").rlike(UNIT_LINE)
    rows = rows.withColumn("unit", unit).withColumn("cells", F.when(unit, F.filter("cells", lambda c: ~F.trim(F.lower(c["text"])).isin(*UNIT_WORDS))).otherwise(F.col("cells")))
    rows = rows.withColumn("cells", F.filter("cells", lambda c, i: ~((c["text"] == "$") & F.coalesce(is_value(F.get("cells", i + 1)["text"]), F.lit(False)))))
    label_first = (F.size("cells") > 1) & ~is_value(F.get("cells", F.lit(1))["text"])
    number = lambda c, i: is_value(c["text"]) & ~((i == 0) & label_first)
    rows = rows.withColumn("cells", F.transform("cells", lambda c, i: F.struct(c["x0"].alias("x0"), c["x1"].alias("x1"), c["text"].alias("text"), number(c, i).alias("number"))))
    order = Window.partitionBy(*page).orderBy("row")
    before = F.count_if(F.size("cells") > 0).over(order.rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("_part", F.when(F.array_join("cells.text", " ").rlike(PART_LINE) & (before > 0), 1).otherwise(0))
    return rows.select(*page, F.sum("_part").over(order).cast("int").alias("part"), "row", "unit", "cells")


def columns(rows: Column) -> Column:
    """Columns of a table as (left, x1), from the right edges of its figures: an edge within the gap of the last one is of its column."""
    edges = F.array_sort(F.transform(F.filter(F.flatten(F.transform(rows, lambda r: r["cells"])), lambda c: c["number"]), lambda c: F.struct(c["x1"].alias("x1"), c["x0"].alias("x0"))))

    def take(found: Column, edge: Column) -> Column:
        def beside(last: Column) -> Column:
            wider = F.struct(edge["x1"].alias("x1"), F.least(last["x0"], edge["x0"]).alias("x0"))
            near = F.coalesce(edge["x1"] - last["x1"] <= COLUMN_GAP, F.lit(False))
            return F.when(near, F.concat(F.slice(found, F.lit(1), F.greatest(F.size(found) - 1, F.lit(0))), F.array(wider))).otherwise(F.concat(found, F.array(edge)))

        return let(F.get(found, F.size(found) - 1), beside)

    found = F.aggregate(edges, F.array().cast("array<struct<x1:double,x0:double>>"), take)
    return F.transform(found, lambda c: F.struct(c["x0"].alias("x0"), c["x1"].alias("x1")))


def _with_left(found: Column) -> Column:
    """A column reaches from the right edge of the one before it, the first from a little left of its widest figure."""
    return F.transform(found, lambda c, i: F.struct(F.when(i == 0, c["x0"] - 2).otherwise(F.get(found, i - 1)["x1"]).alias("left"), c["x1"].alias("x1")).cast("struct<left:double,x1:double>"))


def placed_cells(cells: Column, cols: Column, limit: Column, numbers: Column, heading: Column) -> Column:
    """Cells with the first and last column that they belong to; null for those of the label, several for group headings.

    ``limit`` is where the columns begin, ``numbers`` whether the row has figures, ``heading`` whether it is a row of headings.
    """

    def place(c: Column) -> Column:
        centre = (c["x0"] + c["x1"]) / 2
        # Nearest column by right edge; of equals the first.
        near = F.array_min(F.transform(cols, lambda k, i: F.struct(F.abs(k["x1"] - c["x1"]).alias("far"), i.alias("at"))))
        over = lambda k: (k["x1"] > k["left"]) & ((F.least(c["x1"], k["x1"]) - F.greatest(c["x0"], k["left"])) >= LEAST_OVERLAP * (k["x1"] - k["left"]))
        hits = lambda: F.filter(F.transform(cols, lambda k, i: F.when(over(k), i)), lambda i: i.isNotNull())
        under = F.nullif(F.array_position(F.transform(cols, lambda k: (k["left"] < centre) & (centre <= k["x1"])), True), F.lit(0)).cast("int") - 1

        def at(first: Column, last: Column) -> Column:
            return F.struct(first.alias("first"), last.alias("last"))

        def of_hits(h: Column) -> Column:
            several = ~numbers & (F.size(h) >= 2)
            return F.when(several, at(F.get(h, F.lit(0)), F.get(h, F.size(h) - 1))).when(F.size(h) == 1, at(F.get(h, F.lit(0)), F.get(h, F.lit(0)))).otherwise(let(near, lambda n: at(n["at"], n["at"])))

        single = lambda value: let(value, lambda v: at(v, v))
        in_label = F.when(heading, single(F.coalesce(under, let(near, lambda n: F.when(n["far"] <= EDGE_REACH, n["at"])))))
        where = F.when(F.size(cols) == 0, F.lit(None)).when(c["number"], single(near["at"])).when(c["x0"] < limit, in_label).otherwise(let(hits(), of_hits))
        return let(where, lambda w: F.struct(w["first"].alias("first"), w["last"].alias("last"), centre.alias("centre"), c["text"].alias("text")))

    return F.transform(cells, place).cast(_CELLS)


def group_spans(groups: Column, cols: Column) -> Column:
    """Group headings of one printed row as (span, text) over all columns. Each is widened, by as much as keeps it centred, to free columns beside it."""
    middle = lambda a, b: (F.get(cols, a)["left"] + F.get(cols, b)["x1"]) / 2

    def widened(taken: Column, g: Column) -> Column:
        def step(s: Column, _: Column) -> Column:
            def wider(left: int, right: int) -> Column:
                a, b = s["first"] - left, s["last"] + right
                free = ~F.exists(taken, lambda t: ((t["first"] < s["first"]) & (t["last"] >= a)) | ((t["first"] <= b) & (t["last"] > s["last"])))
                drift = F.abs(middle(a, b) - g["centre"])
                fits = (a >= 0) & (b < F.size(cols)) & F.coalesce(drift <= CENTRE_REACH, F.lit(False)) & free
                return F.when(fits, F.struct((b - a).alias("n"), (-drift).alias("near"), a.alias("first"), b.alias("last")))

            best = F.array_max(F.array(wider(1, 1), wider(1, 0), wider(0, 1)))
            return let(best, lambda b: F.struct(F.coalesce(b["first"], s["first"]).alias("first"), F.coalesce(b["last"], s["last"]).alias("last")))

        span = F.aggregate(F.sequence(F.lit(1), F.size(cols)), F.struct(g["first"].alias("first"), g["last"].alias("last")), step)
        return let(span, lambda s: F.concat(taken, F.array(F.struct(s["first"].alias("first"), s["last"].alias("last"), g["text"].alias("text")))))

    blank = lambda n: F.when(n > 0, F.array(F.struct(n.alias("span"), F.lit("").alias("text")))).otherwise(F.array().cast("array<struct<span:int,text:string>>"))
    own = lambda s: F.array(F.struct((s["last"] - s["first"] + 1).alias("span"), s["text"].alias("text")))

    def filled(spans: Column) -> Column:
        parts = F.flatten(F.transform(spans, lambda s, i: F.concat(blank(s["first"] - F.coalesce(F.get(spans, i - 1)["last"] + 1, F.lit(0))), own(s))))
        return F.concat(parts, blank(F.size(cols) - 1 - F.get(spans, F.size(spans) - 1)["last"]))

    return let(F.array_sort(F.aggregate(groups, F.array().cast("array<struct<first:int,last:int,text:string>>"), widened)), filled)


def _run_on(rows: Column, plain: Column) -> Column:
    """For each row of a table the place of the row whose label it belongs to: its own, or that of the row which it runs on from."""

    def take(s: Column, r: Column) -> Column:
        label, here = r["label"], F.size(s["heads"])
        digit = label.rlike("[0-9]")
        bracket = label.startswith("(") & ((s["kind"] == "text") | ~digit | label.rlike(REFER_NOTE))
        rest = (s["kind"] == "data") & s["item"] & ~label.startswith("- ") & (F.size(F.split(label, r"\s+")) <= 3) & ~digit
        goes_on = ~plain & r["kind"].isin("section", "text") & (label != "") & s["kind"].isin("data", "total", "text") & (label.rlike(r"^\p{Ll}") | bracket | rest)
        state = lambda head, kind, item: F.struct(head.alias("head"), kind.alias("kind"), item.alias("item"), F.concat(s["heads"], F.array(head)).alias("heads"))
        return F.when(goes_on, state(s["head"], s["kind"], s["item"])).otherwise(state(here, r["kind"], label.startswith("- ")))

    start = F.struct(F.lit(0).alias("head"), F.lit("").alias("kind"), F.lit(False).alias("item"), F.array().cast("array<int>").alias("heads"))
    return F.aggregate(rows, start, take)["heads"]


def notes_column(rows: Column, width: Column) -> Column:
    """Place of the first column headed as notes, or whose filled cells are all note references; null if there is none."""
    inside = lambda kinds, k: F.transform(F.filter(rows, lambda r: r["kind"].isin(*kinds)), lambda r: F.get(r["cells"], k))

    def of_notes(k: Column) -> Column:
        filled = F.filter(inside(("data", "total"), k), lambda c: c != "")
        return F.exists(inside(("header",), k), lambda c: F.lower(c).isin(*NOTES_HEADS)) | ((F.size(filled) > 0) & F.forall(filled, lambda c: c.rlike(NOTE_REF)))

    return F.nullif(F.array_position(F.transform(_places(width), of_notes), True), F.lit(0)).cast("int") - 1


def statement_tables(cells: DataFrame, page: list[str], title: str | None = None) -> DataFrame:
    """(page, part, place, kind, label, cells, spans, notes_col): the rows of a page's tables, from cells with their places.

    Kinds are unit, group, header, data, total, section and text; ``cells`` has one text a column (headers, data, totals) and
    ``spans`` the (span, text) of group headings. Lettered parts are tables of their own. Takes (page, row, x0, x1, text) and
    the column that ``title`` names. Cells without text or place are no cells; a page without figures is plain text; repeated
    cells stay; no cells give no rows.
    """
    table = [*page, "part"]
    rows = page_rows(cells, page, title)
    whole = rows.groupBy(*table).agg(F.array_sort(F.collect_list(F.struct("row", "unit", "cells"))).alias("rows"))
    whole = whole.withColumn("_edges", columns(F.col("rows"))).select(*table, _with_left(F.col("_edges")).alias("cols"), F.inline("rows"))
    whole = whole.withColumn("numbers", F.exists("cells", lambda c: c["number"])).withColumn("limit", F.get("cols", F.lit(0))["left"])
    heading = ~F.col("numbers") & F.exists("cells", lambda c: c["x0"] >= F.col("limit"))
    read = whole.select(*table, "cols", "row", "unit", "numbers", placed_cells(F.col("cells"), F.col("cols"), F.col("limit"), F.col("numbers"), heading).alias("placed"))
    read = read.withColumn("band", ~F.col("numbers") & F.exists("placed", lambda c: c["first"].isNotNull()))
    starts = F.when(~F.col("band") | F.col("unit"), 1).otherwise(0)
    read = read.withColumn("run", F.sum(starts).over(Window.partitionBy(*table).orderBy("row")))
    listed = F.array_sort(F.collect_list(F.struct("row", "placed")))
    merged = read.groupBy(*table, "run", "band").agg(F.min("row").alias("row"), F.first("cols").alias("cols"), F.bool_or("unit").alias("unit"), F.bool_or("numbers").alias("numbers"), listed.alias("_rows"))
    merged = merged.withColumn("placed", F.flatten("_rows.placed"))

    label = stacked(F.transform(F.filter("placed", lambda c: c["first"].isNull()), lambda c: c["text"]))
    in_column = lambda k: F.transform(F.filter("placed", lambda c: (c["first"] == k) & (c["last"] == k)), lambda c: c["text"])
    texts = F.when(F.col("band") | F.col("numbers"), F.transform(_places(F.size("cols")), lambda k: stacked(in_column(k)))).otherwise(F.array().cast("array<string>"))
    merged = merged.withColumn("label", label).withColumn("texts", texts)
    kind = F.when(F.col("band"), "header").when(F.col("numbers"), F.when((F.col("label") == "") | F.col("label").rlike(TOTAL_LINE), "total").otherwise("data"))
    kind = kind.when(F.col("label").rlike(SECTION_LINE), "section").otherwise("text")
    none, no_spans = F.array().cast("array<string>"), F.array().cast("array<struct<span:int,text:string>>")
    out = lambda step, kind, label, cells, spans: F.struct(step.alias("step"), kind.alias("kind"), label.alias("label"), cells.alias("cells"), spans.alias("spans")).cast(_ROW)
    groups = F.filter(F.transform("_rows", lambda r: F.filter(r["placed"], lambda c: c["last"] > c["first"])), lambda g: F.size(g) > 0)
    nothing = F.array().cast(f"array<{_ROW}>")
    parts = [
        F.when(F.col("unit") & (F.size("cols") > 0), F.array(out(F.lit(-1), F.lit("unit"), F.lit(UNIT_LABEL), none, no_spans))).otherwise(nothing),
        F.when(F.col("band"), F.transform(groups, lambda g, i: out(i, F.lit("group"), F.lit(""), none, group_spans(F.array_sort(g), F.col("cols"))))).otherwise(nothing),
        F.when(F.size("placed") > 0, F.array(out(F.size("_rows"), kind, F.col("label"), F.col("texts"), no_spans))).otherwise(nothing),
    ]
    made = merged.select(*table, "row", F.size("cols").alias("width"), F.inline(F.concat(*parts)))
    ordered = made.groupBy(*table).agg(F.first("width").alias("width"), F.array_sort(F.collect_list(F.struct("row", "step", "kind", "label", "cells", "spans"))).alias("rows"))
    ordered = ordered.withColumn("heads", _run_on(F.col("rows"), F.col("width") == 0)).withColumn("notes_col", notes_column(F.col("rows"), F.col("width")))
    each = ordered.select(*table, "notes_col", F.inline(F.arrays_zip(F.col("heads").alias("head"), F.col("rows").alias("r")))).withColumn("n", F.struct("r.row", "r.step"))
    held = each.groupBy(*table, "notes_col", "head").agg(F.min_by("r", "n").alias("r"), F.array_sort(F.collect_list(F.struct("n", "r.label"))).alias("labels"))
    place = F.row_number().over(Window.partitionBy(*table).orderBy("head")).cast("long")
    return held.select(*table, place.alias("place"), "r.kind", stacked(F.col("labels.label")).alias("label"), "r.cells", "r.spans", "notes_col")
