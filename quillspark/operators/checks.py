"""Reconciliation: subtotals, balances, carried figures, note ties, and their summaries."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import figures as fig
from . import links


# The two totals of a balance sheet.
TOTAL_ASSETS = r"(?i)^total\s+assets$"
TOTAL_CLAIMS = r"(?i)^total\s+(?:equity\s+and\s+liabilities|liabilities\s+and\s+(?:shareholders|stockholders)?['’]?\s*equity)$"


def subtotals(rows: DataFrame) -> DataFrame:
    """(statement, seq, n_lines, status) of each total: it equals the lines since the total before it, else those since the heading.

    Takes rows (statement, seq, kind 'data', 'total' or 'heading', values map<int,double>, raws map<int,string>). A total that holds
    stands for its lines in the totals further down, so a table is read row by row: rows are dealt by statement and sorted, and a
    task keeps two sums a column. A total below fewer than two lines is not judged.
    """
    dealt = rows.select("statement", F.col("seq").cast("long").alias("seq"), "kind", F.map_entries("values").alias("cells"), F.map_entries("raws").alias("printed"))
    dealt = dealt.repartition("statement").sortWithinPartitions("statement", "seq")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, block, since = None, _Sum(), _Sum()
        for batch in batches:
            out = []
            for statement, seq, kind, cells, printed in zip(*(batch.column(c).to_pylist() for c in ("statement", "seq", "kind", "cells", "printed")), strict=True):
                if statement != now or kind not in ("data", "total"):
                    now, block, since = statement, _Sum(), _Sum()
                if kind not in ("data", "total"):
                    continue
                values = {c["key"]: c["value"] for c in cells or [] if c["value"] is not None}
                if kind == "data":
                    block.add(values)
                    since.add(values)
                    continue
                raws = {c["key"]: c["value"] for c in printed or []}
                held = next((x for x in (block, since) if x.lines >= 2 and x.equals(values, raws)), None)
                if values and since.lines >= 2:
                    out.append((statement, seq, held.lines if held else None, "ok" if held else "unverified"))
                if held:
                    since.take(held)
                since.add(values)
                block = _Sum()
            yield pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], t) for k, t in enumerate((batch.schema.field("statement").type, pa.int64(), pa.int64(), pa.string()))], names=["statement", "seq", "n_lines", "status"])

    return dealt.mapInArrow(run, f"statement {rows.schema['statement'].dataType.simpleString()}, seq long, n_lines long, status string")


class _Sum:
    """Sums by column of some lines."""

    def __init__(self):
        self.lines, self.sums = 0, {}

    def add(self, values: dict) -> None:
        self.lines += 1
        for col, v in values.items():
            self.sums[col] = self.sums.get(col, 0.0) + v

    def take(self, other: _Sum) -> None:
        for col, v in list(other.sums.items()):
            self.sums[col] -= v
        self.lines -= other.lines

    def equals(self, values: dict, raws: dict) -> bool:
        """Every column of a total, give or take one in its last printed digit."""
        near = lambda col, v: abs(self.sums[col] - v) <= 10.0 ** -len((raws.get(col) or "").partition(".")[2]) + 1e-9
        return bool(values) and all(col in self.sums and near(col, v) for col, v in values.items())


def balance_sides(cells: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The cells of lines labelled total assets, and of those labelled total equity and liabilities. Takes a column label."""
    return cells.where(F.trim("label").rlike(TOTAL_ASSETS)), cells.where(F.trim("label").rlike(TOTAL_CLAIMS))


def balances(assets: DataFrame, claims: DataFrame) -> DataFrame:
    """(unit_id, col, status): total assets against the first total of equity and liabilities of the statement, by column.

    Takes (unit_id, line_id, seq, col, value, raw) twice.
    """
    first = claims.groupBy(F.col("unit_id").alias("first_unit")).agg(F.min_by("line_id", "seq").alias("other"))
    held = claims.withColumnRenamed("line_id", "claim_id").join(first, (F.col("unit_id") == F.col("first_unit")) & (F.col("claim_id") == F.col("other")))
    other = held.select("unit_id", "col", F.col("value").alias("claimed"), F.col("raw").alias("claimed_raw"))
    found = assets.where("value is not null").join(other.where("claimed is not null"), ["unit_id", "col"])
    ok = fig.close(F.col("value"), F.col("claimed"), F.col("claimed_raw"))
    return found.select("unit_id", "line_id", "col", F.when(ok, "ok").otherwise("fail").alias("status"))


def note_ties(asked: DataFrame, note_figures: DataFrame) -> DataFrame:
    """(src, dst, status): whether a note that a line cites prints one of the line's distinctive figures.

    Takes (src, dst, section_id, key): the references of lines with each of their amounts. A line that ties to a cited note is ok
    by this too: a tie is one of these amounts, printed in that note.
    """
    printed = links.printed_amounts(note_figures).withColumnRenamed("note_id", "dst").withColumn("there", F.lit(1))
    hit = asked.join(printed, ["section_id", "dst", "key"], "left")
    return hit.groupBy("src", "dst").agg(F.when(F.max("there") == 1, "ok").otherwise("warn").alias("status"))


def kind_status(checks: DataFrame) -> DataFrame:
    """Counts by kind and status with subtotals and the grand total."""
    return checks.rollup("kind", "status").agg(F.count("*").alias("n"))


def link_summary(lines: DataFrame, edges: DataFrame) -> DataFrame:
    """lines, linked lines, and lines by method, in one row."""
    linked = edges.where(F.col("kind").isin("references", "ties_to", "mentions"))
    methods = (("notes column", "by_notes_column"), ("label", "by_label"), ("figure match", "by_figure_match"), ("title match", "by_title_match"))
    per = linked.where("src is not null").groupBy("src").agg(*[F.max(F.when(F.col("method") == m, 1)).alias(a) for m, a in methods])
    counts = per.agg(F.count("*").alias("linked"), *[F.count(a).alias(a) for _, a in methods])
    # One row each side, so a cross join of two aggregates.
    return lines.agg(F.count("*").alias("lines")).crossJoin(counts)


def acceptance(reports: DataFrame, least_notes: int, least_statements: int, readable: float) -> DataFrame:
    """All gates of a report at once: (report, each gate, accepted). Takes (report, notes, statements, readable_share)."""
    gates = reports.select("report", (F.col("notes") >= least_notes).alias("enough_notes"), (F.col("statements") >= least_statements).alias("enough_statements"), (F.col("readable_share") >= readable).alias("readable"))
    return gates.withColumn("accepted", F.col("enough_notes") & F.col("enough_statements") & F.col("readable"))


# A total's label, the most figures of a sum, and how far a sum may be off.
TOTAL_LABEL, LONGEST_SUM, NEAR = r"(?i)^\s*total\b", 20, 0.5

_TIED = "array<struct<row:bigint,figure:string,status:string,parts:array<string>>>"


def tie_outs(cells: DataFrame) -> DataFrame:
    """(page, tbl, col, row, figure, status, parts): totals that equal figures above them, and the digits of all that took part.

    A row ties if it is the sum of the shortest run of 2 to ``LONGEST_SUM`` figures above it in its column, or the difference of the
    last two; it then stands for them further down. A column is a fold: its figures so far and their running sums, so that the sum of
    a run is the difference of two of them. A total may also be the sum or difference of the last two figures of the rows above,
    whatever their columns: those come from a window over rows. A total that ties in no way is untied, or unchecked if a figure above
    is unreadable. Takes (page, tbl, col, row, label, figure, value).
    """
    label = F.trim(F.replace(F.coalesce("label", F.lit("")), F.lit("*"), F.lit("")))
    cells = cells.select("page", "tbl", "col", F.col("row").cast("long").alias("row"), label.alias("label"), F.coalesce("figure", F.lit("")).alias("figure"), "value")
    down = Window.partitionBy("page", "tbl").orderBy("row")
    pair = F.transform(F.array_sort(F.collect_list(F.struct("col", "figure", "value"))), lambda x: F.struct(x["figure"].alias("figure"), x["value"].alias("value")))
    rows = cells.where("value is not null").groupBy("page", "tbl", "row").agg(pair.alias("own"), F.min_by("label", "col").alias("first"))
    rows = rows.withColumn("last", F.try_element_at("own", F.lit(-1))).withColumn("next", F.try_element_at("own", F.lit(-2)))
    one, other = F.lag("last").over(down), F.coalesce(F.lag("next").over(down), F.lag("last", 2).over(down))
    rows = rows.withColumns({"a": other, "b": one}).select("page", "tbl", "row", F.when(_is_total(F.col("first")), F.col("a")).alias("a"), F.when(_is_total(F.col("first")), F.col("b")).alias("b"))
    item = F.struct("row", "label", "figure", "value", "a", "b")
    columns = cells.join(rows, ["page", "tbl", "row"], "left").groupBy("page", "tbl", "col").agg(F.array_sort(F.collect_list(item)).alias("s"))
    digits = lambda figure: F.regexp_replace(figure, "[^0-9]", "")
    near = lambda total, value: F.coalesce(F.abs(total - value) < NEAR, F.lit(False))

    def step(state: Column, x: Column) -> Column:
        figures, sums, n, value = state["figures"], state["sums"], F.size(state["figures"]), x["value"]
        upto = lambda k: F.get(sums, n - k)  # noqa: E731  running sum without the last k
        runs = F.when(n >= 2, F.sequence(F.lit(2), F.least(n, F.lit(LONGEST_SUM)))).otherwise(F.array().cast("array<int>"))
        shortest = F.get(F.filter(runs, lambda k: near(upto(F.lit(0)) - upto(k), value)), F.lit(0))
        used = F.coalesce(shortest, F.when((n >= 2) & near(2 * upto(F.lit(1)) - upto(F.lit(2)) - upto(F.lit(0)), value), F.lit(2)), F.lit(0))
        across = near(x["a"]["value"] - x["b"]["value"], value) | near(x["a"]["value"] + x["b"]["value"], value)
        parts = F.when(used > 0, F.slice(figures, n - used + 1, used)).when(across, F.array(x["a"]["figure"], x["b"]["figure"]))
        status = F.when(parts.isNotNull(), "tied").when((n >= 2) & _is_total(x["label"]), F.when(state["unknown"], "unchecked").otherwise("untied"))
        said = F.struct(x["row"].alias("row"), x["figure"].alias("figure"), status.alias("status"), F.coalesce(F.array_sort(F.array_distinct(F.transform(F.concat(parts, F.array(x["figure"])), digits))), F.array().cast("array<string>")).alias("parts"))
        read = F.struct(
            F.concat(F.slice(figures, 1, n - used), F.array(x["figure"])).alias("figures"), F.concat(F.slice(sums, 1, n - used + 1), F.array(F.get(sums, n - used) + value)).alias("sums"),
            (state["unknown"] & parts.isNull()).alias("unknown"), F.when(status.isNotNull(), F.concat(state["out"], F.array(said))).otherwise(state["out"]).alias("out"),
        )
        blank = F.struct(figures.alias("figures"), sums.alias("sums"), (state["unknown"] | F.contains(x["figure"], F.lit("[?]"))).alias("unknown"), state["out"].alias("out"))
        return F.when(value.isNull(), blank).otherwise(read)

    start = F.struct(F.array().cast("array<string>").alias("figures"), F.array(F.lit(0.0)).alias("sums"), F.lit(False).alias("unknown"), F.array().cast(_TIED).alias("out"))
    found = columns.select("page", "tbl", "col", F.inline(F.aggregate("s", start, step, lambda state: state["out"])))
    return found.select("page", "tbl", "col", "row", "figure", "status", "parts")


def _is_total(label: Column) -> Column:
    return (label == "") | label.rlike(TOTAL_LABEL)


def confirmed(ties: DataFrame) -> DataFrame:
    """(page, figure): the digits of every figure that took part in a tie of its page."""
    return ties.where("status = 'tied'").select("page", F.explode("parts").alias("figure")).distinct()
