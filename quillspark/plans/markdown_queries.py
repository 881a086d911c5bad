"""Queries of transcribed pages: documents and orders written as Markdown and read back."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import layout as ly
from ..operators import markdown as md
from ..sources import report_views as rv
from ..sources.report_views import with_views
from .registry import query


def _pages(spark, d):
    """Each document as a page: by turns a heading, two lines of text, two list items, and a table of two rows."""
    rows = rv.blocks(spark, d).where(F.col("text").rlike(r"\S"))
    t = F.regexp_replace(F.regexp_replace(F.replace("text", F.lit("|"), F.lit("/")), r"\s+", " "), "^ | $", "")
    rows = rows.select(F.col("doc_id").alias("page"), (F.row_number().over(Window.partitionBy("doc_id").orderBy("seq")) - 1).alias("k"), t.alias("t"))
    k = F.col("k") % 6
    said = (
        F.when(k == 0, F.concat(F.lit("### "), "t")).when(k == 1, F.concat(F.lit("Text "), "t")).when(k == 2, F.concat(F.lit("  Text "), "t", F.lit("\n\n"))).when(k == 3, F.concat(F.lit("- "), "t"))
        .when(k == 4, F.concat(F.lit("2) "), "t")).otherwise(F.concat(F.lit("| Said | Place |\n|---|:--:|\n| "), "t", F.lit(" | "), F.col("k").cast("string"), F.lit(" |")))
    )
    return rows.groupBy("page").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", said.alias("s")))), lambda x: x["s"]), "\n").alias("text"))


_LINES = with_views("v_blocks") + ", l AS (SELECT doc_id AS page, row_number() OVER (PARTITION BY doc_id ORDER BY seq) - 1 AS k, regexp_replace(regexp_replace(replace(text, '|', '/'), '\\s+', ' ', 'g'), '^ | $', '', 'g') AS t FROM v_blocks WHERE regexp_matches(text, '\\S'))"


@query("d13_markdown_blocks", _LINES + """, b AS (SELECT page, k // 6 * 4 + CASE WHEN k % 6 = 0 THEN 0 WHEN k % 6 <= 2 THEN 1 WHEN k % 6 <= 4 THEN 2 ELSE 3 END AS place, k, t FROM l)
SELECT page, place, CASE place % 4 WHEN 0 THEN 'heading' WHEN 1 THEN 'paragraph' WHEN 2 THEN 'list' ELSE 'table' END AS kind, CASE place % 4 WHEN 0 THEN 2 END AS level,
  CASE place % 4 WHEN 1 THEN string_agg('Text ' || t, ' ' ORDER BY k) WHEN 2 THEN string_agg(t, ' / ' ORDER BY k) WHEN 3 THEN 'Said|Place' || chr(10) || any_value(t) || '|' || any_value(k) ELSE any_value(t) END AS said FROM b GROUP BY page, place""")
def markdown_blocks(spark, d):
    """Blocks of transcribed pages in order."""
    found = md.blocks(_pages(spark, d))
    line = lambda rows: F.transform(rows, lambda r: F.array_join(r, "|"))
    said = F.when(F.col("kind") == "list", F.array_join("items", " / ")).when(F.col("kind") == "table", F.array_join(F.concat(line("head"), line("rows")), "\n")).otherwise(F.col("text"))
    return found.select("page", "place", "kind", "level", said.alias("said"))


@query("d13_markdown_coverage", "SELECT doc_id AS page, true AS covered FROM documents WHERE regexp_matches(text, '\\S')")
def markdown_coverage(spark, d):
    """The blocks of a transcribed page hold its characters, no more and no less."""
    pages = _pages(spark, d)
    return ly.coverage(md.plain_lines(pages), md.blocks(pages))


@query("d5_markdown_rows", with_views("v_lines") + """SELECT page, row, kind, label, cells, 0 AS notes_col FROM (
  SELECT order_id AS page, seq + 1 AS row, 'data' AS kind, label, concat_ws('|', (part_id % 40 + 1)::VARCHAR, quantity::VARCHAR, format('{:,.2f}', cents / 100.0)) AS cells FROM v_lines
  UNION ALL SELECT order_id, count(*) + 2, 'total', 'Total', concat_ws('|', '', sum(quantity)::VARCHAR, format('{:,.2f}', sum(cents) / 100.0)) FROM v_lines GROUP BY order_id
  UNION ALL SELECT DISTINCT order_id, r, k, l, c FROM v_lines, (VALUES (0, 'header', 'Item', 'Notes|Units|Price'), (1, 'section', 'Goods:', '')) h(r, k, l, c))""")
def markdown_rows(spark, d):
    """Orders as Markdown tables read back as rows: header, section, data and total, and the notes column."""
    own = rv.lines(spark, d)
    row = lambda *c: F.concat(F.lit("| "), F.concat_ws(" | ", *c), F.lit(" |"))
    body = F.transform(F.array_sort(F.collect_list(F.struct("seq", row("label", (F.col("part_id") % 40 + 1).cast("string"), F.col("quantity").cast("string"), F.format_number(F.col("cents") / 100, 2)).alias("s")))), lambda x: x["s"])
    total = row(F.lit("**Total**"), F.lit(""), F.concat(F.lit("**"), F.sum("quantity").cast("string"), F.lit("**")), F.concat(F.lit("**"), F.format_number(F.sum("cents") / 100, 2), F.lit("**")))
    text = F.concat(F.lit("# Statement\n\n| Item | Notes | Units | Price |\n|---|---|---:|---:|\n| **Goods:** | | | |\n"), F.array_join(body, "\n"), F.lit("\n"), total, F.lit("\n\nSigned by the board"))
    pages = own.groupBy(F.col("order_id").alias("page")).agg(text.alias("text"))
    return md.table_rows(md.blocks(pages)).select("page", "row", "kind", "label", F.array_join("cells", "|").alias("cells"), "notes_col")
