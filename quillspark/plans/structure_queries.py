"""Queries of report structure, selection by composition, versions and quality."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import retrieval as rt
from ..operators import structure as st
from ..operators import tables as tb
from ..sources import report_views as rv
from ..sources import scans
from ..sources.report_views import with_views
from .registry import query, table


@query("s1_report_files")
def s1(spark, d):
    return scans.report_files(spark, d, "*.parquet").select("name", "size")


@query("s9_optional_table", "SELECT source AS report, count(*) AS documents, CAST(0 AS BIGINT) AS checks FROM documents GROUP BY source")
def s9(spark, d):
    """Reports beside a table that stores of an older version lack: it reads as empty."""
    checks = scans.package_table(spark, f"{d}/no-such-store", "checks").groupBy(F.col("report_id").alias("report")).agg(F.count("*").alias("checks"))
    return table(spark, d, "documents").groupBy(F.col("source").alias("report")).agg(F.count("*").alias("documents")).join(checks, "report", "left").select("report", "documents", F.coalesce("checks", F.lit(0).cast("long")).alias("checks"))


@query("s13_import_check", "SELECT doc_id, CASE WHEN doc_id % 5 = 2 OR doc_id % 5 = 3 THEN 'not a package' WHEN doc_id % 3 = 0 THEN 'another version' WHEN doc_id % 4 = 1 THEN 'no report' END AS problem FROM documents")
def s13(spark, d):
    """Packages that may be imported: the head of the file, a known version, and a report's hash of 64 hex digits."""
    sha = F.when(F.col("doc_id") % 4 == 1, F.lit("short")).otherwise(F.sha2("text", 256))
    version = F.when(F.col("doc_id") % 3 == 0, "2.0").otherwise("1.2")
    head = F.when(F.col("doc_id") % 5 == 2, F.lit("PK zip").cast("binary")).when(F.col("doc_id") % 5 != 3, F.concat(F.unhex(F.lit(scans.PACKAGE_HEAD)), F.col("text").cast("binary")))
    return table(spark, d, "documents").select("doc_id", scans.import_problem(head, version, sha).alias("problem"))


@query("s19_spans_in_range", "SELECT user_id AS page, string_agg(event_id::VARCHAR, ' ' ORDER BY value, event_id) AS spans FROM events WHERE value BETWEEN 5 AND 15 GROUP BY user_id")
def s19(spark, d):
    own = table(spark, d, "events").where(F.col("value").between(5, 15))
    return own.groupBy(F.col("user_id").alias("page")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("value", "event_id"))), lambda x: x["event_id"].cast("string")), " ").alias("spans"))


@query("s22_manifest", "SELECT 'f' || o_orderkey AS name, CASE WHEN o_orderkey % 6 = 0 OR o_orderkey % 7 = 0 OR o_orderkey % 5 = 0 OR o_orderstatus = 'P' THEN 0 ELSE o_custkey END AS done FROM orders")
def s22(spark, d):
    """A manifest counts only for the size, time and prompt version it was made for; a new file has none."""
    own = table(spark, d, "orders").select(F.concat(F.lit("f"), F.col("o_orderkey").cast("string")).alias("name"), "o_orderkey", "o_custkey", "o_orderstatus", F.col("o_orderkey").alias("size"), F.unix_date(F.col("o_orderdate").cast("date")).alias("mtime"))
    manifest = own.where("o_orderstatus != 'P'").select("name", (F.col("size") + (F.col("o_orderkey") % 6 == 0).cast("long")).alias("size"), (F.col("mtime") + (F.col("o_orderkey") % 7 == 0).cast("int")).alias("mtime"), F.when(F.col("o_orderkey") % 5 == 0, 1).otherwise(2).alias("prompt_version"), F.col("o_custkey").alias("done"))
    return scans.current_manifest(manifest, own.select("name", "size", "mtime"), 2).select("name", "done")


@query("p15_validation", "SELECT o_orderkey, CASE WHEN o_orderkey % 50 = 0 THEN 'page must be 1 or more' WHEN o_orderkey % 50 > 40 THEN 'report has 40 pages' END AS problem FROM orders")
def p15(spark, d):
    page = F.col("o_orderkey") % 50
    return table(spark, d, "orders").select("o_orderkey", F.when(page < 1, "page must be 1 or more").when(page > 40, "report has 40 pages").alias("problem"))


@query("p19_statement_sections", "SELECT c.conv_id, coalesce(s.section, 'consolidated') AS section FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN (SELECT DISTINCT conv_id, CASE WHEN turn % 2 = 0 THEN 'consolidated' ELSE 'standalone' END AS section FROM conversations WHERE role = 'system') s USING (conv_id)")
def p19(spark, d):
    turns = table(spark, d, "conversations")
    named = turns.where("role = 'system'").select("conv_id", F.when(F.col("turn") % 2 == 0, "consolidated").otherwise("standalone").alias("section")).distinct()
    return turns.select("conv_id").distinct().join(named, "conv_id", "left").select("conv_id", F.coalesce("section", F.lit("consolidated")).alias("section"))


@query("a12_quality_report", """SELECT report, docs, languages, share, concat_ws(',', CASE WHEN docs < 50 THEN 'few' END, CASE WHEN share > 0.05 THEN 'loud' END) AS warnings FROM (SELECT source AS report, count(*) AS docs, count(DISTINCT lang) AS languages, round(avg(CASE WHEN text LIKE '%!!%' THEN 1.0 ELSE 0.0 END), 9) AS share FROM documents GROUP BY source)""")
def a12(spark, d):
    docs = table(spark, d, "documents").withColumnRenamed("source", "report")
    facts = {"docs": F.count("*"), "languages": F.countDistinct("lang"), "share": F.round(F.avg(F.col("text").contains("!!").cast("double")), 9)}
    return st.quality_facts(docs, facts, {"few": F.col("docs") < 50, "loud": F.col("share") > 0.05})


@query("k7_feature_gaps", "SELECT feature, '| ' || feature || ' | ' || coalesce(own::VARCHAR, '—') || ' | ' || coalesce(other::VARCHAR, '—') || ' |' AS line FROM (SELECT coalesce(a.event_type, b.event_type) || ':' || coalesce(a.user_id, b.user_id) AS feature, a.n AS own, b.n AS other FROM (SELECT event_type, user_id % 9 AS user_id, count(*) AS n FROM events WHERE event_id % 2 = 0 GROUP BY 1, 2) a FULL JOIN (SELECT event_type, user_id % 9 AS user_id, count(*) AS n FROM events WHERE event_id % 2 = 1 AND event_type <> 'view' GROUP BY 1, 2) b ON a.event_type = b.event_type AND a.user_id = b.user_id WHERE a.n IS DISTINCT FROM b.n)")
def k7(spark, d):
    feature = F.concat("event_type", F.lit(":"), (F.col("user_id") % 9).cast("string")).alias("feature")
    count = lambda cond: table(spark, d, "events").where(cond).groupBy(feature).agg(F.count("*").alias("value"))
    return st.gap_lines(st.feature_gaps(count("event_id % 2 = 0"), count("event_id % 2 = 1 and event_type != 'view'")))


@query("m4_registry", "SELECT vec_id, label, CASE WHEN label % 2 = 0 THEN 2 ELSE 1 END AS version FROM embeddings")
def m4(spark, d):
    """A registry after an update: the newest version of each model."""
    old = table(spark, d, "embeddings").select("vec_id", "label", F.lit(1).alias("version"))
    new = old.where("label % 2 = 0").withColumn("version", F.lit(2))
    return old.unionByName(new).groupBy("vec_id").agg(F.max_by(F.struct("label", "version"), "version").alias("s")).select("vec_id", "s.*")


@query("m6_narrative_check", "SELECT source, count(*) FILTER (n_chars > 500) AS found, bool_and(length(text) = n_chars) AS covered FROM documents GROUP BY source HAVING count(*) FILTER (n_chars > 500) >= 1")
def m6(spark, d):
    held = table(spark, d, "documents").groupBy("source").agg(F.count_if(F.col("n_chars") > 500).alias("found"), F.bool_and(F.length("text") == F.col("n_chars")).alias("covered"))
    return held.where("found >= 1")


@query("d2_aligned_columns", """WITH c AS (SELECT user_id AS tbl, event_id % 10 AS row, value AS edge, event_type AS text FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_id % 10 ORDER BY event_id) AS n FROM events) WHERE n = 1),
k AS (SELECT *, sum(new) OVER (PARTITION BY tbl ORDER BY edge RANGE UNBOUNDED PRECEDING) AS col FROM (SELECT *, CASE WHEN edge - lag(edge) OVER (PARTITION BY tbl ORDER BY edge) > 3.0 THEN 1 ELSE 0 END AS new FROM c)),
w AS (SELECT tbl, max(col) AS last FROM k GROUP BY tbl)
SELECT tbl, row, string_agg(coalesce(text, ''), '|' ORDER BY p) AS cells FROM (SELECT r.tbl, r.row, p, k.text FROM (SELECT DISTINCT k.tbl, k.row, unnest(range(0, CAST(last AS BIGINT) + 1)) AS p FROM k JOIN w USING (tbl)) r LEFT JOIN k ON k.tbl = r.tbl AND k.row = r.row AND k.col = p) GROUP BY tbl, row""")
def d2(spark, d):
    from ..operators.sequences import keep_first

    cells = table(spark, d, "events").select(F.col("user_id").alias("tbl"), (F.col("event_id") % 10).alias("row"), F.col("value").alias("edge"), F.col("event_type").alias("text"), "event_id")
    held = st.aligned_table(keep_first(cells, ["tbl", "row"], F.col("event_id")).drop("event_id"), ["tbl"], 3.0)
    return held.select("tbl", "row", F.array_join("cells", "|").alias("cells"))


@query("d7_statement_pages", "SELECT user_id, event_type AS kind, min(event_id) AS start, max(event_id) AS \"end\", count(*) AS n FROM (SELECT *, event_id - row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS run FROM events WHERE event_id < user_id * 60 AND event_id >= user_id * 60 - 900) GROUP BY user_id, event_type, run")
def d7(spark, d):
    pages = table(spark, d, "events").select("user_id", F.col("event_id").alias("page"), F.col("event_type").alias("kind"), (F.col("user_id") * 60).alias("notes_page"))
    return st.statement_groups(pages, ["user_id"], 900)


@query("d8_note_index", """WITH l AS (SELECT user_id, event_id, event_type, CAST(floor(value) AS BIGINT) AS n FROM events), c AS (SELECT user_id, event_type, count(*) AS k FROM l GROUP BY 1, 2), t AS (SELECT *, max(k) OVER (PARTITION BY user_id) AS top FROM c), o AS (SELECT l.* FROM l JOIN t USING (user_id, event_type) WHERE k >= greatest(10, top * 0.6))
SELECT user_id, array_to_string(list_transform(list_reduce(a, lambda s, x: CASE WHEN len(s) = 0 OR (x[1] > s[-1] AND x[1] <= s[-1] + 4) THEN list_concat(s, x) ELSE s END, []::BIGINT[]), lambda v: CAST(v AS VARCHAR)), ',') AS accepted FROM (SELECT user_id, list([n] ORDER BY event_id) AS a FROM o GROUP BY user_id)""")
def d8(spark, d):
    from ..operators.sequences import accepted_steps

    rows = table(spark, d, "events").select("user_id", F.col("event_id").alias("seq"), F.col("event_type").alias("style"), F.floor("value").alias("number"))
    held = accepted_steps(st.dominant(rows, ["user_id"], "style", 10, 0.6), "user_id", "seq", "number", 4)
    return held.select("user_id", F.array_join(F.transform("accepted", lambda x: x.cast("string")), ",").alias("accepted"))


@query("d9_markers", with_views("v_blocks") + r"SELECT doc_id, upper(regexp_extract(text, '\b(th[a-z]{4})\b', 1)) AS marker, min(seq) AS seq FROM v_blocks WHERE regexp_matches(text, '\b(th[a-z]{4})\b') GROUP BY 1, 2")
def d9(spark, d):
    return st.markers(rv.blocks(spark, d), ["doc_id"], r"\b(th[a-z]{4})\b", "seq").select("doc_id", "marker", "seq")


@query("d10_entity_pages", "SELECT conv_id, entity, min(turn) AS first_page, max(turn) AS last_page FROM (SELECT conv_id, turn, coalesce(last_value(e IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING), first_value(e IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS entity FROM (SELECT *, CASE WHEN role = 'user' THEN substr(text, 1, 1) END AS e FROM conversations)) GROUP BY 1, 2")
def d10(spark, d):
    from ..operators.sequences import fill_both

    pages = table(spark, d, "conversations").withColumn("e", F.when(F.col("role") == "user", F.substring("text", 1, 1)))
    return pages.select("conv_id", "turn", fill_both(pages, ["conv_id"], "turn", "e").alias("entity")).groupBy("conv_id", "entity").agg(F.min("turn").alias("first_page"), F.max("turn").alias("last_page"))


@query("d11_section_map", "SELECT user_id, src AS source, event_id AS place FROM (SELECT *, min(src) OVER (PARTITION BY user_id) AS best FROM (SELECT *, CASE event_type WHEN 'error' THEN 1 WHEN 'view' THEN 2 ELSE 3 END AS src FROM events)) WHERE src = best")
def d11(spark, d):
    source = F.when(F.col("event_type") == "error", 1).when(F.col("event_type") == "view", 2).otherwise(3)
    return st.section_map(table(spark, d, "events").select("user_id", source.alias("source"), F.col("event_id").alias("place")), "user_id").select("user_id", "source", "place")


@query("d22_nested_view", with_views("v_lines") + "SELECT unit_id, count(*) AS n, string_agg(label, ';' ORDER BY seq) AS labels FROM v_lines GROUP BY unit_id")
def d22(spark, d):
    view = st.nested_view(rv.lines(spark, d), ["unit_id"], "seq", "label", "cents")
    return view.select("unit_id", F.size("lines").cast("long").alias("n"), F.array_join(F.transform("lines", lambda x: x["label"]), ";").alias("labels"))


@query("d23_statement_order", with_views("v_lines") + "SELECT id, section_id, unit_id, row_number() OVER (PARTITION BY section_id, unit_id ORDER BY seq) AS place FROM v_lines")
def d23(spark, d):
    place = F.row_number().over(Window.partitionBy("section_id", "unit_id").orderBy("seq")).cast("long")
    return rv.lines(spark, d).select("id", "section_id", "unit_id", place.alias("place"))


@query("f26_pitch_columns", "SELECT o_orderkey, array_to_string([o_orderstatus, o_orderkey::VARCHAR, o_orderpriority], '|') AS cells FROM orders")
def f26(spark, d):
    line = F.concat(F.lit("  "), "o_orderstatus", F.lit("    "), F.col("o_orderkey").cast("string"), F.lit("   "), "o_orderpriority", F.lit("  "))
    return table(spark, d, "orders").select("o_orderkey", F.array_join(st.pitch_columns(line), "|").alias("cells"))


@query("f28_labels", with_views("v_notes") + "SELECT id, CASE WHEN section_id = 'consolidated' THEN 'Consolidated' ELSE 'Standalone' END || ' Note ' || number || ' — ' || title AS label FROM v_notes")
def f28(spark, d):
    return rv.notes(spark, d).select("id", F.format_string("%s Note %d — %s", F.initcap("section_id"), F.col("number"), F.col("title")).alias("label"))


@query("q8_recheck")
def q8(spark, d):
    """The checks of transcribed tables run again over the pages that are done."""
    from ..operators.checks import tie_outs

    cells = table(spark, d, "events").where("event_type = 'view'").select((F.col("user_id")).alias("page"), F.lit(0).cast("long").alias("tbl"), F.lit(1).cast("long").alias("col"), F.col("event_id").alias("row"), F.when(F.col("event_id") % 5 == 0, "Total").otherwise("line").alias("label"), F.col("value").cast("string").alias("figure"), "value")
    return tie_outs(cells)


def _printed(spark, d):
    """Statements laid out as cells on a page: title, unit, group heading, headings, each label over two rows beside its figures, sums, signature."""
    width = 5.0
    lines = rv.lines(spark, d).withColumn("words", F.split("label", " "))
    cell = lambda row, x1, text: F.struct(row.cast("long").alias("row"), (x1 - width * F.length(text)).alias("x0"), x1.alias("x1"), text.alias("text"))
    at = lambda row, x0, text: cell(F.lit(row), F.lit(x0) + width * F.length(text), text)
    edge = lambda x: F.lit(float(x)) + F.col("seq") % 3
    top = F.col("seq") * 2 + 10
    number, price = (F.col("part_id") % rv.NOTES + 1).cast("string"), F.format_number(F.col("cents") / 100, 2)
    body = F.array(
        cell(top, F.lit(40.0) + width * F.length(F.col("words")[0]), F.col("words")[0]), cell(top, edge(300), number), cell(top, edge(380), F.col("quantity").cast("string")),
        cell(top, F.lit(400.0), F.lit("$")), cell(top, edge(460), price), cell(top, edge(540), F.col("tax").cast("string")),
        cell(top + 1, F.lit(40.0) + width * F.length(F.col("words")[1]), F.col("words")[1]),
    )
    heads = F.array(
        at(0, 40.0, F.col("title")), at(1, 400.0, F.lit("In ₹ Million")), at(2, 410.0, F.lit("Amounts of the year")), at(3, 40.0, F.lit("Particulars")),
        cell(F.lit(3), F.lit(302.0), F.lit("Notes")), cell(F.lit(3), F.lit(380.0), F.lit("Units")), cell(F.lit(3), F.lit(460.0), F.lit("Price")), cell(F.lit(3), F.lit(540.0), F.lit("Tax")),
        cell(F.col("low"), F.lit(65.0), F.lit("Total")), cell(F.col("low"), F.lit(381.0), F.col("units").cast("string")), cell(F.col("low"), F.lit(461.0), F.format_number(F.col("sum") / 100, 2)),
        cell(F.col("low") + 1, F.lit(200.0), F.lit("As per our report attached")), cell(F.col("low") + 2, F.lit(460.0), F.lit("77")),
    )
    title = F.concat(F.lit("Statement of "), F.col("order_id").cast("string")).alias("title")
    sums = lines.groupBy("order_id").agg(F.sum("quantity").alias("units"), F.sum("cents").alias("sum"), (F.max("seq") * 2 + 12).alias("low")).select("*", title)
    return lines.select("order_id", title, F.inline(body)).unionByName(sums.select("order_id", "title", F.inline(heads)))


@query("d4_statement_tables", with_views("v_lines") + """SELECT order_id, CAST(place AS BIGINT) AS place, kind, label, cells, spans, 0 AS notes_col FROM (
  SELECT order_id, seq + 3 AS place, 'data' AS kind, label, concat_ws('|', (part_id % 40 + 1)::VARCHAR, quantity::VARCHAR, format('{:,.2f}', cents / 100.0), tax::VARCHAR) AS cells, '' AS spans FROM v_lines
  UNION ALL SELECT order_id, count(*) + 4, 'total', 'Total', concat_ws('|', '', sum(quantity)::VARCHAR, format('{:,.2f}', sum(cents) / 100.0), ''), '' FROM v_lines GROUP BY order_id
  UNION ALL SELECT DISTINCT order_id, p, k, l, c, s FROM v_lines, (VALUES (1, 'unit', '₹ in Million', '', ''), (2, 'group', '', '', '2:|2:Amounts of the year'), (3, 'header', 'Particulars', 'Notes|Units|Price|Tax', '')) h(p, k, l, c, s))""")
def d4(spark, d):
    """Statements read back from where their cells stand on the page: the rows must be those that were laid out."""
    held = tb.statement_tables(_printed(spark, d), ["order_id"], "title")
    spans = F.array_join(F.transform("spans", lambda s: F.concat(s["span"].cast("string"), F.lit(":"), s["text"])), "|")
    return held.select("order_id", "place", "kind", "label", F.array_join("cells", "|").alias("cells"), spans.alias("spans"), "notes_col")
