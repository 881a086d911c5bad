"""Queries of scans, sinks, predicates, text functions and page structure."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import figures as fig
from ..functions import text as tx
from ..operators import checks, grouped, layout
from ..operators import passages as ps
from ..operators import structure as st
from ..operators.sequences import numbered
from ..sources import report_views as rv
from ..sources import scans, sinks
from ..sources.report_views import with_views
from ..sources.store import scratch
from .registry import query, small, table


@query("s2_natural_order", "SELECT p_partkey, 'TYPE-' || p_size || ' ' || p_brand AS name, row_number() OVER (ORDER BY p_size, CAST(regexp_extract(p_brand, '[0-9]+') AS BIGINT), p_partkey) AS place FROM part")
def s2(spark, d):
    """Names in natural order: the number inside a name is compared as a number. Ranges of it are numbered apart."""
    name = F.concat(F.lit("TYPE-"), F.col("p_size").cast("string"), F.lit(" "), "p_brand")
    rows = table(spark, d, "part").select("p_partkey", "p_size", name.alias("name")).withColumn("key", tx.natural_key(F.col("name")))
    return numbered(rows, "p_size", "key", "p_partkey").select("p_partkey", "name", "place")


@query("s4_segments", "SELECT user_id, seg, min(event_id) AS first, max(event_id) AS last, count(*) AS n FROM (SELECT *, sum(b) OVER (PARTITION BY user_id ORDER BY event_id) AS seg FROM (SELECT *, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY event_id) > 43200000000 THEN 1 ELSE 0 END AS b FROM events)) GROUP BY user_id, seg")
def s4(spark, d):
    order = Window.partitionBy("user_id").orderBy("event_id")
    b = F.when(F.unix_micros("ts") - F.lag(F.unix_micros("ts")).over(order) > 43_200_000_000, 1).otherwise(0)
    events = table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp")).withColumn("b", b)
    cut = events.withColumn("seg", F.sum("b").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return cut.groupBy("user_id", "seg").agg(F.min("event_id").alias("first"), F.max("event_id").alias("last"), F.count("*").alias("n"))


@query("s5_point_lookup", "SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders WHERE o_orderkey = 4711")
def s5(spark, d):
    return table(spark, d, "orders").where("o_orderkey = 4711").select("o_orderkey", "o_orderstatus", "o_totalprice")


@query("s6_table_scan", with_views("v_lines") + "SELECT id, label FROM v_lines WHERE unit_id = 'O7' OR pdf_page BETWEEN 10 AND 12")
def s6(spark, d):
    return rv.lines(spark, d).where("unit_id = 'O7' OR pdf_page BETWEEN 10 AND 12").select("id", "label")


@query("s7_read_only_sql", "SELECT o_orderstatus AS status, count(*) AS n FROM orders WHERE o_totalprice > 250000.0 GROUP BY o_orderstatus")
def s7(spark, d):
    return scans.read_only_query(spark, "SELECT o_orderstatus AS status, count(*) AS n FROM package_orders WHERE o_totalprice > ? GROUP BY o_orderstatus", [250000.0], package_orders=table(spark, d, "orders"))


@query("s8_rebuild_index", "SELECT n_name AS section, count(*) AS units, string_agg(c_custkey::VARCHAR, ',' ORDER BY c_custkey) AS ids FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name")
def s8(spark, d):
    units = table(spark, d, "customer").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    held = units.groupBy(F.col("n_name").alias("section")).agg(F.array_sort(F.collect_list(F.struct("c_custkey", "c_name"))).alias("units"))
    return held.select("section", F.size("units").cast("long").alias("units"), F.array_join(F.transform("units", lambda u: u["c_custkey"].cast("string")), ",").alias("ids"))


@query("s10_done_pages", "SELECT page_id, length(html) AS chars FROM pages WHERE url LIKE 'https%' AND page_id IN (SELECT event_id FROM events WHERE event_type = 'view')")
def s10(spark, d):
    done = table(spark, d, "events").where("event_type = 'view'").select(F.col("event_id").alias("page_id"))
    return table(spark, d, "pages").where("url like 'https%'").join(done, "page_id", "left_semi").select("page_id", F.length("html").cast("long").alias("chars"))


@query("s11_hash_lookup", "SELECT min(doc_id) AS doc_id, count(*) AS copies, sha256(text) AS digest FROM documents GROUP BY sha256(text) HAVING count(*) > 1")
def s11(spark, d):
    return table(spark, d, "documents").groupBy(F.sha2("text", 256).alias("digest")).agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies")).where("copies > 1")


@query("s12_page_spec", "SELECT o_orderkey, CASE WHEN o_orderkey % 11 > 1 THEN array_to_string(list_sort(list_distinct(list_concat(range(o_orderkey % 90 + 1, o_orderkey % 90 + 4), [o_orderkey % 7 + 1]))), ',') END AS pages FROM orders")
def s12(spark, d):
    a = F.col("o_orderkey") % 90 + 1
    spec = F.concat(a.cast("string"), F.lit("-"), (a + 2).cast("string"), F.lit(", "), (F.col("o_orderkey") % 7 + 1).cast("string"), F.when(F.col("o_orderkey") % 11 == 0, ", 5-300").when(F.col("o_orderkey") % 11 == 1, ", x").otherwise(" "))
    return table(spark, d, "orders").select("o_orderkey", F.array_join(F.transform(scans.page_spec_column(spec), lambda x: x.cast("string")), ",").alias("pages"))


@query("s14_history_newest", "SELECT o_orderkey AS sno, strftime(o_orderdate, '%Y-%m-%d') AS asked_at, o_orderstatus AS report, 'What of ' || o_custkey || '?' || chr(10) || chr(10) || 'Kind: none' AS question FROM orders ORDER BY o_orderkey DESC LIMIT 100")
def s14(spark, d):
    """The hundred newest entries of a history, their headers read."""
    text = F.concat(F.lit("Asked at: "), F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit("\nno header\nReport: "), "o_orderstatus", F.lit("\n\nWhat of "), F.col("o_custkey").cast("string"), F.lit("?\n\nKind: none"))
    newest = table(spark, d, "orders").select(F.col("o_orderkey").alias("sno"), scans.history_entry(text).alias("e")).orderBy(F.desc("sno")).limit(100)
    return newest.select("sno", F.try_element_at("e.meta", F.lit("Asked at")).alias("asked_at"), F.try_element_at("e.meta", F.lit("Report")).alias("report"), "e.question")


@query("s15_open_feedback", "SELECT user_id, event_id, event_type FROM (SELECT user_id, max(event_id) AS event_id, arg_max(event_type, event_id) AS event_type FROM events GROUP BY user_id) WHERE event_type <> 'view'")
def s15(spark, d):
    """Feedback whose last state is not the closed one, newest first."""
    state = sinks.latest_state(table(spark, d, "events").withColumn("at", F.col("event_id")), "user_id", "at", "event_id", "event_type")
    return state.where("event_type != 'view'").orderBy(F.desc("event_id"))


@query("s16_prefix_lookup", "SELECT 'model-' || s_suppkey % 10 || CASE WHEN s_suppkey < 10 THEN '' ELSE '-' || s_suppkey END AS id, s_acctbal >= 0 AS supported FROM supplier WHERE s_suppkey % 10 = 3 OR s_name = 'Supplier#000000005'")
def s16(spark, d):
    """Models of a registry by id, by the beginning of an id, or by hash."""
    tail = F.when(F.col("s_suppkey") < 10, "").otherwise(F.concat(F.lit("-"), F.col("s_suppkey").cast("string")))
    registry = table(spark, d, "supplier").select(F.concat(F.lit("model-"), (F.col("s_suppkey") % 10).cast("string"), tail).alias("id"), F.col("s_name").alias("sha256"), (F.col("s_acctbal") < 0).alias("pending"))
    return scans.find_models(registry, "model-3").unionByName(scans.find_models(registry, "Supplier#000000005")).select("id", "supported")


@query("s17_units_in_order", "SELECT c_nationkey, c_custkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS seq FROM customer")
def s17(spark, d):
    return table(spark, d, "customer").select("c_nationkey", "c_custkey", F.row_number().over(Window.partitionBy("c_nationkey").orderBy("c_custkey")).cast("long").alias("seq"))


@query("s20_next_number", "SELECT max(o_orderkey) + 1 AS sno FROM orders")
def s20(spark, d):
    return table(spark, d, "orders").agg((F.max("o_orderkey") + 1).alias("sno"))


@query("s21_thread", "SELECT conv_id, turn, role, length(text) AS chars FROM conversations WHERE conv_id = 7")
def s21(spark, d):
    return table(spark, d, "conversations").where("conv_id = 7").select("conv_id", "turn", "role", F.length("text").cast("long").alias("chars"))


@query("k2_flatten_index", "SELECT l_orderkey AS section_id, l_partkey AS id, row_number() OVER (ORDER BY l_orderkey, l_partkey, l_suppkey, l_linenumber) AS \"order\" FROM lineitem")
def k2(spark, d):
    units = F.array_sort(F.collect_list(F.struct(F.col("l_partkey").alias("id"), "l_suppkey", "l_linenumber"))).alias("units")
    nested = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(units).withColumn("seq", F.col("id"))
    return sinks.flatten_index(nested).select("section_id", "id", F.col("order").cast("long").alias("order"))


@query("k4_upsert", "SELECT c_custkey, CASE WHEN c_custkey % 10 = 0 THEN 'NEW' ELSE c_mktsegment END AS segment FROM customer")
def k4(spark, d):
    now = table(spark, d, "customer").select("c_custkey", F.col("c_mktsegment").alias("segment"))
    return sinks.upsert(now, now.where("c_custkey % 10 = 0").withColumn("segment", F.lit("NEW")), "c_custkey")


@query("k6_latest_state", "SELECT user_id, arg_max(event_type, event_id) AS event_type, arg_max(value, event_id) AS value FROM events GROUP BY user_id")
def k6(spark, d):
    return sinks.latest_state(table(spark, d, "events"), "user_id", "event_id", "event_type", "value")


@query("k6_unique_names", "SELECT event_id, event_type || '-' || user_id || CASE WHEN n > 1 THEN '-' || n ELSE '' END AS name FROM (SELECT *, row_number() OVER (PARTITION BY event_type, user_id ORDER BY event_id) AS n FROM events)")
def k6n(spark, d):
    rows = table(spark, d, "events").select(F.col("event_id").alias("id"), "event_type", F.col("user_id").cast("string").alias("second"))
    return sinks.unique_names(rows, "event_type", "second").select(F.col("id").alias("event_id"), "name")


@query("p1_scanned", with_views("v_blocks") + "SELECT doc_id, count(*) FILTER (length(trim(text)) > 80) < greatest(1, count(*) * 0.1) AS scanned FROM v_blocks GROUP BY doc_id")
def p1(spark, d):
    return rv.blocks(spark, d).groupBy("doc_id").agg((F.count_if(F.length(F.trim("text")) > 80) < F.greatest(F.lit(1), F.count("*") * 0.1)).alias("scanned"))


@query("p2_no_text", with_views("v_blocks") + "SELECT doc_id FROM v_blocks GROUP BY doc_id HAVING count(*) FILTER (length(text) > 200) < greatest(1, count(*) // 10)")
def p2(spark, d):
    held = rv.blocks(spark, d).groupBy("doc_id").agg(F.count_if(F.length("text") > 200).alias("n"), F.floor(F.count("*") / 10).alias("least"))
    return held.where("n < greatest(1, least)").select("doc_id")


@query("p3_figure_cells", with_views("v_values") + "SELECT line_id, col, " + ", ".join(f"regexp_matches(raw, '{p}') AS {n}" for n, p in fig.FIGURE_CELLS.items()) + " FROM v_values")
def p3(spark, d):
    return rv.values(spark, d).select("line_id", "col", *fig.figure_cells(F.col("raw")))


@query("p5_year_rows", with_views("v_lines") + "SELECT unit_id, bool_and(year BETWEEN 1900 AND 2099) AS year_row, count(DISTINCT year) AS years FROM v_lines GROUP BY unit_id")
def p5(spark, d):
    cells = rv.lines(spark, d).groupBy("unit_id").agg(F.collect_set(F.col("year").cast("string")).alias("cells"))
    return cells.select("unit_id", F.forall("cells", lambda c: c.rlike("^(?:19|20)[0-9]{2}$")).alias("year_row"), F.size("cells").cast("long").alias("years"))


_ROWS = "rows_ AS (SELECT doc_id, seq, text, seq * 10.0 AS y0, seq * 10.0 + 8 AS y1, count(*) OVER (PARTITION BY doc_id) * 10.0 AS height FROM v_blocks)"


def _rows(spark, d):
    """The lines of a document as the rows of a page."""
    n = F.count("*").over(Window.partitionBy("doc_id"))
    return rv.blocks(spark, d).select(F.col("doc_id").alias("page"), "seq", "text", F.lit(0.0).alias("x0"), (F.col("seq") * 10.0).alias("y0"), (F.col("seq") * 10.0 + 8).alias("y1"), (n * 10.0).alias("height"))


@query("p6_header_row", with_views("v_blocks") + f", {_ROWS} SELECT doc_id AS page, min(seq) AS position, arg_min(text, seq) AS text FROM rows_ WHERE seq <= 4 AND y0 <= 0.2 * height AND contains(lower(text), 'the') GROUP BY doc_id")
def p6(spark, d):
    return st.header_row(_rows(spark, d), "The").withColumn("position", F.col("position").cast("long"))


@query("p7_capitals", with_views("v_blocks") + """, f AS (SELECT doc_id, text, seq, CASE seq % 3 WHEN 0 THEN 'Courier' WHEN 1 THEN 'Arial-Bold' ELSE 'DejaVu Mono' END AS font, len(regexp_extract_all(text, '\\p{L}')) AS letters, len(regexp_extract_all(text, '\\p{Lu}')) AS caps FROM v_blocks)
SELECT doc_id, count(*) FILTER (letters >= 4 AND caps >= 0.9 * letters) AS capitals, count(*) FILTER ((seq & 16) <> 0 OR font LIKE '%Bold%') AS bold, count(*) FILTER (font <> 'Arial-Bold') >= 0.9 * count(*) AS mono FROM f GROUP BY doc_id""")
def p7(spark, d):
    """Lines in capitals and in bold, and whether a page is typewritten."""
    font = F.when(F.col("seq") % 3 == 0, "Courier").when(F.col("seq") % 3 == 1, "Arial-Bold").otherwise("DejaVu Mono")
    rows = rv.blocks(spark, d).withColumn("font", font)
    return rows.groupBy("doc_id").agg(F.count_if(st.is_capitals(F.col("text"))).alias("capitals"), F.count_if(st.is_bold(F.col("seq"), F.col("font"))).alias("bold"), st.is_monospaced(F.col("font")).alias("mono"))


@query("p8_repeated_bands", with_views("v_blocks") + """, b AS (SELECT *, lower(trim(text)) AS k FROM (SELECT *, seq <= 1 AS top, seq >= max(seq) OVER (PARTITION BY doc_id) - 1 AS bottom FROM v_blocks) WHERE length(trim(text)) BETWEEN 1 AND 120),
n AS (SELECT k, count(DISTINCT doc_id) FILTER (top) AS tops, count(DISTINCT doc_id) FILTER (bottom) AS bottoms FROM b GROUP BY k), pages AS (SELECT count(DISTINCT doc_id) AS pages FROM b)
SELECT doc_id, seq, CASE WHEN top AND length(text) >= 3 AND (tops >= greatest(3, 0.3 * pages) OR (length(text) <= 80 AND tops >= 2)) THEN 'header'
  WHEN bottom AND (bottoms >= 3 OR regexp_matches(text, '(?i)^(?:page\\s+)?(?:[A-Z]-)?[0-9]{1,3}$')) THEN 'footer' ELSE 'body' END AS band FROM b JOIN n USING (k), pages""")
def p8(spark, d):
    """Running headers and footers: a short line at the top of two pages, any at the top of a third of them, one at the bottom of three, or a page number."""
    last = F.max("seq").over(Window.partitionBy("doc_id"))
    rows = rv.blocks(spark, d).withColumn("last", last).withColumn("k", F.lower(F.trim("text"))).where("length(k) between 1 and 120")
    rows = rows.withColumn("top", F.col("seq") <= 1).withColumn("bottom", F.col("seq") >= F.col("last") - 1)
    return tx.bands(rows, "doc_id").select("doc_id", "seq", "band")


@query("p9_real_heading", with_views("v_blocks") + "SELECT doc_id, seq FROM v_blocks WHERE length(text) BETWEEN 1 AND 110 AND len(string_split(trim(text), ' ')) <= 14 AND NOT regexp_matches(text, '^[a-z]') AND NOT regexp_matches(text, '[,;]$')")
def p9(spark, d):
    return rv.blocks(spark, d).where(F.length("text").between(1, 110) & (F.size(F.split(F.trim("text"), " ")) <= 14) & ~F.col("text").rlike("^[a-z]") & ~F.col("text").rlike("[,;]$")).select("doc_id", "seq")


@query("p11_entity_scope", "SELECT conv_id, turn, n_name FROM conversations, nation WHERE turn = n_nationkey % 7")
def p11(spark, d):
    """Entities named in a question: exploded words meet the entities' rare words in an equi-join."""
    names = table(spark, d, "nation").select("n_name", F.lower("n_name").alias("word"), (F.col("n_nationkey") % 7).alias("turn"))
    said = names.groupBy("turn").agg(F.array_join(F.array_sort(F.collect_list("word")), " and ").alias("q"))
    asked = table(spark, d, "conversations").join(F.broadcast(said), "turn").select("conv_id", "turn", F.explode(F.array_distinct(F.split("q", " "))).alias("word"))
    return asked.join(F.broadcast(names.select("n_name", "word")), "word").select("conv_id", "turn", "n_name")


@query("p13_conflict", "SELECT a.vec_id AS a, b.vec_id AS b, CASE WHEN (a.label < 2) <> (b.label < 2) THEN 'scan' WHEN a.label <> b.label THEN 'form' END AS why FROM embeddings a, (SELECT min(vec_id) AS vec_id, label FROM embeddings GROUP BY label) b")
def p13(spark, d):
    own = table(spark, d, "embeddings").select("vec_id", "label")
    models = small(own.groupBy(F.col("label").alias("lb")).agg(F.min("vec_id").alias("b")))  # the first report of each profile
    why = F.when((F.col("label") < 2) != (F.col("lb") < 2), "scan").when(F.col("label") != F.col("lb"), "form")
    return own.crossJoin(models).select(F.col("vec_id").alias("a"), "b", why.alias("why"))


@query("p14_stale", "SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' AND o_orderkey % 5 = 0 THEN 'ready' WHEN o_orderkey % 5 = 0 THEN 'stale' ELSE 'missing' END AS status FROM orders")
def p14(spark, d):
    built = table(spark, d, "orders").where("o_orderkey % 5 = 0").select("o_orderkey", (F.col("o_orderstatus") == "F").alias("current"))
    return table(spark, d, "orders").select("o_orderkey").join(built, "o_orderkey", "left").select("o_orderkey", F.when(F.col("current"), "ready").when(F.col("current").isNotNull(), "stale").otherwise("missing").alias("status"))


_PAGES = """pg AS (SELECT doc_id, source AS report, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS page, text || CASE WHEN doc_id % 5 = 0 AND length(source) % 2 = 0 THEN chr(10) || 'NOTES to the  Consolidated' || chr(10) || 'Financial Statements' WHEN doc_id % 5 = 1 THEN chr(10) || '  Schedule ''A'': Capital'
  WHEN doc_id % 5 = 2 THEN ' Forming part of  the Balance Sheet' WHEN doc_id % 5 = 3 THEN ' FORM 10-K' ELSE ' notes forming part of the standalone financial statements to the consolidated' END AS text FROM documents)"""


def _pages(spark, d):
    """Documents as the pages of their source, each with a mark of some format."""
    k = F.col("doc_id") % 5
    mark = F.when((k == 0) & (F.length("source") % 2 == 0), "\nNOTES to the  Consolidated\nFinancial Statements").when(k == 1, "\n  Schedule 'A': Capital").when(k == 2, " Forming part of  the Balance Sheet")
    mark = mark.when(k == 3, " FORM 10-K").otherwise(" notes forming part of the standalone financial statements to the consolidated")
    page = F.row_number().over(Window.partitionBy("source").orderBy("doc_id"))
    return table(spark, d, "documents").select("doc_id", F.col("source").alias("report"), page.alias("page"), F.concat("text", mark).alias("text"))


@query("p17_section_of", f"""WITH {_PAGES}, p AS (SELECT doc_id, lower(regexp_replace(text, '\\s+', ' ', 'g')) AS t FROM pg)
SELECT doc_id, CASE WHEN t LIKE '%notes to consolidated financial statements%' OR t LIKE '%notes forming part of the consolidated financial statements%' OR t LIKE '%notes to the consolidated financial statements%' THEN 'consolidated'
  WHEN t LIKE '%notes forming part of the standalone financial statements%' THEN 'standalone' WHEN t LIKE '%form 10-k%' THEN 'filed' END AS section FROM p""")
def p17(spark, d):
    return _pages(spark, d).select("doc_id", st.notes_section(F.col("text"), ("filed", "FORM 10-K")).alias("section"))


@query("p18_page_bounds", with_views("v_blocks") + f""", {_ROWS}, marked AS (SELECT doc_id, seq, y0, y1, height, CASE WHEN seq = 0 AND doc_id % 3 = 0 THEN '3/31/2024, 9:15 AM' WHEN y0 + 10 = height AND doc_id % 2 = 0 THEN 'https://a.b/c' ELSE text END AS text FROM rows_),
ends AS (SELECT doc_id, greatest(min(y0), max(y1) FILTER (y0 < 0.12 * height AND regexp_matches(text, '(?i)^[0-9]{{1,2}}/[0-9]{{1,2}}/[0-9]{{2,4}},?\\s+[0-9]{{1,2}}:[0-9]{{2}}\\s*[AP]M\\b|^Table of Contents$'))) AS top,
  least(max(y1) + 0.5, min(y0) FILTER (y0 > 0.85 * height AND regexp_matches(text, '^https?://'))) - 0.5 AS bottom FROM marked GROUP BY doc_id)
SELECT doc_id AS page, top, bottom, coalesce(min(y0) FILTER (y0 > top + 0.5 AND y1 < bottom), top) AS body_top FROM marked JOIN ends USING (doc_id) GROUP BY doc_id, top, bottom""")
def p18(spark, d):
    text = F.when((F.col("seq") == 0) & (F.col("page") % 3 == 0), "3/31/2024, 9:15 AM").when((F.col("y0") + 10 == F.col("height")) & (F.col("page") % 2 == 0), "https://a.b/c").otherwise(F.col("text"))
    return st.page_bounds(_rows(spark, d).withColumn("text", text))


@query("p20_numeric_cells", with_views("v_values") + "SELECT line_id, string_agg(raw, '|' ORDER BY col) AS cells FROM v_values WHERE regexp_matches(raw, '[0-9]') GROUP BY line_id")
def p20(spark, d):
    cells = rv.values(spark, d).groupBy("line_id").agg(F.array_sort(F.collect_list(F.struct("col", "raw"))).alias("c"))
    return cells.select("line_id", F.array_join(F.transform(F.filter("c", lambda x: x["raw"].rlike("[0-9]")), lambda x: x["raw"]), "|").alias("cells"))


@query("u2_pages_to_do", "SELECT event_id FROM events WHERE event_type <> 'error' EXCEPT SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F'")
def u2(spark, d):
    return table(spark, d, "events").where("event_type != 'error'").select("event_id").subtract(table(spark, d, "orders").where("o_orderstatus = 'F'").select("o_orderkey"))


@query("u3_common", "SELECT l_partkey AS id FROM lineitem WHERE l_quantity > 45 INTERSECT SELECT p_partkey FROM part WHERE p_size > 25")
def u3(spark, d):
    return table(spark, d, "lineitem").where("l_quantity > 45").select(F.col("l_partkey").alias("id")).intersect(table(spark, d, "part").where("p_size > 25").select("p_partkey"))


@query("u4_ordered_distinct", "SELECT user_id, string_agg(event_type, ',' ORDER BY f) AS kinds FROM (SELECT user_id, event_type, min(event_id) AS f FROM events GROUP BY 1, 2) GROUP BY user_id")
def u4(spark, d):
    first = table(spark, d, "events").groupBy("user_id", "event_type").agg(F.min("event_id").alias("f"))
    return first.groupBy("user_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("f", "event_type"))), lambda x: x["event_type"]), ",").alias("kinds"))


@query("f15_clean_text")
def f15(spark, d):
    return table(spark, d, "documents").select("doc_id", tx.clean_text("text").alias("text"))


_TITLED = """array_to_string(list_transform(string_split({0}, ' '), lambda w, i: CASE WHEN length(regexp_replace(w, '[^A-Za-z]', '', 'g')) > 1 AND upper(regexp_replace(w, '[^A-Za-z]', '', 'g')) = regexp_replace(w, '[^A-Za-z]', '', 'g') AND NOT contains(w, '.')
  THEN CASE WHEN i > 1 AND lower(w) IN ('and', 'or', 'of', 'the', 'to', 'in', 'for', 'on', 'at', 'by', 'as', 'with', 'from', '&') THEN lower(w) ELSE upper(left(lower(w), 1)) || substr(lower(w), 2) END ELSE w END), ' ')"""


@query("f16_titles", f"""SELECT DISTINCT p_name, CASE WHEN length(p_name || ' of the ' || p_type) <= 20 THEN p_name || ' of the ' || p_type ELSE regexp_replace(left(p_name || ' of the ' || p_type, 20), '\\s+\\S*$', '') || '…' END AS short,
  {_TITLED.format("(upper(p_name) || ' OF THE U.S. ' || p_type)")} AS titled, {_TITLED.format("upper(p_name)")} AS cleaned, 'Schedule ''E'' ' || p_name || ' – 1' AS legacy FROM part""")
def f16(spark, d):
    titled = F.concat(F.upper("p_name"), F.lit(" OF THE U.S. "), "p_type")
    cleaned = tx.clean_title(F.concat(F.lit(" -"), F.upper("p_name"), F.lit(" as at March 31, 2020 Rs. Rs")))
    legacy = tx.legacy_clean(F.concat(F.lit("Schedule ‘ E´ "), "p_name", F.lit(" \ufffd\ufffd 1")))
    return table(spark, d, "part").select("p_name", tx.truncate(F.concat("p_name", F.lit(" of the "), "p_type"), 20).alias("short"), tx.title_case(titled).alias("titled"), cleaned.alias("cleaned"), legacy.alias("legacy")).distinct()


_NORM = "trim(regexp_replace(lower({0}), '[^a-z0-9]+', ' ', 'g'))"
_ENTITY = "trim(regexp_replace(regexp_replace(lower(text), '[^a-z0-9& ]', ' ', 'g'), ' +', ' ', 'g'))"


@query("f17_norm_slug", with_views("v_blocks") + f"""SELECT doc_id, seq, {_NORM.format('text')} AS norm, trim(regexp_replace(lower(regexp_replace(text, '(?i)\\(\\s*cont(?:d|inued)?\\.?\\s*\\)', '', 'g')), '\\s+', ' ', 'g')) AS heading,
  {_NORM.format("replace(text, '&', ' and ')")} AS title, {_ENTITY} AS entity,
  coalesce(nullif(array_to_string(list_filter(string_split({_ENTITY}, ' '), lambda w: w <> '' AND w NOT IN ('inc', 'company', 'co', 'corporation', 'corp', 'ltd', 'limited', 'the', 'of', 'and', '&', 'insurance', 'incorporated')), '-'), ''), 'report') AS entity_key,
  CASE WHEN {_NORM.format('text')} = '' THEN 'N-SECTION' ELSE 'N-' || upper(array_to_string(list_slice(string_split({_NORM.format('text')}, ' '), 1, 5), '-')) END AS slug FROM v_blocks""")
def f17(spark, d):
    text = F.col("text")
    kinds = {"norm": tx.norm, "heading": tx.norm_heading, "title": tx.norm_title, "entity": tx.norm_entity, "entity_key": tx.entity_key, "slug": tx.slug}
    return rv.blocks(spark, d).select("doc_id", "seq", *[f(text).alias(n) for n, f in kinds.items()])


@query("f29_fill_prompt", "SELECT conv_id, turn, '{{MISSING}} ' || role || ': ' || text || ' {{ROLE}}' || role || '.' AS prompt FROM conversations")
def f29(spark, d):
    """A value that looks like a placeholder stays as it is."""
    values = F.create_map(F.lit("ROLE"), F.col("role"), F.lit("QUESTION"), F.concat("text", F.lit(" {{ROLE}}")))
    return table(spark, d, "conversations").select("conv_id", "turn", tx.fill_prompt(F.lit("{{MISSING}} {{ROLE}}: {{QUESTION}}{{ROLE}}."), values).alias("prompt"))


@query("k1_write_package", "SELECT 'a' AS report_id, o_orderkey AS id, o_totalprice + 1 AS total FROM orders WHERE o_orderstatus = 'F' UNION ALL SELECT 'b', o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'O'")
def k1(spark, d):
    """Two reports of one package, the first written twice: only its own partition is replaced."""
    own = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("total"), "o_orderstatus")
    part = lambda status: own.where(F.col("o_orderstatus") == status).select("id", "total")
    root = scratch(spark, "package")
    for report, rows in (("a", part("F")), ("b", part("O")), ("a", part("F").withColumn("total", F.col("total") + 1))):
        sinks.write_package({"lines": rows}, root, report)
    return spark.read.schema("id long, total double, report_id string").parquet(f"{root}/lines").select("report_id", "id", "total")


@query("k5_append", "SELECT event_id, event_type FROM events")
def k5(spark, d):
    """A history that grows by appends, read as one."""
    path, rows = scratch(spark, "history"), table(spark, d, "events").select("event_id", "event_type")
    for cond in ("event_type = 'view'", "event_type != 'view'"):
        sinks.append(rows.where(cond), path)
    return spark.read.schema(rows.schema).parquet(path)


@query("f18_join_lines", with_views("v_blocks") + "SELECT doc_id, string_agg(text, ' ' ORDER BY seq) AS text FROM v_blocks WHERE length(text) > 0 GROUP BY doc_id")
def f18(spark, d):
    held = rv.blocks(spark, d).where("length(text) > 0").groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", "text"))), lambda x: x["text"]).alias("lines"))
    return held.select("doc_id", tx.join_lines(F.col("lines")).alias("text"))


@query("f22_ids", with_views("v_notes") + "SELECT id, CASE WHEN section_id = 'consolidated' THEN 'C' ELSE 'S' END || '-N' || lpad(number::VARCHAR, 3, '0') AS note_id FROM v_notes")
def f22(spark, d):
    code = F.when(F.col("section_id") == "consolidated", "C").otherwise("S")
    return rv.notes(spark, d).select("id", F.concat(code, F.lit("-N"), F.lpad(F.col("number").cast("string"), 3, "0")).alias("note_id"))


@query("f23_statement_type", "SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN 'PL' WHEN 1 THEN 'BS' WHEN 2 THEN 'CF' WHEN 3 THEN 'EQ' END AS kind FROM orders")
def f23(spark, d):
    title = F.expr("CASE o_orderkey % 5 WHEN 0 THEN 'Statement of Profit and Loss' WHEN 1 THEN 'Consolidated Balance Sheet' WHEN 2 THEN 'Statement of Cash Flows' WHEN 3 THEN 'Statement of Changes in Equity' ELSE o_orderpriority END")
    return table(spark, d, "orders").select("o_orderkey", tx.statement_type(title).alias("kind"))


@query("f24_printed_to_page", """WITH o AS (SELECT turn + conv_id % 3 AS page, turn AS printed, conv_id FROM conversations), m AS (SELECT conv_id, conv_id % 3 AS off FROM conversations GROUP BY conv_id)
SELECT e.conv_id, e.printed, e.printed + m.off AS page FROM (SELECT conv_id, unnest(range(0, 40)) AS printed FROM m) e JOIN m USING (conv_id)""")
def f24(spark, d):
    """Page of a printed number: the page that prints it, else the usual offset."""
    seen = table(spark, d, "conversations").select("conv_id", F.col("turn").alias("printed"), (F.col("turn") + F.col("conv_id") % 3).alias("page"))
    offset = seen.groupBy("conv_id", (F.col("page") - F.col("printed")).alias("off")).agg(F.count("*").alias("n"), F.min("page").alias("f")).groupBy("conv_id").agg(F.max_by("off", F.struct("n", -F.col("f"))).alias("off"))
    asked = offset.select("conv_id", "off", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(39).cast("long"))).alias("printed"))
    return asked.join(seen, ["conv_id", "printed"], "left").select("conv_id", "printed", F.coalesce("page", F.col("printed") + F.col("off")).alias("page"))


@query("f25_parse_reply", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, '# Page' || chr(10) || event_type || ' 1[?] 2[?]' AS markdown, 2 AS unreadable FROM events")
def f25(spark, d):
    """Header and Markdown of a transcription reply."""
    reply = F.concat(F.lit("Here it is:\n```json\n"), "props", F.lit("\n```\n\n# Page\n"), "event_type", F.lit(" 1[?] 2[?]\n "))
    return table(spark, d, "events").select("event_id", tx.parse_reply(reply, "k long").alias("r")).select("event_id", "r.header.k", F.regexp_replace("r.markdown", r"\s+$", "").alias("markdown"), "r.unreadable")


@query("f27_block_text", with_views("v_blocks") + "SELECT doc_id, seq, CASE WHEN length(text) < 40 THEN '## ' || text WHEN seq % 5 = 0 THEN '- ' || text ELSE text END AS text FROM v_blocks")
def f27(spark, d):
    kind = F.when(F.length("text") < 40, "heading").when(F.col("seq") % 5 == 0, "bullet").otherwise("paragraph")
    return rv.blocks(spark, d).select("doc_id", "seq", tx.block_text(kind, F.lit(2), F.col("text")).alias("text"))


@query("f30_features", "SELECT page_id, html LIKE '%<table%' AS tables, len(regexp_extract_all(html, '<p>')) >= 5 AS many_paragraphs, CASE WHEN url LIKE 'https%' THEN 'tls' ELSE 'plain' END AS kind FROM pages")
def f30(spark, d):
    return table(spark, d, "pages").select("page_id", F.col("html").contains("<table").alias("tables"), (F.regexp_count("html", F.lit("<p>")) >= 5).alias("many_paragraphs"), F.when(F.col("url").startswith("https"), "tls").otherwise("plain").alias("kind"))


@query("d3_page_layout", with_views("v_blocks") + "SELECT doc_id, min(seq) AS top, max(seq) AS bottom, coalesce(min(seq) FILTER (length(text) > 60), 0) AS body_top FROM v_blocks GROUP BY doc_id")
def d3(spark, d):
    return rv.blocks(spark, d).groupBy("doc_id").agg(F.min("seq").alias("top"), F.max("seq").alias("bottom"), F.coalesce(F.min(F.when(F.length("text") > 60, F.col("seq"))), F.lit(0).cast("long")).alias("body_top"))


@query("d5_table_cells", with_views("v_blocks") + "SELECT doc_id, seq, i - 1 AS col, trim(c[i]) AS cell FROM (SELECT doc_id, seq, c, unnest(range(1, len(c) + 1)) AS i FROM (SELECT doc_id, seq, string_split(text, ' | ') AS c FROM v_blocks WHERE text LIKE '% | %'))")
def d5(spark, d):
    return rv.blocks(spark, d).where(F.col("text").contains(" | ")).select("doc_id", "seq", F.posexplode(F.split("text", r" \| ")).alias("col", "cell")).select("doc_id", "seq", F.col("col").cast("long").alias("col"), F.trim("cell").alias("cell"))


@query("d13_blocks", with_views("v_blocks") + "SELECT doc_id, sum(CASE WHEN kind <> coalesce(prev, '') THEN 1 ELSE 0 END)::BIGINT AS blocks, count(*) FILTER (kind = 'table') AS table_rows FROM (SELECT *, lag(kind) OVER (PARTITION BY doc_id ORDER BY seq) AS prev FROM (SELECT *, CASE WHEN text LIKE '% | %' THEN 'table' WHEN length(text) < 40 THEN 'heading' ELSE 'paragraph' END AS kind FROM v_blocks)) GROUP BY doc_id")
def d13(spark, d):
    kind = F.when(F.col("text").contains(" | "), "table").when(F.length("text") < 40, "heading").otherwise("paragraph")
    rows = rv.blocks(spark, d).withColumn("kind", kind)
    new = F.when(F.col("kind").eqNullSafe(F.lag("kind").over(Window.partitionBy("doc_id").orderBy("seq"))), 0).otherwise(1)
    return rows.withColumn("new", new).groupBy("doc_id").agg(F.sum("new").alias("blocks"), F.count_if(F.col("kind") == "table").alias("table_rows"))


_PASSAGES = """, b AS (SELECT v.doc_id, seq, seq // 20 + 1 AS page, text, source AS title, lang AS parent, length(text) < 40 AS short, trim(text, chr(9) || chr(10) || chr(13) || ' ') AS bare,
    trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')) AS plain, trim(regexp_replace(lower(source), '[^a-z0-9]+', ' ', 'g')) AS own FROM v_blocks v JOIN (SELECT doc_id, source, lang FROM documents) d ON d.doc_id = v.doc_id),
h AS (SELECT *, short AND NOT (bare = '' OR regexp_matches(bare, '^\\p{Ll}') OR regexp_matches(bare, '[,;]$') OR len(regexp_split_to_array(bare, '\\s+')) > 14 OR length(bare) > 110) AND NOT (own <> '' AND contains(plain, own)) AS heading FROM b),
n AS (SELECT *, CASE WHEN heading THEN 0 ELSE length(text) END AS n FROM h),
u AS (SELECT *, sum(n) OVER (PARTITION BY doc_id ORDER BY seq) AS upto FROM n),
c AS (SELECT *, CASE WHEN heading AND upto > coalesce(max(CASE WHEN heading THEN upto END) OVER (PARTITION BY doc_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) THEN 1 ELSE 0 END AS cut FROM u),
s AS (SELECT *, sum(cut) OVER (PARTITION BY doc_id ORDER BY seq) AS stretch FROM c),
i AS (SELECT *, row_number() OVER (PARTITION BY doc_id, stretch ORDER BY seq) AS i FROM s),
names AS (SELECT doc_id, stretch, coalesce(list(text ORDER BY seq) FILTER (heading), []) AS names FROM s GROUP BY ALL),
pack AS (SELECT doc_id, stretch, i, seq, n, n::BIGINT AS content, 1 AS part FROM i WHERE i = 1
  UNION ALL SELECT x.doc_id, x.stretch, x.i, x.seq, x.n, CASE WHEN content > 0 AND NOT x.heading AND content + x.n > 8000 THEN x.n ELSE content + x.n END, part + CASE WHEN content > 0 AND NOT x.heading AND content + x.n > 8000 THEN 1 ELSE 0 END
  FROM pack k JOIN i x ON x.doc_id = k.doc_id AND x.stretch = k.stretch AND x.i = k.i + 1),
piece AS (SELECT doc_id, first, part, chars, CASE WHEN part = 1 AND len(names) > 0 THEN [array_to_string(names, ' · ')] ELSE names END AS heads, row_number() OVER (PARTITION BY doc_id ORDER BY first) AS j
  FROM (SELECT doc_id, stretch, part, min(seq) AS first, sum(n)::BIGINT AS chars FROM pack GROUP BY ALL) JOIN names USING (doc_id, stretch)),
fold AS (SELECT doc_id, j, first, part, chars, heads, 1 AS g FROM piece WHERE j = 1
  UNION ALL SELECT x.doc_id, x.j, CASE WHEN f.chars < 1500 THEN f.first ELSE x.first END, x.part, CASE WHEN f.chars < 1500 THEN f.chars ELSE 0 END + x.chars,
    CASE WHEN f.chars < 1500 AND len(f.heads) > 0 AND f.heads <> x.heads THEN f.heads[:-2] || [array_to_string([f.heads[-1]] || [y FOR y IN x.heads[-1:] IF NOT list_contains(f.heads, y)], ' · ')] ELSE x.heads END, g + CASE WHEN f.chars < 1500 THEN 0 ELSE 1 END
  FROM fold f JOIN piece x ON x.doc_id = f.doc_id AND x.j = f.j + 1),
done AS (SELECT *, max(g) OVER (PARTITION BY doc_id) AS last FROM fold QUALIFY row_number() OVER (PARTITION BY doc_id, g ORDER BY j DESC) = 1),
p AS (SELECT *, g AS passage, lead(first) OVER (PARTITION BY doc_id ORDER BY g) AS next FROM done WHERE NOT (g = last AND g > 1 AND chars < 1500)),
t AS (SELECT s.*, p.passage, p.heads, p.part, lag(s.page) OVER (PARTITION BY s.doc_id, p.passage ORDER BY s.seq) AS was FROM s JOIN p ON s.doc_id = p.doc_id AND s.seq >= p.first AND (p.next IS NULL OR s.seq < p.next)),
w AS (SELECT doc_id, passage, any_value(heads) AS heads, any_value(part) AS part, any_value(title) AS title, any_value(parent) AS parent, min(seq) AS first_seq, max(seq) AS last_seq, sum(n)::BIGINT AS chars,
  string_agg(concat_ws(chr(10) || chr(10), CASE WHEN was IS DISTINCT FROM page THEN '--- PDF page ' || page || ' ---' END, nullif(text, '')), chr(10) || chr(10) ORDER BY seq) FILTER (text <> '' OR was IS DISTINCT FROM page) AS text,
  array_to_string([x FOR x IN regexp_split_to_array(coalesce(string_agg(text, ' ' ORDER BY seq) FILTER (NOT heading), ''), '\\s+') IF x <> ''][1:25], ' ') AS lead FROM t GROUP BY doc_id, passage)
SELECT doc_id, passage::BIGINT AS passage, 'P-' || title || '-' || lpad(passage::VARCHAR, greatest(2, length(passage::VARCHAR))::INTEGER, '0') AS id, first_seq, last_seq, chars, lead, sha256(text) AS text_sha256,
  regexp_replace(regexp_replace(array_to_string([parent, title] || [y FOR y IN heads IF trim(regexp_replace(lower(y), '[^a-z0-9]+', ' ', 'g')) <> lower(title)], ' › '), '[\\x00-\\x1f]+', ' ', 'g'), '  +', ' ', 'g') || CASE WHEN part > 1 THEN ' (part ' || part || ')' ELSE '' END AS path FROM w"""


@query("d14_passages", with_views("v_blocks").replace("WITH", "WITH RECURSIVE", 1) + _PASSAGES)
def d14(spark, d):
    """Documents as sections named by their source: passages with their text, lead, id and path."""
    named = table(spark, d, "documents").select("doc_id", F.col("source").alias("title"), F.col("lang").alias("parent"))
    rows = rv.blocks(spark, d).withColumn("kind", F.when(F.length("text") < 40, "heading").otherwise("paragraph")).withColumn("page", F.floor(F.col("seq") / 20) + 1)
    return ps.passages(rows.join(named, "doc_id")).drop("figures").withColumn("text_sha256", F.sha2("text", 256)).drop("text")


@query("d16_unit_lines", with_views("v_blocks") + "SELECT doc_id, string_agg(text, chr(10) ORDER BY seq) AS text FROM v_blocks WHERE seq BETWEEN 2 AND 5 GROUP BY doc_id")
def d16(spark, d):
    """A unit's text by its first and last line: a slice of the page's lines."""
    return table(spark, d, "documents").select("doc_id", F.slice(F.split("text", "\n"), 3, 4).alias("l")).where(F.size("l") > 0).select("doc_id", F.array_join("l", "\n").alias("text"))


@query("d18_document_order", "SELECT id, row_number() OVER (ORDER BY coalesce(start, 1000000), flag, id) AS place FROM (SELECT doc_id AS id, CASE WHEN doc_id % 9 = 0 THEN NULL ELSE doc_id * 13 % 400 END AS start, 0 AS flag FROM documents UNION ALL SELECT 100000 + page_id, page_id, 1 FROM pages)")
def d18(spark, d):
    a = table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.when(F.col("doc_id") % 9 != 0, F.col("doc_id") * 13 % 400).alias("start"), F.lit(0).alias("flag"))
    b = table(spark, d, "pages").select((F.col("page_id") + 100000).alias("id"), F.col("page_id").alias("start"), F.lit(1).alias("flag"))
    return numbered(a.unionByName(b).withColumn("start", F.coalesce("start", F.lit(1000000))), "start", "flag", "id").select("id", "place")


@query("d20_fingerprint", with_views("v_blocks") + "SELECT d.source, count(DISTINCT d.doc_id) AS docs, round(avg(CASE WHEN upper(b.text) = b.text THEN 1.0 ELSE 0.0 END), 9) AS capitals, count(*) FILTER (b.text LIKE '% | %') AS table_rows, mode(d.lang) IS NOT NULL AS has_lang FROM v_blocks b JOIN documents d USING (doc_id) GROUP BY d.source")
def d20(spark, d):
    rows = rv.blocks(spark, d).join(table(spark, d, "documents").select("doc_id", "source", "lang"), "doc_id")
    return rows.groupBy("source").agg(F.countDistinct("doc_id").alias("docs"), F.round(F.avg((F.upper("text") == F.col("text")).cast("double")), 9).alias("capitals"), F.count_if(F.col("text").contains(" | ")).alias("table_rows"), F.max("lang").isNotNull().alias("has_lang"))


@query("m2_format", f"""WITH {_PAGES}, s AS (SELECT report, count(*) FILTER (regexp_matches(lower(regexp_replace(text, '\\s+', ' ', 'g')), 'notes (to|forming part of the|to the) (consolidated|standalone) financial statements')) AS modern_notes_pages,
  CAST(sum(len(regexp_extract_all(text, '(?im)^\\s*schedule\\s*[‘’''`´"\ufffd]?\\s*(?:[A-Z]{{1,2}}|[0-9]{{1,2}}|[IVXL]{{1,5}})\\s*[‘’''`´"\ufffd]?\\s*(?:[:.\\-–]|$)'))) AS BIGINT) AS schedule_headings,
  count(*) FILTER (regexp_matches(text, '(?i)forming\\s+part\\s+of\\s+the\\s+(?:balance\\s+sheet|profit\\s*(?:and|&)\\s*loss\\s+account|accounts)')) AS forming_part_pages,
  count(*) FILTER (page <= 5 AND regexp_matches(text, '\\bFORM\\s+10-K\\b')) AS form_10k_cover FROM pg GROUP BY report)
SELECT *, CASE WHEN modern_notes_pages >= 3 THEN CASE WHEN form_10k_cover > 0 THEN 'us-10k' ELSE 'modern' END WHEN schedule_headings >= 3 OR forming_part_pages >= 3 THEN 'legacy' ELSE 'modern' END AS format FROM s""")
def m2(spark, d):
    return st.report_format(_pages(spark, d))


@query("m5_missing_cache", "SELECT DISTINCT sha256(text) AS digest FROM documents WHERE sha256(text) NOT IN (SELECT sha256(text) FROM documents WHERE lang = 'en')")
def m5(spark, d):
    docs = table(spark, d, "documents").select("lang", F.sha2("text", 256).alias("digest"))
    return docs.select("digest").distinct().join(docs.where("lang = 'en'").select("digest").distinct(), "digest", "left_anti")


@query("q7_acceptance", "SELECT report, notes >= 40 AS enough_notes, statements >= 2 AS enough_statements, share >= 0.1 AS readable, notes >= 40 AND statements >= 2 AND share >= 0.1 AS accepted FROM (SELECT source AS report, count(*) AS notes, count(DISTINCT lang) AS statements, avg(CASE WHEN n_chars > 2000 THEN 1.0 ELSE 0.0 END) AS share FROM documents GROUP BY source)")
def q7(spark, d):
    reports = table(spark, d, "documents").groupBy(F.col("source").alias("report")).agg(F.count("*").alias("notes"), F.countDistinct("lang").alias("statements"), F.avg((F.col("n_chars") > 2000).cast("double")).alias("readable_share"))
    return checks.acceptance(reports, 40, 2, 0.1)


@query("w1_row_clusters", """WITH RECURSIVE e AS (SELECT user_id AS page, value * 10 AS y, event_id::DOUBLE AS x, event_type AS text, row_number() OVER (PARTITION BY user_id ORDER BY value * 10, event_id) AS i FROM events),
  r AS (SELECT page, i, y AS first, 0 AS row FROM e WHERE i = 1 UNION ALL SELECT e.page, e.i, CASE WHEN e.y - r.first > 3.0 THEN e.y ELSE r.first END, row + CASE WHEN e.y - r.first > 3.0 THEN 1 ELSE 0 END FROM r JOIN e ON e.page = r.page AND e.i = r.i + 1)
  SELECT page, y, x, text, row FROM e JOIN r USING (page, i)""")
def w1(spark, d):
    y = F.col("value") * 10
    spans = table(spark, d, "events").select(F.col("user_id").alias("page"), F.col("event_id").alias("seg"), y.alias("y0"), y.alias("y1"), F.col("event_id").cast("double").alias("x0"), F.col("event_type").alias("text"))
    return layout.rows_of_page(spans).select("page", F.col("y0").alias("y"), F.col("x0").alias("x"), "text", F.col("row").cast("long").alias("row"))


_TIES = """, c AS (SELECT order_id AS page, seq * 10 AS row, label, cents / 100.0 AS value FROM v_lines UNION ALL SELECT order_id, max(seq) * 10 + 5, 'Total', sum(cents) / 100.0 FROM v_lines GROUP BY order_id),
x AS (SELECT page, row, label, value::DOUBLE AS v, format('{:,.2f}', value) AS figure, row_number() OVER w AS i, lag(value::DOUBLE) OVER w AS b, lag(value::DOUBLE, 2) OVER w AS a, lag(format('{:,.2f}', value)) OVER w AS fb, lag(format('{:,.2f}', value), 2) OVER w AS fa FROM c WINDOW w AS (PARTITION BY page ORDER BY row)),
r AS (SELECT page, i, [v] AS vs, [figure] AS fs, NULL::VARCHAR AS status, row, figure, []::VARCHAR[] AS parts FROM x WHERE i = 1
  UNION ALL SELECT page, i, vs[:len(vs) - used] || [v], fs[:len(fs) - used] || [figure], CASE WHEN used > 0 OR across THEN 'tied' WHEN len(vs) >= 2 AND label = 'Total' THEN 'untied' END, row, figure,
    CASE WHEN used > 0 THEN fs[len(fs) - used + 1:] || [figure] WHEN across THEN [fa, fb, figure] ELSE [] END
  FROM (SELECT *, coalesce(k, CASE WHEN len(vs) >= 2 AND abs(vs[-2] - vs[-1] - v) < 0.5 THEN 2 END, 0) AS used FROM (
    SELECT x.page, x.i, vs, fs, x.v, x.figure, x.label, x.row, fa, fb, coalesce(x.label = 'Total' AND (abs(a - b - v) < 0.5 OR abs(a + b - v) < 0.5), false) AS across,
      [k FOR k IN range(2, least(len(vs), 20) + 1) IF abs(list_sum(vs[len(vs) - k + 1:]) - x.v) < 0.5][1] AS k FROM r JOIN x ON x.page = r.page AND x.i = r.i + 1)))
SELECT page, 0 AS tbl, 1 AS col, row, figure, status, list_sort(list_distinct([regexp_replace(y, '[^0-9]', '', 'g') FOR y IN parts])) AS parts FROM r WHERE status IS NOT NULL"""


def _tied(spark, d):
    own = rv.lines(spark, d)
    part = own.select(F.col("order_id").alias("page"), F.lit(0).cast("long").alias("tbl"), F.lit(1).cast("long").alias("col"), (F.col("seq") * 10).alias("row"), F.col("label"), (F.col("cents") / 100).alias("value"))
    total = own.groupBy("order_id").agg(F.sum("cents").alias("c"), F.max("seq").alias("m")).select(F.col("order_id").alias("page"), F.lit(0).cast("long").alias("tbl"), F.lit(1).cast("long").alias("col"), (F.col("m") * 10 + 5).alias("row"), F.lit("Total").alias("label"), (F.col("c") / 100).alias("value"))
    return checks.tie_outs(part.unionByName(total).withColumn("figure", F.format_number("value", 2)))


@query("q5_tie_outs", with_views("v_lines").replace("WITH", "WITH RECURSIVE", 1) + _TIES)
def q5(spark, d):
    return _tied(spark, d)


@query("q5_confirmed", with_views("v_lines").replace("WITH", "WITH RECURSIVE", 1) + _TIES.replace("SELECT page, 0 AS tbl", ", t AS (SELECT page, 0 AS tbl") + ") SELECT DISTINCT page, unnest(parts) AS figure FROM t WHERE status = 'tied'")
def q5_confirmed(spark, d):
    """The figures of each page that a tie confirms."""
    return checks.confirmed(_tied(spark, d))


@query("d12_reading_order", "SELECT user_id AS page, event_id AS box, row_number() OVER (PARTITION BY user_id ORDER BY event_id % 2, floor(value), event_id) - 1 AS place FROM events")
def d12(spark, d):
    x = F.col("event_id") % 2 * 300.0
    y = F.floor(F.col("value")) * 12.0
    boxes = table(spark, d, "events").select(F.col("user_id").alias("page"), F.lit("page").alias("container"), F.lpad(F.col("event_id").cast("string"), 20, "0").alias("node"), x.alias("x0"), y.alias("y0"), (x + 250.0).alias("x1"), (y + 4.0).alias("y1"))
    return layout.reading_order(boxes).select("page", F.col("node").cast("long").alias("box"), "place")


@query("d1_text_rows", "SELECT user_id AS page, event_type AS row, string_agg(event_id::VARCHAR, ' | ' ORDER BY event_id) AS text FROM events GROUP BY 1, 2")
def d1(spark, d):
    spans = table(spark, d, "events").select(F.col("user_id").alias("page"), F.col("event_type").alias("row"), (F.col("event_id") * 100.0).alias("x0"), (F.col("event_id") * 100.0 + 50.0).alias("x1"), F.col("event_id").cast("string").alias("text"))
    return grouped.text_rows(spans)


@query("r8_candidate_lists", with_views("v_notes") + "SELECT section_id, string_agg(title, '; ' ORDER BY number) AS titles FROM v_notes WHERE number <= 8 GROUP BY section_id")
def r8(spark, d):
    held = rv.notes(spark, d).groupBy("section_id").agg(F.array_sort(F.collect_list(F.struct("number", "title"))).alias("n"))
    return held.select("section_id", F.array_join(F.transform(F.slice("n", 1, 8), lambda x: x["title"]), "; ").alias("titles"))


@query("r9_report_summary", "SELECT source, count(*) AS passages, sum(n_chars)::BIGINT AS chars, count(DISTINCT lang) AS languages, min(doc_id) AS first_id, max(doc_id) AS last_id FROM documents GROUP BY source")
def r9(spark, d):
    return table(spark, d, "documents").groupBy("source").agg(F.count("*").alias("passages"), F.sum("n_chars").alias("chars"), F.countDistinct("lang").alias("languages"), F.min("doc_id").alias("first_id"), F.max("doc_id").alias("last_id"))


@query("r10_add_named", "SELECT conv_id, turn + 1 AS note FROM conversations c WHERE role = 'user' AND turn + 1 NOT IN (SELECT turn FROM conversations x WHERE x.conv_id = c.conv_id AND x.role = 'system')")
def r10(spark, d):
    turns = table(spark, d, "conversations")
    named = turns.where("role = 'user'").select("conv_id", (F.col("turn") + 1).alias("note"))
    return named.join(turns.where("role = 'system'").select("conv_id", F.col("turn").alias("note")), ["conv_id", "note"], "left_anti")


@query("o10_checks_first", "SELECT event_id FROM events ORDER BY CASE event_type WHEN 'error' THEN 0 WHEN 'signup' THEN 1 WHEN 'click' THEN 2 ELSE 3 END, event_id LIMIT 12")
def o10(spark, d):
    order = F.when(F.col("event_type") == "error", 0).when(F.col("event_type") == "signup", 1).when(F.col("event_type") == "click", 2).otherwise(3)
    return table(spark, d, "events").orderBy(order, "event_id").limit(12).select("event_id")


@query("o11_interleaved", """SELECT report, id, flag, row_number() OVER (PARTITION BY report ORDER BY coalesce(start, 1000000), flag, id) AS place FROM (
  SELECT o_custkey AS report, o_orderkey AS id, 0 AS flag, CASE WHEN o_orderstatus <> 'P' THEN dayofyear(o_orderdate) END AS start FROM orders UNION ALL SELECT user_id, event_id, 1, event_id % 365 FROM events)""")
def o11(spark, d):
    """Units and passages of each report in document order: by first page, those without a page last, a unit before a passage."""
    units = table(spark, d, "orders").select(F.col("o_custkey").alias("report"), F.col("o_orderkey").alias("id"), F.lit(0).alias("flag"), F.when(F.col("o_orderstatus") != "P", F.dayofyear("o_orderdate").cast("long")).alias("start"))
    passages = table(spark, d, "events").select(F.col("user_id").alias("report"), F.col("event_id").alias("id"), F.lit(1).alias("flag"), (F.col("event_id") % 365).alias("start"))
    order = Window.partitionBy("report").orderBy(F.coalesce("start", F.lit(1000000)), "flag", "id")
    return units.unionByName(passages).select("report", "id", "flag", F.row_number().over(order).cast("long").alias("place"))
