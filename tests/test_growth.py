"""Work that must grow with the input: no join brings back what a row had, no pair is made once a period or once a note."""

import math
import random

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from quillspark.functions import figures as fig
from quillspark.operators import checks, layout, legacy, links, retrieval, sections, sequences
from quillspark.plans import link_queries
from quillspark.sources import legacy_views, page_views, report_views, store

SMALL = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def rows(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.mark.parametrize("name", ["j1_lines_values", "d6_lines_values"])
def test_figures_bring_their_line_without_a_join(spark, name):
    assert "Join" not in plan(entry.queries()[name](spark, SMALL))


def test_a_pair_of_lines_is_made_once_and_not_once_a_period(spark):
    figures = spark.createDataFrame(
        [("s", u, u, "net income", p, v, str(v)) for u, v in (("a", 1.0), ("b", 1.0), ("c", 7.5)) for p in ("FY1", "FY2")] + [("s", "d", "d", "net income", "FY3", 1.0, "1.0")],
        "section_id string, unit_id string, line_id string, label_key string, period_label string, value double, raw string",
    )
    found = links.carried(figures, figures)
    top = plan(found)
    assert "Aggregate" not in top[: top.index("Join")]
    assert rows(found) == [("a", "b", 2, True, "FY1 1.0, FY2 1.0"), ("a", "c", 2, False, "FY1 1.0, FY2 1.0"), ("b", "c", 2, False, "FY1 1.0, FY2 1.0")]


def test_an_amount_in_many_notes_is_one_row_for_a_figure(spark):
    parsed = spark.createDataFrame([("a", "s", 0, "12,345.00", 12345.0, False), ("b", "s", 0, "77.50", 77.5, False), ("b", "s", 1, "66.25", 66.25, False)], "line_id string, section_id string, col int, raw string, value double, nil boolean")
    notes = spark.createDataFrame([("s", f"n{k}", "12,345.00") for k in range(9)] + [("s", f"n{k}", "77.50") for k in range(9)] + [("s", "n3", "66.25")], "section_id string, note_id string, raw string")
    found = links.ties_to(None, parsed, notes)
    assert rows(found.select("src", "dst", "confidence", F.col("key").cast("double"))) == [("b", "n3", "high", 77.5)]
    assert "Window" not in plan(found)


def test_links_stay_with_their_order_and_are_kept_without_evidence(spark):
    """Figures meet broadcast amounts where their order is; evidence, most of the bytes of a link, is written nowhere."""
    ties = plan(link_queries._ties(spark, SMALL))
    assert "BroadcastHashJoin" in ties and "Exchange hashpartitioning" not in ties
    entry.queries()["u1_all_edges"](spark, SMALL).count()
    entry.queries()["o5_best_lines"](spark, SMALL).count()
    kept = [k[1] for k in store._BUILT if k[0] == spark.sparkContext.applicationId]
    assert "edges" not in kept and link_queries._links(spark, SMALL).columns == ["src", "dst", "kind", "method", "confidence"]


def test_more_amounts_than_are_broadcast_give_the_same_ties(spark, monkeypatch):
    few = rows(link_queries._ties(spark, SMALL))
    monkeypatch.setattr(link_queries, "_AMOUNTS", 10)
    monkeypatch.setattr(link_queries, "small", lambda df, most: df.repartition(3).hint("merge"))
    assert "SortMergeJoin" in plan(link_queries._ties(spark, SMALL)) and rows(link_queries._ties(spark, SMALL)) == few


def test_a_table_dealt_by_a_column_is_grouped_and_joined_in_place(spark, tmp_path):
    path = str(tmp_path / "given")
    spark.range(50).selectExpr("id", "id % 7 as k").write.parquet(path)
    made = store.built(spark, "dealt-table", path, lambda: spark.read.parquet(path), deal="k")
    assert "Exchange" not in plan(made.groupBy("k", "id").count()) and rows(made.select("id")) == [(i,) for i in range(50)]
    again = store.built(spark, "dealt-table", path, lambda: None, deal="k", plain=True)
    both = again.unionByName(again.groupBy("k").agg(F.max("id").alias("id"))).repartition("k")
    assert rows(both.groupBy(F.spark_partition_id().alias("p"), "k").count().groupBy("k").count()) == [(k, 1) for k in range(7)]
    kept = store._DEALT[store._BUILT[next(k for k in store._BUILT if k[2] == path)]]
    store.forget(spark, path)
    assert not spark.catalog.tableExists(kept)


def test_lines_with_listed_figures_are_carried_as_those_with_a_row_a_figure(spark):
    figures = spark.createDataFrame(
        [("s", u, u, "net income", p, v, str(v)) for u, v in (("a", 1.0), ("b", 1.0), ("c", 7.5)) for p in ("FY2", "FY1")] + [("s", "d", "d", "net income", "FY3", 1.0, "1.0")],
        "section_id string, unit_id string, line_id string, label_key string, period_label string, value double, raw string",
    )
    figure = F.struct("period_label", "raw", "value", fig.tolerance(F.col("raw")).alias("near"))
    listed = figures.groupBy("section_id", "label_key", "unit_id", "line_id").agg(F.array_sort(F.collect_list(figure)).alias("figures"))
    assert rows(links.carried(listed, listed)) == rows(links.carried(figures, figures)) and links.carried(listed, listed).count() == 3


def test_nearest_within_a_tolerance(spark):
    asked = spark.createDataFrame([(10.0,), (14.9,), (30.0,)], "amount double")
    held = spark.createDataFrame([(9.0, "z"), (11.0, "b"), (15.1, "c"), (36.0, "d")], "value double, id string")
    assert [(a, i, round(x, 6)) for a, i, x in rows(sequences.nearest(asked, held, "amount", "value", "id", 5.0))] == [(10.0, "b", 1.0), (14.9, "c", 0.2)]


def test_lines_linked_by_a_method_are_counted_once(spark):
    edges = spark.createDataFrame([("a", "references", "label"), ("a", "references", "label"), ("a", "ties_to", "figure match"), ("b", "carries", "same figures")], "src string, kind string, method string")
    assert rows(checks.link_summary(edges.select("src"), edges)) == [(4, 1, 0, 1, 1, 0)]
    assert "Expand" not in plan(checks.link_summary(edges.select("src"), edges))


def test_common_figures_read_as_the_long_way_reads_them(spark):
    odd = ["1,234.50", "Rs. 1,234", "Rs.5", "(1,234.56)", "(12%)", "5%", "5%%", "—", "--", "nil", "12,34,567", "1,23", "1234,567", "(Rs. 5)", "$ 7", "₹8", ".5", "5.", "", "-3", "- 4", "(-2)", "7\n", " 7 ", "x", "00012", "()", None]
    df = spark.createDataFrame([(x,) for x in odd], "raw string")
    plain = F.trim(F.replace(F.col("raw"), F.lit(" "), F.lit(" ")))
    long = fig.let(F.trim(F.regexp_replace(plain, fig.CURRENCY, "")), fig._parse_unpriced)
    both = df.select("raw", fig.parse_value(F.col("raw")).alias("a"), long.alias("b")).collect()
    assert [(r.raw, r.a) for r in both] == [(r.raw, r.b) for r in both]


def test_aligned_tables_shuffle_a_page_once(spark):
    """The lines, their parts and the pages are dealt once; before, each table of rows and columns was joined back to its segments."""
    found = plan(entry.queries()["d12_aligned_tables"](spark, SMALL))
    assert found.count("Scan parquet") <= 4 and found.count("Exchange hashpartitioning") <= 4


def test_a_page_of_documents_is_read_and_dealt_once(spark):
    """Lines, glyphs and headings come from one scan; boxes stay with their lines, and no line holds the gaps of its whole box."""
    segments = page_views.document_pages(spark, SMALL)[0]
    assert plan(segments).count("Scan parquet") == 1 and plan(segments).count("Exchange") == 1
    lines = layout.text_boxes(segments.withColumn("bullet", F.lit(False)))
    assert "Join" not in plan(lines) and "collect_list" not in plan(layout.paragraphs(lines.localCheckpoint()))


def test_marks_and_stacks_by_all_pairs(spark):
    """Marks meet the nearest line on their right, and lines the closest one above, as when all pairs of a page are compared."""
    rng, given = random.Random(5), []
    for page in range(12):
        for seg in range(rng.randint(1, 60)):
            mark = rng.random() < 0.3
            x, y, size = rng.choice([40.0, 52.0, 60.0, 300.0]), rng.randint(0, 40) * 6.0 + rng.choice([0, 0.5]), rng.choice([10.0, 10.0, 14.0])
            given.append((page, seg, x, y, x + (5.0 if mark else rng.randint(40, 200)), y + size, "•" if mark else f"line {seg}", size, rng.random() < 0.2, False))
    names = "page long, seg long, x0 double, y0 double, x1 double, y1 double, t string, size double, bold boolean, mono boolean"
    df = spark.createDataFrame(given, names)
    none = spark.createDataFrame([], "page long, draw long, x0 double, y0 double, x1 double, y1 double, curves int, fill boolean, stroke boolean, kinds string, pen double")
    marked = layout.mark_bullets(df, none, layout.body_sizes(df)).collect()
    want, boxes = set(), layout.text_boxes(spark.createDataFrame([tuple(r[c] for c in ("page", "seg", "x0", "y0", "x1", "y1", "t", "size", "bold", "mono", "bullet")) for r in marked], names + ", bullet boolean")).collect()
    for page in range(12):
        own = [g for g in given if g[0] == page]
        lines, aims = [g for g in own if g[6] != "•"], {}
        for m in (g for g in own if g[6] == "•"):
            near = [(k[2] - m[4], k[1]) for k in lines if abs((k[3] + k[5]) / 2 - (m[3] + m[5]) / 2) <= 4 and 0 <= k[2] - m[4] <= 25]
            if near:
                aims.setdefault(min(near)[1], []).append((min(near)[0], m[1], m[2]))
        used = {min(a)[1] for a in aims.values()}
        want |= {(page, k[1], "• " + k[6], min(aims[k[1]])[2], True) if k[1] in aims else (page, k[1], k[6], k[2], False) for k in lines}
        want |= {(page, m[1], "•", m[2], True) for m in own if m[6] == "•" and m[1] not in used}
    assert {(r.page, r.seg, r.t, r.x0, r.bullet) for r in marked} == want
    for page in range(12):
        own = sorted((r for r in boxes if r.page == page), key=lambda r: (r.y0, r.x0, r.seg))
        above, free = {}, {k for k, r in enumerate(own) if not r.bullet}
        for a, u in enumerate(own):
            fits = []
            for b in free:
                v = own[b]
                gap, overlap, large = v.y0 - u.y1, min(u.x1, v.x1) - max(u.x0, v.x0), max(u.size, v.size)
                alike = u.bold == v.bold and large <= 1.25 * min(u.size, v.size) and (overlap >= 0.2 * min(u.x1 - u.x0, v.x1 - v.x0) or abs(u.x0 - v.x0) <= 3)
                if b > a and alike and v.y0 > u.y0 + 0.4 * u.size and -2 <= gap <= 0.8 * large + 1.5:
                    fits.append((gap, -overlap, b))
            if fits:
                above[min(fits)[2]] = a
                free.discard(min(fits)[2])
        at = {}
        for b in range(len(own)):
            at[b] = (at[above[b]][0], at[above[b]][1] + 1) if b in above else (b, 0)
        assert [(r.box, r.line) for r in own] == [at[b] for b in range(len(own))]


def test_coverage_counts_characters_without_a_join(spark):
    lines = spark.createDataFrame([(1, "a b"), (1, "b"), (2, "x"), (3, " "), (4, "q")], "page long, t string")
    blocks = spark.createDataFrame([(1, "bba"), (2, "xx"), (5, "z")], "page long, text string")
    for name, kind in (("items", "array<string>"), ("markers", "string"), ("value", "string"), ("label", "string"), ("labels", "array<string>"), ("head", "array<array<string>>"), ("rows", "array<array<string>>")):
        blocks = blocks.withColumn(name, F.lit(None).cast(kind))
    found = layout.coverage(lines, blocks)
    assert rows(found) == [(1, True), (2, False), (3, True), (4, False)]
    assert "Join" not in plan(found)


def test_the_term_index_deals_passages_and_postings_once(spark):
    """No posting is joined with lengths or counts; odd ids and empty passages count as before."""
    given = [(1, "p", "alpha beta"), (2, "p", "alpha alpha gamma"), (2, "q", "beta"), (3, "the", None), (None, "p", "alpha")]
    indexed = retrieval.index(spark.createDataFrame(given, "id long, path string, text string"))
    found = plan(indexed)
    assert "Join" not in found and found.count("Exchange hashpartitioning") == 2
    tf = {(1, "p"): 3, (1, "alpha"): 1, (1, "beta"): 1, (2, "p"): 3, (2, "q"): 3, (2, "alpha"): 2, (2, "gamma"): 1, (2, "beta"): 1, (None, "p"): 3, (None, "alpha"): 1}
    dl = {i: sum(n for (k, _), n in tf.items() if k == i) for i in (1, 2, None)}
    idf = lambda t: math.log(1 + (5 - (df := sum(term == t for _, term in tf)) + 0.5) / (df + 0.5))
    score = {i: sum(w * idf(t) * tf[i, t] * 2.5 / (tf[i, t] + 1.5 * (0.25 + 0.75 * dl[i] / (sum(dl.values()) / 3))) for t, w in (("alpha", 2.0), ("beta", 1.0)) if (i, t) in tf) for i in (1, 2)}
    assert dict(rows(retrieval.bm25(indexed, {"alpha": 2.0, "beta": 1.0}))) == pytest.approx(score)


def test_values_of_a_line_are_counted_before_they_are_sent(spark):
    found = plan(entry.queries()["a14_column_map"](spark, SMALL))
    assert "Join" not in found and "collect_list" not in found and found.count("Exchange") == 1


def test_sections_join_no_entry_back(spark):
    """Texts meet numbers on their page, groups come with their first section: one join brings the height of a page, one the length of a report."""
    segments = spark.createDataFrame([], "report long, page long, seg long, x0 double, y0 double, x1 double, y1 double, t string, size double, bold boolean")
    pages = spark.createDataFrame([], "report long, page long, width double, height double")
    entries = spark.createDataFrame([], "report long, ord long, title string, start long, grp string")
    logical = lambda df: df._jdf.queryExecution().analyzed().toString()
    assert logical(sections.parse_contents(segments, pages)).count("Join") == 1
    assert logical(sections.section_map(spark.createDataFrame([], "report long, page_count long"), contents=entries, heading=entries)).count("Join") == 1
    assert logical(sections.header_runs(spark.createDataFrame([], "report long, page long, place int, line string"))).count("Join") == 1


def test_lines_are_numbered_where_their_parts_are(spark, tmp_path):
    """The order of a line comes last, so grouping by order deals nothing anew; lines without a part count, parts named twice give two lines."""
    items = [(1, 7, 1, 1), (1, 8, 1, 2), (1, 9, 1, 3), (1, None, 1, 4), (2, 9, 1, 1)]
    names = ("l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int", "p_partkey long, p_name string")
    more = {c: F.lit(1.0) for c in ("l_quantity", "l_extendedprice", "l_discount", "l_tax")}
    spark.createDataFrame(items, names[0]).withColumns(more).withColumn("l_shipdate", F.lit("1999-01-01").cast("timestamp")).write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(8, "b"), (9, "c"), (9, "d"), (5, None)], names[1]).write.parquet(f"{tmp_path}/part.parquet")
    own = report_views.lines(spark, str(tmp_path))
    assert rows(own.select("order_id", "seq", "label")) == [(1, 2, "b"), (1, 3, "c"), (1, 3, "d"), (2, 1, "c"), (2, 1, "d")]
    found = plan(own.groupBy("order_id").agg(F.collect_list(F.struct("seq", "label"))))
    assert found[: found.index("Window")].count("Exchange") == 0


def test_ruled_pages_are_dealt_once(spark):
    """Segments and rules of a page are made and met in one row: no join and no exchange behind the lines of the orders."""
    found = plan(entry.queries()["d12_grid_tables"](spark, SMALL))
    assert found.count("Scan parquet") == 2 and found[: found.index("Window [row_number")].count("Exchange") == 0


def test_rows_of_transcribed_tables_stay_with_their_page(spark):
    """The notes column is found in the rows of its table, so nothing is dealt or joined behind the lines of the orders."""
    found = plan(entry.queries()["d5_markdown_rows"](spark, SMALL))
    assert found.count("Scan parquet") == 2 and found.count("Join") == 1 and "Exchange" not in found[: found.rindex("Window [row_number")]


def test_pages_of_old_reports_come_from_their_sections_once(spark):
    """Sections are built once and say all their rows in one scan; the items of the orders meet them by order in the one other join."""
    found = plan(legacy_views.printed_rows(spark, SMALL))
    assert found.count("Join") == 2 and found.count("Scan parquet") == 4


def test_only_titles_of_old_reports_are_compared_with_titles(spark):
    pages = spark.createDataFrame([], "report long, page long, row long, x0 double, y0 double, y1 double, size double, bold boolean, text string")
    tops = spark.createDataFrame([], "report long, page long, top double, bottom double, body_top double, part_of string")
    found = legacy.markers(pages, tops)._jdf.queryExecution().analyzed().toString()
    guarded = f"(size#{found.split('size#')[1].split(',')[0].split(' ')[0]} >= {legacy.TITLE_SIZE})) THEN CASE WHEN RLIKE"
    assert found.count(guarded) == 2


def test_pages_of_old_reports_are_dealt_once(spark):
    """Pages are kept in buckets, where layouts and windows find them; the notes of a schedule are read without a join, and no unit's rows are kept."""
    pages = store.settled(legacy_views.printed_rows(spark, SMALL).limit(100_000).repartition("report", "page"), "pages-test", "report", "page")
    tops = legacy_views.layouts(pages)
    assert "Exchange hashpartitioning" not in plan(pages.join(tops.hint("merge"), ["report", "page"]))
    given = [(1, 1, 1, r, 40.0, 10.0 * r, False, t) for r, t in enumerate(("ahead", "1. ONE: first", "more", "2. two", "9. not a note", "3. three"))]
    held = spark.createDataFrame(given, "report long, n int, page long, row long, x0 double, y0 double, bold boolean, text string")
    found = legacy.note_items(held)
    assert rows(found.select("number", "row", "digest")) == [(1, 1, "ONE: first more"), (2, 3, "two 9. not a note"), (3, 5, "three")]
    assert "Join" not in plan(found)
