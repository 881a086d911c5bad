import collections
import unicodedata

import pytest
from pyspark.sql import functions as F

from quillspark.functions import text as tx
from quillspark.operators import checks, layout, links, passages, retrieval, sequences
from quillspark.sources import scans, sinks


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_references_fall_back_to_leading_digits(spark):
    lines = spark.createDataFrame([("L1", "s", "5"), ("L2", "s", "5(a)"), ("L3", "s", "99"), ("L4", "s", None), ("L5", "t", "5")], "id string, section_id string, note_ref string")
    notes = spark.createDataFrame([("s", "C5", 5)], "section_id string, id string, number int")
    assert rows(links.references(lines, notes)) == [("L1", "C5"), ("L2", "C5")]


def test_ties_need_a_long_figure_or_two(spark):
    lines = spark.createDataFrame([("a", "s"), ("b", "s")], "id string, section_id string")
    parsed = spark.createDataFrame([("a", "1,234", 1234.0, False), ("b", "12,345", 12345.0, False), ("b", "—", 0.0, True)], "line_id string, raw string, value double, nil boolean")
    notes = spark.createDataFrame([("s", "n1", "1,234"), ("s", "n1", "12,345"), ("s", "n2", "12,345.00")], "section_id string, note_id string, raw string")
    assert rows(links.ties_to(lines, parsed, notes).drop("key")) == [("b", "n1", "medium"), ("b", "n2", "medium")]


def test_edit_one(spark):
    a = spark.createDataFrame([(x,) for x in ("12345", "99999", "1234", "77", "12346")], "f string")
    b = spark.createDataFrame([("12345",), ("779",)], "f string")
    assert [r.f for r in links.edit_one_unmatched(a, b, "f").collect()] == ["99999"]


def test_subtotals(spark):
    data = [("s", 1, "data", 5.0), ("s", 2, "data", 6.0), ("s", 3, "total", 11.0), ("s", 4, "data", 1.0), ("s", 5, "data", 1.0), ("s", 6, "total", 9.0)]
    df = spark.createDataFrame(data, "statement string, seq int, kind string, v double").select("statement", "seq", "kind", F.create_map(F.lit(1), "v").alias("values"), F.create_map(F.lit(1), F.col("v").cast("string")).alias("raws"))
    assert [(r.seq, r.status) for r in checks.subtotals(df).orderBy("seq").collect()] == [(3, "ok"), (6, "unverified")]


def test_subtotals_since_the_heading(spark):
    """A total that holds stands for its lines further down; a heading starts anew."""
    data = [(1, "data", 5.0), (2, "data", 6.0), (3, "total", 11.0), (4, "data", 1.0), (5, "total", 12.0), (6, "heading", None), (7, "data", 2.0), (8, "total", 2.0)]
    df = spark.createDataFrame([("s", *r) for r in data], "statement string, seq int, kind string, v double")
    df = df.select("statement", "seq", "kind", F.create_map(F.lit(1), "v").alias("values"), F.create_map(F.lit(1), F.col("v").cast("string")).alias("raws"))
    assert [(r.seq, r.n_lines, r.status) for r in checks.subtotals(df).orderBy("seq").collect()] == [(3, 2, "ok"), (5, 2, "ok")]


def test_labels_cite_notes_and_schedules(spark):
    cases = {"Investments (notes 5 and 6) (Schedule XVII)": ["5", "6", "XVII"], "Scheduled payments": [], "Notes payable": [], "Loans, Schedule 'E'": ["E"], "Cash (Refer Note No. 15)": ["15"], "Tax (note 3, 3 & 4)": ["3", "4"]}
    df = spark.createDataFrame([(k,) for k in cases], "label string")
    assert {r.label: r.c for r in df.select("label", links.cited_units(F.col("label")).alias("c")).collect()} == cases


def test_only_figures_that_statements_repeat_are_carried(spark):
    lines = spark.createDataFrame([("a", "s", "u1", " Net income:"), ("b", "s", "u2", "NET INCOME"), ("c", "s", "u3", "Revenue"), ("d", "s", "u1", "Revenue"), ("e", "t", "u4", "Net income")], "id string, section_id string, unit_id string, label string")
    parsed = spark.createDataFrame([(i, p, v, f"{v:.1f}") for i, p, v in [("a", "FY1", 1.0), ("a", "FY2", 2.0), ("b", "FY1", 1.05), ("b", "FY2", 3.0), ("c", "FY1", 1.0), ("d", "FY1", 1.0), ("e", "FY1", 1.0), ("b", None, 9.0)]], "line_id string, period_label string, value double, raw string")
    figures = links.carry_figures(lines, parsed)
    assert rows(links.carried(figures, figures)) == [("a", "b", 2, False, "FY1 1.0, FY2 2.0")]


def test_balance_by_labels(spark):
    cells = [("u", "1", 1, "Total  assets", 1, 10.0, "10"), ("u", "2", 2, "Total liabilities", 1, 4.0, "4"), ("u", "3", 3, "Total liabilities and shareholders' equity", 1, 10.4, "10.4"), ("u", "4", 4, "Total equity and liabilities", 1, 99.0, "99"), ("v", "5", 1, "Total assets", 1, 1.0, "1")]
    df = spark.createDataFrame(cells, "unit_id string, line_id string, seq int, label string, col int, value double, raw string")
    assert rows(checks.balances(*checks.balance_sides(df))) == [("u", "1", 1, "fail")]


def test_numbered_over_ranges(spark):
    df = spark.range(500).select((F.col("id") * 7 % 13).alias("k"), "id").repartition(5)
    got = {r.id: r.place for r in sequences.numbered(df, "k", "id").collect()}
    assert got == {i: n + 1 for n, (_, i) in enumerate(sorted((i * 7 % 13, i) for i in range(500)))}
    assert sequences.numbered(df.limit(0), "k", "id").count() == 0


def test_accepted_steps(spark):
    df = spark.createDataFrame([("g", i, n) for i, n in enumerate([3, 5, 50, 6, 2, 10, 11])], "g string, o int, n long")
    assert sequences.accepted_steps(df, "g", "o", "n", 4).first().accepted == [3, 5, 6, 10, 11]


def test_runs_and_fill(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 2, "x"), ("a", 5, "x"), ("a", 3, None)], "g string, p int, k string")
    assert rows(sequences.runs(df.where("k is not null"), ["g"], "p", "k", 2))[0][2:] in {(1, 2, 2), (5, 5, 1)}
    assert [r.f for r in df.select("p", sequences.fill_both(df, ["g"], "p", "k").alias("f")).orderBy("p").collect()] == ["x"] * 4


def test_deepest_cover(spark):
    points = spark.createDataFrame([("g", 5), ("g", 70), ("g", 500)], "group string, place long")
    spans = spark.createDataFrame([("g", 1, 0, 100, 1, 1), ("g", 2, 60, 80, 2, 2)], "group string, id int, start long, end long, level int, seq int")
    assert rows(sequences.deepest_cover(points, spans, 64)) == [("g", 5, 1), ("g", 70, 2)]


def test_budget_skips_what_does_not_fit(spark):
    df = spark.createDataFrame([("g", 1, 90), ("g", 2, 20), ("g", 3, 10), ("h", 1, 500)], "g string, o long, s long")
    assert rows(retrieval.budget_fill(df, "g", "o", "s", "o", 100)) == [("g", [1, 3]), ("h", [1])]


BLOCKS = "doc_id long, seq long, page long, kind string, text string, title string, parent string"


def test_passages_are_named_by_their_headings(spark):
    long = "x" * 1600
    blocks = [(0, "heading", "Indian Economy"), (1, "text", "short"), (2, "heading", "Outlook"), (3, "text", long), (4, "heading", "and so on, softer"), (5, "heading", "Risk"), (6, "heading", "Credit"), (7, "text", long * 4), (8, "text", long * 2), (9, "heading", "End"), (10, "text", "e")]
    rows_ = spark.createDataFrame([(1, s, s // 4 + 1, k, t, None, None) for s, k, t in blocks] + [(2, 1, 1, "text", "a", None, None), (3, 1, 7, "heading", "Risk report", "Risk", "Annual"), (3, 2, 7, "text", "paid $5 million and\tmore", "Risk", "Annual")], BLOCKS)
    heads = rows_.withColumn("heading", (F.col("kind") == "heading") & passages.real_heading(F.col("text"), F.col("title")))
    pieces = passages.pieces(heads).where("doc_id = 1").orderBy("first")
    assert [(r.heads, r.part, r["first"]) for r in pieces.collect()] == [(["Indian Economy"], 1, 0), (["Outlook"], 1, 2), (["Risk · Credit"], 1, 5), (["Risk", "Credit"], 2, 8), (["End"], 1, 9)]
    found = {(r.doc_id, r.passage): r for r in passages.passages(rows_).collect()}
    assert [(found[1, k].path, found[1, k].first_seq, found[1, k].last_seq) for k in (1, 2, 3)] == [("Indian Economy · Outlook", 0, 4), ("Risk · Credit", 5, 7), ("Risk › Credit (part 2)", 8, 10)]
    assert (found[2, 1].first_seq, found[2, 1].last_seq, found[2, 1].text) == (1, 1, "--- PDF page 1 ---\n\na") and len(found) == 5
    own = found[3, 1]  # the section's own title names no passage
    assert (own.path, own.id, own.lead, own.text, [f.amount for f in own.figures]) == ("Annual › Risk", "P-Risk-01", "Risk report paid $5 million and more", "--- PDF page 7 ---\n\nRisk report\n\npaid $5 million and\tmore", [5e6])
    assert found[1, 1].text.startswith("--- PDF page 1 ---\n\nIndian Economy\n\nshort\n\nOutlook\n\nx") and "\n\n--- PDF page 2 ---\n\nand so on" in found[1, 1].text
    assert passages.passages(rows_.limit(0)).count() == 0


def test_tie_outs(spark):
    cells = [(1, 0, 1, k, label, str(v), v) for k, (label, v) in enumerate([("a", 5.0), ("b", 7.0), ("Total", 12.0), ("c", 3.0), ("Total", 99.0)])]
    df = spark.createDataFrame(cells, "page long, tbl long, col long, row long, label string, figure string, value double")
    assert [(r.row, r.status) for r in checks.tie_outs(df).orderBy("row").collect()] == [(2, "tied"), (4, "untied")]


def nodes(spark, boxes):
    return spark.createDataFrame([(p, "page", f"{k:05d}", *map(float, b)) for p, k, *b in boxes], "page long, container string, node string, x0 double, y0 double, x1 double, y1 double")


def test_reading_order(spark):
    df = nodes(spark, [(1, 0, 0, 0, 600, 20), (1, 1, 0, 40, 280, 300), (1, 2, 320, 40, 600, 160), (1, 3, 320, 170, 600, 300)])
    assert [r.node for r in layout.reading_order(df).orderBy("place").collect()] == ["00000", "00001", "00002", "00003"]


def test_row_clusters_compare_to_the_first(spark):
    df = spark.createDataFrame([(1, 0, 0.0, 0.0), (1, 1, 2.0, 1.0), (1, 2, 4.0, 0.0)], "page long, seg long, y0 double, x0 double").withColumn("y1", F.col("y0"))
    assert [r.row for r in layout.rows_of_page(df).orderBy("seg").collect()] == [0, 0, 1]


def test_page_spec():
    assert scans.page_spec("405-407, 410,406") == [405, 406, 407, 410]
    for bad in ("x", "9-3", "1-500"):
        with pytest.raises(ValueError):
            scans.page_spec(bad)


def test_package_round_trip(spark, tmp_path):
    root = str(tmp_path / "store")
    one = spark.createDataFrame([("", "L1", "s", "u", 1, 1, "x", "data", None)], scans.LINES)
    sinks.write_package({"lines": one}, root, "r1")
    sinks.write_package({"lines": one.withColumn("label", F.lit("y"))}, root, "r2")
    sinks.write_package({"lines": one.withColumn("label", F.lit("z"))}, root, "r1")
    assert sorted((r.report_id, r.label) for r in scans.package_table(spark, root, "lines").collect()) == [("r1", "z"), ("r2", "y")]
    assert scans.package_table(spark, root, "checks").count() == 0
    with pytest.raises(ValueError):
        scans.read_only_query(spark, "drop table x")


def test_upsert_and_latest(spark):
    now = spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int")
    assert rows(sinks.upsert(now, spark.createDataFrame([("b", 9)], "k string, v int"), "k")) == [("a", 1), ("b", 9)]
    events = spark.createDataFrame([("f", 1, "open"), ("f", 2, "fixed")], "f string, at int, status string")
    assert rows(sinks.latest_state(events, "f", "at", "status")) == [("f", "fixed")]


def test_tie_outs_across_columns(spark):
    """Equity in the outer column is the difference of two figures of the inner one; what took part is confirmed."""
    cells = [(1, 0, c, r, label, f"{v:,.0f}", v) for r, (label, c, v) in enumerate([("Capital", 1, 36782441.0), ("Less: treasury", 1, 577170.0), ("Total equity", 2, 36205271.0), ("Other", 2, 5.0)])]
    cells.append((1, 0, 2, 9, "**Total**", "36,205,277", 36205277.0))
    cells.append((1, 0, 3, 1, "Less: treasury", "7[?]", None))
    df = spark.createDataFrame(cells, "page long, tbl long, col long, row long, label string, figure string, value double")
    got = {(r.row, r.col): (r.status, r.parts) for r in checks.tie_outs(df).collect()}
    assert got == {(2, 2): ("tied", ["36205271", "36782441", "577170"]), (9, 2): ("untied", [])}


def test_notes_named_by_the_question_come_first(spark):
    ids = lambda *x: spark.createDataFrame([(i, k) for k, i in enumerate(x)], "id string, place int")
    scored = spark.createDataFrame([("a", 9), ("b", 5), ("c", 4), ("d", 5)], "id string, score long")
    assert [r.id for r in retrieval.select_notes(ids("z"), ids("h", "a", "y"), scored, 4).collect()] == ["z", "h", "a", "d"]


def test_tie_outs_of_all_orders(spark, tmp_path):
    from quillspark.plans import QUERIES

    source = "/root/testdata/sf0.001"
    spark.read.parquet(f"{source}/part.parquet").write.parquet(f"{tmp_path}/part.parquet")
    few = spark.read.parquet(f"{source}/lineitem.parquet").where("l_orderkey < 50")
    moved = few.withColumn("l_orderkey", F.col("l_orderkey") + 5000)
    few.unionByName(moved.select(few.columns)).write.parquet(f"{tmp_path}/lineitem.parquet")
    pages = [r.page for r in QUERIES["q5_tie_outs"](spark, str(tmp_path)).select("page").collect()]
    assert sorted(p for p in pages if p >= 5000) == sorted(p + 5000 for p in pages if p < 5000) and max(pages) >= 5000


def test_reading_order_of_many_boxes(spark):
    """1,500 bands down a page: each is a cut of its own."""
    boxes = nodes(spark, [(1, k, 0, k * 20, 50, k * 20 + 5) for k in range(1500)])
    assert all(r.place == int(r.node) for r in layout.reading_order(boxes).collect())


def test_page_specs_are_null_where_they_are_wrong(spark):
    cases = ["405-407, 410", "3", " 2 , 1-2,, ", "", "9-5", "1-102", "1-101", "x", "4, y", "1-2-3", "99999999999"]
    df = spark.createDataFrame([(c,) for c in cases], "spec string")
    for r in df.select("spec", scans.page_spec_column(F.col("spec")).alias("pages")).collect():
        try:
            want = scans.page_spec(r.spec)
        except ValueError:
            want = None
        if r.spec != "99999999999":
            assert r.pages == want, r.spec
        else:
            assert r.pages is None


DATA = "/root/testdata/sf0.001"


def test_clean_text_of_all_documents(spark):
    from quillspark.plans import QUERIES

    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    got = {r.doc_id: r.text for r in QUERIES["f15_clean_text"](spark, DATA).collect()}
    assert got == {i: t and unicodedata.normalize("NFKC", t).replace("`", "₹") for i, t in texts.items()}
    odd = spark.createDataFrame([("ﬁ ½ `5 Ａ",), (None,)], "t string").select(tx.clean_text("t").alias("t"))
    assert [r.t for r in odd.collect()] == ["fi 1⁄2 ₹5 A", None]


def test_row_clusters_of_all_events(spark):
    from quillspark.plans import QUERIES

    pages = collections.defaultdict(list)
    for r in spark.read.parquet(f"{DATA}/events.parquet").collect():
        pages[r.user_id].append((r.value * 10, float(r.event_id)))
    want = {}
    for page, spans in pages.items():
        row, first = -1, None
        for y, x in sorted(spans):
            if first is None or y > first + 3.0:
                row, first = row + 1, y
            want[page, x] = row
    assert {(r.page, r.x): r.row for r in QUERIES["w1_row_clusters"](spark, DATA).collect()} == want


def test_tie_outs_of_all_lines_by_brute_force(spark):
    """Each order's figures and their total: the total ties if some run of 2 to 20 figures above it gives it."""
    from quillspark.plans import QUERIES

    orders = collections.defaultdict(list)
    for r in QUERIES["d6_lines_values"](spark, DATA).where("col = 1").collect():
        orders[int(r.unit_id[1:])].append((r.line_id, r.value))
    got = {(r.page, r.row): r.status for r in QUERIES["q5_tie_outs"](spark, DATA).collect()}
    for page, own in orders.items():
        values = [v for _, v in sorted(own)]
        last = len(values) * 10 + 5
        if 2 <= len(values) <= 20 and not any((page, k * 10) in got for k in range(1, len(values) + 1)):
            assert got[page, last] == "tied", page
        if len(values) == 1:
            assert (page, last) not in got
