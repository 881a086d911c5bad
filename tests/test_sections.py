"""Section maps against contents, headers and outlines whose sections are known."""

from pyspark.sql import functions as F

from quillspark.operators import sections

SEGMENTS = "report long, page long, seg long, x0 double, y0 double, x1 double, y1 double, t string, size double, bold boolean"


def printed(spark, lines, wide=5.0):
    """Segments from (page, x, y, text, size, bold)."""
    rows = [(1, p, k, float(x), float(y), x + wide * len(t), float(y + size), t, float(size), bold) for k, (p, x, y, t, size, bold) in enumerate(lines)]
    return spark.createDataFrame(rows, SEGMENTS)


def sizes(spark, *pages):
    return spark.createDataFrame([(1, p, 600.0, 800.0) for p in pages], "report long, page long, width double, height double")


def entries(spark, lines, pages=(2,)):
    got = sections.parse_contents(printed(spark, lines), sizes(spark, *pages)).orderBy("page", "n").collect()
    return [(r.title, r.printed, r.grp) for r in got]


def test_contents_with_leaders_under_a_list_of_directors(spark):
    lines = [(2, 40, 100, "R. Rao, Chairman", 10, False), (2, 40, 400, "CONTENTS", 12, True)]
    lines += [(2, 40, 430 + 14 * k, f"{t} {'. ' * 8} {p}", 10, False) for k, (t, p) in enumerate((("Board of Directors", "1"), ("Letter", "2 - 4"), ("Risk Factors", "5"), ("Notes", "A-6"), ("Index of terms", "77")))]
    assert entries(spark, lines) == [("Board of Directors", "1", None), ("Letter", "2 - 4", None), ("Risk Factors", "5", None), ("Notes", "A-6", None), ("Index of terms", "77", None)]


def test_contents_in_two_columns_with_numbers_first(spark):
    lines = [(2, 40, 30, "Contents", 16, True), (2, 65, 60, "STATUTORY REPORTS", 10, True), (2, 365, 60, "PART II", 10, True)]
    for x, rows in ((40, ("Notice", "Our people and", "Board report")), (340, ("Results", "Outlook", "Auditors"))):
        for k, t in enumerate(rows):
            lines += [(2, x, 80 + 30 * k, f"{k + 3:02d}", 10, False), (2, x + 25, 80 + 30 * k, t, 10, False)]
    lines.append((2, 65, 122, "their safety,", 10, False))  # goes on from the title above it
    assert entries(spark, lines) == [
        ("Notice", "03", "STATUTORY REPORTS"), ("Results", "03", "PART II"), ("Our people and their safety", "04", "STATUTORY REPORTS"),
        ("Outlook", "04", "PART II"), ("Board report", "05", "STATUTORY REPORTS"), ("Auditors", "05", "PART II"),
    ]


def test_contents_with_numbers_last(spark):
    lines = [(2, 40, 30, "INDEX TO FORM 10-K", 12, True)]
    for k, t in enumerate(("Business", "Risk Factors", "Properties", "Legal Proceedings", "Controls")):
        lines += [(2, 40, 80 + 20 * k, f"ITEM {k + 1}.", 10, False), (2, 100, 80 + 20 * k, t, 10, False), (2, 500, 80 + 20 * k, str(k + 9), 10, False)]
    assert entries(spark, lines) == [(f"ITEM {k + 1}. {t}", str(k + 9), None) for k, t in enumerate(("Business", "Risk Factors", "Properties", "Legal Proceedings", "Controls"))]
    assert entries(spark, lines[:13]) == []  # four are none
    assert entries(spark, [(p, x, y, "Chapters" if s == 12 else t, s, b) for p, x, y, t, s, b in lines]) and not sections.parse_contents(printed(spark, [(p, x, y, "Chapters" if s == 12 else t, s, b) for p, x, y, t, s, b in lines]), sizes(spark, 2)).where("titled").count()


def test_numbered_groups(spark):
    titles = ["1. Our assets", "1.1 Copper", "1.2 Iron", "2. People", "Other report", "1.1 Alone", "3. Plan", "3.1 Next"]
    df = spark.createDataFrame([(1, k, t, None) for k, t in enumerate(titles)], "report long, ord long, title string, grp string")
    got = [(r.title, r.grp) for r in sections.numbered_groups(df).orderBy("ord").collect()]
    assert got == [("1.1 Copper", "1. Our assets"), ("1.2 Iron", "1. Our assets"), ("2. People", None), ("Other report", None), ("1.1 Alone", None), ("3.1 Next", "3. Plan")]


def test_printed_numbers(spark):
    labels = spark.createDataFrame([(1, p, {9: "F-1"}.get(p), str(p - 4) if p > 4 and p != 7 else "77" if p == 7 else None) for p in range(1, 12)], "report long, page long, printed string, footer string")
    df = spark.createDataFrame([(1, x) for x in ("001", "3", "5-9", "F-1", "40", "x")], "report long, printed string")
    got = {r.printed: r.start for r in sections.PageFinder(labels).pages(df).collect()}
    assert got == {"001": 5, "3": 7, "5-9": 9, "F-1": 9, "40": 44, "x": None}


def test_header_runs(spark):
    pages = {1: ["Acme 2020"], 2: ["Acme 2020", "STATUTORY REPORTS", "Board report"], 3: ["Acme 2020", "12"], 4: ["Acme 2020", "Board report"], 5: ["Acme 2020", "Risk"], 6: ["Acme 2020", "Risk"], 9: ["Acme 2020", "Risk"], 10: ["Acme 2020", "Once"], 11: ["Acme 2020"], 12: ["Acme 2020"]}
    df = spark.createDataFrame([(1, p, k, line) for p, lines in pages.items() for k, line in enumerate(lines)] + [(None, 1, 0, "x"), (1, None, 0, "y")], "report long, page long, place int, line string")
    groups = spark.createDataFrame([(1, "Statutory reports")], "report long, title string")
    got = sections.header_runs(df, groups).orderBy("first").collect()
    assert [(r.title, r["first"], r["last"]) for r in got] == [("Board report", 2, 4), ("Risk", 5, 6)]


def test_outlines(spark):
    toc = [(1, "Part I", 1), (2, "Business", 2), (2, "Risk  factors", 4), (3, "deep", 5), (1, "Alone", 8), (1, "Part II", 9), (2, "Data", 9), (2, "nowhere", 0)]
    df = spark.createDataFrame([(1, k, *x) for k, x in enumerate(toc)], "report long, seq long, level int, title string, page long")
    got = [(r.title, r.start, r.grp) for r in sections.bookmark_entries(df).orderBy("ord").collect()]
    assert got == [("Business", 2, "Part I"), ("Risk factors", 4, "Part I"), ("Alone", 8, None), ("Data", 9, "Part II")]
    assert sections.bookmark_entries(df.where("seq < 2")).count() == 0


def test_items_and_headings(spark):
    body = [(p, 50, 300 + 12 * k, "plain text of the page that goes on", 10, False) for p in range(1, 9) for k in range(4)]
    segments = printed(spark, [*body, (2, 50, 40, "Item 7. MD&A", 10, True), (3, 300, 40, "Item 8. too far right", 10, True), (4, 50, 40, "Report of the", 16, True), (4, 50, 58, "auditors.", 16, True), (5, 50, 40, "Report of the auditors", 16, True), (8, 50, 40, "Report of the auditors", 16, True), (6, 50, 600, "Low down", 16, True)])
    pages = sizes(spark, *range(1, 9))
    assert [(r.item, r.start) for r in sections.item_headings(segments, pages).collect()] == [("7", 2)]
    assert [(r.title, r.start) for r in sections.heading_entries(segments, pages).orderBy("ord").collect()] == [("Report of the auditors", 4), ("Report of the auditors", 8)]


def test_map_takes_the_first_source(spark):
    counts = spark.createDataFrame([(1, 20), (2, 9), (3, 5)], "report long, page_count long")
    entry = "report long, ord long, title string, start long, grp string"
    contents = spark.createDataFrame([(1, 1, "Letter", 3, None), (1, 2, "Assets", 5, "Review"), (1, 3, "Risk", 9, "Review"), (1, 4, "Letter", 15, None)], entry)
    headings = spark.createDataFrame([(1, 1, "Other", 2, None), (2, 1, "Only", 1, None)], entry)
    got = sections.section_map(counts, contents=contents, heading=headings)
    rows = [(r.report, r.id, r.parent_id, r.level, r.start_page, r.end_page, r.source) for r in got.orderBy("report", "seq").collect()]
    assert rows == [
        (1, "N-FRONT-MATTER", None, 1, 1, 2, "fallback"), (1, "N-LETTER", None, 2, 3, 4, "contents"), (1, "N-REVIEW", None, 1, 5, 14, "contents"), (1, "N-ASSETS", "N-REVIEW", 2, 5, 8, "contents"),
        (1, "N-RISK", "N-REVIEW", 2, 9, 14, "contents"), (1, "N-LETTER-2", None, 2, 15, 20, "contents"), (2, "N-ONLY", None, 2, 1, 9, "heading"),
    ]
    assert {r.report: (r.once, r.depth) for r in sections.cover(got, counts).collect()} == {1: (True, 2), 2: (True, 1)}
    runs = spark.createDataFrame([(1, "RISK", 12), (1, "Our Assets & more", 5), (1, "Unknown", 2)], "report long, title string, start long")
    said = {(r.id, r.page, r.warns) for r in sections.confirmations(got, running_header=runs).collect()}
    assert said == {("N-RISK", 12, True)}


def test_titles_that_mean_the_same(spark):
    cases = [("Board's Report", "BOARD’S REPORT", True), ("Governance", "Report on Corporate Governance", False), ("Corporate Governance", "Report on Corporate Governance", True), ("Risk & return", "Risk and return", True), ("", "x", False), ("a b c d", "a b c e", True), ("a b c", "a b d", False)]
    df = spark.createDataFrame(cases, "a string, b string, same boolean")
    assert all(r.got == r.same for r in df.withColumn("got", sections.same_title(F.col("a"), F.col("b"))).collect())
