"""Statement tables from positioned cells: one page by hand, and random pages against a plain reading of the same rules."""

import random

from pyspark.sql import functions as F

from quillspark.operators import tables

SCHEMA = "page long, title string, row long, x0 double, x1 double, text string"


def right(row, *figures):
    return [(row, x1 - 5 * len(t), x1, t) for x1, t in figures]


def left(row, text, x0=40.0):
    return [(row, x0, x0 + 5 * len(text), text)]


def read(spark, cells, title="Balance Sheet"):
    df = spark.createDataFrame([(1, title, r, float(a), float(b), t) for r, a, b, t in cells], SCHEMA)
    out = tables.statement_tables(df, ["page"], "title").orderBy("part", "place").collect()
    return [(r.part, r.kind, r.label, list(r.cells) or [tuple(s) for s in r.spans], r.notes_col) for r in out]


def test_page_by_hand(spark):
    cells = [
        *left(0, "Balance  Sheet (Contd.)"),
        *left(1, "In ₹ Million", 300),
        (2, 395.0, 460.0, "As at March 31,"),
        *left(3, "Particulars"), (3, 275.0, 303.0, "Notes"), *right(3, (380, "2026"), (460, "2025")),
        *left(4, "ASSETS"),
        *left(5, "Property, plant and"), *right(5, (300, "3"), (380, "1,250"), (460, "1,100")),
        *left(6, "equipment"),
        *left(7, "Loans"), *right(7, (300, "12"), (372, "$"), (380, "40"), (460, "—")),
        *left(8, "(Refer note 12)"),
        *right(9, (381, "1,290"), (461, "1,100")),
        *left(10, "A. OTHER EQUITY"),
        *left(11, "- Other Comprehensive"), *right(11, (420, "7")),
        *left(12, "Income/(Loss)"),
        *left(13, "Net cash"), *right(13, (420, "(7)")),
        *left(14, "As per our report attached"),
        *left(15, "Partner"), *right(15, (420, "99")),
    ]
    assert read(spark, cells) == [
        (0, "unit", "₹ in Million", [], 0),
        (0, "header", "", ["", "", "As at March 31,"], 0),
        (0, "data", "Particulars Notes", ["", "2026", "2025"], 0),
        (0, "section", "ASSETS", [], 0),
        (0, "data", "Property, plant and equipment", ["3", "1,250", "1,100"], 0),
        (0, "data", "Loans (Refer note 12)", ["12", "40", "—"], 0),
        (0, "total", "", ["", "1,290", "1,100"], 0),
        (1, "section", "A. OTHER EQUITY", [], None),
        (1, "data", "- Other Comprehensive Income/(Loss)", ["7"], None),
        (1, "total", "Net cash", ["(7)"], None),
    ]


def test_bands_stack_and_groups_widen(spark):
    cells = [
        (0, 255.0, 400.0, "Owners of the Company"),
        (1, 165.0, 200.0, "Share"), (1, 265.0, 300.0, "Non-"),
        (2, 165.0, 200.0, "capital"), (2, 240.0, 300.0, "controlling"),
        *left(3, "Opening"), *right(3, (200, "1,000"), (300, "2,000"), (400, "3,000"), (500, "4,000"), (600, "5,000")),
    ]
    assert read(spark, cells) == [
        (0, "group", "", [(4, "Owners of the Company"), (1, "")], None),
        (0, "header", "", ["Share capital", "Non-controlling", "", "", ""], None),
        (0, "data", "Opening", ["1,000", "2,000", "3,000", "4,000", "5,000"], None),
    ]


def test_pages_without_figures_cells_or_rows(spark):
    assert read(spark, [*left(0, "Auditors:"), *left(1, "wrote this")]) == [(0, "section", "Auditors:", [], None), (0, "text", "wrote this", [], None)]
    empty = spark.createDataFrame([(1, None, None, 1.0, 2.0, "5"), (1, None, 1, 1.0, 2.0, None)], SCHEMA)
    assert tables.statement_tables(empty, ["page"], "title").count() == 0
    assert tables.statement_tables(empty.limit(0), ["page"]).count() == 0


def plain_columns(edges):
    """Right edges in order; one within 6 points of the last edge of a column is of that column."""
    found = []
    for x1, x0 in sorted(edges):
        if found and x1 - found[-1][0] <= 6:
            found[-1] = (x1, min(x0, found[-1][1]))
        else:
            found.append((x1, x0))
    return found


def test_random_figures_fall_in_their_columns(spark):
    rng = random.Random(5)
    cells, want = [], {}
    for page in range(30):
        rows = [[(rng.choice([200, 206, 209, 300, 304, 420]) + rng.random(), f"{rng.randrange(10**6):,}") for _ in range(rng.randrange(1, 4))] for _ in range(8)]
        edges = [(x, x - 5 * len(t)) for row in rows for x, t in row]
        found = plain_columns(edges)
        for n, row in enumerate(rows):
            cells += [(page, None, n, 40.0, 80.0, "Line"), *[(page, None, n, x - 5 * len(t), x, t) for x, t in row]]
            texts = [[] for _ in found]
            for x, t in sorted(row, key=lambda c: (c[0] - 5 * len(c[1]), c[0])):
                texts[min(range(len(found)), key=lambda i: abs(found[i][0] - x))].append(t)
            want[page, n + 1] = [" ".join(t) for t in texts]
    got = tables.statement_tables(spark.createDataFrame(cells, SCHEMA), ["page"]).where(F.col("kind") == "data").collect()
    assert {(r.page, r.place): list(r.cells) for r in got} == want
