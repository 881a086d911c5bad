"""Transcribed pages against blocks and rows that are known."""

from quillspark.operators import layout, markdown

PAGE = """# NATIONAL COMPANY
### EXHIBIT 1

First line
of a paragraph
| Item | Note | 1999 |
|:---|---|---:|
| **Assets** | | |
| Land | 3 | 1,200 |
| Tools | 4 | (35) |
| | | 1,165 |
- one
* two

1. three
12) four
text after
||lonely||
"""


def pages(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "page long, text string")


def test_blocks(spark):
    rows = markdown.blocks(pages(spark, PAGE, None, "", "\n\n")).orderBy("page", "place").collect()
    assert [(r.page, r.kind, r.level, r.text, r["items"]) for r in rows] == [
        (0, "heading", 1, "NATIONAL COMPANY", None), (0, "heading", 2, "EXHIBIT 1", None), (0, "paragraph", None, "First line of a paragraph", None), (0, "table", None, None, None),
        (0, "list", None, None, ["one", "two"]), (0, "list", None, None, ["three", "four"]), (0, "paragraph", None, "text after", None), (0, "table", None, None, None),
    ]
    assert rows[3].head == [["Item", "Note", "1999"]] and rows[3].rows[1:] == [["Land", "3", "1,200"], ["Tools", "4", "(35)"], ["", "", "1,165"]]
    assert (rows[7].head, rows[7].rows) == ([], [["lonely"]])


def test_coverage(spark):
    df = pages(spark, PAGE, "a | b\n# x\n- y")
    found = markdown.blocks(df)
    assert all(r.covered for r in layout.coverage(markdown.plain_lines(df), found).collect())
    assert {r.page for r in layout.coverage(markdown.plain_lines(df), found.where("kind <> 'list'")).collect() if not r.covered} == {0, 1}


def test_table_rows(spark):
    found = markdown.blocks(pages(spark, PAGE, "| a | b |\n| Sum of it: | |\n| x | **77** |\n| y | |"))
    rows = markdown.table_rows(found, spark.createDataFrame([(1, "77")], "page long, figure string")).orderBy("page", "place", "row").collect()
    assert [(r.page, r.kind, r.label, r.cells, r.notes_col) for r in rows] == [
        (0, "header", "Item", ["Note", "1999"], 0), (0, "section", "Assets", [], 0), (0, "data", "Land", ["3", "1,200"], 0), (0, "data", "Tools", ["4", "(35)"], 0), (0, "total", "", ["", "1,165"], 0),
        (0, "header", "lonely", [], None), (1, "header", "a", ["b"], 0), (1, "section", "Sum of it:", [], 0), (1, "total", "x", ["77"], 0), (1, "text", "y", [], 0),
    ]
