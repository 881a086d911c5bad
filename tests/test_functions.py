import pytest
from pyspark.sql import functions as F

from quillspark.functions import figures as fig
from quillspark.functions import text as tx
from quillspark.functions import words as wd


def one(spark, value, use, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(use(F.col("v")).alias("x")).first().x


@pytest.mark.parametrize(
    ("raw", "value", "nil"),
    [("1,198.28", 1198.28, False), ("5,95,11,000", 59511000.0, False), ("(1,828)", -1828.0, False), ("$10,622", 10622.0, False), ("₹ 215.24", 215.24, False),
     ("—", 0.0, True), ("–", 0.0, True), ("-", 0.0, True), ("––", 0.0, True), ("Nil", 0.0, True), ("(.17)", -0.17, False), ("11,57,05.424", None, False), ("728,00[?]", None, False), ("n.a.", None, False), ("", None, False), ("12%", 12.0, False), ("-5", -5.0, False), ("(", None, False), (".", None, False)],
)
def test_parse_value(spark, raw, value, nil):
    got = one(spark, raw, fig.parse_value)
    assert (got.value, got.nil) == (value, nil)


def test_parse_value_of_null(spark):
    assert one(spark, None, fig.parse_value).value is None


@pytest.mark.parametrize(
    ("heading", "fiscal", "end", "label"),
    [("Year ended March 31, 2026", (3, 31), "2026-03-31", "FY2026"), ("2024", (12, 31), "2024-12-31", "FY2024"), ("Balance as on April 1, 2025", (3, 31), "2025-04-01", "2025-04-01"),
     ("Previous Year Rs.", (3, 31), None, "previous year"), ("FY 2025-26", (3, 31), "2026-03-31", "FY2026"), ("Securities premium", (3, 31), None, None), ("31st December, 1999", None, "1999-12-31", "1999-12-31"), ("As at 2024", None, None, "FY2024"), (None, None, None, None)],
)
def test_parse_period(spark, heading, fiscal, end, label):
    got = one(spark, heading, lambda c: fig.parse_period(c, fiscal))
    assert (got.period_end, got.period_label) == (end, label)


@pytest.mark.parametrize(("cell", "amount"), [("$ 46,002,417", 46002417.0), ("(332,319)", -332319.0), ("34.456", 34456.0), ("-", 0.0), ("**12**", 12.0), ("728,00[?]", None), ("total", None), ("", None)])
def test_parse_amount(spark, cell, amount):
    assert one(spark, cell, fig.parse_amount) == amount


@pytest.mark.parametrize(
    ("text", "found"),
    [("₹16,812 crore", [(16812e7, "INR")]), ("US$1.2 billion", [(1.2e9, "USD")]), ("₹12.2 lakh crore", [(12.2e12, "INR")]), ("₹2 each", []), ("$5M and €3 million", [(5e6, "USD"), (3e6, "EUR")])],
)
def test_money(spark, text, found):
    got = one(spark, text, fig.money_figures)
    assert [(pytest.approx(x.amount), x.currency) for x in got] == found


@pytest.mark.parametrize(("unit", "currency", "scale"), [("In ₹ Million", "INR", 1e6), ("Rs. in crore", "INR", 1e7), ("(in millions of U.S. dollars)", "USD", 1e6), (None, None, None)])
def test_statement_unit(spark, unit, currency, scale):
    got = one(spark, unit, fig.statement_unit)
    assert (got.currency, got.scale) == (currency, scale)


def test_close_allows_one_in_the_last_digit(spark):
    rows = spark.createDataFrame([(100.0, 101.0, "101"), (100.0, 102.0, "102"), (1.05, 1.06, "1.06"), (1.05, 1.07, "1.07")], "t double, p double, raw string")
    assert [r.x for r in rows.select(fig.close(F.col("t"), F.col("p"), F.col("raw")).alias("x")).collect()] == [True, False, True, False]


def test_stemmers_differ(spark):
    assert one(spark, "The company's duties, boxes and class policies", wd.retrieval_tokens) == ["duty", "boxe", "class", "policy"]
    assert sorted(one(spark, "Deferred tax assets (net)", wd.link_words)) == ["asset", "deferred", "tax"]
    assert one(spark, "How did employee benefits change?", wd.question_words) == ["did", "employee", "benefit"]
    assert one(spark, "Profit before tax", wd.label_words) == ["profit"]


@pytest.mark.parametrize(("title", "kind"), [("Item 1A. Risk Factors", "risk"), ("Item 3. Legal Proceedings", "legal"), ("Item 3. Key Information", "highlights"), ("Management’s Discussion and Analysis", "mdna"), (None, "other"), ("Zebra", "other")])
def test_kind_of(spark, title, kind):
    assert one(spark, title, wd.kind_of) == kind


def test_query_terms_weigh_synonyms_less():
    terms = wd.query_terms("What is the outlook for CV exports?")
    assert terms["cv"] == 1.0 and terms["export"] == 1.0 and terms["truck"] == 0.6 and terms["guidance"] == 0.6


def test_text(spark):
    assert one(spark, "N O T E S", tx.despace) == "NOTES"
    assert one(spark, "TYPE-2", tx.natural_key) < one(spark, "TYPE-10", tx.natural_key)
    assert one(spark, "INVESTMENTS OF THE  U.S. Group (at Cost)", tx.title_case) == "Investments of the U.S. Group (at Cost)"
    assert one(spark, "SCHEDULES forming part of the accounts Rs. Rs", tx.clean_title) == "Schedules"
    assert one(spark, "The Company (Contd.) & Co.", tx.norm_heading) == "the company & co."
    assert one(spark, "The Insurance Company", tx.entity_key) == "report"
    assert one(spark, "!", tx.slug) == "N-SECTION"
    assert one(spark, ["infor-", "mation on", "cash"], tx.join_lines, "array<string>") == "information on cash"
    assert one(spark, "ﬁx `5", lambda c: tx.clean_text(c)) == "fix ₹5"
    assert one(spark, "Risk, and Return on Capital!", tx.slug) == "N-RISK-AND-RETURN-ON-CAPITAL"
