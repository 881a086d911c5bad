"""Printed figures, dates and periods as native column expressions.

Every function takes and returns columns, stays inside whole-stage code generation, and gives NULL for what
cannot be read: a figure that is unreadable (NULL), a printed dash (0 and nil) and a number are three things.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What a printed figure, date and unit may look like.
CURRENCY = r"^(?:Rs\.?|INR|US\$|\$|₹|`)\s*|\s*(?:Rs\.?|₹)$"
NIL = r"^(?:[-–—−]{1,2}|(?i:nil))$"
PLAIN = r"^(?:(?:Rs\.?|INR|US\$|\$|₹|`)\s*)?((?:[0-9]{1,3}(?:,[0-9]{3})+|[0-9]+)(?:\.[0-9]+)?)%?\z"
BRACKETED = r"^\(((?:[0-9]{1,3}(?:,[0-9]{3})+|[0-9]+)(?:\.[0-9]+)?)%?\)\z"
DASH = r"^[-–—−]{1,2}\z"
NUMBER = r"^([0-9]{1,3}(?:,[0-9]{3})+|[0-9]{1,2}(?:,[0-9]{2})+,[0-9]{3}|[0-9]+|)(\.[0-9]+)?$"
MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")
MONTH = r"(january|february|march|april|may|june|july|august|september|october|november|december|sept?|jan|feb|mar|apr|jun|jul|aug|oct|nov|dec)\.?"
MONTH_FIRST = rf"(?i){MONTH}\s+([0-9]{{1,2}}),?\s+([0-9]{{4}})"
DAY_FIRST = rf"(?i)([0-9]{{1,2}})(?:st|nd|rd|th)?\s+{MONTH},?\s+([0-9]{{4}})"
PREVIOUS = r"(?i)\bprevious\s+(?:year|period)\b"
YEAR_ONLY = r"(?i)^(?:FY\s*)?((?:19|20)[0-9]{2})$"
YEAR_LAST = r"\b((?:19|20)[0-9]{2})$"
FISCAL_RANGE = r"(?i)\bFY\s*'?((?:19|20)?[0-9]{2})\s*[-–/]\s*'?((?:19|20)?[0-9]{2})\b"
UNIT_PATTERNS = (
    r"(?i)\(?\s*(?:in\s+)?(?:millions|thousands|billions) of (?:U\.?S\.?\s+)?dollars[^)\n]*\)?",
    r"(?i)(?:₹|\bRs\.?|\bINR)\s*in\s*(?:million|crore|lakh|lac)s?",
    r"(?i)in\s*(?:₹|\bRs\.?|\bINR)\s*(?:million|crore|lakh|lac)s?",
    r"(?i)(?:₹|\bRs\.?)\s*(?:million|crore|lakh)s?",
    r"(?i)(?:U\.S\.|Canadian)\s+dollars\s+in\s+(?:millions|thousands|billions)",
    r"\bUS\$M\b",
)
UNIT_SCALES = ((r"crore", 1e7), (r"lakh|lac", 1e5), (r"billion|\bbn\b|\$b\b", 1e9), (r"million|\bmn\b|\$m\b|\bm\b", 1e6), (r"thousand|\b000s?\b|\$k\b", 1e3))
UNIT_CURRENCIES = (
    (r"₹|\brs\b|inr|rupee", "INR"), (r"u\.?s\.?\s*dollar|us\$|usd|\$", "USD"), (r"canadian dollar|c\$|cad", "CAD"),
    (r"a\$|aud|australian dollar", "AUD"), (r"€|euro", "EUR"), (r"£|sterling|gbp", "GBP"),
)
#: Figures of a transcribed page: grouped in threes by comma or dot, or four digits and more.
PAGE_FIGURE = r"\(?-?\$?\s?[0-9]{1,3}(?:[,.][0-9]{3})+(?:\.[0-9]{1,2})?\)?|\(?-?\$?[0-9]{4,}(?:\.[0-9]{1,2})?\)?"
MONEY = (
    r"(?i)(US\$|A\$|C\$|₹|Rs\.?|INR|\$|€|£)\s?([0-9][0-9,]*(?:\.[0-9]+)?)\s*"
    r"(lakh\s+crores?|crores?|cr\b\.?|lakhs?|lacs?|trillion|billion|bn\b|million|mn\b|thousand|[MBK]\b)?"
)
MONEY_CURRENCIES = {"us$": "USD", "$": "USD", "a$": "AUD", "c$": "CAD", "₹": "INR", "rs": "INR", "rs.": "INR", "inr": "INR", "€": "EUR", "£": "GBP"}
MONEY_SCALES = {
    "crore": 1e7, "crores": 1e7, "cr": 1e7, "lakh": 1e5, "lakhs": 1e5, "lac": 1e5, "lacs": 1e5, "trillion": 1e12,
    "billion": 1e9, "bn": 1e9, "b": 1e9, "million": 1e6, "mn": 1e6, "m": 1e6, "thousand": 1e3, "k": 1e3,
}
LEAST_MONEY = 1e6


def let(value: Column, use) -> Column:
    """``use`` of a value that is computed once, however often it is named."""
    return F.get(F.transform(F.array(value), use), 0)


def parse_value(raw: Column) -> Column:
    """struct(value double, nil boolean) of a printed figure; an impossible grouping has no value.

    The common forms are read by one expression each; all others take the long way, which gives the same for these.
    """
    plain = F.trim(F.replace(raw, F.lit("\u00a0"), F.lit(" ")))
    size = lambda pattern: F.replace(F.regexp_extract(raw, pattern, 1), F.lit(","), F.lit("")).try_cast("double")
    said = lambda value, nil: F.struct(value.alias("value"), F.lit(nil).alias("nil"))
    return (
        F.when(raw.rlike(PLAIN), said(size(PLAIN), False)).when(raw.rlike(BRACKETED), said(-size(BRACKETED), False)).when(raw.rlike(DASH), said(F.lit(0.0), True))
        .otherwise(let(F.trim(F.regexp_replace(plain, CURRENCY, "")), _parse_unpriced))
    )


def _parse_unpriced(text: Column) -> Column:
    nil = text.rlike(NIL)
    bracketed = text.startswith("(") & text.endswith(")") & (F.length(text) > 1)
    inner = F.when(bracketed, F.trim(F.substr(text, F.lit(2), F.length(text) - 2))).otherwise(text)

    def unsigned(inner: Column) -> Column:
        signed = inner.rlike("^[-–−]")
        bare = F.when(signed, F.trim(F.substr(inner, F.lit(2)))).otherwise(inner)
        core = F.replace(F.regexp_replace(F.trim(F.regexp_replace(bare, CURRENCY, "")), "%+$", ""), F.lit(" "), F.lit(""))
        return let(let(core, _size), lambda size: F.when(bracketed | signed, -size).otherwise(size))

    return F.struct(F.when(nil, F.lit(0.0)).otherwise(let(inner, unsigned)).alias("value"), nil.alias("nil"))


def _size(core: Column) -> Column:
    """A number whose commas stand where thousands or lakhs do."""
    fits = core.rlike(NUMBER) & (core != "") & (core != ".")
    plain = F.replace(core, F.lit(","), F.lit(""))
    return F.when(fits, F.when(plain.startswith("."), F.concat(F.lit("0"), plain)).otherwise(plain).try_cast("double"))


def parse_amount(cell: Column) -> Column:
    """The amount of a transcribed cell: a dash is 0, dots may group thousands, [?] or words are NULL."""
    return let(F.trim(F.replace(cell, F.lit("*"), F.lit(""))), _parse_cell)


def _parse_cell(text: Column) -> Column:
    core = F.regexp_replace(text, r"[()$\s]", "")
    core = F.when(core.rlike(r"^-?[0-9]{1,3}(?:\.[0-9]{3})+$"), F.replace(core, F.lit("."), F.lit(""))).otherwise(core)
    size = F.replace(core, F.lit(","), F.lit("")).try_cast("double")
    signed = F.when(text.startswith("(") & text.endswith(")"), -size).otherwise(size)
    return F.when(text.rlike(r"^\$?\s*[-–—]{1,2}$"), F.lit(0.0)).when(text.contains("[?]") | ~text.rlike("[0-9]"), F.lit(None).cast("double")).otherwise(signed)


def digits(figure: Column) -> Column:
    return F.regexp_replace(figure, "[^0-9]", "")


def page_figures(text: Column) -> Column:
    """Digit strings of the figures with four digits or more."""
    return F.filter(F.transform(F.regexp_extract_all(text, F.lit(PAGE_FIGURE), F.lit(0)), digits), lambda d: F.length(d) >= 4)


def month_number(name: Column) -> Column:
    return F.array_position(F.array(*[F.lit(m) for m in MONTHS]), F.substr(F.lower(name), F.lit(1), F.lit(3))).cast("int")


def find_date(text: Column) -> Column:
    """struct(year, month, day) of the first date, month first before day first; NULL without one."""
    first, second = text.rlike(MONTH_FIRST), text.rlike(DAY_FIRST)
    part = lambda pattern, k: F.regexp_extract(text, pattern, k)
    a = F.struct(part(MONTH_FIRST, 3).cast("int").alias("year"), month_number(part(MONTH_FIRST, 1)).alias("month"), part(MONTH_FIRST, 2).cast("int").alias("day"))
    b = F.struct(part(DAY_FIRST, 3).cast("int").alias("year"), month_number(part(DAY_FIRST, 2)).alias("month"), part(DAY_FIRST, 1).cast("int").alias("day"))
    return F.when(first, a).when(second, b)


def _iso(year: Column, month: Column, day: Column) -> Column:
    return F.concat(F.lpad(year.cast("string"), 4, "0"), F.lit("-"), F.lpad(month.cast("string"), 2, "0"), F.lit("-"), F.lpad(day.cast("string"), 2, "0"))


def parse_period(heading: Column, fiscal: tuple[int, int] | None = None) -> Column:
    """struct(period_end, period_label) of a column heading; ``fiscal`` is the year-end's month and day."""
    end_of_year = F.lit(f"-{fiscal[0]:02d}-{fiscal[1]:02d}") if fiscal else F.lit(None).cast("string")

    def read(text: Column) -> Column:
        year = F.coalesce(F.nullif(F.regexp_extract(text, YEAR_ONLY, 1), F.lit("")), F.nullif(F.regexp_extract(text, YEAR_LAST, 1), F.lit("")), _range_end(text))
        parts = F.struct(text.rlike(PREVIOUS).alias("previous"), find_date(text).alias("date"), year.alias("year"))
        return let(parts, choose)

    def choose(x: Column) -> Column:
        date = x["date"]
        iso = _iso(date["year"], date["month"], date["day"])
        at_year_end = (date["month"] == fiscal[0]) & (date["day"] == fiscal[1]) if fiscal else F.lit(False)
        period_end = F.when(x["previous"], F.lit(None).cast("string")).when(date.isNotNull(), iso).when(x["year"].isNotNull(), F.concat(x["year"], end_of_year))
        label = F.when(x["previous"], F.lit("previous year")).when(date.isNotNull() & at_year_end, F.concat(F.lit("FY"), date["year"].cast("string"))).when(date.isNotNull(), iso).when(x["year"].isNotNull(), F.concat(F.lit("FY"), x["year"]))
        return F.struct(period_end.alias("period_end"), label.alias("period_label"))

    return let(F.trim(F.coalesce(heading, F.lit(""))), read)


def _range_end(text: Column) -> Column:
    span = F.nullif(F.regexp_extract(text, FISCAL_RANGE, 2), F.lit(""))
    return F.when(F.length(span) == 2, F.concat(F.lit("20"), span)).otherwise(span)


def report_unit(text: Column) -> Column:
    """The unit a statement is printed in: the first of the patterns, in their order, that occurs."""
    found = [F.nullif(F.regexp_extract(text, p, 0), F.lit("")) for p in UNIT_PATTERNS]
    return F.trim(F.regexp_replace(F.coalesce(*found), r"\s+", " "))


def statement_unit(unit: Column) -> Column:
    """struct(currency, scale) that a unit names."""
    low = F.lower(F.coalesce(unit, F.lit("")))
    first = lambda pairs, kind: F.coalesce(*[F.when(low.rlike(p), F.lit(v).cast(kind)) for p, v in pairs])
    return F.struct(first(UNIT_CURRENCIES, "string").alias("currency"), first(UNIT_SCALES, "double").alias("scale"))


def distinctive(raw: Column, value: Column) -> Column:
    """Whether a figure has four significant digits or more and is no year."""
    d = digits(raw)
    return value.isNotNull() & (F.length(F.regexp_replace(d, "^0+", "")) >= 4) & ~d.rlike("^(19|20)[0-9]{2}$")


def amount_key(value: Column) -> Column:
    """Size of an amount to two decimals, without its sign."""
    return F.round(F.abs(value), 2).cast("decimal(38,2)")


def close(total: Column, printed: Column, raw: Column) -> Column:
    """Whether a total equals a printed figure but for one in its last printed digit."""
    return F.abs(total - printed) <= tolerance(raw)


def tolerance(raw: Column) -> Column:
    """One in the last printed digit of a figure."""
    decimals = F.length(F.coalesce(F.get(F.split(raw, r"\."), F.lit(1)), F.lit("")))
    return F.pow(F.lit(10.0), -decimals.cast("double")) + 1e-9


def money_figures(text: Column) -> Column:
    """array of struct(raw, currency, amount) of the money amounts of a million or more."""
    whole = F.regexp_extract_all(text, F.lit(MONEY), F.lit(0))

    def read(m: Column) -> Column:
        word = F.regexp_replace(F.regexp_replace(F.lower(F.regexp_extract(m, MONEY, 3)), r"\.$", ""), r"\s+", " ")
        scale = F.coalesce(F.when(word.startswith("lakh crore"), F.lit(1e12)), F.try_element_at(F.create_map(*[F.lit(x) for kv in MONEY_SCALES.items() for x in kv]), word), F.lit(1.0))
        number = F.replace(F.regexp_extract(m, MONEY, 2), F.lit(","), F.lit("")).cast("double")
        currency = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in MONEY_CURRENCIES.items() for x in kv]), F.lower(F.regexp_extract(m, MONEY, 1))), F.lit("?"))
        return F.struct(F.trim(m).alias("raw"), currency.alias("currency"), (number * scale).alias("amount"))

    return F.filter(F.transform(whole, read), lambda x: x["amount"] >= LEAST_MONEY)


# What six readers take for a figure. They differ on purpose, so each keeps its own.
FIGURE_CELLS = {
    "table_value": r"^\(?[-–−]?\s*[₹$]?\s*[0-9,]+(\.[0-9]+)?\)?%?$|^[-–—]$",
    "number_cell": r"^\(?[-–]?[0-9,]+(\.[0-9]+)?\)?%?$|^[-–—]{1,2}$",
    "layout": r"(?i)^[(\-–−]?\s*(?:₹|US\$|\$|Rs\.?|€|£)?\s*[(\-–−]?\s*[0-9][0-9,]*(?:\.[0-9]+)?\s*\)?\s*%?(?:\([a-z]\))?$|^[-–—]+$",
    "formatted": r"(?i)^[(\-–−]?\s*(?:₹|US\$|\$|Rs\.?|€|£|C\$|A\$)?\s*[(\-–−]?\s*[0-9][0-9,]*(?:\.[0-9]+)?\s*\)?\s*%?(?:\([a-z]\))?$|^[-–—]+$",
    "links": r"^(?:\(?-?\$?\s?[0-9][0-9,]*\.?[0-9]*\)?)$",
    "transcript": r"\(?-?\$?\s?[0-9]{1,3}(?:[,.][0-9]{3})+(?:\.[0-9]{1,2})?\)?|\(?-?\$?[0-9]{4,}(?:\.[0-9]{1,2})?\)?",
}


def figure_cells(raw: Column) -> list[Column]:
    """Whether each reader takes a cell for a figure (the transcript's finds one inside the cell)."""
    return [raw.rlike(pattern).alias(name) for name, pattern in FIGURE_CELLS.items()]
