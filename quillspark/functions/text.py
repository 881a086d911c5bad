"""Text cleaning, titles, slugs, ids and joins of lines."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

STATEMENT_TYPES = (
    ("EQ", r"changes in (?:shareholders'? |stockholders'? )?equity"), ("CF", r"cash flows?"), ("BS", r"balance sheets?|financial position"),
    ("PL", r"profit (?:and|&) loss|statements? of (?:income|operations|earnings|comprehensive income)|income statements?"),
)
# Words of a title that stay small, words that do not tell entities apart, and what is cut from titles.
SMALL_WORDS = ("and", "or", "of", "the", "to", "in", "for", "on", "at", "by", "as", "with", "from", "&")
GENERIC_WORDS = ("inc", "inc.", "company", "co", "co.", "corporation", "corp", "corp.", "ltd", "ltd.", "limited", "the", "of", "and", "&", "insurance", "incorporated")
CONTINUED = r"(?i)\(\s*cont(?:d|inued)?\.?\s*\)"
TRAILING_RUPEES = r"(\s+Rs\.?)+\s*$"
TITLE_END = r"(?i)\s+(?:forming part of|for the (?:year|period) ended|as at)\b.*$"
LOST_DASH, QUOTED_REFERENCE, STRAY_QUOTE = "\ufffd{2,}", "['‘’`´₹\ufffd]\\s*([A-Z]{1,2}|[0-9]{1,2})\\s*['‘’`´₹\ufffd]", "[‘’`´₹\ufffd]"
ELLIPSIS = "…"


def _clean(text: pd.Series) -> pd.Series:
    return text.str.normalize("NFKC").str.replace("`", "₹", regex=False)


def clean_text(text: Column | str) -> Column:
    """Compatibility form of a text; a backtick is the rupee sign. Spark SQL has no NFKC, so this one is an Arrow function."""
    return F.pandas_udf(_clean, "string")(text)


def norm(text: Column) -> Column:
    """Lower case, runs of other than a-z and 0-9 as one space."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]+", " "))


def norm_heading(text: Column) -> Column:
    """Lower case with single spaces, without "(continued)"."""
    return F.trim(F.regexp_replace(F.lower(F.regexp_replace(text, CONTINUED, "")), r"\s+", " "))


def norm_title(text: Column) -> Column:
    """``norm`` with "&" as a word."""
    return norm(F.replace(F.lower(text), F.lit("&"), F.lit(" and ")))


def norm_entity(name: Column) -> Column:
    """Lower-case words of a company's name, "&" kept."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(name, F.lit(""))), "[^a-z0-9& ]", " "), " +", " "))


def entity_key(name: Column) -> Column:
    """The words that tell an entity apart, joined by hyphens."""
    words = F.filter(F.split(norm_entity(name), " "), lambda w: (w != "") & ~w.isin(*GENERIC_WORDS))
    return F.when(F.size(words) == 0, "report").otherwise(F.array_join(words, "-"))


def despace(text: Column) -> Column:
    """A line of four letters or more set apart ("N O T E S") with its single letters joined."""
    return F.when(text.rlike(r"^(?:\w ){3,}\w.*$"), F.regexp_replace(text, r"(?<=\b\w) (?=\w\b)", "")).otherwise(text)


def slug(title: Column, words: int = 5) -> Column:
    """Section id: N- and the first words in capitals."""
    own = norm(title)
    return F.when(own == "", "N-SECTION").otherwise(F.concat(F.lit("N-"), F.upper(F.array_join(F.slice(F.split(own, " "), 1, words), "-"))))


def passage_slug(section: Column) -> Column:
    body = F.regexp_replace(F.substr(F.regexp_replace(section, "^N-", ""), F.lit(1), F.lit(28)), "-+$", "")
    return F.when(body == "", "SECTION").otherwise(body)


def title_case(text: Column) -> Column:
    """Words all in capitals with one capital, small ones without unless first; other words as they are."""
    small = F.array(*[F.lit(w) for w in SMALL_WORDS])

    def word(w, i):
        letters, low = F.regexp_replace(w, "[^A-Za-z]", ""), F.lower(w)
        loud = (F.length(letters) > 1) & (F.upper(letters) == letters) & ~w.contains(".")
        return F.when(~loud, w).when((i > 0) & F.array_contains(small, low), low).otherwise(F.concat(F.upper(F.left(low, F.lit(1))), F.substr(low, F.lit(2))))

    return F.array_join(F.transform(F.split(F.trim(F.regexp_replace(text, r"\s+", " ")), " "), word), " ")


def clean_title(text: Column) -> Column:
    """A statement's title without trailing rupee signs and what follows its name."""
    cut = F.regexp_replace(F.regexp_replace(text, TRAILING_RUPEES, ""), TITLE_END, "")
    return title_case(F.regexp_replace(cut, r"^[ :.\-–]+|[ :.\-–]+$", ""))


def legacy_clean(text: Column) -> Column:
    """An old report's text with its lost dashes and quotes; figures stay."""
    quoted = F.regexp_replace(F.regexp_replace(text, LOST_DASH, "–"), QUOTED_REFERENCE, "'$1'")
    # Most texts hold no quote of any kind, which one look shows.
    return F.replace(F.when(text.rlike("['‘’`´₹\ufffd]"), F.regexp_replace(quoted, STRAY_QUOTE, "'")).otherwise(text), F.lit("––"), F.lit("–"))


def fill_prompt(template: Column, values: Column) -> Column:
    """``template`` with each {{KEY}} replaced from the map ``values`` in one pass: what a value holds is never replaced, an unknown key stays."""
    texts = F.split(template, r"\{\{[A-Za-z0-9_]+\}\}")
    keys = F.regexp_extract_all(template, F.lit(r"\{\{([A-Za-z0-9_]+)\}\}"), F.lit(1))
    filled = F.transform(keys, lambda k: F.coalesce(F.try_element_at(values, k), F.concat(F.lit("{{"), k, F.lit("}}"))))
    return F.array_join(F.transform(texts, lambda t, i: F.concat(t, F.coalesce(F.get(filled, i), F.lit("")))), "")


def truncate(title: Column, limit: int) -> Column:
    """At most ``limit`` characters, cut at a word, with an ellipsis."""
    head = F.regexp_replace(F.substr(title, F.lit(1), F.lit(limit)), r"\s+\S*$", "")
    return F.when(F.length(title) <= limit, title).otherwise(F.concat(head, F.lit(ELLIPSIS)))


def join_lines(lines: Column) -> Column:
    """One paragraph of an array of lines: a hyphen at a line's end before a lower-case letter joins the word."""
    return F.aggregate(lines, F.lit(""), lambda acc, x: F.when(acc == "", x).when(acc.endswith("-") & x.rlike("^[a-z]"), F.concat(F.substr(acc, F.lit(1), F.length(acc) - 1), x)).otherwise(F.concat(acc, F.lit(" "), x)))


def statement_type(title: Column) -> Column:
    low = F.lower(title)
    out = F.lit(None).cast("string")
    for code, pattern in reversed(STATEMENT_TYPES):
        out = F.when(low.rlike(pattern), F.lit(code)).otherwise(out)
    return out


def natural_key(name: Column) -> Column:
    """Sort key of a name: its digit runs padded, so TYPE-2 comes before TYPE-10."""
    parts = F.regexp_extract_all(F.lower(name), F.lit("[0-9]+|[^0-9]+"), F.lit(0))
    return F.array_join(F.transform(parts, lambda p: F.when(p.rlike("^[0-9]"), F.lpad(p, 12, "0")).otherwise(p)), "")


def block_text(kind: Column, level: Column, text: Column) -> Column:
    """A block as plain text: headings with marks, bullets with a dash."""
    return F.when(kind == "heading", F.concat(F.repeat(F.lit("#"), level), F.lit(" "), text)).when(kind == "bullet", F.concat(F.lit("- "), text)).otherwise(text)


def bands(rows: DataFrame, page: str) -> DataFrame:
    """Adds ``band`` (header, footer or body) to lines with k (their plain form), top and bottom.

    Lines are counted before the join, so one that stands on every page is one row on that side.
    """
    pages = F.countDistinct(page)
    often = rows.groupBy("k").agg(F.countDistinct(F.when(F.col("top"), F.col(page))).alias("tops"), F.countDistinct(F.when(F.col("bottom"), F.col(page))).alias("bottoms"))
    told = rows.join(often, "k").crossJoin(F.broadcast(rows.agg(pages.alias("pages"))))  # one row
    size = F.length("text")
    header = F.col("top") & (size >= 3) & ((F.col("tops") >= F.greatest(F.lit(3), 0.3 * F.col("pages"))) | ((size <= 80) & (F.col("tops") >= 2)))
    footer = F.col("bottom") & ((F.col("bottoms") >= 3) | F.col("text").rlike(r"(?i)^(?:page\s+)?(?:[A-Z]-)?[0-9]{1,3}$"))
    return told.withColumn("band", F.when(header, "header").when(footer, "footer").otherwise("body"))


def parse_reply(reply: Column, schema: str) -> Column:
    """header (its JSON block read as ``schema``), markdown (what follows the block, else all) and the number of unreadable figures in it."""
    block = F.regexp_extract(reply, r"(?s)```json\s*(\{.*?\})\s*```", 1)
    markdown = F.trim(F.regexp_replace(reply, r"(?s)^.*?```json\s*\{.*?\}\s*```\s*", ""))
    return F.struct(F.from_json(block, schema).alias("header"), markdown.alias("markdown"), F.regexp_count(markdown, F.lit(r"\[\?\]")).cast("long").alias("unreadable"))
