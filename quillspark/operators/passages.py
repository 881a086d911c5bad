"""Passages: the blocks of a section cut at headings and by length, small pieces joined, each named by its headings.

A heading cuts where text stands between it and the heading before: that is a comparison of two running sums, so headings in a row
name one stretch. Inside a stretch text is packed up to ``MAX_CHARS`` (a fold over its lengths), and pieces below ``MIN_CHARS`` join the
next one (a fold over the pieces of a section, which hold names and lengths, no text). Texts are joined once, when the places are known.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import figures as fig
from ..functions import text as tx

# Least and most characters of a passage, words of its lead, figures it keeps, and what no heading has.
MIN_CHARS, MAX_CHARS, LEAD_WORDS, MOST_FIGURES = 1500, 8000, 25, 40
HEADING_WORDS, HEADING_CHARS = 14, 110

_PIECE = "struct<heads:array<string>,part:int,chars:bigint,first:bigint>"


def _plain(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", " "))


def real_heading(text: Column, title: Column) -> Column:
    """Whether a block typed as a heading names what follows, and is no pull quote nor the section's own title (null: none)."""
    bare = F.regexp_replace(text, r"^\s+|\s+$", "")
    prose = (bare == "") | bare.rlike(r"^\p{Ll}") | bare.rlike("[,;]$") | (F.size(F.split(bare, r"\s+")) > HEADING_WORDS) | (F.length(bare) > HEADING_CHARS)
    return ~prose & ~F.coalesce((_plain(title) != "") & F.contains(_plain(text), _plain(title)), F.lit(False))


def _last(array: Column) -> Column:
    return F.try_element_at(array, F.lit(-1))


def _but_last(array: Column) -> Column:
    return F.slice(array, 1, F.greatest(F.size(array) - 1, F.lit(0)))


def pieces(rows: DataFrame, most: int = MAX_CHARS) -> DataFrame:
    """(doc_id, stretch, heads, part, chars, first): stretches between headings, in parts of at most ``most`` characters or one block. Takes (doc_id, seq, heading, text)."""
    order = Window.partitionBy("doc_id").orderBy("seq")
    rows = rows.withColumn("n", F.when(F.col("heading"), F.lit(0)).otherwise(F.length("text")).cast("long")).withColumn("upto", F.sum("n").over(order))
    before = F.coalesce(F.max(F.when(F.col("heading"), F.col("upto"))).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = rows.withColumn("cut", F.when(F.col("heading") & (F.col("upto") > before), 1).otherwise(0)).withColumn("stretch", F.sum("cut").over(order))
    item = F.struct("seq", "heading", "n", F.when(F.col("heading"), F.col("text")).alias("name"))
    held = rows.groupBy("doc_id", "stretch").agg(F.array_sort(F.collect_list(item)).alias("s"))
    names = F.transform(F.filter("s", lambda x: x["heading"]), lambda x: x["name"])

    def pack(out: Column, x: Column) -> Column:
        now = _last(out)
        opens = (F.size(out) == 0) | ((now["chars"] > 0) & ~x["heading"] & (now["chars"] + x["n"] > most))
        fresh = F.struct((F.coalesce(now["part"], F.lit(0)) + 1).alias("part"), x["n"].alias("chars"), x["seq"].cast("long").alias("first"))
        grown = F.struct(now["part"].alias("part"), (now["chars"] + x["n"]).alias("chars"), now["first"].alias("first"))
        return F.when(opens, F.concat(out, F.array(fresh))).otherwise(F.concat(_but_last(out), F.array(grown)))

    packed = F.aggregate("s", F.array().cast("array<struct<part:int,chars:bigint,first:bigint>>"), pack)
    found = held.select("doc_id", "stretch", names.alias("names"), F.inline(packed))
    heads = F.when((F.col("part") == 1) & (F.size("names") > 0), F.array(F.array_join("names", " · "))).otherwise(F.col("names"))
    return found.select("doc_id", "stretch", heads.alias("heads"), "part", "chars", "first")


def joined(found: DataFrame, least: int = MIN_CHARS) -> DataFrame:
    """(doc_id, passage, heads, part, chars, first): a piece below ``least`` characters joins the next, both naming it; a last one the passage before."""
    listed = found.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("first", "heads", "part", "chars"))).alias("s"))

    def both(short: Column, x: Column) -> Column:
        fresh = F.filter(F.slice(x["heads"], -1, F.least(F.size(x["heads"]), F.lit(1))), lambda h: ~F.array_contains(short["heads"], h))
        named = F.concat(_but_last(short["heads"]), F.array(F.array_join(F.concat(F.array(_last(short["heads"])), fresh), " · ")))
        heads = F.when((F.size(short["heads"]) > 0) & (short["heads"] != x["heads"]), named).otherwise(x["heads"])
        return F.struct(heads.alias("heads"), x["part"].alias("part"), (short["chars"] + x["chars"]).alias("chars"), short["first"].alias("first"))

    def step(state: Column, x: Column) -> Column:
        own = F.struct(x["heads"].alias("heads"), x["part"].alias("part"), x["chars"].alias("chars"), x["first"].alias("first"))
        whole = F.when(state["short"].isNull(), own).otherwise(both(state["short"], x))
        kept = whole["chars"] >= least
        return F.struct(F.when(kept, F.concat(state["done"], F.array(whole))).otherwise(state["done"]).alias("done"), F.when(~kept, whole).alias("short"))

    def end(state: Column) -> Column:
        last = _last(state["done"])
        grown = F.struct(last["heads"].alias("heads"), last["part"].alias("part"), (last["chars"] + state["short"]["chars"]).alias("chars"), last["first"].alias("first"))
        return F.when(state["short"].isNull(), state["done"]).when(F.size(state["done"]) == 0, F.array(state["short"])).otherwise(F.concat(_but_last(state["done"]), F.array(grown)))

    start = F.struct(F.array().cast(f"array<{_PIECE}>").alias("done"), F.lit(None).cast(_PIECE).alias("short"))
    return listed.select("doc_id", F.posexplode(F.aggregate("s", start, step, end)).alias("k", "p")).select("doc_id", (F.col("k") + 1).cast("long").alias("passage"), "p.*")


def passages(blocks: DataFrame, least: int = MIN_CHARS, most: int = MAX_CHARS) -> DataFrame:
    """(doc_id, passage, id, first_seq, last_seq, chars, path, lead, text, figures) of each section.

    Takes (doc_id, seq, page, kind, text, title, parent): ``title`` and ``parent`` name the section, either may be null. ``chars`` counts
    text without headings; ``text`` has a line for each page it is on; ``figures`` are the money amounts in it, ``MOST_FIGURES`` at most.
    """
    rows = blocks.withColumn("text", F.coalesce("text", F.lit(""))).withColumn("heading", (F.col("kind") == "heading") & real_heading(F.col("text"), F.col("title")))
    places = joined(pieces(rows.select("doc_id", "seq", "heading", "text"), most), least)
    order = Window.partitionBy("doc_id").orderBy("seq")
    rows = rows.join(places.select("doc_id", "passage", "heads", "part", F.col("first").alias("seq")), ["doc_id", "seq"], "left")
    rows = rows.withColumn("passage", F.last("passage", ignorenulls=True).over(order))
    turned = ~F.col("page").eqNullSafe(F.lag("page").over(Window.partitionBy("doc_id", "passage").orderBy("seq")))
    rows = rows.withColumn("said", F.array_compact(F.array(F.when(turned, F.concat(F.lit("--- PDF page "), F.col("page").cast("string"), F.lit(" ---"))), F.when(F.col("text") != "", F.col("text")))))
    item = F.array_sort(F.collect_list(F.struct("seq", "heading", "text", "said")))
    held = rows.groupBy("doc_id", "passage").agg(
        F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"), F.sum(F.when(F.col("heading"), 0).otherwise(F.length("text"))).alias("chars"), F.first("heads", ignorenulls=True).alias("heads"),
        F.first("part", ignorenulls=True).alias("part"), F.first("title", ignorenulls=True).alias("title"), F.first("parent", ignorenulls=True).alias("parent"), item.alias("s"),
    )
    own = F.filter("heads", lambda h: F.coalesce(_plain(h) != _plain(F.col("title")), F.lit(True)))
    path = F.array_join(F.concat(F.array_compact(F.array("parent", "title")), own), " › ")
    path = F.regexp_replace(F.regexp_replace(path, r"[\x00-\x1f]+", " "), "  +", " ")
    words = F.filter(F.split(F.array_join(F.transform(F.filter("s", lambda x: ~x["heading"]), lambda x: x["text"]), " "), r"\s+"), lambda w: w != "")
    text = F.array_join(F.flatten("s.said"), "\n\n")
    slug = tx.passage_slug(F.coalesce("title", F.lit("")))
    out = held.withColumn("text", text).select(
        "doc_id", "passage", F.concat(F.lit("P-"), slug, F.lit("-"), F.lpad(F.col("passage").cast("string"), F.greatest(F.length(F.col("passage").cast("string")), F.lit(2)), F.lit("0"))).alias("id"), "first_seq", "last_seq", "chars",
        F.when(F.col("part") > 1, F.concat(path, F.lit(" (part "), F.col("part").cast("string"), F.lit(")"))).otherwise(path).alias("path"), F.array_join(F.slice(words, 1, LEAD_WORDS), " ").alias("lead"), "text",
    )
    return out.withColumn("figures", F.slice(fig.money_figures(F.col("text")), 1, MOST_FIGURES))
