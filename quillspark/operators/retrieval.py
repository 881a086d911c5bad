"""Ranked retrieval: postings, BM25, boosts, caps, relative cut-offs and budgets."""

from __future__ import annotations

import zlib

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import words as wd

K1, B = 1.5, 0.75
PATH_WEIGHT, NAMED_BOOST, KIND_BOOST = 3, 1.6, 1.25
PER_SECTION, CANDIDATES = 4, 30
#: Partitions of an index, and the parts in which each of them is written.
BUCKETS, SLICES = 32, 16


def _words(passages: DataFrame, *more: Column) -> DataFrame:
    """(id, term, weight): words of the text once, words of the path three times, and ``more``; each is looked up and stemmed as a row of its own."""
    of = lambda c, weight: F.struct(wd.raw_words(F.col(c)).alias("words"), F.lit(weight).alias("weight"))
    rows = passages.select("id", F.inline(F.array(of("text", 1), of("path", PATH_WEIGHT), *more))).select("id", F.explode("words").alias("word"), "weight")
    return rows.where(~wd.is_stopword(F.col("word"))).select("id", wd.retrieval_stem(F.col("word")).alias("term"), "weight")


def postings(passages: DataFrame) -> DataFrame:
    """(id, term, tf): words of the text once, words of the path three times. Takes (id, path, text)."""
    return _words(passages).groupBy("id", "term").agg(F.sum("weight").alias("tf"))


def index(passages: DataFrame) -> DataFrame:
    """(bucket, term, id, tf, dl): postings with the length of their passage, to be written once, partitioned by bucket.

    The term "" has a row for each id: how many passages have it, and its length. A question then reads the buckets of its terms and
    of "" alone, and counts what it needs of them. Passages are dealt once by id, postings once by bucket; nothing joins them.
    """
    own = passages.select("id", "path", "text").repartition("id")
    posted = _words(own, F.struct(F.array(F.lit("")).alias("words"), F.lit(1).alias("weight"))).groupBy("id", "term").agg(F.sum("weight").alias("tf"))
    length = F.sum(F.when(F.col("term") != "", F.col("tf")).otherwise(0)).over(Window.partitionBy("id"))
    found = posted.withColumn("dl", length).withColumn("bucket", _bucket(F.col("term")))
    return found.repartition("bucket", F.pmod(F.xxhash64("id"), F.lit(SLICES))).sortWithinPartitions("bucket", "term")


def _bucket(term: Column) -> Column:
    return F.pmod(F.crc32(term.cast("binary")), F.lit(BUCKETS)).cast("int")


def bm25(indexed: DataFrame, terms: dict[str, float]) -> DataFrame:
    """(id, score) of the passages that hold a term, from the postings of ``index``: partitions and rows of other terms are not read."""
    weights = F.create_map(*[F.lit(x) for kv in terms.items() for x in kv])
    of = lambda *names: indexed.where(F.col("bucket").isin(sorted({zlib.crc32(t.encode()) % BUCKETS for t in names})) & F.col("term").isin(list(names)))
    asked = of(*terms)
    often = asked.groupBy("term").agg(F.count("*").alias("df"))  # a row a term
    corpus = of("").agg(F.avg(F.when(F.col("dl") > 0, F.col("dl"))).alias("avgdl"), F.sum("tf").alias("n_docs"))  # one row
    asked = asked.where("id is not null").join(F.broadcast(often), "term").crossJoin(F.broadcast(corpus))
    idf = F.log(1 + (F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = F.try_element_at(weights, F.col("term")) * idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    return asked.groupBy("id").agg(F.sum(part).alias("score"))


def boosted(scores: DataFrame, passages: DataFrame, question: str) -> DataFrame:
    """Scores times 1.6 in a kind of section that the question names, else 1.25 in one that it points at."""
    q = F.lit(question)
    factor = F.when(F.array_contains(wd.named_kinds(q), F.col("kind")), NAMED_BOOST).when(F.array_contains(wd.boosted_kinds(q), F.col("kind")), KIND_BOOST).otherwise(1.0)
    return scores.join(passages.select("id", "section_id", "seq", "kind"), "id").withColumn("score", F.col("score") * factor)


def candidates(scores: DataFrame, limit: int = CANDIDATES, per_section: int = PER_SECTION) -> DataFrame:
    """The best passages, at most ``per_section`` of a section. Rounded before sorting, as sums of floats depend on their order."""
    own = scores.withColumn("score", F.round("score", 6))
    place = F.row_number().over(Window.partitionBy("section_id").orderBy(F.desc("score"), "seq"))
    return own.withColumn("place", place).where(F.col("place") <= per_section).drop("place").orderBy(F.desc("score"), "seq").limit(limit)


def ahead_of_rest(found: DataFrame, share: float, limit: int, *order: Column) -> DataFrame:
    """Rows with at least ``share`` of the best score, the first ``limit`` by score and ``order``. Meant for a short candidate list."""
    best = found.agg(F.max("score").alias("best"))
    return found.crossJoin(F.broadcast(best)).where(F.col("score") >= share * F.col("best")).drop("best").orderBy(F.desc("score"), *order).limit(limit)


def budget_fill(rows: DataFrame, group: str, order: str, size: str, item: str, budget: int) -> DataFrame:
    """(group, taken): items in order while they fit; the first is always taken, one that does not fit is skipped. One fold over each group's ordered array."""
    listed = rows.groupBy(group).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(item).alias("i"), F.col(size).cast("long").alias("s")))).alias("items"))
    start = F.struct(F.lit(0).cast("long").alias("used"), F.array().cast("array<bigint>").alias("taken"))

    def step(acc, x):
        fits = (F.size(acc["taken"]) == 0) | (acc["used"] + x["s"] <= budget)
        return F.struct(F.when(fits, acc["used"] + x["s"]).otherwise(acc["used"]).alias("used"), F.when(fits, F.concat(acc["taken"], F.array(x["i"].cast("long")))).otherwise(acc["taken"]).alias("taken"))

    return listed.select(group, F.aggregate("items", start, step)["taken"].alias("taken"))


def merge_ordered(*lists: DataFrame) -> DataFrame:
    """(id, priority, place) of ordered id lists, each id once at its first list. Takes (id, place) tables."""
    union = None
    for k, one in enumerate(lists):
        part = one.select("id", F.struct(F.lit(k).alias("priority"), F.col("place").alias("place")).alias("at"))
        union = part if union is None else union.unionByName(part)
    return union.groupBy("id").agg(F.min("at").alias("at")).select("id", F.col("at.priority").alias("priority"), F.col("at.place").alias("place"))


def keyword_scores(notes: DataFrame, phrases: list[str], words: list[str]) -> DataFrame:
    """(id, score): 3 for each phrase in the title, 1 for each in a sub-heading or the digest, 2 for each word (its last s's off) in the title.

    Takes (id, title, subheadings array, digest).
    """
    title, digest = F.lower("title"), F.lower(F.coalesce("digest", F.lit("")))
    subs = F.lower(F.array_join(F.coalesce("subheadings", F.array().cast("array<string>")), " "))
    points = [F.when(title.contains(p), 3).otherwise(0) + F.when(subs.contains(p) | digest.contains(p), 1).otherwise(0) for p in phrases]
    points += [F.when(title.contains(w.rstrip("s")), 2).otherwise(0) for w in words]
    return notes.select("id", sum(points, F.lit(0)).cast("long").alias("score")).where("score > 0")


def select_notes(explicit: DataFrame, hints: DataFrame, scored: DataFrame, limit: int, hinted: int = 2) -> DataFrame:
    """(id, priority, place) of the notes for a question, at most ``limit``: those it names, then the first hints, then those by score.

    Takes (id, place), (id, place) and (id, score); a note counts where it comes first. Scores keep half of the best or more.
    """
    first = hints.orderBy("place").limit(hinted)
    near = ahead_of_rest(scored, 0.5, limit, F.desc("id"))  # a short list, so its places come from one window
    ranked = near.select("id", F.row_number().over(Window.orderBy(F.desc("score"), F.desc("id"))).alias("place"))
    return merge_ordered(explicit, first, ranked).orderBy("priority", "place").limit(limit)
