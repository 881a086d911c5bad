"""A corpus pipeline of five stages, each reading what the one before it wrote.

Language identification, near-duplicates, benchmark passages, the mix of sources, and token files. ``STAGES`` lists
(name, function); a function takes (spark, docs, sf_dir). All but the last return the columns of ``documents``.

In every stage a row is judged as a row: rows that repeat a doc_id or have none are separate documents. An empty table gives
an empty one, and columns other than those of ``documents`` are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillspark.llm import op01_language, op03_token_store, op05_mixing, op06_decontaminate, op09_minhash
from quillspark.llm.common import materialise, settled, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Keys of rows to drop that may be broadcast; a longer list is joined by shuffle.
BROADCAST_IDS = 1 << 20
#: What language identification takes for a letter.
LETTER = r"\p{L}"
#: Key of a row within a stage; a doc_id may be null or repeat.
ROW = "pipeline_row"
#: Of the choice of documents that the mix takes once more, and the parts a fraction is counted in.
SEED, UNIT = 20_240_502, 1 << 30

#: The last stage's language identification, token files and all between are not SQL; see tests/llm.
ORACLE_SQL = None


def _keyed(docs: DataFrame) -> DataFrame:
    """``docs`` with the key of each row, written so that every later reading has the same keys."""
    return materialise(docs.select(*COLUMNS, F.monotonically_increasing_id().alias(ROW)), "pipeline-rows")


def _without(docs: DataFrame, drop: DataFrame) -> DataFrame:
    """``docs`` but for the rows whose key is in ``drop``."""
    keys = materialise(drop.select(ROW), "pipeline-drop")
    few = keys.count() <= BROADCAST_IDS
    return docs.join(F.broadcast(keys) if few else keys, ROW, "left_anti")


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents without a letter (null and empty texts too), and those where no language has half of the score.

    Copies share their fate, as only the text decides. Where no document outside the held-out quarter has a lang, there is no language to score: all with a letter stay.
    """
    model = op01_language.fit(docs)
    if not model.languages:
        return docs.where(F.col("text").rlike(LETTER)).select(*COLUMNS)
    found = op01_language.identify(docs, model, *COLUMNS)
    return found.where("lang_pred != 'und' and score >= 0.5").select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the row of least id (null last) of each group of near-duplicates (five-word shingles, similarity 0.8).

    Rows without a word, null texts among them, are near nothing and stay.
    """
    docs = _keyed(docs)
    found = op09_minhash.near_duplicates(docs.withColumn("doc_id", F.col(ROW)))
    groups = materialise(found.select(F.col("doc_id").alias(ROW), "component_id"), "pipeline-groups")
    least = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", ROW))[ROW]
    stays = groups.join(docs.select(ROW, "doc_id"), ROW).groupBy("component_id").agg(least.alias(ROW)).select(ROW)
    return _without(docs, groups.join(stays, ROW, "left_anti")).select(*COLUMNS)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the rows that hold a passage of a benchmark item; null texts hold none and stay, as does all where there is no item."""
    found = op06_decontaminate.contamination(docs, table(spark, sf_dir, "benchmark"), carry=tuple(COLUMNS[1:]))
    return found.where("not contaminated").select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeat each document as often as the mix takes its words, rounded so that each source keeps its words.

    A document comes floor(taken / size) times, and once more where the running sum of the fractions along its shard, with a
    seeded start, passes a whole number. Each has the chance of its fraction; as the line is in order of size, the words of
    a shard differ from those taken by less than its longest document. A text without words has none to take and goes; a null
    source is a source.
    """
    docs = _keyed(docs)
    mixed = op05_mixing.mix(docs, lambda k: k % 3 + 1, carry=(ROW,)).where("taken > 0")
    part = F.expr(f"coalesce(taken % nullif(size, 0) * {UNIT}L div nullif(size, 0), 0L)")  # no division by 0, whatever order Spark takes
    line = Window.partitionBy("source", "shard").orderBy("size", F.xxhash64(F.lit(SEED), "doc_id"), "doc_id", ROW)
    start = F.pmod(F.xxhash64(F.lit(SEED), "source", "shard"), F.lit(UNIT))
    laid = mixed.withColumn("part", part).withColumn("upto", start + F.sum("part").over(line.rowsBetween(Window.unboundedPreceding, 0)))
    once_more = F.expr(f"upto div {UNIT} - (upto - part) div {UNIT}")
    copies = laid.select(ROW, (F.expr("coalesce(taken div nullif(size, 0), 0L)") + once_more).cast("int").alias("copies")).where("copies > 0")
    return docs.join(copies, ROW).withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).select(*COLUMNS)


def token_files(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Write the token files and return what they hold of each document."""
    return op03_token_store.token_store(docs).drop("ids")


STAGES = [("language id", language_id), ("near duplicates", near_duplicates), ("decontamination", decontaminate), ("source mix", mix_sources), ("token files", token_files)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = settled(spark, "pipeline-" + name.replace(" ", "-"), lambda stage=stage, docs=docs: stage(spark, docs, sf_dir))
    return docs
