"""Token counts with a digest cache: encode only the distinct texts that the cache lacks, and append them.

The key of the cache is the SHA-256 of the normalised text (runs of space, tab and line feed become one space,
which no count depends on) with the SHA-256 of the tokenizer's name and file. Copies are dropped inside each
input partition first, so a group of copies of any size sends one text for each partition at most.

Nulls: a null text counts as empty (0 bytes, 0 tokens); a null doc_id keeps its row. Repeated rows each get a
row. Other columns are ignored, an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import id_column, input_partitions, scratch_path, table, text_slices
from .vocab import VOCABULARY, as_list, vocabulary_path, word_bpe

LIMIT_TOKENS = 2048
CACHE_SCHEMA = "version string, digest binary, n_tokens long"


def tokenizer_version(path: str) -> str:
    return hashlib.sha256(Path(path).name.encode() + b"\0" + Path(path).read_bytes()).hexdigest()


class CountCache:
    """A Parquet table of counts at ``path``, partitioned by tokenizer version; it may not exist yet. One writer at a time."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def _exists(self) -> bool:
        hpath = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        return hpath.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(hpath)

    def read(self, version: str) -> DataFrame:
        if not self._exists():
            return self.spark.createDataFrame([], "digest binary, n_tokens long")
        rows = self.spark.read.schema(CACHE_SCHEMA).parquet(self.path)
        # A digest is appended once, so there is nothing to aggregate, and the join below can split a popular digest.
        return rows.where(F.col("version") == version).select("digest", "n_tokens")

    def append(self, counts: DataFrame, version: str) -> None:
        counts.select(F.lit(version).alias("version"), "digest", "n_tokens").write.mode("append").partitionBy("version").parquet(self.path)


def _distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen: set[bytes] = set()
    for batch in batches:
        keep = []
        for i, digest in enumerate(batch.column("digest").to_pylist()):
            if digest not in seen:
                seen.add(digest)
                keep.append(i)
        yield batch.take(pa.array(keep, pa.int64()))


def token_counts(docs: DataFrame, cache: CountCache, tokenizer: str | None = None, limit: int = LIMIT_TOKENS) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every whole text."""
    spark = docs.sparkSession
    path = tokenizer or vocabulary_path(VOCABULARY)
    version = tokenizer_version(path)
    text = F.coalesce("text", F.lit(""))
    normal = F.regexp_replace(text, "[ \\t\\n]+", " ")
    rows = docs.select(id_column(), F.octet_length(text).cast("long").alias("n_bytes"), F.unhex(F.sha2(normal, 256)).alias("digest"))
    texts = docs.select(normal.alias("text")).select(F.unhex(F.sha2("text", 256)).alias("digest"), "text")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, seen = word_bpe(path), set()
        for part in text_slices(batches):
            fresh = next(_distinct([part]))
            digests = fresh.column("digest").to_pylist()
            keep = [i for i, d in enumerate(digests) if d not in seen]
            seen.update(digests)
            _, at = bpe.encode([fresh.column("text")[i].as_py() for i in keep])
            yield pa.RecordBatch.from_arrays([pa.array([digests[i] for i in keep], pa.binary()), pa.array(np.diff(at), pa.int64())], names=["digest", "n_tokens"])

    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), input_partitions(docs))
    distinct = texts.mapInArrow(_distinct, "digest binary, text string").repartition(n, "digest")
    misses = distinct.join(cache.read(version), "digest", "left_anti")
    cache.append(misses.mapInArrow(encode, "digest binary, n_tokens long"), version)
    counted = rows.join(cache.read(version), "digest")
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"), CountCache(spark, scratch_path(spark, "op7-cache")))
