"""Quality classifier by importance resampling: hashed n-gram models of target and raw text, and Gumbel top-k.

Features of a text are its byte 4-grams (case and signs kept) and the hashed pairs of neighbouring words, in two ranges of
buckets. The raw model counts every document; the target model counts a bounded sample of the documents labelled good
(``TARGET_ROWS`` of them, by a hash of doc_id). The importance ratio of a text is the product of its features' ratios. The
log weight is that of the whole product with ``sharpness`` None. The query departs from it on purpose: taken over whole texts,
the product is ruled by length (a long clean text has a more extreme ratio than any short junk), so its log weight is the mean
log ratio of a feature times ``SHARPNESS``, the ratio of a text of so many average features. Adding a seeded Gumbel draw and
keeping the ``keep`` share of largest keys samples without replacement in proportion to exp(log weight). The cut is found by
counting keys in ever finer ranges, so no ordering of all rows is needed.

Nulls: a null or empty text has log weight 0; rows whose key ties with the cut are all kept; a null doc_id draws as one
document. Empty tables give an empty result, no labels make all weights 0. Repeated rows each get a row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SpanHasher, id_column, materialise, mix64, row_sums, spaced_words, table, text_slices, utf8_buffer

BUCKETS = 1 << 14
TARGET_ROWS = 2000
SHARPNESS = 20.0
KEEP = 0.85
_HASHER = SpanHasher(seed=4_001)


def features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of the byte 4-grams and of the word pairs (these from BUCKETS up), each with the n+1 places where texts begin."""
    data, offsets = utf8_buffer(texts, "\n")
    d = data.astype(np.uint32)
    n = max(0, len(d) - 3)
    chars = (d[:n] << np.uint32(24)) | (d[1 : n + 1] << np.uint32(16)) | (d[2 : n + 2] << np.uint32(8)) | d[3 : n + 3]
    chars = ((chars ^ (chars >> np.uint32(15))) * np.uint32(2654435761) >> np.uint32(18)).astype(np.int64)
    inner = np.ones(n, dtype=bool)
    for k in (1, 2, 3):
        cut = offsets[1:] - k
        inner[cut[(cut >= 0) & (cut < n)]] = False
    char_first = np.concatenate([[0], np.cumsum(inner)])[np.minimum(offsets, n)]
    start, end, first = spaced_words(data, offsets)
    h = _HASHER.spans(_HASHER.prefix(data), start, end)
    pairs = (mix64(h[1:] - h[:-1]) >> np.uint64(64 - 14)).astype(np.int64) + BUCKETS
    inside = np.ones(len(pairs), dtype=bool)
    cut = first[1:-1] - 1
    inside[cut[(cut >= 0) & (cut < len(pairs))]] = False
    pair_first = np.concatenate([[0], np.cumsum(inside)])[np.minimum(first, len(pairs))]
    return chars[inner], char_first, pairs[inside], pair_first


def fit(docs: DataFrame, target_ids: set[int]) -> np.ndarray:
    """Log ratio of target to raw for each bucket, from counts over all documents."""
    shared = docs.sparkSession.sparkContext.broadcast(target_ids)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, target = np.zeros(2 * BUCKETS, dtype=np.int64), np.zeros(2 * BUCKETS, dtype=np.int64)
        for part in text_slices(batches):
            chars, char_first, pairs, pair_first = features(part.column("text"))
            raw += np.bincount(chars, minlength=2 * BUCKETS) + np.bincount(pairs, minlength=2 * BUCKETS)
            own = np.array([i in shared.value for i in part.column("doc_id").to_pylist()], dtype=bool)
            if own.any():
                target += np.bincount(chars[np.repeat(own, np.diff(char_first))], minlength=2 * BUCKETS) + np.bincount(pairs[np.repeat(own, np.diff(pair_first))], minlength=2 * BUCKETS)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(2 * BUCKETS)), pa.array(raw), pa.array(target)], names=["bucket", "raw", "target"])

    counted = docs.select(id_column(), "text").mapInArrow(count, "bucket long, raw long, target long").groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).collect()
    raw, target = np.ones(2 * BUCKETS), np.ones(2 * BUCKETS)
    for r in counted:
        raw[r.bucket] += r.raw
        target[r.bucket] += r.target
    ratio = np.zeros(2 * BUCKETS)
    if target_ids:
        for part in (slice(0, BUCKETS), slice(BUCKETS, None)):
            ratio[part] = np.log(target[part] / target[part].sum()) - np.log(raw[part] / raw[part].sum())
    return ratio.astype(np.float32)


def target_sample(docs: DataFrame, labels: DataFrame, rows: int = TARGET_ROWS, seed: int = 5) -> set[int]:
    """doc_ids of at most about ``rows`` documents labelled good, by a hash of doc_id."""
    good = labels.where("quality = 1 and doc_id is not null").select(id_column()).distinct()
    n = good.count()
    if not n:
        return set()
    picked = good.where(F.xxhash64(F.lit(seed), "doc_id").bitwiseAND((1 << 31) - 1) < min(1 << 31, (rows << 31) // n))
    return {r.doc_id for r in picked.collect()}


def gumbel_keys(docs: DataFrame, ratio: np.ndarray, seed: int = 13, sharpness: float | None = SHARPNESS) -> DataFrame:
    """doc_id, log_weight and key (log weight plus a Gumbel draw seeded by doc_id); without ``sharpness`` the weight is the plain ratio."""
    shared = docs.sparkSession.sparkContext.broadcast(ratio)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches):
            chars, char_first, pairs, pair_first = features(part.column("text"))
            total = row_sums(shared.value[chars], char_first) + row_sums(shared.value[pairs], pair_first)
            n = np.diff(char_first) + np.diff(pair_first)
            weight = total if sharpness is None else sharpness * total / np.maximum(n, 1)
            ids = np.array([0 if i is None else i for i in part.column("doc_id").to_pylist()], dtype=np.int64)
            u = (mix64(ids.view(np.uint64) ^ mix64(np.array([seed], dtype=np.uint64))) >> np.uint64(11)).astype(np.float64) / 2**53
            key = weight - np.log(-np.log(np.clip(u, 1e-300, 1 - 1e-16)))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(weight), pa.array(key)], names=["doc_id", "log_weight", "key"])

    return docs.select(id_column(), "text").mapInArrow(run, "doc_id long, log_weight double, key double")


def kth_largest(rows: DataFrame, column: str, k: int, parts: int = 4096) -> float:
    """The k-th largest value by counting rows in ever finer ranges of values; the driver sees one count a range."""
    low, high = rows.agg(F.min(column), F.max(column)).first()
    if low is None or k <= 0:
        return float("inf")
    while low < high:
        width = (high - low) / parts
        at = F.least(F.floor((F.col(column) - low) / width), F.lit(parts - 1)) if width > 0 else F.lit(0)
        inside = rows.where(F.col(column).between(low, high)).groupBy(at.alias("part")).agg(F.count("*").alias("n"), F.min(column).alias("low"), F.max(column).alias("high"))
        for r in sorted(inside.collect(), key=lambda r: -r.part):
            if r.n >= k:
                if (r.low, r.high) == (low, high):
                    return low
                low, high = r.low, r.high
                break
            k -= r.n
    return low


def resample(docs: DataFrame, labels: DataFrame, keep: float = KEEP, sharpness: float | None = SHARPNESS) -> DataFrame:
    """doc_id, log_weight, key and selected of every document; rows whose keys tie with the last one kept are all selected."""
    ratio = fit(docs, target_sample(docs, labels))
    keys = materialise(gumbel_keys(docs, ratio, sharpness=sharpness), "op4-keys")
    cut = kth_largest(keys, "key", round(keep * keys.count()))
    return keys.withColumn("selected", F.col("key") >= F.lit(cut))


def op4_quality_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
