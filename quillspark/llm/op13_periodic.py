"""Periodic runs of words: every maximal stretch that repeats itself at least ``MIN_EXPONENT`` times with its smallest period.

All lags are scanned, for many documents at once: the array of word ids is compared with itself shifted by p, for each p up to
n / MIN_EXPONENT, and a true stretch of k places is a run of k + p words. A stretch that counts is at least 3 p places long, so a
shift is compared first at every place of a grid that meets such a stretch four times in a row, and in full only where four in a row
agree. A run found again under a multiple of its period covers the same words, so of equal stretches the least lag stays.

Texts of more than ``LONG_BYTES`` are scanned apart: Spark deals (document, lags from 2^k up to 2^(k+1)) over the machines and brings
the runs of a document back to its words. Such a document sends its word ids once for each doubling of the lag.

Rows: a null text has no words; a null doc_id keeps its row and its words. Rows that repeat a doc_id are documents of their own.
Equal exponents go by the smallest start, then period. Other columns are ignored, an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import id_column, input_partitions, materialise, spaced_words, table, text_slices, utf8_buffer

MIN_EXPONENT, MIN_WORDS = 4, 6
#: Texts beyond this are scanned by ranges of lags.
LONG_BYTES = 1 << 16
#: Places of the grid that a stretch meets at least.
_GRID = 4

SCHEMA = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"
_NAMES = [c.split()[0] for c in SCHEMA.split(", ")]


def rewritten(doc_id: int | None, ids: np.ndarray) -> np.ndarray:
    """Place of the original word that stands at each place: one document in ten repeats the words behind a place of its own."""
    n, places = len(ids), np.arange(len(ids))
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if n and h % 10 == 0:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        places[a:] = a + (places[a:] - a) % p
    return places


def scan(words: np.ndarray, sizes: np.ndarray, low: int = 1, high: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and lag of the stretches that are long enough, for the lags from ``low`` below ``high``.

    ``words`` holds the documents one after another, longest first, and no id in two of them; ``sizes`` their numbers of words.
    """
    found = [(np.empty(0, dtype=np.int64),) * 3]
    upto = np.concatenate([[0], np.cumsum(sizes)])
    last = int(sizes[0]) // MIN_EXPONENT if len(sizes) else 0
    many = np.searchsorted(-sizes, -MIN_EXPONENT * np.arange(last + 1), side="right")
    for p in range(low, min(high or last + 1, last + 1)):
        line = words[: upto[many[p]]]
        need = max(MIN_WORDS - p, (MIN_EXPONENT - 1) * p)
        step = max(1, need // _GRID)
        hit = line[p::step] == line[: len(line) - p : step]
        if len(hit) < _GRID or not (hit[:-3] & hit[1:-2] & hit[2:-1] & hit[3:]).any():
            continue
        same = np.zeros(len(line) - p + 2, dtype=np.int8)
        same[1:-1] = line[p:] == line[: len(line) - p]
        edge = np.flatnonzero(np.diff(same))
        start, stop = edge[::2], edge[1::2]
        keep = stop - start >= need
        found.append((start[keep], stop[keep] + p, np.full(keep.sum(), p)))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _distinct_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Ids, starts and ends of all words in a buffer, the n+1 places of the texts in them, and the buffer."""
    data, offsets = utf8_buffer(texts, after=" ")
    start, end, first = spaced_words(data, offsets)
    cut = np.concatenate([[0], np.cumsum(end - start)])
    packed = data[(data != 32) & ((data < 9) | (data > 13))]
    ids = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(cut), pa.py_buffer(packed)]).dictionary_encode().indices
    return np.asarray(ids).astype(np.int64), start, end, first, data


def _runs_of(start: np.ndarray, end: np.ndarray, lag: np.ndarray) -> np.ndarray:
    """Rows (start, length, period) by start, then period; of equal stretches the least lag."""
    order = np.lexsort((lag, end, start))
    start, end, lag = start[order], end[order], lag[order]
    new = np.ones(len(start), dtype=bool)
    new[1:] = (start[1:] != start[:-1]) | (end[1:] != end[:-1])
    runs = np.stack([start, end - start, lag], axis=1)[new]
    return runs[np.lexsort((runs[:, 2], runs[:, 0]))]


def _result(doc_id: int | None, runs: np.ndarray, words: list[bytes]) -> tuple:
    """A row of the result, from all runs of a document and its words."""
    best, gone = None, np.zeros(len(words) + 1, dtype=np.int64)
    for s, length, q in runs.tolist():
        if best is None or length * best[2] > best[1] * q:  # earlier ones win ties
            best = (s, length, q)
        gone[s + q] += 1
        gone[s + length] -= 1
    listed = "".join(f"{s},{length},{q}\n" for s, length, q in runs.tolist())
    if len(runs):
        words = [w for w, k in zip(words, (np.cumsum(gone)[:-1] == 0).tolist(), strict=True) if k]
    s, length, q = best or (None, None, None)
    return doc_id, len(runs), s, length, q, 1000 * length // q if best else None, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(b" ".join(words)).hexdigest()


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64()] * 6 + [pa.string()] * 2
    return pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(zip(*rows, strict=True), kinds, strict=True)], names=_NAMES)


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Results of documents that are scanned here, a slice of them at once."""
    for part in text_slices(batches):
        doc_ids = part.column("doc_id").to_pylist()
        ids, start, end, first, data = _distinct_words(part.column("text"))
        places = [first[i] + rewritten(doc_id, ids[first[i] : first[i + 1]]) for i, doc_id in enumerate(doc_ids)]
        sizes = np.diff(first)
        order = np.argsort(-sizes, kind="stable")
        apart = int(ids.max(initial=0)) + 1
        line = np.concatenate([ids[places[i]] + k * apart for k, i in enumerate(order.tolist())])
        at = np.cumsum(sizes[order]) - sizes[order]
        s, e, lag = scan(line, sizes[order])
        of = np.searchsorted(at + sizes[order], s, side="right")
        by = np.argsort(of, kind="stable")
        edges = np.searchsorted(of[by], np.arange(len(order) + 1))
        raw, rows = data.tobytes(), [()] * len(order)
        for k, i in enumerate(order.tolist()):
            mine = by[edges[k] : edges[k + 1]]
            runs = _runs_of(s[mine] - at[k], e[mine] - at[k], lag[mine])
            if len(runs) or sizes[i] and places[i][-1] != first[i + 1] - 1:  # has runs, or repeats its words
                words = [raw[a:b] for a, b in zip(start[places[i]].tolist(), end[places[i]].tolist(), strict=True)]
            else:
                words = raw[start[first[i]] : end[first[i + 1] - 1]].split() if sizes[i] else []
            rows[i] = _result(doc_ids[i], runs, words)
        yield _batch(rows)


def _ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(row, low, ids) for each range of lags [low, 2 low) of long documents."""
    for part in text_slices(batches):
        ids, _, _, first, _ = _distinct_words(part.column("text"))
        for i, (row, doc_id) in enumerate(zip(part.column("row").to_pylist(), part.column("doc_id").to_pylist(), strict=True)):
            own = ids[first[i] : first[i + 1]]
            blob = own[rewritten(doc_id, own)].astype("<i4").tobytes()
            lows = [1 << k for k in range(max(0, len(own) // MIN_EXPONENT).bit_length())]
            for low in lows:
                yield pa.RecordBatch.from_arrays([pa.array([row], pa.int64()), pa.array([low], pa.int64()), pa.array([blob], pa.binary())], names=["row", "low", "ids"])


def _scan_ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row, low, blob in zip(batch.column("row").to_pylist(), batch.column("low").to_pylist(), batch.column("ids"), strict=True):
            words = np.frombuffer(blob.as_buffer(), dtype="<i4")
            s, e, lag = scan(words, np.array([len(words)]), low, 2 * low)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(s), row)), pa.array(s), pa.array(e), pa.array(lag)], names=["row", "start", "end", "lag"])


def _together(docs: pa.Table, found: pa.Table) -> pa.Table:
    """The result of one long document from its text and its runs."""
    runs = _runs_of(*(np.asarray(found.column(c)) for c in ("start", "end", "lag")))
    rows = []
    for doc_id, text in zip(docs.column("doc_id").to_pylist(), docs.column("text").to_pylist(), strict=True):
        words = text.encode().split()
        rows.append(_result(doc_id, runs, [words[i] for i in rewritten(doc_id, np.empty(len(words), dtype=np.int8)).tolist()]))
    return pa.Table.from_batches([_batch(rows)])


def periodic_runs(docs: DataFrame, long_bytes: int = LONG_BYTES) -> DataFrame:
    """doc_id, n_runs, the run of the greatest exponent, and digests of all runs and of the words that stay, of every whole text."""
    spark = docs.sparkSession
    rows = docs.select(id_column(), "text")
    short = rows.where(F.coalesce(F.octet_length("text"), F.lit(0)) <= long_bytes).mapInArrow(_whole, SCHEMA)
    long = materialise(rows.where(F.octet_length("text") > long_bytes).withColumn("row", F.monotonically_increasing_id()), "op13-long")
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), input_partitions(long))
    dealt = long.mapInArrow(_ranges, "row long, low long, ids binary").repartition(n, "row", "low")
    found = dealt.mapInArrow(_scan_ranges, "row long, start long, end long, lag long")
    return short.unionByName(long.groupBy("row").cogroup(found.groupBy("row")).applyInArrow(_together, SCHEMA))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs(table(spark, sf_dir, "documents"))
