"""Shared helpers of the corpus operators: scratch tables, Arrow text buffers and span hashing."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Text bytes handled at once inside a Python worker; bounds its memory.
SLICE_BYTES = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Paths of the scratch tables of this driver, in the order they were made.
_MADE: list[str] = []


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder of the cluster, or a temporary one where none is set and all tasks run on this machine (tests)."""
    sc = spark.sparkContext
    base = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("quillspark.scratch.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="quillspark-")
        spark.conf.set("quillspark.scratch.dir", base)
    return base


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder, removed when the driver's JVM ends if not before."""
    path = f"{scratch_dir(spark)}/{label}-{uuid.uuid4().hex}"
    hpath, fs = _located(spark, path)
    fs.deleteOnExit(hpath)
    _MADE.append(path)
    return path


def _located(spark: SparkSession, path: str):
    hpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hpath, hpath.getFileSystem(spark._jsc.hadoopConfiguration())


def _remove(spark: SparkSession, paths: Iterable[str]) -> None:
    for path in paths:
        hpath, fs = _located(spark, path)
        fs.delete(hpath, True)


def materialise(df: DataFrame, label: str, *partition_by: str) -> DataFrame:
    """Cut the lineage: write ``df`` to the shared folder and read it back."""
    spark, schema = df.sparkSession, df.schema
    path = scratch_path(spark, label)
    writer = df.write.option("compression", "zstd")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    out = spark.read.schema(schema).parquet(path)
    out.scratch_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Remove scratch tables that nothing reads any more."""
    for df in tables:
        _remove(df.sparkSession, [df.scratch_path])


def settled(spark: SparkSession, label: str, make: Callable[[], DataFrame]) -> DataFrame:
    """What ``make`` returns, written to the shared folder; the scratch tables made on the way are removed."""
    mark = len(_MADE)
    out = materialise(make(), label)
    _remove(spark, _MADE[mark:-1])
    del _MADE[mark:-1]
    return out


def input_partitions(df: DataFrame) -> int:
    return max(1, df.rdd.getNumPartitions())


def text_slices(batches: Iterable[pa.RecordBatch], limit: int = SLICE_BYTES, column: str = "text") -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that each holds about ``limit`` bytes of text and whole rows."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        size = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0), dtype=np.int64) + 1)
        lo = 0
        while lo < n:
            base = size[lo - 1] if lo else 0
            hi = max(lo + 1, int(np.searchsorted(size, base + limit, side="right")))
            yield batch.slice(lo, hi - lo)
            lo = hi


def utf8_buffer(texts: pa.Array, after: str = "\0") -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all rows, the byte ``after`` behind each row, and the n+1 offsets of the rows. Nulls are empty."""
    joined = pc.binary_join_element_wise(pc.fill_null(texts.cast(pa.large_string()), ""), pa.scalar("", pa.large_string()), pa.scalar(after, pa.large_string()))
    joined = pa.concat_arrays([joined])
    offsets = np.frombuffer(joined.buffers()[1], dtype=np.int64)[joined.offset : joined.offset + len(joined) + 1]
    data = np.frombuffer(joined.buffers()[2], dtype=np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


_U = np.uint64
#: The Mersenne prime of the span hashes.
PRIME = (1 << 61) - 1
#: Symbols taken at once, so that the arrays stay in the processor's cache.
_STEP = 1 << 16


def mix64(x: np.ndarray) -> np.ndarray:
    """The finaliser of MurmurHash3 on unsigned 64-bit values."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> _U(33)
    x *= _U(0xFF51AFD7ED558CCD)
    x ^= x >> _U(33)
    x *= _U(0xC4CEB9FE1A85EC53)
    x ^= x >> _U(33)
    return x


def _reduced(x: np.ndarray) -> np.ndarray:
    """x modulo PRIME, for any unsigned 64-bit x."""
    x = (x & _U(PRIME)) + (x >> _U(61))
    return np.where(x >= _U(PRIME), x - _U(PRIME), x)


def times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a * b modulo PRIME, for a and b below it, from products of their halves (2**61 is 1, so 2**62 is 2)."""
    a1, a0, b1, b0 = a >> _U(31), a & _U(0x7FFFFFFF), b >> _U(31), b & _U(0x7FFFFFFF)
    cross = a1 * b0 + a0 * b1
    return _reduced(((a1 * b1) << _U(1)) + (cross >> _U(30)) + ((cross & _U(0x3FFFFFFF)) << _U(31)) + a0 * b0)


class SpanHasher:
    """Hash of any span of an array of symbols (below 2**12) from one prefix array: a polynomial modulo a prime of 61 bits.

    Two different spans of n symbols share a hash for at most n of the 2**61 bases; where equality decides a result, callers
    compare the symbols too.
    """

    #: Powers of each base and of its inverse, shared by all hashers of a worker.
    _tables: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def __init__(self, seed: int):
        self.base = (int(mix64(np.array([seed], dtype=np.uint64))[0]) * 0x9E3779B97F4A7C15 + seed) % (PRIME - 2**32) + 2**32

    def _grow(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if self.base not in self._tables or len(self._tables[self.base][0]) < n:
            self._tables[self.base] = (_powers(self.base, n + n // 8), _powers(pow(self.base, -1, PRIME), n + n // 8))
        return self._tables[self.base]

    def prefix(self, symbols: np.ndarray) -> np.ndarray:
        powers, _ = self._grow(len(symbols) + 1)
        out, carry = np.zeros(len(symbols) + 1, dtype=np.uint64), _U(0)
        for lo in range(0, len(symbols), _STEP):
            code, power = symbols[lo : lo + _STEP].astype(np.uint64) + _U(1), powers[lo : lo + _STEP][: len(symbols) - lo]
            low, high = np.cumsum(code * (power & _U(0xFFFFFFFF))), np.cumsum(code * (power >> _U(32)))
            part = _reduced(low + (high >> _U(29)) + ((high & _U(0x1FFFFFFF)) << _U(32)) + carry)
            out[lo + 1 : lo + 1 + len(part)] = part
            carry = part[-1]
        return out

    def spans(self, prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hashes of the spans; they depend on the symbols and the length alone."""
        _, inverses = self._grow(len(prefix))
        there = _reduced(prefix[end] + _U(PRIME) - prefix[start])
        return mix64(times(there, inverses[start]) + (end - start).astype(np.uint64) * _U(0x9E3779B97F4A7C15))

    def windows(self, prefix: np.ndarray, width: int) -> np.ndarray:
        """Hashes of all spans of ``width`` symbols, unmixed."""
        _, inverses = self._grow(len(prefix))
        out = np.empty(max(0, len(prefix) - width), dtype=np.uint64)
        for lo in range(0, len(out), _STEP):
            hi = min(lo + _STEP, len(out))
            out[lo:hi] = times(_reduced(prefix[lo + width : hi + width] + _U(PRIME) - prefix[lo:hi]), inverses[lo:hi])
        return out


def _powers(base: int, n: int) -> np.ndarray:
    out = np.ones(1, dtype=np.uint64)
    while len(out) < n:
        out = np.concatenate([out, times(out, np.full(1, pow(base, len(out), PRIME), dtype=np.uint64))])
    return out[:n]


def equal_spans(data: np.ndarray, a: np.ndarray, other: np.ndarray, b: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Whether the symbols of each span data[a:a + length] are those of other[b:b + length]."""
    out = np.ones(len(length), dtype=bool)
    upto = np.cumsum(length)
    lo = 0
    while lo < len(length):  # so many symbols at once
        hi = max(lo + 1, int(np.searchsorted(upto, (upto[lo - 1] if lo else 0) + _STEP, side="right")))
        n = length[lo:hi]
        at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        bad = data[np.repeat(a[lo:hi], n) + at] != other[np.repeat(b[lo:hi], n) + at]
        if bad.any():
            out[lo + np.repeat(np.arange(hi - lo), n)[bad]] = False
        lo = hi
    return out


def id_column(name: str = "doc_id"):
    return F.col(name).cast("long").alias("doc_id")


def empty_like(schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([], f.type) for f in schema], schema=schema)


def spaced_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of the runs free of ASCII white space in a buffer whose rows end in white space, and the first run of each row."""
    space = (data == 32) | ((data >= 9) & (data <= 13))
    edge = np.diff((~space).astype(np.int8), prepend=0)
    start = np.flatnonzero(edge == 1)
    return start, np.flatnonzero(edge == -1), np.searchsorted(start, offsets)


def row_sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of the runs of ``values`` cut at ``first`` (n+1 places)."""
    return np.diff(np.concatenate([[0.0], np.cumsum(values, dtype=np.float64)])[first])
