"""Document fingerprints from prefix polynomial hashes.

A text's prefix arrays hold, for two primes, the polynomial hash of every prefix of its code points; the hash of any
span follows from two entries and one power, so spans compare in constant time and longest common extensions by
binary search (``PrefixHashes.extension``). A fingerprint is 64 registers of 16 bits in hex: each span of ``SPAN`` code
points picks a register and a value by its hash, a register keeps the least; empty registers borrow from the first
filled one in a seeded order. The likeness of two fingerprints is the share of equal registers, less what chance gives.

``edit_neighbours`` needs the next document in descending doc_id. Documents go to ranges of doc_id; a range also gets the
largest document of the range below it (the last range the largest of all), so that texts are shuffled once.

Nulls: a null text is empty; a null doc_id sorts after all others. Rows that repeat a doc_id follow in the order of their
texts. A text shorter than ``SPAN`` is one span; the empty text has a fingerprint of its own. Other columns are ignored,
an empty table gives an empty result, and a single document is its own next.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import id_column, input_partitions, mix64, table, text_slices

PRIMES = ((1 << 31) - 1, (1 << 31) - 19)
BASES = (1_103_515_245, 1_664_525)
REGISTERS = 64
SPAN = 12
_U = np.uint64
_PROBES = np.stack([np.random.default_rng(10_001 + k).permutation(REGISTERS) for k in range(REGISTERS)], axis=1)


def _powers(base: int, prime: int, n: int) -> np.ndarray:
    out = np.ones(1, dtype=_U)
    while len(out) < n:
        out = np.concatenate([out, out * _U(pow(base, len(out), prime)) % _U(prime)])
    return out[:n]


class PrefixHashes:
    """Prefix arrays of an array of code points, and the equality of spans that they answer."""

    #: Powers of each base (or inverse) and prime, the longest asked for.
    _tables: dict[tuple[int, int], np.ndarray] = {}

    def __init__(self, codes: np.ndarray):
        self.n = len(codes)
        self.prefix = []
        for base, prime in zip(BASES, PRIMES, strict=True):
            terms = (codes.astype(_U) + _U(1)) * self.powers(base, prime)[: self.n] % _U(prime)
            self.prefix.append(np.concatenate([np.zeros(1, dtype=_U), np.cumsum(terms, dtype=_U)]))

    def powers(self, base: int, prime: int) -> np.ndarray:
        if len(self._tables.get((base, prime), ())) <= self.n:
            self._tables[base, prime] = _powers(base, prime, self.n + self.n // 8 + 1)
        return self._tables[base, prime]

    def spans(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """62-bit hash of each span: both residues, moved to the same power."""
        out = np.zeros(len(start), dtype=_U)
        for prefix, base, prime in zip(self.prefix, BASES, PRIMES, strict=True):
            # a multiple of the power of the start becomes one of the highest power
            out = (out << _U(31)) | ((prefix[end] - prefix[start]) % _U(prime) * self.powers(base, prime)[self.n - start] % _U(prime))
        return out

    def extension(self, a: np.ndarray, b: np.ndarray, limit: np.ndarray) -> np.ndarray:
        """Longest common extension from places a and b, at most ``limit``, by binary search."""
        low, high = np.zeros_like(limit), limit.copy()
        while (low < high).any():
            mid = (low + high + 1) // 2
            same = self.spans(a, a + mid) == self.spans(b, b + mid)
            low, high = np.where(same, mid, low), np.where(same, high, mid - 1)
        return low


def fingerprints(texts: list[str]) -> list[np.ndarray]:
    """The registers of each text, from the prefix arrays of all of them together."""
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    n = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
    first = np.cumsum(n) - n
    hashes = PrefixHashes(codes)
    count = np.where(n > SPAN, n - SPAN + 1, 1)
    text = np.repeat(np.arange(len(n)), count)
    start = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + first[text]
    end = np.minimum(start + SPAN, (first + n)[text])
    # Spans of one slice share its highest power; the residue is brought to the power of an empty prefix.
    value = mix64(_at_zero(hashes, start, end) ^ ((end - start).astype(_U) << _U(56)))
    cell = text * REGISTERS + (value >> _U(58)).astype(np.int64)
    least = np.full(len(n) * REGISTERS, ~_U(0), dtype=_U)
    np.minimum.at(least, cell, value << _U(6))
    filled = np.zeros(len(least), dtype=bool)
    filled[cell] = True
    regs = (mix64(least) & _U(0xFFFF)).astype(np.uint16).reshape(-1, REGISTERS)
    filled = filled.reshape(-1, REGISTERS)
    row, col = np.nonzero(~filled)
    for probe in _PROBES:
        if not len(row):
            break
        hit = filled[row, probe[col]]
        regs[row[hit], col[hit]] = regs[row[hit], probe[col[hit]]]
        row, col = row[~hit], col[~hit]
    return list(regs)


def _at_zero(hashes: PrefixHashes, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Span hashes that do not depend on the slice: divided by the power of the start."""
    out = np.zeros(len(start), dtype=_U)
    for prefix, base, prime in zip(hashes.prefix, BASES, PRIMES, strict=True):
        inverse = hashes.powers(pow(base, -1, prime), prime)
        out = (out << _U(31)) | ((prefix[end] - prefix[start]) % _U(prime) * inverse[start] % _U(prime))
    return out


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Share of equal registers, less what chance gives, from 0 to 1."""
    chance = 1 / (1 << 16)
    return max(0.0, (float((a == b).mean()) - chance) / (1 - chance))


def fingerprint_hex(registers: np.ndarray) -> str:
    return registers.astype(">u2").tobytes().hex()


def edited(text: str, following: str) -> str:
    """``text`` with its last third replaced by as much of the start of ``following``."""
    k = len(text) // 3
    return text[: len(text) - k] + following[:k]


def _ranges(docs: DataFrame) -> tuple[DataFrame, int]:
    """(doc_id, text, range, halo): the documents by ranges of doc_id, each range with the document that follows its last."""
    spark = docs.sparkSession
    rows = docs.select(id_column(), F.coalesce("text", F.lit("")).alias("text"))
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * input_partitions(docs))
    cuts = rows.where("doc_id is not null").agg(F.percentile_approx("doc_id", [i / parts for i in range(1, parts)], 10_000).alias("cuts")).first().cuts or []
    cuts = sorted(set(cuts))
    place = F.lit(0)
    if cuts:
        place = F.coalesce(F.when(F.col("doc_id").isNull(), F.lit(0)), _bisect(F.col("doc_id"), cuts) + 1)
    ranged = rows.withColumn("range", place.cast("int"))
    # A document that follows: the largest of the nearest filled range below, or of all for the lowest range.
    tops = ranged.groupBy("range").agg(F.max(F.struct(F.col("doc_id").isNotNull().alias("there"), "doc_id", F.xxhash64("text").alias("mark"), F.length("text").alias("size"))).alias("top"))
    top = Window.orderBy("range")
    tops = tops.select((F.coalesce(F.lead("range").over(top), F.first("range").over(top.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))).alias("halo_range"), "range", "top")
    wanted = tops.select("halo_range", F.col("range").alias("from_range"), F.col("top.doc_id").alias("top_id"), F.col("top.mark").alias("mark"), F.col("top.size").alias("size"))
    halo = ranged.join(F.broadcast(wanted), (F.col("range") == F.col("from_range")) & F.col("doc_id").eqNullSafe(F.col("top_id")) & (F.xxhash64("text") == F.col("mark")) & (F.length("text") == F.col("size")))
    halo = halo.select("doc_id", "text", F.col("halo_range").alias("range")).dropDuplicates(["range"])
    both = ranged.select("doc_id", "text", "range", F.lit(False).alias("halo")).unionByName(halo.withColumn("halo", F.lit(True)))
    return both, len(cuts) + 1


def _bisect(value, cuts: list[int]):
    """Number of cuts below ``value``; the cuts are one array literal, searched by halving."""
    array = F.lit(cuts)
    state = F.struct(F.lit(0).alias("lo"), F.lit(len(cuts)).alias("hi"))
    steps = F.sequence(F.lit(1), F.lit(max(1, len(cuts).bit_length() + 1)))

    def halve(s, _):
        mid = F.floor((s["lo"] + s["hi"]) / 2).cast("int")
        above = F.get(array, mid) < value
        return F.struct(F.when(s["lo"] < s["hi"], F.when(above, mid + 1).otherwise(s["lo"])).otherwise(s["lo"]).alias("lo"), F.when(s["lo"] < s["hi"], F.when(above, s["hi"]).otherwise(mid)).otherwise(s["hi"]).alias("hi"))

    return F.aggregate(steps, state, halve, lambda s: s["lo"])


def edit_neighbours(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next and unchanged (common prefix of text and edited text)."""
    both, n = _ranges(docs)
    # Descending doc_id, nulls last, then text; the document carried over comes last in its range.
    ordered = both.repartitionById(n, F.col("range")).sortWithinPartitions("range", "halo", F.col("doc_id").desc_nulls_last(), F.col("text").desc())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple | None = None  # (doc_id, text, range, registers) that waits for its next
        for part in text_slices(batches):
            ids, texts = part.column("doc_id").to_pylist(), part.column("text").to_pylist()
            places, halo = part.column("range").to_pylist(), part.column("halo").to_pylist()
            own = fingerprints(texts)
            rows = ([last] if last else []) + list(zip(ids, texts, places, own, halo, strict=True))
            last = None if rows[-1][4] else rows[-1]
            done = [(a, b) for a, b in zip(rows, rows[1:]) if not a[4] and a[2] == b[2]]
            if not done:
                continue
            changed = [edited(a[1], b[1]) for a, b in done]
            prints = fingerprints(changed)
            pairs = PrefixHashes(np.frombuffer("".join(a[1] + c for (a, _), c in zip(done, changed, strict=True)).encode("utf-32-le", "surrogatepass"), dtype=np.uint32))
            n_a, n_c = np.array([len(a[1]) for a, _ in done]), np.array([len(c) for c in changed])
            at = np.cumsum(n_a + n_c) - n_a - n_c
            common = pairs.extension(at, at + n_a, np.minimum(n_a, n_c))
            yield pa.RecordBatch.from_arrays([
                pa.array([a[0] for a, _ in done], pa.int64()), pa.array(n_a), pa.array([hashlib.sha256(c.encode("utf-8", "surrogatepass")).hexdigest() for c in changed]),
                pa.array([fingerprint_hex(a[3]) for a, _ in done]), pa.array([fingerprint_hex(p) for p in prints]),
                pa.array([likeness(a[3], p) for (a, _), p in zip(done, prints, strict=True)]), pa.array([likeness(a[3], b[3]) for a, b in done]), pa.array(common),
            ], names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "unchanged"])

    return ordered.mapInArrow(run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, unchanged long")


def op10_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edit_neighbours(table(spark, sf_dir, "documents"))
