"""Benchmark decontamination: Wu-Manber search for the windows of benchmark items in whole documents.

Words are lower-cased runs of letters, digits and non-ASCII signs. A pattern is a window of ``WINDOW`` consecutive words
of an item, or the whole item if it has fewer. Patterns of one length are searched together: a block of words at the
end of the window looks up how far the window may jump (0 where some pattern ends in that block), the hash of the
last words picks the bucket of patterns that end so, and those are compared word by word, then byte by byte. All
strips of a slice of documents move at once, each from its own place.

A pattern is a place in the numbered words of all items, so the tables take about 32 bytes a word and are broadcast. Their
size is checked: items of more than ``SLICE_BYTES`` of text are cut into slices that fit, each is searched on its own, and
the hits of a document are united by a grouped pass. Words are numbered by hashes that tell all words of the items apart, and
the bytes of each occurrence are compared, so no result rests on a hash.

Nulls: a null text has no words; an item whose id or text is null or has no words has no window; a null doc_id keeps its
row. Repeated item ids count once, repeated documents each get a row. Other columns are ignored; either table may be empty.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SpanHasher, equal_spans, id_column, materialise, mix64, scratch_path, table, text_slices, utf8_buffer

WINDOW = 10
STRIP = 192
#: Bytes of the items' texts searched at once.
SLICE_BYTES = 16 << 20
_SHIFT_BITS = 16
#: Key of a row where several searches are united.
_ROW = "op6_row"


def _byte_tables() -> tuple[np.ndarray, np.ndarray]:
    lower = np.arange(256, dtype=np.uint8)
    lower[65:91] += 32
    word = np.zeros(256, dtype=bool)
    word[48:58] = word[97:123] = word[128:] = True
    return lower, word


_LOWER, _WORD = _byte_tables()


@dataclass
class Words:
    """The words of a slice of texts: bytes, spans and hashes, and the first word of each text."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    hashes: np.ndarray
    first: np.ndarray  # n_texts + 1


def words_of(texts: pa.Array, hasher: SpanHasher) -> Words:
    data, offsets = utf8_buffer(texts)
    data = _LOWER[data]
    inside = np.zeros(len(data) + 1, dtype=np.int8)
    inside[:-1] = _WORD[data]  # the NUL after each text ends its last word
    edge = np.diff(inside, prepend=0)
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    hashes = hasher.spans(hasher.prefix(data), start, end)
    return Words(data, start, end, hashes, np.searchsorted(start, offsets))


@dataclass
class WuManber:
    """Patterns of ``size`` words each, by their places in the word numbers of all items; word 0 is a word of no pattern."""

    size: int
    sequence: np.ndarray
    place: np.ndarray  # of each distinct pattern
    items_at: np.ndarray  # pattern -> its items, by offsets
    items: np.ndarray
    block: int = field(init=False)
    shift: np.ndarray = field(init=False)
    bucket_keys: np.ndarray = field(init=False)
    bucket_at: np.ndarray = field(init=False)
    order: np.ndarray = field(init=False)

    def __post_init__(self):
        m = self.size
        self.block = min(2, m)
        self.shift = np.full(1 << _SHIFT_BITS, m - self.block + 1, dtype=np.int32)
        for end in range(self.block, m + 1):  # rightmost blocks last, they shift least
            np.minimum.at(self.shift, self._block_hash(self.sequence, self.place + end - 1), m - end)
        suffix = self._suffix(self.sequence, self.place + m - 1)
        self.order = np.argsort(suffix, kind="stable").astype(np.int32)
        self.bucket_keys, first = np.unique(suffix[self.order], return_index=True)
        self.bucket_at = np.append(first, len(suffix)).astype(np.int32)

    def _block_hash(self, words: np.ndarray, last: np.ndarray) -> np.ndarray:
        h = words[last - self.block + 1].astype(np.uint64)
        for k in range(2 - self.block, 1):
            h = h * np.uint64(0x9E3779B97F4A7C15) + words[last + k].astype(np.uint64)
        return ((h * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(64 - _SHIFT_BITS)).astype(np.int64)

    def _suffix(self, words: np.ndarray, last: np.ndarray) -> np.ndarray:
        """Hash of the last words of a window, up to four."""
        return _run_hash(words, last, min(4, self.size))

    def search(self, words: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(last word, pattern) of each occurrence in texts that are runs of ``words`` cut at ``first``."""
        m = self.size
        begin, end = first[:-1] + m - 1, first[1:]  # places of a window's last word
        long = end > begin
        begin, end = begin[long], end[long]
        strips = -(-(end - begin) // STRIP)
        lane = np.repeat(begin, strips) + STRIP * (np.arange(strips.sum()) - np.repeat(np.cumsum(strips) - strips, strips))
        stop = np.minimum(lane + STRIP, np.repeat(end, strips))
        found = []
        while len(lane):
            jump = self.shift[self._block_hash(words, lane)]
            found.append(lane[jump == 0])
            lane = lane + np.maximum(jump, 1)
            going = lane < stop
            lane, stop = lane[going], stop[going]
        last = np.concatenate(found) if found else np.empty(0, dtype=np.int64)
        if not len(last):
            return last, last
        at = np.minimum(np.searchsorted(self.bucket_keys, suffix := self._suffix(words, last)), len(self.bucket_keys) - 1)
        hit = self.bucket_keys[at] == suffix
        last, at = last[hit], at[hit]
        n = self.bucket_at[at + 1] - self.bucket_at[at]
        which = np.repeat(np.arange(len(last)), n)
        pattern = self.order[np.repeat(self.bucket_at[at] - np.cumsum(n) + n, n) + np.arange(n.sum())]
        for k in range(m):  # word by word, of those that agree so far
            same = words[last[which] - k] == self.sequence[self.place[pattern] + m - 1 - k]
            which, pattern = which[same], pattern[same]
        return last[which], pattern


def _run_hash(words: np.ndarray, last: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n words that end at each place."""
    h = np.zeros(len(last), dtype=np.uint64)
    for k in range(1 - n, 1):
        h = (h + words[last + k].astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return h


@dataclass
class Patterns:
    hasher: SpanHasher
    hashes: np.ndarray  # sorted hashes of the vocabulary; word number = place + 1
    spelling: np.ndarray  # bytes of the vocabulary, one word after the other
    spelled_at: np.ndarray
    item_ids: list[str]
    machines: list[WuManber]

    def number(self, words: Words) -> np.ndarray:
        """Word numbers, 0 for a word of no pattern."""
        if not len(self.hashes):
            return np.zeros(len(words.hashes), dtype=np.int32)
        at = np.minimum(np.searchsorted(self.hashes, words.hashes), len(self.hashes) - 1)
        return np.where(self.hashes[at] == words.hashes, at + 1, 0).astype(np.int32)

    def spelled(self, words: Words, numbers: np.ndarray, last: np.ndarray, size: int) -> np.ndarray:
        """Direct comparison of the words of each occurrence, each distinct place once."""
        places = np.unique(last[:, None] + np.arange(1 - size, 1))
        own, length = numbers[places] - 1, words.end[places] - words.start[places]
        same = self.spelled_at[own + 1] - self.spelled_at[own] == length
        same[same] = equal_spans(words.data, words.start[places][same], self.spelling, self.spelled_at[own[same]], length[same])
        return np.ones(len(last), dtype=bool) if same.all() else ~np.isin(last[:, None] + np.arange(1 - size, 1), places[~same]).any(axis=1)


def build_patterns(items: list[tuple[object, str | None]], window: int = WINDOW) -> Patterns:
    items = sorted({(str(i), t) for i, t in items if i is not None and t})
    ids = sorted({i for i, _ in items})
    no = {i: k for k, i in enumerate(ids)}
    texts, seed = pa.array([t for _, t in items], pa.large_string()), 6_001
    while True:
        w = words_of(texts, hasher := SpanHasher(seed))
        hashes, where, number = np.unique(w.hashes, return_index=True, return_inverse=True)
        length, first = w.end - w.start, where[number]
        if (length == length[first]).all() and equal_spans(w.data, w.start, w.data, w.start[first], length).all():
            break
        seed += 1  # two words of one hash
    size = np.diff(w.first)
    item = np.repeat([no[i] for i, _ in items], size).astype(np.int32)
    left = np.repeat(w.first[1:], size) - np.arange(len(item))  # words from here to the end of the item
    sizes = np.minimum(np.repeat(size, size), window)
    sequence = (number + 1).astype(np.int32)
    machines = [_machine(int(m), sequence, np.flatnonzero((sizes == m) & (left >= m)), item) for m in np.unique(sizes)]
    spelled_at = np.concatenate([[0], np.cumsum(length[where])])
    take = np.repeat(w.start[where] - spelled_at[:-1], length[where]) + np.arange(spelled_at[-1])
    return Patterns(hasher, hashes, w.data[take], spelled_at, ids, machines)


def _machine(m: int, sequence: np.ndarray, place: np.ndarray, item: np.ndarray) -> WuManber:
    """The machine of the windows of m words at ``place``; equal windows are one pattern with the items of all."""
    h = mix64(_run_hash(sequence, place + m - 1, m))
    order = np.lexsort((item[place], h))
    place, h = place[order], h[order]
    new = np.ones(len(place), dtype=bool)
    new[1:] = h[1:] != h[:-1]
    for k in range(m):  # windows of one hash that differ
        new[1:] |= sequence[place[1:] + k] != sequence[place[:-1] + k]
    fresh = new.copy()
    fresh[1:] |= item[place[1:]] != item[place[:-1]]
    at = np.append(np.flatnonzero(new[fresh]), fresh.sum()).astype(np.int32)
    return WuManber(m, sequence, place[new].astype(np.int32), at, item[place[fresh]])


def scan(texts: pa.Array, patterns: Patterns) -> tuple[Words, np.ndarray, list[list[int]]]:
    """Words of the texts, which of them are hit, and the numbers of the items found in each text."""
    words = words_of(texts, patterns.hasher)
    numbers = patterns.number(words)
    cover = np.zeros(len(numbers) + 1, dtype=np.int64)
    pairs = []
    for machine in patterns.machines:
        last, pattern = machine.search(numbers, words.first)
        if len(last):
            ok = patterns.spelled(words, numbers, last, machine.size)
            last, pattern = last[ok], pattern[ok]
            np.add.at(cover, last - machine.size + 1, 1)
            np.add.at(cover, last + 1, -1)
            n = machine.items_at[pattern + 1] - machine.items_at[pattern]
            item = machine.items[np.repeat(machine.items_at[pattern] - np.cumsum(n) + n, n) + np.arange(n.sum())]
            text = np.searchsorted(words.first, np.repeat(last, n), side="right") - 1
            pairs.append(np.unique(text * len(patterns.item_ids) + item))
    found: list[list[int]] = [[] for _ in range(len(texts))]
    if pairs:
        for text, item in zip(*np.divmod(np.unique(np.concatenate(pairs)), len(patterns.item_ids)), strict=True):
            found[text].append(int(item))
    return words, np.cumsum(cover[:-1]) > 0, found


def _digest(items: list[str]) -> str:
    return hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()


_RESULT = "n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"
_UNITED = "n_words long, items array<string>, spans array<struct<s: int, e: int>>"


def _search(docs: DataFrame, items: list, window: int, unite: bool, keep_text: bool = False) -> DataFrame:
    """The columns of ``docs``, without text unless it is to be kept, with those of a search, or with what is needed to unite several."""
    shared = docs.sparkSession.sparkContext.broadcast(build_patterns(items, window))
    kept = [f for f in docs.schema if keep_text or f.name != "text"]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in kept] + [_UNITED if unite else _RESULT])
    names = [c.split()[0] for c in ("n_words l, items a, spans a" if unite else _RESULT).split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        patterns = shared.value
        for part in text_slices(batches):
            words, hit, found = scan(part.column("text"), patterns)
            items_of = [[patterns.item_ids[i] for i in f] for f in found]
            n_words = pa.array(np.diff(words.first), pa.int64())
            if unite:
                edges = [np.flatnonzero(np.diff(hit[a:b].astype(np.int8), prepend=0, append=0)).reshape(-1, 2).tolist() for a, b in zip(words.first[:-1], words.first[1:], strict=True)]
                spans = pa.array([[{"s": a, "e": b} for a, b in e] for e in edges], pa.list_(pa.struct([("s", pa.int32()), ("e", pa.int32())])))
                columns = [n_words, pa.array(items_of, pa.list_(pa.string())), spans]
            else:
                n_hit = np.diff(np.concatenate([[0], np.cumsum(hit)])[words.first])
                columns = [n_words, pa.array(n_hit, pa.int64()), pa.array([len(f) for f in found], pa.int64()), pa.array([_digest(x) for x in items_of]), pa.array(n_hit > 0)]
            yield pa.RecordBatch.from_arrays([*(part.column(f.name) for f in kept), *columns], names=[*(f.name for f in kept), *names])

    return docs.mapInArrow(run, schema)


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, slice_bytes: int = SLICE_BYTES, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256 and contaminated of every document, and the columns ``carry``."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.col("text")).where("item_id is not null and text is not null")
    total = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n")).first().n
    keep_text = "text" in carry  # sent to the search once, also if it is to be kept
    rows = docs.select(id_column(), *(c for c in carry if c != "text"), "text")
    if total <= slice_bytes:
        return _search(rows, [tuple(r) for r in items.collect()], window, False, keep_text)
    n = -(-2 * total // slice_bytes)
    sliced = materialise(items.withColumn("slice", F.pmod(F.xxhash64("item_id", "text"), F.lit(n))), "op6-items")
    rows = materialise(rows.withColumn(_ROW, F.monotonically_increasing_id()), "op6-rows")
    path = scratch_path(docs.sparkSession, "op6-hits")
    for k in range(n):
        own = [(r.item_id, r.text) for r in sliced.where(F.col("slice") == k).toLocalIterator()]
        hits = _search(rows.select(_ROW, "text"), own, window, unite=True)
        (hits if k == 0 else hits.where(F.size("items") > 0)).write.mode("append").parquet(path)  # the first slice has a row for each document
    one = docs.sparkSession.read.parquet(path).groupBy(_ROW).agg(
        F.max("n_words").alias("n_words"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
        F.flatten(F.collect_list("spans")).alias("spans"))
    union = F.aggregate(
        F.array_sort("spans"), F.struct(F.lit(0).alias("upto"), F.lit(0).cast("long").alias("n")),
        lambda a, x: F.struct(F.greatest(a["upto"], x["e"]).alias("upto"), (a["n"] + F.greatest(F.lit(0), x["e"] - F.greatest(a["upto"], x["s"]))).cast("long").alias("n")), lambda a: a["n"])
    one = one.select(_ROW, "n_words", union.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"))
    return (rows if keep_text else rows.drop("text")).join(one, _ROW).drop(_ROW).withColumn("contaminated", F.col("n_hit") > 0)


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
