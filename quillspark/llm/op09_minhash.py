"""Near-duplicate groups by HyperMinHash.

A document's set is the distinct shingles of its lower-cased words. One 64-bit hash of a shingle picks one of 256 buckets
and a value there; a bucket's register keeps the least value as its count of leading zeros (6 bits) and ``MANTISSA`` bits
after the first one. An empty register borrows from the first filled bucket in a seeded order of its own, so that two sets
agree in a register with the chance of their Jaccard similarity, however small they are.

1. Sets that are equal are one from here on (a group of copies of any size costs one row a partition).
2. Bands of ``ROWS`` registers are keys. The documents of a key are tested against the one with the least id, not with
   each other. Those that the registers put far below the threshold (after taking off chance collisions, with a margin of
   six standard errors) are dropped; the rest are confirmed on their full sets, rebuilt from the whole texts. Links give groups.
3. Groups that meet in a key may still belong together. Their documents get finer keys: two sets that reach the threshold
   share one of the rarest shingles of each, as many as the larger may lack and one more, in any order common to all. The
   order is by the number of documents, exact for the at most ``LISTED`` shingles that stand in the most; a passage
   that many documents hold comes last and is no key unless it is nearly all of a text. Keys that hold one group go.
4. In a finer key, documents outside its largest group meet all others, in blocks of ``BLOCK`` by portions of ``PORTION``, by a
   bitmap that bounds what two sets can share: how many shingles fall into each of ``CELLS`` cells, counted up to ``PLANES``.
   Two sets share at most the lesser count of each cell, so the bound exceeds what they do share only where shingles that
   either alone has meet in a cell, and pairs somewhat below the threshold send nothing. A document sends its ``LIKELIEST`` pairs with each other group; these are confirmed and join groups. Documents
   that held pairs back send ``MORE`` times as many in the next round, to groups that are still others, until none holds back.

With similarity 0.8 or more a pair shares no band with chance (1 - 0.8**5)**51 < 2e-9. Shingles are compared by 64-bit hashes
built on word hashes modulo a 61-bit prime, and equal sets by 128 bits.

Nulls: a null text, or one without words, has an empty set and no links; a null doc_id has no links and is kept. Rows that
repeat a doc_id are one node. Other columns are ignored, an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SpanHasher, discard, id_column, materialise, mix64, spaced_words, table, text_slices, utf8_buffer
from .graph import components, join_groups

REGISTERS, MANTISSA, ROWS, BANDS = 256, 10, 5, 51
#: Cells of a bitmap and the highest count of one; shingles whose number of documents is known to all workers.
CELLS, PLANES, LISTED = 1024, 4, 1 << 18
BITS = CELLS * PLANES
#: Bitmaps laid at once.
BITMAPS = 4096
#: Documents outside a key's largest group in one block, and all its documents in one portion.
BLOCK, PORTION = 512, 4096
#: Pairs of a document with one group and portion in the first round, and how many times as many in each later one.
LIKELIEST, MORE = 32, 32
#: Documents named in an id list that may be broadcast; beyond it the join is shuffled.
BROADCAST_IDS = 1 << 20
PAIRS_PER_TASK = 512
_HASHER = SpanHasher(seed=9_001)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_U = np.uint64


def _probes() -> np.ndarray:
    """For each register, all buckets in a seeded order."""
    rng = np.random.default_rng(9_002)
    return np.stack([rng.permutation(REGISTERS) for _ in range(REGISTERS)], axis=1)


_PROBES = _probes()


def shingle_sets(texts: pa.Array, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text, and the n+1 places where texts begin."""
    data, offsets = utf8_buffer(texts, "\n")
    data = _LOWER[data]
    start, end, first = spaced_words(data, offsets)
    word = _HASHER.spans(_HASHER.prefix(data), start, end)
    n = np.diff(first)
    count = np.where(n >= words, n - words + 1, np.minimum(n, 1))
    text = np.repeat(np.arange(len(n)), count)
    at = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + first[text]
    hashes = np.full(len(at), _U(words), dtype=np.uint64)
    left = first[text + 1] - at
    for k in range(words):
        there = left > k
        step = word[np.minimum(at + k, max(len(word) - 1, 0))] if len(word) else word
        hashes = np.where(there, mix64(hashes * _U(0x9E3779B97F4A7C15) + step), hashes)
    order = np.lexsort((hashes, text))
    hashes, text = hashes[order], text[order]
    keep = np.ones(len(hashes), dtype=bool)
    keep[1:] = (hashes[1:] != hashes[:-1]) | (text[1:] != text[:-1])
    return hashes[keep], np.concatenate([[0], np.cumsum(np.bincount(text[keep], minlength=len(n)))]).astype(np.int64)


def registers(hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """HyperMinHash registers (texts x REGISTERS, 16 bits each, 0 only for an empty set)."""
    n = len(first) - 1
    out = np.zeros((n, REGISTERS), dtype=np.uint16)
    text = np.repeat(np.arange(n), np.diff(first))
    cell, least = np.unique(text * REGISTERS + (hashes >> _U(56)).astype(np.int64), return_index=True)
    value = hashes[least] << _U(8)
    top = (value >> _U(11)).astype(np.float64)
    zeros = np.where(top > 0, 53 - np.frexp(top)[1], 53).astype(np.uint64)
    mantissa = (value << (zeros + _U(1))) >> _U(64 - MANTISSA)
    out.reshape(-1)[cell] = ((zeros + _U(1)) << _U(MANTISSA) | mantissa).astype(np.uint16)
    filled = out > 0
    row, col = np.nonzero(~filled & filled.any(axis=1, keepdims=True))
    for probe in _PROBES:
        if not len(row):
            break
        hit = filled[row, probe[col]]
        out[row[hit], col[hit]] = out[row[hit], probe[col[hit]]]
        row, col = row[~hit], col[~hit]
    return out


def band_keys(regs: np.ndarray) -> np.ndarray:
    key = np.repeat(np.arange(1, BANDS + 1, dtype=np.uint64)[None, :], len(regs), axis=0)
    for k in range(ROWS):
        key = mix64(key * _U(0x9E3779B97F4A7C15) + regs[:, k : ROWS * BANDS : ROWS].astype(np.uint64))
    return key


def estimate(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """Jaccard similarity from registers, less the chance that unequal values share a register."""
    same = (a == b).mean(axis=1)
    k = np.arange(1, 54)[None, :]
    mass = [(1 - 2.0**-k) ** np.maximum(n / REGISTERS, 1)[:, None] - (1 - 2.0 ** -(k - 1)) ** np.maximum(n / REGISTERS, 1)[:, None] for n in (n_a, n_b)]
    chance = (mass[0] * mass[1]).sum(axis=1) / (1 << MANTISSA)
    return (same - chance) / (1 - chance)


def sketch(docs: DataFrame, words: int) -> DataFrame:
    """doc_id, n, digest (128 bits of the set) and registers of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches):
            hashes, first = shingle_sets(part.column("text"), words)
            regs, n = registers(hashes, first), np.diff(first)
            sums = [np.concatenate([[_U(0)], np.cumsum(mix64(hashes ^ _U(salt)), dtype=np.uint64)])[first] for salt in (0x1F83D9AB, 0x5BE0CD19)]
            digest = np.stack([np.diff(s) for s in sums], axis=1)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(n), pa.array([d.tobytes() for d in digest], pa.binary()), pa.array([r.tobytes() if k else None for r, k in zip(regs, n, strict=True)], pa.binary())], names=["doc_id", "n", "digest", "regs"])

    return docs.select(id_column(), "text").mapInArrow(run, "doc_id long, n long, digest binary, regs binary")


def _bands(sets: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                regs = np.frombuffer(b"".join(batch.column("regs").to_pylist()), dtype=np.uint16).reshape(-1, REGISTERS)
                yield pa.RecordBatch.from_arrays([pa.array(band_keys(regs).view(np.int64).reshape(-1)), pa.array(np.repeat(np.asarray(batch.column("id")), BANDS))], names=["key", "id"])

    return sets.select("id", "regs").mapInArrow(run, "key long, id long")


def _plausible(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """Pairs that sizes and registers allow to reach the threshold."""
    a, b = (sets.select(F.col("id").alias(x), F.col("n").alias(f"n_{x}"), F.col("regs").alias(f"regs_{x}")) for x in "ab")
    joined = pairs.join(a.select("a", "n_a", "regs_a"), "a").join(b, "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                ra, rb = (np.frombuffer(b"".join(batch.column(f"regs_{x}").to_pylist()), dtype=np.uint16).reshape(-1, REGISTERS) for x in "ab")
                na, nb = (np.asarray(batch.column(f"n_{x}")).astype(float) for x in "ab")
                least = np.minimum(na, nb)
                margin = np.maximum(0.2, 6 * 0.4 / np.sqrt(least))
                keep = (least >= threshold * np.maximum(na, nb) - 1e-9) & (estimate(ra, rb, na, nb) >= threshold - margin)
                yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(keep))

    return joined.select("a", "b", "n_a", "n_b", "regs_a", "regs_b").mapInArrow(run, "a long, b long")


def _texts_of(docs: DataFrame, ids: DataFrame, at_most: int) -> DataFrame:
    """doc_id and text of the documents in ``ids`` (distinct doc_id), which has ``at_most`` rows."""
    texts = docs.where(F.col("doc_id").isNotNull()).select(id_column(), F.col("text"))
    return texts.join(F.broadcast(ids) if at_most <= BROADCAST_IDS else ids, "doc_id", "left_semi")


def _confirmed(pairs: DataFrame, docs: DataFrame, words: int, percent: int) -> DataFrame:
    """Pairs whose full sets, rebuilt from the whole texts, reach the threshold. A popular ``a`` is cut into portions of its partners."""
    n_pairs = pairs.count()
    ids = pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()
    texts = materialise(_texts_of(docs, ids, 2 * n_pairs), "op9-texts")
    portions = pairs.groupBy("a").agg(F.ceil(F.count("*") / PAIRS_PER_TASK).cast("int").alias("portions"))
    heads = portions.select("a", F.explode(F.sequence(F.lit(0), F.col("portions") - 1)).alias("portion")).join(texts.withColumnRenamed("doc_id", "a"), "a")
    tails = pairs.join(portions, "a").select("a", F.pmod(F.xxhash64("b"), F.col("portions")).cast("int").alias("portion"), "b").join(texts.withColumnRenamed("doc_id", "b"), "b")
    rows = heads.select("a", "portion", F.lit(None).cast("long").alias("b"), "text").unionByName(tails.select("a", "portion", "b", "text"))
    n = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    rows = rows.repartition(n, "a", "portion").sortWithinPartitions("a", "portion", F.col("b").asc_nulls_first())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heads_now, of = [], None  # more than one text where rows repeat a doc_id
        for part in text_slices(batches):
            hashes, first = shingle_sets(part.column("text"), words)
            keep = np.zeros(part.num_rows, dtype=bool)
            for i, (a, portion, b) in enumerate(zip(*(part.column(c).to_pylist() for c in ("a", "portion", "b")), strict=True)):
                own = hashes[first[i] : first[i + 1]]
                if b is None:
                    heads_now = [*heads_now, own] if of == (a, portion) else [own]
                    of = (a, portion)
                    continue
                for head in heads_now:
                    both = int((head[np.minimum(np.searchsorted(head, own), len(head) - 1)] == own).sum()) if len(head) else 0
                    keep[i] |= both > 0 and 100 * both >= percent * (len(head) + len(own) - both)
            yield part.select(["a", "b"]).filter(pa.array(keep))

    return rows.mapInArrow(run, "a long, b long").distinct()


def _listed(texts: DataFrame, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and numbers of documents of the shingles that stand in more than 1 / LISTED of all (document, shingle) pairs, sorted by hash.

    There are fewer than LISTED of them, whatever the input.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches):
            shingle, n = np.unique(shingle_sets(part.column("text"), words)[0], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(shingle.view(np.int64)), pa.array(n)], names=["shingle", "n"])

    counts = materialise(texts.select("text").mapInArrow(count, "shingle long, n long").groupBy("shingle").agg(F.sum("n").alias("n")).where("n > 1"), "op9-counts")
    least = (counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]) // LISTED
    listed = counts.where(F.col("n") > least).toArrow()
    shingle, n = np.asarray(listed.column("shingle")).view(np.uint64), np.asarray(listed.column("n"))
    discard(counts)
    order = np.argsort(shingle)
    return shingle[order], n[order]


def _rare_keys(texts: DataFrame, words: int, percent: int) -> DataFrame:
    """key, id, g: the rarest shingles of each document, one of which any partner shares."""
    shared = texts.sparkSession.sparkContext.broadcast(_listed(texts, words))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, uses = shared.value
        for part in text_slices(batches):
            hashes, first = shingle_sets(part.column("text"), words)
            n = np.diff(first)
            doc = np.repeat(np.arange(len(n)), n)
            often = np.zeros(len(hashes), dtype=np.int64)
            if len(known):
                at = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
                often = np.where(known[at] == hashes, uses[at], 0)
            order = np.lexsort((hashes, often, doc))
            place = np.arange(len(order)) - first[doc]
            keep = place < (n - (percent * n + 99) // 100 + 1)[doc]
            own = order[keep]
            yield pa.RecordBatch.from_arrays([pa.array(hashes[own].view(np.int64)), part.column("id").take(pa.array(doc[keep])), part.column("g").take(pa.array(doc[keep]))], names=["key", "id", "g"])

    return texts.select("id", "g", "text").mapInArrow(run, "key long, id long, g long")


def counted(hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Packed bitmaps (texts x BITS): bit k * CELLS + c is set if more than k shingles fall into cell c."""
    n = np.diff(first)
    cell = np.sort(np.repeat(np.arange(len(n)), n) * CELLS + (hashes >> _U(20)).astype(np.int64) % CELLS)
    new = np.ones(len(cell), dtype=bool)
    new[1:] = cell[1:] != cell[:-1]
    at = np.arange(len(cell))
    before = at - np.maximum.accumulate(np.where(new, at, 0))
    bits = np.zeros((len(n), BITS), dtype=bool)
    keep = before < PLANES
    bits[cell[keep] // CELLS, before[keep] * CELLS + cell[keep] % CELLS] = True
    return np.packbits(bits, axis=1)


def _bitmaps(texts: DataFrame, words: int) -> DataFrame:
    """id, n and the bitmap of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches):
            hashes, first = shingle_sets(part.column("text"), words)
            for lo in range(0, part.num_rows, BITMAPS):
                own = part.slice(lo, BITMAPS)
                at = first[lo : lo + own.num_rows + 1]
                packed = counted(hashes[at[0] : at[-1]], at - at[0])
                yield pa.RecordBatch.from_arrays([own.column("id"), pa.array(np.diff(at)), pa.array([b.tobytes() for b in packed], pa.binary())], names=["id", "n", "bits"])

    return texts.select("id", "text").mapInArrow(run, "id long, n long, bits binary")


def _between(rows: DataFrame) -> DataFrame:
    """The rows (key, id, g) of keys with several groups, with head (outside the key's largest group), blocks and portions."""
    sizes = rows.groupBy("key", "g").agg(F.count("*").alias("m")).groupBy("key").agg(F.max(F.struct("m", "g")).alias("top"), F.sum("m").alias("n")).where("n > top.m")
    plan = sizes.select("key", F.col("top.g").alias("big"), *_portions(F.col("n") - F.col("top.m"), F.col("n")))
    return rows.join(plan, "key").withColumn("head", F.col("g") != F.col("big")).drop("big")


def _held_back(rows: DataFrame, back: DataFrame, groups: DataFrame) -> DataFrame:
    """The rows of keys that still have several groups and a document of ``back``, which are the heads now."""
    now = rows.select("key", "id").join(groups.withColumnRenamed("node", "id"), "id", "left").select("key", "id", F.coalesce("component", "id").alias("g"))
    now = now.join(back.withColumn("held", F.lit(True)), "id", "left").select("key", "id", "g", F.col("held").isNotNull().alias("head"))
    sizes = now.groupBy("key").agg(F.min("g").alias("g0"), F.max("g").alias("g1"), F.count("*").alias("n"), F.count_if("head").alias("heads")).where("g0 != g1 and heads > 0")
    return now.join(sizes.select("key", *_portions(F.col("heads"), F.col("n"))), "key")


def _portions(heads: Column, n: Column) -> list[Column]:
    return [F.ceil(heads / BLOCK).cast("int").alias("blocks"), F.ceil(n / PORTION).cast("int").alias("portions")]


def _likeliest(rows: DataFrame, bitmaps: DataFrame, limit: int, percent: int) -> DataFrame:
    """(a, b, more): for each head of a key at most ``limit`` pairs with each other group in each portion.

    ``more`` is true in rows without a pair, whose a is a head that held some back.
    """
    full = rows.join(bitmaps, "id")
    portion = F.pmod(F.xxhash64("id"), F.col("portions")).cast("int")
    block = F.pmod(F.xxhash64("id", F.lit(1)), F.col("blocks")).cast("int")
    columns = ["key", "id", "g", "n", "bits"]
    heads = full.where("head").select(*columns, block.alias("block"), F.explode(F.sequence(F.lit(0), F.col("portions") - 1)).alias("portion"), F.lit(True).alias("head"))
    tails = full.select(*columns, F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), portion.alias("portion"), F.lit(False).alias("head"))
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = heads.unionByName(tails).repartition(n, "key", "block", "portion").sortWithinPartitions("key", "block", "portion", F.desc("head"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heads_now, tails_now, of = [], [], None

        def flush() -> Iterator[pa.RecordBatch]:
            if heads_now and tails_now:
                a, b, back = _best(_joined(heads_now), _joined(tails_now), limit, percent)
                flags = np.arange(len(a) + len(back)) >= len(a)
                yield pa.RecordBatch.from_arrays([pa.array(np.append(np.minimum(a, b), back)), pa.array(np.append(np.maximum(a, b), back)), pa.array(flags)], names=["a", "b", "more"])

        for batch in batches:
            if not batch.num_rows:
                continue
            key, block, portion, head = (np.asarray(batch.column(c)) for c in ("key", "block", "portion", "head"))
            own = (np.asarray(batch.column("id")), np.asarray(batch.column("g")), np.asarray(batch.column("n")), np.frombuffer(b"".join(batch.column("bits").to_pylist()), dtype=np.uint8).reshape(-1, BITS // 8))
            cut = np.flatnonzero((np.diff(key) != 0) | (np.diff(block) != 0) | (np.diff(portion) != 0) | (np.diff(head.astype(np.int8)) != 0)) + 1
            for lo, hi in zip(np.append(0, cut), np.append(cut, len(key)), strict=True):
                if of != (key[lo], block[lo], portion[lo]):
                    yield from flush()
                    heads_now, tails_now, of = [], [], (key[lo], block[lo], portion[lo])
                (heads_now if head[lo] else tails_now).append(tuple(x[lo:hi] for x in own))
        yield from flush()

    return dealt.select(*columns, "block", "portion", "head").mapInArrow(run, "a long, b long, more boolean").distinct()


def _joined(parts: list[tuple]) -> tuple:
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def _best(x: tuple, y: tuple, limit: int, percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids of pairs of different groups whose bitmaps allow the threshold, the likeliest ``limit`` of each x with each group of y, and ids of x with others.

    x and y are ids, groups, sizes and bitmaps.
    """
    left = np.unpackbits(x[3], axis=1).astype(np.float32)
    found = []
    for lo in range(0, len(y[0]), 1024):
        part = slice(lo, lo + 1024)
        right = np.unpackbits(y[3][part], axis=1).astype(np.float32)
        common = left @ right.T
        both = np.minimum(x[2][:, None] - left.sum(axis=1)[:, None], y[2][part][None, :] - right.sum(axis=1)[None, :]) + common
        union = x[2][:, None] + y[2][part][None, :] - both
        i, j = np.nonzero((x[1][:, None] != y[1][part][None, :]) & (100 * both >= percent * union))
        found.append((i, j + lo, both[i, j] / union[i, j]))
    i, j, likeness = _joined(found)
    order = np.lexsort((y[0][j], -likeness, y[1][j], i))
    i, j = i[order], j[order]
    new = np.ones(len(i), dtype=bool)
    new[1:] = (i[1:] != i[:-1]) | (y[1][j[1:]] != y[1][j[:-1]])
    at = np.arange(len(i))
    keep = at - np.maximum.accumulate(np.where(new, at, 0)) < limit
    return x[0][i[keep]], y[0][j[keep]], np.unique(x[0][i[~keep]])


def _untested_links(shared: DataFrame, tested: DataFrame, sets: DataFrame, groups: DataFrame, docs: DataFrame, words: int, percent: int) -> DataFrame:
    """``groups`` after all links between groups that share a key of three or more documents."""
    grouped = shared.join(groups.withColumnRenamed("node", "id"), "id", "left").select("key", F.coalesce("component", "id").alias("g"))
    meets = grouped.distinct()
    several = meets.groupBy("key").agg(F.min("g").alias("g0"), F.max("g").alias("g1")).where("g0 != g1").select("key")
    meeting = materialise(meets.join(several, "key").select("g").distinct(), "op9-meeting")
    if meeting.isEmpty():
        return groups
    members = sets.select("id").join(groups.withColumnRenamed("node", "id"), "id", "left").select("id", F.coalesce("component", "id").alias("g")).join(meeting, "g", "left_semi")
    members = materialise(members, "op9-members")
    texts = _texts_of(docs, members.select(F.col("id").alias("doc_id")), members.count()).withColumnRenamed("doc_id", "id")
    texts = materialise(texts.join(members, "id"), "op9-texts")
    rows = materialise(_between(_rare_keys(texts, words, percent)), "op9-between")
    bitmaps = materialise(_bitmaps(texts.join(rows.select("id").distinct(), "id", "left_semi"), words), "op9-bitmaps")
    discard(texts, members)
    limit = LIKELIEST
    while not rows.isEmpty():
        sent = materialise(_likeliest(rows, bitmaps, limit, percent), "op9-likeliest")
        pairs = materialise(sent.where("not more").select("a", "b").join(tested, ["a", "b"], "left_anti"), "op9-pairs")
        found = materialise(_confirmed(materialise(_plausible(pairs, sets, percent / 100), "op9-plausible"), docs, words, percent), "op9-edges")
        if not found.isEmpty():
            groups = materialise(join_groups(groups, found), "op9-groups")
        tested, limit = tested.unionByName(pairs), limit * MORE
        rows = materialise(_held_back(rows, sent.where("more").select(F.col("a").alias("id")).distinct(), groups), "op9-between")
    return groups


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of each document; links are 100 * intersection >= percent * union."""
    sketches = materialise(sketch(docs, words), "op9-sketch")  # its registers are read for one document of each set
    filled = sketches.where("n > 0 and doc_id is not null")
    first = filled.groupBy("digest").agg(F.min(F.struct("doc_id", "n", "regs")).alias("x"))
    sets = materialise(first.select("digest", F.col("x.doc_id").alias("id"), "x.n", "x.regs"), "op9-sets")
    bands = _bands(sets)
    keys = materialise(bands.groupBy("key").agg(F.min("id").alias("a"), F.count("*").alias("size")).where("size > 1"), "op9-keys")
    shared = materialise(bands.join(keys, "key"), "op9-shared")
    tested = materialise(shared.where("id > a").select("a", F.col("id").alias("b")).distinct(), "op9-pairs")
    edges = _confirmed(materialise(_plausible(tested, sets, percent / 100), "op9-plausible"), docs, words, percent)
    twice = filled.groupBy("doc_id").agg(F.min("digest").alias("d0"), F.max("digest").alias("d1"), F.collect_set("digest").alias("ds")).where("d0 != d1")
    twice = twice.select("doc_id", F.explode("ds").alias("digest")).join(sets, "digest").select(F.col("doc_id").alias("a"), F.col("id").alias("b")).where("a != b")
    groups = materialise(components(edges.unionByName(twice)), "op9-groups")
    discard(keys)
    groups = _untested_links(shared.where("size > 2").select("key", "id"), tested, sets, groups, docs, words, percent)
    rows = sketches.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("digest")).alias("digest"))
    classes = sets.select("digest", "id").join(groups.withColumnRenamed("node", "id"), "id", "left").select("digest", F.coalesce("component", "id").alias("component"))
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return rows.join(classes, "digest", "left").select("doc_id", "n_shingles", component.alias("component_id")).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def op9_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), words=4)
