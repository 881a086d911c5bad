"""Cross-tokenizer alignment: where the tokens of two tokenizers end together, which overlap, and how common each such pair is.

A text is cut into units before a space or line feed that follows a sign; neither tokenizer joins tokens over such a cut, so the
tokens of a text are those of its units, and each distinct unit is encoded and merged once a worker. The two-pointer merge walks the
cumulative ends of both sides, for a block of units at once: every stretch between two ends (of either side) is one link, every
stretch between two common ends one group. The bytes of the tokens are compared with those of the unit.

Spark does the rest: a first pass writes one row for each document with its distinct links; the links of a block of documents are
made distinct, counted by groupBy, joined with the highest count of their A id, and joined back to the blocks, whose documents are
then summed side by side. A block holds some ``BLOCK_BYTES`` of text (or one longer document), so a frequent pair meets one row for
each block, and no task holds more than one block.

Rows: null and empty texts, and those whose joined token bytes on either side are not " " + text (a text with U+2581 on side B), have
no tokens: zeros and an empty string. A null doc_id keeps its row; rows that repeat a doc_id are documents of their own, also in the
counts. Other columns are ignored, an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import id_column, materialise, table, text_slices, utf8_buffer
from .vocab import vocabulary_path

#: Text bytes of the documents whose links are joined together.
BLOCK_BYTES = 4 << 20
#: Units remembered in a worker; beyond that the memory starts anew.
CACHE_UNITS = 1 << 19
#: Units encoded as one text.
STRIP = 2048


def _byte_alphabet() -> dict[str, int]:
    """Sign to byte of byte-level vocabularies: printable bytes stand for themselves, the others for U+0100 and up, in order."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(0x100 + k): b for k, b in enumerate(rest)}


class ByteLevel:
    """A byte-level vocabulary of the ``tokenizers`` library; strings of special tokens are plain text."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = True
        signs = _byte_alphabet()
        self.tokens = [b""] * self.library.get_vocab_size()
        for token, i in self.library.get_vocab().items():
            self.tokens[i] = bytes(signs[c] for c in token) if all(c in signs for c in token) else token.encode()
        self.size = np.array([len(t) for t in self.tokens], dtype=np.int64)

    def encode(self, text: str) -> np.ndarray:
        """Ids of a text that begins with a space."""
        return np.asarray(self.library.encode(text, add_special_tokens=False).ids, dtype=np.int64)


class Pieces:
    """A ``sentencepiece`` vocabulary with byte pieces, which puts a space before a text by itself."""

    def __init__(self, path: str):
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        n = self.library.get_piece_size()
        self.tokens = [bytes([int(p[3:5], 16)]) if self.library.is_byte(i) else p.replace("▁", " ").encode() for i in range(n) for p in [self.library.id_to_piece(i)]]
        self.size = np.array([len(t) for t in self.tokens], dtype=np.int64)

    def encode(self, text: str) -> np.ndarray:
        return np.asarray(self.library.encode(text[1:], num_threads=1), dtype=np.int64)


def unit_cuts(data: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Places where units begin: the starts ``first`` of the texts, and spaces and line feeds behind a byte that ends no white space.

    White space beyond ASCII is told by its lead byte, so some other signs count as white space too: that only makes units longer.
    """
    gap = (data == 0x20) | (data == 0x0A)
    if len(data) > 1:
        gap[1:] &= ~((data[:-1] <= 0x20) | (data[:-1] == 0x7F))
        gap[2:] &= data[:-2] != 0xC2
        gap[3:] &= (data[:-3] < 0xE1) | (data[:-3] > 0xE3)
    gap[first[first < len(data)]] = True
    return np.flatnonzero(gap)


def closed(unit: bytes) -> bool:
    """Whether a space behind ``unit`` begins another unit, by the rule of ``unit_cuts``."""
    return unit[-1] > 0x20 and unit[-1] != 0x7F and unit[-2:-1] != b"\xc2" and not b"\xe1" <= unit[-3:-2] <= b"\xe3"


class Aligner:
    """Units and what is known of them: counts of tokens, groups and links, the groups as text, and the links as pairs of ids."""

    def __init__(self, a: ByteLevel, b: Pieces):
        self.a, self.b = a, b
        self.bits = int(len(b.tokens) - 1).bit_length()
        self._forget()

    def _forget(self) -> None:
        self.slot: dict[bytes, int] = {}
        self.groups: list[str] = []
        self.counts: list[np.ndarray] = []  # n_a, n_b, n_groups, n_links, bad
        self.pairs: list[np.ndarray] = []
        self.known = None

    def slots(self, units: list[bytes]) -> np.ndarray:
        """Place of each unit in ``table``; unknown ones are encoded first."""
        if len(self.slot) > CACHE_UNITS:
            self._forget()
        new = [u for u in units if u not in self.slot]
        if new:
            # A unit that ends in white space would grow into the next one.
            joined = [u for u in new if closed(u)]
            for k in range(0, len(joined), STRIP):
                self._add(joined[k : k + STRIP])
            for u in new:
                if not closed(u):
                    self._add([u])
            self.known = None
        return np.fromiter((self.slot[u] for u in units), dtype=np.int64, count=len(units))

    def table(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Counts of all slots, links of all slots, and where those of a slot begin."""
        if self.known is None:
            self.counts, self.pairs = [np.concatenate(self.counts)], [np.concatenate(self.pairs)]
            self.known = (self.counts[0], self.pairs[0], np.concatenate([[0], np.cumsum(self.counts[0][:, 3])]))
        return self.known

    def _add(self, units: list[bytes]) -> None:
        text = b"".join([b" a", *units])  # a unit in front, as side B begins with a space
        said = text.decode()
        ids_a, ids_b = self.a.encode(said), self.b.encode(said)
        if b"".join([self.a.tokens[i] for i in ids_a]) != text or b"".join([self.b.tokens[i] for i in ids_b]) != text:
            if len(units) > 1:
                for u in units:
                    self._add([u])
            else:  # these bytes can't be told from the tokens
                self._enter(units, ["\n"], np.array([[0, 0, 0, 0, 1]]), np.empty(0, dtype=np.int64))
            return
        end_a, end_b = np.cumsum(self.a.size[ids_a]), np.cumsum(self.b.size[ids_b])
        edges = np.cumsum([2, *map(len, units)])
        ends = np.union1d(end_a, end_b)
        at_a, at_b = np.searchsorted(end_a, ends), np.searchsorted(end_b, ends)
        both = np.intersect1d(end_a, end_b, assume_unique=True)
        upto = [np.searchsorted(x, edges, side="right") for x in (end_a, end_b, both, ends)]
        counts = np.stack([*(np.diff(x) for x in upto), np.zeros(len(units), dtype=np.int64)], axis=1)
        say_a, say_b = [str(i) for i in ids_a], [str(i) for i in ids_b]
        cut_a, cut_b = np.searchsorted(end_a, both, side="right").tolist(), np.searchsorted(end_b, both, side="right").tolist()
        cuts = zip([0, *cut_a], cut_a, [0, *cut_b], cut_b)
        said = [f"{say_a[i]}|{say_b[k]}" if j - i == m - k == 1 else f"{','.join(say_a[i:j])}|{','.join(say_b[k:m])}" for i, j, k, m in cuts]
        of = upto[2].tolist()
        groups = [";".join(said[i:j]) for i, j in zip(of, of[1:])]
        self._enter(units, groups, counts, ((ids_a[at_a] << self.bits) | ids_b[at_b])[upto[3][0] :])

    def _enter(self, units: list[bytes], groups: list[str], counts: np.ndarray, pairs: np.ndarray) -> None:
        for u in units:
            self.slot[u] = len(self.slot)
        self.groups += groups
        self.counts.append(counts)
        self.pairs.append(pairs)

    def align(self, texts: pa.Array) -> tuple[np.ndarray, list[str], np.ndarray, np.ndarray, np.ndarray]:
        """Of each text: counts (n_a, n_b, n_groups, n_links) and digest of the groups; then distinct links, their multiplicity, and the n+1 places where those of a text begin."""
        there = np.asarray(pc.greater(pc.fill_null(pc.binary_length(texts), 0), 0))
        data, offsets = utf8_buffer(pc.binary_join_element_wise(pa.scalar("", pa.large_string()), pc.fill_null(texts.cast(pa.large_string()), ""), pa.scalar(" ", pa.large_string())), after="")
        cuts = unit_cuts(data, offsets[:-1])
        encoded = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(cuts), [None, pa.py_buffer(np.append(cuts, len(data))), pa.py_buffer(data)]).dictionary_encode()
        of = self.slots(encoded.dictionary.to_pylist())[np.asarray(encoded.indices)] if len(cuts) else np.empty(0, dtype=np.int64)
        n = len(texts)
        if not len(of):
            return np.zeros((n, 4), dtype=np.int64), [""] * n, np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64), np.zeros(n + 1, dtype=np.int64)
        counts, links, begin = self.table()
        first = np.searchsorted(cuts, offsets)
        sums = np.diff(np.concatenate([np.zeros((1, 5), dtype=np.int64), np.cumsum(counts[of], axis=0)])[first], axis=0)
        ok = there & (sums[:, 4] == 0)
        sums = sums[:, :4] * ok[:, None]
        sha = []
        for i in range(n):
            said = ";".join(map(self.groups.__getitem__, of[first[i] : first[i + 1]].tolist())) if ok[i] else None
            sha.append("" if said is None else hashlib.sha256(said.encode()).hexdigest())
        of, doc = of[np.repeat(ok, np.diff(first))], np.repeat(np.arange(n), np.diff(first) * ok)
        each = counts[of, 3]
        total = np.cumsum(each)
        take = np.arange(total[-1] if len(total) else 0) + np.repeat(begin[of] - total + each, each)
        width = self.bits + int(len(self.a.tokens)).bit_length()
        keys, times = np.unique((np.repeat(doc, each) << width) | links[take], return_counts=True)
        return sums, sha, keys & ((1 << width) - 1), times, np.searchsorted(keys, np.arange(n + 1) << width)


_LOADED: dict[tuple[str, str], Aligner] = {}


def aligner(path_a: str, path_b: str) -> Aligner:
    """The aligner of this worker; its memory of units outlives a task."""
    if (path_a, path_b) not in _LOADED:
        _LOADED[path_a, path_b] = Aligner(ByteLevel(path_a), Pieces(path_b))
    return _LOADED[path_a, path_b]


LINKED = "block long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<long>, times array<int>"


def linked(docs: DataFrame, path_a: str, path_b: str, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row for each document, with its block and its distinct links (A id and B id in one number) and how often it holds each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        both, block, size = aligner(path_a, path_b), TaskContext.get().partitionId() << 32, 0
        for part in text_slices(batches):
            texts = part.column("text")
            sums, sha, pairs, times, at = both.align(texts)
            yield pa.RecordBatch.from_arrays([
                pa.array(np.full(len(sha), block)), part.column("doc_id"), *(pa.array(sums[:, k]) for k in range(4)), pa.array(sha, pa.string()),
                pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(pairs)), pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(times, pa.int32())),
            ], names=["block", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "times"])
            size += pc.sum(pc.binary_length(texts)).as_py() or 0
            if size >= block_bytes:
                block, size = block + 1, 0

    return docs.select(id_column(), "text").mapInArrow(run, LINKED)


def _block_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(block, pair, documents that hold it) of the runs of rows of one block in each batch."""
    for batch in batches:
        blocks = np.asarray(batch.column("block"))
        cut = np.flatnonzero(np.diff(blocks, prepend=-1, append=-1)) if len(blocks) else []
        for lo, hi in zip(cut, cut[1:]):
            pair, n = np.unique(np.asarray(batch.column("pairs").slice(lo, hi - lo).flatten()), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(pair), blocks[lo])), pa.array(pair, pa.int64()), pa.array(n, pa.int64())], names=["block", "pair", "n"])


def _sum_links(docs: pa.Table, known: pa.Table) -> pa.Table:
    """The documents of a block with the sums over their links."""
    docs = docs.combine_chunks()
    if not docs.num_rows:
        return pa.Table.from_arrays([pa.array([], f.type) for f in _OUT], schema=_OUT)
    pair = np.asarray(known.column("pair"))
    order = np.argsort(pair)
    count, best = np.asarray(known.column("n"))[order], np.asarray(known.column("best"))[order]
    lists = pa.concat_arrays(docs.column("pairs").chunks)
    at = np.searchsorted(pair[order], np.asarray(lists.flatten()))
    times = np.asarray(pa.concat_arrays(docs.column("times").chunks).flatten()).astype(np.int64)
    upto = np.concatenate([[0], np.cumsum(np.asarray(pc.list_value_length(lists)))])
    sums = [np.diff(np.concatenate([[0], np.cumsum(times * x)])[upto]) for x in (best[at].astype(np.int64), count[at])] if len(pair) else [np.zeros(docs.num_rows, dtype=np.int64)] * 2
    kept = [docs.column(f.name) for f in _OUT if f.name not in ("n_best", "count_sum")]
    return pa.Table.from_arrays([*kept[:5], *map(pa.array, sums), kept[5]], schema=_OUT)


_OUT = pa.schema([(c, pa.int64()) for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")] + [("groups_sha256", pa.string())])


def pair_counts(block_pairs: DataFrame, bits: int) -> DataFrame:
    """(pair, n, best): how many documents hold the pair, and whether no pair of its A id is held by more."""
    counts = block_pairs.groupBy("pair").agg(F.sum("n").alias("n")).withColumn("a", F.shiftright("pair", bits))
    most = counts.groupBy("a").agg(F.max("n").alias("most"))
    return counts.join(most, "a").select("pair", "n", (F.col("n") == F.col("most")).alias("best"))


def alignment(docs: DataFrame, path_a: str, path_b: str, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of every whole text."""
    bits = aligner(path_a, path_b).bits
    rows = materialise(linked(docs, path_a, path_b, block_bytes), "op12-linked")
    blocks = rows.select("block", "pairs").mapInArrow(_block_pairs, "block long, pair long, n long")
    blocks = materialise(blocks.groupBy("block", "pair").agg(F.sum("n").alias("n")), "op12-blocks")
    counts = materialise(pair_counts(blocks, bits), "op12-counts")
    known = blocks.select("block", "pair").join(counts, "pair")
    schema = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
    return rows.groupBy("block").cogroup(known.groupBy("block")).applyInArrow(_sum_links, schema)


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment(table(spark, sf_dir, "documents"), vocabulary_path("byte_bpe_50k.json"), vocabulary_path("piece_bpe_32k.model"))
