"""Suffix-array dedup: remove each byte covered by a ``WIDTH``-byte string that also starts earlier.

Windows of WIDTH bytes are dealt out by content: a window's anchor is its ``ANCHOR``-byte string of least hash (leftmost on
ties), so equal windows have equal anchors at equal places. Neighbouring windows with one anchor form a segment of at most
2 * WIDTH - ANCHOR bytes; only segments whose anchor occurs twice in the corpus can hold a repeated window.

1. Documents are dealt to chunks by a hash of their id. A chunk lists its segments as (anchor hash, segment digest, first place).
2. Per anchor: anchors that occur once go. Equal segments are one from here on, at their first place: those whose anchors and
   whole bytes have the same two hashes modulo a prime of 61 bits, with different bases.
3. Where segments with one anchor differ, their bytes, one copy of each, form a collection; its Burrows-Wheeler transform and
   common prefixes are built column by column (see ``bcr``), and windows in a run of prefixes of WIDTH or more are equal.
4. A chunk marks the bytes of all windows that also start earlier and hashes what is left.

Only hashes, places and the differing segments are shuffled besides one pass of the documents; copies of a passage, however many,
send one row per chunk. Matches never cross documents. Rows that repeat a doc_id, or have none, are documents of their own: a
window is earlier if its (doc_id, hash of the text, start) is smaller. Rows that repeat the text too are one document, and each
gets its result. A null doc_id sorts first, a null text is empty; other columns are ignored and an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bcr import repeated_windows
from .common import SpanHasher, id_column, input_partitions, mix64, table, text_slices, utf8_buffer

WIDTH, ANCHOR = 100, 32
#: Segments in one collection; whole anchors, so one may be larger.
COLLECTION = 4096
#: Text bytes whose segments are found at once.
SLICE = 1 << 19
CHUNKS_PER_INPUT = 3
_LEAST = -(1 << 63)
#: A place holds a hash of the text above the start, so that rows of one doc_id stay apart.
_PLACE = 32
_U = np.uint64
_HASHER = SpanHasher(seed=2_001)
_OTHER = SpanHasher(seed=2_002)


class Segments:
    """The segments of a slice of documents: document number, start in it, length, anchor hash and digest."""

    def __init__(self, texts: pa.Array, width: int, anchor: int):
        self.data, self.offsets = utf8_buffer(texts)
        windows = np.maximum(np.diff(self.offsets) - width, 0)  # a row also has the NUL behind it
        n = len(self.data) - anchor + 1
        if n <= 0 or not windows.any():
            self.doc = self.start = self.length = self.begin = np.empty(0, dtype=np.int64)
            self.anchor = self.digest = np.empty(0, dtype=_U)
            return
        prefix = _HASHER.prefix(self.data)
        hashes = _HASHER.windows(prefix, anchor)
        bits = int(n).bit_length()
        low = hashes >> _U(bits)
        low <<= _U(bits)
        low |= np.arange(n, dtype=_U)  # the leftmost of the least
        span, have = width - anchor + 1, 1
        while have < span:
            step = min(have, span - have)
            low = np.minimum(low[:-step], low[step:])
            have += step
        # Segments begin where the anchor changes and where the windows of a document begin; windows across documents go.
        filled = windows > 0
        first, stop = self.offsets[:-1][filled], self.offsets[:-1][filled] + windows[filled]
        cuts = np.unique(np.concatenate([np.flatnonzero(low[1:] != low[:-1]) + 1, first, stop]))
        begin, last = cuts[:-1], cuts[1:] - 1
        doc = np.searchsorted(first, begin, side="right") - 1
        inside = (doc >= 0) & (begin < stop[np.maximum(doc, 0)])
        begin, end = begin[inside], last[inside] + width
        own = (low[begin] & _U((1 << bits) - 1)).astype(np.int64)
        self.doc = np.flatnonzero(filled)[doc[inside]]
        self.length = end - begin
        self.start = begin - self.offsets[self.doc]
        self.anchor = mix64(hashes[own])
        other = _OTHER.prefix(self.data)
        self.digest = mix64(_OTHER.spans(other, begin, end) + (own - begin).astype(_U) * _U(0x9E3779B97F4A7C15))
        self.begin = begin


def _sorted(docs: pa.Table) -> pa.RecordBatch:
    """The documents of a chunk by id, as one batch."""
    docs = docs.take(pc.sort_indices(docs, sort_keys=[("doc", "ascending"), ("tag", "ascending")])).combine_chunks()
    batches = docs.to_batches()
    return batches[0] if batches else pa.RecordBatch.from_arrays([pa.array([], f.type) for f in docs.schema], schema=docs.schema)


def _places(piece: pa.RecordBatch, s: Segments) -> np.ndarray:
    """Place of each segment in its document, under the hash of the text."""
    return (np.asarray(piece.column("tag"))[s.doc] << _PLACE) | s.start


def _pairs_key(anchor: np.ndarray, digest: np.ndarray) -> np.ndarray:
    return mix64(anchor ^ mix64(digest))


def _packed(**columns: np.ndarray) -> dict[str, bytes]:
    return {k: v.tobytes() for k, v in columns.items()}


_LIST = "anchor binary, digest binary, doc binary, start binary, flag binary"
_NAMES = ["anchor", "digest", "doc", "start", "flag"]


def _unpack(rows: pa.Table) -> tuple[np.ndarray, ...]:
    """anchor, digest, doc, start, flag and the number of the row of each entry."""
    cols = [b"".join(rows.column(c).to_pylist()) for c in _NAMES]
    anchor, digest = np.frombuffer(cols[0], dtype=_U), np.frombuffer(cols[1], dtype=_U)
    n = np.array([len(x) // 8 for x in rows.column("anchor").to_pylist()], dtype=np.int64)
    return anchor, digest, np.frombuffer(cols[2], dtype=np.int64), np.frombuffer(cols[3], dtype=np.int64), np.frombuffer(cols[4], dtype=np.uint8), np.repeat(np.arange(len(n)), n)


def remove_repeats(docs: DataFrame, width: int = WIDTH, anchor: int = ANCHOR) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and the removed spans (start, end in bytes) of each document."""
    spark = docs.sparkSession
    block = max(b for b in range(1, 26) if width % b == 0)
    chunks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), CHUNKS_PER_INPUT * input_partitions(docs))
    rows = docs.select(id_column(), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.select(F.coalesce("doc_id", F.lit(_LEAST)).alias("doc"), F.col("doc_id").isNull().alias("no_id"), "text", F.pmod(F.xxhash64("text"), F.lit(1 << 31)).alias("tag"))
    rows = rows.withColumn("chunk", F.pmod(F.xxhash64("doc", "tag"), F.lit(chunks)).cast("int"))
    dealt = rows.repartition(chunks, "chunk").groupBy("chunk")

    def to_table(entries: list[dict], schema: pa.Schema) -> pa.Table:
        return pa.Table.from_pylist(entries, schema=schema)

    entry_schema = pa.schema([("bucket", pa.int32()), ("chunk", pa.int32())] + [(c, pa.binary()) for c in _NAMES])
    reply_schema = pa.schema([("chunk", pa.int32())] + [(c, pa.binary()) for c in _NAMES])
    segment_schema = pa.schema([("bucket", pa.int32()), ("chunk", pa.int32()), ("anchor", pa.binary()), ("doc", pa.binary()), ("start", pa.binary()), ("size", pa.binary()), ("text", pa.binary())])

    def list_segments(key, part):
        found = []
        for piece in text_slices([_sorted(part)], SLICE):
            s = Segments(piece.column("text"), width, anchor)
            found.append((s.anchor, s.digest, np.asarray(piece.column("doc"))[s.doc], _places(piece, s)))
        if not found:
            return to_table([], entry_schema)
        a, d, doc, start = (np.concatenate(x) for x in zip(*found, strict=True))
        order = np.lexsort((start, doc, d, a))
        a, d, doc, start = a[order], d[order], doc[order], start[order]
        head = np.ones(len(a), dtype=bool)
        head[1:] = (a[1:] != a[:-1]) | (d[1:] != d[:-1])
        at = np.flatnonzero(head)
        many = (np.diff(np.append(at, len(a))) > 1).astype(np.uint8)
        a, d, doc, start = a[at], d[at], doc[at], start[at]
        bucket = (a % _U(chunks)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        cut = np.searchsorted(bucket[order], np.arange(chunks + 1))
        out = []
        for b in np.flatnonzero(np.diff(cut)):
            own = order[cut[b] : cut[b + 1]]
            out.append({"bucket": int(b), "chunk": key[0].as_py(), **_packed(anchor=a[own], digest=d[own], doc=doc[own], start=start[own], flag=many[own])})
        return to_table(out, entry_schema)

    def find_repeats(key, part):
        a, d, doc, start, many, row = _unpack(part)
        order = np.lexsort((start, doc, d, a))
        a, d, doc, start, many, row = a[order], d[order], doc[order], start[order], many[order], row[order]
        new_a = np.ones(len(a), dtype=bool)
        new_a[1:] = a[1:] != a[:-1]
        new_d = new_a.copy()
        new_d[1:] |= d[1:] != d[:-1]
        anchor_no = np.cumsum(new_a) - 1
        uses = np.bincount(anchor_no) + np.bincount(anchor_no, weights=many)
        kinds = np.bincount(anchor_no, weights=new_d)
        repeated, differ = uses[anchor_no] > 1, kinds[anchor_no] > 1
        head = np.flatnonzero(new_d)[np.cumsum(new_d) - 1]  # first place of an equal segment
        out, chunk = [], part.column("chunk").to_pylist()
        pick = np.flatnonzero(repeated)
        pick = pick[np.argsort(row[pick], kind="stable")]
        for own in np.split(pick, np.flatnonzero(np.diff(row[pick])) + 1):
            if len(own):
                out.append({"chunk": chunk[row[own[0]]], **_packed(anchor=a[own], digest=d[own], doc=doc[head[own]], start=start[head[own]], flag=differ[own].astype(np.uint8))})
        return to_table(out, reply_schema)

    def matched(piece: pa.RecordBatch, s: Segments, known: tuple) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Segments in the reply, their place in it, and whether each is the first of its kind."""
        key, a, d, doc, start, _ = known
        mine = _pairs_key(s.anchor, s.digest)
        at = np.minimum(np.searchsorted(key, mine), max(len(key) - 1, 0))
        hit = np.flatnonzero((a[at] == s.anchor) & (d[at] == s.digest)) if len(key) else np.empty(0, dtype=np.int64)
        at = at[hit] if len(hit) else hit
        first = (np.asarray(piece.column("doc"))[s.doc[hit]] == doc[at]) & (_places(piece, s)[hit] == start[at])
        return hit, at, first

    def lookup(reply: pa.Table) -> tuple:
        a, d, doc, start, flag, _ = _unpack(reply)
        key = _pairs_key(a, d)
        order = np.argsort(key, kind="stable")
        return key[order], a[order], d[order], doc[order], start[order], flag[order]

    def send_segments(key, part, reply):
        known = lookup(reply)
        out: dict[int, list] = {}
        if part.num_rows and len(known[0]):
            wanted = np.unique(known[3][known[5] > 0])
            batch = _sorted(part)
            batch = batch.filter(pa.array(np.isin(np.asarray(batch.column("doc")), wanted)))
            for piece in text_slices([batch], SLICE):
                s = Segments(piece.column("text"), width, anchor)
                hit, at, first = matched(piece, s, known)
                pick = hit[first & (known[5][at] > 0)]
                bucket = (s.anchor[pick] % _U(chunks)).astype(np.int64)
                ids, places = np.asarray(piece.column("doc")), _places(piece, s)
                for b in np.unique(bucket):
                    own = pick[bucket == b]
                    out.setdefault(int(b), []).append((s.anchor[own], ids[s.doc[own]], places[own], s.length[own].astype(np.int32), b"".join(s.data[x : x + n].tobytes() for x, n in zip(s.begin[own], s.length[own], strict=True))))
        entries = []
        for b, pieces in out.items():
            a, doc, start, size, text = zip(*pieces, strict=True)
            entries.append({"bucket": b, "chunk": key[0].as_py(), **_packed(anchor=np.concatenate(a), doc=np.concatenate(doc), start=np.concatenate(start), size=np.concatenate(size)), "text": b"".join(text)})
        return to_table(entries, segment_schema)

    def compare(key, part):
        cols = {c: b"".join(part.column(c).to_pylist()) for c in ("anchor", "doc", "start", "size", "text")}
        a, doc, start, size = np.frombuffer(cols["anchor"], _U), np.frombuffer(cols["doc"], np.int64), np.frombuffer(cols["start"], np.int64), np.frombuffer(cols["size"], np.int32).astype(np.int64)
        data, begin = np.frombuffer(cols["text"], np.uint8), np.cumsum(size) - size
        chunk = np.repeat(np.array(part.column("chunk").to_pylist()), [len(x) // 8 for x in part.column("anchor").to_pylist()])
        order = np.lexsort((start, doc, a))
        heads = np.flatnonzero(np.append(True, np.diff(a[order].view(np.int64)) != 0))
        found: dict[int, list] = {}
        lo = 0
        while lo < len(order):
            nxt = np.searchsorted(heads, lo + COLLECTION)  # whole anchors
            hi = int(heads[nxt - 1]) if heads[nxt - 1] > lo else int(heads[nxt]) if nxt < len(heads) else len(order)
            if lo + COLLECTION >= len(order):
                hi = len(order)
            own = order[lo:hi]
            take = np.repeat(begin[own] - np.cumsum(size[own]) + size[own], size[own]) + np.arange(size[own].sum())
            starts = repeated_windows(data[take], np.concatenate([[0], np.cumsum(size[own])]), width, np.stack([doc[own], start[own]], axis=1), block)
            for j, st in zip(own, starts, strict=True):
                if len(st):
                    cut = np.flatnonzero(np.diff(st) > width)
                    found.setdefault(int(chunk[j]), []).append((np.full(len(cut) + 1, doc[j]), start[j] + st[np.append(0, cut + 1)], start[j] + st[np.append(cut, len(st) - 1)] + width))
            lo = hi
        out = []
        for c, pieces in found.items():
            d, s, e = (np.concatenate(x) for x in zip(*pieces, strict=True))
            out.append({"chunk": c, "anchor": None, "digest": e.astype(np.int64).tobytes(), "doc": d.astype(np.int64).tobytes(), "start": s.astype(np.int64).tobytes(), "flag": None})
        return to_table(out, reply_schema)

    result_schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("removed", pa.list_(pa.int32()))])

    def cut_out(key, part, reply):
        ranged = pc.is_null(reply.column("anchor"))
        known, extra = lookup(reply.filter(pc.invert(ranged))), reply.filter(ranged)
        e_doc, e_start, e_end = (np.frombuffer(b"".join(extra.column(c).to_pylist()), t).astype(np.int64) for c, t in (("doc", np.int64), ("start", np.int64), ("digest", np.int64)))
        of: dict[tuple[int, int], list[tuple[int, int]]] = {}
        low = (1 << _PLACE) - 1
        for d, a, b in zip(e_doc.tolist(), e_start.tolist(), e_end.tolist(), strict=True):
            of.setdefault((d, a >> _PLACE), []).append((a & low, b & low))
        out = []
        for piece in text_slices([_sorted(part)], SLICE):
            s = Segments(piece.column("text"), width, anchor)
            hit, _, first = matched(piece, s, known)
            own = hit[~first]
            edge = np.zeros(len(s.data) + 1, dtype=np.int64)
            if len(own):
                np.add.at(edge, s.begin[own], 1)
                np.add.at(edge, s.begin[own] + s.length[own], -1)
            ids = np.asarray(piece.column("doc"))
            for i, row in enumerate(zip(ids.tolist(), piece.column("tag").to_pylist(), strict=True) if of else ()):
                for a, b in of.get(row, ()):
                    edge[s.offsets[i] + a] += 1
                    edge[s.offsets[i] + b] -= 1
            gone = np.cumsum(edge[:-1]) > 0
            turn = np.diff(gone.astype(np.int8), prepend=0, append=0)
            at = np.flatnonzero(turn)
            cut = np.searchsorted(at, s.offsets)
            n_gone = np.concatenate([[0], np.cumsum(gone)])[s.offsets]
            rows, spans = [], []
            for i in range(len(ids)):
                x, y = s.offsets[i], s.offsets[i + 1] - 1
                text = s.data[x:y]
                rows.append(hashlib.sha256(text if n_gone[i] == n_gone[i + 1] else text[~gone[x:y]]).hexdigest())
                spans.append(at[cut[i] : cut[i + 1]] - x)
            ident = [None if no else int(v) for v, no in zip(ids, piece.column("no_id").to_pylist(), strict=True)]
            out.append(pa.RecordBatch.from_arrays([pa.array(ident, pa.int64()), pa.array(np.diff(s.offsets) - 1), pa.array(np.diff(n_gone)), pa.array([len(x) // 2 for x in spans], pa.int64()), pa.array(rows), pa.array(spans, pa.list_(pa.int32()))], schema=result_schema))
        return pa.Table.from_batches(out, schema=result_schema)

    entries = dealt.applyInArrow(list_segments, "bucket int, chunk int, " + _LIST)
    repeats = entries.groupBy("bucket").applyInArrow(find_repeats, "chunk int, " + _LIST)
    segments = dealt.cogroup(repeats.groupBy("chunk")).applyInArrow(send_segments, "bucket int, chunk int, anchor binary, doc binary, start binary, size binary, text binary")
    ranges = segments.groupBy("bucket").applyInArrow(compare, "chunk int, " + _LIST)
    return dealt.cogroup(repeats.unionByName(ranges).groupBy("chunk")).applyInArrow(cut_out, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, removed array<int>")


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents")).drop("removed")
