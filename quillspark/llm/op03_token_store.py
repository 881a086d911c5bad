"""Token-ID / binary output: frequency-ranked ids in byte-aligned variable-length coding.

Ids are replaced by their rank (0 = most frequent in the corpus), ranks are written little-endian in
1 to 4 bytes, and the byte counts stand apart in control bytes, four counts of two bits to a byte.
A file holds blocks of consecutive documents in ascending doc_id order:

    "QTOK" | version u32 | n_docs u64 | n_ids u64 | len(data) u64 | doc_ids i64[n_docs] |
    doc_id present u8[n_docs] | ids of each document u64[n_docs] | control bytes | data bytes

Blocks are rows of a Parquet table (shard, block, n_ids, blob), so that any store Spark can reach holds them;
the rank table (id at each rank) is a table of its own beside them. The reader looks up the byte counts
of a control byte in a table and gathers the bytes with numpy.

Nulls: a null text is an empty document (the end id alone); a null doc_id sorts first. Rows that repeat a
doc_id stay separate, in the order of their ids. Other columns are ignored. An empty table gives no blocks.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import discard, id_column, input_partitions, materialise, scratch_path, table, text_slices
from .vocab import as_list, vocabulary_path, word_bpe

END_ID = 2
BLOCK_IDS = 1 << 20
_LENGTHS = (((np.arange(256)[:, None] >> np.array([0, 2, 4, 6])) & 3) + 1).astype(np.uint8)


def vbyte_encode(values: np.ndarray) -> tuple[bytes, bytes]:
    """Control bytes and data bytes of unsigned 32-bit values."""
    v = np.ascontiguousarray(values, dtype="<u4")
    n = 1 + (v > 0xFF).astype(np.uint8) + (v > 0xFFFF) + (v > 0xFFFFFF)
    codes = np.zeros(-(-len(v) // 4) * 4, dtype=np.uint8)
    codes[: len(v)] = n - 1
    control = (codes.reshape(-1, 4) << np.array([0, 2, 4, 6], dtype=np.uint8)).sum(axis=1, dtype=np.uint8)
    data = v.view(np.uint8).reshape(-1, 4)[np.arange(4) < n[:, None]]
    return control.tobytes(), data.tobytes()


def vbyte_decode(control: np.ndarray, data: np.ndarray, n: int) -> np.ndarray:
    size = _LENGTHS[control].reshape(-1)[:n]
    at = np.cumsum(size, dtype=np.int64) - size
    out = data[at].astype(np.uint32)
    for k in (1, 2, 3):
        more = np.flatnonzero(size > k)
        out[more] |= data[at[more] + k].astype(np.uint32) << np.uint32(8 * k)
    return out


def pack_block(doc_ids: list[int | None], lengths: list[int], ranks: np.ndarray) -> bytes:
    control, data = vbyte_encode(ranks)
    head = b"QTOK" + np.uint32(1).tobytes() + np.array([len(doc_ids), len(ranks), len(data)], dtype="<u8").tobytes()
    ids = np.array([0 if i is None else i for i in doc_ids], dtype="<i8").tobytes()
    there = np.array([i is not None for i in doc_ids], dtype=np.uint8).tobytes()
    return head + ids + there + np.array(lengths, dtype="<u8").tobytes() + control + data


def unpack_block(blob: bytes, id_of_rank: np.ndarray) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """doc_ids, ids of each document and all ids of a block."""
    if blob[:4] != b"QTOK" or int.from_bytes(blob[4:8], "little") != 1:
        raise ValueError("not a token block of version 1")
    docs, n, size = np.frombuffer(blob, dtype="<u8", count=3, offset=8).tolist()
    at = 32
    ids = np.frombuffer(blob, dtype="<i8", count=docs, offset=at).tolist()
    there = np.frombuffer(blob, dtype=np.uint8, count=docs, offset=at + 8 * docs).tolist()
    lengths = np.frombuffer(blob, dtype="<u8", count=docs, offset=at + 9 * docs).astype(np.int64)
    at += 17 * docs
    control = np.frombuffer(blob, dtype=np.uint8, count=-(-n // 4), offset=at)
    data = np.frombuffer(blob, dtype=np.uint8, count=size, offset=at + len(control))
    return [i if ok else None for i, ok in zip(ids, there, strict=True)], lengths, id_of_rank[vbyte_decode(control, data, n)]


def encode_ids(docs: DataFrame, path: str) -> DataFrame:
    """doc_id and the ids of every whole text (in the encoder's ``dtype``), the end id last."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = word_bpe(path)
        for part in text_slices(batches):
            ids, at = bpe.encode(as_list(part.column("text")))
            last = np.array([END_ID], dtype=bpe.dtype).tobytes()
            rows = [ids[a:b].tobytes() + last for a, b in zip(at[:-1], at[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(rows, pa.binary())], names=["doc_id", "ids"])

    return docs.select(id_column(), "text").mapInArrow(run, "doc_id long, ids binary")


def rank_table(encoded: DataFrame, vocabulary: int, dtype: np.dtype) -> np.ndarray:
    """Ids by falling frequency, ties by id. Its size is bounded by the vocabulary, so the driver holds it."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(vocabulary, dtype=np.int64)
        for batch in batches:
            if batch.num_rows:
                seen += np.bincount(np.frombuffer(b"".join(batch.column(0).to_pylist()), dtype=dtype), minlength=vocabulary)
        there = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(there), pa.array(seen[there])], names=["id", "n"])

    rows = encoded.select("ids").mapInArrow(count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect()
    return np.array([r.id for r in sorted(rows, key=lambda r: (-r.n, r.id))], dtype="<u4")


def write_store(docs: DataFrame, path: str, tokenizer: str, block_ids: int = BLOCK_IDS) -> None:
    """Encode ``docs`` and write the token files below ``path`` (blocks/ and ranks/)."""
    spark = docs.sparkSession
    bpe = word_bpe(tokenizer)
    vocabulary, dtype = max(END_ID + 1, bpe.library.get_vocab_size()), bpe.dtype
    encoded = materialise(encode_ids(docs, tokenizer), "op3-ids")
    ranks = rank_table(encoded, vocabulary, dtype)
    rank_of = np.zeros(vocabulary, dtype=np.uint32)
    rank_of[ranks] = np.arange(len(ranks), dtype=np.uint32)
    shared = spark.sparkContext.broadcast(rank_of)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        shard, block = TaskContext.get().partitionId(), 0
        ids, parts, size = [], [], 0

        def flush() -> pa.RecordBatch:
            values = np.concatenate(parts)
            blob = pack_block(ids, [len(p) for p in parts], shared.value[values])
            return pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([block], pa.int32()), pa.array([len(values)], pa.int64()), pa.array([blob], pa.binary())], names=["shard", "block", "n_ids", "blob"])

        for batch in batches:
            for doc_id, raw in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                values = np.frombuffer(raw.as_buffer(), dtype=dtype)
                ids.append(doc_id)
                parts.append(values)
                size += len(values)
                if size >= block_ids:
                    yield flush()
                    ids, parts, size, block = [], [], 0, block + 1
        if ids:
            yield flush()

    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), input_partitions(encoded))
    ordered = encoded.repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id", "ids")
    ordered.mapInArrow(pack, "shard int, block int, n_ids long, blob binary").write.option("compression", "none").parquet(f"{path}/blocks")
    spark.createDataFrame([(ranks.tobytes(),)], "ids binary").coalesce(1).write.parquet(f"{path}/ranks")
    discard(encoded)


def read_store(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 and ids (unsigned 32-bit, little-endian) of each document of a store."""
    blocks = spark.read.schema("shard int, block int, n_ids long, blob binary").parquet(f"{path}/blocks")
    id_of_rank = np.frombuffer(spark.read.parquet(f"{path}/ranks").first().ids, dtype="<u4")
    shared = spark.sparkContext.broadcast(id_of_rank)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, block, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                docs, lengths, ids = unpack_block(blob, shared.value)
                end = np.cumsum(lengths)
                raw = [ids[a:b].tobytes() for a, b in zip(end - lengths, end, strict=True)]
                yield pa.RecordBatch.from_arrays([
                    pa.array([shard] * len(docs), pa.int32()), pa.array([block] * len(docs), pa.int32()), pa.array(docs, pa.int64()),
                    pa.array(end - lengths), pa.array(lengths), pa.array([zlib.crc32(r) for r in raw], pa.int64()), pa.array(raw, pa.binary()),
                ], names=["shard", "block", "doc_id", "within", "n_tokens", "ids_crc32", "ids"])

    rows = blocks.select("shard", "block", "blob").mapInArrow(read, "shard int, block int, doc_id long, within long, n_tokens long, ids_crc32 long, ids binary")
    running = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    shards = blocks.groupBy("shard").agg(F.sum("n_ids").alias("n")).select("shard", F.coalesce(F.sum("n").over(running), F.lit(0)).alias("before_shard"))
    inside = Window.partitionBy("shard").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = blocks.select("shard", "block", F.coalesce(F.sum("n_ids").over(inside), F.lit(0)).alias("before_block")).join(shards, "shard")
    return rows.join(offsets, ["shard", "block"]).select("doc_id", (F.col("before_shard") + F.col("before_block") + F.col("within")).alias("start"), "n_tokens", "ids_crc32", "ids")


def token_store(docs: DataFrame, tokenizer: str | None = None, path: str | None = None) -> DataFrame:
    """Write ``docs`` as token files and return what the files hold, read back."""
    path = path or scratch_path(docs.sparkSession, "op3-store")
    write_store(docs, path, tokenizer or vocabulary_path())
    return read_store(docs.sparkSession, path)


def op3_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_store(table(spark, sf_dir, "documents")).drop("ids")
