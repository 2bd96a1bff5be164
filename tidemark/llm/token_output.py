"""Operator 1: token ids in fixed-width bit-packed shards.

Format. A shard set is a Parquet dataset of blocks, so that any store Spark reaches can hold it and its commit
protocol covers retried tasks. A block row has: shard, block (its number in the shard), block_start (ids in the
shard before it), width (bits of an id: the fewest that hold the vocabulary), n_ids, doc_ids, doc_ends (ids in the
block up to each document's end) and payload, the ids as n_ids fields of width bits on end, most significant bit
first, the last byte padded with zeros. Id k of a block starts at bit k * width, so one can be read alone.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import parallelism, piece_encoder, shared_dir, slices, tokenizer

BLOCK_IDS = 1 << 20
SLICE_BYTES = 4 << 20
CACHE_PIECES = 1_100_000
BLOCKS = "shard int, block int, block_start long, width int, n_ids long, doc_ids array<long>, doc_ends array<long>, payload binary"


def width_of(vocabulary: int) -> int:
    """The fewest bits that hold ids below vocabulary."""
    return max(1, int(vocabulary - 1).bit_length())


def pack(ids: np.ndarray, width: int) -> bytes:
    """Ids as fields of width bits, on end."""
    if width == 16:
        return ids.astype(">u2").tobytes()
    out = []
    for i in range(0, len(ids), 1 << 16):  # a multiple of eight fields ends on a byte
        bits = np.unpackbits(ids[i : i + (1 << 16)].astype(">u4").view(np.uint8).reshape(-1, 4), axis=1)
        out.append(np.packbits(bits[:, 32 - width :]).tobytes())
    return b"".join(out)


def unpack(payload: bytes, width: int, start: int, count: int) -> np.ndarray:
    """Ids start to start + count of a payload; reads only the bytes that hold them."""
    if width == 16:
        return np.frombuffer(payload, dtype=">u2", count=count, offset=2 * start).astype("<u4")
    out, weights = np.empty(count, dtype=np.uint32), (1 << np.arange(width - 1, -1, -1, dtype=np.uint32)).astype(np.uint32)
    for i in range(0, count, 1 << 16):
        n = min(1 << 16, count - i)
        bit = (start + i) * width
        raw = np.frombuffer(payload, dtype=np.uint8)[bit // 8 : (bit + n * width + 7) // 8]
        out[i : i + n] = np.unpackbits(raw)[bit % 8 : bit % 8 + n * width].reshape(n, width) @ weights
    return out


def _blocks(path: str, end_id: int, width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, shard = piece_encoder(path, CACHE_PIECES), TaskContext.get().partitionId()
        block = start = held = 0
        docs: list = []
        parts: list[np.ndarray] = []
        lengths: list[np.ndarray] = []

        def close() -> pa.RecordBatch:
            ids, ends = np.concatenate(parts), np.cumsum(np.concatenate(lengths))
            row = {"shard": shard, "block": block, "block_start": start, "width": width, "n_ids": len(ids), "doc_ids": docs, "doc_ends": ends.tolist(), "payload": pack(ids, width)}
            types = [pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array([v], type=t) for v, t in zip(row.values(), types, strict=True)], names=list(row))

        for batch in slices(batches, "text", SLICE_BYTES):
            ids, counts = encoder.encode(batch.column(1).to_pylist())
            with_end = np.full(len(ids) + len(counts), end_id, dtype=np.uint32)
            inner = np.ones(len(with_end), dtype=bool)
            inner[np.cumsum(counts + 1) - 1] = False
            with_end[inner] = ids
            docs += batch.column(0).to_pylist()
            parts.append(with_end)
            lengths.append(counts + 1)
            held += len(with_end)
            if held >= BLOCK_IDS:
                yield close()
                block, start, held, docs, parts, lengths = block + 1, start + held, 0, [], [], []
        if docs:
            yield close()

    return run


def write_tokens(docs: DataFrame, path: str, tokenizer_path: str, end_id: int) -> None:
    """Encodes documents(doc_id, text) and writes them to path in ascending doc_id order.

    A null text is empty: it gets the end id alone. A null doc_id comes first; rows of one doc_id are ordered by
    text. Other columns are not read. Each shard is one range of doc_ids, cut by their quantiles.
    """
    vocabulary = max(tokenizer(tokenizer_path).get_vocab_size(), end_id + 1)
    ordered = docs.select("doc_id", "text").repartitionByRange(parallelism(docs.sparkSession), "doc_id").sortWithinPartitions("doc_id", "text")
    ordered.mapInArrow(_blocks(tokenizer_path, end_id, width_of(vocabulary)), BLOCKS).write.option("compression", "none").parquet(path)


def _documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            ids = unpack(row["payload"], row["width"], 0, row["n_ids"]).astype("<u4", copy=False)
            ends = np.array(row["doc_ends"], dtype=np.int64)
            starts = np.concatenate([[0], ends[:-1]])
            sums = [zlib.crc32(ids[s:e]) for s, e in zip(starts.tolist(), ends.tolist(), strict=True)]
            columns = [pa.array(np.full(len(ends), row["shard"], dtype=np.int32)), pa.array(row["doc_ids"], pa.int64()), pa.array(row["block_start"] + starts), pa.array(ends - starts), pa.array(sums, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["shard", "doc_id", "in_shard", "n_tokens", "ids_crc32"])


def read_index(docs: DataFrame, path: str) -> DataFrame:
    """From a shard set: doc_id, start (ids of all documents before it), n_tokens, ids_crc32 (of its ids as little-endian uint32)."""
    blocks = docs.sparkSession.read.schema(BLOCKS).parquet(path)
    sizes = blocks.groupBy("shard").agg(F.sum("n_ids").alias("ids"))  # a row a shard
    base = sizes.select("shard", (F.sum("ids").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, 0)) - F.col("ids")).alias("base"))
    found = blocks.mapInArrow(_documents, "shard int, doc_id long, in_shard long, n_tokens long, ids_crc32 long")
    return found.join(base, "shard").select("doc_id", (F.col("base") + F.col("in_shard")).alias("start"), "n_tokens", "ids_crc32")


def read_documents(spark: SparkSession, path: str, doc_ids: list[int]) -> DataFrame:
    """doc_id, ids of the named documents of a shard set; only blocks that hold one are unpacked, and of these only its ids."""
    wanted, named = sorted(set(doc_ids)), set(doc_ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ends = [0, *row["doc_ends"]]
                mine = [k for k, d in enumerate(row["doc_ids"]) if d in named]
                ids = [unpack(row["payload"], row["width"], ends[k], ends[k + 1] - ends[k]).tolist() for k in mine]
                yield pa.RecordBatch.from_arrays([pa.array([row["doc_ids"][k] for k in mine], pa.int64()), pa.array(ids, pa.list_(pa.int64()))], names=["doc_id", "ids"])

    held = spark.read.schema(BLOCKS).parquet(path).where(F.arrays_overlap("doc_ids", F.array(*(F.lit(d).cast("long") for d in wanted))))
    return held.mapInArrow(run, "doc_id long, ids array<long>")


def token_output(docs: DataFrame, tokenizer_path: str, end_id: int = 2, path: str | None = None) -> DataFrame:
    """Writes the shard set (to a new shared folder unless path says otherwise) and returns its index, read from the files.

    An empty table gives an empty index.
    """
    path = path or shared_dir(docs.sparkSession)
    write_tokens(docs, path, tokenizer_path, end_id)
    return read_index(docs, path)
