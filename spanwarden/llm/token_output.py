"""Token ids in a bit-packed binary form with random access.

Each shard is one self-contained byte string (all numbers little-endian):

    4s   magic b"SWTK"
    u2   version 1
    u1   bits of an id: the fewest that hold the vocabulary's largest id
    u1   0
    u4   ids of a block
    u8   documents
    u8   ids
    i8[] doc_id of each document (the smallest i8 where it is null)
    u8[] ids up to the end of each document
    u8[] byte offset of each block in the packed area, and its end
    ...  packed blocks: id k of a block fills bits k*bits to (k+1)*bits, low bit first

Shards stand in rows of a Parquet folder, so that Spark's commit protocol makes
retried tasks harmless on any file system: part and seq order them by doc_id, and
part_start counts the ids of the same part before the shard.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanwarden.llm.pieces import KEPT, encoder
from spanwarden.llm.workers import small_batches, trim
from spanwarden.session import new_path

HEAD = struct.Struct("<4sHBBIQQ")
MAGIC, BLOCK, SHARD_IDS = b"SWTK", 4096, 1 << 20
NO_ID = -(1 << 63)
SCHEMA = "part int, seq int, part_start long, n_docs long, n_ids long, payload binary"


def id_bits(vocab_size: int) -> int:
    return max(1, int(vocab_size - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    """Ids in ``bits`` bits each, low bit first; the last byte is filled with 0."""
    ids = np.ascontiguousarray(ids, "<u4")
    if len(ids) and bits < 32 and int(ids.max()) >> bits:
        raise ValueError(f"an id does not fit in {bits} bits")
    if bits in (8, 16, 32):
        return ids.astype(f"<u{bits // 8}").tobytes()
    each = np.unpackbits(ids.view(np.uint8).reshape(-1, 4), axis=1, bitorder="little")[:, :bits]
    return np.packbits(each.reshape(-1), bitorder="little").tobytes()


def unpack(data, n: int, bits: int) -> np.ndarray:
    if bits in (8, 16, 32):
        return np.frombuffer(data, f"<u{bits // 8}", n).astype("<u4")
    flat = np.unpackbits(np.frombuffer(data, np.uint8), bitorder="little", count=n * bits).reshape(n, bits)
    whole = np.zeros((n, 32), np.uint8)
    whole[:, :bits] = flat
    return np.packbits(whole, axis=1, bitorder="little").reshape(-1).view("<u4")


def write_shard(doc_ids: list, lengths: list[int], ids: np.ndarray, bits: int, block: int = BLOCK) -> bytes:
    packed = [pack(ids[i : i + block], bits) for i in range(0, len(ids), block)]
    offsets = np.cumsum([0, *map(len, packed)], dtype="<u8")
    keys = np.array([NO_ID if x is None else x for x in doc_ids], "<i8")
    return b"".join([HEAD.pack(MAGIC, 1, bits, 0, block, len(doc_ids), len(ids)), keys.tobytes(), np.cumsum(lengths, dtype="<u8").tobytes(), offsets.tobytes(), *packed])


class Shard:
    """Reads documents of a shard; only the blocks that hold them are unpacked."""

    def __init__(self, payload: bytes):
        magic, version, self.bits, _, self.block, n_docs, self.n_ids = HEAD.unpack_from(payload)
        if magic != MAGIC or version != 1:
            raise ValueError("not a token shard")
        n_blocks = -(-self.n_ids // self.block)
        at = HEAD.size
        self.doc_ids = np.frombuffer(payload, "<i8", n_docs, at)
        self.ends = np.frombuffer(payload, "<u8", n_docs, at + 8 * n_docs).astype(np.int64)
        self.offsets = np.frombuffer(payload, "<u8", n_blocks + 1, at + 16 * n_docs).astype(np.int64)
        self.packed = memoryview(payload)[at + 16 * n_docs + 8 * (n_blocks + 1) :]

    def ids(self, start: int, end: int) -> np.ndarray:
        if start >= end:
            return np.empty(0, "<u4")
        first, last = start // self.block, -(-end // self.block)
        n = min(self.n_ids, last * self.block) - first * self.block
        if self.block * self.bits % 8 == 0:
            got = unpack(self.packed[self.offsets[first] : self.offsets[last]], n, self.bits)
        else:
            sizes = [min(self.block, self.n_ids - k * self.block) for k in range(first, last)]
            got = np.concatenate([unpack(self.packed[self.offsets[k] : self.offsets[k + 1]], m, self.bits) for k, m in zip(range(first, last), sizes)])
        return got[start - first * self.block : end - first * self.block]

    def document(self, k: int) -> np.ndarray:
        return self.ids(int(self.ends[k - 1]) if k else 0, int(self.ends[k]))


def write_token_shards(docs: DataFrame, tokenizer: str, end_id: int, path: str, id_col: str = "doc_id", text_col: str = "text", kept: int = KEPT) -> None:
    """Encodes whole texts in ascending order of the id and writes shards to ``path``.

    Rows are dealt by ranges of the id, so a hot source or text spreads like any other;
    equal ids lie together, ordered by their text. Null ids come first; a null text is
    empty. Each document ends with ``end_id``. Other columns are not read.
    """
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    ordered = rows.repartitionByRange(parts, F.col("id")).sortWithinPartitions("id", "text")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part = encoder(tokenizer, kept), TaskContext.get().partitionId()
        bits, end = id_bits(max(enc.vocab_size, end_id + 1)), np.array([end_id], "<u4")
        keys, lengths, held, n, seq, before = [], [], [], 0, 0, 0

        def shard() -> pa.RecordBatch:
            payload = write_shard(keys, lengths, np.concatenate(held), bits)
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([seq], pa.int32()), pa.array([before]), pa.array([len(keys)]), pa.array([n]), pa.array([payload], pa.binary())], [x.split()[0] for x in SCHEMA.split(", ")])

        for b in batches:
            for key, ids in zip(b.column(0).to_pylist(), enc.ids(b.column(1).to_pylist())):
                keys.append(key)
                lengths.append(len(ids) + 1)
                held += [ids, end]
                n += len(ids) + 1
                if n >= SHARD_IDS:
                    yield shard()
                    seq, before = seq + 1, before + n
                    keys, lengths, held, n = [], [], [], 0
        if keys:
            yield shard()
        del keys, lengths, held
        trim()

    with small_batches(spark, max(250, kept // 250)):
        ordered.mapInArrow(encode, SCHEMA).write.parquet(path)


def part_starts(spark: SparkSession, path: str) -> dict[int, int]:
    """Ids before each part; one number for each partition of the writing job."""
    sizes = spark.read.schema(SCHEMA).parquet(path).groupBy("part").agg(F.sum("n_ids").alias("n")).orderBy("part").collect()
    out, total = {}, 0
    for r in sizes:
        out[r["part"]], total = total, total + r["n"]
    return out


def read_token_shards(spark: SparkSession, path: str, id_col: str = "doc_id") -> DataFrame:
    """id, start, n_tokens and ids_crc32 of each document, all taken from the shards."""
    starts = part_starts(spark, path)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part, before, payload in zip(*(b.column(k).to_pylist() for k in range(3))):
                shard = Shard(payload)
                raw = memoryview(shard.ids(0, shard.n_ids).tobytes())
                ends = shard.ends
                begins = np.concatenate([[0], ends[:-1]]).astype(np.int64)
                sums = [zlib.crc32(raw[4 * a : 4 * z]) for a, z in zip(begins.tolist(), ends.tolist())]
                keys = pa.array(shard.doc_ids, pa.int64(), mask=shard.doc_ids == NO_ID)
                yield pa.RecordBatch.from_arrays([keys, pa.array(begins + (starts[part] + before)), pa.array(ends - begins), pa.array(sums, pa.int64())], ["id", "start", "n_tokens", "ids_crc32"])

    shards = spark.read.schema(SCHEMA).parquet(path).select("part", "part_start", "payload")
    return shards.mapInArrow(read, "id long, start long, n_tokens long, ids_crc32 long").withColumnRenamed("id", id_col)


def token_output(docs: DataFrame, tokenizer: str, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text", kept: int = KEPT) -> DataFrame:
    """Writes ``docs`` as token shards in the shared folder and reads them back, a row for each document.

    A worker keeps about ``kept`` encoded pieces, some 250 bytes each: fewer cost time, not results.
    An empty table gives an empty result; see :func:`write_token_shards` for nulls and ties.
    """
    path = new_path(docs.sparkSession, "tokens")
    write_token_shards(docs, tokenizer, end_id, path, id_col, text_col, kept)
    return read_token_shards(docs.sparkSession, path, id_col)
