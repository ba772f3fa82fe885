"""Operator 2: token-id files with Elias-Fano encoded document boundaries.

Documents are dealt by ranges of the document id, so that shard after shard holds them in ascending
order. Each shard is a run of blocks; a block is one row of a Parquet table (written through Spark's
commit protocol, so that it survives lost executors and works on any store): the concatenated ids
(16 bits each where the vocabulary allows, else 32), the documents' boundaries and the documents'
own ids, the latter two Elias-Fano encoded. A select structure over the upper bits (one 32-bit
sample for every 256 ones) returns any boundary without a table of 64-bit offsets.

Elias-Fano, for a rising sequence of n numbers below u: the low l = log2(u / n) bits of each are
stored as they are, the rest in unary as a bit vector of n ones and u / 2^l zeros: about 2 + l bits
a number. select(i) finds the i-th one and adds the low bits.

Defined results: a null or empty text is a document of the end id alone; null document ids come
first; documents of equal id keep one place each, ordered by the hash of their text and then the
text, whatever the partitioning; an empty table makes an empty set of files; other columns are not
read. A document longer than a block makes its block longer.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import opened, vocabulary_text
from .common import col, expire, action_settings, scratch_path, table

#: Ids after which a block is closed.
BLOCK_IDS = 1 << 20
#: Words and pieces of a worker's memos: more than usual, since no other stage shares the executor. Cost only.
MEMO = 40_000, 800_000
#: Rows of the result that a reading task makes at a time.
DOCS_AT_ONCE = 4096
#: One sample of the select structure for so many ones.
SAMPLE = 256
_BLOCK = "shard int, block int, start_in_shard bigint, n_docs bigint, n_null_ids bigint, n_ids bigint, width int, ids binary, bounds binary, first_id bigint, doc_ids binary"


class EliasFano:
    """A rising sequence of whole numbers from 0 on, packed; select(i) is the i-th of them."""

    def __init__(self, n: int, low_bits: int, low: np.ndarray, high: np.ndarray, samples: np.ndarray):
        self.n, self.low_bits, self.low, self.high, self.samples = n, low_bits, low, high, samples

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        v = np.asarray(values, dtype=np.uint64)
        n, top = len(v), int(v[-1]) if len(v) else 0
        low_bits = max(0, ((top + 1) // max(n, 1)).bit_length() - 1)
        places = (v >> np.uint64(low_bits)).astype(np.int64) + np.arange(n)
        bits = np.zeros(int(places[-1]) + 1 if n else 0, dtype=np.uint8)
        bits[places] = 1
        low = (v[:, None] >> np.arange(low_bits, dtype=np.uint64)[None, :] & np.uint64(1)).astype(np.uint8).reshape(-1)
        return cls(n, low_bits, np.packbits(low, bitorder="little"), np.packbits(bits, bitorder="little"), places[::SAMPLE].astype(np.uint32))

    def select(self, i: int) -> int:
        """The i-th number: from the sample before it, ones are counted byte by byte."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        place, left = int(self.samples[i // SAMPLE]), i % SAMPLE
        at = place >> 3
        byte = int(self.high[at]) >> (place & 7) << (place & 7)
        while (ones := byte.bit_count()) <= left:
            left -= ones
            at += 1
            byte = int(self.high[at])
        for _ in range(left):
            byte &= byte - 1
        found = (at << 3) + (byte & -byte).bit_length() - 1
        return (found - i) << self.low_bits | self._low(i)

    def _low(self, i: int) -> int:
        first = i * self.low_bits
        last = first + self.low_bits
        return int.from_bytes(self.low[first >> 3 : (last + 7) >> 3].tobytes(), "little") >> (first & 7) & ((1 << self.low_bits) - 1)

    def all(self) -> np.ndarray:
        """Every number, as select would return them one by one."""
        places = np.flatnonzero(np.unpackbits(self.high, bitorder="little"))[: self.n]
        low = np.unpackbits(self.low, bitorder="little")[: self.n * self.low_bits].reshape(self.n, self.low_bits).astype(np.int64)
        return (places - np.arange(self.n) << self.low_bits) + (low << np.arange(self.low_bits)).sum(axis=1)

    def to_bytes(self) -> bytes:
        """Four 32-bit little-endian numbers (n, low bits, bytes of low and of high bits), then low, high and samples."""
        return np.array([self.n, self.low_bits, len(self.low), len(self.high)], "<u4").tobytes() + self.low.tobytes() + self.high.tobytes() + self.samples.astype("<u4").tobytes()

    @classmethod
    def from_bytes(cls, raw: bytes) -> EliasFano:
        n, low_bits, a, b = np.frombuffer(raw, "<u4", 4).tolist()
        return cls(n, low_bits, np.frombuffer(raw, np.uint8, a, 16), np.frombuffer(raw, np.uint8, b, 16 + a), np.frombuffer(raw, "<u4", -1, 16 + a + b))


def _block(shard: int, block: int, start: int, doc_ids: list, ids: list[bytes], width: int) -> dict:
    nulls = sum(d is None for d in doc_ids)
    known = np.array(doc_ids[nulls:], dtype=np.int64)
    first = int(known[0]) if len(known) else 0
    ends = np.cumsum([0, *map(len, ids)]) // width
    return {
        "shard": shard, "block": block, "start_in_shard": start, "n_docs": len(doc_ids), "n_null_ids": nulls, "n_ids": int(ends[-1]), "width": width,
        "ids": b"".join(ids), "bounds": EliasFano.of(ends).to_bytes(), "first_id": first, "doc_ids": EliasFano.of(known - first).to_bytes(),
    }


def write_files(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text", end_id: int = 0, vocabulary: str | None = None, block_ids: int = BLOCK_IDS) -> None:
    """Encodes every whole text and writes the ids, an end id after each document, in ascending order of the document id."""
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(vocabulary_text(vocabulary))
    # dealt before encoding: dealing by ranges reads its input twice
    keyed = docs.select(col(doc_id).cast("bigint").alias("doc_id"), F.coalesce(col(text).cast("string"), F.lit("")).alias("text")).withColumn("h", F.xxhash64("text"))
    # rows of one id may be dealt to several shards: by the hash of the text, which the order follows
    order = [F.asc_nulls_first("doc_id"), F.asc("h")]
    dealt = keyed.repartitionByRange(*order).sortWithinPartitions(*order, "text").select("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        bpe = opened(sent.value, *MEMO)
        width, end = bpe.width, bpe.pack([end_id])
        shard, block, start, held = TaskContext.get().partitionId(), 0, 0, 0
        names, parts = [], []
        schema = pa.schema([("shard", pa.int32()), ("block", pa.int32()), ("start_in_shard", pa.int64()), ("n_docs", pa.int64()), ("n_null_ids", pa.int64()), ("n_ids", pa.int64()), ("width", pa.int32()), ("ids", pa.binary()), ("bounds", pa.binary()), ("first_id", pa.int64()), ("doc_ids", pa.binary())])
        for batch in batches:
            for name, whole in zip(batch.column(0), batch.column(1)):
                name, whole = name.as_py(), whole.as_py()
                names.append(name)
                parts.append(bpe.packed(whole) + end)
                held += len(parts[-1]) // width
                if held >= block_ids:
                    yield pa.RecordBatch.from_pylist([_block(shard, block, start, names, parts, width)], schema)
                    block, start, held, names, parts = block + 1, start + held, 0, [], []
        if names:
            yield pa.RecordBatch.from_pylist([_block(shard, block, start, names, parts, width)], schema)

    with action_settings(spark):
        dealt.mapInArrow(run, _BLOCK).write.parquet(path)


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """Per document, from the files alone: doc_id, start (ids of all documents before it), n_tokens, ids_crc32."""
    blocks = spark.read.schema(_BLOCK).parquet(path)
    # one row a shard: as many as the writing job had tasks
    shards = blocks.groupBy("shard").agg(F.sum("n_ids").alias("total"))
    before = shards.selectExpr("shard", "sum(total) over (order by shard rows between unbounded preceding and current row) - total as base")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in (batch.slice(i, 1).to_pylist()[0] for batch in batches for i in range(len(batch))):
            bounds, known = EliasFano.from_bytes(row["bounds"]), EliasFano.from_bytes(row["doc_ids"])
            ids, before = np.frombuffer(row["ids"], f"<u{row['width']}").astype("<u4"), row["base"] + row["start_in_shard"]
            rows, start = [], bounds.select(0)
            for i in range(bounds.n - 1):
                end, at = bounds.select(i + 1), i - row["n_null_ids"]
                rows.append((None if at < 0 else known.select(at) + row["first_id"], before + start, end - start, zlib.crc32(ids[start:end])))
                start = end
                if len(rows) == DOCS_AT_ONCE or i == bounds.n - 2:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], names=["doc_id", "start", "n_tokens", "ids_crc32"])
                    rows = []

    columns = ["start_in_shard", "n_null_ids", "width", "ids", "bounds", "first_id", "doc_ids"]
    placed = blocks.select("shard", *columns).join(F.broadcast(before), "shard").select("base", *columns)
    return placed.mapInArrow(run, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "token-ids")
    write_files(table(spark, sf_dir, "documents"), path)
    expire(spark, path)
    return read_files(spark, path)


QUERIES = {"op2_token_files": op2_token_files}
SQL: dict[str, str] = {}
