"""Token-id output: concatenated id arrays with Elias-Fano encoded document boundaries.

Documents are sorted by id over all partitions and written in blocks. A block holds its documents' token ids end to end and
two Elias-Fano sequences, of the documents' end positions and of their names (as distances from the first one): the low bits
of each number packed, the high bits in unary, and a sampled select directory, which readers use. Blocks are rows of a Parquet folder, so that any store Spark writes to will do and
Spark's commit protocol covers lost tasks; no task holds more than one block.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import SLICE_ROWS, checkpoint_folder, map_slices
from .tokens import default_tokenizer, encoder

END_ID = 0
#: A block is closed after the document that reaches this many ids.
BLOCK_TOKENS = 1 << 20
#: Every so many-th one bit of the high part has its position stored.
SELECT_EVERY = 64
BLOCKS = "part int, block long, n_docs long, n_tokens long, id_bytes int, ids binary, low_bits int, low binary, high binary, samples binary, first_id long, n_null int, name_low_bits int, name_low binary, name_high binary, name_samples binary"
#: Names in a block lie at most so far apart.
MOST_APART = 1 << 62
ROWS = "part int, block long, doc_id long, local_start long, n_tokens long, ids_crc32 long"


@dataclass(frozen=True)
class EliasFano:
    """A nondecreasing sequence of n integers in about n * (2 + log2(greatest / n)) bits."""

    n: int
    low_bits: int
    low: bytes
    high: bytes
    samples: bytes

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        values = np.asarray(values, np.int64)
        n = len(values)
        low_bits = max(0, int(np.log2(max(1, int(values[-1]) // n)))) if n else 0
        low = ((values[:, None] >> np.arange(low_bits)) & 1).astype(np.uint8).reshape(-1)
        ones = (values >> low_bits) + np.arange(n)
        high = np.zeros(int(ones[-1]) + 1 if n else 0, np.uint8)
        high[ones] = 1
        pack = lambda bits: np.packbits(bits, bitorder="little").tobytes()
        return cls(n, low_bits, pack(low), pack(high), ones[::SELECT_EVERY].astype("<u4").tobytes())

    def _low(self, first: int, count: int) -> np.ndarray:
        """The low parts of ``count`` values from the ``first``."""
        if not self.low_bits:
            return np.zeros(count, np.int64)
        a, b = first * self.low_bits, (first + count) * self.low_bits
        bits = np.unpackbits(np.frombuffer(self.low, np.uint8)[a // 8 : (b + 7) // 8], bitorder="little")[a % 8 : a % 8 + b - a]
        return bits.reshape(count, self.low_bits).astype(np.int64) @ (1 << np.arange(self.low_bits, dtype=np.int64))

    def select(self, k: int) -> int:
        """The k-th value: from the sampled one bit, on to the k-th one bit of the high part."""
        at = int.from_bytes(self.samples[k // SELECT_EVERY * 4 : k // SELECT_EVERY * 4 + 4], "little")
        left, byte = k % SELECT_EVERY, at // 8
        current = self.high[byte] >> (at % 8) << (at % 8)
        while (ones := current.bit_count()) <= left:
            left -= ones
            byte += 1
            current = self.high[byte]
        for _ in range(left):
            current &= current - 1
        one = byte * 8 + (current & -current).bit_length() - 1
        first, end = k * self.low_bits, (k + 1) * self.low_bits
        low = int.from_bytes(self.low[first // 8 : (end + 7) // 8], "little") >> first % 8 & (1 << self.low_bits) - 1
        return (one - k) << self.low_bits | low

    def values(self) -> np.ndarray:
        """The whole sequence."""
        ones = np.flatnonzero(np.unpackbits(np.frombuffer(self.high, np.uint8), bitorder="little"))[: self.n]
        return ((ones - np.arange(self.n)) << self.low_bits) | self._low(0, self.n)


def write_tokens(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None) -> None:
    """Encode the texts (null as empty), each with END_ID appended, and write blocks in ascending order of ids to ``path``.

    A null id sorts first; repeated ids are kept, ordered by text; repeated rows are kept. An empty table gives an empty
    folder. Only the two named columns are read, so others cannot clash. A text is never split over blocks; a task holds one
    block and one slice of rows, however long its texts. One shuffle, by ranges of the id.
    """
    tokenizer = tokenizer or default_tokenizer()
    end = np.array([END_ID], "<u4").tobytes()

    def block(part: int, number: int, ids: list, blobs: list[bytes]) -> tuple:
        data = np.frombuffer(b"".join(blobs), "<u4")
        width = 2 if not len(data) or int(data.max()) < 1 << 16 else 4
        ends = EliasFano.of(np.cumsum([len(b) // 4 for b in blobs]))
        known = [i for i in ids if i is not None]
        names = EliasFano.of(np.array([i - known[0] for i in known], np.int64))
        head = part, number, len(ids), len(data), width, data.astype(f"<u{width}").tobytes()
        return *head, ends.low_bits, ends.low, ends.high, ends.samples, known[0] if known else None, len(ids) - len(known), names.low_bits, names.low, names.high, names.samples

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part, number, ids, blobs, size = encoder(tokenizer), 0, 0, [], [], 0
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE_ROWS):
                piece = batch.slice(at, SLICE_ROWS)
                part = piece.column(2)[0].as_py()
                for i, blob in zip(piece.column(0).to_pylist(), encode.encode(piece.column(1).to_pylist())):
                    if ids and ids[-1] is not None and i - next(x for x in ids if x is not None) > MOST_APART:
                        yield record(block(part, number, ids, blobs))
                        number, ids, blobs, size = number + 1, [], [], 0
                    ids.append(i)
                    blobs.append(blob + end)
                    size += len(blobs[-1]) // 4
                    if size >= BLOCK_TOKENS:
                        yield record(block(part, number, ids, blobs))
                        number, ids, blobs, size = number + 1, [], [], 0
        if ids:
            yield record(block(part, number, ids, blobs))

    from pyspark.sql import types as T
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = to_arrow_schema(T.StructType.fromDDL(BLOCKS))

    def record(row: tuple) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([v], type=f.type) for v, f in zip(row, schema)], schema=schema)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    rows.withColumn("part", F.spark_partition_id()).mapInArrow(run, BLOCKS).write.parquet(path)


def documents_of(n_docs: int, ends: EliasFano, n_null: int, first_id: int | None, names: EliasFano) -> Iterator[tuple[int | None, int, int]]:
    """(name, start, end) of each document of a block, by select on its two sequences."""
    start = 0
    for k in range(n_docs):
        stop = ends.select(k)
        yield None if k < n_null else first_id + names.select(k - n_null), start, stop
        start = stop


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """One row per document from the files: doc_id, start (ids of all documents before it), n_tokens, ids_crc32.

    Null and repeated ids come back as they were written; an empty folder gives an empty result. A task holds one block.
    Starts of blocks are sums over block headers alone: within a part, and over parts (one row each).
    """
    blocks = spark.read.schema(BLOCKS).parquet(path)

    def run(*columns: list) -> Iterator[tuple]:
        for part, number, n_docs, width, data, bits, low, high, some, first_id, n_null, name_bits, name_low, name_high, name_some in zip(*columns):
            wide = np.frombuffer(data, f"<u{width}").astype("<u4")
            ends, names = EliasFano(n_docs, bits, low, high, some), EliasFano(n_docs - n_null, name_bits, name_low, name_high, name_some)
            for name, start, stop in documents_of(n_docs, ends, n_null, first_id, names):
                yield part, number, name, start, stop - start, zlib.crc32(wide[start:stop].tobytes())

    read = [c for c in blocks.columns if c != "n_tokens"]
    rows = map_slices(blocks.select(*read), run, ROWS)
    headers = blocks.select("part", "block", F.col("n_tokens").alias("_n"))
    earlier = lambda w: F.coalesce(F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = headers.groupBy("part").agg(F.sum("_n").alias("_n")).select("part", earlier(Window.orderBy("part")).alias("_part_start"))
    starts = headers.select("part", "block", earlier(Window.partitionBy("part").orderBy("block")).alias("_start")).join(parts, "part")
    out = rows.join(starts, ["part", "block"])
    return out.select("doc_id", (F.col("_part_start") + F.col("_start") + F.col("local_start")).alias("start"), "n_tokens", "ids_crc32")


def round_trip(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write the documents' ids to a new folder in the shared checkpoint folder and read them back; rows as there."""
    path = f"{checkpoint_folder(docs.sparkSession)}/token-blocks-{uuid.uuid4().hex}"
    write_tokens(docs, path, id_col, text_col)
    return read_tokens(docs.sparkSession, path)
