"""Token ids in a binary format: fixed-width bit packing in blocks of whole documents.

Ids are stored in the fewest bits that hold the vocabulary, least significant bit
first.  A file (a Parquet file, so that any store Spark reaches will do, and a lost
executor's files are written again) holds blocks of about ``BLOCK`` ids: ``part``,
``block``, ``start`` (ids of the part before it), ``n_ids``, ``bits``, ``doc_ids``,
``ends`` (the documents' ends in the block) and ``packed``.  Blocks are independent:
numpy unpacks one as a whole, or any stretch of ids in it.  Parts follow the order of
doc_id; the table ``parts`` beside the blocks holds each part's first place.

Defined cases: a null text is empty and still gets the end id; null doc_ids come first;
rows that share a doc_id are in the order of
a hash of their texts; equal rows are documents of their own; an empty table makes no
block; a text longer than a block is one block; columns but the id and the text take no
part, whatever their names.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textkit as tk
from .tokens import default_path, encoder

BLOCK = 1 << 18
FILES = "part int, block long, start long, n_ids long, bits int, doc_ids array<long>, ends binary, packed binary"


def pack_bits(ids: np.ndarray, bits: int) -> bytes:
    if bits == 16:
        return ids.astype("<u2").tobytes()
    out = []
    for at in range(0, len(ids), 1 << 16):  # a multiple of 8 ids fills whole bytes
        part = ids[at : at + (1 << 16)].astype("<u4").view(np.uint8).reshape(-1, 4)
        out.append(np.packbits(np.unpackbits(part, axis=1, count=bits, bitorder="little").ravel(), bitorder="little").tobytes())
    return b"".join(out)


def unpack_bits(packed: bytes, bits: int, begin: int, end: int) -> np.ndarray:
    """Ids ``begin`` to ``end`` of a block, read from the bytes that hold them."""
    if bits == 16:
        return np.frombuffer(packed, "<u2", end - begin, 2 * begin).astype(np.uint32)
    out = np.empty(end - begin, dtype=np.uint32)
    for at in range(begin, end, 1 << 16):
        upto = min(end, at + (1 << 16))
        first = at * bits // 8
        raw = np.frombuffer(packed, np.uint8, -(-upto * bits // 8) - first, first)
        flat = np.unpackbits(raw, bitorder="little")[at * bits - first * 8 :][: (upto - at) * bits].reshape(-1, bits)
        wide = np.zeros((upto - at, 32), dtype=np.uint8)
        wide[:, :bits] = flat
        out[at - begin : upto - begin] = np.packbits(wide, axis=1, bitorder="little").view("<u4").ravel()
    return out


def _encode(path: str, end_id: int):
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = encoder(path, special=True)
        bits = max(made.vocabulary - 1, end_id).bit_length()
        part, number, start = TaskContext.get().partitionId(), 0, 0
        types = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.binary(), pa.binary()]
        for batch in tk.slices(batches, 1, 2 << 20):
            ids, bounds = made.encode_ended(batch.column(1), end_id)
            docs, at = batch.column(0).to_pylist(), 0
            while at < len(docs):
                upto = min(len(docs), int(np.searchsorted(bounds, bounds[at] + BLOCK)))
                own = ids[bounds[at] : bounds[upto]]
                row = [part, number, start, len(own), bits, docs[at:upto], (bounds[at + 1 : upto + 1] - bounds[at]).astype(np.int64).tobytes(), pack_bits(own, bits)]
                yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, types, strict=True)], names=[f.split()[0] for f in FILES.split(", ")])
                number, start, at = number + 1, start + len(own), upto

    return encode


def write_tokens(docs: DataFrame, path: str, tokenizer: str | None = None, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encode ``docs`` in the order of ``id_col`` to the tables ``path``/blocks and ``path``/parts."""
    spark = docs.sparkSession
    # the row's number spreads equal rows, and those without an id, over many parts
    keys = [F.col(id_col).cast("long").alias("_id"), F.xxhash64(F.col(text_col)).alias("_hash"), F.monotonically_increasing_id().alias("_nth")]
    rows = docs.select(*keys, F.col(text_col).alias("_text"))
    dealt = rows.repartitionByRange(tk.chunk_count(docs, text_col, least=8), "_id", "_hash", "_nth").sortWithinPartitions("_id", "_hash").select("_id", "_text")
    dealt.mapInArrow(tk.tidy(_encode(tokenizer or default_path(), end_id), encodes=True), FILES).write.option("compression", "none").parquet(f"{path}/blocks")
    counts = spark.read.parquet(f"{path}/blocks").groupBy("part").agg(F.sum("n_ids").alias("n"))
    # one row for each part that was written: small whatever the documents hold
    counts.selectExpr("part", "n", "coalesce(sum(n) OVER (ORDER BY part ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS first").write.parquet(f"{path}/parts")


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for r in range(batch.num_rows):
            doc_ids, start, n_ids, bits, ends, packed = (batch.column(i)[r] for i in range(6))
            ids = unpack_bits(packed.as_buffer(), bits.as_py(), 0, n_ids.as_py())
            ends = np.frombuffer(ends.as_buffer(), np.int64)
            begins = np.concatenate(([0], ends[:-1]))
            crc = [zlib.crc32(ids[a:b]) for a, b in zip(begins.tolist(), ends.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([doc_ids.values, pa.array(begins + start.as_py()), pa.array(ends - begins), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])


def read_blocks(spark: SparkSession, path: str) -> DataFrame:
    """The blocks with ``start`` counted over all parts."""
    parts = spark.read.parquet(f"{path}/parts").select("part", "first")
    return spark.read.schema(FILES).parquet(f"{path}/blocks").join(parts, "part").withColumn("start", F.col("start") + F.col("first")).drop("first")


def read_digests(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id``, ``start``, ``n_tokens``, ``ids_crc32`` of every document, from its unpacked ids."""
    return read_blocks(spark, path).select("doc_ids", "start", "n_ids", "bits", "ends", "packed").mapInArrow(tk.tidy(_digests), "doc_id long, start long, n_tokens long, ids_crc32 long")


def _stretch(first: int, last: int):
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, n, bits, packed in zip(*(batch.column(i) for i in range(4)), strict=True):
                start, n = start.as_py(), n.as_py()
                a, b = max(first - start, 0), min(last - start, n)
                ids = unpack_bits(packed.as_buffer(), bits.as_py(), a, b)
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(start + a, start + b)), pa.array(ids.astype(np.int64))], names=["place", "id"])

    return read


def read_stretch(spark: SparkSession, path: str, first: int, last: int) -> DataFrame:
    """``place`` and ``id`` of the ids from place ``first`` to before ``last``: of the blocks that hold them, only their bytes are unpacked."""
    held = read_blocks(spark, path).where((F.col("start") < last) & (F.col("start") + F.col("n_ids") > first))
    return held.select("start", "n_ids", "bits", "packed").mapInArrow(tk.tidy(_stretch(first, last)), "place long, id long")


def op7_token_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = tk.table_path(spark, "tokens")
    write_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"), path)
    return read_digests(spark, path)
