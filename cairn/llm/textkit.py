"""Vectorised word segmentation and hashing shared by the text operators.

Texts travel as UTF-8 bytes.  Words are maximal runs of the bytes that a class marks
as word bytes; both classes used here are decided by single bytes, so no decoding is
needed.  Everything below works on bounded blocks of about one megabyte, except that a
single longer document is one block of its own.
"""

from __future__ import annotations

import contextlib
import ctypes
import inspect
import sys
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

BLOCK = 1 << 20
U64 = np.uint64


def _class(non_word: list[int]) -> np.ndarray:
    table = np.ones(256, dtype=bool)
    table[non_word] = False
    return table


#: Words ``[^\x20\x09-\x0D]+``.
SPACED = _class([0x20, *range(0x09, 0x0E)])
#: Words ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` after lower-casing: digits, a-z and all that is not ASCII.
ALNUM = _class([*range(0x00, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)])

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_VALUES = np.random.default_rng(20240229).integers(1, 2**64 - 1, 256, dtype=np.uint64, endpoint=True)
_VALUES_LOWER = _VALUES[_LOWER]
_BASE = 0x9E3779B97F4A7C15
_POWERS: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> list[np.ndarray]:
    if len(_POWERS[0]) < n:
        size = max(n, BLOCK + 4096)
        for k, base in enumerate((_BASE, pow(_BASE, -1, 2**64))):
            steps = np.full(size, base, dtype=np.uint64)
            steps[0] = 1
            _POWERS[k] = np.cumprod(steps, dtype=np.uint64)
    return _POWERS


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    h = h ^ (h >> U64(32))
    h = h * U64(0xD6E8FEB86659FD93)
    h = h ^ (h >> U64(32))
    h = h * U64(0xD6E8FEB86659FD93)
    return h ^ (h >> U64(32))


class Words:
    """Words of several documents: hashes, and documents' bounds in them."""

    def __init__(self, hashes: np.ndarray, bounds: np.ndarray) -> None:
        self.hashes = hashes
        #: document i has the words bounds[i]:bounds[i + 1]
        self.bounds = bounds

    def doc_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.bounds) - 1), np.diff(self.bounds))


def _block(texts: list[bytes], table: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    raw = np.frombuffer(b"\n" + b"\n".join(texts) + b"\n", dtype=np.uint8)
    word = table[raw]
    edges = np.flatnonzero(word[1:] != word[:-1]) + 1
    starts, ends = edges[0::2], edges[1::2]
    power, inverse = _powers(len(raw) + 1)
    total = np.zeros(len(raw) + 1, dtype=np.uint64)
    np.cumsum(values[raw] * power[: len(raw)], out=total[1:])
    hashes = mix((total[ends] - total[starts]) * inverse[starts])
    places = np.cumsum([1] + [len(t) + 1 for t in texts])
    return hashes, np.searchsorted(starts, places)


def hash_words(texts: list[bytes | None], table: np.ndarray, lower: bool) -> Words:
    """64-bit hashes of all words of ``texts`` (None: no words)."""
    values = _VALUES_LOWER if lower else _VALUES
    hashes, bounds, at, base = [], [np.zeros(1, np.int64)], 0, 0
    while at < len(texts):
        block, size = [], 0
        while at < len(texts) and (not block or size + len(texts[at] or b"") <= BLOCK):
            block.append(texts[at] or b"")
            size += len(block[-1])
            at += 1
        h, b = _block(block, table, values)
        hashes.append(h)
        bounds.append(b[1:].astype(np.int64) + base)
        base += len(h)
    return Words(np.concatenate(hashes) if hashes else np.zeros(0, np.uint64), np.concatenate(bounds))


def window_hash(h: np.ndarray, size: int, at: np.ndarray, base: int = _BASE) -> np.ndarray:
    """Hash of the ``size`` word hashes that begin at each of ``at``."""
    out = np.zeros(len(at), dtype=np.uint64)
    for k in range(size):
        out *= U64(base)
        out += h[at + k]
    return mix(out)


def sub_sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums of ``values`` between consecutive bounds; an empty stretch sums to 0."""
    total = np.zeros(len(values) + 1, dtype=np.float64 if values.dtype.kind == "f" else np.int64)
    np.cumsum(values, out=total[1:])
    return total[bounds[1:]] - total[bounds[:-1]]


def tidy(run, encodes: bool = False):
    """A function of Arrow data that gives its worker's free memory back when it ends.

    Workers serve many tasks; what one leaves unused would count for the next.  A worker
    that begins work which does not encode tokens lets go of the encoder it kept.
    """

    def begin() -> None:
        tokens = sys.modules.get(f"{__package__}.tokens")
        if tokens and not encodes:
            tokens.encoder.cache_clear()

    def release() -> None:
        pa.default_memory_pool().release_unused()
        with contextlib.suppress(OSError, AttributeError):  # only the GNU library has it
            ctypes.CDLL(None).malloc_trim(0)

    def one(data):
        begin()
        try:
            return run(data)
        finally:
            release()

    def two(data, more):
        begin()
        try:
            return run(data, more)
        finally:
            release()

    def many(batches):
        begin()
        try:
            yield from run(batches)
        finally:
            release()

    if inspect.isgeneratorfunction(run):
        return many
    return one if len(inspect.signature(run).parameters) == 1 else two


def with_fields(df: DataFrame, **fields: str) -> T.StructType:
    """The schema of ``df`` with further fields; any names and types of its columns can be among them."""
    plain = [T.StructField(f.name, f.dataType, f.nullable) for f in df.schema.fields]
    return T.StructType(plain + [T.StructField(name, {"string": T.StringType(), "long": T.LongType(), "double": T.DoubleType()}[kind]) for name, kind in fields.items()])


def numbered(df: DataFrame) -> DataFrame:
    """``df`` with columns that are called by their number, as functions of Arrow data can't be asked for all names."""
    return df.toDF(*[f"_{k}" for k in range(len(df.columns))])


def extended(df: DataFrame, compute, text_col: str, most: int = 4 << 20, **fields: str) -> DataFrame:
    """``df`` with the further columns ``fields``; ``compute`` gives their arrays for a list of texts of about ``most`` bytes."""
    at, plain = df.columns.index(text_col), numbered(df)
    schema = with_fields(plain, **{f"_new{k}": kind for k, kind in enumerate(fields.values())})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, at, most):
            yield pa.RecordBatch.from_arrays([*batch.columns, *compute(as_bytes(batch.column(at)))], names=schema.names)

    return plain.mapInArrow(tidy(run), schema).toDF(*df.columns, *fields)


def as_bytes(column: pa.Array | pa.ChunkedArray) -> list[bytes | None]:
    return column.cast(pa.binary()).to_pylist()


def slices(batches: Iterator[pa.RecordBatch], text: int, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The batches cut so that the texts in column ``text`` of each make up about ``most`` bytes."""
    import pyarrow.compute as pc

    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column(text).cast(pa.binary())), 0).to_numpy(zero_copy_only=False))
        at = 0
        while at < batch.num_rows:
            upto = int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + most)) + 1
            yield batch.slice(at, upto - at)
            at = upto


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays as one compressed value; ascending whole numbers are kept as differences."""
    parts = []
    for a in arrays:
        step = a.dtype.kind in "iu" and len(a) > 1 and bool((a[1:] >= a[:-1]).all())
        raw = np.diff(a, prepend=a.dtype.type(0)) if step else a
        # a difference needs few of its bytes; planes of equal bytes compress well
        planes = np.ascontiguousarray(raw).view(np.uint8).reshape(len(a), -1).T.tobytes() if len(a) else b""
        head = f"{a.dtype.str},{len(a)},{int(step)};".encode()
        parts.append(len(head).to_bytes(2, "little") + head + planes)
    return zstandard.ZstdCompressor(level=1).compress(b"".join(parts))


def unpack(value: bytes) -> list[np.ndarray]:
    data, at, out = zstandard.ZstdDecompressor().decompress(value), 0, []
    while at < len(data):
        n = int.from_bytes(data[at : at + 2], "little")
        kind, count, step = data[at + 2 : at + 2 + n].decode().rstrip(";").split(",")
        at += 2 + n
        dtype = np.dtype(kind)
        size = int(count) * dtype.itemsize
        planes = np.frombuffer(data, np.uint8, size, at).reshape(dtype.itemsize, -1) if size else np.zeros((dtype.itemsize, 0), np.uint8)
        a = np.ascontiguousarray(planes.T).view(dtype).ravel()
        out.append(np.cumsum(a, dtype=dtype) if int(step) else a)
        at += size
    return out


def group_ids(table: pa.Table) -> tuple[pa.Table, list[int | None], list[bytes | None]]:
    """A group's rows in the order of id (null first), the hash of ``chunked`` and text, and ids and texts as lists."""
    import pyarrow.compute as pc

    order = pc.sort_indices(table, sort_keys=[("_id", "ascending"), ("_hash", "ascending"), ("_text", "ascending")], null_placement="at_start")
    table = table.take(order)
    return table, table.column("_id").to_pylist(), as_bytes(table.column("_text"))


def table_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder that all executors share."""
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        import tempfile

        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        top = tempfile.mkdtemp(prefix="cairn-")
        spark.conf.set("spark.checkpoint.dir", top)
    return f"{top.rstrip('/')}/cairn/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read again: its lineage ends here."""
    spark = df.sparkSession
    path = table_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def chunk_count(docs: DataFrame, text_col: str, each: int = 4 << 20, least: int = 32) -> int:
    """Chunks of about ``each`` bytes, from the bytes of the texts and 32 a row."""
    size = docs.agg(F.sum(F.coalesce(F.octet_length(text_col), F.lit(0)) + 32)).first()[0] or 0
    return max(least, -(-int(size) // each))


def bucket_count(chunks: int, each: int = 8, least: int = 32) -> int:
    """Buckets that chunks send to: one for ``each`` chunks, so that what they send stays in few, larger parts."""
    return max(min(chunks, least), chunks // each)


def chunked(docs: DataFrame, chunks: int, id_col: str, text_col: str, *more: Column) -> DataFrame:
    """``_chunk``, ``_hash``, ``_id``, ``_text`` and ``more``: chunks are ranges of the hash of id and text, so their order is the hash's."""
    hashed = F.pmod(F.xxhash64(F.col(id_col), F.col(text_col)), F.lit(1 << 32))
    chunk = F.shiftright(F.col("_hash") * chunks, 32)
    rows = docs.select(hashed.alias("_hash"), F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("_text"), *more)
    return rows.select(chunk.cast("long").alias("_chunk"), "*")


def bounded_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Smaller batches than Spark's defaults, to Python and from Parquet: texts can be long, and a batch is held whole."""
    bounds = {
        "spark.sql.execution.arrow.maxRecordsPerBatch": rows,
        "spark.sql.execution.arrow.maxBytesPerBatch": 4 << 20,
        "spark.sql.parquet.columnarReaderBatchSize": 512,
    }
    for key, most in bounds.items():
        now = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(key))
        if not 0 < now <= most:
            spark.conf.set(key, str(most))


def crc_remainder(doc_id, modulus: int):
    """crc32 of the id as text, modulo ``modulus``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % modulus
