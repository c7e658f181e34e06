"""What the operators share: tables, shared scratch tables, and vectorised word work on Arrow batches.

Words are maximal runs of bytes other than space and \\t..\\r; a null text has none. Python code sees texts as UTF-8 bytes, in chunks
of whole texts of about `CHUNK` bytes, so memory follows one long text or one chunk, never a partition.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vouchline.session import work_dir

WORD = r"[^\x20\x09-\x0D]+"
CHUNK = 1 << 20
#: Rows of an Arrow batch sent to a Python worker: bounds memory when many long texts stand together.
BATCH_ROWS = 1000
U = np.uint64


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame, name: str, **options) -> DataFrame:
    """`df` written to the shared folder and read again: cuts the lineage, survives lost executors. `options` are the writer's."""
    spark = df.sparkSession
    path = work_dir(spark, name)
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def part_of(doc_id: str, modulus: int, remainder: int) -> Column:
    """Whether crc32 of the id as text leaves `remainder`; false for a null id."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % modulus == remainder, F.lit(False))


# --- words of a chunk of texts, as numpy arrays -----------------------------------------------------------------------------------

_rng = np.random.default_rng(20260101)
#: One random odd 64-bit number per byte value, and the multiplier of the rolling hash: fixed, so that every task hashes alike.
_BYTE = _rng.integers(0, 1 << 63, 256, dtype=np.uint64) * U(2) + U(1)
_BASE = int(_rng.integers(0, 1 << 62)) * 4 + 5
_POWERS: list[np.ndarray] = []
SPACES = np.zeros(256, bool)
SPACES[[32, *range(9, 14)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (wraps around)."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _POWERS or len(_POWERS[0]) < n:
        n = max(n, CHUNK + 1)
        inverse = pow(_BASE, -1, 1 << 64)
        tables = [np.full(n, U(b)) for b in (_BASE, inverse)]
        for t in tables:
            t[0] = 1
        _POWERS[:] = [np.multiply.accumulate(t) for t in tables]
    return _POWERS[0], _POWERS[1]


class Words:
    """Words of a chunk of texts: byte ranges, 64-bit hashes, and the text each belongs to."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, breaks: np.ndarray = SPACES):
        self.data, self.offsets, self.texts = data, offsets, len(offsets) - 1
        inside = ~breaks[data]
        n = len(data)
        first, last = inside.copy(), inside.copy()
        if n:
            first[1:] &= ~inside[:-1]
            last[:-1] &= ~inside[1:]
            at = offsets[:-1]
            at = at[at < n]
            first[at] = inside[at]
            at = offsets[1:]
            at = at[at > 0] - 1
            last[at] = inside[at]
        self.starts, self.ends = np.flatnonzero(first), np.flatnonzero(last) + 1
        self.doc = np.searchsorted(offsets[1:], self.starts, side="right")
        self.counts = np.bincount(self.doc, minlength=self.texts)
        self.first_word = np.concatenate(([0], np.cumsum(self.counts)))

    @functools.cached_property
    def _sums(self) -> np.ndarray:
        power, _ = _powers(len(self.data) + 1)
        out = np.zeros(len(self.data) + 1, np.uint64)
        np.cumsum(_BYTE[self.data] * power[: len(self.data)], out=out[1:])
        return out

    def hashes(self, starts: np.ndarray | None = None, ends: np.ndarray | None = None) -> np.ndarray:
        starts, ends = (self.starts, self.ends) if starts is None else (starts, ends)
        _, inverse = _powers(len(self.data) + 1)
        return mix((self._sums[ends] - self._sums[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))

    def windows(self, k: int) -> np.ndarray:
        """Positions of words where a window of k words of one text starts."""
        n = len(self.doc)
        if n < k:
            return np.zeros(0, np.int64)
        return np.flatnonzero(self.doc[: n - k + 1] == self.doc[k - 1 :])


def sequence_hash(h: np.ndarray, at: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k consecutive hashes from each position on."""
    out = np.full(len(at), U(k))
    for j in range(k):
        out = (out ^ h[at + j]) * U(0x9E3779B97F4A7C15)
        out ^= out >> U(29)
    return mix(out)


def chunks(texts, limit: int = CHUNK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of an Arrow column of binaries; nulls are empty."""
    import pyarrow as pa

    texts = texts.combine_chunks() if isinstance(texts, pa.ChunkedArray) else texts
    if isinstance(texts, pa.ChunkedArray):
        texts = pa.concat_arrays(texts.chunks) if texts.num_chunks else pa.array([], pa.binary())
    if texts.null_count:
        texts = texts.fill_null(b"")
    _, where, raw = texts.buffers()
    width = np.int64 if pa.types.is_large_binary(texts.type) else np.int32
    offsets = np.frombuffer(where, width)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64) if len(texts) else np.zeros(1, np.int64)
    data = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
    i = 0
    while i < len(texts):
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, side="right")) - 1)
        yield i, j, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        i = j


def gathered(batches: Iterator, limit: int = 2 * CHUNK) -> Iterator:
    """Record batches of about `limit` bytes, from smaller ones that follow each other."""
    import pyarrow as pa

    wait, held = [], 0
    for batch in batches:
        if batch.num_rows:
            wait.append(batch)
            held += batch.nbytes
        if held >= limit:
            yield from pa.Table.from_batches(wait).combine_chunks().to_batches()
            wait, held = [], 0
    if wait:
        yield from pa.Table.from_batches(wait).combine_chunks().to_batches()


def as_bytes(name: str = "text") -> Column:
    return F.col(name).cast("binary").alias(name)


def empty_like(df: DataFrame, name: str, base: str) -> str:
    """A column name that `df` does not have."""
    while name in df.columns:
        name += base
    return name


def bits_table(rows: DataFrame, hash_column: str, log2_bits: int) -> np.ndarray:
    """A one-hash Bloom filter of 2^log2_bits bits over the 64-bit hashes of `rows`: never larger, whatever the number of rows.

    Spark sets the bits; the driver gets 64-bit words, at most 2^(log2_bits - 6) of them.
    """
    slot = F.shiftrightunsigned(F.col(hash_column), 64 - log2_bits)
    words = (
        rows.select(F.shiftrightunsigned(slot, 6).alias("at"), F.call_function("shiftleft", F.lit(1).cast("long"), slot.bitwiseAND(63).cast("int")).alias("bit"))
        .groupBy("at").agg(F.bit_or("bit").alias("bits")).toArrow()
    )
    out = np.zeros(1 << (log2_bits - 6), np.int64)
    out[words["at"].to_numpy()] = words["bits"].to_numpy()
    return out.view(np.uint64)


def bits_hold(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    log2_bits = int(len(bits)).bit_length() - 1 + 6
    slot = hashes >> U(64 - log2_bits)
    return (bits[(slot >> U(6)).astype(np.int64)] >> (slot & U(63))) & U(1) == 1
