"""Shared helpers of the training-data operators: the shared work folder, Arrow text access and vectorised hashing."""

from __future__ import annotations

import ctypes
import gc

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shared import Stages, drop_stage, shared_dir, stage  # noqa: F401

#: Text handled at once inside a Python worker, so that memory follows this and not the Arrow batch.
SLICE_BYTES = 1 << 20
U64 = np.uint64


def tidy(spark: SparkSession) -> None:
    """Shuffle files go once nothing refers to them: say so now, not when the driver next happens to collect garbage."""
    gc.collect()
    spark._jvm.System.gc()


def stage_alone(df: DataFrame) -> DataFrame:
    """stage(), whose shuffle files go as soon as the table is written, not when the driver next collects garbage."""
    conf, key = df.sparkSession.conf, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = conf.get(key, None)
    conf.set(key, "true")
    try:
        return stage(df)
    finally:
        conf.set(key, before) if before is not None else conf.unset(key)


def broadcast_if(df: DataFrame, most: int) -> DataFrame:
    """df with a broadcast hint if it has at most `most` rows, by count; else as it is, for a shuffled join."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


#: Rows of whole texts in an Arrow batch, where the session leaves Spark's default of 10,000.
BATCH_ROWS = 2_000


def small_batches(spark: SparkSession) -> None:
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key) == "10000":
        spark.conf.set(key, str(BATCH_ROWS))


def release() -> None:
    """Give memory that a Python worker has freed back to the system, as workers outlive their tasks."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # no such call on this system
        pass


def pick_id_text(docs: DataFrame, id_col: str, text_col: str, *more: str) -> DataFrame:
    """Only the named columns, under fixed names, so that other columns of docs can't clash."""
    small_batches(docs.sparkSession)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), *[F.col(c) for c in more])


def text_slices(batch: pa.RecordBatch, column: str = "text", max_bytes: int = SLICE_BYTES):
    """Slices of a batch with at most max_bytes of text each (a longer single text stands alone)."""
    lengths = _byte_lengths(batch.column(column))
    start, total = 0, 0
    for i, n in enumerate(lengths):
        if i > start and total + n > max_bytes:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += n
    if start < batch.num_rows:
        yield batch.slice(start)
    release()


def _byte_lengths(col: pa.Array) -> list[int]:
    import pyarrow.compute as pc

    return pc.fill_null(pc.binary_length(col), 0).to_pylist()


def utf8_bytes(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(all bytes of a text column, row offsets); null is empty."""
    col = (col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col).fill_null("").cast(pa.large_string())
    _, offsets, data = col.buffers()
    at = np.frombuffer(offsets, dtype=np.int64)[col.offset : col.offset + len(col) + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], (at - at[0])


def code_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(all code points, row offsets) of a list of texts."""
    joined = "".join(texts)
    lengths = np.fromiter((len(t) for t in texts), dtype=np.int64, count=len(texts))
    return np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32), np.concatenate(([0], np.cumsum(lengths)))


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift, multiply), vectorised."""
    x = x.astype(U64, copy=True)
    x ^= x >> U64(32)
    x *= U64(0xD6E8FEB86659FD93)
    x ^= x >> U64(32)
    x *= U64(0xD6E8FEB86659FD93)
    x ^= x >> U64(32)
    return x


class PrefixHash:
    """Polynomial prefix hashes over symbols: the hash of any range in O(1), equal for equal ranges anywhere."""

    _powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    _small = None

    def __init__(self, symbols: np.ndarray, base: int = 0x9E3779B97F4A7C15, small: bool = False):
        """small: all symbols are below 1024."""
        n = len(symbols)
        power, inverse = self._tables(base | 1, n + 1)
        self.power, self.inverse = power, inverse
        if small or symbols.dtype == np.uint8:
            if PrefixHash._small is None:
                PrefixHash._small = mix64(np.arange(1024, dtype=U64) + U64(0x5851F42D4C957F2D))
            values = PrefixHash._small[symbols]
        else:
            values = mix64(symbols.astype(U64) + U64(0x5851F42D4C957F2D))
        values *= power[:n]
        self.sums = np.zeros(n + 1, U64)
        np.cumsum(values, out=self.sums[1:])

    @classmethod
    def _tables(cls, base: int, n: int):
        have = cls._powers.get(base)
        if have is None or len(have[0]) < n:
            size = max(n, 1 << 16)
            inv = pow(base, -1, 1 << 64)
            out = []
            for b in (base, inv):
                a = np.full(size, U64(b), U64)
                a[0] = U64(1)
                out.append(np.multiply.accumulate(a))
            have = cls._powers[base] = (out[0], out[1])
        return have

    def ranges(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Unmixed hashes of symbols[start:end], anchored at power 0."""
        return (self.sums[end] - self.sums[start]) * self.inverse[start]

    def without(self, start, end, cut_start, cut_end) -> np.ndarray:
        """Unmixed hashes of symbols[start:end] with symbols[cut_start:cut_end] deleted."""
        head = (self.sums[cut_start] - self.sums[start]) * self.inverse[start]
        tail = (self.sums[end] - self.sums[cut_end]) * self.inverse[cut_end] * self.power[cut_start - start]
        return head + tail


#: Byte values that separate words: space, \t \n \v \f \r.
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True


def word_spans(raw: np.ndarray, offsets: np.ndarray, breaks: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, row) of the words of all rows, [^\\x20\\x09-\\x0D]+ unless other bytes break words; words never cross rows."""
    n = len(raw)
    if not n:
        z = np.zeros(0, np.int64)
        return z, z, z
    word = ~breaks[raw]
    first = np.zeros(n + 1, bool)
    first[offsets[:-1]] = True  # an empty last row points past the end
    first = first[:n]
    prev = np.empty(n, bool)
    prev[0] = False
    prev[1:] = word[:-1]
    starts = np.flatnonzero(word & (~prev | first))
    after = np.empty(n, bool)
    after[-1] = True
    after[:-1] = ~word[1:] | first[1:]
    ends = np.flatnonzero(word & after) + 1
    return starts, ends, np.searchsorted(offsets, starts, side="right") - 1


def word_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte ranges."""
    return mix64(PrefixHash(raw).ranges(starts, ends)) if len(starts) else np.zeros(0, U64)


#: Odd multipliers that make a shingle depend on the order of its words.
_PLACE = [U64(x) for x in (0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3, 0x1D8E4E27C47D124F, 0xEB44ACCAB455D165, 0x9C6E6877736C46E3, 0x2F8E4E1DC38F6A7B)]


def shingle_hashes(words: np.ndarray, rows: np.ndarray, n_rows: int, size: int = 5, whole_short: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, first word, row offsets) of the word n-grams of every row.

    A row with 1 to size-1 words has one shingle of all its words if whole_short; rows without words have none.
    """
    counts = np.bincount(rows, minlength=n_rows)
    first = np.concatenate(([0], np.cumsum(counts)))
    per_row = np.maximum(counts - size + 1, 0)
    short = (counts > 0) & (counts < size) if whole_short else np.zeros(n_rows, bool)
    per_row = per_row + short
    offsets = np.concatenate(([0], np.cumsum(per_row)))
    at = np.arange(offsets[-1]) - np.repeat(offsets[:-1], per_row) + np.repeat(first[:-1], per_row)
    left = np.repeat(np.where(short, counts, size), per_row)
    out = np.zeros(len(at), U64)
    for k in range(size):
        live = left > k
        out += np.where(live, words[np.minimum(at + k, max(len(words) - 1, 0))] * _PLACE[k % len(_PLACE)] + U64(k + 1), U64(0)) if len(words) else U64(0)
    return mix64(out), at, offsets

