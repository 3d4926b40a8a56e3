"""k-mers: integer encoding, canonical form, hashes, mod-mers, minimizers (FN12-FN15, W1, W2).

Decisions: digits A C G T N = 0 1 2 3 4 in base 5, first letter first; k is at most 27; a canonical k-mer is the lesser
of its value and that of its reverse complement; a minimizer is the least canonical value of `window` consecutive k-mers,
the leftmost of equals, and is dropped if it equals the one before it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .alphabet import reverse_complement

MAX_K = 27
#: Spark's xxhash64 starts from seed 42 and chains columns; this value hashes to 0 there, so the next column has seed 0.
SEED_ZERO = -365884300664092260


def check_k(k: int) -> None:
    if not 1 <= k <= MAX_K:
        raise ValueError(f"k must be from 1 to {MAX_K}")


def hash0(value: Column) -> Column:
    """XXH64 of a 64-bit value with seed 0 (FN12)."""
    return F.xxhash64(F.lit(SEED_ZERO), value)


def encode(kmer: Column) -> Column:
    return F.conv(F.translate(kmer, "ACGTN", "01234"), 5, 10).cast("bigint")


def canonical(kmer: Column) -> Column:
    return F.least(encode(kmer), encode(reverse_complement(kmer)))


#: Letters of a piece: slices are taken from pieces, as a slice of a whole sequence copies the sequence.
PIECE = 256


def slices(seqs: DataFrame, n: int, *keep: str) -> DataFrame:
    """The kept columns, p and the n bytes of `seq` from there on, as `slice`, of every place; shorter sequences have none.

    Sequences are cut in pieces that reach n - 1 letters into the next, so the time grows with the letters alone.
    """
    last = F.length("seq") - n
    cut = lambda b: F.transform(F.sequence(F.lit(0), last, F.lit(PIECE)), lambda i: F.struct(i.alias("from"), F.substring(b, i + 1, F.least(last - i, F.lit(PIECE - 1)) + n).alias("b")))
    # The lambda holds the bytes: they are copied from the string once.
    pieces = seqs.filter(F.length("seq") >= n).select(*keep, F.explode(F.transform(F.array(F.col("seq").cast("binary")), cut)[0]).alias("piece"))
    places = pieces.select(*keep, "piece", F.explode(F.sequence(F.lit(0), F.length("piece.b") - n)).alias("at"))
    return places.select(*keep, (F.col("piece.from") + F.col("at")).alias("p"), F.substring("piece.b", F.col("at") + 1, F.lit(n)).alias("slice"))


def kmers(seqs: DataFrame, k: int) -> DataFrame:
    """seq_id, pos, kmer of every place; sequences shorter than k have none."""
    check_k(k)
    return slices(seqs, k, "seq_id").select("seq_id", F.col("p").cast("bigint").alias("pos"), F.col("slice").cast("string").alias("kmer"))


#: Frames of a long sequence that are handled at once; values that a batch of results holds, beyond one chunk's.
CHUNK, HELD = 1 << 20, 1 << 18


def xxh64_of(values: np.ndarray) -> np.ndarray:
    """XXH64 with seed 0 of 64-bit values, as hash0()."""
    # The primes of XXH64.
    p1, p2, p3, p4, p5 = (np.uint64(x) for x in (11400714785074694791, 14029467366897019727, 1609587929392839161, 9650029242287828579, 2870177450012600261))
    turn = lambda x, r: (x << np.uint64(r)) | (x >> np.uint64(64 - r))
    h = (p5 + np.uint64(8)) ^ (turn(values.astype(np.int64).view(np.uint64) * p2, 31) * p1)
    h = turn(h, 27) * p1 + p4
    h = (h ^ (h >> np.uint64(33))) * p2
    h = (h ^ (h >> np.uint64(29))) * p3
    return (h ^ (h >> np.uint64(32))).view(np.int64)


def selected_parts(batches, select):
    """(seq_id, pos, value), arrays of one chunk each, of what select(seq) gives for each sequence of Arrow batches."""
    for batch in batches:
        ids, texts = batch.column("seq_id").to_numpy(), batch.column("seq")
        for i, seq_id in enumerate(ids):
            for pos, val in select(texts[i].as_py() or ""):
                yield np.full(len(pos), seq_id, np.int64), pos.astype(np.int64), val.astype(np.int64)


def held_parts(parts):
    """Parts joined to batches of bounded size, beyond one part's."""
    held, n = [], 0
    for part in parts:
        held.append(part)
        n += len(part[0])
        if n >= HELD:
            yield tuple(np.concatenate(x) for x in zip(*held, strict=True))
            held, n = [], 0
    if held:
        yield tuple(np.concatenate(x) for x in zip(*held, strict=True))


def long_enough(seqs: DataFrame, least: int) -> DataFrame:
    return seqs.select(F.col("seq_id").cast("long").alias("seq_id"), "seq").filter(F.length("seq") >= least)


def _selected(seqs: DataFrame, least: int, select) -> DataFrame:
    """seq_id, pos, value of what select(seq) gives for each sequence, chunk by chunk, in batches of bounded size."""

    def run(batches):
        for held in held_parts(selected_parts(batches, select)):
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in held], names=["seq_id", "pos", "value"])

    return long_enough(seqs, least).mapInArrow(run, "seq_id long, pos long, value long")


def mod_mers(seqs: DataFrame, k: int, mod_exp: int) -> DataFrame:
    """seq_id, pos, value of k-mers whose hash has mod_exp low zero bits; value is the hash (FN15)."""
    check_k(k)
    if not 0 <= mod_exp <= 62:
        raise ValueError("mod_exp must be from 0 to 62")
    return _selected(seqs, k, lambda seq: mod_mer_chunks(seq, k, mod_exp))


def mod_mer_chunks(seq: str, k: int, mod_exp: int):
    """(place, value) of the mod-mers of each chunk of a sequence."""
    for a in range(0, len(seq) - k + 1, CHUNK):
        h = xxh64_of(canonical_values(seq[a : a + CHUNK + k - 1], k))
        at = np.flatnonzero(h & ((1 << mod_exp) - 1) == 0)
        yield at + a, h[at]


def minimizers(seqs: DataFrame, k: int, w: int) -> DataFrame:
    """seq_id, pos, value of winnowing minimizers (FN14, W2), in numpy over Arrow batches; long sequences go in chunks."""
    check_k(k)
    if w < 1:
        raise ValueError("window must be at least 1")
    return _selected(seqs, k + w - 1, lambda seq: minimizer_chunks(seq, k, w))


def minimizers_of(seq: str, k: int, w: int) -> tuple[np.ndarray, np.ndarray]:
    """(place, value) of one sequence's minimizers."""
    out = list(minimizer_chunks(seq, k, w))
    return tuple(np.concatenate([p[i] for p in out]).astype(np.int64) if out else np.zeros(0, np.int64) for i in (0, 1))


def minimizer_chunks(seq: str, k: int, w: int):
    """(place, value) of the minimizers of each chunk of a sequence. A chunk begins one frame early, to see the value before it."""
    frames = len(seq) - (k + w - 1) + 1
    for a in range(0, max(frames, 0), CHUNK):
        begin = max(a - 1, 0)
        end = min(a + CHUNK, frames)
        low, at = window_minima(canonical_values(seq[begin : end + k + w - 2], k), w)
        new = np.ones(len(low), bool)
        new[1:] = low[1:] != low[:-1]
        new[: a - begin] = False
        yield at[new] + begin, low[new]


def window_minima(v: np.ndarray, w: int) -> tuple[np.ndarray, np.ndarray]:
    """(value, place) of the least of each w values side by side, the leftmost of equals."""
    low, ahead, size = v, np.zeros(len(v), np.uint8 if w <= 256 else np.int64), 1
    while size < w:
        step = min(size, w - size)
        right = low[step:] < low[:-step]
        # A choice by arithmetic: where() takes several times as long.
        ahead = ahead[:-step] + right * (ahead[step:] + ahead.dtype.type(step) - ahead[:-step])
        low, size = np.minimum(low[step:], low[:-step]), size + step
    return low, np.arange(len(low)) + ahead


def canonical_values(seq: str, k: int) -> np.ndarray:
    """Canonical base-5 values of all k-mers of a validated sequence."""
    d = _DIGIT[np.frombuffer(seq.encode("ascii", "replace"), np.uint8)]
    n = len(d) - k + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    forward, backward, c = np.zeros(n, np.int64), np.zeros(n, np.int64), _COMPLEMENT[d]
    for j in range(k):
        forward = forward * 5 + d[j : j + n]
        backward = backward * 5 + c[k - 1 - j : k - 1 - j + n]
    return np.minimum(forward, backward)


_DIGIT = np.full(256, 4, np.int64)
for _i, _c in enumerate(b"ACGT"):
    _DIGIT[_c] = _i
_COMPLEMENT = np.array([3, 2, 1, 0, 4])
