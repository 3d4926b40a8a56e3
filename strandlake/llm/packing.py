"""Best-fit packing of tokenised documents into fixed-length sequences (best-two-fit over length counts).

Piece lengths are at most `capacity`, so the plan of all bins follows from `capacity` counts, whatever the corpus size:
the counts go to the driver, bins are planned as patterns with multiplicities, and pieces find their places by their rank
within their length. Each pattern uses up at least one length, so there are at most `capacity` patterns.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import pick_id_text, stage, text_slices

CAPACITY = 2048
END_ID = 0


def plan_bins(counts: np.ndarray, capacity: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """Best-two-fit over counts[length]: a list of (how many bins, [(length, times in the bin)]).

    A bin is filled greedily with the longest piece that fits; then its shortest piece gives way to two unpacked pieces
    if they fill the gap that this opens more tightly.
    """
    left = counts.astype(np.int64).copy()
    left[0] = 0
    plan = []
    while True:
        lengths = np.flatnonzero(left)
        if not len(lengths):
            return plan
        free, gap, used = left.copy(), capacity, {}
        while gap:
            fits = np.flatnonzero(free[: gap + 1])
            if not len(fits):
                break
            n = int(fits[-1])
            k = int(min(free[n], gap // n))
            used[n] = used.get(n, 0) + k
            free[n] -= k
            gap -= n * k
        if gap:
            small = min(used)
            room = gap + small
            have = np.flatnonzero(free[: room + 1])
            if len(have):
                mate = room - have
                best = np.full(room + 1, 0, np.int64)
                best[have] = have
                best = np.maximum.accumulate(best)
                other = best[mate]
                same = (other == have) & (free[have] < 2)
                if same.any():
                    below = np.concatenate(([0], best[:-1]))
                    at = np.minimum(other[same], room)
                    other = other.copy()
                    other[same] = below[at]
                total = np.where(other > 0, have + other, 0)
                j = int(total.argmax())
                if total[j] > small:
                    used[small] -= 1
                    for n in (int(have[j]), int(other[j])):
                        used[n] = used.get(n, 0) + 1
                    used = {n: k for n, k in used.items() if k}
        times = int(min(left[n] // k for n, k in used.items()))
        for n, k in used.items():
            left[n] -= k * times
        plan.append((times, sorted(used.items(), reverse=True)))


def places(plan: list[tuple[int, list[tuple[int, int]]]], capacity: int) -> dict[str, np.ndarray]:
    """Runs of places: pieces of `length` with ranks from `rank` on take sequences from `base` on, all at `offset`."""
    rank, runs, base = np.zeros(capacity + 1, np.int64), [], 0
    for times, items in plan:
        offset = 0
        for n, k in items:
            for _ in range(k):
                runs.append((n, rank[n], base, offset))
                rank[n] += times
                offset += n
        base += times
    runs.sort()
    cols = np.array(runs, np.int64).reshape(-1, 4).T
    return {"length": cols[0], "rank": cols[1], "base": cols[2], "offset": cols[3]}


PIECE_SCHEMA = "part int, doc_id long, piece int, start long, length int, ids_crc32 long, local_rank long, ids binary"


def token_pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Pieces of at most `capacity` ids of every document; a document ends with end_id, null text is empty."""

    def run(batches):
        from pyspark import TaskContext

        from .tokens import WordEncoder

        enc, part, seen = WordEncoder.open(tokenizer), TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        for batch in batches:
            for cut in text_slices(batch):
                texts = [t or "" for t in cut.column("text").to_pylist()]
                ids, off = enc.encode(texts)
                out = {k: [] for k in ("doc_id", "piece", "start", "length", "ids_crc32", "local_rank", "ids")}
                for i, doc in enumerate(cut.column("doc_id").to_pylist()):
                    own = np.append(ids[off[i] : off[i + 1]], np.uint32(end_id)).astype("<u4")
                    for p, s in enumerate(range(0, len(own), capacity)):
                        raw = own[s : s + capacity].tobytes()
                        n = len(raw) // 4
                        for k, v in zip(out, (doc, p, s, n, zlib.crc32(raw), int(seen[n]), raw if with_ids else None), strict=True):
                            out[k].append(v)
                        seen[n] += 1
                n = len(out["piece"])
                types = (pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array([part] * n, pa.int32()), *[pa.array(v, t) for v, t in zip(out.values(), types, strict=True)]], names=["part", *out])

    return pick_id_text(docs, id_col, text_col).mapInArrow(run, PIECE_SCHEMA)


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Pack all documents into sequences of at most `capacity` tokens.

    One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset (and ids if with_ids). Only documents
    longer than capacity are cut. Null text is the end id alone; null and repeated doc_ids are rows like any other;
    an empty table gives no rows; other columns of docs are ignored.
    """
    pieces = stage(token_pieces(docs, tokenizer, capacity, end_id, id_col, text_col, with_ids))
    spark = docs.sparkSession
    per_part = pieces.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n"))
    counts = np.zeros(capacity + 1, np.int64)
    for n, c in per_part.groupBy("length").agg(F.sum("n")).collect():  # at most `capacity` rows
        counts[n] = c
    runs = places(plan_bins(counts, capacity), capacity)
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_part.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("rank_before"))
    shared = spark.sparkContext.broadcast({"key": runs["length"] << 48 | runs["rank"], **runs})
    fields = ["doc_id", "piece", "start", "length", "ids_crc32", *(["ids"] if with_ids else [])]
    kinds = {"doc_id": "long", "piece": "int", "start": "long", "length": "long", "ids_crc32": "long", "ids": "binary"}

    def place(batches):
        run = shared.value
        for b in batches:
            n = b.column("length").to_numpy(zero_copy_only=False).astype(np.int64)
            rank = b.column("rank").to_numpy(zero_copy_only=False)
            at = np.searchsorted(run["key"], n << 48 | rank, side="right") - 1
            cols = [b.column(f) if f != "length" else pa.array(n) for f in fields]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(run["base"][at] + rank - run["rank"][at]), pa.array(run["offset"][at])], names=[*fields, "sequence_id", "offset"])

    ranked = pieces.join(offsets, ["part", "length"]).select(*fields, (F.col("rank_before") + F.col("local_rank")).alias("rank"))
    return ranked.mapInArrow(place, ", ".join(f"{f} {kinds[f]}" for f in fields) + ", sequence_id long, offset long")
