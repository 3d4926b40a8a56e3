"""Alignment of queries with windows of references: every start, every end, the least errors and a transcript (FN20, A7, J3).

All candidates of an Arrow batch are aligned at once, one banded pass each: a place on the main diagonal, with `errors`
places to either side, stands for 2 * errors + 1 starts, whose bands are rows of one array of bytes, so that a step of the
pass is a few vector operations over all starts and candidates.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Candidates that are aligned at once, and letters of all of them.
ROWS, LETTERS = 4096, 4 << 20
WINDOW = ("query_id", "seq_id", "base", "at", "seq", "b")


def banded(queries: list[bytes], windows: list[bytes], at: np.ndarray, errors: int) -> tuple[np.ndarray, ...]:
    """(candidate, start, end, errors) of all alignments of whole queries that start within `errors` places of `at` in their window."""
    n, k = len(queries), errors
    lengths = np.array([len(q) for q in queries], np.int64)
    order = np.argsort(lengths, kind="stable")
    lengths, queries, windows, at = lengths[order], [queries[i] for i in order], [windows[i] for i in order], np.asarray(at, np.int64)[order]
    longest, width = int(lengths.max(initial=0)), 2 * k + 1

    def matrix(texts: list[bytes], first: np.ndarray, rows: int) -> np.ndarray:
        """Letters from `first` on, a column for each text; 0 where there are none."""
        sizes = np.array([len(t) for t in texts], np.int64)
        flat = np.frombuffer(b"".join(texts) + b"\0", np.uint8)
        place = first[None, :] + np.arange(rows)[:, None]
        inside = (place >= 0) & (place < sizes)
        return np.where(inside, flat[np.where(inside, place + (np.cumsum(sizes) - sizes), 0)], np.uint8(0))

    query = matrix(queries, np.zeros(n, np.int64), longest)
    # Row x of text is the letter x - k places from the first start.
    text = matrix(windows, at - 2 * k, longest + 4 * k + 1)
    far = np.int8(k + 1)
    cells = np.full((width, width + 1, n), far, np.int8)  # start, diagonal (and one beyond), candidate
    for d in range(k, width):
        cells[:, d] = d - k
        for s in range(width):
            for j in range(1, d - k + 1):
                cells[s, d, text[k + s + j - 1] == 0] = far
    final = np.full((width, width, n), far, np.int8)
    done = int(np.searchsorted(lengths, 0, side="right"))
    for i in range(1, longest + 1):
        cells, live = cells[:, :, done:] if done else cells, slice(n - (cells.shape[2] - done), n)
        letter = query[i - 1, live]
        new = np.full(cells.shape, far, np.int8)
        for d in range(width):
            j = i + d - k
            if j < 0:
                continue
            if j == 0:
                new[:, d] = min(i, int(far))
                continue
            own = text[j + k - 1 : j + k - 1 + width, live]
            best = np.minimum(cells[:, d] + (own != letter), cells[:, d + 1] + np.int8(1))
            if d:
                np.minimum(best, new[:, d - 1] + np.int8(1), out=best)
            best[own == 0] = far
            np.minimum(best, far, out=new[:, d])
        cells = new
        upto = int(np.searchsorted(lengths, i, side="right"))
        base = live.start
        final[:, :, base:upto] = cells[:, :width, : upto - base]
        done = upto - base
    starts = text[k : k + width] != 0
    s, d, row = np.nonzero((final <= k) & starts[:, None, :])
    begin = at[row] + s - k
    end = begin + lengths[row] + d - k
    keep = (begin >= 0) & (end >= begin)
    return order[row][keep], begin[keep], end[keep], final[s, d, row][keep].astype(np.int64)


def transcript(query: bytes, text: bytes, errors: int) -> str:
    """A least-cost alignment of two whole strings within `errors`: runs of = (equal), X (replaced), I (letter of the query only), D (of the text only).

    From the end, letters are paired where that is best, else the text's is left alone, else the query's.
    """
    m, n, k = len(query), len(text), errors
    rows = [{j: j for j in range(min(n, k) + 1)}]
    for i in range(1, m + 1):
        row = {}
        for j in range(max(0, i - k), min(n, i + k) + 1):
            ways = [rows[i - 1][j] + 1] if j in rows[i - 1] else []
            if j:
                ways += [rows[i - 1][j - 1] + (query[i - 1] != text[j - 1])] if j - 1 in rows[i - 1] else []
                ways += [row[j - 1] + 1] if j - 1 in row else []
            row[j] = min(ways)
        rows.append(row)
    i, j, out = m, n, []
    while i or j:
        cost = rows[i][j]
        differ = i and j and query[i - 1] != text[j - 1]
        if i and j and rows[i - 1].get(j - 1, cost + 9) + differ == cost:
            out.append("X" if differ else "=")
            i, j = i - 1, j - 1
        elif j and rows[i].get(j - 1, cost + 9) + 1 == cost:
            out.append("D")
            j -= 1
        else:
            out.append("I")
            i -= 1
    return re.sub(r"(.)\1*", lambda x: f"{len(x.group())}{x.group(1)}", "".join(reversed(out)))


def _batches(batch: pa.RecordBatch):
    """Slices of a batch of windows by rows and letters."""
    sizes = np.asarray(pc.binary_length(batch.column("b"))).astype(np.int64) if batch.num_rows else np.zeros(0, np.int64)
    start, total = 0, 0
    for i, n in enumerate(sizes.tolist()):
        if i > start and (i - start >= ROWS or total + n > LETTERS):
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += n
    if start < batch.num_rows:
        yield batch.slice(start)


def _aligner(errors: int, ends: bool):
    def align(batches):
        for batch in batches:
            for part in _batches(batch):
                queries, windows = (part.column(c).cast(pa.binary()).to_pylist() for c in ("seq", "b"))
                row, begin, end, cost = banded(queries, windows, np.asarray(part.column("at")), errors)
                if not ends:  # least errors of each start
                    order = np.lexsort((cost, begin, row))
                    row, begin, cost = row[order], begin[order], cost[order]
                    first = np.ones(len(row), bool)
                    first[1:] = (row[1:] != row[:-1]) | (begin[1:] != begin[:-1])
                    row, begin, cost = row[first], begin[first], cost[first]
                ids = [np.asarray(part.column(c))[row] for c in ("query_id", "seq_id", "base")]
                out = [pa.array(ids[0], pa.int64()), pa.array(ids[1], pa.int64()), pa.array(ids[2] + begin, pa.int64())]
                if ends:
                    scripts = [transcript(queries[r], windows[r][b:e], errors) for r, b, e in zip(row, begin, end, strict=True)]
                    out += [pa.array(ids[2] + end, pa.int64()), pa.array(cost, pa.int32()), pa.array(scripts, pa.string())]
                else:
                    out.append(pa.array(cost, pa.int32()))
                yield pa.RecordBatch.from_arrays(out, names=["query_id", "seq_id", "pos", *(["end", "errors", "transcript"] if ends else ["errors"])])

    return align


def least_errors(windows: DataFrame, errors: int) -> DataFrame:
    """query_id, seq_id, pos, errors: the starts within `errors` of a window's place `at`, with their least errors over all ends."""
    return windows.select(*WINDOW).mapInArrow(_aligner(errors, False), "query_id long, seq_id long, pos long, errors int")


def alignments(windows: DataFrame, errors: int) -> DataFrame:
    """query_id, seq_id, pos, end, errors, transcript of every start and end within `errors`; each once, whatever windows it lies in."""
    found = windows.select(*WINDOW).mapInArrow(_aligner(errors, True), "query_id long, seq_id long, pos long, end long, errors int, transcript string")
    return found.groupBy("query_id", "seq_id", "pos", "end").agg(F.min("errors").alias("errors"), F.min("transcript").alias("transcript"))
