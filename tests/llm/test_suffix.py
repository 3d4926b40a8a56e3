import random
from collections import Counter

import numpy as np

from .brute import ODD, SF, frame, sha


def brute(rows, m=50):
    first = {}
    data = [(d if d is not None else 2**63 - 1, (t or "").encode()) for d, t in rows]
    for d, b in data:
        for i in range(len(b) - m + 1):
            w = b[i : i + m]
            first[w] = min(first.get(w, d), d)
    out = []
    for (d, b), (doc, _) in zip(data, rows, strict=True):
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - m + 1):
            if first[b[i : i + m]] < d:
                gone[i : i + m] = True
        spans = int((np.diff(np.concatenate(([0], gone.view(np.int8)))) == 1).sum())
        out.append((doc, len(b), int(gone.sum()), spans, sha(bytes(x for x, g in zip(b, gone, strict=True) if not g))))
    return Counter(out)


def got(df):
    return Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in df.collect())


def test_sorted_suffixes():
    from strandlake.llm.induced_sort import Scratch, sorted_suffixes

    rng = np.random.default_rng(1)
    x = rng.integers(0, 4, 200)
    texts = [rng.integers(0, k, n) for n, k in ((0, 2), (1, 2), (2, 1), (300, 2), (3000, 3), (3000, 245), (2000, 1), (757, 3))] + [np.concatenate([x] * 8 + [rng.integers(0, 4, 500)] + [x] * 5)]
    for raw in texts:
        b = raw.astype(np.uint8).tobytes()
        for entries in (10**9, 1000, 50):
            with Scratch(entries) as scratch:
                parts = [(p, np.array(c)) for p, c in sorted_suffixes(np.append(raw + 1, 0).astype(np.uint8), 60, scratch)]
            order, common = (np.concatenate(c).tolist() for c in zip(*parts, strict=True))
            assert sorted(order) == list(range(len(b)))
            cut = [b[i : i + 60] for i in order]
            assert cut == sorted(cut)
            for k, (v, w) in enumerate(zip(cut, cut[1:], strict=False)):
                assert common[k + 1] == next((i for i, (c, d) in enumerate(zip(v, w, strict=False)) if c != d), min(len(v), len(w)))


def test_shards_larger_than_memory_go_to_files(monkeypatch):
    from strandlake.llm import induced_sort
    from strandlake.llm.induced_sort import BucketQueue, Pile, Scratch, sorted_suffixes

    text = np.append(np.random.default_rng(2).integers(1, 5, 40_000), 0).astype(np.uint8)
    held = []
    for kind in (Pile, BucketQueue):
        was = kind.append if kind is Pile else kind.push

        def watched(self, *args, was=was):
            was(self, *args)
            held.append(self.held)

        monkeypatch.setattr(kind, "append" if kind is Pile else "push", watched)
    deep = []
    parts = induced_sort._sorted_parts
    monkeypatch.setattr(induced_sort, "_sorted_parts", lambda t, d, s: (deep.append(len(t)), parts(t, d, s))[1])
    with Scratch(1000) as scratch:  # 40 times its bound
        assert sum(len(p) for p, _ in sorted_suffixes(text, 50, scratch)) == 40_000
        assert scratch.n_files > 10
    assert max(held) <= 1000 and len(deep) > 2


def test_repeats(spark):
    from strandlake.llm.suffix_dedup import dedup_substrings

    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    rng = random.Random(4)
    for k in range(120):
        parts = []
        for _ in range(4):
            t = rng.choice(rows)[1]
            i = rng.randrange(max(len(t) - 60, 1))
            parts.append(t[i : i + rng.choice((30, 49, 50, 51, 75, 80, 300))])
        rows.append((1000 + k, rng.choice(("", " ", "é")).join(parts)))
    rng.shuffle(rows)
    d = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute(rows)
    for more in ({"block_bytes": 40_000}, {"block_bytes": 20_000, "hot_cells": 1}, {"entries": 2000, "max_buckets": 3, "block_bytes": 30_000}, {"entries": 3000, "max_ranges": 2, "block_bytes": 20_000}, {}):
        assert got(dedup_substrings(d, **more)) == want


def test_odd(spark):
    from strandlake.llm.suffix_dedup import dedup_substrings

    d = frame(spark, ODD + ["ab" * 100, "ab" * 90, "x" * 49, "x" * 50, "y" * 400, "y" * 60])
    rows = [(r.doc_id, r.text) for r in d.collect()]
    assert got(dedup_substrings(d)) == brute(rows)
    assert dedup_substrings(d.limit(0)).count() == 0


def test_cells_do_not_depend_on_slices():
    from strandlake.llm.suffix_dedup import Cells

    rng = np.random.default_rng(0)
    for t in range(60):
        sizes = rng.integers(0, 400, rng.integers(0, 12)) * (rng.random() < 0.9)
        off = np.concatenate(([0], np.cumsum(sizes))).astype(np.int64)
        raw = rng.integers(97, 99 + 20 * (t % 2), off[-1]).astype(np.uint8)
        docs = np.arange(len(sizes))
        whole = Cells(raw, off, docs, 50)
        for size in (110, 137, 300):
            cut = Cells(raw, off, docs, 50, size)
            assert all(np.array_equal(getattr(whole, k), getattr(cut, k)) for k in ("anchor", "place", "a", "b", "row", "content", "doc"))


def test_messages_grow_with_the_blocks():
    import pyarrow as pa

    from strandlake.llm.suffix_dedup import _send_anchors

    rng, sent = random.Random(5), []
    for k in range(2_000):
        text = "".join(rng.choices("abcdefgh", k=3_000))
        got = _send_anchors(16, 50)(pa.table({"doc_id": [k], "text": [text], "block": [k]}))
        sent.append(got.num_rows)
    assert max(sent) <= 16 and sum(sent) <= 16 * 2_000


def test_a_text_in_many_slices(spark):
    from strandlake.llm.suffix_dedup import dedup_substrings

    rng = random.Random(6)
    long = "".join(rng.choices("abcdefghij ", k=5 << 20))
    edge = (1 << 20) - 40  # the copies cross the borders of slices
    rows = [(1, long), (2, "<" + long[edge : edge + 90] + ">"), (3, "<" + long[:60] + "|" + long[-49:]), (4, "x" * edge + long[3 * edge : 3 * edge + 200])]
    out = {r.doc_id: (r.n_removed, [(s.start, s.end) for s in r.spans]) for r in dedup_substrings(spark.createDataFrame(rows, "doc_id long, text string"), block_bytes=1 << 21).collect()}
    assert out == {1: (0, []), 2: (90, [(1, 91)]), 3: (60, [(1, 61)]), 4: (200, [(edge, edge + 200)])}
