"""Phrase mining against plain counting, with small sections, containers and tries."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from strandlake.llm import collocations as q

LOWER = {c: c + 32 for c in range(65, 91)}


def brute(docs, least, top=2000):
    f, n = Counter(), Counter()
    for lang, text in docs:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", (text or "").translate(LOWER)):
            w = [x for x in re.split("[ \t]", piece) if x]
            n[lang] += len(w)
            f.update((lang, *w[i : i + k]) for k in range(1, 5) for i in range(len(w) - k + 1))
    good = {g: c for g, c in f.items() if c >= least}
    rows = []
    for (lang, *w), a in good.items():
        if len(w) < 2:
            continue
        inside = any(g[0] == lang and len(g) - 1 > len(w) and 100 * c >= 80 * a and any(list(g[i : i + len(w)]) == w for i in range(1, len(g) - len(w) + 1)) for g, c in good.items())
        if not inside:
            score, _, l, r = min((2_000_000 * a // (f[(lang, *w[:k])] + f[(lang, *w[k:])]), k, f[(lang, *w[:k])], f[(lang, *w[k:])]) for k in range(1, len(w)))
            rows.append((lang, " ".join(w), a, l, r, n[lang], score))
    out = []
    for lang in n:
        own = sorted((x for x in rows if x[0] == lang), key=lambda x: (-x[6], -x[2], x[1].encode()))[:top]
        out += [(lang, i + 1, *x[1:]) for i, x in enumerate(own)]
    return sorted(out)


def corpus(seed=3, n=400):
    rng = random.Random(seed)
    fixed = ["New York City", "the fox, the dog", "a b c d e", "École de Paris", "x\ty\t z"]
    out = []
    for i in range(n):
        words = [rng.choice("the of and river stone Bridge water é 日本 q".split()) if rng.random() < 0.6 else f"w{int(rng.paretovariate(0.7))}" for _ in range(rng.randrange(30))]
        words.insert(rng.randrange(len(words) + 1), rng.choice(fixed))
        out.append((rng.choice(["en", "de", None, "und"]), rng.choice([" ", "  ", ". ", "\n", " ; "]).join(words)))
    return [*out, ("en", None), (None, ""), ("xx", "... !"), ("en", "\x00 \x00"), ("en", "hot pair " * 300), ("en", " ".join(f"hot pair u{i} hot pair v{i}" for i in range(200)))]


def run(spark, docs, **more):
    df = spark.createDataFrame([(*d, 1, "k", 2) for d in docs], "lang string, text string, n int, k1 string, section int")
    return sorted(map(tuple, q.collocations(df, **more).collect()))


def test_equals_plain_counting(spark, monkeypatch):
    docs = corpus()
    assert run(spark, docs, least=5) == brute(docs, 5)
    assert run(spark, docs, least=3, top=7) == brute(docs, 3, 7)


def test_small_sections_and_hot_words(spark):
    """Parts built by hand, so that sections, spills and hot prefixes are small."""
    docs = corpus(8, 150)
    old = q.SECTION, q.BURST, q.ENTRIES
    try:
        q.SECTION = 7
        text = "one two three. four five six seven eight nine ten; one two " * 3
        got = Counter()
        for words, counts, blob in q._encode(text.encode()):
            names = words.to_pylist()
            ids = np.frombuffer(blob, np.uint32)
            assert len(ids) <= 10 and counts.sum() == ((ids & 2) == 0).sum()
            known = np.arange(1, len(names) + 1)
            for w in zip(*q._windows(ids.astype(np.int64), known), strict=True):
                got[tuple(names[i - 1].decode() for i in w if i)] += 1
        want = Counter()
        for piece in re.split("[.;]", text):
            w = piece.split()
            want.update(tuple(w[i : i + 4]) for i in range(len(w) - 1))
        assert got == want
    finally:
        q.SECTION, q.BURST, q.ENTRIES = old
    assert run(spark, docs, least=4) == brute(docs, 4)


@pytest.mark.parametrize(("burst", "entries"), [(2, 20), (5, 1000), (4096, 50), (3, 10**6)])
def test_trie_counts_bursts_and_spills(burst, entries):
    rng, bits = np.random.default_rng(burst), 7
    trie, got, want, runs = q.HatTrie(bits, burst, entries), Counter(), Counter(), []
    for _ in range(20):
        firsts = rng.zipf(1.5, 200) % 50 + 1
        ids = rng.zipf(1.3, (3, 200)) % 100
        keys = (ids[0] << 14) | (ids[1] << 7) | ids[2]
        want.update(zip(firsts.tolist(), keys.tolist(), strict=True))
        runs += trie.add(firsts, keys)
        assert trie.total <= entries + 200
    if burst < 10:
        assert any(isinstance(n, dict) for n in trie.root.values())
    assert entries > 1000 or runs
    for f, k, c in [*runs, trie.drain()]:
        pairs = list(zip(f.tolist(), k.tolist(), strict=True))
        assert pairs == sorted(pairs)
        for pair, n in zip(pairs, c.tolist(), strict=True):
            got[pair] += n
    assert got == want and trie.total == 0 and not trie.root


def test_merge_sums_over_batches_and_leaves_hot_prefixes():
    import pyarrow as pa

    rng = np.random.default_rng(2)
    rows = sorted((int(a) << 32 | int(b), int(c) << 32 | (int(d) if c else 0), int(n)) for a, b, c, d, n in rng.integers([1, 1, 0, 0, 1], 5, (500, 5)))
    batches = [pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*rows[i : i + 9], strict=True)], names=["k1", "k2", "c"]) for i in range(0, len(rows), 9)]
    for hot, least in ((0, 1), (2, 60)):
        got = Counter()
        for b in q._merger(hot, least)(iter(batches)):
            for r in b.to_pylist():
                assert (r["k1"], r["k2"]) not in got
                got[r["k1"], r["k2"]] = r["c"]
        want, low = Counter(), (1 << 32) - 1
        for a, b, n in rows:
            for key in {(a, 0), (a, b >> 32 << 32), (a, b)}:
                want[key] += n
        is_hot = lambda x: 0 < x <= hot
        keep = lambda a, b, n: n >= least or (is_hot(a >> 32) and is_hot(a & low) and (b == 0 or (b & low == 0 and is_hot(b >> 32))))
        assert got == {k: n for k, n in want.items() if keep(*k, n)}


def test_nothing_frequent_and_empty(spark):
    assert run(spark, [("en", "a b c"), (None, None)]) == []
    df = spark.createDataFrame([], "lang string, text string")
    assert q.collocations(df).collect() == [] and q.collocations(df).columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]


def test_a_long_text_without_marks(spark):
    docs = [("en", "alpha beta gamma delta " * 60_000)]
    assert run(spark, docs) == brute(docs, 30)
