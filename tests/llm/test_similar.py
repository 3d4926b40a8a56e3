import random
import re
from collections import Counter

import numpy as np
import pytest

from .brute import ODD, SF, frame, sha


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").lower())
    return frozenset(" ".join(w[i : i + 5]) for i in range(max(len(w) - 4, 1))) if w else frozenset()


def classes(rows):
    """(class, links) of every row by brute force."""
    sets = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    links = [0] * len(rows)
    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 5 * len(a & b) >= 4 * len(a | b):
                links[i] += 1
                links[j] += 1
                parent[root(i)] = root(j)
    low = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            low[root(i)] = min(low.get(root(i), d), d)
    return [(low.get(root(i)), links[i]) for i in range(len(rows))]


def near_copies(seed, n, words=200, edits=2):
    rng = random.Random(seed)
    base = [f"w{rng.randrange(10**6)}" for _ in range(words)]
    out = []
    for _ in range(n):
        w = list(base)
        for _ in range(edits):
            w[rng.randrange(words)] = f"v{rng.randrange(10**9)}"
        out.append(" ".join(w))
    return out


def test_jaccard(spark, docs, monkeypatch):
    from strandlake.llm import ngram_jaccard

    monkeypatch.setattr(ngram_jaccard, "BLOCK", 16)  # buckets of near copies are dealt as pairs of blocks
    extra = near_copies(1, 60) + near_copies(2, 40, 150, 3) + near_copies(3, 30, 100, 1) + ["a b c", "a b c", "A B C"]
    texts = [r.text for r in docs.collect()] + extra + extra[:5]
    rows = list(enumerate(texts))
    got = ngram_jaccard.jaccard_join(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    want = classes(rows)
    assert {r.doc_id: (r.class_id, r.n_links) for r in got} == dict(enumerate(want))


def test_jaccard_tells_rows_of_one_id_apart(spark):
    from strandlake.llm.ngram_jaccard import jaccard_join, keep_one_of_each

    a, b = near_copies(7, 1, 300, 0)[0], near_copies(8, 1, 300, 0)[0]
    rows = [(5, a, "x"), (5, b, "x"), (6, f"{b} more", "x"), (7, f"{a} more", "x"), (3, f"more {b}", "y"), (None, a, "n"), (None, a, "n"), (None, "q r s", "n"), (9, None, "z"), (9, "", "z")]
    d = spark.createDataFrame(rows, "doc_id long, text string, vid string")
    got = Counter(tuple(r) for r in jaccard_join(d).collect())
    lone = [r for r in got if r[0] is None and r[2] == 0]
    assert len(lone) == 1
    assert got == Counter({(5, 5, 3): 1, (5, 3, 2): 1, (6, 3, 2): 1, (7, 5, 3): 1, (3, 3, 2): 1, (None, 5, 3): 2, lone[0]: 1, (9, 9, 0): 2})
    kept = Counter(tuple(r) for r in keep_one_of_each(d).collect())
    assert kept == Counter([(5, a, "x"), (3, f"more {b}", "y"), (None, "q r s", "n"), (9, None, "z"), (9, "", "z")])
    again = spark.createDataFrame(rows[:1] * 4 + rows[5:7] + rows[7:8] * 3, d.schema)
    assert sorted(map(str, keep_one_of_each(again).collect())) == sorted(map(str, [again.first(), again.filter("text = 'q r s'").first()]))
    assert keep_one_of_each(d.limit(0)).columns == d.columns and keep_one_of_each(d.limit(0)).count() == 0


def test_jaccard_large_group(spark):
    from strandlake.llm.ngram_jaccard import jaccard_join

    texts = near_copies(11, 3000, 120, 1)
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = jaccard_join(d).collect()
    grams = [np.array(sorted(map(hash, shingles(t)))) for t in texts]
    every, inv = np.unique(np.concatenate(grams), return_inverse=True)
    matrix = np.zeros((len(texts), len(every)), np.float32)
    matrix[np.repeat(np.arange(len(texts)), [len(g) for g in grams]), inv] = 1
    matrix = matrix[:, matrix.sum(0) > 1]  # what one text has alone is in no intersection
    both, size = matrix @ matrix.T, np.array([len(g) for g in grams])
    linked = 5 * both >= 4 * (size[:, None] + size - both)
    assert {r.doc_id: r.n_links for r in got} == dict(enumerate((linked.sum(1) - 1).tolist()))
    assert {r.class_id for r in got} == {0}


def test_jaccard_recall_at_the_threshold():
    from strandlake.llm.ngram_jaccard import band_keys, least_matches, shingle_sets, signatures

    import pyarrow as pa

    rng = random.Random(9)
    pairs = []
    for _ in range(400):
        w = [f"w{rng.randrange(10**6)}" for _ in range(49)]  # 45 shingles
        v = list(w)
        v[-5:] = [f"v{rng.randrange(10**6)}" for _ in range(5)]  # 40 / 50
        pairs += [" ".join(w), " ".join(v)]
    sets, off = shingle_sets(pa.array(pairs))
    sig = signatures(sets, off)
    keys = band_keys(sig)
    shared = (keys[::2] == keys[1::2]).any(1)
    match = np.cumsum(sig[::2] == sig[1::2], 1)
    assert shared.mean() > 0.995 and all((match[:, n - 1] >= need).mean() > 0.999 for n, need in least_matches().items())


def test_jaccard_odd(spark):
    from strandlake.llm.ngram_jaccard import jaccard_join

    d = frame(spark, ODD)
    rows = [(r.doc_id, r.text) for r in d.collect()]
    got = jaccard_join(d).collect()
    assert Counter((r.doc_id, r.n_links) for r in got) == Counter((d, n) for (d, _), (_, n) in zip(rows, classes(rows), strict=True))
    assert jaccard_join(d.limit(0)).count() == 0


def test_connected(spark):
    from strandlake.llm.ngram_jaccard import connected

    chain = [(i, i + 1) for i in range(100)] + [(200, 300), (300, 250), (7, 7)]
    got = {r.v: r.root for r in connected(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(1, 101)} | {250: 200, 300: 200}


def test_decontamination(spark, docs):
    from strandlake.llm.decontaminate import decontaminate, find_contamination

    items = spark.read.parquet(f"{SF}/benchmark.parquet")
    texts = {r.item_id: r.text for r in items.collect()}
    some = sorted(texts)[:6]
    rng = random.Random(5)
    extra = [f"prose before {texts[i].upper()} and after, {texts[some[0]]}" for i in some]
    for i in some:
        w = texts[i].split()
        w[-1] = "changed"
        extra.append(" ".join(w))
        w[len(w) // 2] = f"x{rng.random()}"
        extra.append("a " * 30 + " ".join(w) + " b" * 30)
    all_texts = [r.text for r in docs.collect()] + extra + ODD
    d = spark.createDataFrame(list(enumerate(all_texts)), "doc_id long, text string")
    more = spark.createDataFrame([(-1, None), (-2, ""), (-3, "zq yx"), (-4, "onlyword")], "item_id long, text string")
    d = d.union(spark.createDataFrame([(10**6, "we zq yx here"), (10**6 + 1, "yx")], "doc_id long, text string"))
    items = items.select("item_id", "text").union(more)
    got = {(r.doc_id, r.item_id): (round(r.similarity, 9), r.first_word) for r in find_contamination(d, items).collect()}
    want = brute_contamination([(r.doc_id, r.text) for r in d.collect()], [(r.item_id, r.text) for r in items.collect()])
    assert got == want
    hit = {a for a, _ in want}
    assert sorted(r.doc_id for r in decontaminate(d, items).collect()) == sorted(r.doc_id for r in d.collect() if r.doc_id not in hit)
    assert find_contamination(d.limit(0), items).count() == 0
    assert find_contamination(d, items.limit(0)).count() == 0


def brute_contamination(rows, items):
    from unicodedata import category

    word = lambda t: "".join(c if category(c)[0] in "LNM" else " " for c in (t or "").lower()).split()
    out = {}
    parsed = [(i, word(t)) for i, t in items]
    for doc, t in rows:
        w = word(t)
        whole = {tuple(w[s : s + 5]) for s in range(len(w) - 4)}
        for item, iw in parsed:
            if not iw:
                continue
            size = min(5, len(iw))
            grams = Counter(tuple(iw[s : s + size]) for s in range(len(iw) - size + 1))
            if size == 5 and not whole & set(grams):
                continue
            best = (0, 0)
            for s in range(max(len(w) - len(iw), 0) + 1):
                own = Counter(tuple(w[k : k + size]) for k in range(s, min(s + len(iw), len(w)) - size + 1))
                both = sum((own & grams).values())
                union = sum((own | grams).values())
                if union and both / union >= 0.8 and both / union > best[0]:
                    best = (both / union, s)
            if best[0]:
                out[doc, item] = (round(best[0], 9), best[1])
    return out


def test_block_index_finds_all_within_the_radius():
    from strandlake.llm.decontaminate import BITS, RADIUS, BlockIndex

    rng = np.random.default_rng(4)
    items = rng.random((300, BITS)) < 0.5
    queries = np.concatenate((items[rng.integers(0, 300, 2000)], rng.random((3000, BITS)) < 0.5))
    for i in range(2000):  # up to the radius, also with the bits spread over the blocks as evenly as can be
        n = RADIUS - i % 5
        at = rng.permutation(BITS)[:n] if i % 2 else np.unique(np.arange(n) * BITS // n)
        queries[i, at] ^= True
    q, k = BlockIndex(items).candidates(queries, 300)
    got = set(zip(q.tolist(), k.tolist(), strict=True))
    distance = (BITS - (2 * queries.astype(int) - 1) @ (2 * items.astype(int) - 1).T) // 2
    want = set(zip(*(x.tolist() for x in np.nonzero(distance <= RADIUS)), strict=True))
    assert len(want) >= 2000 and want <= got
    assert len([1 for a, _ in got if a >= 2000]) < 0.01 * 3000 * 300  # unrelated fingerprints


def test_decontamination_recall_near_the_threshold():
    from strandlake.llm.decontaminate import ItemIndex, recall_at

    assert recall_at(0.8) > 0.93 and recall_at(0.85) > 0.99
    import pyarrow as pa

    rng = random.Random(6)
    items = [" ".join(f"w{rng.randrange(10**6)}" for _ in range(54)) for _ in range(400)]  # 50 shingles
    index = ItemIndex(list(range(400)), items, 0.8, 47)
    docs = []
    for t in items:
        w = t.split()
        w[20] = "zz"  # five shingles differ: 45 / 55
        docs.append(" ".join(w))
    got = {(r, i) for r, i, *_ in index.search(pa.array(docs))}
    assert got <= {(i, i) for i in range(400)} and len(got) >= 0.95 * 400


def test_decontamination_of_an_item_of_20_000_words():
    import tracemalloc

    import pyarrow as pa

    from strandlake.llm.decontaminate import ItemIndex

    rng = random.Random(2)
    words = lambda n: [f"w{rng.randrange(5_000)}" for _ in range(n)]
    item, before, after = words(20_000), words(7_000), words(7_000)
    copy = [*item[:9_000], "other", *item[9_001:]]
    index = ItemIndex([7], [" ".join(item)], 0.8, 47)
    tracemalloc.start()
    got = index.search(pa.array([" ".join(before + copy + after), " ".join(before), None]))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    # One word differs: it is in 5 of the 19,996 shingles of either.
    assert got == [(0, 7, 19_991 / (2 * 19_996 - 19_991), 7_000, 20_000)]
    assert peak < 500 << 20


def test_decontamination_counts_repeated_shingles():
    """Similarities of all windows of texts with few different words equal those of plain multisets."""
    from collections import Counter

    import numpy as np
    import pyarrow as pa

    from strandlake.llm.decontaminate import ItemIndex, shingles_at, words_of

    rng = random.Random(3)
    for n in (5, 12, 40):
        item, text = (" ".join(rng.choices("abc" if n > 5 else "ab", k=m)) for m in (n, 300))
        index = ItemIndex([1], [item], 0.8, 47)
        g = index.groups[n]
        grams = shingles_at(words_of(pa.array([text]))[0], 5)
        starts = np.arange(300 - n + 1)
        got = index._similarity(g, grams, starts, np.full(len(starts), n - 4), np.zeros(len(starts), np.int64))
        cut = lambda w: Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
        own = cut(item.split())
        for s, sim in zip(starts.tolist(), got.tolist(), strict=True):
            there = cut(text.split()[s : s + n])
            assert sim == (own & there).total() / (own | there).total()


def test_decontamination_words_end_at_unicode_marks():
    import pyarrow as pa

    from strandlake.llm.decontaminate import ItemIndex

    item = "the quick brown fox jumps over the lazy dog near caf\u00e9 walls"
    index = ItemIndex([7], [item], 0.8, 47)
    docs = [f"\u201c{item}\u201d \u2014 so", "before\u2014" + item.replace(" ", "\u2014") + "\u2026after", "\U0001f642" + item, "none of it", None, ""]
    assert [(r, i, s) for r, i, s, *_ in index.search(pa.array(docs))] == [(0, 7, 1.0), (1, 7, 1.0), (2, 7, 1.0)]


def brute_lines(rows):
    occ = []
    for doc, t in rows:
        for i, line in enumerate((t or "").split("\n")):
            if line.strip(" \t\n\x0b\x0c\r"):
                occ.append((doc if doc is not None else 2**63, i, line))
    first = {}
    for o in sorted(occ):
        first.setdefault(o[2], o[:2])

    def within(a, b):
        if a == b:
            return True
        if len(a) > len(b):
            a, b = b, a
        if len(b) - len(a) > 1:
            return False
        i = 0
        while i < len(a) and a[i] == b[i]:
            i += 1
        return a[i:] == b[i + 1 :] if len(a) < len(b) else a[i + 1 :] == b[i + 1 :]

    by_n = {}
    for line in first:
        by_n.setdefault(len(line), []).append(line)
    near = set()
    for line in first:
        for n in (len(line) - 1, len(line), len(line) + 1):
            if any(first[x] < first[line] and within(x, line) for x in by_n.get(n, ())):
                near.add(line)
    out = []
    for doc, t in rows:
        d, kept, seen = doc if doc is not None else 2**63, [], set()
        for i, line in enumerate((t or "").split("\n")):
            blank = not line.strip(" \t\n\x0b\x0c\r")
            if blank or (line not in near and line not in seen and first[line][0] == d):
                kept.append(line)
            seen.add(line)
        out.append((doc, sha("\n".join(kept).encode())))
    return Counter(out)


def test_lines(spark, docs):
    from strandlake.llm.line_dedup import dedup_lines

    rng = random.Random(3)
    base = [" ".join(f"w{rng.randrange(1000)}" for _ in range(rng.choice((4, 8, 30)))) for _ in range(30)]
    texts = []
    for _ in range(60):
        lines = []
        for _ in range(5):
            x = rng.choice(base)
            k = rng.randrange(len(x))
            lines.append(rng.choice([x, x[:k] + x[k + 1 :], x[:k] + "é" + x[k:], x[:k] + "Z" + x[k + 1 :], x[:k] + x[k + 2 :], x[-1] + x, x + x[-1]]))
        texts.append("\n".join(lines))
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    rows += [(1000 + i, t) for i, t in enumerate(texts)] + [(2000, None), (2001, ""), (2002, "\n\n"), (None, texts[0]), (2003, "short\nshort\nshorn\nquite short\nquite shorn\nseven s\nseven t")]
    got = dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert Counter((r.doc_id, sha((r.text or "").encode())) for r in got) == brute_lines(rows)
    assert any(r.n_near for r in got)


def test_short_lines(spark):
    from strandlake.llm.line_dedup import dedup_lines

    rng = random.Random(12)
    rows = [(1, "Sign up\nwarning\n}"), (2, "Sign up!\nwarnings\nab"), (3, "{\n \nabc\nb"), (4, "é\nabcd"), (5, None), (6, "")]
    rows += [(10 + i, "\n".join("".join(rng.choice("abé ") for _ in range(rng.randint(0, 6))) for _ in range(5))) for i in range(40)]
    got = dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert Counter((r.doc_id, sha((r.text or "").encode())) for r in got) == brute_lines(rows)
    assert {r.doc_id: r.text for r in got}[2] == "ab"


def test_lines_that_most_documents_share(spark):
    from pyspark.sql import functions as F

    from strandlake.llm.line_dedup import _places

    rows = [(h, h, d) for h in range(30) for d in range(200 if h in (4, 9) else 1 + h % 5)]
    occ = spark.createDataFrame(rows, "h1 long, h2 int, doc_id long")
    several = occ.groupBy("h1", "h2").agg(F.min("doc_id").alias("d0"), F.count(F.lit(1)).alias("n_docs")).filter("n_docs > 1")
    want = Counter((h, d) for h, _, d in rows if h in (4, 9) or h % 5)
    for limit in (100, 24, 10, 3):
        split = _places(occ, several, limit)
        assert Counter((r.h1, r.doc_id) for r in split.collect()) == want
    assert "BroadcastHashJoin" in split._jdf.queryExecution().toString()


def test_lines_odd(spark):
    from strandlake.llm.line_dedup import dedup_lines

    d = frame(spark, ODD)
    got = dedup_lines(d)
    assert got.columns == [*d.columns, "n_lines", "n_removed", "n_near"] and got.count() == d.count()
    assert dedup_lines(d.limit(0)).count() == 0
    clash = dedup_lines(spark.createDataFrame([(1, "a line of text\na line of text", 99), (2, "a line of texts", 99)], "doc_id long, text string, n_lines long"))
    assert sorted(map(tuple, clash.collect())) == [(1, "a line of text", 2, 1, 0), (2, "", 1, 1, 1)]


def test_language(spark, docs):
    from strandlake.llm.language_id import identify

    noise = [(10**6 + 9, "zxqj kvvw qqqz xjxj wqkz " * 40, "en"), (10**6 + 5, "12345 !!!", "en"), (10**6 + 6, None, "en")]
    d = docs.select("doc_id", "text", "lang").union(spark.createDataFrame(noise, "doc_id long, text string, lang string"))
    rows = {r.doc_id: r for r in identify(d).collect()}
    truth = {r.doc_id: r.lang for r in docs.collect()}
    import zlib

    held = [i for i in truth if zlib.crc32(str(i).encode()) % 5 == 0]
    assert all(rows[i].held_out == (i in set(held)) for i in truth)
    assert np.mean([rows[i].lang_pred == truth[i] for i in held]) > 0.95
    assert rows[10**6 + 5].lang_pred == "und" and rows[10**6 + 6].lang_pred == "und" and rows[10**6 + 9].rejected
    assert sum(rows[i].rejected for i in truth) <= 2
    assert all(0 <= r.score <= 1 for r in rows.values())


def test_language_odd(spark):
    from strandlake.llm.language_id import identify

    d = frame(spark, ODD)
    assert identify(d).count() == d.count()
    assert identify(d.limit(0)).count() == 0


def plain_kneser_ney(texts, order=4):
    """P(symbol | order-1 symbols before it) by the textbook recursion over dictionaries."""
    top = Counter()
    for t in texts:
        x = " " * (order - 1) + " ".join(re.findall("[a-z]+", t)) + " "
        top.update(x[i - order + 1 : i + 1] for i in range(order - 1, len(x)))
    tables = {order: top}
    for k in range(order - 1, 0, -1):
        tables[k] = Counter(g[1:] for g in tables[k + 1])
    d = {}
    for k, t in tables.items():
        ones, twos = sum(n == 1 for n in t.values()), sum(n == 2 for n in t.values())
        d[k] = min(max(ones / max(ones + 2 * twos, 1), 0.1), 0.95)

    def p(context, c):
        k = len(context) + 1
        t = tables[k]
        own = [n for g, n in t.items() if g[:-1] == context]
        if k == 1:
            return max(t[c] - d[1], 0) / sum(own) + d[1] * len(own) / sum(own) / (len(own) + 1)
        if not own:
            return p(context[1:], c)
        return max(t[context + c] - d[k], 0) / sum(own) + d[k] * len(own) / sum(own) * p(context[1:], c)

    return p


def test_kneser_ney_equals_the_plain_recursion():
    from strandlake.llm.language_id import LanguageModels, _places, ngram_keys, symbols

    texts = ["the cat sat on the mat and the hat", "abba babab abab", "that cat"] * 2 + ["a tabby"]
    sym, off, _ = symbols(texts)
    keys, n = np.unique(ngram_keys(sym)[_places(off)], return_counts=True)
    m = LanguageModels(np.array(["x"] * len(keys), object), keys, n)
    p = plain_kneser_ney(texts)
    alphabet = sorted({chr(k & 0xFFFF) for k in keys.tolist()} | {"z"})  # z stands for all symbols never seen
    key = lambda s: sum(ord(c) << 16 * i for i, c in enumerate(reversed(s)))
    for context in ("   ", "the", " ca", "bab", "zzt", "zza", "zzz", "qat"):
        got = np.exp(m.log_p(np.array([key(context + c) for c in alphabet], np.uint64))[:, 0].astype(float))
        assert np.allclose(got, [p(context, c) for c in alphabet], rtol=1e-5)
        assert abs(got.sum() - 1) < 1e-5


def test_language_rejection_is_calibrated(spark):
    from strandlake.llm.language_id import identify

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    langs = sorted(r.lang for r in docs.select("lang").filter("lang is not null").distinct().collect())
    foreign = langs[-1]
    from pyspark.sql import functions as F

    d = docs.withColumn("lang", F.when(F.col("lang") != foreign, F.col("lang")))
    truth = {r.doc_id: r.lang for r in docs.collect()}
    rows = identify(d).collect()
    known = [r.rejected for r in rows if r.held_out and truth[r.doc_id] in langs[:-1] and r.lang_pred != "und"]
    strange = [r.rejected for r in rows if truth[r.doc_id] == foreign]
    print(foreign, np.mean(known), np.mean(strange), len(strange))
    assert np.mean(known) < 0.01 and np.mean(strange) > 0.9


def test_language_models_in_shards_keep_all_types(spark, monkeypatch):
    from strandlake.llm import language_id as li

    docs = spark.read.parquet(f"{SF}/documents.parquet").filter("doc_id % 4 = 0").select("doc_id", "text", "lang")
    rare = spark.createDataFrame([(10**6 + i, f"żółć gęślą jaźń wąż {'ąęćłńśźż'[i]}", "rare") for i in range(8)] + [(2 * 10**6, None, "rare")], docs.schema)
    d = docs.union(rare).union(rare).cache()
    want = {r.doc_id: r for r in li.identify(d).collect()}
    keep = sorted(r.doc_id for r in li.keep_identified(d).collect())
    monkeypatch.setattr(li, "MAX_TYPES", 5000)
    assert li.train(d).n > 1
    got = li.identify(d).collect()
    assert len(got) == d.count() and any(r.lang_pred == "rare" for r in got)
    for r in got:
        w = want[r.doc_id]
        assert (r.held_out, r.lang_pred, r.rejected) == (w.held_out, w.lang_pred, w.rejected)
        assert abs(r.entropy - w.entropy) < 1e-6 and abs(r.score - w.score) < 1e-6
    assert sorted(r.doc_id for r in li.keep_identified(d).collect()) == keep


def test_language_limits_hold_in_buckets_without_training_texts(spark):
    from strandlake.llm.language_id import identify, keep_identified

    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang")
    rng = random.Random(3)
    strange = "".join(rng.choice("жщюыэъ") + rng.choice(" жщюыэъ") for _ in range(150_000))
    d = docs.union(spark.createDataFrame([(10**6, strange, None)], docs.schema))
    assert [r.rejected for r in identify(d).filter("doc_id = 1000000").collect()] == [True]
    assert keep_identified(d).filter("doc_id = 1000000").count() == 0
