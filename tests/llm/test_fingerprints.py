"""SimHash fingerprints and block tables against plain versions."""

import hashlib
import random
import re
import struct

import xxhash

from strandlake.llm import fingerprints as fp

from .brute import ODD, frame, sha


def long_hash(x, seed=42):
    return xxhash.xxh64_intdigest(struct.pack("<Q", x), seed)


def brute_print(text):
    words = [xxhash.xxh64_intdigest(hashlib.md5(w.encode()).hexdigest().encode(), 42) for w in re.split(r"[\x20\x09-\x0D]", text.lower()) if w]
    votes, n = [0] * 128, max(len(words) - 4, 1)
    for p in range(n):
        h = 42
        for k in range(5):
            h = long_hash(words[p + k] if p + k < len(words) else 0, h)
        g = long_hash(h)
        for b in range(64):
            votes[b] += h >> b & 1
            votes[64 + b] += g >> b & 1
    hi, lo = (sum(1 << b for b in range(64) if 2 * votes[base + b] > n) for base in (0, 64))
    return f"{hi:016x}{lo:016x}"


def brute(rows):
    rows = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), hashlib.md5((r[1] or "").encode()).hexdigest()))
    texts = [t or "" for _, t in rows]
    prints = [brute_print(t) for t in texts]
    alike = lambda a, b: 1 - (int(a, 16) ^ int(b, 16)).bit_count() / 128
    out = []
    for i, (d, _) in enumerate(rows):
        t, j = texts[i], (i + 1) % len(rows)
        h = len(t) // 2
        edited = t[: len(t) - h] + texts[j][:h]
        near = sum(0 < (int(prints[i], 16) ^ int(x, 16)).bit_count() <= fp.RADIUS for x in set(prints))
        out.append((d, len(t), sha(edited.encode()), prints[i], brute_print(edited), alike(prints[i], brute_print(edited)), alike(prints[i], prints[j]), prints.count(prints[i]), near))
    return sorted(out, key=repr)


def run(df):
    return sorted(map(tuple, fp.fingerprint_documents(df).collect()), key=repr)


def test_odd_texts_equal_plain_version(spark):
    rng = random.Random(5)
    base = [rng.choice(["stone", "Fluß", "río", "water", "the", "日本"]) + str(rng.randrange(40)) for _ in range(400)]
    texts = [*ODD, " ".join(base), " ".join([*base[:399], "changed"]), "  ".join(base) + "\n", *[" ".join(rng.choices(base, k=rng.randrange(1, 60))) for _ in range(150)]]
    df = frame(spark, texts)
    assert run(df.repartition(5)) == brute([(r.doc_id, r.text) for r in df.collect()])


def test_one_row_and_none(spark):
    assert run(frame(spark, ["only one text"]).limit(1)) == brute([(0, "only one text")])
    assert run(frame(spark, ["x"]).limit(0)) == []


def test_slices_of_a_long_text(spark):
    words = [f"w{i % 977}" for i in range(2 * fp.SLICE + 50)]
    df = spark.createDataFrame([(1, " ".join(words)), (2, "next")], "doc_id long, text string")
    got = {r.doc_id: r for r in fp.fingerprint_documents(df).collect()}
    assert got[1].fingerprint == brute_print(" ".join(words))


def test_block_tables_find_every_pair_once(spark):
    """Groups of near fingerprints, one larger than a bucket's arrays, at several radii."""
    rng = random.Random(9)
    flip = lambda x, n: x ^ sum(1 << b for b in rng.sample(range(128), n))
    seeds = [rng.getrandbits(128) for _ in range(40)]
    prints = {flip(s, rng.randrange(9)) for s in seeds for _ in range(8)} | {flip(seeds[0], rng.randrange(5)) for _ in range(700)} | {0, (1 << 128) - 1, 1, 3}
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    df = spark.createDataFrame([(signed(x >> 64), signed(x & (1 << 64) - 1)) for x in prints], "hi long, lo long")
    for radius in (0, 3, 6):
        got = {((r.hi % (1 << 64)) << 64) + r.lo % (1 << 64): r.n_near for r in fp.near_counts(df, radius).collect()}
        assert got == {x: sum(0 < (x ^ y).bit_count() <= radius for y in prints) for x in prints}


def test_copies_and_near_copies(spark):
    rng = random.Random(2)
    base = [f"w{rng.randrange(3000)}" for _ in range(2000)]
    other = [f"v{rng.randrange(3000)}" for _ in range(2000)]
    rows = [(1, " ".join(base)), (2, " ".join(base).upper()), (3, " ".join(base[:1995])), (4, " ".join(other)), (5, "y")]
    got = {r.doc_id: r for r in fp.fingerprint_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1].fingerprint == got[2].fingerprint and got[1].n_same == 2
    assert got[1].n_near + (got[3].fingerprint == got[1].fingerprint) == 1 and got[4].n_near == 0
    assert all(0.55 < got[d].near_edited < 0.8 for d in (2, 3, 4))


def test_no_side_of_a_join_is_broadcast(spark, monkeypatch):
    """Rows of all block tables are 28 times the fingerprints that Spark sizes them by; whole tables must not come to the driver."""
    plans, real = [], fp.stage_alone
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(fp, "stage_alone", lambda df: plans.append(plan(df)) or real(df))
    out = fp.fingerprint_documents(frame(spark, ["some words of a text", "other words of a text", "one more"]))
    plans.append(plan(out))
    assert len(plans) == 4 and sum(p.count("SortMergeJoin") for p in plans) >= 8
    assert not any("Broadcast" in p for p in plans)
