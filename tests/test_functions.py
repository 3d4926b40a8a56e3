import random

import pytest
import xxhash
from pyspark.sql import functions as F

from strandlake.functions import alphabet as al
from strandlake.functions import kmers as km
from strandlake.functions.distance import edit, hamming


def one(spark, expr, **values):
    row = spark.createDataFrame([tuple(values.values())], list(values)) if values else spark.range(1)
    return row.select(expr.alias("x")).first().x


@pytest.mark.parametrize(("expr", "value", "want"), [
    (al.reverse_complement, "AACGN", "NCGTT"),
    (lambda s: al.collapse(s, "dr_dna5"), "ACGTN", "WSSWN"),
    (lambda s: al.collapse(s, "dr_dna5"), "acgun", "WSSWN"),
    (lambda s: al.replace_unknown(s, "dna5"), "ACXGR", "ACNGN"),
    (lambda s: al.first_invalid(s, "dna5"), "ACXG", 2),
    (lambda s: al.first_invalid(s, "dna5"), "acgun", -1),
    (lambda s: al.is_valid(s, "dna4"), "ACGN", False),
    (lambda s: al.is_valid(s, "dna4"), "", True),
    (lambda s: al.ranks(s, "dna5"), "AcGuNx", [1, 2, 3, 4, 5, 255]),
    (lambda s: al.window(s, F.lit(1), F.lit(2)), "ACGT", "CG"),
])
def test_goldens(spark, expr, value, want):
    assert one(spark, expr(F.col("s")), s=value) == want


def test_unknown_draws_are_stable_and_valid(spark):
    df = spark.createDataFrame([(i, "ACXXYYG" + "Z" * i) for i in range(20)], "seq_id long, seq string")
    e = al.replace_unknown(F.col("seq"), "dna4", F.col("seq_id"), 3)
    a = {r.seq_id: r.x for r in df.select("seq_id", e.alias("x")).collect()}
    b = {r.seq_id: r.x for r in df.repartition(7).select("seq_id", e.alias("x")).collect()}
    assert a == b and all(set(x) <= set("ACGT") and x[:2] == "AC" and x[6] == "G" for x in a.values())
    c = {r.seq_id: r.x for r in df.select("seq_id", al.replace_unknown(F.col("seq"), "dna4", F.col("seq_id"), 4).alias("x")).collect()}
    assert a != c


def test_invalid_symbol_error(spark):
    df = spark.createDataFrame([("rec", 5, "ACXG")], "id string, n long, seq string")
    with pytest.raises(Exception, match="rec.*number 5.*'X' .0x58. at place 2"):
        df.select(al.require_valid(F.col("seq"), F.col("id"), F.col("n"))).collect()


def test_hash_is_xxh64_seed_0(spark):
    rng = random.Random(1)
    values = [rng.randrange(-(2**63), 2**63) for _ in range(200)] + [0, 1, -1]
    got = [r.x for r in spark.createDataFrame([(v,) for v in values], "v long").select(km.hash0(F.col("v")).alias("x")).collect()]
    for v, h in zip(values, got, strict=True):
        assert h & (2**64 - 1) == xxhash.xxh64_intdigest((v & (2**64 - 1)).to_bytes(8, "little"), 0)
    assert one(spark, F.xxhash64(F.lit(1).cast("long"))) == -7001672635703045582


def enc(s):
    return int("".join(str("ACGTN".index(c)) for c in s), 5)


def rc(s):
    return s[::-1].translate(str.maketrans("ACGTN", "TGCAN"))


@pytest.mark.parametrize(("k", "w"), [(1, 1), (3, 1), (3, 4), (5, 7)])
def test_minimizers(spark, k, w):
    rng = random.Random(k * w)
    seqs = [(i, "".join(rng.choice("ACGTN") for _ in range(rng.randrange(40)))) for i in range(30)]
    got = {}
    for r in km.minimizers(spark.createDataFrame(seqs, "seq_id long, seq string"), k, w).collect():
        got.setdefault(r.seq_id, []).append((r.pos, r.value))
    for i, s in seqs:
        v = [min(enc(s[j : j + k]), enc(rc(s[j : j + k]))) for j in range(len(s) - k + 1)]
        want = []
        for j in range(len(v) - w + 1):
            m = min(range(j, j + w), key=lambda x: (v[x], x))
            if not want or want[-1][2] != v[m]:
                want.append((m, v[m], v[m]))
            else:
                want[-1] = (*want[-1][:2], v[m])
        assert sorted(got.get(i, [])) == sorted({(a, b) for a, b, _ in want}), s


def test_minimizer_chunks(monkeypatch):
    rng = random.Random(8)
    s = "".join(rng.choice("ACGTN") for _ in range(300)) + "A" * 60
    whole = km.minimizers_of(s, 4, 3)
    monkeypatch.setattr(km, "CHUNK", 11)
    assert all((a == b).all() for a, b in zip(whole, km.minimizers_of(s, 4, 3), strict=True))


def test_mod_mers(spark):
    s = "ACGTTGCATGTCGCATGATGCATGAGAGCTACGT"
    got = {(r.pos, r.value) for r in km.mod_mers(spark.createDataFrame([(0, s)], "seq_id long, seq string"), 5, 2).collect()}
    want = set()
    for j in range(len(s) - 4):
        h = xxhash.xxh64_intdigest(min(enc(s[j : j + 5]), enc(rc(s[j : j + 5]))).to_bytes(8, "little"), 0)
        if h & 3 == 0:
            want.add((j, h - 2**64 if h >= 2**63 else h))
    assert got == want
    for bad in (-1, 63):
        with pytest.raises(ValueError):
            km.mod_mers(spark.range(0), 3, bad)


def test_distances(spark):
    assert one(spark, hamming(F.col("q"), F.col("r"), F.lit(1)), q="ACGT", r="TACTT") == 1
    assert one(spark, edit(F.col("q"), F.col("r"), F.lit(0), 2), q="ACGT", r="AGT") == 1
    assert one(spark, edit(F.col("q"), F.col("r"), F.lit(0), 1), q="ACGT", r="TTTTT") is None
