import random

import pytest
from pyspark.sql import functions as F

from strandlake.operators import kmer
from strandlake.operators.index import build_index, gram_counts, search_index, statistics
from strandlake.operators.search import expand_strands, limit_queries, prepare, search, search_collapsed, search_exact

REFS = [(0, "ACGTACGT"), (1, "NNACGT")]


def seqs(spark, rows, key="seq_id"):
    return spark.createDataFrame(rows, f"{key} long, seq string")


def lev(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(new[-1] + 1, row[j] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def brute(refs, queries, k, metric):
    out = {}
    for q, s in queries:
        m = len(s)
        for r, t in refs:
            for p in range(len(t)):
                if metric == "hamming":
                    d = sum(a != b for a, b in zip(s, t[p : p + m], strict=True)) if p + m <= len(t) else k + 1
                else:
                    d = min(lev(s, t[p : p + n]) for n in range(max(m - k, 0), m + k + 1))
                if m and d <= k:
                    out[q, r, p] = d
    return out


def hits(df):
    rows = df.collect()
    out = {(r.query_id, r.seq_id, r.pos): r.errors for r in rows}
    assert len(out) == len(rows)
    return out


@pytest.fixture(scope="module")
def sample():
    rng = random.Random(7)
    refs = [(i, "".join(rng.choice("ACGT") for _ in range(rng.choice((0, 3, 25, 60))))) for i in range(12)]
    queries = []
    for i in range(14):
        t = rng.choice([s for _, s in refs if len(s) > 20])
        a = rng.randrange(len(t) - 15)
        q = list(t[a : a + rng.choice((2, 4, 9, 14))])
        for _ in range(rng.randrange(3)):
            j = rng.randrange(len(q))
            q[j : j + 1] = rng.choice(([], ["A"], ["G", "T"], [q[j], "C"])) or [q[j]]
        queries.append((i, "".join(q)))
    return refs, [*queries, (14, ""), (15, "A")]


@pytest.mark.parametrize("metric", ["hamming", "edit"])
@pytest.mark.parametrize("k", [0, 1, 2])
@pytest.mark.parametrize("broadcast", [True, False])
def test_search_equals_brute_force(spark, sample, metric, k, broadcast):
    refs, queries = sample
    got = hits(search(seqs(spark, refs), seqs(spark, queries, "query_id"), k, metric, broadcast=broadcast))
    assert got == brute(refs, queries, k, "hamming" if k == 0 else metric)


@pytest.mark.parametrize(("metric", "broadcast"), [("hamming", True), ("edit", True), ("edit", False)])
def test_chunks_change_nothing(spark, sample, metric, broadcast, monkeypatch):
    from strandlake.operators import search as module

    refs, queries = sample
    monkeypatch.setattr(module, "CHUNK", 7)
    assert hits(search(seqs(spark, refs), seqs(spark, queries, "query_id"), 2, metric, broadcast=broadcast)) == brute(refs, queries, 2, metric)


def test_goldens(spark):
    refs = seqs(spark, REFS)
    exact = {(r.query_id, r.seq_id, r.pos) for r in search_exact(refs, expand_strands(seqs(spark, [(0, "ACGT")], "src_id"))).collect()}
    assert exact == {(q, *x) for q in (0, 1) for x in ((0, 0), (0, 4), (1, 2))}
    assert hits(search(refs, seqs(spark, [(0, "ACGA")], "query_id"), 1, "hamming")) == {(0, 0, 0): 1, (0, 0, 4): 1, (0, 1, 2): 1}
    both = limit_queries(expand_strands(seqs(spark, [(0, "ACGT"), (1, "AAAA")], "src_id")), 3)
    assert {r.query_id for r in both.collect()} == {0, 1, 2}


def test_strata_and_top_n(spark, sample):
    refs, queries = sample
    r, q = seqs(spark, refs), seqs(spark, queries, "query_id")
    every = hits(search(r, q, 2, "edit"))
    low = {}
    for (a, _, _), e in every.items():
        low[a] = min(low.get(a, 9), e)
    assert hits(search(r, q, 2, "edit", "best")) == {k: e for k, e in every.items() if e == low[k[0]]}
    top = hits(search(r, q, 2, "edit", "all", 2))
    for a in low:
        want = sorted((e, *k[1:]) for k, e in every.items() if k[0] == a)[:2]
        assert sorted((e, *k[1:]) for k, e in top.items() if k[0] == a) == want


def test_metamorphic(spark, sample):
    refs, queries = sample
    r, q = seqs(spark, refs), seqs(spark, queries, "query_id")
    one, two = hits(search(r, q, 1, "edit")), hits(search(r, q, 2, "edit"))
    assert set(one) <= set(two) and set(hits(search(r, q, 2, "hamming"))) <= set(two)
    folded = hits(search_collapsed(r, q, 1, alphabet="dr_dna4"))
    assert set(one) <= set(folded)
    assert hits(search_collapsed(r, q, 1, alphabet="dr_dna4", verify=True)) == one


@pytest.mark.parametrize("name", ["optimum", "01*0", "suffix", "pex-td", "h2-k3"])
def test_every_complete_scheme_gives_the_same_hits(spark, sample, name):
    from strandlake.plans.schemes import generate

    refs, queries = sample
    r, q = seqs(spark, refs), seqs(spark, queries, "query_id")
    assert hits(search(r, q, 2, "edit", scheme=generate(name, 0, 2))) == brute(refs, queries, 2, "edit")


def test_scheme_without_seed_is_refused(spark):
    from strandlake.plans.schemes import generate

    with pytest.raises(ValueError, match="free of errors"):
        search(seqs(spark, REFS), seqs(spark, [(0, "ACGT")], "query_id"), 1, scheme=generate("backtracking", 0, 1))


def test_bad_options(spark):
    for more in ({"metric": "x"}, {"mode": "x"}, {"errors": -1}, {"max_hits": -1}):
        with pytest.raises(ValueError):
            search(spark.range(0), spark.range(0), **more)


@pytest.mark.parametrize("alphabet", ["dna4", "dr_dna4"])
def test_index_equals_search(spark, sample, tmp_path, alphabet):
    refs, queries = sample
    path = f"{tmp_path}/i"
    meta = build_index(seqs(spark, refs), path, alphabet, gram_len=3)
    assert meta["n_seqs"] == len(refs) and meta["total_size"] == sum(len(s) for _, s in refs)
    q = seqs(spark, queries, "src_id")
    for k in (0, 1, 2):
        got = hits(search_index(spark, path, q, k, reverse=False))
        flat = q.withColumnRenamed("src_id", "query_id")
        want = search(seqs(spark, refs), flat, k, "edit") if alphabet == "dna4" else search_collapsed(seqs(spark, refs), flat, k, alphabet=alphabet)
        assert got == hits(want)


def test_index_guards(spark, tmp_path):
    with pytest.raises(ValueError, match="no valid index"):
        search_index(spark, f"{tmp_path}/none", spark.range(1))
    with pytest.raises(ValueError, match="empty"):
        build_index(seqs(spark, []), f"{tmp_path}/e")
    build_index(seqs(spark, REFS), f"{tmp_path}/u", kind="uni", gram_len=2)
    with pytest.raises(ValueError, match="exact"):
        search_index(spark, f"{tmp_path}/u", seqs(spark, [(0, "ACGT")], "src_id"), 1)
    with pytest.raises(ValueError, match="query"):
        search_index(spark, f"{tmp_path}/u", seqs(spark, [], "src_id"))
    with pytest.raises(Exception, match="lacks"):
        build_index(seqs(spark, [(0, "AXC")]), f"{tmp_path}/x")
    build_index(seqs(spark, [(0, "AXCGT")]), f"{tmp_path}/x", ignore_unknown=True, gram_len=2)
    assert prepare(seqs(spark, [(0, "axu")]), ignore_unknown=True).first().seq == "ANT"
    assert statistics(seqs(spark, REFS)).first().asDict() == {"n_seqs": 2, "total_size": 14, "sigma": 6}
    assert {r.gram: r.n for r in gram_counts(seqs(spark, REFS), 4).collect()}["ACGT"] == 3


@pytest.mark.parametrize(("mode", "k", "w", "m"), [("winnowing", 3, 2, 0), ("mod", 3, 1, 1)])
def test_kmer_index(spark, tmp_path, mode, k, w, m):
    rng = random.Random(5)
    refs = [(i, "".join(rng.choice("ACGT") for _ in range(80))) for i in range(6)]
    path = f"{tmp_path}/k"
    build_kmer = kmer.build_kmer_index(seqs(spark, refs), path, k, mode, w, m)
    texts = {r.seq_id: r.kmer_ids for r in spark.read.parquet(f"{path}/texts").collect()}
    assert build_kmer["largest_value"] == max(max(t) for t in texts.values())
    first = [i for s in sorted(texts) for i in texts[s]]
    assert list(dict.fromkeys(first)) == list(range(1, build_kmer["largest_value"] + 1))
    queries = [(0, refs[2][1][10:60]), (1, "ACG"), (2, refs[4][1][5:50]), (3, refs[1][1])]
    got = {(r.query_id, r.src_id, r.seq_id, r.pos) for r in kmer.kmer_search(spark, path, seqs(spark, queries, "src_id")).collect()}
    words = spark.read.parquet(f"{path}/dictionary")
    own = kmer.admitted(kmer.admit(seqs(spark, queries, "src_id"), words, k, mode, w, m)).collect()
    want = set()
    for q in own:
        for s, t in texts.items():
            want |= {(q.query_id, q.src_id, s, p) for p in range(len(t) - len(q.kmer_ids) + 1) if t[p : p + len(q.kmer_ids)] == q.kmer_ids}
    assert got == want and any(x[1] == 3 and x[2] == 1 for x in got) and not any(x[1] == 1 for x in got)
    with pytest.raises(ValueError):
        kmer.kmer_search(spark, path, seqs(spark, [(0, "AC")], "src_id"))
    with pytest.raises(ValueError, match="kind"):
        search_index(spark, path, seqs(spark, [(0, "AC")], "src_id"))


def test_adaptive_sigma():
    assert [kmer.adaptive_sigma(x) for x in (1, 2, 3, 5, 15, 127)] == [3, 3, 4, 6, 16, 128]
    with pytest.raises(ValueError):
        kmer.adaptive_sigma(128)


def test_plan_reads_two_columns_and_broadcasts(spark, tmp_path):
    path = f"{tmp_path}/p"
    spark.createDataFrame([(0, "ACGTACGT", "x")], "seq_id long, seq string, other string").write.parquet(path)
    df = search_exact(spark.read.parquet(path), seqs(spark, [(0, "ACGT")], "query_id"))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "other" not in plan and "CartesianProduct" not in plan
    assert df.select(F.count(F.lit(1))).first()[0] == 2
