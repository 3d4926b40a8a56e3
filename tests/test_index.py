"""Stored indexes: what a search reads, seeds by frequency, strata, parts and cells; alignments."""

import itertools
import random
import re
import shutil
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest

from strandlake import queries as engine
from strandlake.operators import align, index
from strandlake.operators import search as s
from strandlake.sources.tables import read_meta

SF = "/root/testdata/sf0.01"


def seqs(spark, rows, key="seq_id"):
    return spark.createDataFrame(rows, f"{key} long, seq string")


def hits(df):
    return {(r.query_id, r.seq_id, r.pos): r.errors for r in df.collect()}


@pytest.fixture(scope="module")
def whole(spark, tmp_path_factory):
    """All documents of sf0.01."""
    path = f"{tmp_path_factory.mktemp('index')}/docs"
    index.build_index(engine.references(spark, SF), path)
    return path


def test_a_search_reads_the_buckets_of_its_seeds(spark, whole, tmp_path):
    meta = read_meta(spark, whole, *index.KINDS)
    size = lambda table, picked=None: sum(f.stat().st_size for f in Path(whole, table).glob("*.parquet") if picked is None or int(re.search(r"_(\d{5})\.", f.name)[1]) in picked)
    own = s.expand_strands(engine.probes(spark, SF).filter("length(seq) > 100").orderBy("src_id").limit(1), reverse=False)
    probes = index.probe_cells(spark, whole, meta, own, 0)
    probes = spark.createDataFrame(probes.collect(), probes.schema)
    assert probes.count() == 1
    assert index.buckets_read(spark, whole, probes).first().asDict() == {"cells": 1, "buckets": 1, "of_buckets": meta["buckets"]}
    picked = {r.b for r in probes.selectExpr(f"pmod(hash(cell), {meta['buckets']}) AS b").collect()}
    # Any other file would raise if it were opened.
    shutil.copytree(f"{whole}/grams", f"{tmp_path}/grams")
    for f in Path(tmp_path, "grams").glob("*.parquet"):
        if int(re.search(r"_(\d{5})\.", f.name)[1]) not in picked:
            f.write_bytes(b"not a table")
            f.with_name(f".{f.name}.crc").unlink(missing_ok=True)
    places = lambda at: sorted((r.seq_id, r.p) for r in index.look_up(index.stored(spark, at, "grams", meta["buckets"]), probes, "cell").collect())
    assert places(str(tmp_path)) == places(whole) != []
    seq = own.first().seq
    grams = spark.createDataFrame([(bytearray(seq[i : i + meta["gram_len"]].encode()),) for i in range(len(seq) - meta["gram_len"] + 1)], "gram binary")
    counted = {r.b for r in grams.selectExpr(f"pmod(hash(gram), {meta['buckets']}) AS b").collect()}
    hit = index.search_index(spark, whole, engine.probes(spark, SF).filter(f"src_id = {own.first().src_id}"), reverse=False)
    part = {r.b for r in hit.select(index._part(hit.seq_id, (hit.pos / index.PART).cast("int")).alias("p")).selectExpr(f"pmod(hash(p), {meta['buckets']}) AS b").collect()}
    read = size("grams", picked) + size("counts", counted) + size("parts", part)
    every = size("grams") + size("counts") + size("parts")
    assert size("grams", picked) > 0 and read < 0.05 * every


def test_stored_rows_are_not_shuffled(spark, whole, monkeypatch):
    """Beyond the literals and the broadcast, the join takes the buckets as they are."""
    monkeypatch.setattr(index, "LITERALS", 0)
    monkeypatch.setattr(index, "BROADCAST", 0)
    meta = read_meta(spark, whole, *index.KINDS)
    probes = spark.createDataFrame([(1, bytearray(b"ACGT" * 3))], "query_id long, cell binary")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = index.look_up(index.stored(spark, whole, "grams", meta["buckets"]), probes, "cell")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert plan.count("Exchange hashpartitioning(cell") == 1 and "SortMergeJoin" in plan
    stored = next(x for x in re.split(r"\n(?=[^\n]*SortMergeJoin)", plan) if "FileScan" in x)
    assert "Exchange" not in stored[: stored.index("FileScan")]


def test_one_index_answers_as_a_search_of_the_references(spark, whole):
    refs, own = engine.references(spark, SF), engine.probes(spark, SF)
    flat = s.expand_strands(own, reverse=False)
    for errors, metric in ((0, "edit"), (1, "hamming")):
        assert hits(index.search_index(spark, whole, own, errors, metric, reverse=False)) == hits(s.search(refs, flat, errors, metric))


def test_cheapest_seeds_equal_brute_force():
    rng = random.Random(4)
    for _ in range(200):
        g, k = rng.randrange(1, 4), rng.randrange(1, 4)
        counts = [rng.randrange(1, 6) for _ in range(g * k - g + 1 + rng.randrange(6))]
        got = index.cheapest_seeds(np.array(counts), k, g)
        ways = [x for x in itertools.combinations(range(len(counts)), k) if all(b - a >= g for a, b in itertools.pairwise(x))]
        assert tuple(got) in ways and sum(counts[i] for i in got) == min(sum(counts[i] for i in x) for x in ways)


def repetitive(seed, n=12):
    """References made of few repeats, with rare stretches."""
    rng = random.Random(seed)
    draw = lambda m: "".join(rng.choice("ACGT") for _ in range(m))
    repeat = draw(9)
    refs = [(i, "".join(repeat if rng.random() < 0.7 else draw(7) for _ in range(12))) for i in range(n)]
    return refs, [(i, refs[i % n][1][i : i + 40]) for i in range(6)]


def test_seeds_by_frequency_join_fewer_places(spark, tmp_path, monkeypatch):
    refs, queries = repetitive(1)
    path = f"{tmp_path}/r"
    meta = index.build_index(seqs(spark, refs), path, gram_len=6)
    own = seqs(spark, queries, "query_id")
    counts = {bytes(r.gram): r.n for r in index.stored(spark, path, "counts", meta["buckets"]).collect()}
    assert counts and min(counts.values()) >= index.COMMON
    cost = lambda rows: sum(counts.get(bytes(r.cell), 1) for r in rows)
    chosen = index.probe_cells(spark, path, meta, own, 1).collect()
    fixed = s._seeds(own, [(0, 1), (1, 2)], 2, (6,)).withColumnRenamed("gram", "cell").collect()
    assert len(chosen) == 2 * len(queries) and cost(chosen) < 0.6 * cost(fixed)
    for a in {r.query_id for r in chosen}:
        at = sorted(r.offset for r in chosen if r.query_id == a)
        assert at[1] - at[0] >= 6
    for k in (0, 1, 2):
        want = hits(s.search(seqs(spark, refs), own, k, "edit"))
        assert hits(index.search_index(spark, path, own.withColumnRenamed("query_id", "src_id"), k, reverse=False)) == want


def test_cells_of_hot_grams_and_small_parts(spark, tmp_path, monkeypatch):
    refs, queries = repetitive(2)
    monkeypatch.setattr(index, "CELL", 5)
    monkeypatch.setattr(index, "PART", 32)
    monkeypatch.setattr(index, "REACH", 60)
    monkeypatch.setattr(index, "LEAST_ROWS", 50)
    path = f"{tmp_path}/r"
    meta = index.build_index(seqs(spark, refs), path, gram_len=6)
    cells = index.stored(spark, path, "grams", meta["buckets"])
    assert cells.filter("length(cell) > 6").count() and cells.groupBy("cell").count().agg({"count": "max"}).first()[0] < 15
    own = seqs(spark, queries, "query_id")
    for literals in (2000, 0):
        monkeypatch.setattr(index, "LITERALS", literals)
        for k, metric in ((0, "edit"), (1, "edit"), (2, "edit"), (2, "hamming")):
            want = hits(s.search(seqs(spark, refs), own, k, metric))
            assert hits(index.search_index(spark, path, own.withColumnRenamed("query_id", "src_id"), k, metric, reverse=False)) == want


def test_answered_queries_are_not_verified_again(spark, tmp_path, monkeypatch):
    refs, queries = repetitive(3)
    changed = [(i, q if i % 3 == 0 else q[:20] + ("A" if q[20] != "A" else "C") + q[21:] if i % 3 == 1 else "ACGTTGCA" * 5) for i, q in queries]
    asked = []
    real = s._verify_windows

    def watched(windows, errors, metric):
        asked.append((errors, {r.query_id for r in windows.select("query_id").distinct().collect()}))
        return real(windows, errors, metric)

    path = f"{tmp_path}/r"
    index.build_index(seqs(spark, refs), path, gram_len=6)
    own = seqs(spark, changed, "query_id")
    every = hits(s.search(seqs(spark, refs), own, 2, "edit"))
    low = {}
    for (q, *_), e in every.items():
        low[q] = min(e, low.get(q, 9))
    assert 0 in low.values() and 1 in low.values()
    want = {k: e for k, e in every.items() if e == low[k[0]]}
    for module, find in ((s, lambda: s.search(seqs(spark, refs), own, 2, "edit", "best")), (index, lambda: index.search_index(spark, path, own.withColumnRenamed("query_id", "src_id"), 2, "edit", "best", reverse=False))):
        asked.clear()
        monkeypatch.setattr(module, "_verify_windows", watched)
        assert hits(find()) == want
        monkeypatch.setattr(module, "_verify_windows", real)
        assert [k for k, _ in asked] == [0, 1, 2][: len(asked)] and len(asked) > 1
        assert all(low.get(q, 9) >= k for k, own_ids in asked for q in own_ids)


def distance(x, y):
    row = list(range(len(y) + 1))
    for i, c in enumerate(x, 1):
        new = [i]
        for j, d in enumerate(y, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (c != d)))
        row = new
    return row[-1]


@pytest.mark.parametrize("k", [0, 1, 2, 3])
def test_banded_alignment_equals_brute_force(k):
    rng = random.Random(k)
    letters = lambda n: bytes(rng.choice(b"ACG") for _ in range(n))
    windows = [letters(rng.randrange(1, 22)) for _ in range(80)]
    places = [rng.randrange(-k, len(w) + 2) for w in windows]
    queries = [letters(rng.randrange(k + 1, 14)) if rng.random() < 0.4 else w[max(a, 0) :][: k + 9] + letters(k + 1) for w, a in zip(windows, places, strict=True)]
    got = sorted(zip(*[x.tolist() for x in align.banded(queries, windows, np.array(places), k)], strict=True))
    want = []
    for r, (q, w, at) in enumerate(zip(queries, windows, places, strict=True)):
        want += [(r, a, b, d) for a in range(max(0, at - k), min(len(w) - 1, at + k) + 1) for b in range(a, len(w) + 1) if (d := distance(q, w[a:b])) <= k]
    assert got == sorted(want)
    for r, a, b, d in got:
        q, t = queries[r], windows[r][a:b]
        ops = [(int(n), o) for n, o in re.findall(r"(\d+)(.)", align.transcript(q, t, k))]
        assert sum(n for n, o in ops if o != "=") == d
        i = j = 0
        for o in "".join(o * n for n, o in ops):
            assert o in "ID" or (q[i] == t[j]) == (o == "=")
            i, j = i + (o != "D"), j + (o != "I")
        assert (i, j) == (len(q), len(t))


def test_transcripts_by_hand():
    assert align.transcript(b"ACGT", b"ACGT", 1) == "4=" and align.transcript(b"ACGT", b"AGGT", 1) == "1=1X2="
    assert align.transcript(b"ACGT", b"ACT", 1) == "2=1I1=" and align.transcript(b"AAC", b"AAAC", 1) == "1D3="


@pytest.mark.parametrize("broadcast", [True, False])
def test_alignments_over_chunks(spark, monkeypatch, broadcast):
    monkeypatch.setattr(s, "CHUNK", 16)
    if not broadcast:
        monkeypatch.setattr(s, "BROADCAST_SEEDS", 0)
    refs, queries = repetitive(5, 4)
    queries = [(i, q[: 9 + i]) for i, q in queries] + [(8, "A"), (9, "")]
    got = {(r.query_id, r.seq_id, r.pos, r.end): r.errors for r in s.search_alignments(seqs(spark, refs), seqs(spark, queries, "query_id"), 2).collect()}
    want = {}
    for i, q in queries:
        for j, t in refs if len(q) > 2 else []:
            for a in range(len(t)):
                for b in range(max(a, a + len(q) - 2), min(len(t), a + len(q) + 2) + 1):
                    if (d := distance(q, t[a:b])) <= 2:
                        want[i, j, a, b] = d
    assert got == want


@pytest.mark.parametrize("g", [1, 5, 8, 15, 24])
def test_least_grams_equal_brute_force(monkeypatch, g):
    monkeypatch.setattr(index, "SLICE", 7)
    rng = random.Random(g)
    for window in (1, 2, 7, 16):
        for n in (0, g, g + window - 2, g + window - 1, 90):
            seq = bytes(rng.choice(b"ACGT") for _ in range(max(n, 0)))
            hashes = [int(index.gram_hashes(np.frombuffer(seq[i : i + g], np.uint8), g)[0]) for i in range(len(seq) - g + 1)]
            want = [min(range(i, i + window), key=lambda j: (j if window == 1 else hashes[j], j)) for i in range(max(len(seq) - g - window + 2, 0))]
            assert index.least_grams(seq, g, window).tolist() == want


def test_an_index_of_least_grams_has_all_hits(spark, tmp_path):
    """One place of many is held; hits are those of the sequences, and counts for index_seeds those of all places."""
    rng = random.Random(9)
    draw = lambda m: "".join(rng.choice("ACGT") for _ in range(m))
    refs = [(i, draw(300 + 40 * i)) for i in range(12)]
    refs += [(20 + i, refs[i][1][50:200]) for i in range(6)]
    changed = lambda q, *at: "".join({"A": "C"}.get(c, "A") if i in at else c for i, c in enumerate(q))
    own = [(i, changed(refs[i][1][60 : 90 + 9 * i], *[7, 25][: i % 3])) for i in range(12)]
    path = f"{tmp_path}/w"
    meta = index.build_index(seqs(spark, refs), path, gram_len=8, window=8)
    assert index.stored(spark, path, "grams", meta["buckets"]).count() < 0.35 * sum(len(s) for _, s in refs)
    flat = seqs(spark, own, "query_id")
    for k, metric, scheme in ((0, "edit", None), (1, "hamming", None), (2, "edit", None), (1, "edit", engine.schemes.generate("optimum", 0, 1))):
        want = hits(s.search(seqs(spark, refs), flat, k, metric))
        assert want and hits(index.search_index(spark, path, seqs(spark, own, "src_id"), k, metric, reverse=False, scheme=scheme)) == want
    texts = [t for _, t in refs]
    places = {g: n for q in (q for _, q in own) for g in (q[i : i + 8] for i in range(len(q) - 7)) if (n := sum(t.startswith(g, i) for t in texts for i in range(len(t)))) >= index.COMMON}
    wanted = spark.createDataFrame([(bytearray(q[i : i + 8].encode()),) for _, q in own for i in range(len(q) - 7)], "gram binary")
    assert {bytes(r.gram).decode(): r.n for r in index.sequence_counts(spark, path, meta, wanted).collect()} == places


def test_slices_of_all_places(spark):
    from strandlake.functions.kmers import PIECE, slices

    rows = [(1, "ACGTN" * 203), (2, "ACG"), (3, "A" * (PIECE + 4)), (4, "")]
    got = {(r.seq_id, r.p): bytes(r.slice).decode() for r in slices(seqs(spark, rows), 5, "seq_id").collect()}
    assert got == {(i, p): t[p : p + 5] for i, t in rows for p in range(len(t) - 4)}


@pytest.mark.parametrize("size", [1 << 20, 70])
def test_least_grams_of_sequences_side_by_side(spark, monkeypatch, size):
    """Sequences that are hashed together hold the places of each alone; none lies across two."""
    monkeypatch.setattr(index, "SLICE", size)
    rng = random.Random(17)
    refs = seqs(spark, [(3 * i, "".join(rng.choice("ACGT") for _ in range(rng.randrange(90)))) for i in range(60)]).repartition(2)
    want = [(r.seq[p : p + 6].encode(), r.seq_id, int(p)) for r in refs.collect() for p in np.unique(index.least_grams(r.seq.encode(), 6, 5))]
    assert sorted((bytes(r.gram), r.seq_id, r.p) for r in index.held_grams(refs, 6, 5).collect()) == sorted(want)
    letters = np.frombuffer(b"ACGTTGCAACGT", np.uint8)
    of, places, at = index.least_places(letters, np.array([5, 7]), 3, 2)
    assert ((at - np.array([0, 5])[of]) == places).all() and (places + 3 <= np.array([5, 7])[of]).all()


@pytest.mark.parametrize("alphabet", ["dna4", "dna5", "dr_dna4", "dr_dna5"])
def test_numbers_of_grams_are_in_the_order_of_their_letters(spark, alphabet):
    rng, digits = random.Random(3), index.digits_of(alphabet)
    for g in (1, 5, 13, index.PACKED):
        seq = "".join(rng.choice(digits) for _ in range(300))
        numbers = index.gram_numbers(np.frombuffer(seq.encode(), np.uint8), np.arange(300 - g + 1), g, digits).tolist()
        want = [seq[i : i + g] for i in range(300 - g + 1)]
        got = spark.createDataFrame(list(enumerate(numbers)), "i int, number long").select("i", index.spell("number", g, digits).cast("string").alias("gram")).collect()
        assert [r.gram for r in sorted(got)] == want
        assert [want[i] for i in np.argsort(numbers, kind="stable")] == sorted(want)


@pytest.mark.parametrize("size", [1 << 20, 100, 31])
def test_least_grams_over_slices(monkeypatch, size):
    """Slices of long sequences hold each place once; short sequences are hashed side by side."""
    monkeypatch.setattr(index, "SLICE", size)
    rng = random.Random(size)
    rows = [(7 * i, "".join(rng.choice("ACGT") for _ in range(n))) for i, n in enumerate((20, 500, 13, 14, 99, 31, 1, 260, 0))] + [(99, "A" * 400), (100, "ACG" * 90)]
    batch = pa.RecordBatch.from_arrays([pa.array([i for i, _ in rows]), pa.array([t.encode() for _, t in rows])], names=["seq_id", "b"])
    for g, window in ((6, 8), (6, 1), (9, 2)):
        span = g + window - 1
        enough = [(i, t) for i, t in rows if len(t) >= span]
        long = batch.filter(pa.array([len(t) >= span for _, t in rows]))
        want = [(i, int(p), t[p : p + g].encode()) for i, t in enough for p in np.unique(index.least_grams(t.encode(), g, window))]
        got = [(i, p, own[a : a + g].tobytes()) for own, ids, places, at, _ in index._least(index._slices([long], span), g, window) for i, p, a in zip(ids.tolist(), places.tolist(), at.tolist(), strict=True)]
        assert got == want


def test_wanted_grams_are_counted_where_sequences_lie(spark, tmp_path, monkeypatch):
    """Places of the stored sequences are no rows of the plan, however many there are; beyond COUNTED grams they are joined, with equal counts."""
    rng = random.Random(8)
    refs = [(i, "".join(rng.choice("ACGT") for _ in range(rng.randrange(60)))) for i in range(90)] + [(200, "ACGTT" * 30), (201, "N" * 40)]
    path = f"{tmp_path}/w"
    meta = index.build_index(seqs(spark, refs), path, gram_len=4, window=3)
    wanted = spark.createDataFrame([(bytearray(g.encode()),) for g in ("ACGT", "CGTT", "NNNN", "AAAA", "TTTT", "GATC", "ACGT")], "gram binary")
    want = {g: n for g in {bytes(r.gram).decode() for r in wanted.collect()} if (n := sum(t.startswith(g, i) for _, t in refs for i in range(len(t)))) >= index.COMMON}
    counted = index.sequence_counts(spark, path, meta, wanted)
    assert "Generate" not in counted._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(index, "COUNTED", 0)
    for df in (counted, index.sequence_counts(spark, path, meta, wanted)):
        assert {bytes(r.gram).decode(): r.n for r in df.collect()} == want and {r.cells for r in df.collect()} == {1}
    monkeypatch.undo()
    assert index.sequence_counts(spark, path, meta, wanted.limit(0)).collect() == []


def test_buckets_are_sorted_and_written_once(spark, tmp_path, monkeypatch):
    """Each bucket is one file with its cells in order, also where a gram has several cells, and the writer sorts nothing again."""
    refs, _ = repetitive(6)
    monkeypatch.setattr(index, "CELL", 5)
    monkeypatch.setattr(index, "LEAST_ROWS", 100)
    path = f"{tmp_path}/b"
    plans, real = [], index._write_buckets
    monkeypatch.setattr(index, "_write_buckets", lambda rows, *a: plans.append(rows._jdf.queryExecution().executedPlan().toString()) or real(rows, *a))
    meta = index.build_index(seqs(spark, refs), path, gram_len=6)
    assert meta["buckets"] > 3 and all(p.count("+- Sort") == 1 for p in plans) and len(plans) == 3
    for name, key in (("grams", "cell"), ("counts", "gram"), ("parts", "part")):
        files = {f.name: int(re.search(r"_(\d{5})\.", f.name)[1]) for f in Path(path, name).glob("*.parquet")}
        assert len(set(files.values())) == len(files)
        for f, bucket in files.items():
            rows = spark.read.parquet(f"{path}/{name}/{f}").select(key, index.F.expr(f"pmod(hash({key}), {meta['buckets']})").alias("b")).collect()
            keys = [r[0] if name == "parts" else bytes(r[0]) for r in rows]
            assert keys == sorted(keys) and {r.b for r in rows} <= {bucket}


def test_indexes_share_tables(spark, tmp_path):
    """Another description of an index's tables answers as an index of its own; an alphabet that lacks a symbol is refused, with its place."""
    refs, queries = repetitive(7)
    own, path = seqs(spark, queries, "src_id"), f"{tmp_path}/bi"
    meta = index.build_index(seqs(spark, refs), path, gram_len=6)
    for alphabet, kind, sigma in (("dna4", "bi", 5), ("dna5", "uni", 6)):
        other = f"{tmp_path}/{alphabet}-{kind}"
        index.share_index(spark, other, path, alphabet, kind)
        shared = read_meta(spark, other, kind)
        assert (shared["alphabet"], shared["sigma"], shared["n_seqs"], shared["total_size"]) == (alphabet, sigma, meta["n_seqs"], meta["total_size"])
        for again in (other, f"{tmp_path}/again-{kind}"):
            errors = 0 if kind == "uni" else 1
            assert hits(index.search_index(spark, again, own, errors)) == hits(index.search_index(spark, path, own, errors)) != {}
            index.share_index(spark, f"{tmp_path}/again-{kind}", other, alphabet, kind)
    with pytest.raises(ValueError, match="letters of dna5"):
        index.share_index(spark, f"{tmp_path}/x", path, "dr_dna5", "rbi")
    index.build_index(seqs(spark, [(0, "ACGTACGT"), (4, "ACGNT")]), f"{tmp_path}/n", gram_len=2)
    with pytest.raises(Exception, match="record 4 .*symbol 'N' .*at place 3"):
        index.share_index(spark, f"{tmp_path}/x", f"{tmp_path}/n", "dna4", "bi")


def test_index_facts_write_tables_of_equal_letters_once(spark, monkeypatch):
    built, real = [], engine.build_index
    monkeypatch.setattr(engine, "build_index", lambda refs, path, alphabet, kind: built.append(alphabet) or real(refs, path, alphabet, kind))
    rows = {tuple(r) for r in engine.index_facts(spark, SF.replace("0.01", "0.001")).collect()}
    assert built == ["dna5", "dr_dna5"]
    n, size = engine.references(spark, SF.replace("0.01", "0.001")).selectExpr("count(*)", "sum(length(seq))").first()
    assert rows == {(a, k, n, size, s, True) for a, k, s in (("dna5", "bi", 6), ("dna4", "bi", 5), ("dna5", "uni", 6), ("dr_dna5", "rbi", 4), ("dr_dna4", "rbi", 3))}
