"""Steps of k-mer queries that are bounded by batch: values as Spark's hash, first occurrences, batches of results."""

import random

import pytest

from strandlake.functions import kmers as k
from strandlake.operators import kmer as km
from tests.test_index import seqs


def test_first_seen_of_tasks_with_small_bounds(spark, monkeypatch):
    rng = random.Random(3)
    rows = [(rng.randrange(50), rng.randrange(40), rng.randrange(-9, 60)) for _ in range(3000)]
    selected = spark.createDataFrame(rows, "seq_id long, pos long, value long").repartition(3)
    want = {}
    for s, p, v in rows:
        want[v] = min((s, p), want.get(v, (s, p)))
    for seen in (1 << 21, 16):
        monkeypatch.setattr(km, "SEEN", seen)
        got = km.first_seen(selected).collect()
        assert len(got) <= 3 * len(want) if seen > 16 else len(got) < 3000
        assert {v: min((r.seq_id, r.pos) for r in got if r.value == v) for v in want} == want
        assert [(r.kmer_hash) for r in km.dictionary(selected).orderBy("kmer_id").collect()] == sorted(want, key=lambda v: (*want[v], v))


@pytest.mark.parametrize("held", [1 << 18, 5])
def test_batches_of_selected_kmers(spark, monkeypatch, held):
    """Many small batches give the rows of one, and values are Spark's hashes."""
    monkeypatch.setattr(k, "HELD", held)
    monkeypatch.setattr(k, "CHUNK", 16 if held == 5 else 1 << 20)
    rng = random.Random(5)
    refs = seqs(spark, [(i, "".join(rng.choice("ACGTN") for _ in range(rng.randrange(90)))) for i in range(30)])
    every = k.kmers(refs, 7).select("seq_id", "pos", k.hash0(k.canonical("kmer")).alias("value"))
    assert sorted(k.mod_mers(refs, 7, 0).collect()) == sorted(every.collect())
    assert sorted(k.mod_mers(refs, 7, 2).collect()) == sorted(every.filter("value & 3 = 0").collect())
    want = [(r.seq_id, int(p), int(v)) for r in refs.collect() for p, v in zip(*k.minimizers_of(r.seq, 7, 4), strict=True)]
    assert sorted(map(tuple, k.minimizers(refs, 7, 4).collect())) == sorted(want)


def _shuffled(spark, df):
    """Bytes that the jobs of an action on df shuffle, by Spark's own count."""
    store = spark._jsc.sc().statusStore()
    doubles = spark.sparkContext._gateway.new_array(spark._jvm.double, 0)
    total = lambda: sum(store.stageList(None, False, False, doubles, None).apply(i).shuffleWriteBytes() for i in range(store.stageList(None, False, False, doubles, None).size()))
    before = total()
    df.write.format("noop").mode("overwrite").save()
    return total() - before


@pytest.mark.parametrize("mode", km.KMER_MODES)
@pytest.mark.parametrize("held", [1 << 18, 7])
def test_dictionary_and_texts_where_kmers_are_selected(spark, monkeypatch, mode, held):
    """Fused with the selection, first occurrences and id lists are those of the rows; without broadcast they are too."""
    monkeypatch.setattr(k, "HELD", held)
    monkeypatch.setattr(km, "HELD", held)
    rng = random.Random(7)
    refs = seqs(spark, [(i, "".join(rng.choice("ACGT") for _ in range(rng.randrange(120)))) for i in range(40)]).repartition(3)
    how = (5, mode, 4, 1)
    selected = km.sketch(refs, *how)
    words = km.dictionary(selected)
    assert sorted(map(tuple, km.sketch_dictionary(refs, *how).collect())) == sorted(map(tuple, words.collect()))
    want = sorted((r.seq_id, r.kmer_ids) for r in km.id_texts(selected, words).collect())
    assert sorted((r.seq_id, r.kmer_ids) for r in km.sketch_texts(refs, words, *how).collect()) == want
    monkeypatch.setattr(km, "HELD_WORDS", 3)
    assert sorted((r.seq_id, r.kmer_ids) for r in km.sketch_texts(refs, words, *how).collect()) == want
    assert km.sketch_texts(refs, words.limit(0), *how).count() == 0


def test_id_texts_are_not_shuffled(spark):
    """Grouping the rows of a sketch by sequence shuffled all of it: 588 MB for 0.1 GB of documents."""
    rng = random.Random(9)
    refs = seqs(spark, [(i, "".join(rng.choice("ACGT") for _ in range(400))) for i in range(60)])
    words = spark.createDataFrame([(r.kmer_hash, r.kmer_id) for r in km.sketch_dictionary(refs, 5, "winnowing", 4).collect()], "kmer_hash long, kmer_id int")
    assert _shuffled(spark, km.sketch_texts(refs, words, 5, "winnowing", 4)) == 0
    assert _shuffled(spark, km.id_texts(km.sketch(refs, 5, "winnowing", 4), words)) > 0


@pytest.mark.parametrize("bound", [400_000, 0])
def test_search_of_texts_with_and_without_broadcast(spark, monkeypatch, bound):
    monkeypatch.setattr(km, "BROADCAST_IDS", bound)
    monkeypatch.setattr(km, "BROADCAST_STARTS", bound)
    rng = random.Random(11)
    texts = [(s, [rng.randrange(3) for _ in range(rng.randrange(1, 30))]) for s in range(30)]
    asked = [(q, 9 * q, [rng.randrange(3) for _ in range(rng.randrange(1, 5))]) for q in range(12)]
    want = sorted((q, src, s, p) for q, src, x in asked for s, t in texts for p in range(len(t) - len(x) + 1) if t[p : p + len(x)] == x)
    got = km.search_texts(spark.createDataFrame(texts, "seq_id long, kmer_ids array<int>"), spark.createDataFrame(asked, "query_id long, src_id long, kmer_ids array<int>"))
    assert want and sorted(map(tuple, got.collect())) == want
