import random

import pytest

from strandlake.operators.search import expand_strands, search
from strandlake.operators.simulate import apply_transcript, simulate_reads, transcript
from strandlake.operators.suffix import concat_text, export_suffix_arrays, suffix_array
from strandlake.sources.fasta import fasta_text, read_fasta, write_fasta
from strandlake.sources.tables import Report, hit_lines, write_counted_hits, write_hits


def test_fasta(spark, tmp_path):
    body = ">a desc > x\nACGT\nAC\n>b\nNNAC\n>c\n\n"
    want = [(0, "a desc > x", "ACGTAC"), (1, "b", "NNAC"), (2, "c", "")]
    for name, text in (("u.fa", body), ("w.fa", body.replace("\n", "\r\n"))):
        (tmp_path / name).write_bytes(text.encode())
        rows = read_fasta(spark, f"{tmp_path}/{name}").collect()
        assert sorted((r.seq_id, r.id, r.seq) for r in rows) == want
    (tmp_path / "e.fa").write_text("")
    with pytest.raises(ValueError):
        read_fasta(spark, f"{tmp_path}/e.fa")


def test_fasta_round_trip(spark, tmp_path):
    rows = [(i, f"r{i}", "ACGT" * n) for i, n in enumerate((0, 1, 20, 41))]
    df = spark.createDataFrame(rows, "seq_id long, id string, seq string")
    write_fasta(df.coalesce(1), f"{tmp_path}/o", 80)
    got = {r.id: r.seq for r in read_fasta(spark, f"{tmp_path}/o").collect()}
    assert got == {i: s for _, i, s in rows}
    assert fasta_text(df.filter("seq_id = 2"), 30).first().value == ">r2\n" + "\n".join(("ACGT" * 20)[k : k + 30] for k in (0, 30, 60))
    assert fasta_text(df.filter("seq_id = 3"), 0).first().value == ">r3\n" + "ACGT" * 41


def test_hits_and_report(spark, tmp_path):
    hits = spark.createDataFrame([(1, 2, 3, 0), (0, 5, 6, 1)], "query_id long, seq_id long, pos long, errors int")
    assert sorted(r.value for r in hit_lines(hits).collect()) == ["0 5 6", "1 2 3"]
    write_hits(hits, f"{tmp_path}/t")
    assert sorted(r.value for r in spark.read.text(f"{tmp_path}/t").collect()) == ["0 5 6", "1 2 3"]
    write_hits(hits, f"{tmp_path}/p", text=False)
    assert spark.read.parquet(f"{tmp_path}/p").count() == 2
    r = Report()
    with r.phase("search"):
        pass
    assert [x.phase for x in r.frame(spark, 4, 2).collect()] == ["search", "total", "queries per second", "hits"]


def test_hits_are_counted_where_they_are_written(spark, tmp_path):
    """The plan of the hits runs once, whatever the ordered write reads; no hits are a count of 0."""
    seen = spark.sparkContext.accumulator(0)

    def run(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    schema = "query_id long, seq_id long, pos long"
    hits = spark.range(1_000).selectExpr("id % 7 AS query_id", "id % 3 AS seq_id", "id AS pos").mapInArrow(run, schema)
    assert write_counted_hits(hits, f"{tmp_path}/h") == 1_000
    assert seen.value == 1_000
    assert spark.read.text(f"{tmp_path}/h").count() == 1_000
    for none in (hits.filter("pos < 0"), spark.createDataFrame([], schema), hits.limit(0)):
        assert write_counted_hits(none, f"{tmp_path}/e") == 0
        assert spark.read.text(f"{tmp_path}/e").count() == 0


def test_suffix_array(spark, tmp_path):
    one = lambda t: [p for _, p in sorted((r.rank, r.pos) for r in suffix_array(spark.createDataFrame([(t,)], "text string")).collect())]
    assert one("ACGT$") == [4, 0, 1, 2, 3]
    assert one("$TGCA") == [0, 4, 3, 2, 1]
    rng = random.Random(3)
    for t in ("A" * 70 + "$", "".join(rng.choice("AC") for _ in range(200)) + "$"):
        assert one(t) == sorted(range(len(t)), key=lambda i: t[i:])
    refs = spark.createDataFrame([(0, "AC"), (1, "GT")], "seq_id long, seq string")
    assert concat_text(refs).first().text == "ACGT$"
    export_suffix_arrays(refs, f"{tmp_path}/x")
    read = lambda n: spark.read.text(f"{tmp_path}/x{n}").first().value
    assert (read(".txt"), read(".sa"), read(".rev.txt"), read(".rev.sa")) == ("ACGT$", "4 0 1 2 3", "$TGCA", "0 4 3 2 1")


def test_text_chunks(spark):
    from pyspark.sql import functions as F

    from strandlake.operators.suffix import reverse_chunks, text_chunks

    rng = random.Random(8)
    seqs = ["".join(rng.choice("ACGT") for _ in range(n)) for n in (0, 3, 50, 1, 0, 7, 120, 2)]
    refs = spark.createDataFrame(list(enumerate(seqs)), "seq_id long, seq string").repartition(3)
    whole = "".join(seqs) + "$"
    for size in (9, 16, 64, 1000):
        chunks = text_chunks(refs, size=size)
        rows = sorted((r.start, r.text) for r in chunks.collect())
        assert [t for _, t in rows] == [whole[i : i + size] for i in range(0, len(whole), size)] and [s for s, _ in rows] == list(range(0, len(whole), size))
        assert [p for _, p in sorted((r.rank, r.pos) for r in suffix_array(chunks).collect())] == sorted(range(len(whole)), key=lambda i: whole[i:])
        back = reverse_chunks(chunks)
        assert "".join(t for _, t in sorted((r.start, r.text) for r in back.collect())) == whole[::-1]
        assert [p for _, p in sorted((r.rank, r.pos) for r in suffix_array(back).collect())] == sorted(range(len(whole)), key=lambda i: whole[::-1][i:])
    assert text_chunks(refs.filter(F.lit(False))).first().text == "$"


def test_fasta_of_several_files_is_in_file_order(spark, tmp_path):
    for k, n in enumerate((3, 400, 20)):  # Spark would read the largest first
        (tmp_path / f"p{k}.fa").write_text("".join(f">{k}-{i}\nACGT\n" for i in range(n)))
    rows = sorted((r.seq_id, r.id) for r in read_fasta(spark, str(tmp_path)).collect())
    assert [x for _, x in rows] == [f"{k}-{i}" for k, n in enumerate((3, 400, 20)) for i in range(n)]


def test_simulated_places_are_spread_over_all_sequences(spark):
    rng = random.Random(5)
    seqs = ["".join(rng.choice("ACGT") for _ in range(n)) for n in (200, 9, 10, 11, 40)]
    refs = spark.createDataFrame(list(enumerate(seqs)), "seq_id long, seq string")
    rows = simulate_reads(spark, refs, 3000, 10, seed=2).collect()
    assert len(rows) == 3000 and all(seqs[r.seq_id][r.pos : r.pos + 10] == r.seq for r in rows)
    assert {r.seq_id for r in rows} == {0, 2, 3, 4} and 280 < sum(r.seq_id == 4 for r in rows) < 520


def test_transcripts():
    for seed in range(50):
        rng = random.Random(seed)
        t = transcript(20, 2, 1, 2, rng)
        assert (t.count("S"), t.count("I"), t.count("D"), len(t.replace("D", ""))) == (2, 1, 2, 20)
        span = "".join(rng.choice("ACGT") for _ in range(len(t) - 1))
        assert len(apply_transcript(span, t, rng)) == 20
    with pytest.raises(ValueError):
        transcript(2, 2, 1, 0, random.Random(0))


def test_simulated_reads_are_found(spark):
    rng = random.Random(9)
    refs = spark.createDataFrame([(i, "".join(rng.choice("ACGT") for _ in range(n))) for i, n in enumerate((5, 300, 400))], "seq_id long, seq string")
    reads = simulate_reads(spark, refs, 20, 50, 1, 0, 1, seed=3).cache()
    rows = reads.collect()
    assert len(rows) == 20 and all(len(r.seq) == 50 for r in rows) and {r.seq_id for r in rows} == {1, 2}
    assert rows[0].id == f"simulated-{rows[0].read_id} (seqid:{rows[0].seq_id}, pos:{rows[0].pos}, trans:{rows[0].transcript})"
    found = search(refs, expand_strands(reads.selectExpr("read_id as src_id", "seq"), False), 2, "edit").collect()
    for r in rows:
        assert any(h.query_id == r.read_id and h.seq_id == r.seq_id and abs(h.pos - r.pos) <= 2 for h in found)
    again = {r.read_id: r.seq for r in simulate_reads(spark, refs, 20, 50, 1, 0, 1, seed=3).repartition(5).collect()}
    assert again == {r.read_id: r.seq for r in rows}
    other = {r.read_id: (r.seq_id, r.pos) for r in simulate_reads(spark, refs, 20, 50, 1, 0, 1, seed=4).collect()}
    assert other != {r.read_id: (r.seq_id, r.pos) for r in rows}
    with pytest.raises(ValueError):
        simulate_reads(spark, refs, 2, 500)
    assert {len(r.seq) for r in simulate_reads(spark, None, 5, 33, seed=1).collect()} == {33}


def test_stream(spark, tmp_path):
    from strandlake.streaming.reads import search_stream

    refs = spark.createDataFrame([(0, "ACGTACGTTT")], "seq_id long, seq string")
    spark.createDataFrame([(0, "ACGT"), (1, "GTTT")], "src_id long, seq string").write.parquet(f"{tmp_path}/in")
    reads = spark.readStream.schema("src_id long, seq string").parquet(f"{tmp_path}/in")
    search_stream(reads, refs, f"{tmp_path}/out", f"{tmp_path}/ck", reverse=False, available_now=True).awaitTermination()
    got = {(r.query_id, r.pos) for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert got == {(0, 0), (0, 4), (1, 6)}
