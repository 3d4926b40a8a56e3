import random

import pytest

from strandlake.cli import main


@pytest.fixture(scope="module")
def files(tmp_path_factory):
    d = tmp_path_factory.mktemp("cli")
    rng = random.Random(2)
    refs = ["".join(rng.choice("ACGT") for _ in range(120)) for _ in range(4)]
    (d / "refs.fa").write_text("".join(f">r{i}\n{s}\n" for i, s in enumerate(refs)))
    q = refs[2][30:70]
    (d / "q.fa").write_text(f">q0\n{q}\n>q1\n{q[:10]}{'A' if q[10] != 'A' else 'C'}{q[11:]}\n")
    return d


def lines(spark, path):
    return sorted(tuple(map(int, r.value.split())) for r in spark.read.text(str(path)).collect())


@pytest.mark.parametrize(("build", "ending", "find", "more", "want"), [
    (["index"], ".idx", "search", ["--no-reverse"], [(0, 2, 30)]),
    (["index", "--dna4"], ".dna4.idx", "search", ["-e", "1", "-d", "ham"], [(0, 2, 30), (2, 2, 30)]),
    (["index"], ".idx", "search", ["-e", "2", "-m", "besthits", "--no-reverse", "--dynamic_generator", "-g", "optimum"], [(0, 2, 30), (1, 2, 30)]),
    (["uni-index"], ".single.idx", "uni-search", [], [(0, 2, 30)]),
    (["rbi-index"], ".rbi.idx", "rbi-search", ["-e", "1", "-m", "besthits"], [(0, 2, 30), (1, 2, 30)]),
    (["rbi-index-dna4"], ".rbi4.idx", "rbi-search-dna4", ["--ignore_unknown"], [(0, 2, 30)]),
])
def test_index_and_search(spark, files, build, ending, find, more, want, capsys):
    assert main([build[0], str(files / "refs.fa"), *build[1:]], spark) == 0
    out = files / f"out{abs(hash((find, *more)))}"
    assert main([find, "-q", str(files / "q.fa"), "-i", str(files / f"refs.fa{ending}"), "-o", str(out), *more], spark) == 0, capsys.readouterr().err
    assert lines(spark, out) == want


def test_kmers(spark, files):
    assert main(["kmer-index", str(files / "refs.fa"), "--kmer", "5", "--window", "3"], spark) == 0
    assert main(["kmer-search", "--query", str(files / "refs.fa"), "--index", str(files / "refs.fa.kmer.idx"), "--output", str(files / "k")], spark) == 0
    got = lines(spark, files / "k")
    assert {(2 * i, i, 0) for i in range(4)} <= set(got)


def test_simulator_and_export(spark, files):
    assert main(["read_simulator", "-i", str(files / "refs.fa"), "-o", str(files / "reads"), "-n", "5", "-l", "30", "--substitution_errors", "1"], spark) == 0
    assert main(["read_simulator", "-o", str(files / "random"), "-n", "3", "-l", "10"], spark) == 0
    assert main(["columba_prepare", "-i", str(files / "q.fa"), "-o", str(files / "c")], spark) == 0
    assert len(spark.read.text(str(files / "c.sa")).first().value.split()) == 81


def test_schemes(spark, files, capsys):
    for args in (["list-generators"], [], ["-a", "-l", "12"], ["-a", "-y", "-l", "12", "-k", "1"], ["-a", "--columba", str(files / "col"), "-k", "1"], ["--tikz", str(files / "t")]):
        assert main(["search_scheme", *args], spark) == 0
    assert "pigeon - " in capsys.readouterr().out
    assert main(["search_scheme", "-g", "none"], spark) == 1


def test_errors(spark, files, capsys):
    assert main(["search", "-q", str(files / "q.fa"), "-i", str(files / "nothing")], spark) == 1
    assert "no valid index" in capsys.readouterr().err
