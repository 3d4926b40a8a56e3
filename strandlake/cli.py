"""Command line: python -m strandlake COMMAND. Thirteen commands over FASTA files, indexes and search schemes.

Indexes are folders of Parquet tables named after the input; hits are written as text lines `query seq pos`.
"""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import kmer
from .operators.index import build_index, search_index, statistics
from .operators.search import expand_strands, limit_queries, prepare, strand_counts
from .operators.simulate import simulate_reads
from .operators.suffix import export_suffix_arrays
from .plans import schemes
from .shared import drop_stage
from .sources.fasta import read_fasta, write_fasta
from .sources.tables import Report, observed_stage, read_meta, write_counted_hits, write_hits

#: Index commands: (alphabet, kind, ending of the index's folder).
INDEXES = {"index": ("dna5", "bi", ".idx"), "uni-index": ("dna5", "uni", ".single.idx"), "rbi-index": ("dr_dna5", "rbi", ".rbi.idx"), "rbi-index-dna4": ("dr_dna4", "rbi", ".rbi4.idx")}
OUTPUT = "hits.txt"


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="strandlake", description=__doc__.splitlines()[0])
    sub = top.add_subparsers(dest="command", required=True)
    for name in INDEXES:
        p = sub.add_parser(name, help=f"build an index ({INDEXES[name][0]})")
        p.add_argument("fasta")
        p.add_argument("--ignore_unknown", action="store_true", help="replace unknown symbols")
        if name == "index":
            p.add_argument("--dna4", action="store_true", help="letters A C G T only")
    for name in ("search", "uni-search", "rbi-search", "rbi-search-dna4"):
        p = sub.add_parser(name, help="search queries in an index")
        p.add_argument("-q", "--query", required=True)
        p.add_argument("-i", "--index", required=True)
        p.add_argument("-o", "--output", default=OUTPUT)
        if name == "uni-search":
            p.add_argument("--no-reverse", action="store_true")
            continue
        p.add_argument("-g", "--generator", default="h2-k2", help="search scheme that chooses the seeds")
        p.add_argument("--dynamic_generator", action="store_true", help="report costs with part sizes chosen by weighted node count; hits are the same")
        p.add_argument("-e", "--errors", type=int, default=0)
        p.add_argument("-m", "--search_mode", choices=["all", "besthits"], default="all")
        p.add_argument("--max_hits", type=int, default=0)
        if name == "search":
            p.add_argument("-d", "--distance-metric", choices=["ham", "lev"], default="lev")
            p.add_argument("--no-reverse", action="store_true")
            p.add_argument("--limit_queries", type=int)
        if name == "rbi-search-dna4":
            p.add_argument("--ignore_unknown", action="store_true")
    p = sub.add_parser("kmer-index", help="build a k-mer sketch index")
    p.add_argument("fasta")
    p.add_argument("--ignore_unknown", action="store_true")
    p.add_argument("--kmer", type=int, default=1)
    p.add_argument("--kmer_mode", choices=kmer.KMER_MODES, default="winnowing")
    p.add_argument("--window", type=int, default=1)
    p.add_argument("--mod", type=int, default=4)
    p = sub.add_parser("kmer-search", help="search queries in a k-mer sketch index")
    p.add_argument("--query", required=True)
    p.add_argument("--index", required=True)
    p.add_argument("--output", default=OUTPUT)
    p.add_argument("--no-reverse", action="store_true")
    p = sub.add_parser("search_scheme", help="figures and exports of search schemes")
    p.add_argument("action", nargs="?", choices=["list-generators"])
    p.add_argument("-g", "--generator", default="pigeon")
    p.add_argument("-l", "--length", type=int, default=150)
    p.add_argument("--ref-length", type=float, default=1e9)
    p.add_argument("--min-error", type=int, default=0)
    p.add_argument("-k", "--max-error", type=int, default=2)
    p.add_argument("--sigma", type=int, default=4)
    p.add_argument("-a", "--all", action="store_true")
    p.add_argument("-y", "--yaml", action="store_true")
    p.add_argument("--columba")
    p.add_argument("--tikz")
    p.add_argument("--expansion_mode", default="uniform")
    p = sub.add_parser("read_simulator", help="simulate reads")
    p.add_argument("-i", "--input")
    p.add_argument("-o", "--output", required=True)
    p.add_argument("--fasta_line_length", type=int, default=80)
    p.add_argument("-l", "--read_length", type=int, default=150)
    p.add_argument("-n", "--number_of_reads", type=int, default=1000)
    p.add_argument("--substitution_errors", type=int, default=0)
    p.add_argument("--insertion_errors", type=int, default=0)
    p.add_argument("--deletion_errors", type=int, default=0)
    p.add_argument("-e", "--errors", type=int, default=0)
    p.add_argument("--seed", type=int, default=0)
    p = sub.add_parser("columba_prepare", help="write the joined text and its suffix arrays")
    p.add_argument("-i", "--input", required=True)
    p.add_argument("-o", "--output", required=True)
    return top


def _queries(spark: SparkSession, path: str) -> DataFrame:
    return read_fasta(spark, path, "src_id")


def _index(spark: SparkSession, a: argparse.Namespace) -> None:
    alphabet, kind, ending = INDEXES[a.command]
    if getattr(a, "dna4", False):
        alphabet, ending = "dna4", ".dna4.idx"
    report = Report()
    with report.phase("build"):
        meta = build_index(read_fasta(spark, a.fasta), a.fasta + ending, alphabet, kind, a.ignore_unknown)
    print(f"file: {a.fasta}\nreferences: {meta['n_seqs']}\ntotal size: {meta['total_size']}\nindex: {a.fasta + ending}\nseconds: {report.total():.2f}")


def _search(spark: SparkSession, a: argparse.Namespace) -> None:
    report = Report()
    errors, exact = getattr(a, "errors", 0), a.command == "uni-search"
    kind = {"search": "bi", "uni-search": "uni"}.get(a.command, "rbi")
    meta = read_meta(spark, a.index, kind)
    mode = "best" if getattr(a, "search_mode", "all") == "besthits" else "all"
    metric = "hamming" if getattr(a, "distance_metric", "lev") == "ham" else "edit"
    reverse = not getattr(a, "no_reverse", kind == "rbi")
    limit, top = getattr(a, "limit_queries", None), getattr(a, "max_hits", 0)
    with report.phase("load queries"):
        queries = _queries(spark, a.query)
        own = limit_queries(expand_strands(queries, reverse), limit)
        counts = strand_counts(own).first()
    print(f"query: {a.query}\nindex: {a.index}\nerrors: {errors}\nreverse complements: {reverse}\nsearch mode: {mode}\nmax hits: {top}\noutput: {a.output}\nforward queries: {counts.forward}\nbackward queries: {counts.backward}")
    scheme = None
    if not exact:
        scheme = schemes.generate(a.generator, 0, errors)
        length = max(len(queries.first().seq), len(scheme[0].pi))
        letters, sizes = schemes.expand_by(scheme, length, "topdown" if a.dynamic_generator else "uniform", meta["sigma"], float(meta["total_size"]), metric == "edit")
        cost = letters if metric == "edit" else schemes.limit_to_hamming(letters)
        print(f"partition: {sizes}\nnode count: {schemes.node_count(cost, meta['sigma'], metric == 'edit'):.0f}\nweighted node count: {schemes.node_count(cost, meta['sigma'], metric == 'edit', float(meta['total_size'])):.0f}")
    ignore = getattr(a, "ignore_unknown", False)
    with report.phase("search"):
        hits, figures = observed_stage(search_index(spark, a.index, queries, errors, metric, mode, top, reverse, limit, ignore, scheme), hits=F.count(F.lit(1)))
    with report.phase("result"):
        write_hits(hits, a.output)
    for name, s in report.phases:
        print(f"{name}: {s:.2f}s")
    print(f"total: {report.total():.2f}s\nqueries per second: {(counts.forward + counts.backward) / report.total():.0f}\nhits: {figures['hits']}")
    drop_stage(hits)


def _kmer_index(spark: SparkSession, a: argparse.Namespace) -> None:
    refs = prepare(read_fasta(spark, a.fasta), "dna5", a.ignore_unknown)
    meta = kmer.build_kmer_index(refs, a.fasta + ".kmer.idx", a.kmer, a.kmer_mode, a.window, a.mod)
    facts = statistics(refs).first()
    print(f"references: {facts.n_seqs}\ntotal size: {facts.total_size}\nk-mer mode: {a.kmer_mode}\ndifferent k-mers: {meta['largest_value']}\nindex: {a.fasta}.kmer.idx")


def _kmer_search(spark: SparkSession, a: argparse.Namespace) -> None:
    meta = read_meta(spark, a.index, "kmer")
    queries = prepare(_queries(spark, a.query), "dna5")
    rows = kmer.admit(queries, spark.read.parquet(f"{a.index}/dictionary"), meta["k"], meta["mode"], meta["window"], meta["mod_exp"])
    print("\n".join(f"{k}: {v}" for k, v in kmer.admission_report(rows).first().asDict().items()))
    print(f"hits: {write_counted_hits(kmer.kmer_search(spark, a.index, queries, not a.no_reverse), a.output)}")


def _schemes(spark: SparkSession, a: argparse.Namespace) -> None:
    figures = {"length": a.length, "sigma": a.sigma, "ref_len": a.ref_length}
    if a.action:
        print("\n".join(f"{n} - {d}" for n, (d, _) in schemes.GENERATORS.items()))
    elif a.all and a.columba:
        print("\n".join(schemes.to_columba(a.columba, a.min_error, a.max_error)))
    elif a.all and a.yaml:
        print(schemes.to_yaml(a.min_error, a.max_error, mode=a.expansion_mode, **figures), end="")
    elif a.all:
        schemes.schemes_table(spark, a.min_error, a.max_error, dynamic=True, **figures).orderBy("position").show(100, False)
    elif a.tikz:
        print("\n".join(schemes.write_tikz(a.tikz, schemes.generate(a.generator, a.min_error, a.max_error), a.length)))
    else:
        d = schemes.describe(a.generator, a.min_error, a.max_error, mode=a.expansion_mode, dynamic=True, **figures)
        for k, v in d.items():
            if k in ("scheme", "expanded", "hamming"):
                print(f"{k}:")
                for s in v:
                    print(f"  {list(s.pi)} {list(s.l)} {list(s.u)}")
            else:
                print(f"{k}: {v}")


def _simulate(spark: SparkSession, a: argparse.Namespace) -> None:
    refs = read_fasta(spark, a.input) if a.input else None
    reads = simulate_reads(spark, refs, a.number_of_reads, a.read_length, a.substitution_errors, a.insertion_errors, a.deletion_errors, a.errors, a.seed)
    write_fasta(reads, a.output, a.fasta_line_length)


def _columba(spark: SparkSession, a: argparse.Namespace) -> None:
    export_suffix_arrays(read_fasta(spark, a.input), a.output)


COMMANDS = {**dict.fromkeys(INDEXES, _index), **dict.fromkeys(("search", "uni-search", "rbi-search", "rbi-search-dna4"), _search), "kmer-index": _kmer_index, "kmer-search": _kmer_search, "search_scheme": _schemes, "read_simulator": _simulate, "columba_prepare": _columba}


def main(args: list[str] | None = None, spark: SparkSession | None = None) -> int:
    """Run one command; errors are printed and give exit code 1."""
    a = parser().parse_args(args)
    try:
        COMMANDS[a.command](spark or SparkSession.builder.appName("strandlake").getOrCreate(), a)
    except Exception as e:  # any failure of a command ends it with one line and code 1
        print(f"error: {e}", file=sys.stderr)
        return 1
    return 0
