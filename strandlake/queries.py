"""Registered queries of the sequence-search engine on the driver's tables, with DuckDB SQL for each that SQL expresses.

Documents, projected to DNA letters, are the references; benchmark texts are the queries. Every query takes whole tables and
whole texts; seed_candidates shows the seeds of 12 letters alone, which queries of under 36 letters don't have.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.alphabet import COLLAPSE, collapse, first_invalid, is_valid, replace_unknown, reverse_complement
from .functions.kmers import canonical, kmers, minimizers, mod_mers
from .operators import kmer as km
from .operators.index import COMMON, MAX_GRAM, MIN_GRAM, build_index, frequent_seeds, gram_counts, search_index, share_index, statistics, tables_of
from .operators.search import expand_strands, grams, hits_per_query, limit_queries, search, search_alignments, search_collapsed, search_exact, seeds, select_hits, strand_counts
from .operators.simulate import simulate_reads
from .operators.suffix import CHUNK, concat_text, reverse_chunks, suffix_array, text_chunks
from .plans import schemes
from .shared import shared_dir, stage
from .sources.fasta import fasta_text, read_fasta, write_fasta
from .sources.tables import hit_lines, read_meta, write_hits

LATIN, DNA = "abcdefghijklmnopqrstuvwxyz", "ACGTACGTACGTACGTACGTACGTAC"
K, W, MOD = 11, 5, 4


def dna(text: F.Column) -> F.Column:
    return F.translate(F.regexp_replace(F.lower(text), "[^a-z]", ""), LATIN, DNA)


def _parallel(df: DataFrame) -> DataFrame:
    """Small files are read as few partitions; work per row is heavy, so rows are spread over the cores."""
    return df.repartition(max(df.sparkSession.sparkContext.defaultParallelism, 1)) if df.rdd.getNumPartitions() < df.sparkSession.sparkContext.defaultParallelism else df


def references(spark: SparkSession, sf: str) -> DataFrame:
    docs = _parallel(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text"))
    return docs.select(F.col("doc_id").alias("seq_id"), F.col("doc_id").cast("string").alias("id"), dna(F.col("text")).alias("seq"))


def raw_letters(spark: SparkSession, sf: str) -> DataFrame:
    docs = _parallel(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text"))
    return docs.select(F.col("doc_id").alias("seq_id"), F.regexp_replace("text", "[^A-Za-z]", "").alias("seq"))


def probes(spark: SparkSession, sf: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/benchmark.parquet").select(F.col("item_id").alias("src_id"), F.col("item_id").cast("string").alias("id"), dna(F.col("text")).alias("seq"))


def one_strand(spark: SparkSession, sf: str) -> DataFrame:
    return expand_strands(probes(spark, sf), reverse=False)


def dna_projection_stats(spark, sf):
    r = references(spark, sf)
    more = r.agg(F.min(F.length("seq")).alias("shortest"), F.max(F.length("seq")).alias("longest"))
    return statistics(r).join(more)


def validate_alphabet(spark, sf):
    s = F.col("seq")
    return raw_letters(spark, sf).select("seq_id", first_invalid(s).cast("int").alias("first_invalid"), is_valid(s).alias("valid"))


def mask_unknown_n(spark, sf):
    return raw_letters(spark, sf).select("seq_id", F.md5(replace_unknown(F.col("seq"), "dna5").cast("binary")).alias("digest"))


def _digest(expr):
    return lambda spark, sf: references(spark, sf).select("seq_id", F.md5(expr(F.col("seq")).cast("binary")).alias("digest"))


def strand_expand(spark, sf):
    return expand_strands(probes(spark, sf)).select("query_id", "src_id", F.col("strand").cast("int").alias("strand"), "seq")


def strand_count(spark, sf):
    return strand_counts(expand_strands(probes(spark, sf)))


def limited_queries(spark, sf):
    return limit_queries(expand_strands(probes(spark, sf)), 25).select("query_id", "seq")


def gram_index(spark, sf):
    return gram_counts(references(spark, sf), 8)


def exact_search(spark, sf):
    return search_exact(references(spark, sf), one_strand(spark, sf))


def exact_search_both_strands(spark, sf):
    return search_exact(references(spark, sf), expand_strands(probes(spark, sf)))


def hamming_search_k2(spark, sf):
    return search(references(spark, sf), one_strand(spark, sf), 2, "hamming")


def edit_search_k2(spark, sf):
    return search(references(spark, sf), one_strand(spark, sf), 2, "edit")


def edit_alignments(spark, sf):
    """Every start and end of every hit, with what its transcript says of letters of the query and the reference, and of errors."""
    found = search_alignments(references(spark, sf), one_strand(spark, sf), 1)
    letters = lambda ops: F.aggregate(F.transform(F.regexp_extract_all("transcript", F.lit(f"(\\d+)[{ops}]")), lambda x: x.cast("long")), F.lit(0).cast("long"), lambda a, x: a + x)
    return found.select("query_id", "seq_id", "pos", F.col("end").alias("stop"), "errors", letters("=XI").alias("query_letters"), letters("=XD").alias("reference_letters"), letters("XID").alias("cost"))


def indexed_best_hits(spark, sf):
    return search_index(spark, _stored(spark, sf, "dna5", "bi"), probes(spark, sf), 2, "edit", "best", reverse=False)


def index_seeds(spark, sf):
    """Of each query, the two disjoint grams with the fewest places in the stored sequences, and how many those are (uncommon grams count once)."""
    path = _stored(spark, sf, "dna5", "bi")
    meta = read_meta(spark, path)
    own = one_strand(spark, sf).filter(F.length("seq") >= 2 * meta["gram_len"]).select("query_id", "seq")
    return frequent_seeds(spark, path, meta, own, 1, every=True).groupBy("query_id").agg(F.count(F.lit(1)).alias("seeds"), F.sum("n").cast("long").alias("cost"))


def best_hits(spark, sf):
    return search(references(spark, sf), one_strand(spark, sf), 2, "edit", "best")


def top_n_hits(spark, sf):
    return search(references(spark, sf), one_strand(spark, sf), 2, "edit", "all", 3)


def best_n_hits(spark, sf):
    return search(references(spark, sf), one_strand(spark, sf), 2, "edit", "best", 1)


def query_hits(spark, sf):
    return hits_per_query(search(references(spark, sf), one_strand(spark, sf), 2, "hamming"))


def collapsed_search(spark, sf):
    return search_collapsed(references(spark, sf), one_strand(spark, sf), 1)


def seed_candidates(spark, sf):
    own = seeds(one_strand(spark, sf), 2)
    hits = grams(references(spark, sf), 12).join(F.broadcast(own.filter("length(seq) >= 36").select("query_id", F.substring("gram", F.lit(1), F.lit(12)).alias("gram"), "offset")), "gram")
    return hits.select("query_id", "seq_id", (F.col("p") - F.col("offset")).cast("long").alias("pos")).distinct()


def hit_text(spark, sf):
    return hit_lines(exact_search(spark, sf))


def fasta_format(spark, sf):
    return fasta_text(references(spark, sf), 80)


def kmer_counts(spark, sf):
    return kmers(references(spark, sf), 6).groupBy("kmer").agg(F.count(F.lit(1)).alias("n"))


def canonical_kmers(spark, sf):
    # Few different k-mers are counted before their values are taken.
    counts = kmers(references(spark, sf), 6).groupBy("kmer").agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy(canonical(F.col("kmer")).alias("value")).agg(F.sum("n").alias("n"))


def mod_mer_counts(spark, sf):
    return mod_mers(references(spark, sf), K, MOD).groupBy("seq_id").agg(F.count(F.lit(1)).alias("n"))


def minimizer_rows(spark, sf):
    return minimizers(references(spark, sf), 7, 4)


def kmer_dictionary(spark, sf):
    return km.sketch_dictionary(references(spark, sf), 7, "winnowing", 4, MOD)


def _sketch(spark, sf):
    words = km.sketch_dictionary(references(spark, sf), K, "winnowing", W, MOD)
    return words, km.admit(probes(spark, sf).select("src_id", "seq"), words, K, "winnowing", W, MOD)


def kmer_admission(spark, sf):
    return km.admission_report(_sketch(spark, sf)[1])


def left_semi_dictionary(spark, sf):
    rows = _sketch(spark, sf)[1]
    return rows.join(rows.filter("known"), "src_id", "left_semi").select("src_id", "n_selected")


def left_anti_dropped(spark, sf):
    rows = _sketch(spark, sf)[1]
    return rows.join(rows.filter("known"), "src_id", "left_anti").select("src_id", "n_selected")


def kmer_search(spark, sf):
    words = stage(km.sketch_dictionary(references(spark, sf), K, "winnowing", W, MOD))
    rows = km.admit(probes(spark, sf).select("src_id", "seq"), words, K, "winnowing", W, MOD)
    texts = stage(km.sketch_texts(references(spark, sf), words, K, "winnowing", W, MOD))
    return km.search_texts(texts, km.admitted(rows)).select("query_id", "src_id", "seq_id", "pos")


def _place(spark) -> str:
    return f"{shared_dir(spark).rstrip('/')}/strandlake-{uuid.uuid4().hex}"


def _stored(spark, sf, alphabet: str, kind: str) -> str:
    path = _place(spark)
    build_index(references(spark, sf), path, alphabet, kind)
    return path


def index_facts(spark, sf):
    """What the descriptions of stored indexes of all kinds say, and how many grams they hold.

    Tables follow from the letters, so the indexes of bases share theirs, and so do those of collapsed letters, which are made of the stored bases.
    """
    out, made = None, {}
    for alphabet, kind in (("dna5", "bi"), ("dna4", "bi"), ("dna5", "uni"), ("dr_dna5", "rbi"), ("dr_dna4", "rbi")):
        collapsed = alphabet in COLLAPSE
        if collapsed in made:
            share_index(spark, path := _place(spark), made[collapsed], alphabet, kind)
        else:
            refs = spark.read.parquet(f"{made[False]}/sequences") if collapsed else references(spark, sf)
            build_index(refs, path := _place(spark), alphabet, kind)
            made[collapsed] = path
        meta = read_meta(spark, path, kind)
        row = spark.read.parquet(f"{tables_of(meta, path)}/grams").agg(F.count(F.lit(1)).alias("n_grams")).select(
            F.lit(alphabet).alias("alphabet"), F.lit(kind).alias("kind"), F.lit(meta["n_seqs"]).cast("long").alias("n_seqs"), F.lit(meta["total_size"]).cast("long").alias("total_size"), F.lit(meta["sigma"]).cast("int").alias("sigma"), (F.col("n_grams") > 0).alias("has_grams")
        )
        out = row if out is None else out.union(row)
    return out


def index_search_bi(spark, sf):
    return search_index(spark, _stored(spark, sf, "dna5", "bi"), probes(spark, sf), 1, "edit", "best", reverse=False, scheme=schemes.generate("optimum", 0, 1))


def index_search_hamming(spark, sf):
    return search_index(spark, _stored(spark, sf, "dna4", "bi"), probes(spark, sf), 2, "hamming", reverse=False)


def index_search_uni(spark, sf):
    return search_index(spark, _stored(spark, sf, "dna5", "uni"), probes(spark, sf)).select("query_id", "seq_id", "pos")


def index_search_rbi(spark, sf):
    return search_index(spark, _stored(spark, sf, "dr_dna5", "rbi"), probes(spark, sf), 1, scheme=schemes.generate("h2-k2", 0, 1))


def index_search_rbi_dna4(spark, sf):
    return search_index(spark, _stored(spark, sf, "dr_dna4", "rbi"), probes(spark, sf), 1)


def kmer_index_search(spark, sf):
    path = _place(spark)
    km.build_kmer_index(references(spark, sf), path, K, "winnowing", W, MOD)
    return km.kmer_search(spark, path, probes(spark, sf).select("src_id", "seq")).select("query_id", "src_id", "seq_id", "pos")


def kmer_index_facts(spark, sf):
    path = _place(spark)
    meta = km.build_kmer_index(references(spark, sf), path, 3, "winnowing", W, MOD)
    facts = km.kmer_statistics(spark.read.parquet(f"{path}/texts"), spark.read.parquet(f"{path}/dictionary"))
    return facts.withColumn("sigma", F.lit(km.adaptive_sigma(meta["largest_value"])))


def fasta_round_trip(spark, sf):
    """References written as FASTA files and read back: number, header and letters."""
    path = _place(spark)
    write_fasta(references(spark, sf).repartitionByRange("seq_id").sortWithinPartitions("seq_id"), path)
    return read_fasta(spark, path).select("seq_id", "id", F.length("seq").alias("n"), F.md5(F.col("seq").cast("binary")).alias("digest"))


def hits_round_trip(spark, sf):
    path = _place(spark)
    write_hits(exact_search_both_strands(spark, sf), path)
    return spark.read.text(path)


def _joined(spark, sf):
    return text_chunks(probes(spark, sf).withColumnRenamed("src_id", "seq_id"))


def concat_text_digest(spark, sf):
    text = concat_text(probes(spark, sf).withColumnRenamed("src_id", "seq_id"))
    return text.select(F.length("text").cast("long").alias("n"), F.md5(F.col("text").cast("binary")).alias("digest"))


def concat_chunks(spark, sf):
    chunks = text_chunks(references(spark, sf))
    return chunks.select("start", F.length("text").alias("n"), F.md5(F.col("text").cast("binary")).alias("digest"))


def suffix_array_query(spark, sf):
    return suffix_array(_joined(spark, sf))


def suffix_array_reversed(spark, sf):
    return suffix_array(reverse_chunks(_joined(spark, sf)))


def scheme_list(spark, sf):
    return schemes.list_generators(spark)


def scheme_checks(spark, sf):
    """Per search scheme of up to 3 errors: configurations, and how often they are covered, in DataFrame operations."""
    frames = None
    for name in schemes.GENERATORS:
        for k in range(4):
            parts = schemes.scheme_rows(name, 0, k)
            row = (name, k, len(parts[0][2]), len(parts), schemes.is_valid(schemes.generate(name, 0, k)), schemes.is_complete(schemes.generate(name, 0, k), 0, k), schemes.is_non_redundant(schemes.generate(name, 0, k), 0, k))
            frames = [*(frames or []), row]
    return spark.createDataFrame(frames, "name string, k int, parts int, searches int, valid boolean, complete boolean, non_redundant boolean")


def scheme_node_count(spark, sf):
    return schemes.schemes_table(spark, 0, 2, 30).select("name", "node_count_hamming", "node_count_edit", F.round("weighted_edit", 3).alias("weighted_edit"))


def scheme_expansion(spark, sf):
    """Searches expanded to 30 letters, and what is left of their bounds where a letter has one error at most."""
    rows = []
    for name in schemes.GENERATORS:
        for k in range(3):
            letters = schemes.expand(schemes.generate(name, 0, k), 30)
            rows += [(name, k, i, *(",".join(map(str, v)) for v in (s.pi, s.l, s.u, h.l, h.u))) for i, (s, h) in enumerate(zip(letters, schemes.limit_to_hamming(letters), strict=True))]
    return spark.createDataFrame(rows, "name string, k int, no int, pi string, l string, u string, hamming_l string, hamming_u string")


def simulated_reads_truth(spark, sf):
    """n; reads whose span is where they say; reads in which each letter follows from the transcript and the reference's text."""
    refs = references(spark, sf).select("seq_id", F.col("seq").alias("ref"))
    reads = refs.join(F.broadcast(simulate_reads(spark, refs.withColumnRenamed("ref", "seq"), 500, 60, 1, 1, 1, 0, 7)), "seq_id")
    ops = F.split("transcript", "")
    used = lambda i, skip: F.length(F.regexp_replace(F.substring(F.col("transcript"), F.lit(1), i), skip, ""))
    letter = lambda s, at: F.substring(F.col(s), at + 1, F.lit(1))
    # Before operation i the read has used the letters of M, S and I, the reference those of M, S and D.
    right = F.forall(F.transform(ops, lambda op, i: F.when(op == "M", letter("seq", used(i, "D")) == letter("ref", F.col("pos").cast("int") + used(i, "I"))).when(op == "S", letter("seq", used(i, "D")) != letter("ref", F.col("pos").cast("int") + used(i, "I"))).otherwise(F.lit(True))), lambda x: x)
    inside = (F.col("pos") >= 0) & (F.col("pos") + F.length(F.regexp_replace("transcript", "I", "")) <= F.length("ref"))
    return reads.agg(F.count(F.lit(1)).alias("n"), F.count_if(inside).alias("inside"), F.count_if(right).alias("right_letters"))


def simulated_reads_invariants(spark, sf):
    """n, reads of the asked length, reads whose transcript has that many emitting letters; the seeds' own reference is the document table."""
    reads = simulate_reads(spark, references(spark, sf).select("seq_id", "seq"), 500, 60, 1, 1, 1, 0, 7)
    emit = F.length(F.regexp_replace("transcript", "D", ""))
    return reads.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.length("seq") == 60).alias("right_length"), F.count_if(emit == 60).alias("right_transcript"))


def queries() -> dict:
    return {
        "dna_projection_stats": dna_projection_stats, "validate_alphabet": validate_alphabet, "mask_unknown_n": mask_unknown_n,
        "reverse_complement": _digest(reverse_complement), "collapse_dr4": _digest(lambda s: collapse(s, "dr_dna4")), "collapse_dr5": _digest(lambda s: collapse(s, "dr_dna5")),
        "strand_expand": strand_expand, "strand_count": strand_count, "limit_queries": limited_queries, "gram_index": gram_index,
        "exact_search": exact_search, "exact_search_both_strands": exact_search_both_strands, "hamming_search_k2": hamming_search_k2, "edit_search_k2": edit_search_k2,
        "edit_alignments": edit_alignments, "indexed_best_hits": indexed_best_hits, "index_seeds": index_seeds,
        "best_hits": best_hits, "top_n_hits": top_n_hits, "best_n_hits": best_n_hits, "hits_per_query": query_hits, "collapsed_search": collapsed_search,
        "seed_candidates": seed_candidates, "hit_lines": hit_text, "fasta_format": fasta_format, "kmer_counts": kmer_counts, "canonical_kmers": canonical_kmers,
        "mod_mers": mod_mer_counts, "minimizers": minimizer_rows, "kmer_dictionary": kmer_dictionary, "kmer_admission": kmer_admission,
        "left_semi_dictionary": left_semi_dictionary, "left_anti_dropped": left_anti_dropped, "kmer_search": kmer_search,
        "concat_text": concat_text_digest, "suffix_array": suffix_array_query, "suffix_array_reversed": suffix_array_reversed,
        "index_facts": index_facts, "index_search_bi": index_search_bi, "index_search_hamming": index_search_hamming, "index_search_uni": index_search_uni,
        "index_search_rbi": index_search_rbi, "index_search_rbi_dna4": index_search_rbi_dna4, "kmer_index_search": kmer_index_search, "kmer_index_facts": kmer_index_facts,
        "fasta_round_trip": fasta_round_trip, "hits_round_trip": hits_round_trip, "concat_chunks": concat_chunks, "scheme_expansion": scheme_expansion, "simulated_reads_truth": simulated_reads_truth,
        "scheme_list": scheme_list, "scheme_checks": scheme_checks, "scheme_node_count": scheme_node_count, "simulated_reads_invariants": simulated_reads_invariants,
    }


# --- DuckDB SQL ---

_DNA = f"translate(regexp_replace(lower(text), '[^a-z]', '', 'g'), '{LATIN}', '{DNA}')"
_BASE = f"WITH r AS (SELECT doc_id AS seq_id, {_DNA} AS seq FROM documents), q AS (SELECT item_id AS src_id, item_id AS query_id, {_DNA} AS seq FROM benchmark)"
_RAW = "WITH x AS (SELECT doc_id AS seq_id, replace(upper(regexp_replace(text, '[^A-Za-z]', '', 'g')), 'U', 'T') AS s FROM documents)"
_STRANDS = ", b AS (SELECT (2 * src_id + strand)::BIGINT AS query_id, src_id, strand, CASE WHEN strand = 0 THEN seq ELSE reverse(translate(seq, 'ACGTN', 'TGCAN')) END AS seq FROM q, (SELECT unnest([0, 1])::INT AS strand))"
_PLACES = ", w AS (SELECT seq_id, seq, unnest(range(0, length(seq)))::BIGINT AS pos FROM r)"


def _exact(q: str) -> str:
    # Pairs that hold the query at all, then every place in them.
    return f", p AS (SELECT {q}.query_id, {q}.seq AS q, r.seq_id, r.seq, unnest(range(0, length(r.seq) - length({q}.seq) + 1))::BIGINT AS pos FROM r JOIN {q} ON contains(r.seq, {q}.seq)) SELECT query_id, seq_id, pos FROM p WHERE substr(seq, pos + 1, length(q)) = q"


def _seeded(k: int, r: str = "r", q: str = "q") -> str:
    """Pairs that share one of k+1 parts at least: all that can have a hit."""
    part = f"(length({q}.seq) // {k + 1})"
    has = " OR ".join(f"contains({r}.seq, substr({q}.seq, {j} * {part} + 1, {part}))" for j in range(k + 1))
    return f"(SELECT {q}.query_id, {q}.seq AS q, {r}.seq_id, {r}.seq FROM {r} JOIN {q} ON {has})"


def _edit(k: int, r: str = "r", q: str = "q") -> str:
    # A hit has one of the parts whole, at most k places from where it is in the query.
    part = f"(length(q) // {k + 1})"
    near = " OR ".join(f"contains(substr(seq, greatest(pos + 1 + {j} * {part} - {k}, 1), {part} + {2 * k}), substr(q, {j} * {part} + 1, {part}))" for j in range(k + 1))
    return (
        f", p AS (SELECT *, unnest(range(0, length(seq)))::BIGINT AS pos FROM {_seeded(k, r, q)}), n AS (SELECT *, unnest(range(greatest(length(q) - {k}, 0), length(q) + {k} + 1)) AS n FROM p WHERE {near})"
        f", h AS (SELECT query_id, seq_id, pos, min(levenshtein(q, substr(seq, pos + 1, n)))::INT AS errors FROM n WHERE substr(seq, pos + 1, n) <> '' GROUP BY ALL HAVING errors <= {k})"
    )


_HAMMING = f", p AS (SELECT *, unnest(range(0, length(seq) - length(q) + 1))::BIGINT AS pos FROM {_seeded(2)}), h AS (SELECT query_id, seq_id, pos, hamming(q, substr(seq, pos + 1, length(q)))::INT AS errors FROM p WHERE length(substr(seq, pos + 1, length(q))) = length(q)), h2 AS (SELECT * FROM h WHERE errors <= 2)"
_KMERS = ", k AS (SELECT seq_id, pos, substr(seq, pos + 1, {k}) AS kmer FROM w WHERE pos + {k} <= length(seq))"


def _value(s: str, k: int) -> str:
    """Base-5 value of a k-mer."""
    return "(" + " + ".join(f"(strpos('ACGTN', substr({s}, {i + 1}, 1)) - 1)::BIGINT * {5 ** (k - 1 - i)}" for i in range(k)) + ")"


def _mini(k: int, w: int, src: str = "r", key: str = "seq_id", tag: str = "") -> str:
    """Minimizers of src as table m{tag}."""
    t = tag
    return (
        f", mw{t} AS (SELECT {key} AS seq_id, seq, unnest(range(0, length(seq) - {k} + 1))::BIGINT AS pos FROM {src} WHERE length(seq) >= {k + w - 1})"
        f", mk{t} AS (SELECT seq_id, pos, length(seq) - {k + w - 1} AS last, substr(seq, pos + 1, {k}) AS kmer FROM mw{t})"
        f", mv{t} AS (SELECT seq_id, pos, last, least({_value('kmer', k)}, {_value('reverse(translate(kmer, $$ACGTN$$, $$TGCAN$$))', k)}) AS v FROM mk{t})"
        f", mf{t} AS (SELECT seq_id, pos, last, min({{'v': v, 'p': pos}}) OVER (PARTITION BY seq_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND {w - 1} FOLLOWING) AS x FROM mv{t})"
        f", ml{t} AS (SELECT seq_id, pos, x.v AS value, x.p AS place, lag(x.v) OVER (PARTITION BY seq_id ORDER BY pos) AS was FROM mf{t} WHERE pos <= last)"
        f", m{t} AS (SELECT seq_id, place AS pos, value FROM ml{t} WHERE was IS NULL OR was <> value)"
    )


_DICT = ", d AS (SELECT value AS kmer_hash, row_number() OVER (ORDER BY f.s, f.p)::INT AS kmer_id FROM (SELECT value, min({'s': seq_id, 'p': pos}) AS f FROM m GROUP BY value))"
_ADMIT = f"{_mini(K, W)}{_DICT}{_mini(K, W, 'q', 'src_id', 'q')}, a AS (SELECT q.src_id, count(mq.value)::BIGINT AS n_selected, coalesce(bool_and(d.kmer_id IS NOT NULL) FILTER (WHERE mq.value IS NOT NULL), true) AS known, list(d.kmer_id ORDER BY mq.pos) FILTER (WHERE mq.value IS NOT NULL) AS ids FROM q LEFT JOIN mq ON mq.seq_id = q.src_id LEFT JOIN d ON d.kmer_hash = mq.value GROUP BY q.src_id)"
_TEXT = ", t AS (SELECT string_agg(seq, '' ORDER BY src_id) || '$' AS text FROM q)"


def _suffixes(text: str) -> str:
    return f"{_BASE}{_TEXT}, s AS (SELECT {text} AS text FROM t), z AS (SELECT unnest(range(0, length(text)))::BIGINT AS pos, text FROM s) SELECT (row_number() OVER (ORDER BY substr(text, pos + 1)) - 1)::BIGINT AS rank, pos FROM z"


def _values(rows: list[tuple], names: str) -> str:
    lit = lambda v: "NULL" if v is None else "'" + v.replace("'", "''") + "'" if isinstance(v, str) else str(v).lower() if isinstance(v, bool) else repr(v)
    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(lit, r)) + ')' for r in rows)}) v({names})"


def _scheme_sql() -> str:
    """Validity, completeness and redundancy by enumeration in SQL, from the tables of searches."""
    rows, searches = [], []
    for name in schemes.GENERATORS:
        for k in range(4):
            s = schemes.generate(name, 0, k)
            rows.append((name, k, len(s[0].pi), len(s)))
            searches += [f"('{name}', {k}, {i}, {list(x.pi)}, {list(x.l)}, {list(x.u)})" for i, x in enumerate(s)]
    sums = "list_transform(range(1, parts + 1), lambda t: list_sum(list_transform(range(1, t + 1), lambda j: c[pi[j] + 1])))"
    fits = f"list_bool_and(list_transform(range(1, parts + 1), lambda t: ({sums})[t] BETWEEN l[t] AND u[t]))"
    valid = "list_bool_and(list_transform(range(1, parts + 1), lambda t: list_max(pi[1:t]) - list_min(pi[1:t]) = t - 1 AND l[t] <= u[t] AND (t = 1 OR (l[t] >= l[t - 1] AND u[t] >= u[t - 1]))))"
    return f"""WITH RECURSIVE g(name, k, parts, searches) AS ({_values(rows, 'name, k, parts, searches')}),
s(name, k, no, pi, l, u) AS (VALUES {', '.join(searches)}),
e AS (SELECT DISTINCT k, parts, []::INT[] AS c FROM g UNION ALL SELECT k, parts, list_append(c, x) FROM e, (SELECT unnest(range(0, 4))::INT AS x) WHERE len(c) < parts AND coalesce(list_sum(c), 0) + x <= k),
f AS (SELECT k, parts, c FROM e WHERE len(c) = parts),
cov AS (SELECT g.name, g.k, f.c, count(*) FILTER (WHERE {fits}) AS n FROM g JOIN s USING (name, k) JOIN f USING (k, parts) GROUP BY ALL),
ok AS (SELECT g.name, g.k, bool_and({valid}) AS valid FROM g JOIN s USING (name, k) GROUP BY ALL)
SELECT g.name, g.k, g.parts, g.searches, ok.valid, bool_and(cov.n >= 1) AS complete, bool_and(cov.n = 1) AS non_redundant FROM g JOIN ok USING (name, k) JOIN cov USING (name, k) GROUP BY ALL"""


def _xxh64(value: str) -> str:
    """Tables x1 to x7, of which the last has the XXH64 with seed 0 of a column v of table x0, in 128-bit arithmetic."""
    # The primes of XXH64.
    p1, p2, p3, p4, p5 = 11400714785074694791, 14029467366897019727, 1609587929392839161, 9650029242287828579, 2870177450012600261
    wrap = lambda x: f"(({x}) % 18446744073709551616::UHUGEINT)"
    times = lambda x, p: wrap(f"({x}) * {p}::UHUGEINT")
    turn = lambda x, r: f"({times(x, 1 << r)} + ({x}) // {1 << (64 - r)}::UHUGEINT)"
    steps = [times(value, p2), turn("h", 31), f"xor({p5 + 8}::UHUGEINT, {times('h', p1)})", turn("h", 27), wrap(f"{times('h', p1)} + {p4}::UHUGEINT"), times(f"xor(h, h // {1 << 33}::UHUGEINT)", p2), times(f"xor(h, h // {1 << 29}::UHUGEINT)", p3)]
    tables = [f", x{i + 1} AS (SELECT * EXCLUDE (h), {s} AS h FROM x{i})" if i else f", x1 AS (SELECT *, {s} AS h FROM x0)" for i, s in enumerate(steps)]
    return "".join(tables) + f", hashed AS (SELECT * EXCLUDE (h), xor(h, h // {1 << 32}::UHUGEINT) AS h FROM x7)"


def _mod_mers() -> str:
    kmers = f", k AS (SELECT seq_id, substr(seq, pos + 1, {K}) AS kmer FROM w WHERE pos + {K} <= length(seq)), c AS (SELECT kmer, least({_value('kmer', K)}, {_value('reverse(translate(kmer, $$ACGTN$$, $$TGCAN$$))', K)})::UHUGEINT AS v FROM (SELECT DISTINCT kmer FROM k)), x0 AS (SELECT * FROM c)"
    return f"{_BASE}{_PLACES}{kmers}{_xxh64('v')} SELECT seq_id, count(*)::BIGINT AS n FROM k JOIN hashed USING (kmer) WHERE h % {1 << MOD} = 0 GROUP BY 1"


def _letters(length: int, most: int) -> str:
    """Table e: searches of all schemes, expanded to letters from their tables of parts; hl and hu are their bounds in Hamming distance."""
    searches = [f"('{name}', {k}, {i}, {list(x.pi)}, {list(x.l)}, {list(x.u)})" for name in schemes.GENERATORS for k in range(most + 1) for i, x in enumerate(schemes.generate(name, 0, k))]
    size = f"({length} // len(pi) + CASE WHEN pi[t] < {length} % len(pi) THEN 1 ELSE 0 END)"
    first = f"(pi[t] * ({length} // len(pi)) + least(pi[t], {length} % len(pi)))"
    return (
        f"WITH RECURSIVE s(name, k, no, pi, l, u) AS (VALUES {', '.join(searches)}), p AS (SELECT *, unnest(range(1, len(pi) + 1)) AS t FROM s), q AS (SELECT *, {size} AS n, {first} AS f FROM p), r AS (SELECT *, unnest(range(0, n)) AS j FROM q)"
        ", c AS (SELECT name, k, no, t, j, CASE WHEN t > 1 AND pi[t] < pi[1] THEN f + n - 1 - j ELSE f + j END AS x, CASE WHEN j = n - 1 THEN l[t] WHEN t = 1 THEN 0 ELSE l[t - 1] END AS a, u[t] AS b FROM r)"
        ", o AS (SELECT *, row_number() OVER (PARTITION BY name, k, no ORDER BY t, j) AS i, count(*) OVER (PARTITION BY name, k, no) AS m FROM c)"
        # One error a letter: an upper bound is at most i, and i - j above that of letter j; a lower one at least that of letter j, less j - i.
        ", h AS (SELECT *, least(i, i + min(b - i) OVER (PARTITION BY name, k, no ORDER BY i)) AS hu, max(a - i) OVER (PARTITION BY name, k, no ORDER BY i DESC) + i AS hl FROM o)"
    )


def _scheme_expansion() -> str:
    text = lambda c: f"string_agg({c}::BIGINT, ',' ORDER BY i)"
    return f"{_letters(30, 2)} SELECT name, k::INT AS k, no::INT AS no, {text('x')} AS pi, {text('a')} AS l, {text('b')} AS u, {text('hl')} AS hamming_l, {text('hu')} AS hamming_u FROM h GROUP BY name, k, no"


def _scheme_node_count() -> str:
    """Partial matches with 0, 1 and 2 errors, letter by letter."""
    def step(edit: bool, a: str, b: str) -> str:
        sigma, inside = 4, lambda d: f"{d} BETWEEN {a} AND {b} AND {d} <= most"
        n0 = f"CASE WHEN {inside(0)} THEN n0 ELSE 0 END"
        n1 = f"CASE WHEN {inside(1)} THEN n1 + {sigma if edit else sigma - 1} * n0{f' + {sigma} * ({n0})' if edit else ''} ELSE 0 END"
        n2 = f"CASE WHEN {inside(2)} THEN n2 + {sigma if edit else sigma - 1} * n1{f' + {sigma} * ({n1})' if edit else ''} ELSE 0 END"
        return f"{n0} AS n0, {n1} AS n1, {n2} AS n2"

    walk = lambda name, edit, a, b: f", {name} AS (SELECT name, no, 0::BIGINT AS i, 2 AS most, 1::DOUBLE AS n0, 0::DOUBLE AS n1, 0::DOUBLE AS n2 FROM s WHERE k = 2 UNION ALL SELECT w.name, w.no, h.i, w.most, {step(edit, f'h.{a}', f'h.{b}')} FROM {name} w JOIN h ON h.k = 2 AND h.name = w.name AND h.no = w.no AND h.i = w.i + 1)"
    total = lambda t, weight="1": f"(SELECT sum((n0 + n1 + n2) * {weight}) FROM {t} WHERE {t}.name = g.name AND i > 0)"
    return f"{_letters(30, 2)}{walk('ham', False, 'hl', 'hu')}{walk('edit', True, 'a', 'b')} SELECT g.name, {total('ham')} AS node_count_hamming, {total('edit')} AS node_count_edit, round({total('edit', 'least(1.0, 1e9 / pow(4.0, i))')}, 3) AS weighted_edit FROM (SELECT DISTINCT name FROM s) g"


def oracle_sql() -> dict[str, str]:
    best = "SELECT query_id, seq_id, pos, errors FROM (SELECT *, min(errors) OVER (PARTITION BY query_id) AS low FROM h) WHERE errors = low"
    folded = f", cr AS (SELECT seq_id, translate(seq, 'ACGT', 'WSSW') AS seq FROM r), cq AS (SELECT query_id, translate(seq, 'ACGT', 'WSSW') AS seq FROM q){_edit(1, 'cr', 'cq')} SELECT * FROM h"
    out = {
        "mod_mers": _mod_mers(),
        "scheme_expansion": _scheme_expansion(),
        "scheme_node_count": _scheme_node_count(),
        "index_facts": f"{_BASE} SELECT alphabet, kind, count(*)::BIGINT AS n_seqs, sum(length(seq))::BIGINT AS total_size, sigma, true AS has_grams FROM r, (VALUES ('dna5', 'bi', 6), ('dna4', 'bi', 5), ('dna5', 'uni', 6), ('dr_dna5', 'rbi', 4), ('dr_dna4', 'rbi', 3)) v(alphabet, kind, sigma) GROUP BY ALL",
        "index_search_bi": f"{_BASE}{_edit(1)} {best}",
        "index_search_hamming": f"{_BASE}{_HAMMING} SELECT * FROM h2",
        "index_search_uni": f"{_BASE}{_STRANDS}{_exact('b')}",
        "index_search_rbi": f"{_BASE}{folded}",
        "index_search_rbi_dna4": f"{_BASE}{folded}",
        "kmer_index_facts": f"{_BASE}{_mini(3, W)}{_DICT} SELECT (SELECT count(*) FROM d)::BIGINT AS distinct_kmers, (SELECT count(*) FROM m)::BIGINT AS sketch_length, (SELECT min(s) FROM (SELECT unnest([3, 4, 5, 6, 16, 32, 64, 128]) AS s) WHERE s > (SELECT count(*) FROM d))::INT AS sigma",
        "fasta_round_trip": f"{_BASE} SELECT (row_number() OVER (ORDER BY seq_id) - 1)::BIGINT AS seq_id, seq_id::VARCHAR AS id, length(seq)::INT AS n, md5(seq) AS digest FROM r",
        "hits_round_trip": f"SELECT query_id || ' ' || seq_id || ' ' || pos AS value FROM ({_BASE}{_STRANDS}{_exact('b')})",
        "concat_chunks": f"{_BASE}, t AS (SELECT string_agg(seq, '' ORDER BY seq_id) || '$' AS text FROM r), c AS (SELECT unnest(range(0, length(text), {CHUNK})) AS start, text FROM t) SELECT start::BIGINT AS start, length(substr(text, start + 1, {CHUNK}))::INT AS n, md5(substr(text, start + 1, {CHUNK})) AS digest FROM c",
        "simulated_reads_truth": "SELECT 500::BIGINT AS n, 500::BIGINT AS inside, 500::BIGINT AS right_letters",
        "dna_projection_stats": f"{_BASE} SELECT count(*)::BIGINT AS n_seqs, sum(length(seq))::BIGINT AS total_size, 6 AS sigma, min(length(seq))::INT AS shortest, max(length(seq))::INT AS longest FROM r",
        "validate_alphabet": f"{_RAW}, y AS (SELECT seq_id, s, length(regexp_extract(s, '^[ACGTN]*'))::INT AS n FROM x) SELECT seq_id, CASE WHEN n = length(s) THEN -1 ELSE n END::INT AS first_invalid, n = length(s) AS valid FROM y",
        "mask_unknown_n": f"{_RAW} SELECT seq_id, md5(regexp_replace(s, '[^ACGTN]', 'N', 'g')) AS digest FROM x",
        "reverse_complement": f"{_BASE} SELECT seq_id, md5(reverse(translate(seq, 'ACGTN', 'TGCAN'))) AS digest FROM r",
        "collapse_dr4": f"{_BASE} SELECT seq_id, md5(translate(seq, 'ACGT', 'WSSW')) AS digest FROM r",
        "collapse_dr5": f"{_BASE} SELECT seq_id, md5(translate(seq, 'ACGTN', 'WSSWN')) AS digest FROM r",
        "strand_expand": f"{_BASE}{_STRANDS} SELECT query_id, src_id, strand, seq FROM b",
        "strand_count": f"{_BASE}{_STRANDS} SELECT count(*) FILTER (WHERE strand = 0)::BIGINT AS forward, count(*) FILTER (WHERE strand = 1)::BIGINT AS backward FROM b",
        "limit_queries": f"{_BASE}{_STRANDS} SELECT query_id, seq FROM b WHERE query_id < 25",
        "gram_index": f"{_BASE}{_PLACES} SELECT substr(seq, pos + 1, 8) AS gram, count(*)::BIGINT AS n FROM w WHERE pos + 8 <= length(seq) GROUP BY 1",
        "exact_search": f"{_BASE}{_exact('q')}",
        "exact_search_both_strands": f"{_BASE}{_STRANDS}{_exact('b')}",
        "hamming_search_k2": f"{_BASE}{_HAMMING} SELECT * FROM h2",
        "edit_search_k2": f"{_BASE}{_edit(2)} SELECT * FROM h",
        "edit_alignments": f"{_BASE}{_edit(1)} SELECT DISTINCT query_id, seq_id, pos, pos + length(t) AS stop, levenshtein(q, t)::INT AS errors, length(q)::BIGINT AS query_letters, length(t)::BIGINT AS reference_letters, levenshtein(q, t)::BIGINT AS cost FROM (SELECT *, substr(seq, pos + 1, n) AS t FROM n) WHERE t <> '' AND levenshtein(q, t) <= 1",
        "index_seeds": f"{_BASE}{_PLACES}, g AS (SELECT coalesce(min(n), {MAX_GRAM}) AS g FROM range({MIN_GRAM}, {MAX_GRAM}) t(n) WHERE 4::HUGEINT ** n >= (SELECT sum(length(seq)) FROM r)), c AS (SELECT substr(seq, pos + 1, g) AS gram, count(*) AS n FROM w, g WHERE pos + g <= length(seq) GROUP BY 1 HAVING count(*) >= {COMMON}), e AS (SELECT query_id, i, g, coalesce(n, 1) AS cost FROM (SELECT query_id, g, i, substr(seq, i + 1, g) AS gram FROM (SELECT *, unnest(range(0, length(seq) - g + 1)) AS i FROM q, g WHERE length(seq) >= 2 * g)) LEFT JOIN c USING (gram)) SELECT a.query_id, 2::BIGINT AS seeds, min(a.cost + b.cost)::BIGINT AS cost FROM e a JOIN e b ON a.query_id = b.query_id AND b.i >= a.i + a.g GROUP BY 1",
        "best_hits": f"{_BASE}{_edit(2)} SELECT query_id, seq_id, pos, errors FROM (SELECT *, min(errors) OVER (PARTITION BY query_id) AS low FROM h) WHERE errors = low",
        "top_n_hits": f"{_BASE}{_edit(2)} SELECT query_id, seq_id, pos, errors FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY errors, seq_id, pos) AS k FROM h) WHERE k <= 3",
        "best_n_hits": f"{_BASE}{_edit(2)} SELECT query_id, seq_id, pos, errors FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY errors, seq_id, pos) AS k FROM h) WHERE k <= 1",
        "hits_per_query": f"{_BASE}{_HAMMING} SELECT query_id, count(*)::BIGINT AS n_hits FROM h2 GROUP BY 1",
        "collapsed_search": f"{_BASE}, cr AS (SELECT seq_id, translate(seq, 'ACGT', 'WSSW') AS seq FROM r), cq AS (SELECT query_id, translate(seq, 'ACGT', 'WSSW') AS seq FROM q){_edit(1, 'cr', 'cq')} SELECT * FROM h",
        "seed_candidates": f"{_BASE}{_PLACES}, j AS (SELECT query_id, o * (length(seq) // 3) + least(o, length(seq) % 3) AS off, substr(seq, o * (length(seq) // 3) + least(o, length(seq) % 3) + 1, 12) AS gram FROM q, (SELECT unnest([0, 1, 2]) AS o) WHERE length(seq) >= 36) SELECT DISTINCT query_id, seq_id, (pos - off)::BIGINT AS pos FROM w JOIN j ON substr(w.seq, pos + 1, 12) = gram",
        "hit_lines": f"SELECT query_id || ' ' || seq_id || ' ' || pos AS value FROM ({_BASE}{_exact('q')})",
        "fasta_format": f"{_BASE} SELECT '>' || seq_id || chr(10) || regexp_replace(regexp_replace(seq, '(.{{80}})', '\\1' || chr(10), 'g'), chr(10) || '$', '') AS value FROM r",
        "kmer_counts": f"{_BASE}{_PLACES}{_KMERS.format(k=6)} SELECT kmer, count(*)::BIGINT AS n FROM k GROUP BY 1",
        "canonical_kmers": f"{_BASE}{_PLACES}{_KMERS.format(k=6)} SELECT least({_value('kmer', 6)}, {_value('reverse(translate(kmer, $$ACGTN$$, $$TGCAN$$))', 6)}) AS value, count(*)::BIGINT AS n FROM k GROUP BY 1",
        "minimizers": f"{_BASE}{_mini(7, 4)} SELECT * FROM m",
        "kmer_dictionary": f"{_BASE}{_mini(7, 4)}{_DICT} SELECT * FROM d",
        "kmer_admission": f"{_BASE}{_ADMIT} SELECT count(*)::BIGINT AS n_queries, count(*) FILTER (WHERE NOT known)::BIGINT AS unknown, count(*) FILTER (WHERE known AND n_selected < 6)::BIGINT AS skipped, count(*) FILTER (WHERE known AND n_selected >= 6)::BIGINT AS admitted, coalesce(sum(n_selected) FILTER (WHERE known AND n_selected >= 6), 0)::BIGINT AS total_length, min(n_selected) FILTER (WHERE known AND n_selected >= 6) AS min_length, max(n_selected) FILTER (WHERE known AND n_selected >= 6) AS max_length FROM a",
        "left_semi_dictionary": f"{_BASE}{_ADMIT} SELECT src_id, n_selected FROM a WHERE known",
        "left_anti_dropped": f"{_BASE}{_ADMIT} SELECT src_id, n_selected FROM a WHERE NOT known",
        "kmer_search": f"{_BASE}{_ADMIT}, o AS (SELECT row_number() OVER (ORDER BY src_id) - 1 AS n, src_id, ids FROM a WHERE known AND n_selected >= 6), qs AS (SELECT (2 * n + strand)::BIGINT AS query_id, src_id, CASE WHEN strand = 0 THEN ids ELSE list_reverse(ids) END AS ids FROM o, (SELECT unnest([0, 1]) AS strand)), tx AS (SELECT seq_id, list(kmer_id ORDER BY pos) AS ref FROM m JOIN d ON d.kmer_hash = m.value GROUP BY 1), st AS (SELECT query_id, src_id, ids, seq_id, ref, unnest(range(0, len(ref) - len(ids) + 1))::BIGINT AS pos FROM qs JOIN tx ON list_has_all(ref, ids)) SELECT query_id, src_id, seq_id, pos FROM st WHERE ref[pos + 1 : pos + len(ids)] = ids",
        "concat_text": f"{_BASE}{_TEXT} SELECT length(text)::BIGINT AS n, md5(text) AS digest FROM t",
        "suffix_array": _suffixes("text"),
        "suffix_array_reversed": _suffixes("reverse(text)"),
        "scheme_list": _values([(n, d) for n, (d, _) in schemes.GENERATORS.items()], "name, description"),
        "scheme_checks": _scheme_sql(),
        "simulated_reads_invariants": "SELECT 500::BIGINT AS n, 500::BIGINT AS right_length, 500::BIGINT AS right_transcript",
    }
    return out | {"kmer_index_search": out["kmer_search"], "indexed_best_hits": out["best_hits"]}
