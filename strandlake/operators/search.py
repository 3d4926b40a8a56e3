"""Substring joins between queries and references: exact, Hamming, edit; all hits, best stratum, top n.

A query of m letters with at most k errors, cut into k+1 parts, has a part that is intact. Parts' first letters are seeds,
which meet the references' grams in an equi-join; candidates are verified by distance. Hits are a set keyed by (query_id,
seq_id, pos) with the least errors; reference engines may report an edit hit more than once or leave out starts that begin
with a gap.

Best hits are sought by rising errors: candidates of queries that have a hit already are not verified with more.

Two plans give the same hits. If the seeds are small by count (`BROADCAST_SEEDS`), they are broadcast, and references
stream past them: nothing of the references is shuffled, and candidates are verified where the sequence is at hand. If not,
narrow gram rows (gram, seq_id, pos) and seeds are shuffled by gram, and sequences join the candidates last.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.alphabet import normalise, replace_unknown, require_valid, reverse_complement
from ..functions.distance import edit, hamming
from ..functions.kmers import slices
from ..plans.planner import seed_regions
from ..plans.schemes import Scheme
from ..shared import Stages
from .align import alignments, least_errors

#: Gram lengths: a query takes the longest that its seeds reach. Few lengths mean few passes over the references, so those
#: that are selective enough are cut to the shortest of them.
GRAMS, SELECTIVE = (1, 2, 4, 8, 12, 16, 20, 24, 32), 16
BROADCAST_SEEDS = 50_000
#: Longer sequences are cut into chunks of this many letters, which overlap by the longest query and the errors.
CHUNK = 1_000_000
#: Queries with fewer letters than errors + 1 have no seed; so many different ones are held against every place at once.
SHORT_BATCH = 500
METRICS, MODES = ("hamming", "edit"), ("all", "best")


def prepare(seqs: DataFrame, alphabet: str = "dna5", ignore_unknown: bool = False, seed: int = 0, check: bool = True) -> DataFrame:
    """Sequences in the letters of an alphabet; unknown symbols are replaced or raise an error with their place."""
    key = "seq_id" if "seq_id" in seqs.columns else "src_id"
    name = F.col("id") if "id" in seqs.columns else F.col(key).cast("string")
    if ignore_unknown:
        return seqs.withColumn("seq", replace_unknown(F.col("seq"), alphabet, F.col(key), seed))
    return seqs.withColumn("seq", require_valid(F.col("seq"), name, F.col(key), alphabet) if check else normalise(F.col("seq"), alphabet))


def expand_strands(queries: DataFrame, reverse: bool = True) -> DataFrame:
    """query_id, src_id, strand, seq: forward is 2*src_id, reverse complement 2*src_id+1; src_id itself without reverse."""
    if not reverse:
        return queries.select(F.col("src_id").cast("long").alias("query_id"), F.col("src_id").cast("long").alias("src_id"), F.lit(0).cast("tinyint").alias("strand"), "seq")
    both = F.array(F.struct(F.lit(0).cast("tinyint").alias("strand"), F.col("seq").alias("seq")), F.struct(F.lit(1).cast("tinyint").alias("strand"), reverse_complement(F.col("seq")).alias("seq")))
    return queries.select(F.col("src_id").cast("long").alias("src_id"), F.explode(both).alias("x")).select((2 * F.col("src_id") + F.col("x.strand")).cast("long").alias("query_id"), "src_id", "x.strand", "x.seq")


def limit_queries(queries: DataFrame, n: int | None) -> DataFrame:
    """The first n queries, counted after strands were expanded."""
    return queries if n is None else queries.filter(F.col("query_id") < n)


def strand_counts(queries: DataFrame) -> DataFrame:
    return queries.agg(F.count_if(F.col("strand") == 0).alias("forward"), F.count_if(F.col("strand") == 1).alias("backward"))


def seeds(queries: DataFrame, errors: int, scheme: Scheme | None = None) -> DataFrame:
    """query_id, seq, gram length g, seed (its first g letters), its offset in the query.

    Seeds are the regions that some search of the scheme wants free of errors (of k+1 parts, each one, if no scheme is
    given); queries with fewer letters than the scheme has parts take the k+1 parts.
    """
    plan, parts = seed_regions(scheme) if scheme else ([(j, j + 1) for j in range(errors + 1)], errors + 1)
    out = _seeds(queries.filter(F.length("seq") >= parts), plan, parts)
    if parts > errors + 1:
        out = out.union(_seeds(queries.filter(F.length("seq") < parts), [(j, j + 1) for j in range(errors + 1)], errors + 1))
    return out


def _seeds(queries: DataFrame, regions: list[tuple[int, int]], parts: int, lengths: tuple[int, ...] = GRAMS) -> DataFrame:
    m = F.length("seq")
    start = lambda i: (i * F.floor(m / parts) + F.least(F.lit(i), m % parts)).cast("int")
    spans = F.array(*[F.struct(start(a).alias("offset"), (start(b) - start(a)).alias("n")) for a, b in regions])

    def length(n) -> F.Column:
        g = F.lit(0)
        for x in lengths:
            g = F.when(n >= x, x).otherwise(g)
        return g

    cut = lambda at, g: F.substring(F.col("seq").cast("binary"), at + 1, g)
    each = F.transform(spans, lambda x: F.struct(x["offset"].alias("offset"), length(x["n"]).alias("g"), cut(x["offset"], length(x["n"])).alias("gram")))
    return queries.select("query_id", "seq", F.explode(each).alias("x")).select("query_id", "seq", "x.g", "x.offset", "x.gram").filter("g > 0")


def _one_pass(own: DataFrame) -> tuple[DataFrame, list[int]]:
    """Seeds with their selective lengths made one, and the lengths that are left."""
    lengths = sorted(r.g for r in own.select("g").distinct().collect())
    shortest = min((g for g in lengths if g >= SELECTIVE), default=0)
    long = F.col("g") > shortest if shortest else F.lit(False)
    own = own.withColumn("gram", F.when(long, F.substring("gram", 1, shortest or 1)).otherwise(F.col("gram"))).withColumn("g", F.when(long, shortest).otherwise(F.col("g")))
    return own, [g for g in lengths if g <= shortest or not shortest]


def grams(refs: DataFrame, g: int, keep_seq: bool = False) -> DataFrame:
    """gram, seq_id, p (and the sequence) of every place; slices are taken from bytes."""
    more = ["base"] if "base" in refs.columns else []
    if not keep_seq:
        return slices(refs, g, "seq_id", *more).select(F.col("slice").alias("gram"), "seq_id", *more, "p")
    rows = refs.filter(F.length("seq") >= g).select("seq_id", *more, F.col("seq").cast("binary").alias("b"), F.explode(F.sequence(F.lit(0), F.length("seq") - g)).alias("p"))
    return rows.select(F.substring("b", F.col("p") + 1, F.lit(g)).alias("gram"), "seq_id", *more, "p", "b")


def chunked(refs: DataFrame, overlap: int) -> DataFrame:
    """seq_id, base, seq: sequences in chunks that begin at `base` and reach `overlap` letters into the next one."""
    starts = F.sequence(F.lit(0), F.greatest(F.length("seq") - 1, F.lit(0)), F.lit(CHUNK))
    rows = refs.select("seq_id", "seq", F.explode(F.when(F.length("seq") <= CHUNK, F.array(F.lit(0))).otherwise(starts)).alias("base"))
    piece = F.when(F.length("seq") <= CHUNK, F.col("seq")).otherwise(F.substring(F.col("seq").cast("binary"), F.col("base") + 1, F.lit(CHUNK + overlap)).cast("string"))
    return rows.select("seq_id", F.col("base").cast("long").alias("base"), piece.alias("seq"))


def _verify(candidates: DataFrame, errors: int, metric: str) -> DataFrame:
    """Hits among candidates (query_id, seq, seq_id, pos, b, and base where b is a chunk that begins there)."""
    base = F.col("base") if "base" in candidates.columns else F.lit(0)
    pos, m = F.col("pos"), F.length("seq")
    if metric == "hamming":
        inside = candidates.filter((pos >= 0) & (pos + m <= F.length("b")))
        distance = F.lit(0) if errors == 0 else hamming(F.col("seq"), F.col("b"), pos, errors)
        if errors == 0:
            inside = inside.filter(F.substring("b", pos + 1, m) == F.col("seq").cast("binary"))
    else:
        inside = candidates.filter((pos >= 0) & (pos < F.length("b")))
        distance = edit(F.col("seq"), F.col("b"), pos, errors)
    # Not named pos at once: inside the distance's lambdas, pos would then be the new column.
    hits = inside.select("query_id", "seq_id", (pos + base).cast("long").alias("place"), distance.cast("int").alias("errors"))
    return hits.filter(F.col("errors") <= errors).withColumnRenamed("place", "pos")


def _windows(refs: DataFrame, own: DataFrame, g: int, errors: int, metric: str, small: bool) -> DataFrame:
    """query_id, seq, seq_id, base, at, b: for each seed's place, letters b of the sequence from `base` on, in which the query would start at `at`.

    For edit distance the letters reach far enough for all starts and ends within `errors`.
    """
    own = own.filter(F.col("g") == g)
    if small:
        near = grams(refs, g, keep_seq=True).join(F.broadcast(own), "gram").withColumn("at", F.col("p") - F.col("offset"))
    else:
        narrow = grams(refs, g).join(own.select("gram", "query_id", "offset"), "gram").select("query_id", "seq_id", "base", (F.col("p") - F.col("offset")).alias("at")).distinct()
        near = narrow.join(own.select("query_id", "seq").distinct(), "query_id").join(refs.select("seq_id", "base", F.col("seq").cast("binary").alias("b")), ["seq_id", "base"])
    return cut_windows(near, errors, metric)


def cut_windows(near: DataFrame, errors: int, metric: str) -> DataFrame:
    """Of (query_id, seq, seq_id, base, at, b), only the letters that matter; rows that can't be hits go."""
    shift = errors if metric == "edit" else 0
    m, at = F.length("seq"), F.col("at")
    first = F.greatest(at - shift, F.lit(0))
    whole = near.filter((at >= 0) & (at + m <= F.length("b"))) if metric == "hamming" else near.filter(at + shift >= 0)
    cut = F.substring("b", first + 1, at + m + 2 * shift - first)
    return whole.select("query_id", "seq", "seq_id", (F.col("base") + first).cast("long").alias("base"), (at - first).cast("int").alias("at"), cut.alias("b"))


def _verify_windows(windows: DataFrame, errors: int, metric: str) -> DataFrame:
    if metric == "edit" and errors:
        return least_errors(windows, errors)
    return _verify(windows.withColumn("pos", F.explode(F.array("at")) if errors else F.col("at")), errors, "hamming")


def by_strata(queries: DataFrame, errors: int, find: Callable[[DataFrame, int], DataFrame]) -> DataFrame:
    """Best hits: find(queries, k) gives all hits of queries with up to k errors; it is asked for k = 0, 1, ... and the queries without a hit so far."""
    stages, left, out = Stages(), queries, []
    for k in range(errors + 1):
        out.append(stages.stage(find(left, k)))
        if k < errors:
            left = stages.stage(left.join(out[-1].select("query_id").distinct(), "query_id", "left_anti"))
            if left.isEmpty():
                break
    return reduce(DataFrame.union, out)


def verify_candidates(starts: DataFrame, refs: DataFrame, queries: DataFrame, errors: int, metric: str) -> DataFrame:
    """Late materialisation: narrow candidates meet queries and sequences last."""
    key = ["seq_id", "base"] if "base" in starts.columns else ["seq_id"]
    wide = starts.join(queries.select("query_id", "seq"), "query_id").join(refs.select(*key, F.col("seq").cast("binary").alias("b")), key)
    return _verify(wide, errors, metric)


def _short(refs: DataFrame, queries: DataFrame, errors: int, metric: str) -> DataFrame | None:
    """Queries of at most `errors` letters, of which there are few different ones, held against every place in batches.

    Their hits then go to all queries of those letters; in edit distance nearly every place is one.
    """
    few = queries.filter(F.length("seq").between(1, errors))
    texts = sorted(r.seq for r in few.select("seq").distinct().collect())
    if not texts:
        return None
    places = refs.filter(F.length("seq") > 0).select("seq_id", F.col("seq").cast("binary").alias("b"), "base", F.explode(F.sequence(F.lit(0), F.length("seq") - 1)).alias("pos"))
    parts = []
    for a in range(0, len(texts), SHORT_BATCH):
        held = F.array(*[F.struct(F.lit(a + i).cast("long").alias("query_id"), F.lit(s).alias("seq")) for i, s in enumerate(texts[a : a + SHORT_BATCH])])
        parts.append(_verify(places.select("seq_id", "base", "b", "pos", F.inline(held)), errors, metric))
    number = F.array_position(F.array(*[F.lit(s) for s in texts]), F.col("seq")) - 1
    own = few.select("query_id", number.alias("text_id"))
    hits = reduce(DataFrame.union, parts).withColumnRenamed("query_id", "text_id")
    return hits.join(own, "text_id").select("query_id", "seq_id", "pos", "errors")


def search(refs: DataFrame, queries: DataFrame, errors: int = 0, metric: str = "edit", mode: str = "all", max_hits: int = 0, broadcast: bool | None = None, scheme: Scheme | None = None) -> DataFrame:
    """query_id, seq_id, pos, errors of all hits of queries (query_id, seq) in refs (seq_id, seq), both in one alphabet.

    mode best keeps each query's lowest error count (strands are queries of their own); max_hits keeps at most that many
    hits per query, in the order errors, seq_id, pos. Empty queries have no hits. A complete scheme may choose the seeds; hits are
    the same with any.
    """
    if metric not in METRICS or mode not in MODES or errors < 0 or max_hits < 0:
        raise ValueError(f"metric must be of {METRICS}, mode of {MODES}; errors and max_hits must not be negative")
    metric = "hamming" if errors == 0 else metric
    own, lengths = _one_pass(seeds(queries, errors, scheme))
    longest = queries.agg(F.max(F.length("seq"))).first()[0] or 0
    refs = chunked(refs, longest + errors)
    small = own.limit(BROADCAST_SEEDS + 1).count() <= BROADCAST_SEEDS if broadcast is None else broadcast
    short = _short(refs, queries, errors, metric) if errors else None
    least = lambda parts: reduce(DataFrame.union, parts).groupBy("query_id", "seq_id", "pos").agg(F.min("errors").alias("errors"))
    parts = [_windows(refs, own, g, errors, metric, small) for g in lengths]
    if parts and mode == "best" and errors:
        windows = Stages().stage(reduce(DataFrame.union, parts))
        asked = windows.select("query_id").distinct()
        found = [by_strata(asked, errors, lambda left, k: least([_verify_windows(windows.join(left.select("query_id"), "query_id", "left_semi"), k, metric)]))]
    else:
        found = [_verify_windows(w, errors, metric) for w in parts]
    found += [short] if short is not None else []
    if not found:
        hits = refs.sparkSession.createDataFrame([], "query_id long, seq_id long, pos long, errors int")
    else:
        hits = least(found)
    return select_hits(hits, mode, max_hits)


def search_alignments(refs: DataFrame, queries: DataFrame, errors: int) -> DataFrame:
    """query_id, seq_id, pos, end, errors, transcript: every start and end of a reference that a query fits with at most `errors` edits.

    Queries must have more letters than `errors`; shorter ones, which fit nearly everywhere, have no rows.
    """
    own, lengths = _one_pass(seeds(queries.filter(F.length("seq") > errors), errors))
    if not lengths:
        return refs.sparkSession.createDataFrame([], "query_id long, seq_id long, pos long, end long, errors int, transcript string")
    refs = chunked(refs, (queries.agg(F.max(F.length("seq"))).first()[0] or 0) + 2 * errors)
    small = own.limit(BROADCAST_SEEDS + 1).count() <= BROADCAST_SEEDS
    return alignments(reduce(DataFrame.union, [_windows(refs, own, g, errors, "edit", small) for g in lengths]), errors)


def select_hits(hits: DataFrame, mode: str = "all", max_hits: int = 0) -> DataFrame:
    """Best stratum, then top n. A minimum per query joined back, so that no window gathers all hits of a query."""
    if mode == "best":
        least = hits.groupBy("query_id").agg(F.min("errors").alias("errors"))
        hits = hits.join(least, ["query_id", "errors"]).select("query_id", "seq_id", "pos", "errors")
    if max_hits:
        w = Window.partitionBy("query_id").orderBy("errors", "seq_id", "pos")
        hits = hits.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= max_hits).drop("rank")
    return hits


def search_exact(refs: DataFrame, queries: DataFrame) -> DataFrame:
    """query_id, seq_id, pos of exact occurrences, overlapping ones too."""
    return search(refs, queries, 0).select("query_id", "seq_id", "pos")


def search_collapsed(refs: DataFrame, queries: DataFrame, errors: int = 0, mode: str = "all", max_hits: int = 0, alphabet: str = "dr_dna5", verify: bool = False) -> DataFrame:
    """Edit hits in the collapsed alphabet. No reverse-complement queries: the collapse makes them reverses.

    Hits are a superset of the hits in full letters; verify keeps those that hold there too.
    """
    folded = lambda df: df.withColumn("seq", normalise(F.col("seq"), alphabet))
    if not verify:
        return search(folded(refs), folded(queries), errors, "edit", mode, max_hits)
    hits = search(folded(refs), folded(queries), errors, "edit")
    return select_hits(verify_candidates(hits.select("query_id", "seq_id", "pos"), refs, queries, errors, "edit"), mode, max_hits)


def hits_per_query(hits: DataFrame) -> DataFrame:
    return hits.groupBy("query_id").agg(F.count(F.lit(1)).alias("n_hits"))
