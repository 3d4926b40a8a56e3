"""Quality rules by distribution divergence (DataFrame functions only).

Every document has a histogram of character classes and of its language's common words, which are the words that most of the
language's documents in the corpus hold. References are the pooled histograms of each language over the whole corpus. A document whose Jensen-Shannon distance to its language's reference
is larger than sampling noise at its length explains is not kept; documents too short to judge keep the base verdict.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import broadcast_if, stage

WORD, GAP = "[^\\x20\\x09-\\x0D]+", "[\\x20\\x09-\\x0D]+"
CHAR_CLASSES = ("lower", "upper", "digit", "mark", "other", "space")
N_WORDS = 16
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
#: Distances allowed: a constant plus a share of the noise, which falls with the square root of what was counted.
CHAR_LIMIT, WORD_LIMIT, CHAR_NOISE, WORD_NOISE = 0.18, 0.20, 1.1, 1.1
#: Minimum lengths of the method: documents with fewer words, or languages whose reference has fewer words, tell too little of
#: a distribution to be judged by divergence, and keep the base verdict. So a verdict can change once a language is large enough.
GUARD_WORDS, GUARD_REFERENCE = 80, 2_000
#: Rows, one a language, that may be broadcast, by count.
BROADCAST_ROWS = 100_000


def common_words(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """common_lang, listed: the N_WORDS words that most documents of each language hold, in order; ties by the word."""
    words = F.filter(F.array_distinct(F.split(F.lower(F.col(text_col).cast("string")), "[^\\p{L}]+", -1)), lambda w: w != "")
    rows = docs.filter(F.col(lang_col).isNotNull()).select(F.col(lang_col).cast("string").alias("common_lang"), F.explode(words).alias("w"))
    counts = rows.groupBy("common_lang", "w").agg(F.count(F.lit(1)).alias("n"))
    # Each task keeps its first ones of a language, so that few rows meet.
    first = counts.withColumn("k", F.row_number().over(Window.partitionBy("common_lang").orderBy(F.desc("n"), "w"))).filter(F.col("k") <= N_WORDS)
    return first.groupBy("common_lang").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "w"))), lambda x: x["w"]).alias("listed"))


def features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """doc_id, lang, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, chars and words histograms."""
    common = broadcast_if(stage(common_words(docs, text_col, lang_col)), BROADCAST_ROWS)
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), F.col(lang_col).cast("string").alias("lang"))
    text, listed = F.col("text"), F.col("listed")
    base = base.join(common, F.col("lang") == F.col("common_lang"), "left")
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))
    # Lower-case letters and white space are most of a text: other classes are counted in what is left without them.
    one = base.select(
        "doc_id", "lang", F.regexp_extract_all(text, F.lit(WORD), F.lit(0)).alias("w"), lines.alias("lines"),
        F.when(listed.isNotNull(), F.split(F.lower(text), "[^\\p{L}]+", -1)).alias("runs"), "listed",
        F.length(text).cast("long").alias("n_chars"), F.regexp_replace(text, "[a-z\\x20\\x09-\\x0D]+", "").alias("rest"),
    )
    n = F.size("w")
    count = lambda other: F.length(F.regexp_replace("rest", other, "")).cast("long")
    # Three words: 64-bit hashes. Where none is there twice, which one pass over a hash set tells, nothing repeats.
    hashes = F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.xxhash64(F.get("w", i), F.get("w", i + 1), F.get("w", i + 2)))
    two = one.select(
        "doc_id", "lang", "lines", "listed", "runs", "n_chars", n.cast("long").alias("n_words"), F.length(F.array_join("w", "")).cast("long").alias("word_chars"),
        count("[^#*$%&|<>]+").alias("n_symbols"), count("[^A-Z]+").alias("upper"), count("[^0-9]+").alias("digit"), count("[^!-/:-@\\[-`{-~]+").alias("mark"),
        count("[\\x00-\\x7f]+").alias("other"), F.when(n >= 4, hashes).otherwise(F.array().cast("array<bigint>")).alias("h"),
    )
    # Else hashes are sorted with their places, so that equal windows stand side by side.
    placed = F.sort_array(F.transform("h", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    two = two.withColumn("s", F.when(F.size(F.array_distinct("h")) < F.size("h"), placed).otherwise(F.array().cast("array<struct<h:bigint,i:int>>")))
    same = lambda x, j: F.coalesce(F.get("s", j)["h"] == x["h"], F.lit(False))
    twice = F.filter("s", lambda x, j: F.when(j > 0, same(x, j - 1)).otherwise(F.lit(False)) | same(x, j + 1))
    three = two.withColumn("p", F.transform(twice, lambda x: x["i"]))
    shifted = lambda k: F.transform("p", lambda x: x + k)
    covered = F.when(F.size("p") == 0, F.lit(0)).otherwise(F.size(F.array_union(F.array_union("p", shifted(1)), shifted(2))))
    lower = F.col("word_chars") - F.col("upper") - F.col("digit") - F.col("mark") - F.col("other")
    hist = F.transform("listed", lambda x: (F.size("runs") - F.size(F.array_remove("runs", x))).cast("long"))
    # A language with fewer words than that has zeros for the others.
    hist = F.concat(hist, F.array_repeat(F.lit(0).cast("long"), N_WORDS - F.size("listed")))
    four = three.withColumn("hist", hist)
    common = F.aggregate("hist", F.lit(0).cast("long"), lambda a, x: a + x)
    return four.select(
        "doc_id", "lang", "n_words", "word_chars", "n_symbols", (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        covered.cast("long").alias("n_repeat_words"), F.array(lower, "upper", "digit", "mark", "other", F.col("n_chars") - F.col("word_chars")).alias("chars"),
        F.when(F.col("listed").isNotNull(), F.concat("hist", F.array(F.greatest(F.col("n_words") - common, F.lit(0).cast("long"))))).alias("words"),
    )


def fractions(counts: Column) -> Column:
    """Counts as shares of their sum; null if there is nothing to count."""
    total = F.aggregate(counts, F.lit(0.0), lambda a, x: a + x)
    return F.when(total > 0, F.transform(counts, lambda x: x / total))


def js_distance(p: Column, q: Column) -> Column:
    """Square root of the Jensen-Shannon divergence (base 2) of two arrays of shares; 0 if either is null."""
    side = lambda x, y: F.when(x > 0, x * F.log2(2 * x / (x + y))).otherwise(0.0)
    total = F.aggregate(F.zip_with(p, q, lambda x, y: side(x, y) + side(y, x)), F.lit(0.0), lambda a, x: a + x)
    return F.coalesce(F.sqrt(F.greatest(total / 2, F.lit(0.0))), F.lit(0.0))


def judge_quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """One row per row of docs: doc_id, n_words, the four base counts, base_failed, kept, char_distance, word_distance.

    Null lang has no reference and keeps the base verdict, as do documents and languages below the guards. Null and empty
    texts have no words and fail the base rules. Texts are whole however long; repeated rows give repeated results, and count
    each time in the references; other columns of docs are ignored; an empty table gives no rows.
    """
    f = stage(features(docs, id_col, text_col, lang_col))
    passed = (F.col("n_words") >= MIN_WORDS) & (100 * F.col("n_repeat_words") <= MAX_REPEAT_PERCENT * F.col("n_words"))
    sums = [F.sum(F.get("chars", i)).alias(f"c{i}") for i in range(len(CHAR_CLASSES))] + [F.sum(F.get("words", i)).alias(f"w{i}") for i in range(N_WORDS + 1)]
    # One row per language: partial sums in every task, a few rows shuffled.
    refs = f.filter(passed & F.col("lang").isNotNull()).groupBy("lang").agg(F.sum("n_words").alias("ref_n"), *sums)
    refs = refs.select(F.col("lang").alias("ref_lang"), "ref_n", F.array(*[f"c{i}" for i in range(len(CHAR_CLASSES))]).alias("ref_chars"), F.array(*[f"w{i}" for i in range(N_WORDS + 1)]).alias("ref_words"))
    judged = f.join(refs, F.col("lang") == F.col("ref_lang"), "left")
    n = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    shares = [fractions(F.col(c)).alias(c) for c in ("chars", "words", "ref_chars", "ref_words")]
    both = judged.select(*[c for c in judged.columns if c not in ("chars", "words", "ref_chars", "ref_words")], *shares)
    both = both.withColumns({"char_distance": js_distance(F.col("chars"), F.col("ref_chars")), "word_distance": js_distance(F.col("words"), F.col("ref_words"))})
    near = (F.col("char_distance") <= CHAR_LIMIT + CHAR_NOISE / F.sqrt(5 * n)) & (F.col("word_distance") <= WORD_LIMIT + WORD_NOISE / F.sqrt(n))
    guarded = (F.col("n_words") < GUARD_WORDS) | (F.coalesce(F.col("ref_n"), F.lit(0)) < GUARD_REFERENCE)
    return both.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", (~passed).alias("base_failed"), (passed & (guarded | near)).alias("kept"), "char_distance", "word_distance")


def calibrated_limits(docs: DataFrame, labels: DataFrame, keep: float = 0.999, id_col: str = "doc_id", label_col: str = "quality") -> tuple[float, float]:
    """(CHAR_LIMIT, WORD_LIMIT) at which the share `keep` of the documents labelled 1 that can be judged stays."""
    judged = judge_quality(docs).filter(f"not base_failed and n_words >= {GUARD_WORDS}").join(labels.filter(F.col(label_col) == 1).select(F.col(id_col).alias("doc_id")), "doc_id")
    n = F.col("n_words").cast("double")
    return tuple(judged.agg(F.percentile(F.col("char_distance") - CHAR_NOISE / F.sqrt(5 * n), keep), F.percentile(F.col("word_distance") - WORD_NOISE / F.sqrt(n), keep)).first())
