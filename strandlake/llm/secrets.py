"""Secret scan with corpus-wide ownership frequency (DataFrame functions only).

Patterns propose candidates in every whole text. Each candidate value is hashed, and hashes are counted over distinct
repositories and owners: a value that many owners hold is a widely copied example, one that stays with few owners and
looks live is a credential. Base patterns are always reported; owner-specific live-looking opaque values are added.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import broadcast_if, stage

# The base patterns, in their order.
ASSIGN = "(?i)(password|passwd|secret|token|api_?key)[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
ACCESS = "AKIA[A-Z0-9]{14,}"
HEX = "[0-9a-f]{16,}"
# Opaque candidates: long runs of credential characters.
OPAQUE = "[A-Za-z0-9+/_-]{20,}"
KINDS = ("assign", "access", "hex", "opaque")
MIN_ASSIGN = 12
#: A value held by at most this many distinct owners and repositories is owner-specific.
MAX_OWNERS, MAX_REPOS = 2, 2
#: Hashes of widely copied values that may be broadcast, by count; beyond it they are joined by a shuffle.
BROADCAST_ROWS = 400_000
#: Distinct characters that a live-looking value has at least.
MIN_DISTINCT = 10
#: Matches of a text whose places are summed up together.
BLOCK = 128


def _let(value: Column, body) -> Column:
    """body(value), with value evaluated once: what a lambda takes from outside it would be evaluated for every element."""
    return F.transform(F.array(value), body)[0]


def _before(values: Column, plus, zero: Column) -> Column:
    """array<bigint>: for each of values, those before it taken together by plus, which is associative.

    An array grows by copying, so one of n places would cost n squared: blocks of BLOCK values grow for themselves, from what
    the blocks before them come to.
    """

    def grow(items: Column, first: Column) -> Column:
        start = F.struct(first.alias("at"), F.array().cast("array<bigint>").alias("out"))
        return F.aggregate(items, start, lambda acc, x: F.struct(plus(acc["at"], x).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out")))["out"]

    last = lambda v: F.floor((F.size(v) - 1) / BLOCK).cast("int")
    cut = lambda v: F.transform(F.sequence(F.lit(0), F.greatest(last(v), F.lit(0))), lambda b: F.slice(v, b * BLOCK + 1, BLOCK))
    firsts = lambda blocks: grow(F.transform(blocks, lambda v: F.aggregate(v, zero, plus)), zero)
    return _let(values, lambda v: _let(cut(v), lambda blocks: F.flatten(F.zip_with(blocks, firsts(blocks), grow))))


def _spans(text: Column, pattern: str, group: int = 0) -> Column:
    """array<struct<start,end,value>> of all leftmost non-overlapping matches, in code points.

    The text between matches comes from split, the matches from regexp_extract_all; running lengths give positions.
    """
    parts = F.split(text, pattern, -1)
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    value = found if group == 0 else F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    zero = F.lit(0).cast("long")

    def placed(steps: Column) -> Column:
        widths = F.transform(steps, lambda x: (F.length(x["gap"]) + F.coalesce(F.length(x["hit"]), F.lit(0))).cast("long"))
        row = lambda x, at: F.struct((at + F.length(x["gap"])).alias("start"), (at + F.length(x["gap"]) + F.length(x["hit"])).alias("end"), x["value"].alias("value"))
        return F.filter(F.zip_with(steps, _before(widths, lambda a, b: a + b, zero), row), lambda s: s["end"].isNotNull())

    empty = F.array().cast("array<struct<start:bigint,end:bigint,value:string>>")
    return F.when(text.rlike(pattern), _let(F.arrays_zip(parts.alias("gap"), found.alias("hit"), value.alias("value")), placed)).otherwise(empty)


def _apart(spans: Column, base: Column) -> Column:
    """Those of spans that overlap none of base: by rising place, no base span that begins before their end ends after their start."""
    ends = F.transform(spans, lambda s: F.struct(s["end"].alias("at"), F.lit(0).alias("side"), s["start"].alias("start"), s["end"].alias("end"), s["value"].alias("value")))
    starts = F.transform(base, lambda b: F.struct(b["start"].alias("at"), F.lit(1).alias("side"), b["start"].alias("start"), b["end"].alias("end"), F.lit(None).cast("string").alias("value")))

    def pick(events: Column) -> Column:
        reach = _before(F.transform(events, lambda e: e["side"] * e["end"]), lambda a, b: F.greatest(a, b), F.lit(0).cast("long"))
        kept = F.filter(F.zip_with(events, reach, lambda e, r: F.struct(e.alias("e"), r.alias("r"))), lambda x: (x["e"]["side"] == 0) & (x["r"] <= x["e"]["start"]))
        return F.transform(kept, lambda x: F.struct(x["e"]["start"].alias("start"), x["e"]["end"].alias("end"), x["e"]["value"].alias("value")))

    return F.when(F.size(spans) == 0, spans).otherwise(_let(F.array_sort(F.concat(ends, starts)), pick))


def _digest(spans: Column) -> Column:
    """kind:start:end by start, then kind as listed, comma-joined. spans: array<struct<start,k,end>>."""
    kind = lambda s: F.element_at(F.array(*[F.lit(k) for k in KINDS]), s["k"] + 1)
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", kind(s), s["start"].cast("string"), s["end"].cast("string"))), ",")


def _keyed(spans: Column, k: int) -> Column:
    return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.lit(k).alias("k"), s["end"].alias("end")))


def looks_live(value: Column) -> Column:
    """Letters and digits, and enough distinct characters."""
    return value.rlike("[0-9]") & value.rlike("[A-Za-z]") & (F.size(F.array_distinct(F.split(value, ""))) >= MIN_DISTINCT)


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", repo_col: str = "source", owner_col: str | None = None, max_owners: int = MAX_OWNERS, max_repos: int = MAX_REPOS) -> DataFrame:
    """One row per row of docs: doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_owned, n_copied.

    spans holds the base spans and the added ones (opaque values of few owners that look live and overlap no base span);
    n_owned and n_copied count all candidate spans, base ones too, whose value is owner-specific and live-looking, or
    widely copied. Without owner_col the repository counts as the owner; a null repository or owner is one unknown owner.
    Null and empty texts have no spans; texts are whole however long; repeated rows give repeated results; other columns of
    docs are ignored; an empty table gives no rows.
    """
    owner = F.col(owner_col or repo_col)
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), F.coalesce(F.col(repo_col).cast("string"), F.lit("")).alias("repo"), F.coalesce(owner.cast("string"), F.lit("")).alias("owner"))
    text = F.col("text")
    found = base.select(
        "doc_id", "repo", "owner",
        F.filter(_spans(text, ASSIGN, 2), lambda s: F.length(s["value"]) >= MIN_ASSIGN).alias("assign"),
        _spans(text, ACCESS).alias("access"),
        _spans(text, HEX).alias("hex"),
        F.filter(_spans(text, OPAQUE), lambda s: looks_live(s["value"])).alias("opaque"),
    )
    found = found.withColumn("base", F.concat(_keyed(F.col("assign"), 0), _keyed(F.col("access"), 1), _keyed(F.col("hex"), 2)))
    found = found.withColumn("opaque", _apart(F.col("opaque"), F.col("base")))
    hashed = lambda c, k: F.transform(F.col(c), lambda s: F.struct(s["start"].alias("start"), F.lit(k).alias("k"), s["end"].alias("end"), F.sha2(s["value"].cast("binary"), 256).alias("hash"), looks_live(s["value"]).alias("live")))
    narrow = stage(
        found.select(
            F.monotonically_increasing_id().alias("rid"), "doc_id", "repo", "owner", "base",
            F.concat(*[hashed(c, k) for k, c in enumerate(KINDS)]).alias("candidates"),
        )
    )
    each = narrow.filter(F.size("candidates") > 0).select("rid", "repo", "owner", F.explode("candidates").alias("c")).select("rid", "repo", "owner", "c.*")
    # Distinct (hash, repo, owner) first: a value in very many documents shrinks to its owners before it is counted.
    holders = each.select("hash", "repo", "owner").distinct()
    owners = holders.select("hash", "owner").distinct().groupBy("hash").agg(F.count(F.lit(1)).alias("n_owners"))
    repos = holders.select("hash", "repo").distinct().groupBy("hash").agg(F.count(F.lit(1)).alias("n_repos"))
    # Values that many hold are few; all other values are owner-specific. So a value in very many documents, which is one of
    # the few, is not shuffled with all its documents.
    wide = stage(owners.join(repos, "hash").filter((F.col("n_owners") > max_owners) | (F.col("n_repos") > max_repos)).select("hash"))
    wide = broadcast_if(wide, BROADCAST_ROWS).withColumn("wide", F.lit(True))
    judged = each.join(wide, "hash", "left").withColumn("few", F.col("wide").isNull())
    per_doc = judged.groupBy("rid").agg(
        F.count_if(F.col("few") & F.col("live")).alias("n_owned"),
        F.count_if(~F.col("few")).alias("n_copied"),
        F.collect_list(F.when(F.col("few") & F.col("live") & (F.col("k") == 3), F.struct("start", "k", "end"))).alias("added"),
    )
    count = lambda k: F.size(F.filter("base", lambda s: s["k"] == k)).cast("long")
    added = F.coalesce(F.col("added"), F.array().cast("array<struct<start:bigint,k:int,end:bigint>>"))
    return narrow.join(per_doc, "rid", "left").select(
        "doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
        F.sha2(_digest(F.col("base")).cast("binary"), 256).alias("base_sha256"),
        _digest(F.concat(F.col("base"), added)).alias("spans"),
        F.coalesce("n_owned", F.lit(0)).cast("long").alias("n_owned"), F.coalesce("n_copied", F.lit(0)).cast("long").alias("n_copied"),
    )
