"""SimHash fingerprints of documents, and all fingerprints within a Hamming radius by permuted block tables (op12).

DataFrame functions only. Terms are shingles of five words, weighted by how often they stand in the text; a text of fewer
words is one term. The two 64-bit halves of a term's hash vote on 128 signed bits: a bit is set where more of the weight has
it set than not. Votes are summed in lanes of packed longs: of a few terms in 16 lanes to a long, of a slice
of the text in four, of the text in two, none of which can overflow; no vote leaves the task that holds the text.

A search within `radius` bits cuts fingerprints into radius + FREE blocks. Two fingerprints in reach agree in FREE of them
at least, so a table for each choice of FREE blocks, keyed by their bits, has them in one bucket. A pair counts in the first
table that it shares. Members of a bucket are held against arrays of at most about BUCKET others, so that a large bucket is
spread over many tasks, and no pair becomes a row.

Null texts are empty. Texts without a word have the fingerprint of the empty term.
Repeated rows and ids stay rows of their own; documents of one id follow each other by the MD5 of their texts. With a single
document, the next document is itself. An empty table gives an empty result. Other columns are passed over.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations
from operator import add

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import drop_stage, stage_alone, tidy

#: Words of a term; they are lower-cased runs without white space.
SHINGLE = 5
#: Terms whose votes are added in lanes of 4 bits, and terms of a slice, in lanes of 16 bits; the topmost lane has a sign.
STEP, SLICE = 7, 32_760
BITS, RADIUS, FREE = 128, 6, 2
#: Documents that are sorted together to find each one's next.
RUN = 64
BUCKET = 512


def _votes(terms: DataFrame, *keys: str) -> DataFrame:
    """hi, lo of each group of packed votes (h0 to h3 and g0 to g3 of n terms, in 16 lanes of 4 bits; slice: their slice's number)."""
    packed = [F.sum(F.shiftrightunsigned(f"{h}{i}", 4 * k).bitwiseAND(F.lit(0x000F000F000F000F))).alias(f"{h}{i + 4 * k}") for h in "hg" for k in range(4) for i in range(4)]
    slices = terms.groupBy(*keys, "slice").agg(F.sum("n").alias("n"), *packed)
    wide = [F.sum(F.shiftrightunsigned(f"{h}{i}", 16 * odd).bitwiseAND(F.lit(0x0000FFFF0000FFFF))).alias(f"{h}{i}_{odd}") for h in "hg" for i in range(16) for odd in (0, 1)]
    sums = slices.groupBy(*keys).agg(F.sum("n").alias("n"), *wide)

    def half(h: str) -> Column:
        bits = []
        for bit in range(64):
            lane = F.col(f"{h}{bit % 16}_{bit // 16 % 2}")
            count = F.shiftrightunsigned(lane, 32) if bit >= 32 else lane.bitwiseAND(F.lit(0xFFFFFFFF))
            bits.append(F.when(2 * count > F.col("n"), F.lit((1 << bit) - (1 << 64 if bit == 63 else 0)).cast("long")).otherwise(F.lit(0).cast("long")))
        return F.aggregate(F.array(*bits), F.lit(0).cast("long"), lambda a, x: a.bitwiseOR(x))

    return sums.select(*keys, half("h").alias("hi"), half("g").alias("lo"))


def _terms(texts: DataFrame, *keys: str) -> DataFrame:
    """slice, n, h0 to h3, g0 to g3: the votes of each STEP terms of a text."""
    plain = F.lower(F.coalesce(F.col("text"), F.lit("")))
    for space in "\t\n\v\f\r":
        plain = F.replace(plain, F.lit(space), F.lit(" "))
    words = F.transform(F.filter(F.split(plain, " "), lambda w: w != ""), lambda w: F.xxhash64(F.md5(w.cast("binary"))))
    count = F.greatest(F.size("w") - (SHINGLE - 1), F.lit(1))
    each = texts.select(*keys, words.alias("w")).select(*keys, "w", count.alias("count"), F.explode(F.sequence(F.lit(0), count - 1, F.lit(STEP))).alias("p"))
    at = lambda i: F.coalesce(F.get("w", F.col("p") + i), F.lit(0).cast("long"))
    each = each.select(*keys, "p", "count", *[at(i).alias(f"w{i}") for i in range(STEP + SHINGLE - 1)])
    each = each.select(*keys, "p", "count", *[F.xxhash64(*[f"w{i + k}" for k in range(SHINGLE)]).alias(f"h_{i}") for i in range(STEP)])
    each = each.select("*", *[F.xxhash64(f"h_{i}").alias(f"g_{i}") for i in range(STEP)])
    vote = lambda h, i, j: F.shiftrightunsigned(f"{h}_{j}", i).bitwiseAND(F.when(F.col("p") + j < F.col("count"), F.lit(0x1111111111111111)).otherwise(F.lit(0).cast("long")))
    votes = [reduce(add, [vote(h, i, j) for j in range(STEP)]).alias(f"{h}{i}") for h in "hg" for i in range(4)]
    return each.select(*keys, F.floor(F.col("p") / SLICE).cast("int").alias("slice"), F.least(F.col("count") - F.col("p"), F.lit(STEP)).cast("long").alias("n"), *votes)


def fingerprints(texts: DataFrame, *keys: str) -> DataFrame:
    """keys, hi, lo: the 128-bit SimHash of each text. The keys must tell rows apart; no row is shuffled if they cluster them."""
    return _votes(_terms(texts.select(*keys, "text"), *keys), *keys)


def digits(hi: str, lo: str) -> Column:
    return F.lower(F.concat(F.lpad(F.hex(hi), 16, "0"), F.lpad(F.hex(lo), 16, "0")))


def likeness(hi: str, lo: str, hi2: str, lo2: str) -> Column:
    """The share of equal bits."""
    return (BITS - F.bit_count(F.col(hi).bitwiseXOR(F.col(hi2))) - F.bit_count(F.col(lo).bitwiseXOR(F.col(lo2)))) / F.lit(float(BITS))


def _blocks(radius: int) -> list[tuple[int, int]]:
    """(first bit, bits) of the radius + FREE blocks of a half each; blocks don't straddle the halves."""
    n = radius + FREE
    left = (n + 1) // 2
    edges = lambda base, k: [(base + 64 * i // k, 64 * (i + 1) // k - 64 * i // k) for i in range(k)]
    return edges(0, left) + edges(64, n - left)


def _bits(hi: Column, lo: Column, block: tuple[int, int]) -> Column:
    at, n = block
    mask = (1 << n) - 1
    return F.shiftrightunsigned(hi if at < 64 else lo, at % 64).bitwiseAND(F.lit(mask - (1 << 64) if mask >> 63 else mask).cast("long"))


def near_counts(prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """hi, lo, n_near: for each different fingerprint, how many others are within the radius, by permuted block tables."""
    if not 0 <= radius <= 30:
        raise ValueError("the radius must be from 0 to 30 bits")
    blocks = _blocks(radius)
    tables = list(combinations(range(len(blocks)), FREE))
    own = prints.select("hi", "lo").distinct()
    keys = F.array(*[F.struct(F.lit(t).alias("t"), *[_bits(F.col("hi"), F.col("lo"), blocks[b]).alias(f"k{i}") for i, b in enumerate(pick)]) for t, pick in enumerate(tables)])
    rows = own.select("hi", "lo", F.inline(keys))
    key = ["t", *[f"k{i}" for i in range(FREE)]]
    counted = rows.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    live = stage_alone(rows.join(_shuffled(counted), key).withColumn("m", F.ceil(F.col("n") / BUCKET).cast("int")).withColumn("part", F.pmod(F.xxhash64("hi", "lo"), F.col("m")).cast("int")))
    held = live.groupBy(*key, "part").agg(F.collect_list(F.struct("hi", "lo")).alias("others"))
    asked = live.select("hi", "lo", *key, F.explode(F.sequence(F.lit(0), F.col("m") - 1)).alias("part"))

    def near(o: Column) -> Column:
        a, b = F.col("hi").bitwiseXOR(o["hi"]), F.col("lo").bitwiseXOR(o["lo"])
        distance = F.bit_count(a) + F.bit_count(b)
        # No table before this one has the pair: of each earlier one, some block differs.
        shared = F.lit(0)
        for i, block in enumerate(blocks):
            shared = shared + F.when(_bits(a, b, block) == 0, 1 << i).otherwise(0)
        return (distance > 0) & (distance <= radius) & (_lowest(shared) == F.element_at(F.array(*[F.lit(sum(1 << b for b in pick)) for pick in tables]), F.col("t") + 1))

    found = asked.join(_shuffled(held), [*key, "part"]).select("hi", "lo", F.size(F.filter("others", near)).alias("c"))
    sums = found.groupBy("hi", "lo").agg(F.sum("c").cast("long").alias("n_near"))
    return own.join(_shuffled(sums), ["hi", "lo"], "left").select("hi", "lo", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"))


def _shuffled(side: DataFrame) -> DataFrame:
    """A side of a join that is never broadcast: Spark sizes it by files and rows that were compressed or not yet exploded."""
    return side.hint("merge")


def _lowest(shared: Column) -> Column:
    """The FREE lowest set bits of a number."""
    out = F.lit(0)
    for _ in range(FREE):
        low = shared.bitwiseAND(-shared)
        out, shared = out + low, shared.bitwiseXOR(low)
    return out


def with_next(rows: DataFrame) -> DataFrame:
    """run, uid, text, next_text, next_uid of rows whose uid (partition and place, as monotonically_increasing_id() has it) orders them; the first follows the last.

    Rows are sorted together by runs of RUN. The first row of a run also goes to the run before it; of the partitions, only
    the last uid comes to the driver.
    """
    place = F.col("uid").bitwiseAND(F.lit((1 << 33) - 1))
    last = dict(rows.groupBy(F.shiftright("uid", 33).cast("int").alias("p")).agg(F.max("uid").alias("last")).collect())
    before, at = [], max(last.values(), default=0)
    for p in range(max(last, default=0) + 1):
        before.append(at)
        at = last.get(p, at)
    run = F.shiftright("uid", RUN.bit_length() - 1)
    ahead = F.when(place > 0, F.col("uid") - 1).otherwise(F.element_at(F.array(*[F.lit(x).cast("long") for x in before]), (F.shiftright("uid", 33) + 1).cast("int")))
    to = F.array(F.struct(run.alias("run"), F.lit(0).alias("extra")))
    also = F.array(F.struct(F.shiftright(ahead, RUN.bit_length() - 1).alias("run"), F.lit(1).alias("extra")))
    dealt = rows.select("uid", "text", F.inline(F.when(place % RUN == 0, F.concat(to, also)).otherwise(to)))
    w = Window.partitionBy("run").orderBy("extra", "uid")
    return dealt.select("run", "uid", "text", "extra", F.lead("text").over(w).alias("next_text"), F.lead("uid").over(w).alias("next_uid")).filter("extra = 0").drop("extra")


def fingerprint_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS) -> DataFrame:
    """A row for each document: fingerprints of its text and of its edited text, likeness to the edited text's and to the next document's.

    The edited text has the last floor(n_chars / 2) code points replaced by the first as many (or all) of the next document
    in descending order of id (nulls last). n_same counts the documents with the same fingerprint, itself included, n_near
    the other fingerprints within the radius.
    """
    order = [F.col("doc_id").desc_nulls_last(), F.md5(F.col("text").cast("binary"))]
    plain = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    rows = stage_alone(plain.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("uid", F.monotonically_increasing_id()))
    tidy(docs.sparkSession)
    n, half = F.length("text"), F.floor(F.length("text") / 2).cast("int")
    edited = F.concat(F.left("text", n - half), F.left("next_text", half))
    pairs = with_next(rows).select("run", "uid", "next_uid", n.cast("long").alias("n_chars"), "text", edited.alias("edited"))
    both = pairs.select("run", "uid", F.posexplode(F.array("text", "edited")).alias("side", "text"))
    halves = [F.max(F.when(F.col("side") == s, F.col(h))).alias(name) for s, h, name in ((0, "hi", "hi"), (0, "lo", "lo"), (1, "hi", "ehi"), (1, "lo", "elo"))]
    prints = fingerprints(both, "run", "uid", "side").groupBy("run", "uid").agg(*halves).drop("run")
    facts = pairs.select("uid", "next_uid", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"))
    done = stage_alone(facts.join(_shuffled(prints), "uid").join(_shuffled(rows.select("uid", "doc_id")), "uid"))
    drop_stage(rows)
    tidy(docs.sparkSession)
    same = done.groupBy("hi", "lo").agg(F.count(F.lit(1)).alias("n_same"))
    of_next = done.select(F.col("uid").alias("next_uid"), F.col("hi").alias("nhi"), F.col("lo").alias("nlo"))
    near = same.join(_shuffled(near_counts(same, radius)), ["hi", "lo"])
    all_ = done.join(_shuffled(of_next), "next_uid").join(_shuffled(near), ["hi", "lo"])
    return all_.select("doc_id", "n_chars", "edited_sha256", digits("hi", "lo").alias("fingerprint"), digits("ehi", "elo").alias("edited_fingerprint"), likeness("hi", "lo", "ehi", "elo").alias("near_edited"), likeness("hi", "lo", "nhi", "nlo").alias("near_next"), "n_same", "n_near")
