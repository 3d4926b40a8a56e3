"""Language identification with interpolated Kneser-Ney character language models.

One model per language over case-folded letters and single spaces, held in sorted hash arrays. A text takes the language
with the lowest length-normalised cross-entropy; it is rejected where that is far above what training texts of the
language have at the same length.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import broadcast_if, code_points, mix64, small_batches, stage, text_slices

ORDER = 4
FOLDS = 5
#: N-gram types of all languages together in the model that travels to every executor. If a corpus has more, all are
#: kept, in shards of about this size, and texts are scored shard by shard.
MAX_TYPES = 4_000_000
#: A text is rejected beyond this many standard deviations (plus a slack in nats) of its language's and length's mean.
REJECT_SIGMA, REJECT_SLACK, MIN_BUCKET = 6.0, 0.15, 30
#: Limits, 21 a language, that may be broadcast, by count.
BROADCAST_ROWS = 400_000
_SLOTS = 20
_U = np.uint64


def _letter_table() -> np.ndarray:
    t = np.zeros(1 << 16, bool)
    for c in range(1 << 16):
        t[c] = not 0xD800 <= c < 0xE000 and chr(c).isalpha()
    return t


_LETTERS: list[np.ndarray] = []


def symbols(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(16-bit symbols, row offsets, letters per row): each row is ORDER-1 spaces, its words with one space between, a space."""
    if not _LETTERS:
        _LETTERS.append(_letter_table())
    pad = " " * (ORDER - 1)
    codes, off = code_points([f"{pad}{t.lower()} " for t in texts])
    low = np.minimum(codes, 0xFFFF)
    letter = _LETTERS[0][low]
    big = np.flatnonzero(codes > 0xFFFF)
    if len(big):
        uniq, inv = np.unique(codes[big], return_inverse=True)
        letter[big] = np.array([chr(c).isalpha() for c in uniq.tolist()])[inv]
    sym = np.where(letter, (codes & 0xFFFF) ^ ((codes >> 16) * 0x9E5), 32).astype(np.uint16)
    keep = np.ones(len(codes), bool)
    keep[1:] = letter[1:] | letter[:-1]
    for k in range(ORDER - 1):  # the padding stays
        keep[off[:-1] + k] = True
    kept = np.concatenate(([0], np.cumsum(keep)))
    letters = np.concatenate(([0], np.cumsum(letter)))
    return sym[keep], kept[off], letters[off[1:]] - letters[off[:-1]]


def ngram_keys(sym: np.ndarray) -> np.ndarray:
    """Key of the ORDER symbols that end at each place, 16 bits each (the first ORDER-1 places are not n-grams)."""
    s = sym.astype(_U)
    out = s.copy()
    for k in range(1, ORDER):
        out[k:] |= s[: len(s) - k] << _U(16 * k)
    return out


def _places(off: np.ndarray) -> np.ndarray:
    """Places that are predicted: all but each row's padding."""
    n = np.diff(off) - (ORDER - 1)
    return np.arange(n.sum()) + np.repeat(off[:-1] + ORDER - 1 - (np.cumsum(n) - n), n)


def count_ngrams(docs: DataFrame) -> DataFrame:
    """lang, key, n over whole training texts: tasks send each n-gram type once."""

    def run(batches):
        held: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}

        def merged(parts):
            keys, n = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
            uniq, inv = np.unique(keys, return_inverse=True)
            return uniq, np.bincount(inv, n, len(uniq)).astype(np.int64)

        for batch in batches:
            for cut in text_slices(batch):
                by: dict[str, list[str]] = {}
                for lang, t in zip(cut.column("lang").to_pylist(), cut.column("text").to_pylist(), strict=True):
                    if t:
                        by.setdefault(lang, []).append(t)
                for lang, texts in by.items():
                    sym, off, letters = symbols(texts)
                    keys = ngram_keys(sym)[_places(off)]
                    parts = held.setdefault(lang, [])
                    parts.append(np.unique(keys, return_counts=True))
                    if len(parts) >= 8:
                        held[lang] = [merged(parts)]
        for lang, parts in held.items():
            keys, n = merged(parts)
            for a in range(0, len(keys), 50_000):
                k = keys[a : a + 50_000]
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(k)), pa.array(k.view(np.int64)), pa.array(n[a : a + 50_000])], names=["lang", "key", "n"])

    return docs.mapInArrow(run, "lang string, key long, n long").groupBy("lang", "key").agg(F.sum("n").alias("n"))


def _shorter(grams: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The last k symbols of n-grams of k+1 symbols, with the count of n-grams of each."""
    return np.unique(grams & _U((1 << 16 * k) - 1), return_counts=True)


def _discount(ones: int, twos: int) -> float:
    return float(np.clip(ones / max(ones + 2 * twos, 1), 0.1, 0.95))


class KneserNey:
    """Interpolated Kneser-Ney over packed keys of one language; every table is a sorted hash array."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray, short: dict[int, tuple] | None = None, discounts: dict[int, float] | None = None):
        """short, discounts: tables and discounts of single orders where keys are one shard only."""
        # Orders below the highest count the distinct symbols seen before an n-gram.
        tables = [(keys.astype(_U), counts.astype(np.float64))]
        for k in range(ORDER - 1, 0, -1):
            tables.append((short or {}).get(k) or _shorter(tables[-1][0], k))
        self.orders = []
        lower = None
        for k, (grams, n) in zip(range(1, ORDER + 1), reversed(tables), strict=True):
            n = n.astype(np.float64)
            d = (discounts or {}).get(k) or _discount((n == 1).sum(), (n == 2).sum())
            context, inv = np.unique(grams >> _U(16), return_inverse=True)
            total = np.bincount(inv, n)
            back = d * np.bincount(inv) / total
            if lower is None:
                self.floor = back[0] / (len(grams) + 1)
                p = np.maximum(n - d, 0) / total[inv] + self.floor
            else:
                p = np.maximum(n - d, 0) / total[inv] + back[inv] * self._p(grams & _U((1 << 16 * (k - 1)) - 1), k - 1)
            self.orders.append((*self._sorted(grams, p), *self._sorted(context, back)))
            lower = self.orders[-1]

    @staticmethod
    def _sorted(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        h = mix64(keys + _U(1))
        order = np.argsort(h)
        return h[order], values[order].astype(np.float32)

    @staticmethod
    def _find(hashes: np.ndarray, values: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(hashes):
            return np.zeros(len(keys), bool), np.zeros(len(keys), np.float32)
        h = mix64(keys + _U(1))
        at = np.minimum(np.searchsorted(hashes, h), len(hashes) - 1)
        return hashes[at] == h, values[at]

    def _p(self, keys: np.ndarray, k: int) -> np.ndarray:
        if k == 0:
            return np.full(len(keys), self.floor)
        grams, p, contexts, back = self.orders[k - 1]
        hit, out = self._find(grams, p, keys)
        out = out.astype(np.float64)
        miss = np.flatnonzero(~hit)
        if len(miss):
            known, weight = self._find(contexts, back, keys[miss] >> _U(16))
            shorter = self._p(keys[miss] & _U((1 << 16 * (k - 1)) - 1), k - 1)
            out[miss] = shorter if k == 1 else np.where(known, weight, 1.0) * shorter
        return out

    def log_p(self, keys: np.ndarray) -> np.ndarray:
        return np.log(np.maximum(self._p(keys, ORDER), 1e-12)).astype(np.float32)


class LanguageModels:
    """All languages; log-probabilities of every n-gram seen in training are tabled for all of them."""

    def __init__(self, langs: np.ndarray, keys: np.ndarray, counts: np.ndarray, short: dict[str, tuple[dict, dict]] | None = None):
        """short: for a shard, what KneserNey takes besides, of all languages."""
        self.names = sorted(set(langs.tolist()) if short is None else short)
        self.models = [KneserNey(keys[langs == x], counts[langs == x], *(short[x] if short else ())) for x in self.names]
        seen = np.unique(keys.astype(_U))
        hashes = mix64(seen + _U(1))
        order = np.argsort(hashes)
        self.hashes = hashes[order]
        self.table = np.stack([m.log_p(seen[order]) for m in self.models], 1) if len(seen) else np.zeros((0, len(self.names)), np.float32)
        self.slots = None

    def log_p(self, keys: np.ndarray) -> np.ndarray:
        if not len(self.hashes):
            return np.stack([m.log_p(keys) for m in self.models], 1)
        if self.slots is None:
            self.slots = np.zeros(1 << _SLOTS, np.int32)
            self.slots[(self.hashes >> _U(64 - _SLOTS)).astype(np.int64)] = np.arange(len(self.hashes), dtype=np.int32)
        h = mix64(keys + _U(1))
        at = self.slots[(h >> _U(64 - _SLOTS)).astype(np.int64)]
        miss = np.flatnonzero(self.hashes[at] != h)
        out = self.table[at]
        if len(miss):
            uniq, inv = np.unique(keys[miss], return_inverse=True)
            out[miss] = np.stack([m.log_p(uniq) for m in self.models], 1)[inv]
        return out

    def entropies(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(cross-entropy in nats per symbol of each row and language, symbols per row, letters per row)."""
        sym, off, letters = symbols(texts)
        n = np.diff(off) - (ORDER - 1)
        lp = self.log_p(ngram_keys(sym)[_places(off)])
        live = np.flatnonzero(n > 0)
        out = np.zeros((len(texts), len(self.names)))
        if len(live):
            ends = np.cumsum(n)
            out[live] = -np.add.reduceat(lp, (ends - n)[live], axis=0, dtype=np.float64) / n[live, None]
        return out, n, letters

    def shard_sums(self, texts: list[str], k: int, n_shards: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """As entropies(), with sums of the log-probabilities of the places in shard k."""
        sym, off, letters = symbols(texts)
        n = np.diff(off) - (ORDER - 1)
        keys = ngram_keys(sym)[_places(off)]
        own = np.flatnonzero(_shard_of(keys, n_shards) == k)
        rows, begin = np.unique(np.repeat(np.arange(len(n)), n)[own], return_index=True)
        out = np.zeros((len(texts), len(self.names)))
        if len(own):
            out[rows] = np.add.reduceat(self.log_p(keys[own]), begin, axis=0, dtype=np.float64)
        return out, n, letters


_MIX = 1327217885


def _shard_of(keys: np.ndarray, n: int) -> np.ndarray:
    """Shard by the two middle symbols: all n-grams and contexts of three symbols and up that a key needs share them."""
    return ((((keys >> _U(16)) & _U(0xFFFFFFFF)) * _U(_MIX)) >> _U(24)) % _U(n)


class ShardedModels:
    """All languages, with every n-gram type, where one table would be too large: shards are built one at a time.

    Orders one and two, which are few, are in every shard. The discounts are those of the whole, so results are too.
    """

    def __init__(self, counts: DataFrame, n: int):
        middle = F.shiftrightunsigned("key", 16).bitwiseAND(F.lit(0xFFFFFFFF))
        self.n = n
        self.counts = stage(counts.withColumn("shard", F.shiftright(middle * F.lit(_MIX), 24) % n).repartition("shard"))
        three = counts.groupBy("lang", F.col("key").bitwiseAND(F.lit((1 << 48) - 1)).alias("key")).agg(F.count(F.lit(1)).alias("n"))
        discounts: dict[str, dict[int, float]] = {}
        for k, table in ((ORDER, counts), (ORDER - 1, three)):
            for r in table.groupBy("lang").agg(F.count_if(F.col("n") == 1).alias("ones"), F.count_if(F.col("n") == 2).alias("twos")).collect():
                discounts.setdefault(r.lang, {})[k] = _discount(r.ones, r.twos)
        got = three.groupBy("lang", F.col("key").bitwiseAND(F.lit((1 << 32) - 1)).alias("key")).agg(F.count(F.lit(1)).alias("n")).orderBy("lang", "key").toArrow()
        langs, keys, n2 = _arrays(got)
        self.short = {}
        for x, d in discounts.items():
            two = keys[langs == x], n2[langs == x]
            self.short[x] = ({2: two, 1: _shorter(two[0], 1)}, d)
        self.names = sorted(self.short)

    def shard(self, k: int) -> LanguageModels:
        got = self.counts.filter(F.col("shard") == k).select("lang", "key", "n").orderBy("lang", "key").toArrow()
        return LanguageModels(*_arrays(got), self.short)


def _arrays(got: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return np.array(got.column("lang").to_pylist(), dtype=object), got.column("key").to_numpy().view(_U), got.column("n").to_numpy()


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> LanguageModels | ShardedModels:
    """Models from all rows outside the held-out fold that have a language."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"), held_out(id_col).alias("held"))
    counts = stage(count_ngrams(rows.filter("not held and lang is not null").select("text", "lang")))
    total = counts.count()
    return LanguageModels(*_arrays(counts.toArrow())) if total <= MAX_TYPES else ShardedModels(counts, -(-total // MAX_TYPES))


def held_out(id_col: str):
    """crc32 of the id as text, modulo FOLDS, is 0; null ids count as held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % FOLDS == 0, F.lit(True))


SCORED = "doc_id long, held_out boolean, lang string, lang_pred string, score double, entropy double, bucket int"


def _score(m: LanguageModels, texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
    """(language or und, score, entropy, length bucket) of every text."""
    return _judge(m.names, *m.entropies(texts)) if m.names else _judge(m.names, None, *[np.zeros(len(texts), np.int64)] * 2)


def _judge(names: list[str], e: np.ndarray, n: np.ndarray, letters: np.ndarray) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
    """_score() of texts with their entropies, symbols and letters."""
    if names:
        best = e.argmin(1)
        w = np.exp(-(e - e.min(1, keepdims=True)) * np.clip(n, 1, 50)[:, None])
        score, low = 1 / w.sum(1), e.min(1)
        pred = [names[b] if k else "und" for b, k in zip(best.tolist(), letters.tolist(), strict=True)]
    else:
        score = low = np.zeros(len(n))
        pred = ["und"] * len(n)
    und = letters == 0
    return pred, np.where(und, 0.0, score), np.where(und, 0.0, low), np.minimum(np.log2(np.maximum(n, 1)).astype(np.int32), 20)


def _scored(docs: DataFrame, shared, id_col: str, text_col: str, lang_col: str) -> DataFrame:
    def run(batches):
        for batch in batches:
            for cut in text_slices(batch):
                cols = _score(shared.value, [t or "" for t in cut.column("text").to_pylist()])
                yield pa.RecordBatch.from_arrays([cut.column("doc_id"), cut.column("held_out"), cut.column("lang"), *map(pa.array, cols)], names=["doc_id", "held_out", "lang", "lang_pred", "score", "entropy", "bucket"])

    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"), held_out(id_col).alias("held_out"))
    return stage(rows.mapInArrow(run, SCORED))


_HASH = "_strandlake_text_hash"


def _text_hash(text_col: str):
    return F.sha2(F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary"), 256).alias(_HASH)


def _scored_by_shard(docs: DataFrame, models: ShardedModels, id_col: str, text_col: str, lang_col: str) -> DataFrame:
    """As _scored(), with the texts' hashes: one pass a shard over the texts, whose sums are added up by hash."""
    small_batches(docs.sparkSession)
    texts = docs.select(_text_hash(text_col), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    parts = []
    for k in range(models.n):
        shared = docs.sparkSession.sparkContext.broadcast(models.shard(k))

        def run(batches, k=k, shared=shared, n=models.n):
            for batch in batches:
                for cut in text_slices(batch):
                    sums, *sizes = shared.value.shard_sums(cut.column("text").to_pylist(), k, n)
                    cols = [pa.array(sums.tolist(), pa.list_(pa.float64())), *(pa.array(x, pa.int64()) for x in sizes), pa.array([k] * len(sums), pa.int32())]
                    yield pa.RecordBatch.from_arrays([cut.column(_HASH), *cols], names=[_HASH, "sums", "n", "letters", "shard"])

        parts.append(stage(texts.mapInArrow(run, f"{_HASH} string, sums array<double>, n long, letters long, shard int").dropDuplicates([_HASH])))
        shared.unpersist()
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.union(p)
    whole = whole.groupBy(_HASH).agg(F.max("n").alias("n"), F.max("letters").alias("letters"), F.array_sort(F.collect_list(F.struct("shard", "sums"))).alias("parts"))
    names = models.names

    def judge(batches):
        for batch in batches:
            n, letters = (batch.column(x).to_numpy() for x in ("n", "letters"))
            e = -np.array([np.sum([p["sums"] for p in ps], 0) for ps in batch.column("parts").to_pylist()]).reshape(len(n), len(names)) / np.maximum(n, 1)[:, None]
            yield pa.RecordBatch.from_arrays([batch.column(_HASH), *map(pa.array, _judge(names, e, n, letters))], names=[_HASH, "lang_pred", "score", "entropy", "bucket"])

    judged = whole.mapInArrow(judge, f"{_HASH} string, lang_pred string, score double, entropy double, bucket int")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), held_out(id_col).alias("held_out"), F.col(lang_col).cast("string").alias("lang"), _text_hash(text_col))
    return stage(rows.join(judged, _HASH))


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", models: LanguageModels | None = None) -> DataFrame:
    """One row per row of docs: doc_id, held_out, lang_pred, score, entropy, rejected.

    lang_pred is a learned language, or und where the text is null or has no letter (or nothing was learned); these are
    rejected with score 0. score is the posterior of the language over at most 50 symbols; ties take the first name in order.
    Texts are whole however long; repeated rows give repeated results; a null doc_id counts as held out; other columns of
    docs are ignored; an empty table gives no rows.
    """
    models = models or train(docs, id_col, text_col, lang_col)
    if isinstance(models, ShardedModels):
        scored = _scored_by_shard(docs, models, id_col, text_col, lang_col)
    else:
        scored = _scored(docs, docs.sparkSession.sparkContext.broadcast(models), id_col, text_col, lang_col)
    return _with_rejected(scored).select("doc_id", "held_out", "lang_pred", "score", "entropy", "rejected")


def _with_rejected(scored: DataFrame) -> DataFrame:
    out = scored.join(broadcast_if(_limits(scored), BROADCAST_ROWS), ["lang_pred", "bucket"], "left")
    return out.withColumn("rejected", (F.col("lang_pred") == "und") | F.coalesce(F.col("entropy") > F.col("limit"), F.lit(False)))


def keep_identified(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", models: LanguageModels | None = None) -> DataFrame:
    """The rows of docs, with all their columns, that identify() does not reject.

    Every text is scored once, into a table of the rows with their scores; no text is shuffled (unless the models are in
    shards). Equal rows are judged alike, so all of them stay or go.
    """
    models = models or train(docs, id_col, text_col, lang_col)
    if isinstance(models, ShardedModels):
        kept = _with_rejected(_scored_by_shard(docs, models, id_col, text_col, lang_col)).filter("not rejected").select(_HASH).distinct()
        return docs.withColumn(_HASH, _text_hash(text_col)).join(kept, _HASH, "left_semi").select(*docs.columns)
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(models)
    names = [f"{_HASH}_{c}" for c in ("lang_pred", "entropy", "bucket")]
    schema = StructType(list(docs.schema.fields))
    for c, t in zip(names, ("string", "double", "integer"), strict=True):
        schema = schema.add(c, t)

    def run(batches):
        for batch in batches:
            for cut in text_slices(batch, text_col):
                pred, _, entropy, bucket = _score(shared.value, [t or "" for t in cut.column(text_col).to_pylist()])
                yield pa.RecordBatch.from_arrays([*cut.columns, pa.array(pred), pa.array(entropy), pa.array(bucket)], names=[*cut.schema.names, *names])

    done = stage(docs.withColumn(text_col, F.col(text_col).cast("string")).mapInArrow(run, schema))
    facts = [F.col(c).alias(c.removeprefix(f"{_HASH}_")) for c in names]
    limits = broadcast_if(_limits(done.select(held_out(id_col).alias("held_out"), F.col(lang_col).cast("string").alias("lang"), *facts)), BROADCAST_ROWS)
    within = done.join(limits, (F.col(names[0]) == limits["lang_pred"]) & (F.col(names[2]) == limits["bucket"]), "left")
    return within.filter((F.col(names[0]) != "und") & F.coalesce(F.col(names[1]) <= F.col("limit"), F.lit(True))).select(*[done[c] for c in docs.columns])


def _limits(scored: DataFrame) -> DataFrame:
    """lang_pred, bucket, limit of all 21 buckets of each language: from training texts that got their own language."""
    own = scored.filter("not held_out and lang = lang_pred and lang_pred <> 'und'")
    stats = lambda *by: own.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.avg("entropy").alias("mean"), F.stddev_pop("entropy").alias("sd"))
    each = stats("lang_pred", "bucket")
    whole = stats("lang_pred").select("lang_pred", F.col("mean").alias("all_mean"), F.col("sd").alias("all_sd"), F.explode(F.sequence(F.lit(0), F.lit(20))).alias("bucket"))
    few = F.coalesce(F.col("n"), F.lit(0)) < MIN_BUCKET
    limit = F.when(few, F.col("all_mean") + 2 * REJECT_SIGMA * F.col("all_sd")).otherwise(F.col("mean") + REJECT_SIGMA * F.col("sd")) + REJECT_SLACK
    return whole.join(each, ["lang_pred", "bucket"], "left").select("lang_pred", "bucket", limit.alias("limit"))
