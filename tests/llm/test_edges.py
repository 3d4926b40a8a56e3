"""Very long texts, clashing columns, repeated rows and ids, nulls and empty tables for every operator and stage."""

import random
from collections import Counter

import numpy as np
import pytest

from .brute import base_quality, base_secrets, crc, sha
from .test_suffix import brute as brute_repeats

PATH = pytest.importorskip("public_tokenizers").path("word_bpe_49k.json")
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, vid long, node string, key string, block int, n_lines long, bucket string, th string, hash string, part string, kept string"


def words(rng, n):
    return " ".join(rng.choice(("river", "stone", "bridge", "water", "harbour", "cloud", "winter")) + str(rng.randrange(500)) for _ in range(n))


@pytest.fixture(scope="module")
def docs(spark):
    """A text of 3 million symbols on one line, one of 1.2 million in lines, repeated rows and ids, nulls, and columns named as operators' own."""
    rng = random.Random(12)
    long = words(rng, 300_000)
    lines = "\n".join(words(rng, 12) for _ in range(12_000))
    rows = [(1, long, "en", "a"), (2, lines, "en", "b"), (2, lines[:5000], "en", "b"), (3, long[:4000], None, "a"), (3, long[:4000], None, "a"), (None, lines[100:3000], "en", None), (4, None, "en", "c"), (5, "", None, None), (6, " \n ", "en", "a")]
    return spark.createDataFrame([(*r, 9, 8, "n", "k", 7, 6, "b", "t", "h", "p", "x") for r in rows], COLUMNS).cache()


def texts(docs):
    return [(r.doc_id, r.text or "") for r in docs.collect()]


def test_secrets_quality_licenses(docs):
    from strandlake.llm.licenses import scan_licenses
    from strandlake.llm.quality import judge_quality
    from strandlake.llm.secrets import scan_secrets

    rows = texts(docs)
    got = Counter((r.doc_id, r.n_hex, r.base_sha256) for r in scan_secrets(docs).collect())
    assert got == Counter((d, sum(x[3] == "hex" for x in base_secrets(t)), sha(",".join(f"{k}:{s}:{e}" for s, _, e, k in base_secrets(t)).encode())) for d, t in rows)
    got = Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in judge_quality(docs).collect())
    assert got == Counter((d, *base_quality(t)) for d, t in rows)
    assert Counter((r.doc_id, r.license, r.score) for r in scan_licenses(docs).collect()) == Counter((d, None, 0.0) for d, _ in rows)


def test_language(docs):
    from strandlake.llm.language_id import identify, keep_identified

    got = identify(docs).collect()
    assert Counter(r.doc_id for r in got) == Counter(d for d, _ in texts(docs))
    assert all((r.lang_pred == "und") == (r.doc_id in (4, 5, 6)) for r in got)
    kept = keep_identified(docs)
    assert kept.columns == docs.columns and Counter(map(tuple, kept.collect())) == Counter(tuple(r) for r in docs.collect() if r.doc_id not in (4, 5, 6))
    assert keep_identified(docs.limit(0)).count() == 0


def test_tokens(spark, docs, tmp_path):
    from tokenizers import Tokenizer

    from strandlake.llm.packing import pack
    from strandlake.llm.token_store import digest_store, write_store

    write_store(docs, f"{tmp_path}/s", PATH)
    t = Tokenizer.from_file(PATH)
    ids = [(d, t.encode(x, add_special_tokens=False).ids) for d, x in texts(docs)]
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in digest_store(spark, f"{tmp_path}/s").collect()) == Counter((d, len(x) + 1, crc([*x, 2])) for d, x in ids)
    got = Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in pack(docs, PATH).collect())
    assert got == Counter((d, p, s, len(y[s : s + 2048]), crc(y[s : s + 2048])) for d, x in ids for y in [[*x, 0]] for p, s in enumerate(range(0, len(y), 2048)))


def test_similar(spark, docs):
    from strandlake.llm.decontaminate import decontaminate, find_contamination
    from strandlake.llm.line_dedup import dedup_lines
    from strandlake.llm.ngram_jaccard import jaccard_join, keep_one_of_each

    rows = texts(docs)
    assert Counter((r.doc_id, r.n_links) for r in jaccard_join(docs).collect()) == Counter({(1, 0): 1, (2, 0): 2, (3, 1): 2, (None, 0): 1, (4, 0): 1, (5, 0): 1, (6, 0): 1})
    kept = keep_one_of_each(docs)
    assert kept.columns == docs.columns and Counter((r.doc_id, r.text or "") for r in kept.collect()) == Counter(set(rows))
    done = dedup_lines(docs)
    assert done.columns == [*docs.columns, "n_removed", "n_near"]
    got = {(r.doc_id, sha((r.text or "").encode())) for r in done.collect()}
    lines = dict(rows[:2])[2].split("\n")
    # Both rows of document 2 keep their lines; the row without id comes last, and keeps the two that it cuts.
    assert (2, sha("\n".join(lines).encode())) in got and (2, sha("\n".join(lines)[:5000].encode())) in got
    item = " ".join(rows[0][1].split()[200_000:200_040])
    items = spark.createDataFrame([(1, item), (1, item), (2, None), (3, ""), (4, words(random.Random(1), 30) + " zq")], "item_id long, text string")
    assert [(r.doc_id, r.item_id, r.similarity, r.first_word) for r in find_contamination(docs, items).collect()] == [(1, 1, 1.0, 200_000)]
    left = decontaminate(docs, items)
    assert left.columns == docs.columns and Counter((r.doc_id, r.text or "") for r in left.collect()) == Counter(rows[1:])


def test_suffixes(spark, docs):
    from strandlake.llm.suffix_dedup import dedup_substrings

    some = docs.filter("doc_id is null or doc_id <> 1")
    rows = [(r.doc_id, r.text) for r in some.collect()]
    got = Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in dedup_substrings(some, block_bytes=200_000).collect())
    assert got == brute_repeats(rows)
    whole = {r.doc_id: r for r in dedup_substrings(docs.filter("doc_id in (1, 3)")).collect()}
    assert (whole[1].n_removed, whole[3].n_removed, whole[3].n_bytes) == (0, 4000, 4000)


@pytest.mark.parametrize("rows", ["all", "none"])
def test_pipeline(spark, docs, tmp_path, rows):
    """Stages take repeated ids, clashing columns and empty tables, and keep the columns of documents."""
    import corpus_pipeline as cp

    few = docs.filter("doc_id is null or doc_id <> 1").limit(100 if rows == "all" else 0)
    few.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, words(random.Random(3), 20))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    kept = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for i, (_, step) in enumerate(cp.STAGES):
        out = step(spark, kept, str(tmp_path))
        out.write.parquet(f"{tmp_path}/{i}")
        if i + 1 < len(cp.STAGES):
            assert out.columns == kept.columns
        kept = spark.read.parquet(f"{tmp_path}/{i}")
    n = kept.select("doc_id").distinct().count()
    assert n == (3 if rows == "all" else 0)  # documents 2 and 3, and the one without an id
    assert cp.run(spark, str(tmp_path)).count() == kept.count()
    if rows == "all":
        assert np.sum([r.length for r in kept.collect()]) > 100_000
