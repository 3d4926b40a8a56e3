from collections import Counter

from .brute import SF, sha
from .test_similar import brute_contamination, brute_lines, classes


def test_stages_and_run(spark, tmp_path):
    import corpus_pipeline as cp
    from strandlake.llm.language_id import identify

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    copies = docs.limit(8).selectExpr("doc_id + 100000 as doc_id", "concat(text, ' one more ending') as text", "lang", "source", "n_chars")
    odd = spark.createDataFrame([(200000, None, "en", "s", 0), (200001, "123 !!!", "en", "s", 7)], docs.schema)
    docs.union(copies).union(odd).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{SF}/benchmark.parquet").write.parquet(f"{tmp_path}/benchmark.parquet")
    sf = str(tmp_path)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept, seen = docs, []
    for i, (_, step) in enumerate(cp.STAGES):
        out = step(spark, kept, sf)
        if i + 1 < len(cp.STAGES):
            assert out.dtypes == docs.dtypes
        out.write.parquet(f"{sf}/stage{i}")
        kept = spark.read.parquet(f"{sf}/stage{i}")
        seen.append(kept)
    rows = [[(r.doc_id, r.text) for r in d.collect()] for d in (docs, *seen[:4])]
    good = {r.doc_id for r in identify(docs).collect() if not r.rejected}
    assert {d for d, _ in rows[1]} == good and not {200000, 200001} & good
    lines = {d: h for d, h in brute_lines(rows[1])}
    assert all(lines[d] == sha(t.encode()) for d, t in rows[2])
    assert all(not lines[d] != sha(b"") for d in {d for d, _ in rows[1]} - {d for d, _ in rows[2]} if "\n" not in dict(rows[1])[d])
    groups = classes(rows[2])
    assert {d for d, _ in rows[3]} == {c for c, _ in groups}
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    leaks = {d for d, _ in brute_contamination(rows[3], items)}
    assert leaks and {d for d, _ in rows[4]} == {d for d, _ in rows[3]} - leaks
    packed = Counter((r.doc_id, r.piece, r.length) for r in seen[4].collect())
    assert {d for d, _, _ in packed} == {d for d, _ in rows[4]}
    assert Counter((r.doc_id, r.piece, r.length) for r in cp.run(spark, sf).collect()) == packed
