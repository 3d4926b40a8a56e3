"""Content-addressed store of token ids: rolling hashes cut id streams into chunks, each unique chunk is stored once,
documents are recipes of chunk hashes, and Merkle roots let a reader verify what it rebuilds.

Files, all Parquet under one folder:
  recipes   one row per document in ascending doc_id: part, rid, doc_id, n_tokens, hashes (16 bytes a chunk), lengths, root
  chunks    one row per unique chunk: hash (16 bytes, of ids), ids (a byte that gives the width of an id, 2 or 4, then
            little-endian unsigned ids; 2 where all ids of the chunk fit)
  manifest  one row per recipe part: part, documents, tokens, root over the documents' roots

A reader raises on a chunk, recipe or manifest row that is missing or does not match; it never leaves a document out.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from bisect import bisect_left

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import drop_stage, mix64, pick_id_text, shared_dir, stage, text_slices

END_ID = 2
#: Chunks end where the low bits of the rolling hash are zero; expected length about MIN + 2**BITS ids.
WINDOW, BITS, MIN_IDS, MAX_IDS = 4, 7, 32, 1024
#: Bytes of recipes in a part: what a task sorts and hashes at once.
PART_BYTES = 16 << 20


def rolling_hash(ids: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """Hash of the last `window` ids at every position (fewer at the start)."""
    v = mix64(ids.astype(np.uint64) + np.uint64(1))
    out = np.zeros(len(ids), np.uint64)
    for k in range(min(window, len(ids))):
        out[k:] += v[: len(ids) - k] * np.uint64(2 * k + 0x9E3779B97F4A7C15)
    return mix64(out)


def marks_of(ids: np.ndarray) -> np.ndarray:
    """Places after which a chunk may end. A window that reaches into the document before has no part in any chunk's end,
    as chunks have MIN_IDS ids at least, so documents can be hashed together."""
    return np.flatnonzero(rolling_hash(ids) & np.uint64((1 << BITS) - 1) == 0) + 1


def cut_points(marks: list[int], start: int, end: int) -> list[int]:
    """Ends of the chunks of the document that takes the places from start to end."""
    ends, at = [], start
    while at < end:
        j = bisect_left(marks, at + MIN_IDS)
        at = min(marks[j] if j < len(marks) else end, at + MAX_IDS, end)
        ends.append(at)
    return ends


def pack_ids(ids: np.ndarray) -> bytes:
    """A chunk as stored."""
    return b"\2" + ids.astype("<u2").tobytes() if len(ids) == 0 or int(ids.max()) < 1 << 16 else b"\4" + ids.astype("<u4").tobytes()


def unpack_ids(raw: bytes) -> np.ndarray:
    """The little-endian 32-bit ids of a stored chunk."""
    return np.frombuffer(raw, "<u2" if raw[0] == 2 else "<u4", -1, 1).astype("<u4")


def merkle(leaves: list[bytes]) -> bytes:
    """Root over 16-byte leaves: pairs are hashed level by level, an odd one moves up; no leaf gives the hash of nothing."""
    level = leaves
    while len(level) > 1:
        pairs = [hashlib.blake2b(level[i] + level[i + 1], digest_size=16).digest() for i in range(0, len(level) - 1, 2)]
        level = pairs + ([level[-1]] if len(level) % 2 else [])
    return level[0] if level else hashlib.blake2b(b"", digest_size=16).digest()


def _crc_tables() -> list[np.ndarray]:
    """Operators that append 2**k zero bytes to a CRC-32, as 32 columns each."""
    poly = 0xEDB88320
    odd = np.array([poly, *[1 << i for i in range(31)]], np.uint32)  # one zero bit

    def times(m: np.ndarray, v: np.ndarray) -> np.ndarray:
        out = np.zeros(len(v), np.uint32)
        for i in range(32):
            out ^= np.where(v >> np.uint32(i) & np.uint32(1), m[i], np.uint32(0)).astype(np.uint32)
        return out

    m, tables = odd, []
    for k in range(3 + 40):
        if k >= 3:
            tables.append(m)
        m = times(m, m)
    return tables


_CRC: list[list[np.ndarray]] = []


def crc_shift(crc: np.ndarray, n_bytes: np.ndarray) -> np.ndarray:
    """The part of each CRC-32 in that of its data followed by n_bytes more: a linear map per power of two, by byte tables."""
    if not _CRC:
        byte = np.arange(256, dtype=np.uint32)
        for m in _crc_tables():
            tables = []
            for j in range(4):
                t = np.zeros(256, np.uint32)
                for i in range(8):
                    t ^= np.where(byte >> np.uint32(i) & np.uint32(1), m[8 * j + i], np.uint32(0)).astype(np.uint32)
                tables.append(t)
            _CRC.append(tables)
    out, n = crc.astype(np.uint32), n_bytes.astype(np.int64)
    for k in range(int(n.max(initial=0)).bit_length()):
        live = np.flatnonzero(n >> k & 1)
        v = out[live]
        out[live] = _CRC[k][0][v & 255] ^ _CRC[k][1][v >> 8 & 255] ^ _CRC[k][2][v >> 16 & 255] ^ _CRC[k][3][v >> 24]
    return out


def crc_combine(crc: np.ndarray, more: np.ndarray, n_bytes: np.ndarray) -> np.ndarray:
    """CRC-32 of A+B from those of A and B and the length of B, elementwise."""
    return crc_shift(crc, n_bytes) ^ more.astype(np.uint32)


STAGED = "kind int, rid long, doc_id long, n_tokens long, hashes binary, lengths binary, root binary, hash binary, ids binary"


def _encode(docs: DataFrame, tokenizer: str, end_id: int) -> DataFrame:
    """Recipes (kind 0) and chunks (kind 1, each at most once per task) of one pass over the texts."""

    def run(batches):
        from pyspark import TaskContext

        from .tokens import WordEncoder

        enc, rid, stored = WordEncoder.open(tokenizer), TaskContext.get().partitionId() << 40, set()
        names = ["kind", "rid", "doc_id", "n_tokens", "hashes", "lengths", "root", "hash", "ids"]
        types = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.binary(), pa.binary()]
        for batch in batches:
            for cut in text_slices(batch):
                ids, off = enc.encode([t or "" for t in cut.column("text").to_pylist()])
                ids = np.insert(ids, off[1:], np.uint32(end_id))
                off = (off + np.arange(len(off))).tolist()
                marks, narrow = marks_of(ids).tolist(), len(ids) == 0 or int(ids.max()) < 1 << 16
                raw = ids.astype("<u2").tobytes() if narrow else b""
                rows = []
                for doc, at, end in zip(cut.column("doc_id").to_pylist(), off, off[1:], strict=False):
                    begin, ends, hashes = at, cut_points(marks, at, end), []
                    for e in ends:
                        piece = b"\2" + raw[2 * at : 2 * e] if narrow else pack_ids(ids[at:e])
                        h = hashlib.blake2b(piece, digest_size=16).digest()
                        hashes.append(h)
                        if h not in stored:
                            stored.add(h)
                            rows.append((1, None, None, None, None, None, None, h, piece))
                        at = e
                    lengths = np.diff(np.array([begin, *ends])).astype("<u4").tobytes()
                    rows.append((0, rid, doc, end - begin, b"".join(hashes), lengths, merkle(hashes), None, None))
                    rid += 1
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*rows), types, strict=True)], names=names)

    return docs.mapInArrow(run, STAGED)


def _first_of_each(chunks: DataFrame) -> DataFrame:
    """Unique chunks: equal hashes meet in one sorted partition (a task sends each hash once, so no hash is hot)."""

    def run(batches):
        last = None
        for b in batches:
            keys, keep = b.column("hash").to_pylist(), []
            for k in keys:
                keep.append(k != last)
                last = k
            yield b.filter(pa.array(keep))

    return chunks.repartition("hash").sortWithinPartitions("hash").mapInArrow(run, "hash binary, ids binary")


def write_store(docs: DataFrame, path: str, tokenizer: str, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text", part_bytes: int = PART_BYTES) -> None:
    """Encode every whole text (null is empty) and write recipes, chunks and manifest under path.

    Null doc_ids come first; repeated rows are documents of their own; other columns of docs are ignored; an empty table
    writes an empty store.
    """
    staged = stage(_encode(pick_id_text(docs, id_col, text_col), tokenizer, end_id), "kind")
    recipes = staged.filter("kind = 0").select("rid", "doc_id", "n_tokens", "hashes", "lengths", "root")
    total = recipes.agg(F.sum(F.octet_length("hashes") + F.octet_length("lengths") + 64)).first()[0] or 0
    # rid is a row's own, so a doc_id that very many rows share is cut too.
    ordered = recipes.repartitionByRange(int(total // part_bytes) + 1, "doc_id", "rid").sortWithinPartitions("doc_id", "rid").withColumn("part", F.spark_partition_id())
    ordered.write.option("compression", "zstd").parquet(f"{path}/recipes")
    _first_of_each(staged.filter("kind = 1").select("hash", "ids")).write.option("compression", "zstd").parquet(f"{path}/chunks")
    drop_stage(staged)
    read_recipes(docs.sparkSession, path).select("part", "rid", "doc_id", "n_tokens", "root").groupBy("part").applyInArrow(_manifest_part, _MANIFEST).write.parquet(f"{path}/manifest")


def _in_order(table: pa.Table) -> np.ndarray:
    return np.lexsort((table.column("rid").to_numpy(), table.column("doc_id").fill_null(-(1 << 63)).to_numpy()))


def _manifest_part(table: pa.Table) -> pa.Table:
    """One row for one part of the recipes, which holds about PART_BYTES."""
    roots = table.column("root").to_pylist()
    return pa.table({"part": pa.array([table.column("part")[0].as_py()], pa.int32()), "documents": [table.num_rows], "tokens": [int(table.column("n_tokens").to_numpy().sum())], "root": pa.array([merkle([roots[i] for i in _in_order(table)])], pa.binary())})


_MANIFEST = "part int, documents long, tokens long, root binary"
_RECIPES = "rid long, doc_id long, n_tokens long, hashes binary, lengths binary, root binary, part int"


def read_recipes(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(_RECIPES).parquet(f"{path}/recipes")


def read_chunks(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("hash binary, ids binary").parquet(f"{path}/chunks")


def _entries(batches):
    for b in batches:
        for c in range(0, b.num_rows, 2000):
            s = b.slice(c, 2000)
            rid, hashes = s.column("rid").to_pylist(), s.column("hashes").to_pylist()
            n = [len(h) // 16 for h in hashes]
            data = b"".join(hashes)
            seq = np.concatenate([np.arange(k) for k in n]) if n else np.zeros(0)
            flat = pa.FixedSizeBinaryArray.from_buffers(pa.binary(16), len(data) // 16, [None, pa.py_buffer(data)]).cast(pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(rid, n).astype(np.int64)), pa.array(seq.astype(np.int32)), flat], names=["rid", "seq", "hash"])


def _verified(batches):
    """Chunks as read from the files, each checked against its hash, with length and CRC-32."""
    for b in batches:
        hashes, stored, digest = b.column("hash").to_pylist(), b.column("ids").to_pylist(), hashlib.blake2b
        if any([digest(raw, digest_size=16).digest() != h for h, raw in zip(hashes, stored, strict=True)]):
            raise ValueError("a stored chunk does not match its hash")
        if all([raw[0] == 2 for raw in stored]):
            size = np.fromiter(map(len, stored), np.int64, len(stored)) - 1 >> 1
            wide = np.frombuffer(b"".join([raw[1:] for raw in stored]), "<u2").astype("<u4")
            view, at = memoryview(wide.tobytes()), [0, *(4 * np.cumsum(size)).tolist()]
            crc = [zlib.crc32(view[x:y]) for x, y in zip(at, at[1:], strict=False)]
        else:
            values = [unpack_ids(raw) for raw in stored]
            size, crc = np.array([len(v) for v in values]), [zlib.crc32(v.tobytes()) for v in values]
        yield pa.RecordBatch.from_arrays([b.column("hash"), pa.array(size.astype(np.int32)), pa.array(crc, pa.int64())], names=["hash", "n", "crc"])


def read_manifest(spark: SparkSession, path: str) -> dict[int, tuple[int, int, bytes]]:
    """part: (ids before it, documents, root), one entry per recipe part; counts must be those of the recipes."""
    listed = {r.part: (r.documents, r.tokens, bytes(r.root)) for r in spark.read.schema(_MANIFEST).parquet(f"{path}/manifest").collect()}
    there = {r.part: (r.documents, r.tokens) for r in read_recipes(spark, path).groupBy("part").agg(F.count(F.lit(1)).alias("documents"), F.sum("n_tokens").alias("tokens")).collect()}
    if there != {p: v[:2] for p, v in listed.items()}:
        raise ValueError("the manifest does not match the recipes")
    out, at = {}, 0
    for p in sorted(listed):
        documents, tokens, root = listed[p]
        out[p] = (at, documents, root)
        at += tokens
    return out


def digest_store(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document, from the files alone.

    Every stored id is read and checked once, in its chunk; a document's CRC-32 is combined from those of its chunks, its
    Merkle root is rebuilt from its recipe, and the roots of a part must give the manifest's. ValueError where any differs.
    """
    manifest = spark.sparkContext.broadcast(read_manifest(spark, path))
    recipes = read_recipes(spark, path)
    entries = recipes.select("rid", "hashes").mapInArrow(_entries, "rid long, seq int, hash binary")
    facts = read_chunks(spark, path).mapInArrow(_verified, "hash binary, n int, crc long")
    found = entries.join(facts, "hash", "left").groupBy("rid").agg(F.collect_list(F.struct("seq", "n", "crc")).alias("parts"))
    joined = recipes.select("part", "rid", "doc_id", "n_tokens", "hashes", "root").join(found, "rid", "left")

    def combine(batches):
        for b in batches:
            flat = b.column("parts").flatten()
            if flat.field("n").null_count:
                raise ValueError("a chunk is missing from the store")
            size = pa.compute.list_value_length(b.column("parts")).fill_null(0).to_numpy()
            rows = np.repeat(np.arange(len(size)), size)
            seq, n, crc = (flat.field(k).to_numpy(zero_copy_only=False) for k in ("seq", "n", "crc"))
            order = np.lexsort((seq, rows))
            rows, seq, n, crc = rows[order], seq[order], n[order], crc[order]
            ends = np.cumsum(size)
            sums = np.concatenate(([0], np.cumsum(n, dtype=np.int64)))
            ids = sums[ends] - sums[ends - size]
            after = sums[ends][rows] - sums[1:]
            total, live = np.zeros(len(size), np.uint32), np.flatnonzero(size)
            if len(live):
                total[live] = np.bitwise_xor.reduceat(crc_shift(crc, 4 * after), (ends - size)[live])
            hashes, roots, want = b.column("hashes").to_pylist(), b.column("root").to_pylist(), b.column("n_tokens").to_numpy()
            for i, h in enumerate(hashes):
                if size[i] != len(h) // 16 or ids[i] != want[i] or merkle([h[j : j + 16] for j in range(0, len(h), 16)]) != roots[i]:
                    raise ValueError("a recipe does not match its chunks or its root")
            yield pa.RecordBatch.from_arrays([b.column("part"), b.column("rid"), b.column("doc_id"), pa.array(ids), pa.array(total.astype(np.int64)), b.column("root")], names=["part", "rid", "doc_id", "n_tokens", "ids_crc32", "root"])

    done = joined.mapInArrow(combine, "part int, rid long, doc_id long, n_tokens long, ids_crc32 long, root binary")

    def number(table: pa.Table) -> pa.Table:
        """A part, of bounded size, in order."""
        order = _in_order(table)
        table = table.take(pa.array(order))
        start, documents, root = manifest.value[table.column("part")[0].as_py()]
        if table.num_rows != documents or merkle(table.column("root").to_pylist()) != root:
            raise ValueError("a part of the recipes does not match the manifest's root")
        n = table.column("n_tokens").to_numpy()
        return pa.table({"doc_id": table.column("doc_id"), "start": pa.array(start + np.cumsum(n) - n, pa.int64()), "n_tokens": table.column("n_tokens"), "ids_crc32": table.column("ids_crc32")})

    return done.groupBy("part").applyInArrow(number, "doc_id long, start long, n_tokens long, ids_crc32 long")


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """rid, doc_id and ids (little-endian 32-bit) of every document, rebuilt chunk by chunk in recipe order.

    ValueError if a chunk is missing, or the manifest's counts are not those of the recipes.
    """
    read_manifest(spark, path)
    recipes = read_recipes(spark, path)
    entries = recipes.select("rid", "hashes").mapInArrow(_entries, "rid long, seq int, hash binary")
    parts = entries.join(read_chunks(spark, path), "hash", "left").groupBy("rid").agg(F.array_sort(F.collect_list(F.struct("seq", "ids"))).alias("parts"))

    def rebuild(batches):
        for b in batches:
            ids = []
            for parts, hashes in zip(b.column("parts").to_pylist(), b.column("hashes").to_pylist(), strict=True):
                if len(parts or ()) != len(hashes) // 16 or any(p["ids"] is None for p in parts):
                    raise ValueError("a chunk is missing from the store")
                ids.append(b"".join([unpack_ids(p["ids"]).tobytes() for p in parts]))
            yield pa.RecordBatch.from_arrays([b.column("rid"), b.column("doc_id"), pa.array(ids, pa.binary())], names=["rid", "doc_id", "ids"])

    return recipes.select("rid", "doc_id", "hashes").join(parts, "rid", "left").mapInArrow(rebuild, "rid long, doc_id long, ids binary")


def store_and_digest(docs: DataFrame, tokenizer: str, end_id: int = END_ID, path: str | None = None) -> DataFrame:
    """Write the store in the shared folder, read it back and return its digest."""
    spark = docs.sparkSession
    path = path or f"{shared_dir(spark).rstrip('/')}/store-{uuid.uuid4().hex}"
    write_store(docs, path, tokenizer, end_id)
    return digest_store(spark, path)
