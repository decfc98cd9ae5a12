"""Line dedup: range-partitioned line hashes, read as a stream in order of hash, document and position.

Rows (128-bit key hash, document, position) are dealt by range of (hash, document), so a line that stands
in a third of all documents is spread over many partitions, and sorted within them. One pass counts the
documents of each key and hands out the positions to drop as soon as the count reaches ``min_docs``; it
never holds more than ``min_docs - 1`` documents of a key. A key cut by a partition's edge and not yet
decided there is settled afterwards from the edge rows alone (under ``2 * min_docs`` documents a
partition). The result is a zlib-compressed keep bitmap per document; texts are not shuffled for it.

Null and empty texts are one empty line, which always stays. Rows repeated under one doc_id count once
towards ``min_docs`` and lose the same lines. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import BLANKS, LOWER, UPPER, documents, lean, parts, stored

SEEN = "kind int, h1 long, h2 long, doc_id long, row_key long, pos int, n_lines int"
DROP, EDGE, COMMON = 0, 1, 2


def line_hashes(docs: DataFrame, min_chars: int = 1) -> DataFrame:
    """h1, h2, doc_id, row_key, pos, n_lines of every line whose key has ``min_chars`` code points."""
    key = F.translate(F.expr(f"trim(BOTH {_quoted(BLANKS)} FROM line)"), UPPER, LOWER)
    lines = documents(docs).select("doc_id", "row_key", F.split("text", "\n").alias("lines")).select("doc_id", "row_key", F.size("lines").alias("n_lines"), F.posexplode("lines").alias("pos", "line"))
    return lines.withColumn("key", key).where(F.length("key") >= min_chars).select(F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(7), "key").alias("h2"), "doc_id", "row_key", "pos", "n_lines")


def _quoted(s: str) -> str:
    return "'" + "".join(f"\\u{ord(c):04x}" for c in s) + "'"


def _walk(min_docs: int):
    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []  # rows of the open key while it has fewer than min_docs documents
        key, last, docs, first_key = None, None, 0, True
        names = ["kind", "h1", "h2", "doc_id", "row_key", "pos", "n_lines"]
        types = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32()]

        def packed(rows):
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names)

        def close(rows: list, edge: bool) -> None:
            if key is None or not edge:
                return
            if docs >= min_docs:
                rows.append((COMMON, *key, None, None, None, None))
            else:
                rows.extend((EDGE, *key, *r) for r in held)

        for batch in batches:
            out: list[tuple] = []
            h1, h2, doc, row, pos, n = (batch.column(i).to_pylist() for i in range(6))
            for a, b, d, r, p, m in zip(h1, h2, doc, row, pos, n, strict=True):
                if (a, b) != key:
                    close(out, first_key)
                    first_key = key is None
                    key, last, docs, held = (a, b), (), 0, []
                if d != last:
                    last, docs = d, docs + 1
                    if docs == min_docs:
                        out.extend((DROP, *key, *x) for x in held)
                        held = []
                if docs >= min_docs:
                    out.append((DROP, a, b, d, r, p, m))
                else:
                    held.append((d, r, p, m))
            yield packed(out)
        out = []
        close(out, True)
        yield packed(out)

    return walk


def dropped_lines(docs: DataFrame, min_docs: int = 10, min_chars: int = 1) -> DataFrame:
    """doc_id, row_key, pos, n_lines of every line to drop."""
    rows = line_hashes(docs, min_chars)
    ranged = rows.repartitionByRange(parts(docs.sparkSession), "h1", "h2", "doc_id").sortWithinPartitions("h1", "h2", "doc_id", "pos")
    seen = stored(ranged.mapInArrow(lean(_walk(max(1, min_docs))), SEEN))
    edges = seen.where(F.col("kind") != DROP)
    # A document's rows of one key share a partition, so distinct documents add up; there are few rows here.
    common = edges.groupBy("h1", "h2").agg(F.max((F.col("kind") == COMMON).cast("int")).alias("sure"), F.count_distinct("doc_id").alias("docs")).where((F.col("sure") == 1) | (F.col("docs") >= min_docs))
    settled = edges.where(F.col("kind") == EDGE).join(common.select("h1", "h2"), ["h1", "h2"], "left_semi")
    return seen.where(F.col("kind") == DROP).unionByName(settled).select("doc_id", "row_key", "pos", "n_lines")


def keep_bitmaps(docs: DataFrame, min_docs: int = 10, min_chars: int = 1) -> DataFrame:
    """doc_id, row_key, n_lines, keep_bitmap (zlib of packed bits, first line first) of documents that lose a line."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            maps = []
            for n, gone in zip(batch.column("n_lines").to_pylist(), batch.column("gone").to_pylist(), strict=True):
                bits = np.ones(n, bool)
                bits[gone] = False
                maps.append(zlib.compress(np.packbits(bits).tobytes(), 1))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("row_key"), batch.column("n_lines"), pa.array(maps, pa.binary())], ["doc_id", "row_key", "n_lines", "keep_bitmap"])

    gone = dropped_lines(docs, min_docs, min_chars).groupBy("doc_id", "row_key").agg(F.max("n_lines").alias("n_lines"), F.collect_set("pos").alias("gone"))
    return gone.mapInArrow(lean(pack), "doc_id long, row_key long, n_lines int, keep_bitmap binary")


def with_bitmaps(docs: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """docs, all columns, with row_key_ and __keep_bitmap (null: nothing goes)."""
    b = bitmaps.select(F.col("doc_id").alias("__b_id"), F.col("row_key").alias("__b_key"), F.col("keep_bitmap").alias("__keep_bitmap"))
    keyed = docs.withColumn("__d_key", F.xxhash64(F.coalesce(F.col("text"), F.lit(""))))
    return keyed.join(b, keyed.doc_id.eqNullSafe(b["__b_id"]) & (keyed["__d_key"] == b["__b_key"]), "left").drop("__b_id", "__b_key", "__d_key")


def kept_lines(text: str | None, bitmap: bytes | None) -> tuple[int, str]:
    """(lines before, the kept lines joined)."""
    lines = (text or "").split("\n")
    if bitmap is None:
        return len(lines), text or ""
    keep = np.unpackbits(np.frombuffer(zlib.decompress(bitmap), np.uint8), count=len(lines))
    return len(lines), "\n".join(x for x, k in zip(lines, keep, strict=True) if k)


def deduplicated(docs: DataFrame, min_docs: int = 10, min_chars: int = 1) -> DataFrame:
    """docs with the dropped lines gone; n_chars, where there is one, follows. A document that lost every line stays, empty."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text, bits = batch.column("text").to_pylist(), batch.column("__keep_bitmap").to_pylist()
            new = [t if b is None else kept_lines(t, b)[1] for t, b in zip(text, bits, strict=True)]
            at = batch.schema.get_field_index("text")
            yield batch.set_column(at, batch.schema.field(at), pa.array(new, batch.schema.field(at).type)).drop_columns(["__keep_bitmap"])

    schema = docs.schema
    out = with_bitmaps(docs, keep_bitmaps(docs, min_docs, min_chars)).mapInArrow(lean(apply), schema)
    return out.withColumn("n_chars", F.length("text").cast(schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def line_dedup_digest(docs: DataFrame, min_docs: int = 10, min_chars: int = 1) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept_sha256 of every document."""

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, gone, sha = [], [], []
            for t, b in zip(batch.column("text").to_pylist(), batch.column("__keep_bitmap").to_pylist(), strict=True):
                lines, kept = kept_lines(t, b)
                n.append(lines)
                gone.append(0 if b is None else lines - int(np.unpackbits(np.frombuffer(zlib.decompress(b), np.uint8), count=lines).sum()))
                sha.append(hashlib.sha256(kept.encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(sha)], ["doc_id", "n_lines", "n_dropped", "kept_sha256"])

    slim = documents(docs).select("doc_id", "text")
    return with_bitmaps(slim, keep_bitmaps(docs, min_docs, min_chars)).select("doc_id", "text", "__keep_bitmap").mapInArrow(lean(digest), "doc_id long, n_lines long, n_dropped long, kept_sha256 string")
