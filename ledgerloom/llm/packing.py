"""Best-fit packing: vector best fit over tokens, document count and attention cost.

Texts are cut into pieces of at most ``max_tokens`` ids. Pieces are dealt by hash to shards of a bounded
number, and each shard packs longest first: among the open bins whose residual capacities admit the piece
under every constraint, the one with the smallest weighted residual norm (or the largest weighted dot
product) is taken. The few least filled bins of a shard are dissolved and their pieces packed again, together with
those of ``FAN`` neighbouring shards, in rounds, so that loose ends don't add up with the number of shards. Full pieces take a bin at once. Only piece lengths are shuffled, never ids or texts.

Null and empty texts are documents of the end id alone. Repeated rows are packed as rows of their own
(told apart by an occurrence number in ``copy_``). An empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import documents, lean, stored
from .textarrays import STRETCH, Words, long_rows_cut, ragged, slices, text_buffers
from .token_counts import coder, may_fold

#: Pieces of a shard (about), and shards that meet in a later round.
SHARD, FAN = 6000, 64
#: A shard's least filled bins under this share of the tokens are packed again in the next round, this many at most.
LOOSE_UNDER, LOOSE_BINS = 0.92, 16


@dataclass(frozen=True)
class Capacities:
    """What a bin holds, and the weight of each capacity in the fit. Attention costs the squared length of each piece."""

    tokens: int = 4096
    documents: int = 4096
    attention: float = 4096.0**2
    weights: tuple[float, float, float] = (1.0, 0.05, 0.05)
    rule: str = "norm"


def best_fit(lengths: np.ndarray, cap: Capacities) -> np.ndarray:
    """Bin of each piece. Longest first; a piece goes where the fit is best under all three capacities."""
    order = np.argsort(-lengths, kind="stable")
    out = np.empty(len(lengths), np.int64)
    full = np.array([cap.tokens, cap.documents, cap.attention], float)
    need = np.stack([lengths, np.ones(len(lengths)), lengths.astype(float) ** 2], 1) / full
    weight = np.array(cap.weights)
    left = np.empty((max(16, len(lengths)), 3))  # residuals of open bins, as shares of the capacities
    ident = np.empty(len(left), np.int64)
    n, bins, least = 0, 0, need.min(0) if len(need) else None
    eps = 1e-9
    for i in order:
        d = need[i]
        open_ = left[:n]
        fits = (open_[:, 0] >= d[0] - eps) & (open_[:, 1] >= d[1] - eps) & (open_[:, 2] >= d[2] - eps)
        if fits.any():
            at = np.flatnonzero(fits)
            if cap.rule == "norm":
                k = at[np.argmin((((open_[at] - d) ** 2) * weight).sum(1))]
            else:
                k = at[np.argmax((open_[at] * d * weight).sum(1))]
            left[k] -= d
        else:
            k = n
            left[k], ident[k] = 1.0 - d, bins
            n, bins = n + 1, bins + 1
        out[i] = ident[k]
        if (left[k] < least - eps).any():  # nothing fits any more: close it
            n -= 1
            left[k], ident[k] = left[n], ident[n]
    return out


def encoded(data: np.ndarray, offsets: np.ndarray, path: str) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, ids, tokens of each row) of whole rows, lot by lot; the ids are the library's."""
    own = coder(path)
    cuts, row = long_rows_cut(data, offsets, STRETCH)
    held: list[np.ndarray] = []  # ids of a long row that goes on in the next stretch
    for lo, hi in slices(cuts, STRETCH):
        words = Words(data, cuts, lo, hi, fold=may_fold(data[cuts[lo] : cuts[hi]]))
        at = own.words(words) if len(words.start) else np.zeros(0, np.int64)
        lengths = own.lengths[at].astype(np.int64)
        ids = own.ids[ragged(own.starts[at], lengths)]
        rows = row[lo:hi] - row[lo]
        counts = np.bincount(rows[words.row], lengths, rows[-1] + 1).astype(np.int64)
        if held:
            counts[0] += sum(map(len, held))
            ids, held = np.concatenate([*held, ids]), []
        if hi < len(row) and row[hi] == row[hi - 1]:
            keep = len(ids) - counts[-1]
            held, ids, counts = [ids[keep:]], ids[:keep], counts[:-1]
        if len(counts):
            yield int(row[lo]), ids, counts


def pieces(docs: DataFrame, path: str, end_id: int = 1, max_tokens: int = 4096) -> DataFrame:
    """doc_id, row_key, copy_, piece, start, length, ids_crc32."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, ids, counts in encoded(*text_buffers(batch.column("text")), path):
                size = counts + 1
                ends = np.cumsum(size)
                all_ = np.full(int(ends[-1]), end_id, "<u4")
                all_[ragged(ends - size, counts)] = ids
                n = -(-size // max_tokens)
                row = np.repeat(np.arange(len(size)), n)
                piece = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
                start = piece * max_tokens
                length = np.minimum(size[row] - start, max_tokens)
                begin = ((ends - size)[row] + start) * 4
                raw = memoryview(all_).cast("B")
                crc = [zlib.crc32(raw[a : a + m]) for a, m in zip(begin.tolist(), (length * 4).tolist(), strict=True)]
                at = pa.array(row + first)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(at), batch.column("row_key").take(at), batch.column("copy_").take(at), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), pa.array(crc, pa.int64())], ["doc_id", "row_key", "copy_", "piece", "start", "length", "ids_crc32"])

    copy = F.monotonically_increasing_id().alias("copy_")
    schema = "doc_id long, row_key long, copy_ long, piece int, start long, length long, ids_crc32 long"
    return documents(docs).select("doc_id", "row_key", copy, "text").mapInArrow(lean(cut), schema)


def pack(cut: DataFrame, cap: Capacities = Capacities(), shard: int = SHARD) -> DataFrame:
    """cut (as of ``pieces``), with sequence_id and offset (the place in the sequence). cut is read several times: store it first."""
    full = cut.where(F.col("length") >= cap.tokens)
    rest = cut.where(F.col("length") < cap.tokens)
    n = rest.count()
    shards = max(1, -(-n // shard))
    schema = "doc_id long, row_key long, copy_ long, piece int, start long, length long, ids_crc32 long, shard int, sequence_id long, offset long, loose boolean"

    def fill(last: bool, level: int):
        def one(rows: pd.DataFrame) -> pd.DataFrame:
            rows = rows.sort_values(["length", "doc_id", "row_key", "piece", "copy_"], ascending=[False, True, True, True, True], kind="stable", ignore_index=True)
            lengths = rows["length"].to_numpy()
            bins = best_fit(lengths, cap)
            order = np.argsort(bins, kind="stable")
            before = np.cumsum(lengths[order]) - lengths[order]
            heads = np.flatnonzero(np.diff(bins[order], prepend=-1))
            offset = np.empty(len(rows), np.int64)
            offset[order] = before - np.repeat(before[heads], np.diff(np.append(heads, len(rows))))
            used = np.bincount(bins, weights=lengths)
            rows["sequence_id"] = (level << 56) + (rows["shard"].to_numpy(np.int64) << 24) + bins
            poor = np.argsort(used, kind="stable")[:LOOSE_BINS]
            loose = np.zeros(len(used), bool)
            loose[poor[used[poor] < LOOSE_UNDER * cap.tokens]] = not last
            rows["offset"], rows["loose"] = offset, loose[bins]
            return rows

        return one

    done, level = None, 1
    rest = rest.withColumn("shard", F.pmod(F.xxhash64("doc_id", "row_key", "piece", "copy_"), F.lit(shards)).cast("int"))
    blank = [F.lit(0).cast("long").alias("sequence_id"), F.lit(0).cast("long").alias("offset"), F.lit(False).alias("loose")]
    while True:
        last = shards == 1
        packed = rest.select("*", *(blank if "loose" not in rest.columns else [])).groupBy("shard").applyInPandas(fill(last, level), schema)
        if not last:
            packed = stored(packed)
        tight = packed.where(~F.col("loose"))
        done = tight if done is None else done.unionByName(tight)
        if last:
            break
        rest = packed.where("loose").withColumn("shard", F.floor(F.col("shard") / FAN).cast("int"))
        shards, level = -(-shards // FAN), level + 1
    whole = full.select("*", F.lit(0).alias("shard"), F.monotonically_increasing_id().alias("_m"))
    whole = whole.select(*cut.columns, "shard", (-1 - F.col("_m")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"), F.lit(False).alias("loose"))
    return done.unionByName(whole).drop("shard", "loose")


def pack_documents(docs: DataFrame, path: str, end_id: int = 1, cap: Capacities = Capacities()) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece of every row."""
    cut = stored(pieces(docs, path, end_id, cap.tokens))
    return pack(cut, cap).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
