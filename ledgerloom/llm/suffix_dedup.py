"""Suffix-array dedup: bytes that lie in a string of ``length`` bytes which starts anywhere else, too.

1. Anchors. Every window of ``length`` bytes has a canonical anchor: of its ``GRAM``-byte strings the one of
   least hash. Equal windows have equal anchors at equal distances, so only windows of equal anchors need
   comparing. Windows of one anchor are consecutive and make a segment; about 1.2 % of the places are
   anchors.
2. Segments are range-partitioned by (anchor hash, two segment hashes, text) and read as a sorted stream. A
   segment whose like (by 128 bits of hashes beside the anchor's 64) stands elsewhere is a repeat as a whole;
   equal segments are thus aggregated before any text is moved. An anchor of which there are different
   segments needs their bytes.
3. All of these, groups of two included, are sorted by anchor with deep-shallow suffix sorting
   (``deep_shallow``). Anchors with more than ``CROWD`` different segments, such as the ends of a passage in a
   third of all texts, never meet in one task: their windows are compared by 128-bit digests in a
   pre-aggregated count. Up to ``TOGETHER`` neighbouring windows, cut alike as seen from the anchor, are compared
   as one stretch first; only one of each different stretch is taken apart into windows.
4. Runs of repeated windows come together by text, and each text is cut once.

Texts are UTF-8 bytes; matches never cross texts. Null and short texts lose nothing. Equal texts are
repeats of each other (of ``length`` bytes or more), rows repeated under one doc_id included; they are counted
as whole texts, compared once, and share one result. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .deep_shallow import repeated
from .shared import lean, modest, parts, written
from .textarrays import _BYTE, _INV, _MULT, mix, ragged, slices, text_buffers

GRAM, CROWD, TOGETHER = 32, 2000, 8
#: Bytes of text whose segments are worked out at once.
MOST = 1 << 18
_POWERS: dict[int, tuple[np.ndarray, ...]] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    have = _POWERS.get(0)
    if have is None or len(have[0]) <= n:
        have = _POWERS[0] = (np.cumprod(np.full(n + 1, _MULT, np.uint64)), np.cumprod(np.full(n + 1, _INV, np.uint64)))
    return have


def _places(n: int) -> np.ndarray:
    have = _POWERS.get(1)
    if have is None or len(have[0]) < n:
        have = _POWERS[1] = (np.arange(n, dtype=np.uint64),)
    return have[0][:n]


def _prefix(data: np.ndarray, kind: int = 0) -> np.ndarray:
    """Sums that give the hash of any stretch of bytes by one difference and one product; kind 1: an independent one."""
    total = np.zeros(len(data) + 1, np.uint64)
    value = _BYTE[::-1] * _MULT ^ _BYTE if kind else _BYTE
    np.cumsum(value[data] * _powers(len(data))[0][: len(data)], out=total[1:])
    return total


def _stretch(total: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (total[b] - total[a]) * _powers(len(total))[1][a]


def segments(data: np.ndarray, offsets: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """(row, anchor hash, two segment hashes, first window, last window, anchor) with places relative to the row."""
    n, width = len(data), length - GRAM + 1
    if n < length:
        return tuple(np.zeros(0, np.int64) for _ in range(7))
    total = _prefix(data)
    gram = (total[GRAM:] - total[:-GRAM]) * _powers(n + 1)[1][: n - GRAM + 1]
    gram ^= gram >> np.uint64(31)
    gram *= np.uint64(0x94D049BB133111EB)
    value = gram & np.uint64((1 << 64) - (1 << 28))
    value |= _places(len(value))
    for e in offsets[1:-1]:  # strings across the end of a row are none
        value[max(0, e - GRAM + 1) : e] = np.uint64((1 << 64) - 1)
    pad = -len(value) % width
    block = np.concatenate([value, np.full(pad, (1 << 64) - 1, np.uint64)]).reshape(-1, width)
    ahead = np.minimum.accumulate(block, 1).ravel()
    behind = np.minimum.accumulate(block[:, ::-1], 1)[:, ::-1].ravel()
    windows = n - length + 1
    least = np.minimum(behind[:windows], ahead[width - 1 : width - 1 + windows])
    ends = offsets[1:-1]
    cut = np.unique(np.concatenate([[0], np.flatnonzero(least[1:] != least[:-1]) + 1, ends, ends - length + 1]))
    cut = cut[(cut >= 0) & (cut < windows)]
    last = np.append(cut[1:], windows) - 1
    row = np.searchsorted(offsets, cut, "right") - 1
    keep = cut + length <= offsets[row + 1]
    first, last, r = cut[keep], last[keep], row[keep]
    at = (least[first] & np.uint64((1 << 28) - 1)).astype(np.int64)
    place = ((at - first).astype(np.uint64) << np.uint64(32)) + (last - first).astype(np.uint64)
    segment = mix(_stretch(total, first, last + length) + place)
    other = mix(_stretch(_prefix(data, 1), first, last + length) ^ mix(place))
    base = offsets[r]
    return r, mix(gram[at]), segment, other, first - base, last - base, at - base


def all_segments(data: np.ndarray, offsets: np.ndarray, length: int) -> Iterator[tuple[np.ndarray, ...]]:
    """``segments`` of rows, a bounded number of bytes at once; a long row comes in stretches that overlap by a window."""
    for lo, hi in slices(offsets, MOST):
        begin, end = int(offsets[lo]), int(offsets[hi])
        for a in range(begin, end, MOST) if hi - lo == 1 else [begin]:
            b = min(end, a + MOST + length - 1) if hi - lo == 1 else end
            r, key, seg, other, first, last, at = segments(data[a:b], offsets[lo : hi + 1] - begin if hi - lo > 1 else np.array([0, b - a]), length)
            yield r + lo, key, seg, other, first + (a - begin), last + (a - begin), at + (a - begin)


def _ident(text) -> list:
    """Two independent hashes stand for a text."""
    return [F.xxhash64(text).alias("t1"), F.xxhash64(F.lit(7), text).alias("t2")]


def _texts(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    return modest(docs).select(F.col("doc_id").cast("long").alias("doc_id"), *_ident(text), text.alias("text"))


NAMES = ["key", "seg", "seg2", "t1", "t2", "first", "last", "ahead"]
PLACED = "key long, seg long, seg2 long, t1 long, t2 long, first int, last int, ahead int"
FULL, MIXED, EDGE = 0, 1, 2


def _segments(texts: DataFrame, length: int) -> DataFrame:
    """Segments of texts; copies within a batch are left out, and others by the sorted stream."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = np.stack([batch.column(c).to_numpy() for c in ("t1", "t2")], 1)
            fresh = np.sort(np.unique(own, axis=0, return_index=True)[1])
            batch = batch.take(pa.array(fresh))
            data, offsets = text_buffers(batch.column("text"))
            t1, t2 = own[fresh, 0], own[fresh, 1]
            for r, key, seg, other, first, last, anchor in all_segments(data, offsets, length):
                columns = [key.view(np.int64), seg.view(np.int64), other.view(np.int64), t1[r], t2[r], first.astype(np.int32), last.astype(np.int32), (anchor - first).astype(np.int32)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], NAMES)

    return texts.where(F.octet_length("text") >= length).select("t1", "t2", "text").mapInArrow(lean(work), PLACED)


def _sorted_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From segments in order of (key, seg, text): repeats (FULL), different segments of one anchor (MIXED, one of each), and
    one of each segment of the first and last anchor (EDGE), whose others may stand in the next partition."""
    names = NAMES
    carried: pa.Table | None = None
    at_start = True

    def told(t: pa.Table, first_edge: bool, last_edge: bool) -> pa.RecordBatch:
        columns = [t.column(c).to_numpy() for c in ("key", "seg", "seg2", "t1", "t2", "first")]
        differ = np.concatenate([[True], np.any([c[1:] != c[:-1] for c in columns], axis=0)])
        t = t.filter(pa.array(differ))  # the same segment of a copy of the text
        key, seg, seg2 = (c[differ] for c in columns[:3])
        new_key = np.concatenate([[True], key[1:] != key[:-1]])
        new_seg = new_key | np.concatenate([[True], (seg[1:] != seg[:-1]) | (seg2[1:] != seg2[:-1])])
        of_key, of_seg = np.cumsum(new_key) - 1, np.cumsum(new_seg) - 1
        copies = np.bincount(of_seg)[of_seg]
        kinds = np.bincount(of_key, new_seg)[of_key]
        edge = np.zeros(len(key), bool)
        if first_edge:
            edge |= of_key == 0
        if last_edge:
            edge |= of_key == of_key[-1]
        full = copies > 1
        mixed = ~edge & (kinds > 1) & new_seg
        pick = [np.flatnonzero(m) for m in (full, mixed, edge & new_seg)]
        at = np.concatenate(pick)
        kind = np.repeat([FULL, MIXED, EDGE], [len(p) for p in pick]).astype(np.int32)
        out = t.take(pa.array(at))
        return pa.table([*(out.column(n) for n in names), pa.array(kind), pa.array((copies[at] > 1)), pa.array(kinds[at].astype(np.int64))], [*names, "kind", "settled", "kinds"])

    for batch in batches:
        if not batch.num_rows:
            continue
        t = pa.table(batch) if carried is None else pa.concat_tables([carried, pa.table(batch)])
        key = t.column("key").to_numpy()
        cut = int(np.flatnonzero(key != key[-1])[-1]) + 1 if key[0] != key[-1] else 0
        carried = t.slice(cut)
        if cut:
            yield from told(t.slice(0, cut), at_start, False).to_batches()
            at_start = False
        elif carried.num_rows > 20_000:  # one anchor over several batches: leave it to the count over all partitions
            yield from told(carried, True, True).to_batches()
            carried, at_start = None, True
    if carried is not None and carried.num_rows:
        yield from told(carried, True, True).to_batches()


SORTED = PLACED + ", kind int, settled boolean, kinds long"


def repeated_windows(docs: DataFrame, length: int = 200) -> DataFrame:
    """t1, t2, first, last: runs of window starts whose windows stand elsewhere, too."""
    texts = _texts(docs)
    n = parts(docs.sparkSession)
    distinct = written(texts.groupBy("t1", "t2").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"), F.max(F.octet_length("text")).alias("size")))
    copied_texts = distinct.where(f"copies > 1 AND size >= {length}").select("t1", "t2", F.lit(0).alias("first"), (F.col("size") - length).cast("int").alias("last"))
    ranged = _segments(texts, length).repartitionByRange(n, "key", "seg", "t1").sortWithinPartitions("key", "seg", "seg2", "t1", "t2", "first")
    told = written(ranged.mapInArrow(lean(_sorted_out), SORTED))
    columns = NAMES
    edges = told.where(F.col("kind") == EDGE).select(*columns, "settled")
    one = F.min(F.struct("t1", "t2", "first", "last", "ahead")).alias("one")
    likes = edges.groupBy("key", "seg", "seg2").agg(((F.count("*") > 1) | F.max("settled")).alias("settled"), one)
    kinds = likes.groupBy("key").agg(F.count("*").alias("kinds"))
    copied = likes.where("settled").select(F.col("key").alias("k"), F.col("seg").alias("s"), F.col("seg2").alias("s2"))
    alone = edges.where(~F.col("settled"))
    edge_full = alone.join(copied, (alone.key == copied.k) & (alone.seg == copied.s) & (alone.seg2 == copied.s2), "left_semi")
    edge_mixed = likes.join(kinds.where("kinds > 1"), "key").select("key", "seg", "seg2", "one.*", "settled", "kinds")
    full = told.where(F.col("kind") == FULL).select("t1", "t2", "first", "last").unionByName(edge_full.select("t1", "t2", "first", "last"))
    mixed = told.where(F.col("kind") == MIXED).select(*columns, "settled", "kinds").unionByName(edge_mixed.select(*columns, "settled", "kinds"))
    return full.unionByName(copied_texts).unionByName(_compared(texts, distinct, mixed, length))


def _compared(texts: DataFrame, distinct: DataFrame, mixed: DataFrame, length: int) -> DataFrame:
    """Repeated windows of segments whose anchors have different segments; settled ones are repeats anyway and serve to compare."""
    by_text = mixed.groupBy("t1", "t2").agg(F.collect_list(F.struct("key", "first", "last", "ahead", "settled", "kinds")).alias("segs"))
    wanted = by_text.join(distinct.select("t1", "t2", "rep"), ["t1", "t2"]).withColumnsRenamed({"t1": "w1", "t2": "w2"})
    # one row per text: of rows repeated under one doc_id, segments come twice and are told apart below
    rows = texts.join(wanted, texts.doc_id.eqNullSafe(wanted.rep) & (texts.t1 == wanted.w1) & (texts.t2 == wanted.w2)).select("t1", "t2", "text", "segs")
    schema = "key long, t1 long, t2 long, first int, ahead int, settled boolean, bytes binary, w1 long, w2 long, at int, run int, windows binary"

    names = ["key", "t1", "t2", "first", "ahead", "settled", "bytes", "w1", "w2", "at", "run", "windows"]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_buffers(batch.column("text"))
            segs = batch.column("segs")
            row = np.repeat(np.arange(batch.num_rows), segs.value_lengths().to_numpy())
            s = {c: segs.flatten().field(c).to_numpy(zero_copy_only=False) for c in ("key", "first", "last", "ahead", "settled", "kinds")}
            t1, t2 = (batch.column(c).to_numpy()[row] for c in ("t1", "t2"))
            few = np.flatnonzero(s["kinds"] <= CROWD)
            size = (s["last"] - s["first"]).astype(np.int64) + length
            for lo, hi in slices(np.concatenate([[0], np.cumsum(size[few])]), MOST):
                i = few[lo:hi]
                raw = data[ragged(offsets[row[i]] + s["first"][i], size[i])]
                at = np.concatenate([[0], np.cumsum(size[i])]).astype(np.int32)
                cut_out = pa.Array.from_buffers(pa.binary(), len(i), [None, pa.py_buffer(at), pa.py_buffer(raw)])
                m = len(i)
                yield pa.RecordBatch.from_arrays([pa.array(s["key"][i]), pa.array(t1[i]), pa.array(t2[i]), pa.array(s["first"][i]), pa.array(s["ahead"][i]), pa.array(s["settled"][i]), cut_out, *[pa.nulls(m, pa.int64())] * 2, *[pa.nulls(m, pa.int32())] * 2, pa.nulls(m, pa.binary())], names)
            crowd = np.flatnonzero(s["kinds"] > CROWD)
            for r in np.unique(row[crowd]):
                i = crowd[row[crowd] == r]
                text = data[offsets[r] : offsets[r + 1]]
                n = (s["last"] - s["first"])[i].astype(np.int64) + 1
                at, which = ragged(s["first"][i].astype(np.int64), n), np.repeat(i, n)
                place = at - (s["first"] + s["ahead"])[which]  # as seen from the anchor
                head = np.flatnonzero(np.concatenate([[True], (which[1:] != which[:-1]) | (place[1:] % TOGETHER == 0)]))
                run = np.diff(np.append(head, len(at)))
                for lo, hi in slices(np.append(head, len(at)), MOST):
                    j, c = head[lo:hi], run[lo:hi]
                    own = slice(int(j[0]), int(j[-1] + c[-1]))
                    w1, w2 = digests(text, at[own], at[own] + length, s["key"][which[own]])
                    windows = pa.py_buffer(np.stack([w1, w2], 1))
                    ends = pa.py_buffer(((np.append(j, own.stop) - j[0]) * 16).astype(np.int32))
                    v1, v2 = digests(text, at[j], at[j] + (c - 1) + length, s["key"][which[j]])
                    v2 = mix(v2 + (place[j] * TOGETHER + c).astype(np.uint64))
                    k, m = which[j], len(j)
                    yield pa.RecordBatch.from_arrays([pa.array(s["key"][k]), pa.array(t1[k]), pa.array(t2[k]), pa.nulls(m, pa.int32()), pa.nulls(m, pa.int32()), pa.array(s["settled"][k]), pa.nulls(m, pa.binary()), pa.array(v1.view(np.int64)), pa.array(v2.view(np.int64)), pa.array(at[j].astype(np.int32)), pa.array(c.astype(np.int32)), pa.Array.from_buffers(pa.binary(), m, [None, ends, windows])], names)

    def digests(text: np.ndarray, a: np.ndarray, b: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """128 bits of each stretch [a, b) and its anchor."""
        base, stop = int(a.min()), int(b.max())
        one, other = (_stretch(_prefix(text[base:stop], kind), a - base, b - base) for kind in (0, 1))
        return mix(one), mix(other ^ key.view(np.uint64))

    def apart(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The windows of stretches."""
        for batch in batches:
            n = batch.column("run").to_numpy()
            which = np.repeat(np.arange(len(n)), n)
            windows = np.frombuffer(b"".join(batch.column("windows").to_pylist()), np.int64).reshape(-1, 2)
            at = ragged(batch.column("at").to_numpy().astype(np.int64), n).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(windows[:, 0]), pa.array(windows[:, 1]), *(pa.array(batch.column(c).to_numpy()[which]) for c in ("t1", "t2")), pa.array(at), pa.array(batch.column("settled").to_numpy(zero_copy_only=False)[which])], ["w1", "w2", "t1", "t2", "at", "settled"])

    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Segments in order of key, in lots of whole keys."""
        held: pa.Table | None = None
        for batch in batches:
            held = pa.table(batch) if held is None else pa.concat_tables([held, pa.table(batch)])
            key = held.column("key").to_numpy()
            if held.num_rows > 4000 and key[0] != key[-1]:
                end = int(np.flatnonzero(key != key[-1])[-1]) + 1
                yield from done(held.slice(0, end))
                held = held.slice(end)
        if held is not None and held.num_rows:
            yield from done(held)

    def done(t: pa.Table) -> Iterator[pa.RecordBatch]:
        data, offsets = text_buffers(t.column("bytes"))
        size = np.diff(offsets)
        _, group = np.unique(t.column("key").to_numpy(), return_inverse=True)
        hit = repeated(data, offsets[:-1], size, t.column("ahead").to_numpy().astype(np.int64), group, length)
        windows = size - length + 1
        heads = np.cumsum(windows) - windows
        segment = np.repeat(np.arange(len(size)), windows)
        hit &= ~t.column("settled").to_numpy()[segment]
        same = np.concatenate([[False], segment[1:] == segment[:-1]])
        start = np.flatnonzero(hit & ~(np.concatenate([[False], hit[:-1]]) & same))
        stop = np.flatnonzero(hit & ~(np.concatenate([hit[1:], [False]]) & np.concatenate([same[1:], [False]])))
        s = segment[start]
        first = t.column("first").to_numpy()[s] - heads[s]
        yield pa.RecordBatch.from_arrays([t.column("t1").combine_chunks().take(pa.array(s)), t.column("t2").combine_chunks().take(pa.array(s)), pa.array((start + first).astype(np.int32)), pa.array((stop + first).astype(np.int32))], ["t1", "t2", "first", "last"])

    moved = written(rows.mapInArrow(lean(cut), schema))
    n = parts(texts.sparkSession)
    few = moved.where(F.col("at").isNull()).select("key", "t1", "t2", "first", "ahead", "settled", "bytes").dropDuplicates(["key", "t1", "t2", "first"])
    few = few.repartition(n, "key").sortWithinPartitions("key").mapInArrow(lean(sort), "t1 long, t2 long, first int, last int")
    stretches = moved.where(F.col("at").isNotNull()).select("w1", "w2", "t1", "t2", "at", "run", "windows", "settled").dropDuplicates(["t1", "t2", "at"])
    likes = stretches.groupBy("w1", "w2").agg(((F.count("*") > 1) | F.max("settled")).alias("settled"), F.min(F.struct("t1", "t2", "at", "run", "windows")).alias("one"), (F.count("*") > 1).alias("twice"))
    likes = written(likes.select("w1", "w2", "twice", "settled", "one.*"))
    many = likes.select("t1", "t2", "at", "run", "windows", "settled").mapInArrow(lean(apart), "w1 long, w2 long, t1 long, t2 long, at int, settled boolean")

    def among(rows: DataFrame, twice: DataFrame) -> DataFrame:
        twice = twice.select(F.col("w1").alias("v1"), F.col("w2").alias("v2"))
        return rows.where(~F.col("settled")).join(twice, (F.col("w1") == F.col("v1")) & (F.col("w2") == F.col("v2")), "left_semi")

    whole = among(stretches, likes.where("twice")).select("t1", "t2", F.col("at").alias("first"), (F.col("at") + F.col("run") - 1).alias("last"))
    single = among(many, many.groupBy("w1", "w2").agg(F.count("*").alias("n")).where("n > 1")).select("t1", "t2", F.col("at").alias("first"), F.col("at").alias("last"))
    return few.unionByName(whole).unionByName(single)


def removed_spans(docs: DataFrame, length: int = 200) -> DataFrame:
    """t1, t2, spans: the maximal removed runs [start, end) of each text that loses bytes."""

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for runs in batch.column("runs").to_pylist():
                spans: list[list[int]] = []
                for a, b in sorted((r["first"], r["last"] + length) for r in runs):
                    if spans and a <= spans[-1][1]:
                        spans[-1][1] = max(spans[-1][1], b)
                    else:
                        spans.append([a, b])
                out.append([{"start": a, "end": b} for a, b in spans])
            kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
            yield pa.RecordBatch.from_arrays([batch.column("t1"), batch.column("t2"), pa.array(out, kind)], ["t1", "t2", "spans"])

    runs = repeated_windows(docs, length).groupBy("t1", "t2").agg(F.collect_set(F.struct("first", "last")).alias("runs"))
    return runs.mapInArrow(merge, "t1 long, t2 long, spans array<struct<start:int,end:int>>")


def suffix_dedup(docs: DataFrame, length: int = 200) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept (the remaining bytes) of every row."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, spans = batch.column("text").cast(pa.large_binary()).to_pylist(), batch.column("spans").to_pylist()
            rows: list[list] = [[], [], [], [], []]
            for raw, gone in zip(texts, spans, strict=True):
                gone = gone or []
                kept = b"".join(raw[a:b] for a, b in zip([0, *(g["end"] for g in gone)], [*(g["start"] for g in gone), len(raw)], strict=True))
                for c, v in zip(rows, (len(raw), len(raw) - len(kept), len(gone), hashlib.sha256(kept).hexdigest(), kept), strict=True):
                    c.append(v)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, t) for c, t in zip(rows, (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()), strict=True))], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    spans = removed_spans(docs, length).withColumnsRenamed({"t1": "s1", "t2": "s2"})
    texts = _texts(docs)
    rows = texts.join(spans, (texts.t1 == spans.s1) & (texts.t2 == spans.s2), "left").select("doc_id", "text", "spans")
    return rows.mapInArrow(lean(cut), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
