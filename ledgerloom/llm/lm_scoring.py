"""LM scoring: log10 probabilities of whole texts under an online context-mixing model.

A text is written bit by bit and every bit is predicted by online context mixing (``word_mixing``): hashed
contexts that reach across words, counted over the training texts; tables of the text's own, weights and
gates, updated after every bit; a refinement. Its symbols are the ``TOP`` most frequent words of the training
texts (found twice at least), the end, and an escape for other words. Other words are drawn from

* an urn of ``ALPHA`` draws and the other words already seen in the text, filled with
* the counts of every other training word, discounted onto
* spellings by logistic mixing of hashed-context bit predictors (``context_mixing``), with tables, weights
  and refinement gathered from every distinct training word.

Training texts (crc32(doc_id as text) mod 7 is not 2) give the base counts, N and V, and the symbols. One in
``TUNING`` of them, by a hash of the text, gives the mixing weights, the others the contexts' counts, so that weights
are learned on texts which the counts haven't seen. Every text starts from the same tables and weights, so its score
depends on no other text's place. The symbols are broadcast, as are the tables (of bounded size); other words are
joined, and only sums per text come back.

Null, empty and blank texts are one end token. Repeated rows count and score one by one. With no training
text, N is 0 and every word is unknown. An empty table gives an empty result.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import context_mixing as M
from . import word_mixing as W
from .shared import documents, held, lean, written
from .textarrays import Words, ragged, slices, text_buffers

TOP, TUNING, DISCOUNT, ALPHA, LOT = 100_000, 16, 0.7, 400.0, 100_000
#: Training tokens from whose share for the weights one task learns, learning rates, and bytes of text read side by side: to
#: learn weights, and to count and score, where a lot is about one of Spark's batches, as it takes as many steps as its longest text.
LEARNED, LEARN, RATE, LESSON, SIDE = 4_000_000, 0.02, 0.02, 512 << 10, 10 << 20
END = b""


def _signature(words: Words, at: np.ndarray) -> np.ndarray:
    """31 bits beside the hash: length, first, middle and last byte."""
    a, b = words.start[at], words.end[at]
    d = words.data.astype(np.int64)
    return ((b - a) & 127) << 24 | d[a] << 16 | d[(a + b) // 2] << 8 | d[b - 1]


def _spelled(words: Words, at: np.ndarray) -> pa.Array:
    """The words at these places as a binary array."""
    lengths = words.end[at] - words.start[at]
    data = words.data[ragged(words.start[at], lengths)]
    return pa.Array.from_buffers(pa.large_binary(), len(at), [None, pa.py_buffer(np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)), pa.py_buffer(data)]).cast(pa.binary())


def word_counts(docs: DataFrame, folds: int) -> DataFrame:
    """token, h, sig, n (in training texts) of every distinct word; the end is the empty token."""
    rows = documents(docs, held(folds).alias("held_out")).where(~F.col("held_out")).select("text")
    names = ["token", "h", "sig", "n"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_buffers(batch.column("text"))
            for lo, hi in slices(offsets, 4 << 20):
                words = Words(data, offsets, lo, hi)
                h, at, n = np.unique(words.hashes(), return_index=True, return_counts=True)
                yield pa.RecordBatch.from_arrays([_spelled(words, at), pa.array(h.view(np.int64)), pa.array(_signature(words, at).astype(np.int32)), pa.array(n)], names)
                yield pa.RecordBatch.from_arrays([pa.array([END], pa.binary()), pa.array([0]), pa.array([0], pa.int32()), pa.array([hi - lo])], names)

    flat = rows.mapInArrow(lean(work), "token binary, h long, sig int, n long")
    return flat.groupBy("token", "h", "sig").agg(F.sum("n").alias("n"))


def _few(df: DataFrame) -> DataFrame:
    """df in few partitions, for tasks that each hand over a whole table."""
    return df.coalesce(min(256, 2 * df.sparkSession.sparkContext.defaultParallelism))


def _lots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches joined to lots of about ``LOT`` rows, so that equal steps of words are worked out once."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) >= LOT:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held = []
    if held and sum(b.num_rows for b in held):
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def _table(vocabulary: DataFrame) -> np.ndarray:
    """The bit predictors' counts, summed over all distinct words block by block."""
    size = 2 * M.ORDERS * M.SLOTS // M.BLOCKS

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((M.ORDERS * M.SLOTS, 2), np.float32)
        for batch in _lots(batches):
            for k in range(0, batch.num_rows, LOT):
                total += M.counted(_spellings(batch.column("token").slice(k, LOT)))
        yield pa.RecordBatch.from_arrays([pa.array(range(M.BLOCKS), pa.int32()), pa.array([x.tobytes() for x in total.reshape(M.BLOCKS, size)], pa.binary())], ["block", "counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for b, c in zip(batch.column("block").to_pylist(), batch.column("counts").to_pylist(), strict=True):
                sums[b] = sums.get(b, 0) + np.frombuffer(c, np.float32)
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([x.tobytes() for x in sums.values()], pa.binary())], ["block", "counts"])

    schema = "block int, counts binary"
    got = _few(vocabulary.select("token")).mapInArrow(lean(count), schema).repartition(M.BLOCKS, "block").mapInArrow(lean(add), schema).toArrow()
    out = np.zeros((M.BLOCKS, size), np.float32)
    for b, c in zip(got.column("block").to_pylist(), got.column("counts").to_pylist(), strict=True):
        out[b] += np.frombuffer(c, np.float32)
    return out.reshape(-1, 2)


def _spellings(tokens: pa.Array) -> M.Spellings:
    tokens = tokens.cast(pa.large_binary())
    offsets = np.frombuffer(tokens.buffers()[1], np.int64)[tokens.offset : tokens.offset + len(tokens) + 1]
    data = tokens.buffers()[2]
    data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None and data.size else np.zeros(0, np.uint8)
    return M.Spellings(data, offsets - offsets[0])


def _mixer(vocabulary: DataFrame, table, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Weights (mean over lots by their words) and refinement (sum), learned online over all distinct words. Lots are dealt by
    hash, about ``LOT`` words each, and read in order, so what is learned doesn't depend on how the input is partitioned."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight, refine, n = 0, 0, 0
        for batch in _lots(batches):
            for k in range(0, batch.num_rows, LOT):
                part = batch.column("token").slice(k, LOT)
                w, r = M.learn(table.value, _spellings(part))
                weight, refine, n = weight + w.astype(float) * len(part), refine + (r - M.start()[1]), n + len(part)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([weight.tobytes()], pa.binary()), pa.array([np.asarray(refine, float).tobytes()], pa.binary())], ["n", "weight", "refine"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, weight, refine = 0, 0, 0
        for batch in batches:
            for i, w, r in zip(*(batch.column(c).to_pylist() for c in ("n", "weight", "refine")), strict=True):
                n, weight, refine = n + i, weight + np.frombuffer(w), refine + np.frombuffer(r)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([weight.tobytes()], pa.binary()), pa.array([refine.tobytes()], pa.binary())], ["n", "weight", "refine"])

    schema = "n long, weight binary, refine binary"
    lots = vocabulary.select("token").repartition(max(1, -(-words // LOT)), "token").sortWithinPartitions("token")
    some = lots.mapInArrow(lean(work), schema).repartition(8).mapInArrow(lean(add), schema).collect()
    weights, refine = M.start()
    if not some:
        return weights, refine
    n = sum(r.n for r in some)
    weights = (sum(np.frombuffer(r.weight) for r in some) / n).reshape(weights.shape).astype(np.float32)
    return weights, refine + sum(np.frombuffer(r.refine) for r in some).reshape(refine.shape)


def _read(batches: Iterator[pa.RecordBatch], code: W.Code, most: int) -> Iterator[tuple[pa.RecordBatch, Words, W.Read]]:
    """Texts in lots of about ``most`` bytes."""
    for batch in batches:
        data, offsets = text_buffers(batch.column("text"))
        for lo, hi in slices(offsets, most):
            words = Words(data, offsets, lo, hi)
            yield batch.slice(lo, hi - lo), words, W.Read(code, words)


def _contexts(texts: DataFrame, code) -> np.ndarray:
    """The contexts' counts over these texts, summed block by block, and packed."""
    size = code.value.size() // W.BLOCKS

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for _, _, read in _read(batches, code.value, SIDE):
            total = np.zeros((W.BLOCKS, size, 2), np.uint32) if total is None else total
            W.count(code.value, read, total)
        for k in range(W.BLOCKS if total is not None else 0):
            flat = total[k].ravel()
            large = np.flatnonzero(flat > 255)
            small = zlib.compress(np.minimum(flat, 255).astype(np.uint8), 1)
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), *(pa.array([c], pa.binary()) for c in (small, large.tobytes(), flat[large].tobytes()))], names)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for b, *parts in zip(*(batch.column(c).to_pylist() for c in names), strict=True):
                small, large, counts = np.frombuffer(zlib.decompress(parts[0]), np.uint8), np.frombuffer(parts[1], np.int64), np.frombuffer(parts[2], np.uint32)
                own = sums.setdefault(b, np.zeros(len(small), np.int64))
                own += small
                own[large] += counts.astype(np.int64) - 255
        for b, c in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([b], pa.int32()), pa.array([W.packed(c.reshape(-1, 2)).tobytes()], pa.binary())], ["block", "counts"])

    names = ["block", "small", "large", "counts"]
    schema = "block int, small binary, large binary, counts binary"
    got = _few(texts).mapInArrow(lean(count), schema).repartition(W.BLOCKS, "block").mapInArrow(lean(add), "block int, counts binary").toArrow()
    out = np.tile(W.packed(np.zeros((1, 2))), (W.BLOCKS, size))
    for b, c in zip(got.column("block").to_pylist(), got.column("counts"), strict=True):
        out[b] = np.frombuffer(c.as_buffer(), np.uint16)
    return out.ravel()


def _weights(texts: DataFrame, code, table, tokens: int) -> tuple[np.ndarray, np.ndarray]:
    """Mixing weights (mean over lots by their bytes) and refinement (sum), learned online over these texts. Lots are dealt by
    hash and read in order, so what is learned doesn't depend on how the input is partitioned."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, refine = W.start(code.value)
        gain, n, counts = np.zeros_like(refine), 0, table.value.copy()
        for _, words, read in _read(batches, code.value, LESSON):
            for _ in range(2):
                weights, more = W.mixed(code.value, counts, weights, refine, read, LEARN, learn=True)
            gain, n = gain + more, n + len(words.data)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([(weights.astype(float) * n).tobytes()], pa.binary()), pa.array([gain.tobytes()], pa.binary())], ["n", "weights", "refine"])

    lots = min(512, -(-tokens // LEARNED)) or 1
    dealt = texts.repartition(lots, "row_key", "doc_id").sortWithinPartitions("row_key", "doc_id", "text")
    weights, refine = W.start(code.value)
    some = dealt.mapInArrow(lean(work), "n long, weights binary, refine binary").collect()
    if some:
        weights = (sum(np.frombuffer(r.weights) for r in some) / sum(r.n for r in some)).reshape(weights.shape).astype(np.float32)
        refine = refine + sum(np.frombuffer(r.refine) for r in some).reshape(refine.shape)
    return weights, refine


def lm_scores(docs: DataFrame, folds: int = 7) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte of every row."""
    spark = docs.sparkSession
    vocabulary = written(word_counts(docs, folds))
    sums = vocabulary.agg(F.sum("n"), F.count("*")).first()
    N, V = sums[0] or 0, sums[1]
    ends = vocabulary.where(F.octet_length("token") == 0).first()
    end_n = ends["n"] if ends else 0
    top = vocabulary.where((F.octet_length("token") > 0) & (F.col("n") > 1)).orderBy(F.desc("n"), "h", "sig").limit(TOP).select("h", "sig", "n").toArrow()
    h, sig, n = (np.append(top.column(c).to_numpy(), last) for c, last in (("h", 0), ("sig", 0), ("n", end_n)))
    other_n, other_v = N - int(n.sum()), V - top.num_rows - (1 if ends else 0)
    least = int(n[:-1].min()) if top.num_rows == TOP else 1
    order = np.argsort(h, kind="stable")
    code = spark.sparkContext.broadcast(W.Code(h[order], sig[order], n[order], other_n, N))
    texts = documents(docs, held(folds).alias("held_out"))
    tuning = F.pmod(F.col("row_key"), F.lit(TUNING)) == 0
    contexts = spark.sparkContext.broadcast(_contexts(texts.where(~F.col("held_out") & ~tuning).select("text"), code))
    mixing = _weights(texts.where(~F.col("held_out") & tuning).select("row_key", "doc_id", "text"), code, contexts, N)
    table = spark.sparkContext.broadcast(_table(vocabulary))
    weights, refine = _mixer(vocabulary, table, V)

    def probabilities(n: np.ndarray, spelling: np.ndarray) -> np.ndarray:
        """Log probability of words that are no symbols: counts discounted onto spellings."""
        known = np.maximum(n - DISCOUNT, 0) / max(other_n, 1) + (DISCOUNT * other_v / other_n if other_n else 1.0) * np.exp(np.maximum(spelling, -600))
        return np.log(np.maximum(known, 1e-290))

    def base(n: np.ndarray) -> np.ndarray:
        return np.log10((n + 1) / (N + V + 1))

    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _lots(batches):
            for i in range(0, batch.num_rows, LOT):
                part = batch.slice(i, LOT)
                p = probabilities(part.column("n").to_numpy(), M.spell(table.value, weights, refine, _spellings(part.column("token")), part.num_rows))
                yield pa.RecordBatch.from_arrays([part.column("h"), part.column("sig"), part.column("n"), pa.array(p)], ["h", "sig", "n", "p"])

    rare = vocabulary.where((F.octet_length("token") > 0) & (F.col("n") <= least)).mapInArrow(lean(spell), "h long, sig int, n long, p double")
    kinds = ["h", "sig", "row", "tf", "doc_id", "held_out", "n_tokens", "n_bytes", "n_known", "base", "token", "mixed"]
    schema = "h long, sig int, row long, tf int, doc_id long, held_out boolean, n_tokens long, n_bytes long, n_known long, base double, token binary, mixed double"
    null = lambda m, kind: pa.nulls(m, kind)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row per text with the mixed symbols' sums, and a row per text and other word."""
        c, counts = code.value, contexts.value.copy()
        base_of = np.append(base(c.counts), 0.0)
        known_of = np.append(c.counts > 0, False)
        for part, words, own in _read(batches, c, SIDE):
            n = part.num_rows
            mix = W.mixed(c, counts, *mixing, own, RATE)
            others = np.flatnonzero(~own.known)
            drawn = np.bincount(words.row[others], minlength=n).astype(float)
            mix -= np.where(drawn > 0, _lgamma(ALPHA + drawn) - _lgamma(np.full(n, ALPHA)), 0)
            b = np.bincount(own.row, base_of[own.symbol], n)
            k = np.bincount(own.row, known_of[own.symbol], n).astype(np.int64)
            ids = part.column("row")
            yield pa.RecordBatch.from_arrays([ids, null(n, pa.int32()), ids, null(n, pa.int32()), part.column("doc_id"), part.column("held_out"), pa.array(own.counts), pa.array(np.diff(words.offsets)), pa.array(k), pa.array(b), null(n, pa.binary()), pa.array(mix)], kinds)
            h, row = words.hashes()[others], words.row[others]
            order = np.lexsort((h, row))
            h, row, others = h[order], row[order], others[order]
            first = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (row[1:] != row[:-1])])[: len(h)])
            at, m = others[first], len(first)
            tf = np.diff(np.append(first, len(h)))
            yield pa.RecordBatch.from_arrays([pa.array(h[first].view(np.int64)), pa.array(_signature(words, at).astype(np.int32)), ids.take(pa.array(row[first])), pa.array(tf.astype(np.int32)), null(m, pa.int64()), null(m, pa.bool_()), *[null(m, pa.int64())] * 3, null(m, pa.float64()), _spelled(words, at), null(m, pa.float64())], kinds)

    out = [*kinds[2:3], *kinds[4:10], "mixed"]

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Words met by the join, or spelled where no training text has them, become sums per text."""
        for batch in batches:
            is_word = batch.column("tf").is_valid().to_numpy(zero_copy_only=False)
            if (~is_word).any():
                yield batch.filter(pa.array(~is_word)).select(out)
            batch = batch.filter(pa.array(is_word))
            for i in range(0, batch.num_rows, 20_000):
                part = batch.slice(i, 20_000)
                n = part.column("n").fill_null(0).to_numpy(zero_copy_only=False)
                p = part.column("p").fill_null(0.0).to_numpy(zero_copy_only=False).astype(float)
                new = np.flatnonzero(n == 0)
                if len(new):
                    p[new] = probabilities(np.zeros(len(new)), M.spell(table.value, weights, refine, _spellings(part.column("token").take(pa.array(new))), len(new)))
                tf = part.column("tf").to_numpy()
                urn = p + math.log(ALPHA)
                many = np.flatnonzero(tf > 1)
                if len(many):
                    urn[many] = _rising(np.exp(urn[many]), tf[many])
                rows, r = np.unique(part.column("row").to_numpy(), return_inverse=True)
                m = len(rows)
                yield pa.RecordBatch.from_arrays([pa.array(rows), null(m, pa.int64()), null(m, pa.bool_()), null(m, pa.int64()), null(m, pa.int64()), pa.array(np.bincount(r, tf * (n > 0), m).astype(np.int64)), pa.array(np.bincount(r, tf * base(n), m)), pa.array(np.bincount(r, urn, m))], out)

    rows = texts.select("doc_id", "held_out", F.monotonically_increasing_id().alias("row"), "text")
    flat = rows.mapInArrow(lean(read), schema)
    rare = rare.withColumnsRenamed({"h": "h_", "sig": "sig_"})
    met = flat.join(rare, (flat.h == rare.h_) & (flat.sig == rare.sig_), "left").select(*kinds, "n", "p")
    settled = met.mapInArrow(lean(settle), "row long, doc_id long, held_out boolean, n_tokens long, n_bytes long, n_known long, base double, mixed double")
    per = settled.groupBy("row").agg(*(F.max(c).alias(c) for c in ("doc_id", "held_out", "n_tokens", "n_bytes")), F.sum("n_known").alias("n_known"), F.sum("base").alias("base_score"), (F.sum("mixed") / math.log(10)).alias("score"))
    bits = -F.col("score") * math.log2(10) / F.greatest(F.col("n_bytes"), F.lit(1))
    return per.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(N).cast("long").alias("train_tokens"), "base_score", "score", bits.alias("bits_per_byte"))


def _lgamma(x: np.ndarray) -> np.ndarray:
    """Log gamma for positive numbers: Stirling's series after shifting by 8."""
    shift = np.zeros_like(x)
    for i in range(8):
        shift += np.log(x + i)
    y = x + 8
    return (y - 0.5) * np.log(y) - y + 0.9189385332046727 + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - shift


def _rising(mass: np.ndarray, tf: np.ndarray) -> np.ndarray:
    """log of mass (mass + 1) ... (mass + tf - 1)."""
    return _lgamma(mass + tf) - _lgamma(mass)
