import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from ledgerloom.llm import context_mixing as M
from ledgerloom.llm import word_mixing as W
from ledgerloom.llm import lm_scoring as L
from ledgerloom.llm.lm_scoring import _few, _lgamma, _spellings, _table, lm_scores
from ledgerloom.llm.textarrays import Words, text_buffers


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) + [""]


def held(i):
    return zlib.crc32(str(i).encode()) % 7 == 2


def check_base(rows, docs):
    counts = Counter(w for i, t in docs if not held(i) for w in words(t))
    n, v = sum(counts.values()), len(counts)
    got = {r.doc_id: r for r in rows}
    for i, t in docs:
        own = words(t)
        r = got[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held(i), len(own), sum(counts[w] > 0 for w in own), n)
        assert r.base_score == pytest.approx(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in own), abs=1e-6)
        assert r.score < 0 and math.isfinite(r.score)


def test_counts_and_gain_on_held_out_texts(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = lm_scores(df).collect()
    check_base(rows, [(r.doc_id, r.text) for r in df.collect()])
    size = {r.doc_id: len((r.text or "").encode()) for r in df.collect()}
    bits = [-sum(r.score for r in rows if r.held_out == h) * math.log2(10) / sum(size[r.doc_id] for r in rows if r.held_out == h) for h in (True, False)]
    assert bits[0] < 2.4 and bits[1] < 2.1


def test_odd_rows(odd_docs, docs_of):
    assert lm_scores(odd_docs).count() == odd_docs.count()
    assert lm_scores(odd_docs.limit(0)).count() == 0
    docs = list(enumerate([None, "", " ", "a", "A a\ta", "unknown words", "x" * 5000]))
    check_base(lm_scores(docs_of(docs)).collect(), docs)


def test_spellings_are_a_distribution():
    """Every step's probabilities of its 256 next bytes add up to one, after any context."""
    lot = _spellings(pa.array([b"the", b"then", b"there", b"other", b"rest", b"west"] * 20, pa.binary()))
    table = M.counted(lot)
    weights, refine = M.learn(table, lot)
    for before in (b"", b"th", b"zzz"):
        step = _spellings(pa.array([before + bytes([b]) for b in range(256)], pa.binary()))
        prefix = M.spell(table, weights, refine, _spellings(pa.array([before], pa.binary())), 1)[0]
        total = np.exp(M.spell(table, weights, refine, step, 256)).sum()
        # words = prefix + one byte + the closing blank; bound: they can't have more mass than the prefix without its blank
        assert 0 < total < 1 and prefix < 0


def test_lgamma():
    x = np.array([1e-9, 1e-3, 0.5, 1, 2, 10, 1e4])
    assert np.allclose(_lgamma(x), [math.lgamma(v) for v in x], rtol=1e-9, atol=1e-8)


def test_scores_do_not_depend_on_the_layout(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    first = {r.doc_id: r.score for r in lm_scores(df.coalesce(1)).collect()}
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    try:
        other = {r.doc_id: r.score for r in lm_scores(df.repartition(7)).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert first.keys() == other.keys() and all(other[k] == pytest.approx(v, rel=1e-5) for k, v in first.items())


def test_scores_depend_on_the_order_of_words(spark, docs_of):
    """The same words, as in training texts and backwards: the bits of running text are predicted, not words for themselves."""
    rng = np.random.default_rng(3)
    names = [f"word{k}" for k in range(60)]
    chain = [list(rng.permutation(60)) for _ in range(2)]  # after each word, two others are likely

    def text():
        at, out = 0, []
        for _ in range(60):
            at = chain[int(rng.integers(2))][at]
            out.append(names[at])
        return out

    train = [(i, " ".join(text())) for i in range(3000, 3400) if not held(i)]
    test = [i for i in range(3400, 3600) if held(i)][:16]
    sides = [text() for _ in test[:8]]
    ordered = [(i, " ".join(w)) for i, w in zip(test[:8], sides, strict=True)]
    turned = [(i, " ".join(w[::-1])) for i, w in zip(test[8:], sides, strict=True)]
    got = {r.doc_id: r for r in lm_scores(docs_of(train + ordered + turned)).collect()}
    for (i, _), (j, _) in zip(ordered, turned, strict=True):
        assert got[i].base_score == pytest.approx(got[j].base_score)
        assert got[i].score > got[j].score + 30


def _lot(texts):
    return Words(*text_buffers(pa.array(texts)), 0, len(texts))


def _code(texts, rare=()):
    words = _lot(texts)
    h, first, n = np.unique(words.hashes().view(np.int64), return_index=True, return_counts=True)
    a, b, d = words.start[first], words.end[first], words.data.astype(np.int64)
    sig = ((b - a) & 127) << 24 | d[a] << 16 | d[(a + b) // 2] << 8 | d[b - 1]
    gone = np.isin(h, _lot(list(rare)).hashes().view(np.int64)) if rare else np.zeros(len(h), bool)
    h, sig, n = (np.append(x[~gone], y) for x, y in ((h, 0), (sig, 0), (n, len(texts))))
    order = np.argsort(h)
    return W.Code(h[order], sig[order], n[order], max(1, int(gone.sum())), len(words.start))


def test_mixing_is_bit_by_bit_and_online():
    """Whole words of many texts at once give what a plain loop over texts, words and bits gives."""
    rng = np.random.default_rng(5)
    texts = [" ".join(f"w{int(k)}" for k in rng.geometric(0.15, int(rng.integers(0, 60)))) for _ in range(40)]
    code = _code(texts, ["w9", "w14"])
    read = W.Read(code, _lot(texts))
    counts = np.zeros((code.size(), 2), np.uint32)
    W.count(code, W.Read(code, _lot(texts[::2])), counts)
    table = W.packed(counts)
    weights, refine = W.start(code)
    refine = refine + rng.random(refine.shape)
    got = W.mixed(code, table, weights, refine, read, 0.02)
    for r in range(len(texts)):
        w, own, total = weights.astype(float), np.zeros(2 << W.OWN_BITS, int), 0.0
        for t in range(read.first[r], read.first[r] + read.counts[r]):
            at, way, _ = W.slots(code, read, np.array([t]))
            for k in range(len(way)):
                bit, cell = int(code.bit[way[k]]), table[at[:, k]].astype(int)
                level = (cell[1] >> 8) * 3 + (cell[2] >> 8)
                own_at = [int(np.uint32(at[0, k]) * np.uint32(W._G2) >> np.uint32(32 - W.OWN_BITS)), (int(at[1, k]) & (1 << W.OWN_BITS) - 1) + (1 << W.OWN_BITS)]
                x = np.array([*((cell & 255) * 0.1 - 12.8), *W._OWN[own[own_at]], 1, 0])
                gate = int(code.depth[way[k]]) * W.LEVELS + level
                z = float(np.clip(x @ w[gate], -14, 14))
                part = refine[level, min(max(int(z * 1.5 + W.STEPS / 2), 0), W.STEPS - 1)]
                p = 0.5 / (1 + math.exp(-z)) + 0.5 * part[1] / part.sum()
                total += math.log(p if bit else 1 - p)
                w[gate] += 0.02 * (bit - 1 / (1 + math.exp(-z))) * x
                own[own_at] = W._NEXT[bit * 256 + own[own_at]]
        assert got[r] == pytest.approx(total, rel=1e-3)


def test_symbols_are_a_distribution():
    """The ways down the tree are a complete prefix code, so that the symbols' probabilities add up to one after any context."""
    code = _code(["a b c a b a", "d e f a", ""])
    assert sum(2.0 ** -int(n) for n in code.length) == 1
    assert all((np.diff(code.depth[s : s + n]) == 1).all() for s, n in zip(code.start, code.length, strict=True))


def test_tables_come_from_few_tasks(spark):
    """However many partitions the input has, the tasks that each hand over a whole table are few."""
    most = 2 * spark.sparkContext.defaultParallelism
    assert _few(spark.range(0, 1000, 1, 211)).rdd.getNumPartitions() <= most
    words = spark.createDataFrame([(f"word{k}".encode(),) for k in range(600)], "token binary")
    assert np.array_equal(_table(words.repartition(150)), _table(words.coalesce(1)))


def test_repeats_are_counted_at_once(monkeypatch):
    """Many copies of a text cost hardly more ways than one copy, and give its counts as often."""
    text = "a b c a b a d e f a c b"
    code = _code([text, "g h"])
    walked = []
    ragged = W.ragged
    monkeypatch.setattr(W, "ragged", lambda starts, lengths: walked.append(int(lengths.sum())) or ragged(starts, lengths))
    tables = []
    for copies in (1, 50):
        counts = np.zeros((code.size(), 2), np.uint32)
        W.count(code, W.Read(code, _lot([text] * copies)), counts)
        tables.append((counts, sum(walked)))
        walked.clear()
    assert np.array_equal(tables[0][0] * 50, tables[1][0])
    assert tables[1][1] <= 2 * tables[0][1]


def test_many_texts_are_read_side_by_side():
    """A lot takes as many steps as its longest text, so a batch of 8 MB, as Spark sends them, is one lot."""
    texts = ["a b c d " * 4000, *["a b c d " * 100] * 10_000]
    batch = pa.RecordBatch.from_arrays([pa.array(texts)], ["text"])
    lots = list(L._read(iter([batch]), _code(["a b c d a"]), L.SIDE))
    assert batch.nbytes > 8_000_000 and [part.num_rows for part, _, _ in lots] == [len(texts)]


def test_symbols_are_found_by_hash():
    """Also hashes at the ends of the range and next to a symbol's."""
    code = _code([" ".join(f"w{k}" for k in range(3000))])
    edges = np.iinfo(np.int64)
    h = np.concatenate([code.hashes, code.hashes + 1, code.hashes - 1, [edges.min, -1, 0, 1, edges.max]])
    assert np.array_equal(code.find(h), np.searchsorted(code.hashes, h))
