"""Toxicity: a bidirectional gated recurrent network with attention pooling, in numpy.

Each word enters as a word embedding (of words that several texts of the sample hold, matched by 64-bit
hash; others share one) beside the mean of its hashed character-trigram embeddings;
a GRU runs over the window in either direction, attention pools the states, and a logistic unit gives the
window's logit. All overlapping windows of a text are scored; the text's score is the calibrated largest
one. Learning is by multiple instances: a toxic text must have some toxic window, a clean one none, so
each epoch trains on the windows that now score highest.

The network is fitted on at most ``SAMPLE`` labelled rows (those of the smallest id hashes, texts of up to
``SAMPLE_BYTES`` bytes, copies once). Scoring reads whole texts and nothing but texts. Parameters have a
fixed size, so their broadcast does too.

Null, empty and blank texts have one window without words and the score that goes with it. Without labels
of both classes every score is the share of toxic labels (0 without any). Repeated rows score alike; of
repeated labels of one document the largest counts. An empty table gives an empty result.
"""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import documents, held, lean, modest
from .textarrays import Words, ragged, slices, text_buffers

SAMPLE, SAMPLE_BYTES = 3500, 30_000
WINDOW, STRIDE = 64, 48
WORDS, LEAST_TEXTS, CHAR_BITS, WORD_DIM, CHAR_DIM, HIDDEN = 40_000, 3, 13, 8, 8, 8
EPOCHS, BATCH, RATE = 6, 256, 0.01

Params = dict[str, np.ndarray]


def start(known: np.ndarray, seed: int = 11) -> Params:
    """known: sorted hashes of the words with embeddings; row 0 of these is for all others."""
    rng = np.random.default_rng(seed)
    dim = WORD_DIM + CHAR_DIM
    normal = lambda *shape, scale: (rng.standard_normal(shape) * scale).astype(np.float32)
    p = {"known": known, "word": normal(len(known) + 1, WORD_DIM, scale=0.1), "char": normal(1 << CHAR_BITS, CHAR_DIM, scale=0.5)}
    for d in "fb":
        p |= {f"x{d}": normal(dim, 3 * HIDDEN, scale=dim**-0.5), f"u{d}": normal(HIDDEN, 3 * HIDDEN, scale=HIDDEN**-0.5), f"c{d}": np.zeros(3 * HIDDEN, np.float32)}
    return p | {"a": normal(2 * HIDDEN, HIDDEN, scale=0.35), "ac": np.zeros(HIDDEN, np.float32), "v": normal(HIDDEN, scale=0.35), "o": normal(2 * HIDDEN, scale=0.35), "oc": np.zeros(1, np.float32), "scale": np.array([1.0, 0.0], np.float32)}


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Coded:
    """Distinct words of some texts: places in the embeddings, character-trigram buckets (ragged), and the windows."""

    def __init__(self, words: Words, known: np.ndarray):
        distinct, first, self.word = np.unique(words.hashes(), return_index=True, return_inverse=True)
        at = np.minimum(np.searchsorted(known, distinct), max(0, len(known) - 1))
        self.bucket = np.where(known[at] == distinct, at + 1, 0) if len(known) else np.zeros(len(distinct), np.int64)
        begin, end = words.start[first], words.end[first]
        padded = np.concatenate([[32], words.data, [32]]).astype(np.int64)
        lengths = end - begin  # one trigram around each byte, with blanks at the ends
        at = ragged(begin, lengths)
        left, right = padded[at].copy(), padded[at + 2].copy()
        self.heads = np.concatenate([[0], np.cumsum(lengths)[:-1]]).astype(np.int64) if len(lengths) else np.zeros(0, np.int64)
        left[self.heads] = 32
        if len(lengths):
            right[np.cumsum(lengths) - 1] = 32
        self.char = ((left * 65599 + padded[at + 1]) * 65599 + right) * 40503 >> 7 & ((1 << CHAR_BITS) - 1)
        self.lengths = lengths
        counts = np.diff(words.first)
        per = np.maximum(1, -(-(counts - WINDOW) // STRIDE) + 1)
        self.row = np.repeat(np.arange(len(counts)), per)
        k = np.arange(len(self.row)) - np.repeat(np.cumsum(per) - per, per)
        self.begin = words.first[self.row] + k * STRIDE
        self.size = np.clip(words.first[self.row + 1] - self.begin, 0, WINDOW)

    def inputs(self, p: Params) -> np.ndarray:
        chars = np.add.reduceat(p["char"][self.char], self.heads) / self.lengths[:, None] if len(self.heads) else np.zeros((0, CHAR_DIM))
        return np.concatenate([p["word"][self.bucket], chars], 1).astype(np.float32)

    def ids(self, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(window, place) → distinct word, and the mask of words that are there."""
        place = np.arange(WINDOW)
        mask = place < self.size[windows][:, None]
        at = np.where(mask, self.begin[windows][:, None] + place, 0)
        word = self.word[at] if len(self.word) else np.zeros(at.shape, np.int64)
        return word, mask


def _run(gate: np.ndarray, ids: np.ndarray, mask: np.ndarray, u: np.ndarray, back: bool, keep: list | None = None) -> np.ndarray:
    """Hidden states (place, window, HIDDEN) of one direction; gate: input part of the gates by distinct word."""
    n, H = len(ids), HIDDEN
    h = np.zeros((n, H), np.float32)
    out = np.zeros((WINDOW, n, H), np.float32)
    for t in range(WINDOW - 1, -1, -1) if back else range(WINDOW):
        m = mask[:, t : t + 1]
        g, hu = gate[ids[:, t]], h @ u
        zr = 1 / (1 + np.exp(-(g[:, : 2 * H] + hu[:, : 2 * H])))
        z, r = zr[:, :H], zr[:, H:]
        c = np.tanh(g[:, 2 * H :] + r * hu[:, 2 * H :])
        new = np.where(m, c + z * (h - c), h if not back else 0)
        if keep is not None:
            keep.append((t, h, z, r, c, hu[:, 2 * H :]))
        h = out[t] = new
    return out


def _pool(p: Params, states: np.ndarray, mask: np.ndarray) -> tuple:
    a = np.tanh(states @ p["a"] + p["ac"])
    e = np.where(mask.T, a @ p["v"], -1e9)
    w = np.exp(e - e.max(0)) * mask.T
    w = w / np.maximum(w.sum(0), 1e-9)
    pooled = (states * w[:, :, None]).sum(0)
    return a, w, pooled, pooled @ p["o"] + p["oc"][0]


def logits(p: Params, coded: Coded, windows: np.ndarray | None = None, chunk: int = 1024) -> np.ndarray:
    """The logit of each window."""
    windows = np.arange(len(coded.begin)) if windows is None else windows
    x = coded.inputs(p) if len(coded.bucket) else np.zeros((1, WORD_DIM + CHAR_DIM), np.float32)
    gates = {d: x @ p[f"x{d}"] + p[f"c{d}"] for d in "fb"}
    out = np.empty(len(windows), np.float32)
    for k in range(0, len(windows), chunk):
        ids, mask = coded.ids(windows[k : k + chunk])
        states = np.concatenate([_run(gates[d], ids, mask, p[f"u{d}"], d == "b") for d in "fb"], 2)
        out[k : k + chunk] = _pool(p, states, mask)[3]
    return out


def gradients(p: Params, coded: Coded, windows: np.ndarray, target: np.ndarray, weight: np.ndarray) -> tuple[float, Params]:
    """Weighted cross-entropy of windows and its gradient by back-propagation through time."""
    H, n = HIDDEN, len(windows)
    x = coded.inputs(p)
    ids, mask = coded.ids(windows)
    kept: dict[str, list] = {"f": [], "b": []}
    states = np.concatenate([_run(x @ p[f"x{d}"] + p[f"c{d}"], ids, mask, p[f"u{d}"], d == "b", kept[d]) for d in "fb"], 2)
    a, w, pooled, logit = _pool(p, states, mask)
    prob = sigmoid(logit)
    loss = float(-(weight * (target * np.log(prob + 1e-9) + (1 - target) * np.log(1 - prob + 1e-9))).mean())
    d_logit = (weight * (prob - target) / n).astype(np.float32)
    g: Params = {"o": pooled.T @ d_logit, "oc": np.array([d_logit.sum()], np.float32)}
    d_pool = d_logit[:, None] * p["o"]
    d_w = (states * d_pool).sum(2)
    d_e = w * (d_w - (w * d_w).sum(0))
    g["v"] = np.einsum("tn,tnh->h", d_e, a)
    d_a = d_e[:, :, None] * p["v"] * (1 - a**2)
    g["a"], g["ac"] = np.einsum("tnk,tnh->kh", states, d_a), d_a.sum((0, 1))
    d_states = w[:, :, None] * d_pool + d_a @ p["a"].T
    d_x = np.zeros_like(x)
    for k, d in enumerate("fb"):
        u, d_gate = p[f"u{d}"], np.zeros((len(x), 3 * H), np.float32)
        g_u, d_h = np.zeros_like(u), np.zeros((n, H), np.float32)
        for t, h, z, r, c, un in reversed(kept[d]):
            m = mask[:, t : t + 1]
            d_new = np.where(m, d_h + d_states[t, :, k * H : (k + 1) * H], 0)
            d_c = d_new * (1 - z) * (1 - c**2)
            d_z = d_new * (h - c) * z * (1 - z)
            d_r = d_c * un * r * (1 - r)
            d_g = np.concatenate([d_z, d_r, d_c], 1)
            d_hu = np.concatenate([d_z, d_r, d_c * r], 1)
            np.add.at(d_gate, ids[:, t], d_g)
            g_u += h.T @ d_hu
            d_h = d_new * z + d_hu @ u.T + (np.where(m, 0, d_h) if d == "f" else 0)
        g[f"u{d}"], g[f"x{d}"], g[f"c{d}"] = g_u, x.T @ d_gate, d_gate.sum(0)
        d_x += d_gate @ p[f"x{d}"].T
    g["word"] = np.zeros_like(p["word"])
    np.add.at(g["word"], coded.bucket, d_x[:, :WORD_DIM])
    g["char"] = np.zeros_like(p["char"])
    live = np.flatnonzero(d_x.any(1))
    at = ragged(coded.heads[live], coded.lengths[live])
    np.add.at(g["char"], coded.char[at], np.repeat(d_x[live, WORD_DIM:] / coded.lengths[live, None], coded.lengths[live], 0))
    return loss, g


def _subset(coded: Coded, windows: np.ndarray) -> tuple[Coded, np.ndarray]:
    """The same with the words of these windows only, so that a step costs what its windows hold."""
    ids, mask = coded.ids(windows)
    used, inverse = np.unique(ids[mask], return_inverse=True)
    out = object.__new__(Coded)
    out.bucket, out.lengths = coded.bucket[used], coded.lengths[used]
    out.char = coded.char[ragged(coded.heads[used], out.lengths)]
    out.heads = (np.cumsum(out.lengths) - out.lengths).astype(np.int64)
    out.word = inverse
    out.size = coded.size[windows]
    out.begin = np.cumsum(out.size) - out.size
    return out, np.arange(len(windows))


def vocabulary(words: Words, labels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes of the words to embed, and the log-odds of each by texts, shrunk towards 0 where few texts hold it."""
    n = len(labels)
    distinct, at = np.unique(words.hashes(), return_inverse=True)
    pair = np.unique(at * n + words.row)
    word, toxic = pair // n, labels[pair % n] == 1
    bad, all_ = (np.bincount(word[m], minlength=len(distinct)) for m in (toxic, slice(None)))
    often = np.flatnonzero(all_ >= min(LEAST_TEXTS, max(1, n // 50)))
    often = np.sort(often[np.argsort(-all_[often], kind="stable")][:WORDS])
    bad, good = bad[often], all_[often] - bad[often]
    odds = np.log((bad + 0.3) / (labels.sum() + 1)) - np.log((good + 0.3) / (n - labels.sum() + 1))
    return distinct[often], odds * (bad + good) / (bad + good + 6)


def train(texts: list[str], labels: list[int], epochs: int = EPOCHS, seed: int = 11) -> Params:
    """Fit on texts with 0/1 labels."""
    y, rng = np.array(labels), np.random.default_rng(seed)
    data, offsets = text_buffers(pa.array(texts, pa.large_string()))
    words = Words(data, offsets, 0, len(texts))
    if len(words.start) == 0 or not 0 < y.sum() < len(y):
        share = float(y.mean()) if len(y) else 0.0
        return start(np.zeros(0, np.uint64), seed) | {"scale": np.array([0.0, np.log(max(share, 1e-6) / max(1 - share, 1e-6))], np.float32)}
    known, odds = vocabulary(words, y)
    coded, p = Coded(words, known), start(known, seed)
    p["word"][1:, 0] = odds / 2
    # the first guess of each window: its strongest words
    strength, now = np.append(0, odds).astype(np.float32), np.empty(len(coded.begin), np.float32)
    for k in range(0, len(now), 4096):
        ids, mask = coded.ids(np.arange(k, min(len(now), k + 4096)))
        now[k : k + 4096] = np.sort(np.where(mask, strength[coded.bucket[ids]], 0), 1)[:, -2:].sum(1)
    toxic = y[coded.row] == 1
    moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in p.items() if k not in ("scale", "known")}
    step = 0
    for epoch in range(epochs):
        order = np.lexsort((-now, coded.row))
        rank = np.arange(len(order)) - np.searchsorted(coded.row[order], coded.row[order])
        top = order[rank == 0]
        clean = np.flatnonzero(~toxic)
        some = rng.choice(clean, min(len(clean), max(600, 2 * int(y.sum()))), replace=False)
        hard = top[~toxic[top]]
        hard = hard[np.argsort(-now[hard])][: max(300, int(y.sum()))]
        bad = top[toxic[top]]
        chosen = np.unique(np.concatenate([bad, hard, some]))
        for _ in range(2):
            rng.shuffle(chosen)
            for k in range(0, len(chosen), BATCH):
                own = chosen[k : k + BATCH]
                target = toxic[own].astype(np.float32)
                weight = np.where(target == 1, 0.5 * len(chosen) / max(1, len(bad)), 0.5 * len(chosen) / max(1, len(chosen) - len(bad))).astype(np.float32)
                _, g = gradients(p, *_subset(coded, own), target, weight)
                step += 1
                for name, value in g.items():
                    a, b = moments[name]
                    a += 0.1 * (value - a)
                    b += 0.005 * (value**2 - b)
                    p[name] = p[name] - RATE * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.995**step)) + 1e-6)
        now = logits(p, coded)
    best = np.full(len(y), -np.inf)
    np.maximum.at(best, coded.row, now)
    return p | {"scale": _calibrated(best, y)}


def _calibrated(logit: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Slope and shift of a logistic fit of labels on the texts' largest logits, with smoothed targets."""
    target = np.where(y == 1, (y.sum() + 1) / (y.sum() + 2), 1 / ((y == 0).sum() + 2))
    x = np.stack([logit, np.ones_like(logit)], 1)
    w = np.array([1.0, 0.0])
    for _ in range(50):
        q = sigmoid(x @ w)
        hess = (x * (q * (1 - q))[:, None]).T @ x + 1e-3 * np.eye(2)
        move = np.linalg.solve(hess, x.T @ (q - target) + 1e-3 * (w - [1.0, 0.0]))
        w -= np.clip(move, -2, 2)
    return np.array([max(w[0], 0.05), w[1]], np.float32)


def score_texts(p: Params, column: pa.Array) -> np.ndarray:
    """Score of each text, from all its windows."""
    data, offsets = text_buffers(column)
    out = np.empty(len(offsets) - 1)
    for lo, hi in slices(offsets, 1 << 19):
        coded = Coded(Words(data, offsets, lo, hi), p["known"])
        best = np.full(hi - lo, -np.inf)
        np.maximum.at(best, coded.row, logits(p, coded))
        out[lo:hi] = sigmoid(best * p["scale"][0] + p["scale"][1])
    return out


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, folds: int = 4) -> Params:
    """Train on a bounded sample of labelled documents that aren't held out. The one task that trains runs on an executor;
    the driver gets the parameters."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[int, tuple[str, int]] = {}
        for batch in batches:
            rows = (batch.column(c).to_pylist() for c in ("row_key", "text", "toxic"))
            seen |= {k: (t, int(y > 0)) for k, t, y in zip(*rows, strict=True)}
        own = [seen[k] for k in sorted(seen)]
        out = io.BytesIO()
        np.savez(out, **train([t for t, _ in own], [y for _, y in own]))
        yield pa.RecordBatch.from_arrays([pa.array([out.getvalue()], pa.binary())], ["params"])

    wanted = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held(folds)).groupBy(F.col("doc_id").cast("long").alias("id")).agg(F.max("toxic").alias("toxic"))
    wanted = wanted.orderBy(F.xxhash64("id"), "id").limit(sample)
    rows = documents(docs).where(F.octet_length("text") <= SAMPLE_BYTES)
    rows = rows.join(F.broadcast(wanted), rows.doc_id == wanted.id).select("row_key", "text", F.col("toxic").cast("int").alias("toxic"))
    got = rows.repartition(1).mapInArrow(lean(work), "params binary").first()
    if got is None:  # nothing is labelled, and the plan was cut short
        return train([], [])
    with np.load(io.BytesIO(bytes(got.params))) as f:
        return {k: f[k] for k in f.files}


def scores(docs: DataFrame, params: Params, threshold: float = 0.3, folds: int = 4) -> DataFrame:
    """doc_id, held_out, score, predicted, row_key of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(params)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = score_texts(shared.value, batch.column("text"))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(s), pa.array((s >= threshold).astype(np.int32)), batch.column("row_key")], ["doc_id", "held_out", "score", "predicted", "row_key"])

    return documents(docs).select("doc_id", held(folds).alias("held_out"), "row_key", "text").mapInArrow(lean(work), "doc_id long, held_out boolean, score double, predicted int, row_key long")


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted of every row."""
    return scores(docs, fit(docs, labels), threshold).select("doc_id", "held_out", "score", "predicted")


def without_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """docs, all columns, of the rows that score under the threshold."""
    params = docs.sparkSession.sparkContext.broadcast(fit(docs, labels))
    names = docs.columns

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(score_texts(params.value, batch.column("text")) < threshold)).select(names)

    return modest(docs).mapInArrow(lean(work), docs.schema)
