import random

import numpy as np
import pyarrow as pa
import pytest

from ledgerloom.llm import toxicity as T
from ledgerloom.llm.textarrays import Words, text_buffers


def corpus(n, seed):
    rng = random.Random(seed)
    texts, labels = [], []
    for _ in range(n):
        words = ["".join(rng.choices(["an", "re", "th", "el", "ou", "st"], k=rng.randint(1, 4))) for _ in range(rng.randint(5, 200))]
        bad = rng.random() < 0.2
        for _ in range(rng.randint(2, 5) * bad):
            words.insert(rng.randrange(len(words)), rng.choice(["idiot", "moron", "scumbag", "loser"]))
        texts.append(" ".join(words))
        labels.append(int(bad))
    return texts, labels


def test_gradients_are_those_of_differences():
    data, offsets = text_buffers(pa.array(["hello you stupid moron of a day", "a clean day out " * 20, "x"]))
    words = Words(data, offsets, 0, 3)
    known = np.unique(words.hashes())
    coded, p = T.Coded(words, known), T.start(known)
    p = {k: v.astype(float) if v.dtype == np.float32 else v for k, v in p.items()}
    windows = np.arange(len(coded.begin))
    target, weight = np.eye(1, len(windows))[0], np.ones(len(windows))
    _, g = T.gradients(p, coded, windows, target, weight)
    for name in g:
        at = np.unravel_index(np.argmax(np.abs(g[name])), g[name].shape)
        ends = []
        for step in (1e-3, -1e-3):
            q = {**p, name: p[name].copy()}
            q[name][at] += step
            ends.append(T.gradients(q, coded, windows, target, weight)[0])
        assert (ends[0] - ends[1]) / 2e-3 == pytest.approx(g[name][at], rel=1e-2, abs=1e-5)


def test_every_word_is_in_a_window():
    data, offsets = text_buffers(pa.array([" ".join(["w"] * n) for n in (0, 1, 63, 64, 65, 112, 113, 500)]))
    coded = T.Coded(Words(data, offsets, 0, 8), np.zeros(0, np.uint64))
    seen = [set() for _ in range(8)]
    for r, b, n in zip(coded.row, coded.begin, coded.size):
        seen[r] |= set(range(b, b + n))
    assert [len(s) for s in seen] == [0, 1, 63, 64, 65, 112, 113, 500]


def test_held_out_accuracy(docs_of):
    p = T.train(*corpus(800, 1))
    texts, labels = corpus(300, 2)
    s, y = T.score_texts(p, pa.array(texts)), np.array(labels)
    assert ((s >= 0.3) == (y == 1)).mean() > 0.95
    long = " ".join(["anre"] * 5000 + ["moron", "idiot", "moron"] + ["thel"] * 5000)
    assert T.score_texts(p, pa.array([long]))[0] >= 0.3


def test_tables_and_odd_rows(spark, docs_of, odd_docs):
    texts, y = corpus(200, 3)
    labels = spark.createDataFrame([(i, 1, v) for i, v in enumerate(y)] + [(None, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int")
    docs = docs_of(texts)
    got = T.toxicity(docs, labels).collect()
    assert len(got) == 200 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)
    assert T.toxicity(odd_docs, labels).count() == odd_docs.count()
    assert {r.score for r in T.toxicity(odd_docs, labels.limit(0)).collect()} <= {r.score for r in T.toxicity(odd_docs.limit(3), labels.limit(0)).collect()}
    assert T.toxicity(odd_docs.limit(0), labels).count() == 0
    assert T.without_toxic(odd_docs, labels).columns == odd_docs.columns
