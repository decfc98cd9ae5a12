import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from ledgerloom.llm import suffix_dedup as S
from ledgerloom.llm.deep_shallow import BlindTrie, common_prefix

from .conftest import ODD


def by_hand(docs, length):
    raws = [(i, (t or "").encode()) for i, t in docs]
    seen = Counter(r[k : k + length] for _, r in raws for k in range(len(r) - length + 1))
    out = []
    for i, r in raws:
        gone = np.zeros(len(r) + 2, bool)
        for k in range(len(r) - length + 1):
            if seen[r[k : k + length]] > 1:
                gone[k + 1 : k + length + 1] = True
        kept = bytes(b for b, g in zip(r, gone[1:]) if not g)
        out.append((i, len(r), int(gone.sum()), int((gone[1:] & ~gone[:-1]).sum()), hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def texts(seed, n=60):
    rng = random.Random(seed)
    make = lambda k: "".join(rng.choices("abcdeé \n", k=k))
    passages = [make(k) for k in (150, 190, 205, 230, 400, 900)]
    docs = []
    for _ in range(n):
        parts = [rng.choice(passages) if rng.random() < 0.4 else make(rng.randint(0, 300)) for _ in range(rng.randint(1, 5))]
        docs.append("".join(parts))
    docs += [docs[0], docs[1], docs[2][:-3], docs[3] + "tail", make(50) * 12, "z" * 700, make(199)]
    return list(enumerate(docs + ODD[:7]))


@pytest.mark.parametrize("crowd", [256, 3])
def test_equals_brute_force(docs_of, monkeypatch, crowd):
    monkeypatch.setattr(S, "CROWD", crowd)
    docs = texts(crowd)
    got = S.suffix_dedup(docs_of(docs).repartition(5)).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()
    assert sorted(tuple(r) for r in got) == by_hand(docs, 200)


def test_keys_cut_by_edges(spark, docs_of):
    spark.conf.set("spark.sql.shuffle.partitions", "50")
    try:
        docs = texts(8, 30)
        got = S.suffix_dedup(docs_of(docs)).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()
        assert sorted(tuple(r) for r in got) == by_hand(docs, 200)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_blind_trie_finds_the_longest_prefixes():
    rng = random.Random(1)
    for _ in range(200):
        strings = [bytes(rng.choices(b"ab", k=rng.randint(4, 14))) for _ in range(rng.randint(2, 12))]
        trie = BlindTrie()
        for s in strings:
            trie.add(s)
        want = [max(common_prefix(a, b) for k, b in enumerate(strings) if k != i) for i, a in enumerate(strings)]
        assert trie.lcp == want


def test_odd_rows(odd_docs):
    got = S.suffix_dedup(odd_docs)
    assert got.count() == odd_docs.count()
    assert S.suffix_dedup(odd_docs.limit(0)).count() == 0


def test_multikey_quicksort_orders_groups():
    from ledgerloom.llm.deep_shallow import _words, multikey_quicksort

    rng = np.random.default_rng(4)
    data = rng.integers(97, 99, 3000, dtype=np.uint8)
    data[500:900] = data[1500:1900]
    start, group = rng.integers(0, 2900, 400), rng.integers(0, 9, 400)
    start[:60], start[60:120] = np.arange(500, 560), np.arange(1500, 1560)
    order, tie = multikey_quicksort(_words(data), start, group, 4)
    raw = data.tobytes()
    key = [(int(group[i]), raw[start[i] : start[i] + 32]) for i in order]
    assert key == sorted(key)
    assert [a == b for a, b in zip(key, key[1:])] == (tie[1:] == tie[:-1]).tolist()


def test_long_texts_come_in_stretches(docs_of, monkeypatch):
    """Short stretches and lots give the same result, texts of several stretches included; so do equal segments of other texts."""
    monkeypatch.setattr(S, "MOST", 300)
    docs = texts(11, 25)
    docs.append((len(docs), "".join(random.Random(5).choices("abc", k=2000)) + docs[0][1] + "q" * 500))
    got = S.suffix_dedup(docs_of(docs).repartition(3)).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()
    assert sorted(tuple(r) for r in got) == by_hand(docs, 200)


def test_large_groups_are_sorted(docs_of):
    """Many different segments of one anchor, equal ones among them."""
    rng = random.Random(9)
    core = "".join(rng.choices("abcdefgh", k=260))
    docs = list(enumerate(["".join(rng.choices("xyz", k=rng.randint(20, 150))) + core[rng.randint(0, 30) :] + "".join(rng.choices("uvw", k=rng.randint(0, 90))) for _ in range(80)]))
    got = S.suffix_dedup(docs_of(docs)).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()
    assert sorted(tuple(r) for r in got) == by_hand(docs, 200)


def test_windows_of_crowds_are_compared_in_stretches(docs_of, monkeypatch):
    """A passage that many texts share between different ends: its windows come as stretches, not one by one."""
    monkeypatch.setattr(S, "CROWD", 3)
    rng = random.Random(13)
    make = lambda k: "".join(rng.choices("abcdefgh", k=k))
    passage = make(330)
    docs = list(enumerate(make(rng.randint(100, 200)) + passage + make(rng.randint(100, 200)) for _ in range(60)))
    df = docs_of(docs)
    got = S.suffix_dedup(df).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()
    assert sorted(tuple(r) for r in got) == by_hand(docs, 200)
    runs = S.repeated_windows(df).collect()
    windows = {(r.t1, r.t2, k) for r in runs for k in range(r.first, r["last"] + 1)}
    assert len(windows) >= 60 * 131 and 3 * len(runs) < len(windows)
