import zlib
from collections import defaultdict

import numpy as np
import pytest

from ledgerloom.llm.packing import Capacities, best_fit, pack_documents
from ledgerloom.llm.queries import tokenizer_path
from ledgerloom.llm.token_counts import count_texts, token_counts

from .conftest import ODD


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer_path())


def test_counts_equal_the_library(library):
    texts = [t or "" for t in ODD] + ["aaaa aaaaa aaa", "héllo wörld's I'LL 12 3½", "!!!???...", "<|startoftext|>a<|endoftext|><|endoftext", "\x85a b\x1cc", "ǅ ǈ ß ẞ ŉ ŒŸ"]
    assert count_texts(texts, tokenizer_path()) == [len(library.encode(t, add_special_tokens=False).ids) for t in texts]


def test_counts_on_documents(spark, library):
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    want = {r.doc_id: len(library.encode(r.text or "", add_special_tokens=False).ids) for r in rows.collect()}
    got = token_counts(rows, tokenizer_path()).collect()
    assert {r.doc_id: r.n_tokens for r in got} == want
    assert all(r.over_limit == (r.n_tokens > 2048) for r in got)


def test_counts_of_odd_rows(odd_docs):
    assert token_counts(odd_docs, tokenizer_path()).count() == odd_docs.count()
    assert token_counts(odd_docs.limit(0), tokenizer_path()).count() == 0


@pytest.mark.parametrize("rule", ["norm", "dot"])
def test_best_fit_keeps_every_capacity(rule):
    lengths = np.random.default_rng(1).integers(1, 90, 600)
    cap = Capacities(100, 5, 4000.0, (1.0, 0.2, 0.2), rule)
    bins = best_fit(lengths, cap)
    for b in np.unique(bins):
        own = lengths[bins == b]
        assert len(own) <= 5 and own.sum() <= 100 and ((own**2).sum() <= 4000 or len(own) == 1)


def check_packing(rows, docs, library):
    places, parts = defaultdict(list), defaultdict(list)
    for r in rows:
        places[r.sequence_id].append((r.offset, r.length))
        parts[r.doc_id].append(r)
    for spans in places.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= 4096
    for doc_id, text in docs:
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 1]
        want = [(p, s, len(ids[s : s + 4096]), zlib.crc32(np.array(ids[s : s + 4096], "<u4").tobytes())) for p, s in enumerate(range(0, len(ids), 4096))]
        assert sorted((r.piece, r.start, r.length, r.ids_crc32) for r in parts[doc_id])[: len(want)] == want


def test_packing_round_trip(spark, library):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = pack_documents(df, tokenizer_path()).collect()
    check_packing(rows, [(r.doc_id, r.text) for r in df.collect()], library)
    least = -(-sum(r.length for r in rows) // 4096)
    assert len({r.sequence_id for r in rows}) <= least * 1.02 + 1


def test_packing_in_rounds(spark, docs_of, library):
    from ledgerloom.llm.packing import pack, pieces
    from ledgerloom.llm.shared import stored

    docs = docs_of(["word " * (1 + i * 37 % 900) for i in range(300)])
    cut = stored(pieces(docs, tokenizer_path()))
    rows = pack(cut, shard=20).collect()
    check_packing(rows, [(r.doc_id, r.text) for r in docs.collect()], library)
    assert len({r.sequence_id for r in rows}) <= -(-sum(r.length for r in rows) // 4096) * 1.05 + 1


def test_packing_of_odd_rows(odd_docs, library):
    rows = pack_documents(odd_docs, tokenizer_path()).collect()
    assert sum(r.piece == 0 for r in rows) == odd_docs.count()
    check_packing(rows, list(enumerate(ODD)), library)
    assert pack_documents(odd_docs.limit(0), tokenizer_path()).count() == 0


def test_every_cut_of_a_text_gives_the_same_ids(library, monkeypatch):
    """Fast and slow words, special strings in either case, and texts cut into short stretches."""
    import random

    import pyarrow as pa

    from ledgerloom.llm import packing, token_counts
    from ledgerloom.llm.textarrays import text_buffers

    rng = random.Random(3)
    bits = ["the", "The.", "ÀÉÎÕÜ", "ß×÷", "naïve,", "it's", "'s", "x1y22", "<|endoftext|>", "<|ENDOFTEXT|>", "a<|startoftext|>B", "中文", "İΣς", "—", "...", "é" * 9, "\x85", "𝒳", "ŒŸ", "3½", "@@", "é"]
    texts = [rng.choice(["", " "]).join(rng.choice(bits) + rng.choice(["", " ", "\n", "\t "]) for _ in range(rng.randint(0, 60))) for _ in range(150)] + ["", "word " * 3000, "x" * 4000]
    want = [library.encode(t, add_special_tokens=False).ids for t in texts]
    for stretch in (1 << 19, 64):
        monkeypatch.setattr(packing, "STRETCH", stretch)
        monkeypatch.setattr(token_counts, "STRETCH", stretch)
        got = [(first, ids.tolist(), counts) for first, ids, counts in packing.encoded(*text_buffers(pa.array(texts)), tokenizer_path())]
        assert [i for _, ids, _ in got for i in ids] == [i for w in want for i in w]
        assert [int(c) for _, _, counts in got for c in counts] == [len(w) for w in want]
        assert [first for first, _, _ in got] == np.cumsum([0] + [len(c) for _, _, c in got])[:-1].tolist()
        assert count_texts(texts, tokenizer_path()) == [len(w) for w in want]


def test_best_fit_is_near_the_optimum_of_small_cases():
    """Against the exact least number of bins, found by trying all ways; equal lengths included."""

    def least(lengths, cap):
        best = [len(lengths)]

        def go(i, bins):
            if len(bins) >= best[0]:
                return
            if i == len(lengths):
                best[0] = len(bins)
                return
            for k in range(len(bins)):
                if bins[k] + lengths[i] <= cap and bins.index(bins[k]) == k:
                    bins[k] += lengths[i]
                    go(i + 1, bins)
                    bins[k] -= lengths[i]
            go(i + 1, [*bins, lengths[i]])

        go(0, [])
        return best[0]

    rng = np.random.default_rng(7)
    extra = 0
    for _ in range(60):
        lengths = np.sort(rng.integers(10, 70, 10))[::-1]
        lengths[rng.integers(0, 10, 4)] = 30
        lengths = np.sort(lengths)[::-1]
        used = len(np.unique(best_fit(lengths, Capacities(100, 100, 1e9))))
        want = least(lengths.tolist(), 100)
        assert used <= want + 1
        extra += used - want
    assert extra <= 6
