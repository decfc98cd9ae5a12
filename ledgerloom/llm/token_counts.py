"""Token counts by rank-synchronous array merging.

Distinct pre-tokens are laid out as one ragged numpy array of symbols. In every step each
pre-token looks up the ranks of its adjacent pairs in a sorted pair table, and all pre-tokens apply their
own lowest-rank pair at once, left to right without overlap; the surviving symbols are the token counts.
Ids of words are kept in a bounded table of the worker. The tokenizer file's path is a parameter. Texts are
read in stretches of bounded length that end at white space, so a very long text takes no more memory.

Null and empty texts have no tokens. Repeated rows are counted one by one; an empty table gives an empty
result.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .pretokens import Cutter, cut_bytes
from .shared import documents, lean
from .textarrays import STRETCH, Words, long_rows_cut, ragged, range_hashes, slices, text_buffers

#: Words whose ids a worker remembers.
REMEMBERED = 700_000
TABLE_BITS = 18


def byte_symbols() -> list[str]:
    """The printable stand-in of each byte in byte-level vocabularies: itself if printable, else from 256 on."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = iter(range(0x100, 0x200))
    return [chr(b) if b in shown else chr(next(rest)) for b in range(256)]


def _hash_tables(keys: np.ndarray) -> list[tuple[np.uint64, np.ndarray]]:
    """Tables from hashes of keys to their places (-1: none); keys that meet another in one table go to the next one, too."""
    out, left, rng = [], np.arange(len(keys)), np.random.default_rng(5)
    while len(left) or not out:
        multiplier = rng.integers(1, 1 << 63, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        cell = (keys[left].astype(np.uint64) * multiplier >> np.uint64(64 - TABLE_BITS)).astype(np.int64)
        table = np.full(1 << TABLE_BITS, -1, np.int32)
        table[cell] = left
        left = left[table[cell] != left]
        out.append((multiplier, table))
    return out


class RankMerger:
    """The merge table of a BPE file as arrays: pair keys in order, their ranks and results."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        vocab, self.suffix = model["vocab"], model.get("end_of_word_suffix") or ""
        self.size = len(vocab) + 2
        pairs = [x if isinstance(x, list) else x.split(" ") for x in model["merges"]]
        left, right = (np.array([vocab[p[i]] for p in pairs], np.int64) for i in (0, 1))
        made = np.array([vocab[a + b] for a, b in pairs], np.int64)
        key = left * self.size + right
        order = np.argsort(key, kind="stable")
        self.keys, self.ranks, self.made = key[order], np.arange(len(pairs))[order], made
        self.tables = _hash_tables(self.keys)
        symbols = byte_symbols()
        self.inner = np.array([vocab[s] for s in symbols], np.int64)
        self.final = np.array([vocab[s + self.suffix] for s in symbols], np.int64)

    def find(self, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place of each pair key, whether it is there)."""
        at = np.zeros(len(key), np.int32)
        hit = np.zeros(len(key), bool)
        left = np.arange(len(key))
        for multiplier, table in self.tables:
            k = key[left].astype(np.uint64)
            got = table[(k * multiplier >> np.uint64(64 - TABLE_BITS)).astype(np.int64)]
            there = got >= 0
            same = there & (self.keys[got] == key[left])
            at[left[same]], hit[left[same]] = got[same], True
            left = left[there & ~same]  # an empty cell: no such pair
            if not len(left):
                break
        return at, hit

    def merged(self, raw: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(symbols, offsets) of pre-tokens after all merges; raw is their UTF-8, one after another."""
        n_words = len(lengths)
        symbols = self.inner[raw]
        ends = np.cumsum(lengths)
        full = lengths > 0
        symbols[ends[full] - 1] = self.final[raw[ends[full] - 1]]
        word = np.repeat(np.arange(n_words), lengths)
        counts, live = lengths.copy(), np.arange(len(symbols))
        done_symbols, done_words = [], []
        none = len(self.keys) + 1
        while len(live):
            s, w = symbols[live], word[live]
            rank = np.full(len(s), none)
            if len(s) > 1:
                key = s[:-1] * self.size + s[1:]
                at, hit = self.find(key)
                hit &= w[:-1] == w[1:]
                rank[:-1][hit] = self.ranks[at[hit]]
            heads = np.flatnonzero(np.concatenate([[True], w[1:] != w[:-1]]))
            least = np.repeat(np.minimum.reduceat(rank, heads), np.diff(np.append(heads, len(w))))
            over = least == none
            done_symbols.append(s[over])
            done_words.append(w[over])
            go = (rank == least) & ~over
            # of a run of equal overlapping pairs (a a a), every second one applies, from the left
            i = np.flatnonzero(go)
            if len(i):
                starts = np.concatenate([[True], np.diff(i) != 1])
                place = np.arange(len(i)) - np.repeat(np.flatnonzero(starts), np.diff(np.append(np.flatnonzero(starts), len(i))))
                # a run only overlaps where the pair is (a, a); (a, b) never follows itself directly
                i = i[place % 2 == 0]
                symbols[live[i]] = self.made[rank[i]]
            gone = np.zeros(len(s), bool)
            gone[i + 1] = True
            live = live[~gone & ~over]
        s, w = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (done_symbols, done_words))
        order = np.argsort(w, kind="stable")
        counts = np.bincount(w, minlength=n_words)
        return s[order], np.concatenate([[0], np.cumsum(counts)])


class Coder:
    """Token ids of white-space words. A text's tokens are its words' tokens in order, as pre-tokens hold no white space.

    Distinct words of a stretch are looked up by their 64-bit hash; those not seen before are cut into pre-tokens and
    merged all at once. Ids are kept in one array for up to ``REMEMBERED`` words, then the table starts anew.
    """

    def __init__(self, path: str):
        self.cutter, self.merger = Cutter(path), RankMerger(path)
        self._clear()

    def _clear(self) -> None:
        self.keys, self.place = np.zeros(0, np.uint64), np.zeros(0, np.int32)
        self.ids, self.starts, self.lengths = np.zeros(0, np.uint16 if self.merger.size < 1 << 16 else np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int32)

    def _learn(self, keys: np.ndarray, data: np.ndarray, offsets: np.ndarray) -> None:
        """Ids of new words, in order of their keys."""
        slow, folded, starts = cut_bytes(data, offsets)
        ends = np.append(starts[1:], len(data))
        word = np.searchsorted(offsets, starts, "right") - 1
        fast = ~slow[word]
        starts, ends, word = starts[fast], ends[fast], word[fast]
        ids, first, counts = self._merged(folded, starts, ends)
        tokens = np.bincount(word, counts, len(keys)).astype(np.int64)
        at_slow = np.flatnonzero(slow)
        if len(at_slow):
            cut = [self.cutter.pieces(bytes(data[offsets[i] : offsets[i + 1]]).decode()) for i in at_slow]
            distinct = {w: i for i, w in enumerate(dict.fromkeys(chain.from_iterable(cut)))}
            plain = [b"" if w in self.cutter.specials else w.encode() for w in distinct]
            size = np.array([len(w) for w in plain], np.int64)
            more, at = self.merger.merged(np.frombuffer(b"".join(plain), np.uint8), size)
            begin, n = len(ids) + at[:-1], np.diff(at)
            special = [i for w, i in distinct.items() if w in self.cutter.specials]
            begin[special], n[special] = len(ids) + len(more) + np.arange(len(special)), 1
            ids = np.concatenate([ids, more, [self.cutter.specials[w] for w in distinct if w in self.cutter.specials]]).astype(np.int64)
            piece = np.fromiter((distinct[w] for w in chain.from_iterable(cut)), np.int64)
            owner = np.repeat(at_slow, [len(c) for c in cut])
            tokens += np.bincount(owner, n[piece], len(keys)).astype(np.int64)
            order = np.argsort(np.concatenate([word, owner]), kind="stable")
            first, counts = np.concatenate([first, begin[piece]])[order], np.concatenate([counts, n[piece]])[order]
        heads = len(self.ids) + np.cumsum(tokens) - tokens
        place = np.arange(len(self.lengths), len(self.lengths) + len(keys), dtype=np.int32)
        self.ids = np.concatenate([self.ids, ids[ragged(first, counts)].astype(self.ids.dtype)])
        self.starts, self.lengths = np.concatenate([self.starts, heads]), np.concatenate([self.lengths, tokens.astype(np.int32)])
        into = np.searchsorted(self.keys, keys)
        self.keys, self.place = np.insert(self.keys, into, keys), np.insert(self.place, into, place)

    def _merged(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, first id and number of ids of each pre-token); equal pre-tokens are merged once."""
        _, one, which = np.unique(range_hashes(data, starts, ends), return_index=True, return_inverse=True)
        size = (ends - starts)[one]
        ids, offsets = self.merger.merged(data[ragged(starts[one], size)], size)
        return ids, offsets[:-1][which], np.diff(offsets)[which]

    def words(self, words: Words) -> np.ndarray:
        """The place of each word in ``starts`` and ``lengths``."""
        distinct, first, inverse = np.unique(words.hashes(), return_index=True, return_inverse=True)
        if len(self.keys) > REMEMBERED:
            self._clear()
        at = np.minimum(np.searchsorted(self.keys, distinct), max(0, len(self.keys) - 1))
        new = self.keys[at] != distinct if len(self.keys) else np.ones(len(distinct), bool)
        if new.any():
            begin, size = words.start[first[new]], (words.end - words.start)[first[new]]
            self._learn(distinct[new], words.data[ragged(begin, size)], np.concatenate([[0], np.cumsum(size)]))
            at = np.searchsorted(self.keys, distinct)
        return self.place[at][inverse]


def may_fold(data: np.ndarray) -> bool:
    """Whether A-Z may be folded before words are looked up: special strings are told by their case, and all hold ``<|``."""
    return b"<|" not in data.tobytes()


@lru_cache(2)
def coder(path: str) -> Coder:
    return Coder(path)


def counts_of(data: np.ndarray, offsets: np.ndarray, path: str) -> np.ndarray:
    """Token counts of texts, as the tokenizers library gives them without added special tokens."""
    own = coder(path)
    cuts, row = long_rows_cut(data, offsets, STRETCH)
    out = np.zeros(len(offsets) - 1, np.int64)
    for lo, hi in slices(cuts, STRETCH):
        words = Words(data, cuts, lo, hi, fold=may_fold(data[cuts[lo] : cuts[hi]]))
        if len(words.start):
            at = own.words(words)
            n = np.bincount(words.row, own.lengths[at], hi - lo)
            np.add.at(out, row[lo:hi], n.astype(np.int64))
    return out


def count_texts(texts: list[str], path: str) -> list[int]:
    """The same for a list."""
    return counts_of(*text_buffers(pa.array(texts, pa.large_string())), path).tolist()


def token_counts(docs: DataFrame, path: str, limit: int = 2048) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every row."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_buffers(batch.column("text"))
            n = counts_of(data, offsets, path)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.diff(offsets)), pa.array(n), pa.array(n > limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return documents(docs).select("doc_id", "text").mapInArrow(lean(count), "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
