"""Online context mixing of running text, bit by bit.

A text is a row of symbols: frequent words, the end, and an escape for other words. A symbol is written as the
bits of its way down a Huffman tree. Each bit is predicted from hashed contexts that reach across words:

* how often training texts went on with 0 and 1 at this node, after nothing, the word before, the two words
  before, and the last frequent word before that;
* how the text itself went on so far at this node, and after the same word before, in tables that are updated
  after every bit.

The stretched predictions are mixed by weights that are chosen by the bit's depth and by how often the contexts have been
seen; every text starts from the learned weights and updates them after every bit. A table of adaptive
probabilities refines the result. The bits of one word differ in depth, so they use different weights and
nodes: working on a word's bits at once gives what working on them one by one would.

Texts are read side by side, in lanes; nothing passes from a text to another, but while weights are learned.
"""

from __future__ import annotations

import heapq

import numpy as np

from .textarrays import Words, mix, ragged

INPUTS, LEVELS, STEPS, LANES = 8, 9, 24, 128  # rows of 32 bytes; the last input is not used
#: Symbols whose bits are worked out at once: what stays in a core's cache.
LOT = 1 << 13
OWN_BITS = 12
#: Hashed slots: about twice the training tokens, within these powers of two; nodes have 2**17 more of their own.
LEAST_BITS, MOST_BITS, NODE_BITS = 16, 23, 17
FREQUENT = 128
#: Tables are summed up in so many blocks.
BLOCKS = 16
#: Half of z is held within 7 where it becomes a probability.
_MOST = np.float32(np.tanh(7))
_G1, _G2 = np.uint32(0x9E3779B1), np.uint32(0x85EBCA6B)
#: Of the text's own tables: a state is two counts of up to 15, the other one fades.
_A, _B = np.divmod(np.arange(256), 16)
_OWN = (np.log(_B + 0.3) - np.log(_A + 0.3)).astype(np.float32)
_NEXT = np.concatenate([np.minimum(_A + 1, 15) * 16 + np.where(_B > 2, _B // 2 + 1, _B), np.where(_A > 2, _A // 2 + 1, _A) * 16 + np.minimum(_B + 1, 15)]).astype(np.uint8)


def slot_bits(tokens: int) -> int:
    return int(min(MOST_BITS, max(LEAST_BITS, np.ceil(np.log2(max(tokens, 1)) + 1))))


class Code:
    """Symbols and their ways down the tree; ``hashes`` in order, the end's included, and the escape as the last symbol."""

    def __init__(self, hashes: np.ndarray, sigs: np.ndarray, counts: np.ndarray, escapes: int, tokens: int):
        self.hashes, self.sigs, self.counts, self.bits = hashes, sigs, counts, slot_bits(tokens)
        self.ladder = np.append(hashes, np.iinfo(np.int64).max)
        self.rungs = np.searchsorted(hashes, np.arange(-(1 << 17), 1 << 17) << 46)
        self.end, self.escape = int(np.flatnonzero((hashes == 0) & (sigs == 0))[0]), len(hashes)
        weights = [*np.maximum(counts, 1).tolist(), max(escapes, 1)]
        n = len(weights)
        heap = [(w, i) for i, w in enumerate(weights)]
        heapq.heapify(heap)
        parent, side = np.zeros(2 * n - 1, np.int64), np.zeros(2 * n - 1, np.int8)
        for node in range(n, 2 * n - 1):
            (a, i), (b, j) = heapq.heappop(heap), heapq.heappop(heap)
            parent[[i, j]], side[j] = node, 1
            heapq.heappush(heap, (a + b, node))
        top = 2 * n - 2
        ways, at = [], np.arange(n)
        while (at != top).any():  # one level of all ways at a time, upwards
            ways.append(np.stack([np.where(at != top, parent[at], -1), side[at]], 1))
            at = np.where(at != top, parent[at], top)
        node = np.stack([w[:, 0] for w in ways[::-1]], 1)
        bit = np.stack([w[:, 1] for w in ways[::-1]], 1)
        there = node >= 0
        self.length = there.sum(1)
        self.start = np.cumsum(self.length) - self.length
        self.node, self.bit = (node[there] - n).astype(np.int32), bit[there].astype(np.uint8)
        self.depth = (np.arange(len(self.node)) - np.repeat(self.start, self.length)).astype(np.int32)
        self.turn = (2 * self.depth + self.bit).astype(np.uint8)  # depth and bit; a way is far shorter than 128 bits
        self.deepest = int(self.length.max())
        rank = np.argsort(-counts, kind="stable")[: FREQUENT + 1]
        self.frequent = np.zeros(n, bool)
        self.frequent[rank] = True
        self.frequent[[self.end, self.escape]] = False

    def find(self, h: np.ndarray) -> np.ndarray:
        """The place of each hash among the symbols' hashes, as searchsorted gives it, one at most past the last."""
        at = self.rungs.take((h >> 46) + (1 << 17))
        short = np.flatnonzero(self.ladder.take(at) < h)
        while len(short):
            at[short] += 1
            short = short[self.ladder.take(at[short]) < h[short]]
        return at

    def size(self) -> int:
        return (1 << NODE_BITS) + (1 << self.bits)


class Read:
    """Symbols of rows, their contexts, and, per distinct word, what frequent words need."""

    def __init__(self, code: Code, words: Words):
        rows = len(words.offsets) - 1
        self.rows, self.counts = rows, np.diff(words.first) + 1
        self.first = np.cumsum(self.counts) - self.counts
        n = int(self.counts.sum())
        h = words.hashes().view(np.int64)
        at = np.minimum(code.find(h), len(code.hashes) - 1)
        hit = code.hashes[at] == h
        a, b, d = words.start, words.end, words.data
        sig = ((b - a) & 127) << 24 | d[a].astype(np.int64) << 16 | d[(a + b) // 2].astype(np.int64) << 8 | d[b - 1]
        self.known = hit & (code.sigs[at] == sig)
        place = np.arange(len(h)) + words.row
        self.symbol = np.full(n, code.end)
        self.symbol[place] = np.where(self.known, at, code.escape)
        self.row = np.repeat(np.arange(rows), self.counts)
        hashed = np.zeros(n + 2, np.uint64)  # two places ahead
        hashed[place + 2] = words.hashes()
        age = np.arange(n) - self.first[self.row]
        one = np.where(age > 0, hashed[1 : n + 1], np.uint64(0))
        two = np.where(age > 1, hashed[:n], np.uint64(0))
        last = np.maximum.accumulate(np.where(code.frequent[self.symbol], np.arange(n), -1)) if n else np.zeros(0, np.int64)
        before = np.concatenate([np.full(2, -1), last])[:n]
        three = np.where(before >= self.first[self.row], hashed[before + 2], np.uint64(0))
        self.contexts = [mix(one + np.uint64(1 << 60)), mix(mix(one + np.uint64(2 << 60)) + two), mix(three + np.uint64(3 << 60))]
        self.contexts = [(c >> np.uint64(32)).astype(np.uint32) for c in self.contexts]


def slots(code: Code, read: Read, tokens: np.ndarray) -> tuple[np.ndarray, ...]:
    """(context, bit) → slot, and way place, token of every bit of these tokens, in order."""
    symbol = read.symbol[tokens]
    length = code.length[symbol]
    way = ragged(code.start[symbol], length)
    which = np.repeat(np.arange(len(tokens)), length)
    out = np.empty((4, len(way)), np.int64)
    node = code.node.take(way)
    out[0] = node
    spread = node.view(np.uint32) * _G1
    for k, c in enumerate(read.contexts):
        out[k + 1] = _hashed(code, c[tokens].take(which), spread)
    return out, way, which


def _hashed(code: Code, own: np.ndarray, spread: np.ndarray) -> np.ndarray:
    """The slots of these contexts, which are overwritten, at these nodes."""
    own ^= spread
    own *= _G2
    own ^= own >> np.uint32(15)
    own *= _G1
    own >>= np.uint32(32 - code.bits)
    own += np.uint32(1 << NODE_BITS)
    return own


def count(code: Code, read: Read, into: np.ndarray) -> None:
    """Add a lot of texts to the counts (slot, bit). What is found several times, a symbol after a context, is added at once."""
    flat = into.reshape(-1)
    for c in read.contexts:
        found, n = np.unique(read.symbol.astype(np.uint64) << np.uint64(32) | c, return_counts=True)
        n = n.astype(flat.dtype)
        for lo in range(0, len(found), LOT):
            symbol = (found[lo : lo + LOT] >> np.uint64(32)).astype(np.int64)
            length = code.length[symbol]
            way = ragged(code.start[symbol], length)
            spread = code.node.take(way).view(np.uint32) * _G1
            at = _hashed(code, found[lo : lo + LOT].astype(np.uint32).repeat(length), spread).astype(np.int64)
            at *= 2
            at += code.bit.take(way)
            np.add.at(flat, at, n[lo : lo + LOT].repeat(length))
    n = np.bincount(read.symbol, minlength=len(code.length)).repeat(code.length)  # without contexts: a node's symbols
    flat[: 2 * code.escape] += np.bincount(code.node.astype(np.int64) * 2 + code.bit, n, 2 * code.escape).astype(flat.dtype)


def packed(counts: np.ndarray) -> np.ndarray:
    """Counts (slot, bit) as stretched predictions, and a level of how often a slot was seen, in 16 bits."""
    zero, one = counts[:, 0].astype(np.float32), counts[:, 1].astype(np.float32)
    seen = zero + one
    stretch = np.clip(np.rint(10 * (np.log(one + 0.2) - np.log(zero + 0.2))), -127, 127).astype(np.int64) + 128
    return (stretch + 256 * ((seen > 0).astype(np.int64) + (seen > 3))).astype(np.uint16)


def start(code: Code) -> tuple[np.ndarray, np.ndarray]:
    """Weights by gate, and the refinement's (zeros, ones) by level and step."""
    weights = np.full((code.deepest * LEVELS, INPUTS), 0.25, np.float32)
    weights[:, 6:] = 0
    centre = 1 / (1 + np.exp(-(np.arange(STEPS) - STEPS / 2 + 0.5) / 1.5))
    return weights, np.repeat((np.stack([1 - centre, centre], 1) * 8)[None], LEVELS, 0)


def _dealt(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Texts dealt to lanes, long ones first, each to the shortest lane: (lane, place in it) of each text."""
    lane, place = np.zeros(len(counts), np.int64), np.zeros(len(counts), np.int64)
    heap = [(0, k) for k in range(min(LANES, len(counts)))]
    for r in np.argsort(-counts, kind="stable").tolist():
        used, k = heap[0]
        lane[r], place[r] = k, used
        heapq.heapreplace(heap, (used + int(counts[r]), k))
    return lane, place


def mixed(code: Code, table: np.ndarray, weights: np.ndarray, refine: np.ndarray, read: Read, rate: float = 0.004, learn: bool = False):
    """Natural log of each text's probability, symbol after symbol; with learn, the weights and refinement counts after it instead."""
    lane_of, place_of = _dealt(read.counts)
    lane, step = lane_of[read.row], place_of[read.row] + np.arange(len(read.row)) - read.first[read.row]
    order = np.lexsort((lane, step))  # by step, and by lane within
    lanes, steps = int(lane_of.max()) + 1, int(step.max()) + 1
    ends = np.cumsum(np.bincount(step, minlength=steps))
    fresh = np.zeros(len(read.row), bool)
    fresh[read.first] = True
    gates, half = len(weights), (weights * 0.5).astype(np.float32)  # half the weights give half of z, which tanh takes
    w = np.tile(half, (lanes, 1))
    cells = w.view(np.complex128).ravel()  # two of 16 bytes a row of weights
    own = np.zeros((lanes, 2 << OWN_BITS), np.uint8)
    flat, touched = own.reshape(-1), np.zeros(lanes * gates, bool)
    total, gain = np.zeros(read.rows), np.zeros_like(refine)
    refined = (refine[:, :, 1] / refine.sum(2)).astype(np.float32).ravel() * np.float32(0.5)
    ones, mask, quarter = np.ones(INPUTS, np.float32), (1 << OWN_BITS) - 1, np.float32(rate / 4)
    lo = 0
    while lo < steps:  # stretches of steps of bounded size
        base = ends[lo - 1] if lo else 0
        hi = max(lo + 1, int(np.searchsorted(ends, base + LOT)))
        tokens = order[base : ends[hi - 1]]
        at, way, which = slots(code, read, tokens)
        cell = table.take(at)
        x = np.empty((len(way), INPUTS), np.float32)
        for k, own_cell in enumerate(cell):
            np.subtract((own_cell & 255).astype(np.float32) * np.float32(0.1), np.float32(12.8), out=x[:, k])
        x[:, 6], x[:, 7] = 1, 0
        pairs = x.view(np.float64)  # the third holds inputs 4 and 5, of the text's own tables
        level = (cell[1] >> 8) * np.uint16(3) + (cell[2] >> 8)
        turn = code.turn.take(way)
        bit = turn & 1
        lane_bit = lane[tokens].take(which)
        gate = (turn >> 1) * np.uint16(LEVELS) + level + lane_bit * gates
        both = np.empty((len(way), 2), np.int64)
        np.multiply(gate, 2, out=both[:, 0])
        np.add(both[:, 0], 1, out=both[:, 1])
        cache = np.empty((len(way), 2), np.int64)
        lane_bit *= 2 << OWN_BITS
        np.add(at[0].astype(np.uint32) * _G2 >> np.uint32(32 - OWN_BITS), lane_bit, out=cache[:, 0])
        np.add(at[1] & mask, lane_bit + (mask + 1), out=cache[:, 1])
        next_of = np.repeat(bit.astype(np.int64) * 256, 2).reshape(-1, 2)
        side = bit * np.float32(2) - np.float32(1)
        sign = side * quarter
        z, squashed = np.empty((2, len(way)), np.float32)
        counts = ends[lo:hi] - base
        cuts = np.concatenate([[0], np.cumsum(code.length[read.symbol[tokens]])])[np.concatenate([[0], counts])].tolist()
        begun: dict[int, list[int]] = {}
        for i in np.flatnonzero(fresh[tokens]).tolist():
            begun.setdefault(int(step[tokens[i]]) - lo, []).append(int(lane[tokens[i]]))
        for s, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
            if s in begun:
                own[begun[s]] = 0
                if not learn:
                    w.reshape(lanes, gates, INPUTS)[begun[s]] = half
            c, xs, zs = cache[a:b], x[a:b], z[a:b]
            state = flat.take(c).astype(np.intp)
            pairs[a:b, 2] = _OWN.take(state).view(np.float64)[:, 0]
            wg = w.take(gate[a:b], 0)
            np.matmul(xs * wg, ones, out=zs)
            error = np.tanh(zs, out=squashed[a:b]) * quarter
            np.subtract(sign[a:b], error, out=error)  # the bit less its probability, times half the rate
            wg += xs * error.repeat(INPUTS).reshape(-1, INPUTS)
            cells[both[a:b]] = wg.view(np.complex128)
            state += next_of[a:b]
            flat[c] = _NEXT.take(state)
        place = level * np.intp(STEPS) + np.clip(z * np.float32(3) + np.float32(STEPS / 2), 0, STEPS - 1).astype(np.intp)
        if learn:
            touched[gate] = True
            gain += np.bincount(place * 2 + bit, minlength=gain.size).reshape(gain.shape)
        else:
            p = np.clip(squashed, -_MOST, _MOST, out=squashed)
            p *= np.float32(0.25)
            p -= np.float32(0.25)
            p += refined.take(place)  # of a 1, less a half
            p *= side
            p += np.float32(0.5)
            np.log(np.clip(p, 1e-6, 1, out=p), out=p)
            total += np.bincount(read.row[tokens].take(which), p, read.rows)
        lo = hi
    if not learn:
        return total
    many = touched.reshape(lanes, gates).sum(0)
    change = 2 * (w.reshape(lanes, gates, INPUTS) - half).sum(0) / np.maximum(many, 1)[:, None]
    return (weights + change).astype(np.float32), gain
