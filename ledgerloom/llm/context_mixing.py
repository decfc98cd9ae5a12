"""Logistic context mixing of words' spellings: hashed-context bit predictors, gated weights, adaptive refinement.

A word is spelled as its bytes and a closing blank, bit by bit. For each of the orders 0 to 5 a table of
hashed contexts (the last bytes and the bits so far) holds how many words went on with 0 and with 1. Their
stretched estimates are mixed by a weight set that is chosen by the bit's place and the longest context
that has been seen, and the result is refined by a table of adaptive probabilities. Weights and refinement
learn online on predictions that leave the word itself out, so that they fit words not seen before.
"""

from __future__ import annotations

import numpy as np

from .textarrays import mix, ragged

ORDERS, SLOT_BITS = 6, 17
SLOTS = 1 << SLOT_BITS
STEPS, BLOCKS = 24, 48
_PRIOR = np.array([0.4, 0.3, 0.2, 0.1, 0.05, 0.05], np.float32)


class Spellings:
    """The distinct steps of words' spellings: up to five bytes before and the byte that follows, the closing blank included.

    ``code`` packs a step (nine bits a byte, 0 before the word's start), ``times`` counts it, ``all`` has the
    step of each byte and ``word`` its word. All predictions depend on the step alone.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        lengths = np.diff(offsets) + 1
        ends = np.cumsum(lengths)
        self.word = np.repeat(np.arange(len(lengths)), lengths)
        spelled = np.full(int(lengths.sum()), 33, np.uint64)
        spelled[ragged(ends - lengths, lengths - 1)] = data.astype(np.uint64) + np.uint64(1)
        place = np.arange(len(spelled)) - np.repeat(ends - lengths, lengths)
        code = spelled.copy()
        for order in range(1, ORDERS):
            before = np.zeros(len(spelled), np.uint64)
            before[order:] = spelled[:-order]
            before[place < order] = 0
            code |= before << np.uint64(9 * order)
        self.all = code
        self.code, self.times = np.unique(code, return_counts=True)
        self.bytes = (self.code & np.uint64(511)) - np.uint64(1)
        known = self.code >> np.uint64(9)
        self.context = [mix((known & np.uint64((1 << 9 * o) - 1)) + np.uint64(o << 56)) for o in range(ORDERS)]

    def slots(self, bit: int) -> tuple[np.ndarray, np.ndarray]:
        """(order, step) → slot for this bit, and the bit itself."""
        node = (self.bytes >> np.uint64(8 - bit)) + np.uint64(1 << bit)
        spread = node * np.uint64(0x9E3779B97F4A7C15)
        out = np.empty((ORDERS, len(node)), np.int64)
        for o, c in enumerate(self.context):
            out[o] = ((c ^ spread) * np.uint64(0xD6E8FEB86659FD93) >> np.uint64(64 - SLOT_BITS)).astype(np.int64) + o * SLOTS
        return out, ((self.bytes >> np.uint64(7 - bit)) & np.uint64(1)).astype(np.int64)


def counted(spellings: Spellings) -> np.ndarray:
    """(slot, bit) → words: the table of one lot of distinct words; tables of lots add up."""
    out = np.zeros(2 * ORDERS * SLOTS)
    times = spellings.times.astype(float)
    for bit in range(8):
        slots, bits = spellings.slots(bit)
        for order in slots:
            np.add.at(out, order * 2 + bits, times)
    return out.astype(np.float32).reshape(-1, 2)


def start() -> tuple[np.ndarray, np.ndarray]:
    """Weights by gate, and the refinement's (zeros, ones) by gate and step."""
    weights = np.full((8 * ORDERS, ORDERS + 1), 0.3, np.float32)
    weights[:, -1] = 0
    centre = 1 / (1 + np.exp(-(np.arange(STEPS) - STEPS / 2 + 0.5) / 1.5))
    return weights, np.repeat((np.stack([1 - centre, centre], 1) * 8)[None], 8 * ORDERS, 0)


def _inputs(table: np.ndarray, slots: np.ndarray, bits: np.ndarray | None, bit: int) -> tuple[np.ndarray, np.ndarray]:
    """Stretched predictions (byte, input), and the gate; with bits, the word's own count is left out."""
    n = table.view(np.complex64).ravel().take(slots)  # a slot's two counts at once
    zero, one = n.real, n.imag
    if bits is not None:
        own = bits.astype(np.float32)
        zero, one = np.maximum(zero - (1 - own), 0), np.maximum(one - own, 0)
    prior = _PRIOR[:, None]
    x = np.ones((slots.shape[1], ORDERS + 1), np.float32)
    x[:, :-1] = (np.log(one + prior) - np.log(zero + prior)).T
    seen = (zero + one > 0).sum(0)
    return x, bit * ORDERS + np.maximum(seen - 1, 0)


def _place(gate: np.ndarray, z: np.ndarray) -> np.ndarray:
    """The place in the refinement."""
    return gate * STEPS + np.clip((z * 1.5 + STEPS / 2).astype(np.int64), 0, STEPS - 1)


def learn(table: np.ndarray, spellings: Spellings, rounds: int = 6, rate: float = 0.15) -> tuple[np.ndarray, np.ndarray]:
    """Online over one lot of words: (weights, refinement counts)."""
    weights, refine = start()
    n = len(spellings.code)
    turn = (spellings.code * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(40)).astype(np.int64) % rounds if n else np.zeros(0, np.int64)
    for bit in range(8):
        slots, bits = spellings.slots(bit)
        x, gate = _inputs(table, slots, bits, bit)
        for r in range(rounds):
            own = turn == r
            xs, gs, times = x[own], gate[own], spellings.times[own].astype(np.float32)
            z = np.clip(np.einsum("ij,ij->i", xs, weights.take(gs, 0)), -12, 12)
            error = (bits[own] - 1 / (1 + np.exp(-z))) * times
            mass = np.bincount(gs, times, len(weights))
            grad = np.stack([np.bincount(gs, error * xs[:, i], len(weights)) for i in range(ORDERS + 1)], 1)
            weights += (rate * grad / np.maximum(mass, 50)[:, None]).astype(np.float32)
            refine += np.bincount(_place(gs, z) * 2 + bits[own], times, refine.size).reshape(refine.shape)
    return weights, refine


def spell(table: np.ndarray, weights: np.ndarray, refine: np.ndarray, spellings: Spellings, words: int) -> np.ndarray:
    """Natural log of the probability of each word's spelling."""
    total = np.zeros(len(spellings.code))
    refined = (refine[:, :, 1] / refine.sum(2)).astype(np.float32).ravel()
    for bit in range(8):
        slots, bits = spellings.slots(bit)
        x, gate = _inputs(table, slots, None, bit)
        z = np.clip(np.einsum("ij,ij->i", x, weights.take(gate, 0)), -12, 12)
        p = np.clip(0.5 / (1 + np.exp(-z)) + 0.5 * refined.take(_place(gate, z)), 1e-5, 1 - 1e-5)
        total += np.log(np.where(bits == 1, p, 1 - p))
    return np.bincount(spellings.word, total[np.searchsorted(spellings.code, spellings.all)], words) if len(total) else np.zeros(words)
