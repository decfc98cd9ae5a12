"""Deep-shallow suffix sorting of short segments, for repeats of a given length.

``repeated`` takes segments that share an anchor and tells which of their windows of ``length`` bytes stand
in another segment at the same distance from the anchor. At one distance the suffixes of a group's segments
are sorted by a multikey quicksort over eight-byte words (ternary partitions about a median of three, all
groups at once) to a shallow depth. Suffixes that are still equal there have long common prefixes; a blind
trie orders them and gives each one's longest common prefix with the others. What all suffixes of a group
have in common settles every pair up to its end, so the next distance to sort at lies behind that, or where
another segment begins.
"""

from __future__ import annotations

import numpy as np

SHALLOW_WORDS = 8


class BlindTrie:
    """Inner nodes are [depth, {byte: child}]; leaves are places in ``strings``. Keys are compared only once, at the leaf."""

    def __init__(self):
        self.strings: list[bytes] = []
        self.lcp: list[int] = []
        self.root: list | int | None = None

    def add(self, s: bytes) -> None:
        me = len(self.strings)
        self.strings.append(s)
        self.lcp.append(0)
        if self.root is None:
            self.root = me
            return
        node = self.root
        while isinstance(node, list):  # blind: only branching bytes are looked at
            depth, children = node
            node = children.get(s[depth]) if depth < len(s) and s[depth] in children else next(iter(children.values()))
        same = common_prefix(s, self.strings[node])
        self.lcp[me] = same
        self.lcp[node] = max(self.lcp[node], same)
        parent, at, node = None, -1, self.root
        while isinstance(node, list) and node[0] < same:
            parent, at = node, s[node[0]]
            if at not in node[1]:
                break
            node = node[1][at]
        if isinstance(node, list) and node[0] == same and same < len(s):
            node[1][s[same]] = me
            return
        if parent is not None and node is parent:
            parent[1][at] = me
            return
        leaf = node
        while isinstance(leaf, list):
            leaf = next(iter(leaf[1].values()))
        other = self.strings[leaf]
        if same >= len(s) or same >= len(other):  # one is a prefix of the other: the longer stands for both
            if not isinstance(node, list) and len(s) > len(other):
                self._put(parent, at, me)
            return
        self._put(parent, at, [same, {other[same]: node, s[same]: me}])

    def common(self) -> int:
        """What all strings begin with."""
        shortest = min(map(len, self.strings))
        return min(self.root[0], shortest) if isinstance(self.root, list) else shortest

    def _put(self, parent: list | None, at: int, node: list | int) -> None:
        if parent is None:
            self.root = node
        else:
            parent[1][at] = node


def common_prefix(a: bytes, b: bytes) -> int:
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    x = np.frombuffer(a, np.uint8, n) != np.frombuffer(b, np.uint8, n)
    return int(x.argmax())


def _words(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on, as a number that sorts like them."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)]).astype(np.uint64)
    out = np.zeros(len(data), np.uint64)
    for k in range(8):
        out <<= np.uint64(8)
        out |= padded[k : k + len(data)]
    return out


def multikey_quicksort(words: np.ndarray, start: np.ndarray, group: np.ndarray, levels: int) -> tuple[np.ndarray, np.ndarray]:
    """(order, tie): suffixes in order within their groups, as far as ``levels`` words tell, and numbers of those that are equal.

    Each step splits every open group by its pivot into less, equal and greater; equal ones go on a word deeper.
    """
    order = np.argsort(group, kind="stable")
    tie = group[order]
    tie = np.cumsum(np.concatenate([[0], tie[1:] != tie[:-1]])) if len(tie) else tie
    level = np.zeros(len(order), np.int64)
    live = np.arange(len(order))  # places in ``order`` of groups that are open
    while True:
        own = tie[live]
        size = np.bincount(own, minlength=int(own.max(initial=-1)) + 1)
        live = live[(size[own] > 1) & (level[live] < levels)]
        if not len(live):
            return order, tie
        own = tie[live]
        word = words[start[order[live]] + 8 * level[live]]
        heads = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
        n = np.diff(np.append(heads, len(own)))
        three = np.sort(np.stack([word[heads], word[heads + n // 2], word[heads + n - 1]]), 0)
        pivot = np.repeat(three[1], n)
        side = (word >= pivot).astype(np.int64) + (word > pivot)
        which = np.repeat(np.arange(len(heads)), n)
        inner = np.argsort(which * 3 + side, kind="stable")
        order[live], level[live] = order[live][inner], level[live][inner] + (side[inner] == 1)
        part = (which * 3 + side)[inner]
        cut = np.zeros(len(order), bool)
        cut[live[1:]] = (part[1:] != part[:-1]) & (which[1:] == which[:-1])
        tie = tie + np.cumsum(cut)


def _common_heads(data: np.ndarray, a: np.ndarray, b: np.ndarray, most: int) -> np.ndarray:
    """Length of the common prefix of the suffixes from a[i] and b[i] on, if under ``most``."""
    place = np.arange(most)
    differ = data[a[:, None] + place] != data[b[:, None] + place]
    return np.where(differ.any(1), differ.argmax(1), most)


def repeated(data: np.ndarray, begin: np.ndarray, size: np.ndarray, ahead: np.ndarray, group: np.ndarray, length: int) -> np.ndarray:
    """For each window of each segment, in order: whether it repeats.

    Segment i is ``data[begin[i] : begin[i] + size[i]]`` and has ``size[i] - length + 1`` windows; its anchor
    stands ``ahead[i]`` bytes after its start. Segments of different groups aren't compared.
    """
    windows = size - length + 1
    heads = np.cumsum(windows) - windows
    out = np.zeros(int(windows.sum()), bool)
    if not len(size):
        return out
    words, raw, levels = _words(data), data.tobytes(), min(SHALLOW_WORDS, length // 8)
    n = int(group.max()) + 1
    none = np.iinfo(np.int64).min
    cursor = np.full(n, none)  # the distance that a group is sorted at
    np.maximum.at(cursor, group, ahead)
    least = np.full(n, np.iinfo(np.int64).max)
    np.minimum.at(least, group, ahead - windows + 1)
    own = np.flatnonzero(np.bincount(group, minlength=n)[group] > 1)  # segments of groups that aren't done
    while len(own):
        at = cursor[group[own]]
        there = own[(ahead[own] >= at) & (ahead[own] - windows[own] < at)]
        behind = np.full(n, none)
        later = own[ahead[own] < at]
        np.maximum.at(behind, group[later], ahead[later])
        members = np.bincount(group[there], minlength=n)
        there = there[members[group[there]] > 1]
        step = ahead[there] - cursor[group[there]]
        start = begin[there] + step
        common = _settled(data, raw, words, start, begin[there] + size[there], group[there], levels, length, heads[there] + step, out, n)
        cursor = np.where(members > 1, np.maximum(cursor - common - 1, behind), behind)
        own = own[cursor[group[own]] >= least[group[own]]]
    return out


def _settled(data, raw, words, start, end, group, levels, length, window, out, n) -> np.ndarray:
    """Sort the suffixes of each group, mark the windows that repeat, and return what all of a group's suffixes begin with."""
    common = np.zeros(n, np.int64)
    if not len(start):
        return common
    order, tie = multikey_quicksort(words, start, group, levels)
    own = group[order]
    first = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
    last = np.append(first[1:], len(own)) - 1
    split = tie[first] != tie[last]
    common[own[first[split]]] = _common_heads(data, start[order[first[split]]], start[order[last[split]]], max(1, 8 * levels))
    bounds = np.flatnonzero(np.concatenate([[True], tie[1:] != tie[:-1], [True]]))
    alone = np.ones(n, bool)
    alone[own[first[split]]] = False
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        if b - a == 1:
            continue
        trie = BlindTrie()
        members = order[a:b].tolist()
        for w in members:
            trie.add(raw[start[w] : end[w]])
        for w, same in zip(members, trie.lcp, strict=True):
            if same >= length:
                out[window[w] : window[w] + same - length + 1] = True
        if alone[own[a]]:
            common[own[a]] = trie.common()
    return common
