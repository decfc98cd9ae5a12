"""MinHash near-dedup: a chosen-path set similarity join over word shingles.

Every tree sends a document down a path of tokens: at each node the document picks the token of its set
that is least under the node's own hash, so two documents part at a node with probability 1 - J. Trees
are independent, and their number follows from the recall that is asked for. As large nodes are compared at
depth ``DEEP`` only, so many trees are grown that deep nodes alone give the recall; those above the number
that shallow nodes need have deep nodes only. All keys of a document come from its own set, so trees cost one
pass over the texts.

1. Documents of equal sets form a class; only the smallest id of a class goes on.
2. At the nodes of depth ``SHALLOW`` every member is compared with the node's smallest id (a number of pairs
   linear in the node), and the links found give first components.
3. Members outside their node's largest component are compared with ``PROBES`` members of it by hash, and
   what is still apart then exhaustively, in blocks: members outside the largest component against all.
   Nodes above ``LARGE`` branch on to depth ``DEEP`` before that, and so does each tree.
4. Candidates are confirmed on the full shingle sets of the whole texts, and components follow from all
   links by star contraction.

Null, empty and blank texts have no shingles, are linked with nothing and stay. A text of fewer words than
the width has its whole word sequence as its one shingle. Repeated rows get equal answers. A null doc_id is
never a representative unless its whole class has none. Different texts under one doc_id are one vertex of the
graph, and its links are those of one of the texts. An empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import components
from .shared import documents, lean, stored, written
from .textarrays import Words, mix, slices, text_buffers

SHALLOW, DEEP, LARGE, PROBES, BLOCK = 3, 5, 4096, 4, 256
#: Pairs that read one copy of a text, and bytes of text that are hashed at once.
SHARED, MOST = 2048, 1 << 19
_ODD = np.uint64(0xD6E8FEB86659FD93)


def trees_for(similarity: float, recall: float, depth: int = SHALLOW) -> int:
    """Independent trees after which a pair at the threshold has shared a node of a depth with the probability asked for."""
    return max(1, math.ceil(math.log(1 - recall) / math.log(1 - similarity**depth)))


def _paths(row: np.ndarray, token: np.ndarray, heads: np.ndarray, counts: np.ndarray, trees: int, full: int) -> tuple[np.ndarray, np.ndarray]:
    """(shallow, deep) node keys, one column a tree, of rows that have tokens; trees from ``full`` on have the deep node twice."""
    shallow, deep = (np.empty((len(heads), trees), np.uint64) for _ in range(2))
    for t in range(trees):
        node = mix(np.full(len(heads), t + 1, np.uint64))
        for level in range(1, DEEP + 1):
            h = (token ^ np.repeat(node, counts)) * _ODD
            h ^= h >> np.uint64(32)
            h *= _ODD
            node = mix(node * np.uint64(31) + np.minimum.reduceat(h, heads))
            if level == (SHALLOW if t < full else DEEP):
                shallow[:, t] = node
        deep[:, t] = node
    return shallow, deep


def shingle_table(docs: DataFrame, trees: int, width: int = 5, full: int | None = None) -> DataFrame:
    """doc_id, row_key, n_shingles, s1, s2 (digest of the set), shallow, deep (node keys by tree; none without shingles)."""
    shallow_trees = trees if full is None else full

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_buffers(batch.column("text"))
            for lo, hi in slices(offsets, MOST):
                row, token = Words(data, offsets, lo, hi).shingles(width)
                n = np.bincount(row, minlength=hi - lo)
                full = np.flatnonzero(n)
                heads = np.concatenate([[0], np.cumsum(n[full])[:-1]]).astype(np.int64)
                sums = np.zeros((2, hi - lo), np.uint64)
                keys = np.zeros((2, 0, trees), np.uint64)
                if len(full):
                    sums[0, full] = np.add.reduceat(mix(token + np.uint64(1)), heads)
                    sums[1, full] = np.add.reduceat(mix(token ^ np.uint64(0x5DEECE66D1234567)), heads)
                    keys = _paths(row, token, heads, n[full], trees, shallow_trees)
                at = pa.array(np.concatenate([[0], np.cumsum((n > 0) * trees)]).astype(np.int32))
                lists = [pa.ListArray.from_arrays(at, pa.array(k.reshape(-1).view(np.int64))) for k in keys]
                part = batch.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("row_key"), pa.array(n.astype(np.int64)), pa.array(sums[0].view(np.int64)), pa.array(sums[1].view(np.int64)), *lists], ["doc_id", "row_key", "n_shingles", "s1", "s2", "shallow", "deep"])

    return documents(docs).select("doc_id", "row_key", "text").mapInArrow(lean(work), "doc_id long, row_key long, n_shingles long, s1 long, s2 long, shallow array<long>, deep array<long>")


def _candidate_texts(docs: DataFrame, nodes: DataFrame, classes: DataFrame) -> DataFrame:
    """doc_id, text of the representatives that share a node with another."""
    wanted = nodes.select(F.col("rep").alias("id")).distinct().join(classes.select(F.col("rep").alias("id"), F.col("row_key").alias("key")), "id")
    rows = documents(docs).select("doc_id", "row_key", "text")
    met = rows.join(wanted, (rows.doc_id == wanted.id) & (rows.row_key == wanted.key), "left_semi")
    # different texts under one doc_id are one vertex, which the text of the least hash stands for
    return written(met.groupBy("doc_id").agg(F.min_by("text", "row_key").alias("text")))


def _confirmed(texts: DataFrame, pairs: DataFrame, similarity: float, width: int) -> DataFrame:
    """pairs (a, b) of representatives whose full sets are similar enough. The text of an ``a`` with many pairs, such as a
    large group's pivot, comes once for every ``SHARED`` of them, so that no task gets them all."""
    percent = round(similarity * 100)

    def sets(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        data, offsets = text_buffers(texts)
        rows, tokens = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
        for lo, hi in slices(offsets, MOST):
            r, t = Words(data, offsets, lo, hi).shingles(width)
            rows.append(r + lo)
            tokens.append(t)
        return np.concatenate(rows), np.concatenate(tokens)

    def test(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                part = batch.slice(k, 256)
                (ra, ta), (rb, tb) = sets(part.column("text_a")), sets(part.column("text_b"))
                n = part.num_rows
                row, token = np.concatenate([ra, rb]), np.concatenate([ta, tb])
                order = np.lexsort((token, row))
                row, token = row[order], token[order]
                same = (row[1:] == row[:-1]) & (token[1:] == token[:-1])
                common = np.bincount(row[1:][same], minlength=n)
                union = np.bincount(ra, minlength=n) + np.bincount(rb, minlength=n) - common
                yield pa.RecordBatch.from_arrays([part.column("a"), part.column("b")], ["a", "b"]).filter(pa.array((100 * common >= percent * union) & (union > 0)))

    b = texts.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b"))
    a = texts.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a"))
    shares = pairs.groupBy("a").agg(F.ceil(F.count("*") / SHARED).cast("int").alias("shares"))
    a = a.join(shares, "a").select("a", "text_a", F.explode(F.sequence(F.lit(0), F.col("shares") - 1)).alias("share"))
    dealt = pairs.join(shares, "a").select("a", "b", F.pmod(F.xxhash64("b"), F.col("shares")).cast("int").alias("share"))
    return stored(dealt.join(b, "b").join(a, ["a", "share"]).select("a", "b", "text_a", "text_b").mapInArrow(lean(test), "a long, b long"))


def near_duplicates(docs: DataFrame, similarity: float = 0.8, width: int = 5, recall: float = 0.9999) -> DataFrame:
    """doc_id, row_key, n_shingles, component_id, kept of every row."""
    trees = trees_for(similarity, recall, DEEP)
    table = stored(shingle_table(docs, trees, width, trees_for(similarity, recall)))
    some = table.where("n_shingles > 0 AND doc_id IS NOT NULL")
    classes = stored(some.groupBy("s1", "s2", "n_shingles").agg(F.min(F.struct("doc_id", "row_key")).alias("least"), F.min_by(F.struct("shallow", "deep"), F.struct("doc_id", "row_key")).alias("keys")).select("s1", "s2", "n_shingles", F.col("least.doc_id").alias("rep"), F.col("least.row_key").alias("row_key"), "keys.shallow", "keys.deep"))
    zipped = F.explode(F.arrays_zip("shallow", "deep")).alias("k")
    nodes = classes.select("rep", "n_shingles", zipped).select("rep", F.col("n_shingles").alias("n"), F.col("k.shallow").alias("node"), F.col("k.deep").alias("deep"))
    heads = stored(nodes.groupBy("node").agg(F.min(F.struct("rep", "n")).alias("h"), F.count("*").alias("members")).where("members > 1").select("node", F.col("h.rep").alias("pivot"), F.col("h.n").alias("pivot_n"), "members"))
    ratio = F.least("n", "pivot_n") * 100 >= F.greatest("n", "pivot_n") * round(similarity * 100)
    spokes = written(nodes.join(heads, "node"))
    texts = _candidate_texts(docs, spokes, classes)
    tried = stored(spokes.where((F.col("rep") != F.col("pivot")) & ratio).select(F.col("pivot").alias("a"), F.col("rep").alias("b")).distinct())
    links = _confirmed(texts, tried, similarity, width)
    comp = stored(components(links))
    more = stored(_probes(spokes, comp, similarity).join(tried, ["a", "b"], "left_anti"))
    if more.head(1):
        links = links.unionByName(_confirmed(texts, more, similarity, width))
        comp = stored(components(links))
    found = stored(_blocks(spokes, comp, texts, similarity, width))
    if found.head(1):
        comp = stored(components(links.unionByName(found)))
    named = classes.join(comp, classes.rep == comp.id, "left").select("s1", "s2", "n_shingles", F.coalesce("component", "rep").alias("component_id"))
    out = table.select("doc_id", "row_key", "n_shingles", "s1", "s2").join(named, ["s1", "s2", "n_shingles"], "left")
    own = F.coalesce("component_id", "doc_id")
    return out.select("doc_id", "row_key", "n_shingles", own.alias("component_id"), F.col("doc_id").eqNullSafe(own).alias("kept"))


def _mixed(spokes: DataFrame, comp: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Members (node, rep, n, comp), and the nodes of several components: main (the largest), its probes, n_left, n_all."""
    key = F.when(F.col("members") > LARGE, F.col("deep")).otherwise(F.col("node"))
    at = spokes.join(comp, spokes.rep == comp.id, "left").select(key.alias("node"), "rep", "n", F.coalesce("component", "rep").alias("comp"))
    probes = [F.min(F.struct(F.xxhash64("rep", "node", F.lit(k)), F.col("rep"), F.col("n"))).alias(f"probe{k}") for k in range(PROBES)]
    sizes = at.groupBy("node", "comp").agg(F.count("*").alias("size"), *probes)
    top = F.max(F.struct("size", "comp", F.array(*(f"probe{k}" for k in range(PROBES))).alias("probes"))).alias("top")
    mixed = sizes.groupBy("node").agg(top, F.sum("size").alias("n_all"), F.count("*").alias("comps")).where("comps > 1")
    return at, mixed.select("node", F.col("top.comp").alias("main"), F.col("top.probes").alias("probes"), (F.col("n_all") - F.col("top.size")).alias("n_left"), "n_all")


def _probes(spokes: DataFrame, comp: DataFrame, similarity: float) -> DataFrame:
    """Pairs (a, b) of members outside their node's largest component with ``PROBES`` members of it."""
    at, mixed = _mixed(spokes, comp)
    left = at.join(mixed, "node").where(F.col("comp") != F.col("main")).select(F.col("rep").alias("x"), F.col("n").alias("nx"), F.explode(F.array_distinct("probes")).alias("p"))
    met = left.select("x", "nx", F.col("p.rep").alias("y"), F.col("p.n").alias("ny"))
    close = F.least("nx", "ny") * 100 >= F.greatest("nx", "ny") * round(similarity * 100)
    return met.where(close).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def _blocks(spokes: DataFrame, comp: DataFrame, texts: DataFrame, similarity: float, width: int) -> DataFrame:
    """Links (a, b) that join components, by comparing all members outside a node's largest component with all its members.

    Both sides come in blocks of ``BLOCK``, each pair of blocks is one product of incidence matrices, and only a
    spanning set of its links is returned, so that nothing grows with the number of pairs.
    """
    at, mixed = _mixed(spokes, comp)
    percent = round(similarity * 100)
    cuts = mixed.select("node", "main", F.ceil(F.col("n_left") / BLOCK).cast("int").alias("cut_l"), F.ceil(F.col("n_all") / BLOCK).cast("int").alias("cut_r"))
    members = at.join(cuts, "node")
    own_l, own_r = F.pmod(F.xxhash64("rep"), F.col("cut_l")).cast("int"), F.pmod(F.xxhash64("rep", F.lit(1)), F.col("cut_r")).cast("int")
    left = members.where(F.col("comp") != F.col("main")).select("node", own_l.alias("lb"), F.explode(F.sequence(F.lit(0), F.col("cut_r") - 1)).alias("rb"), F.lit(0).alias("side"), "rep", "comp")
    right = members.select("node", F.explode(F.sequence(F.lit(0), F.col("cut_l") - 1)).alias("lb"), own_r.alias("rb"), F.lit(1).alias("side"), "rep", "comp")

    def joined(t: pa.Table) -> pa.RecordBatch:
        side, rep, parts = t.column("side").to_numpy(), t.column("rep").to_numpy(), t.column("comp").to_numpy()
        data, offsets = text_buffers(t.column("text"))
        row, token = (np.concatenate(x) for x in zip(*((r + lo, k) for lo, hi in slices(offsets, MOST) for r, k in (Words(data, offsets, lo, hi).shingles(width),)), strict=True))
        size = np.bincount(row, minlength=len(side))
        _, place, often = np.unique(token, return_inverse=True, return_counts=True)
        keep = often[place] > 1  # tokens of one text only count for its size
        row, place = row[keep], np.unique(place[keep], return_inverse=True)[1]
        common = np.zeros((int((side == 0).sum()), int((side == 1).sum())), np.float32)
        at_side = np.where(side == 0, np.cumsum(side == 0) - 1, np.cumsum(side == 1) - 1)
        for lo in range(0, int(place.max(initial=-1)) + 1, 8192):
            pick = (place >= lo) & (place < lo + 8192)
            cell = [np.zeros((m, 8192), np.float32) for m in common.shape]
            for s in (0, 1):
                mine = pick & (side[row] == s)
                cell[s][at_side[row[mine]], place[mine] - lo] = 1
            common += cell[0] @ cell[1].T
        l, r = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        union = size[l][:, None] + size[r][None, :] - common
        x, y = np.nonzero((100 * common >= percent * union) & (parts[l][:, None] != parts[r][None, :]))
        boss: dict[int, int] = {}

        def find(v: int) -> int:
            while (up := boss.get(v, v)) != v:
                boss[v] = v = boss.get(up, up)
            return v

        out: list[tuple[int, int]] = []
        for i, j in zip(l[x], r[y], strict=True):
            a, b = find(parts[i]), find(parts[j])
            if a != b:
                boss[a] = b
                out.append((int(rep[i]), int(rep[j])))
        return pa.RecordBatch.from_arrays([pa.array([min(o) for o in out], pa.int64()), pa.array([max(o) for o in out], pa.int64())], ["a", "b"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        key = None
        for batch in batches:
            keys = list(zip(*(batch.column(c).to_pylist() for c in ("node", "lb", "rb")), strict=True))
            start = 0
            for i, k in enumerate(keys):
                if k != key:
                    if key is not None:
                        yield joined(pa.Table.from_batches([*held, batch.slice(start, i - start)]))
                    held, start, key = [], i, k
            held.append(batch.slice(start))
        if key is not None:
            yield joined(pa.Table.from_batches(held))

    both = left.unionByName(right).join(texts, F.col("rep") == F.col("doc_id")).select("node", "lb", "rb", "side", "rep", "comp", "text")
    return both.repartition("node", "lb", "rb").sortWithinPartitions("node", "lb", "rb").mapInArrow(lean(work), "a long, b long")


def near_dedup(docs: DataFrame, similarity: float = 0.8, width: int = 5, recall: float = 0.9999) -> DataFrame:
    """docs, all columns, with one document of each group: the one of the smallest id."""
    keep = near_duplicates(docs, similarity, width, recall).where("kept").select(F.col("doc_id").alias("__id"), F.col("row_key").alias("__key"))
    keyed = docs.withColumn("__row", F.xxhash64(F.coalesce(F.col("text"), F.lit(""))))
    return keyed.join(keep, keyed.doc_id.eqNullSafe(keep["__id"]) & (keyed["__row"] == keep["__key"]), "left_semi").drop("__row")
