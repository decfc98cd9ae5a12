import hashlib
import random
import re
from collections import defaultdict

import numpy as np

from ledgerloom.llm.exact_dedup import exact_dedup
from ledgerloom.llm.line_dedup import deduplicated, line_dedup_digest

from .conftest import ODD

BLANK = re.compile(r"[\x20\x09-\x0D]")


def exact_by_hand(docs):
    groups = defaultdict(list)
    for i, t in docs:
        groups[BLANK.sub("", t or "")].append((-len(t or ""), i))
    return sorted((i, min(g)[1], len(g), min(g)[1] == i, hashlib.sha256(k.encode()).hexdigest()) for k, g in groups.items() for _, i in g)


def test_exact_dedup(docs_of):
    rng = random.Random(3)
    docs = list(enumerate([*ODD, *(" ".join(rng.choices(["a", "b", "Ç"], k=rng.randint(0, 3))) + rng.choice(["", "\n", " "]) for _ in range(500))]))
    got = exact_dedup(docs_of(docs).repartition(9))
    assert sorted(tuple(r) for r in got.select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()) == exact_by_hand(docs)


def test_exact_dedup_odd_rows(odd_docs):
    assert exact_dedup(odd_docs).count() == odd_docs.count()
    assert exact_dedup(odd_docs.limit(0)).count() == 0


def lines_by_hand(docs, least=10):
    strip = lambda x: re.sub(r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", "", x)
    fold = lambda x: re.sub("[A-Z]", lambda m: m[0].lower(), strip(x))
    seen = defaultdict(set)
    for i, t in docs:
        for x in (t or "").split("\n"):
            seen[fold(x)].add(i)
    out = []
    for i, t in docs:
        lines = (t or "").split("\n")
        kept = [x for x in lines if not fold(x) or len(seen[fold(x)]) < least]
        out.append((i, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out)


def some_lines(seed=5, n=120):
    rng = random.Random(seed)
    pool = [f"Line {k} Été " for k in range(60)] + ["hot line"] * 30 + ["", " "]
    return list(enumerate([*ODD, *("\n".join(rng.choice(pool).upper() if rng.random() < 0.3 else rng.choice(pool) for _ in range(rng.randint(0, 12))) for _ in range(n))]))


def test_line_dedup(docs_of):
    docs = some_lines()
    got = line_dedup_digest(docs_of(docs).repartition(5))
    assert sorted(tuple(r) for r in got.select("doc_id", "n_lines", "n_dropped", "kept_sha256").collect()) == lines_by_hand(docs)


def test_line_dedup_keys_cut_by_edges(spark, docs_of):
    docs = some_lines(9, 200)
    spark.conf.set("spark.sql.shuffle.partitions", "61")
    try:
        got = line_dedup_digest(docs_of(docs), 12)
        assert sorted(tuple(r) for r in got.collect()) == lines_by_hand(docs, 12)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_line_dedup_texts(odd_docs, docs_of):
    assert line_dedup_digest(odd_docs).count() == odd_docs.count()
    assert line_dedup_digest(odd_docs.limit(0)).count() == 0
    same = docs_of(["Head\nbody %d" % i for i in range(10)])
    assert sorted(r.text for r in deduplicated(same).collect()) == sorted(f"body {i}" for i in range(10))
    assert deduplicated(odd_docs).columns == odd_docs.columns and np.all([r.n_chars is None or r.n_chars == len(r.text) for r in deduplicated(same).collect()])
