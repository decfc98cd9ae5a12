import importlib
import random
import re

from ledgerloom.llm.graph import components
from ledgerloom.llm.near_dedup import near_dedup, near_duplicates


def shingles(text, width=5):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[k : k + width]) for k in range(max(1, len(words) - width + 1))} if words else set()


def by_hand(docs, percent):
    sets = {i: shingles(t) for i, t in docs}
    boss = {i: i for i in sets}

    def find(x):
        while boss[x] != x:
            x = boss[x]
        return x

    where = {}
    for i, s in sets.items():
        for x in s:
            where.setdefault(x, []).append(i)
    tried = set()
    for ids in where.values():
        for n, a in enumerate(ids):
            for b in ids[n + 1 :]:
                if (a, b) not in tried:
                    tried.add((a, b))
                    common = len(sets[a] & sets[b])
                    if 100 * common >= percent * (len(sets[a]) + len(sets[b]) - common):
                        x, y = find(a), find(b)
                        boss[max(x, y)] = min(x, y)
    return {i: (len(s), find(i), find(i) == i) for i, s in sets.items()}


def variants(seed=2):
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(3000)]
    docs = []
    for _ in range(25):
        base = rng.choices(words, k=rng.randint(3, 200))
        for _ in range(rng.randint(1, 12)):
            own = list(base)
            for _ in range(rng.randint(0, 3)):
                own[rng.randrange(len(own))] = rng.choice(words).upper()
            docs.append(" ".join(own))
    base = rng.choices(words, k=300)
    for k in range(400):  # a group too large to compare exhaustively
        own = list(base)
        own[k % 300] = "edit"
        docs.append("\n".join(own))
    docs += [None, "", " \t", "one two", "One  Two", "one two three"]
    rng.shuffle(docs)
    return list(enumerate(docs))


def test_near_duplicates_equal_brute_force(docs_of):
    docs = variants()
    for percent in (85, 80):
        got = near_duplicates(docs_of(docs).repartition(7), percent / 100).collect()
        assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in got} == by_hand(docs, percent)


def test_near_dedup_keeps_one_of_each(docs_of, odd_docs):
    docs = variants(4)
    want = {i for i, (_, _, kept) in by_hand(docs, 80).items() if kept}
    assert {r.doc_id for r in near_dedup(docs_of(docs)).collect()} == want
    assert near_duplicates(odd_docs).count() == odd_docs.count()
    assert near_dedup(odd_docs).columns == odd_docs.columns
    assert near_duplicates(odd_docs.limit(0)).count() == 0


def test_components_of_a_chain_and_a_star(spark):
    chain = [(k, k + 1) for k in range(40)]
    star = [(100, 101 + k) for k in range(50)]
    got = {r.id: r.component for r in components(spark.createDataFrame(chain + star, "a long, b long")).collect()}
    assert got == {**{k: 0 for k in range(41)}, **{k: 100 for k in range(100, 151)}}


def test_large_nodes_keep_the_recall(spark, docs_of, monkeypatch):
    near_dedup_module = importlib.import_module("ledgerloom.llm.near_dedup")
    monkeypatch.setattr(near_dedup_module, "LARGE", 1)  # every node is compared inside its deep children
    deep = near_dedup_module.DEEP
    seen = []
    table = near_dedup_module.shingle_table
    monkeypatch.setattr(near_dedup_module, "shingle_table", lambda docs, trees, *rest: seen.append(trees) or table(docs, trees, *rest))
    words = [f"w{k}" for k in range(60)]
    texts = [" ".join(words[:50] + [f"x{k}"] * (k > 0)) for k in range(30)] + ["other words altogether here now"]
    got = near_dedup_module.near_duplicates(docs_of(texts), 0.8).collect()
    assert len({r.component_id for r in got if r.doc_id < 30}) == 1 and {r.component_id for r in got if r.doc_id == 30} == {30}
    assert (1 - 0.8**deep) ** seen[0] <= 0.0001
