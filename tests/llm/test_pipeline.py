from collections import Counter

import corpus_pipeline as P
from ledgerloom.llm.queries import ORACLE_SQL, QUERIES


def test_registered_queries():
    import __spark_entry__ as e

    names = [n for n in e.queries() if n.startswith("op")]
    assert [sum(n.startswith(f"op{k}_") for n in names) for k in range(1, 11)] == [1] * 10
    assert "pipeline" in e.queries() and set(ORACLE_SQL) <= set(QUERIES)


def test_stages_keep_columns_and_rows_follow(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    names = docs.columns
    for name, stage in P.STAGES[:-1]:
        before = {r.doc_id for r in docs.select("doc_id").collect()}
        docs = P.written(stage(spark, docs, sf))
        assert docs.columns == names, name
        after = [r.doc_id for r in docs.select("doc_id").collect()]
        assert set(after) <= before and len(after) == len(set(after)), name
    pieces = P.best_fit_packing(spark, docs, sf).collect()
    assert {r.doc_id for r in pieces} == set(after)
    used = Counter()
    for r in pieces:
        used[r.sequence_id] += r.length
    assert max(used.values()) <= 4096


def test_empty_documents(spark, docs_of):
    empty = docs_of([]).limit(0)
    for _, stage in P.STAGES:
        empty_out = stage(spark, empty, "/root/testdata/sf0.001")
        assert empty_out.count() == 0
