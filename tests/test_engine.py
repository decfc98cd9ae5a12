import datetime as dt
import json
import random
import time
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from ledgerloom.functions import amounts as A
from ledgerloom.operators import analyse as N
from ledgerloom.operators import convert as C
from ledgerloom.operators import extract as E
from ledgerloom.operators import filters as L
from ledgerloom.operators import joins as J
from ledgerloom.operators import present as V
from ledgerloom.operators import reconcile as R
from ledgerloom.operators import reshape as S
from ledgerloom.operators import tidy as T
from ledgerloom.operators.common import RID
from ledgerloom.plans import catalogue, runtime
from ledgerloom.sources import readers, sinks
from ledgerloom.streaming.windows import windowed_breakdown


def table(spark, header, rows):
    data = [(i, *(None if c is None else str(c) for c in r)) for i, r in enumerate(rows)]
    return spark.createDataFrame(data, f"{RID} long, " + ", ".join(f"`{h}` string" for h in header)).coalesce(1)


SALES = (["Date", "Customer", "Region", "Amount"], [
    ["05/01/2025", "Acme", "North", "£100"], ["20/01/2025", "Birch", "South", "200"], ["03/02/2025", "Acme", "North", "300"], ["09/04/2025", "Cedar", "", "junk"], ["", "Acme", "South", "50"], ["11/04/2026", "Birch", "North", "150"], ["12/04/2025", "Acme", "South", "400"],
])


def rows(df, *names):
    return [tuple(r) for r in df.select(*names).collect()]


def test_filters(spark):
    df = table(spark, ["Customer", "Amount", "Due"], [["A", "100", "01/02/2026"], ["B", "(500)", "15/02/2026"], ["C", "n/a", "x"], [" ", "1,000", ""], ["a", "", "2026-03-01"]])
    got = L.filter_rows(df, [{"column": "amount", "op": ">", "value": 50}])
    assert rows(got.df, "Customer") == [("A",), (" ",)]
    assert got.coverage() == {"n_in": 5, "n_out": 2, "n_dropped": 3, "removed_0": 3, "incomparable_0": 2}
    one = lambda **f: [r[0] for r in rows(L.filter_rows(df, [f]).df, "Customer")]
    assert one(column="Customer", op="==", value="a") == ["A", "a"]
    assert one(column="Due", op="<", value="10/02/2026") == ["A"]
    assert one(column="Amount", op="between", value=[-600, 100]) == ["A", "B"]
    assert one(column="Amount", op="in", value=["100", "n/a"]) == ["A", "C"]
    assert one(column="Amount", op="is_empty") == ["a"]
    with pytest.raises(KeyError):
        L.filter_rows(df, [{"column": "nope", "op": "==", "value": 1}])
    with pytest.raises(ValueError):
        L.filter_rows(df, [{"column": "Due", "op": "~", "value": 1}])


def test_summary_and_outliers(spark):
    df = table(spark, ["v"], [[x] for x in (1, 2, 3, 4, 5, 6, 7, 1000, "x", "")])
    s = N.numeric_summary(df, "v").first()
    assert (s.n, s.missing, s.skipped, s.median, s.p25, s.p75) == (8, 1, 1, Decimal("4.5"), Decimal("2.5"), Decimal("6.5"))
    out = N.outliers_iqr(df, "v")
    assert rows(out.df, "side", "value") == [("high", Decimal(1000))] and out.coverage()["high_count"] == 1
    assert N.numeric_summary(table(spark, ["v"], [["5"]]), "v").first().p25 == 5
    assert N.numeric_summary(table(spark, ["v"], [["x"]]), "v").first().n == 0


def test_numbers_keep_every_row_of_wide_tables(spark):
    text = F.concat(*(F.sha2((F.col("id") * 7 + i).cast("string"), 256) for i in range(4)))
    df = spark.range(1, 40_001, numPartitions=3).select((F.col("id") * 3).alias("_rid"), text.alias("text"))  # its row ids alone take few partitions, whole rows more
    got = T.numbered(df)
    assert got.agg(F.count("*"), F.min("row"), F.max("row"), F.count_if(F.col("row") * 3 != F.col("_rid")), F.sum(F.length("text"))).first()[:] == (40_000, 1, 40_000, 0, 256 * 40_000)


def test_outliers_on_a_fence_count_as_in_sql(spark, tmp_path):
    duckdb = pytest.importorskip("duckdb")
    values = [1.0] * 4 + [1.18] * 5 + [1.45]  # the upper fence is 1.45, but 1.4499999999999997 in doubles
    spark.createDataFrame([(v,) for v in values], "value double").coalesce(1).write.parquet(str(tmp_path / "events.parquet"))
    got = catalogue.QUERIES["outliers_event_value"](spark, str(tmp_path)).first()
    db = duckdb.connect()
    db.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    assert [tuple(got)] == db.sql(catalogue.ORACLE["outliers_event_value"]).fetchall() and got.high_count == 1
    exact = N.outliers_iqr(spark.createDataFrame([(v,) for v in values], "value double"), "value").coverage()
    assert exact["upper_fence"] == Decimal("1.45") and exact["high_count"] == 0


def test_breakdown_and_concentration(spark):
    df = table(spark, *SALES)
    got = N.breakdown(df, "Customer", "Amount")
    assert [(r.key, r.total, r["count"]) for r in got.df.collect()] == [("Acme", 850, 4), ("Birch", 350, 2), ("Cedar", 0, 1)]
    report = got.coverage()
    assert report["skipped"] == 1 and report["groups_to_80pct"] == 2 and not report["has_negatives"]
    assert ("(blank)",) in rows(N.breakdown(df, "Region").df, "key")
    negative = N.breakdown(table(spark, ["k", "v"], [["a", "5"], ["b", "-3"]]), "k", "v")
    assert negative.df.first().share is None and negative.coverage()["has_negatives"]
    c = N.concentration(N.group_totals(df, "Customer", "Amount").where("total > 0")).first()
    assert c.n == 2 and c.classification == "highly concentrated" and c.hhi == pytest.approx((850 / 12) ** 2 + (350 / 12) ** 2)
    assert N.gini(table(spark, ["v"], [[1], [1], [1], [1]]), "v").first().gini == 0
    assert N.gini(table(spark, ["v"], [[0], [0], [0], [10]]), "v").first().gini == 0.75


def test_period_operators(spark):
    df = table(spark, *SALES)
    got = N.period_series(df, "Date", "Amount")
    series = {r.period: r for r in got.df.collect()}
    assert len(series) == 16 and series["2025-03"].total == 0 and series["2025-01"].total == 300 and series["2026-04"].yoy == pytest.approx((150 - 400) / 400)
    assert got.coverage()["bad_dates"] == 1 and got.coverage()["best"] == "2025-04" and series["2025-05"].yoy is None
    t = N.trend(spark.createDataFrame([("a", 1.0), ("b", 2.0), ("c", 3.0)], "period string, total double")).first()
    assert (t.slope, t.r_squared, t.classification) == (1.0, 1.0, "rising")
    flat = N.trend(spark.createDataFrame([("a", 2.0), ("b", 2.0), ("c", 2.0)], "period string, total double")).first()
    assert flat.classification == "flat" and flat.r_squared == 0
    r = N.rolling(spark.createDataFrame([("a", 1.0), ("b", 5.0), ("c", 3.0), ("d", 9.0)], "period string, total double"), how="median")
    assert [x.rolling for x in r.orderBy("period").collect()] == [None, None, 3.0, 5.0]
    s = {x.season: x for x in N.seasonality(df, "Date", "Amount").collect()}
    assert s[1].total == 300 and s[4]["count"] == 3 and s[7]["count"] == 0 and len(s) == 12


def test_ageing_cohort_pivot(spark):
    df = table(spark, *SALES)
    age = {r.bucket: r["count"] for r in N.ageing(df, "Date", "30/04/2025").collect()}
    assert age == {"future": 1, "0–30": 2, "31–60": 0, "61–90": 1, "90+": 2, "unparsed": 1}
    cohort = {(r.cohort, r.offset): r.entities for r in N.cohort(df, "Customer", "Date").df.collect()}
    assert cohort[("2025-01", 0)] == 2 and cohort[("2025-01", 3)] == 1 and cohort[("2025-04", 0)] == 1 and cohort[("2025-04", 9)] == 0
    p = {(r.row, r.col): r.cell for r in N.pivot(df, "Region", "Customer", "Amount").collect()}
    assert p[("North", "Acme")] == 400 and p[("North", None)] == 550 and p[(None, None)] == 1200


def test_shape_and_relation(spark):
    d = N.distribution(table(spark, ["v"], [[x] for x in (1, 2, 3, 4, 100)]), "v").first()
    assert d.classification in ("heavy-tailed", "highly skewed") and d.skewness == pytest.approx(2.232, abs=1e-3)
    m = {(r.row, r.col): r.r for r in N.correlation_matrix(table(spark, ["a", "b", "c"], [[1, 2, 5], [2, 4, 5], [3, 6, 5], ["x", 1, 5]]), ["a", "b", "c"]).collect()}
    assert m[("a", "b")] == 1.0 and m[("a", "c")] is None and m[("c", "c")] == 1.0
    h = N.histogram(table(spark, ["v"], [[x] for x in (0, 5, 10, 11, "x")]), "v", [0, 5, 10])
    assert [r["count"] for r in h.df.collect()] == [1, 2] and h.coverage() == {"n": 4, "outside": 1, "not_numeric": 1}


def test_join_first_row_and_coverage(spark):
    a = table(spark, ["Week", "Product", "Price"], [["1", "A", "10"], ["01/01/2026", "B", "11"], ["3", "C", "12"]])
    b = table(spark, ["week", "product", "Price"], [["1.0", "a", "9"], ["1", "A", "8"], ["2026-01-01", " b ", "7"], ["9", "Z", "6"]])
    got = J.join_on(a, b, ["Week", "Product"], "left")
    assert [(r.Product, r.r_Price) for r in got.df.orderBy(RID).collect()] == [("A", "9"), ("B", "7"), ("C", None)]
    assert got.coverage() == {"matched": 2, "left_only": 1, "right_only": 1, "right_dup_keys": 1}


def test_asof_rates(spark):
    df = table(spark, ["d"], [["2026-01-15"], ["2025-01-01"], ["2026-03-01"], ["x"]])
    rates = spark.createDataFrame([("2026-01-01", "1.1"), ("2026-02-01", "1.2")], "as_of string, rate string")
    from ledgerloom.functions import parsing as P

    got = J.asof_rate(df, P.day(F.col("d")), rates).orderBy(RID).collect()
    assert [r.fx_rate for r in got] == [Decimal("1.1"), Decimal("1.1"), Decimal("1.2"), None]


def test_reshape(spark):
    df = table(spark, ["id", "x", "y"], [["1", "a", "b"], ["2", "c", None]])
    long = S.unpivot(df, ["id"], ["x", "y"])
    assert sorted(rows(long, "id", "variable"))[0] == ("1", "x") and long.count() == 4
    assert sorted(rows(S.pivot_wide(long, ["id"], "variable", "value"), "id", "x", "y")) == [("1", "a", "b"), ("2", "c", "")]
    assert S.union([df.drop(RID), df.drop(RID, "y").withColumn("z", F.lit("q"))]).columns == ["id", "x", "y", "z"]
    assert S.nest(df, ["id"], "kids", ["x", "y"]).first().kids[0].x == "a"
    nested = spark.createDataFrame([json.dumps({"a": {"b": 1, "c": [1, 2]}})], "string").select(F.from_json("value", "a struct<b:int,c:array<int>>").alias("j")).select("j.*")
    assert S.flatten(nested).columns == ["a.b", "a.c"]


def test_recipe(spark):
    df = table(spark, ["Inv. Name", "Commit", "Close"], [["Acme ltd", "£1,000", "01/02/2026"], ["", "", ""], ["Birch", "pending", "13/13/2026"], ["ACME LTD", "£1,000", "01/02/2026"], ["Total", "2,000", ""], ["Acme ltd", "£1,000", "01/02/2026"]])
    recipe = {
        "columns": [{"name": "Name", "source": "inv. name", "case": "title"}, {"name": "Amount", "source": "Commit", "type": "currency"}, {"name": "Close", "source": "Close", "type": "date"}, {"name": "Gone", "source": "nope"}],
        "dedup": {"keys": ["Name", "Amount"], "fuzzy": True}, "validate": [{"column": "Name", "required": True, "regex": "^[A-Z]"}],
    }
    got = T.apply_recipe(df, recipe)
    assert got.coverage() == {"blank_rows": 1, "total_rows": 1}
    out = got.df.orderBy(RID).collect()
    assert [(r.Name, r.Amount, r["Amount Currency"]) for r in out] == [("Acme Ltd", Decimal(1000), "GBP"), ("Birch", None, "")]
    assert out[1]["Amount__raw"] == "pending" and out[1]["Close__raw"] == "13/13/2026"
    reasons = {(r.column, r.reason.split(":")[0]) for r in got.extra["flags"].collect()}
    assert ("Amount", "not a number") in reasons and ("Close", "unrecognised date") in reasons and ("Gone", "source column not found") in reasons
    assert got.extra["issues"].count() == 0


def test_profile_quality_and_clusters(spark):
    df = table(spark, *SALES)
    kinds = {c["column"]: c["type"] for c in T.profile(df)}
    assert kinds["Date"] == "date" and kinds["Amount"] in ("number", "text") and kinds["Customer"] == "text"
    q = T.score_quality(df)
    assert 0 < q["score"] <= 100 and q["grade"] in "ABCDF"
    p = T.profile(table(spark, ["p", "m"], [["low", "£1"], ["High", "£2"], ["medium", "3"]]))
    assert [c["type"] for c in p] == ["ordinal", "currency"]
    v = T.propose_value_map(table(spark, ["c"], [["New York"], ["new york"], ["New York"], ["Paris"]]), "c")
    assert {(r.surface, r.canonical) for r in v.collect()} == {("New York", "New York"), ("new york", "New York")}


def test_convert(spark):
    df = table(spark, ["Date", "Account", "Debit", "Credit", "Memo"], [["01/02/2026", "100", "50.255", "", "rent"], ["02/02/2026", "", "", "20", "fee"], ["03/02/2026", "300", "1", "", "skip"]])
    spec = {
        "filter": [{"column": "Memo", "op": "ne", "value": "skip"}],
        "map": [{"target": "Day", "source": "date", "type": "date", "format": "%Y-%m-%d"}, {"target": "Amount", "sources": ["Debit", "Credit"], "compute": "debit_minus_credit", "type": "number", "dp": 2}, {"target": "Acct", "source": "Account"}, {"target": "Note", "sources": ["Memo", "Account"], "compute": "concat", "sep": "/"}, {"target": "Src", "const": "GL"}],
        "contract": [{"name": "Acct", "required": True, "on_missing": "exclude"}, {"name": "Note", "max_len": 3}],
    }
    got = C.convert(df, spec)
    assert rows(got.df, "Day", "Amount", "Acct", "Note", "Src") == [("2026-02-01", "50.26", "100", "rent/100", "GL")]
    assert got.extra["issues"].first().column == "Acct" and got.extra["validators"].first().rule == "max_len"
    assert got.coverage()["n_excluded"] == 1
    assert [d["severity"] for d in C.sense_check(["Date"], spec)] == ["error"] * 4


def key_case(spark):
    a = table(spark, ["invoice_no", "amount", "date"], [["INV 1", "100", "2026-01-01"], ["inv2", "200.45", "2026-01-01"], ["3", "300", ""], ["inv1", "100", ""], ["5", "x", ""], ["6", "£10", ""]])
    b = table(spark, ["Invoice_No", "amount"], [["inv1", "100"], ["INV2", "200"], ["4", "400"], ["5", "5"], ["6", "US$10"]])
    return a, b


def test_reconcile_by_key(spark):
    o = R.Options(mode="key", key="invoice_no")
    got = {(r.bucket, r.a, r.b) for r in R.match(*key_case(spark), o).collect()}
    assert got == {("matched", 0, 0), ("value_diff", 1, 1), ("a_only", 2, None), ("dup_a", 3, None), ("parse_error", 4, 3), ("currency_diff", 5, 4), ("b_only", None, 2)}
    buckets = R.match(*key_case(spark), o)
    cats = {r.category: r.materiality for r in R.triage(buckets, o).collect()}
    assert cats["amount_mismatch"] == "immaterial" and cats["missing_in_A"] == "immaterial" and "duplicate" in cats
    assert R.summarise(buckets, R.triage(buckets, o))["matched"] == 1


def serial(a, b, tol, win):
    """The ordered choice, by hand."""
    free, out = dict(enumerate(b)), set()
    for i, (amt, d) in enumerate(a):
        best = None
        for j, (x, e) in free.items():
            if abs(amt - x) <= tol:
                gap = abs((d - e).days)
                rank = (0 if gap <= win else 1, gap)
                if best is None or rank < best[0]:
                    best = (rank, j)
        if best is None:
            out.add(("a_only", i, None))
        else:
            out.add(("matched" if best[0][0] == 0 else "ambiguous", i, best[1]))
            del free[best[1]]
    return out | {("b_only", None, j) for j in free}


def test_reconcile_by_amount_and_date_equals_the_ordered_choice(spark):
    rng = random.Random(4)
    day = lambda: dt.date(2026, 1, 1) + dt.timedelta(days=rng.randint(0, 25))
    sides = [[(Decimal(rng.choice([100, 100.01, 100.02, 250, 251, rng.randint(300, 400)])).quantize(Decimal("0.01")), day()) for _ in range(60)] for _ in range(2)]
    frames = [table(spark, ["amount", "date"], [[a, d.isoformat()] for a, d in s]) for s in sides]
    o = R.Options(mode="amount_date", date="date")
    got = {(r.bucket, r.a, r.b) for r in R.match_amount_date(R.items(frames[0], o), R.items(frames[1], o), o).collect()}
    assert got == serial(*sides, Decimal("0.01"), 5)


def test_residue(spark):
    a = table(spark, ["amount", "date"], [["100", "2026-01-01"], ["100", "2026-01-01"], ["55", "2026-01-03"], ["200", "2026-01-05"]])
    b = table(spark, ["amount", "date"], [["100", "2026-01-02"], ["-55", "2026-01-03"], ["218", "2026-01-06"]])
    got = {(r.bucket, r.a, r.b) for r in R.match(a, b, R.Options(mode="amount_date", date="date")).collect()}
    assert got == {("matched", 0, 0), ("dup_a", 1, None), ("value_diff", 2, 1), ("value_diff", 3, 2)}


def test_sign_flips_of_large_groups_pair_in_order(spark):
    rng = random.Random(5)
    day = lambda: (dt.date(2026, 1, 1) + dt.timedelta(days=rng.randint(0, 20))).isoformat()
    many = [[str(s * 10), "2026-01-03"] for s in (1, -1)]
    sides = [[many[k]] * 450 + [[str((1 - 2 * k) * Decimal(rng.choice(["77.00", "77.01", "77.02", "78.50"]))), day()] for _ in range(40)] for k in (0, 1)]
    o = R.Options(mode="amount_date", date="date")
    got = {(r.a, r.b) for r in R.match(*(table(spark, ["amount", "date"], s) for s in sides), o).where("bucket = 'value_diff' AND a_amt * b_amt < 0").collect()}
    free, want = set(range(490)), set()
    for i, (v, d) in enumerate(sides[0]):
        fits = lambda j: abs(Decimal(v) + Decimal(sides[1][j][0])) <= Decimal(str(o.rounding)) and abs((dt.date.fromisoformat(d) - dt.date.fromisoformat(sides[1][j][1])).days) <= o.date_window_days  # noqa: B023, E731
        j = next((j for j in sorted(free) if fits(j)), None)
        if j is not None:
            free.discard(j)
            want.add((i, j))
    assert got == want and {(k, k) for k in range(450)} <= got


def test_large_equal_groups_match_in_order_and_in_time(spark):
    n = 20_000  # looking through all free records for each would take hundreds of millions of steps
    side = lambda odd: spark.range(n).selectExpr(f"id AS {RID}", "'100.00' AS amount", "'2026-01-03' AS date").union(spark.sql(f"SELECT {n}L, '{odd}', '2026-01-03'"))
    start = time.monotonic()
    o = R.Options(mode="amount_date", date="date")
    got = R.match_amount_date(R.items(side("100.01"), o), R.items(side("100.02"), o), o).collect()
    assert {(r.bucket, r.a, r.b) for r in got} == {("matched", k, k) for k in range(n + 1)} and time.monotonic() - start < 90


def test_tax_pairs_are_the_serial_choice(spark):
    rng = random.Random(7)
    day = lambda: rng.choice([None, *((dt.date(2026, 1, 1) + dt.timedelta(days=k)) for k in range(0, 24, 2))])
    sides = [[(Decimal(rng.choice(c)), day()) for _ in range(90)] for c in (("100", "200", "-100", "107"), ("105.05", "107.20", "214", "-108", "115.101", "100"))]
    a, b = (spark.createDataFrame([(i, v, d, None) for i, (v, d) in enumerate(x)], f"{s} long, {s}_amt decimal(28,6), {s}_dt date, {s}_ccy string") for s, x in zip("ab", sides, strict=True))
    inside = F.coalesce(F.abs(F.datediff("a_dt", "b_dt")) <= 5, F.lit(True))
    got = R._taxed(a, b, F.lit("0.01").cast("decimal(28,6)"), F.lit(True), inside, R.Options(mode="amount_date", date="date"))
    free, want = dict(enumerate(sides[1])), set()
    for i, (v, d) in enumerate(sides[0]):
        fits = []
        for j, (w, e) in free.items():
            gap, low, high = abs((d - e).days) if d and e else 0, *sorted((abs(v), abs(w)))
            if (v > 0) == (w > 0) and gap <= 5 and any(abs((high - low) / low - Decimal(r)) <= Decimal("0.001") for r in A.TAX_RATES):
                fits.append((gap, j))
        if fits:
            want.add((i, min(fits)[1]))
            del free[min(fits)[1]]
    assert {(r.a, r.b) for r in got.collect()} == want and len(want) > 20


def test_greedy_rounds_leave_no_edge(spark, monkeypatch):
    monkeypatch.setattr(R, "ONE_TASK_EDGES", 0)
    edges = spark.range(52).selectExpr("id AS a").crossJoin(spark.range(52).selectExpr("id AS b")).selectExpr("a", "b", "0 AS w")
    assert {(r.a, r.b) for r in R._greedy(edges).collect()} == {(k, k) for k in range(52)}


@pytest.mark.parametrize("one_task", [0, 200_000])
def test_greedy_is_the_serial_choice_at_any_size(spark, monkeypatch, one_task):
    monkeypatch.setattr(R, "ONE_TASK_EDGES", one_task)
    rng = random.Random(6)
    listed = {(0, 100): 0, (1, 100): 0, (1, 101): 1, (2, 101): 0} | {(rng.randint(10, 30), rng.randint(200, 222)): rng.randint(0, 3) for _ in range(120)}
    edges = spark.createDataFrame([(a, b, w) for (a, b), w in listed.items()], "a long, b long, w int")
    free, want = {b for _, b in listed}, set()
    for a in sorted({a for a, _ in listed}):
        fits = [(w, b) for (x, b), w in listed.items() if x == a and b in free]
        if fits:
            want.add((a, min(fits)[1]))
            free.discard(min(fits)[1])
    assert {(r.a, r.b) for r in R._greedy(edges).collect()} == want and {(0, 100), (1, 101)} <= want


def test_first_combination_is_that_of_trying_all():
    from itertools import combinations

    rng = random.Random(8)
    for _ in range(300):
        values = [rng.randint(-5, 40) for _ in range(rng.randint(0, 9))]
        target, slack = rng.randint(0, 90), rng.randint(0, 2)
        want = next((c for k in range(2, 6) for c in combinations(range(len(values)), k) if abs(sum(values[i] for i in c) - target) <= slack), None)
        assert R.first_combination(values, target, slack, 5) == want


def test_large_groups_are_searched_where_asked_for(spark):
    a = table(spark, ["party", "amount"], [["X", "10000000.50"]])
    b = table(spark, ["party", "amount"], [["x", str(2**k)] for k in range(3, 24)] * 4 + [["x", "9999990.25"], ["x", "10.25"]])
    kinds = lambda most: [(r.kind, r.a_ids, r.b_ids) for r in R.propose_aggregations(a, b, "party", "party", R.Options(), candidates=most).collect()]
    assert kinds(60) == [("too_many", [], [])] and kinds(None) == [("one_to_many", [0], [84, 85])]


def test_accepting_group_ties_through_a_plan(spark, tmp_path, monkeypatch):
    base = str(tmp_path)
    (tmp_path / "a.csv").write_text("ref,party,amount\nr1,X,100\nr2,Q,300\nr3,Y,50\n")
    (tmp_path / "b.csv").write_text("ref,party,amount\nr1,X,100\nq1,q,100\nq2,q,200\ny1,y,20\ny2,y,30\n")
    plan = {"version": 1, "skill": "reconcile", "inputs": ["a.csv", "b.csv"], "options": {"mode": "key", "key": "ref"}, "aggregate": {"group": "party"}, "output": "w.xlsx", "approval": {"confirmed": True}}
    first = runtime.run_plan(spark, plan, base)
    assert first["status"] == "ok", first
    proposals = first["result"]["proposals"]
    assert [(p["kind"], p["grp"], len(p["a_ids"]), len(p["b_ids"])) for p in proposals] == [("group", "q", 1, 2), ("group", "y", 1, 2)]
    chosen = plan | {"aggregate": {"group": "party", "accepted": [0]}}
    monkeypatch.setenv("LEDGERLOOM_APPROVAL_KEY", "secret")
    assert "signed approval" in runtime.run_plan(spark, chosen, base)["errors"][0]["error"]
    receipt = runtime.sign(runtime.approval_request(spark, chosen, base), "secret", "me")
    other = plan | {"aggregate": {"group": "party", "accepted": [1]}, "approval": {"confirmed": True, "receipt": receipt}}
    assert "signed approval" in runtime.run_plan(spark, other, base)["errors"][0]["error"]
    twice = runtime.run_plan(spark, plan | {"aggregate": {"group": "party", "accepted": [0, 0]}}, base)
    assert twice["errors"][0]["pointer"] == "/aggregate/accepted"
    done = runtime.run_plan(spark, chosen | {"approval": {"confirmed": True, "receipt": receipt}}, base)
    assert done["status"] == "ok" and done["result"]["moved_items"] == 3
    s = done["result"]["summary"]
    assert s["matched"] == 1 and {k: v["n"] for k, v in s["by_category"].items()} == {"missing_in_B": 1, "missing_in_A": 2}


def test_aggregation_proposals(spark):
    a = table(spark, ["party", "amount"], [["X", "300"], ["Y", "50"], ["Z", "70"]])
    b = table(spark, ["party", "amount"], [["x", "100"], ["x", "200"], ["y", "20"], ["y", "30"], ["y", "99"]])
    got = {(r.kind, r.grp, tuple(r.a_ids), tuple(r.b_ids)) for r in R.propose_aggregations(a, b, "party", "party", R.Options()).collect()}
    assert got == {("group", "x", (0,), (0, 1)), ("one_to_many", "y", (1,), (2, 3))}
    o = R.Options(mode="key", key="party")
    chosen = spark.createDataFrame([([2], [4])], "a_ids array<long>, b_ids array<long>")
    after = R.apply_aggregations(R.match(a.where("party = 'Z'"), b.where("amount = '99'"), o), chosen)
    assert {r.bucket for r in after.collect()} == {"matched_agg"}


def test_extract_fields(spark):
    text = "Investor: Acme LP\nCommitment ....... S$ 2.5m\nClose date\n\n13 Jun 2026\nBank  DBS\n"
    docs = spark.createDataFrame([("a.txt", text), ("b.txt", "nothing")], "path string, text string")
    got = E.extract_fields(docs, [{"name": "Investor", "required": True}, {"name": "Commitment", "type": "currency"}, {"name": "Close date", "type": "date"}, {"name": "Bank"}])
    r = got.df.where("path = 'a.txt'").first()
    assert (r.Investor, r.Commitment, r["Commitment Currency"], r["Close date"], r.Bank) == ("Acme LP", Decimal(2500000), "SGD", dt.date(2026, 6, 13), "DBS")
    assert {x.path for x in got.extra["flags"].collect()} == {"b.txt"}


def test_readers_and_sinks(spark, tmp_path):
    p = tmp_path / "messy.csv"
    p.write_text('﻿Report of June\n\nRef;Date;Amount\n1;01/02/2026;"1;5"\n2;02/02/2026;7\n', encoding="utf-8")
    df = readers.read_csv(spark, str(p))
    assert df.columns == [RID, "Ref", "Date", "Amount"] and [r.Amount for r in df.orderBy(RID).collect()] == ["1;5", "7"]
    x = tmp_path / "t.xlsx"
    sinks.write_xlsx(df, str(x))
    back = readers.read_any(spark, str(x))
    assert [tuple(r)[1:] for r in back.orderBy(RID).collect()] == [tuple(r)[1:] for r in df.orderBy(RID).collect()]
    sinks.write_workbook({"a": (["h", "i"], [["1", "2"]]), "b": (["h", "i"], [["3", "4"]])}, str(x))
    with pytest.raises(readers.SheetSelectionRequired):
        readers.read_xlsx(spark, str(x))
    assert readers.read_xlsx(spark, str(x), "b").first().h == "3"
    j = tmp_path / "r.json"
    j.write_text(json.dumps({"meta": 1, "items": [{"a": {"b": 1}}, {"a": {"b": 2}}]}))
    assert [r.a.b for r in readers.read_json(spark, str(j)).orderBy(RID).collect()] == [1, 2]
    assert readers.markdown_rows("| a | b |\n|---|---|\n| 1 \\| 2 | 3 |\n| 4 |") == [["a", "b"], ["1 | 2", "3"], ["4", ""]]
    assert readers.paste_rows("Name  Age\nAnn   5") == [["Name", "Age"], ["Ann", "5"]]
    w = sinks.fixed_width(table(spark, ["a", "n"], [["ABCDE", "12.50"]]), [{"name": "a", "width": 4}, {"name": "n", "width": 8, "align": "r", "pad": "0"}])
    assert w.first().value == "ABCD00012.50"
    files = sinks.write_output(df, {"format": "csv", "split_by": "Ref"}, str(tmp_path / "out.csv"))
    assert len(files) == 2


def test_wide_rows_and_late_fields_are_read(spark, tmp_path):
    (tmp_path / "w.csv").write_text("a,b\n" + "1,2\n" * 300 + '3,4,LOST\n5,"x\ny",6,7\n8\n')
    got = readers.read_csv(spark, str(tmp_path / "w.csv")).drop(RID).collect()
    assert len(got) == 303 and len(got[0]) == 4
    assert [tuple(r) for r in got[-3:]] == [("3", "4", "LOST", None), ("5", "x\ny", "6", "7"), ("8", None, None, None)]
    (tmp_path / "late.json").write_text(json.dumps([{"a": i} for i in range(1500)] + [{"a": 1, "late": {"x": 2}}]))
    got = readers.read_json(spark, str(tmp_path / "late.json"))
    assert got.count() == 1501 and got.where("late IS NOT NULL").select("late.x").first()[0] == 2
    (tmp_path / "none.json").write_text("[]")
    assert readers.read_json(spark, str(tmp_path / "none.json")).count() == 0


def test_headers_by_strength():
    rows = [["Report", None, None], ["1/2/2025", "12", "0.0"], ["Name", "Amount", "Day"], ["Ann", "5", "1/2/2025"]]
    assert readers.detect_header(rows) == 2 and readers.detect_header([]) == 0 and readers.detect_header([["x"], [None]]) == 0
    assert readers.detect_header([["a", "b"], ["c", "d"]]) == 0


def office(path, parts):
    import zipfile

    with zipfile.ZipFile(path, "w") as z:
        for name, text in parts.items():
            z.writestr(name, text)


def test_tables_of_word_documents_and_slides(spark, tmp_path):
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    cell = lambda t, more="": f"<w:tc>{more}<w:p><w:r><w:t>{t}</w:t></w:r></w:p></w:tc>"
    row = lambda *c: f"<w:tr>{''.join(c)}</w:tr>"
    wide = '<w:tcPr><w:gridSpan w:val="2"/></w:tcPr>'
    body = f"<w:p><w:r><w:t>intro</w:t></w:r></w:p><w:tbl>{row(cell('Name'), cell('Paid'))}{row(cell('Ann'), cell('5'))}</w:tbl><w:tbl>{row(cell('both', wide))}</w:tbl>"
    office(tmp_path / "d.docx", {"word/document.xml": f"<w:document {w}><w:body>{body}</w:body></w:document>"})
    assert [tuple(r) for r in readers.read_any(spark, str(tmp_path / "d.docx")).drop(RID).collect()] == [("Ann", "5"), ("both", "both")]
    a = 'xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main" xmlns:p="http://schemas.openxmlformats.org/presentationml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
    par = lambda t: f"<a:p><a:r><a:t>{t}</a:t></a:r></a:p>"
    line = lambda *c: "<a:tr>" + "".join(f"<a:tc><a:txBody>{par(x)}</a:txBody></a:tc>" for x in c) + "</a:tr>"
    slide = f"<p:sld {a}><p:sp>{par('Title')}</p:sp><a:tbl>{line('Item', 'Cost')}{line('Desk', '90')}</a:tbl></p:sld>"
    rels = '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">' + "".join(f'<Relationship Id="r{i}" Target="slides/s{i}.xml"/>' for i in (1, 2)) + "</Relationships>"
    show = f'<p:presentation {a}><p:sldIdLst><p:sldId id="256" r:id="r2"/><p:sldId id="257" r:id="r1"/></p:sldIdLst></p:presentation>'
    office(tmp_path / "s.pptx", {"ppt/presentation.xml": show, "ppt/_rels/presentation.xml.rels": rels, "ppt/slides/s1.xml": slide, "ppt/slides/s2.xml": f"<p:sld {a}/>"})
    assert [tuple(r) for r in readers.read_any(spark, str(tmp_path / "s.pptx")).drop(RID).collect()] == [("Desk", "90")]
    slides = readers.pptx_slides((tmp_path / "s.pptx").read_bytes())
    assert [(s["slide"], len(s["tables"]), s["text"]) for s in slides] == [(1, 0, ""), (2, 1, "Title")]


def test_filters_with_code_generation(spark):
    """With code generation on a filter's report tells the same."""
    df = table(spark, ["v", "d"], [["1,200", "05/01/2025"], ["£30", "junk"], ["x", "2025-03-01"], ["", None], ["1200", "06/01/2025"]])
    filters = [{"column": "v", "op": ">=", "value": "1,000"}, {"column": "d", "op": "<", "value": "2025-02-01"}]
    plain = (L.filter_rows(df, filters).coverage(), L.filter_rows(df, filters).df.count())
    names = {"spark.sql.codegen.wholeStage": "true", "spark.sql.codegen.factoryMode": "FALLBACK"}
    before = {k: spark.conf.get(k) for k in names}
    try:
        for k, v in names.items():
            spark.conf.set(k, v)
        assert (L.filter_rows(df, filters).coverage(), L.filter_rows(df, filters).df.count()) == plain
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert plain[1] == 2 and plain[0]["incomparable_0"] == 2


def test_html():
    text = V.page("T & Co", [V.bar("b", ["x", "y"], [1, -2]), V.line("l", ["a", "b"], {"s": [1, None]}), V.donut("d", ["x"], [1]), V.heatmap("h", [("r", "c", 1), ("r", "d", None)]), V.waterfall("w", [("s", 5, "start"), ("d", -2, "delta")]), V.stacked("s", [("a", "x", 1), ("a", "y", -1)]), V.table([{"a": "<b>"}]), V.scatter("p", [(1, 2), (2, 3)], (1, 1)), V.sparkline("k", [1, 2])])
    assert "&lt;b&gt;" in text and "T &amp; Co" in text and text.count("<svg") == 8 and "http" not in text


def plan_file(tmp_path):
    (tmp_path / "sales.csv").write_text("Date,Customer,Amount\n01/01/2025,A,10\n01/02/2025,B,30\n05/02/2025,A,20\n")
    return {"version": 1, "skill": "analyse", "inputs": ["sales.csv"], "operations": [{"op": "breakdown", "by": "Customer", "value": "Amount"}, {"op": "filter_rows", "filters": [{"column": "Customer", "op": "==", "value": "A"}]}, {"op": "numeric_summary", "value": "Amount"}]}


def test_plans(spark, tmp_path, monkeypatch):
    plan, base = plan_file(tmp_path), str(tmp_path)
    assert runtime.validate_plan(spark, plan, base) == []
    assert runtime.run_plan(spark, plan, base)["status"] == "needs_approval"
    dry = runtime.run_plan(spark, plan, base, dry=True)
    assert dry["status"] == "dry_run" and not (tmp_path / "analysis.json").exists()
    done = runtime.run_plan(spark, plan | {"approval": {"confirmed": True}}, base)
    assert done["status"] == "ok" and done["result"]["results"][2]["rows"][0]["n"] == 2 and (tmp_path / "analysis.json").exists()
    bad = runtime.validate_plan(None, {"version": 1, "skill": "analyse", "inputs": ["x"], "operations": [{"op": "nope"}]})
    assert bad[0]["pointer"] == "/operations/0/op"
    (tmp_path / "bank.csv").write_text("Date,amount\n01/01/2025,10\n01/02/2025,30\n")
    rec = {"version": 1, "skill": "reconcile", "inputs": ["sales.csv", "bank.csv"], "options": {"mode": "amount_date", "amount": "Amount", "date": "Date"}, "approval": {"confirmed": True}}
    got = runtime.run_plan(spark, rec, base)
    assert got["status"] == "ok" and got["result"]["summary"]["matched"] == 2 and (tmp_path / "workpaper.xlsx").exists()
    conv = {"version": 1, "skill": "convert", "inputs": ["sales.csv"], "approval": {"confirmed": True}, "spec": {"map": [{"target": "Who", "source": "Customer"}, {"target": "Sum", "source": "Amount", "type": "number", "dp": 2}], "fingerprint": {"columns": ["Date", "Customer", "Amount", "Old"]}}}
    assert "signed approval" in runtime.run_plan(spark, conv, base)["errors"][0]["error"]
    monkeypatch.setenv("LEDGERLOOM_APPROVAL_KEY", "k")
    receipt = runtime.sign(runtime.approval_request(spark, conv, base), "k", "me")
    ok = runtime.run_plan(spark, conv | {"approval": {"confirmed": True, "receipt": receipt}}, base)
    assert ok["status"] == "ok" and (tmp_path / "converted.csv").read_text().splitlines()[1] == "A,10.00"
    assert not runtime.verified(receipt | {"approver": "you"}, receipt["request"], "k")
    tidy = {"version": 1, "skill": "tidy", "inputs": ["sales.csv"], "approval": {"confirmed": True}, "recipe": {"columns": [{"name": "Amount", "source": "Amount", "type": "number"}]}}
    assert runtime.run_plan(spark, tidy, base)["status"] == "ok" and (tmp_path / "tidy.xlsx").exists()
    vis = {"version": 1, "skill": "visualise", "inputs": ["sales.csv"], "analysis": "analysis.json", "blocks": [{"type": "bar", "result": 0, "x": "key", "y": "total"}], "approval": {"confirmed": True}}
    assert runtime.run_plan(spark, vis, base)["status"] == "ok" and "<svg" in (tmp_path / "dashboard.html").read_text()


def test_streaming_breakdown(spark, tmp_path):
    df = spark.createDataFrame([(dt.datetime(2024, 1, 1, 5), "a", 1.0), (dt.datetime(2024, 1, 1, 7), "a", 2.0), (dt.datetime(2024, 1, 2, 1), "b", 5.0)], "ts timestamp, kind string, value double")
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    q = windowed_breakdown(stream, "ts", "kind", "value").writeStream.format("memory").queryName("w").outputMode("complete").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert {(r.key, r["count"], float(r.total)) for r in spark.table("w").collect()} == {("a", 2, 3.0), ("b", 1, 5.0)}


def test_entry_works_without_the_corpus_operators(tmp_path):
    import os
    import shutil
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    shutil.copytree(os.path.join(root, "ledgerloom"), tmp_path / "ledgerloom", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(os.path.join(root, "__spark_entry__.py"), tmp_path)
    code = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert len(q) > 40 and set(o) <= set(q) and not any(n.startswith('op') for n in q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"}, check=True, timeout=60)
