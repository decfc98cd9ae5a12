"""Descriptive analytics: summaries, breakdowns, concentration, periods, ageing, cohorts, pivots, series.

Cells may be messy text or typed columns; text goes through the shared parsers. Every operator aggregates
before it orders anything: windows run over groups or periods, never over raw rows, so their single
partition holds as many rows as there are groups. Exact order statistics of raw rows use a range-partitioned
rank (``ranked``), not a window over one partition.
"""

from __future__ import annotations

from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import amounts as A
from ..functions import parsing as P
from ..session import checkpointed
from .common import RID, Result, find, q, with_rid
from .filters import _typed

SHARE = "decimal(38,18)"


def amount_of(df: DataFrame, name: str) -> Column:
    """The amounts of a column: parsed if it is text."""
    dtype = dict(df.dtypes)[name]
    return q(name).cast(P.AMOUNT) if _typed(dtype) == "number" else P.amount(q(name))


def date_of(df: DataFrame, name: str, dayfirst: bool = True) -> Column:
    dtype = dict(df.dtypes)[name]
    return q(name).cast("date") if _typed(dtype) == "date" else P.day(q(name), dayfirst)


def filled(df: DataFrame, name: str) -> Column:
    """Whether a cell holds anything."""
    return ~P.blank(q(name))


def ranked(df: DataFrame, order: str) -> DataFrame:
    """df of one column ``order`` (no nulls) with ``pos`` from 0, without sorting everything in one task.

    Values are counted, so ties cost one row; counts are then range-partitioned and the offset of each partition
    follows from the sums of those before it (one row a partition). The counts are kept: read again, the range
    could be cut elsewhere.
    """
    counts = df.groupBy(order).agg(F.count("*").alias("times")).repartitionByRange(order).sortWithinPartitions(order)
    counts = checkpointed(counts.withColumn("part", F.spark_partition_id()))
    sums = counts.groupBy("part").agg(F.sum("times").alias("s"), F.min(order).alias("low"))
    before = sums.select("part", (F.sum("s").over(Window.orderBy("low")) - F.col("s")).alias("before"))
    inside = F.sum("times").over(Window.partitionBy("part").orderBy(order)) - F.col("times")
    return counts.withColumn("inside", inside).join(F.broadcast(before), "part").select(order, "times", (F.col("before") + F.col("inside")).alias("pos"))


def _at(values: DataFrame, order: str, places: dict[str, Column]) -> list[Column]:
    """Aggregates that pick the values at given places (columns of the joined counts)."""
    hit = lambda p: (F.col("pos") <= p) & (p < F.col("pos") + F.col("times"))
    return [F.max(F.when(hit(p), F.col(order))).alias(k) for k, p in places.items()]


def numeric_summary(df: DataFrame, value: str) -> DataFrame:
    """One row: n, missing, skipped, total, mean, min, p25, median, p75, max, negatives. Quartiles are medians of halves."""
    name = find(df, value)
    rows = df.select(amount_of(df, name).alias("v"), filled(df, name).alias("f"))
    base = rows.agg(F.count("v").alias("n"), F.count_if(~F.col("f")).alias("missing"), F.count_if(F.col("f") & F.col("v").isNull()).alias("skipped"), F.sum("v").alias("total"), F.min("v").alias("min"), F.max("v").alias("max"), F.count_if(F.col("v") < 0).alias("negatives"))
    n = F.col("n")
    half = F.floor(n / 2)
    middle = lambda start, size: (start + F.floor((size - 1) / 2), start + F.floor(size / 2))
    lo, hi = middle(F.lit(0), half), middle(n - half, half)
    med = middle(F.lit(0), n)
    pos = ranked(rows.where(F.col("v").isNotNull()).select("v"), "v").crossJoin(F.broadcast(base.select("n")))
    picked = pos.agg(*_at(pos, "v", {"l0": lo[0], "l1": lo[1], "m0": med[0], "m1": med[1], "h0": hi[0], "h1": hi[1]}))
    mid = lambda a, b: ((F.col(a) + F.col(b)) / 2).cast(P.AMOUNT)
    one = n == 1
    out = base.crossJoin(F.broadcast(picked))
    return out.select("n", "missing", "skipped", "total", F.try_divide(F.col("total"), n).cast(P.AMOUNT).alias("mean"), "min", F.when(one, F.col("min")).otherwise(mid("l0", "l1")).alias("p25"), mid("m0", "m1").alias("median"), F.when(one, F.col("max")).otherwise(mid("h0", "h1")).alias("p75"), "max", "negatives")


def outliers_iqr(df: DataFrame, value: str, k: float = 1.5, cap: int = 10, binary: bool = False) -> Result:
    """Values beyond Tukey's fences, at most ``cap`` a side (lowest and highest first); the report has fences and exact counts.
    With ``binary``, fences are doubles as SQL computes them: one may lie a last bit off, beside the values equal to it."""
    name = find(df, value)
    s = numeric_summary(df, value)
    kind = "double" if binary else P.AMOUNT
    p25, p75 = (F.col(c).cast(kind) for c in ("p25", "p75"))
    iqr = p75 - p25
    fences = s.select("n", F.when(F.col("n") >= 4, p25 - iqr * k).cast(kind).alias("lower_fence"), F.when(F.col("n") >= 4, p75 + iqr * k).cast(kind).alias("upper_fence"))
    v = df.select(amount_of(df, name).alias("value")).where(F.col("value").isNotNull()).crossJoin(F.broadcast(fences))
    side = F.when(F.col("value") < F.col("lower_fence"), "low").when(F.col("value") > F.col("upper_fence"), "high")
    out = v.select("value", side.alias("side")).where(F.col("side").isNotNull())
    lists = out.where("side = 'low'").orderBy("value").limit(cap).unionByName(out.where("side = 'high'").orderBy(F.desc("value")).limit(cap))
    counts = out.agg(F.count_if(F.col("side") == "low").alias("low_count"), F.count_if(F.col("side") == "high").alias("high_count"))
    return Result(lists.select("side", "value"), fences.crossJoin(counts))


def group_totals(df: DataFrame, by: str, value: str | None = None) -> DataFrame:
    """key, count, total, skipped, first_rid of every group; blanks group as (blank)."""
    df, key = with_rid(df), find(df, by)
    label = F.when(P.blank(q(key)), "(blank)").otherwise(P.text(q(key))).alias("key")
    if value is None:
        return df.select(label, RID).groupBy("key").agg(F.count("*").alias("count"), F.lit(None).cast("decimal(38,6)").alias("total"), F.lit(0).cast("long").alias("skipped"), F.min(RID).alias("first_rid"))
    name = find(df, value)
    rows = df.select(label, RID, amount_of(df, name).alias("v"), filled(df, name).alias("f"))
    return rows.groupBy("key").agg(F.count("*").alias("count"), F.coalesce(F.sum("v"), F.lit(0)).cast("decimal(38,6)").alias("total"), F.count_if(F.col("f") & F.col("v").isNull()).alias("skipped"), F.min(RID).alias("first_rid"))


def breakdown(df: DataFrame, by: str, value: str | None = None, top: int | None = 10) -> Result:
    """key, count, total, share, cum_share, rank, largest first, ties by first appearance. Shares are null where a group is
    negative or nothing is left to share; the report has top1_share, top3_share and groups_to_80pct."""
    groups = group_totals(df, by, value).withColumn("m", F.coalesce(F.col("total"), F.col("count").cast("decimal(38,6)")))
    every = Window.partitionBy()
    valid = (F.sum("m").over(every) > 0) & (F.min("m").over(every) >= 0)
    order = Window.orderBy(F.desc("m"), "first_rid")
    share = F.when(valid, F.try_divide(F.col("m").cast("double"), F.sum("m").over(every).cast("double")))
    out = groups.select("key", "count", "total", "skipped", share.alias("share"), F.row_number().over(order).alias("rank"), "m", "first_rid")
    exact = F.sum("m").over(order.rowsBetween(Window.unboundedPreceding, 0))
    out = out.withColumn("cum_share", F.when(F.col("share").isNotNull(), F.try_divide(exact.cast("double"), F.sum("m").over(every).cast("double"))))
    to80 = F.min(F.when(F.col("cum_share") >= 0.8, F.col("rank")))
    report = out.agg(F.count("*").alias("n_groups"), F.sum("m").alias("grand_total"), F.max(F.when(F.col("rank") == 1, F.col("share"))).alias("top1_share"), F.sum(F.when(F.col("rank") <= 3, F.col("share"))).alias("top3_share"), to80.alias("groups_to_80pct"), F.sum("skipped").alias("skipped"), (F.count_if(F.col("m") < 0) > 0).alias("has_negatives"))
    cut = out if top is None else out.where(F.col("rank") <= top)
    return Result(cut.select("key", "count", "total", "share", "cum_share", "rank").orderBy("rank"), report)


def concentration(groups: DataFrame, value: str = "total", top_n: int = 4) -> DataFrame:
    """One row for a frame of group totals: n, hhi (0 to 10000), top_n_share, groups_to_80, classification."""
    v = groups.select(q(value).cast("double").alias("v")).where(F.col("v").isNotNull())
    every, order = Window.partitionBy(), Window.orderBy(F.desc("v"))
    shares = v.select("v", F.try_divide(F.col("v"), F.sum("v").over(every)).alias("s"), F.row_number().over(order).alias("rank"), F.try_divide(F.sum("v").over(order.rowsBetween(Window.unboundedPreceding, 0)), F.sum("v").over(every)).alias("cum"))
    one = shares.agg(F.count("*").alias("n"), F.count_if(F.col("v") < 0).alias("bad"), F.sum("v").alias("total"), F.sum((F.col("s") * 100) ** 2).alias("hhi"), F.sum(F.when(F.col("rank") <= top_n, F.col("s"))).alias("top_n_share"), F.min(F.when(F.col("cum") >= 0.8, F.col("rank"))).alias("groups_to_80"))
    good = (F.col("n") > 0) & (F.col("bad") == 0) & (F.col("total") != 0)
    label = F.when(F.col("n") == 0, "no data").when(F.col("bad") > 0, "unreliable (negatives present)").when(F.col("total") == 0, "unreliable (total is zero)").when(F.col("hhi") < 1500, "fragmented").when(F.col("hhi") < 2500, "moderate").when(F.col("hhi") < 5000, "concentrated").otherwise("highly concentrated")
    return one.select("n", *(F.when(good, F.col(c)).alias(c) for c in ("hhi", "top_n_share", "groups_to_80")), label.alias("classification"))


def gini(df: DataFrame, value: str) -> DataFrame:
    """One row: n, gini (4 places), classification. Ranks come from counted values, so no single task sorts the rows."""
    name = find(df, value)
    v = df.select(amount_of(df, name).alias("v")).where(F.col("v").isNotNull())
    pos = ranked(v, "v")
    # ranks pos+1 ... pos+times add up to times * (2 pos + times + 1) / 2
    ranks = F.col("times").cast("double") * (2 * F.col("pos") + F.col("times") + 1) / 2
    one = pos.agg(F.sum("times").alias("n"), F.min("v").alias("low"), F.sum(F.col("v").cast("double") * F.col("times")).alias("total"), F.sum(F.col("v").cast("double") * ranks).alias("weighted"))
    one = one.withColumn("n", F.coalesce("n", F.lit(0)))
    n = F.col("n")
    good = (n >= 2) & (F.col("low") >= 0) & (F.col("total") != 0)
    g = F.round(F.when(good, F.try_divide(2 * F.col("weighted"), n * F.col("total")) - F.try_divide(n + 1, n)), 4)
    label = F.when(n < 2, "insufficient data (need ≥2 values)").when(F.col("low") < 0, "unreliable (negatives present)").when(F.col("total") == 0, "unreliable (total is zero)").when(g < 0.25, "relatively equal").when(g < 0.45, "moderate inequality").when(g < 0.6, "high inequality").otherwise("extreme inequality")
    return one.select("n", g.alias("gini"), label.alias("classification"))


def distribution(df: DataFrame, value: str, by: str | None = None) -> DataFrame:
    """n, skewness, kurtosis (both of samples, 3 places), classification, of all rows or by group."""
    name = find(df, value)
    keys = [q(find(df, by)).alias("key")] if by else []
    rows = df.select(*keys, amount_of(df, name).cast("double").alias("v"))
    one = rows.groupBy(*(["key"] if by else [])).agg(F.count("v").alias("n"), F.skewness("v").alias("g"), F.kurtosis("v").alias("k"), F.stddev_samp("v").alias("sd"))
    n = F.col("n").cast("double")
    enough = (n >= 4) & (F.coalesce("sd", F.lit(0.0)) > 0)
    skew = F.when(enough, F.col("g") * F.sqrt(F.when(enough, n * (n - 1))) / F.when(enough, n - 2))
    kurt = F.when(enough, ((n + 1) * F.col("k") + 6) * F.when(enough, n - 1) / F.when(enough, (n - 2) * (n - 3)))
    out = one.select(*(["key"] if by else []), "n", "sd", F.round(skew, 3).alias("skewness"), F.round(kurt, 3).alias("kurtosis"), skew.alias("s"), kurt.alias("t"))
    size = F.abs(F.col("s"))
    label = F.when(F.col("n") < 4, "insufficient data (need ≥4 values)").when(F.coalesce("sd", F.lit(0.0)) == 0, "constant (no spread)").when(F.col("t") > 3, "heavy-tailed").when(size >= 1, "highly skewed").when(size >= 0.5, "moderately skewed").otherwise("symmetric")
    return out.select(*(["key"] if by else []), "n", "skewness", "kurtosis", label.alias("classification"))


def percentile(df: DataFrame, value: str, quantiles: list[float], by: str | None = None) -> DataFrame:
    """(key,) q, value: exact quantiles with linear interpolation."""
    if any(not 0 <= x <= 1 for x in quantiles):
        raise ValueError("quantiles lie between 0 and 1")
    name = find(df, value)
    keys = [q(find(df, by)).alias("key")] if by else []
    rows = df.select(*keys, amount_of(df, name).cast("double").alias("v"))
    got = rows.groupBy(*(["key"] if by else [])).agg(F.percentile("v", F.array(*(F.lit(float(x)) for x in quantiles))).alias("p"))
    return got.select(*(["key"] if by else []), F.posexplode(F.arrays_zip(F.array(*(F.lit(float(x)) for x in quantiles)).alias("q"), F.col("p").alias("value"))).alias("i", "z")).select(*(["key"] if by else []), "z.q", "z.value")


def pearson(x: Column, y: Column) -> Column:
    """Correlation of pairs, 3 places; null under three pairs or where a side is constant."""
    both = x.isNotNull() & y.isNotNull()
    a, b = (F.when(both, c.cast("double")) for c in (x, y))
    r = F.try_divide(F.covar_samp(a, b), F.stddev_samp(a) * F.stddev_samp(b))
    return F.when(F.count_if(both) >= 3, F.round(r, 3) + 0.0)


def correlation_matrix(df: DataFrame, columns: list[str]) -> DataFrame:
    """row, col, r of all pairs in one aggregation; the diagonal is 1."""
    names = [find(df, c) for c in columns]
    v = df.select(*(amount_of(df, c).cast("double").alias(f"c{i}") for i, c in enumerate(names)))
    pairs = [(i, j) for i in range(len(names)) for j in range(i + 1, len(names))]
    one = v.agg(*(pearson(F.col(f"c{i}"), F.col(f"c{j}")).alias(f"r{i}_{j}") for i, j in pairs), F.lit(1.0).alias("one"))
    cells = []
    for i, a in enumerate(names):
        for j, b in enumerate(names):
            r = F.col("one") if i == j else F.col(f"r{min(i, j)}_{max(i, j)}")
            cells.append(F.struct(F.lit(a).alias("row"), F.lit(b).alias("col"), r.alias("r")))
    return one.select(F.inline(F.array(*cells)))


def _by_period(df: DataFrame, date_col: str, value: str | None, grain: str, dayfirst: bool) -> tuple[DataFrame, DataFrame]:
    """(start, count, total of each period that has rows; report of bad dates and skipped values)."""
    name, val = find(df, date_col), find(df, value) if value else None
    v = amount_of(df, val) if val else F.lit(None).cast(P.AMOUNT)
    rows = df.select(date_of(df, name, dayfirst).alias("d"), v.alias("v"), (filled(df, val) if val else F.lit(False)).alias("f"))
    report = rows.agg(F.count_if(F.col("d").isNull()).alias("bad_dates"), F.count_if(F.col("d").isNotNull() & F.col("f") & F.col("v").isNull()).alias("skipped"))
    good = rows.where(F.col("d").isNotNull()).groupBy(F.trunc("d", grain).alias("start"))
    return good.agg(F.count("*").alias("count"), F.coalesce(F.sum("v"), F.lit(0)).cast("decimal(38,6)").alias("total")), report


def period_series(df: DataFrame, date_col: str, value: str | None = None, grain: str = "month", dayfirst: bool = True, fill: str = "zero") -> Result:
    """period, count, total, delta, pct_change, yoy of every calendar period between the first and the last. Quiet periods are
    zero (null with fill='null'); yoy compares with the year before only where that had rows."""
    seen, report = _by_period(df, date_col, value, grain, dayfirst)
    step = A.months(grain)
    spine = seen.agg(F.min("start").alias("a"), F.max("start").alias("b")).where(F.col("a").isNotNull()).select(F.explode(F.sequence("a", "b", F.expr(f"make_interval(0, {step})"))).alias("start"))
    measure = "total" if value else "count"
    year_ago = seen.select(F.add_months("start", 12).alias("start"), F.col(measure).alias("base"))
    zero = F.lit(0) if fill == "zero" else F.lit(None)
    rows = spine.join(seen, "start", "left").join(year_ago, "start", "left").select("start", F.coalesce("count", zero).cast("long").alias("count"), F.coalesce("total", zero).cast("decimal(38,6)").alias("total"), "base", F.col("count").isNull().alias("gap"))
    before = F.lag(measure).over(Window.orderBy("start"))
    m = F.col(measure).cast("double")
    change = lambda x: F.try_divide(m - x.cast("double"), F.when(x != 0, x.cast("double")))
    out = rows.select(A.period_key(F.col("start"), grain).alias("period"), "count", *(["total"] if value else []), (F.col(measure) - before).alias("delta"), change(before).alias("pct_change"), change(F.col("base")).alias("yoy"), "gap", "start")
    key = F.struct(F.col(measure), -F.datediff("start", F.lit("1970-01-01").cast("date")))
    low = F.struct(F.col(measure), F.col("start"))
    best = out.agg(F.max_by("period", key).alias("best"), F.min_by("period", low).alias("worst"), F.min("period").alias("first"), F.max("period").alias("last"), F.count_if("gap").alias("gap_periods"))
    return Result(out.drop("gap", "start").orderBy("period"), report.crossJoin(best))


def trend(series: DataFrame, key: str = "period", value: str = "total") -> DataFrame:
    """One row: n, slope per step, r_squared, classification of an ordered series."""
    at = series.select((F.row_number().over(Window.orderBy(key)) - 1).cast("double").alias("x"), q(value).cast("double").alias("y"))
    y = F.when(F.col("y").isNotNull(), F.col("x"))
    one = at.agg(F.count("y").alias("n"), F.regr_slope("y", "x").alias("slope"), F.var_pop("y").alias("vy"), F.var_pop(y).alias("vx"), F.covar_pop("x", "y").alias("cxy"))
    r2 = F.coalesce(F.try_divide(F.col("cxy") ** 2, F.when((F.col("vx") > 0) & (F.col("vy") > 0), F.col("vx") * F.col("vy"))), F.lit(0.0))
    enough = F.col("n") >= 3
    way = F.when(F.col("slope") > 0, "rising").otherwise("falling")
    label = F.when(~enough, "insufficient data (need ≥3 points)").when((F.abs("slope") < 1e-12) | (r2 < 0.25), "flat").when(r2 >= 0.5, way).otherwise(F.concat(F.lit("weakly "), way))
    return one.select("n", F.when(enough, F.round("slope", 6)).alias("slope"), F.when(enough, F.round(r2, 3)).alias("r_squared"), label.alias("classification"))


def rolling(series: DataFrame, key: str = "period", value: str = "total", window: int = 3, how: str = "mean") -> DataFrame:
    """key, value, rolling over the last ``window`` points, null for the first ones; nulls inside are skipped."""
    if how not in ("mean", "sum", "median") or window < 1:
        raise ValueError("rolling takes mean, sum or median over a window of at least 1")
    order = Window.orderBy(key)
    frame = order.rowsBetween(-(window - 1), 0)
    v = q(value).cast("double")
    if how == "median":
        got = F.array_sort(F.collect_list(v).over(frame))
        n = F.size(got)
        out = (F.get(got, F.floor((n - 1) / 2).cast("int")) + F.get(got, F.floor(n / 2).cast("int"))) / 2
    else:
        out = (F.avg if how == "mean" else F.sum)(v).over(frame)
    return series.select(q(key), q(value), F.when(F.row_number().over(order) >= window, out).alias("rolling"))


def compare_series(a: DataFrame, b: DataFrame, key: str = "period", value: str = "total") -> Result:
    """key, a, b, gap, ratio, pct_diff of shared keys in order; the report has correlations at lags 0 and 1 and one-sided counts."""
    x, y = (d.select(q(key).alias("key"), q(value).cast("double").alias(s)) for d, s in ((a, "a"), (b, "b")))
    both = x.withColumn("in_a", F.lit(True)).join(y.withColumn("in_b", F.lit(True)), "key", "full_outer")
    shared = both.where("in_a AND in_b").select("key", "a", "b", (F.col("a") - F.col("b")).alias("gap"), F.try_divide("a", F.when(F.col("b") != 0, F.col("b"))).alias("ratio"), F.try_divide(F.col("a") - F.col("b"), F.when(F.col("b") != 0, F.col("b"))).alias("pct_diff"))
    order = Window.orderBy("key")
    lagged = shared.select("a", "b", F.lag("a").over(order).alias("pa"), F.lag("b").over(order).alias("pb"))
    r = lagged.agg(F.count("*").alias("n"), pearson(F.col("a"), F.col("b")).alias("same"), pearson(F.col("a"), F.col("pb")).alias("b_leads_1"), pearson(F.col("pa"), F.col("b")).alias("a_leads_1"))
    size = lambda c: F.coalesce(F.abs(F.col(c)), F.lit(-1.0))
    best = F.when(F.greatest(size("same"), size("b_leads_1"), size("a_leads_1")) < 0, None).when((size("same") >= size("b_leads_1")) & (size("same") >= size("a_leads_1")), "same").when(size("b_leads_1") >= size("a_leads_1"), "b_leads_1").otherwise("a_leads_1")
    sides = both.agg(F.count_if(F.col("in_b").isNull()).alias("a_only"), F.count_if(F.col("in_a").isNull()).alias("b_only"))
    return Result(shared.orderBy("key"), r.withColumn("best_alignment", best).crossJoin(sides))


def ageing(df: DataFrame, date_col: str, as_of: str, buckets: tuple[int, ...] = (30, 60, 90), value: str | None = None, dayfirst: bool = True) -> DataFrame:
    """bucket, count, total by days from the date to as_of; empty buckets print, future and unparsed only if there are any."""
    name, val = find(df, date_col), find(df, value) if value else None
    lows = [0, *(b + 1 for b in buckets[:-1])]
    labels = [*(f"{a}–{b}" for a, b in zip(lows, buckets, strict=True)), f"{buckets[-1]}+"]
    days = F.datediff(P.day(F.lit(as_of)), date_of(df, name, dayfirst))
    place = F.when(days < 0, 0)
    for i, b in enumerate(buckets):
        place = place.when(days <= b, i + 1)
    place = F.when(days.isNull(), len(labels) + 1).otherwise(place.otherwise(len(labels)))
    v = amount_of(df, val) if val else F.lit(None).cast(P.AMOUNT)
    got = df.select(place.alias("place"), v.alias("v")).groupBy("place").agg(F.count("*").alias("count"), F.coalesce(F.sum("v"), F.lit(0)).cast("decimal(38,6)").alias("total"))
    names = ["future", *labels, "unparsed"]
    spine = df.sparkSession.range(len(names)).select(F.col("id").cast("int").alias("place"), F.get(F.array(*(F.lit(x) for x in names)), F.col("id").cast("int")).alias("bucket"))
    out = spine.join(F.broadcast(got), "place", "left").where(F.col("count").isNotNull() | ~F.col("bucket").isin("future", "unparsed"))
    return out.orderBy("place").select("bucket", F.coalesce("count", F.lit(0)).cast("long").alias("count"), *([F.coalesce("total", F.lit(0)).cast("decimal(38,6)").alias("total")] if value else []))


def cohort(df: DataFrame, id_col: str, date_col: str, value: str | None = None, grain: str = "month", dayfirst: bool = True) -> Result:
    """cohort, offset, entities, total, size, retention, in long form with all offsets up to the largest."""
    who, when = find(df, id_col), find(df, date_col)
    v = amount_of(df, find(df, value)) if value else F.lit(None).cast(P.AMOUNT)
    rows = df.select(P.text(q(who)).alias("id"), F.trunc(date_of(df, when, dayfirst), grain).alias("p"), v.alias("v")).where("id <> ''")
    active = rows.where(F.col("p").isNotNull()).groupBy("id", "p").agg(F.coalesce(F.sum("v"), F.lit(0)).cast("decimal(38,6)").alias("total"))
    first = active.withColumn("first", F.min("p").over(Window.partitionBy("id")))
    cells = first.groupBy("first", A.periods_between(F.col("first"), F.col("p"), grain).alias("offset")).agg(F.count("*").alias("entities"), F.sum("total").cast("decimal(38,6)").alias("total"))
    sizes = cells.groupBy("first").agg(F.max(F.when(F.col("offset") == 0, F.col("entities"))).alias("size"))
    most = cells.agg(F.max("offset").alias("most"))
    spine = sizes.crossJoin(F.broadcast(most)).select("first", "size", F.explode(F.sequence(F.lit(0), F.col("most"))).alias("offset"))
    out = spine.join(cells, ["first", "offset"], "left").select(A.period_key(F.col("first"), grain).alias("cohort"), "offset", F.coalesce("entities", F.lit(0)).cast("long").alias("entities"), *([F.coalesce("total", F.lit(0)).cast("decimal(38,6)").alias("total")] if value else []), "size")
    out = out.withColumn("retention", F.col("entities").cast("double") / F.col("size"))
    return Result(out.orderBy("cohort", "offset"), rows.agg(F.count_if(F.col("p").isNull()).alias("bad_dates")))


def pivot(df: DataFrame, rows: str, columns: str, value: str | None = None, how: str = "sum") -> DataFrame:
    """row, col, cell in long form, totals under null keys (of sums and counts; true means for mean), by grouping sets."""
    r, c = find(df, rows), find(df, columns)
    label = lambda n: F.when(P.blank(q(n)), "(blank)").otherwise(P.text(q(n)))
    v = amount_of(df, find(df, value)) if value else F.lit(None).cast(P.AMOUNT)
    agg = {"count": F.count("*").cast("double"), "sum": F.coalesce(F.sum("v"), F.lit(0)).cast("double"), "mean": F.avg("v").cast("double")}[how if value else "count"]
    return df.select(label(r).alias("row"), label(c).alias("col"), v.alias("v")).cube("row", "col").agg(agg.alias("cell")).orderBy(F.col("row").asc_nulls_last(), F.col("col").asc_nulls_last())


def seasonality(df: DataFrame, date_col: str, value: str | None = None, grain: str = "month", dayfirst: bool = True) -> DataFrame:
    """season, count, total, average, share, index, index_norm of every month or quarter of the year.

    average divides by the season's rows and index by the mean of the seasons' totals, as the reference figures do;
    index_norm divides the season's total by that mean, so that it centres on 1.
    """
    name, n = find(df, date_col), 12 if grain == "month" else 4
    d = date_of(df, name, dayfirst)
    v = amount_of(df, find(df, value)) if value else F.lit(None).cast(P.AMOUNT)
    part = F.month("d") if grain == "month" else F.quarter("d")
    seen = df.select(d.alias("d"), v.alias("v")).where(F.col("d").isNotNull()).groupBy(part.alias("season")).agg(F.count("*").alias("count"), F.coalesce(F.sum("v"), F.lit(0)).cast("double").alias("sum"))
    spine = df.sparkSession.range(1, n + 1).select(F.col("id").cast("int").alias("season"))
    out = spine.join(F.broadcast(seen), "season", "left").select("season", F.coalesce("count", F.lit(0)).cast("long").alias("count"), F.coalesce(F.col("sum") if value else F.col("count").cast("double"), F.lit(0.0)).alias("total"))
    every = Window.partitionBy()
    mean = F.try_divide(F.sum("total").over(every), F.count_if(F.col("count") > 0).over(every))
    average = F.coalesce(F.try_divide(F.col("total"), F.when(F.col("count") > 0, F.col("count"))), F.lit(0.0))
    nonzero = F.when(mean != 0, mean)
    return out.select("season", "count", "total", average.alias("average"), F.try_divide(F.col("total"), F.sum("total").over(every)).alias("share"), F.try_divide(average, nonzero).alias("index"), F.try_divide(F.col("total"), nonzero).alias("index_norm")).orderBy("season")


def currency_mix(df: DataFrame, value: str) -> DataFrame:
    """code, count of the currencies that a column's cells name."""
    return df.select(P.currency_code(q(find(df, value))).alias("code")).where(F.col("code").isNotNull()).groupBy("code").agg(F.count("*").alias("count")).orderBy("code")


def histogram(df: DataFrame, value: str, bins: int | list[float] = 10) -> Result:
    """bin, low, high, count: half-open bins but for the last; values outside and cells that aren't numbers are counted apart."""
    name = find(df, value)
    v = df.select(amount_of(df, name).cast("double").alias("v"), filled(df, name).alias("f"))
    if isinstance(bins, int):
        ends = v.agg(F.min("v").alias("a"), F.max("v").alias("b"))
        edges = ends.select(F.transform(F.sequence(F.lit(0), F.lit(bins)), lambda i: F.col("a") + (F.col("b") - F.col("a")) * i / bins).alias("e"))
    else:
        edges = df.sparkSession.range(1).select(F.array(*(F.lit(float(x)) for x in sorted(bins))).alias("e"))
    n = bins if isinstance(bins, int) else len(bins) - 1
    wide = v.crossJoin(F.broadcast(edges))
    below = F.size(F.filter("e", lambda x: x <= F.col("v")))
    place = F.when((F.col("v") >= F.get("e", F.lit(0))) & (F.col("v") <= F.get("e", F.lit(n))), F.least(below, F.lit(n)))
    counts = wide.select(place.alias("bin")).where(F.col("bin").isNotNull()).groupBy("bin").agg(F.count("*").alias("count"))
    spine = edges.select(F.explode(F.sequence(F.lit(1), F.lit(n))).alias("bin"), "e").select("bin", F.get("e", F.col("bin") - 1).alias("low"), F.get("e", F.col("bin")).alias("high"))
    report = wide.agg(F.count("v").alias("n"), F.count_if(F.col("v").isNotNull() & place.isNull()).alias("outside"), F.count_if(F.col("f") & F.col("v").isNull()).alias("not_numeric"))
    return Result(spine.join(F.broadcast(counts), "bin", "left").select("bin", "low", "high", F.coalesce("count", F.lit(0)).cast("long").alias("count")).orderBy("bin"), report)


def scatter_fit(df: DataFrame, x: str, y: str) -> DataFrame:
    """n, slope, intercept, r of a straight line through two columns."""
    a, b = (amount_of(df, find(df, c)).cast("double") for c in (x, y))
    v = df.select(a.alias("x"), b.alias("y")).where("x IS NOT NULL AND y IS NOT NULL")
    return v.agg(F.count("*").alias("n"), F.try_divide(F.covar_samp("x", "y"), F.var_samp("x")).alias("slope"), (F.avg("y") - F.try_divide(F.covar_samp("x", "y"), F.var_samp("x")) * F.avg("x")).alias("intercept"), pearson(F.col("x"), F.col("y")).alias("r"))


def bridge(steps: DataFrame, order: str, kind: str, value: str) -> DataFrame:
    """Running levels of a waterfall: start and total rows set the level, deltas move it. One row a step."""
    w = Window.orderBy(order)
    group = F.sum(F.when(q(kind).isin("start", "total"), 1).otherwise(0)).over(w)
    marked = steps.withColumn("_g", group)
    level = F.sum(q(value)).over(Window.partitionBy("_g").orderBy(order))
    return marked.withColumn("level", level).drop("_g")


def suggest(profile: list[dict[str, Any]]) -> dict[str, list[str]]:
    """Roles of columns from a profile: dates, measures, dimensions, ids (text of which nine tenths differ)."""
    out: dict[str, list[str]] = {"dates": [], "measures": [], "dimensions": [], "ids": []}
    for c in profile:
        if c["type"] == "date":
            out["dates"].append(c["column"])
        elif c["type"] in ("number", "currency"):
            out["measures"].append(c["column"])
        elif c["type"] == "text" and c["distinct"] >= 0.9 * max(1, c["n"] - c["missing"]):
            out["ids"].append(c["column"])
        elif c["type"] in ("categorical", "ordinal", "bool", "text"):
            out["dimensions"].append(c["column"])
    return out


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
