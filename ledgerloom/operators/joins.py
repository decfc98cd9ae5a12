"""Joins: typed keys with first-row lookup, as-of rates, reference lookups, membership, amount potential."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import parsing as P
from .analyse import amount_of
from .common import RID, Result, find, q, values, with_rid
from .filters import _typed

#: Rows up to which a lookup side is broadcast; beyond, both sides are shuffled.
BROADCAST_ROWS = 500_000


def small(df: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """df, marked for broadcast if it has few enough rows: at most ``most + 1`` of them are counted."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def typed_key(df: DataFrame, name: str) -> Column:
    """Numbers by value, dates by day, anything else as folded text."""
    c, known = q(name), _typed(dict(df.dtypes)[name])
    if known == "number":
        return F.concat(F.lit("n:"), c.cast("decimal(38,6)").cast("string"))
    if known == "date":
        return F.concat(F.lit("d:"), c.cast("date").cast("string"))
    kind = P.kind(c)
    return F.when(kind == "number", F.concat(F.lit("n:"), P.amount(c).cast("decimal(38,6)").cast("string"))).when(kind == "date", F.concat(F.lit("d:"), P.day(c).cast("string"))).otherwise(F.concat(F.lit("s:"), F.regexp_replace(F.lower(P.text(c)), r"\s+", " ")))


def _keyed(df: DataFrame, names: list[str], prefix: str) -> DataFrame:
    """df with a column of the typed key by name: one hash-partitionable string."""
    return df.withColumn(prefix, F.concat_ws("\u0001", *(typed_key(df, find(df, n)) for n in names)))


def join_on(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner") -> Result:
    """left with the first right row of each key. Clashing columns of the right get ``r_``; the report counts matched,
    left_only, right_only and right_dup_keys."""
    if how not in ("inner", "left"):
        raise ValueError("how is inner or left")
    a, b = _keyed(left, on, "_key"), _keyed(with_rid(right), on, "_rkey")
    keys = {find(right, n) for n in on}
    taken = {c.lower() for c in left.columns}
    cells = [q(c).alias(f"r_{c}" if c.lower() in taken else c) for c in values(right) if c not in keys]
    names = [f"r_{c}" if c.lower() in taken else c for c in values(right) if c not in keys]
    firsts = b.groupBy("_rkey").agg(F.min_by(F.struct(*cells, F.lit(1).alias("_in")), RID).alias("_first"), F.count("*").alias("_times"))
    met = a.join(firsts.select("_rkey", "_first"), a._key == firsts._rkey, how)
    out = met.select(*(q(c) for c in left.columns), *(F.col("_first").getField(n).alias(n) for n in names))
    lefts = a.groupBy("_key").agg(F.count("*").alias("n"))
    both = lefts.join(firsts.select("_rkey", "_times"), lefts._key == firsts._rkey, "full_outer")
    report = both.agg(F.coalesce(F.sum(F.when(F.col("_rkey").isNotNull(), F.col("n"))), F.lit(0)).alias("matched"), F.coalesce(F.sum(F.when(F.col("_rkey").isNull(), F.col("n"))), F.lit(0)).alias("left_only"), F.count_if(F.col("_key").isNull()).alias("right_only"), F.count_if(F.col("_times") > 1).alias("right_dup_keys"))
    return Result(out, report)


def asof_rate(df: DataFrame, day: Column, rates: DataFrame, as_of: str = "as_of", rate: str = "rate", into: str = "fx_rate") -> DataFrame:
    """df with the latest rate of or before its day, else the earliest. The rates (a pinned list) become one sorted array a
    row; a day that didn't parse gets none."""
    if rates.limit(100_001).count() > 100_000:
        raise ValueError("more than 100000 pinned rates; join them by currency and day instead")
    pinned = rates.select(q(as_of).cast("date").alias("d"), q(rate).cast("decimal(28,10)").alias("r")).agg(F.array_sort(F.collect_list(F.struct("d", "r"))).alias("_rates"))
    upto = F.filter("_rates", lambda x: x["d"] <= F.col("_day"))
    pick = F.when(F.size(upto) > 0, F.get(upto, F.size(upto) - 1)["r"]).otherwise(F.get("_rates", F.lit(0))["r"])
    return df.withColumn("_day", day).crossJoin(F.broadcast(pinned)).withColumn(into, F.when(F.col("_day").isNotNull(), pick)).drop("_day", "_rates")


def lookup(df: DataFrame, column: str, table: DataFrame, key: str, value: str, into: str, missing: str = "keep") -> DataFrame:
    """df with the value that a reference table has for the column; of repeated keys the last wins. Where there is none: keep
    the cell, blank, or error."""
    t = with_rid(table)
    last = t.groupBy(P.text(q(find(table, key))).alias("_k")).agg(F.max_by(P.text(q(find(table, value))), RID).alias("_v"))
    name = find(df, column)
    met = df.join(small(last), P.text(q(name)) == F.col("_k"), "left")
    other = {"keep": P.text(q(name)), "blank": F.lit("")}.get(missing)
    if missing == "error":
        other = F.raise_error(F.concat(F.lit("no lookup value for "), P.text(q(name)))).cast("string")
    if other is None:
        raise ValueError("missing is keep, blank or error")
    return met.withColumn(into, F.when(F.col("_k").isNotNull(), F.col("_v")).otherwise(other)).drop("_k", "_v")


def in_master(df: DataFrame, column: str, master: DataFrame, master_column: str) -> DataFrame:
    """Rows whose non-blank cell isn't in the master, by alphanumeric key."""
    from ..functions.texts import alnum_key

    known = master.select(alnum_key(q(find(master, master_column))).alias("_m")).distinct()
    name = find(df, column)
    rows = df.where(~P.blank(q(name)))
    return rows.join(small(known), alnum_key(q(name)) == F.col("_m"), "left_anti")


def amount_potential(a: DataFrame, amount_a: str, b: DataFrame, amount_b: str) -> DataFrame:
    """One row: equal and flipped, the pairs that equal amounts alone allow as they are and with b negated."""
    x = a.select(amount_of(a, find(a, amount_a)).alias("v")).where("v IS NOT NULL").groupBy("v").agg(F.count("*").alias("n"))
    y = b.select(amount_of(b, find(b, amount_b)).alias("v")).where("v IS NOT NULL").groupBy("v").agg(F.count("*").alias("m"))
    turned = y.select((-F.col("v")).cast(P.AMOUNT).alias("v"), F.col("m").alias("f"))
    met = x.join(y, "v", "left").join(turned, "v", "left")
    pairs = lambda c: F.coalesce(F.sum(F.when(F.col(c).isNotNull(), F.least("n", c))), F.lit(0))
    return met.agg(pairs("m").alias("equal"), pairs("f").alias("flipped"))


def first_rows(df: DataFrame, keys: list[Column], order: str = RID) -> DataFrame:
    """df with ``_nth`` (1 for the first row of its key)."""
    return df.withColumn("_nth", F.row_number().over(Window.partitionBy(*keys).orderBy(order)))
