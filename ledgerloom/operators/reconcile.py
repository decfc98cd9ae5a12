"""Reconciliation of two record sets: by key, or by amount within a date window; residue, triage, summary, group ties.

Every match is a frame of buckets: bucket, a and b (row ids), amounts, dates, currencies, diff, date_gap. The
key match is one full outer join of first rows. The amount match is a serial choice (each A row in order takes
its best free B row), so it is resolved inside islands of amounts that could meet at all; an island is small
unless amounts lie densely within the tolerance of each other.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from dataclasses import dataclass
from functools import reduce
from itertools import combinations

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import amounts as A
from ..functions import parsing as P
from ..functions.texts import spaceless_key
from .common import RID, Result, find_side, q, with_rid
from .filters import _typed

#: Probable cause and suggested action of each category.
TRIAGE = {
    "missing_in_B": ("in {A} but not in {B}: unrecorded there, or a timing item", "investigate; record in {B} or chase it", "investigate"),
    "missing_in_A": ("in {B} but not in {A}: unrecorded there, or a timing item", "investigate; record in {A} or query {B}", "investigate"),
    "amount_mismatch": ("same item, different amounts", "investigate the difference and correct the wrong side", "investigate"),
    "rounding": ("amounts differ within the rounding tolerance", "accept within tolerance", "accept"),
    "sign_flip": ("equal size, opposite sign: a direction error", "correct the sign of the entry", "correct"),
    "duplicate": ("more than once on one side", "confirm and remove the duplicate", "remove"),
    "timing_difference": ("equal amounts, different dates: in transit or cut-off", "monitor; expected to clear", "monitor"),
    "ambiguous_match": ("equal amounts, dates beyond the window: perhaps the same item", "confirm before reconciling", "confirm"),
    "currency_mismatch": ("same item, different currencies", "convert at the right rate or fix the currency", "investigate"),
    "currency_unknown": ("amounts tie but a currency is unknown", "establish the currency and run again", "confirm"),
    "parse_error": ("a matched item has no readable amount", "fix the source value and run again", "correct"),
}
# Labels, modes and columns of usual reconciliations.
PRESETS = {
    "invoice_tracker_vs_ledger": {"a_label": "Tracker", "b_label": "Ledger", "mode": "key", "key": "invoice_no", "amount": "amount", "date": "date"},
    "bank_vs_ledger": {"a_label": "Bank", "b_label": "Cashbook", "mode": "amount_date", "amount": "amount", "date": "date"},
    "fa_vs_internal": {"a_label": "FA", "b_label": "Internal", "mode": "key", "key": "ref", "amount": "amount", "date": "date"},
    "payments_vs_bank": {"a_label": "Approved", "b_label": "Bank", "mode": "key", "key": "payment_ref", "amount": "amount", "date": "date"},
}


@dataclass(frozen=True)
class Options:
    mode: str = "key"
    key: str | None = None
    amount: str = "amount"
    date: str | None = None
    currency: str | None = None
    debit: str | None = None
    credit: str | None = None
    tolerance: float = 0.01
    date_window_days: int | None = 5
    strict_currency: bool = False
    flip_b: bool = False
    rounding: float = 0.05
    material: float = 1000.0
    escalate: float = 10000.0
    as_of: str | None = None
    a_label: str = "A"
    b_label: str = "B"


def items(df: DataFrame, o: Options, flip: bool = False) -> DataFrame:
    """rid, amt, dt, key, ccy of every record."""
    df, types = with_rid(df), dict(df.dtypes)

    def cell(name: str | None) -> Column | None:
        found = find_side(df, name)
        return q(found) if found else None

    def amount(name: str | None) -> Column:
        found = find_side(df, name)
        if not found:
            return F.lit(None).cast(P.AMOUNT)
        return q(found).cast(P.AMOUNT) if _typed(types[found]) == "number" else P.lenient_amount(q(found))

    d, c = amount(o.debit), amount(o.credit)
    zero = F.lit(0).cast(P.AMOUNT)
    amt = F.when(d.isNotNull() | c.isNotNull(), F.coalesce(d, zero) - F.coalesce(c, zero)).otherwise(amount(o.amount)).cast(P.AMOUNT)
    when = find_side(df, o.date)
    day = F.lit(None).cast("date") if not when else q(when).cast("date") if _typed(types[when]) == "date" else P.reconcile_date(q(when))
    named = cell(o.currency)
    seen = [P.reconcile_currency(x) for x in (cell(o.amount), cell(o.debit), cell(o.credit)) if x is not None]
    own = [F.when(~P.blank(named), F.coalesce(P.reconcile_currency(named), F.upper(P.text(named))))] if named is not None else []
    key = cell(o.key)
    return df.select(F.col(RID).alias("rid"), (-amt if flip else amt).cast(P.AMOUNT).alias("amt"), day.alias("dt"), (spaceless_key(key) if key is not None else F.lit(None).cast("string")).alias("key"), F.coalesce(*own, *seen, F.lit(None).cast("string")).alias("ccy"))


#: Edges up to which one task makes an ordered choice; beyond, it is made in rounds.
ONE_TASK_EDGES = 200_000
BUCKETS = "bucket string, a long, b long, a_amt decimal(28,6), b_amt decimal(28,6), a_dt date, b_dt date, a_ccy string, b_ccy string, diff decimal(28,6), date_gap int"
_COLUMNS = [c.split()[0] for c in BUCKETS.split(", ")]


def _bucketed(df: DataFrame, bucket: Column) -> DataFrame:
    gap = F.abs(F.datediff("a_dt", "b_dt"))
    diff = (F.col("a_amt") - F.col("b_amt")).cast(P.AMOUNT)
    return df.select(bucket.alias("bucket"), "a", "b", "a_amt", "b_amt", "a_dt", "b_dt", "a_ccy", "b_ccy", diff.alias("diff"), gap.alias("date_gap"))


def _side(df: DataFrame, s: str) -> DataFrame:
    return df.select(F.col("rid").alias(s), *(F.col(c).alias(f"{s}_{c}") for c in ("amt", "dt", "ccy")), F.col("key").alias(f"{s}_key"))


def _empty(df: DataFrame, s: str) -> DataFrame:
    return df.select("*", F.lit(None).cast("long").alias(s), F.lit(None).cast(P.AMOUNT).alias(f"{s}_amt"), F.lit(None).cast("date").alias(f"{s}_dt"), F.lit(None).cast("string").alias(f"{s}_ccy"))


def match_key(a: DataFrame, b: DataFrame, o: Options) -> DataFrame:
    """First A with first B of each key; later ones are duplicates; records without a key stay one-sided."""
    nth = lambda d, s: _side(d, s).withColumn("nth", F.when(F.col(f"{s}_key").isNull(), 1).otherwise(F.row_number().over(Window.partitionBy(f"{s}_key").orderBy(s))))
    x, y = nth(a, "a"), nth(b, "b")
    # records without a key can't meet: they join on keys of their own, and don't pile up under one
    one = lambda d, s: d.where("nth = 1").drop("nth").withColumn(f"{s}_join", F.coalesce(f"{s}_key", F.concat(F.lit(f"\u0000{s}"), F.col(s).cast("string"))))
    x1, y1 = one(x, "a"), one(y, "b")
    met = x1.join(y1, x1.a_join == y1.b_join, "full_outer")
    rel = A.currency_relation(F.col("a_ccy"), F.col("b_ccy"), o.strict_currency)
    within = F.abs(F.col("a_amt") - F.col("b_amt")) <= F.lit(str(o.tolerance)).cast(P.AMOUNT)
    bucket = F.when(F.col("b").isNull(), "a_only").when(F.col("a").isNull(), "b_only").when(F.col("a_amt").isNull() | F.col("b_amt").isNull(), "parse_error").when(rel == "mismatch", "currency_diff").when(rel == "unknown", "currency_unknown").when(within, "matched").otherwise("value_diff")
    twice = [_bucketed(_empty(d.where("nth > 1"), other), F.lit(f"dup_{s}")) for d, s, other in ((x, "a", "b"), (y, "b", "a"))]
    return _bucketed(met, bucket).unionByName(twice[0]).unionByName(twice[1])


def _islands(steps: DataFrame, tol: Column) -> DataFrame:
    """amt, island of distinct amounts; neighbours within the tolerance share an island. The partitions are kept: read again,
    the range could be cut elsewhere."""
    ranged = _kept(steps.repartitionByRange("amt").sortWithinPartitions("amt").withColumn("p", F.spark_partition_id()))
    edge = ranged.groupBy("p").agg(F.min("amt").alias("low"), F.max("amt").alias("high"))
    before = edge.select("p", F.lag("high").over(Window.orderBy("low")).alias("before"))
    prior = F.coalesce(F.lag("amt").over(Window.partitionBy("p").orderBy("amt")), F.col("before"))
    cut = F.coalesce((F.col("amt") - prior > tol).cast("int"), F.lit(1))
    local = ranged.join(F.broadcast(before), "p").select("amt", "p", cut.alias("cut"))
    local = local.withColumn("i", F.sum("cut").over(Window.partitionBy("p").orderBy("amt")))
    sums = local.groupBy("p").agg(F.max("i").alias("s"), F.min("amt").alias("low")).select("p", (F.sum("s").over(Window.orderBy("low")) - F.col("s")).alias("o"))
    return local.join(F.broadcast(sums), "p").select("amt", (F.col("i") + F.col("o")).alias("island"))


def match_amount_date(a: DataFrame, b: DataFrame, o: Options) -> DataFrame:
    """Each A in order takes its best free B of an equal amount: inside the window, then outside, then of unknown currency."""
    tol = F.lit(str(o.tolerance)).cast(P.AMOUNT)
    ready = F.col("amt").isNotNull() & (F.col("dt").isNotNull() if o.date else F.lit(True))
    both = a.withColumn("side", F.lit("a")).unionByName(b.withColumn("side", F.lit("b")))
    both = _kept(both)
    live, dead = both.where(ready), both.where(~ready)
    if o.tolerance > 0:  # islands of distinct amounts that lie within the tolerance of the next
        islands = _islands(live.select("amt").distinct(), tol)
        live = live.join(islands, "amt")
    else:
        live = live.withColumn("island", F.xxhash64("amt"))
    # an island of at most one kind of records a side (amount, date and currency) needs no ordered choice: the nth of the one
    # side meets the nth of the other, by expressions
    whole = Window.partitionBy("island")
    kinds = lambda s: [f(F.when(F.col("side") == s, F.struct("amt", "dt", "ccy"))).over(whole) for f in (F.min, F.max)]
    plain = reduce(lambda x, y: x & y, (low.eqNullSafe(high) for low, high in (kinds("a"), kinds("b"))))
    live = _kept(live.withColumn("plain", plain))
    nth = F.row_number().over(Window.partitionBy("island", "side").orderBy("rid"))
    of = lambda s, c: F.max(F.when(F.col("side") == s, F.col(c)))
    fields = [of(s, c).alias(n) for s in "ab" for c, n in (("rid", s), ("amt", f"{s}_amt"), ("dt", f"{s}_dt"), ("ccy", f"{s}_ccy"))]
    met = live.where("plain").withColumn("nth", nth).groupBy("island", "nth").agg(*fields).drop("island", "nth")
    rel = A.currency_relation(F.col("a_ccy"), F.col("b_ccy"), o.strict_currency)
    fits = (F.abs(F.col("a_amt") - F.col("b_amt")) <= tol) & (rel != "mismatch")
    inside = F.lit(True) if o.date_window_days is None else F.abs(F.datediff("a_dt", "b_dt")) <= o.date_window_days
    kind = F.when(rel == "unknown", "currency_unknown").when(inside, "matched").otherwise("ambiguous") if o.date else F.when(rel == "unknown", "currency_unknown").otherwise("ambiguous")
    ends = {s: F.struct(*(F.col(c) if c[0] == s else F.lit(None).cast(t).alias(c) for c, t in _FIELDS)) for s in "ab"}
    both_ = F.struct(*(F.col(c) for c, _ in _FIELDS))
    apart = F.filter(F.array(*(F.when(F.col(s).isNotNull(), F.struct(F.lit(f"{s}_only").alias("bucket"), ends[s].alias("r"))) for s in "ab")), lambda x: x.isNotNull())
    settled = met.select(F.inline(F.when(F.col("a").isNotNull() & F.col("b").isNotNull() & fits, F.array(F.struct(kind.alias("bucket"), both_.alias("r")))).otherwise(apart))).select("bucket", "r.*")
    single = lambda d, s, other: _bucketed(_empty(d.select(*(c for c in d.columns if c.startswith(s) and (c == s or c[1] == "_"))), other), F.lit(f"{s}_only"))
    crowd = live.where("NOT plain").select("island", "side", "rid", "amt", "dt", "ccy").repartition("island").sortWithinPartitions("island", "side", "rid").mapInPandas(_chooser(o), ", ".join(["bucket string", *(f"{c} {t}" for c, t in _FIELDS)]))
    met = settled.unionByName(crowd)
    rest_a = single(_side(dead.where("side = 'a'"), "a"), "a", "b")
    rest_b = single(_side(dead.where("side = 'b'"), "b"), "b", "a")
    return _bucketed(met, F.col("bucket")).unionByName(rest_a).unionByName(rest_b)


_FIELDS = [("a", "long"), ("a_amt", P.AMOUNT), ("a_dt", "date"), ("a_ccy", "string"), ("b", "long"), ("b_amt", P.AMOUNT), ("b_dt", "date"), ("b_ccy", "string")]


def _chooser(o: Options):
    """The ordered choice inside islands, over records sorted by island, side and rid. B records of one amount, date and
    currency wait in one queue; an A looks only at the queues of amounts within the tolerance."""
    from collections import deque
    from decimal import Decimal

    most, window, dated, strict = Decimal(str(o.tolerance)), o.date_window_days, bool(o.date), o.strict_currency

    def island(A_: list, B_: list, out: list) -> None:
        at: dict = {}
        for y in B_:
            at.setdefault(y[1], {}).setdefault(y[2:], deque()).append(y)
        amounts = sorted(at)
        for x in A_:
            rid, amt, dt, ccy = x
            best = None
            for v in amounts[bisect_left(amounts, amt - most) : bisect_right(amounts, amt + most)]:
                for k, line in at[v].items():
                    known = ccy is not None and k[1] is not None
                    if known and ccy != k[1]:
                        continue
                    gap = abs((dt - k[0]).days) if dated else 0
                    rank = 2 if strict and not known else 1 if not dated else 0 if window is None or gap <= window else 1
                    if best is None or (rank, gap, line[0][0]) < best[:3]:
                        best = (rank, gap, line[0][0], v, k)
            if best is None:
                out.append(("a_only", *x, None, None, None, None))
                continue
            line = at[best[3]][best[4]]
            out.append((("matched", "ambiguous", "currency_unknown")[best[0]], *x, *line.popleft()))
            if not line:
                del at[best[3]][best[4]]
                if not at[best[3]]:
                    del at[best[3]]
                    amounts.pop(bisect_left(amounts, best[3]))
        out.extend(("b_only", None, None, None, None, *y) for lines in at.values() for line in lines.values() for y in line)

    def choose(batches):
        names = ["bucket", *(c for c, _ in _FIELDS)]
        now, sides, out = None, ([], []), []

        def frame():
            done = pd.DataFrame(out, columns=names, dtype=object)
            out.clear()
            return done

        for batch in batches:
            null = lambda c: batch[c].astype(object).where(batch[c].notna(), None).tolist()  # noqa: E731, B023
            for i, s, *x in zip(batch.island.tolist(), batch.side.tolist(), batch.rid.tolist(), batch.amt.tolist(), null("dt"), null("ccy"), strict=True):
                if i != now:
                    island(*sides, out)
                    now, sides = i, ([], [])
                sides[s == "b"].append(tuple(x))
            if len(out) >= 10_000:
                yield frame()
        island(*sides, out)
        yield frame()

    return choose


def refine(buckets: DataFrame, o: Options) -> DataFrame:
    """One-sided records that pair by opposite sign, or by a usual tax rate, become value_diff; twins of matched or earlier
    one-sided records on amount and date become duplicates."""
    tol, near = (F.lit(str(v)).cast(P.AMOUNT) for v in (o.tolerance, o.rounding))
    buckets = _kept(buckets)  # read several times below
    a = buckets.where("bucket = 'a_only' AND a_amt IS NOT NULL").select("a", "a_amt", "a_dt", "a_ccy")
    b = buckets.where("bucket = 'b_only' AND b_amt IS NOT NULL").select("b", "b_amt", "b_dt", "b_ccy")
    compatible = A.currency_relation(F.col("a_ccy"), F.col("b_ccy")) != "mismatch"
    inside = F.lit(True) if o.date_window_days is None else F.coalesce(F.abs(F.datediff("a_dt", "b_dt")) <= o.date_window_days, F.lit(True))
    flips = _kept(_flips(a.where(F.abs("a_amt") > near), b, near, o))
    a2, b2 = a.join(flips, "a", "left_anti"), b.join(flips, "b", "left_anti")
    taxed = _taxed(a2, b2, tol, compatible, inside, o)
    pairs = _kept(flips.unionByName(taxed))
    full = pairs.join(a, "a").join(b, "b")
    diffs = _bucketed(full, F.lit("value_diff"))
    rest = buckets.join(pairs.select(F.col("a").alias("pa")), (F.col("bucket") == "a_only") & (F.col("a") == F.col("pa")), "left_anti").join(pairs.select(F.col("b").alias("pb")), (F.col("bucket") == "b_only") & (F.col("b") == F.col("pb")), "left_anti")
    for s in "ab":
        twin = F.col("bucket").isin("matched", f"{s}_only") & F.col(f"{s}_amt").isNotNull()
        alone = F.when(~twin, F.xxhash64("a", "b"))  # others take no part, and don't pile up under one key
        order = Window.partitionBy(f"{s}_amt", f"{s}_dt", "twin", "alone").orderBy((F.col("bucket") != "matched").cast("int"), s)
        rest = rest.withColumns({"twin": twin, "alone": alone}).withColumn("nth", F.row_number().over(order))
        rest = rest.withColumn("bucket", F.when(F.col("twin") & (F.col("bucket") == f"{s}_only") & (F.col("nth") > 1), f"dup_{s}").otherwise(F.col("bucket"))).drop("twin", "alone", "nth")
    return rest.select(*_COLUMNS).unionByName(diffs)


def _taxed(a: DataFrame, b: DataFrame, tol: Column, compatible: Column, inside: Column, o: Options) -> DataFrame:
    """(a, b) whose amounts are apart by a usual tax rate: each A in order takes its nearest free B, of equally near ones the
    first. Pairs are listed between kinds (records of one amount, date and currency), met by cells of amount and days."""
    width, days = F.log(F.lit(1.002)), None if o.date_window_days is None else o.date_window_days + 1
    kind = lambda d, s: _kept(d.where(F.col(f"{s}_amt") != 0).withColumn(f"k{s}", F.min(s).over(Window.partitionBy(f"{s}_amt", f"{s}_dt", f"{s}_ccy"))))
    a, b = kind(a, "a"), kind(b, "b")
    ratios = F.explode(F.array(*(F.lit(1 + float(r)) for r in A.TAX_RATES)))
    scale = lambda c: F.floor(F.log(F.abs(c).cast("double")) / width)
    day = lambda s: F.floor(F.datediff(f"{s}_dt", F.lit("1970-01-01").cast("date")) / days)
    listed = []
    one = {"a": a.where("a = ka").drop("a"), "b": b.where("b = kb").drop("b")}
    for s, other in ("ab", "ba"):  # one side is the net amount, the other the gross
        net = one[s].select("*", ratios.alias("r")).withColumn("cell", F.floor(F.log(F.abs(f"{s}_amt").cast("double") * F.col("r")) / width))
        gross = one[other].select("*", F.explode(F.array(*(scale(F.col(f"{other}_amt")) + i for i in (-1, 0, 1)))).alias("cell"))
        if days is None:
            met = [net.join(gross, "cell")]
        else:  # records without a date meet all others
            dated = {t: F.col(f"{t}_dt").isNotNull() for t in "ab"}
            near = gross.where(dated[other]).withColumn("day", F.explode(F.array(*(day(other) + i for i in (-1, 0, 1)))))
            met = [net.where(dated[s]).withColumn("day", day(s)).join(near, ["cell", "day"]).drop("day"), net.where(~dated[s]).join(gross, "cell"), net.where(dated[s]).join(gross.where(~dated[other]), "cell")]
        x, y = (F.abs(f"{t}_amt").cast("double") for t in (s, other))
        off = F.abs((y - x) / x - (F.col("r") - 1))  # near the limit, decimals decide
        apart = F.when(off < 0.00099, True).when(off > 0.00101, False).otherwise(A.tax_hint(F.col("a_amt"), F.col("b_amt")).isNotNull())
        for m in met:
            listed.append(m.where((F.signum("a_amt") == F.signum("b_amt")) & inside & apart & (F.abs(F.col("a_amt") - F.col("b_amt")) > tol) & compatible).select("ka", "kb", F.coalesce(F.abs(F.datediff("a_dt", "b_dt")), F.lit(0)).alias("w")))
    edges = _kept(reduce(DataFrame.unionByName, listed).groupBy("ka").agg(F.sort_array(F.collect_list(F.struct("w", "kb"))).alias("to")))
    lines = b.join(edges.select(F.explode("to.kb").alias("kb")).distinct(), "kb", "left_semi").select(F.lit(0).alias("side"), F.col("b").alias("rid"), "kb", F.lit(None).cast("array<int>").alias("w"), F.lit(None).cast("array<long>").alias("to"))
    asks = a.join(edges, "ka").select(F.lit(1).alias("side"), F.col("a").alias("rid"), F.lit(None).cast("long").alias("kb"), F.col("to.w").alias("w"), F.col("to.kb").alias("to"))

    def choose(batches):
        from collections import deque

        queues: dict = {}
        for batch in batches:
            got = []
            for side, rid, kb, w, to in zip(*(batch.column(c).to_pylist() for c in ("side", "rid", "kb", "w", "to")), strict=True):
                if side == 0:
                    queues.setdefault(kb, deque()).append(rid)
                    continue
                best = None
                for gap, k in zip(w, to, strict=True):
                    if best is not None and gap > best[0]:
                        break
                    if k in queues and (best is None or queues[k][0] < best[1]):
                        best = (gap, queues[k][0], k)
                if best is not None:
                    got.append((rid, queues[best[2]].popleft()))
                    if not queues[best[2]]:
                        del queues[best[2]]
            yield pa.RecordBatch.from_arrays([pa.array([g[i] for g in got], pa.int64()) for i in (0, 1)], names=["a", "b"])

    return lines.unionByName(asks).repartition(1).sortWithinPartitions("side", "rid").mapInArrow(choose, "a long, b long")


def _flips(a: DataFrame, b: DataFrame, near: Column, o: Options) -> DataFrame:
    """(a, b) of opposite amounts: each A in order takes the first free B that fits. B records of one amount, date and currency
    wait in one queue, so an island of sizes costs its A records times its queues, and no pairs are listed."""
    cols = lambda d, s: d.select(F.lit(s).alias("side"), F.col(s).alias("rid"), (F.col(f"{s}_amt") if s == "a" else -F.col(f"{s}_amt")).cast(P.AMOUNT).alias("amt"), F.col(f"{s}_dt").alias("dt"), F.col(f"{s}_ccy").alias("ccy"))
    both = _kept(cols(a, "a").unionByName(cols(b, "b")))
    placed = both.join(_islands(both.select("amt").distinct(), near), "amt")
    met = placed.groupBy("island").agg(F.count_if(F.col("side") == "a").alias("na"), F.count_if(F.col("side") == "b").alias("nb")).where("na > 0 AND nb > 0").select("island")

    def choose(rows: pd.DataFrame) -> pd.DataFrame:
        from collections import deque
        from decimal import Decimal

        most, out, queues = Decimal(str(o.rounding)), [], {}
        name = lambda v: v if isinstance(v, str) else None
        day = lambda v: None if pd.isna(v) else v
        for y in rows[rows.side == "b"].sort_values("rid").itertuples():
            queues.setdefault((y.amt, day(y.dt), name(y.ccy)), deque()).append(int(y.rid))
        for x in rows[rows.side == "a"].sort_values("rid").itertuples():
            dt, ccy, best = day(x.dt), name(x.ccy), None
            for k, line in queues.items():
                if abs(x.amt - k[0]) > most or (ccy and k[2] and ccy != k[2]):
                    continue
                if o.date_window_days is not None and dt is not None and k[1] is not None and abs((dt - k[1]).days) > o.date_window_days:
                    continue
                if best is None or line[0] < queues[best][0]:
                    best = k
            if best is not None:
                out.append((int(x.rid), queues[best].popleft()))
                if not queues[best]:
                    del queues[best]
        return pd.DataFrame(out, columns=["a", "b"])

    return placed.join(met, "island").select("island", "side", "rid", "amt", "dt", "ccy").groupBy("island").applyInPandas(choose, "a long, b long")


def _greedy(edges: DataFrame) -> DataFrame:
    """(a, b) chosen as each A in order takes its nearest free B. Few edges are chosen in one task; more of them in rounds of
    deferred acceptance: every A asks its nearest B, a B holds the first A that asks and turns later ones away for good. As all
    B prefer A records in one and the same order, the outcome is the serial choice. Rounds end when nobody is turned away."""
    edges = _kept(edges.select("a", "b", "w"))
    if edges.count() <= ONE_TASK_EDGES:

        def choose(rows: pd.DataFrame) -> pd.DataFrame:
            out, used = [], set()
            for a, own in rows.sort_values(["a", "w", "b"]).groupby("a", sort=True):
                b = next((int(x) for x in own.b if int(x) not in used), None)
                if b is not None:
                    used.add(b)
                    out.append((int(a), b))
            return pd.DataFrame(out, columns=["a", "b"])

        return edges.withColumn("all", F.lit(0)).groupBy("all").applyInPandas(choose, "a long, b long")
    left = edges
    while True:
        asked = _kept(left.groupBy("a").agg(F.min(F.struct("w", "b")).alias("best")).select("a", F.col("best.b").alias("b")))
        held = asked.groupBy("b").agg(F.min("a").alias("holder"), F.count("*").alias("n"))
        if not held.where("n > 1").head(1):
            return asked
        left = _kept(left.join(held.select("b", "holder"), "b", "left").where("holder IS NULL OR a <= holder").select("a", "b", "w"))


def _kept(df: DataFrame) -> DataFrame:
    from ..session import checkpointed

    return checkpointed(df)


def match(a: DataFrame, b: DataFrame, o: Options) -> DataFrame:
    x, y = items(a, o), items(b, o, o.flip_b)
    return match_key(x, y, o) if o.mode == "key" else refine(match_amount_date(x, y, o), o)


def triage(buckets: DataFrame, o: Options) -> DataFrame:
    """category, magnitude, materiality, action, probable_cause, suggested_action, currency, age_days, a, b of every exception."""
    diff = F.bround(F.abs("diff"), 2)
    near = F.lit(str(o.rounding)).cast(P.AMOUNT)
    flip = (F.bround(F.abs(F.col("a_amt") + F.col("b_amt")), 2) <= near) & (F.bround(F.abs("a_amt"), 2) > near)
    category = (
        F.when((F.col("bucket") == "matched") & (F.col("date_gap") > 0), "timing_difference").when(F.col("bucket") == "ambiguous", "ambiguous_match").when(F.col("bucket") == "currency_diff", "currency_mismatch")
        .when(F.col("bucket").isin("currency_unknown", "parse_error"), F.col("bucket")).when(F.col("bucket") == "value_diff", F.when(diff <= near, "rounding").when(flip, "sign_flip").otherwise("amount_mismatch"))
        .when(F.col("bucket") == "a_only", "missing_in_B").when(F.col("bucket") == "b_only", "missing_in_A").when(F.col("bucket").isin("dup_a", "dup_b"), "duplicate")
    )
    rows = buckets.withColumn("category", category).where(F.col("category").isNotNull())
    own = F.coalesce("a_amt", "b_amt")
    size = F.when(F.col("category") == "timing_difference", F.lit(0).cast(P.AMOUNT)).when(F.col("bucket") == "value_diff", F.col("diff")).otherwise(own)
    named = {k: [t.format(A=o.a_label, B=o.b_label) for t in v] for k, v in TRIAGE.items()}
    pick = lambda i: F.element_at(F.create_map(*(F.lit(x) for k, v in named.items() for x in (k, v[i]))), F.col("category"))
    hint = F.when(F.col("category") == "amount_mismatch", A.tax_hint(F.col("a_amt"), F.col("b_amt")))
    apart = F.when((F.col("category") == "ambiguous_match") & F.col("date_gap").isNotNull(), F.concat(F.lit("dates "), F.col("date_gap").cast("string"), F.lit(" days apart")))
    cause = F.concat(pick(0), F.coalesce(F.concat(F.lit(" ("), F.coalesce(hint, apart), F.lit(")")), F.lit("")))
    age = F.when(F.col("bucket").isin("a_only", "b_only"), F.datediff(P.reconcile_date(F.lit(o.as_of)), F.coalesce("a_dt", "b_dt"))) if o.as_of else F.lit(None).cast("int")
    band = F.when(F.col("category") == "rounding", "within tolerance").otherwise(A.materiality(F.col("magnitude"), o.material, o.escalate))
    out = rows.withColumn("magnitude", size).select("category", "magnitude", band.alias("materiality"), pick(2).alias("action"), cause.alias("probable_cause"), pick(1).alias("suggested_action"), F.coalesce("a_ccy", "b_ccy").alias("currency"), age.alias("age_days"), "a", "b")
    order = F.when(F.col("materiality") == "escalate", 0).when(F.col("materiality") == "material", 1).when(F.col("materiality") == "immaterial", 2).otherwise(3)
    return out.orderBy(order, F.desc(F.abs(F.coalesce("magnitude", F.lit(0)))), "a", "b")


def summarise(buckets: DataFrame, exceptions: DataFrame, aggregated_items: int = 0) -> dict[str, object]:
    """matched, exceptions, pct_reconciled, values matched and in exception (all, by category, by currency), RAG status. Items
    matched inside the window on different days count as matched and as exceptions."""
    size = lambda c: F.coalesce(F.sum(F.abs(c)), F.lit(0)).cast("decimal(38,2)")
    hit = buckets.where("bucket = 'matched'").groupBy(F.coalesce("a_ccy", "b_ccy", F.lit("?")).alias("ccy")).agg(F.count("*").alias("n"), size(F.col("a_amt")).alias("v")).collect()
    out = exceptions.groupBy("category", F.coalesce("currency", F.lit("?")).alias("ccy")).agg(F.count("*").alias("n"), size(F.col("magnitude")).alias("v"), F.count_if(F.col("materiality").isin("material", "escalate")).alias("red")).collect()
    matched, n_exceptions, red = sum(r.n for r in hit), sum(r.n for r in out), sum(r.red for r in out)
    reconciled = matched + aggregated_items
    total = reconciled + n_exceptions
    by_category: dict[str, dict] = {}
    by_currency: dict[str, dict] = {r.ccy: {"matched_val": r.v, "exception_val": 0} for r in hit}
    for r in out:
        c = by_category.setdefault(r.category, {"n": 0, "val": 0})
        c["n"], c["val"] = c["n"] + r.n, c["val"] + r.v
        m = by_currency.setdefault(r.ccy, {"matched_val": 0, "exception_val": 0})
        m["exception_val"] += r.v
    return {
        "matched": matched, "exceptions": n_exceptions, "total": total, "pct_reconciled": round(100 * reconciled / total, 1) if total else 100.0,
        "value_matched": sum(r.v for r in hit), "value_in_exception": sum(r.v for r in out), "by_category": by_category, "by_currency": by_currency,
        "material_or_escalate": red, "rag": "RED" if red else "AMBER" if n_exceptions else "GREEN",
    }


def absurd_warning(potential: dict[str, int], reconciled: int) -> str | None:
    """A warning where equal amounts allow twenty pairs or more and under a fifth of them is reconciled."""
    if potential["equal"] >= 20 and reconciled < 0.2 * potential["equal"]:
        return f"only {reconciled} of {potential['equal']} possible pairs matched: check dates and mappings"
    if potential["flipped"] >= 20 and potential["flipped"] > 2 * potential["equal"] and reconciled < 0.2 * potential["flipped"]:
        return f"{potential['flipped']} pairs would match with one side's sign turned: check the sign convention"
    return None


def check_balance(df: DataFrame, amount: str, opening: float, closing: float, tolerance: float = 0.01) -> DataFrame:
    """One row: movement, expected, difference, unparsed, balanced: opening and movement against closing."""
    v = items(df, Options(amount=amount)).agg(F.coalesce(F.sum("amt"), F.lit(0)).cast("decimal(38,6)").alias("movement"), F.count_if(F.col("amt").isNull()).alias("unparsed"))
    expected = (F.col("movement") + F.lit(str(opening)).cast("decimal(28,6)")).alias("expected")
    gap = F.lit(str(closing)).cast("decimal(28,6)") - F.col("expected")
    return v.select("movement", expected, "unparsed").withColumn("difference", gap).withColumn("balanced", F.abs("difference") <= F.lit(str(tolerance)).cast("decimal(28,6)"))


PROPOSALS = "kind string, grp string, a_ids array<long>, b_ids array<long>, a_sum decimal(38,6), b_sum decimal(38,6)"


def first_combination(values: list[int], target: int, slack: int, most: int) -> tuple[int, ...] | None:
    """Places of the first two to ``most`` values that add up to the target within the slack: fewest first, then by place.

    The last value of a combination is looked up among the sorted ones behind the others, so k values cost as k - 1 do.
    """
    order = sorted(range(len(values)), key=lambda i: (values[i], i))
    ranked = [values[i] for i in order]

    def last(after: int, want: int) -> int | None:
        return min((i for i in order[bisect_left(ranked, want - slack) : bisect_right(ranked, want + slack)] if i > after), default=None)

    for k in range(2, most + 1):
        for head in combinations(range(len(values)), k - 1):
            end = last(head[-1], target - sum(values[i] for i in head))
            if end is not None:
                return (*head, end)
    return None


def propose_aggregations(a: DataFrame, b: DataFrame, group_a: str | list[str], group_b: str | list[str], o: Options, most: int = 5, candidates: int | None = 60) -> DataFrame:
    """Group ties (equal sums of a group's records, three records or more) and subset ties (one record against two to ``most``
    of the other side in its group), with the ids of both sides. The group is of one column or several. Give the records that
    are still unmatched. Groups of more than ``candidates`` open records a side are listed as 'too_many' instead of being
    searched, as their subsets may take hours; with None, every group is searched."""
    from ..functions.texts import spaceless_key as key

    def side(df: DataFrame, g: str | list[str]) -> DataFrame:
        d = with_rid(df)
        keys = [key(q(find_side(d, c))) for c in ([g] if isinstance(g, str) else g)]
        whole = reduce(lambda x, y: x & y, (k.isNotNull() for k in keys), F.lit(True))
        return items(d, o).join(d.select(F.col(RID).alias("rid"), F.when(whole, F.concat_ws("+", *keys)).alias("grp")), "rid").where("grp IS NOT NULL AND amt IS NOT NULL")

    x, y = side(a, group_a), side(b, group_b)
    tol = F.lit(str(o.tolerance)).cast(P.AMOUNT)
    sums = lambda d, s: d.groupBy("grp").agg(F.sum("amt").cast("decimal(38,6)").alias(f"{s}_sum"), F.count("*").alias(f"{s}_n"), F.min("ccy").alias(f"{s}_lo"), F.max("ccy").alias(f"{s}_hi"))
    both = _kept(sums(x, "a").join(sums(y, "b"), "grp"))
    one_ccy = (F.coalesce(F.least("a_lo", "b_lo"), F.lit("")) == F.coalesce(F.greatest("a_hi", "b_hi"), F.lit("")))
    tied = both.where((F.abs(F.col("a_sum") - F.col("b_sum")) <= tol) & (F.col("a_n") + F.col("b_n") >= 3) & one_ccy)
    ids = lambda d, s: d.join(tied.select("grp"), "grp", "left_semi").groupBy("grp").agg(F.sort_array(F.collect_list("rid")).alias(f"{s}_ids"))
    whole = tied.join(ids(x, "a"), "grp").join(ids(y, "b"), "grp").select(F.lit("group").alias("kind"), "grp", "a_ids", "b_ids", "a_sum", "b_sum")
    none = F.array().cast("array<long>")
    over = both.where(F.lit(False) if candidates is None else (F.col("a_n") > candidates) | (F.col("b_n") > candidates)).join(tied.select("grp"), "grp", "left_anti")
    many = over.select(F.lit("too_many").alias("kind"), "grp", none.alias("a_ids"), none.alias("b_ids"), "a_sum", "b_sum")
    open_ = lambda d: d.join(tied.select("grp"), "grp", "left_anti").join(over.select("grp"), "grp", "left_anti")

    def subsets(key_: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        cents = lambda d: [(int(r.rid), int(round(r.amt * 100))) for r in d.sort_values("rid").itertuples()]
        out, slack = [], int(round(o.tolerance * 100))
        sides = (cents(left), cents(right))
        used: tuple[set, set] = (set(), set())
        for s in (0, 1):
            for rid, target in sides[s]:
                if rid in used[s]:
                    continue
                pool = [(i, v) for i, v in sides[1 - s] if i not in used[1 - s] and (v > 0) == (target > 0)]
                at = first_combination([v for _, v in pool], target, slack, most)
                if at:
                    hit = [pool[k] for k in at]
                    used[s].add(rid)
                    used[1 - s].update(i for i, _ in hit)
                    ids = ([rid], [i for i, _ in hit])
                    total = (target / 100, sum(v for _, v in hit) / 100)
                    out.append((("one_to_many", "many_to_one")[s], key_[0], ids[s], ids[1 - s], total[s], total[1 - s]))
        from decimal import Decimal

        return pd.DataFrame([(k, g, x, y, Decimal(str(p)), Decimal(str(r))) for k, g, x, y, p, r in out], columns=["kind", "grp", "a_ids", "b_ids", "a_sum", "b_sum"])

    part = open_(x).groupBy("grp").cogroup(open_(y).groupBy("grp")).applyInPandas(subsets, PROPOSALS)
    return whole.unionByName(many).unionByName(part).orderBy("grp", "kind", "a_ids", "b_ids")


def unmatched(df: DataFrame, buckets: DataFrame, s: str) -> DataFrame:
    """The records of side ``s`` that are one-sided."""
    d = with_rid(df)
    left = buckets.where(F.col("bucket") == f"{s}_only").select(F.col(s).alias("left_"))
    return d.join(left, d[RID] == left.left_, "left_semi")


def apply_aggregations(buckets: DataFrame, accepted: DataFrame) -> DataFrame:
    """buckets with the one-sided records of accepted proposals (with a_ids and b_ids) moved to the bucket matched_agg."""
    for s in "ab":
        ids = accepted.select(F.explode(f"{s}_ids").alias("i")).distinct().withColumn("hit", F.lit(True))
        moved = buckets.join(ids, (buckets.bucket == f"{s}_only") & (buckets[s] == ids.i), "left")
        buckets = moved.withColumn("bucket", F.when(F.col("hit"), "matched_agg").otherwise(F.col("bucket"))).drop("i", "hit")
    return buckets


def result(a: DataFrame, b: DataFrame, o: Options) -> Result:
    """Buckets with exceptions, kept so that summary and reports read them once."""
    buckets = _kept(match(a, b, o))
    return Result(buckets, None, {"exceptions": triage(buckets, o)})
