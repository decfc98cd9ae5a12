"""Declarative filters with a report, and the row filters of conversions."""

from __future__ import annotations

from decimal import Decimal
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import parsing as P
from .common import Result, find, q

OPS = ("==", "!=", ">", ">=", "<", "<=", "in", "not_in", "between", "not_between", "contains", "is_empty", "not_empty")


def _typed(dtype: str) -> str | None:
    """The kind of a column whose type says it already."""
    if dtype.startswith(("decimal", "bigint", "int", "double", "float", "smallint", "tinyint")):
        return "number"
    return "date" if dtype in ("date", "timestamp", "timestamp_ntz") else None


class _Side:
    """A column in a comparison: its kind and its value as each kind. A text column's readings come from ``_read``."""

    def __init__(self, c: Column, dtype: str, name: str):
        self.known = _typed(dtype)
        number, date = (c, c) if self.known else (F.col(_READ + name)["number"], F.col(_READ + name)["date"])
        self.kind = F.lit(self.known) if self.known else P.kind_from(P.text(c), date, number)
        self.number, self.date, self.string = number.cast("decimal(38,10)"), date.cast("date"), F.lower(P.text(c))


_READ = "__read_"


def _read(df: DataFrame, names: list[str]) -> DataFrame:
    """df with each text column's readings as number and date, worked out once. They come out of a generator, as the optimiser
    would otherwise put their expressions, which are long, into every predicate."""
    each = [F.struct(P.amount(q(n)).cast("decimal(38,10)").alias("number"), P.day(q(n)).alias("date")).alias(_READ + n) for n in names]
    return df.select("*", F.inline(F.array(F.struct(*each)))) if each else df


def _literals(df: DataFrame, values: list[Any]) -> list[tuple[str, Any]]:
    """(kind, value) of a plan's values, read once on the driver by the same parsers as cells."""
    out: list[tuple[str, Any]] = [("number", Decimal(str(v))) if isinstance(v, (int, float, Decimal)) and not isinstance(v, bool) else ("", "" if v is None else str(v)) for v in values]
    texts = [v for k, v in out if not k]
    if texts:
        c = F.col("v")
        one = df.sparkSession.range(1).select(F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.lit(v).alias("v")) for i, v in enumerate(texts)))).alias("x")).select("x.i", "x.v")
        read = {r.i: r for r in one.select("i", P.kind(c).alias("k"), P.amount(c).cast("decimal(38,10)").alias("number"), P.day(c).alias("date"), F.lower(P.text(c)).alias("string")).collect()}
        at = iter(range(len(texts)))
        out = [(k, v) if k else ((r := read[next(at)]).k, r[r.k]) for k, v in out]
    return out


def _compare(a: _Side, literal: tuple[str, Any], op: str) -> tuple[Column, Column]:
    """(passes, incomparable): only the column's reading as the literal's kind is worked out; passes is null for other cells."""
    by = {"==": lambda x, y: x == y, "!=": lambda x, y: x != y, ">": lambda x, y: x > y, ">=": lambda x, y: x >= y, "<": lambda x, y: x < y, "<=": lambda x, y: x <= y}[op]
    kind, value = literal
    if a.known and a.known != kind:
        return F.lit(None).cast("boolean"), F.lit(True)
    mine = {"number": a.number, "date": a.date, "string": a.string}[kind]
    y = F.lit(str(value)).cast("decimal(38,10)") if kind == "number" else F.lit(value)
    if a.known:
        return by(mine, y), F.lit(False)
    return F.when(a.kind == kind, by(mine, y)), a.kind != kind


def predicate(df: DataFrame, name: str, dtype: str, op: str, value: Any = None) -> tuple[Column, Column]:
    """(keep, incomparable) of a column of df, whose text columns have been read, against a plan's value."""
    c = q(name)
    never = F.lit(False)
    if op not in OPS:
        raise ValueError(f"unknown filter {op!r}; there are {', '.join(OPS)}")
    if op == "is_empty":
        return P.blank(c), never
    if op == "not_empty":
        return ~P.blank(c), never
    if op == "contains":
        return F.lower(P.text(c)).contains(str(value).lower()), never
    side = _Side(c, dtype, name)
    if op in ("in", "not_in"):
        hit = F.lit(False)
        for v in _literals(df, list(value)):
            hit = hit | F.coalesce(_compare(side, v, "==")[0], never)
        return (hit if op == "in" else ~hit), never
    if op in ("between", "not_between"):
        low, high = _literals(df, list(value))
        (a, bad_a), (b, bad_b) = _compare(side, low, ">="), _compare(side, high, "<=")
        bad = bad_a | bad_b
        inside = a & b
        return F.when(bad, False).otherwise(inside if op == "between" else ~inside), bad
    out, bad = _compare(side, _literals(df, [value])[0], op)
    if op in ("==", "!="):
        return F.coalesce(out, F.lit(op == "!=")), never
    return F.coalesce(out, never), bad


def filter_rows(df: DataFrame, filters: list[dict[str, Any]]) -> Result:
    """Rows that pass all filters, and n_in, n_out, n_dropped, removed_k, incomparable_k in one pass over the input."""
    dtypes, names = dict(df.dtypes), [find(df, f["column"]) for f in filters]
    compared = [n for n, f in zip(names, filters, strict=True) if f["op"] not in ("is_empty", "not_empty", "contains") and not _typed(dtypes[n])]
    rows = _read(df, list(dict.fromkeys(compared)))
    tests = [predicate(rows, n, dtypes[n], f["op"], f.get("value")) for n, f in zip(names, filters, strict=True)]
    flags = [c.alias(f"__{kind}{k}") for k, pair in enumerate(tests) for kind, c in zip(("ok", "bad"), pair, strict=True)]
    keep, aggs = F.lit(True), [F.count("*").alias("n_in")]
    for k in range(len(tests)):
        ok, bad = F.col(f"__ok{k}"), F.col(f"__bad{k}")
        aggs += [F.count_if(keep & ~ok).alias(f"removed_{k}"), F.count_if(keep & bad).alias(f"incomparable_{k}")]
        keep = keep & ok
    report = rows.select(F.lit(1).alias("__one"), *flags).agg(*aggs, F.count_if(keep).alias("n_out")).withColumn("n_dropped", F.col("n_in") - F.col("n_out"))
    passed = rows.where(P.all_of([ok for ok, _ in tests])) if tests else rows
    return Result(passed.select(*(q(c) for c in df.columns)), report)


MATCHES = ("eq", "ne", "in", "not_in", "contains", "blank", "nonblank", "gt", "ge", "lt", "le")


def matches(c: Column, op: str, value: Any = None) -> Column:
    """The conversion's filters: equality in exact case, numeric ones false where either side isn't a number."""
    s = P.text(c)
    if op in ("eq", "ne"):
        return (s == str(value)) if op == "eq" else (s != str(value))
    if op in ("in", "not_in"):
        hit = s.isin([str(v) for v in value])
        return hit if op == "in" else ~hit
    if op == "contains":
        return F.lower(s).contains(str(value).lower())
    if op in ("blank", "nonblank"):
        return (s == "") if op == "blank" else (s != "")
    if op in ("gt", "ge", "lt", "le"):
        a, b = P.amount(c), P.amount(F.lit(str(value)))
        return F.coalesce({"gt": a > b, "ge": a >= b, "lt": a < b, "le": a <= b}[op], F.lit(False))
    raise ValueError(f"unknown filter {op!r}; there are {', '.join(MATCHES)}")
