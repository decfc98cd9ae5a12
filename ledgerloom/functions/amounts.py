"""Periods, rounding, money display and small rules as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Tax rates looked for in amount gaps, decimal places of currencies without cents, grade bounds.
TAX_RATES = ["0.05", "0.07", "0.08", "0.09", "0.10", "0.15", "0.20"]
NO_CENTS = ["JPY", "KRW"]
GRADES = [(95, "A"), (85, "B"), (70, "C"), (50, "D")]
_STRFTIME = {"%d": "dd", "%m": "MM", "%Y": "yyyy", "%y": "yy", "%b": "MMM", "%B": "MMMM", "%H": "HH", "%M": "mm", "%S": "ss", "%a": "EEE", "%A": "EEEE", "%j": "DDD"}


def period_key(d: Column, grain: str) -> Column:
    if grain == "year":
        return F.date_format(d, "yyyy")
    if grain == "quarter":
        return F.concat(F.date_format(d, "yyyy"), F.lit("-Q"), F.quarter(d).cast("string"))
    if grain == "month":
        return F.date_format(d, "yyyy-MM")
    raise ValueError(f"grain must be month, quarter or year, not {grain!r}")


def period_start(d: Column, grain: str) -> Column:
    return F.trunc(d, grain)


def months(grain: str) -> int:
    return {"month": 1, "quarter": 3, "year": 12}[grain]


def periods_between(a: Column, b: Column, grain: str) -> Column:
    """Whole periods from date a to date b."""
    n = lambda d: F.year(d) * 12 + F.month(d) - 1
    step = months(grain)
    return F.floor(n(b) / step).cast("int") - F.floor(n(a) / step).cast("int")


def date_pattern(strftime: str) -> str:
    """A strftime pattern as a pattern of date_format."""
    out, i = "", 0
    while i < len(strftime):
        if strftime[i] == "%":
            out += _STRFTIME.get(strftime[i : i + 2], "")
            i += 2
        else:
            out += f"'{strftime[i]}'" if strftime[i].isalpha() else strftime[i]
            i += 1
    return out


def rounded(c: Column, places: int) -> Column:
    """Half to even."""
    return F.bround(c, places)


def money(c: Column, code: Column) -> Column:
    return F.when(code.isin(NO_CENTS), F.format_number(F.bround(c, 0), 0)).otherwise(F.format_number(F.bround(c, 2), 2))


def percent(c: Column, places: int = 1) -> Column:
    return F.concat(F.format_number(c * 100, places), F.lit("%"))


def tax_hint(a: Column, b: Column) -> Column:
    """A note where the gap is a usual tax rate of the smaller amount."""
    low, high = F.least(F.abs(a), F.abs(b)), F.greatest(F.abs(a), F.abs(b))
    ratio = F.try_divide(high - low, low)
    cases = [F.when(F.abs(ratio - F.lit(r).cast("decimal(10,4)")) <= F.lit("0.001").cast("decimal(10,4)"), F.lit(f"difference is {float(r) * 100:.0f}% of the smaller side: possible GST/VAT/WHT (net against gross)")) for r in TAX_RATES]
    return F.when((a != 0) & (b != 0), F.coalesce(*cases))


def materiality(v: Column, material: float, escalate: float) -> Column:
    size = F.abs(F.coalesce(v, F.lit(0)))
    return F.when(size >= escalate, "escalate").when(size >= material, "material").otherwise("immaterial")


def grade(percent_: Column) -> Column:
    out = F.lit("F")
    for least, name in reversed(GRADES):
        out = F.when(percent_ >= least, name).otherwise(out)
    return out


def currency_relation(a: Column, b: Column, strict: bool = False) -> Column:
    return F.when(a.isNotNull() & b.isNotNull(), F.when(a == b, "ok").otherwise("mismatch")).otherwise("unknown" if strict else "ok")
