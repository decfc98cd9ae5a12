"""Conversion onto target contracts: mapping, required policy, validators, drift."""

from __future__ import annotations

from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import amounts as A
from ..functions import parsing as P
from ..functions import texts as X
from . import joins
from .common import RID, Result, find_loose, find_side, q, values, with_rid
from .filters import matches
from .reshape import reshaped


def _cell(df: DataFrame, name: str) -> Column:
    found = find_side(df, name)
    return q(found).cast("string") if found else F.lit("")


def field(df: DataFrame, spec: dict[str, Any], fx: dict[str, Any] | None = None) -> Column:
    """The value of one mapping entry as text: const, or source columns by ``compute``, then its type's format."""
    sources = spec.get("sources") or ([spec["source"]] if spec.get("source") else [])
    cells = [_cell(df, s) for s in sources]
    number = lambda c: F.coalesce(P.amount(c), F.lit(0).cast(P.AMOUNT))
    how = spec.get("compute", "as_is")
    if "const" in spec:
        out = F.lit(str(spec["const"]))
    elif how == "debit_minus_credit":
        out = (number(cells[0]) - number(cells[1])).cast("string")
    elif how == "sum":
        out = reduce(lambda a, b: a + b, [number(c) for c in cells]).cast("string")
    elif how == "concat":
        out = F.concat_ws(spec.get("sep", " "), *(P.text(c) for c in cells))
    elif how == "fx_convert":
        rate = spec.get("rate", (fx or {}).get("rate"))
        used = F.col("_fx") if "_fx" in df.columns else F.lit(str(rate)).cast("decimal(28,10)") if rate is not None else None
        if used is None:
            raise ValueError(f"no rate is pinned for {spec['target']}")
        out = (P.amount(cells[0]) * used).cast("decimal(38,10)").cast("string")
    elif how == "lookup":
        if "map" not in spec:
            out = F.col(f"_lookup_{spec['target']}")
        else:
            table = F.create_map(*(F.lit(str(x)) for kv in spec["map"].items() for x in kv))
            other = {"keep": P.text(cells[0]), "blank": F.lit("")}.get(spec.get("on_missing", "keep"), F.raise_error(F.concat(F.lit("no lookup value for "), P.text(cells[0]))).cast("string"))
            out = F.coalesce(F.try_element_at(table, P.text(cells[0])), other)
    elif how == "as_is":
        out = cells[0] if cells else F.lit("")
    else:
        raise ValueError(f"unknown compute {how!r}")
    kind = spec.get("type", "text")
    if kind in ("number", "currency"):
        places = spec.get("dp", spec.get("decimals"))
        value = P.amount(out)
        return F.coalesce((F.bround(value, places).cast(f"decimal(38,{places})") if places is not None else value).cast("string"), P.text(out))
    if kind == "date":
        return F.coalesce(F.date_format(P.day(out), A.date_pattern(spec.get("format", "%d %b %Y"))), P.text(out))
    return P.text(out)


def apply_map(df: DataFrame, mapping: list[dict[str, Any]], fx: dict[str, Any] | None = None, lookups: dict[str, DataFrame] | None = None) -> DataFrame:
    """The target columns, in the mapping's order, and the row id."""
    df = with_rid(df)
    if fx and fx.get("rates"):
        rates = df.sparkSession.createDataFrame([(str(k), str(v)) for k, v in fx["rates"].items()], "as_of string, rate string")
        df = joins.asof_rate(df, P.day(_cell(df, fx["date_column"])), rates, into="_fx")
    for spec in mapping:
        if spec.get("compute") == "lookup" and "map" not in spec:
            ref = spec["lookup"]
            df = joins.lookup(df, spec["source"], (lookups or {})[ref["table"]], ref["key"], ref["value"], f"_lookup_{spec['target']}", spec.get("on_missing", "keep"))
    return df.select(F.col(RID), *(field(df, s, fx).alias(s["target"]) for s in mapping))


def apply_required(rows: DataFrame, contract: list[dict[str, Any]]) -> Result:
    """Required columns by policy: flag, exclude, error or blank. extra['issues'] lists rid, column, severity, reason."""
    drop, issues = F.lit(False), []
    for c in contract:
        if not c.get("required") or c["name"] not in rows.columns:
            continue
        gone, policy = P.blank(q(c["name"])), c.get("on_missing", "flag")
        if policy == "exclude":
            drop = drop | gone
        if policy != "blank":
            severity = "error" if policy == "error" else "warn"
            issues.append(F.when(gone, F.struct(F.lit(c["name"]).alias("column"), F.lit(severity).alias("severity"), F.lit(f"required value missing ({policy})").alias("reason"))))
    kind = "array<struct<column:string,severity:string,reason:string>>"
    noted = rows.select(F.col(RID).alias("rid"), F.inline(F.filter(F.array(*issues), lambda x: x.isNotNull()) if issues else F.array().cast(kind)))
    return Result(rows.where(~drop), rows.agg(F.count("*").alias("n_in"), F.count_if(drop).alias("n_excluded")), {"issues": noted})


def validators(rows: DataFrame, contract: list[dict[str, Any]]) -> DataFrame:
    """column, rule, count, example: one row for each broken rule (allowed, pattern, max_len, iban, bic), in one aggregation."""
    rows = with_rid(rows)
    rules: list[tuple[str, str, Column]] = []
    for c in contract:
        if c["name"] not in rows.columns:
            continue
        s = P.text(q(c["name"]))
        full = s != ""
        if c.get("allowed"):
            rules.append((c["name"], "allowed", full & ~s.isin([str(x) for x in c["allowed"]])))
        if c.get("pattern"):
            rules.append((c["name"], "pattern", full & ~s.rlike(c["pattern"])))
        if c.get("max_len"):
            rules.append((c["name"], "max_len", full & (F.length(s) > c["max_len"])))
        for check, valid in (("iban", X.valid_iban), ("bic", X.valid_bic)):
            if c.get("check") == check or c.get(check):
                rules.append((c["name"], check, full & ~valid(s)))
    if not rules:
        return rows.limit(0).select(F.lit("").alias("column"), F.lit("").alias("rule"), F.lit(0).cast("long").alias("count"), F.lit("").alias("example"))
    aggs = [a for i, (name, _, bad) in enumerate(rules) for a in (F.count_if(bad).alias(f"n{i}"), F.min_by(P.text(q(name)), F.when(bad, F.col(RID))).alias(f"x{i}"))]
    cells = [F.struct(F.lit(n).alias("column"), F.lit(r).alias("rule"), F.col(f"n{i}").alias("count"), F.col(f"x{i}").alias("example")) for i, (n, r, _) in enumerate(rules)]
    return rows.agg(*aggs).select(F.inline(F.array(*cells))).where("count > 0")


def check_contract(columns: list[str], spec: dict[str, Any]) -> list[dict[str, str]]:
    """Plan-time findings: required targets without a mapping (error), source columns that nothing uses."""
    mapped = {m["target"] for m in spec["map"]}
    used = {str(s).strip().lower() for m in spec["map"] for s in (m.get("sources") or [m.get("source")]) if s}
    out = [{"severity": "error", "column": c["name"], "reason": "required target isn't mapped"} for c in spec.get("contract", []) if c.get("required") and c["name"] not in mapped]
    rule = spec.get("on_unmapped_source", "report")
    return out + [{"severity": "error" if rule == "error" else "info", "column": c, "reason": "source column isn't used"} for c in columns if c.strip().lower() not in used]


def sense_check(columns: list[str], spec: dict[str, Any], as_of: str | None = None) -> list[dict[str, str]]:
    """Plan-time drift against the fingerprint of the first run: mapped columns missing (error), new or gone columns, old rates."""
    low = {c.strip().lower() for c in columns}
    needed = {str(s) for m in spec["map"] for s in (m.get("sources") or [m.get("source")]) if s}
    out = [{"severity": "error", "column": c, "reason": "mapped column is missing"} for c in sorted(needed) if c.strip().lower() not in low]
    before = spec.get("fingerprint", {}).get("columns")
    if before:
        known = {c.strip().lower() for c in before}
        out += [{"severity": "warn", "column": c, "reason": "new column"} for c in columns if c.strip().lower() not in known]
        out += [{"severity": "warn", "column": c, "reason": "column is gone"} for c in before if c.strip().lower() not in low]
    pinned = spec.get("fx", {}).get("as_of")
    if pinned and as_of and pinned < as_of:
        out.append({"severity": "warn", "column": "", "reason": f"the pinned rate is of {pinned}"})
    return out


def convert(df: DataFrame, spec: dict[str, Any], lookups: dict[str, DataFrame] | None = None) -> Result:
    """Filter, reshape, map, apply the required policy and validate. An issue of severity error blocks writing."""
    rows = with_rid(df)
    for f in spec.get("filter", []):
        name = find_loose(rows, f["column"])
        if name is None:
            raise KeyError(f"no column {f['column']!r} to filter by; there are {', '.join(values(rows))}")
        rows = rows.where(matches(q(name), f["op"], f.get("value")))
    rows = reshaped(rows, spec.get("reshape", []))
    mapped = apply_map(rows, spec["map"], spec.get("fx"), lookups)
    done = apply_required(mapped, spec.get("contract", []))
    done.extra["validators"] = validators(done.df, spec.get("contract", []))
    return done
