"""Tidying by recipe, deduplication, validation, profile, quality score and value clusters."""

from __future__ import annotations

from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import amounts as A
from ..functions import parsing as P
from ..functions import texts as X
from ..session import checkpointed
from .common import RID, Result, find, find_loose, q, values, with_rid
from .joins import small

FLAG = "`row` long, `column` string, value string, reason string"


def numbered(df: DataFrame, into: str = "row", order: str = RID) -> DataFrame:
    """df with dense row numbers from 1 in row order, by partition offsets: no single task sees all rows. The partitions are
    kept: read again, the range could be cut elsewhere, and offsets of other partitions lose or misnumber rows."""
    parts = checkpointed(df.repartitionByRange(order).sortWithinPartitions(order).withColumn("_p", F.spark_partition_id()))
    sizes = parts.groupBy("_p").agg(F.count("*").alias("_s"), F.min(order).alias("_low"))
    offsets = sizes.select("_p", (F.sum("_s").over(Window.orderBy("_low")) - F.col("_s")).alias("_o"))
    nth = F.row_number().over(Window.partitionBy("_p").orderBy(order))
    return parts.withColumn(into, nth.cast("long")).join(F.broadcast(offsets), "_p").withColumn(into, F.col(into) + F.col("_o")).drop("_p", "_o")


def without_blank_and_total_rows(df: DataFrame, blanks: bool = True, totals: bool = True) -> Result:
    """Rows left, and counts of blank and total rows dropped."""
    cells = [q(c) for c in values(df)]
    blank = P.all_of([P.blank(c) for c in cells])
    total = reduce(lambda a, b: a | b, [X.total_word(c) for c in cells])
    drop = (blank & blanks) | (~blank & total & totals)
    return Result(df.where(~drop), df.agg(F.count_if(blank & blanks).alias("blank_rows"), F.count_if(~blank & total & totals).alias("total_rows")))


def hygiene(c: Column, spec: dict[str, Any]) -> Column:
    out = X.repaired(c) if spec.get("fix_encoding") else c
    if spec.get("strip_specials"):
        out = X.stripped(out, spec["strip_specials"] if isinstance(spec["strip_specials"], str) else None)
    out = X.collapsed(out)
    return X.cased(out, spec["case"]) if spec.get("case") else out


def mapped(c: Column, value_map: dict[str, Any]) -> Column:
    """Canonical values, matched by folded text; maps are {variant: canonical} or {canonical: [variants]}."""
    import unicodedata

    fold = lambda s: "".join(ch for ch in unicodedata.normalize("NFKD", str(s)).lower() if ch.isascii() and ch.isalnum())
    flat = {fold(v): k for k, vs in value_map.items() if isinstance(vs, list) for v in [*vs, k]} | {fold(k): v for k, v in value_map.items() if not isinstance(v, list)}
    if not flat:
        return c
    table = F.create_map(*(F.lit(x) for kv in flat.items() for x in kv))
    return F.coalesce(F.try_element_at(table, X.folded(c)), c)


def apply_recipe(df: DataFrame, recipe: dict[str, Any], masters: dict[str, DataFrame] | None = None) -> Result:
    """Project, rename and convert by recipe; then deduplicate and validate. extra['flags'] lists what didn't convert or
    needs a look; a cell that didn't convert is null in its column and kept in ``<name>__raw``."""
    df = with_rid(df)
    kept = without_blank_and_total_rows(df, recipe.get("drop_blank_rows", True), recipe.get("drop_total_rows", True))
    rows = numbered(kept.df)
    out: list[Column] = [F.col(RID), F.col("row")]
    flags: list[Column] = []
    for spec in recipe["columns"]:
        target, source = spec.get("name") or spec["source"], find_loose(rows, spec.get("source") or spec["name"])
        flag = lambda value, reason, when, target=target: F.when(when, F.struct(F.lit(target).alias("column"), value.alias("value"), reason.alias("reason")))
        if source is None:
            out.append(F.lit("").alias(target))
            flags.append(flag(F.lit(""), F.lit("source column not found"), F.lit(True)))
            continue
        cell, kind = q(source), spec.get("type", "text")
        code = find_loose(rows, spec["code_source"]) if spec.get("code_source") else None
        conv = P.converted(cell, kind, q(code) if code else None, spec.get("expected_currency"), spec.get("dayfirst", recipe.get("dayfirst", True)))
        if kind in ("text", "categorical", "ordinal"):
            value = hygiene(P.text(cell), spec)
            out.append((mapped(value, spec["value_map"]) if spec.get("value_map") else value).alias(target))
        else:
            out += [conv["value"].alias(target), conv["raw"].alias(f"{target}__raw")]
            if kind == "currency":
                out.append(conv["code"].alias(spec.get("code_name", f"{target} Currency")))
            flags.append(flag(P.text(cell), conv["note"], conv["note"] != ""))
        if spec.get("required"):
            flags.append(flag(F.lit(""), F.lit("required value missing"), P.blank(cell)))
    listed = F.filter(F.array(*flags), lambda x: x.isNotNull()) if flags else F.array().cast("array<struct<column:string,value:string,reason:string>>")
    wide = rows.select(*out, listed.alias("_flags"))
    noted = wide.select("row", F.inline("_flags"))
    result = wide.drop("_flags")
    keys = recipe.get("dedup", {}).get("keys") if isinstance(recipe.get("dedup"), dict) else recipe.get("dedup")
    extra = {"flags": noted}
    if keys:
        d = dedup(result, keys, fuzzy=(recipe["dedup"].get("fuzzy", False) if isinstance(recipe["dedup"], dict) else False))
        result, extra["duplicates"] = d.df, d.extra["duplicates"]
    if recipe.get("validate"):
        extra["issues"] = validate(result, recipe["validate"], masters or {})
    return Result(result.drop("row"), kept.report, extra)


def dedup(df: DataFrame, keys: list[str], fuzzy: bool = False) -> Result:
    """First row of each exact key (in row order) stays; extra['duplicates'] lists the dropped, and with fuzzy also the kept rows
    whose folded key an earlier row has in another spelling."""
    df = with_rid(df)
    names = [find(df, k) for k in keys]
    exact = F.concat_ws("\u0001", *(F.coalesce(q(c).cast("string"), F.lit("")) for c in names))
    blank = exact.rlike("^\u0001*$")
    seen = df.withColumn("_key", exact).withColumn("_nth", F.when(blank, 1).otherwise(F.row_number().over(Window.partitionBy("_key").orderBy(RID))))
    first = F.when(~blank, F.min(RID).over(Window.partitionBy("_key")))
    seen = seen.withColumn("_first", first)
    gone = seen.where("_nth > 1").select(F.col(RID).alias("rid"), F.col("_first").alias("of_rid"), F.lit("exact").alias("kind"), F.col("_key").alias("key"))
    kept = seen.where("_nth = 1")
    if fuzzy:
        soft = X.alnum_key(F.concat_ws(" ", *(q(c).cast("string") for c in names)))
        w = Window.partitionBy("_soft").orderBy(RID)
        near = kept.withColumn("_soft", soft).where("_soft <> ''").withColumn("_lead", F.first(RID).over(w))
        gone = gone.unionByName(near.where(F.col("_lead") != F.col(RID)).select(F.col(RID).alias("rid"), F.col("_lead").alias("of_rid"), F.lit("fuzzy").alias("kind"), F.col("_key").alias("key")))
    return Result(kept.drop("_key", "_nth", "_first"), df.agg(F.count("*").alias("n_in")), {"duplicates": gone})


def validate(df: DataFrame, rules: list[dict[str, Any]], masters: dict[str, DataFrame]) -> DataFrame:
    """rid, column, value, reason of every breach: required, regex, in_master, unique."""
    import re

    df = with_rid(df)
    out: list[DataFrame] = []
    for rule in rules:
        name = find_loose(df, rule["column"])
        if name is None:
            out.append(df.limit(1).select(F.lit(None).cast("long").alias("rid"), F.lit(rule["column"]).alias("column"), F.lit("").alias("value"), F.lit("column not found").alias("reason")))
            continue
        issue = lambda rows, reason, name=name: rows.select(F.col(RID).alias("rid"), F.lit(name).alias("column"), P.text(q(name)).alias("value"), F.lit(reason).alias("reason"))
        full = df.where(~P.blank(q(name)))
        if rule.get("required"):
            out.append(issue(df.where(P.blank(q(name))), "required value missing"))
        if rule.get("regex"):
            try:
                re.compile(rule["regex"])
                out.append(issue(full.where(~P.text(q(name)).rlike(rule["regex"])), f"doesn't match {rule['regex']}"))
            except re.error as e:
                out.append(issue(df.limit(1), f"invalid pattern: {e}"))
        if rule.get("in_master"):
            master = masters[rule["in_master"]]
            known = master.select(X.alnum_key(q(values(master)[0])).alias("_m")).distinct()
            out.append(issue(full.join(small(known), X.alnum_key(q(name)) == F.col("_m"), "left_anti"), f"not in {rule['in_master']}"))
        if rule.get("unique"):
            nth = F.row_number().over(Window.partitionBy(X.alnum_key(q(name))).orderBy(RID))
            out.append(issue(full.withColumn("_nth", nth).where("_nth > 1"), "not unique"))
    if not out:
        return df.limit(0).select(F.col(RID).alias("rid"), F.lit("").alias("column"), F.lit("").alias("value"), F.lit("").alias("reason"))
    return reduce(DataFrame.unionByName, out)


def profile(df: DataFrame, samples: int = 4) -> list[dict[str, Any]]:
    """Of every column: type, n, missing, distinct, samples; measured over all rows in one aggregation, collected as one row."""
    df = with_rid(df)
    names = values(df)
    aggs: list[Column] = [F.count("*").alias("n")]
    for i, name in enumerate(names):
        c, s = q(name), P.text(q(name))
        full = s != ""
        low = F.lower(s)
        looks = reduce(lambda a, b: a | b, [F.upper(s).contains(k) for k in [*P.CURRENCIES, "$"]])
        aggs += [
            F.count_if(full).alias(f"full{i}"), F.count_if(full & P.day(c).isNotNull()).alias(f"date{i}"), F.count_if(full & looks & P.amount(c).isNotNull()).alias(f"money{i}"),
            F.count_if(full & P.amount(c).isNotNull()).alias(f"number{i}"), F.count_if(low.isin("yes", "no", "true", "false", "y", "n")).alias(f"bool{i}"),
            F.count_distinct(F.when(full, low)).alias(f"distinct{i}"), F.count_if(full & X.noisy(c.cast("string"))).alias(f"noise{i}"),
        ]
    one = df.agg(*aggs).first().asDict()
    out = []
    few = df.orderBy(RID).limit(200).collect()
    for i, name in enumerate(names):
        full, distinct = one[f"full{i}"], one[f"distinct{i}"]
        share = lambda k, i=i, full=full: one[f"{k}{i}"] / full if full else 0
        kind = "empty" if not full else "date" if share("date") > 0.8 else "currency" if share("money") > 0.5 else "number" if share("number") > 0.8 else "bool" if share("bool") > 0.8 else None
        if kind is None:
            words = {r.w for r in df.select(F.lower(P.text(q(name))).alias("w")).where("w <> ''").distinct().limit(13).collect()} if 2 <= distinct <= 12 else set()
            kind = "ordinal" if words and any(words <= set(s) for s in P.ORDINAL_SCALES) else "categorical" if full >= 8 and 2 <= distinct <= 20 and distinct <= full / 2 else "text"
        shown = list(dict.fromkeys(str(r[name]).strip() for r in few if r[name] is not None and str(r[name]).strip()))[:samples]
        parsed = {"date": "date", "currency": "number", "number": "number", "bool": "bool"}.get(kind)
        out.append({"column": name, "type": kind, "n": one["n"], "missing": one["n"] - full, "distinct": distinct, "samples": shown, "consistency": (one[f"{parsed}{i}"] / full if parsed else 1.0) if full else 1.0, "noise": one[f"noise{i}"]})
    return out


def duplicate_rows(df: DataFrame) -> DataFrame:
    """One row: n, duplicates (rows beyond the first of equal ones)."""
    key = F.sha2(F.concat_ws("|", *(P.text(q(c)) for c in values(df))), 256)
    return df.groupBy(key.alias("k")).agg(F.count("*").alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicates"))


def score_quality(df: DataFrame) -> dict[str, Any]:
    """score (completeness and consistency averaged, less up to 15 for duplicates), grade, issues."""
    columns, dup = profile(df), duplicate_rows(df).first()
    if not columns or not columns[0]["n"]:
        return {"score": 0.0, "grade": "F", "issues": [{"severity": "critical", "column": "", "issue": "no rows"}], "columns": columns}
    complete = sum(1 - c["missing"] / c["n"] for c in columns) / len(columns) * 100
    consistent = sum(c["consistency"] for c in columns) / len(columns) * 100
    penalty = min(15.0, 100 * dup.duplicates / dup.n)
    score = max(0.0, (complete + consistent) / 2 - penalty)
    issues = []
    for c in columns:
        gone = c["missing"] / c["n"]
        if gone > 0.2:
            issues.append({"severity": "critical" if gone > 0.5 else "warn", "column": c["column"], "issue": f"{gone:.0%} missing"})
        if c["consistency"] < 0.9:
            issues.append({"severity": "warn", "column": c["column"], "issue": f"{c['consistency']:.0%} parse as {c['type']}"})
        if c["noise"]:
            issues.append({"severity": "info", "column": c["column"], "issue": f"{c['noise']} cells with stray blanks or encoding marks"})
    grade = next((g for least, g in A.GRADES if score >= least), "F")
    order = {"critical": 0, "warn": 1, "info": 2}
    return {"score": round(score, 1), "grade": grade, "completeness": complete, "consistency": consistent, "duplicates": dup.duplicates, "issues": sorted(issues, key=lambda i: order[i["severity"]]), "columns": columns}


def propose_value_map(df: DataFrame, column: str, master: list[str] | None = None) -> DataFrame:
    """fold, surface, count, canonical of every spelling in clusters of several: the master's spelling, else the most frequent,
    then the longest, then the first in order."""
    name = find(df, column)
    s = df.select(X.collapsed(q(name)).alias("surface")).where("surface <> ''").groupBy("surface").agg(F.count("*").alias("count")).withColumn("fold", X.folded(F.col("surface")))
    master = master or []
    known = F.create_map(*(F.lit(x) for m in master for x in (m, m))) if master else None
    by_fold = F.max(F.when(F.col("surface").isin(master), F.col("surface"))).over(Window.partitionBy("fold")) if known is not None else F.lit(None).cast("string")
    best = F.first("surface").over(Window.partitionBy("fold").orderBy(F.desc("count"), F.desc(F.length("surface")), "surface"))
    spellings = F.count("*").over(Window.partitionBy("fold"))
    return s.select("fold", "surface", "count", F.coalesce(by_fold, best).alias("canonical"), spellings.alias("n")).where("n > 1").drop("n")
