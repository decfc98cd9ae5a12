"""Union, split, long and wide shapes, nesting and flattening."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import parsing as P
from .common import RID, find, q, values, with_rid


def union(frames: list[DataFrame], how: str = "outer") -> DataFrame:
    """All rows: with all columns, filled with empty text, or with the shared ones in the first frame's order."""
    if how == "inner":
        shared = [c for c in values(frames[0]) if all(c in f.columns for f in frames)]
        frames = [f.select(*(q(c) for c in shared)) for f in frames]
    elif how != "outer":
        raise ValueError("how is outer or inner")
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out.fillna("")


def unpivot(df: DataFrame, ids: list[str], columns: list[str], var: str = "variable", value: str = "value") -> DataFrame:
    """Wide to long, cells as text."""
    ids, columns = ([find(df, c) for c in names] for names in (ids, columns))
    return df.select(*(q(c) for c in ids), *(q(c).cast("string").alias(c) for c in columns)).unpivot([q(c) for c in ids], [q(c) for c in columns], var, value)


def pivot_wide(df: DataFrame, index: list[str], var: str, value: str, how: str = "first", variants: list[str] | None = None) -> DataFrame:
    """Long to wide, variants in order; first in row order or sum. Missing cells are empty text."""
    df = with_rid(df)
    index, var, value = [find(df, c) for c in index], find(df, var), find(df, value)
    agg = F.min_by(q(value).cast("string"), RID) if how == "first" else F.sum(P.amount(q(value))).cast("string")
    grouped = df.groupBy(*(q(c) for c in index)).pivot(var, variants) if variants else df.groupBy(*(q(c) for c in index)).pivot(var)
    return grouped.agg(agg).fillna("")


def nest(df: DataFrame, keys: list[str], into: str, children: list[str]) -> DataFrame:
    """One row a key with its children as an array of structs, in row order."""
    df = with_rid(df)
    keys, children = ([find(df, c) for c in names] for names in (keys, children))
    row = F.struct(F.col(RID), F.struct(*(q(c).alias(c) for c in children)).alias("child"))
    return df.groupBy(*(q(c) for c in keys)).agg(F.min(RID).alias(RID), F.transform(F.array_sort(F.collect_list(row)), lambda x: x["child"]).alias(into)).orderBy(RID).drop(RID)


def split(df: DataFrame, by: str, keys: list[str] | None = None) -> dict[str, DataFrame]:
    """A filtered frame for each value. For many values write with ``partitionBy`` instead."""
    name = find(df, by)
    keys = keys or [r.k for r in df.select(P.text(q(name)).alias("k")).distinct().orderBy("k").limit(1001).collect()]
    if len(keys) > 1000:
        raise ValueError("more than 1000 values to split by; write partitioned instead")
    return {k: df.where(P.text(q(name)) == k) for k in keys}


def flatten(df: DataFrame, sep: str = ".", positions: int = 0) -> DataFrame:
    """Nested structs as columns named by their path; of arrays the first ``positions`` elements, or all as JSON text."""
    while True:
        out, again = [], False
        for f in df.schema.fields:
            if isinstance(f.dataType, T.StructType):
                out += [F.col(f"`{f.name}`").getField(x).alias(f"{f.name}{sep}{x}") for x in f.dataType.names]
                again = True
            elif isinstance(f.dataType, T.ArrayType):
                if positions:
                    out += [F.get(q(f.name), F.lit(i)).alias(f"{f.name}{sep}{i}") for i in range(positions)]
                    again = again or not isinstance(f.dataType.elementType, (T.StringType, T.NumericType))
                else:
                    out.append(F.to_json(q(f.name)).alias(f.name))
            else:
                out.append(q(f.name))
        df = df.select(*out)
        if not again:
            return df


def flatten_json(df: DataFrame, column: str, paths: list[str]) -> DataFrame:
    """df with a column for each dotted path into a column of JSON text; list positions are segments."""
    import re

    name = find(df, column)
    jsonpath = lambda p: "$." + re.sub(r"\.(\d+)(?=\.|$)", r"[\1]", p)
    return df.withColumns({p: F.get_json_object(q(name), jsonpath(p)) for p in paths})


def reshaped(df: DataFrame, steps: list[dict[str, Any]]) -> DataFrame:
    """Reshape steps in order: unpivot, pivot, flatten."""
    for s in steps:
        op = s.get("op") or next(iter(s))
        o = s if "op" in s else s[op]
        if op == "unpivot":
            df = unpivot(df, o["id_cols"], o["value_cols"], o.get("var_name", "variable"), o.get("value_name", "value"))
        elif op == "pivot":
            df = pivot_wide(df, o["index_cols"], o["var_col"], o["value_col"], o.get("agg", "first"))
        elif op == "flatten":
            df = flatten(df, o.get("sep", "."), o.get("positions", 0))
        else:
            raise ValueError(f"unknown reshape step {op!r}")
    return df
