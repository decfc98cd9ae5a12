"""Results, row identity and column resolution."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RID = "_rid"


@dataclass
class Result:
    """A frame with its coverage report; ``report`` is a one-row frame, ``extra`` holds side frames such as flags."""

    df: DataFrame
    report: DataFrame | None = None
    extra: dict[str, DataFrame] = field(default_factory=dict)

    def coverage(self) -> dict[str, Any]:
        return self.report.first().asDict() if self.report is not None else {}


def with_rid(df: DataFrame) -> DataFrame:
    """df with a row id that follows the order of the source; kept if it is there already."""
    return df if RID in df.columns else df.withColumn(RID, F.monotonically_increasing_id())


def values(df: DataFrame) -> list[str]:
    """Columns that hold data."""
    return [c for c in df.columns if c != RID]


def q(name: str) -> Column:
    """A column by its exact name, dots and blanks included."""
    return F.col("`" + name.replace("`", "``") + "`")


def find(df: DataFrame, name: str) -> str:
    """The column of that name in any case; an unknown name raises with the names there are."""
    want = str(name).strip().lower()
    for c in values(df):
        if c.strip().lower() == want:
            return c
    raise KeyError(f"no column {name!r}; there are {', '.join(values(df))}")


def find_loose(df: DataFrame, name: str) -> str | None:
    """Exact, then any case, then a unique column that contains the name; else None."""
    names = values(df)
    if name in names:
        return name
    want = str(name).strip().lower()
    same = [c for c in names if c.strip().lower() == want]
    if same:
        return same[0]
    part = [c for c in names if want and want in c.strip().lower()]
    return part[0] if len(part) == 1 else None


def find_side(df: DataFrame, name: str | None) -> str | None:
    """Exact, then a unique match in any case; else None, and the cells are missing."""
    if not name:
        return None
    names = values(df)
    if name in names:
        return name
    same = [c for c in names if c.strip().lower() == str(name).strip().lower()]
    return same[0] if len(same) == 1 else None
