"""Labelled fields out of documents, as a frame of one row a document."""

from __future__ import annotations

import re
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import parsing as P
from ..functions.texts import cleaned_value
from .common import Result

#: Lines after a label in which its value is looked for.
AHEAD = 3


def _label(label: str) -> str:
    return r"\s+".join(re.escape(w) for w in label.split())


def _value(text: Column, spec: dict[str, Any], labels: list[str]) -> Column:
    """The first hit of: after a colon or tab, after a dotted leader, after two blanks, on one of the next lines that isn't a label."""
    names = [spec.get("label") or spec["name"], *spec.get("aliases", [])]
    any_label = "|".join(_label(x) for x in labels)
    tries = []
    for name in names:
        head = rf"(?im)^[ \t|]*{_label(name)}"
        tries += [
            F.regexp_extract(text, rf"{head}[ \t]*[:\t|][ \t]*(\S[^\n]*)$", 1),
            F.regexp_extract(text, rf"{head}[ \t]*[.…_]{{3,}}[ \t]*(\S[^\n]*)$", 1),
            F.regexp_extract(text, rf"{head}[ \t]{{2,}}(\S[^\n]*)$", 1),
            F.regexp_extract(text, rf"{head}[ \t]*:?[ \t]*\n(?:[ \t]*\n){{0,{AHEAD - 1}}}[ \t]*(?!(?:{any_label})\b)(\S[^\n]*)$", 1),
        ]
    return cleaned_value(F.coalesce(*(F.when(t != "", t) for t in tries), F.lit("")))


def extract_fields(docs: DataFrame, fields: list[dict[str, Any]], path: str = "path", text: str = "text") -> Result:
    """path and the fields of every document, converted by type; extra['flags'] lists path, column, value, reason of what is
    missing or didn't convert. Fields that aren't found are empty, never guessed."""
    labels = [x for f in fields for x in [f.get("label") or f["name"], *f.get("aliases", [])]]
    out: list[Column] = [F.col(path)]
    flags: list[Column] = []
    for f in fields:
        found, kind = _value(F.regexp_replace(F.col(text), "\r\n?", "\n"), f, labels), f.get("type", "text")
        conv = P.converted(found, kind, None, f.get("expected_currency"))
        note = F.when(found == "", F.lit("not found" if f.get("required") else "")).otherwise(conv["note"])
        flags.append(F.when(note != "", F.struct(F.lit(f["name"]).alias("column"), found.alias("value"), note.alias("reason"))))
        out.append((found if kind == "text" else conv["value"]).alias(f["name"]))
        if kind != "text":
            out.append(conv["raw"].alias(f"{f['name']}__raw"))
        if kind == "currency":
            out.append(conv["code"].alias(f.get("code_name", f"{f['name']} Currency")))
    wide = docs.select(*out, F.filter(F.array(*flags), lambda x: x.isNotNull()).alias("_flags"))
    return Result(wide.drop("_flags"), wide.agg(F.count("*").alias("n_documents")), {"flags": wide.select(F.col(path), F.inline("_flags"))})
