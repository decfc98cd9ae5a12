"""Sinks: delimited, JSON, fixed width, workbook, template order, partitioned fan-out.

Large outputs are written by Spark, in parallel. Single files (a workbook, one CSV) are for results that a
person reads; their rows are bounded by ``SINGLE_FILE_ROWS``.
"""

from __future__ import annotations

import csv
import json
import os
import re
import zipfile
from decimal import Decimal
from typing import Any
from xml.sax.saxutils import escape

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.common import RID, q, values

SINGLE_FILE_ROWS = 1_000_000


def _rows(df: DataFrame) -> tuple[list[str], list[list[Any]]]:
    names = values(df)
    got = (df.orderBy(RID) if RID in df.columns else df).limit(SINGLE_FILE_ROWS + 1).select(*(q(c) for c in names)).collect()
    if len(got) > SINGLE_FILE_ROWS:
        raise ValueError(f"more than {SINGLE_FILE_ROWS} rows for one file; write a folder instead")
    return names, [list(r) for r in got]


def _plain(v: Any) -> Any:
    return format(v, "f") if isinstance(v, Decimal) else v.isoformat() if hasattr(v, "isoformat") else v


def write_csv(df: DataFrame, path: str, sep: str = ",", encoding: str = "utf-8") -> None:
    names, rows = _rows(df)
    with open(path, "w", newline="", encoding=encoding) as f:
        w = csv.writer(f, delimiter=sep)
        w.writerow(names)
        w.writerows([["" if c is None else _plain(c) for c in r] for r in rows])


def write_json(df: DataFrame, path: str, lines: bool = False) -> None:
    """A JSON array (decimals as text), or one record a line."""
    names, rows = _rows(df)
    records = [{n: (v.asDict(True) if hasattr(v, "asDict") else v) for n, v in zip(names, r, strict=True)} for r in rows]
    default = lambda v: v.asDict(True) if hasattr(v, "asDict") else _plain(v) if not isinstance(_plain(v), type(v)) else str(v)
    with open(path, "w", encoding="utf-8") as f:
        f.write("\n".join(json.dumps(r, default=default, ensure_ascii=False) for r in records) if lines else json.dumps(records, default=default, ensure_ascii=False, indent=2))


def write_folder(df: DataFrame, path: str, kind: str = "parquet", partition_by: list[str] | None = None, **options: Any) -> None:
    """In parallel, by partition if asked for."""
    out = df.drop(RID).write.mode("overwrite")
    (out.partitionBy(*partition_by) if partition_by else out).format(kind).options(**options).save(path)


def fixed_width(df: DataFrame, columns: list[dict[str, Any]]) -> DataFrame:
    """One text column ``value``: cells cut or filled to their width, left or right."""
    cells = []
    for c in columns:
        s, w, pad = F.coalesce(q(c["name"]).cast("string"), F.lit("")), int(c["width"]), c.get("pad", " ")
        s = F.substring(s, 1, w)
        cells.append(F.lpad(s, w, pad) if c.get("align", "l").startswith("r") else F.rpad(s, w, pad))
    return df.select(*([RID] if RID in df.columns else []), F.concat(*cells).alias("value"))


def write_fixedwidth(df: DataFrame, path: str, columns: list[dict[str, Any]], header: bool = False) -> None:
    _, rows = _rows(fixed_width(df, columns))
    with open(path, "w", encoding="utf-8") as f:
        if header:
            f.write("".join(str(c["name"])[: c["width"]].ljust(c["width"]) for c in columns) + "\n")
        f.writelines(r[0] + "\n" for r in rows)


def _letters(i: int) -> str:
    out = ""
    i += 1
    while i:
        i, r = divmod(i - 1, 26)
        out = chr(65 + r) + out
    return out


def _sheet(names: list[str], rows: list[list[Any]]) -> str:
    lines = []
    for r, row in enumerate([names, *rows], 1):
        cells = []
        for i, v in enumerate(row):
            ref = f"{_letters(i)}{r}"
            if v is None or v == "":
                continue
            if isinstance(v, (int, float, Decimal)) and not isinstance(v, bool):
                cells.append(f'<c r="{ref}"><v>{_plain(v)}</v></c>')
            else:
                text = re.sub("[\x00-\x08\x0b\x0c\x0e-\x1f]", "", str(_plain(v)))
                cells.append(f'<c r="{ref}" t="inlineStr"><is><t xml:space="preserve">{escape(text)}</t></is></c>')
        lines.append(f'<row r="{r}">{"".join(cells)}</row>')
    return f'<?xml version="1.0" encoding="UTF-8"?><worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData>{"".join(lines)}</sheetData></worksheet>'


def write_workbook(sheets: dict[str, tuple[list[str], list[list[Any]]]], path: str) -> None:
    """A workbook of named sheets of cells; names are made valid and distinct."""
    named: dict[str, tuple] = {}
    for name, content in sheets.items():
        base = re.sub(r"[\[\]:*?/\\]", " ", name)[:31] or "Sheet"
        n, k = base, 1
        while n.lower() in {x.lower() for x in named}:
            k += 1
            n = f"{base[:28]} {k}"
        named[n] = content
    rel = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("[Content_Types].xml", '<?xml version="1.0" encoding="UTF-8"?><Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/>' + "".join(f'<Override PartName="/xl/worksheets/sheet{i}.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/>' for i in range(1, len(named) + 1)) + "</Types>")
        z.writestr("_rels/.rels", f'<?xml version="1.0" encoding="UTF-8"?><Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Type="{rel}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        z.writestr("xl/workbook.xml", f'<?xml version="1.0" encoding="UTF-8"?><workbook xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="{rel}"><sheets>' + "".join(f'<sheet name="{escape(n, {chr(34): "&quot;"})}" sheetId="{i}" r:id="rId{i}"/>' for i, n in enumerate(named, 1)) + "</sheets></workbook>")
        z.writestr("xl/_rels/workbook.xml.rels", '<?xml version="1.0" encoding="UTF-8"?><Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">' + "".join(f'<Relationship Id="rId{i}" Type="{rel}/worksheet" Target="worksheets/sheet{i}.xml"/>' for i in range(1, len(named) + 1)) + "</Relationships>")
        for i, (names, rows) in enumerate(named.values(), 1):
            z.writestr(f"xl/worksheets/sheet{i}.xml", _sheet(names, rows))


def write_xlsx(df: DataFrame, path: str, sheet: str = "Sheet1") -> None:
    write_workbook({sheet: _rows(df)}, path)


def template_order(df: DataFrame, header: list[str]) -> DataFrame:
    """Columns in a template's order; those it lacks go, those that are missing are empty."""
    low = {c.strip().lower(): c for c in values(df)}
    cells = [q(low[h.strip().lower()]).alias(h) if h.strip().lower() in low else F.lit("").alias(h) for h in header]
    return df.select(*([RID] if RID in df.columns else []), *cells)


def file_name(value: Any) -> str:
    return re.sub(r"[^\w.-]+", "_", str(value).strip()) or "blank"


def write_output(df: DataFrame, target: dict[str, Any], path: str) -> list[str]:
    """Write by target spec: template header, split, nest and format. The files written come back."""
    if target.get("template_header"):
        df = template_order(df, target["template_header"])
    if target.get("split_by"):
        from ..operators.reshape import split

        root, ext = os.path.splitext(path)
        out: list[str] = []
        for value, part in split(df, target["split_by"]).items():
            out += write_output(part, {k: v for k, v in target.items() if k not in ("split_by", "template_header")}, f"{root}_{file_name(value)}{ext}")
        return out
    if target.get("nest"):
        from ..operators.reshape import nest

        n = target["nest"]
        df = nest(df, n["keys"], n["into"], n["children"])
    kind = target.get("format", "csv")
    if kind == "csv":
        write_csv(df, path, target.get("delimiter", ","), target.get("encoding", "utf-8"))
    elif kind in ("json", "jsonl"):
        write_json(df, path, kind == "jsonl")
    elif kind == "xlsx":
        write_xlsx(df, path, target.get("sheet", "Sheet1"))
    elif kind == "fixedwidth":
        write_fixedwidth(df, path, target["columns"], target.get("header", False))
    elif kind == "parquet":
        write_folder(df, path, "parquet", target.get("partition_by"))
    else:
        raise ValueError(f"unknown output format {kind!r}")
    return [path]
