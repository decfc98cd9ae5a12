"""The published plan format, put into this engine's terms, so that existing plans run as they are.

Published plans name skills ``data-...``, columns ``*_col``, mappings as an object of targets with ``from``,
and one output file. Plans already in the engine's terms come back unchanged.
"""

from __future__ import annotations

import os
from typing import Any

_OPERATION_KEYS = {"column": "value", "date_col": "date", "id_col": "id", "rows_col": "rows", "cols_col": "columns", "aggfunc": "how", "func": "how"}
_OPTION_KEYS = {"tol": "tolerance", "date_window": "date_window_days"}
_NUMERIC_OPTIONS = ("tolerance", "material", "escalate")


def _filters(items: list[dict[str, Any]]) -> list[dict[str, Any]]:
    return [{("column" if k == "col" else k): v for k, v in f.items()} for f in items]


def _operation(op: dict[str, Any]) -> dict[str, Any]:
    out = {_OPERATION_KEYS.get(k, k): v for k, v in op.items()}
    if isinstance(out.get("k"), str):
        out["k"] = float(out["k"])
    if out.get("op") == "filter_rows":
        out["filters"] = _filters(out.get("filters", []))
    if isinstance(out.get("on"), str):
        out["on"] = [out["on"]]
    if out.get("op") == "compare_series" and "left" in op:
        side = lambda o: {_OPERATION_KEYS.get(k, k): v for k, v in o.items()}
        out |= side(op["left"]) | {"other": side(op.get("right", {}))}
    elif out.get("op") == "compare_series":
        out |= {"value": op.get("a_value", out.get("value")), "other": {"value": op.get("b_value", out.get("value"))}}
    return out


def conversion(spec: dict[str, Any]) -> dict[str, Any]:
    """A conversion spec with its mapping as a list, contract, reshape, lookups, rates and output."""
    if isinstance(spec.get("map"), list):
        return spec
    target, rules = spec.get("target", {}), spec.get("rules", {})
    lookups: dict[str, str] = {}
    entries = []
    for name, e in spec.get("map", {}).items():
        entry = {k: v for k, v in e.items() if k not in ("from", "map_values", "table", "key", "value", "on_date")} | {"target": name}
        source = e.get("from")
        if isinstance(source, list):
            entry |= {"sources": source, "source": source[0]}
        elif source is not None:
            entry["source"] = source
        if e.get("compute") == "lookup":
            if "map_values" in e:
                entry["map"] = e["map_values"]
            else:
                lookups[name] = e["table"]
                entry["lookup"] = {"table": name, "key": e.get("key", "key"), "value": e.get("value", "value")}
        entries.append(entry)
    missing = rules.get("on_missing_required", "flag")
    contract = [{**c, "on_missing": missing} for c in target.get("columns", [])]
    out = {"map": entries, "contract": contract, "filter": _filters(spec.get("filter", [])), "on_unmapped_source": rules.get("on_unmapped_source", "report"), "lookups": lookups}
    steps = [s for s in spec.get("reshape", []) if s["op"] in ("unpivot", "pivot", "flatten")]
    output = {k: target[k] for k in ("format", "delimiter", "encoding", "header") if k in target}
    if target.get("format") == "fixedwidth":
        output["columns"] = target.get("columns", [])
    for s in spec.get("reshape", []):
        if s["op"] == "split":
            output["split_by"] = s["by"]
        elif s["op"] == "nest":
            output["nest"] = {"keys": s["key_cols"], "into": s["into"], "children": s["child_cols"]}
        elif s["op"] == "union":
            out["union"] = s.get("how", "outer")
    out |= {"reshape": steps, "output": output}
    if spec.get("source", {}).get("expected_columns"):
        out["fingerprint"] = {"columns": spec["source"]["expected_columns"]}
    if spec.get("source", {}).get("tidy_recipe") and spec["source"].get("clean_with_tidy"):
        out["tidy"] = recipe(spec["source"]["tidy_recipe"])
    dated = next((e["on_date"] for e in spec.get("map", {}).values() if e.get("on_date")), None)
    fx = spec.get("fx")
    if fx:
        out["fx"] = {"rates": fx, "date_column": dated} if dated and not {"rate", "rates"} & set(fx) else fx
    return out


def recipe(r: dict[str, Any]) -> dict[str, Any]:
    """A tidy recipe with names, expected currencies, dedup keys and rule columns in the engine's terms."""
    names = {"target": "name", "currency": "expected_currency", "code_target": "code_name"}
    out = {k: v for k, v in r.items() if k not in ("drop", "dedup_keys", "validate", "columns")}
    out["columns"] = [{names.get(k, k): v for k, v in c.items()} for c in r.get("columns", [])]
    if "drop" in r:
        out |= {"drop_blank_rows": r["drop"].get("blank", True), "drop_total_rows": r["drop"].get("totals", True)}
    if r.get("dedup_keys"):
        out["dedup"] = {"keys": r["dedup_keys"], "fuzzy": True}
    if r.get("validate"):
        out["validate"] = [{("column" if k == "col" else k): v for k, v in x.items()} for x in r["validate"]]
    return out


def fields(items: list[dict[str, Any]]) -> list[dict[str, Any]]:
    names = {"currency": "expected_currency", "code_target": "code_name"}
    out = []
    for f in items:
        labels = f.get("labels")
        g = {names.get(k, k): v for k, v in f.items() if k != "labels"}
        out.append(g | ({"label": labels[0], "aliases": labels[1:]} if labels else {}))
    return out


def _blocks(dashboard: dict[str, Any]) -> list[dict[str, Any]]:
    out = []
    for b in dashboard.get("blocks", []):
        if b.get("type") == "kpi_row":
            out += [{"type": "kpi"} | item for item in b.get("items", [])]
        elif b.get("rows") == "$source":
            out.append({k: v for k, v in b.items() if k != "rows"} | {"source": 0})
        else:
            out.append(b)
    return out


def normalised(plan: dict[str, Any]) -> dict[str, Any]:
    """The plan in the engine's terms."""
    skill = str(plan.get("skill", ""))
    if not skill.startswith("data-"):
        return plan
    out = dict(plan) | {"skill": skill.removeprefix("data-")}
    if "input" in out:
        out["inputs"] = out.pop("input") if isinstance(out["input"], list) else [out.pop("input")]
    if isinstance(out.get("output"), str):
        out["output"] = {"folder": os.path.dirname(out["output"]), "file": os.path.basename(out["output"])}
    kind = out["skill"]
    if kind == "analyse":
        out["operations"] = [_operation(o) for o in plan.get("operations", [])]
    elif kind == "reconcile":
        o = {_OPTION_KEYS.get(k, k): v for k, v in plan.get("options", {}).items()}
        out["preset"] = o.pop("preset", plan.get("preset"))
        if out["preset"] is None:
            del out["preset"]
        if o.pop("aggregate", False):
            out["aggregate"] = {"group": [c for c in (o.get("group_col"), o.get("party_col")) if c]}
            accepted = plan.get("accepted_aggregations", plan.get("accepted"))
            if accepted is not None:
                out["aggregate"]["accepted"] = accepted
        balance = {x: {"opening": float(o[f"opening_{x}"]), "closing": float(o[f"closing_{x}"])} for x in "ab" if o.get(f"opening_{x}") is not None and o.get(f"closing_{x}") is not None}
        if balance:
            out["balance"] = balance
        for k in ("group_col", "party_col", "opening_a", "closing_a", "opening_b", "closing_b"):
            o.pop(k, None)
        o |= {k: plan[k] for k in ("a_label", "b_label") if k in plan}
        out["options"] = o | {k: float(o[k]) for k in _NUMERIC_OPTIONS if isinstance(o.get(k), str)}
    elif kind == "convert" and isinstance(plan.get("spec"), dict):
        out["spec"] = conversion(plan["spec"])
        if out["spec"].get("union"):
            out["union"] = out["spec"]["union"]
    elif kind == "tidy":
        out["recipe"] = recipe(plan.get("recipe", {}))
    elif kind == "extract":
        if "fields" in plan:
            out["fields"] = fields(plan["fields"])
        if plan.get("recipe"):
            out["recipe"] = recipe(plan["recipe"])
    elif kind == "visualise" and "dashboard" in plan:
        out |= {"title": plan["dashboard"].get("title", "Dashboard"), "blocks": _blocks(plan["dashboard"])}
    return out
