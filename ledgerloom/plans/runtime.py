"""JSON plans: validate, dry-run, approve and run.

A plan is {"version": 1, "skill": ..., "inputs": [...], "approval": {...}, ...}. Validation is static but for
the inputs' schemas. Dry runs build every frame and write nothing. Runs need a confirmed approval; conversions
whose source has drifted, and group ties, need a receipt signed over the plan's and the sources' hashes.
"""

from __future__ import annotations

import hashlib
import hmac
import json
import os
from dataclasses import dataclass, fields
from decimal import Decimal
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import analyse as N
from ..operators import convert as C
from ..operators import extract as E
from ..operators import filters as L
from ..operators import joins as J
from ..operators import present as V
from ..operators import reconcile as R
from ..operators import reshape as S
from ..operators import tidy as T
from ..operators.common import RID, Result, values
from ..sources import readers, sinks
from . import dialect

SKILLS = ("analyse", "reconcile", "convert", "tidy", "extract", "visualise")
#: Rows of a result that go into the envelope.
RESULT_ROWS = 1000


class PlanError(ValueError):
    """A plan that can't be run; ``pointer`` says where."""

    def __init__(self, message: str, pointer: str = ""):
        super().__init__(message)
        self.pointer = pointer


@dataclass
class Table:
    df: DataFrame
    note: str
    path: str


def plain(v: Any) -> Any:
    """JSON-ready: decimals and dates as text."""
    if isinstance(v, Decimal):
        return format(v, "f")
    if isinstance(v, dict):
        return {str(k): plain(x) for k, x in v.items()}
    if isinstance(v, (list, tuple)):
        return [plain(x) for x in v]
    return v.isoformat() if hasattr(v, "isoformat") else v


def read_table(spark: SparkSession, source: dict[str, Any] | str, base: str = "") -> Table:
    source = {"path": source} if isinstance(source, str) else source
    path = source["path"]
    path = path if os.path.isabs(path) or "://" in path else os.path.join(base, path)
    options = {k: source[k] for k in ("json_path",) if k in source}
    if "header_row" in source and path.endswith((".csv", ".tsv")):
        options["header_row"] = source["header_row"]
    return Table(readers.read_any(spark, path, source.get("sheet"), **options), os.path.basename(path), path)


def inspect(spark: SparkSession, source: dict[str, Any] | str, base: str = "", sample: int = 5) -> dict[str, Any]:
    t = read_table(spark, source, base)
    return {"path": t.path, "rows": t.df.count(), "columns": values(t.df), "sample": [plain({k: v for k, v in r.asDict(True).items() if k != RID}) for r in t.df.limit(sample).collect()]}


# ---- schemas: the subset of JSON Schema that plans need --------------------------------------------------

_NAME, _LIST = {"type": "string"}, {"type": "array"}
SCHEMAS: dict[str, dict[str, Any]] = {
    "analyse": {"type": "object", "required": ["operations"], "properties": {"operations": {"type": "array", "minItems": 1, "items": {"type": "object", "required": ["op"], "properties": {"op": {"enum": []}}}}}},
    "reconcile": {"type": "object", "properties": {"options": {"type": "object", "properties": {"mode": {"enum": ["key", "amount_date"]}, "tolerance": {"type": "number"}, "date_window_days": {"type": "integer"}}}, "preset": {"enum": list(R.PRESETS)}}},
    "convert": {"type": "object", "required": ["spec"], "properties": {"spec": {"type": "object", "required": ["map"], "properties": {"map": {"type": "array", "minItems": 1, "items": {"type": "object", "required": ["target"], "properties": {"target": _NAME, "type": {"enum": ["text", "number", "currency", "date"]}, "compute": {"enum": ["as_is", "debit_minus_credit", "sum", "concat", "fx_convert", "lookup"]}}}}, "contract": _LIST}}}},
    "tidy": {"type": "object", "required": ["recipe"], "properties": {"recipe": {"type": "object", "required": ["columns"], "properties": {"columns": {"type": "array", "minItems": 1, "items": {"type": "object", "properties": {"type": {"enum": ["text", "number", "currency", "date", "bool", "categorical", "ordinal"]}}}}}}}},
    "extract": {"type": "object", "properties": {"fields": {"type": "array", "items": {"type": "object", "required": ["name"], "properties": {"type": {"enum": ["text", "number", "currency", "date", "bool"]}}}}}},
    "visualise": {"type": "object", "required": ["blocks"], "properties": {"blocks": {"type": "array", "minItems": 1, "items": {"type": "object", "required": ["type"]}}}},
}
_TYPES = {"object": dict, "array": list, "string": str, "number": (int, float), "integer": int, "boolean": bool}


def schema_errors(value: Any, schema: dict[str, Any], at: str = "") -> list[dict[str, str]]:
    """Breaches of a schema with their JSON pointers."""
    out: list[dict[str, str]] = []
    kind = schema.get("type")
    if kind and (not isinstance(value, _TYPES[kind]) or (kind in ("number", "integer") and isinstance(value, bool))):
        return [{"pointer": at or "/", "error": f"is not of type {kind}"}]
    if schema.get("enum") and value not in schema["enum"]:
        out.append({"pointer": at or "/", "error": f"{value!r} is not one of {', '.join(map(str, schema['enum']))}"})
    if isinstance(value, dict):
        out += [{"pointer": f"{at}/{k}", "error": "is required"} for k in schema.get("required", []) if k not in value]
        for k, s in schema.get("properties", {}).items():
            if k in value:
                out += schema_errors(value[k], s, f"{at}/{k}")
    if isinstance(value, list):
        if len(value) < schema.get("minItems", 0):
            out.append({"pointer": at or "/", "error": f"has fewer than {schema['minItems']} items"})
        for i, x in enumerate(value):
            out += schema_errors(x, schema.get("items", {}), f"{at}/{i}")
    return out


# ---- hashes and approvals ---------------------------------------------------------------------------------


def canonical_hash(value: Any) -> str:
    return hashlib.sha256(json.dumps(plain(value), sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode()).hexdigest()


def source_hash(spark: SparkSession, path: str) -> str:
    """A hash of a source's bytes: of its files' hashes, read where the files are."""
    parts = spark.read.format("binaryFile").load(path).select("path", F.sha2("content", 256).alias("h")).orderBy("path").collect()
    return hashlib.sha256("".join(p.h for p in parts).encode()).hexdigest()


def approval_request(spark: SparkSession, plan: dict[str, Any], base: str = "") -> dict[str, Any]:
    plan = dialect.normalised(plan)
    body = {k: v for k, v in plan.items() if k != "approval"}
    return {"plan": canonical_hash(body), "sources": {i: source_hash(spark, read_table(spark, s, base).path) for i, s in enumerate(inputs(plan))}}


def sign(request: dict[str, Any], key: str, approver: str) -> dict[str, Any]:
    body = {"request": request, "approver": approver}
    return body | {"signature": hmac.new(key.encode(), canonical_hash(body).encode(), "sha256").hexdigest()}


def verified(receipt: dict[str, Any] | None, request: dict[str, Any], key: str) -> bool:
    """Whether a receipt is signed with the key and for exactly this plan and these sources."""
    if not receipt or canonical_hash(receipt.get("request")) != canonical_hash(request):
        return False
    body = {"request": receipt["request"], "approver": receipt.get("approver")}
    return hmac.compare_digest(receipt.get("signature", ""), hmac.new(key.encode(), canonical_hash(body).encode(), "sha256").hexdigest())


# ---- plans -------------------------------------------------------------------------------------------------


def load_plan(path: str) -> dict[str, Any]:
    with open(path, encoding="utf-8") as f:
        text = f.read()
    if path.endswith(".md"):
        import re

        block = re.search(r"```(?:json)?\s*\n(.*?)```", text, re.S)
        if not block:
            raise PlanError("the card has no fenced JSON block")
        text = block[1]
    plan = json.loads(text)
    if not isinstance(plan, dict):
        raise PlanError("a plan is a JSON object")
    return plan


def inputs(plan: dict[str, Any]) -> list[Any]:
    one = plan.get("inputs", plan.get("input", []))
    return one if isinstance(one, list) else [one]


def validate_plan(spark: SparkSession | None, plan: dict[str, Any], base: str = "") -> list[dict[str, str]]:
    """Everything wrong with a plan; with a session also whether its sources can be read."""
    plan = dialect.normalised(plan)
    out: list[dict[str, str]] = []
    if plan.get("version") != 1:
        out.append({"pointer": "/version", "error": "must be 1"})
    skill = plan.get("skill")
    if skill not in SKILLS:
        return [*out, {"pointer": "/skill", "error": f"must be one of {', '.join(SKILLS)}"}]
    schema = SCHEMAS[skill]
    if skill == "analyse":
        schema = json.loads(json.dumps(schema))
        schema["properties"]["operations"]["items"]["properties"]["op"]["enum"] = list(OPERATIONS)
    out += schema_errors(plan, schema)
    n = len(inputs(plan))
    if skill == "reconcile":
        if n != 2:
            out.append({"pointer": "/inputs", "error": "reconcile takes two inputs"})
        o = plan.get("options", {})
        if o.get("mode") == "amount_date" and not (o.get("amount") and o.get("date")):
            out.append({"pointer": "/options", "error": "amount_date needs amount and date"})
    elif n == 0 and skill != "visualise":
        out.append({"pointer": "/inputs", "error": "an input is required"})
    if skill == "convert" and n > 1 and plan.get("union") not in ("outer", "inner"):
        out.append({"pointer": "/union", "error": "several inputs need union: outer or inner"})
    for i, op in enumerate(plan.get("operations", []) if skill == "analyse" else []):
        if isinstance(op, dict) and op.get("op") == "join_on" and n < 2:
            out.append({"pointer": f"/operations/{i}", "error": "join_on needs two inputs"})
    if spark is not None and not out:
        for i, s in enumerate(inputs(plan)):
            try:
                read_table(spark, s, base).df.limit(1).collect()
            except Exception as e:
                out.append({"pointer": f"/inputs/{i}", "error": f"can't be read: {str(e)[:200]}"})
    return out


def _shown(r: Result | DataFrame) -> dict[str, Any]:
    r = r if isinstance(r, Result) else Result(r)
    out: dict[str, Any] = {"rows": [plain({k: v for k, v in x.asDict(True).items() if k != RID}) for x in r.df.limit(RESULT_ROWS).collect()]}
    if r.report is not None:
        out["report"] = plain(r.coverage())
    return out


def _period(d: DataFrame, o: dict) -> DataFrame:
    return N.period_series(d, o["date"], o.get("value"), o.get("grain", "month"), o.get("dayfirst", True)).df


def _measure(o: dict) -> str:
    return "total" if o.get("value") else "count"


# Each takes the current frame, the operation's options and the plan's other frames.
OPERATIONS = {
    "profile": lambda d, o, _: Result(d.sparkSession.createDataFrame([(c["column"], c["type"], c["n"], c["missing"], c["distinct"]) for c in T.profile(d)], "column string, type string, n long, missing long, distinct long")),
    "quality": lambda d, o, _: Result(d.sparkSession.createDataFrame([(float(q["score"]), q["grade"]) for q in [T.score_quality(d)]], "score double, grade string")),
    "filter_rows": lambda d, o, _: L.filter_rows(d, o["filters"]),
    "numeric_summary": lambda d, o, _: N.numeric_summary(d, o["value"]),
    "outliers_iqr": lambda d, o, _: N.outliers_iqr(d, o["value"], o.get("k", 1.5), o.get("cap", 10)),
    "breakdown": lambda d, o, _: N.breakdown(d, o["by"], o.get("value"), o.get("top", 10)),
    "concentration": lambda d, o, _: N.concentration(N.group_totals(d, o["by"], o.get("value")), "total" if o.get("value") else "count", o.get("top_n", 4)),
    "gini": lambda d, o, _: N.gini(N.group_totals(d, o["by"], o["value"]).select("total") if o.get("by") else d, "total" if o.get("by") else o["value"]),
    "distribution": lambda d, o, _: N.distribution(d, o["value"], o.get("by")),
    "percentile": lambda d, o, _: N.percentile(d, o["value"], o["q"] if isinstance(o["q"], list) else [o["q"]], o.get("by")),
    "correlation_matrix": lambda d, o, _: N.correlation_matrix(d, o["columns"]),
    "period_series": lambda d, o, _: N.period_series(d, o["date"], o.get("value"), o.get("grain", "month"), o.get("dayfirst", True), o.get("fill", "zero")),
    "trend": lambda d, o, _: N.trend(_period(d, o), value=_measure(o)),
    "rolling": lambda d, o, _: N.rolling(_period(d, o), value=_measure(o), window=o.get("window", 3), how=o.get("how", "mean")),
    "compare_series": lambda d, o, more: N.compare_series(_period(d, o), _period(more[1] if len(more) > 1 else d, o | o.get("other", {})), value=_measure(o)),
    "seasonality": lambda d, o, _: N.seasonality(d, o["date"], o.get("value"), o.get("grain", "month"), o.get("dayfirst", True)),
    "ageing": lambda d, o, _: N.ageing(d, o["date"], o["as_of"], tuple(o.get("buckets", (30, 60, 90))), o.get("value")),
    "cohort": lambda d, o, _: N.cohort(d, o["id"], o["date"], o.get("value"), o.get("grain", "month")),
    "pivot": lambda d, o, _: N.pivot(d, o["rows"], o["columns"], o.get("value"), o.get("how", "sum")),
    "histogram": lambda d, o, _: N.histogram(d, o["value"], o.get("bins", 10)),
    "currency_mix": lambda d, o, _: N.currency_mix(d, o["value"]),
    "join_on": lambda d, o, more: J.join_on(d, more[1], o["on"], o.get("how", "inner")),
}


def _out(plan: dict, base: str, name: str) -> str:
    folder = plan.get("output", {}).get("folder", "") if isinstance(plan.get("output"), dict) else ""
    folder = folder if os.path.isabs(folder) else os.path.join(base, folder)
    os.makedirs(folder or ".", exist_ok=True)
    return os.path.join(folder, name)


def _file(plan: dict, name: str) -> str:
    output = plan.get("output")
    return output.get("file", name) if isinstance(output, dict) else name


def _run_analyse(spark, plan, base, dry):
    frames = [read_table(spark, s, base).df for s in inputs(plan)]
    now, results = frames[0], []
    for op in plan["operations"]:
        got = OPERATIONS[op["op"]](now, op, frames)
        if op["op"] == "filter_rows":  # later operations see the filtered rows
            now = got.df
            results.append({"op": "filter_rows", "report": plain(got.coverage())})
        else:
            results.append({"op": op["op"]} | _shown(got))
    payload = {"sources": [s if isinstance(s, str) else s["path"] for s in inputs(plan)], "results": results}
    files = []
    if not dry:
        files = [_out(plan, base, _file(plan, "analysis.json"))]
        with open(files[0], "w", encoding="utf-8") as f:
            json.dump(payload, f, ensure_ascii=False, indent=2)
    return payload, files


def options(plan: dict) -> R.Options:
    known = {f.name for f in fields(R.Options)}
    given = R.PRESETS.get(plan.get("preset"), {}) | plan.get("options", {})
    unknown = set(given) - known
    if unknown:
        raise PlanError(f"unknown options: {', '.join(sorted(unknown))}", "/options")
    return R.Options(**given)


def _check_accepted(spark, plan, base, proposals, accepted) -> None:
    """The accepted list must name different proposals by number, and a receipt must be signed for the plan that holds it."""
    numbers = isinstance(accepted, list) and all(isinstance(i, int) and not isinstance(i, bool) and 0 <= i < len(proposals) for i in accepted)
    if not numbers or len(set(accepted)) != len(accepted) or any(proposals[i]["kind"] == "too_many" for i in accepted):
        raise PlanError("accepted must list different proposals by number", "/aggregate/accepted")
    key = os.environ.get("LEDGERLOOM_APPROVAL_KEY", "")
    if not key or not verified(plan.get("approval", {}).get("receipt"), approval_request(spark, plan, base), key):
        raise PlanError("accepted proposals, none included, need a signed approval", "/approval/receipt")


def _run_reconcile(spark, plan, base, dry):
    a, b = (T.numbered(readers_rid(read_table(spark, s, base).df)) for s in inputs(plan))
    o = options(plan)
    got = R.result(a, b, o)
    proposals, taken = [], 0
    if plan.get("aggregate"):
        g = plan["aggregate"]
        left = [R.unmatched(df, got.df, s) for df, s in ((a, "a"), (b, "b"))]
        frame = R.propose_aggregations(*left, g.get("group_a", g.get("group")), g.get("group_b", g.get("group")), o, candidates=g.get("candidates", 60))
        proposals = [plain(r.asDict(True)) for r in frame.collect()]
        accepted = g.get("accepted")
        if proposals and accepted is not None:
            _check_accepted(spark, plan, base, proposals, accepted)
            chosen = spark.createDataFrame([(proposals[i]["a_ids"], proposals[i]["b_ids"]) for i in accepted], "a_ids array<long>, b_ids array<long>")
            got.df = R.apply_aggregations(got.df, chosen)
            taken = got.df.where("bucket = 'matched_agg'").count()
            got.extra["exceptions"] = R.triage(got.df, o)
    exceptions = got.extra["exceptions"]
    summary = R.summarise(got.df, exceptions, taken)
    potential = J.amount_potential(R.items(a, o), "amt", R.items(b, o, o.flip_b), "amt").first().asDict()
    payload = {"summary": plain(summary), "warning": R.absurd_warning(potential, summary["matched"]), "exceptions": _shown(exceptions)["rows"]}
    if proposals:
        payload["proposals"] = proposals
        payload["moved_items"] = taken
    for side, df in (("a", a), ("b", b)):
        limits = plan.get("balance", {}).get(side)
        if limits:
            payload[f"balance_{side}"] = plain(R.check_balance(df, o.amount, limits["opening"], limits["closing"]).first().asDict())
    files = []
    if not dry:
        files = [_out(plan, base, _file(plan, "workpaper.xlsx"))]
        flat = lambda df: sinks._rows(df)
        sinks.write_workbook({"Summary": (["item", "value"], [[k, json.dumps(plain(v))] for k, v in summary.items()]), "Exceptions": flat(exceptions), "Matched": flat(got.df.where("bucket = 'matched'"))}, files[0])
    return payload, files


def readers_rid(df: DataFrame) -> DataFrame:
    from ..operators.common import with_rid

    return with_rid(df)


def _run_convert(spark, plan, base, dry):
    tables = [read_table(spark, s, base) for s in inputs(plan)]
    spec = plan["spec"] if isinstance(plan["spec"], dict) else dialect.conversion(load_plan(os.path.join(base, plan["spec"])))
    df = tables[0].df if len(tables) == 1 else readers_rid(S.union([t.df.drop(RID) for t in tables], plan["union"]))
    drift = C.sense_check(values(df), spec, plan.get("as_of"))
    if any(d["severity"] == "error" for d in drift):
        raise PlanError("; ".join(f"{d['column']}: {d['reason']}" for d in drift if d["severity"] == "error"), "/spec/map")
    if drift and not dry:
        key = os.environ.get("LEDGERLOOM_APPROVAL_KEY", "")
        if not key or not verified(plan.get("approval", {}).get("receipt"), approval_request(spark, plan, base), key):
            raise PlanError("the source has drifted; a signed approval is needed: " + "; ".join(f"{d['column']}: {d['reason']}" for d in drift), "/approval/receipt")
    lookups = {k: read_table(spark, v, base).df for k, v in spec.get("lookups", {}).items()}
    if spec.get("tidy"):
        df = T.apply_recipe(df, spec["tidy"]).df
    got = C.convert(df, spec, lookups)
    contract = C.check_contract(values(df), spec)
    issues = [plain(r.asDict()) for r in got.extra["issues"].limit(RESULT_ROWS).collect()]
    broken = [plain(r.asDict()) for r in got.extra["validators"].collect()]
    payload = {"drift": drift, "contract": contract, "issues": issues, "validators": broken, "report": plain(got.coverage()), "sample": _shown(got.df.limit(5))["rows"]}
    if any(x["severity"] == "error" for x in [*contract, *issues]):
        raise PlanError("errors block the output: " + json.dumps([x for x in [*contract, *issues] if x["severity"] == "error"][:5]), "/spec")
    files = [] if dry else sinks.write_output(got.df, spec.get("output", {}), _out(plan, base, plan.get("output", {}).get("file", "converted." + spec.get("output", {}).get("format", "csv"))))
    return payload, files


def _run_tidy(spark, plan, base, dry):
    source, recipe = inputs(plan)[0], plan["recipe"]
    if recipe.get("header_row") is not None and isinstance(source, dict):
        source = source | {"header_row": recipe["header_row"]}
    elif recipe.get("header_row") is not None:
        source = {"path": source, "header_row": recipe["header_row"]}
    masters = {k: read_table(spark, v, base).df for k, v in plan.get("masters", {}).items()}
    got = T.apply_recipe(read_table(spark, source, base).df, recipe, masters)
    payload = {k: [plain(r.asDict()) for r in v.limit(RESULT_ROWS).collect()] for k, v in got.extra.items()} | {"report": plain(got.coverage()), "rows": got.df.count()}
    files = []
    if not dry:
        files = [_out(plan, base, _file(plan, "tidy.xlsx")), _out(plan, base, os.path.splitext(_file(plan, "tidy.xlsx"))[0] + ".report.md")]
        sinks.write_xlsx(got.df, files[0])
        with open(files[1], "w", encoding="utf-8") as f:
            f.write("\n\n".join(f"## {k}\n\n{V.markdown(v) if v else 'none'}" for k, v in payload.items() if isinstance(v, list)))
    return payload, files


def _run_extract(spark, plan, base, dry):
    if "fields" in plan:
        paths = [p if os.path.isabs(p) or "://" in p else os.path.join(base, p) for p in (s if isinstance(s, str) else s["path"] for s in inputs(plan))]
        docs = spark.read.text(paths, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("text"))
        got = E.extract_fields(docs, plan["fields"])
    else:
        got = Result(read_table(spark, inputs(plan)[0], base).df)
        if plan.get("recipe"):
            got = T.apply_recipe(got.df, plan["recipe"])
    payload = _shown(got) | {"flags": [plain(r.asDict()) for r in got.extra["flags"].limit(RESULT_ROWS).collect()] if "flags" in got.extra else []}
    files = []
    if not dry:
        files = [_out(plan, base, _file(plan, "extracted.xlsx"))]
        sinks.write_xlsx(got.df, files[0])
    return payload, files


def _block(b: dict[str, Any], results: list[dict], sources: list[list[dict]]) -> str:
    rows = sources[b["source"]] if "source" in b else results[b["result"]]["rows"] if "result" in b else b.get("rows", [])
    pick = lambda k: [r.get(b[k]) for r in rows] if k in b else []
    title, kind = b.get("title", ""), b["type"]
    if kind == "kpi":
        return V.kpi(b["label"], b["value"], b.get("status"))
    if kind == "table":
        return V.table(rows, b.get("columns"), b.get("rag"))
    if kind == "line":
        return V.line(title, pick("x"), {y: [r.get(y) for r in rows] for y in (b["y"] if isinstance(b["y"], list) else [b["y"]])})
    if kind in ("heatmap", "stacked"):
        return {"heatmap": V.heatmap, "stacked": V.stacked}[kind](title, [(r.get(b["x"]), r.get(b["series"]), r.get(b["y"])) for r in rows])
    if kind == "waterfall":
        return V.waterfall(title, [(r.get(b["x"]), r.get(b["y"]), r.get(b.get("kind", "kind"), "delta")) for r in rows])
    if kind == "scatter":
        return V.scatter(title, [(r.get(b["x"]), r.get(b["y"])) for r in rows])
    if kind == "histogram":
        return V.histogram(title, [(r["low"], r["high"], r["count"]) for r in rows])
    if kind == "sparkline":
        return V.sparkline(title, pick("y"))
    if kind in ("bar", "donut"):
        return {"bar": V.bar, "donut": V.donut}[kind](title, pick("x"), pick("y"))
    raise PlanError(f"unknown block {kind!r}", "/blocks")


def _run_visualise(spark, plan, base, dry):
    results: list[dict] = []
    if plan.get("analysis"):
        with open(os.path.join(base, plan["analysis"]), encoding="utf-8") as f:
            results = json.load(f)["results"]
    elif plan.get("operations"):
        results = _run_analyse(spark, plan, base, True)[0]["results"]
    used = {b["source"] for b in plan["blocks"] if "source" in b}
    sources = [V.rows_of(read_table(spark, s, base).df.drop(RID)) if i in used else [] for i, s in enumerate(inputs(plan))]
    text = V.page(plan.get("title", "Dashboard"), [_block(b, results, sources) for b in plan["blocks"]])
    files = []
    if not dry:
        files = [_out(plan, base, _file(plan, "dashboard.html"))]
        with open(files[0], "w", encoding="utf-8") as f:
            f.write(text)
    return {"bytes": len(text)}, files


RUNNERS = {"analyse": _run_analyse, "reconcile": _run_reconcile, "convert": _run_convert, "tidy": _run_tidy, "extract": _run_extract, "visualise": _run_visualise}


def run_plan(spark: SparkSession, plan: dict[str, Any], base: str = "", dry: bool = False) -> dict[str, Any]:
    """The envelope of a run: status ok, dry_run, invalid, needs_approval or error, with result and files."""
    plan = dialect.normalised(plan)
    envelope = lambda status, **more: {"status": status, "skill": plan.get("skill"), "plan": canonical_hash({k: v for k, v in plan.items() if k != "approval"})} | more
    errors = validate_plan(spark, plan, base)
    if errors:
        return envelope("invalid", errors=errors)
    if not dry and not plan.get("approval", {}).get("confirmed"):
        return envelope("needs_approval", errors=[{"pointer": "/approval/confirmed", "error": "must be true to run; dry-run needs none"}])
    try:
        result, files = RUNNERS[plan["skill"]](spark, plan, base, dry)
    except PlanError as e:
        return envelope("error", errors=[{"pointer": e.pointer, "error": str(e)}])
    except Exception as e:
        return envelope("error", errors=[{"pointer": "", "error": f"{type(e).__name__}: {str(e)[:500]}"}])
    return envelope("dry_run" if dry else "ok", result=plain(result), files=files)
