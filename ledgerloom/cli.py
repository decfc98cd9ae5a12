"""Command line: inspect, validate, run (with --dry-run), approve, schema."""

from __future__ import annotations

import argparse
import json
import os
import sys

from .plans import runtime
from .session import session


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="ledgerloom")
    sub = p.add_subparsers(dest="command", required=True)
    for name in ("inspect", "validate", "run", "approve"):
        c = sub.add_parser(name)
        c.add_argument("path")
        if name == "run":
            c.add_argument("--dry-run", action="store_true")
        if name == "approve":
            c.add_argument("--approver", required=True)
    sub.add_parser("schema").add_argument("skill", choices=runtime.SKILLS)
    a = p.parse_args(argv)
    if a.command == "schema":
        out = runtime.SCHEMAS[a.skill]
    else:
        spark, base = session(), os.path.dirname(os.path.abspath(a.path))
        if a.command == "inspect":
            out = runtime.inspect(spark, os.path.abspath(a.path))
        else:
            plan = runtime.load_plan(a.path)
            if a.command == "validate":
                out = {"errors": runtime.validate_plan(spark, plan, base)}
            elif a.command == "run":
                out = runtime.run_plan(spark, plan, base, a.dry_run)
            else:
                out = runtime.sign(runtime.approval_request(spark, plan, base), os.environ["LEDGERLOOM_APPROVAL_KEY"], a.approver)
    print(json.dumps(out, ensure_ascii=False, indent=2))
    return int(bool(out.get("errors")) if isinstance(out, dict) else 0)


if __name__ == "__main__":
    sys.exit(main())
