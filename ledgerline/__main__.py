"""Command line: builds the tables of a folder of logs, or reads built ones, and prints a report."""

from __future__ import annotations

import argparse
import sys
from datetime import datetime

OVER_BUDGET = DRIFT = 4
NO_LOGS = 3


def parsed(argv: list[str]) -> argparse.Namespace:
    p = argparse.ArgumentParser("ledgerline")
    p.add_argument("command", choices=["summary", "daily", "weekly", "monthly", "skills", "models", "projects", "top", "search", "budget", "statusline", "verify", "refresh"])
    p.add_argument("argument", nargs="?", help="query of search, dollars of budget, days or sessions of top")
    p.add_argument("--logs", help="folder of log files")
    p.add_argument("--tables", help="folder of built tables; refresh writes them, the others read them")
    p.add_argument("--source", default="main")
    p.add_argument("--provider", choices=["a", "b"], default="a", help="whose log files: entries, or counters")
    for name in ("last", "month", "since", "until"):
        p.add_argument(f"--{name}")
    p.add_argument("--limit", type=int)
    p.add_argument("--sort", choices=["cost", "count", "name", "date"])
    p.add_argument("--json", action="store_true")
    p.add_argument("--csv")
    return p.parse_args(argv)


def run(spark, a: argparse.Namespace) -> int:
    from ledgerline.functions.periods import named_range, resolve
    from ledgerline.operators.verify import drifted
    from ledgerline.plans import commands as cmd
    from ledgerline.plans import counter_tables, tables
    from ledgerline.sources import sinks

    now = datetime.now()
    start, end = resolve(now, a.last, a.month, a.since, a.until)
    build = counter_tables.build if a.provider == "b" else tables.build
    if a.command == "refresh":
        tables.write(build(spark, a.logs), a.tables, a.source)
        return 0
    t = tables.load(spark, a.tables, a.source) if a.tables else build(spark, a.logs)
    by = {"count": {"models": "requests", "projects": "sessions", "skills": "runs"}.get(a.command), "name": "name"}.get(a.sort, "cost_usd")
    code = 0
    if a.command in cmd.PERIODS:
        out = cmd.periods(t, cmd.PERIODS[a.command], start, end, a.limit, "cost" if a.sort == "cost" else "date")
    elif a.command in ("skills", "models", "projects"):
        out = getattr(cmd, a.command)(t, start, end, a.limit, by)
    elif a.command == "top":
        out = (cmd.top_days if a.argument == "days" else cmd.top_sessions)(t, start, end, a.limit or 10)
    elif a.command == "search":
        out = cmd.search(t, a.argument or "", a.limit or 20)
    elif a.command == "budget":
        out = cmd.budget(t, float(a.argument), start, end)
        code = OVER_BUDGET if out.first()["over_budget"] else 0
    elif a.command == "verify":
        if t.lines.isEmpty():
            return NO_LOGS
        out, found = cmd.verify(t)
        code = DRIFT if drifted(found) else 0
    elif a.command == "statusline":
        out = cmd.statusline(t, *((start, end) if start or end else named_range("today", now)))
    else:
        out = cmd.summary(t, start, end)
    if a.csv:
        sinks.write_csv(out, a.csv)
    else:
        print(sinks.report_json(out) if a.json else sinks.report_table(out))
    return code


def main() -> int:
    from pyspark.sql import SparkSession

    spark = SparkSession.builder.appName("ledgerline").getOrCreate()
    return run(spark, parsed(sys.argv[1:]))


if __name__ == "__main__":
    sys.exit(main())
