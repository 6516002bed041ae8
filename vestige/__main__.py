"""The command line: a collection's folder to a run's folder."""

from __future__ import annotations

import argparse
from collections.abc import Sequence
from pathlib import Path

from vestige.operators.rules import RuleSet
from vestige.session import session, ship
from vestige.sources import evidence, events, loading, sinks


def arguments() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser("vestige", description="Reads a collection and writes its exports, case, report and manifest.")
    p.add_argument("--evidence", help="the collection's folder")
    p.add_argument("--output", help="the folder that gets a folder for this run")
    p.add_argument("--run-id", help="the run folder's name; by default the time")
    p.add_argument("--security", action="store_true", help="read the Security log too")
    p.add_argument("--rule-set", help="a rule file in place of the built-in rules")
    p.add_argument("--profile", default="general", help="the profile whose weights count")
    p.add_argument("--exports", help="the exports to write, comma-separated; by default all")
    p.add_argument("--list-rules", action="store_true", help="print the rules and stop")
    p.add_argument("--list-sources", action="store_true", help="print what is read from event logs and stop")
    return p


def main(given: Sequence[str] | None = None) -> str | None:
    p = arguments()
    a = p.parse_args(given)
    rules = RuleSet.from_json(Path(a.rule_set).read_text()) if a.rule_set else RuleSet()
    if a.list_rules:
        print(*sinks.rule_lines(rules, a.profile), sep="\n")
        return None
    if a.list_sources:
        print(*(f"{r.id}: {r.kind}: {r.meaning}" for r in events.RULES), *(f"{c}:{e}: not read: {why}" for (c, e), why in events.EXCLUDED.items()), sep="\n")
        return None
    if not a.evidence or not a.output:
        p.error("--evidence and --output are needed")
    names = a.exports.split(",") if a.exports else tuple(sinks.EXPORTS)
    if unknown := set(names) - set(sinks.EXPORTS):
        p.error(f"no such exports: {', '.join(sorted(unknown))}")
    evidence.Boundary(a.evidence).refuse_write(a.output)
    spark = session("vestige")
    ship(spark)
    case = loading.load(spark, a.evidence, events.OPT_IN if a.security else (), rules, a.profile)
    try:
        tables = (*loading.TABLES, *rules.rows(a.profile))
        folder = sinks.run_case(spark, case, tables, a.output, Path(a.evidence).name, a.run_id, names, lambda: case.collection.account(case.table("source")))
    finally:
        case.close()
    print(folder)
    return folder


if __name__ == "__main__":
    main()
