"""python -m gristmill.cli COMMAND PATH ..."""

from __future__ import annotations

import argparse
import sys
import time
from pathlib import Path

from gristmill.operators import coverage, duplication, report, snapshot, stats
from gristmill.operators.thresholds import focus
from gristmill.plans.analysis import Analysis
from gristmill.session import session
from gristmill.sources import config
from gristmill.sources.discovery import files

STATE = ".gristmill-shrink.toml"


def _arguments(argv: list[str]) -> argparse.Namespace:
    top = argparse.ArgumentParser("gristmill")
    sub = top.add_subparsers(dest="command", required=True)
    for name in ("check", "stats", "dry", "mimic", "clamp", "rules", "config", "shrink-start", "shrink-check", "viz", "show-tests"):
        p = sub.add_parser(name)
        p.add_argument("path", nargs="?", default=".")
        p.add_argument("--lang", choices=config.LANGUAGES)
        p.add_argument("--config")
        p.add_argument("--ignore", action="append", default=[])
        p.add_argument("--focus")
        p.add_argument("--all", action="store_true")
        p.add_argument("--top", type=int)
        p.add_argument("--wide", action="store_true")
        p.add_argument("--filter")
        p.add_argument("--out")
        p.add_argument("--target")
        p.add_argument("--zoom", type=float, default=1.0)
        p.add_argument("--untested", action="store_true")
        p.add_argument("--timing", action="store_true")
    return top.parse_args(argv)


def _show(df) -> None:
    """Reports are for reading: rows come one partition at a time."""
    print("  ".join(df.columns))
    for row in df.toLocalIterator():
        print("  ".join("" if v is None else str(v) for v in row))


def main(argv: list[str] | None = None) -> int:
    args = _arguments(sys.argv[1:] if argv is None else argv)
    began = time.time()
    found = config.config_files(args.path, args.config)
    limits = config.load_thresholds(found, (args.lang,) if args.lang else config.LANGUAGES)
    if args.command == "rules":
        gate = config.load_gate(found)
        print("\n".join([*config.DEFINITIONS, *(line for lang in limits for line in config.rules(limits, lang, gate))]))
        return 0
    if args.command == "config":
        gate = config.load_gate(found)
        print("# Effective configuration\n\n[gate]")
        print(f"test_coverage_threshold = {gate.coverage}\nmin_similarity = {gate.min_similarity:.2f}\nduplication_enabled = {str(gate.duplication_enabled).lower()}")
        for lang, x in limits.items():
            print("\n".join(["", f"[{lang}]", *(f"{m} = {v}" for m, v in x.items() if v is not None)]))
        return 0
    spark = session()
    table = files(spark, args.path, tuple(args.ignore), args.lang)
    if table.isEmpty():
        print("No source files found.")
        return 0
    a = Analysis(table, limits, config.load_gate(found))
    code = _run(args, a)
    if args.timing:
        print(f"{args.command}: {time.time() - began:.1f} s", file=sys.stderr)
    return code


def _totals(a: Analysis) -> dict[str, int]:
    return {k: int(v or 0) for k, v in a.totals.first().asDict().items()}


def _run(args: argparse.Namespace, a: Analysis) -> int:
    if args.command == "check":
        return _check(args, a)
    if args.command == "stats":
        if args.wide:
            _show(stats.wide(a.function_rows.withColumnRenamed("path", "file")))
        elif args.top or args.all:
            _show(stats.top(a.values.withColumn("key", a.values["value"]), args.top or 10, "key").select("metric", "rank", "value"))
        else:
            print("\n".join(report.stats_lines([r.asDict() for r in stats.percentiles(a.values).collect()])))
    elif args.command == "dry":
        pairs = a.pairs if not args.filter else duplication.about_file(a.pairs, a.chunks, args.filter)
        found = False
        for row in report.pair_lines(pairs, a.chunks).toLocalIterator():
            print(row["line"])
            found = True
        if not found:
            print("No duplicates found.")
    elif args.command in ("mimic", "clamp"):
        values = {r["metric"]: r["threshold"] for r in stats.mimic(a.values).collect()}
        text = config.to_toml({k: v for k, v in sorted(values.items())})
        if args.command == "clamp" or args.out:
            Path(args.out or Path(args.path, ".gristmill.toml")).write_text(text, "utf-8")
        else:
            print(text)
    elif args.command == "shrink-start":
        now = _totals(a)
        metric, target = snapshot.parse_target(args.target or "", now)
        snapshot.save(args.out or Path(args.path, STATE), metric, target, now)
    elif args.command == "shrink-check":
        return _shrink(args, a)
    elif args.command == "viz":
        report.write_graph(args.out or "modules.mmd", a.modules, a.edges, args.zoom)
    else:
        shown = coverage.show_tests(a.tests[0], a.tests[1], True, with_file=False)
        for row in report.test_lines(shown, coverage.covered(a.tests[0], a.tests[2]), args.untested).orderBy("file", "line").toLocalIterator():
            print(row["text"])
    return 0


def _shrink(args: argparse.Namespace, a: Analysis) -> int:
    state = snapshot.load(args.out or Path(args.path, STATE))
    if state is None:
        print("Error: No shrink session found.")
        return 1
    metric, target, before = state
    baseline = a.files.sparkSession.createDataFrame(list(before.items()), "metric string, value bigint")
    rows = snapshot.check(baseline, snapshot.long(a.totals), metric, target).collect()
    for r in rows:
        print(report.shrink_line(*r))
    if not rows:
        print("Shrink constraints satisfied.")
    return int(bool(rows))


def _check(args: argparse.Namespace, a: Analysis) -> int:
    violations = focus(a.violations, args.focus) if args.focus else a.violations
    failed = False
    for row in report.violation_lines(violations).toLocalIterator():
        print(row["line"])
        failed = True
    if a.gate.duplication_enabled:
        members = a.clusters.join(a.chunks, a.clusters["id"] == a.chunks["chunk_id"]).select("cluster_id", "file", "start_line", "name")
        for row in report.duplication_lines(members, a.cluster_summary).toLocalIterator():
            print(row["line"])
            failed = True
    total, covered, pct = a.coverage.first()
    if pct < a.gate.coverage and not args.all:
        print(report.coverage_line(pct, a.gate.coverage, total - covered, total))
        failed = True
    print(report.summary_line(_totals(a)))
    if not failed:
        print("NO VIOLATIONS")
    return int(failed)


if __name__ == "__main__":
    sys.exit(main())
