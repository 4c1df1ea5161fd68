"""Command line: init, check-config, validate-trace, validate-mapping, convert-trace, scan-trace, scan-external-trace, corpus-report."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .plans.corpus import corpus_report, write_corpus_report
from .plans.report import AuditResult
from .project import check_project, init_project
from .sdk import Auditor
from .sources.mapping import TraceAdapter, load_mapping
from .sources.policy import load_policy
from .sources.trace import load_trace, trace_lines, write_trace

COMMANDS = ("init", "check-config", "validate-trace", "validate-mapping", "convert-trace", "scan-trace", "scan-external-trace", "corpus-report")


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="lakeaudit", description=__doc__)
    sub = p.add_subparsers(dest="command", required=True)
    c = {n: sub.add_parser(n) for n in COMMANDS}
    c["init"].add_argument("--root", default=".")
    c["init"].add_argument("--force", action="store_true")
    c["check-config"].add_argument("--root", default=".")
    c["validate-trace"].add_argument("trace")
    c["validate-mapping"].add_argument("mapping")
    for n in ("convert-trace", "scan-external-trace"):
        c[n].add_argument("--input", required=True)
        c[n].add_argument("--mapping", required=True)
        c[n].add_argument("--diagnostics")
    c["convert-trace"].add_argument("--output")
    c["convert-trace"].add_argument("--stdout", action="store_true")
    c["scan-external-trace"].add_argument("--normalized-trace")
    c["scan-trace"].add_argument("--trace", required=True)
    for flag in ("--traces", "--expectations", "--policy", "--output"):
        c["corpus-report"].add_argument(flag, required=True)
    for n, mode in (("scan-trace", "raw"), ("scan-external-trace", "redacted")):
        c[n].add_argument("--policy")
        c[n].add_argument("--json-report")
        c[n].add_argument("--markdown-report")
        c[n].add_argument("--redacted-trace")
        c[n].add_argument("--report-value-mode", choices=("raw", "redacted", "hashed"), default=mode)
    return p


def main(argv: list[str] | None = None) -> int:
    argv = list(sys.argv[1:] if argv is None else argv)
    if argv and argv[0] not in COMMANDS and argv[0] not in ("-h", "--help"):
        argv.insert(0, "scan-trace")  # the old form has flags only
    args = parser().parse_args(argv)
    try:
        return run(args)
    except (OSError, ValueError) as e:
        print(f"error: {e}", file=sys.stderr)
        return 2


def run(args: argparse.Namespace) -> int:
    if args.command == "init":
        for path in init_project(args.root, args.force):
            print(f"wrote {path}")
        return 0
    if args.command == "check-config":
        print(f"ok: {check_project(args.root).root}")
        return 0
    if args.command == "validate-mapping":
        load_mapping(args.mapping)
        print(f"ok: {args.mapping}")
        return 0
    spark = SparkSession.builder.getOrCreate()
    if args.command == "validate-trace":
        events = load_trace(spark, args.trace)
        dest = F.array_distinct(F.flatten(F.collect_set(F.transform(F.from_json("destinations", "array<struct<layer:string>>"), lambda d: d["layer"]))))
        r = events.agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_set("layer")).alias("layers"), F.array_sort(dest).alias("dest")).first()
        if not r["n"]:
            raise ValueError(f"{args.trace}: trace has no events")
        print(f"ok: {r['n']} events; layers: {', '.join(r['layers'])}; destination layers: {', '.join(x for x in r['dest'] if x)}")
        return 0
    if args.command == "corpus-report":
        report = corpus_report(spark, args.traces, args.expectations, load_policy(args.policy))
        write_corpus_report(report, args.output)
        print(f"{report['total']['traces']} traces, {report['total']['events']} events, {report['total']['findings']} findings")
        return 0 if report["passed"] else 1
    external = args.command != "scan-trace"
    path = args.input if external else args.trace
    if external:
        adapter = TraceAdapter.from_mapping(args.mapping)
        events = adapter.load(spark, path)
        if args.diagnostics:
            with open(args.diagnostics, "w", encoding="utf-8") as f:
                f.write(json.dumps(adapter.diagnostics(spark, path), indent=2, sort_keys=True) + "\n")
    else:
        events = load_trace(spark, path)
    target = getattr(args, "output", None) or getattr(args, "normalized_trace", None)
    if target:
        write_trace(events, target)
    if args.command == "convert-trace":
        if args.stdout:
            for line in trace_lines(events):
                print(line)
        return 0
    auditor = Auditor.from_policy_file(spark, args.policy) if args.policy else Auditor.from_project(spark)
    result: AuditResult = auditor.audit_events(events, trace_path=path, mode=args.report_value_mode)
    if args.markdown_report:
        result.write_markdown(args.markdown_report)
    if args.json_report:
        result.write_json(args.json_report)
    if args.redacted_trace:
        write_trace(auditor.redact_trace(events), args.redacted_trace, always=True, content="redacted_content")
    s = result.summary()
    print(f"{s['total_findings']} candidates, {s['total_boundary_exposures']} exposures, {s['by_disposition'].get('violation', 0)} violations")
    return 0


if __name__ == "__main__":
    sys.exit(main())
