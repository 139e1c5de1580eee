"""quality, routes, slice, trace, ask and cost on the console."""

from __future__ import annotations

import argparse
import importlib
import json
import sys
from datetime import UTC, datetime

from pyspark.sql import SparkSession

from .operators import cost, grouping, routing, slices, timing, triage
from .operators.overview import Analysis, analyse, overview
from .sources.export import Export, find_export, load, raw_records, read_platform_notes


def pair(text: str) -> tuple[str, str]:
    name, equals, value = text.partition("=")
    if not equals or not name:
        raise argparse.ArgumentTypeError(f"expected name=value, got {text!r}")
    return name, value


def moment(text: str) -> datetime:
    try:
        found = datetime.fromisoformat(text.replace("Z", "+00:00"))
    except ValueError:
        raise argparse.ArgumentTypeError(f"not an ISO time: {text!r}") from None
    return found.replace(tzinfo=found.tzinfo or UTC).astimezone(UTC)


def factory(text: str):
    module, colon, name = text.partition(":")
    try:
        return getattr(importlib.import_module(module), name)
    except (ImportError, AttributeError, ValueError):
        raise argparse.ArgumentTypeError(f"expected module:function, got {text!r}") from None


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="wayfarer", description=__doc__)
    p.add_argument("--data", default=".")
    p.add_argument("--key")
    p.add_argument("--plain", action="store_true", help="accepted for scripts; output is always plain")
    sub = p.add_subparsers(dest="command", required=True)
    q = sub.add_parser("quality")
    q.add_argument("--quiet", action="store_true")
    r = sub.add_parser("routes")
    r.add_argument("--json", action="store_true")
    r.add_argument("--limit", type=int, default=8)
    s = sub.add_parser("slice")
    s.add_argument("--where", type=pair, action="append", default=[])
    s.add_argument("--route", type=int)
    s.add_argument("--after", type=moment)
    s.add_argument("--before", type=moment)
    s.add_argument("--journey", action="append", default=[])
    s.add_argument("--limit", type=int, default=slices.MAX_JOURNEYS)
    t = sub.add_parser("trace")
    t.add_argument("value")
    a = sub.add_parser("ask")
    a.add_argument("question", nargs="?")
    a.add_argument("--symptom", type=int)
    a.add_argument("--stub", action="store_true", help="the deterministic answerer, also where a model is named")
    a.add_argument("--model", type=factory, help="module:function; called with effort=..., it returns model(messages, tools), which answers with a tool call or a text")
    a.add_argument("--effort", default="medium", choices=["low", "medium", "high"])
    a.add_argument("--no-platform-context", action="store_true")
    a.add_argument("--platform", help="a text file about the platform")
    c = sub.add_parser("cost")
    c.add_argument("--per-day", type=int, default=cost.PER_DAY)
    c.add_argument("--hot-gb-month", type=float, default=cost.HOT)
    return p


def cmd_quality(args, a: Analysis, export: Export) -> int:
    for row in export.report.where("reason is not null").orderBy("file_name").collect():
        print(f"{row['file_name']}: {row['reason']} ({row['parsed']} of {row['records']})")
    defects = a.defects.orderBy("check", "id").collect()
    for d in defects:
        print(f"\n[{d['id']}] {d['title']}")
        print("\n".join(f"  limit: {x}" for x in d["limits"]))
        if not args.quiet:
            print("\n".join([*(f"  {x}" for x in d["evidence"][:6]), *(f"  would resolve: {x}" for x in d["would_resolve"])]))
    print(f"\n{len(a.limits)} limit(s) travel with every answer" if defects else "the general checks found no defect in the input")
    return 0


def cmd_routes(args, a: Analysis, export: Export) -> int:
    if args.json:
        print(json.dumps(overview(a)["routes"]))
        return 0
    for c in grouping.ranked_candidates(grouping.candidates(a.events)).collect():
        print(f"{c['key']:<18} {c['coverage']:>8.0%} {c['groups']:>8} groups {c['sources_per_group']:>6.1f} sources each, median size {c['median_group_size']}  {'USED' if c['key'] == a.key else c['disqualified']}")
    share = grouping.unjoined_share(a.events, a.key).head()
    print(f"{share['unjoined']} of all {share['records']} records carry no `{a.key}`")
    if a.key:
        for line in routing.rendered(a.routes.where(f"route <= {args.limit}")).orderBy("line_no").collect():
            print("  " + line["line"])
    for row in timing.described(timing.busiest(a.durations), a.events.selectExpr("node as label", "attributes['duration_ms'].n as ms")).collect():
        print(f"  {row['label']:<50} {row['description']}")
    return 0


def show_slice(a: Analysis, where: slices.Filter, limit: int) -> int:
    if not a.key:
        print("no identifier joins these records")
        return 1
    found = slices.take(a.events, a.key, a.membership, where, limit)
    print("\n".join(found.lines))
    return 0 if found.total else 1


def cmd_slice(args, a: Analysis, export: Export) -> int:
    return show_slice(a, slices.Filter(tuple(args.journey), tuple(args.where), args.after, args.before, args.route), args.limit)


def cmd_trace(args, a: Analysis, export: Export) -> int:
    return show_slice(a, slices.Filter(values=(args.value,)), slices.MAX_JOURNEYS)


def cmd_ask(args, a: Analysis, export: Export) -> int:
    question = args.question
    if args.symptom is not None:
        told = [r["text"] for r in export.symptoms.orderBy("ordinal").collect()]
        if not 1 <= args.symptom <= len(told):
            print(f"there are {len(told)} symptoms")
            return 1
        question = told[args.symptom - 1]
    try:
        model = args.model(effort=args.effort) if args.model and not args.stub else None
        found = triage.triage(question or "", a, model, "" if args.no_platform_context else read_platform_notes(args.platform))
    except triage.TriageError as e:
        print(e)
        return 1
    print(f"{found.verdict}: {found.restated_complaint}")
    for h in found.hypotheses:
        print(f"- {h.summary}\n  evidence: {', '.join(h.evidence_refs)}\n  alternative: {h.alternative}")
    print("\n".join(f"limit: {x}" for x in [*found.limits_that_apply, *found.limits_unaddressed]))
    return 0


def cmd_cost(args, a: Analysis | None, export: Export) -> int:
    raw = raw_records(SparkSession.active(), export.directory)
    for row in cost.report(cost.measure(raw), cost.Rates(args.per_day, args.hot_gb_month)).collect():
        print(f"{row['line']:<22} {row['amount'] if row['amount'] is not None else 0.0:>14,.3f}")
    return 0


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    spark = SparkSession.builder.appName("wayfarer").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    try:
        export = load(spark, find_export(args.data, spark))
    except FileNotFoundError as e:
        print(e, file=sys.stderr)
        return 2
    if args.command == "cost":
        return cmd_cost(args, None, export)
    analysis = analyse(export.events, args.key)
    try:
        return globals()[f"cmd_{args.command}"](args, analysis, export)
    finally:
        analysis.release()


__all__ = ["main"]

if __name__ == "__main__":
    sys.exit(main())
