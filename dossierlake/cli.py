"""The command line: scan a folder, sign a report, extract scripts, verify evidence and logs."""

from __future__ import annotations

import argparse
import os
import sys
from datetime import datetime

from dossierlake.config import Config, load


def _scan(args: argparse.Namespace) -> int:
    from dossierlake.operators import casefile, custody, reports
    from dossierlake.plans.scan import scan
    from dossierlake.session import build_session

    if not os.path.isdir(args.dir):
        print(f"Error: not a directory: {args.dir}", file=sys.stderr)
        return 1
    out = os.path.abspath(args.output_dir or os.path.join(args.dir, "..", "scan-output"))
    os.makedirs(out, exist_ok=True)
    spark = build_session("scan", master=None if args.cluster else f"local[{args.jobs or max(1, (os.cpu_count() or 2) - 1)}]")
    found = scan(spark, os.path.abspath(args.dir), f"{out}/tables", load(args.config) if args.config else Config())
    case = f"{out}/case_cli_{datetime.now():%Y%m%d_%H%M%S}.prc"
    log = os.path.abspath(args.custody_log) if args.custody_log else custody.log_path(out)
    if args.custody_log or args.output_dir:
        rows = found.records.where("not is_revision and sha256 is not null").orderBy("path").select("path", "sha256")
        custody.append(log, [custody.ingested(r["path"], r["sha256"]) for r in rows.toLocalIterator()])
    own = casefile.write_case(found, case, os.path.abspath(args.dir))
    custody.append(log, [custody.entry(custody.CASE_SAVE, case, own, {"source": "cli_scan"})])
    for kind, write in (("csv", reports.write_csv_file), ("html", reports.write_html_file), ("xlsx", reports.write_xlsx)):
        if kind in (args.report or []):
            write(found.report(), f"{out}/report.{kind}")
            casefile.sealed(f"{out}/report.{kind}", kind, log)
    s = found.summary().first()
    print(f"Files {s['originals']}, altered {s['yes']}, possibly {s['possible']}, errors {s['errors']}, revisions {s['revisions']}\nCase saved: {case}\nCustody log: {log}")
    return 0


def _signed(args: argparse.Namespace) -> int:
    from dossierlake.operators import casefile, custody

    if not os.path.exists(args.case):
        print(f"Error: case file not found: {args.case}", file=sys.stderr)
        return 1
    out = args.output or os.path.splitext(args.case)[0] + ".signed_report.json"
    log = custody.log_path(os.path.dirname(args.case), args.case) if args.custody else None
    own = casefile.write_report(casefile.findings_report(casefile.read_case(args.case), args.case), out, log, args.case, args.sign_key)
    print(f"Signed report: {out}\nReport SHA-256: {own}")
    return 0


def _scripts(args: argparse.Namespace) -> int:
    from dossierlake.operators.casefile import write_scripts
    from dossierlake.parse.facts import facts_of

    if not os.path.exists(args.file):
        print(f"Error: file not found: {args.file}", file=sys.stderr)
        return 1
    with open(args.file, "rb") as f:
        found = facts_of(args.file, f.read()).get("scripts") or []
    if not found:
        print("No embedded JavaScript found.")
        return 0
    said = write_scripts(found, args.output)
    print(f"Extracted {len(found)} script(s) to {args.output}" if args.output else said, end="\n" if args.output else "")
    return 0


def _verify(args: argparse.Namespace) -> int:
    from dossierlake.operators import casefile, custody
    from dossierlake.session import build_session

    spark, good = build_session("verify", master="local[2]"), True
    if args.case:
        counts = {r["verdict"]: r["count"] for r in casefile.verify_evidence(spark, args.case, args.custody_log).groupBy("verdict").count().collect()}
        print("Evidence:", ", ".join(f"{n} {v}" for v, n in sorted(counts.items())) or "none")
        good = set(counts) <= {"verified"}
    if args.custody_log:
        _, whole, _, said = custody.verdict(spark, args.custody_log)
        print(said)
        good = good and whole
    return 0 if good else 1


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="dossierlake", description="Document forensics on Spark")
    sub = parser.add_subparsers(required=True)
    p = sub.add_parser("scan", help="scan a folder of PDF files")
    p.add_argument("dir")
    p.add_argument("--output-dir")
    p.add_argument("--custody-log")
    p.add_argument("--jobs", type=int)
    p.add_argument("--config")
    p.add_argument("--cluster", action="store_true", help="use the session's own master")
    p.add_argument("--report", action="append", choices=["csv", "html", "xlsx"])
    p.set_defaults(run=_scan)
    p = sub.add_parser("export-signed", help="write a findings report with its hash")
    p.add_argument("case")
    p.add_argument("--output")
    p.add_argument("--custody", action="store_true")
    p.add_argument("--sign-key")
    p.set_defaults(run=_signed)
    p = sub.add_parser("extract-js", help="write the scripts of a file")
    p.add_argument("file")
    p.add_argument("--output")
    p.set_defaults(run=_scripts)
    p = sub.add_parser("verify", help="compare evidence with a case, and a custody log with its chain")
    p.add_argument("--case")
    p.add_argument("--custody-log")
    p.set_defaults(run=_verify)
    args = parser.parse_args(argv)
    return args.run(args)


if __name__ == "__main__":
    sys.exit(main())
