"""Command line: audit, scope and check files.

    python -m provenlake audit PATH [--json]       claims against evidence; exit code 0, 1, 2 or 3
    python -m provenlake scope PATH [--full]       what commands reached; exit code 0, 1 or 3
    python -m provenlake check PATH [--loose]      session documents: chains and gate; exit code 0, 1, 2 or 3

PATH is a file, a folder or a pattern; the exit code is the greatest of all sessions'.
"""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from provenlake.operators import audit, flatten, ledger, scope
from provenlake.session import written
from provenlake.sources import files
from provenlake.sources.transcripts import blocks, canonical_lines


def _events(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    lines = files.transcript_lines(spark, path)
    return written(audit.events(blocks(canonical_lines(lines))))[0], lines.select("session").distinct()


def _rows(df: DataFrame, *order: str):
    """Rows in order, a partition at a time."""
    return (r.asDict(True) for r in df.orderBy(*order).toLocalIterator())


def run_audit(spark: SparkSession, args) -> int:
    ev, sessions = _events(spark, args.path)
    grades, _ = written(audit.graded_sentences(ev))
    graded, _ = written(audit.audit(ev, grades))
    code = 0
    for r in _rows(audit.session_rollup(ev, graded, sessions, grades), "session"):
        code = max(code, r["exit_code"])
        print(json.dumps(r) if args.json else f"{r['session']}: " + ("no transcript" if r["exit_code"] == 3 else ", ".join(f"{r[k]} {k}" for k in ("commands", "supported", "supported_weak", "unsupported", "contradicted"))))
    for r in _rows(graded, "session", "seq", "idx", "pos", "kind"):
        print(json.dumps(r, ensure_ascii=False) if args.json else f"  {r['session']}:{r['seq']} {r['verdict']:<14} {r['kind']}: {r['text']}" + (f"\n      {r['evidence']}" if r["evidence"] else ""))
    return code


def run_scope(spark: SparkSession, args) -> int:
    ev, sessions = _events(spark, args.path)
    code = 0
    for r in _rows(scope.summary(ev, sessions), "session"):
        code = max(code, r["exit_code"])
        print(json.dumps(r))
    for r in _rows(scope.shown(scope.reach(ev), None if args.full else 8), "session", "what"):
        print(f"  {r['session']} {r['what']} ({r['n']}): {', '.join(r['values'])}")
    for r in _rows(scope.opaque(ev), "session", "seq"):
        print(f"  {r['session']}:{r['seq']} cannot read: {r['why']}: {r['command']}")
    return code


def run_check(spark: SparkSession, args) -> int:
    docs = flatten.newest_documents(files.session_documents(spark, args.path))
    chains = ledger.document_chains(docs)
    facts = flatten.facts_table(files.session_documents(spark, args.path)).withColumn("truth", ledger.truth(F.col("evidence"), F.lit(False), F.lit(False)))
    reports = ledger.full_report(facts, "root", ["item"])
    code = 0
    for r in _rows(chains.join(reports, "root", "left"), "root"):
        gate = 3 if r["status"] == "tampered" else (r["gate"] if args.loose else r["gate_strict"]) if r["done"] is not None else 0 if args.loose else 2
        code = max(code, gate)
        print(f"# {r['root']}: {r['entries']} entries, chain {r['status']}" + (f" at {r['position']}" if r["position"] is not None else "") + f", exit {gate}")
        if r["done"] is not None:
            print(ledger.report_markdown(r))
    return code


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    p = argparse.ArgumentParser(prog="provenlake", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    p.add_argument("what", choices=("audit", "scope", "check"))
    p.add_argument("path")
    p.add_argument("--json", action="store_true")
    p.add_argument("--full", action="store_true")
    p.add_argument("--loose", action="store_true")
    args = p.parse_args(argv)
    spark = spark or SparkSession.builder.appName("provenlake").getOrCreate()
    return {"audit": run_audit, "scope": run_scope, "check": run_check}[args.what](spark, args)


if __name__ == "__main__":
    sys.exit(main())
