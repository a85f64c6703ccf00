"""Command line: init, refresh, search, status, doctor, verify."""

from __future__ import annotations

import argparse
import json
import sys

from py4j.protocol import Py4JError
from pyspark.errors import PySparkException
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from . import config as C


def _positive(text: str) -> int:
    n = int(text)
    if n < 1:
        raise argparse.ArgumentTypeError("must be at least 1")
    return n


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="tessera")
    p.add_argument("--config")
    sub = p.add_subparsers(dest="command", required=True)
    x = sub.add_parser("init")
    x.add_argument("--root", required=True)
    x.add_argument("--index", required=True)
    x.add_argument("--force", action="store_true")
    x = sub.add_parser("refresh")
    x.add_argument("--full", action="store_true")
    x = sub.add_parser("search")
    x.add_argument("question")
    x.add_argument("--top-k", type=_positive)
    x.add_argument("--project")
    x.add_argument("--policy")
    x.add_argument("--json", action="store_true")
    sub.add_parser("status").add_argument("--json", action="store_true")
    sub.add_parser("doctor")
    x = sub.add_parser("verify")
    x.add_argument("--deep", action="store_true")
    x.add_argument("--json", action="store_true")
    return p


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    """Exit codes: search 0 hits, 1 none, 2 refused; status 1 no index; verify 0 clean, 1 drift, 2 no index; 3 for errors."""
    args = parser().parse_args(argv)
    try:
        return _run(args, spark)
    except (PySparkException, Py4JError) as e:  # a table of the index that is damaged or gone, among others
        lines = str(e).strip().splitlines() or [type(e).__name__]
        print(f"error: the index cannot be read or written: {lines[0]}", file=sys.stderr)
        return 3
    except (RuntimeError, ValueError, KeyError) as e:
        print(f"error: {e}", file=sys.stderr)
        return 3
    except BrokenPipeError:
        return 1
    except KeyboardInterrupt:
        return 130


def _run(args, spark) -> int:
    from pathlib import Path

    from .engine import Engine, NoIndex, PrivateQuery
    from .operators.trust import first_findings

    if args.command == "init":
        where = Path(args.config or "config.json")
        if where.exists() and not args.force:
            raise RuntimeError(f"{where} exists; use --force to replace it")
        where.write_text(json.dumps(C.default_config(args.root, args.index), indent=2))
        print(where)
        return 0
    config = C.load(args.config)
    if args.command == "doctor":
        gone = [r["path"] for r in config["corpus_roots"] if not Path(r["path"]).exists()]
        print(json.dumps({"config": "valid", "missing_roots": gone, "index": (Path(config["index_path"]) / "current.json").exists()}))
        return 1 if gone else 0
    spark = spark or SparkSession.builder.appName("tessera").getOrCreate()
    engine = Engine(spark, config)
    if args.command == "refresh":
        print(json.dumps(engine.refresh(full=args.full), sort_keys=True))
        return 0
    if args.command == "status":
        try:
            meta = engine.metadata()
        except NoIndex as e:
            print(json.dumps({"error": str(e)}) if args.json else f"error: {e}", file=sys.stdout if args.json else sys.stderr)
            return 1
        chunks = engine.read("chunks").count()
        projects = engine.read("sources").groupBy("project").agg(F.count(F.lit(1)).alias("files")).orderBy(F.desc("files"), "project").limit(15).collect()
        print(json.dumps(meta | {"chunks": chunks, "projects": {r["project"]: r["files"] for r in projects}}, sort_keys=True))
        return 0
    if args.command == "verify":
        try:
            engine.metadata()
        except RuntimeError as e:
            print(json.dumps({"error": str(e), "exit_code": 2}) if args.json else f"error: {e}", file=sys.stdout if args.json else sys.stderr)
            return 2
        findings, gone = engine.audit(args.deep).cache(), engine.missing()
        for root in gone:
            print(f"missing root: {root}", file=sys.stderr)
        if args.json:  # row by row: the driver never holds all findings
            n = 0
            print("[", end="")
            for n, r in enumerate(findings.toLocalIterator(), 1):
                print((", " if n > 1 else "") + json.dumps(r.asDict()), end="")
            print("]")
            return 1 if n else 0
        rows = first_findings(findings).collect()
        print("\n".join(f"{r['kind']}: {r['path']} ({r['total']} in all)" for r in rows) or "clean")
        return 1 if rows else 0
    try:
        answer = engine.answer(args.question, args.top_k, args.project, args.policy)
    except PrivateQuery as e:
        print(json.dumps({"refused": str(e)}) if args.json else f"refused: matched '{e}'")
        return 2
    hits = answer["results"]
    if args.json:
        print(json.dumps(answer))
    else:
        for w in answer["warnings"]:
            print(f"warning: {w}", file=sys.stderr)
        for h in hits:
            print(f"{h['rank']}. [{h['marker']}] {h['path']} ({h['score']:.4f})\n   {h['snippet']}")
    return 0 if hits else 1


if __name__ == "__main__":
    sys.exit(main())
