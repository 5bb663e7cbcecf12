"""Command line: run the pipeline over exported layout JSON, validate or compare runs, print the configuration.

Exit codes: 0 done, 1 runs differ, 2 configuration, 3 input, 6 pipeline, 7 artifact.
"""

from __future__ import annotations

import argparse
import dataclasses
import json
import sys

from quire.plans.config import DEFAULT


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="quire", description=__doc__)
    sub = p.add_subparsers(dest="command", required=True)
    run = sub.add_parser("run", help="regions of an export, resolved and written with a manifest")
    run.add_argument("source")
    run.add_argument("output")
    run.add_argument("--set", action="append", default=[], metavar="SECTION.KEY=VALUE")
    run.add_argument("--lenient", action="store_true", help="a failed stage is reported and its input goes on")
    check = sub.add_parser("validate", help="files of a run against its manifest")
    check.add_argument("output")
    compare = sub.add_parser("compare", help="regions of two runs")
    compare.add_argument("left")
    compare.add_argument("right")
    sub.add_parser("config", help="thresholds as JSON")
    return p


def options(pairs: list[str]) -> dict:
    out: dict = {}
    for pair in pairs:
        name, equals, value = pair.partition("=")
        section, dot, key = name.partition(".")
        if not (equals and dot):
            raise ValueError(f"not SECTION.KEY=VALUE: {pair}")
        out.setdefault(section, {})[key] = json.loads(value)
    return out


def main(argv: list[str] | None = None, spark=None) -> int:
    args = parser().parse_args(argv)
    if args.command == "config":
        print(json.dumps(dataclasses.asdict(DEFAULT), indent=2))
        return 0
    try:
        config = DEFAULT.with_options(**options(getattr(args, "set", [])))
    except ValueError as e:
        print(e, file=sys.stderr)
        return 2
    from pyspark.sql import SparkSession

    from quire.operators import trace
    from quire.plans import pipeline
    from quire.sources import adapters, sinks

    spark = spark or SparkSession.builder.getOrCreate()
    if args.command == "validate":
        try:
            issues = sinks.validate_artifacts(spark, args.output).collect()  # one row per file that is wrong
        except Exception as e:
            print(e, file=sys.stderr)
            return 7
        for r in issues:
            print(r["issue"], r["path"])
        return 7 if issues else 0
    if args.command == "compare":
        left, right = (spark.read.parquet(f"{x}/regions") for x in (args.left, args.right))
        differ = trace.compare(left, right).where("added + removed + moved + retyped > 0")
        differ.show(20, False)
        return 1 if not differ.isEmpty() else 0
    try:
        regions, counts = adapters.convert_export(adapters.read_export(spark, args.source))
        counts.collect()  # one row per document of the export
    except Exception as e:
        print(e, file=sys.stderr)
        return 3
    try:
        out = pipeline.run(regions, config, pipeline.Run(strict=not args.lenient), sinks.written)
        frames = {n: getattr(out, n) for n in ("regions", "excluded", "relationships", "captions", "hierarchy", "tables", "trace", "policy", "assets", "conflicts", "crops", "caption_groups")}
        sinks.write_artifacts(frames, args.output, out.status)
    except Exception as e:
        print(e, file=sys.stderr)
        return 6
    return 0


if __name__ == "__main__":
    sys.exit(main())
