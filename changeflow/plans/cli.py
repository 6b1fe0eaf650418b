"""`python -m changeflow.plans.cli run|validate|explain -c job.yaml`."""

from __future__ import annotations

import argparse
import sys


def main(args: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="changeflow")
    parser.add_argument("action", choices=["run", "validate", "explain"])
    parser.add_argument("-c", "--config", required=True)
    parser.add_argument("-m", "--master", default=None)
    parser.add_argument("--checkpoint", default=None, help="run as streams, with checkpoints in this folder")
    parser.add_argument("--bounded", action="store_true", help="streams end when what is there has been read")
    parser.add_argument("--run-id", default=None, help="a run that repeats an earlier one's id writes no table twice")
    got = parser.parse_args(args)
    from changeflow.plans import config

    try:
        spec = config.load(got.config)
    except (ValueError, OSError) as e:
        print(f"invalid job: {e}", file=sys.stderr)
        return 2
    for w in spec.warnings:
        print(f"warning: {w}", file=sys.stderr)
    if got.action == "validate":
        print(f"{spec.name}: {len(spec.pipelines)} pipeline(s)")
        return 0
    from pyspark.sql import SparkSession

    from changeflow.plans import job

    builder = SparkSession.builder.appName(spec.name).config("spark.sql.session.timeZone", "UTC")
    spark = (builder.master(got.master) if got.master else builder).getOrCreate()
    if got.action == "explain":
        print(job.explain(spark, spec))
        return 0
    if got.checkpoint:
        for q in job.stream(spark, spec, got.checkpoint, got.bounded).values():
            q.awaitTermination()
        return 0
    dead = job.run(spark, spec, name=got.run_id)
    failed = {f"{p}/{s}": e for p, sinks in dead.items() for s, e in sinks.items()}
    for name, e in failed.items():
        print(f"sink {name} failed: {e}", file=sys.stderr)
    return 1 if failed else 0


if __name__ == "__main__":
    sys.exit(main())
