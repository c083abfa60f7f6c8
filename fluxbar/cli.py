"""Command line: run SQL over files, run a registered query, or show the plan of either."""

from __future__ import annotations

import argparse
import glob
import json
import os
import platform

import pyarrow as pa
import pyspark
from pyspark.sql import DataFrame, SparkSession

from fluxbar import catalog
from fluxbar.plans import experiments


def register(spark: SparkSession, folder: str) -> list[str]:
    """A view for each Parquet table of a folder, named after it."""
    names = []
    for path in sorted(glob.glob(os.path.join(folder, "*.parquet"))):
        names.append(os.path.basename(path).removesuffix(".parquet"))
        spark.read.parquet(path).createOrReplaceTempView(names[-1])
    return names


def execute(spark: SparkSession, args: argparse.Namespace) -> DataFrame:
    if args.command == "query":
        if args.tables:
            register(spark, args.tables)
        return spark.sql(args.sql)
    return catalog.queries()[args.name](spark, args.tables)


def prepared(spark: SparkSession, args: argparse.Namespace) -> DataFrame:
    """The commands that write tables; what they report."""
    if args.command == "run-pairs-experiment":
        with open(args.config) as f:
            return experiments.run_pairs_config(spark, json.load(f))
    if args.command == "prepare-futures":
        return experiments.prepare_futures(spark, args.raw, args.out, [r.strip() for r in args.roots.split(",") if r.strip()] if args.roots else None)
    experiments.universe(spark.read.parquet(args.closes), spark.read.parquet(args.shares), args.top).write.option("header", True).csv(args.out)
    return spark.read.option("header", True).csv(args.out)


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="fluxbar")
    sub = p.add_subparsers(dest="command", required=True)
    for name, what in (("query", "sql"), ("run", "name")):
        c = sub.add_parser(name)
        c.add_argument(what)
        c.add_argument("--tables", help="folder with Parquet tables", required=name == "run")
        c.add_argument("--explain", action="store_true")
        c.add_argument("--out", help="write Parquet here instead of showing rows")
        c.add_argument("--rows", type=int, default=20, help="how many rows to show")
    e = sub.add_parser("run-experiment", help="run a config and write equity and metrics")
    e.add_argument("config")
    q = sub.add_parser("run-pairs-experiment", help="run a pairs config and write selection, metrics and portfolio")
    q.add_argument("config")
    f = sub.add_parser("prepare-futures", help="continuous series of the contracts in a folder")
    f.add_argument("raw")
    f.add_argument("out")
    f.add_argument("--roots", help="comma-separated; all files if not given")
    u = sub.add_parser("build-universe", help="the largest symbols by close times shares")
    u.add_argument("closes")
    u.add_argument("shares")
    u.add_argument("out")
    u.add_argument("--top", type=int, default=100)
    r = sub.add_parser("report", help="the best written metrics as a Markdown table")
    r.add_argument("folder")
    r.add_argument("--by", required=True)
    r.add_argument("--rows", type=int, default=20)
    sub.add_parser("list")
    sub.add_parser("doctor", help="show the versions in use")
    return p


def main(argv: list[str] | None = None) -> None:
    args = parser().parse_args(argv)
    if args.command == "list":
        print("\n".join(sorted(catalog.queries())))
        return
    if args.command == "doctor":
        print(f"python {platform.python_version()}, pyspark {pyspark.__version__}, pyarrow {pa.__version__}")
        return
    spark = SparkSession.builder.appName("fluxbar").getOrCreate()
    if args.command == "run-experiment":
        experiments.run_experiment(spark, experiments.read_config(args.config)).show(truncate=False)
        return
    if args.command == "report":
        print(experiments.report(spark, args.folder, args.by, args.rows))
        return
    if args.command in ("run-pairs-experiment", "prepare-futures", "build-universe"):
        prepared(spark, args).show(truncate=False)
        return
    df = execute(spark, args)
    if args.explain:
        df.explain("formatted")
    elif args.out:
        df.write.parquet(args.out)
    else:
        df.show(args.rows, truncate=False)


if __name__ == "__main__":
    main()
