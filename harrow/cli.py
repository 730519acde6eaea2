"""python -m harrow.cli query2 | query1 | pack: the engine's runs on a tree of files."""

from __future__ import annotations

import argparse
import sys
import time
from contextlib import nullcontext

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from harrow.functions.keys import WIDTHS, prefix_key
from harrow.metrics import Counters, Progress, Report, Sampler, usage
from harrow.operators.mapreduce import filter_count
from harrow.plans.strategies import BUCKETS, STRATEGIES, aggregate, group_count
from harrow.sources import catalog
from harrow.sources.tables import read_table, repack, stream_table
from harrow.streaming.incremental import Epoch, initial_share, keep_sums

#: Other names for strategies, and the one that keeps weights, in one epoch; ddinc does so epoch by epoch.
ALIASES = {"timely": "exchange", "dd": "weighted"}


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="harrow")
    commands = top.add_subparsers(dest="command", required=True)
    two = commands.add_parser("query2", help="revenue by prefix of the address")
    two.add_argument("-i", "--input", default="columns-snz", help="format")
    two.add_argument("-c", "--chunks", type=int, help="the first so many chunks only")
    two.add_argument("-k", "--key_length", type=int, default=8, choices=WIDTHS)
    two.add_argument("-r", "--reduce", default="hashes", choices=[*STRATEGIES, *ALIASES, "ddinc"])
    two.add_argument("-b", "--buckets", type=int, default=BUCKETS)
    two.add_argument("-p", "--partial", action="store_true", help="combine before the shuffle (hashes)")
    two.add_argument("-m", "--monitor", help="file for samples")
    two.add_argument("-v", "--verbose", action="store_true", help="print the plan")
    two.add_argument("--sip", action="store_true", help="accepted; the hash that deals out keys is Spark's own")
    two.add_argument("--hosts", help="accepted; the cluster is the master's, see -w")
    two.add_argument("--me", type=int, help="accepted; as --hosts")
    one = commands.add_parser("query1", help="rankings above a page rank, counted")
    one.add_argument("-i", "--input", default="rmp-gz")
    one.add_argument("--above", type=int, default=10)
    pack = commands.add_parser("pack", help="a table of the source format in another")
    pack.add_argument("table")
    pack.add_argument("format")
    pack.add_argument("--source", default="text-deflate")
    for p in (two, one, pack):
        p.add_argument("-s", "--set", default="5nodes")
        p.add_argument("--root", default="data")
        p.add_argument("-w", "--workers", help="master: a number for local threads, or a master's address")
        p.add_argument("--pb", action="store_true", help="progress bar")
    return top


def session(args: argparse.Namespace) -> SparkSession:
    builder = SparkSession.builder.appName(f"harrow-{args.command}").config("spark.ui.showConsoleProgress", str(args.pb).lower())
    if args.workers:
        builder = builder.master(f"local[{args.workers}]" if args.workers.isdigit() else args.workers)
    return builder.getOrCreate()


def visits(spark: SparkSession, args: argparse.Namespace, chunks: int | None) -> DataFrame:
    rows = read_table(spark, catalog.directory(args.root, args.input, args.set, "uservisits"), "uservisits", args.input, ["source_ip", "ad_revenue"], chunks)
    return rows.select(prefix_key(F.col("source_ip"), args.key_length).alias("key"), F.col("ad_revenue").alias("value"))


def report(args: argparse.Namespace, groups: int, revenue: float | None, began: float, inner: float) -> Report:
    out = Report(args.reduce, args.input, args.key_length, groups, revenue or 0.0, time.monotonic() - began, time.monotonic() - inner, usage())
    print(out.line(), flush=True)
    return out


def query2(spark: SparkSession, args: argparse.Namespace, counters: Counters | None = None) -> Report:
    began, counters = time.monotonic(), counters or Counters()
    rows = counters.count(visits(spark, args, args.chunks), "read")
    sums = counters.count(aggregate(rows, ALIASES.get(args.reduce, args.reduce), args.partial, args.buckets), "aggreg")
    result = group_count(sums)
    if args.verbose:
        result.explain("formatted")
    row = result.first()
    return report(args, row["n_groups"], row["total_revenue"], began, began)


def ddinc(spark: SparkSession, args: argparse.Namespace) -> Report:
    """Sums kept up to date: 95 of 100 chunks in the first epoch, then one in each. Every chunk is read once; a line for each epoch."""
    began = inner = time.monotonic()
    path, lines = catalog.directory(args.root, args.input, args.set, "uservisits"), []
    first = max(1, initial_share(len(catalog.chunks(path, args.input, args.chunks))))
    rows = stream_table(spark, path, "uservisits", args.input, ["source_ip", "ad_revenue"], first, args.chunks)
    rows = rows.select(prefix_key(F.col("source_ip"), args.key_length).alias("key"), F.col("ad_revenue").cast("double").alias("value"), F.lit(1).cast("long").alias("weight"))

    def ended(epoch: Epoch) -> None:
        nonlocal inner
        lines.append(report(args, epoch.n_groups, epoch.total_revenue, began, inner))
        inner = time.monotonic()

    upkeep = keep_sums(rows, f"{catalog.shared_folder(spark)}/state", ended)
    try:
        upkeep.settle()
    finally:
        upkeep.stop()
    return lines[-1] if lines else report(args, 0, 0.0, began, inner)


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    spark = session(args)
    if args.command == "pack":
        repack(spark, args.root, args.set, args.table, args.source, args.format)
    elif args.command == "query1":
        rows = read_table(spark, catalog.directory(args.root, args.input, args.set, "rankings"), "rankings", args.input, ["pagerank"])
        print(filter_count(rows, F.col("pagerank") > args.above).first()["n"])
    elif args.reduce == "ddinc":
        with Sampler(args.monitor) if args.monitor else nullcontext():
            ddinc(spark, args)
    elif args.monitor:
        counters = Counters()
        progress = Progress(spark, len(catalog.chunks(catalog.directory(args.root, args.input, args.set, "uservisits"), args.input, args.chunks)))
        with Sampler(args.monitor, progress=progress) as sampler:
            query2(spark, args, counters=counters)
            sampler.progress = lambda: progress.ended(counters)
    else:
        query2(spark, args)
    return 0


if __name__ == "__main__":
    sys.exit(main())
