"""``python -m weftspan.plans.cli contacts.bedpe out/``: call stripes and write them as tab-separated text."""

from __future__ import annotations

import argparse
import dataclasses
import logging
import os
import time

from pyspark.sql import SparkSession

from weftspan.functions.lineage import clear
from weftspan.operators.features import describe, histograms
from weftspan.plans.pipeline import Params, StripeCaller
from weftspan.sources.dialects import save_stripes, write_tsv

FEATURES = ["length", "loop_count", "weight", "gap_size", "orientation_score", "raw_gap_score", "gap_score", "stripe_score", "worst_gap_score", "l_score", "w_score", "cross_score"]


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(description=__doc__)
    p.add_argument("input")
    p.add_argument("output")
    p.add_argument("--name", "-n", help="first part of the names of the files written; that of the input if not given")
    p.add_argument("--stats", "-s", action="store_true", help="also write a summary and a histogram of every score")
    p.add_argument("--verbose", "-v", action="store_true", help="log how long each part takes")
    p.add_argument("--quiet", "-q", action="store_true", help="log warnings only")
    p.add_argument("--loglevel", "-l", default="WARN", help="Spark's own log level")
    for f in dataclasses.fields(Params):
        flag = f"--{f.name.replace('_', '-')}"
        if isinstance(f.default, bool):
            p.add_argument(flag, action=argparse.BooleanOptionalAction, default=f.default)
        else:
            p.add_argument(flag, type=type(f.default), default=f.default)
    return p


def params_of(args: argparse.Namespace) -> Params:
    return Params(**{f.name: getattr(args, f.name) for f in dataclasses.fields(Params)})


def main(argv: list[str] | None = None) -> str:
    args = parser().parse_args(argv)
    logging.basicConfig(level=logging.WARNING if args.quiet else logging.DEBUG if args.verbose else logging.INFO, format="%(message)s", force=True)
    logging.getLogger("py4j").setLevel(logging.WARNING)
    began = time.time()
    spark = SparkSession.builder.appName("weftspan").getOrCreate()
    spark.sparkContext.setLogLevel(args.loglevel)
    call = StripeCaller(params_of(args)).start(args.input, spark)
    name = args.name or os.path.basename(args.input.rstrip("/")).split(".")[0]
    out = f"{args.output.rstrip('/')}/{name}.stripes.tsv"
    save_stripes(call.final, out)
    logging.debug("Stripes written after %.1f s", time.time() - began)
    if args.stats:
        write_tsv(describe(call.scored, FEATURES), f"{args.output.rstrip('/')}/{name}.stats.tsv")
        write_tsv(histograms(call.scored, FEATURES), f"{args.output.rstrip('/')}/{name}.histograms.tsv")
        logging.debug("Statistics written after %.1f s", time.time() - began)
    clear(spark)
    logging.info("All done in %.1f s: %s", time.time() - began, out)
    return out


if __name__ == "__main__":
    main()
