"""Command line: ``python -m sparkloom.cli compress IN OUT``, ``decompress IN OUT``, ``predict IN``."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .operators.predict import from_bytes, seeded_weights
from .plans import arrays
from .sources.fields import load_field, read_chunks, write_chunks


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="sparkloom")
    sub = p.add_subparsers(dest="command", required=True)
    c = sub.add_parser("compress", help="write a field as encoded chunks")
    c.add_argument("source")
    c.add_argument("target")
    c.add_argument("--selector", default="model")
    c.add_argument("--policy", default="balanced")
    c.add_argument("--error-bound", type=float, default=0.0)
    c.add_argument("--chunk", type=int, default=65536)
    c.add_argument("--shuffle", action="store_true")
    c.add_argument("--verify", action="store_true")
    d = sub.add_parser("decompress", help="read encoded chunks back")
    d.add_argument("source")
    d.add_argument("target")
    d.add_argument("--chunk", type=int, default=65536)
    r = sub.add_parser("predict", help="rank configurations for a field")
    r.add_argument("source")
    r.add_argument("--policy", default="balanced")
    r.add_argument("--error-bound", type=float, default=0.0)
    for x in (c, r):
        x.add_argument("--weights", help="file of network weights; seeded ones otherwise")
    return p


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    a = parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName("sparkloom").getOrCreate()
    weights = seeded_weights()
    if getattr(a, "weights", None):
        with open(a.weights, "rb") as f:
            weights = from_bytes(f.read())
    if a.command == "compress":
        field = load_field(spark, a.source)
        options = arrays.Options(a.selector, a.policy, a.error_bound, chunk=a.chunk, shuffle=a.shuffle)
        write_chunks(arrays.write_field(field, options, weights), a.target)
        if a.verify:
            got = arrays.verify(field, arrays.read_field(read_chunks(spark, a.target), a.chunk), a.error_bound)
            bad = got.where((F.col("lost") > 0) | (F.col("violations") > 0)).count()
            print("verified" if not bad else f"{bad} fields differ")
            return int(bad > 0)
    elif a.command == "decompress":
        arrays.read_field(read_chunks(spark, a.source), a.chunk).write.mode("overwrite").parquet(a.target)
    else:
        field = load_field(spark, a.source)
        rows = arrays.candidates(arrays.chunk_table(field, 65536), arrays.Options(policy=a.policy, error_bound=a.error_bound, host_only=False), weights)
        rows.groupBy("action32", "name").agg(F.avg("cost").alias("cost")).orderBy("cost", "action32").show(64, False)
    return 0


if __name__ == "__main__":
    sys.exit(main())
