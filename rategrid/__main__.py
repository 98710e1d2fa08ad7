"""The command line: ``python -m rategrid list``, ``run`` and ``fit``."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession

from rategrid.operators import likelihood
from rategrid.plans import fit, registry
from rategrid.sources import params


def main(argv: list[str], spark: SparkSession | None = None) -> int:
    parser = argparse.ArgumentParser("rategrid", description="Queries over a folder of Parquet tables.")
    commands = parser.add_subparsers(dest="command", required=True)
    commands.add_parser("list", help="names of all queries")
    run = commands.add_parser("run", help="run a query")
    run.add_argument("name")
    run.add_argument("--data", required=True, help="folder of the tables")
    run.add_argument("--out", help="folder to write to; without it the first rows are shown")
    run.add_argument("--format", default="parquet", choices=("parquet", "csv", "json"))
    fitted = commands.add_parser("fit", help="fit the triggering model and keep its parameters")
    fitted.add_argument("--data", required=True)
    fitted.add_argument("--out", required=True)
    fitted.add_argument("--model", default="model")
    asked = parser.parse_args(argv)
    if asked.command == "list":
        print("\n".join(sorted(registry.QUERIES)))
        return 0
    spark = spark or SparkSession.builder.getOrCreate()
    if asked.command == "fit":
        theta, nll, settled = likelihood.fit(fit.placed(spark, asked.data), fit.SPAN, fit.TAU, fit.RADIUS, fit.BETA, starts=1, tol=1e-5)
        params.save(spark, asked.out, asked.model, {**likelihood.unpack(theta, fit.BETA), "nll": nll})
        return 0 if settled else 1
    if asked.name not in registry.QUERIES:
        print(f"no query {asked.name}; see list", file=sys.stderr)
        return 2
    df = registry.QUERIES[asked.name](spark, asked.data)
    if asked.out:
        writer = df.write.mode("overwrite").option("header", True) if asked.format == "csv" else df.write.mode("overwrite")
        writer.format(asked.format).save(asked.out)
    else:
        df.show(truncate=False)
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
