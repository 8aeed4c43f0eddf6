"""Command line: verify a table of questions, or run a registered query.

    python -m quern verify --docs DIR --questions DIR --out DIR [--config FILE] [--mode MODE] ...
    python -m quern query NAME TABLES [--out DIR]
"""

from __future__ import annotations

import argparse
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern import config
from quern.plans import catalog
from quern.plans.pipeline import MODES, Pipeline
from quern.sources import sinks
from quern.sources.datasets import first_percent
from quern.storage import scope


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="quern", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    commands = top.add_subparsers(dest="command", required=True)
    verify = commands.add_parser("verify", help="verify questions against a corpus")
    verify.add_argument("--docs", required=True, help="Parquet of doc_id, title, content, pmid, id, url[, year]")
    verify.add_argument("--questions", required=True, help="Parquet of id, question, options")
    verify.add_argument("--out", required=True, help="folder of the records; records there already are not made again")
    verify.add_argument("--config")
    verify.add_argument("--mode", choices=[*MODES, *config.ALIASES])
    verify.add_argument("--vectors")
    verify.add_argument("--nodes")
    verify.add_argument("--edges")
    verify.add_argument("--k", type=int)
    verify.add_argument("--votes", type=int, dest="n_votes")
    verify.add_argument("--models", nargs="*")
    verify.add_argument("--alpha", type=float, help="weight of recency")
    verify.add_argument("--nei-share", type=float, help="verdicts with a smaller share of the votes are undecided")
    verify.add_argument("--no-compress", action="store_false", dest="compress", default=None)
    verify.add_argument("--percent", type=float, default=100.0)
    verify.add_argument("--run-id", default=None)
    query = commands.add_parser("query", help="run a registered query")
    query.add_argument("name")
    query.add_argument("tables")
    query.add_argument("--out")
    return top


def _done(spark: SparkSession, path: str) -> DataFrame | None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    there = target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)
    return spark.read.parquet(path).select("id") if there else None


def verify(spark: SparkSession, args: argparse.Namespace, hooks=None) -> int:
    """Appends the records of the questions that have none yet; returns how many were asked for."""
    settings = config.settings(
        config.load(args.config) if args.config else {}, mode=args.mode, k=args.k, n_votes=args.n_votes, models=args.models or None, alpha=args.alpha, nei_share=args.nei_share, compress=args.compress,
    )
    more = {name: spark.read.parquet(path) for name, path in (("vectors", args.vectors), ("nodes", args.nodes), ("edges", args.edges)) if path}
    questions = spark.read.parquet(args.questions)
    if args.percent < 100:
        questions = first_percent(questions, args.percent, "id")
    with scope(spark):
        records = Pipeline(spark.read.parquet(args.docs), settings, hooks, **more).batch_verify(questions, _done(spark, args.out))
        # The time is set here, once, so that a task that runs again writes the same record.
        stamped = records.withColumn("made_at", F.lit(time.strftime("%Y-%m-%dT%H:%M:%SZ", time.gmtime())))
        sinks.append_records(stamped, args.out, args.run_id or f"run-{int(time.time())}")
    return questions.count()


def main(argv: list[str] | None = None) -> None:
    args = parser().parse_args(argv)
    spark = SparkSession.builder.appName("quern").getOrCreate()
    if args.command == "verify":
        verify(spark, args)
        return
    rows = catalog.queries()[args.name](spark, args.tables)
    if args.out:
        rows.write.mode("overwrite").parquet(args.out)
    else:
        print(sinks.text_table(rows, 20))


if __name__ == "__main__":
    main()
