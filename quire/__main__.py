"""Command line.

python -m quire list                                   names of all queries
python -m quire run NAME --input DIR --out DIR         runs one over the tables in DIR and writes Parquet
python -m quire evaluate REFERENCE CANDIDATE           compares two translations exports (JSON files or folders)
python -m quire balances LEDGER                        balances of a ledger table (uid, kind, coins), as Parquet
"""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EXPORT = "pages array<struct<name:string,regions:array<struct<id:long,order:long,kind:string,japanese:string,english:string,speaker:string>>>>"


def export(spark: SparkSession, path: str) -> DataFrame:
    """page, id, kind, source and english of an export's boxes that have an English line."""
    pages = spark.read.schema(EXPORT).json(path, multiLine=True).select(F.explode("pages").alias("p")).select("p.name", F.explode("p.regions").alias("r"))
    rows = pages.select(F.col("name").alias("page"), "r.id", "r.kind", F.col("r.japanese").alias("source"), "r.english")
    return rows.where(F.trim("english") != "")


def compare(reference: DataFrame, candidate: DataFrame) -> dict[str, dict]:
    """The character score, the lines that are word for word the same, and the lines that name others than the reference does."""
    from quire.operators import evaluate

    pairs = reference.join(candidate.select("page", "id", F.col("english").alias("candidate")), ["page", "id"])
    same = F.lower(F.trim("english")) == F.lower(F.trim("candidate"))
    return {
        "score": evaluate.chrf(pairs.select(F.col("candidate").alias("hypothesis"), F.col("english").alias("reference"))).first().asDict(),
        "lines": pairs.agg(F.count("*").alias("compared"), F.count_if(same).alias("word_for_word")).first().asDict(),
        "persons": evaluate.who_differs(pairs.select("source", F.col("english").alias("reference"), "candidate")).first().asDict(),
    }


def main(arguments: list[str] | None = None) -> None:
    from quire.plans import registry

    parser = argparse.ArgumentParser(prog="quire")
    commands = parser.add_subparsers(dest="command", required=True)
    commands.add_parser("list")
    run = commands.add_parser("run")
    run.add_argument("name")
    run.add_argument("--input", required=True)
    run.add_argument("--out", required=True)
    both = commands.add_parser("evaluate")
    both.add_argument("reference")
    both.add_argument("candidate")
    commands.add_parser("balances").add_argument("ledger")
    given = parser.parse_args(arguments)
    queries = registry.queries()
    if given.command == "list":
        print("\n".join(sorted(queries)))
        return
    if given.command == "run" and given.name not in queries:
        parser.error(f"no query is named {given.name}")
    spark = SparkSession.builder.getOrCreate()
    if given.command == "run":
        queries[given.name](spark, given.input.rstrip("/")).write.mode("overwrite").parquet(given.out)
    elif given.command == "evaluate":
        for name, figures in compare(export(spark, given.reference), export(spark, given.candidate)).items():
            print(name, *(f"{k}={v}" for k, v in figures.items()))
    else:
        from quire.operators.ledger import balances

        for r in balances(spark.read.parquet(given.ledger)).orderBy("uid").toLocalIterator():
            print(r["uid"], r["balance"])


if __name__ == "__main__":
    main()
