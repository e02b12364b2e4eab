"""Comparison of two runs: character n-gram F-score, and lines on which they disagree about who is meant."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.functions.text import ngram_matches

def chrf(pairs: DataFrame, order: int = 6, beta: float = 2.0) -> DataFrame:
    """Corpus score over (hypothesis, reference): matches and totals are summed first, precision and recall averaged over orders."""
    schema = "n int, matched long, in_hypothesis long, in_reference long"

    def count(batches):
        for x in batches:
            sums = [[0, 0, 0] for _ in range(order)]
            for h, r in zip(x.hypothesis, x.reference):
                for k, v in enumerate(ngram_matches(h or "", r or "", order)):
                    sums[k] = [a + b for a, b in zip(sums[k], v)]
            yield pd.DataFrame([(k + 1, *v) for k, v in enumerate(sums)], columns=["n", "matched", "in_hypothesis", "in_reference"])

    sums = pairs.select("hypothesis", "reference").mapInPandas(count, schema).groupBy("n").agg(*[F.sum(c).alias(c) for c in ("matched", "in_hypothesis", "in_reference")])
    # Each mean is over the orders of which its own side has n-grams.
    share = lambda c: F.coalesce(F.avg(F.when(F.col(c) > 0, F.col("matched") / F.col(c))), F.lit(0.0))
    sums = sums.agg(share("in_hypothesis").alias("p"), share("in_reference").alias("r"))
    b = beta * beta
    score = F.when(F.col("p") + F.col("r") > 0, 100 * (1 + b) * F.col("p") * F.col("r") / (b * F.col("p") + F.col("r"))).otherwise(0.0)
    return sums.select(F.round("p", 6).alias("precision_"), F.round("r", 6).alias("recall"), F.round(score, 4).alias("chrf"))


def who_differs(pairs: DataFrame) -> DataFrame:
    """A11. pairs: source, reference, candidate. Where the source names nobody: lines, lines on which both sides name somebody, and of these
    the ones that name others."""
    from quire.operators.regions import persons

    #: Pronouns of the source language (fixed values).
    own = "私|僕|俺|あたし|わたし|我々|あなた|君|きみ|お前|彼|彼女"
    rows = pairs.where(~F.coalesce("source", F.lit("")).rlike(own)).select(persons(F.col("reference")).alias("a"), persons(F.col("candidate")).alias("b"))
    both = (F.size("a") > 0) & (F.size("b") > 0)
    return rows.agg(F.count("*").alias("unnamed"), F.count_if(both).alias("named_by_both"), F.count_if(both & (F.col("a") != F.col("b"))).alias("disagree"))
