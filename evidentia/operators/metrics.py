"""Recall at five, per question, overall and by bucket."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def recall(answer: Column | str, gold: Column | str, k: int = 5) -> Column:
    """Share of the gold ids, repeats counted, among the first k answers; null without gold."""
    kept = F.filter(gold, lambda g: g != "")
    hits = F.size(F.filter(kept, lambda g: F.array_contains(F.slice(answer, 1, k), g)))
    return F.when(F.size(kept) > 0, hits / F.size(kept).cast("double"))


def with_recall(questions: DataFrame, answers: DataFrame) -> DataFrame:
    out = questions.join(answers, "q_id", "left").withColumn("answer", F.coalesce("answer", F.array().cast("array<string>")))
    return out.withColumn("recall", recall("answer", "gold"))


def evaluate(df: DataFrame, *by: str) -> DataFrame:
    """recall_at_5, evaluated, skipped and total, overall or by bucket; recall 0 where nothing could be evaluated."""
    return df.groupBy(*by).agg(
        F.round(F.coalesce(F.avg("recall"), F.lit(0.0)), 6).alias("recall_at_5"), F.count("recall").alias("evaluated"),
        F.count_if(F.col("recall").isNull()).alias("skipped"), F.count("*").alias("total"),
    )


def family_proportions(df: DataFrame) -> DataFrame:
    """(family, bucket, n, share): shares within each family."""
    n = df.groupBy("family", "bucket").agg(F.count("*").alias("n"))
    total = n.groupBy("family").agg(F.sum("n").alias("total"))  # one row per family
    return n.join(F.broadcast(total), "family").select("family", "bucket", "n", F.round(F.try_divide(F.col("n").cast("double"), "total"), 6).alias("share"))


def proportions(df: DataFrame, bucket: str) -> DataFrame:
    """(bucket, n, share): the total is that of the few grouped rows."""
    n = df.groupBy(bucket).agg(F.count("*").alias("n"))
    total = df.agg(F.count("*").alias("total"))
    return n.crossJoin(F.broadcast(total)).select(bucket, "n", F.round(F.try_divide(F.col("n").cast("double"), "total"), 6).alias("share"))


def weighted_recall(by_bucket: DataFrame, weights: DataFrame) -> DataFrame:
    """(family, weighted, strict, coverage), per family of buckets: recall re-weighted by another split's shares; buckets never evaluated are left out of
    ``weighted`` and count 0 in ``strict``; ``coverage`` is the weight of the evaluated ones."""
    met = weights.join(by_bucket.where("evaluated > 0").select("family", "bucket", "recall_at_5"), ["family", "bucket"], "left")
    covered = F.when(F.col("recall_at_5").isNotNull(), F.col("share"))
    return met.groupBy("family").agg(
        F.round(F.coalesce(F.try_divide(F.sum(covered * F.col("recall_at_5")), F.sum(covered)), F.lit(0.0)), 6).alias("weighted"),
        F.round(F.sum(F.col("share") * F.coalesce("recall_at_5", F.lit(0.0))), 6).alias("strict"),
        F.round(F.coalesce(F.sum(covered), F.lit(0.0)), 6).alias("coverage"),
    )


def best_weight(grid: DataFrame, place: str, weight: str, recall: str) -> DataFrame:
    """(weight, recall): the row of a grid report that a fold in its order ends with: a row replaces the best so far if its
    recall, not rounded, is above the best one's rounded to six places. The grid is one row per combination."""
    rows = F.array_sort(F.collect_list(F.struct(F.col(place).alias("place"), F.col(weight).alias("weight"), F.col(recall).alias("recall"))))
    start = F.struct(F.lit(None).cast("double").alias("weight"), F.lit(-1.0).alias("recall"))
    step = lambda best, x: F.when(x["recall"] > best["recall"], F.struct(x["weight"].alias("weight"), F.round(x["recall"], 6).alias("recall"))).otherwise(best)
    return grid.agg(F.aggregate(rows, start, step).alias("b")).select("b.*")
