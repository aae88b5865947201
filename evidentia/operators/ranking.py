"""Scaling, ranking and cutting scores within the pool of a question.

Group facts are aggregated before the shuffle and joined back rather than computed in a window, so that the pool that
holds a tenth of all rows is never in one task: adaptive execution splits it in the join.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from evidentia.session import cut_lineage

#: Scores are compared at this many places, so that the order of a sum's terms can't change a rank.
PLACES = 6


def scaled(x: Column, low: Column, high: Column) -> Column:
    """(x - low) / (high - low); 0 where all scores of the group are the same."""
    flat = high - low <= 1e-9 * F.greatest(F.abs(low), F.abs(high))
    return F.when(flat, 0.0).otherwise(F.try_divide(x - low, high - low))


def minmax(df: DataFrame, columns: list[str], group: tuple[str, ...] = ("q_id",), suffix: str = "_norm") -> DataFrame:
    """Adds ``<column>_norm`` for each column, scaled within the group."""
    facts = df.groupBy(*group).agg(*(f(c).alias(f"_{n}_{c}") for c in columns for n, f in (("lo", F.min), ("hi", F.max))))
    out = df.join(facts, list(group))
    for c in columns:
        out = out.withColumn(f"{c}{suffix}", scaled(F.col(c), F.col(f"_lo_{c}"), F.col(f"_hi_{c}")))
    return out.drop(*(f"_{n}_{c}" for c in columns for n in ("lo", "hi")))


def by_score(score: str) -> list[Column]:
    return [F.desc(F.round(F.col(score), PLACES)), F.asc("cand_idx")]


def top_k(df: DataFrame, score: str, k: int = 5, group: tuple[str, ...] = ("q_id",)) -> DataFrame:
    """The k best rows of each group with their ``rank``; each task keeps k rows a group before the shuffle."""
    rank = F.row_number().over(Window.partitionBy(*group).orderBy(*by_score(score))).cast("bigint")
    return df.withColumn("rank", rank).where(F.col("rank") <= k)


def ranges(df: DataFrame, group: list[str], order: list[Column]) -> DataFrame:
    """``df`` laid out in ranges of group and order, written once, with the column ``_range``."""
    return cut_lineage(df.repartitionByRange(*(F.col(g) for g in group), *order).withColumn("_range", F.spark_partition_id()))


def running(df: DataFrame, group: list[str], order: list[Column], value: Column, name: str) -> DataFrame:
    """Adds the running sum of ``value`` over the group in the order, without gathering a group: sums within ranges, shifted
    by the sums of the group's ranges before. ``order`` must be total within a group."""
    laid = ranges(df.withColumn("_value", value), group, order)
    sums = laid.groupBy(*group, "_range").agg(F.sum("_value").alias("_sum"))
    before = Window.partitionBy(*group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # one row per range
    sums = sums.select(*group, "_range", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_before"))
    inside = F.sum("_value").over(Window.partitionBy(*group, "_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    out = laid.withColumn("_inside", inside).join(sums, [*group, "_range"])
    return out.withColumn(name, F.col("_inside") + F.col("_before")).drop("_range", "_inside", "_before", "_value")


def ranked(df: DataFrame, group: list[str], order: list[Column], name: str = "rank") -> DataFrame:
    """Adds the rank of every row in its group without gathering a group. ``df`` should be slim, as its rows are moved."""
    out = running(df, group, order, F.lit(1).cast("bigint"), name)
    return out.withColumn(name, F.col(name).cast("bigint"))


def ranks(df: DataFrame, score: str, name: str) -> DataFrame:
    """(q_id, cand_idx, <name>): the rank of every candidate in its pool by score."""
    return ranked(df.select("q_id", "cand_idx", score), ["q_id"], by_score(score), name).drop(score)


def rank_percentile(df: DataFrame, score: str, name: str) -> DataFrame:
    """Adds 1 - (rank - 1) / (n - 1); 1 in a pool of one."""
    n = df.groupBy("q_id").agg(F.count("*").alias("_n"))
    out = df.join(ranks(df, score, "_rank"), ["q_id", "cand_idx"]).join(n, "q_id")
    share = F.when(F.col("_n") <= 1, 1.0).otherwise(1 - F.try_divide((F.col("_rank") - 1).cast("double"), F.col("_n") - 1))
    return out.withColumn(name, share).drop("_rank", "_n")


def group_best(df: DataFrame, score: str, place: str, name: str) -> DataFrame:
    """Adds the best score among candidates of the same page or layout; 0 where it is null."""
    best = df.where(F.col(place).isNotNull()).groupBy("q_id", place).agg(F.max(score).alias(name))
    return df.join(best, ["q_id", place], "left").withColumn(name, F.coalesce(name, F.lit(0.0)))


def context_boost(df: DataFrame, score: str, page_weight: float = 0.0, layout_weight: float = 0.0) -> DataFrame:
    """Adds to the score the scaled best score of its page and of its layout, both of the scores as they were."""
    weights = {"page_id": page_weight, "layout_id": layout_weight}
    weights = {p: w for p, w in weights.items() if w > 0}
    if not weights:
        return df
    for place in weights:
        df = group_best(df, score, place, f"_{place}_best")
    df = minmax(df, [f"_{p}_best" for p in weights])
    total = reduce(lambda a, b: a + b, (w * F.col(f"_{p}_best_norm") for p, w in weights.items()), F.col(score))
    return df.withColumn(score, total).drop(*(f"_{p}_best{s}" for p in weights for s in ("", "_norm")))
