"""Training pairs for a reranker: positives, hard negatives and random negatives."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from evidentia.operators.ranking import by_score


def domain_weights(samples: DataFrame, mode: str = "uniform") -> DataFrame:
    """(domain, n, weight): questions over domains times the domain's questions, or its root; 1 with mode none."""
    n = samples.groupBy("domain").agg(F.count("*").alias("n"))
    total = n.agg(F.sum("n").alias("total"), F.count("*").alias("domains"))
    ratio = F.col("total") / (F.col("domains") * F.col("n")).cast("double")
    weight = {"none": F.lit(1.0), "uniform": ratio, "sqrt": F.sqrt(ratio)}.get(mode)
    if weight is None:
        raise ValueError(f"unknown mode: {mode}")
    return n.crossJoin(F.broadcast(total)).select("domain", "n", weight.alias("weight"))


def training_pairs(
    pool: DataFrame, score: str, hard: int = 6, random: int = 2, positive_weight: float = 3.0, hard_weight: float = 1.3,
    seed: int = 42, domain_weight: Column | None = None,
) -> DataFrame:
    """(q_id, cand_idx, label, kind, weight) for questions with gold candidates.

    All positives, the ``hard`` best others by base score and ``random`` of the rest, in an order fixed by a digest. The
    rest need only be looked for among the first hard + random by digest.
    """
    has_gold = pool.where("is_gold").select("q_id").distinct()
    pool = pool.join(has_gold, "q_id", "left_semi")
    each = domain_weight if domain_weight is not None else F.lit(1.0)
    positives = pool.where("is_gold").select("q_id", "cand_idx", F.lit(1).alias("label"), F.lit("positive").alias("kind"), (F.lit(positive_weight) * each).alias("weight"))
    others = pool.where("not is_gold")
    place = F.row_number().over(Window.partitionBy("q_id").orderBy(*by_score(score)))
    hardest = others.withColumn("_n", place).where(F.col("_n") <= hard)
    digest = F.md5(F.concat_ws(":", "q_id", F.col("cand_idx").cast("string"), F.lit(str(seed))))
    drawn = others.withColumn("_d", digest)
    order = Window.partitionBy("q_id").orderBy("_d", "cand_idx")
    drawn = drawn.withColumn("_m", F.row_number().over(order)).where(F.col("_m") <= hard + random)
    drawn = drawn.join(hardest.select("q_id", "cand_idx"), ["q_id", "cand_idx"], "left_anti")
    drawn = drawn.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= random)
    negative = lambda df, kind, w: df.select("q_id", "cand_idx", F.lit(0).alias("label"), F.lit(kind).alias("kind"), (F.lit(w) * each).alias("weight"))
    return positives.unionByName(negative(hardest, "hard", hard_weight)).unionByName(negative(drawn, "random", 1.0))
