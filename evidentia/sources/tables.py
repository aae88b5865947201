"""The two tables everything is computed from, cleaned of repeated deliveries and uneven spelling."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from evidentia.functions import text as X
from evidentia.session import table

REFERENCE, DEV, TEST = "train", "validation", "test"


def latest(df: DataFrame, keys: list[str], newest_first: list) -> DataFrame:
    """The row of each key that comes first in the order; each task keeps one row a key before the shuffle."""
    n = F.row_number().over(Window.partitionBy(*keys).orderBy(*newest_first))
    return df.withColumn("_n", n).where("_n = 1").drop("_n")


def samples(spark: SparkSession, d: str) -> DataFrame:
    """One row per question, of its last delivery."""
    s = table(spark, d, "samples").withColumn("q_id", X.strip("q_id")).where("q_id <> ''")
    s = latest(s, ["q_id"], [F.desc_nulls_last("ingested_at"), F.desc("sample_pos")])
    old_id = X.strip("old_id")
    empty = F.array().cast("array<string>")
    expected = X.expected_types("evidence_modality_type")
    return s.select(
        "q_id", "sample_pos", F.when(old_id != "", old_id).alias("old_id"), X.strip("split").alias("split"),
        X.strip("doc_name").alias("doc_name"), X.strip("domain").alias("domain"), X.normalize("question").alias("question"),
        X.strip("question_type").alias("question_type"),
        F.transform(F.coalesce("evidence_modality_type", empty), X.strip).alias("types"), expected.alias("expected"),
        F.array_join(expected, ",").alias("expected_key"),
        F.transform(F.coalesce("gold_quotes", empty), X.strip).alias("gold"),
    )


def candidates(spark: SparkSession, d: str) -> DataFrame:
    """One row per question and place in its pool, of its last delivery."""
    c = table(spark, d, "candidates").withColumn("q_id", X.strip("q_id")).where("q_id <> '' and cand_idx is not null")
    c = latest(c, ["q_id", "cand_idx"], [F.desc_nulls_last("ingested_at"), F.desc("cand_id")])
    raw_type = X.strip("raw_type")
    path = X.strip("img_path")
    return c.select(
        "q_id", "cand_idx", "cand_id", X.strip("quote_id").alias("quote_id"), "modality",
        F.lower(F.when(raw_type != "", raw_type).otherwise(F.col("modality"))).alias("raw_type"),
        X.normalize("content").alias("content"), "page_id", "layout_id", F.when(path != "", path).alias("img_path"),
    )


def pools(spark: SparkSession, d: str, split: str | None = None) -> DataFrame:
    """Candidates with their question's columns; ``is_gold`` tells whether they are among its gold quotes."""
    s = samples(spark, d)
    if split:
        s = s.where(F.col("split") == split)
    return candidates(spark, d).join(s, "q_id").withColumn("is_gold", F.array_contains("gold", F.col("quote_id")))
