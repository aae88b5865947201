"""Buckets, preferences and statistics of a data set and of answers to it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidentia.functions import text as X
from evidentia.operators.ranking import PLACES


def with_domain_bucket(df: DataFrame) -> DataFrame:
    return df.withColumn("bucket", F.when(F.col("domain") != "", F.col("domain")).otherwise("unknown"))


def long_domains(df: DataFrame) -> DataFrame:
    return with_domain_bucket(df).select("bucket")


def gold_modality(questions: DataFrame, candidates: DataFrame) -> DataFrame:
    """(q_id, gold_modality): mixed, text_only, image_only or none, by the candidates that are gold."""
    gold = questions.select("q_id", F.explode(F.array_distinct("gold")).alias("quote_id")).where("quote_id <> ''")
    met = gold.join(candidates.select("q_id", "quote_id", "modality"), ["q_id", "quote_id"])
    met = met.groupBy("q_id").agg(F.bool_or(F.col("modality") == "text").alias("t"), F.bool_or(F.col("modality") != "text").alias("i"))
    out = questions.select("q_id").join(met, "q_id", "left")
    kind = F.expr("case when t and i then 'mixed' when i then 'image_only' when t then 'text_only' else 'none' end")
    return out.select("q_id", kind.alias("gold_modality"))


FAMILIES = ("doc_frequency", "overlap_confidence", "domain_bucket", "type_bucket", "gold_len", "gold_modality")
#: Families whose shares don't depend on gold, and so are known of a test split.
OPEN_FAMILIES = FAMILIES[:3]


def bucketed(questions: DataFrame, candidates: DataFrame, reference: DataFrame, neighbors: DataFrame) -> DataFrame:
    """Questions with a bucket of each family: document frequency in the reference, confidence of the best neighbour's score
    (``neighbors`` of ``question_neighbors``; none is 0), domain, type, gold count and modality."""
    counts = reference.groupBy("doc_name").agg(F.count("*").alias("n"))
    best = neighbors.where("n_rank = 1").select("q_id", F.col("score").alias("best"))
    out = questions.join(counts, "doc_name", "left").join(gold_modality(questions, candidates), "q_id").join(best, "q_id", "left")
    out = out.withColumn("overlap_confidence", X.confidence_bucket(F.round(F.coalesce("best", F.lit(0.0)), PLACES)))
    named = lambda c: F.when(F.col(c) != "", F.col(c)).otherwise("unknown")
    return out.withColumns(
        {
            "doc_frequency": X.frequency_bucket(F.coalesce("n", F.lit(0))), "domain_bucket": named("domain"), "type_bucket": named("question_type"),
            "gold_len": F.size(F.filter("gold", lambda g: g != "")).cast("string"),
        }
    )


def long_buckets(df: DataFrame, families: tuple[str, ...] = FAMILIES) -> DataFrame:
    """One row per question and family, so one aggregation serves all families."""
    return df.select(*(c for c in ("recall",) if c in df.columns), F.inline(F.array(*(F.struct(F.lit(f).alias("family"), F.col(f).alias("bucket")) for f in families))))


def preference(ranked: DataFrame, candidates: DataFrame, questions: DataFrame) -> DataFrame:
    """Per set of expected types: questions, answers by modality and their shares and averages; what isn't text is image."""
    key = F.array_join(F.array_sort("types"), "|")
    met = ranked.join(candidates.select("q_id", "quote_id", "cand_idx", "modality").groupBy("q_id", "quote_id").agg(F.max_by("modality", "cand_idx").alias("modality")), ["q_id", "quote_id"])
    met = met.groupBy("q_id").agg(F.count_if(F.col("modality") == "text").alias("t"), F.count_if(F.col("modality") != "text").alias("i"))
    rows = questions.select("q_id", key.alias("types_key")).join(met, "q_id", "left").fillna(0, ["t", "i"])
    out = rows.groupBy("types_key").agg(F.count("*").alias("n"), F.sum("t").alias("text_cnt"), F.sum("i").alias("image_cnt"))
    total = F.col("text_cnt") + F.col("image_cnt")
    return out.select(
        "types_key", "n", "text_cnt", "image_cnt",
        F.round(F.coalesce(F.try_divide(F.col("text_cnt").cast("double"), total), F.lit(0.0)), 4).alias("text_share"),
        F.round(F.col("text_cnt") / F.col("n").cast("double"), 4).alias("text_avg"),
    )


def stats(questions: DataFrame, candidates: DataFrame) -> DataFrame:
    """Per split: questions, distinct documents and average pool sizes, by modality."""
    c = candidates.groupBy("q_id").agg(F.count("*").alias("c"), F.count_if(F.col("modality") == "text").alias("t"))
    rows = questions.join(c, "q_id", "left").fillna(0, ["c", "t"])
    return rows.groupBy("split").agg(
        F.count("*").alias("n"), F.countDistinct("doc_name").alias("docs"), F.round(F.avg("c"), 3).alias("avg_candidates"),
        F.round(F.avg("t"), 3).alias("avg_text"), F.round(F.avg(F.col("c") - F.col("t")), 3).alias("avg_image"),
    )


def most_common(df: DataFrame, k: int) -> DataFrame:
    """(value, n): the k most frequent values, ties by first appearance (sample_pos), then by value."""
    n = df.groupBy("value").agg(F.count("*").alias("n"), F.min("sample_pos").alias("first"))
    return n.orderBy(F.desc("n"), F.asc("first"), F.asc("value")).limit(k).select("value", "n")


def kinds(ranked: DataFrame, candidates: DataFrame) -> DataFrame:
    """(facet, value, n, share): how often answers are of each modality and of each raw type, overall. Of a quote that a pool
    has twice, the last counts."""
    last = candidates.groupBy("q_id", "quote_id").agg(F.max_by(F.struct("modality", "raw_type"), "cand_idx").alias("c"))
    met = ranked.join(last, ["q_id", "quote_id"]).select(F.inline(F.array(*(F.struct(F.lit(x).alias("facet"), F.col(f"c.{x}").alias("value")) for x in ("modality", "raw_type")))))
    n = met.groupBy("facet", "value").agg(F.count("*").alias("n"))
    total = n.groupBy("facet").agg(F.sum("n").alias("total"))
    return n.join(F.broadcast(total), "facet").select("facet", "value", "n", F.round(F.col("n") / F.col("total").cast("double"), 4).alias("share"))


def gold_lengths(questions: DataFrame) -> DataFrame:
    """(split, gold_len, n): questions by number of gold ids, blank ones counted."""
    return questions.groupBy("split", F.size("gold").cast("bigint").alias("gold_len")).agg(F.count("*").alias("n"))
