"""Dense scores: dot products of vectors that an encoder left in a table."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evidentia.session import broadcast_if_small


def dot(a: Column | str, b: Column | str) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda s, x: s + x)


def with_vectors(df: DataFrame, vectors: DataFrame, on: Column, name: str) -> DataFrame:
    """Adds the vector whose vec_id is ``on``; the vector table is broadcast only if it is counted small."""
    v = vectors.select(F.col("vec_id").alias("_vec"), F.col("embedding").alias(name))
    return df.withColumn("_key", on).join(broadcast_if_small(v, 5_000), F.col("_key") == F.col("_vec"), "left").drop("_key", "_vec")


def model_encoder(load: Callable[[], Callable[[list], list]]) -> Callable[[Column], Column]:
    """An encoder around a model: ``load()`` runs once per worker and gives a function from a batch of texts, or of the bytes
    of pictures, to their vectors, which are scaled to length 1. An empty batch stays empty."""

    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = load()
        for values in batches:
            vectors = [np.asarray(v, np.float64) for v in model(list(values))] if len(values) else []
            yield pd.Series([(v / max(float(np.linalg.norm(v)), 1e-12)).astype(np.float32).tolist() for v in vectors], dtype=object)

    return encode


def cache_key(model: str, text: Column | str) -> Column:
    """What a text's vector is stored under: a digest of model and text, so that equal texts are encoded once."""
    return F.substring(F.sha2(F.concat_ws("\0", F.lit(model), text), 256), 1, 24)


def encoded(texts: DataFrame, text: str, model: str, encode: Callable[[Column], Column], cache: DataFrame) -> DataFrame:
    """(cache_key, vector, cached) for each distinct text: those in ``cache`` (cache_key, vector) as they are, the misses, found
    by an anti-join, encoded. What isn't ``cached`` is to be added to the cache."""
    distinct = texts.where(F.col(text).isNotNull()).select(cache_key(model, text).alias("cache_key"), F.col(text).alias("text")).dropDuplicates(["cache_key"])
    hits = cache.join(distinct, "cache_key", "left_semi").select("cache_key", "vector", F.lit(True).alias("cached"))
    misses = distinct.join(cache, "cache_key", "left_anti").select("cache_key", encode(F.col("text")).alias("vector"), F.lit(False).alias("cached"))
    return hits.unionByName(misses)


def dense(pool: DataFrame, vectors: DataFrame) -> DataFrame:
    """(q_id, cand_idx, dense): question and candidate are encoded by lookup; 0 where a vector is missing."""
    n = vectors.count()
    questions = with_vectors(pool.select("q_id").distinct(), vectors, F.pmod(F.col("q_id").cast("bigint"), F.lit(n)), "_q")
    rows = with_vectors(pool.select("q_id", "cand_idx", "cand_id"), vectors, F.pmod("cand_id", F.lit(n)), "_c")
    return rows.join(questions, "q_id").select("q_id", "cand_idx", F.coalesce(dot("_q", "_c"), F.lit(0.0)).alias("dense"))


def scorer(scores: DataFrame, method: str) -> DataFrame:
    """(q_id, cand_idx, <method>) of a scorer's delivered scores, the last of each candidate; null and NaN count as 0."""
    from evidentia.functions.text import strip
    from evidentia.sources.tables import latest

    s = scores.where(F.col("method") == method).withColumn("q_id", strip("q_id"))
    s = latest(s, ["q_id", "cand_idx"], [F.desc_nulls_last("scored_at"), F.desc("score_id")])
    value = F.when(F.col("score").isNull() | F.isnan("score"), 0.0).otherwise(F.col("score") + 0.0)
    return s.select("q_id", "cand_idx", value.alias(method))
