"""Memory of gold evidence: how often a candidate with the same key was gold among the reference questions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidentia.functions import text as X
from evidentia.session import broadcast_if_small

#: The parts of each key. Null pages and layouts are values like others.
KEYS = {
    "doc_page_layout_type": ("doc_name", "page_id", "layout_id", "raw_type"),
    "doc_page_layout": ("doc_name", "page_id", "layout_id"),
    "doc_page_type": ("doc_name", "page_id", "raw_type"),
    "doc_layout_type": ("doc_name", "layout_id", "raw_type"),
    "doc_page": ("doc_name", "page_id"),
    "doc_layout": ("doc_name", "layout_id"),
    "doc_type": ("doc_name", "raw_type"),
    "quote_id": ("quote_id",),
    "raw_type": ("raw_type",),
    "modality": ("modality",),
    "expected_raw_type": ("expected_key", "raw_type"),
    "expected_modality": ("expected_key", "modality"),
    "expected_quote_id": ("expected_key", "quote_id"),
    "question_type_raw_type": ("question_type", "raw_type"),
    "domain_raw_type": ("domain", "raw_type"),
    "doc_content": ("doc_name", "content_md5"),
    "global_content": ("content_md5",),
}
#: Keys with few values, which would gather in few tasks if they were shuffled by value.
BROAD = ("raw_type", "modality", "expected_raw_type", "expected_modality", "question_type_raw_type", "domain_raw_type")
#: Weights of the keys in the three scores. Fixed values.
MEMORY = {
    "doc_content": 1.35, "doc_page_layout_type": 1.15, "doc_page_layout": 0.85, "doc_page_type": 0.55, "doc_layout_type": 0.45,
    "global_content": 0.25, "doc_page": 0.18, "doc_layout": 0.14, "doc_type": 0.04, "expected_raw_type": 0.18,
    "expected_modality": 0.10, "expected_quote_id": 0.08, "question_type_raw_type": 0.06, "domain_raw_type": 0.05,
    "quote_id": 0.04, "raw_type": 0.03, "modality": 0.02,
}
PRECISE = {"doc_content": 1.6, "doc_page_layout_type": 1.4, "doc_page_layout": 1.0, "doc_page_type": 0.65, "doc_layout_type": 0.55}
SIMILAR = {"doc_content": 1.25, "doc_page_layout_type": 1.10, "doc_page_layout": 0.80, "doc_page_type": 0.45, "doc_layout_type": 0.35}


def keyed(pool: DataFrame, names: tuple[str, ...] = tuple(KEYS)) -> DataFrame:
    """(q_id, cand_idx, is_gold, key_name, key): one row per candidate and key; content is a key by its digest."""
    text = X.content_key("content")
    pool = pool.withColumn("content_md5", F.when(text != "", F.md5(text)))

    def key(parts: tuple[str, ...]) -> Column:
        values = [F.coalesce(F.col(p).cast("string"), F.lit("\x02null")) for p in parts]
        return F.concat_ws("\x01", *values)

    made = [F.struct(F.lit(n).alias("key_name"), key(KEYS[n]).alias("key")) for n in names if "content_md5" not in KEYS[n]]
    of_text = [F.struct(F.lit(n).alias("key_name"), key(KEYS[n]).alias("key")) for n in names if "content_md5" in KEYS[n]]
    pairs = F.array(*made) if made else None
    if of_text:
        extra = F.when(F.col("content_md5").isNotNull(), F.array(*of_text)).otherwise(F.array().cast("array<struct<key_name:string,key:string>>"))
        pairs = F.concat(pairs, extra) if made else extra
    return pool.select("q_id", "cand_idx", "is_gold", F.inline(pairs))


def memory_table(keys: DataFrame) -> DataFrame:
    """(key_name, key, candidate_cnt, gold_cnt), combined before the shuffle."""
    return keys.groupBy("key_name", "key").agg(F.count("*").alias("candidate_cnt"), F.count_if("is_gold").alias("gold_cnt"))


def recalled(keys: DataFrame, memory: DataFrame, without: DataFrame | None = None) -> DataFrame:
    """Keys with ``precision`` and ``support`` in memory; ``without`` holds keys of questions whose own candidates are
    subtracted, which equals a memory built without the question.

    Keys with few values meet a counted small memory by broadcast, the others by shuffle.
    """
    broad = F.col("key_name").isin(*BROAD)
    on = ["key_name", "key"]
    met = keys.where(~broad).join(memory.where(~broad), on).unionByName(keys.where(broad).join(broadcast_if_small(memory.where(broad)), on))
    gold, seen = F.col("gold_cnt"), F.col("candidate_cnt")
    if without is not None:
        own = without.groupBy("q_id", *on).agg(F.count("*").alias("own_cnt"), F.count_if("is_gold").alias("own_gold"))
        met = met.join(own, ["q_id", *on], "left")
        gold, seen = gold - F.coalesce("own_gold", F.lit(0)), seen - F.coalesce("own_cnt", F.lit(0))
    met = met.select("q_id", "cand_idx", *on, gold.alias("g"), seen.alias("c"))
    useful = (F.col("g") > 0) & (F.col("c") > 0)
    return met.select(
        "q_id", "cand_idx", "key_name",
        F.when(useful, F.try_divide(F.col("g").cast("double"), F.col("c"))).otherwise(0.0).alias("precision"),
        F.when(useful, F.log1p(F.col("g").cast("double"))).otherwise(0.0).alias("support"),
    )


def weighted(column: str, weights: dict[str, float]) -> Column:
    return reduce(lambda rest, kv: F.when(F.col(column) == kv[0], kv[1]).otherwise(rest), weights.items(), F.lit(0.0))


def memory_scores(pool: DataFrame, reference: DataFrame, leave_one_out: bool = False) -> DataFrame:
    """(q_id, cand_idx, memory, precise): both scores from one pass over the keys."""
    keys, of_reference = keyed(pool), keyed(reference)
    met = recalled(keys, memory_table(of_reference), of_reference if leave_one_out else None)
    both = met.groupBy("q_id", "cand_idx").agg(
        *(F.sum(weighted("key_name", w) * F.col("precision") * F.col("support")).alias(n) for n, w in (("memory", MEMORY), ("precise", PRECISE)))
    )
    zero = F.lit(0.0)
    out = pool.select("q_id", "cand_idx").join(both, ["q_id", "cand_idx"], "left")
    return out.select("q_id", "cand_idx", F.coalesce("memory", zero).alias("memory"), F.coalesce("precise", zero).alias("precise"))

