"""Combining scores and rankings: reciprocal ranks, quotas, routing, insertion and coverage."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from evidentia.operators.ranking import PLACES, minmax
from evidentia.session import broadcast_if_small, cut_lineage


def linear(weights: dict[str, float]) -> Column:
    return reduce(lambda a, b: a + b, (F.lit(w) * F.col(c) for c, w in weights.items()))


def reciprocal_rank_fusion(lists: list[tuple[DataFrame, float]], item: str = "cand_idx", k: int = 60) -> DataFrame:
    """(q_id, item, rrf, rank) from ranked lists (q_id, item, rank from 1) with weights.

    The sum of weight / (k + rank) decides, then the place of first appearance, list by list.
    """
    rows = reduce(
        DataFrame.unionByName,
        (
            df.select("q_id", item, (F.lit(float(w)) / (F.lit(k) + F.col("rank"))).alias("part"), F.struct(F.lit(i).alias("list"), F.col("rank").alias("rank")).alias("seen"))
            for i, (df, w) in enumerate(lists)
        ),
    )
    fused = rows.groupBy("q_id", item).agg(F.sum("part").alias("rrf"), F.min("seen").alias("_seen"))
    order = Window.partitionBy("q_id").orderBy(F.desc(F.round("rrf", 9)), F.asc("_seen"))
    return fused.withColumn("rank", F.row_number().over(order).cast("bigint")).drop("_seen")


def quota_union(lists: list[tuple[DataFrame, int]], fallback: DataFrame, k: int = 5) -> DataFrame:
    """(q_id, cand_idx, rank): from each list in turn its quota of items not taken yet, then from ``fallback``, up to k.

    The first k + quotas rows of a list are all that can be taken from it.
    """
    taken: DataFrame | None = None
    most = k + sum(q for _, q in lists)
    for i, (df, quota) in enumerate([*lists, (fallback, k)]):
        rest = df.where(F.col("rank") <= most).select("q_id", "cand_idx", "rank")
        if taken is not None:
            rest = rest.join(taken.select("q_id", "cand_idx"), ["q_id", "cand_idx"], "left_anti")
        place = F.row_number().over(Window.partitionBy("q_id").orderBy("rank"))
        picked = rest.withColumn("n", place).where(F.col("n") <= quota).select("q_id", "cand_idx", F.struct(F.lit(i).alias("list"), F.col("n").alias("n")).alias("at"))
        taken = picked if taken is None else taken.unionByName(picked)
    order = Window.partitionBy("q_id").orderBy("at")
    return taken.withColumn("rank", F.row_number().over(order).cast("bigint")).where(F.col("rank") <= k).drop("at")


def answers(ranked: DataFrame, item: str = "quote_id") -> DataFrame:
    """(q_id, answer): each question's items in the order of their ranks; ``ranked`` is already cut."""
    return ranked.groupBy("q_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", item))), lambda x: x[item]).alias("answer"))


def gated(questions: DataFrame, a: DataFrame, b: DataFrame, use_a: Column) -> DataFrame:
    """(q_id, answer): a's answer where the condition on the question holds, else b's; a missing one is empty."""
    out = questions.join(a.withColumnRenamed("answer", "_a"), "q_id", "left").join(b.withColumnRenamed("answer", "_b"), "q_id", "left")
    chosen = F.when(use_a, F.col("_a")).otherwise(F.col("_b"))
    return out.select("q_id", F.coalesce(chosen, F.array().cast("array<string>")).alias("answer"))


def consensus_insert(base: DataFrame, systems: list[DataFrame], k: int = 5) -> DataFrame:
    """(q_id, answer): the item most systems rank first, ties to the smaller id, joins the base answer if it isn't there,
    in place of the last of k."""
    firsts = reduce(DataFrame.unionByName, (s.select("q_id", F.try_element_at("answer", F.lit(1)).alias("item")) for s in systems))
    counted = firsts.where("item is not null").groupBy("q_id", "item").agg(F.count("*").alias("n"))
    voted = counted.groupBy("q_id").agg(F.min_by("item", F.struct(-F.col("n"), F.col("item"))).alias("item"))
    out = base.join(voted, "q_id", "left")
    inserted = F.concat(F.slice("answer", 1, k - 1), F.array("item"))
    keep = F.col("item").isNull() | F.array_contains("answer", F.col("item"))
    return out.select("q_id", F.when(keep, F.col("answer")).otherwise(inserted).alias("answer"))


VISUAL = ("table", "figure", "chart", "image")


def needs_coverage(pool: DataFrame, order: DataFrame, k: int = 5) -> DataFrame:
    """(q_id) of comparative questions that expect text and pictures and whose first k lack a modality or crowd on two pages."""
    visual = F.array(*map(F.lit, VISUAL))
    mixed = (F.col("question_type") == "Comparative") & F.array_contains("expected", "text") & F.arrays_overlap("expected", visual)
    first = pool.where(mixed).join(order.where(F.col("rank") <= k), ["q_id", "cand_idx"]).groupBy("q_id").agg(
        F.count_if(F.col("modality") == "text").alias("texts"), F.count_if(F.col("modality") == "image").alias("images"),
        F.count("page_id").alias("pages"), F.countDistinct("page_id").alias("distinct_pages"),
    )
    return first.where("texts = 0 or images = 0 or (pages >= 3 and distinct_pages <= 2)").select("q_id")


def coverage_select(
    pool: DataFrame, base: str, order: DataFrame, k: int = 5, page: float = 0.08, layout: float = 0.04, modality: float = 0.05,
    raw_type: float = 0.03, missing: float = 0.12,
) -> DataFrame:
    """(q_id, cand_idx, rank): greedy choice that spreads over pages, layouts, modalities and types for questions that need
    it (``needs_coverage``); else the first k of ``order`` (q_id, cand_idx, rank).

    A step takes the best adjusted score, ties to the smaller cand_idx. The score is 0.7 times the scaled base and 0.3 times
    1 - (rank - 1) / (n - 1), 0 for what the order doesn't list. Each of the k steps is one aggregate over all pools, which
    is combined before the shuffle, so that no pool is gathered in a task; what is carried on is k places a question. All
    candidates of one page, layout, modality and type are adjusted alike, so that the k best of each kind suffice.
    """
    needed = cut_lineage(needs_coverage(pool, order, k))
    plain = order.where(F.col("rank") <= k).join(needed, "q_id", "left_anti").select("q_id", "cand_idx", "rank")
    wants = F.arrays_overlap("expected", F.array(*map(F.lit, VISUAL))).alias("wants_visual")
    kind = ["page_id", "layout_id", "modality", "raw_type"]
    todo = pool.select("q_id", "cand_idx", *kind, wants, F.col(base).alias("_base")).join(needed, "q_id", "left_semi")
    n = todo.groupBy("q_id").agg(F.count("*").alias("_n"))
    todo = minmax(todo.join(n, "q_id"), ["_base"]).join(order.select("q_id", "cand_idx", F.col("rank").alias("_rank")), ["q_id", "cand_idx"], "left")
    listed = F.when(F.col("_n") <= 1, 1.0).otherwise(1 - F.try_divide((F.col("_rank") - 1).cast("double"), F.col("_n") - 1))
    score = F.round(0.7 * F.col("_base_norm") + 0.3 * F.when(F.col("_rank").isNull(), 0.0).otherwise(listed), PLACES)
    alike = Window.partitionBy("q_id", *kind).orderBy(F.desc("score"), F.asc("cand_idx"))
    todo = todo.withColumn("score", score).withColumn("_k", F.row_number().over(alike)).where(F.col("_k") <= k)
    todo = cut_lineage(todo.select("q_id", "cand_idx", *kind, "wants_visual", "score"))
    place = "struct<cand_idx:bigint,page_id:bigint,layout_id:bigint,modality:string,raw_type:string>"
    chosen = needed.withColumn("chosen", F.array().cast(f"array<{place}>"))
    alike_count = lambda c: F.size(F.filter("chosen", lambda x: x[c] == F.col(c)))
    has = lambda m: F.exists("chosen", lambda x: x["modality"] == m)
    for _ in range(k):
        met = todo.join(broadcast_if_small(chosen), "q_id").where(~F.exists("chosen", lambda x: x["cand_idx"] == F.col("cand_idx")))
        adjusted = (
            F.col("score") - page * F.coalesce(F.exists("chosen", lambda x: x["page_id"] == F.col("page_id")), F.lit(False)).cast("double")
            - layout * F.coalesce(F.exists("chosen", lambda x: x["layout_id"] == F.col("layout_id")), F.lit(False)).cast("double")
            - modality * F.greatest(alike_count("modality") - 1, F.lit(0)) - raw_type * alike_count("raw_type")
            + missing * ((F.col("modality") == "text") & ~has("text")).cast("double")
            + missing * ((F.col("modality") == "image") & F.col("wants_visual") & ~has("image")).cast("double")
        )
        best = F.max_by(F.struct("cand_idx", *kind), F.struct(F.round(adjusted, 9), -F.col("cand_idx")))
        step = met.groupBy("q_id").agg(best.alias("next"))
        grown = F.when(F.col("next").isNull(), F.col("chosen")).otherwise(F.concat("chosen", F.array(F.col("next").cast(place))))
        chosen = cut_lineage(chosen.join(step, "q_id", "left").select("q_id", grown.alias("chosen")))
    spread = chosen.select("q_id", F.posexplode("chosen").alias("n", "x")).select("q_id", F.col("x.cand_idx").alias("cand_idx"), (F.col("n") + 1).cast("bigint").alias("rank"))
    return plain.unionByName(spread)
