"""The best N items of every group, by cutoffs that are refined for all groups at once."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from evidentia.session import cut_lineage

_PARTS = [f"p{i}" for i in range(6)]
_PARTS_TYPE = T.StructType([T.StructField(p, T.LongType()) for p in _PARTS])


@F.pandas_udf(_PARTS_TYPE)
def _code(score: pd.Series, tie: pd.Series, spare: pd.Series) -> pd.DataFrame:
    """An order-preserving code as six numbers of 32 bits, largest first: score, tie (smaller is better), spare."""

    def halves(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return (x >> np.uint64(32)).astype(np.int64), (x & np.uint64(0xFFFFFFFF)).astype(np.int64)

    top = np.uint64(1 << 63)
    bits = (score.to_numpy(np.float64) + 0.0).view(np.uint64)
    bits = np.where(bits & top, ~bits, bits | top)
    tied = ~(tie.to_numpy(np.int64).view(np.uint64) ^ top)
    rest = ~(spare.to_numpy(np.int64).view(np.uint64) ^ top)
    return pd.DataFrame(dict(zip(_PARTS, [y for x in (bits, tied, rest) for y in halves(x)], strict=True)))


def _bounds() -> list[F.Column]:
    return [F.count("*").alias("n")] + [f(p).alias(f"{p}_{n}") for p in _PARTS for n, f in (("lo", F.min), ("hi", F.max))]


def _next_state() -> list[F.Column]:
    """The first part of the code on which a group's open rows differ, its range, and how many rows are still sought."""
    part, lo, hi = F.lit(len(_PARTS)), F.lit(0), F.lit(0)
    for i, p in reversed(list(enumerate(_PARTS))):
        differs = F.col(f"{p}_lo") < F.col(f"{p}_hi")
        part, lo, hi = (F.when(differs, a).otherwise(b) for a, b in ((F.lit(i), part), (F.col(f"{p}_lo"), lo), (F.col(f"{p}_hi"), hi)))
    return [part.alias("part"), lo.alias("lo"), hi.alias("hi")]


def best_of_groups(rows: DataFrame, groups: list[str], item: str, n: int = 5, fan: int = 16, hot_share: int = 1000) -> DataFrame:
    """The ``n`` best rows of each group, or all of a smaller one: columns ``groups`` and ``item``.

    ``rows`` has ``groups``, ``item``, score (double, not null or NaN) and tie (bigint); higher scores first, then smaller
    ties, then items by a fixed hash. Every row gets a code in that order. Each round cuts the range of every unfinished
    group's open codes into ``fan`` equal parts, counts rows in each (combined before the shuffle), keeps those above
    the part with the ``n``-th row, drops those below and goes on within it. Rows with one code, which are repeated
    rows, count as one. No group is sorted or held in one task: rows of groups with over 1 / ``hot_share`` of all rows,
    of which there are fewer than ``hot_share``, meet their state by broadcast, all others by shuffle.
    """
    spare = F.xxhash64(item)
    tie = F.coalesce(F.col("tie").cast("long"), F.lit((1 << 63) - 1))
    coded = rows.select(*groups, item, _code("score", tie, spare).alias("c")).select(*groups, item, "c.*")
    open_rows = cut_lineage(coded.dropDuplicates([*groups, item]))
    state = cut_lineage(open_rows.groupBy(*groups).agg(*_bounds()))
    total = open_rows.count()
    hot = F.broadcast(state.where(F.col("n") * hot_share > total).select(*groups, F.lit(True).alias("hot")))
    mark = F.coalesce("hot", F.lit(False)).alias("hot")
    open_rows = open_rows.join(hot, groups, "left").select(*groups, item, *_PARTS, mark)
    whole = F.col("n") <= n
    part, lo, hi = _next_state()
    state = state.join(hot, groups, "left").select(*groups, mark, F.when(whole, -1).otherwise(part).alias("part"), lo, hi, F.lit(n).alias("left"))
    on = [*groups, "hot"]
    value = F.lit(0)
    for i, p in reversed(list(enumerate(_PARTS))):
        value = F.when(F.col("part") == i, F.col(p)).otherwise(value)
    width = F.when((F.col("part") >= 0) & (F.col("part") < len(_PARTS)), F.col("hi") - F.col("lo") + 1)
    slot = F.floor((value - F.col("lo")) * fan / width)
    # Rows that are kept lie above the range.
    slot = F.coalesce(F.least(F.greatest(slot, F.lit(0)), F.lit(fan)), F.lit(0)).cast("int").alias("slot")

    def meet(rows: DataFrame, facts: DataFrame) -> DataFrame:
        met = rows.where("hot").join(F.broadcast(facts.where("hot")), on)
        return met.unionByName(rows.where("not hot").join(facts.where("not hot"), on))

    met = cut_lineage(meet(open_rows, state).select(*on, item, *_PARTS, "left", slot, (F.col("part") < 0).alias("kept")))
    accepted = [met.where("kept").select(*groups, item)]
    # At most ``fan`` rows a group meet in a window.
    higher = Window.partitionBy(*on).orderBy(F.desc("slot")).rowsBetween(Window.unboundedPreceding, -1)
    while True:
        open_rows = met.where("not kept")
        counts = open_rows.groupBy(*on, "slot", "left").agg(*_bounds())
        counts = counts.withColumn("left", F.col("left") - F.coalesce(F.sum("n").over(higher), F.lit(0)))
        cuts = counts.where("left > 0 and n >= left").select(
            *on, F.col("slot").alias("cut"), (F.col("n") == F.col("left")).alias("done"), F.col("left").cast("int"), *_next_state()
        )
        cuts = cut_lineage(cuts)
        if cuts.isEmpty():
            break
        met = meet(open_rows.drop("left"), cuts).where("slot >= cut")
        kept = (F.col("slot") > F.col("cut")) | F.col("done") | (F.col("part") == len(_PARTS))
        met = cut_lineage(met.select(*on, item, *_PARTS, "left", slot, kept.alias("kept")))
        accepted.append(met.where("kept").select(*groups, item))
    out = accepted[0]
    for a in accepted[1:]:
        out = out.unionByName(a)
    return out


def trimmed(column: str) -> F.Column:
    """Without white space of any kind around it."""
    return F.regexp_replace(F.col(column), r"(?U)^\s+|\s+$", "")


def best_quotes(scores: DataFrame, n: int = 5) -> DataFrame:
    """The ``n`` best quotes of each question and scorer: (q_id bigint, method, quote_id).

    Ids are compared trimmed. Of rows for one question, scorer and quote the one scored last counts, on equal times the
    largest score_id; if its score is null or NaN, the quote isn't ranked. -0.0 equals 0.0. Ties go to the smaller
    cand_idx, null last, then to a fixed hash of quote_id. Rows whose q_id isn't a number, or whose method or quote_id
    is null, are left out; an empty table gives no rows.
    """
    rows = scores.select(
        trimmed("q_id").try_cast("bigint").alias("q_id"), "method", trimmed("quote_id").alias("quote_id"), "score", "cand_idx",
        F.struct("scored_at", "score_id").alias("at"),
    ).where("q_id is not null and method is not null and quote_id is not null")
    last = rows.groupBy("q_id", "method", "quote_id").agg(F.max_by(F.struct("score", "cand_idx"), "at").alias("x"))
    ranked = last.select("q_id", "method", "quote_id", F.col("x.score").alias("score"), F.col("x.cand_idx").alias("tie"))
    ranked = ranked.where("score is not null and not isnan(score)")
    return best_of_groups(ranked, ["q_id", "method"], "quote_id", n)
