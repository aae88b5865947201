"""BM25 of candidates within their own pool."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidentia.functions import text as X
from evidentia.session import cut_lineage


def bm25(pool: DataFrame, query: str, document: str, keys: tuple[str, ...] = ("q_id", "cand_idx"), group: tuple[str, ...] = ("q_id",), k1: float = 1.5, b: float = 0.75) -> DataFrame:
    """(keys, bm25): Okapi BM25 of each row's document for its query, the corpus being the rows of its group.

    Only the query's terms are counted, in the row itself, so what is shuffled is one row per candidate and query term it
    has, never its words. Repeated query terms count as often as they stand. Without a shared term the score is 0.
    """
    rows = pool.select(*keys, X.tokens(query).alias("q"), X.tokens(document).alias("d"))
    counted = F.transform(
        F.array_intersect("q", "d"),
        lambda t: F.struct(
            t.alias("term"),
            F.size(F.filter("d", lambda x: x == t)).alias("tf"),
            F.size(F.filter("q", lambda x: x == t)).alias("qf"),
        ),
    )
    # Read three times below; the texts are read once.
    rows = cut_lineage(rows.select(*keys, F.size("d").alias("dl"), counted.alias("hits")))
    corpus = rows.groupBy(*group).agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"))
    hits = rows.select(*keys, "dl", F.inline_outer("hits"))
    # A query with different texts for one group would count a term once per row, as rows of a group share the query.
    df = hits.where("term is not null").groupBy(*group, "term").agg(F.count("*").alias("df"))
    scored = hits.join(df, [*group, "term"], "left").join(corpus, list(group))
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    length = 1 - b + b * F.greatest("dl", F.lit(1)) / F.greatest("avgdl", F.lit(1e-9))
    term = F.col("qf") * idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * length)
    return scored.groupBy(*keys).agg(F.coalesce(F.sum(term), F.lit(0.0)).alias("bm25"))
