"""Rerankers and language-model selectors behind one contract: a column of scores from a column of pairs.

A scorer is a function (query column, document column) -> double column. A neural one wraps an iterator pandas UDF that
loads its model once per worker; the two here need no model and keep composed methods checkable.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from evidentia.functions import text as X
from evidentia.operators.ranking import PLACES, minmax

Scorer = Callable[[Column, Column], Column]


def cosine_scorer(query: Column, document: Column) -> Column:
    return X.token_cosine(X.tokens(query), X.tokens(document))


def jaccard_scorer(query: Column, document: Column) -> Column:
    return X.token_jaccard(X.tokens(query), X.tokens(document))


def model_scorer(load: Callable[[], Callable[[list[str], list[str]], list[float]]]) -> Scorer:
    """A scorer around a model: ``load()`` runs once per worker and gives a function of a batch of pairs."""

    @F.pandas_udf(T.DoubleType())
    def score(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        model = load()
        for query, document in batches:
            yield pd.Series(model(list(query), list(document)), dtype="float64")

    return score


def rerank(df: DataFrame, base: str, scorer: Scorer, top: int = 10, weight: float = 0.5) -> DataFrame:
    """Adds ``rerank_order``, the rank after rescoring the first ``top`` by (1 - weight) scaled base + weight scaled score.

    ``df`` has q_id, cand_idx, question, doc_text, ``base`` and base_rank. Only the first ``top`` reach the scorer; ties
    keep the base order, and the others follow in it.
    """
    head = df.where(F.col("base_rank") <= top).select("q_id", "cand_idx", base, "base_rank", scorer(F.col("question"), F.col("doc_text")).alias("_score"))
    head = minmax(head, [base, "_score"])
    fused = F.round((1 - weight) * F.col(f"{base}_norm") + weight * F.col("_score_norm"), PLACES)
    order = F.row_number().over(Window.partitionBy("q_id").orderBy(F.desc(fused), F.asc("base_rank")))
    head = head.select("q_id", "cand_idx", order.cast("bigint").alias("_head"))
    out = df.join(head, ["q_id", "cand_idx"], "left")
    return out.withColumn("rerank_order", F.coalesce("_head", "base_rank")).drop("_head")


#: What a causal reranker is told, unless its model brings its own. Fixed value.
INSTRUCTION = "Given a question, judge whether the document is evidence that helps to answer it."
SYSTEM = (
    "You are a retrieval assistant. Select the 5 most relevant evidence quote_ids for the question. Output only a JSON array of "
    "quote_ids ordered from most relevant to least relevant."
)
CLOSING = 'Return exactly one JSON array like ["text3", "image2", ...].'


def prompts(pool: DataFrame, questions: DataFrame, words: int = 320) -> DataFrame:
    """(q_id, line_no, line): each question's prompt line by line: the system's line, the question, its candidates' ids
    and first words in the pool's order, and the closing line.

    ``line_no`` rises along the prompt and follows cand_idx, so that no pool is gathered or ranked.
    """
    line = F.concat(F.lit("- "), "quote_id", F.lit(": "), X.first_words("doc_text", words))
    body = pool.join(questions.select("q_id"), "q_id", "left_semi").select("q_id", (F.col("cand_idx") + 3).alias("line_no"), line.alias("line"))
    last = pool.groupBy("q_id").agg(F.max("cand_idx").alias("_last"))
    frame = {0: F.lit(SYSTEM), 1: F.concat(F.lit("Question: "), "question"), 2: F.lit("Candidates:")}
    around = [F.struct(F.lit(n).cast("bigint").alias("line_no"), x.alias("line")) for n, x in frame.items()]
    around.append(F.struct((F.coalesce("_last", F.lit(-1).cast("bigint")) + 4).alias("line_no"), F.lit(CLOSING).alias("line")))
    rows = questions.join(last, "q_id", "left").select("q_id", F.explode(F.array(*around)).alias("_l")).select("q_id", "_l.*")
    return rows.unionByName(body)
