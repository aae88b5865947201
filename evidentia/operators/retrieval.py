"""Retrieval methods over any questions and any reference: one pipeline of scores, fusion, boost, reranking and forcing.

A method answers the questions of a pool against the evidence of reference questions. A question that is itself among the
reference is scored without its own evidence.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, fields, replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from evidentia.functions import text as X
from evidentia.operators import fusion as U
from evidentia.operators import memory as M
from evidentia.operators import neighbors as N
from evidentia.operators import ranker as R
from evidentia.operators import ranking as K
from evidentia.operators import rerank as RR
from evidentia.operators.dense import dense
from evidentia.operators.lexical import bm25
from evidentia.session import cut_lineage

KEYS = ["q_id", "cand_idx"]
SLIM = ["question", "question_type", "expected", "doc_name", "split", "modality", "raw_type", "page_id", "layout_id", "quote_id", "doc_text"]


@dataclass(frozen=True)
class Settings:
    """Parameters of all methods, with the defaults of the pipeline they stand for. Fixed values."""

    top_k: int = 5
    seed: int = 42
    bm25_weight: float = 0.35
    dense_weight: float = 0.65
    memory_weight: float = 0.55
    type_weight: float = 0.35
    page_weight: float = 0.0
    layout_weight: float = 0.0
    force_memory_top: int = 0
    similar_weight: float = 0.0
    similar_topn: int = 3
    use_reranker: bool = False
    rerank_topk: int = 10
    reranker_weight: float = 0.5
    dual_primary_weight: float = 1.15
    dual_secondary_weight: float = 1.0
    dual_base_weight: float = 0.45
    dual_rrf_k: int = 60
    ranker_iterations: int = 220
    ranker_step: float = 0.05
    ranker_depth: int = 6
    ranker_leaf: int = 20
    ranker_positive_weight: float = 4.0
    ranker_model_weight: float = 0.75
    ranker_base_weight: float = 0.25
    ranker_domain_balance: str = "none"
    use_coverage: bool = False
    coverage_page: float = 0.08
    coverage_layout: float = 0.04
    coverage_modality: float = 0.05
    coverage_raw_type: float = 0.03
    coverage_missing: float = 0.12
    route_low_documents: int = 3
    route_high_documents: int = 10
    route_low_confidence: float = 0.2
    route_high_confidence: float = 0.4
    route_low_quotas: tuple[int, int, int] = (3, 1, 1)
    route_high_quotas: tuple[int, int, int] = (2, 2, 1)
    llm_words: int = 320

    def given(self, **changes: object) -> Settings:
        return replace(self, **changes)


NAMES = tuple(f.name for f in fields(Settings))
#: Methods without a model trained on the reference.
UNTRAINED = (
    "bm25", "dense", "hybrid", "typed_hybrid", "memory", "memory_hybrid", "typed_memory_hybrid", "reranker_only", "dual_reranker", "llm", "image",
)
METHODS = (*UNTRAINED[:9], "doc_aware_ranker", "routed_doc_aware", *UNTRAINED[9:])


@dataclass(frozen=True)
class Data:
    """What a method works on: the pools of the questions to answer and of the reference, their questions, vectors."""

    pool: DataFrame
    reference_pool: DataFrame
    questions: DataFrame
    reference: DataFrame
    vectors: DataFrame
    #: What ``scored`` gave, for several methods to share.
    scores: DataFrame | None = None


def with_text(pool: DataFrame) -> DataFrame:
    return pool.withColumn("doc_text", X.document_text("raw_type", "content"))


def lexical(pool: DataFrame) -> DataFrame:
    return bm25(with_text(pool), "question", "doc_text")


def similar(data: Data, topn: int) -> DataFrame:
    near = N.similar_questions(data.questions, data.reference, topn)
    return N.similar_gold_scores(data.pool, near, data.reference_pool)


def scored(data: Data, columns: tuple[str, ...], topn: int = 3) -> DataFrame:
    """The pool with the wanted scores of bm25, dense, type_score, memory, precise and similar, each also scaled."""
    if data.scores is not None and {f"{c}_norm" for c in columns} <= set(data.scores.columns):
        return data.scores
    parts = []
    if "bm25" in columns:
        parts.append(lexical(data.pool))
    if "dense" in columns:
        parts.append(dense(data.pool, data.vectors))
    if "memory" in columns or "precise" in columns:
        both = M.memory_scores(data.pool, data.reference_pool, leave_one_out=True)
        parts.append(both.select(*KEYS, *(c for c in ("memory", "precise") if c in columns)))
    if "similar" in columns:
        parts.append(similar(data, topn))
    rows = with_text(data.pool).withColumn("type_score", R.type_score())
    rows = rows.select(*KEYS, *(c for c in SLIM if c in rows.columns), "type_score")
    return K.minmax(reduce(lambda a, b: a.join(b, KEYS), parts, rows), list(columns))


def fused(data: Data, s: Settings, memory: bool, typed: bool) -> DataFrame:
    """``score`` of the hybrid, or of the memory hybrid, with the type score if typed and the context's boost."""
    weights = {"bm25": s.bm25_weight, "dense": s.dense_weight}
    if memory:
        weights |= {"memory": s.memory_weight, "similar": s.similar_weight}
    if typed:
        weights["type_score"] = s.type_weight
    weights = {c: w for c, w in weights.items() if w}
    columns = tuple(weights) + (("precise",) if memory and s.force_memory_top else ())
    rows = scored(data, columns, s.similar_topn)
    rows = rows.withColumn("score", U.linear({f"{c}_norm": w for c, w in weights.items()}) if weights else F.lit(0.0))
    if s.page_weight or s.layout_weight:  # read several times by the boost
        rows = cut_lineage(rows)
    return K.context_boost(rows, "score", s.page_weight, s.layout_weight)


def _reranked(rows: DataFrame, score: str, scorer: RR.Scorer, s: Settings, weight: float | None = None) -> DataFrame:
    """The first rerank_topk or top_k of each question by ``score`` with their rank after reranking."""
    most = max(s.rerank_topk, s.top_k)
    head = cut_lineage(K.top_k(rows, score, most).withColumnRenamed("rank", "base_rank"))
    return RR.rerank(head, score, scorer, s.rerank_topk, s.reranker_weight if weight is None else weight)


def _answer(rows: DataFrame, s: Settings, rank: str = "rank") -> DataFrame:
    return rows.where(F.col(rank) <= s.top_k).select("q_id", F.col(rank).alias("rank"), "quote_id")


def _ordered(rows: DataFrame, s: Settings, scorer: RR.Scorer, score: str = "score") -> DataFrame:
    """The first of each question by score, reranked if wanted, with ``rank``."""
    if s.use_reranker:
        return _reranked(rows, score, scorer, s).withColumn("rank", F.col("rerank_order"))
    return K.top_k(rows, score, s.top_k)


def hybrid(data: Data, s: Settings, scorer: RR.Scorer, typed: bool = False) -> DataFrame:
    return _answer(_ordered(fused(data, s, False, typed), s, scorer), s)


def memory(data: Data, s: Settings) -> DataFrame:
    rows = scored(data, ("bm25", "memory")).withColumn("score", U.linear({"bm25_norm": s.bm25_weight, "memory_norm": s.memory_weight}))
    return _answer(K.top_k(rows, "score", s.top_k), s)


def memory_hybrid(data: Data, s: Settings, scorer: RR.Scorer, typed: bool = False) -> DataFrame:
    rows = fused(data, s, True, typed)
    if not s.force_memory_top:
        return _answer(_ordered(rows, s, scorer), s)
    rows = cut_lineage(rows)
    # Forced candidates lead, best first; the others follow in the order so far, of which the first top_k suffice.
    order = _ordered(rows, s, scorer).select(*KEYS, F.col("rank").alias("base_rank"))
    lead = [F.desc(F.round("precise", K.PLACES)), *K.by_score("score")]
    first = rows.where(F.round("precise", K.PLACES) > 0).withColumn("_f", F.row_number().over(Window.partitionBy("q_id").orderBy(*lead)))
    first = first.where(F.col("_f") <= s.force_memory_top).select(*KEYS, "_f")
    both = order.join(first, KEYS, "full")
    at = F.when(F.col("_f").isNotNull(), F.struct(F.lit(0).alias("late"), F.col("_f").cast("bigint").alias("n")))
    at = at.otherwise(F.struct(F.lit(1).alias("late"), F.col("base_rank").alias("n")))
    rank = F.row_number().over(Window.partitionBy("q_id").orderBy(at)).cast("bigint")
    return _answer(both.withColumn("rank", rank).join(rows.select(*KEYS, "quote_id"), KEYS), s)


def reranker_only(data: Data, s: Settings, scorer: RR.Scorer) -> DataFrame:
    """Whole pools by the reranker's score."""
    rows = with_text(data.pool).select(*KEYS, "quote_id", scorer(F.col("question"), F.col("doc_text")).alias("score"))
    return _answer(K.top_k(rows, "score", s.top_k), s)


def dual_reranker(data: Data, s: Settings, first: RR.Scorer, second: RR.Scorer) -> DataFrame:
    """Reciprocal ranks of two rerankings of the memory hybrid, each at weight 0.7, and of its own order.

    Beyond rerank_topk all three lists have the same order, so that the head of each that long decides the first top_k.
    """
    rows = fused(data, s, True, False)
    most = max(s.rerank_topk, s.top_k)
    head = cut_lineage(K.top_k(rows, "score", most).withColumnRenamed("rank", "base_rank").select(*KEYS, "quote_id", "question", "doc_text", "score", "base_rank"))
    lists = [
        (RR.rerank(head, "score", x, s.rerank_topk, 0.7).select(*KEYS, F.col("rerank_order").alias("rank")), w)
        for x, w in ((first, s.dual_primary_weight), (second, s.dual_secondary_weight))
    ]
    lists.append((head.select(*KEYS, F.col("base_rank").alias("rank")), s.dual_base_weight))
    out = U.reciprocal_rank_fusion(lists, k=s.dual_rrf_k)
    return _answer(out.join(head.select(*KEYS, "quote_id"), KEYS), s)


def image(data: Data, s: Settings) -> DataFrame:
    """Text candidates by BM25 among text, images by vectors, each scaled within its modality."""
    pool = with_text(data.pool)
    text = K.minmax(lexical(pool.where("modality = 'text'")), ["bm25"]).select(*KEYS, F.col("bm25_norm").alias("score"))
    picture = K.minmax(dense(pool.where("modality = 'image'"), data.vectors), ["dense"]).select(*KEYS, F.col("dense_norm").alias("score"))
    return _answer(K.top_k(text.unionByName(picture).join(pool.select(*KEYS, "quote_id"), KEYS), "score", s.top_k), s)


def llm(data: Data, s: Settings, said: DataFrame) -> DataFrame:
    """What a language model selected, filled up by BM25. ``said`` has q_id and output, the model's text.

    Ids are matched with the pool by a join, so that no pool is gathered into a list of allowed ids.
    """
    ids = said.select("q_id", X.quote_ids("output").alias("x")).select("q_id", F.posexplode("x.listed").alias("n", "quote_id"), F.lit(0).alias("found"))
    mentioned = said.select("q_id", X.quote_ids("output").alias("x")).select("q_id", F.posexplode("x.mentioned").alias("n", "quote_id"), F.lit(1).alias("found"))
    known = data.pool.select("q_id", "quote_id").distinct()
    named = ids.unionByName(mentioned).join(known, ["q_id", "quote_id"]).groupBy("q_id", "quote_id", "found").agg(F.min("n").alias("n"))
    # Mentions count only where no listed id is known.
    best = named.groupBy("q_id").agg(F.min("found").alias("found"))
    named = named.join(best, ["q_id", "found"]).select("q_id", "quote_id", F.struct(F.lit(0).alias("late"), F.col("n").cast("bigint").alias("n")).alias("at"))
    # Named ids take at most top_k of BM25's first 2 top_k.
    rest = K.top_k(scored(data, ("bm25",)), "bm25", 2 * s.top_k)
    rest = rest.select("q_id", "quote_id", F.struct(F.lit(1).alias("late"), F.col("rank").alias("n")).alias("at"))
    both = named.unionByName(rest).groupBy("q_id", "quote_id").agg(F.min("at").alias("at"))
    rank = F.row_number().over(Window.partitionBy("q_id").orderBy("at")).cast("bigint")
    return _answer(both.withColumn("rank", rank), s)


def ranker_rows(data: Data, s: Settings | None = None) -> DataFrame:
    """The ranker's features of all pools. The ranker's base score has weights of its own unless settings are given."""
    weights = None if s is None else {"bm25": s.bm25_weight, "dense": s.dense_weight, "memory": s.memory_weight, "similar": s.similar_weight, "type_score": s.type_weight}
    pages = (0.0, 0.0) if s is None else (s.page_weight, s.layout_weight)
    return R.features(
        with_text(data.pool), data.vectors, data.reference_pool, data.questions, data.reference, leave_one_out=True, weights=weights,
        topn=3 if s is None else s.similar_topn, boost=pages,
    )


def ranked_by_model(data: Data, s: Settings, is_reference: Column, base: Settings | None = None) -> DataFrame:
    """Features of all pools with ``final``, of a model fitted on those of the reference."""
    rows = cut_lineage(ranker_rows(data, base))
    model = R.fit(
        rows.where(is_reference), s.ranker_positive_weight, s.ranker_iterations, s.seed, s.ranker_step, s.ranker_depth, s.ranker_leaf, s.ranker_domain_balance
    )
    return cut_lineage(R.predict(model, rows, s.ranker_model_weight, s.ranker_base_weight))


def _covered(rows: DataFrame, order: DataFrame, s: Settings) -> DataFrame:
    """The coverage choice over an order (q_id, cand_idx, rank) of the first of each pool; the order itself elsewhere."""
    return U.coverage_select(
        rows, "final", order, s.top_k, s.coverage_page, s.coverage_layout, s.coverage_modality, s.coverage_raw_type, s.coverage_missing
    )


def doc_aware_ranker(rows: DataFrame, s: Settings, scorer: RR.Scorer) -> DataFrame:
    order = _ordered(rows, s, scorer, "final")
    if s.use_coverage:
        order = _covered(rows, order.select(*KEYS, "rank"), s).join(rows.select(*KEYS, "quote_id"), KEYS)
    return _answer(order, s)


def routed_doc_aware(rows: DataFrame, s: Settings, counts: DataFrame) -> DataFrame:
    """Documents known well, with strong overlap, take from final, overlap and semantic lists by the high quotas, others
    known by the low ones; the rest by the final score. ``counts`` has doc_name and doc_count."""
    q = rows.select("q_id", "doc_name", "overlap_confidence").distinct().join(counts, "doc_name", "left")
    known, sure = F.coalesce("doc_count", F.lit(0)), F.col("overlap_confidence")
    high = (known >= s.route_high_documents) & (sure >= s.route_high_confidence)
    low = (known >= s.route_low_documents) & (sure >= s.route_low_confidence)
    routes = q.select("q_id", F.when(high, "high").when(low, "low").otherwise("plain").alias("route"))
    most = s.top_k + max(sum(s.route_high_quotas), sum(s.route_low_quotas))
    lists = {c: cut_lineage(K.top_k(rows, c, most).select(*KEYS, "rank").join(routes, "q_id")) for c in ("final", "overlap", "semantic")}
    out = lists["final"].where(F.col("route") == "plain").where(F.col("rank") <= s.top_k).select(*KEYS, "rank")
    for name, quotas in (("high", s.route_high_quotas), ("low", s.route_low_quotas)):
        own = [x.where(F.col("route") == name) for x in lists.values()]
        out = out.unionByName(U.quota_union(list(zip(own, quotas, strict=True)), own[0], s.top_k))
    if s.use_coverage:
        out = _covered(rows, out, s)
    return _answer(out.join(rows.select(*KEYS, "quote_id"), KEYS), s)


def methods(data: Data, s: Settings, is_reference: Column, first: RR.Scorer = RR.cosine_scorer, second: RR.Scorer = RR.jaccard_scorer,
            said: Callable[[Data], DataFrame] | None = None) -> dict[str, Callable[[], DataFrame]]:
    """Every method by name as a function of nothing that gives (q_id, rank, quote_id)."""

    def bm25_only() -> DataFrame:
        return _answer(K.top_k(scored(data, ("bm25",)), "bm25", s.top_k), s)

    def dense_only() -> DataFrame:
        return _answer(K.top_k(scored(data, ("dense",)), "dense", s.top_k), s)

    def routed() -> DataFrame:
        counts = data.reference.groupBy("doc_name").agg(F.count("*").alias("doc_count"))
        return routed_doc_aware(ranked_by_model(data, s, is_reference, s), s, counts)

    return {
        "bm25": bm25_only,
        "dense": dense_only,
        "hybrid": lambda: hybrid(data, s, first),
        "typed_hybrid": lambda: hybrid(data, s, first, typed=True),
        "memory": lambda: memory(data, s),
        "memory_hybrid": lambda: memory_hybrid(data, s, first),
        "typed_memory_hybrid": lambda: memory_hybrid(data, s, first, typed=True),
        "reranker_only": lambda: reranker_only(data, s, first),
        "dual_reranker": lambda: dual_reranker(data, s, first, second),
        "doc_aware_ranker": lambda: doc_aware_ranker(ranked_by_model(data, s, is_reference, s), s, first),
        "routed_doc_aware": routed,
        "llm": lambda: llm(data, s, said(data)),
        "image": lambda: image(data, s),
    }
