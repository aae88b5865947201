"""The supervised ranker: 34 features per candidate, gradient-boosted trees, and fusion with the base score."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidentia.functions import text as X
from evidentia.operators import memory as M
from evidentia.operators import neighbors as N
from evidentia.operators.dense import dense
from evidentia.operators.fusion import linear
from evidentia.operators.lexical import bm25
from evidentia.operators.ranking import context_boost, group_best, minmax, rank_percentile
from evidentia.session import checkpoints, cut_lineage

WEIGHTS = {"bm25": 0.2, "dense": 0.65, "memory": 0.55, "similar": 0.15, "type_score": 0.0}
PRECISIONS = ("doc_content", "doc_page_layout_type", "doc_page_type", "doc_layout_type", "global_content")
FEATURES = (
    "base_norm", "bm25_norm", "dense_norm", "memory_norm", "precise_norm", "similar_norm", "type_score", "page_context_norm",
    "layout_context_norm", *(f"{v}_votes_norm" for v in N.VOTES), *(f"p_{k}" for k in PRECISIONS), "neighbor_best",
    "neighbor_mean3", "neighbor_share", "neighbor_has", "is_text", "is_image", "is_table", "is_figure", "is_chart",
    "is_picture", "has_page", "has_layout", "n_tokens", "bm25_pct", "dense_pct",
)


def type_score() -> F.Column:
    """1 if the candidate's type is expected, or text is and it is text."""
    hit = F.array_contains("expected", F.col("raw_type")) | ((F.col("modality") == "text") & F.array_contains("expected", "text"))
    return F.coalesce(hit, F.lit(False)).cast("double")


def scored(pool: DataFrame, vectors: DataFrame, reference: DataFrame | None = None, questions: DataFrame | None = None,
           reference_questions: DataFrame | None = None, leave_one_out: bool = False, topn: int = 3) -> DataFrame:
    """The pool with bm25, dense and type scores and, given a reference, memory, precise and similar ones."""
    keys = ["q_id", "cand_idx"]
    parts = [bm25(pool, "question", "doc_text"), dense(pool, vectors)]
    if reference is not None:
        parts.append(M.memory_scores(pool, reference, leave_one_out))
        near = N.similar_questions(questions, reference_questions, topn)
        parts.append(N.similar_gold_scores(pool, near, reference))
    out = pool.withColumn("type_score", type_score())
    return reduce(lambda a, b: a.join(b, keys), parts, out)


def features(pool: DataFrame, vectors: DataFrame, reference: DataFrame, questions: DataFrame, reference_questions: DataFrame,
             leave_one_out: bool = False, weights: dict[str, float] | None = None, topn: int = 3,
             boost: tuple[float, float] = (0.0, 0.0)) -> DataFrame:
    """(q_id, cand_idx, is_gold, the features, overlap_confidence, semantic, overlap). With ``leave_one_out`` a question's
    own evidence is subtracted from memory and it isn't its own neighbour."""
    w = {**WEIGHTS, **(weights or {})}
    keys = ["q_id", "cand_idx"]
    rows = scored(pool, vectors, reference, questions, reference_questions, leave_one_out, topn)
    # Of the texts only their length goes on.
    rows = cut_lineage(rows.withColumn("n_tokens", F.size(X.tokens("content")).cast("double")).drop("content"))
    rows = minmax(rows, ["bm25", "dense", "memory", "precise", "similar"])
    named = {("type_score" if k == "type_score" else f"{k}_norm"): v for k, v in w.items()}
    rows = context_boost(rows.withColumn("base", linear(named)), "base", *boost)
    rows = rows.withColumn("context", 0.5 * F.col("bm25_norm") + 0.5 * F.col("dense_norm"))
    rows = group_best(group_best(rows, "context", "page_id", "page_context"), "context", "layout_id", "layout_context")
    near = cut_lineage(N.question_neighbors(questions, reference_questions, topn))
    votes = N.neighbor_votes(pool, near, reference)
    rows = rows.join(votes, keys)
    rows = minmax(rows, ["base", "page_context", "layout_context", *(f"{v}_votes" for v in N.VOTES)])
    of_reference = M.keyed(reference, PRECISIONS)
    met = M.recalled(M.keyed(pool, PRECISIONS), M.memory_table(of_reference), of_reference if leave_one_out else None)
    precisions = met.groupBy(*keys).agg(*(F.max(F.when(F.col("key_name") == k, F.col("precision"))).alias(f"p_{k}") for k in PRECISIONS))
    rows = rows.join(precisions, keys, "left").fillna(0.0, [f"p_{k}" for k in PRECISIONS])
    rows = rows.join(N.neighbor_facts(questions, near, topn), "q_id")
    flags = {
        "is_text": F.col("modality") == "text", "is_image": F.col("modality") == "image", "is_table": F.col("raw_type") == "table",
        "is_figure": F.col("raw_type") == "figure", "is_chart": F.col("raw_type") == "chart", "is_picture": F.col("raw_type") == "image",
        "has_page": F.col("page_id").isNotNull(), "has_layout": F.col("layout_id").isNotNull(),
    }
    rows = rows.withColumns({k: F.coalesce(v, F.lit(False)).cast("double") for k, v in flags.items()})
    best = rows.groupBy("q_id").agg(*(F.max(f"{c}_norm").alias(f"_{c}") for c in ("precise", "exact_votes", "page_type_votes")))
    rows = rows.join(best, "q_id").withColumn("overlap_confidence", F.greatest("neighbor_best", "_precise", "_exact_votes", "_page_type_votes"))
    rows = rows.withColumn("semantic", linear({n: v for n, v in named.items() if n in ("bm25_norm", "dense_norm", "type_score")}))
    overlap = {"memory_norm": w["memory"], "precise_norm": 0.35, "similar_norm": w["similar"], "exact_votes_norm": 0.6, "page_votes_norm": 0.25,
               "page_type_votes_norm": 0.2, "layout_votes_norm": 0.1, "page_context_norm": 0.1}
    rows = rows.withColumn("overlap", linear(overlap))
    rows = rank_percentile(rank_percentile(rows, "bm25", "bm25_pct"), "dense", "dense_pct")
    kept = ["question_type", "expected", "doc_name", "split", "domain", "modality", "raw_type", "page_id", "layout_id", "quote_id", "question", "doc_text"]
    return rows.select(*keys, "is_gold", *kept, "base", *FEATURES, "overlap_confidence", "semantic", "overlap")


def fit(training: DataFrame, positive_weight: float = 4.0, iterations: int = 220, seed: int = 42, step: float = 0.05, depth: int = 6,
        leaf: int = 20, domain_balance: str = "none"):
    """Gradient-boosted trees over the features; a row weighs ``positive_weight`` if gold, times its domain's weight
    (``mining.domain_weights``). The rows stay distributed."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.feature import VectorAssembler

    from evidentia.operators.mining import domain_weights

    training = training.withColumn("domain", F.when(F.col("domain") != "", F.col("domain")).otherwise("unknown"))
    each = domain_weights(training.select("q_id", "domain").distinct().select("domain"), domain_balance)
    rows = training.join(F.broadcast(each.select("domain", F.col("weight").alias("_domain_weight"))), "domain")
    weight = F.when(F.col("is_gold"), positive_weight).otherwise(1.0) * F.col("_domain_weight")
    checkpoints(rows.sparkSession)  # every tenth iteration's residuals, whose lineage would grow with the iterations
    rows = cut_lineage(rows.select(*FEATURES, F.col("is_gold").cast("double").alias("label"), weight.alias("weight")))
    trees = GBTClassifier(
        maxIter=iterations, stepSize=step, maxDepth=depth, maxBins=255, minInstancesPerNode=leaf, weightCol="weight", seed=seed, checkpointInterval=10
    )
    return Pipeline(stages=[VectorAssembler(inputCols=list(FEATURES), outputCol="features"), trees]).fit(rows)


def predict(model, rows: DataFrame, model_weight: float = 0.75, base_weight: float = 0.25) -> DataFrame:
    """Adds ``final``: the scaled positive probability and the scaled base score, weighted."""
    from pyspark.ml.functions import vector_to_array

    out = model.transform(rows).withColumn("model", vector_to_array("probability")[1]).drop("features", "rawPrediction", "probability", "prediction")
    out = minmax(out, ["model"])
    return out.withColumn("final", model_weight * F.col("model_norm") + base_weight * F.col("base_norm"))
