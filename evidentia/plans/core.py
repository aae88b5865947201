"""Registered queries over the given tables: the evidence pipeline, operator by operator."""

from __future__ import annotations

import itertools
from collections.abc import Callable
from dataclasses import replace
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evidentia.functions import text as X
from evidentia.operators import analysis as A
from evidentia.operators import fusion as U
from evidentia.operators import memory as M
from evidentia.operators import metrics as E
from evidentia.operators import mining
from evidentia.operators import neighbors as N
from evidentia.operators import ranker as R
from evidentia.operators import ranking as K
from evidentia.operators import rerank as RR
from evidentia.operators import retrieval as RT
from evidentia.operators import splits as S
from evidentia.operators.dense import dense, encoded, scorer
from evidentia.operators.retrieval import Data, Settings, lexical
from evidentia.operators.retrieval import with_text as texts
from evidentia.session import cut_lineage, fresh_path, table
from evidentia.sources import records
from evidentia.sources.tables import DEV, REFERENCE, TEST, candidates, latest, pools, samples

KEYS = ["q_id", "cand_idx"]
HYBRID = {"bm25_norm": 0.35, "dense_norm": 0.65}
#: Weights of the sweep, in the order of their grid. Fixed values.
SWEEP = {
    "bm25": (0.25, 0.35, 0.45), "dense": (0.55, 0.65, 0.75), "memory": (0.25, 0.4, 0.55, 0.7, 0.9), "type_score": (0.0, 0.05, 0.1, 0.15, 0.25),
}
FUSION = (0.35, 0.45, 0.55, 0.65, 0.8, 1.0)
IS_REFERENCE = f"split = '{REFERENCE}'"
_registry: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    _registry[f.__name__] = f
    return f


def r6(name: str, *columns: str) -> list[F.Column]:
    return [F.round(c, 6).alias(c) for c in (name, *columns)]


def data(spark: SparkSession, d: str, split: str | None = None) -> Data:
    """The pools of a split, or all, against those of the reference split; cleaned once."""
    s, pool = cut_lineage(samples(spark, d)), cut_lineage(pools(spark, d))
    of = lambda x: x.where(F.col("split") == split) if split else x
    return Data(of(pool), pool.where(IS_REFERENCE), of(s), s.where(IS_REFERENCE), table(spark, d, "embeddings"))


def answered(spark: SparkSession, d: str, ranked: DataFrame, split: str | None = None) -> DataFrame:
    q = samples(spark, d)
    q = q.where(F.col("split") == split) if split else q
    return E.with_recall(q, U.answers(ranked))


def top(df: DataFrame, score: str, k: int = 5) -> DataFrame:
    return K.top_k(df, score, k).select("q_id", "rank", "quote_id")


@query
def normalize_text(spark, d):
    return table(spark, d, "candidates").select("cand_id", X.normalize("content").alias("text"))


@query
def tokenize(spark, d):
    t = X.tokens("content")
    return table(spark, d, "candidates").select("cand_id", F.size(t).cast("bigint").alias("n"), F.array_join(t, " ").alias("tokens"))


@query
def candidate_text(spark, d):
    return candidates(spark, d).select(*KEYS, X.document_text("raw_type", "content").alias("doc_text"))


@query
def expected_type(spark, d):
    return pools(spark, d).select(*KEYS, "expected_key", R.type_score().alias("type_score"))


@query
def question_order(spark, d):
    """Numeric ids first by value, then the others."""
    number = F.col("q_id").try_cast("bigint")
    s = samples(spark, d).select("q_id", number.isNull().cast("int").alias("late"), number.alias("number"))
    order = [F.asc("late"), F.asc_nulls_last("number"), F.asc("q_id")]
    return S.positions(s, order, "place").select("q_id", "place")


@query
def bm25_scores(spark, d):
    return lexical(pools(spark, d)).select(*KEYS, *r6("bm25"))


@query
def bm25_top5(spark, d):
    pool = pools(spark, d)
    return top(lexical(pool).join(pool.select(*KEYS, "quote_id"), KEYS), "bm25")


@query
def bm25_eval(spark, d):
    return E.evaluate(answered(spark, d, bm25_top5(spark, d)), "split")


@query
def dense_scores(spark, d):
    return dense(candidates(spark, d), table(spark, d, "embeddings")).select(*KEYS, *r6("dense"))


@query
def dense_top5(spark, d):
    c = candidates(spark, d)
    return top(dense(c, table(spark, d, "embeddings")).join(c.select(*KEYS, "quote_id"), KEYS), "dense")


@query
def minmax(spark, d):
    return K.minmax(scorer(table(spark, d, "scores"), "bm25"), ["bm25"]).select(*KEYS, *r6("bm25_norm"))


@query
def rank_percentile(spark, d):
    return K.rank_percentile(scorer(table(spark, d, "scores"), "bm25"), "bm25", "pct").select(*KEYS, *r6("pct"))


@query
def context_boost(spark, d):
    rows = scorer(table(spark, d, "scores"), "dense").join(candidates(spark, d).select(*KEYS, "page_id", "layout_id"), KEYS)
    return K.context_boost(rows, "dense", 0.1, 0.05).select(*KEYS, *r6("dense"))


@query
def hybrid_top5(spark, d):
    return RT.hybrid(data(spark, d), Settings(), RR.cosine_scorer)


@query
def typed_hybrid_top5(spark, d):
    return RT.hybrid(data(spark, d), Settings(), RR.cosine_scorer, typed=True)


@query
def boosted_hybrid_top5(spark, d):
    """The typed hybrid with the context's boost, reranked."""
    return RT.hybrid(data(spark, d), Settings(page_weight=0.1, layout_weight=0.05, use_reranker=True), RR.cosine_scorer, typed=True)


@query
def memory_table(spark, d):
    return M.memory_table(M.keyed(pools(spark, d, REFERENCE))).select("key_name", F.md5("key").alias("key"), "candidate_cnt", "gold_cnt")


@query
def memory_precision_loo(spark, d):
    keys = M.keyed(pools(spark, d, REFERENCE), R.PRECISIONS)
    return M.recalled(keys, M.memory_table(keys), keys).select(*KEYS, "key_name", *r6("precision", "support"))


@query
def memory_scores(spark, d):
    """All pools; those of the reference without their question's own evidence."""
    return M.memory_scores(pools(spark, d), pools(spark, d, REFERENCE), leave_one_out=True).select(*KEYS, *r6("memory", "precise"))


@query
def memory_scores_loo(spark, d):
    reference = pools(spark, d, REFERENCE)
    return M.memory_scores(reference, reference, leave_one_out=True).select(*KEYS, *r6("memory", "precise"))


@query
def memory_top5(spark, d):
    return RT.memory(data(spark, d), Settings())


@query
def memory_hybrid_top5(spark, d):
    return RT.memory_hybrid(data(spark, d), Settings(), RR.cosine_scorer)


@query
def typed_memory_hybrid_top5(spark, d):
    """With similar questions, the type score, the context's boost and a reranker."""
    settings = Settings(similar_weight=0.15, page_weight=0.1, layout_weight=0.05, use_reranker=True)
    return RT.memory_hybrid(data(spark, d), settings, RR.cosine_scorer, typed=True)


@query
def force_memory(spark, d):
    """The memory hybrid with up to two candidates of precise memory in front."""
    return RT.memory_hybrid(data(spark, d), Settings(force_memory_top=2), RR.cosine_scorer)


def asked(spark, d) -> tuple[DataFrame, DataFrame]:
    """The stated query set, every question whose id is divisible by 20, and the reference questions."""
    s = cut_lineage(samples(spark, d))
    return s.where(F.col("q_id").try_cast("bigint") % 20 == 0), s.where(F.col("split") == REFERENCE)


@query
def question_similarity(spark, d):
    return N.question_pairs(*asked(spark, d)).select("q_id", "ref_q_id", *r6("similarity"))


@query
def similar_memory(spark, d):
    q, ref = asked(spark, d)
    near = N.similar_questions(q, ref, 3)
    pool = pools(spark, d).join(q.select("q_id"), "q_id", "left_semi")
    return N.similar_gold_scores(pool, near, pools(spark, d, REFERENCE)).select(*KEYS, *r6("similar"))


@query
def neighbors(spark, d):
    return N.question_neighbors(*asked(spark, d)).select("q_id", "ref_q_id", "n_rank", *r6("score"))


@query
def neighbor_facts(spark, d):
    q, ref = asked(spark, d)
    facts = N.neighbor_facts(q, N.question_neighbors(q, ref))
    return facts.select("q_id", *r6(*(f"neighbor_{c}" for c in ("best", "mean3", "share", "has"))))


@query
def neighbor_votes(spark, d):
    q, ref = asked(spark, d)
    pool = pools(spark, d).join(q.select("q_id"), "q_id", "left_semi")
    votes = N.neighbor_votes(pool, N.question_neighbors(q, ref), pools(spark, d, REFERENCE))
    return votes.select(*KEYS, *r6(*(f"{v}_votes" for v in N.VOTES)))


def scorer_lists(spark, d) -> tuple[DataFrame, DataFrame]:
    """The two scorers' ranked lists, first twenty."""
    return tuple(K.top_k(scorer(table(spark, d, "scores"), m), m, 20).select(*KEYS, "rank") for m in ("bm25", "dense"))


@query
def rrf(spark, d):
    """Reciprocal ranks summed over the whole lists of both scorers; the first ten."""
    a, b = (K.ranked(scorer(table(spark, d, "scores"), m), ["q_id"], K.by_score(m)).select(*KEYS, "rank") for m in ("bm25", "dense"))
    out = U.reciprocal_rank_fusion([(a, 1.0), (b, 0.5)])
    return out.where("rank <= 10").select(*KEYS, "rank", F.round("rrf", 9).alias("rrf"))


@query
def quota_union(spark, d):
    a, b = scorer_lists(spark, d)
    return U.quota_union([(a, 2), (b, 2)], a)


def submissions(spark, d) -> tuple[DataFrame, DataFrame]:
    """Answers of the two scorers, five ids each."""
    c = candidates(spark, d).select(*KEYS, "quote_id")
    return tuple(U.answers(x.where("rank <= 5").join(c, KEYS).select("q_id", "rank", "quote_id")) for x in scorer_lists(spark, d))


@query
def submission_rrf(spark, d):
    lists = [(a.select("q_id", F.posexplode("answer").alias("p", "quote_id")).withColumn("rank", F.col("p") + 1), w) for a, w in zip(submissions(spark, d), (1.0, 2.0), strict=True)]
    return U.reciprocal_rank_fusion(lists, "quote_id").where("rank <= 5").select("q_id", "rank", "quote_id")


def routed(spark, d, use_a) -> DataFrame:
    a, b = submissions(spark, d)
    s = samples(spark, d)
    seen = s.where((F.col("split") == REFERENCE) & (F.col("doc_name") != "")).select("doc_name", F.lit(True).alias("seen")).distinct()
    out = U.gated(s.join(seen, "doc_name", "left"), a, b, use_a)
    return out.select("q_id", F.array_join("answer", " ").alias("answer"))


@query
def seen_doc_gate(spark, d):
    return routed(spark, d, F.col("seen").isNotNull())


@query
def question_type_route(spark, d):
    return routed(spark, d, F.col("question_type") == "Descriptive")


@query
def consensus_insert(spark, d):
    a, b = submissions(spark, d)
    return U.consensus_insert(a, [a, b, b]).select("q_id", F.array_join("answer", " ").alias("answer"))


@query
def rerank_stub(spark, d):
    return RT.hybrid(data(spark, d), Settings(use_reranker=True), RR.cosine_scorer)


@query
def reranker_only(spark, d):
    return RT.reranker_only(data(spark, d), Settings(), RR.cosine_scorer)


@query
def dual_rerank_stub(spark, d):
    return RT.dual_reranker(data(spark, d), Settings(similar_weight=0.15), RR.cosine_scorer, RR.jaccard_scorer)


def stub_selector(x: Data) -> DataFrame:
    """(q_id, output): what a language model might say, the three candidates that share most tokens with the question: as a
    JSON list, or mentioned in a sentence for odd questions."""
    rows = x.pool.select(*KEYS, "quote_id", RR.jaccard_scorer(F.col("question"), F.col("content")).alias("score"))
    ids = U.answers(K.top_k(rows, "score", 3))
    odd = F.col("q_id").try_cast("bigint") % 2 == 1
    return ids.select("q_id", F.when(odd, F.concat(F.lit("I choose "), F.array_join("answer", " and "), F.lit("."))).otherwise(F.to_json("answer")).alias("output"))


@query
def llm_top5(spark, d):
    """A selector's answer, filled up by BM25."""
    x = data(spark, d)
    return RT.llm(x, Settings(), stub_selector(x))


@query
def image_top5(spark, d):
    return RT.image(data(spark, d), Settings())


@query
def llm_prompt(spark, d):
    return RR.prompts(texts(candidates(spark, d)), samples(spark, d))


@query
def llm_parse(spark, d):
    """Every candidate's text read as a model's answer that may name the quotes of its question's gold list."""
    rows = pools(spark, d).where("size(gold) > 0")
    said = F.concat(F.lit("I choose text1, image2 and "), F.element_at("gold", 1), F.lit(" and text1. "), "content")
    listed = F.when(F.col("cand_idx") % 2 == 0, F.to_json("gold")).otherwise(said)
    return rows.select(*KEYS, F.array_join(X.parse_quote_ids(listed, "gold"), " ").alias("ids"))


@query
def ranker_features(spark, d):
    rows = RT.ranker_rows(data(spark, d))
    return rows.select(*KEYS, "is_gold", *r6(*R.FEATURES, "overlap_confidence", "semantic", "overlap"))


#: Boosting rounds of the registered queries; the methods' own default is 220.
ITERATIONS = 10
_by_model: dict[tuple[str, str], tuple[DataFrame, DataFrame, DataFrame]] = {}


def by_model(spark, d) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows with the model's scores, questions, reference questions per document); a data set's model is fitted once in an
    application, its scores being a table in the shared folder."""
    key = spark.sparkContext.applicationId, d
    if key not in _by_model:
        x, s = data(spark, d), Settings(ranker_iterations=ITERATIONS)
        counts = x.reference.groupBy("doc_name").agg(F.count("*").alias("doc_count"))
        _by_model[key] = RT.ranked_by_model(x, s, F.expr(IS_REFERENCE), s), x.questions, counts
    return _by_model[key]


@query
def doc_aware_top5(spark, d):
    return RT.doc_aware_ranker(by_model(spark, d)[0], Settings(), RR.cosine_scorer)


@query
def routed_top5(spark, d):
    rows, _, counts = by_model(spark, d)
    return RT.routed_doc_aware(rows, Settings(), counts)


@query
def coverage_top5(spark, d):
    rows = cut_lineage(RT.fused(data(spark, d), Settings(), False, False))
    out = U.coverage_select(rows, "score", K.ranks(rows, "score", "rank"))
    return out.join(rows.select(*KEYS, "quote_id"), KEYS).select("q_id", "rank", "quote_id")


@query
def split_doc(spark, d):
    return S.split_by_document(samples(spark, d))


@query
def split_row(spark, d):
    return S.split_by_row(samples(spark, d))


@query
def split_domain(spark, d):
    return S.split_by_domain(samples(spark, d), "Academic paper")


@query
def split_mixed(spark, d):
    return S.split_mixed(samples(spark, d))


@query
def split_shard(spark, d):
    """A shard of the development questions of the split by document, in that split's order."""
    s = samples(spark, d)
    return S.shard(S.dev_positions(s, S.split_by_document(s), "doc").withColumn("split_pos", F.col("split_pos") + 1), "split_pos", 3, 1)


@query
def eval_splits(spark, d):
    """Recall of memory under each way to hold questions of the delivered reference out of it."""
    s = cut_lineage(samples(spark, d).where(IS_REFERENCE))
    pool, parts = pools(spark, d, REFERENCE), []
    for strategy in ("doc", "row", "mixed", "domain"):
        part = cut_lineage(S.eval_split(s, strategy, domain="Academic paper"))
        dev, train = (part.where(F.col("part") == x).select("q_id") for x in ("dev", "train"))
        held = s.join(dev, "q_id", "left_semi")
        x = Data(pool.join(dev, "q_id", "left_semi"), pool.join(train, "q_id", "left_semi"), held, s.join(train, "q_id", "left_semi"), table(spark, d, "embeddings"))
        rows = E.with_recall(held, U.answers(RT.memory(x, Settings())))
        docs = held.agg(F.countDistinct("doc_name").alias("num_dev_docs"))
        parts.append(E.evaluate(rows).crossJoin(docs).withColumn("strategy", F.lit(strategy)))
    return reduce(DataFrame.unionByName, parts)


@query
def shard(spark, d):
    s = S.positions(samples(spark, d).select("q_id", "sample_pos"), [F.asc("sample_pos")], "place")
    return S.shard(s, "place", 4, 1).select("q_id", "place")


def families(spark, d, split: str, rows: DataFrame, which: tuple[str, ...] = A.FAMILIES) -> DataFrame:
    """Questions of a split, long by family of buckets."""
    s = cut_lineage(samples(spark, d))
    reference = s.where(IS_REFERENCE)
    near = N.question_neighbors(s.where(F.col("split") == split), reference)
    return A.long_buckets(A.bucketed(rows, candidates(spark, d), reference, near), which)


@query
def recall_by_bucket(spark, d):
    return E.evaluate(families(spark, d, DEV, answered(spark, d, bm25_top5(spark, d), DEV)), "family", "bucket")


@query
def bucket_proportions(spark, d):
    """Shares of the development split's buckets of every family."""
    s = samples(spark, d).where(F.col("split") == DEV)
    return E.family_proportions(families(spark, d, DEV, s))


@query
def weighted_proxy(spark, d):
    """Recall on the development split re-weighted by the test split's shares, for the families known of it."""
    by = E.evaluate(families(spark, d, DEV, answered(spark, d, bm25_top5(spark, d), DEV), A.OPEN_FAMILIES), "family", "bucket")
    shares = E.family_proportions(families(spark, d, TEST, samples(spark, d).where(F.col("split") == TEST), A.OPEN_FAMILIES))
    return E.weighted_recall(by, shares)


@query
def modality_preference(spark, d):
    c = candidates(spark, d).select(*KEYS, "quote_id", "modality", "raw_type")
    return A.preference(top(lexical(pools(spark, d)).join(c, KEYS), "bm25"), c, samples(spark, d))


@query
def answer_kinds(spark, d):
    c = candidates(spark, d).select(*KEYS, "quote_id", "modality", "raw_type")
    return A.kinds(top(lexical(pools(spark, d)).join(c, KEYS), "bm25"), c)


@query
def gold_lengths(spark, d):
    return A.gold_lengths(samples(spark, d))


@query
def dataset_stats(spark, d):
    return A.stats(samples(spark, d), candidates(spark, d))


@query
def top_question_types(spark, d):
    return A.most_common(samples(spark, d).select("sample_pos", F.col("question_type").alias("value")), 10)


@query
def top_modalities(spark, d):
    return A.most_common(samples(spark, d).select("sample_pos", F.explode("types").alias("value")), 10)


@query
def domain_balance(spark, d):
    s = A.with_domain_bucket(samples(spark, d).where(F.col("split") == REFERENCE))
    s = s.select(F.col("bucket").alias("domain"))
    a, b = mining.domain_weights(s, "uniform"), mining.domain_weights(s, "sqrt").select("domain", F.col("weight").alias("root"))
    return a.join(b, "domain").select("domain", "n", *r6("weight", "root"))


@query
def document_counts(spark, d):
    n = samples(spark, d).groupBy("doc_name").agg(F.count("*").alias("n"))
    return n.select("doc_name", "n", X.frequency_bucket(F.col("n")).alias("bucket"))


@query
def weight_sweep(spark, d):
    """The twenty best of all combinations of the weights by recall on the development split, rounded, ties in the order of
    the grid. All combinations share one scaling, and each keeps five rows a question."""
    names = list(SWEEP)
    rows = cut_lineage(RT.scored(data(spark, d, DEV), tuple(names)).select(*KEYS, "quote_id", *(f"{c}_norm" for c in names)))
    grid = spark.createDataFrame([(i, *w) for i, w in enumerate(itertools.product(*SWEEP.values()))], ", ".join(["grid_pos int", *(f"{c}_weight double" for c in names)]))
    score = reduce(lambda a, b: a + b, (F.col(f"{c}_weight") * F.col(f"{c}_norm") for c in names))
    each = K.top_k(rows.crossJoin(F.broadcast(grid.select("grid_pos", *(f"{c}_weight" for c in names)))).withColumn("score", score), "score", 5, ("grid_pos", "q_id"))
    each = each.join(samples(spark, d).select("q_id", "gold"), "q_id")
    of = each.groupBy("grid_pos", "q_id").agg(F.collect_list("quote_id").alias("answer"), F.any_value("gold").alias("gold"))
    of = of.withColumn("recall", E.recall("answer", "gold")).groupBy("grid_pos").agg(F.round(F.coalesce(F.avg("recall"), F.lit(0.0)), 6).alias("recall"))
    return grid.join(of, "grid_pos").orderBy(F.desc("recall"), F.asc("grid_pos")).limit(20)


def fusion_recalls(spark, d) -> DataFrame:
    """(w, recall), not rounded, per weight of a reranker's score against the base score on the development split."""
    rows = RT.scored(data(spark, d, DEV), ("bm25", "dense")).withColumn("rerank", RR.cosine_scorer(F.col("question"), F.col("doc_text")))
    rows = K.minmax(rows.withColumn("base", U.linear(HYBRID)), ["base", "rerank"]).select(*KEYS, "quote_id", "base_norm", "rerank_norm")
    grid = spark.createDataFrame([(w,) for w in FUSION], "w double")
    each = rows.crossJoin(F.broadcast(grid)).withColumn("score", (1 - F.col("w")) * F.col("base_norm") + F.col("w") * F.col("rerank_norm"))
    each = K.top_k(each, "score", 5, ("w", "q_id")).join(samples(spark, d).select("q_id", "gold"), "q_id")
    of = each.groupBy("w", "q_id").agg(F.collect_list("quote_id").alias("answer"), F.any_value("gold").alias("gold"))
    return of.withColumn("recall", E.recall("answer", "gold")).groupBy("w").agg(F.coalesce(F.avg("recall"), F.lit(0.0)).alias("recall"))


@query
def fusion_grid(spark, d):
    return fusion_recalls(spark, d).select("w", *r6("recall"))


@query
def best_fusion_weight(spark, d):
    """What a fold over the grid in its order ends with."""
    return E.best_weight(fusion_recalls(spark, d).withColumn("place", F.col("w")), "place", "w", "recall")


def compared(spark, d, names: tuple[str, ...]) -> DataFrame:
    """Recall of methods on the development questions; all share one computation of the scores."""
    x, s = data(spark, d, DEV), Settings()
    x = replace(x, scores=cut_lineage(RT.scored(x, ("bm25", "dense", "memory", "precise", "type_score"))))
    known, parts = RT.methods(x, s, F.expr(IS_REFERENCE), said=stub_selector), []
    for name in names:
        rows = E.with_recall(x.questions, U.answers(known[name]()))
        parts.append(E.evaluate(rows).withColumn("method", F.lit(name)))
    return reduce(DataFrame.unionByName, parts)


@query
def ablation(spark, d):
    """All methods but the trained ones."""
    return compared(spark, d, RT.UNTRAINED)


@query
def ablation_trained(spark, d):
    """The trained rankers, of one model fitted on the reference."""
    rows, questions, counts = by_model(spark, d)
    s = Settings()
    both = {"doc_aware_ranker": RT.doc_aware_ranker(rows, s, RR.cosine_scorer), "routed_doc_aware": RT.routed_doc_aware(rows, s, counts)}
    held = questions.where(F.col("split") == DEV)
    return reduce(DataFrame.unionByName, (E.evaluate(E.with_recall(held, U.answers(r))).withColumn("method", F.lit(n)) for n, r in both.items()))


@query
def pair_examples(spark, d):
    pool = pools(spark, d, REFERENCE).join(scorer(table(spark, d, "scores"), "bm25"), KEYS)
    return mining.training_pairs(pool, "bm25").select(*KEYS, "label", "kind", "weight")


@query
def submission_rows(spark, d):
    return records.answer_rows(samples(spark, d), submissions(spark, d)[1])


@query
def image_paths(spark, d):
    """Resolved against a listing; here the tables' own paths, of which every second is stored by its bare name."""
    c = candidates(spark, d).where("img_path is not null").select(*KEYS, "img_path")
    root = "/data"
    name = F.element_at(F.split("img_path", "/"), -1)
    stored = c.select(F.when(F.col("cand_idx") % 2 == 0, F.concat(F.lit(root + "/"), "img_path")).otherwise(F.concat(F.lit(root + "/images/"), name)).alias("path"))
    return records.resolved_paths(c, stored, root).select(*KEYS, "resolved")


@query
def records_round_trip(spark, d):
    """Pools written as records, a JSON line for each hundred places of a question's pool, read and flattened again."""
    c = candidates(spark, d).withColumn("part", F.floor(F.col("cand_idx") / 100))
    quote = lambda *x: F.struct("cand_idx", F.struct("quote_id", F.col("raw_type").alias("type"), *x, "page_id", "layout_id").alias("quote"))
    ordered = lambda x: F.transform(F.array_sort(F.collect_list(x)), lambda y: y["quote"])
    text = quote(F.col("content").alias("text"))
    image = quote(F.col("content").alias("img_description"), "img_path")
    pooled = c.groupBy("q_id", "part").agg(
        ordered(F.when(F.col("modality") == "text", text)).alias("text_quotes"), ordered(F.when(F.col("modality") == "image", image)).alias("img_quotes")
    )
    line = cut_lineage(pooled.select(F.to_json(F.struct("*")).alias("line")))
    parsed = line.select(F.from_json("line", T.StructType([*records.RECORD, T.StructField("part", T.LongType())])).alias("r")).select("r.*")
    return records.record_candidates(parsed).select("q_id", F.col("cand_idx").cast("bigint").alias("cand_idx"), "quote_id", "modality", "page_id")


@query
def records_samples(spark, d):
    """Questions written as JSON lines, read and made into questions again."""
    s = table(spark, d, "samples")
    s = latest(s.withColumn("q_id", X.strip("q_id")).where("q_id <> ''"), ["q_id"], [F.desc_nulls_last("ingested_at"), F.desc("sample_pos")])
    path = fresh_path(spark)
    fields = ["q_id", "old_id", "doc_name", "domain", "question", "question_type", "evidence_modality_type", "gold_quotes"]
    s.select(F.to_json(F.struct(*fields)).alias("value")).write.text(path)
    out = records.record_samples(records.read_records(spark, path))
    return out.select("q_id", "old_id", "doc_name", "domain", "question", "question_type", F.array_join("types", "|").alias("types"), F.array_join("gold", "|").alias("gold"))


@query
def reranker_prompts(spark, d):
    """The digest of the text that a causal reranker reads for each pair."""
    prompt = X.reranker_prompt(RR.INSTRUCTION, "question", "doc_text")
    return texts(pools(spark, d)).select(*KEYS, F.md5(prompt).alias("prompt"), F.length(prompt).cast("bigint").alias("n_chars"))


@query
def embedding_cache(spark, d):
    """Which texts of all pools are found in a cache of the reference pools' texts, and which are encoded as misses; the
    encoder here is a stub, a text's length."""
    length = lambda x: F.array(F.length(x).cast("float"))
    none = spark.createDataFrame([], "cache_key string, vector array<float>")
    cache = cut_lineage(encoded(texts(pools(spark, d, REFERENCE)), "doc_text", "stub", length, none).select("cache_key", "vector"))
    return encoded(texts(pools(spark, d)), "doc_text", "stub", length, cache).select("cache_key", F.col("vector")[0].cast("bigint").alias("n_chars"), "cached")


@query
def streamed_memory(spark, d):
    """Memory of the reference pools kept by a stream of their keys, for the data available now."""
    from evidentia.streaming.memory import current, maintain

    folder = fresh_path(spark)
    M.keyed(pools(spark, d, REFERENCE)).write.parquet(f"{folder}/keys")
    stream = spark.readStream.schema("q_id string, cand_idx bigint, is_gold boolean, key_name string, key string").parquet(f"{folder}/keys")
    maintain(stream, folder).awaitTermination()
    return current(spark, folder).select("key_name", F.md5("key").alias("key"), "candidate_cnt", "gold_cnt")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_registry)
