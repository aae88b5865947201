"""Command line: python -m evidentia.cli MODE --data DIR [--method NAME] [--set NAME=VALUE ...] [--out DIR] [--config KEY=VALUE ...]

eval, dump_eval, ablate, analyze and sweep hold questions out of the delivered training split (--split doc, row, mixed or
domain, --ratio, --overlap, --holdout), or take the delivered validation split (--split given); --shards and --shard cut the
held-out questions. submit answers every question of the data, each without its own evidence, or of one split (--of).
Every parameter of a method is set by its name in ``operators.retrieval.Settings``.
"""

from __future__ import annotations

import argparse
import ast
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidentia.operators import analysis as A
from evidentia.operators import metrics as E
from evidentia.operators import neighbors as N
from evidentia.operators import splits as S
from evidentia.operators.fusion import answers
from evidentia.operators.retrieval import METHODS, NAMES, Data, Settings, methods
from evidentia.plans.core import queries, stub_selector
from evidentia.session import cut_lineage, table
from evidentia.sources.records import answer_rows, write_answers
from evidentia.sources.tables import DEV, REFERENCE, candidates, pools, samples

REPORTS = {"stats": ("dataset_stats", "gold_lengths", "top_question_types", "top_modalities"), "sweep": ("weight_sweep", "fusion_grid", "best_fusion_weight")}
MODES = (*REPORTS, "eval", "dump_eval", "ablate", "analyze", "submit")


def settings(given: list[str]) -> Settings:
    """Settings of NAME=VALUE strings; values are literals, lists of numbers with commas."""
    changes = {}
    for one in given:
        name, _, value = one.partition("=")
        if name not in NAMES:
            raise ValueError(f"unknown parameter: {name}")
        known = getattr(Settings(), name)
        changes[name] = value if isinstance(known, str) else ast.literal_eval(f"({value},)" if isinstance(known, tuple) else value)
    return Settings().given(**changes)


def held_out(spark: SparkSession, data: str, split: str = "given", ratio: float = 0.1, seed: int = 42, overlap: float = 0.74, holdout: str = "",
             shards: int = 1, shard: int = 0) -> Data:
    """The held-out questions and what they are answered against."""
    s = cut_lineage(samples(spark, data))
    vectors = table(spark, data, "embeddings")
    if split == "given":
        dev, train = s.where(F.col("split") == DEV), s.where(F.col("split") == REFERENCE)
        places = S.positions(dev.select("q_id", "sample_pos"), [F.asc("sample_pos")], "place").select("q_id", "place")
    else:
        own = s.where(F.col("split") == REFERENCE)
        parts = cut_lineage(S.eval_split(own, split, ratio, seed, overlap, holdout))
        dev, train = (own.join(parts.where(F.col("part") == x).select("q_id"), "q_id", "left_semi") for x in ("dev", "train"))
        places = S.dev_positions(own, parts, split, seed).select("q_id", (F.col("split_pos") + 1).alias("place"))
    dev = cut_lineage(dev.join(S.shard(places, "place", shards, shard).select("q_id"), "q_id", "left_semi"))
    pool = cut_lineage(pools(spark, data))
    return Data(pool.join(dev.select("q_id"), "q_id", "left_semi"), pool.join(train.select("q_id"), "q_id", "left_semi"), dev, train, vectors)


def answered(x: Data, method: str, s: Settings) -> DataFrame:
    """Answers of a method. A trained one learns from the reference's pools and so works on both."""
    ids = x.questions.select("q_id")
    if method in ("doc_aware_ranker", "routed_doc_aware"):
        mark = x.reference.select("q_id", F.lit(True).alias("is_reference"))
        both = x.pool.join(mark, "q_id", "left_anti").unionByName(x.reference_pool).drop("split")
        both = both.join(mark, "q_id", "left").withColumn("split", F.when(F.col("is_reference"), "reference").otherwise("asked")).drop("is_reference")
        asked = x.questions.join(mark, "q_id", "left_anti").unionByName(x.reference)
        x = Data(both, x.reference_pool, asked, x.reference, x.vectors)
    ranked = methods(x, s, F.col("split") == "reference", said=stub_selector)[method]()
    return answers(ranked).join(ids, "q_id", "left_semi")


def analysis(spark: SparkSession, data: str, x: Data, rows: DataFrame, ranked: DataFrame) -> list[DataFrame]:
    """Recall, preferences, and of every family of buckets shares and recall; for families known of a test split its shares
    and the recall re-weighted by them, the test split's counts being of the whole training split."""
    s, c = samples(spark, data), candidates(spark, data)
    near = N.question_neighbors(x.questions, x.reference)
    long = cut_lineage(A.long_buckets(A.bucketed(rows, c, x.reference, near)))
    test, whole = s.where(F.col("split") == "test"), s.where(F.col("split") == REFERENCE)
    of_test = A.long_buckets(A.bucketed(test, c, whole, N.question_neighbors(test, whole)), A.OPEN_FAMILIES)
    by, shares = E.evaluate(long, "family", "bucket"), E.family_proportions(of_test)
    return [E.evaluate(rows), A.preference(ranked, c, x.questions), A.kinds(ranked, c), E.family_proportions(long), by, shares, E.weighted_recall(by, shares)]


def run(spark: SparkSession, mode: str, data: str, method: str = "hybrid", out: str | None = None, s: Settings | None = None, of: str | None = None,
        **held: object) -> list[DataFrame]:
    """The frames a mode reports; ``submit`` writes the answers to ``out`` instead."""
    s = s or Settings()
    if mode not in MODES:
        raise ValueError(f"unknown mode: {mode}")
    if mode in REPORTS:
        known = queries()
        return [known[q](spark, data) for q in REPORTS[mode]]
    if mode == "submit":
        q = cut_lineage(samples(spark, data))
        reference, asked = q.where(F.col("split") == REFERENCE), q.where(F.col("split") == of) if of else q
        x = Data(pools(spark, data, of), pools(spark, data, REFERENCE), asked, reference, table(spark, data, "embeddings"))
        write_answers(answer_rows(asked, answered(x, method, s)), out or "answers")
        return []
    x = held_out(spark, data, **held)
    if mode == "ablate":
        parts = [E.evaluate(E.with_recall(x.questions, answered(x, m, s))).withColumn("method", F.lit(m)) for m in METHODS]
        return [reduce(DataFrame.unionByName, parts)]
    got = cut_lineage(answered(x, method, s))
    rows = E.with_recall(x.questions, got)
    if mode == "dump_eval":
        return [rows.select("q_id", "answer", "gold", "recall")]
    if mode == "eval":
        return [E.evaluate(rows).crossJoin(x.questions.agg(F.countDistinct("doc_name").alias("num_dev_docs")))]
    ranked = got.select("q_id", F.posexplode("answer").alias("n", "quote_id")).select("q_id", (F.col("n") + 1).cast("bigint").alias("rank"), "quote_id")
    return analysis(spark, data, x, rows, ranked)


def main() -> None:
    p = argparse.ArgumentParser(description=__doc__)
    p.add_argument("mode", choices=MODES)
    p.add_argument("--data", required=True)
    p.add_argument("--method", choices=METHODS, default="hybrid")
    p.add_argument("--set", action="append", default=[], help="a method's parameter, NAME=VALUE")
    p.add_argument("--split", choices=("given", "doc", "row", "mixed", "domain"), default="given")
    p.add_argument("--ratio", type=float, default=0.1)
    p.add_argument("--seed", type=int, default=42)
    p.add_argument("--overlap", type=float, default=0.74)
    p.add_argument("--holdout", default="", help="the domain held out")
    p.add_argument("--shards", type=int, default=1)
    p.add_argument("--shard", type=int, default=0)
    p.add_argument("--of", help="the split to submit; all without")
    p.add_argument("--out")
    p.add_argument("--config", action="append", default=[], help="Spark settings, KEY=VALUE")
    a = p.parse_args()
    builder = SparkSession.builder.appName("evidentia")
    for one in a.config:
        builder = builder.config(*one.split("=", 1))
    held = {k: getattr(a, k) for k in ("split", "ratio", "seed", "overlap", "holdout", "shards", "shard")}
    for i, df in enumerate(run(builder.getOrCreate(), a.mode, a.data, a.method, a.out, settings(a.set), a.of, **held)):
        if a.out:
            df.write.mode("overwrite").json(f"{a.out}/{a.mode}_{i}")
        else:
            df.show(50, truncate=False)


if __name__ == "__main__":
    main()
