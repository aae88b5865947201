"""Queries of the training-data problems, and SQL for those it can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidentia.llm.consistent_form import consistent_texts, equal_looking_pairs
from evidentia.llm.cross_split import overlap_classes, overlap_report, split_overlaps
from evidentia.llm.group_splits import group_splits, must_share, name_classes, split_shares
from evidentia.llm.leaks import leaked, paraphrased
from evidentia.llm.mixing import mixture
from evidentia.llm.pieces import cut_to_pieces
from evidentia.llm.sentences import learned, sentence_places, sentences
from evidentia.llm.top_n import best_quotes
from evidentia.session import table


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return must_share(table(spark, d, "samples"), table(spark, d, "doc_catalog"))


def p1_splits(spark: SparkSession, d: str) -> DataFrame:
    return group_splits(table(spark, d, "samples"), table(spark, d, "doc_catalog")).select("q_id", "domain", "split")


def p1_shares(spark: SparkSession, d: str) -> DataFrame:
    return split_shares(group_splits(table(spark, d, "samples"), table(spark, d, "doc_catalog")))


def p1_classes(spark: SparkSession, d: str) -> DataFrame:
    return name_classes(table(spark, d, "samples"), table(spark, d, "doc_catalog"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return best_quotes(table(spark, d, "scores"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    pairs = split_overlaps(table(spark, d, "samples"))
    a, b = F.least("q_id_train", "q_id_eval"), F.greatest("q_id_train", "q_id_eval")
    return pairs.select(a.alias("q_id_a"), b.alias("q_id_b"))


def p3_overlaps(spark: SparkSession, d: str) -> DataFrame:
    return overlap_report(split_overlaps(table(spark, d, "samples")))


def p3_classes(spark: SparkSession, d: str) -> DataFrame:
    return overlap_classes(table(spark, d, "samples"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    contents = equal_looking_pairs(table(spark, d, "candidates"), "cand_id", "content")
    questions = equal_looking_pairs(table(spark, d, "samples"), "sample_pos", "question")
    return contents.select(F.lit("content").alias("field"), "key_a", "key_b").unionByName(
        questions.select(F.lit("question").alias("field"), "key_a", "key_b")
    )


def p4_forms(spark: SparkSession, d: str) -> DataFrame:
    contents = consistent_texts(table(spark, d, "candidates"), "cand_id", "content")
    questions = consistent_texts(table(spark, d, "samples"), "sample_pos", "question")
    return contents.select(F.lit("content").alias("field"), "*").unionByName(
        questions.select(F.lit("question").alias("field"), "*")
    )


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    pieces = cut_to_pieces(table(spark, d, "candidates"), table(spark, d, "size_limits"))
    return pieces.where("n_pieces > 1 and piece_no = 0").select("cand_id")


def p5_pieces(spark: SparkSession, d: str) -> DataFrame:
    return cut_to_pieces(table(spark, d, "candidates"), table(spark, d, "size_limits"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return leaked(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p6_paraphrases(spark: SparkSession, d: str) -> DataFrame:
    return paraphrased(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p7_mixture(spark: SparkSession, d: str) -> DataFrame:
    return mixture(table(spark, d, "documents"), table(spark, d, "mix_targets"))[0]


def p7_shares(spark: SparkSession, d: str) -> DataFrame:
    return mixture(table(spark, d, "documents"), table(spark, d, "mix_targets"))[1]


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    return sentence_places(docs, model=learned(docs))


def p8_sentences(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    return sentences(docs, model=learned(docs))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (
        p1_found, p1_splits, p1_shares, p1_classes, p2_found, p3_found, p3_overlaps, p3_classes, p4_found, p4_forms, p5_found, p5_pieces,
        p6_found, p6_paraphrases, p7_mixture, p7_shares, p8_found, p8_sentences,
    )
    return {f.__name__: f for f in found}


_TRIM = r"regexp_replace({}, '^[\s\p{{Z}}\x{{85}}]+|[\s\p{{Z}}\x{{85}}]+$', '', 'g')"


def oracle_sql() -> dict[str, str]:
    return {
        "p2_found": f"""
            with s as (
              select try_cast({_TRIM.format("q_id")} as bigint) as q_id, method, {_TRIM.format("quote_id")} as quote_id,
                     score, cand_idx, scored_at, score_id from scores),
            latest as (
              select *, row_number() over (partition by q_id, method, quote_id
                                           order by scored_at desc nulls last, score_id desc) as n from s),
            ranked as (
              select q_id, method, quote_id,
                     row_number() over (partition by q_id, method order by score + 0.0 desc, cand_idx) as r
              from latest where n = 1 and score is not null and not isnan(score) and q_id is not null
                and method is not null and quote_id is not null)
            select q_id, method, quote_id from ranked where r <= 5""",
        "p5_found": """
            select cand_id from candidates c join size_limits l on c.modality = l.modality
            where length(content) > max_chars""",
    }
