"""Questions that stand, exactly or almost, on both sides of a split."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evidentia.llm.consistent_form import document_key, lowered
from evidentia.llm.group_splits import domain_name
from evidentia.llm.top_n import trimmed
from evidentia.session import cut_lineage

#: A pair with the least similarity, 0.75, shares a bucket but for (1 - 0.75 ** 4) ** 44, less than one in ten million.
BANDS, ROWS = 44, 4


def words_of(text: str) -> list[str]:
    """The distinct words, longest runs of letters and digits, of the text's consistent form in lower case."""
    return sorted(set("".join(c if c.isalnum() else " " for c in lowered(text)).split()))


@F.pandas_udf(T.ArrayType(T.StringType()))
def _words(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for s in batches:
        known = {v: words_of(v) for v in s.dropna().unique()}
        yield pd.Series([known.get(v) for v in s], dtype=object)


@F.pandas_udf(T.ArrayType(T.LongType()))
def _buckets(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """One bucket number per band, of the words' minwise hashes and of the block."""
    rng = np.random.default_rng(20)
    n = BANDS * ROWS
    mult, add = rng.integers(1, 1 << 63, n, np.uint64) | np.uint64(1), rng.integers(0, 1 << 63, n, np.uint64)
    mix = rng.integers(1, 1 << 63, ROWS, np.uint64) | np.uint64(1)
    band = rng.integers(0, 1 << 63, BANDS, np.uint64)
    for block, words in batches:
        out = []
        for b, w in zip(block, words, strict=True):
            h = np.array([xxhash.xxh3_64_intdigest(x) for x in w], np.uint64)
            x = h[:, None] * mult + add
            low = (x ^ (x >> np.uint64(29))).min(axis=0).reshape(BANDS, ROWS)
            key = (low * mix).sum(axis=1) + band + np.uint64(xxhash.xxh3_64_intdigest(b))
            out.append((key ^ (key >> np.uint64(31))).view(np.int64))
        yield pd.Series(out, dtype=object)


def _close(samples: DataFrame, similarity: float, held_out: tuple[str, ...]) -> tuple[DataFrame, DataFrame]:
    """Questions with their representative, and confirmed pairs (rep_a in train, rep_b held out, jaccard)."""
    q = samples.select(
        trimmed("q_id").try_cast("bigint").alias("q_id"), F.struct("ingested_at", "sample_pos").alias("at"),
        F.struct(F.lower(trimmed("split")).alias("split"), "doc_name", "question", domain_name("domain").alias("domain")).alias("x"),
    ).where("q_id is not null")
    q = q.groupBy("q_id").agg(F.max_by("x", "at").alias("x")).select("q_id", "x.*")
    q = q.where(F.col("split").isin("train", *held_out) & F.col("doc_name").isNotNull() & F.col("question").isNotNull())
    q = q.select("q_id", "split", "domain", document_key("doc_name").alias("doc"), _words("question").alias("words"))
    q = q.where("doc <> '' and size(words) > 0")
    digits = F.array_join(F.filter("words", lambda w: w.rlike(r"(?U)\p{Nd}")), " ")
    block = F.concat_ws("\n", "doc", digits)
    train = F.col("split") == "train"
    rep = F.md5(F.concat_ws("\n", train.cast("string"), "doc", F.array_join("words", " ")))
    q = cut_lineage(q.select("q_id", "split", "domain", train.alias("train"), block.alias("block"), "words", rep.alias("rep")))
    reps = q.groupBy("rep", "train").agg(F.any_value("words").alias("words"), F.any_value("block").alias("block"))
    reps = cut_lineage(reps)
    met = reps.select("rep", "train", F.explode(_buckets("block", "words")).alias("bucket"))
    a = met.where("train").select("bucket", F.col("rep").alias("rep_a"))
    b = met.where("not train").select("bucket", F.col("rep").alias("rep_b"))
    candidates = a.join(b, "bucket").select("rep_a", "rep_b").distinct()
    for side in "ab":
        own = reps.select(*(F.col(c).alias(f"{c}_{side}") for c in ("rep", "words", "block")))
        candidates = candidates.join(own, f"rep_{side}")
    both = F.size(F.array_intersect("words_a", "words_b"))
    jaccard = both / (F.size("words_a") + F.size("words_b") - both)
    close = candidates.where("block_a = block_b").withColumn("jaccard", jaccard).where(F.col("jaccard") >= similarity)
    return q, close.select("rep_a", "rep_b", "jaccard")


def split_overlaps(samples: DataFrame, similarity: float = 0.75, held_out: tuple[str, ...] = ("validation", "test")) -> DataFrame:
    """Confirmed pairs (q_id_train, q_id_eval, split, domain, jaccard): one question in train, one held out.

    Both are about one document (by name alone), have the same words with digits, and of their distinct words at least
    the share ``similarity`` occurs in both. Questions with one set of words on one side of the split are one
    representative; representatives meet in banded minwise buckets of their document and digits, only across the split,
    and the exact similarity decides. ``split`` and ``domain`` are the held-out question's; domains are in lower case, with
    single spaces for white space and underscores, so that uneven spellings are one.

    Of repeated deliveries of a q_id the last counts. Null, blank or unknown splits, documents and questions, and
    questions without a word, match nothing. Ids are trimmed; those that aren't numbers are left out. Empty tables give
    no rows.
    """
    q, close = _close(samples, similarity, held_out)
    left = q.where("train").select(F.col("rep").alias("rep_a"), F.col("q_id").alias("q_id_train"))
    right = q.where("not train").select(F.col("rep").alias("rep_b"), F.col("q_id").alias("q_id_eval"), "split", "domain")
    pairs = close.join(left, "rep_a").join(right, "rep_b")
    return pairs.select("q_id_train", "q_id_eval", "split", "domain", "jaccard")


def overlap_classes(samples: DataFrame, similarity: float = 0.75, held_out: tuple[str, ...] = ("validation", "test")) -> DataFrame:
    """(q_id, split, domain, class_id, n_links), one row per question with an overlap: the class of questions with its words
    on its side of the split, and the number of questions on the other side it overlaps with. Says what ``split_overlaps``
    does without expanding classes into pairs."""
    q, close = _close(samples, similarity, held_out)
    close = cut_lineage(close)
    sizes = q.groupBy("rep").agg(F.count("*").alias("n"))
    links = [close.select(F.col(x).alias("class_id"), F.col(y).alias("rep")) for x, y in (("rep_a", "rep_b"), ("rep_b", "rep_a"))]
    links = links[0].unionByName(links[1]).join(sizes, "rep").groupBy("class_id").agg(F.sum("n").alias("n_links"))
    return q.withColumnRenamed("rep", "class_id").join(links, "class_id").select("q_id", "split", "domain", "class_id", "n_links")


def overlap_report(pairs: DataFrame) -> DataFrame:
    """Numbers of pairs and of held-out and train questions in them, per held-out split and domain."""
    return pairs.groupBy("split", "domain").agg(
        F.count("*").alias("n_pairs"),
        F.countDistinct("q_id_eval").alias("n_held_out"),
        F.countDistinct("q_id_train").alias("n_train"),
    )
