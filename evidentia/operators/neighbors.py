"""Similar reference questions of the same document, and what their gold evidence says about candidates."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from evidentia.functions import text as X
from evidentia.operators.memory import SIMILAR, keyed, weighted
from evidentia.operators.ranking import PLACES
from evidentia.session import cut_lineage


def question_pairs(queries: DataFrame, reference: DataFrame) -> DataFrame:
    """(q_id, ref_q_id, ref_pos, similarity) of questions of one document that share a token; never a question with itself.

    ``queries`` is a stated query set; each is held against all reference questions of its document, as rows of a join.
    """
    q = queries.where("doc_name <> ''").select("q_id", "doc_name", X.tokens("question").alias("q_tokens"))
    r = reference.select(F.col("q_id").alias("ref_q_id"), "doc_name", F.col("sample_pos").alias("ref_pos"), X.tokens("question").alias("r_tokens"))
    pairs = q.join(r, "doc_name").where("q_id <> ref_q_id")
    pairs = pairs.select("q_id", "ref_q_id", "ref_pos", X.token_cosine(F.col("q_tokens"), F.col("r_tokens")).alias("similarity"))
    return pairs.where("similarity > 0")


def best_neighbors(pairs: DataFrame, score: str, n: int) -> DataFrame:
    """The n best reference questions of each, ties by their position: adds ``n_rank``."""
    order = Window.partitionBy("q_id").orderBy(F.desc(F.round(score, PLACES)), F.asc("ref_pos"))
    return pairs.withColumn("n_rank", F.row_number().over(order).cast("bigint")).where(F.col("n_rank") <= n)


#: Questions of a document are compared in blocks of about so many; documents with more are split into several.
BLOCK = 400
_K1, _B = 1.5, 0.75
_FACTS = ("b_lo", "b_hi", "c_lo", "c_hi")


def _sides(queries: DataFrame, reference: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both sides of the comparison, without texts: each question's distinct tokens that a reference question of its document
    has, by hashes, with their BM25 weights in the corpus of the document's reference questions but itself; and each
    reference question's tokens. Everything is one row per question, or per question and token, on its way."""
    hashed = F.transform(X.tokens("question"), lambda t: F.xxhash64(t))
    r = reference.where("doc_name <> ''").select(F.col("q_id").alias("ref_q_id"), "doc_name", F.col("sample_pos").alias("ref_pos"), hashed.alias("tokens"))
    r = cut_lineage(r.withColumn("dl", F.size("tokens")).withColumn("n_distinct", F.size(F.array_distinct("tokens"))))
    corpus = r.groupBy("doc_name").agg(F.count("*").alias("n"), F.sum("dl").alias("total"))
    df = r.select("doc_name", F.explode(F.array_distinct("tokens")).alias("term")).groupBy("doc_name", "term").agg(F.count("*").alias("df"))
    q = queries.where("doc_name <> ''").select("q_id", "doc_name", hashed.alias("tokens"))
    q = q.join(r.select(F.col("ref_q_id").alias("q_id"), "doc_name", F.col("dl").alias("own")), ["q_id", "doc_name"], "left").join(corpus, "doc_name")
    mine = F.col("own").isNotNull().cast("int")
    q = q.withColumn("n", F.col("n") - mine).where("n > 0")
    average = (F.col("total") - F.coalesce("own", F.lit(0))) / F.col("n").cast("double")
    q = cut_lineage(q.select("q_id", "doc_name", "n", mine.alias("mine"), average.alias("avgdl"), F.size(F.array_distinct("tokens")).alias("n_distinct"), "tokens"))
    terms = q.select("q_id", "doc_name", "n", "mine", F.explode("tokens").alias("term")).groupBy("q_id", "doc_name", "n", "mine", "term").agg(F.count("*").alias("qf"))
    left = F.col("df") - F.col("mine")
    weight = F.col("qf") * F.log(1 + (F.col("n") - left + 0.5) / (left + 0.5))
    terms = terms.join(df, ["doc_name", "term"]).where(left > 0).groupBy("q_id").agg(F.collect_list(F.struct("term", weight.alias("weight"))).alias("terms"))
    q = q.drop("tokens", "n", "mine").join(terms, "q_id")
    q = q.select("q_id", "doc_name", "avgdl", "n_distinct", F.col("terms.term").alias("terms"), F.col("terms.weight").alias("weights"))
    return cut_lineage(q), r


def _matrices(q: pd.DataFrame, r: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """BM25 and cosine of every question of a block with every reference question of one, and which pairs count."""
    flat = lambda c, kind: np.concatenate([np.asarray(x, kind) for x in c] or [np.empty(0, kind)])
    owner = np.repeat(np.arange(len(q)), q["terms"].map(len))
    vocabulary, place = np.unique(flat(q["terms"], np.int64), return_inverse=True)
    weight = np.zeros((len(q), len(vocabulary)))
    weight[owner, place] = flat(q["weights"], np.float64)
    tokens, of = flat(r["tokens"], np.int64), np.repeat(np.arange(len(r)), r["tokens"].map(len))
    at = np.minimum(np.searchsorted(vocabulary, tokens), max(0, len(vocabulary) - 1))
    hit = vocabulary[at] == tokens if len(vocabulary) else np.zeros(len(tokens), bool)
    count = np.zeros((len(r), len(vocabulary)))
    np.add.at(count, (of[hit], at[hit]), 1.0)
    sizes = np.sqrt(q["n_distinct"].to_numpy(float)[:, None] * r["n_distinct"].to_numpy(float)[None])
    cosine = np.divide((weight > 0).astype(float) @ (count > 0).astype(float).T, sizes, out=np.zeros_like(sizes), where=sizes > 0)
    length = 1 - _B + _B * np.maximum(r["dl"].to_numpy(float), 1)[None] / np.maximum(q["avgdl"].to_numpy(float), 1e-9)[:, None]
    bm25 = np.zeros_like(cosine)
    for c in np.unique(count[count > 0]):
        bm25 += weight @ (count == c).astype(float).T * (c * (_K1 + 1) / (c + _K1 * length))
    return bm25, cosine, q["q_id"].to_numpy()[:, None] != r["ref_q_id"].to_numpy()[None]


def _scaled(x: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    flat = high - low <= 1e-9 * np.maximum(np.abs(low), np.abs(high))
    return np.where(flat, 0.0, (x - low) / np.where(flat, 1.0, high - low))


def _facts(bm25: np.ndarray, cosine: np.ndarray, counts: np.ndarray) -> list[np.ndarray]:
    ends = ((np.inf, np.min), (-np.inf, np.max))
    return [f(np.where(counts, x, empty), axis=1, keepdims=True) for x in (bm25, cosine) for empty, f in ends]


def _best(q: pd.DataFrame, r: pd.DataFrame, score: np.ndarray, counts: np.ndarray, n: int) -> pd.DataFrame:
    """The n best pairs of each question by positive rounded score, ties by position."""
    score = np.where(counts, score, -1.0)
    rounded, position = np.round(score, PLACES), r["ref_pos"].to_numpy()
    order = np.lexsort((np.broadcast_to(position, score.shape), -rounded), axis=1)[:, :n]
    row, col = np.repeat(np.arange(len(q)), order.shape[1]), order.ravel()
    kept = rounded[row, col] > 0
    row, col = row[kept], col[kept]
    return pd.DataFrame({"q_id": q["q_id"].to_numpy()[row], "ref_q_id": r["ref_q_id"].to_numpy()[col], "ref_pos": position[col], "score": score[row, col]})


def _by_document(q: pd.DataFrame, r: pd.DataFrame) -> Iterator[tuple[pd.DataFrame, pd.DataFrame]]:
    of = dict(iter(r.groupby("doc_name")))
    for doc, mine in q.groupby("doc_name"):
        if doc in of:
            yield mine, of[doc]


_PAIR = "q_id string, ref_q_id string, ref_pos bigint, score double"


def _nearest(queries: DataFrame, reference: DataFrame, n: int, by_cosine: bool) -> DataFrame:
    """(q_id, ref_q_id, ref_pos, score, n_rank) of the n best reference questions of each question's document.

    Small documents are compared several to a task; a document with over BLOCK questions on a side in blocks, of which each
    side's rows go to every block of the other, and only the n best of a block leave it. Scaling by BM25's and the cosine's
    extremes over the whole document takes such documents two passes.
    """
    q, r = _sides(queries, reference)
    sizes = [x.groupBy("doc_name").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias(c)) for x, c in ((q, "q_blocks"), (r, "r_blocks"))]
    blocks = cut_lineage(sizes[0].join(sizes[1], "doc_name"))
    large = blocks.where("q_blocks * r_blocks > 1")
    slots = max(8, q.count() // (8 * BLOCK))
    small = [x.join(blocks.where("q_blocks * r_blocks = 1").select("doc_name"), "doc_name", "left_semi").withColumn("slot", F.pmod(F.xxhash64("doc_name"), F.lit(slots))) for x in (q, r)]

    def whole(q: pd.DataFrame, r: pd.DataFrame) -> pd.DataFrame:
        out = [pd.DataFrame(columns=["q_id", "ref_q_id", "ref_pos", "score"])]
        for mine, theirs in _by_document(q, r):
            bm25, cosine, counts = _matrices(mine, theirs)
            b_lo, b_hi, c_lo, c_hi = _facts(bm25, cosine, counts)
            with np.errstate(invalid="ignore"):
                score = cosine if by_cosine else 0.7 * _scaled(bm25, b_lo, b_hi) + 0.3 * _scaled(cosine, c_lo, c_hi)
            out.append(_best(mine, theirs, np.nan_to_num(score), counts, n))
        return pd.concat([x for x in out if len(x)] or out)

    found = small[0].groupBy("slot").cogroup(small[1].groupBy("slot")).applyInPandas(whole, _PAIR)
    if not large.isEmpty():
        found = found.unionByName(_blockwise(q.join(large, "doc_name"), r.join(large, "doc_name"), n, by_cosine))
    return best_neighbors(found, "score", n)


def _blockwise(q: DataFrame, r: DataFrame, n: int, by_cosine: bool) -> DataFrame:
    """The n best of each block of documents that are split."""
    key = ["doc_name", "qb", "rb"]
    every = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    q = q.withColumn("qb", F.pmod(F.xxhash64("q_id"), F.col("q_blocks")).cast("int"))
    r = r.withColumn("rb", F.pmod(F.xxhash64("ref_q_id"), F.col("r_blocks")).cast("int")).withColumn("qb", every("q_blocks")).drop("q_blocks", "r_blocks")
    spread = lambda x: x.withColumn("rb", every("r_blocks")).drop("q_blocks", "r_blocks").groupBy(*key)

    def extremes(q: pd.DataFrame, r: pd.DataFrame) -> pd.DataFrame:
        if not len(q) or not len(r):
            return pd.DataFrame({"q_id": [], **{f: [] for f in _FACTS}})
        return pd.DataFrame({"q_id": q["q_id"].to_numpy(), **{f: x[:, 0] for f, x in zip(_FACTS, _facts(*_matrices(q, r)), strict=True)}})

    def best(q: pd.DataFrame, r: pd.DataFrame) -> pd.DataFrame:
        if not len(q) or not len(r):
            return pd.DataFrame(columns=["q_id", "ref_q_id", "ref_pos", "score"])
        bm25, cosine, counts = _matrices(q, r)
        low = {f: q[f].to_numpy(float)[:, None] for f in _FACTS} if not by_cosine else {}
        score = cosine if by_cosine else 0.7 * _scaled(bm25, low["b_lo"], low["b_hi"]) + 0.3 * _scaled(cosine, low["c_lo"], low["c_hi"])
        return _best(q, r, score, counts, n)

    if not by_cosine:
        facts = spread(q).cogroup(r.groupBy(*key)).applyInPandas(extremes, ", ".join(["q_id string", *(f"{f} double" for f in _FACTS)]))
        facts = facts.groupBy("q_id").agg(*(f(c).alias(c) for c, f in zip(_FACTS, (F.min, F.max, F.min, F.max), strict=True)))
        q = q.join(cut_lineage(facts), "q_id")
    return spread(q).cogroup(r.groupBy(*key)).applyInPandas(best, _PAIR)


def question_neighbors(queries: DataFrame, reference: DataFrame, n: int = 3) -> DataFrame:
    """(q_id, ref_q_id, ref_pos, score, n_rank): 0.7 scaled BM25 of the reference questions and 0.3 scaled token cosine.

    Only positive scores stay, so a document with a single other question gives no neighbour: scaled alone it is 0.
    """
    return _nearest(queries, reference, n, by_cosine=False).select("q_id", "ref_q_id", "ref_pos", "score", "n_rank")


def similar_questions(queries: DataFrame, reference: DataFrame, n: int = 3) -> DataFrame:
    """(q_id, ref_q_id, ref_pos, similarity, n_rank): the n reference questions of the document with the largest cosine."""
    return _nearest(queries, reference, n, by_cosine=True).select("q_id", "ref_q_id", "ref_pos", F.col("score").alias("similarity"), "n_rank")


def similar_gold_scores(pool: DataFrame, neighbors: DataFrame, reference_pool: DataFrame) -> DataFrame:
    """(q_id, cand_idx, similar): each gold candidate of a neighbour adds the similarity to candidates with its keys."""
    names = tuple(SIMILAR)
    gold = keyed(reference_pool.where("is_gold"), names).select(F.col("q_id").alias("ref_q_id"), "key_name", "key")
    votes = neighbors.select("q_id", "ref_q_id", "similarity").join(gold, "ref_q_id")
    votes = votes.groupBy("q_id", "key_name", "key").agg(F.sum("similarity").alias("votes"))
    met = keyed(pool, names).join(votes, ["q_id", "key_name", "key"])
    total = met.groupBy("q_id", "cand_idx").agg(F.sum(weighted("key_name", SIMILAR) * F.col("votes")).alias("similar"))
    out = pool.select("q_id", "cand_idx").join(total, ["q_id", "cand_idx"], "left")
    return out.select("q_id", "cand_idx", F.coalesce("similar", F.lit(0.0)).alias("similar"))


VOTES = ("exact", "page", "layout", "page_type", "raw_type")


def neighbor_votes(pool: DataFrame, neighbors: DataFrame, reference_pool: DataFrame) -> DataFrame:
    """(q_id, cand_idx, exact, page, layout, page_type, raw_type votes): sums of neighbours' scores over gold evidence alike.

    Null pages and layouts never match, unlike in memory. Votes are summed by value before they meet candidates, so a
    candidate joins at most one row per kind of vote and no pairs of candidates arise.
    """
    key = X.content_key("content")
    gold = reference_pool.where("is_gold").select(F.col("q_id").alias("ref_q_id"), key.alias("text"), "page_id", "layout_id", "raw_type")
    votes = neighbors.select("q_id", "ref_q_id", "score").join(gold, "ref_q_id")
    page, layout = F.col("page_id").cast("string"), F.col("layout_id").cast("string")
    values = {
        "exact": F.when(F.col("text") != "", F.md5("text")), "page": page, "layout": layout,
        "page_type": F.when(page.isNotNull(), F.concat_ws("\x01", page, "raw_type")), "raw_type": F.col("raw_type"),
    }
    kinds = F.inline(F.array(*(F.struct(F.lit(n).alias("kind"), v.alias("value")) for n, v in values.items())))
    summed = votes.select("q_id", "score", kinds).where("value is not null").groupBy("q_id", "kind", "value").agg(F.sum("score").alias("votes"))
    mine = pool.select("q_id", "cand_idx", "page_id", "layout_id", "raw_type", key.alias("text")).select("q_id", "cand_idx", kinds)
    met = mine.where("value is not null").join(summed, ["q_id", "kind", "value"])
    scale = F.when(F.col("kind") == "raw_type", 0.2).otherwise(1.0)
    wide = met.groupBy("q_id", "cand_idx").agg(*(F.sum(F.when(F.col("kind") == n, scale * F.col("votes"))).alias(n) for n in VOTES))
    out = pool.select("q_id", "cand_idx").join(wide, ["q_id", "cand_idx"], "left")
    return out.select("q_id", "cand_idx", *(F.coalesce(n, F.lit(0.0)).alias(f"{n}_votes") for n in VOTES))


def neighbor_facts(queries: DataFrame, neighbors: DataFrame, n: int = 3) -> DataFrame:
    """(q_id, best, mean of the first three, share of the n wanted, whether any) of each question's neighbours."""
    facts = neighbors.groupBy("q_id").agg(
        F.max(F.when(F.col("n_rank") == 1, F.col("score"))).alias("best"), F.avg(F.when(F.col("n_rank") <= 3, F.col("score"))).alias("mean3"),
        (F.count("*") / F.lit(float(max(n, 1)))).alias("share"), F.lit(1.0).alias("has"),
    )
    out = queries.select("q_id").join(facts, "q_id", "left")
    return out.select("q_id", *(F.coalesce(c, F.lit(0.0)).alias(f"neighbor_{c}") for c in ("best", "mean3", "share", "has")))
