"""Evaluation splits and shards. Positions are global ranks, found range by range rather than in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidentia.operators.ranking import ranked, running
from evidentia.session import cut_lineage


def shuffled(key: str, seed: int = 42) -> Column:
    """A fixed random order of a key."""
    return F.md5(F.concat(F.col(key), F.lit(f":{seed}")))


def positions(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """Adds the global position from 1."""
    return ranked(df.withColumn("_all", F.lit(0)), ["_all"], order, name).drop("_all")


def split_by_document(samples: DataFrame, ratio: float = 0.1, seed: int = 42) -> DataFrame:
    """(q_id, part): whole documents in a fixed random order go to dev, max(1, round(n * ratio)) of them, fewer than all
    unless there is only one; half counts round to even."""
    docs = positions(samples.select("doc_name").distinct(), [shuffled("doc_name", seed), F.asc("doc_name")], "place")
    n = samples.agg(F.countDistinct("doc_name").alias("n"))
    wanted = F.greatest(F.lit(1), F.bround(F.col("n") * ratio, 0).cast("bigint"))
    dev = docs.crossJoin(F.broadcast(n)).where(F.col("place") <= F.when(F.col("n") > 1, F.least(wanted, F.col("n") - 1)).otherwise(wanted))
    out = samples.join(dev.select("doc_name", F.lit("dev").alias("part")), "doc_name", "left")
    return out.select("q_id", F.coalesce("part", F.lit("train")).alias("part"))


def split_by_row(samples: DataFrame, ratio: float = 0.1, seed: int = 42) -> DataFrame:
    """(q_id, part): questions in a fixed random order, max(1, round(n * ratio)) of them dev."""
    placed = positions(samples.select("q_id"), [shuffled("q_id", seed), F.asc("q_id")], "place")
    n = F.broadcast(samples.agg(F.count("*").alias("n")))
    wanted = F.greatest(F.lit(1), F.bround(F.col("n") * ratio, 0).cast("bigint"))
    return placed.crossJoin(n).select("q_id", F.when(F.col("place") <= wanted, "dev").otherwise("train").alias("part"))


def split_by_domain(samples: DataFrame, domain: str) -> DataFrame:
    """(q_id, part): one domain, underscores read as spaces, is held out; an error if that leaves a part empty."""
    held = F.replace(F.col("domain"), F.lit("_"), F.lit(" ")) == domain.strip().replace("_", " ")
    if samples.where(held).isEmpty() or samples.where(~held).isEmpty():
        raise ValueError(f"no questions on one side of the domain: {domain}")
    return samples.select("q_id", F.when(held, "dev").otherwise("train").alias("part"))


def split_mixed(samples: DataFrame, ratio: float = 0.1, overlap: float = 0.74, seed: int = 42) -> DataFrame:
    """(q_id, part): dev holds ``overlap`` of its questions from documents that also stay in train, the rest from documents
    taken whole.

    Documents in a fixed random order are taken whole until the share of unseen questions is reached, the last one whole
    too. Of the others' questions, all but one of each document, its first in a fixed random order, may be taken, in
    another such order, up to the rest. Where nothing would stay in train, the split is by row.
    """
    n = samples.count()
    wanted = max(1, round(n * ratio))
    wanted = min(wanted, n - 1) if n > 1 else 1
    seen = round(wanted * overlap)
    sizes = samples.groupBy("doc_name").agg(F.count("*").alias("size")).withColumn("_all", F.lit(0))
    docs = running(sizes, ["_all"], [shuffled("doc_name", seed), F.asc("doc_name")], F.col("size"), "sum")
    taken = cut_lineage(docs.where(F.col("sum") - F.col("size") < wanted - seen).select("doc_name"))
    rest = samples.join(taken, "doc_name", "left_anti").select("q_id", "doc_name")
    if rest.isEmpty():
        return split_by_row(samples, ratio, seed)
    first = rest.groupBy("doc_name").agg(F.min_by("q_id", F.struct(shuffled("q_id", seed), F.col("q_id"))).alias("q_id"))
    free = rest.join(first.select("q_id"), "q_id", "left_anti")
    others = positions(free.select("q_id"), [shuffled("q_id", seed + 1), F.asc("q_id")], "place").where(F.col("place") <= seen)
    dev = samples.join(taken, "doc_name", "left_semi").select("q_id").unionByName(others.select("q_id"))
    return samples.join(dev.withColumn("part", F.lit("dev")), "q_id", "left").select("q_id", F.coalesce("part", F.lit("train")).alias("part"))


def eval_split(samples: DataFrame, strategy: str, ratio: float = 0.1, seed: int = 42, overlap: float = 0.74, domain: str = "") -> DataFrame:
    """(q_id, part) by the named strategy: doc, row, mixed or domain."""
    if strategy == "doc":
        return split_by_document(samples, ratio, seed)
    if strategy == "row":
        return split_by_row(samples, ratio, seed)
    if strategy == "mixed":
        return split_mixed(samples, ratio, overlap, seed)
    if strategy == "domain":
        return split_by_domain(samples, domain)
    raise ValueError(f"unknown split: {strategy}")


def dev_positions(samples: DataFrame, parts: DataFrame, strategy: str, seed: int = 42) -> DataFrame:
    """(q_id, split_pos): places of the dev questions from 0 in the split's own order, by which shards are cut: by document
    and then as delivered, for row splits in their random order, else as delivered."""
    dev = samples.join(parts.where("part = 'dev'"), "q_id").select("q_id", "doc_name", "sample_pos")
    order = {"doc": [F.asc("first"), F.asc("sample_pos")], "row": [shuffled("q_id", seed), F.asc("q_id")]}.get(strategy, [F.asc("sample_pos")])
    first = dev.groupBy("doc_name").agg(F.min("sample_pos").alias("first"))
    out = positions(dev.join(first, "doc_name"), order, "place")
    return out.select("q_id", (F.col("place") - 1).alias("split_pos"))


def shard(df: DataFrame, position: str, shards: int, number: int) -> DataFrame:
    """Rows whose position from 1 falls to the shard; one shard or fewer keeps all."""
    if shards <= 1:
        return df
    if not 0 <= number < shards:
        raise ValueError("the shard's number must be from 0 to below their count")
    return df.where((F.col(position) - 1) % shards == number)
