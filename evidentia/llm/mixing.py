"""A mixture of sources at target weights, drawn as disjoint blocks by a tree of hypergeometric splits."""

from __future__ import annotations

import base64
import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from evidentia.llm.top_n import trimmed
from evidentia.session import broadcast_if_small, cut_lineage

TOKENIZER = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
#: A block holds this share of the mixture, so that a quota is met to about one part in so many.
BLOCKS = 4000
#: ... and at most so many tokens, which bounds a shard in a mixture of any size.
BLOCK_TOKENS = 1 << 20
#: Blocks of an output shard.
SHARD_BLOCKS = 64
_encodings: dict[bytes, object] = {}


def _encoding(pattern: str, content: bytes):
    key = hashlib.sha256(content).digest()
    if key not in _encodings:
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, content.splitlines())}
        _encodings[key] = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return _encodings[key]


def token_count(spark: SparkSession, text: Column | str, path: str = TOKENIZER) -> Column:
    """Tokens of a text under the public tokenizer whose ranks the file at ``path`` holds; null for null.

    The file, under a megabyte, is read once by the driver, from a local path, and broadcast, so executors need no copy.
    """
    import public_tokenizers

    with open(path, "rb") as f:
        known = spark.sparkContext.broadcast((public_tokenizers.PATTERN, f.read()))

    @F.pandas_udf(T.LongType())
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encode = _encoding(*known.value).encode_ordinary
        for s in batches:
            sizes = {v: len(encode(v)) for v in s.dropna().unique()}
            yield s.map(sizes).astype("Int64")

    return count(text)


def _coprime(start: int, n: int) -> int:
    a = max(1, start % max(n, 1))
    while math.gcd(a, n) != 1:
        a += 1
    return a


def _source(column: str) -> Column:
    name = F.lower(trimmed(column))
    return F.when(name != "", name)


def _walk(counts: list[int], sizes: list[int], seed: int, shards: pd.Series) -> pd.DataFrame:
    """For each shard its stretch [lo, hi) of every source's blocks, found by descending the tree of splits to it.

    A node splits its counts between its halves by a multivariate hypergeometric draw with a generator seeded by the
    node, so every task that passes a node sees the same split.
    """
    ends = np.concatenate(([0], np.cumsum(sizes)))
    splits: dict[tuple[int, int], np.ndarray] = {}
    out = []
    for shard in shards:
        lo, hi = 0, len(sizes)
        have, offset = np.array(counts, np.int64), np.zeros(len(counts), np.int64)
        while hi - lo > 1:
            mid = (lo + hi) // 2
            if (lo, hi) not in splits:
                rng = np.random.default_rng([seed, lo, hi])
                splits[lo, hi] = rng.multivariate_hypergeometric(have, int(ends[mid] - ends[lo]), method="marginals")
            left = splits[lo, hi]
            if shard < mid:
                have, hi = left, mid
            else:
                have, offset, lo = have - left, offset + left, mid
        out.append(pd.DataFrame({"shard": shard, "k": np.arange(len(counts)), "lo": offset, "hi": offset + have}))
    columns = ["shard", "k", "lo", "hi"]
    return pd.concat(out)[columns] if out else pd.DataFrame(columns=columns)


def mixture(
    docs: DataFrame, targets: DataFrame, tokens: Column | None = None, total_tokens: int | None = None, seed: int = 7, key: str = "doc_id",
    tokenizer: str = TOKENIZER,
) -> tuple[DataFrame, DataFrame]:
    """(mixture, report).

    mixture: one row per use of a document, (doc_id, source, copy, n_tokens, shard, position); ``copy`` counts a document's
    uses from 0, ``position`` is its place in its shard, a random order. report: per target source (source,
    target_share, max_repeats, n_docs, n_tokens, mixed_tokens, actual_share, in_reach, error, reach_share, reach_error):
    ``error`` is the actual share less the target; ``reach_share`` is a source's actual share of what the sources in reach
    contribute, and ``reach_error`` that less its target among theirs, null for sources out of reach.

    The mixture aims at ``total_tokens``, by default the size of all documents of the sources with a target. Documents of
    a source are put in a random order and cut into blocks of equal tokens; a source's quota is its share in blocks, at
    most its blocks times max_repeats. A source out of reach is used up to its cap and the report tells; the others
    aren't stretched in its place, so their shares hold among themselves, and each is above its target of the whole by what
    is missing. What a source contributes beyond whole passes over its documents is one stretch of its random order, so that
    a quota is met up to a document on each side. Quotas are split among shards by a tree of multivariate hypergeometric draws; each
    shard gets disjoint stretches of the sources' permuted blocks, and is shuffled by itself.

    Sources are compared trimmed and in lower case; documents whose source is null, blank or without a target, or with
    no tokens (null and empty texts), aren't used. Null or negative shares and caps count as 0; a source given twice
    counts once, with its largest share. Empty tables give an empty mixture. Extra columns are left out.
    """
    spark = docs.sparkSession
    weights = targets.select(_source("source").alias("source"), F.greatest(F.coalesce("target_share", F.lit(0.0)), F.lit(0.0)).alias("target_share"), F.greatest(F.coalesce("max_repeats", F.lit(0)), F.lit(0)).alias("max_repeats"))
    weights = weights.where("source is not null").groupBy("source").agg(F.max("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats"))
    weights = cut_lineage(weights)
    counted = docs.select(F.col(key).alias("doc_id"), _source("source").alias("source"), (token_count(spark, "text", tokenizer) if tokens is None else tokens).alias("n_tokens"))
    counted = counted.where("source is not null and n_tokens > 0").join(broadcast_if_small(weights.select("source")), "source", "left_semi")
    place = F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1 << 40))
    counted = cut_lineage(counted.withColumn("place", place))
    # One row per target source: a report's size.
    have = counted.groupBy("source").agg(F.count("*").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
    rows = weights.join(have, "source", "left").orderBy("source").collect()
    size = total_tokens or sum(r["n_tokens"] or 0 for r in rows)
    n_docs = sum(r["n_docs"] or 0 for r in rows)
    block = max(1, min(size // BLOCKS, BLOCK_TOKENS))
    plan, counts = [], []
    for k, r in enumerate(rows):
        n_blocks = math.ceil((r["n_tokens"] or 0) / block)
        wanted = round(r["target_share"] * size / block)
        counts.append(min(wanted, n_blocks * r["max_repeats"]))
        rng = np.random.default_rng([seed, k])
        full, rest = max(n_blocks, 1), max(1, counts[-1] % max(n_blocks, 1))
        times = [_coprime(int(rng.integers(1 << 30)), n) for n in (full, rest)]
        plan.append((k, r["source"], full, times[0], counts[-1] // full, rest, times[1], int(rng.integers(1 << 30)), bool(counts[-1] >= wanted)))
    total = sum(counts)
    n_shards = max(1, math.ceil(total / SHARD_BLOCKS))
    sizes = [total // n_shards + (i < total % n_shards) for i in range(n_shards)]

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield _walk(counts, sizes, seed, b["id"])

    stretches = spark.range(n_shards).mapInPandas(walk, "shard long, k long, lo long, hi long").where("lo < hi")
    sources = spark.createDataFrame(plan, "k long, source string, n_blocks long, times long, passes long, n_rest long, times_rest long, turn long, in_reach boolean")
    drawn = stretches.select("shard", "k", F.explode(F.sequence("lo", F.col("hi") - 1)).alias("v")).join(F.broadcast(sources), "k")
    # The v-th draw of a source falls in pass v / n_blocks. A whole pass takes all blocks in a permuted order; the last one
    # takes its n_rest blocks, permuted, from one stretch of them.
    copy, at = F.floor(F.col("v") / F.col("n_blocks")), F.pmod("v", "n_blocks")
    last = copy >= F.col("passes")
    n, times = (F.when(last, F.col(y)).otherwise(F.col(x)) for x, y in (("n_blocks", "n_rest"), ("times", "times_rest")))
    which = F.pmod(F.pmod(at * times, n) + F.col("turn") * (copy + 1), F.col("n_blocks"))
    drawn = drawn.select("shard", "source", copy.alias("copy"), which.alias("block"))
    # Running totals of tokens in the random order: one over ranges of places, one within each range.
    ranges = 1 << max(6, min(20, math.ceil(math.log2(n_docs / 1000 + 1))))
    counted = counted.withColumn("range", F.floor(F.col("place") / ((1 << 40) // ranges)))
    before = counted.groupBy("source", "range").agg(F.sum("n_tokens").alias("range_tokens"))
    running = Window.partitionBy("source").orderBy("range")
    before = before.select("source", "range", (F.sum("range_tokens").over(running) - F.col("range_tokens")).alias("before"))
    inner = Window.partitionBy("source", "range").orderBy("place", "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    middle = F.col("before") + F.col("inner") - F.col("n_tokens") / 2
    placed = counted.withColumn("inner", F.sum("n_tokens").over(inner)).join(before, ["source", "range"])
    placed = placed.select("doc_id", "source", "n_tokens", F.floor(middle / block).alias("block"))
    uses = placed.join(drawn, ["source", "block"])
    order = Window.partitionBy("shard").orderBy(F.xxhash64("doc_id", "copy", F.lit(seed)), "doc_id", "copy")
    uses = uses.select("doc_id", "source", "copy", "n_tokens", "shard", (F.row_number().over(order) - 1).alias("position"))
    mixed = uses.groupBy("source").agg(F.sum("n_tokens").alias("mixed_tokens"))
    report = weights.join(have, "source", "left").join(mixed, "source", "left").join(sources.select("source", "in_reach"), "source", "left")
    zero = F.lit(0).cast("long")
    report = report.select(
        "source", "target_share", "max_repeats", F.coalesce("n_docs", zero).alias("n_docs"), F.coalesce("n_tokens", zero).alias("n_tokens"),
        F.coalesce("mixed_tokens", zero).alias("mixed_tokens"), "in_reach",
    )
    whole = Window.partitionBy()  # one row per target source
    of = lambda x, condition=F.lit(True): F.try_divide(F.col(x), F.sum(F.when(condition, F.col(x))).over(whole))
    report = report.withColumn("actual_share", F.coalesce(of("mixed_tokens"), F.lit(0.0)))
    report = report.withColumn("error", F.col("actual_share") - F.col("target_share"))
    report = report.withColumn("reach_share", F.when(F.col("in_reach"), of("mixed_tokens", F.col("in_reach"))))
    report = report.withColumn("reach_error", F.col("reach_share") - of("target_share", F.col("in_reach")))
    return uses, report
