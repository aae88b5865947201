"""Memory of gold evidence kept up to date by a stream of keyed candidates, as a table in the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

COUNTS = "key_name string, key string, candidate_cnt bigint, gold_cnt bigint"
_SEEN = ["q_id", "cand_idx", "key_name", "key"]


def memory_counts(keys: DataFrame) -> DataFrame:
    """(key_name, key, candidate_cnt, gold_cnt) of keyed candidates (q_id, cand_idx, is_gold, key_name, key)."""
    return keys.groupBy("key_name", "key").agg(F.count("*").alias("candidate_cnt"), F.count_if("is_gold").alias("gold_cnt"))


def maintain(stream: DataFrame, folder: str) -> StreamingQuery:
    """Keep the counts of a stream of keyed candidates under ``folder``, for the data available now.

    A candidate delivered twice counts once, by its question, place and key. Each batch adds two tables: the candidates not
    seen before, found by an anti-join with those of the batches before it, and their counts. All state is in these tables:
    executors keep none between batches, and the driver sees no rows. A batch that is run again overwrites its own tables.
    """

    def add(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        fresh = batch.dropDuplicates(_SEEN)
        if number:
            seen = spark.read.parquet(*(f"{folder}/seen/{i}" for i in range(number)))
            fresh = fresh.join(seen, _SEEN, "left_anti")
        fresh.select(*_SEEN, "is_gold").write.mode("overwrite").parquet(f"{folder}/seen/{number}")
        memory_counts(spark.read.parquet(f"{folder}/seen/{number}")).write.mode("overwrite").parquet(f"{folder}/counts/{number}")

    return stream.writeStream.foreachBatch(add).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()


def current(spark: SparkSession, folder: str) -> DataFrame:
    """The memory table as of the last batch: the batches' counts added up."""
    counts = spark.read.schema(COUNTS).option("recursiveFileLookup", "true").parquet(f"{folder}/counts")
    return counts.groupBy("key_name", "key").agg(F.sum("candidate_cnt").alias("candidate_cnt"), F.sum("gold_cnt").alias("gold_cnt"))
