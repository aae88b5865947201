"""Question records as JSON lines, resolved image paths, and the answer file."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from evidentia.functions import text as X

_PLACE = [T.StructField("page_id", T.LongType()), T.StructField("layout_id", T.LongType())]


def _strings(*names: str) -> list[T.StructField]:
    return [T.StructField(n, T.StringType()) for n in names]


RECORD = T.StructType(
    [
        *_strings("q_id", "old_id", "doc_name", "domain", "question", "question_type"),
        T.StructField("evidence_modality_type", T.ArrayType(T.StringType())),
        T.StructField("gold_quotes", T.ArrayType(T.StringType())),
        T.StructField("text_quotes", T.ArrayType(T.StructType([*_strings("quote_id", "type", "text"), *_PLACE]))),
        T.StructField("img_quotes", T.ArrayType(T.StructType([*_strings("quote_id", "type", "img_description", "img_path"), *_PLACE]))),
    ]
)


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """One row per line; blank lines are skipped and a malformed one fails the read."""
    return spark.read.schema(RECORD).option("mode", "FAILFAST").json(path)


def read_images(spark: SparkSession, path: str) -> DataFrame:
    """(path, content): the pictures under a folder as they are stored, for an encoder's batches."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content")


def record_samples(records: DataFrame) -> DataFrame:
    """Questions of records: ids stripped, a blank old_id as null, the question normalised, lists of stripped strings."""
    empty = F.array().cast("array<string>")
    old_id = X.strip("old_id")
    return records.select(
        X.strip("q_id").alias("q_id"), F.when(old_id != "", old_id).alias("old_id"), *(X.strip(c).alias(c) for c in ("doc_name", "domain", "question_type")),
        X.normalize("question").alias("question"), F.transform(F.coalesce("evidence_modality_type", empty), X.strip).alias("types"),
        F.transform(F.coalesce("gold_quotes", empty), X.strip).alias("gold"),
    )


def record_candidates(records: DataFrame) -> DataFrame:
    """Candidates of each record: its text quotes, then its image quotes; cand_idx is the place in both together.

    Where the records have a column ``part``, the parts of a q_id are one pool, in order: cand_idx is the place in all its
    text quotes, then all its image quotes.
    """

    def unified(quotes: str, modality: str, content: str, path: Column | None) -> Column:
        kind = lambda x: X.strip(x["type"])
        return F.transform(
            F.coalesce(quotes, F.array().cast(RECORD[quotes].dataType)),
            lambda x: F.struct(
                X.strip(x["quote_id"]).alias("quote_id"), F.lit(modality).alias("modality"),
                F.when(kind(x) != "", kind(x)).otherwise(modality).alias("raw_type"), X.normalize(x[content]).alias("content"),
                x["page_id"].alias("page_id"), x["layout_id"].alias("layout_id"),
                (x["img_path"] if path is None else path).alias("img_path"),
            ),
        )

    both = F.concat(unified("text_quotes", "text", "text", F.lit(None).cast("string")), unified("img_quotes", "image", "img_description", None))
    q_id = X.strip("q_id").alias("q_id")
    if "part" not in records.columns:
        return records.select(q_id, F.posexplode(both).alias("cand_idx", "c")).select("q_id", "cand_idx", "c.*")
    n_text, n_img = (F.coalesce(F.size(x), F.lit(0)).cast("bigint") for x in ("text_quotes", "img_quotes"))
    pool = Window.partitionBy("q_id")
    before = pool.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = records.select(q_id, "part", n_text.alias("_texts"), n_img.alias("_imgs"))
    earlier = [F.coalesce(F.sum(x).over(before), F.lit(0)) for x in ("_texts", "_imgs")]
    sizes = sizes.select("q_id", "part", "_texts", earlier[0].alias("_text_at"), (F.sum("_texts").over(pool) + earlier[1]).alias("_img_at"))
    rows = records.select(q_id, "part", F.posexplode(both).alias("_place", "c")).join(sizes, ["q_id", "part"])
    at = F.when(F.col("_place") < F.col("_texts"), F.col("_text_at") + F.col("_place")).otherwise(F.col("_img_at") + F.col("_place") - F.col("_texts"))
    return rows.select("q_id", at.alias("cand_idx"), "c.*")


def resolved_paths(df: DataFrame, existing: DataFrame, root: str) -> DataFrame:
    """Adds ``resolved``: the first place of four under ``root`` where the image exists, else the first.

    ``existing`` has the column path; pictures themselves aren't read.
    """
    name = F.element_at(F.split("img_path", "/"), -1)
    places = [F.concat(F.lit(root + p), x) for p, x in (("/", F.col("img_path")), ("/images/", name), ("/images/images/", name), ("/", name))]
    tried = df.where("img_path is not null").select("img_path").distinct().select("img_path", F.posexplode(F.array(*places)).alias("n", "path"))
    found = tried.join(existing.select("path").distinct(), "path").groupBy("img_path").agg(F.min_by("path", "n").alias("found"))
    out = df.join(found, "img_path", "left")
    first = F.when(F.col("img_path").isNotNull(), places[0])
    return out.withColumn("resolved", F.coalesce("found", first)).drop("found")


def answer_rows(questions: DataFrame, answers: DataFrame) -> DataFrame:
    """(q_id, sample_pos, gold_quotes): up to five ids joined by spaces; empty where there is no answer."""
    out = questions.select("q_id", "sample_pos").join(answers, "q_id", "left")
    ids = F.coalesce(F.slice("answer", 1, 5), F.array().cast("array<string>"))
    return out.select("q_id", "sample_pos", F.array_join(ids, " ").alias("gold_quotes"))


def write_answers(rows: DataFrame, path: str) -> None:
    """CSV files with a header, in the order of the questions across files; CRLF ends lines."""
    rows.orderBy("sample_pos").select("q_id", "gold_quotes").write.mode("overwrite").option("header", True).option("lineSep", "\r\n").csv(path)
