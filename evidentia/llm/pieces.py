"""Long texts cut into numbered pieces at natural boundaries, each sharing characters with the one before."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidentia.session import broadcast_if_small

# What a piece may end with, strongest first; each alternative takes as much as it can between the two bounds.
_BOUNDARIES = (
    r"(?<=\n\s{0,8}\n)",  # blank line
    r"(?<=[\n\r])",  # line break
    r"(?<=[.!?…।؟;][\"'”’»)\]]{0,3}\s{1,4})|(?<=[。！？｡][」』”’）]{0,3})(?![」』”’）])",  # end of a sentence
    r"(?<=[,:،、，；：|)\]」』]\s{0,4})(?<!\S\s{0,3})|(?<=[、，；：|])",  # clause or cell
    r"(?<=\s)(?!\s)",  # word
    r"\b{g}",  # what a reader sees as one character
)


def _alternatives(low: str, high: str) -> F.Column:
    """Alternatives by strength, then any character; bounds are columns."""
    body = F.concat(F.lit("[\\s\\S]{"), F.col(low), F.lit(","), F.col(high), F.lit("}"))
    rest = F.concat(F.lit("[\\s\\S]{1,"), F.col(high), F.lit("}"))
    parts: list[F.Column] = [rest, F.lit("\\z")]
    for b in _BOUNDARIES:
        parts += [F.lit("|"), body, F.lit(f"(?:{b})")]
    return F.concat(*parts, F.lit("|"), rest)


def _pattern() -> F.Column:
    """What a piece adds to the one before; the first piece has bounds of its own."""
    return F.concat(F.lit("(?s)\\A(?:"), _alternatives("first_least", "first_most"), F.lit(")|(?:"), _alternatives("least", "body"), F.lit(")"))


def cut_to_pieces(
    df: DataFrame, limits: DataFrame, key: str = "cand_id", text: str = "content", kind: str = "modality"
) -> DataFrame:
    """Rows (key, piece_no, n_pieces, start_pos, piece), piece_no from 0.

    ``limits`` has max_chars and overlap_chars for each value of ``kind``. A text within its limit is one piece. A longer
    one is cut at the strongest boundary in the second half of what a piece may hold, else between two characters as a
    reader sees them, else between two code points. From the second on, a piece begins with the last overlap_chars
    characters of the piece before, so that no piece is longer than max_chars and the pieces without their overlaps,
    in order, are the text. A limit under 1, and an overlap below 0 or not below its limit, are errors; a null overlap is 0.

    Null texts, and rows whose kind is null or has no limit, give no rows; an empty text is one empty piece. Repeated
    keys are cut each. Extra columns are left out. Characters are code points.
    """
    limits = limits.where(F.col(kind).isNotNull() & F.col("max_chars").isNotNull()).select(
        F.col(kind).alias("kind"), F.col("max_chars").cast("int").alias("max_chars"), F.coalesce("overlap_chars", F.lit(0)).cast("int").alias("overlap")
    )
    sound = (F.col("max_chars") >= 1) & (F.col("overlap") >= 0) & (F.col("overlap") < F.col("max_chars"))
    wrong = F.raise_error(F.format_string("no pieces of %d characters with an overlap of %d", "max_chars", "overlap"))
    limits = limits.withColumn("overlap", F.when(sound, F.col("overlap")).otherwise(wrong.cast("int")))
    limits = limits.dropDuplicates(["kind"]).withColumn("body", F.col("max_chars") - F.col("overlap"))
    # Bodies of at least the overlap, where they may be so long, so that it comes from one body; else from ``back`` of them,
    # and the first piece holds at least the overlap.
    half, short = F.greatest(F.lit(1), F.floor(F.col("body") / 2).cast("int")), F.col("overlap") <= F.col("body")
    limits = limits.withColumn("least", F.when(short, F.greatest(half, "overlap")).otherwise(half))
    limits = limits.withColumn("back", F.ceil(F.col("overlap") / F.col("least")).cast("int"))
    limits = limits.withColumn("first_least", F.when(short, F.col("least")).otherwise(F.col("overlap")))
    limits = limits.withColumn("first_most", F.when(short, F.col("body")).otherwise(F.col("max_chars"))).withColumn("pattern", _pattern())
    rows = df.select(F.col(key).alias("key"), F.col(kind).alias("kind"), F.col(text).alias("text"))
    rows = rows.where("text is not null").join(broadcast_if_small(limits), "kind")
    bodies = F.when(F.length("text") <= F.col("max_chars"), F.array("text")).otherwise(
        F.regexp_extract_all("text", F.col("pattern"), F.lit(0))
    )
    cut = rows.select("key", "overlap", "back", bodies.alias("bodies"))
    cut = cut.withColumn("sizes", F.transform("bodies", lambda x: F.length(x)))
    # Made within the row, so that the pieces of a long text don't each carry the text.
    pieces = F.expr(
        "transform(bodies, (x, i) -> struct(i as piece_no, size(bodies) as n_pieces,"
        " greatest(aggregate(slice(sizes, 1, i), 0L, (s, y) -> s + y) - overlap, 0L) as start_pos,"
        " if(i > 0, concat(right(array_join(slice(bodies, greatest(i - back + 1, 1), least(back, i)), ''), overlap), x), x) as piece))"
    )
    return cut.select(F.col("key").alias(key), F.inline(pieces))
