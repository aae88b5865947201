"""Text expressions: stripping, normalising, tokens and what a candidate reads as."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: One token: letters and digits, with at most one joiner inside. Fixed value.
TOKEN = r"[A-Za-z0-9]+(?:[._/-][A-Za-z0-9]+)?"
#: How each kind of evidence is introduced. Fixed values.
PREFIXES = {
    "text": "Text passage",
    "table": "Table data",
    "figure": "Figure description",
    "chart": "Chart description",
    "image": "Image description",
    "layout": "Layout element",
}


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c: Column | str) -> Column:
    """Without white space around; null becomes empty."""
    return F.coalesce(F.regexp_replace(_col(c).cast("string"), r"(?U)^\s+|\s+$", ""), F.lit(""))


def normalize(c: Column | str) -> Column:
    """Escapes undone, dollar signs dropped, white space collapsed. Not idempotent: an escaped escape takes two calls."""
    text = F.coalesce(_col(c).cast("string"), F.lit(""))
    for escaped, plain in ((r"\%", "%"), (r"\$", "$"), (r"\_", "_"), ("$", " ")):
        text = F.replace(text, F.lit(escaped), F.lit(plain))
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def tokens(c: Column | str) -> Column:
    return F.regexp_extract_all(F.lower(normalize(c)), F.lit(TOKEN), F.lit(0))


def content_key(c: Column | str) -> Column:
    return F.lower(normalize(c))


def document_text(raw_type: Column | str, content: Column | str) -> Column:
    """The sentence that introduces a candidate, with its content."""
    kind = _col(raw_type)
    known = F.create_map(*(F.lit(x) for pair in PREFIXES.items() for x in pair))
    other = F.concat(F.upper(F.substring(kind, 1, 1)), F.lower(F.substring(kind, 2, 1 << 30)), F.lit(" evidence"))
    prefix = F.coalesce(F.try_element_at(known, F.lower(kind)), other)
    return F.trim(F.concat(F.lit("This is a "), prefix, F.lit(" containing the following information: "), normalize(content)))


def expected_types(types: Column | str) -> Column:
    """Lower case, without empty ones, sorted; repeats stay."""
    kept = F.filter(F.coalesce(_col(types), F.array().cast("array<string>")), lambda x: strip(x) != "")
    return F.array_sort(F.transform(kept, lambda x: F.lower(strip(x))))


def token_cosine(a: Column, b: Column) -> Column:
    """Shared distinct tokens over the root of the product of their numbers; 0 if either has none."""
    x, y = F.size(F.array_distinct(a)), F.size(F.array_distinct(b))
    return F.when((x == 0) | (y == 0), 0.0).otherwise(F.size(F.array_intersect(a, b)) / F.sqrt(x.cast("double") * y))


def token_jaccard(a: Column, b: Column) -> Column:
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 0.0).otherwise(F.size(F.array_intersect(a, b)) / union.cast("double"))


def first_words(c: Column | str, n: int) -> Column:
    return F.array_join(F.slice(F.split(normalize(c), " "), 1, n), " ")


def quote_ids(output: Column | str) -> Column:
    """A model's answer as (listed, mentioned): the ids of its JSON list, without white space around, and those it mentions
    anywhere; each once, in order."""
    listed = F.coalesce(F.from_json(_col(output), "array<string>"), F.array().cast("array<string>"))
    mentioned = F.coalesce(F.regexp_extract_all(_col(output), F.lit(r"\b(?:text|image)\d+\b"), F.lit(0)), F.array().cast("array<string>"))
    return F.struct(F.array_distinct(F.transform(listed, strip)).alias("listed"), F.array_distinct(mentioned).alias("mentioned"))


def parse_quote_ids(output: Column | str, allowed: Column | str) -> Column:
    """Ids of a model's answer that are allowed: of its JSON list, else those it mentions; each once, in order."""
    ids = quote_ids(output)
    of_json = F.array_intersect(ids["listed"], _col(allowed))
    return F.when(F.size(of_json) > 0, of_json).otherwise(F.array_intersect(ids["mentioned"], _col(allowed)))


def reranker_prompt(instruction: str, query: Column | str, document: Column | str) -> Column:
    return F.format_string("<Instruct>: %s\n<Query>: %s\n<Document>: %s", F.lit(instruction), _col(query), _col(document))


def frequency_bucket(n: Column) -> Column:
    return (
        F.when(n <= 0, "unseen").when(n <= 2, "seen_1_2").when(n <= 4, "seen_3_4").when(n <= 9, "seen_5_9")
        .otherwise("seen_10_plus")
    )


def confidence_bucket(x: Column) -> Column:
    return F.when(x <= 0, "none").when(x < 0.2, "low").when(x < 0.4, "mid").otherwise("high")
