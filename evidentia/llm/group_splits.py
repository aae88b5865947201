"""Train, validation and test splits that keep related documents together."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from evidentia.llm.consistent_form import document_key
from evidentia.llm.top_n import trimmed
from evidentia.session import cut_lineage

#: Split and share, in the order in which the weight of a domain is laid out.
PROPORTIONS = (("train", 0.8), ("validation", 0.1), ("test", 0.1))
#: Owners that say nothing; fixed values.
NO_OWNER = ("", "unknown", "n/a")


def components(edges: DataFrame, seed: int = 7) -> DataFrame:
    """Connected components by random-mate contraction: (vertex, root) for every vertex of ``edges`` (u, v: strings).

    In each round every vertex tosses a coin, a hash of vertex, seed and round. Tails with a heads neighbour collapse
    into the smallest such neighbour; edges are renamed, loops and repeats go, until no edge is left. About a quarter
    of the vertices that still have edges go each round. The rounds' (child, parent) tables, unwound from the last to
    the first, give each vertex its root. Neighbours are reduced by min() before the shuffle, so a vertex with very many
    edges gathers nowhere. Edges with a null end and loops are left out.
    """
    edges = edges.where("u is not null and v is not null and u <> v")
    edges = cut_lineage(edges.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct())
    rounds: list[DataFrame] = []
    while not edges.isEmpty():
        heads = lambda c, r=len(rounds): F.xxhash64(c, F.lit(seed), F.lit(r)) % 2 == 0
        tossed = edges.select("u", "v", heads("u").alias("hu"), heads("v").alias("hv")).where("hu <> hv")
        mates = tossed.select(F.when(F.col("hu"), F.col("v")).otherwise(F.col("u")).alias("child"), F.when(F.col("hu"), F.col("u")).otherwise(F.col("v")).alias("mate"))
        hooks = cut_lineage(mates.groupBy("child").agg(F.min("mate").alias("parent")))
        rounds.append(hooks)
        for end in ("u", "v"):
            to = hooks.select(F.col("child").alias(end), "parent")
            edges = edges.join(to, end, "left").withColumn(end, F.coalesce("parent", end)).drop("parent")
        edges = edges.where("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()
        edges = cut_lineage(edges)
    if not rounds:
        return edges.select(F.col("u").alias("vertex"), F.col("v").alias("root"))
    labels = rounds[-1].select(F.col("child").alias("vertex"), F.col("parent").alias("root"))
    for i, hooks in enumerate(reversed(rounds[:-1])):
        up = labels.select(F.col("vertex").alias("parent"), "root")
        here = hooks.join(up, "parent", "left").select(F.col("child").alias("vertex"), F.coalesce("root", "parent").alias("root"))
        labels = labels.unionByName(here)
        if i % 4 == 3:
            labels = cut_lineage(labels)
    roots = labels.select(F.col("root").alias("vertex"), "root").distinct()
    return cut_lineage(labels.unionByName(roots))


def _name_edges(catalog: DataFrame) -> DataFrame:
    """Document to owner; one row per document and owner, so an owner of many documents costs a row for each."""
    owned = catalog.where(F.col("owner").isNotNull() & ~F.col("owner").isin(*NO_OWNER))
    owned = owned.select("doc_name", "owner").distinct().select(document_key("doc_name").alias("d"), "owner")
    return owned.where("d <> ''").select(F.concat(F.lit("d:"), "d").alias("u"), F.concat(F.lit("o:"), "owner").alias("v"))


def document_components(names: DataFrame, catalog: DataFrame) -> DataFrame:
    """(doc_name, component) for each distinct string of ``names.doc_name`` that names a document.

    Strings name one document if they are equal in consistent form, lower case and without file ending and all but
    letters and digits. Documents belong together through owners in ``catalog``; owners match as they stand, and null,
    empty, ``unknown`` and ``n/a`` ones link nothing. Null and empty names, and those without a letter or digit, are
    left out.
    """
    named = names.select("doc_name").where("doc_name is not null and doc_name <> ''").distinct()
    named = named.select("doc_name", document_key("doc_name").alias("d")).where("d <> ''")
    named = named.select("doc_name", F.concat(F.lit("d:"), "d").alias("vertex"))
    roots = components(_name_edges(catalog))
    return named.join(roots, "vertex", "left").select("doc_name", F.coalesce("root", "vertex").alias("component"))


def must_share(samples: DataFrame, catalog: DataFrame) -> DataFrame:
    """Pairs doc_name_a < doc_name_b of different strings of samples.doc_name that must get one split."""
    c = cut_lineage(document_components(samples, catalog))
    a = c.select("component", F.col("doc_name").alias("doc_name_a"))
    b = c.select("component", F.col("doc_name").alias("doc_name_b"))
    return a.join(b, "component").where("doc_name_a < doc_name_b").select("doc_name_a", "doc_name_b")


def domain_name(column: str) -> F.Column:
    """A domain without the unevenness of its spelling; null where it is blank."""
    text = F.lower(F.regexp_replace(trimmed(column), r"(?U)[\s_]+", " "))
    return F.when(text == "", None).otherwise(text)


def group_splits(samples: DataFrame, catalog: DataFrame, proportions: tuple[tuple[str, float], ...] = PROPORTIONS, seed: int = 7) -> DataFrame:
    """One row per question: (q_id, component, domain, split); questions of one component get one split.

    A component counts in the domain most of its questions have (the first by name on a tie; null is a domain). Within a
    domain components are laid out by falling size class and then by hash, and the middle of a component's stretch of
    the running total decides its split: large components fall into the first, largest split, and small ones fill the
    others, so that the proportions hold in each domain up to the size of one component. Of repeated deliveries the
    last counts. A question without a document is its own component. Questions without q_id are left out.

    The running total is one over size classes and hash ranges, at most 16384 rows a class, plus one within each range.
    """
    q = samples.select(trimmed("q_id").alias("q_id"), "doc_name", domain_name("domain").alias("domain"), F.struct("ingested_at", "sample_pos").alias("at"))
    q = q.where("q_id is not null and q_id <> ''").groupBy("q_id").agg(F.max_by(F.struct("doc_name", "domain"), "at").alias("x"))
    q = q.select("q_id", "x.doc_name", "x.domain")
    c = document_components(q, catalog)
    q = q.join(c, "doc_name", "left").select("q_id", "domain", F.coalesce("component", F.concat(F.lit("q:"), "q_id")).alias("component"))
    q = cut_lineage(q)
    by_domain = q.groupBy("component", "domain").agg(F.count("*").alias("n"))
    main = F.min_by("domain", F.struct(-F.col("n"), F.coalesce("domain", F.lit("")))).alias("main")
    sizes = by_domain.groupBy("component").agg(main, F.sum("n").alias("n"))
    size_class = F.floor(F.log2("n")).cast("int")
    place = F.pmod(F.xxhash64("component", F.lit(seed)), F.lit(1 << 20))
    sizes = cut_lineage(sizes.withColumns({"class": -size_class, "place": place, "range": F.floor(place / (1 << 6)).cast("int")}))
    ranges = sizes.groupBy("main", "class", "range").agg(F.sum("n").alias("range_n"))
    over = Window.partitionBy("main")
    ranges = ranges.select(
        F.col("main").alias("m"), F.col("class").alias("c"), F.col("range").alias("r"), F.sum("range_n").over(over).alias("total"),
        (F.sum("range_n").over(over.orderBy("class", "range")) - F.col("range_n")).alias("before"),
    )
    laid = sizes.join(ranges, F.expr("class = c and range = r and main <=> m"))
    inner = Window.partitionBy("main", "class", "range").orderBy("place", "component")
    middle = (F.col("before") + F.sum("n").over(inner) - F.col("n") / 2) / F.col("total")
    edges, at = [], 0.0
    for name, share in proportions:
        at += share
        edges.append((name, at))
    split = reduce(lambda rest, e: F.when(F.col("middle") < e[1], e[0]).otherwise(rest), reversed(edges[:-1]), F.lit(edges[-1][0]))
    chosen = laid.select("component", middle.alias("middle")).select("component", split.alias("split"))
    return q.join(chosen, "component").select("q_id", "component", "domain", "split")


def split_shares(splits: DataFrame, proportions: tuple[tuple[str, float], ...] = PROPORTIONS) -> DataFrame:
    """(domain, split, n, share, target, error): the shares that the splits of each domain's own questions reach, and
    under the domain ``all`` those of all questions; a null domain is ``unknown``. A split that got nothing has n 0."""
    of = splits.select(F.explode(F.array(F.lit("all"), F.coalesce("domain", F.lit("unknown")))).alias("domain"), "split")
    n = of.groupBy("domain").agg(F.count("*").alias("total"), *(F.count_if(F.col("split") == name).alias(name) for name, _ in proportions))
    wide = F.array(*(F.struct(F.lit(name).alias("split"), F.col(name).alias("n"), F.lit(share).alias("target")) for name, share in proportions))
    rows = n.select("domain", "total", F.inline(wide))
    share = F.col("n") / F.col("total").cast("double")
    return rows.select("domain", "split", "n", F.round(share, 6).alias("share"), "target", F.round(share - F.col("target"), 6).alias("error"))


def name_classes(samples: DataFrame, catalog: DataFrame) -> DataFrame:
    """(doc_name, component, n_names): the class of every distinct document name and its number of names, which stands for
    all pairs of names that must share a split."""
    c = cut_lineage(document_components(samples, catalog))
    return c.join(c.groupBy("component").agg(F.count("*").alias("n_names")), "component").select("doc_name", "component", "n_names")
