"""Every query with SQL gives what DuckDB makes of the SQL, over whole tables."""

import os
from pathlib import Path

import duckdb
import pandas as pd
import pytest

from evidentia.plans import registry

DATA = Path(os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001"))


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for p in DATA.glob("*.parquet"):
        c.execute(f"create view {p.stem} as select * from '{p}'")
    return c


def plain(df):
    def value(x):
        if pd.isna(x):
            return None
        return x if isinstance(x, (str, bool)) else round(float(x), 5)

    return sorted((tuple(value(x) for x in r) for r in df[sorted(df.columns)].itertuples(index=False)), key=repr)


@pytest.mark.skipif(not DATA.exists(), reason="no test tables here")
@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_sql(spark, duck, name):
    got = registry.queries()[name](spark, str(DATA)).toPandas()
    want = duck.execute(registry.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert plain(got) == plain(want)


def test_sql_only_for_queries():
    assert set(registry.oracle_sql()) <= set(registry.queries())


@pytest.mark.skipif(not DATA.exists(), reason="no test tables here")
def test_rrf_sums_whole_lists(spark):
    """Against sums in plain Python over all ranks."""
    from evidentia.operators.dense import scorer
    from evidentia.session import table

    sums, seen = {}, {}
    for i, (m, w) in enumerate((("bm25", 1.0), ("dense", 0.5))):
        pools = {}
        for r in scorer(table(spark, str(DATA), "scores"), m).collect():
            pools.setdefault(r["q_id"], []).append((-round(r[m], 6), r["cand_idx"]))
        assert max(map(len, pools.values())) > 20
        for q, pool in pools.items():
            for n, (_, c) in enumerate(sorted(pool), 1):
                sums[q, c] = sums.get((q, c), 0.0) + w / (60 + n)
                seen.setdefault((q, c), (i, n))
    want = {}
    for q, c in sorted(sums, key=lambda x: (-round(sums[x], 9), seen[x])):
        want.setdefault(q, []).append(c)
    got = {}
    for r in sorted(registry.queries()["rrf"](spark, str(DATA)).collect(), key=lambda r: r["rank"]):
        got.setdefault(r["q_id"], []).append(r["cand_idx"])
    assert got == {q: c[:10] for q, c in want.items()}


@pytest.mark.skipif(not DATA.exists(), reason="no test tables here")
def test_llm_prompt_has_every_candidate(spark):
    """Every line against plain Python."""
    from evidentia.plans.core import texts
    from evidentia.sources.tables import candidates, samples

    pools = {}
    for r in texts(candidates(spark, str(DATA))).collect():
        pools.setdefault(r["q_id"], []).append((r["cand_idx"], f"- {r['quote_id']}: " + " ".join(r["doc_text"].split()[:320])))
    assert max(map(len, pools.values())) > 20
    got = {}
    for r in sorted(registry.queries()["llm_prompt"](spark, str(DATA)).collect(), key=lambda r: r["line_no"]):
        got.setdefault(r["q_id"], []).append((r["line_no"], r["line"]))
    questions = {r["q_id"]: r["question"] for r in samples(spark, str(DATA)).collect()}
    assert got.keys() == questions.keys()
    for q, lines in got.items():
        assert len({n for n, _ in lines}) == len(lines)
        first, *body, last = [x for _, x in lines]
        assert first.startswith("You are a retrieval assistant.") and last.startswith("Return exactly one JSON array")
        assert body == [f"Question: {questions[q]}", "Candidates:", *(x for _, x in sorted(pools.get(q, [])))]


@pytest.mark.skipif(not DATA.exists(), reason="no test tables here")
def test_records_round_trip_returns_every_candidate(spark, tmp_path):
    """All candidates as two pools, against plain Python."""
    from pyspark.sql import functions as F
    from pyspark.sql.window import Window

    from evidentia.session import table
    from evidentia.sources.tables import candidates

    place = F.row_number().over(Window.orderBy("cand_id", "ingested_at")).cast("bigint")
    two = table(spark, str(DATA), "candidates").withColumn("_n", place).withColumn("q_id", (F.col("_n") % 2).cast("string"))
    two.withColumn("cand_idx", F.floor(F.col("_n") / 2)).drop("_n").write.parquet(f"{tmp_path}/candidates.parquet")
    pools = {}
    for r in candidates(spark, str(tmp_path)).where("modality in ('text', 'image')").collect():
        pools.setdefault(r["q_id"], []).append((r["modality"] != "text", r["cand_idx"], r["quote_id"], r["modality"], r["page_id"]))
    assert any(x[1] >= 100 for pool in pools.values() for x in pool)
    want = {(q, n, *x[2:]) for q, pool in pools.items() for n, x in enumerate(sorted(pool, key=lambda x: x[:2]))}
    rows = registry.queries()["records_round_trip"](spark, str(tmp_path)).select("q_id", "cand_idx", "quote_id", "modality", "page_id").collect()
    assert {tuple(r) for r in rows} == want and len(rows) == len(want)


@pytest.mark.skipif(not DATA.exists(), reason="no test tables here")
def test_trained_rankers_answer_every_pool(spark):
    """With few iterations, as the answers' form doesn't depend on them; recall is above that of the first five of a pool."""
    from pyspark.sql import functions as F

    from evidentia.operators import metrics as E
    from evidentia.operators import retrieval as RT
    from evidentia.operators.fusion import answers
    from evidentia.plans import core

    x, s = core.data(spark, str(DATA)), RT.Settings(ranker_iterations=5, use_coverage=True, use_reranker=True)
    rows = RT.ranked_by_model(x, s, F.expr(core.IS_REFERENCE), s)
    counts = x.reference.groupBy("doc_name").agg(F.count("*").alias("doc_count"))
    want = {(r["q_id"], min(5, r["n"])) for r in x.pool.groupBy("q_id").agg(F.countDistinct("cand_idx").alias("n")).collect()}
    first = {r["q_id"]: r["answer"] for r in x.pool.where("cand_idx < 5").groupBy("q_id").agg(F.collect_list("quote_id").alias("answer")).collect()}
    base = E.evaluate(E.with_recall(x.questions, spark.createDataFrame(list(first.items()), "q_id string, answer array<string>"))).first()["recall_at_5"]
    for got in (RT.doc_aware_ranker(rows, s, core.RR.cosine_scorer), RT.routed_doc_aware(rows, s, counts)):
        got = answers(got)
        assert {(r["q_id"], len(r["answer"])) for r in got.collect()} == want
        assert all(len(set(r["answer"])) == len(r["answer"]) for r in got.collect())
        assert E.evaluate(E.with_recall(x.questions, got)).first()["recall_at_5"] > base
