import csv
from pathlib import Path

import pytest

from evidentia import cli
from evidentia.sources.tables import samples

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(DATA).exists(), reason="no test tables here")


def submitted(folder):
    rows = [r for p in sorted(folder.glob("*.csv")) for r in csv.DictReader(p.read_text().splitlines())]
    return {r["q_id"]: r["gold_quotes"].split() for r in rows}


def test_reports(spark):
    assert len(cli.run(spark, "stats", DATA)) == 4
    with pytest.raises(ValueError, match="mode"):
        cli.run(spark, "other", DATA)


@pytest.mark.parametrize("method", ["dense", "memory", "typed_memory_hybrid", "reranker_only", "dual_reranker", "llm"])
def test_submit_answers_every_question_of_every_split(spark, tmp_path, method):
    cli.run(spark, "submit", DATA, method, str(tmp_path / "a"))
    got = submitted(tmp_path / "a")
    with_pool = {r["q_id"] for r in cli.pools(spark, DATA).select("q_id").distinct().collect()}
    assert got.keys() == {r["q_id"] for r in samples(spark, DATA).select("q_id").collect()}
    assert all(got[q] for q in with_pool)


def test_submit_of_one_split_and_top_k(spark, tmp_path):
    cli.run(spark, "submit", DATA, "memory", str(tmp_path / "a"), cli.settings(["top_k=2"]), of="test")
    got = submitted(tmp_path / "a")
    assert got.keys() == {r["q_id"] for r in samples(spark, DATA).where("split = 'test'").select("q_id").collect()}
    assert max(map(len, got.values())) == 2


@pytest.mark.parametrize("split", ["given", "doc", "row", "mixed", "domain"])
def test_eval_under_every_split(spark, split):
    row = cli.run(spark, "eval", DATA, "memory", split=split, holdout="Academic paper").pop().first()
    assert row["total"] > 0 and 0 <= row["recall_at_5"] <= 1 and row["num_dev_docs"] > 0


def test_shards_are_disjoint_and_whole(spark):
    whole = {r["q_id"] for r in cli.run(spark, "dump_eval", DATA, "bm25", split="row", ratio=0.5).pop().collect()}
    parts = [{r["q_id"] for r in cli.run(spark, "dump_eval", DATA, "bm25", split="row", ratio=0.5, shards=2, shard=i).pop().collect()} for i in (0, 1)]
    assert parts[0] | parts[1] == whole and not parts[0] & parts[1] and all(parts)


def test_trained_method_and_analysis(spark):
    s = cli.settings(["ranker_iterations=2", "route_high_quotas=1,2,2", "ranker_domain_balance=sqrt"])
    assert s.route_high_quotas == (1, 2, 2)
    assert cli.run(spark, "eval", DATA, "doc_aware_ranker", s=s).pop().first()["total"] > 0
    frames = cli.run(spark, "analyze", DATA, "bm25", split="row", ratio=0.5)
    assert len(frames) == 7 and {r["family"] for r in frames[6].collect()} == set(cli.A.OPEN_FAMILIES)
    with pytest.raises(ValueError, match="parameter"):
        cli.settings(["other=1"])
