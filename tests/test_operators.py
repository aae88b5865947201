import math
import random
from collections import Counter
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from evidentia.operators import fusion, lexical, metrics, mining, ranking, rerank, splits
from evidentia.operators import memory as M
from evidentia.sources import records

MICRO = str(Path(__file__).parent / "data/micro.jsonl")


def brute_bm25(question, docs):
    n, avg = len(docs), sum(map(len, docs)) / len(docs)
    df = Counter(t for d in docs for t in set(d))
    out = []
    for d in docs:
        tf = Counter(d)
        out.append(
            sum(
                qf * math.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5)) * tf[t] * 2.5 / (tf[t] + 1.5 * (0.25 + 0.75 * max(len(d), 1) / avg))
                for t, qf in Counter(question).items()
                if tf[t]
            )
        )
    return out


def test_bm25_against_brute_force(spark):
    rng = random.Random(1)
    words = "alpha beta gamma delta 2020 x".split()
    rows, want = [], {}
    for q in range(5):
        question = [rng.choice(words) for _ in range(4)]
        docs = [[rng.choice(words) for _ in range(rng.randint(1, 9))] for _ in range(rng.randint(1, 7))]
        for i, (d, s) in enumerate(zip(docs, brute_bm25(question, docs), strict=True)):
            rows.append((str(q), i, " ".join(question), " ".join(d)))
            want[str(q), i] = s
    rows += [("none", 0, "", "alpha"), ("none", 1, None, None)]
    want |= {("none", 0): 0.0, ("none", 1): 0.0}
    df = spark.createDataFrame(rows, "q_id string, cand_idx int, question string, doc string")
    got = {(r["q_id"], r["cand_idx"]): r["bm25"] for r in lexical.bm25(df, "question", "doc").collect()}
    assert got.keys() == want.keys()
    assert all(got[k] == pytest.approx(want[k]) for k in want)


def pool(spark, rows, extra="s double"):
    return spark.createDataFrame(rows, f"q_id string, cand_idx bigint, {extra}")


def test_minmax_is_zero_on_flat_pools(spark):
    df = ranking.minmax(pool(spark, [("a", 0, 1.0), ("a", 1, 3.0), ("a", 2, 2.0), ("b", 0, 5.0), ("c", 0, 0.0), ("c", 1, 0.0)]), ["s"])
    assert {(r["q_id"], r["cand_idx"]): r["s_norm"] for r in df.collect()} == {
        ("a", 0): 0, ("a", 1): 1, ("a", 2): 0.5, ("b", 0): 0, ("c", 0): 0, ("c", 1): 0,
    }


def test_ranked_over_ranges_equals_a_sort(spark):
    rng = random.Random(2)
    rows = [("big" if rng.random() < 0.8 else f"q{i % 7}", i, float(rng.randint(0, 9))) for i in range(2000)]
    got = ranking.ranked(pool(spark, rows), ["q_id"], ranking.by_score("s")).collect()
    by = {}
    for q, i, s in rows:
        by.setdefault(q, []).append((-s, i))
    want = {i: n + 1 for v in by.values() for n, (_, i) in enumerate(sorted(v))}
    assert {r["cand_idx"]: r["rank"] for r in got} == want


def test_rank_percentile_and_top_k_break_ties_by_place(spark):
    df = pool(spark, [("a", 0, 1.0), ("a", 1, 1.0), ("a", 2, 2.0), ("b", 0, 9.0)])
    pct = {(r["q_id"], r["cand_idx"]): r["p"] for r in ranking.rank_percentile(df, "s", "p").collect()}
    assert pct == {("a", 2): 1.0, ("a", 0): 0.5, ("a", 1): 0.0, ("b", 0): 1.0}
    assert sorted((r["q_id"], r["cand_idx"]) for r in ranking.top_k(df, "s", 2).collect()) == [("a", 0), ("a", 2), ("b", 0)]


def test_context_boost_ignores_null_places(spark):
    df = pool(spark, [("a", 0, 0.2, 1, None), ("a", 1, 0.8, 1, None), ("a", 2, 0.5, None, 7)], "s double, page_id bigint, layout_id bigint")
    got = {r["cand_idx"]: round(r["s"], 6) for r in ranking.context_boost(df, "s", 0.1, 0.0).collect()}
    assert got == {0: 0.3, 1: 0.9, 2: 0.5}
    assert ranking.context_boost(df, "s") is df


def memory_pool(spark):
    extra = "quote_id string, modality string, raw_type string, content string, page_id bigint, layout_id bigint, doc_name string, domain string, question_type string, expected_key string, is_gold boolean"
    rng = random.Random(3)
    rows = [
        (f"q{q}", i, f"text{i}", "text", rng.choice(["text", "table"]), rng.choice(["A", "a", "", None, "b"]), rng.choice([1, 2, None]), rng.choice([1, None]), f"d{q % 2}", "News", "Comparative", "text", rng.random() < 0.4)
        for q in range(6)
        for i in range(4)
    ]
    return pool(spark, rows, extra)


def test_leave_one_out_equals_memory_without_the_question(spark):
    df = memory_pool(spark)
    loo = {(r["q_id"], r["cand_idx"]): (r["memory"], r["precise"]) for r in M.memory_scores(df, df, leave_one_out=True).collect()}
    for q in ("q0", "q3"):
        without = M.memory_scores(df.where(F.col("q_id") == q), df.where(F.col("q_id") != q)).collect()
        for r in without:
            assert loo[q, r["cand_idx"]] == pytest.approx((r["memory"], r["precise"]))


def test_null_pages_are_keys_of_memory(spark):
    df = memory_pool(spark)
    n = M.keyed(df.where("page_id is null"), ("doc_page",)).join(M.memory_table(M.keyed(df, ("doc_page",))), ["key_name", "key"]).count()
    assert n == df.where("page_id is null").count() > 0
    assert M.keyed(df.where("content is null or content = ''"), ("global_content",)).count() == 0


def test_reciprocal_ranks_against_brute_force(spark):
    rng = random.Random(4)
    lists = [{f"q{q}": rng.sample(range(9), rng.randint(0, 6)) for q in range(20)} for _ in range(3)]
    weights = (1.0, 1.0, 0.5)
    frames = [pool(spark, [(q, i, r + 1) for q, v in one.items() for r, i in enumerate(v)], "rank bigint") for one in lists]
    got = {}
    for r in fusion.reciprocal_rank_fusion(list(zip(frames, weights, strict=True))).collect():
        got.setdefault(r["q_id"], {})[r["rank"]] = r["cand_idx"]
    for q in lists[0]:
        score, seen = {}, []
        for one, w in zip(lists, weights, strict=True):
            for r, i in enumerate(one[q]):
                score[i] = score.get(i, 0) + w / (60 + r + 1)
                seen += [] if i in seen else [i]
        want = sorted(seen, key=lambda i: (-round(score[i], 9), seen.index(i)))
        assert [got.get(q, {})[k] for k in sorted(got.get(q, {}))] == want


def test_quota_union_against_brute_force(spark):
    rng = random.Random(5)
    lists = [{f"q{q}": rng.sample(range(12), 10) for q in range(20)} for _ in range(3)]
    frames = [pool(spark, [(q, i, r + 1) for q, v in one.items() for r, i in enumerate(v)], "rank bigint") for one in lists]
    got = {}
    for r in fusion.quota_union(list(zip(frames, (2, 2, 1), strict=True)), frames[2]).collect():
        got.setdefault(r["q_id"], {})[r["rank"]] = r["cand_idx"]
    for q in lists[0]:
        want = []
        for one, quota in zip([*lists, lists[2]], (2, 2, 1, 5), strict=True):
            want += [i for i in one[q] if i not in want][:quota]
        assert [got[q][k] for k in sorted(got[q])] == want[:5]


def test_recall_counts_repeats_and_skips_questions_without_gold(spark):
    df = spark.createDataFrame(
        [(["a", "b"], ["a", "a", "c", ""]), (["a"], []), (["a"], [""]), (list("vwxyza"), ["a"])], "answer array<string>, gold array<string>"
    ).withColumn("recall", metrics.recall("answer", "gold"))
    assert [r["recall"] for r in df.select("recall").collect()] == [pytest.approx(2 / 3), None, None, 0.0]
    assert metrics.evaluate(df).first().asDict() == {"recall_at_5": 0.333333, "evaluated": 2, "skipped": 2, "total": 4}


def test_rerank_keeps_the_tail_in_base_order(spark):
    rows = [("a", i, "x y", "x y" if i == 1 else "z", 1.0 - i / 10, i + 1) for i in range(4)]
    df = pool(spark, rows, "question string, doc_text string, s double, base_rank int")
    got = {r["cand_idx"]: r["rerank_order"] for r in rerank.rerank(df, "s", rerank.cosine_scorer, top=2, weight=0.9).collect()}
    assert got == {0: 2, 1: 1, 2: 3, 3: 4}


def brute_coverage(pool, k=5):
    """(cand_idx, modality, raw_type, page, layout, score) in the order of their ranks -> the greedy choice."""
    n, low, high = len(pool), min(p[5] for p in pool), max(p[5] for p in pool)
    score = {p[0]: round(0.7 * ((p[5] - low) / (high - low) if high > low else 0) + 0.3 * (1 - i / (n - 1) if n > 1 else 1), 6) for i, p in enumerate(pool)}
    chosen = []
    while len(chosen) < min(k, n):
        def adjusted(p):
            x = score[p[0]] - 0.08 * any(c[3] == p[3] is not None for c in chosen) - 0.04 * any(c[4] == p[4] is not None for c in chosen)
            x -= 0.05 * max(0, sum(c[1] == p[1] for c in chosen) - 1) + 0.03 * sum(c[2] == p[2] for c in chosen)
            return x + 0.12 * (not any(c[1] == p[1] for c in chosen))

        chosen.append(min((p for p in pool if p not in chosen), key=lambda p: (-round(adjusted(p), 9), p[0])))
    return [c[0] for c in chosen]


def test_coverage_against_brute_force(spark):
    rng = random.Random(6)
    pools = {}
    for q in range(25):
        rows = [(i, *rng.choice([("text", "text"), ("image", "table"), ("image", "chart")]), rng.choice([1, 2, 3, None]), rng.choice([1, None]), round(rng.random(), 2)) for i in range(rng.randint(1, 30))]
        pools[f"q{q}"] = sorted(rows, key=lambda p: (-p[5], p[0]))
    rows = [(q, *p[:5], "Comparative", ["table", "text"], p[5]) for q, pool in pools.items() for p in pool]
    rows += [("plain", *r[1:6], "Descriptive", *r[7:]) for r in rows if r[0] == "q0"]
    pools["plain"] = pools["q0"]
    df = pool(spark, rows, "modality string, raw_type string, page_id bigint, layout_id bigint, question_type string, expected array<string>, s double")
    got = {}
    for r in fusion.coverage_select(df, "s", ranking.ranks(df, "s", "rank")).collect():
        got.setdefault(r["q_id"], {})[r["rank"]] = r["cand_idx"]
    swapped = 0
    for q, rows in pools.items():
        first = rows[:5]
        pages = [p[3] for p in first if p[3] is not None]
        needs = q != "plain" and (len({p[1] for p in first}) < 2 or (len(pages) >= 3 and len(set(pages)) <= 2))
        want = brute_coverage(rows) if needs else [p[0] for p in first]
        swapped += needs and want != [p[0] for p in first]
        assert [got[q][k] for k in sorted(got[q])] == want
    assert swapped > 3


def test_running_sums_over_ranges(spark):
    rng = random.Random(7)
    rows = [("big" if rng.random() < 0.7 else "small", i, float(rng.randint(0, 9))) for i in range(500)]
    got = {r["cand_idx"]: r["sum"] for r in ranking.running(pool(spark, rows), ["q_id"], ranking.by_score("s"), F.col("s"), "sum").collect()}
    for g in ("big", "small"):
        total = 0.0
        for s, i in sorted((-s, i) for q, i, s in rows if q == g):
            total -= s
            assert got[i] == pytest.approx(total)


def test_best_weight_is_a_fold_that_compares_with_the_rounded_best(spark):
    grid = spark.createDataFrame([(0.3, 5 / 6), (0.5, 5 / 6), (0.7, 0.5), (0.9, 2 / 3)], "w double, recall double")
    assert metrics.best_weight(grid, "w", "w", "recall").first().asDict() == {"weight": 0.5, "recall": 0.833333}


def test_stream_counts_redelivered_candidates_once(spark, tmp_path):
    from evidentia.streaming.memory import current, maintain

    schema = "q_id string, cand_idx bigint, is_gold boolean, key_name string, key string"
    rows = [("a", 0, True, "k", "x"), ("a", 1, False, "k", "x"), ("b", 0, True, "k", "y"), ("a", 0, True, "k", "x")]
    for n, part in enumerate((rows[:2], rows[1:])):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(schema).parquet(f"{tmp_path}/in")
        maintain(stream, f"{tmp_path}/out").awaitTermination()
        got = {r["key"]: (r["candidate_cnt"], r["gold_cnt"]) for r in current(spark, f"{tmp_path}/out").collect()}
        assert got == ({"x": (2, 1)} if n == 0 else {"x": (2, 1), "y": (1, 1)})


def test_cache_finds_hits_and_encodes_misses(spark):
    from evidentia.operators.dense import cache_key, encoded, model_encoder

    calls = model_encoder(lambda: lambda texts: [[3.0 * len(t), 4.0 * len(t)] for t in texts])
    df = spark.createDataFrame([("aa",), ("b",), ("aa",), (None,)], "t string")
    cache = spark.createDataFrame([("b",)], "t string").select(cache_key("m", "t").alias("cache_key"), F.array(F.lit(9.0).cast("float")).alias("vector"))
    got = {r["cached"]: [round(x, 6) for x in r["vector"]] for r in encoded(df, "t", "m", calls, cache).collect()}
    assert got == {True: [9.0], False: [0.6, 0.8]}


def test_images_are_read_in_batches(spark, tmp_path):
    (tmp_path / "x").mkdir()
    (tmp_path / "x/a.png").write_bytes(b"abc")
    from evidentia.operators.dense import model_encoder

    size = model_encoder(lambda: lambda pictures: [[float(len(p))] for p in pictures])
    rows = records.read_images(spark, str(tmp_path)).select("path", size(F.col("content")).alias("v")).collect()
    assert [(r["path"].endswith("x/a.png"), r["v"]) for r in rows] == [(True, [1.0])]


def test_listed_ids_are_stripped(spark):
    from evidentia.functions import text as X

    df = spark.createDataFrame([('[" text1 ", "image2", "no"]',), ("text1 and image2, text1",), ("[1, ",), (None,)], "o string").withColumn("a", F.array(F.lit("image2"), F.lit("text1")))
    assert [r["x"] for r in df.select(X.parse_quote_ids("o", "a").alias("x")).collect()] == [["text1", "image2"], ["text1", "image2"], [], []]


def test_training_pairs(spark):
    df = pool(spark, [("a", i, float(9 - i), i == 3) for i in range(10)] + [("b", 0, 1.0, False)], "s double, is_gold boolean")
    got = mining.training_pairs(df, "s", hard=3, random=2).collect()
    assert {r["q_id"] for r in got} == {"a"}
    assert Counter(r["kind"] for r in got) == {"positive": 1, "hard": 3, "random": 2}
    assert {r["cand_idx"] for r in got if r["kind"] == "hard"} == {0, 1, 2}
    assert len({r["cand_idx"] for r in got}) == 6


def test_splits(spark):
    s = spark.createDataFrame([(str(i), f"d{i % 7}", "Academic_paper" if i % 3 else "News") for i in range(50)], "q_id string, doc_name string, domain string")
    row = Counter(r["part"] for r in splits.split_by_row(s).collect())
    assert row == {"train": 45, "dev": 5}
    doc = {r["q_id"]: r["part"] for r in splits.split_by_document(s, 0.3).collect()}
    assert len({i % 7 for i in range(50) if doc[str(i)] == "dev"}) == 2
    assert all(len({doc[str(i)] for i in range(50) if i % 7 == k}) == 1 for k in range(7))
    assert Counter(r["part"] for r in splits.split_by_domain(s, "Academic paper").collect())["dev"] == 33
    mixed = {r["q_id"]: r["part"] for r in splits.split_mixed(s, 0.2).collect()}
    assert len(mixed) == 50 and 0 < sum(p == "dev" for p in mixed.values()) <= 17
    kept = {i % 7 for i in range(50) if mixed[str(i)] == "train"}
    whole = set(range(7)) - kept
    assert whole and sum(mixed[str(i)] == "dev" and i % 7 in kept for i in range(50)) == 7
    with pytest.raises(ValueError, match="one side"):
        splits.split_by_domain(s, "Laws")
    with pytest.raises(ValueError, match="unknown split"):
        splits.eval_split(s, "other")
    one = s.where("doc_name = 'd1'")
    assert {r["part"] for r in splits.split_by_document(one).collect()} == {"dev"}
    placed = splits.positions(s, [F.asc("q_id")], "place")
    assert sum(splits.shard(placed, "place", 4, n).count() for n in range(4)) == 50
    with pytest.raises(ValueError, match="shard"):
        splits.shard(placed, "place", 4, 4)


def test_records(spark):
    r = records.read_records(spark, MICRO)
    assert r.count() == 2
    c = {(x["q_id"], x["cand_idx"]): x for x in records.record_candidates(r).collect()}
    assert len(c) == 4
    assert c["1", 0]["content"] == "Revenue was 5 in 2020" and c["1", 0]["raw_type"] == "text"
    assert c["1", 2]["modality"] == "image" and c["1", 2]["img_path"] == "images/a.png"
    assert c["2", 0]["raw_type"] == "Equation" and c["2", 0]["content"] == "x = 1" and c["2", 0]["page_id"] is None


def test_malformed_record_fails(spark, tmp_path):
    (tmp_path / "bad.jsonl").write_text('{"q_id": 1}\n{oops\n')
    with pytest.raises(Exception, match="(?i)malformed|FAILFAST"):
        records.read_records(spark, str(tmp_path)).collect()


def test_answers_file(spark, tmp_path):
    q = spark.createDataFrame([("b", 1), ("a", 0), ("c", 2)], "q_id string, sample_pos bigint")
    a = spark.createDataFrame([("a", list("123456")), ("b", ["x"])], "q_id string, answer array<string>")
    rows = records.answer_rows(q, a)
    records.write_answers(rows, str(tmp_path / "out"))
    lines = b"".join(p.read_bytes() for p in sorted((tmp_path / "out").glob("*.csv"))).split(b"\r\n")
    assert [x for x in lines if x and not x.startswith(b"q_id")] == [b"a,1 2 3 4 5", b"b,x", b'c,""'] or b"c," in lines


def test_resolved_paths(spark):
    c = spark.createDataFrame([("q", 0, "x/a.png"), ("q", 1, "x/b.png"), ("q", 2, None)], "q_id string, cand_idx bigint, img_path string")
    have = spark.createDataFrame([("/r/images/b.png",), ("/r/b.png",)], "path string")
    got = {r["cand_idx"]: r["resolved"] for r in records.resolved_paths(c, have, "/r").collect()}
    assert got == {0: "/r/x/a.png", 1: "/r/images/b.png", 2: None}


@pytest.mark.parametrize("block", [400, 7])
def test_neighbors_in_blocks_against_brute_force(spark, monkeypatch, block):
    """With a block of 7 every document is split into several."""
    from evidentia.operators import neighbors as N

    monkeypatch.setattr(N, "BLOCK", block)
    rng = random.Random(8)
    words = "how much did net revenue of alpha beta gamma grow in 2020 2021".split()
    rows = [(f"q{i:02}", rng.choice(["a", "a", "b", "c", ""]) if i else "single", i, " ".join(rng.choices(words, k=rng.randint(0, 8)))) for i in range(60)]
    df = spark.createDataFrame(rows, "q_id string, doc_name string, sample_pos bigint, question string")
    ref = df.where("sample_pos % 4 > 0")
    near = {(r["q_id"], r["ref_q_id"]): (r["n_rank"], r["score"]) for r in N.question_neighbors(df, ref).collect()}
    alike = {(r["q_id"], r["ref_q_id"]): (r["n_rank"], r["similarity"]) for r in N.similar_questions(df, ref).collect()}
    want_near, want_alike = {}, {}
    for q, doc, _, text in rows:
        others = [(o, p, t.split()) for o, d, p, t in rows if d == doc != "" and p % 4 > 0 and o != q]
        if not others:
            continue
        terms = text.split()
        bm25 = brute_bm25(terms, [t for *_, t in others]) if any(t for *_, t in others) else [0.0] * len(others)
        cosine = [len(set(terms) & set(t)) / math.sqrt(len(set(terms)) * len(set(t))) if terms and t else 0.0 for *_, t in others]
        unit = lambda x: [(y - min(x)) / (max(x) - min(x)) if max(x) - min(x) > 1e-9 * max(map(abs, x)) else 0.0 for y in x]
        score = [0.7 * a + 0.3 * b for a, b in zip(unit(bm25), unit(cosine), strict=True)]
        for values, want in ((score, want_near), (cosine, want_alike)):
            best = sorted((-round(v, 6), p, o, v) for (o, p, _), v in zip(others, values, strict=True) if round(v, 6) > 0)[:3]
            want |= {(q, o): (n, v) for n, (_, _, o, v) in enumerate(best, 1)}
    for got, want in ((near, want_near), (alike, want_alike)):
        assert got.keys() == want.keys() and len(want) > 60
        assert all(got[k][0] == want[k][0] and got[k][1] == pytest.approx(want[k][1]) for k in want)
    assert N.question_neighbors(df, ref.limit(0)).count() == 0 and N.similar_questions(df.limit(0), ref).count() == 0
