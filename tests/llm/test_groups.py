import datetime as dt
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from evidentia.llm.cross_split import overlap_classes, overlap_report, split_overlaps, words_of
from evidentia.llm.group_splits import components, group_splits, must_share, name_classes, split_shares
from evidentia.llm.top_n import best_of_groups, best_quotes

T0 = dt.datetime(2024, 1, 1)
SCORES = "score_id bigint, q_id string, cand_idx bigint, quote_id string, method string, score double, scored_at timestamp"
SAMPLES = "sample_pos bigint, q_id string, split string, doc_name string, domain string, question string, ingested_at timestamp"
CATALOG = "doc_name string, owner string"


def clashing(df, *names):
    return df.withColumns({c: F.lit(-1) for c in names})


def union_find(edges):
    up = {}

    def find(x):
        up.setdefault(x, x)
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        up[find(a)] = find(b)
    groups = {}
    for x in list(up):
        groups.setdefault(find(x), set()).add(x)
    return {frozenset(g) for g in groups.values()}


def test_components_against_union_find(spark):
    rng = random.Random(1)
    edges = [(f"v{i}", f"v{i + 1}") for i in range(30)] + [("hub", f"s{i}") for i in range(40)]
    edges += [(f"r{rng.randint(0, 60)}", f"r{rng.randint(0, 60)}") for _ in range(40)]
    df = spark.createDataFrame([*edges, edges[0], ("v1", "v0"), (None, "v0"), ("x", "x")], "u string, v string")
    got = {}
    for r in components(df).collect():
        got.setdefault(r["root"], set()).add(r["vertex"])
    assert {frozenset(g) for g in got.values()} == {g for g in union_find([e for e in edges if e[0] != e[1]])}
    assert components(df.limit(0)).count() == 0


def test_must_share(spark):
    names = ["A-x", "a_x.pdf", "B y", "C", "D", None, "", "--", "e", "Z", "q", "q "]
    s = clashing(spark.createDataFrame([(n,) for n in names + names[:3]], "doc_name string"), "d", "vertex", "root", "component", "owner")
    cat = [("ax", "O1"), ("b-y", "O1"), ("c", "unknown"), ("d", "unknown"), ("e", "O2"), ("mid", "O2"), ("mid", "O3"), ("z", "O3"), (None, "O1"), ("c", None), ("d", ""), ("c", "n/a"), ("d", "n/a")]
    c = spark.createDataFrame(cat, CATALOG)
    want = {("A-x", "a_x.pdf"), ("A-x", "B y"), ("B y", "a_x.pdf"), ("Z", "e"), ("q", "q ")}
    rows = [tuple(r) for r in must_share(s, c).collect()]
    assert set(rows) == want and len(rows) == len(want)
    assert {tuple(r) for r in must_share(s, c.limit(0)).collect()} == {("A-x", "a_x.pdf"), ("q", "q ")}
    assert must_share(s.limit(0), c).count() == 0
    classes = {r["doc_name"]: (r["component"], r["n_names"]) for r in name_classes(s, c).collect()}
    assert {(a, b) for a in classes for b in classes if a < b and classes[a] == classes[b]} == want
    assert classes["A-x"][1] == 3 and classes["D"][1] == 1


def test_group_splits_keep_groups_and_proportions(spark):
    rng = random.Random(2)
    docs = [min(rng.randint(0, 900), rng.randint(0, 900)) if i % 50 else None for i in range(6000)]
    rows = [(i, str(i), "train", None if k is None else f"doc {k}", "News " if (k or i) // 3 % 3 else "Laws", "q", T0) for i, k in enumerate(docs)]
    rows += [(7000 + i, *r[1:6], T0 + dt.timedelta(1)) for i, r in enumerate(rows[:100])] + [(9999, None, "train", "x", None, "q", None)]
    s = clashing(spark.createDataFrame(rows, SAMPLES), "n", "class", "place", "range", "main")
    c = spark.createDataFrame([(f"doc {i}", f"o{i // 3}") for i in range(300)], CATALOG)
    out = group_splits(s, c).collect()
    assert len(out) == 6000 and len({r["q_id"] for r in out}) == 6000
    by = {}
    for r in out:
        by.setdefault(r["component"], set()).add(r["split"])
    assert all(len(v) == 1 for v in by.values())
    for domain in ("news", "laws"):
        n = Counter(r["split"] for r in out if r["domain"] == domain)
        total = sum(n.values())
        assert abs(n["train"] / total - 0.8) < 0.04 and abs(n["test"] / total - 0.1) < 0.04
    shares = {(r["domain"], r["split"]): r for r in split_shares(group_splits(s, c)).collect()}
    assert shares["all", "train"]["n"] == sum(r["split"] == "train" for r in out)
    assert shares["news", "test"]["n"] == sum(r["split"] == "test" and r["domain"] == "news" for r in out)
    assert all(abs(r["error"]) < 0.04 for (d, _), r in shares.items() if d in ("all", "news", "laws"))
    assert group_splits(s.limit(0), c).count() == 0


def brute_best(rows, n=5):
    last = {}
    for i, q, c, k, m, s, at in sorted(rows, key=lambda r: (r[6] is not None, r[6] or T0, r[0])):
        if q is None or not q.strip().isdigit() or m is None or k is None:
            continue
        last[int(q), m, k.strip()] = (s, c)
    groups = {}
    for (q, m, k), (s, c) in last.items():
        if s is not None and s == s:
            groups.setdefault((q, m), []).append((-s + 0.0, c, k))
    return {(q, m, k) for (q, m), v in groups.items() for _, _, k in sorted(v)[:n]}


def test_best_quotes_against_brute_force(spark):
    rng = random.Random(3)
    values = [None, float("nan"), -0.0, 0.0, 1.5, 2.0, -3.0, float("inf"), float("-inf"), 1e300, 5e-324]
    rows = []
    for i in range(3000):
        q, c = rng.choice(["1", "2", " 3", "77 "]) if rng.random() < 0.5 else str(rng.randint(10, 200)), rng.randint(0, 40)
        rows.append((i, q, c, f" t{c}" if rng.random() < 0.1 else f"t{c}", rng.choice(["bm25", "dense"]), rng.choice(values), rng.choice([None, T0, T0 + dt.timedelta(rng.random())])))
    rows += [(9000 + i, "500", i, f"t{i}", "bm25", 1.0, T0) for i in range(4000)]  # one hot pool of ties
    rows += [(20000, None, 1, "t", "bm25", 1.0, T0), (20001, "1", 1, None, "bm25", 1.0, T0), (20002, "x", 1, "t", "bm25", 1.0, T0), (20003, "1", 1, "t", None, 1.0, T0)]
    df = clashing(spark.createDataFrame(rows, SCORES), "slot", "part", "lo", "hi", "left", "n", "p0", "hot", "kept", "cut", "tie", "at")
    got = [tuple(r) for r in best_quotes(df).collect()]
    assert len(got) == len(set(got)) and set(got) == brute_best(rows)
    assert best_quotes(df.limit(0)).count() == 0


@pytest.mark.parametrize("fan", [2, 16])
def test_best_of_groups_with_null_ties(spark, fan):
    rows = [("g", f"i{i}", float(i % 3), None if i % 2 else i) for i in range(50)]
    df = spark.createDataFrame(rows, "g string, item string, score double, tie bigint")
    got = {r["item"] for r in best_of_groups(df, ["g"], "item", 7, fan).collect()}
    assert got == {r[1] for r in sorted(rows, key=lambda r: (-r[2], r[3] is None, r[3] or 0))[:7]}
    assert best_of_groups(df, ["g"], "item", 100, fan).count() == 50


def test_split_overlaps_against_brute_force(spark):
    rng = random.Random(4)
    words = "How much did the net revenue of alpha beta gamma delta change in total against last year".split()
    rows = []
    for i in range(400):
        w = words[: rng.randint(8, 16)]
        for _ in range(rng.randint(0, 2)):
            w[rng.randrange(len(w))] = rng.choice(["omega", "psi"])
        text = " ".join(w) + rng.choice(["", " 2020", " 2021"])
        rows.append((i, str(i), rng.choice(["train", "validation", "test", "Train "]), rng.choice(["d-1", "D 1.pdf", "d2", None, ""]), "News", rng.choice([text, text.upper(), text.replace("o", "о")]), T0))
    rows += [(900, "5", *rows[5][2:6], T0 + dt.timedelta(1)), (901, "901", "train", "d2", None, None, T0), (902, "902", None, "d2", None, "x", T0), (903, "903", "test", "d2", None, "??", None)]
    df = clashing(spark.createDataFrame(rows, SAMPLES), "rep", "bucket", "words", "block", "train", "doc", "x", "at")
    got = {(r["q_id_train"], r["q_id_eval"]) for r in split_overlaps(df).collect()}
    want = set()
    clean = lambda n: {"d-1": 1, "D 1.pdf": 1, "d2": 2}.get(n)
    for a in rows[:400]:
        for b in rows[:400]:
            if a[2].strip().lower() == "train" and b[2] in ("validation", "test") and clean(a[3]) and clean(a[3]) == clean(b[3]):
                x, y = set(words_of(a[5])), set(words_of(b[5]))
                digits = lambda z: {v for v in z if any(map(str.isdigit, v))}
                if digits(x) == digits(y) and len(x & y) >= 0.75 * len(x | y):
                    want.add((a[0], b[0]))
    assert got == want and len(want) > 50
    report = overlap_report(split_overlaps(df)).collect()
    assert sum(r["n_pairs"] for r in report) == len(want)
    links = Counter(x for pair in want for x in pair)
    assert {r["q_id"]: r["n_links"] for r in overlap_classes(df).collect()} == dict(links)
    uneven = df.withColumn("domain", F.element_at(F.array(*map(F.lit, ("News", " news", "NEWS "))), (F.col("sample_pos") % 3 + 1).cast("int")))
    assert {r["domain"] for r in overlap_report(split_overlaps(uneven)).collect()} == {"news"}
    assert split_overlaps(df.limit(0)).count() == 0
