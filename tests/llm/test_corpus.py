import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from evidentia.llm import leaks as L
from evidentia.llm.consistent_form import lowered
from evidentia.llm.mixing import _walk, mixture
from evidentia.llm.sentences import FIXED, learned, sentence_places, sentence_starts, sentences, words_of_clause


def cut(text):
    s = sentence_starts(text)
    return [text[a:b].strip() for a, b in zip(s, [*s[1:], len(text)], strict=False)]


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("Dr. A. Smith came at 5 p.m. on Monday. He left at 6 p.m. The end.", 3),
        ("Sold to Foo Inc. for 3 million. The buyer was Bar Inc. It paid 2.5 percent (cf. No. 7).", 3),
        ('"We will not wait. The plan stands," said Foo. Next one.', 2),
        ("“Is it final?” asked the clerk. Yes.", 2),
        ("(See Sec. 4.3 for more.) It holds. 12. Open the book. Did it pay 3?! Yes", 5),
        ("Heading 2020\n\nA line that\nwraps. www.86.example by X", 3),
        ("It paused ... and went on. Done", 2),
        ("Am 3. Mai 2012 kam Dr. Y, z. B. mit u. a. vielen. Siehe Nr. 4 bzw. Abs. 6.Danach ging er.", 3),
        ("„Wir warten nicht. Der Plan gilt“, sagte Foo. Gut.", 2),
        ("Voir fig. 5, p. 2 et art. 3. « Nous partons. Venez », a dit M. Foo. Pourquoi ? Bon.", 4),
        ("¿Por qué? ¡Vamos! El Sr. X, p. ej. hoy, suma aprox. 3.", 3),
        ("А. В. Иванов, т. е. автор, пишет в 2011 г. для нас. См. рис. 3 и табл. 4.", 2),
        ("Γιατί έμεινε; Ο κ. Α είδε, π.χ. εδώ, κάτι. «Δεν ξέρω. Όχι», είπε.", 3),
        ("なぜですか？はい（費用は3.5。前回は4。）が増えた。「待て。行く。」と述べた。", 3),
        ("主任说：“不等。照旧。”为什么？“定稿了吗？”他问。费用为3……二零年", 5),
        ("ดร.สมชายไปหน้า 62 แล้ว ผลสำรวจคงที่ บริษัทปรับ", 3),
        ("डॉ. राम ने देखा। क्या है? “हम नहीं। चलेगी,” कहा।", 3),
        ("قال د. سامي: «لن ننتظر. خطة قائمة» اليوم. لماذا؟ نعم.", 3),
        ("was foo inc. cost per text is 9? sold to foo inc. for 9 million. at 5 p.m. on tuesday.", 4),
        ("“IS THE SURVEY FINAL?” ASKED THE ANALYST. DID IT? YES.", 3),
        ("It went to Ιｎｃ． ｆоｒ 9 million. Next", 2),
        ("For X, it rose; for Y: no. eBrand fell. J．\xa0Ｋ． Ｍan．　Ｙes．", 4),
    ],
)
def test_sentences_of_each_language(text, want):
    assert len(cut(text)) == want, cut(text)


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("Gov. Smith met Sen. Lee on Jan. 5 at Univ. Hall. They left.", 2),
        ("Der Abg. Meier sprach mit Min. Vogt. Dann ging er.", 2),
        ("El Gral. Paz y la Dña. Ana hablaron. Fin.", 2),
        ("The U.S. Senate voted. It passed.", 2),
        ("He moved to the U.S. In May he left the U.K. market.", 2),
        ("他说：“我们走吧。”便离开了。", 1),
        ("彼は「本当に行くのか。」なんて言った。", 1),
        ("他停下……便走了。我们……他们来了吗？", 3),
        ("บริษัทปรับแผนที่ ผลสำรวจคงที่และ รายได้เพิ่มขึ้น", 2),
    ],
)
def test_sentences_by_the_words_around_a_gap(text, want):
    assert len(cut(text)) == want, cut(text)


def test_clauses_are_cut_by_the_cheapest_words():
    assert words_of_clause("经济增长速度放缓", FIXED.words) == ["经济", "增长", "速度", "放缓"]
    assert words_of_clause("ปรับแผนที่ของเมือง", FIXED.words) == ["ปรับ", "แผนที่", "ของ", "เมือง"]
    words = {"ab": 1.0, "abc": 1.0, "cd": 1.0, "d": 1.0}
    assert words_of_clause("abcdxy", words) in (["abc", "d", "xy"], ["ab", "cd", "xy"])
    assert words_of_clause("", words) == [] and words_of_clause("x" * 20_000, words) == ["x" * 20_000]


def test_model_learned_from_documents(spark):
    texts = ["We saw the Obj. no more. We went to Foo Inc. for 3 days. It was Bar Inc. For us it ended. Ja."] * 8
    texts += ["他来了。今天很好。今天下雨。今天是。今天去。今天不。", None, "", "plain"] * 8
    df = spark.createDataFrame([(t,) for t in texts], "text string").withColumns({c: F.lit(0) for c in ("word", "n", "w", "m")})
    m = learned(df)
    assert "obj" in m.abbreviations and "more" not in m.abbreviations
    assert m.goes_on["inc", "for", "number"] == 1.0 and m.goes_on["inc", "for", "word"] == 0.0
    assert "今天" in m.words
    assert len(sentence_starts("the obj. no more.", m)) == 1 and len(sentence_starts("the obj. no more.")) == 2
    assert len(sentence_starts("it was bar inc. for us it ended.", m)) == 2
    assert learned(df.limit(0)) == FIXED


@pytest.mark.parametrize("text", ["", " ", "\n\n", "a", "...", '"', "(" * 2000, ". " * 2000, "x" * 300_000, "a.\n\n\n\nb", "’”)"])
def test_sentences_lose_nothing(text):
    s = sentence_starts(text)
    assert s == sorted(set(s)) and all(not text[i].isspace() for i in s)
    assert "".join("".join(cut(text)).split()) == "".join(text.split())


def test_sentence_tables(spark):
    rows = [(1, "One. Two."), (2, None), (3, ""), (4, "  \n "), (5, "Ａ． One more"), (1, "One. Two."), (None, "x")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").withColumns({c: F.lit(0) for c in ("starts", "key", "i", "next")})
    got = sentences(df).collect()
    assert [(r["doc_id"], r["start_pos"], r["sentence"]) for r in got if r["doc_id"] == 1] == [(1, 0, "One."), (1, 5, "Two.")] * 2
    assert {r["doc_id"] for r in got} == {1, 5, None}
    assert sentence_places(df).count() == len(got)
    assert sentences(df.limit(0)).count() == 0


def pseudo(rng, n):
    return " ".join("".join(rng.choice("bcdfglmnprst") + rng.choice("aeiou") for _ in range(3)) for _ in range(n))


def test_leaks_against_brute_force(spark):
    rng = random.Random(1)
    items = [(i, pseudo(rng, 30)) for i in range(12)] + [(50, ""), (51, None), (None, pseudo(rng, 20)), (52, "tiny"), (0, None)]
    docs = []
    for k in range(160):
        text = pseudo(rng, rng.randint(5, 60))
        if k % 4 == 0:
            source = items[rng.randrange(12)][1]
            a = rng.randrange(0, 60)
            part = source[a : a + rng.choice([45, 66, 72, 90, 150])]
            text = text + " " + (part if k % 8 else part.upper().replace("O", "О").replace(" ", " \n")) + " " + pseudo(rng, 20)
        docs.append((k, text))
    docs += [(900, None), (901, ""), (902, "x" * 5000), (None, items[0][1]), (5, docs[5][1]), (903, "  ")]
    bare = lambda t: "".join(filter(str.isalnum, lowered(t)))
    grams = {i: {b[j : j + 60] for j in range(len(b) - 59)} for i, t in items if t and i is not None for b in [bare(t)]}
    want = {(d, i) for d, t in docs if t and d is not None for b in [bare(t)] for i, g in grams.items() if any(b[j : j + 60] in g for j in range(len(b) - 59))}
    clash = {c: F.lit(0) for c in ("term", "df", "cosine", "run", "weights", "n")}
    d = spark.createDataFrame(docs, "doc_id bigint, text string").withColumns(clash)
    e = spark.createDataFrame(items, "item_id bigint, text string").withColumns(clash)
    rows = [tuple(r) for r in L.leaked(d, e).collect()]
    assert set(rows) == want and len(rows) == len(want) > 10
    assert L.leaked(d.limit(0), e).count() == 0 and L.leaked(d, e.limit(0)).count() == 0


def test_paraphrases_against_brute_force(spark):
    """Every passage of every document against every stretch of every item, with numbers as whole tokens and names."""
    rng = random.Random(5)
    items = [(i, pseudo(rng, 26)) for i in range(8)] + [(8 + i, pseudo(rng, 9) + f" {rng.randint(100, 999)} " + pseudo(rng, 12)) for i in range(4)]
    items += [(12 + i, f"it was {pseudo(rng, 4)} {pseudo(rng, 1).title()} {pseudo(rng, 20)}") for i in range(4)]
    docs = []
    for k in range(96):
        words = items[k % 16][1].split()
        for at in range(rng.randint(0, 5), len(words), rng.choice([5, 7, 8])):
            if k % 9 == 0 or not words[at][0].isupper():
                words[at] = str(rng.randint(100, 999)) if words[at].isdigit() or k % 9 == 0 else pseudo(rng, 1)
        docs.append((k, " ".join([pseudo(rng, rng.randint(0, 9)), *words, pseudo(rng, rng.randint(0, 9))])))
    bare = lambda t: "".join(filter(str.isalnum, lowered(t)))
    want = {}
    for d, t in docs:
        b = bare(t)
        for i, u in items:
            names = [(bare(u).index(w.lower()), w.lower()) for n, w in enumerate(u.split()) if n and w.istitle()]
            numbers = {w for w in u.split() if w.isdigit()}
            u = bare(u)  # noqa: PLW2901
            if any(b[j : j + 60] in u for j in range(len(b) - 59)):
                continue
            for j in {*range(0, len(b) - 59, L.STRIDE), max(0, len(b) - 60)}:
                p, around = b[j : j + 60], b[max(0, j - L.AROUND) : j + 60 + L.AROUND]
                if L._common_subsequence(p, u) < 48 or not L._same_numbers(around, j - max(0, j - L.AROUND), j - max(0, j - L.AROUND) + 60, numbers):
                    continue
                for o in {*range(0, len(u) - 59, L.STRIDE // 2), max(0, len(u) - 60)}:
                    share = L._common_subsequence(p, u[max(0, o - L.AROUND) : o + 60 + L.AROUND]) / 60
                    if share >= 0.8 and all(w in around for at, w in names if o <= at and at + len(w) <= o + 60):
                        want[d, i] = max(want.get((d, i), 0), round(share, 4))
    d, e = spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")
    got = {(r["doc_id"], r["item_id"]): r["subsequence"] for r in L.paraphrased(d, e).collect()}
    # What is reported is right; brute force asks no cosine.
    assert got.keys() <= want.keys() and all(got[x] <= want[x] for x in got)
    assert len(got) >= 0.9 * len(want) > 20


def test_answers_of_a_passage():
    assert L._same_numbers("pay2015now", 0, 10, frozenset({"2015"})) and not L._same_numbers("pay2015now", 0, 5, frozenset({"20", "5"}))
    assert L._same_numbers("77pay", 2, 5, frozenset()) and L._same_numbers("none", 0, 4, frozenset())
    text = "The clerk met Xavier in Old Town. Then Ann left."
    assert [w for _, w in L._names(text, "".join(filter(str.isalnum, lowered(text))))] == ["xavier", "old", "town", "ann"]
    assert L._names(text.upper(), "") == [] and L._names("", "") == []


def test_blocks_of_items_give_what_one_gives(spark, monkeypatch):
    rng = random.Random(8)
    items = [(i, pseudo(rng, 30)) for i in range(12)]
    docs = [(k, f"{pseudo(rng, 9)} {items[k % 12][1][(k % 5) * 9 :][: 60 + 9 * (k % 6)]} {pseudo(rng, 9)}") for k in range(60)]
    d, e = spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")
    one = {tuple(r) for r in L.leaked(d, e).collect()}
    monkeypatch.setattr(L, "BLOCK_CHARS", 800)
    assert {tuple(r) for r in L.leaked(d, e).collect()} == one and len(one) > 20


def test_runs_at_the_same_place_of_two_stretches(spark):
    rng = random.Random(6)
    item = pseudo(rng, 24).replace(" ", "")
    near = item[:30] + "zz" + item[32:70] + "zz" + item[72:110] + "zz" + item[112:]
    rest = "q" * (L.STRETCH - len(near))
    d = spark.createDataFrame([(1, "q" * 2400 + near + rest + item + "q" * 9000)], "doc_id bigint, text string")
    e = spark.createDataFrame([(7, item)], "item_id bigint, text string")
    assert [tuple(r) for r in L.leaked(d, e).collect()] == [(1, 7)]


def test_winnowed_terms_are_those_of_the_common_run():
    rng = random.Random(2)
    run = np.array([ord(rng.choice("abcdefgh")) for _ in range(80)], np.uint32)
    a = np.concatenate((run, np.full(30, 120, np.uint32)))
    b = np.concatenate((np.arange(200, 240, dtype=np.uint32), run))
    x, y = (set(L.terms(p, np.zeros(len(p), np.int32))[0].tolist()) for p in (a, b))
    assert len(x & y) >= (80 - L.N_GRAM - L.WINNOW) // L.WINNOW
    assert len(L.terms(run[:5], np.zeros(5, np.int32))[0]) == 0


def test_randomised_svd_finds_the_leading_space(spark):
    rng = np.random.default_rng(3)
    left, right = rng.standard_normal((40, 3)), rng.standard_normal((3, 25))
    m = left @ right
    df = spark.createDataFrame([(list(range(25)), row.tolist()) for row in m], "terms array<long>, weights array<double>").repartition(3)
    v = L.randomised_svd(df, 25, rank=3)
    assert np.allclose(m @ v @ v.T, m, atol=1e-6)


def test_common_subsequences_of_many_passages():
    rng = np.random.default_rng(9)
    points = rng.integers(97, 103, 500).astype(np.uint32)
    texts = [rng.integers(97, 104, n).astype(np.uint32) for n in (5, 80, 200)]
    item = np.sort(rng.integers(0, 3, 40))
    starts, lengths = rng.integers(0, 495, 40), rng.integers(1, 61, 40)
    lengths = np.minimum(lengths, 500 - starts)
    got = L._common_subsequences(points, starts, lengths, item, texts)
    want = [L._common_subsequence(L._decode(points[s : s + n]), L._decode(texts[i])) for s, n, i in zip(starts, lengths, item, strict=True)]
    assert got.tolist() == want


def test_common_subsequence_against_dynamic_programming():
    rng = random.Random(4)
    for _ in range(50):
        a, b = ("".join(rng.choice("abc") for _ in range(rng.randint(0, 12))) for _ in "ab")
        t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
        assert L._common_subsequence(a, b) == t[-1][-1]


def test_walk_partitions_every_quota():
    import pandas as pd

    counts, sizes = [10, 0, 25, 3], [7, 7, 6, 6, 6, 6]
    out = _walk(counts, sizes, 1, pd.Series(range(6)))
    assert (out.assign(n=out.hi - out.lo).groupby("shard").n.sum().to_numpy() == sizes).all()
    for k, n in enumerate(counts):
        one = out[out.k == k].sort_values("lo")
        assert one.lo.iloc[0] == 0 and one.hi.iloc[-1] == n and (one.hi.iloc[:-1].to_numpy() == one.lo.iloc[1:].to_numpy()).all()


def test_mixture(spark):
    rng = random.Random(5)
    sizes = {"a": 1500, "b": 600, "c": 40, "none": 50}
    docs = [(i, rng.choice([s, s.upper(), f" {s} "]), rng.randint(1, 40)) for i, s in enumerate(s for s, n in sizes.items() for _ in range(n))]
    docs += [(9000, None, 5), (9001, "a", 0), (9002, "", 5), (9003, "a", None)]
    d = spark.createDataFrame(docs, "doc_id bigint, source string, t bigint").withColumns({c: F.lit("x") for c in ("block", "copy", "shard", "k", "text", "place")})
    t = spark.createDataFrame([("A", 0.5, 1), ("b", 0.3, 2), ("c", 0.15, 3), ("gone", 0.05, 2), (None, 0.1, 1)], "source string, target_share double, max_repeats int")
    uses, report = mixture(d, t, tokens=F.col("t"))
    rows, r = uses.collect(), {x["source"]: x for x in report.collect()}
    assert len({(x["doc_id"], x["copy"]) for x in rows}) == len(rows)
    assert len({(x["shard"], x["position"]) for x in rows}) == len(rows)
    most = Counter(x["doc_id"] for x in rows)
    by = {x["doc_id"]: x["source"] for x in rows}
    assert all(n <= {"a": 1, "b": 2, "c": 3}[by[i]] for i, n in most.items())
    total = sum(x["n_tokens"] for x in rows)
    size = sum(n or 0 for _, s, n in docs if (s or "").strip().lower() in ("a", "b", "c"))
    assert abs(r["a"]["mixed_tokens"] - 0.5 * size) < 0.02 * size and abs(r["b"]["mixed_tokens"] - 0.3 * size) < 0.02 * size
    assert r["a"]["in_reach"] and not r["c"]["in_reach"] and not r["gone"]["in_reach"]
    assert r["c"]["mixed_tokens"] == 3 * r["c"]["n_tokens"]
    assert sum(x["actual_share"] for x in r.values()) == pytest.approx(1) and sum(x["mixed_tokens"] for x in r.values()) == total
    # Among the sources in reach, shares hold to about a document.
    assert all(abs(r[x]["reach_error"]) < 80 / total for x in "ab") and r["c"]["reach_error"] is None
    assert r["a"]["error"] == pytest.approx(r["a"]["actual_share"] - 0.5)
    empty, none = mixture(d.limit(0), t, tokens=F.col("t"))
    assert empty.count() == 0 and none.count() == 4
    assert mixture(d, t.limit(0), tokens=F.col("t"))[0].count() == 0


def test_tokenizer_counts(spark):
    from evidentia.llm.mixing import TOKENIZER, token_count

    try:
        open(TOKENIZER).close()
    except OSError:
        pytest.skip("no tokenizer files here")
    df = spark.createDataFrame([("hello world",), ("",), (None,), ("<|endoftext|> " + "é" * 20_000,)], "text string")
    n = [r["n"] for r in df.select(token_count(spark, "text", TOKENIZER).alias("n")).collect()]
    assert n[0] > 0 and n[1] == 0 and n[2] is None and n[3] > 100
