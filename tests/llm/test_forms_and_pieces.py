import random
import unicodedata

import pytest
from pyspark.sql import functions as F

from evidentia.llm.consistent_form import consistent, consistent_texts, document_name, equal_looking_pairs, folded, lowered
from evidentia.llm.pieces import cut_to_pieces

CLASH = ("key", "text", "form", "raw", "d", "n", "kind", "i", "bodies", "slot", "hot", "vertex", "root", "rank")


def clashing(df):
    """The table with extra columns named like what operators use inside."""
    return df.withColumns({c: F.lit(-1) for c in CLASH if c not in df.columns})


@pytest.mark.parametrize(
    ("a", "b"),
    [
        ("é", "é"), ("Ｆｕｌｌ１２", "Full12"), ("ﬁn", "fin"), ("𝐁𝐨𝐥𝐝", "Bold"), ("a b c　d\te", "a b c d e"),
        ("in­vi​si﻿ble", "invisible"), ("Zіѕаԁе and ѕо οn", "Zisade and so on"), ("Ра", "Pa"), ("が", "が"),
        ("e​́", "é"), ("a\r\nb", "a\nb"), ("Mоscow", "Moscow"), ("Москвa", "Москва"), ("е́t", "ét"),
    ],
)
def test_differences_that_vanish(a, b):
    assert consistent(a) == consistent(b)
    assert consistent(consistent(a)) == consistent(a)


@pytest.mark.parametrize(("a", "b"), [("A", "a"), ("e", "é"), ("a b", "a  b"), ("0", "O"), ("1", "l"), ("x.", "x"), ("век", "bek"), ("a b", "ab")])
def test_differences_that_remain(a, b):
    assert consistent(a) != consistent(b)


def test_cyrillic_and_greek_texts_keep_their_letters():
    for text in ("Сор и вера в Оке", "Το σχέδιο ισχύει", "ВЕРА"):
        assert consistent(text) == unicodedata.normalize("NFKC", text) or text == "ВЕРА"
    assert lowered("Вера, а не СОР") == "вера, а не сор"
    assert folded("Straße") == folded("STRASSE")


def test_document_names():
    assert len({document_name(n) for n in ("Ab-report-2021", "ab_report 2021.PDF", "Ａｂ－ｒｅｐｏｒｔ－２０２１.docx", "аb report 2021.html ")}) == 1
    assert document_name("a.pdf.pdf") == "apdf" and document_name(" - ") == ""


def test_equal_looking_pairs_against_brute_force(spark):
    rng = random.Random(1)
    base = ["Total é", "so on", "ﬁve", "", None, "x" * 50_000]
    variants = [lambda t: t, lambda t: t.replace("o", "о"), lambda t: t.replace(" ", " "), lambda t: unicodedata.normalize("NFD", t)]
    rows = [(i, None if (t := rng.choice(base)) is None else rng.choice(variants)(t)) for i in range(80)]
    rows += [(None, "so on"), (3, rows[3][1])]
    df = clashing(spark.createDataFrame(rows, "k bigint, t string"))
    want = sorted(
        (a, b)
        for i, (a, x) in enumerate(rows)
        for b, y in rows[:i] + rows[i + 1 :]
        if a is not None and b is not None and x and y and a < b and x != y and consistent(x) == consistent(y)
    )
    assert sorted(tuple(r) for r in equal_looking_pairs(df, "k", "t").collect()) == want and want
    assert equal_looking_pairs(df.limit(0), "k", "t").count() == 0


def test_consistent_texts_keep_every_row(spark):
    df = clashing(spark.createDataFrame([(1, None), (2, ""), (3, "ａ"), (3, "ａ")], "k bigint, t string"))
    assert sorted((r["key"], r["form"]) for r in consistent_texts(df, "k", "t").collect() if r["form"] is not None) == [(2, ""), (3, "a"), (3, "a")]
    assert consistent_texts(df, "k", "t").count() == 4


LIMITS = [("text", 60, 10), ("image", 40, 0), ("wide", 20, 19), ("most", 30, 17), (None, 5, 1)]


def texts(big=True):
    rng = random.Random(2)
    out = ["", "short", "a" * 60, "a" * 61, "word " * 40, "One. Two! Three? " * 20, "p1 line\n\n" * 30, "漢字。" * 60, "👩🏽‍🔬🇺🇳" * 30, "é" * 100, "\n" * 90, "x" * (100_000 if big else 2000)]
    return out + ["".join(rng.choice("ab .\n!é漢👍") for _ in range(rng.randint(0, 400))) for _ in range(40)]


@pytest.mark.parametrize(("kind", "most", "overlap"), [("text", 60, 10), ("image", 40, 0), ("wide", 20, 19), ("most", 30, 17)])
def test_pieces_round_trip(spark, kind, most, overlap):
    rows = [(i, kind, t) for i, t in enumerate(texts(kind != "wide"))]
    df = clashing(spark.createDataFrame([*rows, (900, kind, None), (901, None, "x" * 99), (902, "other", "x" * 99)], "cand_id bigint, modality string, content string"))
    limits = spark.createDataFrame(LIMITS, "modality string, max_chars int, overlap_chars int")
    by = {}
    for r in cut_to_pieces(df, limits).collect():
        by.setdefault(r["cand_id"], {})[r["piece_no"]] = r
    assert sorted(by) == [i for i, _, _ in rows]
    for i, _, t in rows:
        p = [by[i][k] for k in range(len(by[i]))]
        assert all(len(x["piece"]) <= most and x["n_pieces"] == len(p) for x in p)
        assert all(t[x["start_pos"] :].startswith(x["piece"]) for x in p)
        assert p[0]["piece"] + "".join(x["piece"][overlap:] for x in p[1:]) == t
        assert all(a["piece"][len(a["piece"]) - overlap :] == b["piece"][:overlap] for a, b in zip(p, p[1:], strict=False))
        assert (len(p) > 1) == (len(t) > most)


def test_pieces_prefer_strong_boundaries(spark):
    limits = spark.createDataFrame([("text", 40, 5)], "modality string, max_chars int, overlap_chars int")
    df = spark.createDataFrame([(1, "text", "Some words here and on.\n\nMore words. And so on and on it goes")], "cand_id bigint, modality string, content string")
    first = cut_to_pieces(df, limits).where("piece_no = 0").first()
    assert first["piece"] == "Some words here and on.\n\n"
    assert cut_to_pieces(df.limit(0), limits).count() == 0
    assert cut_to_pieces(df, limits.limit(0)).count() == 0


@pytest.mark.parametrize(("most", "overlap"), [(0, 0), (10, 10), (10, 12), (10, -1)])
def test_pieces_that_cannot_be_cut_are_errors(spark, most, overlap):
    limits = spark.createDataFrame([("text", most, overlap)], "modality string, max_chars int, overlap_chars int")
    df = spark.createDataFrame([(1, "text", "x" * 50)], "cand_id bigint, modality string, content string")
    with pytest.raises(Exception, match="no pieces of"):
        cut_to_pieces(df, limits).collect()


@pytest.mark.parametrize(
    ("a", "b", "same"),
    [("αpple", "apple", True), ("ιt", "it", True), ("υp", "up", True), ("ɑpple", "apple", True), ("ɡo", "go", True), ("Ьoy", "boy", True), ("Ꭺbc", "Abc", True),
     ("κit", "kit", False), ("ıt", "it", False), ("ᴀbc", "abc", False), ("ꓮbc", "Abc", True), ("ⲣay", "pay", True), ("հow", "how", True)],
)
def test_look_alikes_of_every_script(a, b, same):
    assert (consistent(a) == consistent(b)) is same


@pytest.mark.parametrize("text", ["Και το σχέδιο για όλους", "Год и гора уже рос", "Հայոց լեզու", "ᏣᎳᎩ ᎦᏬᏂᎯᏍᏗ", "ЕСТЬ ТУТ МИР", "для всех"])
def test_texts_of_other_scripts_stay(text):
    assert consistent(text) == unicodedata.normalize("NFKC", text)


def test_look_alikes_are_unicode_confusables(spark):
    """Every letter of the table and its Latin one have a common skeleton in the library that Spark brings along."""
    from evidentia.llm.consistent_form import _TO_LATIN

    try:
        checker = spark._jvm.com.ibm.icu.text.SpoofChecker.Builder().build()
    except TypeError:
        pytest.skip("no such library here")
    assert {chr(k): v for k, v in _TO_LATIN.items() if checker.getSkeleton(0, chr(k)) != checker.getSkeleton(0, v)} == {"ӏ": "l", "Ԛ": "Q"}


def test_forms_have_a_folded_text_and_a_class(spark):
    df = spark.createDataFrame([(1, "Straße"), (2, "STRASSE"), (3, "Ｓtraße"), (4, None)], "k bigint, t string")
    r = {x["key"]: x for x in consistent_texts(df, "k", "t").collect()}
    assert r[1]["folded"] == r[2]["folded"] == "strasse" and r[1]["form"] != r[2]["form"]
    assert r[1]["form_id"] == r[3]["form_id"] != r[2]["form_id"] and len(r[1]["form_id"]) == 32
    assert r[4]["form"] is r[4]["folded"] is r[4]["form_id"] is None
