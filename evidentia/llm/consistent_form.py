"""Texts that look the same, brought to one form.

``consistent(text)`` removes default-ignorable characters, applies compatibility normalisation in composed form, maps
every kind of space to a space, and rewrites look-alike letters of other scripts to the script of their word: letters
that Unicode's confusables give the shape of a Latin one. Letters whose shape differs visibly (a dotless i, a small capital
A) stay, and so does a word wholly in another script. Letter case, accents, punctuation, digits and the number of spaces stay; digits never stand for letters. ``lowered(text)`` is
the same in lower case and ``folded(text)`` in full case folding, for comparisons that ignore case.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterator

import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evidentia.session import cut_lineage

# Unicode's Default_Ignorable_Code_Point.
_IGNORABLE_RANGES = (
    (0xAD, 0xAD), (0x34F, 0x34F), (0x61C, 0x61C), (0x115F, 0x1160), (0x17B4, 0x17B5), (0x180B, 0x180F), (0x200B, 0x200F),
    (0x202A, 0x202E), (0x2060, 0x206F), (0x3164, 0x3164), (0xFE00, 0xFE0F), (0xFEFF, 0xFEFF), (0xFFA0, 0xFFA0),
    (0xFFF0, 0xFFF8), (0x1BCA0, 0x1BCA3), (0x1D173, 0x1D17A), (0xE0000, 0xE0FFF),
)
# Kinds of space but for line breaks, and what breaks lines.
_SPACE_RANGES = ((0x9, 0x9), (0xB, 0xC), (0x1C, 0x1F), (0xA0, 0xA0), (0x1680, 0x1680), (0x2000, 0x200A), (0x202F, 0x202F),
                 (0x205F, 0x205F), (0x3000, 0x3000))
_BREAK_RANGES = ((0xD, 0xD), (0x85, 0x85), (0x2028, 0x2029))
_LATIN_RANGES = ((0x41, 0x5A), (0x61, 0x7A), (0xC0, 0xD6), (0xD8, 0xF6), (0xF8, 0x24F), (0x1E00, 0x1EFF))
_PHONETIC_RANGES = ((0x250, 0x2AF), (0x1D00, 0x1D7F))
_SCRIPT_RANGES = {
    "g": ((0x370, 0x3FF), (0x1F00, 0x1FFF)), "c": ((0x400, 0x52F),), "l": _PHONETIC_RANGES,
    "other": ((0x531, 0x587), (0x13A0, 0x13FD), (0x2C80, 0x2CFF), (0xA4D0, 0xA4F7), (0xAB70, 0xABBF)),
}
_OTHER_RANGES = tuple(r for ranges in _SCRIPT_RANGES.values() for r in ranges)
# Letters that look like a Latin one by the confusables of Unicode Technical Standard 39, restricted to
# letters, by script; the other script first. Where its prototype stands for several letters, the one of the same case.
_CYRILLIC = "АВЕКМНОРСТУХЬагеорсух", "ABEKMHOPCTYXbareopcyx"
_CYRILLIC_RARE = "ЅІЈѕіјһҮүҽӀԁԌԛԜԝѡѴѵ", "SIJsijhYyeIdGqWwwVv"
_CYRILLIC_DRAWN = "ӏԚ", "lQ"  # drawn alike, though not in that list
_GREEK = "ΑΒΕΖΗΙΚΜΝΟΡΤΥΧαγιυσονρ", "ABEZHIKMNOPTYXayiuoovp"
_GREEK_RARE = "ͿϜϳϺ", "JFjM"
_ARMENIAN = "ՍՏՕագզհոռսցքօ", "USOwqqhnnugfo"
_PHONETIC = "ɑɡɣɩɪɯʋʏᴄᴏᴑᴜᴠᴡᴢ", "agyiiwuycoouvwz"
_CHEROKEE = "ᎠᎡᎢᎥᎩᎪᎫᎬᎳᎷᎻᎽᏀᏂᏃᏏᏒᏔᏕᏙᏚᏞᏟᏢᏦᏧᏳᏴꭵꮃꮓꮩꮪꮯ", "DRTiYAJEWMHYGhZbRWSVSLCPKdGBiwzvsc"
_LISU = "ꓐꓑꓒꓓꓔꓖꓗꓙꓚꓜꓝꓟꓠꓡꓢꓣꓦꓧꓪꓫꓬꓮꓰꓲꓳꓴ", "BPdDTGKJCZFMNLSRVHWXYAEIOU"
_COPTIC = "ⲎⲒⲔⲘⲚⲞⲟⲢⲣⲤⲥⲦⲨⲬⳐ", "HIKMNOoPpCcTYXL"


def _class(ranges: tuple[tuple[int, int], ...]) -> str:
    return "".join(f"{re.escape(chr(a))}-{re.escape(chr(b))}" for a, b in ranges)


def _twins(*pairs: tuple[str, str]) -> dict[int, str]:
    return {ord(a): b for x, y in pairs for a, b in zip(x, y, strict=True)}


_TO_LATIN = _twins(_CYRILLIC, _CYRILLIC_RARE, _CYRILLIC_DRAWN, _GREEK, _GREEK_RARE, _ARMENIAN, _PHONETIC, _CHEROKEE, _LISU, _COPTIC)
# The other way the last of several letters counts.
_TO_SCRIPT = {"c": _twins(_CYRILLIC[::-1]), "g": _twins(_GREEK[::-1])}
_LATIN, _OTHER = _class(_LATIN_RANGES), _class(_OTHER_RANGES)
_TWIN_LATIN, _TWIN_OTHER = "".join(sorted(set(_TO_LATIN.values()))), "".join(map(chr, _TO_LATIN))

_IGNORABLE = re.compile(f"[{_class(_IGNORABLE_RANGES)}]+")
_SPACE = re.compile(f"[{_class(_SPACE_RANGES)}]")
_BREAK = re.compile(f"\r\n|[{_class(_BREAK_RANGES)}]")
_ODD_ASCII = re.compile("[\t\x0b\x0c\x1c-\x1f\r]")
_HAS_OTHER, _HAS_LATIN = re.compile(f"[{_OTHER}]"), re.compile(f"[{_LATIN}]")
_WORD = re.compile(f"[{_LATIN}{_OTHER}][{_LATIN}{_OTHER}\u0300-\u036f]*")
_OWN_LATIN = re.compile("[%s]" % "".join(c for a, b in _LATIN_RANGES for c in map(chr, range(a, b + 1)) if c not in "".join((*_CYRILLIC, *_GREEK, *_CYRILLIC_RARE, *_CYRILLIC_DRAWN))))
_ALIEN = re.compile(f"[{_class(_SCRIPT_RANGES['other'])}]")
_OWN_OTHER = re.compile(f"(?![{_TWIN_OTHER}])[{_OTHER}]")
_ONLY = {s: re.compile("[%s\u0300-\u036f]*" % "".join(x + y)) for s, (x, y) in (("c", _CYRILLIC), ("g", _GREEK))}
_STOP = re.compile("[.!?:;\n]")


def _script(word: str) -> str | None:
    """The script a word is meant in: that of its letters without a twin, else Latin, or None if others are possible.

    A word of two or more letters wholly in Armenian, Cherokee, Lisu or Coptic script is meant in that.
    """
    bare = unicodedata.normalize("NFD", word)
    if _OWN_LATIN.search(bare):
        return "l"
    if m := _OWN_OTHER.search(bare):
        o = ord(m.group())
        return next(s for s, ranges in _SCRIPT_RANGES.items() if any(a <= o <= b for a, b in ranges))
    if len(bare) > 1 and not _HAS_LATIN.search(bare) and _ALIEN.search(bare) and any(c not in "Օօ" for c in bare):
        return "other"
    return None if any(p.fullmatch(bare) for p in _ONLY.values()) else "l"


def _rewrite_lookalikes(text: str) -> str:
    words = list(_WORD.finditer(text))
    scripts = [_script(m.group()) for m in words]
    # A word of twins alone takes the script of the word before it in its sentence, else of the next one, else Latin.
    following: list[str | None] = [None] * len(words)
    for i in range(len(words) - 2, -1, -1):
        following[i] = scripts[i + 1] or following[i + 1]
    out, at, known, end = [], 0, None, 0
    for i, m in enumerate(words):
        if not scripts[i] and _STOP.search(text, end, m.start()):
            known = following[i] or known
        known, end = scripts[i] or known or following[i] or "l", m.end()
        word = m.group()
        if known == "l":
            if not _HAS_OTHER.search(word):
                continue
            table = _TO_LATIN
        else:
            if known == "other" or not _HAS_LATIN.search(word):
                continue
            table = _TO_SCRIPT[known]
        out += (text[at : m.start()], unicodedata.normalize("NFC", unicodedata.normalize("NFD", word).translate(table)))
        at = m.end()
    return "".join(out) + text[at:] if out else text


def consistent(text: str) -> str:
    if text.isascii():
        return _BREAK.sub("\n", _SPACE.sub(" ", text)) if _ODD_ASCII.search(text) else text
    text = _IGNORABLE.sub("", text)
    # Line breaks and spaces first, as compatibility forms of some spaces would bring combining marks.
    text = _BREAK.sub("\n", _SPACE.sub(" ", text))
    if not unicodedata.is_normalized("NFKC", text):
        text = _IGNORABLE.sub("", unicodedata.normalize("NFKC", text))
    if _HAS_OTHER.search(text) and (_HAS_LATIN.search(text) or not _OWN_OTHER.search(text)):
        text = _rewrite_lookalikes(text)
    return text


def lowered(text: str) -> str:
    """Consistent form in lower case."""
    return consistent(text).lower()


def folded(text: str) -> str:
    """Consistent form without letter case; composed again, as full folding may leave loose marks."""
    text = consistent(text)
    return text.lower() if text.isascii() else unicodedata.normalize("NFC", text.casefold())


def _vectorised(f: Callable[[str], str]) -> Callable[[Column | str], Column]:
    @F.pandas_udf(T.StringType())
    def apply(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield s.map({v: f(v) for v in s.dropna().unique()}).astype(object).where(s.notna(), None)

    return apply


consistent_form = _vectorised(consistent)
folded_form = _vectorised(folded)


def document_name(name: str) -> str:
    """What is left of a document's name once spelling is ignored: letters and digits, without a file ending."""
    name = re.sub(r"\.(pdf|docx|html)$", "", lowered(name).strip())
    return "".join(filter(str.isalnum, name))


document_key = _vectorised(document_name)


def _digest(text: str) -> bytes:
    return xxhash.xxh3_128_digest(text.encode("utf-8", "surrogatepass"))


@F.pandas_udf(T.StructType([T.StructField("form", T.BinaryType()), T.StructField("raw", T.BinaryType())]))
def form_digests(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    """128-bit digests of the consistent form and of the text as it stands; each distinct text of a batch once."""
    for s in batches:
        known = {v: (_digest(consistent(v)), _digest(v)) for v in s.dropna().unique()}
        pairs = [known.get(v, (None, None)) for v in s]
        yield pd.DataFrame({"form": [p[0] for p in pairs], "raw": [p[1] for p in pairs]}, dtype=object)


@F.pandas_udf(T.StructType([T.StructField(n, T.StringType()) for n in ("form", "folded", "form_id")]))
def _forms(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for s in batches:
        known = {v: (consistent(v), folded(v), _digest(consistent(v)).hex()) for v in s.dropna().unique()}
        rows = [known.get(v, (None, None, None)) for v in s]
        yield pd.DataFrame(rows, columns=["form", "folded", "form_id"], dtype=object)


def consistent_texts(df: DataFrame, key: str, text: str) -> DataFrame:
    """One row per row of ``df``: its key, its text in consistent form, that form without letter case (full folding) and, as
    ``form_id``, the form's 128-bit digest in hex, which is the class of texts that look the same.

    Null texts have null forms and form_id; empty texts empty forms. Extra columns are left out.
    """
    return df.select(F.col(key).alias("key"), _forms(F.col(text)).alias("f")).select("key", "f.*")


def equal_looking_pairs(df: DataFrame, key: str, text: str) -> DataFrame:
    """Pairs (key_a < key_b) of rows whose texts are different strings with the same consistent form.

    Texts are compared by two 128-bit digests, so none is shuffled: rows meet by the form's digest, and only forms that
    stand in two or more different strings are joined. Null and empty texts match nothing; rows that repeat a text are
    rows of their own; null keys are left out. A table without rows gives no rows.
    """
    d = cut_lineage(
        df.select(F.col(key).alias("key"), F.col(text).alias("text"))
        .where("text is not null and text <> '' and key is not null")
        .select("key", form_digests("text").alias("d"))
        .select("key", "d.form", "d.raw")
    )
    # One row per different string of a form, pre-aggregated before the shuffle.
    strings = d.groupBy("form", "raw").agg(F.count("*").alias("n_rows"))
    several = strings.groupBy("form").agg(F.count("*").alias("n")).where("n > 1").select("form")
    rows = d.join(several, "form", "left_semi")
    a = rows.select("form", F.col("key").alias("key_a"), F.col("raw").alias("raw_a"))
    b = rows.select("form", F.col("key").alias("key_b"), F.col("raw").alias("raw_b"))
    return a.join(b, "form").where("raw_a <> raw_b and key_a < key_b").select("key_a", "key_b")
