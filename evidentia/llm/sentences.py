"""Sentences of texts in any of eleven languages, with their places.

Every text is a lattice: its nodes are the gaps where a sentence may end (terminators, closing quotation marks and
brackets, spaces of Thai, blank lines), and each gap is either an end or passed, at a cost. The cheapest way through
the lattice gives the sentences. Costs of spaced scripts come from the terminator, the word before and the opening after
it, and from what the sentence so far would be; those of scripts without spaces from a lattice of dictionary words over
the whole clauses on both sides, of which the last and the first word count: final particles, words that can't end a
clause, words that carry it on and words that open one.

What isn't fixed is learned from all documents by Spark (``learned``): abbreviations, as words whose dot is mostly
followed by small letters or numbers; what follows abbreviations that may end a sentence; and the words that open and end
clauses in scripts without spaces.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from evidentia.llm.consistent_form import lowered
from evidentia.session import cut_lineage

# Fixed values. Abbreviations, in lower case and without their last dot, that stand before a name or word.
_BEFORE_WORD = frozenset(
    "dr prof mr mrs ms st mt sr sra srta dra m mm mme mlle me hr fr frau messrs rev gen col capt lt sgt hon gov sen rep pres "
    "supt cmdr adm maj univ abg gral dña dn lic ing dipl mag mons vve pfr "
    "cf vs approx env d'env ca bzw vgl sog ggf evtl ej e.g i.e z.b d.h aprox resp incl excl esp viz см ср т.е т.к напр им ул проф акад "
    "π.χ κ δρ καθ βλ δηλ ดร नं डॉ श्री د أ".split()
)
# ... that are titles only with a capital.
_TITLE = frozenset("min dir insp sec präs".split())
# ... that stand before a number; before a capital they end a sentence like other words.
_BEFORE_NUMBER = frozenset(
    "no nos fig figs tab sec eq ch vol pp p art arts par nr abb abs kap bd s núm pág págs cap rue jan feb mar apr jun jul aug sep "
    "sept oct nov dec рис табл стр гл п ст № σελ εικ αρ".split()
)
# ... that may also be the last word of a sentence; it ends before a capital letter.
_MAY_END = frozenset(
    "inc ltd co corp llc plc etc al p.m a.m jr bros dept est usw u.a o.ä г гг руб тыс млн κ.λπ κ.ά".split()
)
# ... that may also stand before a name: they end a sentence before a word that opens one.
_BEFORE_NAME = frozenset("u.s u.k u.n e.u d.c u.s.a".split())
# Of those, the ones that end a sentence in a passage of one case too, unless a word follows that goes on.
_MAY_END_ANY_CASE = frozenset("inc ltd co corp llc plc p.m a.m".split())
# Prepositions and conjunctions, which carry on what stands before them, and words that open a sentence.
_CARRY_ON = frozenset("on in to at of and or by with from for as than".split())
_OPENERS = frozenset(
    "the a an it he she they we i you this that these those there here his her their our its in on at by for from with as if "
    "when while although after before since but and so yet however then what who why how no not one some many most all".split()
)
# Months, after which a German day's dot is no end; and words before an ordinal.
_MONTHS = frozenset("januar jänner februar märz april mai juni juli august september oktober november dezember".split())
_ORDINAL_BEFORE = frozenset("am im vom zum der die das dem den des bis ab".split())
# The closed classes of scripts without spaces. Words that carry on the clause before a pause or quotation,
# words that open a sentence, particles that end one, and words that can't end one.
_GOES_ON = frozenset(
    "と って という との とは とか なんて など が は を に で も の 而 但 却 便 即 随即 随后 然后 就 也 才 并 并且 还 的 地 得 和 与"
    " ๆ ฯลฯ".split()
)
_OPENS = frozenset(
    "はじめ はい とても ところ もう もし また まず なぜ しかし そして その この これ 昨年 今年 第 确认 为什么 但是 不过 因此 所以"
    " 这 那 我们 他们 在 上个 去年 按照 版本 如果 虽然".split()
)
_FINAL = frozenset("吗 呢 吧 了 啊 嘛 た だ か です ます ない る う よ ね ครับ ค่ะ คะ แล้ว".split())
_CANT_END = frozenset("และ หรือ เพราะ คือ เช่น ได้แก่ เพื่อ โดย ซึ่ง ระหว่าง".split())
# Other words the lattice must know whole.
_WHOLE = frozenset(
    "ของ ที่ ใน กับ ว่า จาก แผนที่ คงที่ หน้าที่ พื้นที่ เจ้าหน้าที่ สถานที่ ทันที ทั้งที่ กว่า มากกว่า ทว่า ภายใน ขึ้นใน อยู่ใน 目的 有的 的确 已经 经济 增长 速度 公司 时间 今天 明天"
    " もの こと ところで とにかく はず".split()
)
_CLOSED = {w: 1.0 + 0.5 * (w in _FINAL) for w in _GOES_ON | _OPENS | _FINAL | _CANT_END | _WHOLE}
_LONGEST = 8
_OPEN = {"(": ")", "[": "]", "{": "}", "「": "」", "『": "』", "【": "】", "《": "》", "〈": "〉", "«": "»", "“": "”", "„": "“"}
_CLOSE = frozenset("".join(_OPEN.values()) + "’")
_BRACKETS = frozenset(_OPEN) | _CLOSE - {"’"} | {'"'}
_KNOWN = _BEFORE_WORD | _BEFORE_NUMBER | _MAY_END | _BEFORE_NAME
_MARKS = ".!?…。！？｡।॥؟;\u037e"
_PLAIN_EVENT = re.compile(rf"[{_MARKS}()\[\]{{}}「」『』【】《》〈〉«»“”„\"\r\n]")
_THAI_GAP = r"(?<=[\u0e01-\u0e4e])[^\S\r\n]+(?=[\u0e01-\u0e4e])"
_THAI_EVENT = re.compile(rf"{_PLAIN_EVENT.pattern}|{_THAI_GAP}")
_THAI = re.compile("[\u0e01-\u0e4e]")
_BLANK = re.compile(r"(?:\r\n|\n|\r(?!\n))[^\S\r\n]*(?:\r\n|\n|\r(?!\n))\s*")
_RUN = re.compile(rf"(?:[{_MARKS}]|(?<=\.) (?=\.(?: \.|\s|$)))+")
# Full-width forms of ASCII as ASCII, other kinds of space as a space, letter for letter.
_FLAT = {0xFF01 + i: 0x21 + i for i in range(94)} | dict.fromkeys([0xA0, *range(0x2000, 0x200B), 0x202F, 0x205F, 0x3000, 0x9], 0x20)
_UNFLAT = re.compile("[%s]" % "".join(map(chr, _FLAT)))
_INVISIBLE = re.compile("[\xad​-‏⁠﻿]")
_SKIP = re.compile(r"[\s\xad​-‏⁠﻿]*")
_GAP = re.compile(r"\s*")
_NUMBER_ONLY = re.compile(r"[\s\xad​-‏⁠﻿(\[]*\d{1,3}\Z")
_LIST_NUMBER = re.compile(r"\d{1,3}[.)]\s+\S")
_GREEK = re.compile(r"[Ͱ-Ͽἀ-῿]")

_WORD = re.compile(r"\w*")
_TWO_WORDS = re.compile(r"(\w+)\s*(.?)", re.DOTALL)
_CLAUSE = re.compile("[\u3040-\u30ff\u3400-\u9fff\uf900-\ufaff々ー]+|[\u0e01-\u0e4e]+")
# A word, its dot, the next word and the first character of the one after, in text of both cases; and what opens a clause
# without spaces.
_DOT_GAP = r"(?U)(?<![\p{L}\p{N}.])(\p{L}[\p{L}.]{0,7})\.\s+(?<=\p{Lu}[^!?\n]{1,60})(?=\p{L}|\p{N})(\w+)\s*(\S?)"
_OPENING = r"(?:[。！？]|(?<=[\u0e01-\u0e4e]) )([\u3040-\u30ff\u3400-\u9fff\u0e01-\u0e4e]{2,8})"

def _spaceless(c: str) -> bool:
    return "぀" <= c <= "ヿ" or "㐀" <= c <= "鿿" or "豈" <= c <= "﫿" or c in "々ー"


def _opens_upper(text: str, at: int) -> bool:
    """Whether what follows begins like a sentence: a capital, also behind one small letter, or a quotation or bracket."""
    c = text[at : at + 1]
    if c.isupper() or c in "«“„\"'¿¡「『(":
        return True
    return (c.islower() and text[at + 1 : at + 2].isupper()) or bool(_LIST_NUMBER.match(text, at))


def _cased(text: str, start: int, end: int) -> bool:
    """Whether the stretch has both capital and small letters, as sentences in cased scripts do."""
    part = text[start:end]
    return part.lower() != part and part.upper() != part


class Model(NamedTuple):
    """What the costs rest on besides fixed values: dictionary words of scripts without spaces with their costs,
    abbreviations, and the share of abbreviations that go on, by abbreviation, next word and kind of the word after it."""

    words: dict[str, float] = _CLOSED
    abbreviations: frozenset[str] = frozenset()
    goes_on: dict[tuple[str, str, str], float] = {}


FIXED = Model()


def words_of_clause(clause: str, words: dict[str, float]) -> list[str]:
    """The words of a clause without spaces: the cheapest path through the lattice of all dictionary words that occur in it.
    A character outside words costs more than a word; neighbouring ones are one unknown word."""
    cost, back = [0.0], [0]
    for end in range(1, len(clause) + 1):
        best, at = cost[end - 1] + 2.0, ~(end - 1)
        for i in range(max(0, end - _LONGEST), end):
            w = words.get(clause[i:end])
            if w is not None and cost[i] + w < best:
                best, at = cost[i] + w, i
        cost.append(best)
        back.append(at)
    out: list[str] = []
    end, unknown = len(clause), False
    while end:
        at = back[end]
        piece = clause[at if at >= 0 else ~at : end]
        if at < 0 and unknown:
            out[-1] = piece + out[-1]
        else:
            out.append(piece)
        unknown, end = at < 0, at if at >= 0 else ~at
    return out[::-1]


class _Clauses:
    """The clauses without spaces of a text, each segmented once, when one of its ends is asked for."""

    def __init__(self, text: str, words: dict[str, float]) -> None:
        self.text, self.words = text, words
        self.known: dict[str, tuple[str, str]] = {}
        self.spans: tuple[dict[int, int], dict[int, int]] | None = None

    def _ends(self, clause: str) -> tuple[str, str]:
        if clause not in self.known:
            w = words_of_clause(clause, self.words)
            self.known[clause] = w[0], w[-1]
        return self.known[clause]

    def _find(self) -> tuple[dict[int, int], dict[int, int]]:
        if self.spans is None:
            found = [m.span() for m in _CLAUSE.finditer(self.text)]
            self.spans = dict(found), {b: a for a, b in found}
        return self.spans

    def first(self, at: int) -> str:
        end = self._find()[0].get(at)
        return self._ends(self.text[at:end])[0] if end else ""

    def last(self, end: int) -> str:
        start = self._find()[1].get(end)
        return self._ends(self.text[start:end])[1] if start is not None else ""

    def evidence(self, gap: int, at: int, quoted: bool = False) -> float:
        """For an end at ``gap`` with the next word at ``at``: how much the words on both sides speak for it. What a
        quotation ends with says nothing about the sentence around it."""
        after = self.first(at)
        before = "" if quoted else self.last(gap)
        return (before in _FINAL) * 3.0 - (after in _GOES_ON) * 3.0 - (before in _CANT_END) * 4.0 + (after in self.words and after not in _GOES_ON) * 0.5


def _dot_score(text: str, start: int, at: int, end: int, model: Model) -> float:
    """How much speaks for an end at the single dot at ``at``, below 0 against it, in the sentence that begins at ``start``."""
    if end >= len(text):
        return 9.0
    nxt = text[end]
    near = text[max(start, at - 40) : at]
    before = near[max(near.rfind(" "), near.rfind("\n")) + 1 :].lstrip("([{«“„\"「『…¿¡'’")
    bare = before if before.isascii() else _INVISIBLE.sub("", before)
    if at - start < 24 and _NUMBER_ONLY.match(text, start, at):
        return -6.0  # a list number belongs to the sentence it opens
    spaced = nxt.isspace() or nxt in _CLOSE or nxt == '"'
    last = bare[-1:]
    if not spaced:
        # Directly before a letter only a capital (or a script without case) may begin a sentence.
        if nxt.isdigit() or nxt in ".,;:-/" or not last or (last.isupper() and len(bare) == 1):
            return -6.0
        if nxt.islower() and not text[end + 1 : end + 2].isupper():
            return -6.0
        if "." in bare and not last.isdigit() and len(bare.rpartition(".")[2]) == 1:
            return -6.0
    follow = _SKIP.match(text, end).end()
    word = bare.lower().lstrip("-–")
    if last.isdigit():
        number = re.search(r"\d[\d.,]*\Z", bare).group()
        if spaced and number.isdigit() and len(number) <= 2 and nxt.isspace():
            after = re.match(r"\w*", text[follow : follow + 12]).group().lower()
            previous = text[max(start, at - len(before) - 8) : at - len(before)].split()
            if after in _MONTHS or (previous and previous[-1].lower() in _ORDINAL_BEFORE):
                return -4.0
        return 3.0
    if not word:
        return 3.0
    joined = word
    if len(word) == 1 or word.rpartition(".")[2:] == (word,) and len(word) <= 2:
        # "u. a", "z. B": the abbreviation's letters may be spaced.
        back = text[max(start, at - len(before) - 4) : at - len(before)]
        if m := re.search(r"(\w)\.\s*\Z", back):
            joined = f"{m.group(1).lower()}.{word}"
    if not word.isascii():
        form = lowered(bare).lstrip("-–")
        word = form if form in _KNOWN else word
    if follow >= len(text):
        return -3.0 if joined in _BEFORE_WORD or word in _BEFORE_WORD else 9.0
    opens = 3.0 if _opens_upper(text, follow) else -3.0
    for w in (joined, word):
        if w in _BEFORE_WORD or (w in _TITLE and bare[:1].isupper() and opens > 0):
            return -4.0
        if w in _BEFORE_NAME:
            return opens if _WORD.match(text, follow).group().lower() in _OPENERS else -3.0
        if w in _MAY_END:
            return opens if _cased(text, start, at) else _one_case_score(text, w, follow, model)
    if word in _BEFORE_NUMBER:
        return -3.0 if text[follow].isdigit() else opens
    if len(word) == 1 and not _spaceless(word):
        return -4.0  # an initial
    if "." in word and all(len(x) == 1 for x in word.split(".")):
        return opens
    if word in model.abbreviations and (opens < 0 or text[follow].isdigit()):
        return -2.0
    return 3.0


def _one_case_score(text: str, word: str, follow: int, model: Model) -> float:
    """As for a dot, where the case of letters tells nothing: by what follows the abbreviation elsewhere, where it does;
    else a preposition or conjunction carries on."""
    if word not in _MAY_END_ANY_CASE:
        return -3.0
    m = _TWO_WORDS.match(text, follow)
    if m:
        share = model.goes_on.get((word, m[1].lower(), _kind(m[2])))
        if share is not None:
            return 2.0 - 4.0 * share
    return -1.0 if _WORD.match(text, follow).group().lower() in _CARRY_ON else 1.0


def _kind(c: str) -> str:
    return "number" if c.isdigit() else "word" if c.isalpha() else "other"


def _mark_score(text: str, start: int, at: int, marks: str, end: int, model: Model, clauses: _Clauses) -> float:
    """How much speaks for an end at a run of terminators outside quotations and brackets."""
    bare = marks.replace(" ", "")
    follow = _SKIP.match(text, end).end()
    rest = text[follow : follow + 1]
    if bare == ".":
        return _dot_score(text, start, at, end, model)
    if set(bare) <= {";", "\u037e"}:
        return 4.0 if "\u037e" in bare or _GREEK.search(text, max(start, at - 3), at) else -6.0
    if not rest:
        return 9.0
    if set(bare) <= {".", "…"}:
        if _spaceless(text[at - 1 : at]) or _spaceless(rest):
            return 1.0 + clauses.evidence(at, follow)
        return 3.0 if _opens_upper(text, follow) else -3.0
    if _spaceless(text[at - 1 : at]):
        return 6.0 + clauses.evidence(at, follow)
    ends = not rest.islower() or text[follow + 1 : follow + 2].isupper() or not _cased(text, start, at)
    return 4.0 if ends else -3.0


def _quote_score(text: str, start: int, opened: int, end: int, clauses: _Clauses) -> float:
    """How much speaks for an end behind the closing mark of a quotation that terminators stand before."""
    inside = bool(text[start:opened].strip())
    follow = _SKIP.match(text, end).end()
    rest = text[follow : follow + 1]
    if not rest:
        return 9.0
    if rest in ",;:.!?、，；：。！？،؛।":
        return -6.0
    if _spaceless(rest) or not (rest.isupper() or rest.islower()):
        if _opens_upper(text, follow):
            return 3.0
        return (1.0 if inside else -3.5) + clauses.evidence(end, follow, quoted=True)
    if not inside and rest.isupper() and text[start:end].upper() == text[start:end]:
        return -3.0  # all in capitals: who speaks follows
    return 3.0 if _opens_upper(text, follow) else -3.0


class _Path(NamedTuple):
    """A way through the lattice up to a gap: its cost, where its open sentence begins, and its sentences before."""

    cost: float
    start: int
    before: tuple | None


#: Ways this much dearer than the cheapest are given up.
_MARGIN = 2.5


def sentence_starts(text: str, model: Model = FIXED) -> list[int]:
    """Places of the first characters of the text's sentences, in code points."""
    flat = _UNFLAT.sub(lambda m: chr(_FLAT[ord(m.group())]), text) if _UNFLAT.search(text) else text
    n = len(flat)
    first = _GAP.match(flat, 0).end()
    if first >= n:
        return []
    clauses = _Clauses(flat, model.words)
    paths = [_Path(0.0, first, None)]
    open_marks: list[tuple[str, int]] = []
    mark_end = -1
    pending = first

    def meet(gap: int, scores: list[float]) -> None:
        """Each way ends its sentence at the gap or passes it; the cheapest that ends and those that pass go on."""
        nonlocal paths, pending
        if len(paths) == 1 and abs(scores[0]) >= _MARGIN:  # the other way would be given up at once
            if scores[0] > 0:
                pending = _GAP.match(flat, gap).end()
                p = paths[0]
                paths = [_Path(p.cost, pending, (p.start, p.before))]
            return
        nxt = _GAP.match(flat, gap).end()
        passed = [p._replace(cost=p.cost + max(0.0, s)) for p, s in zip(paths, scores, strict=True)]
        p, s = min(zip(paths, scores, strict=True), key=lambda x: x[0].cost - x[1] * (x[1] < 0))
        ended = _Path(p.cost + max(0.0, -s), nxt, (p.start, p.before))
        least = min(ended.cost, *(x.cost for x in passed)) + _MARGIN
        paths = [x for x in (ended, *passed) if x.cost < least]
        if len(paths) == 1 and paths[0] is ended:
            pending = nxt

    for event in (_THAI_EVENT if _THAI.search(flat) else _PLAIN_EVENT).finditer(flat, first):
        a, b = event.span()
        if a < pending:
            continue
        c = flat[a]
        if c in "\r\n":
            if not (m := _BLANK.match(flat, a)):
                continue
            open_marks.clear()
            p = min(paths, key=lambda x: x.cost)  # a blank line always ends a sentence
            pending = _GAP.match(flat, m.end()).end()
            paths = [_Path(0.0, pending, (p.start, p.before) if flat[p.start : a].strip() else p.before)]
            mark_end = -1
        elif c.isspace():
            if not open_marks:
                meet(b, [2.0 + clauses.evidence(a, b) if flat[p.start : a].strip() else -9.0 for p in paths])
        elif c in _BRACKETS:
            closing = open_marks and (c == open_marks[-1][0] or (c == "”" and open_marks[-1][0] == "“") or (c == '"' and open_marks[-1][0] == '"'))
            if closing:
                _, opened = open_marks.pop()
                if not open_marks and mark_end >= 0 and not flat[mark_end:a].strip(" "):
                    if c in ")]}】":
                        meet(b, [-6.0 if flat[p.start : opened].strip() else 6.0 for p in paths])
                    else:
                        meet(b, [_quote_score(flat, p.start, opened, b, clauses) for p in paths])
            elif c in _OPEN or c == '"':
                open_marks.append((_OPEN.get(c, '"'), a))
        else:
            m = _RUN.match(flat, a)
            b = pending = mark_end = m.end()
            if not open_marks:
                gap = b
                while gap < n and flat[gap] in ")]}»”’」』】":
                    gap += 1
                meet(gap, [_mark_score(flat, p.start, a, m.group(), b, model, clauses) for p in paths])
    p = min(paths, key=lambda x: x.cost)
    node = (p.start, p.before) if p.start < n and flat[p.start :].strip() else p.before
    starts = []
    while node:
        starts.append(node[0])
        node = node[1]
    return starts[::-1]


#: An abbreviation or word is learned if it holds at least this share of what is counted, and occurs so often: no more
#: than 1 / LEAST_SHARE of them can be learned from any number of documents.
LEAST_SHARE, LEAST_COUNT = 1e-4, 5


def learned(df: DataFrame, text: str = "text") -> Model:
    """The model of all documents' texts, from counts made by Spark.

    Abbreviations are words of at most eight letters whose dot is followed by a small letter or number more often than
    not. For abbreviations that may end a sentence, what follows them in text of both cases tells by its case whether they
    ended one. The first characters of clauses without spaces, behind sure ends, give the words that open clauses: the
    prefixes that are frequent and branch. Each table has at most 1 / LEAST_SHARE rows a length by its threshold. Null and
    empty texts count nothing; without texts the model is the fixed one.
    """
    rows = df.select(F.col(text).alias("text")).where("text is not null and text <> ''")
    dots = rows.select(F.explode(F.regexp_extract_all("text", F.lit(_DOT_GAP), F.lit(0))).alias("m"))
    part = lambda i: F.regexp_extract("m", _DOT_GAP, i)
    dots = dots.select(F.lower(part(1)).alias("word"), part(2).alias("next"), part(3).alias("then"))
    listed = F.col("word").isin(*_MAY_END_ANY_CASE)
    kind = F.when(F.col("then").rlike(r"(?U)^\d"), "number").when(F.col("then").rlike(r"^\p{L}"), "word").otherwise("other")
    dots = cut_lineage(dots.groupBy("word", F.when(listed, F.lower("next")).alias("next"), F.when(listed, kind).alias("kind")).agg(
        F.count("*").alias("n"), F.count_if(F.col("next").rlike(r"(?U)^[\p{Ll}\d]")).alias("on")
    ))
    share = F.sum("n").over(Window.partitionBy())
    words = dots.groupBy("word").agg(F.sum("n").alias("n"), F.sum("on").alias("on")).withColumn("of", share)
    frequent = (F.col("n") >= LEAST_COUNT) & (F.col("n") >= F.col("of") * LEAST_SHARE)
    abbreviations = words.where(frequent & (F.col("on") * 2 > F.col("n"))).select("word").collect()
    follows = dots.where("next is not null").withColumn("of", share).where(frequent).collect()
    opening = rows.select(F.explode(F.regexp_extract_all("text", F.lit(_OPENING), F.lit(1))).alias("m"))
    prefix = F.explode(F.expr("transform(sequence(2, length(m)), i -> left(m, i))")).alias("w")
    opening = opening.where("length(m) >= 2").select(prefix).groupBy("w").agg(F.count("*").alias("n"))
    opening = opening.withColumn("of", F.sum("n").over(Window.partitionBy())).where(frequent).collect()
    counts = {r["w"]: r["n"] for r in opening}
    longer: dict[str, int] = {}
    for w, k in counts.items():
        longer[w[:-1]] = max(longer.get(w[:-1], 0), k)
    # A prefix branches if no single character mostly follows it.
    words_ = {w: 1.25 for w, k in counts.items() if longer.get(w, 0) * 2 <= k}
    return Model(
        {**words_, **_CLOSED}, frozenset(r["word"] for r in abbreviations),
        {(r["word"], r["next"], r["kind"]): r["on"] / r["n"] for r in follows},
    )


def _starts(df: DataFrame, model: Model) -> Column:
    known = df.sparkSession.sparkContext.broadcast(tuple(model))

    @F.pandas_udf(T.ArrayType(T.LongType()))
    def starts(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = Model(*known.value)
        for s in batches:
            places = {v: sentence_starts(v, model) for v in s.dropna().unique()}
            yield pd.Series([places.get(v) for v in s], dtype=object)

    return starts("text")


def sentences(df: DataFrame, key: str = "doc_id", text: str = "text", model: Model = FIXED) -> DataFrame:
    """One row per sentence: (key, sentence_no from 0, start_pos, sentence), places in code points of the text as it is.

    A sentence ends with the end mark of its language, with the closing quotation marks and brackets behind it, with a
    blank line or with the text; in Thai with a space between letters. A single line break ends none, nor do marks in
    abbreviations, initials, numbers, ordinals and addresses, pauses, or marks inside quotations and brackets within a
    sentence. White space around a sentence isn't part of it. ``model`` is what ``learned`` gives. Null, empty and blank
    texts give no rows; repeated keys are split each. Extra columns are left out.
    """
    rows = df.select(F.col(key).alias("key"), F.col(text).alias("text")).where("text is not null and text <> ''")
    rows = rows.withColumn("starts", _starts(df, model))
    spans = F.expr(
        "transform(starts, (p, i) -> struct(i as sentence_no, p as start_pos,"
        " substring(text, int(p + 1), int(coalesce(try_element_at(starts, i + 2), length(text)) - p)) as sentence))"
    )
    out = rows.select(F.col("key").alias(key), F.inline(spans))
    return out.withColumn("sentence", F.regexp_replace("sentence", r"(?U)\s+$", ""))


def sentence_places(df: DataFrame, key: str = "doc_id", text: str = "text", model: Model = FIXED) -> DataFrame:
    """(key, start_pos) of every sentence, as in ``sentences``."""
    rows = df.select(F.col(key).alias("key"), F.col(text).alias("text")).where("text is not null and text <> ''")
    return rows.select(F.col("key").alias(key), F.explode(_starts(df, model)).alias("start_pos"))
