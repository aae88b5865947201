"""Evaluation texts that stand, whole or in part, in corpus documents: latent semantic retrieval with exact checks.

Texts are compared as their letters and digits in consistent form and lower case. Terms are character n-grams, thinned
by winnowing, so that two texts with a common run choose the same terms in it. Passages are overlapping windows.

1. The evaluation set is taken in blocks of bounded size; a block's terms are the vocabulary.
2. One pass over all documents counts in how many of them each term stands (document frequencies).
3. A randomised SVD of the block's TF-IDF passages, its products computed by Spark over the passages, gives the latent
   space. It is fitted on the evaluation passages alone, as other directions say nothing about them.
4. One pass over all passages of all documents that have enough terms of the evaluation set: TF-IDF, projection, cosine in
   the latent space with the block's passages.
5. Candidates are checked: for runs, whether the passage's first characters stand in the item, then the longest common
   run; for paraphrases the longest common subsequence with the item's whole text, all passages of an item at once, then
   numbers, names and the longest common subsequence with the passages they come near to.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from functools import cache, reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidentia.llm.consistent_form import consistent, lowered

N_GRAM, WINNOW = 10, 8
PASSAGE, STRIDE = 60, 10
RANK, OVERSAMPLE, POWER = 96, 16, 2
#: Least cosine of a candidate.
COSINE = 0.6
#: Least terms that a passage of a paraphrase shares with the evaluation set.
TERMS = 3
#: Characters of evaluation text in a block. Of its terms, at most one in two characters and mostly one in five, the driver
#: holds a few matrices of RANK + OVERSAMPLE numbers each, 50 MB apiece; a task holds one, and a tile of cosines.
BLOCK_CHARS, TILE = 250_000, 8_000_000
#: A passage is compared with the item's passage nearest by cosine and so many characters on both sides of it.
AROUND = 15
#: Texts are worked on in stretches of so many characters, which overlap.
STRETCH, LAP = 500_000, 2_000


@cache
def _alnum_table() -> np.ndarray:
    return np.fromiter((chr(i).isalnum() for i in range(0x110000)), bool, 0x110000)


def bare(text: str) -> np.ndarray:
    """Code points of the letters and digits of the text's consistent form in lower case."""
    points = np.frombuffer(lowered(text).encode("utf-32-le", "surrogatepass"), np.uint32)
    return points[_alnum_table()[points]]


def _slide(x: np.ndarray, width: int, f: np.ufunc) -> np.ndarray:
    """f over each ``width`` neighbours (a power of two); shorter by width - 1."""
    step = 1
    while step < width:
        x = f(x[:-step], x[step:])
        step *= 2
    return x


def gram_hashes(points: np.ndarray, width: int) -> np.ndarray:
    """A hash of each ``width`` neighbouring code points, by doubling."""
    if len(points) < width:
        return np.empty(0, np.uint64)
    h = points.astype(np.uint64) + np.uint64(1)
    parts, at, step, power = None, 0, 1, width
    multiplier = np.array([0x9E3779B97F4A7C15], np.uint64)
    while power:
        if power & 1:
            piece = h[at:]
            if parts is None:
                parts = piece
            else:
                m = min(len(parts), len(piece))
                parts = parts[:m] * multiplier + piece[:m]
            at += step
        power >>= 1
        if power:
            h = h[:-step] * multiplier + h[step:]
            step, multiplier = 2 * step, multiplier * multiplier
    h = parts[: len(points) - width + 1] * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ h >> np.uint64(31)


def terms(points: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Winnowed n-grams of texts laid end to end, ``owner`` telling them apart: (hashes, places)."""
    if len(points) < N_GRAM + WINNOW:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    h = gram_hashes(points, N_GRAM)
    last = np.uint64(0xFFFFFFFFFFFFFFFF)
    h[owner[: len(h)] != owner[N_GRAM - 1 :]] = last
    pad = np.full(WINNOW - 1, last)
    low = _slide(np.concatenate((pad, h, pad)), WINNOW, np.minimum)
    chosen = np.flatnonzero((_slide(low, WINNOW, np.maximum) == h) & (h != last))
    return h[chosen], chosen


def _stretches(texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Code points of several texts end to end and, for each, the number of its text and its place there; at most about
    STRETCH characters."""
    parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    size = 0
    for i, t in enumerate(texts):
        if not t:
            continue
        p = bare(t)
        for a in range(0, max(len(p) - LAP, 1), STRETCH):
            piece = p[a : a + STRETCH + LAP]
            if size and size + len(piece) > STRETCH + LAP:
                yield tuple(map(np.concatenate, zip(*parts, strict=True)))
                parts, size = [], 0
            parts.append((piece, np.full(len(piece), i, np.int32), np.arange(a, a + len(piece), dtype=np.int32)))
            size += len(piece)
    if size:
        yield tuple(map(np.concatenate, zip(*parts, strict=True)))


def _lookup(hashes: np.ndarray, vocabulary: np.ndarray, sieve: np.ndarray) -> np.ndarray:
    """Numbers of the hashes in the sorted vocabulary, -1 where absent; the sieve spares most searches."""
    out = np.full(len(hashes), -1, np.int64)
    maybe = np.flatnonzero(sieve[hashes & np.uint64(len(sieve) - 1)])
    at = np.minimum(np.searchsorted(vocabulary, hashes[maybe]), len(vocabulary) - 1)
    hit = vocabulary[at] == hashes[maybe]
    out[maybe[hit]] = at[hit]
    return out


def _sieve(vocabulary: np.ndarray) -> np.ndarray:
    sieve = np.zeros(1 << 22, bool)
    sieve[vocabulary & np.uint64(len(sieve) - 1)] = True
    return sieve


def _windows(points: np.ndarray, owner: np.ndarray, stride: int) -> np.ndarray:
    """Starts of the passages: every ``stride`` characters of each text, and one that ends with it."""
    edges = np.flatnonzero(np.diff(owner)) + 1
    firsts = np.concatenate(([0], edges))
    ends = np.concatenate((edges, [len(points)]))
    grid = np.arange(len(points))
    text = np.repeat(np.arange(len(firsts)), ends - firsts)
    inside = ((grid - firsts[text]) % stride == 0) & (grid + PASSAGE <= ends[text])
    return np.union1d(np.flatnonzero(inside), np.maximum(firsts, ends - PASSAGE))


def _spans(starts: np.ndarray, owner: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and one past the last of the terms that lie whole in each passage."""
    text_end = np.searchsorted(owner, owner[starts], "right")
    last = np.minimum(starts + PASSAGE, text_end) - N_GRAM
    return np.searchsorted(places, starts, "left"), np.searchsorted(places, last, "right")


def _document_frequencies(docs: DataFrame, text: str, vocabulary: np.ndarray) -> np.ndarray:
    """In how many documents each term stands; counted per batch, then summed."""
    known = docs.sparkSession.sparkContext.broadcast((vocabulary, _sieve(vocabulary)))

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        vocabulary, sieve = known.value
        totals = np.zeros(len(vocabulary), np.int64)
        for b in batches:
            for points, owner, _ in _stretches(list(b["text"])):
                hashes, places = terms(points, owner)
                number = _lookup(hashes, vocabulary, sieve)
                seen = number >= 0
                pairs = np.unique(owner[places[seen]].astype(np.int64) * len(vocabulary) + number[seen])
                totals += np.bincount(pairs % len(vocabulary), minlength=len(vocabulary))
        hit = np.flatnonzero(totals)
        yield pd.DataFrame({"term": hit, "df": totals[hit]})

    counts = docs.select(F.col(text).alias("text")).mapInPandas(count, "term long, df long")
    counts = counts.groupBy("term").agg(F.sum("df").alias("df")).toPandas()  # no longer than the vocabulary
    out = np.zeros(len(vocabulary), np.int64)
    out[counts["term"].to_numpy(np.int64)] = counts["df"].to_numpy(np.int64)
    return out


def _sparse_rows(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    sizes = pdf["terms"].map(len).to_numpy()
    return np.repeat(np.arange(len(pdf)), sizes), np.concatenate([*pdf["terms"], np.empty(0, np.int64)]).astype(np.int64), np.concatenate([*pdf["weights"], np.empty(0)])


def _times(rows: np.ndarray, cols: np.ndarray, w: np.ndarray, n: int, right: np.ndarray) -> np.ndarray:
    """Sparse (rows, cols, w) times a dense matrix; rows ascending."""
    if not len(rows):
        return np.zeros((n, right.shape[1]))
    starts = np.flatnonzero(np.diff(rows, prepend=-1))
    out = np.zeros((n, right.shape[1]))
    out[rows[starts]] = np.add.reduceat(w[:, None] * right[cols], starts, axis=0)
    return out


def randomised_svd(passages: DataFrame, n_terms: int, rank: int = RANK, seed: int = 7) -> np.ndarray:
    """Right singular vectors (n_terms x rank) of the sparse matrix with a row (terms, weights) per passage.

    Randomised range finder with power iterations. Every product A'(A X) is computed by Spark, partition by partition, and
    summed by terms; the driver holds one matrix of vocabulary times rank and orthonormalises it.
    """
    spark = passages.sparkSession
    width = min(rank + OVERSAMPLE, n_terms)
    x = np.random.default_rng(seed).standard_normal((n_terms, width))

    def product(x: np.ndarray) -> np.ndarray:
        right = spark.sparkContext.broadcast(x)

        def part(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            total: dict[int, np.ndarray] = {}
            for b in batches:
                rows, cols, w = _sparse_rows(b)
                y = _times(rows, cols, w, len(b), right.value)
                order = np.argsort(cols, kind="stable")
                back = _times(cols[order], rows[order], w[order], n_terms, y)
                for t in np.unique(cols):
                    total[t] = total[t] + back[t] if t in total else back[t]
            yield pd.DataFrame({"term": list(total), "row": [v.tobytes() for v in total.values()]})

        def add(pdf: pd.DataFrame) -> pd.DataFrame:
            known, place = np.unique(pdf["term"].to_numpy(np.int64), return_inverse=True)
            total = np.zeros((len(known), width))
            np.add.at(total, place, np.frombuffer(b"".join(pdf["row"])).reshape(-1, width))
            return pd.DataFrame({"term": known, "row": [v.tobytes() for v in total]})

        schema = "term long, row binary"  # bytes, as lists of numbers would fill the driver
        parts = max(32, n_terms // 4096)
        sums = passages.mapInPandas(part, schema).groupBy(F.expr(f"term % {parts}")).applyInPandas(add, schema).toPandas()
        out = np.zeros((n_terms, width))
        if len(sums):
            out[sums["term"].to_numpy(np.int64)] = np.frombuffer(b"".join(map(bytes, sums["row"]))).reshape(-1, width)
        right.unpersist()
        return out

    for _ in range(POWER):
        x, _ = np.linalg.qr(product(x))
    values, vectors = np.linalg.eigh(x.T @ product(x))
    return (x @ vectors[:, np.argsort(-values)])[:, : min(rank, width)]


def _common_run(a: str, b: str, least: int) -> int:
    """Length of the longest run of ``a`` that stands in ``b``; 0 if under ``least``."""
    best, i = least - 1, 0
    while i + best < len(a):
        while i + best < len(a) and a[i : i + best + 1] in b:
            best += 1
        i += 1
    return best if best >= least else 0


def _common_subsequence(a: str, b: str) -> int:
    """Length of the longest common subsequence, all of ``a`` in one number of bits."""
    places: dict[str, int] = {}
    for i, c in enumerate(a):
        places[c] = places.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    v = full
    for c in b:
        m = v & places.get(c, 0)
        v = ((v + m) | (v - m)) & full
    return len(a) - v.bit_count()


def _common_subsequences(points: np.ndarray, starts: np.ndarray, lengths: np.ndarray, item: np.ndarray, texts: list[np.ndarray]) -> np.ndarray:
    """The same for many passages, each with the item of its number; ``item`` ascending. All passages of an item at once."""
    out = np.zeros(len(starts), np.int64)
    one, full = np.uint64(1), (np.uint64(1) << lengths.astype(np.uint64)) - np.uint64(1)
    places = np.arange(PASSAGE)
    edges = np.flatnonzero(np.diff(item, prepend=-1, append=-1))
    for a, b in zip(edges, edges[1:], strict=False):
        text = texts[item[a]]
        chars = points[np.minimum(starts[a:b, None] + places, len(points) - 1)]
        bits = np.where(places < lengths[a:b, None], one << places.astype(np.uint64), np.uint64(0))
        letters, which = np.unique(text, return_inverse=True)
        masks = [((chars == c) * bits).sum(axis=1, dtype=np.uint64) for c in letters]
        v = full[a:b].copy()
        for k in which:
            m = v & masks[k]
            v = ((v + m) | (v - m)) & full[a:b]
        out[a:b] = lengths[a:b] - np.bitwise_count(v)
    return out


def _decode(points: np.ndarray) -> str:
    return points.astype("<u4").tobytes().decode("utf-32-le", "surrogatepass")


_NUMBER = re.compile(r"\d+")
_NAME = re.compile(r"(?<=[^.!?:\s]\s)[^\W\d_]+")


def _names(text: str, bare_text: str) -> list[tuple[int, str]]:
    """Names of an item, words with a capital within a sentence of text that has small letters too, with their places."""
    form = consistent(text)
    out, at = [], 0
    for m in _NAME.finditer(form) if form.upper() != form else ():
        word = m.group()
        if len(word) >= 3 and word[0].isupper() and not word.isupper():
            place = bare_text.find(word.lower(), at)
            if place >= 0:
                out.append((place, word.lower()))
                at = place + len(word)
    return out


def _same_numbers(near: str, lo: int, hi: int, numbers: frozenset[str]) -> bool:
    """Whether the numbers that stand in ``near`` between ``lo`` and ``hi``, whole ones also where they reach beyond, are
    all among the item's."""
    return all(m.group() in numbers for m in _NUMBER.finditer(near) if m.start() < hi and m.end() > lo)


def _block_leaks(docs: DataFrame, items: list[tuple[int, str]], n_docs: int, doc_key: str, text: str, least: int, share: float, judged: bool) -> DataFrame:
    spark = docs.sparkSession
    texts = [_decode(bare(t)) for _, t in items]
    answers = [(frozenset(_NUMBER.findall(b)), _names(t, b)) for (_, t), b in zip(items, texts, strict=True)]
    found = []
    for points, owner, origin in _stretches([t for _, t in items]):
        hashes, places = terms(points, owner)
        starts = _windows(points, owner, STRIDE // 2)
        found.append((hashes, owner[starts], origin[starts], *_spans(starts, owner, places)))
    schema = "doc_id long, item_id long, cosine double, run long, subsequence double"
    vocabulary = np.unique(np.concatenate([f[0] for f in found])) if found else np.empty(0, np.uint64)
    if not len(vocabulary):
        return spark.createDataFrame([], schema)
    frequencies = _document_frequencies(docs, text, vocabulary)
    idf = np.log(1 + n_docs / (1 + frequencies))
    rows = []
    for hashes, owner, origin, first, last in found:
        number = np.searchsorted(vocabulary, hashes)
        for i, o, a, b in zip(owner, origin, first, last, strict=True):
            if b > a:
                t, n = np.unique(number[a:b], return_counts=True)
                w = n * idf[t]
                rows.append((int(i), int(o), t.tolist(), (w / max(np.linalg.norm(w), 1e-12)).tolist()))
    matrix = pd.DataFrame(rows, columns=["item", "origin", "terms", "weights"])
    passages = spark.createDataFrame(matrix[["terms", "weights"]], "terms array<long>, weights array<double>")
    space = randomised_svd(passages.repartition(max(8, len(matrix) // 4096)), len(vocabulary))
    r, c, w = _sparse_rows(matrix)
    latent = _times(r, c, w, len(matrix), space)
    norms = np.linalg.norm(latent, axis=1)
    good = norms > 1e-9
    latent = (latent[good] / norms[good, None]).astype(np.float32)
    owners, origins = matrix["item"].to_numpy()[good], matrix["origin"].to_numpy()[good]
    # A passage that begins in a run of ``least`` has its first ``core`` characters in it.
    core = max(1, min(PASSAGE, least - STRIDE + 1))
    cores = [gram_hashes(bare(t), core) * np.uint64(2 * i + 1) for i, (_, t) in enumerate(items)]
    cores = np.unique(np.concatenate(cores)) if cores else np.empty(0, np.uint64)
    shared = spark.sparkContext.broadcast(
        (vocabulary, _sieve(vocabulary), idf, space.astype(np.float32), latent, owners, origins, texts, answers, [k for k, _ in items], cores)
    )

    # Such a passage has at least so many terms of the item, as of each WINNOW n-grams one is a term.
    of_run = (least - STRIDE + 1 - N_GRAM + 1) // WINNOW
    least_cosine, shared_terms = COSINE, max(1, min(of_run, TERMS) if judged else of_run)

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        vocabulary, sieve, idf, space, latent, owners, origins, texts, answers, keys, cores = shared.value
        tile = max(16, TILE // max(1, len(latent)))
        columns = [np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32) for t in texts]
        for b in batches:
            out: dict[tuple[int, int], list] = {}
            ids = b["doc_id"].to_numpy()
            for points, owner, _ in _stretches(list(b["text"])):
                hashes, places = terms(points, owner)
                if not len(hashes):
                    continue
                number = _lookup(hashes, vocabulary, sieve)
                known = number >= 0
                so_far = np.concatenate(([0], np.cumsum(known)))
                starts = _windows(points, owner, STRIDE)
                first, last = _spans(starts, owner, places)
                last = np.maximum(first, last)
                head = gram_hashes(points, core)

                def run_like(start: np.ndarray, item: np.ndarray, head: np.ndarray = head) -> np.ndarray:
                    """Whether the first characters of the passages stand in the items."""
                    if not len(head) or not len(cores):
                        return np.zeros(len(start), bool)
                    x = head[np.minimum(start, len(head) - 1)] * (2 * item + 1).astype(np.uint64)
                    return (cores[np.minimum(np.searchsorted(cores, x), len(cores) - 1)] == x) & (start < len(head))

                some = np.flatnonzero(so_far[last] - so_far[first] >= shared_terms)
                near: list[tuple[np.ndarray, ...]] = []
                for at in range(0, len(some), tile):
                    chosen = some[at : at + tile]
                    sizes = last[chosen] - first[chosen]
                    row = np.repeat(np.arange(len(chosen)), sizes)
                    term = np.repeat(first[chosen] - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())
                    keep = known[term]
                    row, t = row[keep], number[term[keep]]
                    z = _times(row, t, idf[t], len(chosen), space)
                    z /= np.maximum(np.linalg.norm(z, axis=1), 1e-12)[:, None]
                    cosines = z.astype(np.float32) @ latent.T
                    p, q = np.divmod(np.flatnonzero(cosines >= least_cosine), len(latent))
                    if not judged:
                        kept = run_like(starts[chosen[p]], owners[q])
                        p, q = p[kept], q[kept]
                    near.append((starts[chosen[p]], q, cosines[p, q]))
                if not near:
                    continue
                start, q, cosine = map(np.concatenate, zip(*near, strict=True))
                # One row per passage and item, as an item has several passages.
                order = np.lexsort((start, owners[q]))
                start, q, cosine = start[order], q[order], cosine[order]
                item = owners[q]
                group = np.flatnonzero(np.diff(start, prepend=-1) | np.diff(item, prepend=-1))
                if not len(group):
                    continue
                best = np.maximum.reduceat(cosine, group)
                bound = np.append(group, len(start))
                text_end = np.searchsorted(owner, owner[start[group]], "right")
                length = np.minimum(PASSAGE, text_end - start[group])
                runs = run_like(start[group], item[group]) if judged else np.ones(len(group), bool)
                common = _common_subsequences(points, start[group], length, item[group], columns) if judged else length
                kept = np.flatnonzero(runs | (common >= share * length))
                for g in kept:
                    s, i = int(start[group[g]]), int(item[group[g]])
                    pair = out.setdefault((ids[owner[s]], i), [0.0, 0, 0.0, set()])
                    pair[0] = max(pair[0], float(best[g]))
                    lo, hi = int(np.searchsorted(owner, owner[s])), int(text_end[g])
                    whole = texts[i]
                    bin_ = s // PASSAGE
                    if runs[g] and bin_ not in pair[3]:  # one region holds the runs of all passages of its bin
                        pair[3].add(bin_)
                        reach = len(whole) + PASSAGE
                        region = _decode(points[max(lo, bin_ * PASSAGE - reach) : min(hi, (bin_ + 1) * PASSAGE + reach)])
                        pair[1] = max(pair[1], _common_run(whole, region, least))
                    if judged and common[g] >= share * length[g]:
                        left, end = max(lo, s - AROUND), s + int(length[g])
                        around = _decode(points[left : min(hi, end + AROUND)])
                        numbers, names = answers[i]
                        if not _same_numbers(around, s - left, end - left, numbers):
                            continue
                        for o in set(origins[q[bound[g] : bound[g + 1]]].tolist()):
                            if all(x in around for at, x in names if o <= at and at + len(x) <= o + PASSAGE):
                                got = _common_subsequence(around[s - left : end - left], whole[max(0, o - AROUND) : o + PASSAGE + AROUND])
                                pair[2] = max(pair[2], got / (end - s))
                for pair in out.values():  # places of the next stretch are others
                    pair[3].clear()
            yield pd.DataFrame([(d, keys[i], *v[:3]) for (d, i), v in out.items()], columns=["doc_id", "item_id", "cosine", "run", "subsequence"])

    return docs.select(F.col(doc_key).alias("doc_id"), F.col(text).alias("text")).where("text is not null").mapInPandas(search, schema)


def leaks(docs: DataFrame, items: DataFrame, doc_key: str = "doc_id", item_key: str = "item_id", text: str = "text", least: int = 60,
          share: float = 0.8, judged: bool = True) -> DataFrame:
    """Candidates (doc_id, item_id, cosine, run, subsequence), one row per document and item.

    ``run`` is the length of the longest stretch of letters and digits that both share, 0 if under ``least``. With
    ``judged``, every passage that comes near by cosine is held against each of the item's passages it comes near to: where
    it gives the same answers, ``subsequence`` is the largest share of its characters that stand there, or AROUND
    characters beside, in that order; else 0. Answers are the same if the passage's numbers, as whole numbers, all stand in
    the item, and the names in the item's passage all stand in or beside the document's; without numbers and names they
    are. Null and empty texts match nothing; rows with a null key are left out; repeated documents are rows of their own,
    and an item given twice counts once. Empty tables give no rows.

    The evaluation set is read in blocks of about BLOCK_CHARS characters, each of which is searched against all
    documents; nothing else passes through the driver.
    """
    items = items.select(F.col(item_key).cast("long").alias("item_id"), F.col(text).alias("text"))
    items = items.where("item_id is not null and text is not null and text <> ''").distinct()
    docs = docs.where(F.col(doc_key).isNotNull())
    sized = items.agg(F.sum(F.length("text")).alias("n")).first()["n"] or 0
    n_docs = docs.count()
    blocks = max(1, math.ceil(sized / BLOCK_CHARS))
    found = []
    for k in range(blocks):
        block = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k).orderBy("item_id", "text").collect()
        found.append(_block_leaks(docs, [(r["item_id"], r["text"]) for r in block], n_docs, doc_key, text, least, share, judged))
    return reduce(DataFrame.unionByName, found)


def leaked(docs: DataFrame, items: DataFrame, least: int = 60) -> DataFrame:
    """(doc_id, item_id) of documents that share at least ``least`` letters and digits in a row with an item."""
    hits = leaks(docs, items, least=least, judged=False).where(F.col("run") >= least)
    return hits.select("doc_id", "item_id").distinct()


def paraphrased(docs: DataFrame, items: DataFrame, share: float = 0.8, least: int = 60) -> DataFrame:
    """Candidates without such a run, a passage of which still stands in the item in order and gives the same answers."""
    near = leaks(docs, items, least=least, share=share).where((F.col("run") < least) & (F.col("subsequence") >= share))
    return near.groupBy("doc_id", "item_id").agg(F.round(F.max("cosine"), 4).alias("cosine"), F.round(F.max("subsequence"), 4).alias("subsequence"))
