"""The same results as SQL over the given tables, written from the definitions rather than from the plans."""

from __future__ import annotations

import itertools
import re

# Fixed values, stated here again so that the operators' own tables are checked: keys with their parts, weights, features.
_PARTS = {
    "doc_page_layout_type": "doc_name page_id layout_id raw_type", "doc_page_layout": "doc_name page_id layout_id", "doc_page_type": "doc_name page_id raw_type",
    "doc_layout_type": "doc_name layout_id raw_type", "doc_page": "doc_name page_id", "doc_layout": "doc_name layout_id", "doc_type": "doc_name raw_type",
    "quote_id": "quote_id", "raw_type": "raw_type", "modality": "modality", "expected_raw_type": "expected_key raw_type",
    "expected_modality": "expected_key modality", "expected_quote_id": "expected_key quote_id", "question_type_raw_type": "question_type raw_type",
    "domain_raw_type": "domain raw_type", "doc_content": "doc_name content_md5", "global_content": "content_md5",
}
_MEMORY = dict(
    doc_page_layout_type=1.15, doc_page_layout=0.85, doc_page_type=0.55, doc_layout_type=0.45, doc_page=0.18, doc_layout=0.14, doc_type=0.04,
    quote_id=0.04, raw_type=0.03, modality=0.02, expected_raw_type=0.18, expected_modality=0.1, expected_quote_id=0.08,
    question_type_raw_type=0.06, domain_raw_type=0.05, doc_content=1.35, global_content=0.25,
)
_PRECISE = dict(doc_page_layout_type=1.4, doc_page_layout=1.0, doc_page_type=0.65, doc_layout_type=0.55, doc_content=1.6)
_SIMILAR = dict(doc_page_layout_type=1.1, doc_page_layout=0.8, doc_page_type=0.45, doc_layout_type=0.35, doc_content=1.25)
_PRECISIONS = ("doc_content", "doc_page_layout_type", "doc_page_type", "doc_layout_type", "global_content")
_VOTE_KINDS = ("exact", "page", "layout", "page_type", "raw_type")
_FEATURES = (
    "base_norm", "bm25_norm", "dense_norm", "memory_norm", "precise_norm", "similar_norm", "type_score", "page_context_norm",
    "layout_context_norm", *(f"{v}_votes_norm" for v in _VOTE_KINDS), *(f"p_{k}" for k in _PRECISIONS), "neighbor_best",
    "neighbor_mean3", "neighbor_share", "neighbor_has", "is_text", "is_image", "is_table", "is_figure", "is_chart",
    "is_picture", "has_page", "has_layout", "n_tokens", "bm25_pct", "dense_pct",
)
_SWEPT = ((0.25, 0.35, 0.45), (0.55, 0.65, 0.75), (0.25, 0.4, 0.55, 0.7, 0.9), (0.0, 0.05, 0.1, 0.15, 0.25))

WS = r"[\s\x0b\x{85}\p{Z}]+"


def strip(x: str) -> str:
    return f"coalesce(regexp_replace(cast({x} as varchar), '^{WS}|{WS}$', '', 'g'), '')"


def norm(x: str) -> str:
    undone = f"coalesce(cast({x} as varchar), '')"
    for a, b in ((r"\%", "%"), (r"\$", "$"), (r"\_", "_"), ("$", " ")):
        undone = f"replace({undone}, '{a}', '{b}')"
    return f"trim(regexp_replace({undone}, '{WS}', ' ', 'g'))"


def tokens(x: str) -> str:
    return f"regexp_extract_all(lower({norm(x)}), '[A-Za-z0-9]+(?:[._/-][A-Za-z0-9]+)?')"


def scaled(x: str, by: str = "q_id") -> str:
    lo, hi = f"min({x}) over (partition by {by})", f"max({x}) over (partition by {by})"
    return f"(case when {hi} - {lo} <= 1e-9 * greatest(abs({lo}), abs({hi})) then 0.0::double else ({x} - {lo}) / ({hi} - {lo}) end)"


def best(x: str, by: str = "q_id") -> str:
    return f"row_number() over (partition by {by} order by round({x}, 6) desc, cand_idx)"


def cosine(a: str, b: str) -> str:
    da, db = f"len(list_distinct({a}))", f"len(list_distinct({b}))"
    return f"(case when {da} = 0 or {db} = 0 then 0.0::double else len(list_intersect({a}, {b})) / sqrt({da}::double * {db}) end)"


def _doc_text(kind: str, content: str) -> str:
    cases = " ".join(f"when '{k}' then '{v}'" for k, v in {
        "text": "Text passage", "table": "Table data", "figure": "Figure description", "chart": "Chart description",
        "image": "Image description", "layout": "Layout element"}.items())
    other = f"upper(substr({kind}, 1, 1)) || lower(substr({kind}, 2)) || ' evidence'"
    return f"trim('This is a ' || (case lower({kind}) {cases} else {other} end) || ' containing the following information: ' || {norm(content)})"


def _keys(source: str, names: tuple[str, ...]) -> str:
    parts = []
    for n in names:
        cols = _PARTS[n].split()
        key = "concat_ws(chr(1), " + ", ".join(f"coalesce(cast({c} as varchar), chr(2) || 'null')" for c in cols) + ")"
        where = " where content_md5 is not null" if "content_md5" in cols else ""
        parts.append(f"select q_id, cand_idx, is_gold, '{n}' as key_name, {key} as key from {source}{where}")
    return " union all ".join(parts)


def _weights(w: dict[str, float]) -> str:
    return "(case key_name " + " ".join(f"when '{k}' then {v}::double" for k, v in w.items()) + " else 0.0::double end)"


def _recalled(keys: str, memory: str, own: str | None) -> str:
    g, c, join = "m.g", "m.c", ""
    if own:
        g, c = "(m.g - coalesce(o.g, 0))", "(m.c - coalesce(o.c, 0))"
        join = f"left join {own} o on o.q_id = k.q_id and o.key_name = k.key_name and o.key = k.key"
    useful = f"{g} > 0 and {c} > 0"
    return (
        f"select k.q_id, k.cand_idx, k.key_name, case when {useful} then {g}::double / {c} else 0.0::double end as precision,"
        f" case when {useful} then ln(1 + {g}::double) else 0.0::double end as support"
        f" from {keys} k join {memory} m on m.key_name = k.key_name and m.key = k.key {join}"
    )


def _memory_of(keys: str) -> str:
    return f"select key_name, key, count(*) as c, count(*) filter (where is_gold) as g from {keys} group by all"


def _bm(pool: str, keys: str, group: str, query: str, doc: str) -> str:
    """BM25 of a pool relation with columns ``query`` and ``doc``; keys and group are column lists."""
    on = lambda a, b, cols: " and ".join(f"{a}.{c} = {b}.{c}" for c in cols.replace(" ", "").split(","))
    return f"""
      with x as (select {keys}, {tokens(query)} as q, {tokens(doc)} as d from {pool}),
      tf as (select {keys}, term, count(*) as tf from (select {keys}, unnest(d) as term from x) group by all),
      qf as (select {keys}, term, count(*) as qf from (select {keys}, unnest(q) as term from x) group by all),
      df as (select {group}, term, count(*) as df from tf group by all),
      corpus as (select {group}, count(*) as n, avg(len(d)) as avgdl from x group by all),
      hits as (select tf.*, qf.qf from tf join qf on {on("tf", "qf", keys)} and tf.term = qf.term),
      part as (select {", ".join("h." + k.strip() for k in keys.split(","))}, h.qf * ln(1 + (c.n - f.df + 0.5::double) / (f.df + 0.5::double))
                 * (h.tf * 2.5::double) / (h.tf + 1.5::double * (0.25::double + 0.75::double * greatest(len(x.d), 1) / greatest(c.avgdl, 1e-9))) as part
               from hits h join df f on {on("h", "f", group)} and f.term = h.term join corpus c on {on("h", "c", group)} join x on {on("x", "h", keys)})
      select {", ".join("x." + k.strip() for k in keys.split(","))}, coalesce(sum(part), 0.0::double) as bm25 from x left join part on {on("x", "part", keys)} group by all"""


CTES: dict[str, str] = {
    "s": f"""select {strip("q_id")} as q_id, sample_pos, {strip("split")} as split, {strip("doc_name")} as doc_name, {strip("domain")} as domain,
        {norm("question")} as question, {strip("question_type")} as question_type,
        list_transform(coalesce(evidence_modality_type, []), lambda x: {strip("x")}) as types,
        list_sort(list_transform(list_filter(coalesce(evidence_modality_type, []), lambda x: {strip("x")} <> ''), lambda x: lower({strip("x")}))) as expected,
        list_transform(coalesce(gold_quotes, []), lambda x: {strip("x")}) as gold
      from samples where {strip("q_id")} <> ''
      qualify row_number() over (partition by {strip("q_id")} order by ingested_at desc nulls last, sample_pos desc) = 1""",
    "c": f"""select {strip("q_id")} as q_id, cand_idx, cand_id, {strip("quote_id")} as quote_id, modality,
        lower(case when {strip("raw_type")} <> '' then {strip("raw_type")} else modality end) as raw_type, {norm("content")} as content,
        page_id, layout_id, nullif({strip("img_path")}, '') as img_path
      from candidates where {strip("q_id")} <> '' and cand_idx is not null
      qualify row_number() over (partition by {strip("q_id")}, cand_idx order by ingested_at desc nulls last, cand_id desc) = 1""",
    "pool": f"""select c.*, s.* exclude (q_id), array_to_string(expected, ',') as expected_key, list_contains(gold, quote_id) as is_gold,
        {_doc_text("raw_type", "content")} as doc_text, case when lower({norm("content")}) <> '' then md5(lower({norm("content")})) end as content_md5,
        (case when list_contains(expected, raw_type) or (modality = 'text' and list_contains(expected, 'text')) then 1.0::double else 0.0::double end) as type_score
      from c join s on c.q_id = s.q_id""",
    "ref": "select * from pool where split = 'train'",
    "dev": "select * from pool where split = 'validation'",
    "bm": _bm("pool", "q_id, cand_idx", "q_id", "question", "doc_text"),
    "dn": """select c.q_id, c.cand_idx, coalesce(list_dot_product(a.embedding::double[], b.embedding::double[]), 0.0::double) as dense
      from c left join embeddings a on a.vec_id = c.q_id::bigint % (select count(*) from embeddings)
      left join embeddings b on b.vec_id = c.cand_id % (select count(*) from embeddings)""",
    "sc": f"""select {strip("q_id")} as q_id, cand_idx, method, case when score is null or isnan(score) then 0.0::double else score + 0.0::double end as score
      from scores qualify row_number() over (partition by {strip("q_id")}, cand_idx, method order by scored_at desc nulls last, score_id desc) = 1""",
    "fu": f"""select p.*, bm25, dense, {scaled("bm25", "p.q_id")} as bm25_norm, {scaled("dense", "p.q_id")} as dense_norm,
        {scaled("type_score", "p.q_id")} as type_score_norm
      from pool p join bm on p.q_id = bm.q_id and p.cand_idx = bm.cand_idx join dn on p.q_id = dn.q_id and p.cand_idx = dn.cand_idx""",
    "rk": _keys("ref", tuple(_PARTS)),
    "pk": _keys("pool", tuple(_PARTS)),
    "mem": _memory_of("rk"),
    "own": "select q_id, key_name, key, count(*) as c, count(*) filter (where is_gold) as g from rk group by all",
    "pr": _recalled("pk", "mem", "own"),
    "rr": _recalled("rk", "mem", "own"),
    "pm": f"""select d.q_id, d.cand_idx, coalesce(sum({_weights(_MEMORY)} * precision * support), 0.0::double) as memory,
        coalesce(sum({_weights(_PRECISE)} * precision * support), 0.0::double) as precise
      from pool d left join pr on d.q_id = pr.q_id and d.cand_idx = pr.cand_idx group by all""",
    "fm": f"""select f.*, memory, precise, {scaled("memory", "f.q_id")} as memory_norm, {scaled("precise", "f.q_id")} as precise_norm
      from fu f join pm on f.q_id = pm.q_id and f.cand_idx = pm.cand_idx""",
    "asked": "select * from s where try_cast(q_id as bigint) % 20 = 0",
    "refs": "select * from s where split = 'train'",
    "qp": f"""select * from (select a.q_id, r.q_id as ref_q_id, r.sample_pos as ref_pos, {cosine(tokens("a.question"), tokens("r.question"))} as similarity
      from asked a join refs r on a.doc_name = r.doc_name and a.q_id <> r.q_id where a.doc_name <> '') where similarity > 0""",
    "np": """select a.q_id, r.q_id as ref_q_id, r.sample_pos as ref_pos, a.question, r.question as ref_question
      from asked a join refs r on a.doc_name = r.doc_name and a.q_id <> r.q_id where a.doc_name <> ''""",
    "nb": _bm("np", "q_id, ref_q_id", "q_id", "question", "ref_question"),
    "ns": f"""select q_id, ref_q_id, ref_pos, 0.7::double * {scaled("bm25")} + 0.3::double * {scaled("cos")} as score from (
        select p.q_id, p.ref_q_id, ref_pos, bm25, {cosine(tokens("question"), tokens("ref_question"))} as cos
        from np p join nb on p.q_id = nb.q_id and p.ref_q_id = nb.ref_q_id)""",
    "nn": """select *, row_number() over (partition by q_id order by round(score, 6) desc, ref_pos) as n_rank from ns
      where round(score, 6) > 0 qualify n_rank <= 3""",
    "ap": "select * from pool where q_id in (select q_id from asked)",
    "lists": f"""select q_id, cand_idx, method, {best("score", "q_id, method")} as rank from sc qualify rank <= 20""",
    "ab": """select l.q_id, method, list(quote_id order by rank) as answer from lists l join c on l.q_id = c.q_id and l.cand_idx = c.cand_idx
      where rank <= 5 group by all""",
    "fs": f"""select f.*, {scaled("sim", "f.q_id")} as similar_norm from fm f join sima on f.q_id = sima.q_id and f.cand_idx = sima.cand_idx""",
    "base10": f"""select *, 0.35::double * bm25_norm + 0.65::double * dense_norm as score,
        {best("0.35::double * bm25_norm + 0.65::double * dense_norm")} as base_rank from fu qualify base_rank <= 10""",
}

_CLEAN_GOLD = "list_filter(gold, lambda g: g <> '')"
_RECALL = f"(case when len({_CLEAN_GOLD}) > 0 then len(list_filter({_CLEAN_GOLD}, lambda g: list_contains(coalesce(answer, []), g)))::double / len({_CLEAN_GOLD}) end)"
_EVAL = (
    "round(coalesce(avg(recall), 0.0::double), 6) as recall_at_5, count(recall) as evaluated,"
    " count(*) - count(recall) as skipped, count(*) as total"
)
CTES["bmtop"] = f"select bm.q_id, {best('bm25', 'bm.q_id').replace('cand_idx', 'bm.cand_idx')} as rank, quote_id, modality from bm join c on bm.q_id = c.q_id and bm.cand_idx = c.cand_idx qualify rank <= 5"
CTES["bmrec"] = f"""select s.*, {_RECALL} as recall from s left join (select q_id, list(quote_id order by rank) as answer from bmtop group by q_id) a on a.q_id = s.q_id"""


def _top(source: str, score: str, where: str = "true") -> str:
    return f"select q_id, rank, quote_id from (select q_id, quote_id, {best(score)} as rank from {source} where {where}) where rank <= 5"


def _rerank(scorer: str, weight: float, source: str = "base10") -> str:
    return f"""select q_id, cand_idx, quote_id, base_rank, row_number() over (partition by q_id order by round({1 - weight}::double * sn
        + {weight}::double * rn, 6) desc, base_rank) as rank from (select *, {scaled("score")} as sn, {scaled("rr")} as rn from (select *, {scorer} as rr from {source}))"""


def _first(source: str, score: str, k: int = 10) -> str:
    return f"(select *, {best('score')} as base_rank from (select *, {score} as score from {source}) qualify base_rank <= {k})"


def _boosted(source: str, score: str) -> str:
    """A source with ``score`` and the boost of pages by 0.1 and layouts by 0.05."""
    of = lambda p: f"case when {p} is null then 0.0::double else max(sc0) over (partition by q_id, {p}) end"
    return f"""(select *, sc0 + 0.1::double * {scaled("pb")} + 0.05::double * {scaled("lb")} as boosted from
      (select *, {of("page_id")} as pb, {of("layout_id")} as lb from (select *, {score} as sc0 from {source})))"""


def _jaccard(a: str, b: str) -> str:
    union = f"len(list_distinct(list_concat({a}, {b})))"
    return f"(case when {union} = 0 then 0.0::double else len(list_intersect({a}, {b}))::double / {union} end)"


def _route(condition: str) -> str:
    return f"""select s.q_id, array_to_string(coalesce(case when {condition} then a.answer else b.answer end, []), ' ') as answer
      from s left join ab a on a.q_id = s.q_id and a.method = 'bm25' left join ab b on b.q_id = s.q_id and b.method = 'dense'"""


_vote_where = {
    "exact": "p.content_md5 = g.content_md5", "page": "p.page_id = g.page_id", "layout": "p.layout_id = g.layout_id",
    "page_type": "p.page_id = g.page_id and p.raw_type = g.raw_type", "raw_type": "p.raw_type = g.raw_type",
}
_VOTES = f"""with g as (select n.q_id, n.score, r.content_md5, r.page_id, r.layout_id, r.raw_type from nn n join ref r on r.q_id = n.ref_q_id where r.is_gold)
  select p.q_id, p.cand_idx, {", ".join(f"round(coalesce(sum(case when {w} then {'0.2::double * ' if k == 'raw_type' else ''}g.score end), 0.0::double), 6) as {k}_votes" for k, w in _vote_where.items())}
  from ap p left join g on g.q_id = p.q_id group by all"""

def _buckets(split: str) -> str:
    near = {"validation": "nnd", "test": "nnt"}[split]
    return f"""select s.*, coalesce(n.n, 0) as n, coalesce(round(b.score, 6), 0.0::double) as near, case when t and i then 'mixed' when i then 'image_only' when t then 'text_only' else 'none' end as gm
      from bmrec s left join (select doc_name, count(*) as n from s where split = 'train' group by 1) n on n.doc_name = s.doc_name
      left join (select q_id, score from {near} where n_rank = 1) b on b.q_id = s.q_id
      left join (select g.q_id, bool_or(modality = 'text') as t, bool_or(modality <> 'text') as i from
        (select distinct q_id, unnest(gold) as quote_id from s) g join c on c.q_id = g.q_id and c.quote_id = g.quote_id where g.quote_id <> '' group by 1) m on m.q_id = s.q_id
      where split = '{split}'"""


_FREQ = "case when n <= 0 then 'unseen' when n <= 2 then 'seen_1_2' when n <= 4 then 'seen_3_4' when n <= 9 then 'seen_5_9' else 'seen_10_plus' end"
_families = {"doc_frequency": _FREQ, "overlap_confidence": "case when near <= 0 then 'none' when near < 0.2 then 'low' when near < 0.4 then 'mid' else 'high' end",
             "domain_bucket": "coalesce(nullif(domain, ''), 'unknown')", "type_bucket": "coalesce(nullif(question_type, ''), 'unknown')",
             "gold_len": f"cast(len({_CLEAN_GOLD}) as varchar)", "gold_modality": "gm"}
_OPEN = ("doc_frequency", "overlap_confidence", "domain_bucket")


def _shares(split: str, names: tuple[str, ...]) -> str:
    rows = " union all ".join(f"select '{f}' as family, {_families[f]} as bucket from b" for f in names)
    return f"""select family, bucket, count(*) as n, round(count(*)::double / sum(count(*)) over (partition by family), 6) as share
      from (with b as ({_buckets(split)}) {rows}) group by 1, 2"""


_FUSION_RECALLS = f"""with y as (select *, 0.35::double * bm25_norm + 0.65::double * dense_norm as base, {cosine(tokens("question"), tokens("doc_text"))} as rr from fu where split = 'validation'),
      z as (select q_id, cand_idx, quote_id, gold, {scaled("base")} as b, {scaled("rr")} as r from y),
      g(w) as (values (0.35::double), (0.45::double), (0.55::double), (0.65::double), (0.8::double), (1.0::double)),
      x as (select w, q_id, quote_id, gold, row_number() over (partition by w, q_id order by round((1 - w) * b + w * r, 6) desc, cand_idx) as rank from z cross join g qualify rank <= 5),
      a as (select w, q_id, list(quote_id) as answer, any_value(gold) as gold from x group by 1, 2)
      select w, coalesce(avg({_RECALL}), 0.0::double) as recall from a group by 1"""
SPLIT_DOC = """with d as (select doc_name, row_number() over (order by md5(doc_name || ':42'), doc_name) as place, count(*) over () as n from (select distinct doc_name from s)),
      w as (select *, greatest(1, round_even(n * 0.1, 0)) as wanted from d)
      select q_id, case when place <= case when n > 1 then least(wanted, n - 1) else wanted end then 'dev' else 'train' end as part from s join w on w.doc_name = s.doc_name"""

QUERIES: dict[str, str] = {
    "split_shard": f"""with p as ({SPLIT_DOC}), d as (select s.q_id, s.sample_pos, min(s.sample_pos) over (partition by doc_name) as first from s join p on p.q_id = s.q_id where part = 'dev'),
      x as (select q_id, row_number() over (order by first, sample_pos) as split_pos from d) select q_id, split_pos from x where (split_pos - 1) % 3 = 1""",
    "split_mixed": """with t as (select count(*) as n, least(greatest(1, cast(round_even(count(*) * 0.1::double, 0) as bigint)), greatest(count(*) - 1, 1)) as wanted from s),
      w as (select n, wanted, cast(round_even(wanted * 0.74::double, 0) as bigint) as seen from t),
      d as (select doc_name, sum(size) over (order by md5(doc_name || ':42'), doc_name) - size as before from (select doc_name, count(*) as size from s group by 1)),
      taken as (select doc_name from d, w where before < wanted - seen),
      rest as (select q_id, row_number() over (partition by doc_name order by md5(q_id || ':42'), q_id) as r from s where doc_name not in (from taken)),
      free as (select q_id, row_number() over (order by md5(q_id || ':43'), q_id) as place from rest where r > 1)
      select q_id, case when doc_name in (from taken) or q_id in (select q_id from free, w where place <= seen) then 'dev' else 'train' end as part from s""",
    "best_fusion_weight": f"""with recursive gr as (select row_number() over (order by w) as i, w, recall from ({_FUSION_RECALLS})),
      f as (select cast(0 as bigint) as i, cast(null as double) as w, -1.0::double as recall union all
        select gr.i, case when gr.recall > f.recall then gr.w else f.w end, case when gr.recall > f.recall then round(gr.recall, 6) else f.recall end from f join gr on gr.i = f.i + 1)
      select w as weight, recall from f order by i desc limit 1""",
    "answer_kinds": """with a as (select b.q_id, unnest([{'f': 'modality', 'v': l.m}, {'f': 'raw_type', 'v': l.r}]) as x from bmtop b join
        (select q_id, quote_id, arg_max(modality, cand_idx) as m, arg_max(raw_type, cand_idx) as r from c group by all) l on l.q_id = b.q_id and l.quote_id = b.quote_id)
      select facet, value, n, round(n::double / sum(n) over (partition by facet), 4) as share from (select x.f as facet, x.v as value, count(*) as n from a group by x.f, x.v)""",
    "gold_lengths": "select split, len(gold) as gold_len, count(*) as n from s group by all",
    "embedding_cache": """select substr(sha256('stub' || chr(0) || doc_text), 1, 24) as cache_key, any_value(length(doc_text)) as n_chars, bool_or(split = 'train') as cached from pool group by 1""",
    "reranker_prompts": r"""with x as (select q_id, cand_idx, '<Instruct>: Given a question, judge whether the document is evidence that helps to answer it.' || chr(10) || '<Query>: ' || question || chr(10) || '<Document>: ' || doc_text as p from pool)
      select q_id, cand_idx, md5(p) as prompt, length(p) as n_chars from x""",
    "records_samples": f"""select s.q_id, nullif({strip("old_id")}, '') as old_id, s.doc_name, s.domain, s.question, s.question_type, array_to_string(types, '|') as types, array_to_string(gold, '|') as gold
      from s join samples r on r.sample_pos = s.sample_pos""",
    "llm_top5": f"""with b as (select q_id, quote_id, {best("sc")} as rank from (select *, {_jaccard(tokens("question"), tokens("content"))} as sc from pool) qualify rank <= 3),
      said as (select q_id, quote_id, min(rank) as n from b where try_cast(q_id as bigint) % 2 is distinct from 1 or regexp_full_match(quote_id, '(text|image)[0-9]+') group by all),
      f as (select q_id, quote_id, {best("bm25", "bm.q_id").replace("cand_idx", "bm.cand_idx")} as rank from bm join pool using (q_id, cand_idx)),
      u as (select q_id, quote_id, min((late, n)) as at_ from (select q_id, quote_id, 0 as late, n from said union all select q_id, quote_id, 1, rank from f) group by all)
      select q_id, rank, quote_id from (select q_id, quote_id, row_number() over (partition by q_id order by at_) as rank from u) where rank <= 5""",
    "reranker_only": _top(f"(select *, {cosine(tokens('question'), tokens('doc_text'))} as rr from pool)", "rr"),
    "typed_memory_hybrid_top5": f"""select q_id, rank, quote_id from ({_rerank(cosine(tokens('question'), tokens('doc_text')), 0.5, _first(_boosted("fs",
        "0.35::double * bm25_norm + 0.65::double * dense_norm + 0.55::double * memory_norm + 0.15::double * similar_norm + 0.35::double * type_score_norm"), "boosted"))}) where rank <= 5""",
    "boosted_hybrid_top5": f"""select q_id, rank, quote_id from ({_rerank(cosine(tokens('question'), tokens('doc_text')), 0.5, _first(_boosted("fu", "0.35::double * bm25_norm + 0.65::double * dense_norm + 0.35::double * type_score_norm"), "boosted"))}) where rank <= 5""",
    "normalize_text": f"select cand_id, {norm('content')} as text from candidates",
    "tokenize": f"select cand_id, len({tokens('content')}) as n, array_to_string({tokens('content')}, ' ') as tokens from candidates",
    "candidate_text": f"select q_id, cand_idx, {_doc_text('raw_type', 'content')} as doc_text from c",
    "expected_type": "select q_id, cand_idx, expected_key, type_score from pool",
    "question_order": "select q_id, row_number() over (order by try_cast(q_id as bigint) is null, try_cast(q_id as bigint), q_id) as place from s",
    "bm25_scores": "select q_id, cand_idx, round(bm25, 6) as bm25 from bm where q_id in (select q_id from s)",
    "bm25_top5": "select q_id, rank, quote_id from bmtop",
    "bm25_eval": f"select split, {_EVAL} from bmrec group by split",
    "dense_scores": "select q_id, cand_idx, round(dense, 6) as dense from dn",
    "dense_top5": f"select q_id, rank, quote_id from (select dn.q_id, quote_id, {best('dense', 'dn.q_id').replace('cand_idx', 'dn.cand_idx')} as rank from dn join c on c.q_id = dn.q_id and c.cand_idx = dn.cand_idx) where rank <= 5",
    "minmax": f"select q_id, cand_idx, round({scaled('score')}, 6) as bm25_norm from sc where method = 'bm25'",
    "rank_percentile": "select q_id, cand_idx, round(1 - percent_rank() over (partition by q_id order by round(score, 6) desc, cand_idx), 6) as pct from sc where method = 'bm25'",
    "context_boost": f"""with x as (select sc.q_id, sc.cand_idx, sc.score, page_id, layout_id,
          case when page_id is null then 0.0::double else max(score) over (partition by sc.q_id, page_id) end as p,
          case when layout_id is null then 0.0::double else max(score) over (partition by sc.q_id, layout_id) end as l
        from sc join c on c.q_id = sc.q_id and c.cand_idx = sc.cand_idx where method = 'dense')
      select q_id, cand_idx, round(score + 0.1::double * {scaled("p")} + 0.05::double * {scaled("l")}, 6) as dense from x""",
    "hybrid_top5": _top("fu", "0.35::double * bm25_norm + 0.65::double * dense_norm"),
    "typed_hybrid_top5": _top("fu", "0.35::double * bm25_norm + 0.65::double * dense_norm + 0.35::double * type_score_norm"),
    "memory_table": "select key_name, md5(key) as key, c as candidate_cnt, g as gold_cnt from mem",
    "streamed_memory": "select key_name, md5(key) as key, c as candidate_cnt, g as gold_cnt from mem",
    "llm_parse": r"""with x as (select q_id, cand_idx, gold, list_filter(list_distinct_ordered, lambda g: list_contains(gold, g)) as ids from (
          select q_id, cand_idx, gold, case when cand_idx % 2 = 0 then gold
            else regexp_extract_all('I choose text1, image2 and ' || gold[1] || ' and text1. ' || content, '\b(?:text|image)\d+\b') end as said from pool where len(gold) > 0) y,
        lateral (select list(v order by i) as list_distinct_ordered from (select v, min(i) as i from (select unnest(y.said) as v, generate_subscripts(y.said, 1) as i) group by v)) z)
      select q_id, cand_idx, coalesce(array_to_string(ids, ' '), '') as ids from x""",
    "records_round_trip": """select q_id, row_number() over (partition by q_id order by modality desc, cand_idx) - 1 as cand_idx, quote_id, modality, page_id
      from c where modality in ('text', 'image')""",
    "memory_precision_loo": f"select q_id, cand_idx, key_name, round(precision, 6) as precision, round(support, 6) as support from rr where key_name in ({', '.join(repr(k) for k in _PRECISIONS)})",
    "memory_scores": "select q_id, cand_idx, round(memory, 6) as memory, round(precise, 6) as precise from pm",
    "memory_scores_loo": f"""select d.q_id, d.cand_idx, round(coalesce(sum({_weights(_MEMORY)} * precision * support), 0.0::double), 6) as memory,
        round(coalesce(sum({_weights(_PRECISE)} * precision * support), 0.0::double), 6) as precise
      from ref d left join rr on d.q_id = rr.q_id and d.cand_idx = rr.cand_idx group by all""",
    "memory_top5": _top("fm", "0.35::double * bm25_norm + 0.55::double * memory_norm"),
    "memory_hybrid_top5": _top("fm", "0.35::double * bm25_norm + 0.65::double * dense_norm + 0.55::double * memory_norm"),
    "force_memory": """with x as (select *, round(0.35::double * bm25_norm + 0.65::double * dense_norm + 0.55::double * memory_norm, 6) as sc from fm),
      y as (select *, row_number() over (partition by q_id order by sc desc, cand_idx) as br,
        case when round(precise, 6) > 0 then row_number() over (partition by q_id, round(precise, 6) > 0 order by round(precise, 6) desc, sc desc, cand_idx) end as f from x)
      select q_id, rank, quote_id from (select q_id, quote_id, row_number() over (partition by q_id order by case when f <= 2 then f else 2 + br end, br) as rank from y) where rank <= 5""",
    "question_similarity": "select q_id, ref_q_id, round(similarity, 6) as similarity from qp",
    "neighbors": "select q_id, ref_q_id, n_rank, round(score, 6) as score from nn",
    "neighbor_facts": """select a.q_id, round(coalesce(max(case when n_rank = 1 then score end), 0.0::double), 6) as neighbor_best,
        round(coalesce(avg(score), 0.0::double), 6) as neighbor_mean3, round(count(score) / 3.0::double, 6) as neighbor_share,
        case when count(score) > 0 then 1.0::double else 0.0::double end as neighbor_has
      from asked a left join nn on nn.q_id = a.q_id group by a.q_id""",
    "neighbor_votes": _VOTES,
    "similar_memory": f"""with n3 as (select *, row_number() over (partition by q_id order by round(similarity, 6) desc, ref_pos) as n from qp qualify n <= 3),
      g as (select n3.q_id, k.key_name, k.key, sum(similarity) as votes from n3 join rk k on k.q_id = n3.ref_q_id where k.is_gold group by all),
      k as ({_keys("ap", tuple(_SIMILAR))})
      select ap.q_id, ap.cand_idx, round(coalesce(t.similar, 0.0::double), 6) as similar from ap left join
        (select k.q_id, k.cand_idx, sum({_weights(_SIMILAR).replace("case key_name", "case k.key_name")} * votes) as similar from k join g on g.q_id = k.q_id and g.key_name = k.key_name and g.key = k.key group by all) t
        on t.q_id = ap.q_id and t.cand_idx = ap.cand_idx""",
    "rrf": f"""with r as (select q_id, cand_idx, method, {best("score", "q_id, method")} as rank from sc),
      x as (select q_id, cand_idx, sum((case method when 'bm25' then 1.0::double else 0.5::double end) / (60 + rank)) as rrf,
        min((case method when 'bm25' then 0 else 1 end, rank)) as seen from r group by all)
      select q_id, cand_idx, rank, rrf from (select q_id, cand_idx, round(rrf, 9) as rrf, row_number() over (partition by q_id order by round(rrf, 9) desc, seen) as rank from x) where rank <= 10""",
    "quota_union": """with a as (select * from lists where method = 'bm25'), b as (select * from lists where method = 'dense'),
      p1 as (select q_id, cand_idx, rank as at_ from a where rank <= 2),
      p2 as (select q_id, cand_idx, 1000 + row_number() over (partition by q_id order by rank) as at_ from b where (q_id, cand_idx) not in (select q_id, cand_idx from p1) qualify at_ <= 1002),
      p12 as (select * from p1 union all select * from p2),
      p3 as (select q_id, cand_idx, 2000 + row_number() over (partition by q_id order by rank) as at_ from a where (q_id, cand_idx) not in (select q_id, cand_idx from p12))
      select q_id, cand_idx, row_number() over (partition by q_id order by at_) as rank from (select * from p12 union all select * from p3) qualify rank <= 5""",
    "submission_rrf": """with x as (select q_id, quote_id, sum(w / (60 + rank)) as rrf, min(l * 1000000 + rank) as seen from (
          select q_id, unnest(answer) as quote_id, generate_subscripts(answer, 1) as rank, case method when 'bm25' then 1.0::double else 2.0::double end as w,
            case method when 'bm25' then 0 else 1 end as l from ab) group by all)
      select q_id, rank, quote_id from (select q_id, quote_id, row_number() over (partition by q_id order by round(rrf, 9) desc, seen) as rank from x) where rank <= 5""",
    "seen_doc_gate": _route("s.doc_name <> '' and s.doc_name in (select doc_name from s where split = 'train')"),
    "question_type_route": _route("s.question_type = 'Descriptive'"),
    "consensus_insert": """with f as (select q_id, answer[1] as item, case method when 'bm25' then 1 else 2 end as n from ab),
      v as (select q_id, item, row_number() over (partition by q_id order by n desc, item) as r from (select q_id, item, sum(n) as n from f where item is not null group by all))
      select a.q_id, array_to_string(case when item is null or list_contains(answer, item) then answer else list_append(answer[1:4], item) end, ' ') as answer
      from ab a left join v on v.q_id = a.q_id and r = 1 where method = 'bm25'""",
    "rerank_stub": f"select q_id, rank, quote_id from ({_rerank(cosine(tokens('question'), tokens('doc_text')), 0.5)}) where rank <= 5",
    "dual_rerank_stub": f"""with b as {_first("fs", "0.35::double * bm25_norm + 0.65::double * dense_norm + 0.55::double * memory_norm + 0.15::double * similar_norm")},
      l as (
        select q_id, cand_idx, quote_id, rank, 1.15::double as w, 0 as i from ({_rerank(cosine(tokens("question"), tokens("doc_text")), 0.7, "b")}) union all
        select q_id, cand_idx, quote_id, rank, 1.0::double, 1 from ({_rerank(_jaccard(tokens("question"), tokens("doc_text")), 0.7, "b")}) union all
        select q_id, cand_idx, quote_id, base_rank, 0.45::double, 2 from b),
      x as (select q_id, cand_idx, any_value(quote_id) as quote_id, sum(w / (60 + rank)) as rrf, min((i, rank)) as seen from l group by q_id, cand_idx)
      select q_id, rank, quote_id from (select q_id, quote_id, row_number() over (partition by q_id order by round(rrf, 9) desc, seen) as rank from x) where rank <= 5""",
    "image_top5": f"""with tb as ({_bm("(select * from pool where modality = 'text')", "q_id, cand_idx", "q_id", "question", "doc_text")}),
      x as (select q_id, cand_idx, {scaled("bm25")} as score from tb union all
            select q_id, cand_idx, {scaled("dense")} as score from (select dn.* from dn join pool p on p.q_id = dn.q_id and p.cand_idx = dn.cand_idx where p.modality = 'image')),
      y as (select x.*, quote_id from x join c on c.q_id = x.q_id and c.cand_idx = x.cand_idx) {_top("y", "score")}""",
    "llm_prompt": f"""select q_id, cast(0 as bigint) as line_no, 'You are a retrieval assistant. Select the 5 most relevant evidence quote_ids for the question. Output only a JSON array of quote_ids ordered from most relevant to least relevant.' as line from s
      union all select q_id, 1, 'Question: ' || question from s union all select q_id, 2, 'Candidates:' from s
      union all select c.q_id, cand_idx + 3, '- ' || quote_id || ': ' || array_to_string(list_slice(string_split({norm(_doc_text("raw_type", "content"))}, ' '), 1, 320), ' ') from c join s on s.q_id = c.q_id
      union all select s.q_id, coalesce(max(cand_idx), -1) + 4, 'Return exactly one JSON array like ["text3", "image2", ...].' from s left join c on c.q_id = s.q_id group by s.q_id""",
    "split_domain": "select q_id, case when replace(domain, '_', ' ') = 'Academic paper' then 'dev' else 'train' end as part from s",
    "split_row": """with x as (select q_id, row_number() over (order by md5(q_id || ':42'), q_id) as place, count(*) over () as n from s)
      select q_id, case when place <= greatest(1, round_even(n * 0.1, 0)) then 'dev' else 'train' end as part from x""",
    "split_doc": SPLIT_DOC,
    "shard": "select q_id, place from (select q_id, row_number() over (order by sample_pos) as place from s) where (place - 1) % 4 = 1",
    "recall_by_bucket": "with b as (" + _buckets("validation") + ") " + " union all ".join(f"select '{f}' as family, {e} as bucket, {_EVAL} from b group by 1, 2" for f, e in _families.items()),
    "bucket_proportions": _shares("validation", tuple(_families)),
    "weighted_proxy": "with b as (" + _buckets("validation") + "), e as (" + " union all ".join(f"select '{f}' as family, {_families[f]} as bucket, {_EVAL} from b group by 1, 2" for f in _OPEN)
      + "), w as (" + _shares("test", _OPEN) + """), m as (select w.*, case when evaluated > 0 then recall_at_5 end as r from w left join e on e.family = w.family and e.bucket = w.bucket)
      select family, round(coalesce(sum(case when r is not null then share * r end) / nullif(sum(case when r is not null then share end), 0), 0.0::double), 6) as weighted,
        round(sum(share * coalesce(r, 0.0::double)), 6) as strict, round(coalesce(sum(case when r is not null then share end), 0.0::double), 6) as coverage from m group by 1""",
    "modality_preference": """with l as (select q_id, quote_id, arg_max(modality, cand_idx) as modality from c group by all),
      m as (select b.q_id, count(*) filter (where l.modality = 'text') as t, count(*) filter (where l.modality <> 'text') as i from bmtop b join l on l.q_id = b.q_id and l.quote_id = b.quote_id group by 1),
      x as (select array_to_string(list_sort(types), '|') as types_key, coalesce(t, 0) as t, coalesce(i, 0) as i from s left join m on m.q_id = s.q_id)
      select types_key, count(*) as n, cast(sum(t) as bigint) as text_cnt, cast(sum(i) as bigint) as image_cnt,
        round(coalesce(sum(t)::double / nullif(sum(t) + sum(i), 0), 0.0::double), 4) as text_share, round(sum(t)::double / count(*), 4) as text_avg from x group by 1""",
    "dataset_stats": """with n as (select q_id, count(*) as c, count(*) filter (where modality = 'text') as t from c group by 1)
      select split, count(*) as n, count(distinct doc_name) as docs, round(avg(coalesce(c, 0)), 3) as avg_candidates, round(avg(coalesce(t, 0)), 3) as avg_text,
        round(avg(coalesce(c, 0) - coalesce(t, 0)), 3) as avg_image from s left join n on n.q_id = s.q_id group by 1""",
    "top_question_types": "select question_type as value, count(*) as n from s group by 1 order by n desc, min(sample_pos), value limit 10",
    "top_modalities": "select value, count(*) as n from (select sample_pos, unnest(types) as value from s) group by 1 order by n desc, min(sample_pos), value limit 10",
    "domain_balance": """with n as (select coalesce(nullif(domain, ''), 'unknown') as domain, count(*) as n from s where split = 'train' group by 1)
      select domain, n, round(sum(n) over ()::double / (count(*) over () * n), 6) as weight, round(sqrt(sum(n) over ()::double / (count(*) over () * n)), 6) as root from n""",
    "document_counts": f"select doc_name, n, {_FREQ} as bucket from (select doc_name, count(*) as n from s group by 1)",
    "weight_sweep": f"""with g(grid_pos, bm25_weight, dense_weight, memory_weight, type_score_weight) as (values {", ".join(f"({i}, {', '.join(f'{w}::double' for w in ws)})" for i, ws in enumerate(itertools.product(*_SWEPT)))}),
      x as (select g.grid_pos, f.q_id, quote_id, gold, row_number() over (partition by grid_pos, f.q_id order by
              round(bm25_weight * bm25_norm + dense_weight * dense_norm + memory_weight * memory_norm + type_score_weight * type_score_norm, 6) desc, cand_idx) as rank
            from fm f cross join g where f.split = 'validation' qualify rank <= 5),
      a as (select grid_pos, q_id, list(quote_id) as answer, any_value(gold) as gold from x group by 1, 2),
      r as (select grid_pos, round(coalesce(avg({_RECALL}), 0.0::double), 6) as recall from a group by 1)
      select cast(g.grid_pos as int) as grid_pos, bm25_weight, dense_weight, memory_weight, type_score_weight, recall from r join g on g.grid_pos = r.grid_pos order by recall desc, g.grid_pos limit 20""",
    "fusion_grid": f"select w, round(recall, 6) as recall from ({_FUSION_RECALLS})",
    "pair_examples": """with p as (select r.q_id, r.cand_idx, is_gold, score from ref r join sc on sc.q_id = r.q_id and sc.cand_idx = r.cand_idx and method = 'bm25'),
      g as (select * from p where q_id in (select q_id from p where is_gold)),
      h as (select *, row_number() over (partition by q_id order by round(score, 6) desc, cand_idx) as n from g where not is_gold),
      d as (select *, row_number() over (partition by q_id order by md5(q_id || ':' || cand_idx || ':42'), cand_idx) as m from h where n > 6)
      select q_id, cand_idx, 1::int as label, 'positive' as kind, 3.0::double as weight from g where is_gold union all
      select q_id, cand_idx, 0::int, 'hard', 1.3::double from h where n <= 6 union all select q_id, cand_idx, 0::int, 'random', 1.0::double from d where m <= 2""",
    "submission_rows": "select s.q_id, sample_pos, array_to_string(coalesce(answer[1:5], []), ' ') as gold_quotes from s left join ab on ab.q_id = s.q_id and method = 'dense'",
    "image_paths": r"""with x as (select q_id, cand_idx, img_path, regexp_extract(img_path, '([^/]*)$', 1) as name from c where img_path is not null),
      e as (select distinct case when cand_idx % 2 = 0 then '/data/' || img_path else '/data/images/' || name end as path from x)
      select q_id, cand_idx, case when '/data/' || img_path in (from e) then '/data/' || img_path when '/data/images/' || name in (from e) then '/data/images/' || name
        when '/data/images/images/' || name in (from e) then '/data/images/images/' || name when '/data/' || name in (from e) then '/data/' || name else '/data/' || img_path end as resolved from x""",
}


def _scope(suffix: str, who: str) -> dict[str, str]:
    """The common tables over the stated query set, over other questions instead."""
    names = ("qp", "np", "nb", "ns", "nn")
    return {n + suffix: re.sub(r"\b(asked|qp|np|nb|ns|nn)\b", lambda m: who if m[1] == "asked" else m[1] + suffix, CTES[n]) for n in names}


CTES["devq"] = "select * from s where split = 'validation'"
CTES["testq"] = "select * from s where split = 'test'"
CTES |= {**_scope("d", "devq"), **_scope("t", "testq"), **_scope("a", "s")}
CTES["sima"] = f"""with n3 as (select *, row_number() over (partition by q_id order by round(similarity, 6) desc, ref_pos) as n from qpa qualify n <= 3),
      g as (select n3.q_id, k.key_name, k.key, sum(similarity) as votes from n3 join rk k on k.q_id = n3.ref_q_id where k.is_gold group by all)
      select pool.q_id, pool.cand_idx, coalesce(t.similar, 0.0::double) as sim from pool left join
        (select k.q_id, k.cand_idx, sum({_weights(_SIMILAR).replace("case key_name", "case k.key_name")} * votes) as similar from pk k join g on g.q_id = k.q_id and g.key_name = k.key_name and g.key = k.key group by all) t
        on t.q_id = pool.q_id and t.cand_idx = pool.cand_idx"""
CTES["votesa"] = f"""with g as (select n.q_id, n.score, r.content_md5, r.page_id, r.layout_id, r.raw_type from nna n join ref r on r.q_id = n.ref_q_id where r.is_gold)
  select p.q_id, p.cand_idx, {", ".join(f"coalesce(sum(case when {w} then {'0.2::double * ' if k == 'raw_type' else ''}g.score end), 0.0::double) as {k}_votes" for k, w in _vote_where.items())}
  from pool p left join g on g.q_id = p.q_id group by all"""
CTES["facta"] = """select a.q_id, coalesce(max(case when n_rank = 1 then score end), 0.0::double) as neighbor_best, coalesce(avg(score), 0.0::double) as neighbor_mean3,
        count(score) / 3.0::double as neighbor_share, case when count(score) > 0 then 1.0::double else 0.0::double end as neighbor_has
      from s a left join nna on nna.q_id = a.q_id group by a.q_id"""
_votes = [f"{v}_votes" for v in _VOTE_KINDS]
_flags = {
    "is_text": "modality = 'text'", "is_image": "modality = 'image'", "is_table": "raw_type = 'table'", "is_figure": "raw_type = 'figure'",
    "is_chart": "raw_type = 'chart'", "is_picture": "raw_type = 'image'", "has_page": "page_id is not null", "has_layout": "layout_id is not null",
}
_context = lambda place: f"(case when {place} is null then 0.0::double else max(context) over (partition by q_id, {place}) end)"
_top_of = lambda x: f"max({x}) over (partition by q_id)"
QUERIES["ranker_features"] = f"""with f0 as (select fm.*, sim, {", ".join(_votes)} from fm join sima on sima.q_id = fm.q_id and sima.cand_idx = fm.cand_idx
        join votesa on votesa.q_id = fm.q_id and votesa.cand_idx = fm.cand_idx),
      f1 as (select *, {scaled("sim")} as similar_norm, {", ".join(f"{scaled(v)} as {v}_norm" for v in _votes)}, 0.5::double * bm25_norm + 0.5::double * dense_norm as context from f0),
      f2 as (select *, 0.2::double * bm25_norm + 0.65::double * dense_norm + 0.55::double * memory_norm + 0.15::double * similar_norm as base,
        {_context("page_id")} as pc, {_context("layout_id")} as lc from f1),
      f3 as (select *, {scaled("base")} as base_norm, {scaled("pc")} as page_context_norm, {scaled("lc")} as layout_context_norm from f2),
      pp as (select q_id, cand_idx, {", ".join(f"max(case when key_name = '{k}' then precision end) as p_{k}" for k in _PRECISIONS)} from pr group by all),
      f4 as (select f3.*, {", ".join(f"coalesce(p_{k}, 0.0::double) as p_{k}" for k in _PRECISIONS)}, neighbor_best, neighbor_mean3, neighbor_share, neighbor_has,
        {", ".join(f"(case when {e} then 1.0::double else 0.0::double end) as {n}" for n, e in _flags.items())}, len({tokens("content")})::double as n_tokens,
        1 - percent_rank() over (partition by f3.q_id order by round(bm25, 6) desc, f3.cand_idx) as bm25_pct,
        1 - percent_rank() over (partition by f3.q_id order by round(dense, 6) desc, f3.cand_idx) as dense_pct
        from f3 left join pp on pp.q_id = f3.q_id and pp.cand_idx = f3.cand_idx join facta on facta.q_id = f3.q_id)
      select q_id, cand_idx, is_gold, {", ".join(f"round({c}, 6) as {c}" for c in _FEATURES)},
        round(greatest(neighbor_best, {_top_of("precise_norm")}, {_top_of("exact_votes_norm")}, {_top_of("page_type_votes_norm")}), 6) as overlap_confidence,
        round(0.2::double * bm25_norm + 0.65::double * dense_norm, 6) as semantic,
        round(0.55::double * memory_norm + 0.35::double * precise_norm + 0.15::double * similar_norm + 0.6::double * exact_votes_norm + 0.25::double * page_votes_norm
          + 0.2::double * page_type_votes_norm + 0.1::double * layout_votes_norm + 0.1::double * page_context_norm, 6) as overlap from f4"""
_ABLATED = {
    "bm25": "select q_id, rank, quote_id from bmtop", "dense": _top("fu", "dense"), "hybrid": QUERIES["hybrid_top5"], "typed_hybrid": QUERIES["typed_hybrid_top5"],
    "memory": QUERIES["memory_top5"], "memory_hybrid": QUERIES["memory_hybrid_top5"],
    "typed_memory_hybrid": _top("fm", "0.35::double * bm25_norm + 0.65::double * dense_norm + 0.55::double * memory_norm + 0.35::double * type_score_norm"),
    "reranker_only": QUERIES["reranker_only"], "dual_reranker": QUERIES["dual_rerank_stub"].replace(" + 0.15::double * similar_norm", "").replace("from fs)", "from fm)"),
    "llm": QUERIES["llm_top5"], "image": QUERIES["image_top5"],
}
QUERIES["ablation"] = " union all ".join(
    f"""select '{name}' as method, {_EVAL} from (select s.*, {_RECALL} as recall from s left join
      (select q_id, list(quote_id order by rank) as answer from ({sql}) group by 1) a on a.q_id = s.q_id where split = 'validation')"""
    for name, sql in _ABLATED.items()
)


def _coverage(k: int = 5) -> str:
    """The greedy choice as k steps, each over what those before it chose."""
    visual = "['table', 'figure', 'chart', 'image']"
    parts = [f"""f as (select *, 0.35::double * bm25_norm + 0.65::double * dense_norm as sc from fu),
      o as (select *, {best("sc")} as rank, count(*) over (partition by q_id) as n, {scaled("sc")} as base from f),
      need as (select q_id from o where rank <= {k} and question_type = 'Comparative' and list_contains(expected, 'text') and list_has_any(expected, {visual}) group by 1
        having count(*) filter (where modality = 'text') = 0 or count(*) filter (where modality = 'image') = 0 or (count(page_id) >= 3 and count(distinct page_id) <= 2)),
      t as (select q_id, cand_idx, page_id, layout_id, modality, raw_type, round(0.7::double * base + 0.3::double * case when n <= 1 then 1.0::double else 1 - (rank - 1)::double / (n - 1) end, 6) as score
        from o where q_id in (from need))"""]
    for i in range(1, k + 1):
        chosen = " union all ".join(f"select * from p{j}" for j in range(1, i)) or "select *, 0 as step from t where false"
        count = lambda what: f"(select count(*) from c{i} where c{i}.q_id = t.q_id and {what})"
        parts.append(f"""c{i} as materialized ({chosen}),
      a{i} as (select t.*, round(score - 0.08::double * ({count(f"c{i}.page_id = t.page_id")} > 0)::int - 0.04::double * ({count(f"c{i}.layout_id = t.layout_id")} > 0)::int
          - 0.05::double * greatest({count(f"c{i}.modality = t.modality")} - 1, 0) - 0.03::double * {count(f"c{i}.raw_type = t.raw_type")}
          + 0.12::double * (t.modality = 'text' and {count(f"c{i}.modality = 'text'")} = 0)::int + 0.12::double * (t.modality = 'image' and {count(f"c{i}.modality = 'image'")} = 0)::int, 9) as adjusted
        from t where (q_id, cand_idx) not in (select q_id, cand_idx from c{i})),
      p{i} as materialized (select q_id, cand_idx, page_id, layout_id, modality, raw_type, score, {i} as step from a{i} qualify row_number() over (partition by q_id order by adjusted desc, cand_idx) = 1)""")
    union = " union all ".join(f"select * from p{i}" for i in range(1, k + 1))
    return f"""with {", ".join(parts)} select o.q_id, o.rank, o.quote_id from o where rank <= {k} and q_id not in (from need)
      union all select p.q_id, cast(step as bigint), o.quote_id from ({union}) p join o on o.q_id = p.q_id and o.cand_idx = p.cand_idx"""


QUERIES["coverage_top5"] = _coverage()


def _memory_of_part(strategy: str, parts: str) -> str:
    """Memory's recall with the questions of ``parts`` held out of the reference."""
    return f"""select '{strategy}' as strategy, {_EVAL}, count(distinct doc_name) as num_dev_docs from (
      with p as ({parts}), tk as (select k.* from rk k join p on p.q_id = k.q_id where part = 'train'), mm as ({_memory_of("tk")}),
        hk as (select k.* from rk k join p on p.q_id = k.q_id where part = 'dev'), r as ({_recalled("hk", "mm", None)}),
        d as (select * from fu where q_id in (select q_id from p where part = 'dev')),
        m as (select d.q_id, d.cand_idx, coalesce(sum({_weights(_MEMORY)} * precision * support), 0.0::double) as memory from d left join r on r.q_id = d.q_id and r.cand_idx = d.cand_idx group by all),
        x as (select d.*, {scaled("memory", "d.q_id")} as memory_norm from d join m on m.q_id = d.q_id and m.cand_idx = d.cand_idx),
        a as (select q_id, list(quote_id order by rank) as answer from ({_top("x", "0.35::double * bm25_norm + 0.55::double * memory_norm")}) group by 1)
      select s.*, {_RECALL} as recall from s join p on p.q_id = s.q_id and part = 'dev' left join a on a.q_id = s.q_id)"""


_of_train = lambda sql: re.sub(r"\bfrom s\b", "from (select * from s where split = 'train') s", sql)
QUERIES["eval_splits"] = " union all ".join(
    _memory_of_part(n, _of_train(QUERIES[q])) for n, q in (("doc", "split_doc"), ("row", "split_row"), ("mixed", "split_mixed"), ("domain", "split_domain"))
)


def oracle_sql() -> dict[str, str]:
    return {name: f"with {', '.join(f'{k} as ({v})' for k, v in _needed(sql))} select * from ({sql}) as result" for name, sql in QUERIES.items()}


def _needed(sql: str) -> list[tuple[str, str]]:
    """The common tables a query reads, directly or through others, each after those it reads."""
    out: dict[str, str] = {}

    def visit(text: str) -> None:
        for name, body in CTES.items():
            if name not in out and re.search(rf"\b(?:from|join)\s+\(*{name}\b", text):
                visit(body)
                out[name] = body

    visit(sql)
    return list(out.items()) or [("one", "select 1")]
