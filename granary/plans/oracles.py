"""What each query must equal, in SQL."""

from __future__ import annotations

_TRIM = r"regexp_replace({}, '^[\s\p{{Z}}]+|[\s\p{{Z}}]+$', '', 'g')"
_TOKENS = r"list_filter(regexp_extract_all(lower(coalesce({}, '')), '[\p{{L}}\p{{N}}_]+'), lambda t: regexp_full_match(t, '[a-z0-9]+'))"
_SENTENCES = f"list_filter(list_transform(string_split(regexp_replace({_TRIM.format('text')}, '([.!?])[\\s\\p{{Z}}]+', '\\1' || chr(1), 'g'), chr(1)), lambda s: {_TRIM.format('s')}), lambda s: s <> '')"
_CHUNKS = f"""chunks as (
  select doc_id, row_number() over (partition by doc_id order by s) - 1 as chunk_index, text from (
    select doc_id, s, {_TRIM.format("substring(text, s + 1, 1000)")} as text
    from documents, unnest(range(0, greatest(0, length(text) - 201) + 1, 800)) as t(s)) where text <> '')"""
_STOP = "['annual','report','quarterly','current','form','corp','section','sections','statement','income','q','k']"
_NORMAL = "regexp_replace(lower({}), '[^a-z0-9]+', '', 'g')"
_NAME_TOKENS = f"list_filter(list_distinct(regexp_extract_all(lower({{}}), '[a-z0-9]+')), lambda t: not list_contains({_STOP}, t))"
_CLEAN = r"trim(regexp_replace({}, '[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]', ' ', 'g'), ' ')"


def _bm25(name: str, rows: str, key: str, asked: str = "benchmark") -> str:
    """Common table expressions up to `name`: item_id, rank, key, score."""
    n = name
    return f"""{n}_bags as (select {key}, {_TOKENS.format("text")} as bag from {rows}),
{n}_size as (select count(*) as n, sum(len(bag)) / count(*) as mean from {n}_bags),
{n}_tf as (select {key}, length, term, count(*) as tf from (select {key}, len(bag) as length, unnest(bag) as term from {n}_bags) group by all),
{n}_df as (select term, count(*) as df, ln(any_value(n) - count(*) + 0.5) - ln(count(*) + 0.5) as idf0 from {n}_tf, {n}_size group by term),
{n}_idf as (select term, case when idf0 < 0 then 0.25 * (select avg(idf0) from {n}_df) else idf0 end as idf from {n}_df),
{n}_asked as (select item_id, term, count(*) as qtf from (select item_id, unnest({_TOKENS.format("text")}) as term from {asked}) group by all),
{n}_scored as (select item_id, {key}, round(sum(qtf * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * length / mean))), 6) as score
  from {n}_tf join {n}_asked using (term) join {n}_idf using (term), {n}_size group by item_id, {key}),
{n} as (select item_id, cast(row_number() over (partition by item_id order by score desc, {key}) as int) as rank, {key}, score from {n}_scored
  qualify row_number() over (partition by item_id order by score desc, {key}) <= 5)"""


def _vectors(name: str, rows: str, key: str, asked: str = "benchmark") -> str:
    """Common table expressions up to `name`: item_id, rank, key, score, by the cosine of hashed counts of tokens."""
    n, bucket = name, "cast('0x' || substr(md5(term), 1, 8) as bigint) % 64"
    return f"""{n}_d as (select {key}, {bucket} as slot, count(*)::double as x from (select {key}, unnest({_TOKENS.format("text")}) as term from {rows}) group by all),
{n}_q as (select item_id, {bucket} as slot, count(*)::double as x from (select item_id, unnest({_TOKENS.format("text")}) as term from {asked}) group by all),
{n}_dn as (select {key}, sqrt(sum(x * x)) as norm from {n}_d group by all), {n}_qn as (select item_id, sqrt(sum(x * x)) as norm from {n}_q group by all),
{n}_dots as (select item_id, {key}, sum(q.x * d.x) as dot from {n}_q q join {n}_d d using (slot) group by all),
{n}_near as (select q.item_id, {", ".join("d." + c.strip() for c in key.split(","))}, round(coalesce(dot, 0) / (q.norm * d.norm), 6) + 0.0 as score from {n}_qn q cross join {n}_dn d
  left join {n}_dots s on s.item_id = q.item_id and {" and ".join(f"s.{c.strip()} = d.{c.strip()}" for c in key.split(","))}),
{n} as (select item_id, cast(row_number() over (partition by item_id order by score desc, {key}) as int) as rank, {key}, score from {n}_near
  qualify row_number() over (partition by item_id order by score desc, {key}) <= 5)"""


def _metrics(name: str, ranked: str, bodies: str, key: str, k: int = 5) -> str:
    return f"""{name}_hits as (select b.item_id, r.rank, case when r.rank is null then null else cast(coalesce(contains(d.text, b.text), false) as int) end as hit
  from benchmark b left join {ranked} r on r.item_id = b.item_id and r.rank <= {k} left join {bodies} d using ({key})),
{name} as (select item_id, cast(coalesce(max(hit), 0) as double) as hit_rate, round(coalesce(1.0::double / min(case when hit = 1 then rank end), 0), 6) as mrr,
  round(coalesce(sum(hit), 0)::double / {k}, 6) as precision, round(coalesce(sum(hit / log2(rank + 1)), 0), 6) as ndcg from {name}_hits group by item_id)"""


_DOT = "list_sum(list_transform(list_zip({0}, {1}), lambda p: p[1]::double * p[2]::double))"
_GAPS = f"""pairs as (select label, vec_id, embedding as b, lag(embedding) over (partition by label order by vec_id) as a from embeddings),
gaps as (select label, vec_id, round({_DOT.format("a", "b")} / (sqrt({_DOT.format("a", "a")}) * sqrt({_DOT.format("b", "b")})), 6) as sim from pairs where a is not null)"""
_COSINE = f"{_DOT.format('q.v', 'e.embedding')} / (sqrt({_DOT.format('q.v', 'q.v')}) * sqrt({_DOT.format('e.embedding', 'e.embedding')}))"
_L2 = "list_sum(list_transform(list_zip(q.v, e.embedding), lambda p: (p[1]::double - p[2]::double) * (p[1]::double - p[2]::double)))"


def _nearest(asked: str, distance: str, order: str) -> str:
    return f"""asked as ({asked}),
near as (select q.query_id, e.vec_id, round({distance}, 6) as distance from asked q, embeddings e where e.vec_id <> q.query_id),
top as (select query_id, cast(row_number() over (partition by query_id order by distance {order}, vec_id) as int) as rank, vec_id, distance from near
  qualify row_number() over (partition by query_id order by distance {order}, vec_id) <= 5)"""


_EACH_100 = "select vec_id as query_id, embedding as v from embeddings where vec_id % 100 = 0"
_CUT = "(gaps join (select label, quantile_cont(sim::double, 0.7) as threshold from gaps group by label) using (label))"
_JUDGE = """judged as (select lang, source, count(*) as rows, round(sum(coalesce(quality, 0))::double / count(*), 4) as avg_quality, round(sum(coalesce(1 - toxic, 0))::double / count(*), 4) as avg_clean,
  round(sum(case when quality = 1 and toxic = 0 then 1 else 0 end)::double / count(*), 4) as avg_pass, lang || '+' || source as label
  from documents left join labels using (doc_id) where coalesce(lang, '') <> '' and coalesce(source, '') <> '' group by lang, source)"""



def _walk(key: str, most: int, overlap: int) -> str:
    """ranges(key, first, last) of a walk over `sizes` (key, n) that closes a range at `most` or at a mark (key, i, brk)."""
    return f"""walk({key}, i, size, first, last) as (
  select {key}, cast(0 as bigint), cast(1 as bigint), cast(null as bigint), cast(null as bigint) from sizes
  union all
  select {key}, i, case when closes then least({overlap}, grown) else grown end, case when closes then i - grown + 1 end, case when closes then i end from (
    select w.{key}, w.i + 1 as i, w.size + 1 as grown, w.size + 1 >= {most} or (coalesce(m.brk, false) and w.size + 1 >= 2) as closes
    from walk w join sizes s on s.{key} = w.{key} left join marks m on m.{key} = w.{key} and m.i = w.i + 1 where w.i + 1 < s.n)),
ranges as (select {key}, first, last from walk where last is not null union all select w.{key}, w.i - w.size + 1, w.i from walk w join sizes s on s.{key} = w.{key} and w.i = s.n - 1)"""


_PAIRS = f"""split as materialized (select doc_id, text, {_SENTENCES} as s from documents where text is not null), sizes as materialized (select doc_id, len(s) as n from split where len(s) > 0),
each_one as (select doc_id, i, list_distinct({_TOKENS.format("s[i + 1]")}) as bag from (select doc_id, s, unnest(range(len(s))) as i from split)),
pairs as materialized (select a.doc_id, a.i, len(list_intersect(a.bag, b.bag)) as shared, greatest(len(list_distinct(list_concat(a.bag, b.bag))), 1) as either from each_one a join each_one b on b.doc_id = a.doc_id and b.i = a.i + 1)"""


def _text_chunks(least: int) -> str:
    return f"""numbered as (select doc_id, row_number() over (partition by doc_id order by last, first) - 1 as chunk_index, first, last from ranges)
select doc_id, chunk_index, array_to_string(list_slice(s, first + 1, last + 1), ' ') as text from numbered join split using (doc_id) where len(s) >= {least}
union all select doc_id, 0, text from split where len(s) < {least}"""


_HALVES = f"""bags as (select item_id, {_TOKENS.format("text")} as bag from benchmark),
one as (select item_id, array_to_string(list_slice(bag, 1, len(bag) // 2), ' ') as text from bags), two as (select item_id, array_to_string(list_slice(bag, len(bag) // 2 + 1, len(bag)), ' ') as text from bags)"""
_FLAT = r"regexp_replace(c.text, '[\s\p{Z}]+', ' ', 'g')"

_AGENTIC = f"""with recursive {_PAIRS}, marks as (select doc_id, i, shared < 0.15 * either as brk from pairs), {_walk("doc_id", 6, 1)}, {_text_chunks(3)}"""
_SEMANTIC = f"""with recursive {_PAIRS}, sims as (select doc_id, i, round(shared::double / either, 6) as sim from pairs),
cuts as (select doc_id, round(quantile_cont(sim, 0.7), 9) as cut from sims group by doc_id),
marks as (select doc_id, i, sim <= cut as brk from sims join cuts using (doc_id)), {_walk("doc_id", 8, 2)}, {_text_chunks(2)}"""


def _pipeline(chunks: str, method: str, k: int = 5) -> str:
    """The metrics of a pipeline, as common table expressions; a hit is a document that has the item's text."""
    name, rows, key = f"p_{chunks[0]}{method[0]}", "chunks" if chunks == "fixed" else chunks, "doc_id, chunk_index"
    ranked = _bm25(name, rows, key) if method == "bm25" else _vectors(name, rows, key, "asked_for" if method == "hyde" else "benchmark")
    return ranked + ", " + _metrics(name + "_m", name, "documents", "doc_id", k)


def _rounds(rounds: int) -> str:
    """found1, found2, ...: what each round of a search with feedback finds first, the terms of a round from all hits before it."""
    base = _bm25("r1", "documents", "doc_id")
    out = [base, "found1 as (select item_id, 1 as round, rank, doc_id, score from r1)"]
    for n in range(2, rounds + 1):
        before = " union all ".join(f"select item_id, doc_id from found{i}" for i in range(1, n))
        out.append(f"""hits{n} as (select distinct h.item_id, h.doc_id from ({before}) h where h.item_id in (select item_id from found{n - 1})),
more{n} as (select item_id, term from (select item_id, term, round(sum(tf) * any_value(idf), 6) as w from hits{n} join r1_tf using (doc_id) join r1_idf using (term) group by item_id, term)
  qualify row_number() over (partition by item_id order by w desc, term) <= 5),
asked{n} as (select item_id, term, cast(sum(qtf) as bigint) as qtf from (select item_id, term, qtf from r1_asked where item_id in (select item_id from found{n - 1}) union all select item_id, term, 1 from more{n}) group by all),
scored{n} as (select item_id, doc_id, round(sum(qtf * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * length / mean))), 6) as score from r1_tf join asked{n} using (term) join r1_idf using (term), r1_size group by item_id, doc_id),
ranked{n} as (select item_id, cast(row_number() over (partition by item_id order by score desc, doc_id) as int) as rank, doc_id, score from scored{n} qualify row_number() over (partition by item_id order by score desc, doc_id) <= 5),
found{n} as (select item_id, {n} as round, rank, doc_id, score from ranked{n} r where not exists (select 1 from ({before}) h where h.item_id = r.item_id and h.doc_id = r.doc_id))""")
    return ", ".join(out)


_NINE = ", ".join(_pipeline(c, m) for c in ("fixed", "semantic", "agentic") for m in ("traditional", "bm25", "hyde"))

SQL: dict[str, str] = {
    "doc_load": f"select doc_id, length({_TRIM.format('text')}) as n_chars_trimmed from documents where length({_TRIM.format('text')}) > 0",
    "tokens_df": f"""with tf as (select doc_id, term, count(*) as tf from (select doc_id, unnest({_TOKENS.format("text")}) as term from documents) group by all)
select term, count(*) as df, cast(sum(tf) as bigint) as cf from tf group by term""",
    "sentences": f"select doc_id, len(s) as n_sentences, coalesce(list_max(list_transform(s, lambda x: length(x))), 0) as max_len from (select doc_id, {_SENTENCES} as s from documents)",
    "chunks_fixed": f"with {_CHUNKS} select doc_id, chunk_index, text from chunks",
    "chunks_agentic_fallback": f"""with s as (select doc_id, {_SENTENCES} as s from documents), n as (select doc_id, s, len(s) as n from s where len(s) > 0),
r as (select doc_id, s, n, j from n, unnest(range(0, cast(ceil(n / 6.0) as bigint))) as t(j))
select doc_id, j as chunk_index, len(part) as n_sent, array_to_string(part, ' ') as text from (select doc_id, j, list_slice(s, greatest(0, 6 * j - 1) + 1, least(6 * j + 5, n - 1) + 1) as part from r)""",
    "adjacent_similarity": f"with {_GAPS} select label, vec_id, sim from gaps",
    "semantic_breakpoints": f"with {_GAPS} select label, round(threshold, 6) as threshold, count(case when sim <= threshold then 1 end) as n_breaks from {_CUT} group by label, threshold",
    "chunks_semantic_ranges": f"""with recursive {_GAPS},
marks as (select label, row_number() over (partition by label order by vec_id) - 1 as i, sim <= threshold as brk from {_CUT}),
sizes as (select label, max(i) + 2 as n from marks group by label), {_walk("label", 8, 2)}
select label, row_number() over (partition by label order by last, first) - 1 as chunk_index, first, last from ranges""",
    "chunks_agentic_eval": _AGENTIC,
    "chunks_semantic": _SEMANTIC,
    "bm25_topk": f"with {_bm25('top', 'documents', 'doc_id')} select * from top",
    "bm25_chunk_topk": f"with {_CHUNKS}, {_bm25('top', 'chunks', 'doc_id, chunk_index')} select item_id, rank, doc_id, cast(chunk_index as int) as chunk_index, score from top",
    "vector_topk_l2": f"with {_nearest(_EACH_100, _L2, 'asc')} select * from top",
    "vector_topk_cosine": f"with {_nearest(_EACH_100, _COSINE, 'desc')} select * from top",
    "hyde_topk": "with means as (select label, pos, avg(x) as x from (select label, unnest(range(1, len(embedding) + 1)) as pos, unnest(embedding)::double as x from embeddings) group by all), "
    + _nearest("select -label - 1 as query_id, list(x order by pos) as v from means group by label", _L2, "asc")
    + " select cast(-query_id - 1 as int) as label, rank, vec_id, distance from top",
    "hybrid_union": f"""with {_CHUNKS}, {_bm25("a", "chunks", "doc_id, chunk_index")}, {_vectors("b", "chunks", "doc_id, chunk_index")}
select item_id, 'bm25' as method, rank, doc_id, cast(chunk_index as int) as chunk_index, score from a union all select item_id, 'vector', rank, doc_id, cast(chunk_index as int), score from b""",
    "vector_chunk_topk": f"with {_CHUNKS}, {_vectors('top', 'chunks', 'doc_id, chunk_index')} select item_id, rank, doc_id, cast(chunk_index as int) as chunk_index, score from top",
    "retrieval_metrics": f"with {_bm25('top', 'documents', 'doc_id')}, {_metrics('m', 'top', 'documents', 'doc_id')} select * from m",
    "pipeline_summary": f"""with recursive {_CHUNKS}, asked_for as (select item_id, 'The following passage answers the question. ' || text as text from benchmark),
semantic as materialized ({_SEMANTIC}), agentic as materialized ({_AGENTIC}), {_NINE},
rows as ({" union all ".join(f"select '{c}+{m}' as pipeline, * from p_{c[0]}{m[0]}_m" for c in ("fixed", "semantic", "agentic") for m in ("traditional", "bm25", "hyde"))})
select pipeline, round(avg(hit_rate), 4) as hit_rate, round(avg(mrr), 4) as mrr, round(avg(precision), 4) as precision, round(avg(ndcg), 4) as ndcg from rows group by pipeline""",
    "retrieval_metrics_multi": f"""with {_nearest(_EACH_100, _COSINE, "desc")},
rel as (select a.vec_id as query_id, a.label, (select count(*) from embeddings b where b.label = a.label) - 1 as n from embeddings a where a.vec_id % 100 = 0),
h as (select rel.query_id, n, rank, cast(e.label = rel.label as int) as hit from rel left join top using (query_id) left join embeddings e using (vec_id))
select query_id, round(coalesce(sum(hit), 0)::double / 5, 6) as precision, round(case when n > 0 then coalesce(sum(hit), 0)::double / n else 0 end, 6) as recall, cast(coalesce(max(hit), 0) as double) as hit_rate,
round(coalesce(1.0::double / min(case when hit = 1 then rank end), 0), 6) as mrr, round(case when n > 0 then coalesce(sum(hit / log2(rank + 1)), 0) / list_sum(list_transform(range(1, least(n, 5) + 1), lambda i: 1 / log2(i + 1))) else 0 end, 6) as ndcg
from h group by query_id, n""",
    "source_matching": f"""with names as (select distinct p_name as name, {_NORMAL.format("p_name")} as a, {_NAME_TOKENS.format("p_name")} as ta from part),
files as (select distinct file, {_NORMAL.format("file")} as b, {_NAME_TOKENS.format("file")} as tb from (select p_brand || ' ' || p_type as file from part)),
hits as (select name, file from names, files where a <> '' and b <> '' and (contains(a, b) or contains(b, a) or len(list_intersect(ta, tb)) >= 3))
select name, coalesce(string_agg(file, '|' order by file), '') as files, cast(count(file) as int) as n_files, case count(file) when 1 then 'confident' when 0 then 'unmatched' else 'ambiguous' end as match_class
from names left join hits using (name) group by name""",
    "url_filename": r"""select url, digest || '_' || regexp_replace(case when ends_with(lower(tail), '.pdf') then tail else digest || '.pdf' end, '[^\p{L}\p{N}._-]', '_', 'g') as file_name
from (select distinct url, sha256(url)[1:12] as digest, url_decode(regexp_extract(url, '^[^:]+://[^/?#]*(?:[^?#]*/)?([^/?#;]+)(?:;[^/?#]*)?/*(?:[?#]|$)', 1)) as tail from pages where url is not null)""",
    "dedupe_first": "select sha256(text) as digest, doc_id, source from documents qualify row_number() over (partition by text order by doc_id) = 1",
    "last_message": "select conv_id, arg_max(text, turn) as text from conversations group by conv_id",
    "context_blocks": f"""with t as (select conv_id, text, row_number() over (partition by conv_id order by turn, text) as i from conversations)
select conv_id, string_agg('[' || i || '] ' || substring({_CLEAN.format("text")}, 1, 2000), chr(10) || chr(10) order by i) as context,
coalesce(string_agg('[Context ' || i || ']' || chr(10) || substring(text, 1, 1200), chr(10) || chr(10) order by i) filter (i <= 3), '[No retrieved context]') as judge_context from t group by conv_id""",
    "previews": rf"""with t as (select doc_id, text, {_TRIM.format("regexp_replace(text, '[" + chr(92) + "s" + chr(92) + "p{Z}]+', ' ', 'g')")} as flat from documents)
select doc_id, case when length(flat) > 240 then substring(flat, 1, 240) || '...' else flat end as preview, substring(text, 1, 500) || '...' as cut,
case when length(text) <= 500 then text else regexp_replace(substring(text, 1, 497), '[\s\p{{Z}}]+$', '') || '...' end as for_prompt, sha256({_CLEAN.format("text")}) as clean_sha256 from t""",
    "name_tokens": f"select p_partkey, {_NORMAL.format('p_type')} as normal, array_to_string(list_sort({_NAME_TOKENS.format(chr(40) + 'p_type || chr(32) || p_name' + chr(41))}), ' ') as tokens from part",
    "judge_summary": f"with {_JUDGE} select * from judged",
    "judge_rank": f"with {_JUDGE} select lang, label, avg_pass, cast(row_number() over (partition by lang order by avg_pass desc, label) as int) as place from judged",
    "sample_rows": "select doc_id from documents order by (doc_id * 48271 + 42) % 2147483647, doc_id limit 50",
    "pipeline_rerun": f"""with {_CHUNKS}, asked_for as (select item_id, 'The following passage answers the question. ' || text as text from benchmark),
{_pipeline("fixed", "traditional")}, {_pipeline("fixed", "bm25", 3)}, {_pipeline("fixed", "hyde", 3)}
select pipeline, round(avg(hit_rate), 4) as hit_rate, round(avg(mrr), 4) as mrr, round(avg(precision), 4) as precision, round(avg(ndcg), 4) as ndcg from (
select 'fixed+traditional' as pipeline, * from p_ft_m union all select 'fixed+bm25', * from p_fb_m union all select 'fixed+hyde', * from p_fh_m) group by pipeline""",
    "search_rounds": f"with {_rounds(2)} select * from found1 union all select * from found2",
    "index_growth": f"with {_bm25('top', 'documents', 'doc_id')} select * from top",
    "collection_growth": """with r as (select source, count(*) as n_rows, max(doc_id) as last from documents group by source)
select source, n_rows, last, 'Total chunks in knowledge base: ' || (select count(*) from documents) as report from r""",
    "planner_answers": """with e as (select event_id, event_id % 10 as a, event_id % 7 - 1 as c, user_id % 4 as kind, cast(event_id % 9 as bigint) as b, event_type = 'click' as fenced from events),
k as (select event_id, fenced, case when kind = 3 then [a, 1, c] else [a, c] end as plain, case kind when 0 then [a, b, c] when 1 then [a, b, c] when 2 then [] else [a, 1, c] end as turned from e)
select event_id, array_to_string(list_filter(plain, lambda x: x >= 0 and x < 8), ',') as breaks, case when fenced then '' else array_to_string(list_filter(turned, lambda x: x >= 0 and x < 8), ',') end as coerced from k""",
    "json_breaks": "select event_id, array_to_string(list_filter([event_id % 10, event_id % 7 - 1], lambda b: b >= 0 and b < 8), ',') as breaks from events",
    "unique_sources": f"with {_bm25('top', 'documents', 'doc_id')} select item_id, count(distinct source) as n_sources from top join documents using (doc_id) group by item_id",
    "bm25_padded": f"""with {_bm25("top", "documents", "doc_id")}, every as (select b.item_id, d.doc_id, coalesce(s.score, 0) as score from benchmark b, documents d left join top_scored s on s.item_id = b.item_id and s.doc_id = d.doc_id)
select item_id, cast(row_number() over (partition by item_id order by score desc, doc_id) as int) as rank, doc_id, score from every qualify row_number() over (partition by item_id order by score desc, doc_id) <= 5""",
    "agentic_retrieval": f"""with {_HALVES}, {_bm25("a", "documents", "doc_id", "one")}, {_bm25("b", "documents", "doc_id", "two")}, {_vectors("f", "documents", "doc_id")},
calls as (select item_id, doc_id, rank, 1 as call from a union all select item_id, doc_id, rank, 2 from b),
found as (select * from calls qualify row_number() over (partition by item_id, doc_id order by call, rank) = 1),
everything as (select * from found union all select item_id, doc_id, rank, 0 from f where item_id not in (select item_id from calls))
select item_id, cast(row_number() over (partition by item_id order by call, rank, doc_id) as int) as place, cast(call as int) as call, doc_id from everything""",
    "grounded_answers": f"""with {_bm25("top", "documents", "doc_id")}, hits as (select t.item_id, rank, coalesce(source, '') as source, text from top t join documents using (doc_id)),
blocks as (select item_id, count(*) as n, string_agg('[' || rank || '] ' || substring({_CLEAN.format("text")}, 1, 2000), chr(10) || chr(10) order by rank) as block, string_agg(source, ',' order by rank) as sources from hits group by item_id)
select b.item_id, sha256('Question: ' || b.text || chr(10) || chr(10) || 'Context:' || chr(10) || coalesce(block, '')) as answer_sha256, coalesce(n, 0) as n_contexts, coalesce(sources, '') as sources from benchmark b left join blocks using (item_id)""",
    "search_reports": f"""with {_CHUNKS}, {_bm25("top", "chunks", "doc_id, chunk_index")},
lines as (select t.item_id, rank, '[' || rank || '] score=' || printf('%.4f', floor(score * 10000 + 0.5) / 10000) || ' | source=' || coalesce(source, 'unknown') || ' | chunk=' || t.chunk_index || chr(10) || case when length(flat) > 300 then substring(flat, 1, 300) || '...' else flat end || chr(10) || '-' as line
  from top t join (select c.doc_id, c.chunk_index, {_TRIM.format(_FLAT)} as flat from chunks c) c on c.doc_id = t.doc_id and c.chunk_index = t.chunk_index join documents d on d.doc_id = t.doc_id)
select item_id, 'Top ' || count(*) || ' BM25 chunks:' || chr(10) || string_agg(line, chr(10) order by rank) as report from lines group by item_id""",
    "usable_questions": f"""with c as (select conv_id, {_TRIM.format("arg_min(text, turn)")} as question, {_TRIM.format("arg_max(text, turn)")} as answer,
list_sort(list_distinct(list(case when role = 'user' then role || '_' || (turn % 3) else role end))) as names from conversations group by conv_id)
select conv_id, question, answer, array_to_string(names, ',') as evidence_doc_names from c where question <> '' and answer <> ''""",
    "eval_examples": "select text as query, cast(item_id as varchar) as reference_answer, '' as source from benchmark where coalesce(text, '') <> ''",
    "judge_metrics": "select doc_id, coalesce(quality, -1)::double as good, (1 - toxic)::double as clean, cast(coalesce(quality = 1 and toxic = 0, false) as int) as passed from labels",
    "score_means": "select lang, round(avg(quality), 6) as quality, round(avg(toxic), 6) as toxic from documents left join labels using (doc_id) group by lang",
    "question_prompts": "select doc_id, sha256('Document (' || coalesce(source, '') || '):' || chr(10) || substring(text, 1, 4000) || chr(10) || chr(10) || 'Write 2 questions that only this document answers.') as prompt_sha256 from documents where length(text) >= 200",
}
