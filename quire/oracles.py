"""The SQL that the library's queries are held against, for DuckDB over the same tables."""

from __future__ import annotations

from . import config
from .queries import BRANCH_WORDS, DAY, MODEL, PATTERNS, RULES


def _quote(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def _fold(x: str) -> str:
    # The tables have accented Latin letters only; the full decomposition is held against Unicode's in the tests.
    return f"lower(regexp_replace(strip_accents({x}), '[^\\x00-\\x7F]', '', 'g'))"


def _tokens(x: str) -> str:
    return f"regexp_extract_all({_fold(x)}, '[a-zA-Z0-9_/-]{{3,}}')"


def _terms(x: str) -> str:
    stop = ", ".join(map(_quote, config.STOP_WORDS))
    return f"list_filter(list_distinct({_tokens(x)}), lambda t: not list_contains([{stop}], t))"


def _squash(x: str) -> str:
    return f"trim(regexp_replace({x}, '\\s+', ' ', 'g'))"


def _any(x: str, words) -> str:
    return "(" + " or ".join(f"contains(lower({x}), {_quote(w)})" for w in words) + ")"


def _all(x: str, words) -> str:
    return "(" + " and ".join(f"contains(lower({x}), {_quote(w)})" for w in words) + ")"


def _count(x: str, words) -> str:
    return "(" + " + ".join(f"contains(lower({x}), {_quote(w)})::bigint" for w in words) + ")"


def _list(words) -> str:
    return "[" + ", ".join(map(_quote, words)) + "]::varchar[]"


def _sentences(x: str) -> str:
    return f"string_split(regexp_replace({_squash(x)}, '([.!?])\\s+', concat('\\1', chr(1)), 'g'), chr(1))"


def _hashed(name: str, source: str, text: str) -> str:
    """CTEs that give <name>(k, v): hashed vectors of source (k, text); slots must be there for others than `hv`."""
    slots = """slots as (select ('0x' || m[1:4])::int as slot, count(distinct k) as df from hv_t group by 1), size as (select count(text) as n from documents),
""" if name == "hv" else ""
    return f"""{name}_t as materialized (select k, md5(term) as m, count(*) as tf from (select k, unnest({_tokens(text)}) as term from {source}) group by all), {slots}{name}_d as (select k, ('0x' || m[5:6])::int as d, sum(case when m[7] < '8' then 1 else -1 end * tf * floor(1024 * ln((n + 1) / (coalesce(df, 0) + 1)))::bigint)::double as x from {name}_t cross join size left join slots on slot = ('0x' || m[1:4])::int group by all),
{name}_l as (select k, list(coalesce(x, 0.0) order by d) as l from (select k, d from {source}, range(256) r(d)) left join {name}_d using (k, d) group by k),
{name} as materialized (select k, list_transform(l, lambda x: x / case when list_inner_product(l, l) = 0 then 1 else sqrt(list_inner_product(l, l)) end) as v from {name}_l)"""


# Shared tables of the retrieval queries.
CHUNKS = f"""{_hashed("hv", "(select doc_id as k, text from documents)", "text")},
ch as (select doc_id as chunk_id, text, source as file, doc_id % 10 + 1 as page, doc_id // 10 as ordinal,
    case when doc_id % 7 = 0 then 'web' else 'pdf' end as source_type, 'https://example.com/' || doc_id as url, lang as title, date '{DAY}' as fetched_on, v as embedding
    from documents join hv on doc_id = k)"""
_THREE = "select item_id as qid, pos, case pos when 0 then text when 1 then substr(text, 1, 60) else substr(text, 61) end as text from benchmark, range(3) p(pos)"
_TWO = "select qid, 0 as pos, question as text from expanded0 union all select qid, 2, expansion from expanded0 join labelled0 using (qid) where two"


def _vectors(variants: str) -> str:
    return f"qt as (select qid * 10 + pos as k, * from ({variants})), {_hashed('qh', 'qt', 'text')}, qv as (select k // 10 as qid, k % 10 as variant_pos, v from qh)"


VECTORS = _vectors(_THREE)


def _hits(k: int, where: str = "true") -> str:
    return f"""{CHUNKS}, {VECTORS}, sc as (select qid, variant_pos, chunk_id, round(list_inner_product(v, embedding), 9) as score from qv, ch where {where}),
hits as (select *, row_number() over (partition by qid, variant_pos order by score desc, chunk_id) as hit_rank from sc qualify hit_rank <= {k})"""


FUSED = _hits(80) + """, fu as (select qid, chunk_id, max(score) + 0.03 * (count(distinct variant_pos) - 1) as semantic, count(distinct variant_pos) as matches, min(variant_pos * 100000 + hit_rank) as seen from hits group by 1, 2),
fused as (select *, row_number() over (partition by qid order by round(semantic, 9) desc, seen, chunk_id) as fused_rank from fu)"""
_RULES = ", ".join(f"({pos}, {_quote(text)}, {_list(some)}, {_list(every)})" for _, pos, text, some, every in RULES)
EXPANDED = f"""rules(pos, added, a_terms, e_terms) as (values {_RULES}),
ex as (select item_id as qid, text as question, (select string_agg(added, ' ' order by pos) from rules
    where len(a_terms) + len(e_terms) > 0 and (len(a_terms) = 0 or len(list_filter(a_terms, lambda t: contains(lower(b.text), lower(t)))) > 0) and len(list_filter(e_terms, lambda t: not contains(lower(b.text), lower(t)))) = 0) as added from benchmark b),
expanded as (select qid, question, case when added is null then question else concat(question, {_quote(config.EXPANSION_LEAD)}, added) end as expansion from ex)"""
LABELLED = EXPANDED + f""", labelled as (select qid, {_quote(config.LABELS[0] + " : ")} || question || case when {_fold(_squash("expansion"))} <> {_fold(_squash("question"))} then chr(10) || chr(10) || {_quote(config.LABELS[2] + " : ")} || expansion else '' end as query_text from expanded)"""
SCORED = f"""{FUSED}, {LABELLED},
asked as (select qid, unnest({_terms("query_text")}) as term from labelled),
tok as (select chunk_id, {_tokens("text")} as toks from ch where chunk_id in (select chunk_id from fused)),
sized as (select f.qid, f.chunk_id, len(t.toks) as l, count(*) over (partition by qid) as n, avg(len(t.toks)) over (partition by qid) as mean from fused f join tok t using (chunk_id)),
tfs as (select chunk_id, term, count(*) as tf from (select chunk_id, unnest(toks) as term from tok) group by 1, 2),
lex as (select s.qid, s.chunk_id, l, n, mean, tf, count(*) over (partition by s.qid, t.term) as df from sized s join tfs t using (chunk_id) join asked a on a.qid = s.qid and a.term = t.term),
raw as (select qid, chunk_id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * l / greatest(1.0, mean)))) as s from lex group by 1, 2),
norm as (select f.*, case when max(s) over (partition by f.qid) > 0 then coalesce(s, 0) / max(s) over (partition by f.qid) else 0.0 end as lexical from fused f left join raw r using (qid, chunk_id)),
fin as (select *, 0.7::double * semantic + 0.3::double * lexical as final from norm),
scored as (select fin.*, row_number() over (partition by qid order by round(final, 9) desc, fused_rank) as rank, c.text, c.file, c.page, c.ordinal, c.source_type, c.url, c.fetched_on from fin join ch c using (chunk_id))"""

_BOOST = f"""boosted as (select qid, chunk_id, final + case when n >= 4 then 0.35::double when n between 2 and 3 then 0.18::double else 0 end + case when contains(file, 'src1') then 0.2::double else 0 end + case when contains(file, 'src2') then -0.12::double else 0 end as final, rank as old
    from (select *, {_count("text", ("the", "ing", "tion", "on"))} as n from scored)),
ranked as (select qid, chunk_id, final, row_number() over (partition by qid order by round(final, 9) desc, old) as rank from boosted)"""
_BLOCK = """blocks as (select qid, file, rank, format('[Source {} | Document : {} | {}, chunk {}, score final {:.3f}, score FAISS {:.3f}, score lexical {:.3f}]', rank, file, case when source_type = 'web' then 'url ' || url || ', consulte le ' || fetched_on else 'page ' || page end, ordinal, final, semantic, lexical) || chr(10) || text as block from scored where rank <= 8),
costs as (select *, greatest(1, length(block) // 4) as cost from blocks)"""
_FIT = f"""{_BLOCK}, walk as (select q.qid, 0 as rank, 0::bigint as used, false as ok from (select distinct qid from costs) q
    union all select c.qid, c.rank, case when w.used + c.cost <= 1200 then w.used + c.cost else w.used end, w.used + c.cost <= 1200 from walk w join costs c on c.qid = w.qid and c.rank = w.rank + 1),
fit as (select c.* from costs c join walk w using (qid, rank) where w.ok)"""
_CONTEXT = """docs as (select qid, file, min(rank) as first, string_agg(block, chr(10) || chr(10) order by rank) as blocks from fit group by 1, 2),
ctx as (select qid, string_agg('## Document : ' || file || chr(10) || blocks, chr(10) || chr(10) order by first) as context from docs group by 1)"""
_CASES = """cases as (select b.item_id as qid, b.text as question, case when b.item_id % 5 <> 0 then [d.source, 'none'] end as docs, case when b.item_id % 4 <> 0 then [upper(string_split(b.text, ' ')[1]), string_split(b.text, ' ')[-1]] end as words from benchmark b join documents d on d.doc_id = b.item_id),
found as (select qid, list(distinct file) as files, lower(string_agg(text, chr(10) order by rank)) as whole from scored where rank <= 8 group by 1),
kept as (select c.*, list_filter(coalesce(docs, []), lambda d: coalesce(list_contains(files, d), false)) as docs_hits, list_filter(coalesce(words, []), lambda k: contains(coalesce(whole, ''), lower(k))) as keyword_hits from cases c left join found using (qid)),
metrics as (select qid, case when coalesce(len(docs), 0) = 0 then 1.0 else round_even(len(docs_hits) / len(docs), 2) end::double as doc_recall, case when coalesce(len(words), 0) = 0 then 1.0 else round_even(len(keyword_hits) / len(words), 2) end::double as keyword_recall, docs_hits, keyword_hits from kept)"""
_ANSWERS = f"""ans as (select conv_id || '-' || turn as qid, coalesce(text, '') || case when conv_id % 3 = 0 then ' [1]' when conv_id % 3 = 1 then ' Je ne sais pas.' else '' end as answer, conv_id from conversations where role = 'assistant'),
am as (select qid, list_filter(['THE', 'tion'], lambda t: contains(lower(answer), lower(t))) as facts, list_filter(['xyzzy', 'heon'], lambda t: contains(lower(answer), t)) as forbidden,
    conv_id % 2 <> 0 or regexp_matches(answer, '\\[\\d+\\]') as citation_ok, conv_id % 5 <> 0 or {_any("answer", config.UNKNOWN_SIGNALS)} as unknown_ok from ans),
metrics as (select qid, len(facts) = 2 and len(forbidden) = 0 and citation_ok and unknown_ok as ok, len(facts) / 2.0::double as facts_recall, citation_ok, unknown_ok, array_to_string(forbidden, ',') as forbidden from am)"""
_PLAIN = "pc as (select source as file, doc_id % 10 + 1 as page, case when doc_id % 7 = 0 then 'web' else 'pdf' end as source_type, 'u' || doc_id % 50 as url, case when doc_id % 9 = 0 then 'TABLEAU ' || text else text end as text from documents)"


def _title(x: str) -> str:
    words, letters, capitals = f"len(string_split({x}, ' '))", f"length(regexp_replace({x}, '[^\\p{{L}}]', '', 'g'))", f"length(regexp_replace({x}, '[^\\p{{Lu}}]', '', 'g'))"
    return f"""case when length({x}) < 4 or length({x}) > 90 or regexp_matches({x}, '^(\\||- |\\* |• )') or regexp_matches({x}, '(?i){config.TITLE_UNIT}') or {words} > 12 or {letters} < 3 then false
    when regexp_matches({x}, '^\\d+(\\.\\d+)*\\s+\\S+') then true when {capitals} > 0.65 * {letters} and {words} <= 10 then true
    else after_blank and not regexp_matches({x}, '[.!?;:]$') and {words} <= 9 end"""


LINES = f"""li as (select doc_id, unnest(string_split(regexp_replace(text, '\\n$', ''), chr(10))) as raw, generate_subscripts(string_split(regexp_replace(text, '\\n$', ''), chr(10)), 1) - 1 as line_no from documents),
sq as (select doc_id, line_no, {_squash("raw")} as line from li),
kl as (select *, coalesce(lag(line = '') over (partition by doc_id order by line_no), true) as after_blank from sq where not (lower(line) in ({", ".join(map(_quote, config.BOILERPLATE_LINES))}) or starts_with(lower(line), '©') or contains(lower(line), 'all rights reserved'))),
tl as (select doc_id, line_no, line, {_title("line")} as title from kl where line <> '')"""
SECTIONS = f"""{LINES}, sec as (select *, sum(title::int) over (partition by doc_id order by line_no) as section from tl),
grp as (select doc_id, section, coalesce(max(case when title then line end), '') as title, string_agg(case when not title then line end, ' ' order by line_no) as body from sec group by 1, 2),
fs as (select doc_id, row_number() over (partition by doc_id order by section) - 1 as pos, title, body from grp where coalesce(body, '') <> ''),
sections as (select * from fs union all select doc_id, 0, '', {_squash("text")} from documents where doc_id not in (select doc_id from fs) and {_squash("text")} <> '')"""


def _packed(source: str, key: str, text: str, size: int = 800, overlap: int = 2) -> str:
    """CTEs that give packed(key, seq, sub, chunk); the state is the buffer's first sentence and length."""
    carried = " ".join(f"when p.i - p.a >= {k} and list_sum(p.ls[p.i - {k - 1}:p.i]) + {k} + p.ls[p.i + 1] <= {size} then {k}" for k in range(overlap, 0, -1))
    return f"""src as (select {key}, {_squash(text)} as t from {source}), ss as (select {key}, list_filter({_sentences("t")}, lambda s: s <> '') as s from src where length(t) > {size}),
st as (select {key}, s, list_transform(s, lambda x: length(x)) as ls from ss),
walk(k, s, ls, i, a, n, fa, fb, hard) as (select {key}, s, ls, 0::bigint, 0::bigint, 0::bigint, null::bigint, null::bigint, false from st
  union all select k, s, ls, i + 1, case when l > {size} then i + 1 when n = 0 then i when n + 1 + l <= {size} then a else i - c end,
    case when l > {size} then 0 when n = 0 then l when n + 1 + l <= {size} then n + 1 + l else (case when c > 0 then list_sum(ls[i - c + 1:i]) + c else 0 end)::bigint + l end,
    case when n > 0 and (l > {size} or n + 1 + l > {size}) then a end, case when n > 0 and (l > {size} or n + 1 + l > {size}) then i end, l > {size}
  from (select p.*, p.ls[p.i + 1] as l, case {carried or "when false then 0"} else 0 end as c from walk p where p.i < len(p.s))),
out as (select k, i * 2 as seq, 0 as sub, array_to_string(s[fa + 1:fb], ' ') as chunk from walk where fa is not null
  union all select k, i * 2 + 1, g, substr(s[i], g * {size} + 1, {size}) from walk, range(0, 1000) r(g) where hard and g * {size} < length(s[i])
  union all select k, i * 2 + 1, 0, array_to_string(s[a + 1:i], ' ') from walk where i = len(s) and n > 0
  union all select {key}, 0, 0, t from src where length(t) <= {size}),
packed as (select k, row_number() over (partition by k order by seq, sub) - 1 as pos, chunk from out where trim(chunk) <> '' or seq = 0)"""


def _table_markdown() -> str:
    cells = f"list_transform(string_split(r, '|'), lambda c: {_squash('c')})"
    return f"""with t as (select doc_id, list_filter(list_transform(list_filter(string_split(text, chr(10)), lambda r: contains(r, '|')), lambda r: {cells}), lambda r: len(list_filter(r, lambda c: c <> '')) > 0) as rows from documents where contains(text, '|')),
w as (select doc_id, rows, list_max(list_transform(rows, lambda r: len(r))) as width from t),
f as (select doc_id, width, list_transform(rows, lambda r: '| ' || array_to_string(list_concat(r, list_transform(range(width - len(r)), lambda i: '')), ' | ') || ' |') as bars from w)
select doc_id, case when len(bars) >= 2 then array_to_string(list_concat([bars[1], '| ' || array_to_string(list_transform(range(width), lambda i: '---'), ' | ') || ' |'], bars[2:]), chr(10)) else '' end as markdown from f"""


def _html(x: str) -> str:
    from .sources.html import DROPPED

    x = f"regexp_replace({x}, '(?s)<!--.*?-->', ' ', 'g')"
    for name in DROPPED:
        x = f"regexp_replace({x}, '(?is)<{name}\\b.*?</{name}\\s*>', ' ', 'g')"
    return _squash(_unescape(f"regexp_replace({x}, '(?s)<[^>]*>', ' ', 'g')"))


def _unescape(x: str) -> str:
    for name, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&amp;", "&")):  # all that the tables have
        x = f"replace({x}, {_quote(name)}, {_quote(char)})"
    return x


def _html_title(html: str, url: str) -> str:
    found = _squash(_unescape(f"regexp_extract({html}, '(?is)<title\\b[^>]*>(.*?)</title\\s*>', 1)"))
    return f"coalesce(nullif({found}, ''), {url})"


def _allowed(url: str) -> str:
    host = f"regexp_replace(lower(regexp_extract({url}, '^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)', 1)), '^www\\.', '')"
    return f"({host} = 'example.com' or ends_with({host}, '.example.com') or {host} = 'example.org' or ends_with({host}, '.example.org'))"


def _adaptive() -> str:
    words = "case (conv_id + turn) % 4 when 0 then 'toutes capacites ' when 1 then 'watts ' when 2 then 'compare ' else '' end || coalesce(text, '')"
    return f"""with a as (select conv_id, turn, {words} as question from conversations where role = 'user'),
b as (select *, case when {_any("question", config.PORTFOLIO_WORDS)} and {_any("question", config.CAPACITY_WORDS)} then 'portfolio' when {_any("question", config.TECHNICAL_HINTS)} then 'technical' when {_any("question", config.SYNTHESIS_WORDS)} then 'synthesis' else 'standard' end as branch from a),
k as (select *, case branch when 'portfolio' then 12 when 'synthesis' then 10 else 8 end::bigint as top_k from b)
select conv_id, turn, branch, top_k, greatest(80, case branch when 'portfolio' then 160 when 'standard' then 60 else 120 end, 8 * top_k)::bigint as candidate_k, case branch when 'standard' then 0.1 when 'synthesis' then 0.05 else 0.0 end::double as min_score from k"""


def _windows() -> str:
    head = _quote(config.EXTRACT_PREFIX)
    return f"""with li as (select doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: {_squash('x')}), lambda x: x <> '') as ls from documents),
r as (select doc_id, len(ls) as n, ls, unnest(range(len(ls))) as i from li), h as (select *, count(*) over (partition by doc_id) as hits from r where regexp_matches(ls[i + 1], '\\d')),
w as (select *, sum(case when i - prev > 7 or prev is null then 1 else 0 end) over (partition by doc_id order by i) as window_no from (select *, lag(i) over (partition by doc_id order by i) as prev from h where hits >= 2)),
s as (select doc_id, any_value(ls) as ls, window_no::bigint as window_no, greatest(0, min(i) - 4) as a, least(max(n), max(i) + 3) as b from w where window_no <= 4 group by doc_id, window_no),
t as (select doc_id, window_no, array_to_string(ls[a + 1:b], chr(10)) as body from s)
select doc_id, window_no, {head} || (doc_id % 10 + 1) || ', bloc ' || window_no || chr(10) || chr(10) || body as excerpt from t where length(body) >= 80"""


def _bm25_topk() -> str:
    return f"""with asked as (select item_id as qid, unnest({_terms("text")}) as term from benchmark), tok as (select doc_id as chunk_id, {_tokens("text")} as toks from documents),
st as (select count(*) as n, avg(len(toks)) as mean from tok), p as (select chunk_id, l, term, count(*) as tf from (select chunk_id, len(toks) as l, unnest(toks) as term from tok) group by 1, 2, 3),
d as (select term, count(*) as df from p group by 1),
s as (select qid, chunk_id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * l / greatest(1.0, mean)))) as score from p join d using (term) join asked using (term), st group by 1, 2)
select qid, chunk_id, round(score, 6) as score, row_number() over (partition by qid order by round(score, 9) desc, chunk_id) as rank from s qualify rank <= 10"""


def _mentions() -> str:
    return "pats(name, pattern) as (values " + ", ".join(f"({_quote(n)}, {_quote(p)})" for n, p in PATTERNS) + "), ment as (select qid, name, list_sort(list(distinct rank))[1:4] as sources from scored, pats where rank <= 8 and regexp_matches(text, '(?i)' || pattern) group by 1, 2)"


def _search() -> str:
    """The whole chain with the variants that remain: the expansion has the vector of its position."""
    narrowed = SCORED.replace(VECTORS, _vectors(_TWO))
    extra = EXPANDED.replace("rules(", "rules0(").replace("from rules", "from rules0").replace("ex as", "ex0 as").replace("from ex)", "from ex0)").replace("expanded as", "expanded0 as") + f", labelled0 as (select qid, {_fold(_squash('expansion'))} <> {_fold(_squash('question'))} as two from expanded0)"
    tech = f"(regexp_matches(s.text, '\\d') and {_any('s.text', config.UNITS)})"
    return f"""with recursive {extra}, {narrowed},
t0 as (select s.*, b.text as question, {tech} as tech, contains(lower(s.text), 'watt') as watt, {_any("b.text", config.TECHNICAL_HINTS)} as asks, {_any("b.text", config.POWER_WORDS)} as power from scored s join benchmark b on b.item_id = s.qid where round(final, 9) >= 0.1),
t1 as (select *, coalesce(max((tech and asks)::int) over (partition by qid), 0) = 1 as narrow from t0), t2 as (select * from t1 where not narrow or tech),
t3 as (select *, coalesce(max((watt and narrow and power)::int) over (partition by qid), 0) = 1 as anyw from t2), t4 as (select * exclude (rank), row_number() over (partition by qid order by rank) as rank from t3 where not anyw or watt),
t5 as (select *, row_number() over (partition by qid, file order by rank) > 2 as over_cap from t4), t6 as (select * exclude (rank), row_number() over (partition by qid order by over_cap, rank) as rank from t5)"""


def _profile_search() -> str:
    """The chain over questions of all branches: each branch's own k and threshold, focus on files for one with watts, and a cap a file for portfolio questions."""
    sql = _search().replace("qualify hit_rank <= 80", "qualify hit_rank <= [160, 120, 120, 80][qid % 4 + 1]")
    sql = sql.replace("round(final, 9) >= 0.1", "round(final, 9) >= [0.0, 0.0, 0.05, 0.1][qid % 4 + 1]")
    sql = sql.replace("t3 as (select *,", "f0 as (select *, qid % 4 = 1 and narrow and (contains(file, 'src1') or contains(file, 'src2')) as focus from t2), f1 as (select *, coalesce(max(focus::int) over (partition by qid), 0) = 1 as anyf from f0), t3 as (select *,")
    sql = sql.replace("over (partition by qid), 0) = 1 as anyw from t2)", "over (partition by qid), 0) = 1 as anyw from f1 where not anyf or focus)")
    sql = sql.replace("order by rank) > 2 as over_cap", "order by rank) > 2 and qid % 4 = 0 as over_cap").replace("benchmark", "bq")
    head = f"with recursive bq as (select item_id, ({_list(BRANCH_WORDS)})[item_id % 4 + 1] || text as text from benchmark), "
    return sql.replace("with recursive ", head, 1) + " select qid, chunk_id, round(semantic, 6) as semantic, round(lexical, 6) as lexical, round(final, 6) as final, rank from t6 where rank <= [12, 8, 10, 8][qid % 4 + 1]"


def _filtered_search() -> str:
    sql = _search().replace("from qv, ch where true", "from qv, ch where source_type = 'pdf' and file in ('src1', 'src2', 'src3') and page >= 2").replace("qualify hit_rank <= 80", "")
    return sql.replace("order by rank) > 2 as over_cap", "order by rank) > 2 and false as over_cap") + " select qid, chunk_id, round(semantic, 6) as semantic, round(lexical, 6) as lexical, round(final, 6) as final, rank from t6 where rank <= 8"


def _asked() -> str:
    head = "\\[Source (\\d+) \\|[^\\]]*\\]\n(.*)"
    parts = f"{_FIT}, {_CONTEXT}".replace("from scored where", "from t6 where").replace("1200", "6000")
    return f"""{_search()}, {parts}, pr as (select item_id as qid, coalesce(context, '') as c from benchmark left join ctx on qid = item_id),
an as (select qid, regexp_extract(c, '(?s){head}', 1) as n, substr({_squash(f"regexp_extract(c, '(?s){head}', 2)")}, 1, 200) as start from pr),
li as (select qid, list(case when source_type = 'web' then url else '/app/static/pdfs/' || file || '#page=' || page end order by rank) as links from t6 where rank <= 8 group by 1)
select qid, case when n = '' then 'Je ne sais pas : aucun contexte disponible.' else start || ' [' || n || ']' end as answer, case when n = '' then 'Je ne sais pas : aucun contexte disponible.' else start || ' [[' || n || ']](' || links[n::int] || ')' end as linked, false as fallback from an left join li using (qid)"""


def _web(name: str) -> str:
    return f"{name} as (select page_id, url, {_html_title('html', 'url')} as title, {_html('html')} as body from pages)"


def _linked() -> str:
    return f"""with recursive {SCORED}, li as (select qid, list(case when source_type = 'web' then url else '/app/static/pdfs/' || file || '#page=' || page end order by rank) as u from scored where rank <= 4 group by 1)
select item_id as qid, case when item_id % 2 = 0 then 'See [[1]](' || u[1] || ') and [[2]](' || u[2] || '): ' || text else text || chr(10) || chr(10) || '[[1]](' || u[1] || ') [[2]](' || u[2] || ') [[3]](' || u[3] || ')' end as linked from benchmark join li on qid = item_id"""


def _pages() -> str:
    """No line of the tables has a number with a unit, so pages have tables and sections only."""
    return f"""with recursive {SECTIONS}, sk as (select doc_id * 100000 + pos as id, * from sections), {_packed('sk', 'id', 'body')},
md as ({_table_markdown()}), parts as (select doc_id, 0 as kind, length(markdown) + length({_quote(config.TABLE_PREFIX)} || '1, tableau 1') + 2 as n from md where markdown <> ''
union all select sk.doc_id, 2, length(p.chunk) + case when sk.title <> '' then length({_quote(config.TITLE_PREFIX)} || rtrim(substr(sk.title, 1, 90))) + 2 else 0 end from packed p join sk on sk.id = p.k)
select source || '-' || doc_id as file, count(*) as chunks, count(*) as last, sum(n)::bigint as chars from parts join documents using (doc_id) group by 1"""


def oracle_sql() -> dict[str, str]:
    scored = f"with recursive {SCORED} "
    r6 = lambda *c: ", ".join(f"round({x}, 6) as {x}" for x in c)
    rules = "chr(10) || chr(10)"
    from .operators.context import NO_CONTEXT
    from .operators.context import RULES as PROMPT_RULES

    head = _quote("Règles :\n" + "\n".join(f"- {r}" for r in PROMPT_RULES))
    return {
        "normalise": f"select doc_id, {_fold('text')} as folded from documents",
        "normalise_full": f"select doc_id, {_fold('text')} as folded from documents",
        "tokenise": f"select doc_id, len({_tokens('text')})::bigint as n_tokens, array_to_string({_tokens('text')}, ' ') as tokens from documents",
        "query_term_sets": f"select item_id as qid, array_to_string(list_sort({_terms('text')}), ' ') as terms from benchmark",
        "lexical_overlap": f"with q as (select item_id as qid, {_terms('text')} as ts from benchmark), a as (select qid, len(ts) as n, unnest(ts) as term from q), d as (select distinct doc_id as chunk_id, unnest({_tokens('text')}) as term from documents) select qid, chunk_id, round(count(*) / any_value(n), 6)::double as overlap from a join d using (term) group by 1, 2",
        "bm25_topk": _bm25_topk(),
        "kept_postings": _bm25_topk(),
        "sentences": f"select doc_id, generate_subscripts({_sentences('text')}, 1) - 1 as pos, unnest({_sentences('text')}) as sentence from documents",
        "hard_split": "select doc_id, g as pos, substr(text, g * 200 + 1, 200) as piece from documents, range(0, 100000) r(g) where g * 200 < length(text)",
        "chunks": f"with recursive {_packed('documents', 'doc_id', 'text')} select k as doc_id, pos, chunk from packed",
        "titles": f"with {LINES} select doc_id, line_no, line, title from tl",
        "sections": f"with {SECTIONS} select doc_id, pos, title, body from sections",
        "section_chunks": f"with recursive {SECTIONS}, sk as (select doc_id * 100000 + pos as id, * from sections), {_packed('sk', 'id', 'body')} select sk.doc_id, sk.pos as section, p.pos, rtrim(substr(sk.title, 1, 90)) as title, case when sk.title <> '' then {_quote(config.TITLE_PREFIX)} || rtrim(substr(sk.title, 1, 90)) || chr(10) || chr(10) || p.chunk else p.chunk end as chunk from packed p join sk on sk.id = p.k",
        "technical_windows": _windows(),
        "table_markdown": _table_markdown(),
        "pdf_files": "select 'source=' || source || '.pdf' as file, count(*) as pages, sum(length(coalesce(text, '')))::bigint as chars, (sum(octet_length(encode(coalesce(text, '')))) + 2 * count(*))::bigint as size from documents group by source",
        "flags": "with s as (select doc_id, case when doc_id % 9 <> 8 then [' Oui ', 'TRUE', '0', 'on', 'non', '', 'Yes', '1 1'][doc_id % 8 + 1] end as said from documents) select doc_id, coalesce(lower(trim(said)) in ('1', 'true', 'yes', 'oui', 'on'), false) as given, coalesce(lower(trim(said)) in ('1', 'true', 'yes', 'oui', 'on'), true) as otherwise from s",
        "detected_tables": """with p as (select p_partkey // 12 as page, p_partkey as k, p_name, p_brand, case when p_partkey % 5 <> 0 then p_size::varchar else '' end as size from part),
            l as (select page, list('| ' || k || ' | ' || p_name || ' | ' || p_brand || ' | ' || size || ' |' order by k) as bars from p group by 1)
            select page, 0::bigint as number, len(bars)::bigint as rows, array_to_string(list_concat([bars[1], '| --- | --- | --- | --- |'], bars[2:]), chr(10)) as markdown from l where len(bars) > 1""",
        "html_text": f"select page_id, {_html_title('html', 'url')} as title, {_html('html')} as text from pages",
        "allow_list": f"select page_id, {_allowed('url')} as allowed from pages",
        "web_upsert": "with n as (select case when page_id % 3 = 0 then url else url || '#new' end as url, page_id from pages) select url, page_id, 'new' as batch from n union all select url, page_id, 'old' from pages where url not in (select url from n)",
        "url_list": "select distinct url from pages where url <> ''",
        "delete_source": "select doc_id, source from documents where source <> (select min(source) from documents)",
        "vector_topk": f"with {_hits(10)} select qid, variant_pos::bigint as variant_pos, chunk_id, {r6('score')}, hit_rank from hits",
        "hashed_vectors": f"with {_hashed('hv', '(select doc_id as k, text from documents)', 'text')} select k as chunk_id, round(list_inner_product(v, v), 6) as norm, len(list_filter(v, lambda x: x <> 0)) as filled, round(v[8], 6) as eighth from hv",
        "cell_topk": f"with {_hits(10)} select qid, variant_pos::bigint as variant_pos, chunk_id, {r6('score')}, hit_rank from hits",
        "normalise_vectors": "select vec_id, round(embedding[1] * 3::double / sqrt(list_inner_product(embedding::double[], embedding::double[]) * 9), 6) as first, 1.0::double as norm from embeddings",
        "fusion": f"with {FUSED} select qid, chunk_id, {r6('semantic')}, matches, fused_rank from fused",
        "metadata_filter": "with " + _hits(5, "source_type = 'pdf' and file in ('src1', 'src2', 'src3') and page between 2 and 8") + f" select qid, variant_pos::bigint as variant_pos, chunk_id, {r6('score')}, hit_rank from hits",
        "hybrid_scores": f"{scored} select qid, chunk_id, {r6('semantic', 'lexical', 'final')}, rank from scored",
        "threshold": f"{scored} select qid, chunk_id, rank from scored where round(final, 9) >= 0.35",
        "adaptive": _adaptive(),
        "intents": f"select doc_id, regexp_matches(text, '\\d') and {_any('text', config.UNITS)} as technical, {_any('text', config.TECHNICAL_HINTS)} as hints, {_any('text', config.PORTFOLIO_WORDS)} and {_any('text', ('ing', 'tion'))} as both, {_all('text', ('the', 'and', 'with'))} as every, {_count('text', ('the', 'ing', 'tion', 'qu', 'ß'))} as terms, {_any('text', config.SYNTHESIS_WORDS)} as synthesis from documents",
        "expansion": f"with {EXPANDED} select qid, expansion from expanded",
        "query_variants": f"with {EXPANDED} select qid, 0::bigint as variant_pos, {_quote(config.LABELS[0])} as label, question as query_text from expanded union all select qid, 1, {_quote(config.LABELS[1])}, {_squash("question")} || ' .' from expanded union all select qid, 2, {_quote(config.LABELS[2])}, expansion from expanded where {_fold(_squash('expansion'))} <> {_fold(_squash('question'))}",
        "technical_filter": f"""{scored}, t0 as (select s.*, b.text as question, regexp_matches(s.text, '\\d') and {_any("s.text", config.UNITS)} as tech, contains(lower(s.file), 'src1') or contains(lower(s.file), 'src2') as focus, contains(lower(s.text), 'watt') as watt from scored s join benchmark b on b.item_id = s.qid),
            t1 as (select *, max((tech and qid % 2 = 0)::int) over (partition by qid) = 1 as narrow from t0), t2 as (select * from t1 where not narrow or tech), t3 as (select *, max((focus and narrow)::int) over (partition by qid) = 1 as anyf from t2),
            t4 as (select * from t3 where not anyf or focus), t5 as (select *, max((watt and narrow and {_any("question", config.POWER_WORDS)})::int) over (partition by qid) = 1 as anyw from t4) select qid, chunk_id, rank from t5 where not anyw or watt""",
        "boosts": f"{scored}, {_BOOST} select qid, chunk_id, {r6('final')}, rank from ranked",
        "diversify": f"{scored}, o as (select *, row_number() over (partition by qid, file order by rank) > 2 as over_cap from scored), d as (select qid, chunk_id, file, row_number() over (partition by qid order by over_cap, rank) as rank from o) select * from d where rank <= 12",
        "judge_order": f"""{scored}, c as (select *, count(*) over (partition by qid) as n from scored), o as (select *, case when qid % 4 <> 0 and n > 8 and rank <= least(n, 12) then list_position(list_filter(list_distinct_keep, lambda x: x <= least(n, 12)), rank) else 0 end as place
            from (select *, case qid % 5 when 0 then [1, 3, 4] when 1 then [2, 3, 1, 4] when 2 then [3, 1, 4] when 3 then [4, 3, 1] else [5, 3, 1, 4] end as list_distinct_keep from c)),
            p as (select *, coalesce(place, 0) as pl from o) select qid, chunk_id, round(case when pl > 0 then final + 0.3::double / pl else final end, 6) as final, row_number() over (partition by qid order by case when pl > 0 then 0 else 1 end, case when pl > 0 then pl else rank end) as rank from p""",
        "cross_scores": f"""{scored}, c as (select *, count(*) over (partition by qid) as n, case when chunk_id % 5 <> 0 then (chunk_id * 7 % 11) / 10.0::double else 0 end as cs from scored), p as (select *, n > 8 and rank <= 20 as inside, final + cs as boosted from c)
            select qid, chunk_id, round(case when inside then boosted else final end, 6) as final, row_number() over (partition by qid order by rank > 20, case when inside then -round(boosted, 9) else 0 end, rank) as rank from p""",
        "context_budget": f"{scored}, {_FIT} select qid, file, rank, cost::bigint as cost from fit",
        "prompts": f"{scored}, {_FIT}, {_CONTEXT} select item_id as qid, {head} || {rules} || 'Question :' || chr(10) || text || {rules} || 'Contexte :' || chr(10) || coalesce(context, {_quote(NO_CONTEXT)}) as prompt from benchmark left join ctx on qid = item_id",
        "product_mentions": f"{scored}, {_mentions()} select qid, name, array_to_string(sources, ',') as sources from ment",
        "mention_hints": f"{scored}, {_mentions()} select qid, 'Found :' || chr(10) || string_agg('- ' || name || ' : ' || array_to_string(list_transform(sources, lambda s: '[' || s || ']'), ', '), chr(10) order by name) as hints from ment group by 1",
        "cache_keys": f"select doc_id, sha256({_quote(MODEL)}::blob || '\\x00'::blob || encode(text)) as key from documents",
        "cache_misses": f"with k as (select doc_id, sha256({_quote(MODEL)}::blob || '\\x00'::blob || encode(text)) as key from documents) select distinct key from k where key not in (select key from k where doc_id % 3 = 0)",
        "token_estimates": "select doc_id, greatest(1, length(text) // 4)::bigint as tokens from documents",
        "union_corpus": f"select source as file, 'pdf' as source_type, length(text)::bigint as size, null::varchar as url from documents union all select {_html_title('html', 'url')}, 'web', length({_html('html')}), url from pages where {_allowed('url')}",
        "index_stats": f"with {_PLAIN} select count(distinct file) as documents, count(*) as chunks, count(distinct case when source_type = 'pdf' then file || '-' || page end) as pdf_pages, count(distinct case when source_type = 'web' then url end) as web_sources from pc",
        "inventory": f"""with {_PLAIN}, one as (select file, count(*) as chunks, count(distinct page) as pages, case when min(page) = max(page) then min(page)::varchar else min(page) || '-' || max(page) end as page_range, count(*) filter (where starts_with(text, {_quote(config.EXTRACT_PREFIX)})) as extracts, count(*) filter (where starts_with(text, 'TABLEAU')) as tables from pc group by 1),
            folder as (select 'src' || (2 * i) as file, 20 * i as size from range(11) r(i)) select file, coalesce(chunks, 0) as chunks, pages, page_range, extracts, tables, size, case when chunks is null then 'not indexed' when size is null then 'missing file' else 'indexed' end as status from one full join folder using (file)""",
        "distinct_sources": f"with {_PLAIN} select distinct file, source_type from pc",
        "eval_retrieval": f"{scored}, {_CASES} select qid, doc_recall, keyword_recall, array_to_string(docs_hits, ',') as docs_hits, array_to_string(keyword_hits, ',') as keyword_hits from metrics",
        "eval_summary": f"{scored}, {_CASES} select count(*) as questions, coalesce(round_even(avg(doc_recall), 3), 0)::double as mean_doc_recall, coalesce(round_even(avg(keyword_recall), 3), 0)::double as mean_keyword_recall from metrics",
        "eval_gate": f"{scored}, {_CASES} select round_even(avg(doc_recall), 3) >= 0.2 and round_even(avg(keyword_recall), 3) >= 0.3 and count(*) filter (where doc_recall = 0 or keyword_recall = 0) = 0 as passed, count(*) filter (where doc_recall = 0 or keyword_recall = 0) as misses from metrics",
        "eval_answers": f"with {_ANSWERS} select qid, ok, facts_recall, citation_ok, unknown_ok, forbidden from metrics",
        "answer_summary": f"with {_ANSWERS} select count(*) as questions, coalesce(round_even(avg(ok::int), 3), 0)::double as success_rate, coalesce(round_even(avg(facts_recall), 3), 0)::double as mean_facts_recall from metrics",
        "report_delta": """with m as (select round(avg(quality) filter (where doc_id % 2 = 0), 6) as qb, round(avg(quality) filter (where doc_id % 2 = 1), 6) as qc, round(avg(toxic) filter (where doc_id % 2 = 0), 6) as tb, round(avg(toxic) filter (where doc_id % 2 = 1), 6) as tc from labels),
            r as (select 'quality' as metric, qb as baseline, qc as current from m union all select 'toxic', tb, tc from m union all select 'latency', 0.0, 0.0) select metric, baseline::double as baseline, current::double as current, round(current - baseline, 6)::double as delta, format('{}{:.2f}', case when current - baseline >= 0 then '+' else '' end, (current - baseline)::double) as label from r""",
        "history": "select conv_id, turn, role from conversations order by conv_id desc, turn desc, role limit 10",
        "source_links": f"select doc_id as chunk_id, case when doc_id % 7 = 0 then 'https://example.com/' || doc_id else '/app/static/pdfs/' || source || '%20%C3%A9.pdf#page=' || (doc_id % 10 + 1) end as link, substr({_squash('text')}, 1, 40) as excerpt from documents",
        "export_markdown": f"{scored}, src as (select qid, string_agg(format('{{}}. {{}}, page {{}} (score {{:.3f}})', rank, file, page, final), chr(10) order by rank) as sources from scored where rank <= 4 group by 1) select item_id as qid, '# Question' || {rules} || text || {rules} || '## Réponse' || {rules} || 'A: ' || text || {rules} || '## Sources' || {rules} || coalesce(sources, '') as markdown from benchmark left join src on qid = item_id",
        "same_results": f"{scored}, {_BOOST}, a as (select qid, list(chunk_id order by rank) as x from scored where rank <= 5 group by 1), b as (select qid, list(chunk_id order by rank) as y from ranked where rank <= 5 group by 1) select qid, x = y as same from a join b using (qid)",
        "fallback_results": f"{scored} select qid, chunk_id, rank from scored where rank <= case when qid % 2 = 0 then 2 else 3 end",
        "hybrid_search": f"{_search()} select qid, chunk_id, {r6('semantic', 'lexical', 'final')}, rank from t6 where rank <= 8",
        "search_trace": f"{_search()} select qid, 'standard' as branch, 8::bigint as top_k, 80::bigint as candidate_k, 0.1::double as min_score, (1 + two::int)::bigint as variants, candidates, coalesce(results, 0) as results from labelled0 left join (select qid, count(*) as candidates from scored group by 1) using (qid) left join (select qid, count(*) as results from t6 where rank <= 8 group by 1) using (qid)",
        "search_stages": f"{_search()}, st as (select 0 as pos, 'variants' as stage, (select count(*) from labelled0) + (select count(*) from labelled0 where two) as rows union all select 1, 'hits', count(*) from hits union all select 2, 'candidates', count(*) from scored union all select 3, 'passed', count(*) from t4 union all select 4, 'results', count(*) from t6 where rank <= 8) select pos::bigint as pos, stage, rows from st",
        "answered_cases": f"""with aa as ({_asked()}), a as (select item_id as qid, case when item_id % 2 = 0 then 'Voir [1] : ' || text else answer end as answer, upper(string_split(text, ' ')[1]) as fact from benchmark left join aa on qid = item_id),
            m as (select *, contains(lower(answer), lower(fact)) as one, qid % 3 <> 0 or regexp_matches(answer, '\\[\\d+\\]') as citation_ok, qid % 7 <> 0 or {_any("answer", config.UNKNOWN_SIGNALS)} as unknown_ok from a)
            select qid, answer, false as ok, case when one then 0.5 else 0 end::double as facts_recall, citation_ok, unknown_ok from m""",
        "ingested_files": """with n as (select source, row_number() over (order by source) - 1 as k from (select distinct source from documents))
            select source as file, (sum(length(coalesce(text, ''))) + count(*))::bigint as chars from documents join n using (source) where k <> 1 and (k % 3 <> 0 or doc_id % 40 < 20) group by 1""",
        "profile_search": _profile_search(),
        "filtered_search": _filtered_search(),
        "asked_answers": _asked(),
        "linked_answers": _linked(),
        "pdf_page_chunks": _pages(),
        "streamed_chunks": f"with recursive {_web('wp')}, {_packed('wp', 'page_id', 'body')} select url, count(*) as chunks, sum(length(chunk))::bigint as chars from packed join wp on k = page_id group by 1",
        "published_chunks": f"with recursive {_web('wp')}, {_packed('wp', 'page_id', 'body')} select url, count(*) as chunks, sum(length(chunk))::bigint as chars from packed join wp on k = page_id group by 1",
        "search_texts": f"with {EXPANDED} select qid, case when qid % 2 = 0 then question || {rules} || 'Reformulation LLM pour recherche : mot ' || {_squash('question')} || {rules} || expansion else expansion end as search_text from expanded",
        "rewrite_cache": f"with k as (select item_id as qid, sha256('v2'::blob || '\\x00'::blob || 'generic'::blob || '\\x00'::blob || {_quote(MODEL)}::blob || '\\x00'::blob || encode(text)) as key from benchmark) select qid, case when qid % 3 = 0 then 'old' when not starts_with(key, '0') then 'new ' || key end as rewrite from k",
        "judge_cache": f"""{scored}, c as (select *, count(*) over (partition by qid) as n from scored), p as (select *, case when n > 8 and rank = 3 then 1 when n > 8 and rank = 1 then 2 else 0 end as pl from c)
            select qid, chunk_id, round(case when pl > 0 then final + 0.3::double / pl else final end, 6) as final, row_number() over (partition by qid order by case when pl > 0 then 0 else 1 end, case when pl > 0 then pl else rank end) as rank from p""",
        "cross_encoder": f"""{scored}, c as (select s.*, count(*) over (partition by qid) as n, (length(b.text) + length(substr({_squash('s.text')}, 1, 1800))) % 7 / 10.0::double as cs from scored s join benchmark b on item_id = qid), p as (select *, n > 8 and rank <= 20 as inside, final + cs as boosted from c)
            select qid, chunk_id, round(case when inside then boosted else final end, 6) as final, row_number() over (partition by qid order by rank > 20, case when inside then -round(boosted, 9) else 0 end, rank) as rank from p""",
        "result_lines": f"{scored} select qid, rank, format('[{{}}] {{}}, chunk {{}}', rank, case when source_type = 'web' then 'Web : ' || file || ' | ' || url else file || ', page ' || page end, ordinal) || chr(10) || format('score_final={{:.3f}} | faiss={{:.3f}} | lexical={{:.3f}}', final, semantic, lexical) || chr(10) || substr({_squash('text')}, 1, 60) as line from scored where rank <= 3",
        "delta_lines": """with m as (select round(avg(quality) filter (where doc_id % 2 = 0), 6) as qb, round(avg(quality) filter (where doc_id % 2 = 1), 6) as qc, round(avg(toxic) filter (where doc_id % 2 = 0), 6) as tb, round(avg(toxic) filter (where doc_id % 2 = 1), 6) as tc from labels),
            r as (select 'quality' as metric, '' as u, qb as b, qc as c from m union all select 'toxic', '', tb, tc from m union all select 'latency', 's', 0.0, 0.0) select metric, format('{} {:.2f}{} -> {:.2f}{}  {}{:.2f}{}', rpad(metric, 16, ' '), b::double, u, c::double, u, case when c - b >= 0 then '+' else '' end, (c - b)::double, u) as line from r""",
        "built_index": f"""with {_web('wp')}, a as (select 'pdf' as source_type, text as t, row_number() over () as id from documents where trim(text) <> '' union all select 'web', body, row_number() over () from wp where trim(body) <> '')
            select source_type, count(*) as chunks, count(*) as ids, round(avg(length(t) / sqrt(length(t)::double * length(t) + 1)), 6) as first, '{DAY}' as day from a group by 1""",
        "cache_stats": "select 'saved' as cache, true as found, count(distinct text) as entries, true as filled from documents union all select 'none', false, 0, false",
        "case_files": "select case when item_id % 2 = 0 then item_id::varchar else substr(text, 1, 40) end as qid, text as question, 'src1' as docs, true as no_words from benchmark",
        "answer_files": "select item_id::varchar as qid, text as answer from benchmark",
        "report_files": f"{scored}, {_CASES} select 8::bigint as top_k, count(*) over () as questions, qid, doc_recall, keyword_recall from metrics",
    }
