"""The queries of this package in SQL, for comparison."""

from __future__ import annotations

from ..functions.text import STOP_WORDS

#: Endings that Hangul words are split from.
PARTICLES = "으로부터 에서부터 에게서 이라도 으로써 으로서 처럼 까지 부터 에서 에게 한테 으로 라도 보다 마다 조차 밖에 하고 이나 은 는 이 가 을 를 에 의 도 와 과 로 만".split()

_STOP = "[" + ", ".join(f"'{w}'" for w in STOP_WORDS) + "]"
_BLANK = r"[\s\v\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}]"
_LINE_BLANK = r"[\t\v\f\r \x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}]"
_PICTOGRAPHS = r"[\x{a9}\x{ae}\x{203c}\x{2049}\x{2122}\x{2139}\x{2194}-\x{21aa}\x{231a}-\x{23ff}\x{25aa}-\x{25fe}\x{2600}-\x{27bf}\x{2934}\x{2935}\x{2b05}-\x{2b55}\x{3030}\x{303d}\x{3297}\x{3299}\x{1f000}-\x{1faff}]"


def _trim(x: str) -> str:
    return f"regexp_replace(regexp_replace({x}, '^{_BLANK}+', ''), '{_BLANK}+$', '')"


def _is_blank(x: str) -> str:
    return f"regexp_full_match({x}, '{_BLANK}*')"


def _terms(x: str) -> str:
    ending = f"([가-힣]{{2}})(?:{'|'.join(PARTICLES)})$"
    words = rf"regexp_extract_all({x}, '[\p{{L}}\p{{N}}]+')"
    hangul = f"list_filter(list_transform({words}, lambda w: lower(regexp_replace(w, '{ending}', '\\1'))), lambda w: not list_contains({_STOP}, w))"
    plain = f"list_filter(list_transform({words}, lambda w: lower(w)), lambda w: length(w) >= 2 and not list_contains({_STOP}, w))"
    return f"case when {x} is null then [] when regexp_matches({x}, '[ㄱ-ㆎ가-힣]') then {hangul} else {plain} end"


def _normal(x: str) -> str:
    """A tag in plain form."""
    t = f"regexp_replace({_trim(x)}, '^#', '')"
    t = f"case when starts_with({t}, '[[') and ends_with({t}, ']]') then substring({t}, 3, greatest(length({t}) - 4, 0)) else {t} end"
    t = f"split_part(split_part(split_part({t}, '|', 1), '#', 1), '^', 1)"
    return _trim(rf"regexp_replace({t}, '^({_PICTOGRAPHS}\x{{fe0f}}?{_BLANK}*)+', '')")


_BODY = rf"regexp_replace(text, '^---\r?\n(?s:.*?)\r?\n---{_BLANK}*\r?\n?', '')"
_TITLE = r"regexp_replace(split_part(note_path, '/', -1), '\.md$', '')"

_NOTE = "note as (select path, mtime, size, category_id, weight, indexed_at from (select *, row_number() over (partition by path order by indexed_at desc, mtime desc, size desc) as rn from notes) where rn = 1)"
_VEC = "vec as (select chunk_id, model, dim, min(vector) as vector from chunk_vectors where vector is not null and len(vector) = dim and len(list_filter(vector, lambda x: x is null or isnan(x))) = 0 group by all)"
_TAG = f"tag as (select distinct note_path, key from (select note_path, {_normal('tag_key')} as key from note_tags) where key <> '')"
_POST = f"words as (select chunk_id, unnest({_terms('text')}) as term from chunks), post as (select chunk_id, term, count(*) as tf from words group by all)"
_ASKED = f"""
asked as (select chunk_id as query_id, note_path as source_path, case when heading is not null and not {_is_blank("heading")} then heading else text end as text from chunks where chunk_id % 20 = 0),
asked_terms as (select query_id, unnest(list_distinct({_terms("text")})) as term from asked),
asked_total as (select query_id, len(list_distinct({_terms("text")})) as total from asked)"""
_BM25 = f"""
size as (select chunk_id, sum(tf)::double as n from post group by 1),
docs as (select term, count(*)::double as df from post group by 1),
mean as (select (select sum(tf) from post)::double / (select count(*) from chunks) as m, (select count(*) from chunks)::double as n),
bm as (select q.query_id, p.chunk_id, sum(ln((mean.n - df + 0.5::double) / (df + 0.5::double) + 1) * (tf * 2.2::double) / (tf + 1.2::double * (0.25::double + 0.75::double * s.n / mean.m))) as score
  from asked_terms q join docs d using (term) join post p using (term) join size s on s.chunk_id = p.chunk_id cross join mean group by 1, 2),
by_terms as (select * from (select query_id, chunk_id, score as bm25_score, row_number() over (partition by query_id order by round(score, 9) desc, chunk_id) as bm25_rank from bm) where bm25_rank <= 30)"""
_NEAR = """
mine as (select chunk_id, list_transform(vector, lambda x: x::double) as v from vec where model = 'note-embed-s' and dim = 64),
cosines as (select q.chunk_id as query_id, c.chunk_id, coalesce(list_dot_product(q.v, c.v) / nullif(sqrt(list_dot_product(q.v, q.v)) * sqrt(list_dot_product(c.v, c.v)), 0), 0) as cosine
  from mine q join mine c on q.chunk_id % 20 = 0 and list_dot_product(q.v, q.v) > 0),
by_vectors as (select * from (select query_id, chunk_id, cosine as vector_score, row_number() over (partition by query_id order by round(cosine, 9) desc, chunk_id) as vector_rank from cosines) where vector_rank <= 30)"""
_FUSED = """
fused as (select coalesce(b.query_id, v.query_id) as query_id, coalesce(b.chunk_id, v.chunk_id) as chunk_id, bm25_score, bm25_rank, vector_score, vector_rank,
  coalesce(1.0::double / (60 + bm25_rank), 0) + coalesce(1.0::double / (60 + vector_rank), 0) as rrf_score
  from by_terms b full join by_vectors v on b.query_id = v.query_id and b.chunk_id = v.chunk_id),
matched as (select f.query_id, f.chunk_id, count(*) as n from fused f join asked_terms q on q.query_id = f.query_id join post p on p.chunk_id = f.chunk_id and p.term = q.term group by 1, 2),
facts as (select f.*, c.note_path, c.heading, c.text, n.category_id, n.weight as note_weight, coalesce(m.n, 0) as matched_query_terms, t.total as query_terms_total,
  coalesce(list_bool_or(list_transform(list_distinct(w.terms), lambda x: contains(c.heading, x))), false) as heading_matched
  from fused f join chunks c using (chunk_id) join note n on n.path = c.note_path join asked_total t on t.query_id = f.query_id
  left join matched m on m.query_id = f.query_id and m.chunk_id = f.chunk_id left join (select query_id, list(term) as terms from asked_terms group by 1) w on w.query_id = f.query_id),
scored as (select *, rrf_score * note_weight * case when heading_matched then 1.2::double else 1 end * (1 + 0.5::double * coalesce(matched_query_terms / nullif(query_terms_total, 0), 0)) as final_score,
  rrf_score * note_weight * (1 + 0.5::double * coalesce(matched_query_terms / nullif(query_terms_total, 0), 0)) as weight_score,
  rrf_score * (1 + 0.5::double * coalesce(matched_query_terms / nullif(query_terms_total, 0), 0)) as rrf_only_score
  from facts where matched_query_terms >= least(2, query_terms_total) or coalesce(vector_score >= 0.6, false)),
best as (select *, regexp_replace(split_part(note_path, '/', -1), '\\.md$', '') as note_title from (select *, row_number() over (partition by query_id order by round(final_score, 9) desc, chunk_id) as place from scored) where place <= 30)"""
_HYBRID = f"with {_NOTE}, {_VEC}, {_POST}, {_ASKED}, {_BM25}, {_NEAR}, {_FUSED}"
_CANONICAL = _trim(rf"regexp_replace(regexp_replace(note_title, '{_BLANK}+[0-9]+$', ''), '{_BLANK}+복사본({_BLANK}+[0-9]+)?$', '')")
_LOG = f"""log as (select *, {_TITLE} as note_title from (select *, row_number() over (partition by query_id, chunk_id order by logged_at desc, note_path desc) as rn from hits where chunk_id is not null) where rn = 1)"""


def _dedupe(rows: str, single: str = "single") -> str:
    return f"""
{single}_paths as (select * from (select *, row_number() over (partition by query_id, note_path order by round(final_score, 9) desc, chunk_id) as a from {rows}) where a = 1),
{single} as (select * from (select *, row_number() over (partition by query_id, {_CANONICAL} order by note_weight desc, round(final_score, 9) desc, chunk_id) as b from {single}_paths) where b = 1)"""


_HEAD = rf"#{{1,6}}{_LINE_BLANK}+[^\n\r\x{{2028}}\x{{2029}}]*[^\n\r\x{{2028}}\x{{2029}}]{_LINE_BLANK}*"
_LINES = f"""
bodies as (select doc_id, {_BODY} as body from documents where text is not null),
lines as (select doc_id, unnest(string_split(body, chr(10))) as line, generate_subscripts(string_split(body, chr(10)), 1) as pos from bodies),
marked as (select *, regexp_full_match(line, '{_HEAD}') as head from lines),
numbered as (select *, sum(head::int) over (partition by doc_id order by pos) as place from marked),
section as (select doc_id, place, max(case when head then {_trim(f"regexp_extract(line, '^#{{1,6}}{_LINE_BLANK}+(.*)$', 1, 's')")} end) as heading, {_trim("coalesce(string_agg(case when not head then line end, chr(10) order by pos), '')")} as text from numbered group by 1, 2)"""
_FULL = "(length(a.rest) + length(x.rest) + 2 > 1500 and length(a.rest) > 0)"
_BUFFER = f"(case when {_FULL} or a.rest = '' then x.rest else a.rest || chr(10) || chr(10) || x.rest end)"
_WINDOWS = f"(case when length({_BUFFER}) > 1500 then (length({_BUFFER}) - 1) // 1500 else 0 end)"
_PACKED = f"""
fold as (select doc_id, place, heading, text, case when length(text) > 1500 then list_reduce(
  list_concat([{{'out': []::varchar[], 'rest': ''}}], list_transform(regexp_split_to_array(text, '\\n{{2,}}'), lambda p: {{'out': []::varchar[], 'rest': p}})),
  lambda a, x: {{'out': list_concat(a.out, case when {_FULL} and not {_is_blank("a.rest")} then [{_trim("a.rest")}] else [] end, list_transform(range({_WINDOWS}), lambda i: {_trim(f"substring({_BUFFER}, i * 1500 + 1, 1500)")})),
    'rest': substring({_BUFFER}, {_WINDOWS} * 1500 + 1)}}) end as f from section),
parts as (select doc_id, place, heading, case when f is null then [text] else list_concat(f.out, [{_trim("f.rest")}]) end as parts from fold),
piece as (select doc_id, place, heading, unnest(parts) as text, generate_subscripts(parts, 1) as i from parts)"""


_CLEAN = _PICTOGRAPHS[:-1] + r"\x{fe0f}]"
_KINDS = "kinds as (select note_path, key, case when length(key) % 2 = 0 then 'doctrine' else 'tag' end as kind from tag)"
_MEANS = """
key_at as (select kind, key, max(indexed_at) as embedded_at from kinds join note on note.path = note_path group by 1, 2),
key_each as (select kind, key, pos, round(avg(x::double), 9) as m from (select k.kind, k.key, unnest(v.vector) as x, generate_subscripts(v.vector, 1) as pos from kinds k join chunks c using (note_path) join vec v using (chunk_id) where v.model = 'note-embed-s' and v.dim = 64) group by 1, 2, 3),
key_vec as (select e.kind, e.key, list(m order by pos) as v, max(embedded_at) as embedded_at from key_each e join key_at using (kind, key) group by 1, 2)"""
_SYNONYMS = f"syn as (select key, unnest(list_distinct([min(heading), max(heading)])) as synonym from kinds join chunks using (note_path) where kind = 'doctrine' and heading is not null and not {_is_blank('heading')} group by key)"
_WRITTEN_BY_SYNONYM = f"""
stems as (select distinct key, list_distinct(t) as t from (select key, {_terms(f"regexp_replace(synonym, '{_CLEAN}', ' ', 'g')")} as t from syn) where len(t) > 1 or (len(t) = 1 and length(t[1]) >= 2)),
said as (select query_id, list_distinct({_terms("text")}) as body from clean),
exact as (select distinct f.query_id, k.kind, 'exact' as tier, f.key from found f join kinds k using (key)),
by_synonym as (select distinct query_id, 'doctrine' as kind, 'synonym' as tier, key from said join stems on list_has_all(body, t) anti join (select query_id, key from exact where kind = 'doctrine') using (query_id, key))"""
_BY_VECTOR = """
near as (select q.chunk_id as query_id, k.kind, k.key, coalesce(list_dot_product(q.v, k.v) / nullif(sqrt(list_dot_product(q.v, q.v)) * sqrt(list_dot_product(k.v, k.v)), 0), 0) as cosine
  from mine q join key_vec k on q.chunk_id % 20 = 0 and list_dot_product(q.v, q.v) > 0),
close as (select * from near where round(cosine, 9) >= case kind when 'doctrine' then 0.1 else 0.15 end),
by_vector as (select * from (select *, row_number() over (partition by query_id, kind order by round(cosine, 9) desc, key) as p from close anti join {known} using ({on})) where p <= 5)"""
_HEADS = rf"""
docs as (select doc_id, regexp_extract(text, '^---\r?\n((?s:.*?))\r?\n---{_BLANK}*(?:\r?\n|$)', 1) as head, {_BODY} as body from documents where text is not null),
said as (select *, {_trim(r"regexp_extract(head, '(?m)^tags:[ \t]*([^\r\n]*)', 1)")} as one, regexp_extract(head, '(?m)^tags:[ \t]*\r?\n((?:[ \t]*-[ \t]+[^\r\n]*(?:\r?\n|\z))+)', 1) as block from docs),
fields as (select doc_id, body, case when regexp_matches(one, '^\[.*\]$') then regexp_extract_all(substring(one, 2, length(one) - 2), '"[^"]*"|''[^'']*''|[^,]+') when one = '' then regexp_extract_all(block, '-[ \t]+([^\r\n]*)', 1) else string_split(one, ',') end as own,
  list_filter(regexp_extract_all(body, '(?:^|[\s\v])#([\p{{L}}\p{{N}}_\-/]+)', 1), lambda x: not regexp_full_match(x, '[0-9]+')) as marks from said),
own as (select doc_id, regexp_replace(regexp_replace({_trim("v")}, '^"(.*)"$', '\1'), '^''(.*)''$', '\1') as tag_key, i from (select doc_id, unnest(own) as v, generate_subscripts(own, 1) as i from fields)),
marks as (select doc_id, unnest(marks) as mark, generate_subscripts(marks, 1) as i from fields),
links as (select doc_id, unnest(list_transform(regexp_extract_all(body, '\[\[([^\]]+)\]\]', 1), lambda x: split_part(x, '|', 1))) as tag_key from fields)"""


def _variants(source: str, id: str) -> str:
    """The plain forms of links, and of their last parts."""
    whole = f"case when starts_with({_trim('tag_key')}, '[[') and ends_with({_trim('tag_key')}, ']]') then substring({_trim('tag_key')}, 3, greatest(length({_trim('tag_key')}) - 4, 0)) else {_trim('tag_key')} end"
    last = f"split_part(split_part({whole}, '|', 1), '/', -1)"
    filled = f"{source} where {_trim('tag_key')} <> ''"
    return f"select {id}, key from (select {id}, {_normal('tag_key')} as key from {filled} union select {id}, {_normal('part')} from (select {id}, {last} as part from {filled} and contains(split_part({whole}, '|', 1), '/'))) where key <> ''"


def oracle_sql() -> dict[str, str]:
    q = {}
    best = "(select n.path, f.group_id, f.weight, row_number() over (partition by n.path order by length(f.path) desc, f.pos) as rn from note n join folders f on starts_with(n.path, f.path) where not starts_with(n.path, '.trash/'))"
    q["scan_notes"] = f"with {_NOTE} select path, group_id as category_id, round(weight * 0.15::double, 6) as weight from {best} where rn = 1 and weight <> 0"
    q["reapply_folders"] = f"with {_NOTE}, best as (select * from {best} where rn = 1 and weight <> 0) select n.path, b.group_id as category_id, round(coalesce(b.weight * 0.15::double, 0), 6) as weight from note n left join best b on b.path = n.path"
    q["latest_notes"] = f"with {_NOTE} select path, mtime, size, indexed_at from note"
    q["suggest_folders"] = """with parts as (select distinct string_split(path, '/') as p from notes where contains(path, '/')), above as (select distinct array_to_string(p[1:n], '/') as folder from (select p, unnest(range(1, len(p))) as n from parts))
select folder from above where folder <> '' and contains(lower(folder), '20') order by folder limit 100"""
    q["folders_fingerprint"] = "select string_agg(x, ';' order by x) || '||.trash/' as fingerprint from (select concat_ws('|', path, group_id, weight) as x from folders)"
    q["folder_factors"] = "select path, round(least(greatest(weight, 0), 10) * 0.15::double, 6) as factor, least(greatest(weight, 0), 10) as weight from folders"
    q["plain_tags"] = f"with {_TAG} select note_path, key from tag"
    q["tag_lexicon"] = f"with {_TAG}, {_KINDS} select distinct key, kind from kinds union all select distinct key, 'both' from kinds"
    q["document_bodies"] = f"select doc_id, length({_BODY}) as characters from documents where text is not null"
    q["document_links"] = r"select doc_id, link, count(*) as links from (select doc_id, unnest(regexp_extract_all(text, '\[\[([^\]]+)\]\]', 1)) as link from documents) group by 1, 2"
    q["document_hashtags"] = r"select doc_id, tag, count(*) as times from (select doc_id, unnest(regexp_extract_all(text, '#([\p{L}\p{N}_\-/]+)', 1)) as tag from documents) group by 1, 2"
    whole = f"case when starts_with({_trim('tag_key')}, '[[') and ends_with({_trim('tag_key')}, ']]') then substring({_trim('tag_key')}, 3, greatest(length({_trim('tag_key')}) - 4, 0)) else {_trim('tag_key')} end"
    last = f"split_part(split_part({whole}, '|', 1), '/', -1)"
    q["link_variants"] = f"with t as (select distinct tag_key from note_tags), u as (select tag_key, {_normal('tag_key')} as key from t union select tag_key, {_normal('part')} from (select tag_key, {last} as part from t where contains(split_part({whole}, '|', 1), '/'))) select tag_key, key from u where key <> ''"
    q["document_sections"] = f"with {_LINES} select doc_id, place, heading, length(text) as characters from section"
    q["document_chunks"] = f"""with {_LINES}, {_PACKED},
filled as (select doc_id, place, heading, i, text from piece where not {_is_blank("text")})
select doc_id, row_number() over (partition by doc_id order by place, i) - 1 as ord, heading, text from filled"""
    q["postings"] = f"with {_POST} select chunk_id, term, tf from post"
    q["chunk_lengths"] = f"with {_POST} select chunk_id, sum(tf)::bigint as length from post group by 1"
    q["term_records"] = f"with {_POST} select term, count(*) as df from post group by 1"
    q["corpus_size"] = f"with {_POST} select (select count(*) from chunks) as chunks, sum(tf)::bigint as terms, round(sum(tf)::double / (select count(*) from chunks), 6) as mean from post"
    q["bm25"] = f"with {_POST}, {_ASKED}, {_BM25} select query_id, chunk_id, round(bm25_score, 6) as bm25_score, bm25_rank from by_terms"
    q["vector_search"] = f"with {_VEC}, {_NEAR} select query_id, chunk_id, round(vector_score, 6) as vector_score, vector_rank from by_vectors"
    q["missing_embeddings"] = f"select c.chunk_id from chunks c left join (select distinct chunk_id from chunk_vectors where model = 'note-embed-s') v on v.chunk_id = c.chunk_id where v.chunk_id is null and not {_is_blank('c.text')}"
    q["embedding_coverage"] = "select model, count(distinct chunk_id) as done, greatest((select count(*) from chunks) - count(distinct chunk_id), 0) as pending, case when count(distinct chunk_id) >= (select count(*) from chunks) then 'complete' else 'pending' end as state from chunk_vectors group by 1"
    shown = "query_id, chunk_id, note_path, note_title, heading, substring(text, 1, 80) as preview, category_id, round(note_weight, 6) as note_weight, round(rrf_score, 6) as rrf_score, round(final_score, 6) as final_score, bm25_rank, vector_rank, round(bm25_score, 6) as bm25_score, round(vector_score, 6) as vector_score, heading_matched, matched_query_terms, query_terms_total"
    q["hybrid"] = f"{_HYBRID} select {shown} from best"
    q["semantic_recall"] = f"{_HYBRID}, own as (select b.* from best b join asked a on a.query_id = b.query_id where b.note_path <> a.source_path), {_dedupe('own')} select query_id, chunk_id, note_path, note_title, round(final_score, 6) as final_score from (select *, row_number() over (partition by query_id order by round(final_score, 9) desc, chunk_id) as p from single) where p <= 10"
    stage = lambda name, s: f"select '{name}' as stage, query_id, chunk_id, round({s}, 6) as final_score from (select *, row_number() over (partition by query_id order by round({s}, 9) desc, chunk_id) as p from scored) where p <= 5"
    q["ablation"] = f"{_HYBRID} {stage('rrf', 'rrf_only_score')} union all {stage('weight', 'weight_score')} union all {stage('heading', 'final_score')}"
    clean = rf"regexp_replace(text, '{_PICTOGRAPHS[:-1]}\x{{fe0f}}]', ' ', 'g')"

    def written(source: str, id: str) -> str:
        links = rf"select {id} as query_id, unnest(regexp_extract_all(text, '\[\[([^\]]+)\]\]', 1)) as tag_key from {source}"
        return rf"""
lex as (select distinct key from tag),
clean as (select {id} as query_id, {clean} as text from {source} where text is not null),
link as ({links}),
keys as (select query_id, {_normal('tag_key')} as key from (select {id} as query_id, unnest(regexp_extract_all(text, '#([\p{{L}}\p{{N}}_\-/]+)', 1)) as tag_key from {source})
  union select query_id, {_normal('tag_key')} from link union select query_id, {_normal('part')} from (select query_id, {last} as part from link where contains(split_part({whole}, '|', 1), '/'))
  union select query_id, unnest({_terms('text')}) from clean union select c.query_id, l.key from clean c join lex l on length(l.key) >= 2 and contains(c.text, l.key)),
found as (select distinct k.query_id, k.key from keys k join lex using (key))"""

    q["written_keys"] = f"with {_TAG}, {written('documents', 'doc_id')} select query_id, key from found"
    q["tag_search"] = f"""with {_NOTE}, {_TAG}, {_ASKED}, {written('asked', 'query_id')},
totals as (select query_id, count(*) as total from found group by 1),
raw as (select f.query_id, t.note_path, count(*)::double as raw from found f join tag t using (key) group by 1, 2),
ranked as (select r.*, n.weight * r.raw as final_score, row_number() over (partition by r.query_id order by round(n.weight * r.raw, 9) desc, r.note_path) as place from raw r join note n on n.path = r.note_path join asked a on a.query_id = r.query_id where a.source_path <> r.note_path),
first as (select note_path, arg_min(chunk_id, ord) as chunk_id from chunks group by 1)
select r.query_id, f.chunk_id, r.note_path, round(final_score, 6) as final_score, raw::bigint as matched_query_terms, total as query_terms_total from ranked r join first f using (note_path) join totals t on t.query_id = r.query_id where place <= 10"""
    spelled = lambda x: rf"regexp_replace(regexp_replace(regexp_replace(nfc_normalize({x}), '[\\\\/]+', '/', 'g'), '^/', ''), '[\s\p{{Zs}}]', ' ', 'g')"
    q["hit_notes"] = f"with n as (select distinct path, {spelled('path')} as key from notes), h as (select {spelled('note_path')} as key, count(*) as hits from hits group by 1) select path, hits from h join n using (key)"
    q["dedupe_hits"] = f"with {_LOG}, {_dedupe('log')} select query_id, chunk_id, note_path, round(final_score, 6) as final_score from single"
    q["shown_hits"] = f"""with {_LOG}, cut as (select *, max(final_score) over (partition by query_id) as top from log), kept as (select *, case when category_id = 'external' then 'external' else 'internal' end as tab from cut where final_score >= top * (1 - 7 / 10::double) and chunk_id not in (select chunk_id from chunks where starts_with(note_path, 'Inbox/')))
select query_id, chunk_id, tab, row_number() over (partition by query_id, tab order by round(final_score, 9) desc, chunk_id) as place from kept"""
    q["tab_counts"] = f"with {_LOG} select query_id, case when category_id = 'external' then 'external' else 'internal' end as tab, count(*) as hits from log group by 1, 2"
    q["fused_ranks"] = f"with {_LOG} select query_id, chunk_id, round(coalesce(1.0::double / (60 + bm25_rank), 0) + coalesce(1.0::double / (60 + vector_rank), 0), 6) as rrf_score from log"
    q["hit_labels"] = f"with {_LOG} select query_id, chunk_id, note_title, concat_ws(' ', 'B' || bm25_rank, 'V' || vector_rank, case when heading_matched then 'H' end, matched_query_terms || '/' || query_terms_total) as flags, '[[' || note_title || coalesce('#' || heading, '') || ']]' as link from log"
    q["query_counts"] = """with log as (select * from (select *, row_number() over (partition by query_id, coalesce(chunk_id, -1), case when chunk_id is null then note_path end order by logged_at desc, note_path desc) as rn from hits) where rn = 1)
select query_id, count(*) as hits, count(bm25_rank) as by_terms, count(vector_rank) as by_vectors, round((epoch_us(max(logged_at)) - epoch_us(min(logged_at))) / 1e6::double, 6) as seconds from log group by 1"""
    pick = lambda p: f"list_sort(list(value))[least(count(*), floor(count(*) * {p}::double)::bigint + 1)]"
    q["timings_by_type"] = f"select event_type, count(*) as n, round(sum(value), 6) as total, min(value) as least, max(value) as most, {pick(0.5)} as p50, {pick(0.95)} as p95 from events group by 1"
    q["slowest"] = "select event_id, value from events order by value desc, event_id limit 5"
    q["debounced"] = """with g as (select *, case when epoch_us(ts) - lag(epoch_us(ts)) over w <= 3600000000 then 0 else 1 end as fresh from events window w as (partition by user_id order by ts, event_id)),
s as (select *, sum(fresh) over (partition by user_id order by ts, event_id) as run from g) select user_id, max(epoch_us(ts)) + 3600000000 as fired_at, count(*) as events, arg_max(event_id, (ts, event_id)) as event_id from s group by user_id, run"""
    q["changed_types"] = "select event_id, user_id, event_type from (select *, coalesce(lag(event_type) over (partition by user_id order by ts, event_id), '') as b from events) where event_type <> b"
    q["newest_generation"] = "select event_id, user_id from (select *, max(ts::date) over (partition by user_id) as d from events) where ts::date = d"
    k = "json_extract_string(props, '$.k')"
    q["sticky_queries"] = f"select event_id, last_value(case when event_type = 'view' then {k}::bigint end ignore nulls) over (partition by user_id order by ts, event_id rows unbounded preceding) as k from events"
    q["unsuppressed"] = f"select event_id from events e where event_type <> 'purchase' and (event_type = 'error' or not exists (select 1 from events o where o.event_type = 'purchase' and o.user_id = e.user_id and json_extract_string(o.props, '$.k') = json_extract_string(e.props, '$.k') and epoch_ms(e.ts) - epoch_ms(o.ts) between 0 and 86399999))"
    more = f"{_NOTE}, {_VEC}, {_TAG}, {_KINDS}, {_ASKED}, {_MEANS}, {_NEAR}, {written('asked', 'query_id')}"
    tiers = f"{_SYNONYMS}, {_WRITTEN_BY_SYNONYM}, {_BY_VECTOR.format(known='(select query_id, kind, key from exact union select query_id, kind, key from by_synonym) g', on='query_id, kind, key')}"
    q["vector_keys"] = f"with {more}, {_BY_VECTOR.format(known='found', on='query_id, key')} select query_id, kind, key, round(cosine, 6) as similarity from by_vector"
    q["query_keys_synonym"] = f"with {_TAG}, {_KINDS}, {_ASKED}, {written('asked', 'query_id')}, {_SYNONYMS}, {_WRITTEN_BY_SYNONYM} select * from exact union all select * from by_synonym"
    by_keys = f"""{tiers},
every as (select query_id, kind, tier, key from exact union all select query_id, kind, tier, key from by_synonym union all select query_id, kind, 'vector', key from by_vector),
weighed as (select query_id, kind, key, max(case kind || tier when 'doctrineexact' then 3 when 'doctrinesynonym' then 2 when 'doctrinevector' then 1 when 'tagexact' then 1 else 0.5 end)::double as w from every group by 1, 2, 3),
totals as (select query_id, count(distinct key) as total from every group by 1),
raw as (select w.query_id, k.note_path, sum(w) as raw from weighed w join kinds k using (kind, key) group by 1, 2),
ranked as (select r.*, n.category_id, n.weight as note_weight, n.weight * r.raw as final_score, row_number() over (partition by r.query_id order by round(n.weight * r.raw, 9) desc, r.note_path) as place from raw r join note n on n.path = r.note_path join asked a on a.query_id = r.query_id where a.source_path <> r.note_path),
first as (select note_path, arg_min(chunk_id, ord) as chunk_id from chunks group by 1),
tagged as (select r.*, f.chunk_id, total, {_TITLE.replace('note_path', 'r.note_path')} as note_title from ranked r join first f using (note_path) join totals t on t.query_id = r.query_id)"""
    q["tag_search_tiers"] = f"with {more}, {by_keys} select query_id, chunk_id, note_path, round(final_score, 6) as final_score, floor(raw + 0.5)::bigint as matched_query_terms, total as query_terms_total from tagged where place <= 10"
    shown_of = lambda rows: f"(select *, row_number() over (partition by query_id order by round(final_score, 9) desc, chunk_id) as s from {rows}) where s <= 10"
    q["both_modes"] = f"""with {more}, {_POST}, {_BM25}, {by_keys}, {_FUSED},
other as (select b.* from best b join asked a on a.query_id = b.query_id where b.note_path <> a.source_path), {_dedupe('other', 'meant')}, thirty as (select * exclude (place) from tagged where place <= 30), {_dedupe('thirty', 'keyed')}
select query_id, note_path, 'semantic' as mode from {shown_of('meant')} union all select query_id, note_path, 'tag' from {shown_of('keyed')}"""
    q["key_state"] = f"with {_NOTE}, {_VEC}, {_TAG}, {_KINDS}, {_MEANS} select kind, count(*) as n, max(embedded_at) as last, count(*) || ':' || max(embedded_at) as fingerprint from key_vec group by 1"
    q["one_key_embedding"] = f"with {_NOTE}, {_VEC}, {_TAG}, {_KINDS}, {_MEANS} select 'note-embed-s' as model, len(v) as length from key_vec where kind = 'doctrine' and key = (select min(key) from key_vec where kind = 'doctrine')"
    q["synonym_stats"] = f"with {_TAG}, {_KINDS}, {_SYNONYMS}, n as (select key, count(*) as n from syn group by 1), k as (select distinct key from kinds where kind = 'doctrine') select count(*) as keys, count(n) as covered, coalesce(sum(n), 0)::bigint as synonyms, round(sum(n)::double / count(n), 6) as mean from k left join n using (key)"
    symbols = r"[\x{1f300}-\x{1faff}\x{2600}-\x{27bf}\x{fe0f}]"
    q["key_inputs"] = f"with {_TAG}, {_KINDS}, {_SYNONYMS}, w as (select key, array_to_string(list(synonym order by synonym), ' ') as words from syn group by 1), k as (select distinct key from kinds where kind = 'doctrine'), t as (select key, {_trim(f"regexp_replace(concat_ws(' ', key, words), '{symbols}', '', 'g')")} as text from k left join w using (key)) select key, text from t where text <> ''"
    q["synonym_json"] = f"with {_TAG}, {_KINDS}, {_SYNONYMS} select key, synonym from (select key, {_trim('synonym')} as synonym from syn) where length(synonym) >= 2 and synonym <> key"
    q["vector_dim_mismatch"] = """with held as (select chunk_id, model, len(vector) as length, min(vector) as f from chunk_vectors where vector is not null and len(list_filter(vector, lambda x: x is null or isnan(x))) = 0 group by 1, 2, 3),
v as (select *, list_transform(f, lambda x: x::double) as v from held),
c as (select q.chunk_id * 3000 + case q.model when 'note-embed-s' then 0 when 'note-embed-w' then 1 else 2 end * 1000 + q.length as query_id, v.chunk_id, coalesce(list_dot_product(q.v, v.v) / nullif(sqrt(list_dot_product(q.v, q.v)) * sqrt(list_dot_product(v.v, v.v)), 0), 0) as cosine
  from v q join v on q.model = v.model and q.length = v.length where q.chunk_id % 20 = 0 and list_dot_product(q.v, q.v) > 0)
select query_id, chunk_id, round(cosine, 6) as vector_score, vector_rank from (select *, row_number() over (partition by query_id order by round(cosine, 9) desc, chunk_id) as vector_rank from c) where vector_rank <= 10"""
    none = "by_vectors as (select null::bigint as query_id, null::bigint as chunk_id, null::double as vector_score, null::bigint as vector_rank where false)"
    q["hybrid_no_embedding"] = f"with {_NOTE}, {_POST}, {_ASKED}, {_BM25}, {none}, {_FUSED} select query_id, chunk_id, round(final_score, 6) as final_score, bm25_rank, matched_query_terms from best where place <= 10"
    q["one_embedding"] = f"with {_VEC} select model, len(vector) as length from vec where chunk_id = (select min(chunk_id) from vec)"
    q["vector_bytes"] = f"with {_VEC} select chunk_id, model, len(vector) as length, round(list_sum(list_transform(vector, lambda x: x::double)), 6) as total from vec"
    q["embedded"] = f"with {_VEC}, fresh as (select chunk_id from chunks where not {_is_blank('text')}) select chunk_id, 'hash-trigram' as model, 64 as dim, 64 as length from fresh union all select chunk_id, model, dim, len(vector) from vec anti join fresh using (chunk_id)"
    q["upserted_notes"] = f"with {_NOTE} select path, mtime, size, indexed_at from note"
    q["kept_tags"] = f"with {_NOTE}, {_TAG} select note_path, key from tag anti join (select path as note_path from note where weight = 0) g using (note_path)"
    q["markdown_notes"] = "select note_path, count(*) as hits from hits where ends_with(note_path, '.md') group by 1"
    since = "floor((indexed_at - mtime) / 1000::double)::bigint"
    q["ages"] = f"with {_NOTE} select path, case when {since} < 60 then {since} || ' s' when {since} < 3600 then floor({since} / 60)::bigint || ' min' when {since} < 86400 then floor({since} / 3600)::bigint || ' h' else strftime(make_timestamp(mtime * 1000), '%Y-%m-%d') end as age from note"
    keyed = f"""{_HEADS},
k as ({_variants('own', 'doc_id')} union select doc_id, {_normal('mark')} from marks where {_normal('mark')} <> ''), l as ({_variants('links', 'doc_id')})"""
    q["document_keys"] = f"with {keyed} select doc_id::varchar as note_path, 'tag' as kind, key from (select * from k union select * from l)"
    q["document_tags"] = f"with {keyed} select doc_id::varchar as note_path, key as tag from (select * from k union select * from l)"
    q["routed_keys"] = f"with {_TAG}, {_KINDS}, {keyed}, lexicon as (select distinct key from kinds where kind = 'doctrine') select doc_id::varchar as note_path, min(kind) as kind, key from (select doc_id, 'tag' as kind, key from k union all select doc_id, case when key in (select key from lexicon) then 'doctrine' else 'tag' end, key from l) group by doc_id, key"
    q["written_tags"] = rf"with links as (select doc_id, unnest(regexp_extract_all(text, '\[\[([^\]]+)\]\]', 1)) as tag_key from documents), m as (select doc_id, unnest(regexp_extract_all(text, '#([\p{{L}}\p{{N}}_\-/]+)', 1)) as mark from documents) select doc_id, key as tag from ({_variants('links', 'doc_id')} union select doc_id, {_normal('mark')} from m where {_normal('mark')} <> '')"
    leading = rf"^{_PICTOGRAPHS[:-1]}0-9#*\x{{200d}}\x{{20e3}}\x{{fe00}}-\x{{fe0f}}\x{{1f1e6}}-\x{{1f1ff}}\x{{1f3fb}}-\x{{1f3ff}}\x{{e0020}}-\x{{e007f}}]+"
    word = _trim(f"regexp_replace({_trim("split_part(w, '|', 1)")}, '{leading}', '')")
    q["document_keywords"] = rf"""with f as (select doc_id, unnest(list_concat(regexp_extract_all(text, '\[\[([^\]]+)\]\]', 1), regexp_extract_all(text, '["“”]([^"“”\n]+)["“”]', 1))) as w from documents) select distinct doc_id, keyword from (select doc_id, {word} as keyword from f) where keyword <> ''"""
    q["highlighted"] = rf"""with t as (select chunk_id, substring(text, 1, 80) as s, list_filter(list_distinct({_terms('heading')}), lambda x: length(x) >= 2) as terms from chunks where heading is not null),
u as (select chunk_id, s, unnest(terms) as term from t), p as (select chunk_id, s, '(' || string_agg(term, '|' order by -length(term), term) || ')' as pattern from u group by 1, 2),
h as (select chunk_id, s, regexp_replace(s, pattern, '<mark>\1</mark>', 'gi') as shown from p) select chunk_id, shown from h where s <> shown"""
    q["stored_chunks"] = f"""with {_LINES}, {_PACKED}, {_HEADS},
tags as (select doc_id, {_trim(f"regexp_replace({_trim('t')}, '^#', '')")} as t, o from (select doc_id, tag_key as t, i as o from own union all select doc_id, mark, 1000000 + i from marks)),
prefix as (select doc_id, '[태그: ' || string_agg(t, ', ' order by o) || '] ' as prefix from (select doc_id, t, min(o) as o from tags where t <> '' group by 1, 2) group by 1),
filled as (select doc_id, place, heading, i, text from piece where not {_is_blank("text")}),
ordered as (select lpad(doc_id::varchar, 12, '0') || '.md' as note_path, row_number() over (partition by doc_id order by place, i) - 1 as ord, heading, coalesce(prefix, '') || text as text from filled left join prefix using (doc_id))
select row_number() over (order by note_path, ord) as chunk_id, note_path, ord, heading, text from ordered"""
    q["path_factors"] = "with b as (select f.path, g.weight, row_number() over (partition by f.path order by length(g.path) desc, g.pos) as rn from folders f join folders g on starts_with(f.path || 'x.md', g.path)) select path, case when weight <> 0 then round(weight * 0.15::double, 6) end as factor from b where rn = 1"
    q["gated"] = f"""with e as (select event_id, ts, user_id, {k} as path, case event_type when 'purchase' then 'open' when 'signup' then 'pause' when 'view' then 'resume' when 'error' then 'manual' else 'trigger' end as kind from events),
w as (select *, last_value(case when kind in ('pause', 'resume') then kind end ignore nulls) over (partition by user_id order by ts, event_id rows unbounded preceding) as switch,
  last_value(case when kind = 'open' then epoch_ms(ts) end ignore nulls) over (partition by user_id, path order by ts, event_id rows unbounded preceding) as opened from e)
select event_id, kind from w where kind = 'manual' or (kind = 'trigger' and coalesce(switch, '') <> 'pause' and not (path is not null and coalesce(epoch_ms(ts) - opened < 86400000, false)))"""
    q["contexts"] = f"""with lines as (select doc_id, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) - 1 as pos from documents where text is not null),
l as (select *, {_is_blank('line')} as blank from lines), e as (select doc_id, coalesce(max(pos) filter (blank and pos < 2), -1) as low, min(pos) filter (blank and pos > 2) as high, max(pos) as n from l group by 1),
p as (select l.doc_id, {_trim("string_agg(line, chr(10) order by pos)")} as paragraph from l join e using (doc_id) where n >= 2 and pos > low and pos < coalesce(high, n + 1) group by 1),
s as (select lang as session, 'note' || ((d.doc_id // 3) % 7) as path, d.doc_id as "at", case when d.doc_id % 3 = 0 and length({_trim('title')}) >= 10 then {_trim('title')} end as chosen, case when length(paragraph) >= 10 then paragraph end as paragraph from documents d left join p using (doc_id) where text is not null and lang is not null),
a as (select *, case when coalesce(chosen, paragraph) is not null then {{'path': path, 'text': coalesce(chosen, paragraph), 'mode': case when chosen is not null then 'selection' else 'paragraph' end}} end as asks from s),
kept as (select *, last_value(asks ignore nulls) over (partition by session order by "at" rows unbounded preceding) as held from a)
select session, path, "at", held['text'] as text, held['mode'] as mode from kept where held['path'] = path"""
    q["unique_queries"] = f"with {_ASKED} select text, count(*) as times, min(query_id) as first from asked group by 1"
    q["paragraphs"] = f"""with lines as (select doc_id, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) - 1 as pos from documents where text is not null),
l as (select *, {_is_blank('line')} as blank from lines), e as (select doc_id, coalesce(max(pos) filter (blank and pos < 2), -1) as low, min(pos) filter (blank and pos > 2) as high, max(pos) as n from l group by 1),
p as (select l.doc_id, {_trim("string_agg(line, chr(10) order by pos)")} as paragraph from l join e using (doc_id) where n >= 2 and pos > low and pos < coalesce(high, n + 1) group by 1)
select doc_id, paragraph from p where length(paragraph) >= 10"""
    return q
