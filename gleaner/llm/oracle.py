"""The same results in SQL, for the queries that SQL can express over whole tables."""

from __future__ import annotations

_SPELLING = r"regexp_replace(regexp_replace(regexp_replace(nfc_normalize({}), '[\\/]+', '/', 'g'), '^/', ''), '[\s\p{{Zs}}]', ' ', 'g')"

_P1 = f"""
with note as (select {_SPELLING.format("path")} as key, min(path) as path from notes group by 1),
held as (select distinct h.query_id, n.path from hits h join note n on {_SPELLING.format("h.note_path")} = n.key where h.query_id is not null),
single as (select path, count(*) as n from held group by 1),
met as (select a.path as path_1, b.path as path_2, count(*) as c from held a join held b on a.query_id = b.query_id and a.path < b.path group by 1, 2 having count(*) >= 8),
total as (select count(distinct query_id) as n from hits)
select path_1, path_2, c as together, x.n as records_1, y.n as records_2, t.n as records, c::double * t.n / (x.n::double * y.n) as lift
from met join single x on x.path = path_1 join single y on y.path = path_2 cross join total t
"""

_PART = "case when {k} > 0 then {k} * ln({k} * records::double / (({r})::double * ({s}))) else 0 end"
_A, _B, _N = "records_1", "records_2", "records"
_LLR = " + ".join(
    _PART.format(k=f"({k})", r=r, s=s)
    for k, r, s in (("together", _A, _B), (f"{_A} - together", _A, f"{_N} - {_B}"), (f"{_B} - together", f"{_N} - {_A}", _B), (f"{_N} - {_A} - {_B} + together", f"{_N} - {_A}", f"{_N} - {_B}"))
)

_TERMS = r"select chunk_id, regexp_extract_all(lower(nfc_normalize(text)), '[\p{L}\p{N}]{2,}') as terms from chunks where text is not null"

_P2 = f"""
with words as (select chunk_id, unnest(terms) as term from ({_TERMS})),
counted as (select term, count(*) as occurrences, count(distinct chunk_id) as records from words group by 1)
select term, occurrences, records,
  case when records < 3 then 'rare' when records > 0.1 * (select count(*) from chunks) then 'common' else 'kept' end as mark from counted
"""

_BREAKS = r"[\s\v\x{1c}-\x{1f}\x{85}\p{Z}.!?。！？]+"

_P3 = f"""
select chunk_id, case when list_max(list_transform(regexp_split_to_array(text, '{_BREAKS}'), lambda x: length(x))) > 1500 - coalesce(length(heading), 0) then 'forced' else 'natural' end as cut
from chunks where length(text) + coalesce(length(heading), 0) > 1500
"""

_P4 = f"""
with words as (select chunk_id, terms from ({_TERMS}) where len(terms) >= 20),
runs as (select chunk_id, list_distinct(list_transform(range(1, len(terms) - 1), lambda i: terms[i] || ' ' || terms[i + 1] || ' ' || terms[i + 2])) as runs from words),
flat as (select chunk_id, unnest(runs) as run from runs),
size as (select chunk_id, len(runs) as n from runs),
met as (select a.chunk_id as chunk_id_1, b.chunk_id as chunk_id_2, count(*) as n from flat a join flat b on a.run = b.run and a.chunk_id < b.chunk_id group by 1, 2)
select chunk_id_1, chunk_id_2 from met join size x on x.chunk_id = chunk_id_1 join size y on y.chunk_id = chunk_id_2
where met.n * 10 >= 7 * (x.n + y.n - met.n)
"""

_GROUPS = rf"""
with recursive words as (select chunk_id, text, regexp_extract_all(lower(nfc_normalize(text)), '[\p{{L}}\p{{N}}]{{2,}}') as terms from chunks),
runs as (select chunk_id, case when text is null then ['null ' || chunk_id] when len(terms) = 0 then ['text ' || nfc_normalize(text)] when len(terms) < 5 then ['run ' || array_to_string(terms, ' ')]
  else list_sort(list_distinct(list_transform(range(1, len(terms) - 3), lambda i: 'run ' || array_to_string(terms[i:i + 4], ' ')))) end as runs from words),
members as (select chunk_id, min(chunk_id) over (partition by runs) as rep, runs from runs),
reps as (select chunk_id as rep, runs from members where chunk_id = rep),
flat as (select rep, len(runs) as n, unnest(runs) as run from reps),
links as (select a.rep as a, b.rep as b from flat a join flat b on a.run = b.run and a.rep <> b.rep group by 1, 2, a.n, b.n having count(*) * 5 >= 4 * (a.n + b.n - count(*))),
reach as (select rep as a, rep as b from reps union select reach.a, links.b from reach join links on links.a = reach.b),
grouped as (select a as rep, min(b) as group_id from reach group by 1),
ends as (select a as rep, count(*) as links from links group by 1)
select chunk_id, rep, group_id, coalesce(links, 0) as links from members join grouped using (rep) left join ends using (rep)
"""

_SHARES = r"""
with wanted as (select lower(regexp_replace(source, '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g')) as source, sum(target_share) as share, min(max_repeats) as cap from mix_targets where source is not null group by 1),
given as (select distinct lower(regexp_replace(source, '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g')) as source from documents where text <> '' and source is not null),
able as (select w.source, share from wanted w join given using (source) where share > 0 and cap >= 1)
select source, round(coalesce(w.share, 0), 6) as target_share, round(coalesce(a.share / (select sum(share) from able), 0), 6) as reachable_share, true as met, true as within from wanted w left join able a using (source)
"""

_P5 = """
with usable as (
  select distinct on (chunk_id, model, dim) chunk_id, model, dim, list_transform(vector, lambda x: x::double) as v from chunk_vectors
  where vector is not null and len(vector) = dim and model is not null and len(list_filter(vector, lambda x: x is null or isnan(x) or isinf(x))) = 0 and len(list_filter(vector, lambda x: x <> 0)) > 0
  order by chunk_id, model, dim, vector),
met as (select a.chunk_id, b.chunk_id as neighbour, list_cosine_similarity(a.v, b.v) as cosine from usable a join usable b on a.model = b.model and a.dim = b.dim and a.chunk_id <> b.chunk_id),
ranked as (select *, row_number() over (partition by chunk_id order by cosine desc, neighbour) as place from met)
select distinct least(chunk_id, neighbour) as chunk_id_1, greatest(chunk_id, neighbour) as chunk_id_2 from ranked where place <= 10 and cosine >= 0.85
"""


def _p8(end: str) -> str:
    """Sign by sign: the prototypes of whole signs, composed, in a table of the query."""
    from .skeleton import prototypes, skeleton

    signs = {chr(i) for i in prototypes()} | {chr(i) for i in range(0x80, 0x3000) if skeleton(chr(i)) != chr(i)}
    quote = lambda x: "'" + x.replace("'", "''") + "'"
    rows = ", ".join(f"({quote(c)}, {quote(skeleton(c))})" for c in sorted(signs))
    return f"""
with prototype(sign, shown) as (values {rows}),
signs as (select doc_id, text, unnest(string_split(nfc_normalize(text), '')) as sign, generate_subscripts(string_split(nfc_normalize(text), ''), 1) as pos from documents where text is not null and text <> ''),
shown as (select doc_id, nfc_normalize(string_agg(coalesce(p.shown, s.sign), '' order by pos)) as form from signs s left join prototype p on p.sign = s.sign group by 1),
forms as (select d.doc_id, d.text, case when d.text is not null then coalesce(s.form, '') end as form from documents d left join shown s on s.doc_id = d.doc_id)
{end}
"""


_LOOK_ALIKE = """select a.doc_id as doc_id_1, b.doc_id as doc_id_2 from forms a join forms b on a.form = b.form and a.doc_id < b.doc_id and a.text <> b.text"""


def oracle_sql() -> dict[str, str]:
    return {
        "p1_found": f"select path_1, path_2 from ({_P1}) where lift >= 4",
        "p1_pairs": f"with found as ({_P1}) select path_1, path_2, together, records_1, records_2, records, round(lift, 6) as lift, round(2 * ({_LLR}), 6) as llr from found",
        "p1_all": f"with found as ({_P1.replace('>= 8', '>= 1')}), rated as (select path_1, path_2, together, records_1, records_2, records, round(lift, 6) as lift, round(2 * ({_LLR}), 6) as llr from found) select *, llr >= 10.828 and lift > 1 as significant from rated",
        "p2_found": f"select term, mark from ({_P2}) where mark <> 'kept'",
        "p2_terms": _P2,
        "p3_found": _P3,
        "p3_checked": "select chunk_id, true as whole, true as within, true as overlap from chunks where length(text) + coalesce(length(heading), 0) > 1500",
        "p4_found": _P4,
        "p4_groups": _GROUPS,
        "p5_found": _P5,
        "p6_checked": "select doc_id, true as whole, true as fits from documents where text is not null",
        "p7_checked": _SHARES,
        "p8_found": _p8(_LOOK_ALIKE),
        "p8_forms": _p8("select doc_id, form from forms"),
    }
