"""Queries over citation styles and exports of whole papers, with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from .operators import exports, references, styles
from .registry import over


def _refs(r):
    return r.withColumn("authors", F.filter(F.split("names", ";"), lambda n: n != "")).drop("names")


_papers = _refs
#: rf: references with authors; tk: citation tokens; nb: numbers.
BASE = r"""
rf as (select *, list_filter(string_split(names, ';'), lambda x: x <> '') as authors, list_transform(list_filter(string_split(names, ';'), lambda x: x <> ''), lambda a: trim(split_part(a, ',', 1))) as fams from v_cite_ref),
tr as (select paper_id, sec_no, unnest(regexp_extract_all(content, '\[\[cite[pt]:[A-Za-z0-9_,\- ]+?\]\]')) as raw, generate_subscripts(regexp_extract_all(content, '\[\[cite[pt]:[A-Za-z0-9_,\- ]+?\]\]'), 1) - 1 as nth from v_doc_section),
tk as (select paper_id, sec_no, nth, regexp_extract(raw, '\[\[cite([pt]):', 1) as kind, list_filter(list_transform(string_split(regexp_extract(raw, ':([A-Za-z0-9_,\- ]+?)\]\]', 1), ','), lambda x: trim(x)), lambda x: x <> '') as ids from tr),
te as (select paper_id, sec_no, nth, kind, ids, unnest(ids) as ref_id, generate_subscripts(ids, 1) as k from tk),
tf as (select paper_id, ref_id, min(struct_pack(s := sec_no, n := nth, k := k)) as fst from te group by all),
nb as (select rf.paper_id, rf.ref_id, cast(row_number() over (partition by rf.paper_id order by fst is null, fst, ord) as int) as number, fst is not null as cited from rf left join tf on tf.paper_id = rf.paper_id and tf.ref_id = rf.ref_id where renderable)"""
over("reference_numbers", ("v_cite_ref", "v_doc_section"), lambda r, s: styles.numbers(_refs(r), s), f"with {BASE} select * from nb")


def _label_sql(style_id: str) -> str:
    """lb: the label of each token."""
    s = styles.STYLES[style_id]
    if s.author_year:
        several = f"when len(fams) <= {s.names} then array_to_string(fams[1:len(fams) - 1], ', ') || '{s.last}' || fams[-1]" if s.names > 2 else ""
        names = f"case len(fams) when 0 then coalesce(title, '') when 1 then fams[1] when 2 then fams[1] || '{s.two}' || fams[2] else case {several or 'when false then null'} else fams[1] || ' et al.' end end"
        piece = f"{names} || '{s.before_year}' || coalesce(cast(year as varchar), 'n.d.')"
        label = f"case when kind = 't' and len(ys) > 0 then '(' || array_to_string(ys, ', ') || ')' else '(' || array_to_string(ps, '{s.between}') || ')' end"
    else:
        piece = "'[' || number || ']'" if style_id == "ieee" else "cast(number as varchar)"
        label = f"array_to_string(ps, '{', ' if style_id == 'ieee' else ','}')"
    return f"""lg as (select te.paper_id, te.sec_no, te.nth, kind, ids, list({piece} order by k) filter (renderable) as ps, coalesce(list(cast(year as varchar) order by k) filter (renderable and year is not null), []) as ys, coalesce(list(coalesce(label, rf.ref_id) order by k) filter (rf.ref_id is not null), []) as ls
 from te left join rf on rf.paper_id = te.paper_id and rf.ref_id = te.ref_id left join nb on nb.paper_id = te.paper_id and nb.ref_id = te.ref_id group by all),
lb as (select paper_id, sec_no, nth, ids, case when ps is null then '[' || array_to_string(ls, ',') || ']' else {label} end as label from lg)"""


def _entry_sql(style_id: str) -> str:
    """bb: the bibliography in the style's order."""
    s = styles.STYLES[style_id]
    given = "case when contains(a, ',') then trim(regexp_replace(a, '^[^,]*,', '')) else '' end"
    short = f"array_to_string(list_transform(list_filter(regexp_split_to_array({given}, '[\\s.]+'), lambda w: w <> ''), lambda w: substring(w, 1, 1) || '.'), ' ')" if s.initials else given
    fam = "trim(split_part(a, ',', 1))"
    back, front = f"case when {short} = '' then {fam} else {fam} || ', ' || {short} end", f"case when {short} = '' then {fam} else {short} || ' ' || {fam} end"
    name = back if s.inverted == "all" else front if s.inverted == "none" else f"case when i = 1 then {back} else {front} end"
    two = " and " if s.entry_last == ", and " and s.inverted != "first" else s.entry_last
    names = f"case when len(nm) = 0 then '' when len(nm) >= {s.et_al_from} then nm[1] || ' et al.' when len(nm) = 1 then nm[1] when len(nm) = 2 then nm[1] || '{two}' || nm[2] else array_to_string(nm[1:len(nm) - 1], ', ') || '{s.entry_last}' || nm[-1] end"
    stop = "case when ns like '%.' or ns = '' then ns else ns || '.' end"
    after = lambda lead, c: f"case when coalesce({c}, '') <> '' then '{lead}' || {c} else '' end"
    y, t = "coalesce(cast(year as varchar), 'n.d.')", "coalesce(title, '')"
    parts = {
        "apa": ["ns", "' ('", y, "'). '", t, "'.'", after(" ", "container"), after(", ", "volume"), after(", ", "pages"), after(". https://doi.org/", "doi")],
        "chicago-author-date": [stop, "' '", y, "'. “'", t, "'.”'", after(" ", "container"), after(" ", "volume"), after(": ", "pages"), "'.'", after(" https://doi.org/", "doi")],
        "harvard-cite-them-right": ["ns", "' ('", y, "') ‘'", t, "'’'", after(", ", "container"), after(", ", "volume"), after(", pp. ", "pages"), "'.'"],
        "ieee": ["ns", "', “'", t, "',”'", after(" ", "container"), after(", vol. ", "volume"), after(", pp. ", "pages"), "', '", y, "'.'"],
        "nature": [stop, "' '", t, "'.'", after(" ", "container"), after(" ", "volume"), after(", ", "pages"), "' ('", y, "').'"],
    }[style_id]
    lead = "''" if s.author_year else "'[' || number || ']'" if style_id == "ieee" else "number || '.'"
    key = "case when number is not null then coalesce(nullif(lower(fams[1]), ''), '￿') end, case when number is not null then coalesce(year, 9999) end, case when number is not null then lower(title) end" if s.author_year else "number"
    return f"""bn as (select rf.*, number, list_transform(authors, lambda a, i: {name}) as nm from rf left join nb on nb.paper_id = rf.paper_id and nb.ref_id = rf.ref_id), bs as (select *, {names} as ns from bn),
bb as (select paper_id, cast(row_number() over (partition by paper_id order by number is null, {key}, ord) as int) as place, ref_id, {'cast(null as int)' if s.author_year else 'number'} as number, case when number is null then raw_text else {lead} || trim({' || '.join(parts)}) end as text, number is null as raw from bs)"""


for _id in styles.STYLES:
    _name = _id.split("-")[0]
    over(f"labels_{_name}", ("v_cite_ref", "v_doc_section"), lambda r, s, i=_id: styles.labels(_refs(r), s, i), f"with {BASE}, {_label_sql(_id)} select * from lb")
    over(f"bibliography_{_name}", ("v_cite_ref", "v_doc_section"), lambda r, s, i=_id: styles.bibliography(_refs(r), s, i), f"with {BASE}, {_entry_sql(_id)} select * from bb")
    over(f"style_sample_{_name}", ("v_cite_ref", "v_doc_section"), lambda r, s, i=_id: styles.samples(_refs(r), s, i))


def _esc(c: str) -> str:
    return rf"regexp_replace({c}, '([&%#_])', '\\\1', 'g')"


def _tex(c: str, ay: bool) -> str:
    cut = rf"regexp_split_to_array({c}, '\[\[cite[pt]:[A-Za-z0-9_,\- ]+?\]\]')"
    kind, ids = (rf"regexp_extract_all({c}, '\[\[cite([pt]):([A-Za-z0-9_,\- ]+?)\]\]', {i})" for i in (1, 2))
    keys = f"array_to_string(list_filter(list_transform(string_split({ids}[i], ','), lambda q: trim(q)), lambda q: q <> ''), ',')"
    cite = rf"'\cite' || {kind}[i] || '{{'" if ay else r"'\cite{'"
    return rf"regexp_replace(array_to_string(list_transform({cut}, lambda p, i: {_esc('p')} || case when i <= len({kind}) then {cite} || {keys} || '}}' else '' end), ''), '\n\n+', chr(10) || chr(10), 'g')"


_N = "chr(10)"


def _latex_sql(style_id: str) -> str:
    ay = styles.STYLES[style_id].author_year
    cite = r"\usepackage[round]{natbib}" if ay else r"\usepackage{cite}"
    front = ["% Citation style: " + style_id, r"\documentclass[11pt]{article}", r"\usepackage[utf8]{inputenc}", cite, r"\usepackage[margin=1in]{geometry}"]
    head = f" || {_N} || ".join(f"'{x}'" for x in front)
    name = "'float_' || (float_no + 1)"
    body, cap = f"trim({_tex('text', ay)})", f"trim({_esc('caption')})"
    fl = rf"""case when kind = 'box' then concat_ws({_N}, '\begin{{quote}}', '% ' || {name} || ': boxed panel captured from page ' || (page + 1) || '; text preserved, original framing not reconstructed', case when {cap} <> '' then '\textbf{{' || {cap} || '}}' end, {body}, '\end{{quote}}')
 else concat_ws({_N}, '\begin{{' || kind || '}}[htbp]', '% ' || {name} || ': ' || kind || ' captured from page ' || (page + 1) || '; text preserved, visual layout not reconstructed', '\centering', case when {body} <> '' then {body} end, case when {cap} <> '' then '\caption{{' || {cap} || '}}' end, '\end{{' || kind || '}}') end"""
    label = "'[' || case len(fams) when 0 then substring(coalesce(title, bb.ref_id), 1, 20) when 1 then fams[1] when 2 then fams[1] || ' and ' || fams[2] else fams[1] || ' et al.' end || '(' || coalesce(cast(year as varchar), 'n.d.') || ')]'" if ay else "''"
    words = "bb.text" if ay else r"regexp_replace(bb.text, '^\s*\[?\d+\]?\.?\s*', '')"
    return rf"""with {BASE}, {_entry_sql(style_id)},
mm as (select paper_id, title, list_filter(string_split(names, ';'), lambda x: x <> '') as au from v_meta),
fh as (select f.*, s.sec_no from v_doc_float f left join (select * from v_doc_section where kind not in ('references', 'abstract')) s on s.paper_id = f.paper_id and s.section_id = f.section_id),
px as (select paper_id, 0 as p, 0 as a, 0 as b, {head} || {_N} || '\title{{' || {_esc("coalesce(title, '')")} || '}}' || {_N} || '\author{{' || case when len(au) > 0 then array_to_string(list_transform(au, lambda x: {_esc('x')}), ' \and ') else '~' end || '}}' || {_N} || '\date{{}}' || {_N} || '\begin{{document}}' || {_N} || '\maketitle' as x from mm
 union all select paper_id, 1, sec_no, -1, case when kind = 'abstract' then '\begin{{abstract}}' || {_N} || regexp_replace({_tex('content', ay)}, '(?i)^abstract\s*[—\-–.:]?\s*', '') || {_N} || '\end{{abstract}}'
   else concat_ws({_N}, case level when 1 then '\section' when 2 then '\subsection' else '\subsubsection' end || '{{' || {_esc('title')} || '}}', case when trim({_tex('content', ay)}) <> '' then {_tex('content', ay)} end) end from v_doc_section where kind <> 'references'
 union all select paper_id, 1, sec_no, float_no, {fl} from fh where sec_no is not null
 union all select distinct paper_id, 2, 0, 0, '\section*{{Unanchored floats}}' || {_N} || '% Captured from the PDF but not attachable to an exported section; text preserved here rather than dropped.' from fh where sec_no is null
 union all select paper_id, 2, 1, float_no, {fl} from fh where sec_no is null
 union all select mm.paper_id, 3, 0, 0, {_N} || '\begin{{thebibliography}}{{' || greatest(9, (select count(*) from rf where rf.paper_id = mm.paper_id)) || '}}' from mm
 union all select bb.paper_id, 3, 1, place, '\bibitem' || {label} || '{{' || bb.ref_id || '}} ' || {_esc(words)} || case when raw then '  % UNPARSED — raw text kept verbatim' else '' end from bb join rf on rf.paper_id = bb.paper_id and rf.ref_id = bb.ref_id
 union all select paper_id, 4, 0, 0, '\end{{thebibliography}}' || {_N} || '\end{{document}}' from mm)
select paper_id, string_agg(x, {_N} order by p, a, b) || {_N} as tex from px group by paper_id"""


_PARTS = ("v_meta", "v_doc_section", "v_doc_float", "v_cite_ref")
for _id in ("ieee", "apa"):
    over(f"latex_{_id}", _PARTS, lambda m, s, f, r, i=_id: exports.latex(_papers(m), s, f, _refs(r), i), _latex_sql(_id))


def _markdown_sql(style_id: str) -> str:
    name = "case when caption <> '' then caption else upper(substring(kind, 1, 1)) || substring(kind, 2) || ' (page ' || (page + 1) || ')' end"
    quote = f"'> **' || {name} || '**' || {_N} || '>' || {_N} || array_to_string(list_transform(string_split(text, {_N} || {_N}), lambda q: '> ' || replace(q, {_N}, {_N} || '> ') || {_N} || '>'), {_N})"
    return rf"""with {BASE}, {_entry_sql(style_id)}, {_label_sql(style_id)},
mm as (select paper_id, title, list_filter(string_split(names, ';'), lambda x: x <> '') as au from v_meta),
sp as (select paper_id, sec_no, unnest(regexp_split_to_array(content, '\[\[cite[pt]:[A-Za-z0-9_,\- ]+?\]\]')) as part, generate_subscripts(regexp_split_to_array(content, '\[\[cite[pt]:[A-Za-z0-9_,\- ]+?\]\]'), 1) - 1 as k from v_doc_section),
sr as (select sp.paper_id, sp.sec_no, string_agg(part || coalesce(label, ''), '' order by k) as content from sp left join lb on lb.paper_id = sp.paper_id and lb.sec_no = sp.sec_no and lb.nth = k group by all),
fh as (select f.*, s.sec_no from v_doc_float f left join (select * from v_doc_section where kind <> 'references') s on s.paper_id = f.paper_id and s.section_id = f.section_id),
px as (select paper_id, 0 as p, 0 as a, 0 as b, concat_ws({_N}, '# ' || coalesce(title, ''), '', case when len(au) > 0 then array_to_string(au, ', ') || {_N} end) as x from mm
 union all select s.paper_id, 1, s.sec_no, -1, concat_ws({_N}, repeat('#', least(level + 1, 4)) || ' ' || title, '', case when trim(sr.content) <> '' then sr.content || {_N} end) from v_doc_section s join sr on sr.paper_id = s.paper_id and sr.sec_no = s.sec_no where kind <> 'references'
 union all select paper_id, 1, sec_no, float_no, {quote} || {_N} || '> _text preserved; original layout not reconstructed_' || {_N} from fh where sec_no is not null
 union all select distinct paper_id, 2, 0, 0, '## Unanchored floats' || {_N} from fh where sec_no is null union all select paper_id, 2, 1, float_no, {quote} || {_N} from fh where sec_no is null
 union all select paper_id, 3, 0, 0, '## References' || {_N} from mm union all select paper_id, 3, 1, place, '- ' || text || case when raw then '  ⚠ unparsed (raw text)' else '' end from bb)
select paper_id, string_agg(x, {_N} order by p, a, b) || {_N} as markdown from px group by paper_id"""


for _id in ("ieee", "apa"):
    over(f"markdown_{_id}", _PARTS, lambda m, s, f, r, i=_id: exports.markdown(_papers(m), s, f, _refs(r), i), _markdown_sql(_id))

_B = lambda c: rf"replace(replace(replace(replace(replace({c}, '\', '\textbackslash{{}}'), '&', '\&'), '%', '\%'), '#', '\#'), '_', '\_')"


def _field(name: str, value: str, escape: bool = True) -> str:
    return f"case when coalesce({value}, '') <> '' then '  ' || {name} || ' = {{' || {_B(value) if escape else value} || '}}' end"


_KIND = f"case when arxiv is not null or regexp_matches(coalesce(container, raw_text), '{references.PREPRINT_WORDS}') then 'misc' when regexp_matches(container, '{references.CONFERENCE_WORDS}') then 'inproceedings' when container is not null then 'article' else 'misc' end"
_FIELDS = [_field("'title'", "title"), _field("'author'", "array_to_string(authors, ' and ')"), _field("'year'", "cast(year as varchar)"), _field("case when e = 'inproceedings' then 'booktitle' else 'journal' end", "container"), _field("'volume'", "volume"), _field("'pages'", "pages"), _field("'doi'", "doi"),
           _field("'url'", "coalesce(nullif(url, ''), 'https://arxiv.org/abs/' || arxiv)", escape=False), _field("'note'", "'arXiv:' || arxiv")]
over("bibtex_all_fields", ("v_cite_ref",), lambda r: exports.bibtex(_refs(r)).drop("ord"),
     f"with {BASE}, k as (select *, {_KIND} as e from rf) select paper_id, ref_id, '@' || e || '{{' || ref_id || ',' || {_N} || concat_ws(',' || {_N}, {', '.join(_FIELDS)}) || {_N} || '}}' as entry from k")
over("provenance", ("v_meta", "v_cite_ref", "v_history"), lambda m, r, h: exports.provenance(_papers(m), _refs(r), h),
     f"""with px as (select m.paper_id, 0 as p, 0 as a, '# Provenance' || {_N} || {_N} || 'Paper: ' || coalesce(title, '') || {_N} || 'Version: ' || version || {_N} || {_N} || '## Agent-added references (' || (select count(*) from v_cite_ref r where r.paper_id = m.paper_id and added_by = 'agent') || ')' || {_N}
   || case when (select count(*) from v_cite_ref r where r.paper_id = m.paper_id and added_by = 'agent') = 0 then {_N} || '(none)' else '' end as x from v_meta m
 union all select paper_id, 1, ord, '- **' || coalesce(title, '?') || '** — added because: ' || coalesce(added_reason, '?') || {_N} || '  - source: ' || source || ' — ' || source_url from v_cite_ref where added_by = 'agent'
 union all select m.paper_id, 2, 0, case when not exists (select 1 from v_history h where h.paper_id = m.paper_id) then {_N} || '## Edit history' || {_N} || {_N} || '(no edits applied — original parse)' else {_N} || '## Edit history' || {_N} end from v_meta m
 union all select paper_id, 3, version, '- v' || version || ' → v' || (version + 1) || ': ' || reason || ' (' || strftime(created_at, '%Y-%m-%d %H:%M') || ')' from v_history)
 select paper_id, string_agg(x, {_N} order by p, a) || {_N} as provenance from px group by paper_id""")  # fmt: skip
