"""Queries over references, records and searches, with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from .catalog_exports import BASE
from .operators import exports, references, works
from .registry import over


def _refs(r):
    return r.withColumn("authors", F.filter(F.split("names", ";"), lambda n: n != "")).drop("names")


_W = BASE.replace("from v_cite_ref", "from v_work")
over("parsed_references", ("v_work",), lambda r: works.is_parsed(_refs(r)),
     f"""with {_W} select paper_id, ref_id, confidence >= 0.5 and (coalesce(title, '') <> '' or len(authors) > 0) as parsed, coalesce(csl_title, '') <> '' and (confidence >= 0.5 or status = 'resolved' or added_by <> 'pdf_parse') as renderable from rf""")
_BEST = "coalesce(source_url, 'https://doi.org/' || coalesce(res_doi, doi, csl_doi), 'https://arxiv.org/abs/' || arxiv, url, csl_url)"
over("best_urls", ("v_work",), works.best_url, f"select paper_id, ref_id, {_BEST} as url from v_work")
over("reference_names", ("v_work",), lambda r: works.display_names(_refs(r)),
     f"with {_W} select paper_id, ref_id, case when len(fams) > 0 then fams[1] || case when len(fams) > 1 then ' et al.' else '' end || case when year is not null then ', ' || year else '' end else substring(coalesce(csl_title, ref_id), 1, 60) end as display_name from rf")
for _f, _c in (("unparsed", "confidence < 0.5"), ("unresolved", "status <> 'resolved'")):
    over(f"{_f}_references", ("v_work",), lambda r, f=_f: works.filtered(r, f).select("paper_id", "ref_id"), f"select paper_id, ref_id from v_work where {_c}")
_GIVEN = "trim(regexp_replace(a, '^[^,]*,', ''))"
over("csl_items", ("v_work",), lambda r: works.csl_items(_refs(r)),
     rf"""with {_W}, j as (select *, case when arxiv is not null or regexp_matches(coalesce(container, ''), '{references.PREPRINT_WORDS}') then 'article' when regexp_matches(container, '{references.CONFERENCE_WORDS}') then 'paper-conference' when container is not null then 'article-journal' else 'article' end as k,
  nullif(concat_ws(' | ', 'arXiv:' || arxiv, case when title is null then 'unparsed raw: ' || substring(raw_text, 1, 200) end), '') as note from rf)
 select paper_id, ref_id, '{{' || concat_ws(',', '"id":' || to_json(ref_id), '"type":' || to_json(k), '"title":' || to_json(nullif(title, '')),
  case when len(authors) > 0 then '"author":[' || array_to_string(list_transform(authors, lambda a: case when contains(a, ',') then '{{"family":' || to_json(trim(split_part(a, ',', 1))) || ',"given":' || to_json({_GIVEN}) || '}}' else '{{"family":' || to_json(a) || '}}' end), ',') || ']' end,
  case when year is not null then '"issued":{{"date-parts":[[' || year || ']]}}' end, '"container-title":' || to_json(container), '"DOI":' || to_json(doi), '"URL":' || to_json(coalesce(url, 'https://arxiv.org/abs/' || arxiv)), '"page":' || to_json(pages), '"volume":' || to_json(volume), '"note":' || to_json(note)) || '}}' as item from j""")  # fmt: skip
over("references_as_sources", ("v_work",), lambda r: works.as_sources(_refs(r)),
     f"""select paper_id, ref_id, x.api, x.title, year, x.authors, x.doi, x.url from (select paper_id, ref_id, year, unnest(case when {_BEST} is null then [] else [struct_pack(api := coalesce(source, 'parsed'), title := coalesce(csl_title, title, '(unknown)'), authors := list_filter(string_split(names, ';'), lambda x: x <> '')[1:10], doi := case when source is not null then res_doi else doi end, url := {_BEST})] end) as x from v_work) z""")
over("records_as_references", ("v_record",), lambda r: works.as_references(r.selectExpr("paper_id", "concat('ref_', cast(900 + seq as string)) as ref_id", "api", "cast(seq as string) as api_id", "title", "2020 as year", "array('Ada B. Lovelace', 'Plato') as authors", "'V' as venue", "doi", "'https://e.org' as url", "cast(null as string) as abstract", "'why' as reason")).drop("abstract"),
     """select paper_id, 'ref_' || (900 + seq) as ref_id, '[agent-added] ' || title as raw_text, ['Lovelace, Ada B.', 'Plato'] as authors, 2020 as year, title, 'V' as container, doi, 'https://e.org' as url, 1.0 as confidence, 'resolved' as status, api as source, cast(seq as varchar) as api_id, 'https://e.org' as source_url, 'agent' as added_by, 'why' as added_reason from v_record""")  # fmt: skip
# All pairs of titles take SQL minutes here; a test compares these with all pairs on small tables.
over("resolved_references", ("v_cite_ref", "v_record"), works.resolved)
over("resolution_totals", ("v_cite_ref", "v_record"), lambda r, x: works.resolution_counts(works.resolved(r, x)))
over("uncited_references", ("v_work", "v_doc_section"), works.uncited, f"with {_W} select paper_id, ref_id from rf where not exists (select 1 from te where te.paper_id = rf.paper_id and te.ref_id = rf.ref_id)")
over("resolve_order", ("v_work", "v_doc_section"), works.resolve_order,
     f"with {_W} select paper_id, ref_id, cast(row_number() over (partition by paper_id order by not exists (select 1 from te where te.paper_id = rf.paper_id and te.ref_id = rf.ref_id), ref_id) as int) as place from rf where status = 'not_attempted'")
over("parse_findings", ("v_work", "v_doc_section", "v_author_part"), works.findings,
     f"""with {_W} select paper_id, 'unparsed_reference' as type, 'medium' as severity, 'Reference ' || coalesce(label, ref_id) || ' could not be parsed' as title, substring(raw_text, 1, 220) as detail from rf where confidence < 0.5
 union all select paper_id, 'style_note', 'low', count(*) || ' in-text markers could not be linked to a reference', 'They were left untouched in the text.' from v_author_part group by 1
 union all select paper_id, 'unresolved_reference', 'low', 'Could not find “' || substring(coalesce(title, raw_text), 1, 70) || '…”', 'No confident match.' from rf where confidence >= 0.5 and status in ('unresolved', 'failed') and exists (select 1 from te where te.paper_id = rf.paper_id and te.ref_id = rf.ref_id)""")  # fmt: skip
_STOP = ", ".join(repr(w) for w in works.PHRASE_STOP)
over("search_queries", ("v_doc_section", "v_meta"), works.search_queries,
     rf"""with u as (select *, regexp_extract_all(lower(substring(content, 1, 4000)), '[a-z][a-z\-]{{2,}}') as w from v_doc_section where kind in ('body', 'abstract') and length(content) >= 200),
 e as (select paper_id, sec_no, w[i] as a, w[i + 1] as b, i from (select *, unnest(range(1, len(w))) as i from u) z), n as (select paper_id, sec_no, a || ' ' || b as p, count(*) as n, min(i) as f from e where a not in ({_STOP}) and b not in ({_STOP}) group by all),
 k as (select *, row_number() over (partition by paper_id, sec_no order by n desc, f) as k from n qualify row_number() over (partition by paper_id, sec_no order by n desc, f) <= 2), q as (select * from k where n >= 2),
 r as (select u.paper_id, u.sec_no, section_id, u.title, p, k, array_to_string(regexp_extract_all(coalesce(m.title, ''), '[A-Za-z][A-Za-z\-]+')[1:6], ' ') as head from u join v_meta m on m.paper_id = u.paper_id left join q on q.paper_id = u.paper_id and q.sec_no = u.sec_no where p is not null or u.title <> '')
 select paper_id, cast(row_number() over (partition by paper_id order by sec_no, coalesce(k, 0)) as int) as place, section_id, substring(trim(coalesce(p, title) || ' ' || head), 1, 120) as query, case when p is not null then 'Topic of section “' || title || '”: ' || p else 'Section topic: ' || title end as claim from r
 qualify row_number() over (partition by paper_id order by sec_no, coalesce(k, 0)) <= 10""")  # fmt: skip
over("tex_round_trip", ("v_doc_section",), lambda s: s.select("paper_id", "sec_no", works.tex_tokens(F.col("content")).alias("tex")).withColumn("back", works.tokens_of_tex(F.col("tex"))),
     r"""with t as (select paper_id, sec_no, regexp_replace(regexp_replace(content, '\[\[cite([pt]):([A-Za-z0-9_,\- ]+?)\]\]', '\\cite\1{\2}', 'g'), '(\\cite[pt]\{[^} ]*) ([^} ]*\})', '\1\2', 'g') as tex from v_doc_section)
 select paper_id, sec_no, tex, regexp_replace(tex, '\\cite([pt])\{([^}]*)\}', '[[cite\1:\2]]', 'g') as back from t""")  # fmt: skip
over("tex_sections", ("v_meta", "v_doc_section", "v_doc_float", "v_cite_ref"), lambda m, s, f, r: works.sections_of_tex(exports.latex(_refs(m), s, f, _refs(r), "apa"), s))
over("clean_lines", ("v_page_line",), lambda l: l.select("paper_id", "line_seq", works.clean_text(F.col("text")).alias("text")),
     "select paper_id, line_seq, replace(replace(replace(replace(replace(nfc_normalize(text), '’', chr(39)), '‘', chr(39)), '“', '\"'), '”', '\"'), chr(160), ' ') as text from v_page_line")
over("latest_children", ("v_finding",), lambda f: works.children(f.select("paper_id", "seq", "ts"), "ts"), "select paper_id, seq, ts, cast(row_number() over (partition by paper_id order by ts desc, seq desc) as int) as place from v_finding")
