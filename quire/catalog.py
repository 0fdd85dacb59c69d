"""All queries of the library by name, with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .functions import citations as C
from .functions import text as T
from . import catalog_edits, catalog_entries, catalog_exports, catalog_intext, catalog_missing, catalog_similar, catalog_works
from .catalog_pages import HEADINGS
from .catalog_sentences import SENTENCES as _SENT
from .operators import integrity, layout, links, references, render, review
from .registry import ORACLES, QUERIES, over as _over, query

FLAGSHIP = "linked_citations_by_ref"

# ---- citation links ---------------------------------------------------------------------------

_NUMBERS = r"""
m as (select paper_id, section_id, family, unnest(regexp_extract_all(content, '\[(\d[\d\s,;–-]*)\]', 1)) as raw,
 generate_subscripts(regexp_extract_all(content, '\[(\d[\d\s,;–-]*)\]', 1), 1) - 1 as marker_no from v_section),
p as (select paper_id, section_id, marker_no, raw, unnest(list_transform(regexp_split_to_array(raw, '[,;]'), lambda x: trim(x))) as part,
 generate_subscripts(regexp_split_to_array(raw, '[,;]'), 1) as part_no from m),
r as (select *, case when regexp_full_match(part, '\d+') then cast(part as int) else try_cast(regexp_extract(part, '^(\d+)\s*[–-]\s*(\d+)$', 1) as int) end as a,
 case when regexp_full_match(part, '\d+') then cast(part as int) else try_cast(regexp_extract(part, '^(\d+)\s*[–-]\s*(\d+)$', 2) as int) end as b from p),
ok as (select paper_id, section_id, marker_no from r group by all having bool_and(coalesce(b >= a and b - a <= 40, false))),
n as (select r.paper_id, r.section_id, r.marker_no, r.raw, part_no, unnest(range(a, b + 1)) as num from r join ok using (paper_id, section_id, marker_no)),
lab as (select paper_id, label, arg_max(ref_id, ord) as ref_id from v_paper_ref group by paper_id, label),
l as (select n.*, lab.ref_id from n left join lab on lab.paper_id = n.paper_id and lab.label = cast(n.num as varchar)),
g as (select paper_id, section_id, marker_no, raw, count(*) as n_parts, count(ref_id) as n_linked from l group by all)"""

_over("expand_number_groups", ("v_section",), lambda s: links.number_markers(s, C.BRACKET).where("numbers is not null").select("paper_id", "section_id", "marker_no", F.explode(F.col("numbers").cast("array<bigint>")).alias("num")),
      f"with {_NUMBERS} select paper_id, section_id, marker_no, cast(num as bigint) as num from n")
_over("linked_citations_by_ref", ("v_section", "v_paper_ref"), links.linked_citations_by_ref,
      f"with {_NUMBERS} select l.paper_id, l.ref_id, count(*) as n_citations, count(distinct l.section_id) as n_sections from l join g on l.paper_id = g.paper_id and l.section_id = g.section_id and l.marker_no = g.marker_no and n_parts = n_linked group by l.paper_id, l.ref_id")
_over("unmatched_markers", ("v_section", "v_paper_ref"), links.unmatched_markers,
      f"with {_NUMBERS} select paper_id, section_id, marker_no, raw, n_parts - n_linked as n_missing from g where n_linked < n_parts")
_over("marker_families", ("v_section", "v_paper_ref"), links.marker_families,
      f"""with {_NUMBERS},
 pm as (select paper_id, unnest(regexp_extract_all(content, '\\((\\d{{1,3}}(?:\\s*[,;–-]\\s*\\d{{1,3}})*)\\)', 1)) as m, generate_subscripts(regexp_extract_all(content, '\\((\\d{{1,3}}(?:\\s*[,;–-]\\s*\\d{{1,3}})*)\\)', 1), 1) as k from v_section),
 sm as (select paper_id, unnest(regexp_extract_all(content, '⟨sup:(\\d[\\d\\s,;–-]*)⟩', 1)) as m, generate_subscripts(regexp_extract_all(content, '⟨sup:(\\d[\\d\\s,;–-]*)⟩', 1), 1) as k from v_section),
 q as (select paper_id, k, f, trim(unnest(string_split(m, ','))) as part from (select *, 'paren' as f from pm union all select *, 'superscript' as f from sm)),
 qq as (select q.paper_id, q.k, q.f from q left join lab on lab.paper_id = q.paper_id and lab.label = part group by all having count(*) = count(lab.ref_id)),
 u as (select paper_id, 'bracket' as f from g where n_parts = n_linked union all select paper_id, f from qq),
 c as (select paper_id, count(*) filter (f = 'bracket') as bracket, count(*) filter (f = 'paren') as paren, count(*) filter (f = 'superscript') as superscript from u group by paper_id)
 select paper_id, bracket, paren, superscript, case greatest(bracket, paren, superscript) when bracket then 'bracket' when paren then 'paren' else 'superscript' end as dominant,
 round(greatest(bracket, paren, superscript) / (bracket + paren + superscript), 2) as confidence from c""")  # fmt: skip
_over("tokenized_sections", ("v_section", "v_paper_ref"), links.tokenised,
      f"""with {_NUMBERS},
 ids as (select l.paper_id, l.marker_no, string_agg(l.ref_id, ',' order by part_no, num) as ids from l join g on l.paper_id = g.paper_id and l.marker_no = g.marker_no and n_parts = n_linked group by all),
 parts as (select paper_id, section_id, unnest(regexp_split_to_array(content, '\\[\\d[\\d\\s,;–-]*\\]')) as part, generate_subscripts(regexp_split_to_array(content, '\\[\\d[\\d\\s,;–-]*\\]'), 1) - 1 as k from v_section)
 select parts.paper_id, parts.section_id, string_agg(part || case when m.raw is null then '' when ids.ids is null then '[' || m.raw || ']' else '[[citep:' || ids.ids || ']]' end, '' order by k) as content
 from parts left join m on m.paper_id = parts.paper_id and m.marker_no = k left join ids on ids.paper_id = parts.paper_id and ids.marker_no = k group by all""")  # fmt: skip
_over("author_year_links", ("v_section", "v_paper_ref"), lambda s, r: links.author_year_links(s, r).where("ref_id is not null").select("paper_id", "family", "year", "ref_id"),
      r"""with x as (select paper_id, unnest(list_concat(regexp_extract_all(content, '(\p{Lu}[\p{L}\p{N}_''’-]*)(?:\s+et\s+al\.?|,)?[\s,]*((?:19|20)\d{2})[;)]', 0), regexp_extract_all(content, '\p{Lu}[\p{L}\p{N}_''’-]*\s*\(\d{4}[a-z]?\)', 0))) as part from v_section)
 select paper_id, lower(regexp_extract(part, '(\p{Lu}[\p{L}\p{N}_''’-]*)', 1)) as family, cast(regexp_extract(part, '(\d{4})', 1) as int) as year, ref_id from x
 join v_paper_ref using (paper_id) where lower(trim(split_part(author1, ',', 1))) = lower(regexp_extract(part, '(\p{Lu}[\p{L}\p{N}_''’-]*)', 1)) and v_paper_ref.year = cast(regexp_extract(part, '(\d{4})', 1) as int)
 qualify row_number() over (partition by paper_id, part order by ord) = 1""")  # fmt: skip

_TOKENS = r"""
t as (select paper_id, unnest(regexp_extract_all({c}, '\[\[cite[pt]:([A-Za-z0-9_,\- ]+?)\]\]', 1)) as ids, generate_subscripts(regexp_extract_all({c}, '\[\[cite[pt]:([A-Za-z0-9_,\- ]+?)\]\]', 1), 1) - 1 as token_no from v_token_section),
e as (select paper_id, token_no, unnest(string_split(ids, ',')) as ref_id, generate_subscripts(string_split(ids, ','), 1) as k from t)"""
_BEFORE, _AFTER = _TOKENS.replace("{c}", "before_text"), _TOKENS.replace("{c}", "after_text")
_over("token_multiset", ("v_token_section",), lambda t: integrity.multiset(t, "before_text"), f"with {_BEFORE} select paper_id, ref_id, count(*) as n from e group by all")
_FIRST = "f as (select paper_id, ref_id, row_number() over (partition by paper_id order by min(token_no * 1000 + k)) as number from e group by paper_id, ref_id)"
_over("first_appearance_numbering", ("v_token_section",), links.first_appearance, f"with {_BEFORE}, {_FIRST} select * from f")
_over("numeric_labels", ("v_token_section",), links.numeric_labels, f"with {_BEFORE}, {_FIRST} select paper_id, token_no, string_agg('[' || number || ']', ', ' order by k) as label from e join f using (paper_id, ref_id) group by paper_id, token_no")
_over("sentence_spans", ("v_section",), lambda s: s.select("paper_id", F.posexplode(T.sentences(F.col("content"), paired=True)).alias("sentence_no", "sentence")).select("paper_id", "sentence_no", F.trim("sentence").alias("sentence")),
      f"with {_SENT.format(c='content', v='v_section')} select paper_id, sentence_no, trim(sentence) as sentence from s")
_over("citation_context", ("v_token_section",), links.citation_context,
      f"""with {_SENT.format(c='before_text', v='v_token_section')}
 select paper_id, sentence_no, array_to_string(regexp_extract_all(sentence, '\\[\\[cite[pt]:([A-Za-z0-9_,\\- ]+?)\\]\\]', 1), ',') as ref_ids, trim(sentence) as context from s where sentence like '%[[cite%'""")  # fmt: skip
_over("claim_texts", ("v_token_section",), lambda t: review.claim_texts(t, "before_text"),
      f"""with {_SENT.format(c='before_text', v='v_token_section')},
 c as (select paper_id, sentence_no, trim(regexp_replace(regexp_replace(sentence, '\\[\\[cite([pt]):([A-Za-z0-9_,\\- ]+?)\\]\\]', '', 'g'), '\\s+', ' ', 'g')) as claim from s) select * from c where length(claim) >= 25""")  # fmt: skip
_over("bibliography_order", ("v_paper_ref",), links.bibliography,
      "select paper_id, ref_id, lower(trim(split_part(author1, ',', 1))) as family, year, cast(row_number() over (partition by paper_id order by lower(trim(split_part(author1, ',', 1))), year, lower(title), ord) as int) as place from v_paper_ref")

# ---- integrity ----------------------------------------------------------------------------------

_COUNTS = rf"""
b as (select paper_id, ref_id, count(*) as n from (select paper_id, unnest(string_split(i, ',')) as ref_id from (select paper_id, unnest(regexp_extract_all(before_text, '\[\[cite[pt]:([A-Za-z0-9_,\- ]+?)\]\]', 1)) as i from v_token_section)) group by all),
a as (select paper_id, ref_id, count(*) as n from (select paper_id, unnest(string_split(i, ',')) as ref_id from (select paper_id, unnest(regexp_extract_all(after_text, '\[\[cite[pt]:([A-Za-z0-9_,\- ]+?)\]\]', 1)) as i from v_token_section)) group by all),
ch as (select coalesce(a.paper_id, b.paper_id) as paper_id, coalesce(a.ref_id, b.ref_id) as ref_id, coalesce(b.n, 0) as n_before, coalesce(a.n, 0) as n_after from a full join b on a.paper_id = b.paper_id and a.ref_id = b.ref_id)"""
_REPORT = """
lo as (select paper_id, sum(n_before - n_after) as n_lost from ch where n_before > n_after group by 1),
un as (select paper_id, count(*) as n_unknown from a where not exists (select 1 from v_known_ref k where k.paper_id = a.paper_id and k.ref_id = a.ref_id) group by 1),
rep as (select p.paper_id, p.before_text, p.after_text, cast(coalesce(n_lost, 0) as bigint) as n_lost, coalesce(n_unknown, 0) as n_unknown,
 cast(case when coalesce(n_lost, 0) > 0 and removal_ack = 0 then 1 else 0 end + case when coalesce(n_unknown, 0) > 0 then 1 else 0 end as int) as n_blocking,
 cast(case when coalesce(n_lost, 0) > 0 and removal_ack = 1 then 1 else 0 end as int) as n_warning from v_token_section p left join lo using (paper_id) left join un using (paper_id))"""
_over("lost_citations", ("v_token_section",), integrity.lost, f"with {_COUNTS} select paper_id, ref_id, n_before - n_after as shortfall from ch where n_before > n_after")
_over("token_diff", ("v_token_section",), integrity.token_diff, f"with {_COUNTS} select paper_id, ref_id, case when n_before > n_after then 'missing' else 'invented' end as kind, abs(n_before - n_after) as n from ch where n_before <> n_after")
_over("unknown_refs", ("v_token_section", "v_known_ref"), integrity.unknown, f"with {_COUNTS} select paper_id, ref_id, n from a where not exists (select 1 from v_known_ref k where k.paper_id = a.paper_id and k.ref_id = a.ref_id)")
_over("integrity_report", ("v_token_section", "v_known_ref"), integrity.report, f"with {_COUNTS}, {_REPORT} select paper_id, n_lost, n_unknown, n_blocking, n_warning, n_blocking = 0 as ok from rep")


def _current(t: DataFrame) -> DataFrame:
    """Sections as they stand: every eleventh has changed since its proposal."""
    return t.select("paper_id", F.when(F.col("paper_id") % 11 == 0, F.concat("before_text", F.lit(" Edited."))).otherwise(F.col("before_text")).alias("content"), F.lit(1).alias("version"))


_over("apply_approved", ("v_token_section", "v_known_ref"), lambda t, r: integrity.apply(_current(t), t, r),
      f"""with {_COUNTS}, {_REPORT}, st as (select *, case when paper_id % 11 = 0 then before_text || ' Edited.' else before_text end as cur from rep)
 select paper_id, case when n_blocking = 0 and cur = before_text then after_text else cur end as content, cast(case when n_blocking = 0 and cur = before_text then 2 else 1 end as int) as version,
 case when n_blocking > 0 then 'blocked' when cur <> before_text then 'stale' else 'applied' end as status from st""")  # fmt: skip
_over("needed_new_refs", ("v_ref", "v_token_section"), lambda r, t: integrity.needed(r.select("ref_id", "title"), t),
      f"with {_COUNTS} select ref_id, title from v_ref where ref_id in (select ref_id from a)")

# ---- references ---------------------------------------------------------------------------------

_over("doi_year_extract", ("v_ref",), lambda r: references.fields(references.entry_text(r)).select("ref_id", "doi", "year"), "select ref_id, doi, year from v_ref")
_over("parse_confidence", ("v_ref",), references.confidence,
      """with c as (select ref_id, round(case when author1 is not null then 0.30 else 0 end + case when length(title) >= 8 then 0.30 else 0 end + case when year is not null then 0.20 else 0 end + case when container is not null then 0.10 else 0 end + case when doi is not null then 0.10 else 0 end, 2) as confidence from v_ref)
 select ref_id, cast(confidence as double) as confidence, confidence >= 0.5 as parsed_ok from c""")  # fmt: skip
_over("csl_type_guess", ("v_ref",), references.csl_types,
      "select ref_id, case when regexp_matches(coalesce(container, ''), '(?i)arxiv|preprint') then 'article' when regexp_matches(container, '(?i)proceedings|conference|workshop|symposium') then 'paper-conference' when container is not null then 'article-journal' else 'article' end as csl_type from v_ref")
_over("display_names", ("v_ref",), references.display_names, "select ref_id, trim(split_part(author1, ',', 1)) || ' et al., ' || cast(year as varchar) as display_name from v_ref")
_over("best_url", ("v_ref",), references.best_url, "select ref_id, 'https://doi.org/' || doi as url from v_ref")
_ESC = r"""replace(replace(replace(replace(replace({c}, '\', '\textbackslash{{}}'), '&', '\&'), '%', '\%'), '#', '\#'), '_', '\_')"""
_over("bibtex_entries", ("v_ref",), references.bibtex,
      f"""with k as (select *, case when container like 'Proc%' then 'inproceedings' when container like 'Journal%' then 'article' else 'misc' end as e, case when container like 'Proc%' then 'booktitle' when container like 'Journal%' then 'journal' else 'howpublished' end as v from v_ref)
 select ref_id, '@' || e || '{{' || ref_id || ',' || chr(10) || concat_ws(',' || chr(10), '  title = {{' || {_ESC.format(c='title')} || '}}', '  author = {{' || author1 || '}}', '  year = {{' || cast(year as varchar) || '}}', '  ' || v || ' = {{' || {_ESC.format(c='container')} || '}}', '  doi = {{' || doi || '}}') || chr(10) || '}}' as entry from k""")  # fmt: skip
_over("next_ref_numbers", ("v_paper_ref", "v_search"), lambda r, s: references.next_numbers(r, s.select("paper_id", "seq")),
      "select paper_id, seq, 'ref_' || cast((select max(ord) from v_paper_ref r where r.paper_id = v_search.paper_id) + row_number() over (partition by paper_id order by seq) as varchar) as ref_id from v_search")

# ---- layout -------------------------------------------------------------------------------------

_HEADS = r"""
pg as (select paper_id, max(page) + 1 as np from v_line group by 1),
hd as (select paper_id, regexp_replace(lower(trim(text)), '\d+', '#', 'g') as head, count(distinct page) as n_pages from v_line where y0 < 26 or y0 > 234 group by all),
hh as (select hd.paper_id, head, n_pages from hd join pg using (paper_id) where n_pages >= greatest(2.0, 0.35 * np))"""
_BODY = "bs as (select paper_id, size as body_size from (select paper_id, round(size, 1) as size, sum(length(text)) as mass, min(line_seq) as seq from v_line group by paper_id, round(size, 1)) qualify row_number() over (partition by paper_id order by mass desc, seq) = 1)"
_over("running_heads", ("v_line",), layout.running_heads, f"with {_HEADS} select * from hh")
_over("body_font_size", ("v_line",), layout.body_size, f"with {_BODY} select * from bs")
_over("header_footer_filter", ("v_line",), lambda l: layout.without_furniture(l).select("paper_id", "line_seq"),
      rf"""with {_HEADS} select paper_id, line_seq from v_line v where trim(text) <> '' and not (regexp_matches(text, '{layout.PAGE_NUMBER}') and (y0 < 26 or y0 > 234))
 and not exists (select 1 from hh where hh.paper_id = v.paper_id and hh.head = regexp_replace(lower(trim(v.text)), '\d+', '#', 'g'))""")  # fmt: skip


def _heads(lines: DataFrame) -> DataFrame:
    """Every tenth line as a heading, so that sections exist in the injected lines."""
    return lines.where("line_seq % 10 = 3").select("paper_id", "line_seq")


_SECT = "sl as (select paper_id, line_seq, page, sum(case when line_seq % 10 = 3 then 1 else 0 end) over (partition by paper_id order by line_seq) as section_no from v_line)"
_over("section_assignment", ("v_line",), lambda l: layout.section_lines(l, _heads(l)).select("paper_id", "line_seq", "section_no"), f"with {_SECT} select paper_id, line_seq, cast(section_no as bigint) as section_no from sl where line_seq % 10 <> 3")
_over("section_extents", ("v_line",), lambda l: layout.section_extents(l, _heads(l)),
      f"with {_SECT} select paper_id, cast(section_no as bigint) as section_no, arg_min(page, line_seq) as page_start, arg_max(page, line_seq) as page_end, count(*) as n_lines from sl where line_seq % 10 <> 3 group by paper_id, section_no")


def _titled(lines: DataFrame) -> DataFrame:
    """Larger lines turned into headings, numbered or known, so that some exist."""
    name = F.when(F.col("line_seq") % 36 == 1, "Introduction").when(F.col("line_seq") % 36 == 13, F.concat(F.lit("2."), (F.col("paper_id") % 5 + 1).cast("string"), F.lit(" Model Details"))).otherwise("REFERENCES")
    return lines.withColumn("text", F.when(F.col("size") == 12, name).otherwise(F.col("text")))


_TITLED = "tl as (select * replace (case when size = 12 then case line_seq % 36 when 1 then 'Introduction' when 13 then '2.' || cast(paper_id % 5 + 1 as varchar) || ' Model Details' else 'REFERENCES' end else text end as text), 1 = 0 as mostly_bold from v_line)"
_over("headings", ("v_line",), lambda l: layout.headings(_titled(l)), f"with {_TITLED}, {HEADINGS.format(lines='tl')} select * from hd")
_over("paragraphs", ("v_line",), layout.paragraphs,
      """with g as (select *, lag(page) over w as pp, lag(x0) over w as px, lag(y0) over w as py from v_line window w as (partition by paper_id order by line_seq)), m as (select paper_id, median(size) as h from v_line group by 1),
 n as (select g.*, case when pp is null or pp <> page or (px < 200) <> (x0 < 200) or y0 - py - size > 0.85 * h then 1 else 0 end as nw from g join m using (paper_id))
 select paper_id, line_seq, cast(sum(nw) over (partition by paper_id order by line_seq) as bigint) as paragraph_no from n""")  # fmt: skip
_over("hanging_indent_entries", ("v_line",), layout.entry_starts,
      """with s as (select paper_id, line_seq, case when x0 <= min(x0) over (partition by paper_id, page) + 2.5 then 1 else 0 end as st from v_line),
 e as (select *, sum(st) over (partition by paper_id order by line_seq) as entry_no from s) select paper_id, cast(entry_no as bigint) as entry_no, count(*) as n_lines, min(line_seq) as first_line from e group by paper_id, entry_no""")  # fmt: skip
_over("reading_order", ("v_line",), layout.reading_order,
      """with c as (select *, count(*) filter (x0 >= 270) over p >= 5 and count(*) filter (x0 < 270) over p >= 5 as two from v_line window p as (partition by paper_id, page))
 select paper_id, page, line_seq, cast(row_number() over (partition by paper_id, page order by case when two and x0 >= 270 then 1 else 0 end, round(y0, 1), x0, line_seq) as int) as place from c""")  # fmt: skip
_CLAIM = "cl as (select l.paper_id, l.line_seq, min(region_no) as region_no from v_line l join v_region r on l.paper_id = r.paper_id and l.page = r.page and l.x0 + 100 between r.x0 and r.x1 and l.y0 + l.size / 2 between r.y0 and r.y1 group by 1, 2)"
_over("line_in_region", ("v_line", "v_region"), layout.lines_in_regions, f"with {_CLAIM} select * from cl")
_over("free_regions", ("v_region",), layout.free_regions,
      "select paper_id, page, region_no, kind from v_region a where not exists (select 1 from v_region b where a.paper_id = b.paper_id and a.page = b.page and b.region_no < a.region_no and a.kind <> b.kind and a.x0 < b.x1 and b.x0 < a.x1 and a.y0 < b.y1 and b.y0 < a.y1)")
_over("caption_nearest_region", ("v_line", "v_region"), layout.nearest_captions,
      """with c as (select r.paper_id, r.region_no, l.line_seq, greatest(l.y0 - r.y1, r.y0 - (l.y0 + l.size), 0.0) as gap from v_region r join v_line l on l.paper_id = r.paper_id and l.page = r.page and least(l.x0 + 200, r.x1) > greatest(l.x0, r.x0))
 select paper_id, region_no, line_seq, gap from c where gap < 40 qualify row_number() over (partition by paper_id, region_no order by gap, line_seq) = 1""")  # fmt: skip
_over("float_anchor_asof", ("v_line", "v_region"), layout.float_anchors,
      f"""with {_CLAIM}, z as (select l.paper_id, l.line_seq, region_no, max(case when region_no is null then l.line_seq end) over (partition by l.paper_id order by l.line_seq rows between unbounded preceding and 1 preceding) as anchor from v_line l left join cl using (paper_id, line_seq))
 select paper_id, region_no, anchor as anchor_line from z where region_no is not null qualify row_number() over (partition by paper_id, region_no order by line_seq) = 1""")  # fmt: skip
_over("readability_gate", ("v_line",), lambda l: layout.readability(l.groupBy("paper_id", "page").agg(F.sum(F.length("text")).alias("n_chars"))),
      "with p as (select paper_id, page, sum(length(text)) as n from v_line group by all) select paper_id, cast(sum(n) as bigint) as n_chars, count(*) filter (n = 0) as n_empty, case when sum(n) < 200 then 'error' when count(*) filter (n = 0) > 0 then 'warning' else 'ok' end as status from p group by 1")

# ---- review -------------------------------------------------------------------------------------

_over("already_cited_doi", ("v_source", "v_ref"), lambda s, r: review.already_cited(s, r).select("seq", "doi"), "select seq, doi from v_source where lower(doi) in (select lower(doi) from v_ref where doi is not null)")
_over("candidate_dedupe", ("v_source", "v_ref"), review.new_candidates,
      "with k as (select *, coalesce(lower(doi), 't:' || substring(lower(title), 1, 80)) as key from v_source where doi is null or lower(doi) not in (select lower(doi) from v_ref where doi is not null)) select key, min(seq) as seq, arg_min(api_id, seq) as api_id from k group by key")
_over("keyword_rank_topk", ("v_ref", "v_source"), lambda r, s: review.ranked(r.select(F.col("ord").alias("claim_id"), F.col("title").alias("claim")), s),
      """with sw as (select unnest(string_split('the of and to in a is that for on with as by this it are be an or was from at we our', ' ')) as w),
 cw as (select distinct ord as claim_id, w from (select ord, unnest(regexp_split_to_array(lower(title), '[^\\p{L}\\p{N}]+')) as w from v_ref) where length(w) >= 3 and w not in (select w from sw)),
 cn as (select claim_id, greatest(count(*), 3) as n from cw group by 1),
 sws as (select distinct seq, cited_by_count, w from (select seq, cited_by_count, unnest(regexp_split_to_array(lower(title), '[^\\p{L}\\p{N}]+')) as w from v_source)),
 sc as (select cw.claim_id, sws.seq, round(least(1.0, 0.7 * cast(count(*) as double) / n + 0.3 * log10(cited_by_count + 1.0) / 5), 6) as score from cw join sws using (w) join cn using (claim_id) group by cw.claim_id, sws.seq, n, cited_by_count),
 k3 as (select * from sc qualify row_number() over (partition by claim_id order by score desc, seq) <= 3),
 k8 as (select *, cast(row_number() over (order by score desc, claim_id, seq) as int) as place from k3 qualify row_number() over (order by score desc, claim_id, seq) <= 8)
 select claim_id, seq, score, place from k8 where score >= 0.4""")  # fmt: skip
_over("bigram_topics", ("v_section",), review.bigrams,
      """with sw as (select unnest(string_split('the of and to in a is that for on with as by this it are be an or was from at we our', ' ')) as w),
 w as (select paper_id, list_filter(regexp_split_to_array(lower(content), '[^a-z]+'), lambda x: length(x) > 0) as a from v_section),
 b as (select paper_id, a[i] as x, a[i + 1] as y, i from (select paper_id, a, unnest(range(1, len(a))) as i from w)),
 n as (select paper_id, x || ' ' || y as bigram, count(*) as n, min(i) as f from b where x not in (select w from sw) and y not in (select w from sw) group by all having count(*) >= 2)
 select paper_id, bigram, n, cast(row_number() over (partition by paper_id order by n desc, f) as int) as place from n qualify row_number() over (partition by paper_id order by n desc, f) <= 6""")  # fmt: skip
_over("claim_sample", ("v_token_section",), review.claim_sample,
      f"""with {_BEFORE}, c as (select paper_id, token_no as pos, bool_or(token_no = m) as covers from (select *, min(token_no) over (partition by paper_id, ref_id) as m from e) group by all)
 select paper_id, pos, covers, cast(row_number() over (partition by paper_id order by covers desc, pos) as int) as place from c qualify row_number() over (partition by paper_id order by covers desc, pos) <= 2""")  # fmt: skip
_over("finding_severity_order", ("v_finding",), review.by_severity,
      "select paper_id, seq, severity, cast(row_number() over (partition by paper_id order by case severity when 'high' then 0 when 'medium' then 1 when 'low' then 2 when 'info' then 3 else 9 end, seq) as int) as place from v_finding")
_over("finding_groups", ("v_finding",), review.group_counts,
      "select paper_id, case when type = 'missing_work' then 'act' when type in ('claim_supported', 'claim_unverifiable') then 'checked' when type = 'unparsed_reference' then 'refs' else 'failed' end as \"group\", count(*) as n from v_finding group by all")
_over("finding_labels", ("v_finding",), review.labels, "select paper_id, type, count(*) as n, arg_min(severity, seq) as severity, min(seq) as first_seq from v_finding group by all")
_over("collapse_failures", ("v_finding",), review.collapsed, "select paper_id, case when type = 'search_failure' then 't:' || title else 's:' || cast(seq as varchar) end as key, count(*) as n, min(seq) as seq from v_finding group by paper_id, key")
_over("status_histogram", ("v_finding",), review.status_histogram, "select type, count(*) as n, count(distinct paper_id) as n_papers from v_finding group by type")
_over("warnings_by_stage", ("v_finding",), review.warnings_by_stage, "select type, count(*) as n, min(title) as first_title from v_finding where severity = 'low' group by type")
_over("stage_durations", ("v_finding",), review.stage_durations,
      "select paper_id, seq, cast(floor((epoch_us(ts) - lag(epoch_us(ts)) over (partition by paper_id order by ts, seq)) / 1000000.0) as bigint) as elapsed from v_finding qualify elapsed is not null")
_over("resolution_ladder", ("v_source", "v_ref"), review.resolution_counts,
      """with d as (select lower(doi) as k, min(seq) as s from v_source where doi is not null group by 1), t as (select lower(title) as k, min(seq) as s from v_source group by 1)
 select ref_id, case when d.s is not null then 'doi' when t.s is not null then 'title' else 'unresolved' end as method, coalesce(d.s, t.s, -1) as seq from v_ref r left join d on d.k = lower(r.doi) left join t on t.k = lower(r.title)""")  # fmt: skip

# ---- exports ------------------------------------------------------------------------------------

_over("tex_escape_shielded", ("v_token_section",), render.tex,
      r"""with p as (select paper_id, regexp_split_to_array(after_text, '\[\[cite[pt]:[A-Za-z0-9_,\- ]+?\]\]') as a, regexp_extract_all(after_text, '\[\[cite([pt]):([A-Za-z0-9_,\- ]+?)\]\]', 1) as k, regexp_extract_all(after_text, '\[\[cite([pt]):([A-Za-z0-9_,\- ]+?)\]\]', 2) as v from v_token_section)
 select paper_id, array_to_string(list_transform(range(1, len(a) + 1), lambda i: regexp_replace(a[i], '([&%#_])', '\\\1', 'g') || case when i <= len(k) then '\cite' || k[i] || '{' || v[i] || '}' else '' end), '') as tex from p""")  # fmt: skip
_over("markdown_export", ("v_section",), render.markdown, "select paper_id, string_agg('## ' || section_id || chr(10) || chr(10) || content, chr(10) || chr(10) order by section_id) as markdown from v_section group by paper_id")
_over("paragraph_parts", ("v_token_section",), render.paragraph_parts,
      r"""with p as (select paper_id, regexp_split_to_array(after_text, '\[\[cite[pt]:[A-Za-z0-9_,\- ]+?\]\]') as a, regexp_extract_all(after_text, '\[\[cite[pt]:([A-Za-z0-9_,\- ]+?)\]\]', 1) as k from v_token_section),
 q as (select paper_id, unnest(flatten(list_transform(a, lambda x, i: case when i <= len(k) then [struct_pack(kind := 'text', value := x), struct_pack(kind := 'cite', value := k[i])] else [struct_pack(kind := 'text', value := x)] end))) as x,
  generate_subscripts(flatten(list_transform(a, lambda x, i: case when i <= len(k) then [1, 2] else [1] end)), 1) - 1 as part_no from p) select paper_id, cast(part_no as int) as part_no, x.kind, x.value from q""")  # fmt: skip
_over("paper_catalog", ("v_section",), render.catalogue, "select paper_id, count(*) as n_sections, cast(sum(length(content)) as bigint) as n_chars, max(section_id) as last_section from v_section group by paper_id")
