"""Scholarly relations injected over the driver's tables, in one SQL text for both engines.

The driver's documents hold no citations, so these views add them deterministically. VIEWS holds
the text that runs in Spark and in the SQL oracles.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

VIEWS: dict[str, str] = {
    "v_ref": """select item_id + 1 as ord, concat('ref_', cast(item_id + 1 as varchar(20))) as ref_id, cast(item_id + 1 as varchar(20)) as label,
 concat(case item_id % 8 when 0 then 'Smith' when 1 then 'Doe' when 2 then 'Chen' when 3 then 'Müller' when 4 then 'Álvarez' when 5 then 'Öztürk' when 6 then 'Li' else 'Wu' end, ', ', case item_id % 3 when 0 then 'J.' when 1 then 'A.' else 'L.' end) as author1,
 cast(1990 + item_id % 35 as int) as year, split_part(replace(text, chr(10), ' '), '.', 1) as title,
 case when item_id % 3 = 0 then concat('10.1000/x', cast(item_id as varchar(20))) else null end as doi,
 case item_id % 4 when 0 then 'Proceedings of Tests' when 1 then 'Journal of Tests' when 2 then 'arXiv preprint' else null end as container from benchmark""",
    "v_section": """select doc_id as paper_id, concat('sec_', cast(doc_id % 3 + 1 as varchar(20))) as section_id, cast(doc_id % 4 as int) as family,
 case doc_id % 4
  when 0 then concat('Prior work [', cast(doc_id % 45 + 1 as varchar(20)), '] holds. ', replace(text, chr(10), ' '), ' Later [', cast((doc_id * 7) % 40 + 1 as varchar(20)), ', ', cast((doc_id * 3) % 30 + 1 as varchar(20)), '-', cast((doc_id * 3) % 30 + 3 as varchar(20)), '] agrees.')
  when 1 then concat('Smith (', cast(1990 + (doc_id * 8) % 35 as varchar(20)), ') argued. ', replace(text, chr(10), ' '), ' Others agree (Müller, 1993; Doe et al., 1991).')
  when 2 then concat('Early work (', cast(doc_id % 40 + 1 as varchar(20)), ') grew (', cast((doc_id * 7) % 40 + 1 as varchar(20)), ') and (1, 3). ', replace(text, chr(10), ' '))
  else concat('Nets⟨sup:', cast(doc_id % 40 + 1 as varchar(20)), '⟩ and sets⟨sup:1,2⟩ and maps⟨sup:3⟩. ', replace(text, chr(10), ' ')) end as content from documents""",
    "v_token_section": """select doc_id as paper_id, concat('Claim one [[citep:ref_', cast(doc_id % 40 + 1 as varchar(20)), ']]. ', replace(text, chr(10), ' '), ' Claim two [[citet:ref_', cast((doc_id * 7) % 40 + 1 as varchar(20)), ']] and [[citep:ref_1,ref_', cast((doc_id * 3) % 40 + 1 as varchar(20)), ']].') as before_text,
 concat('Claim one ', case when doc_id % 5 = 0 then '' else concat('[[citep:ref_', cast(doc_id % 40 + 1 as varchar(20)), ']]') end, '. ', replace(text, chr(10), ' '), ' Claim two [[citet:ref_', cast((doc_id * 7) % 40 + 1 as varchar(20)), ']] and [[citep:ref_1,ref_', cast((doc_id * 3) % 40 + 1 as varchar(20)), ']].', case when doc_id % 7 = 0 then ' New [[citep:ref_999]].' else '' end) as after_text,
 case when doc_id % 10 = 0 then 1 else 0 end as removal_ack from documents""",
    "v_finding": """select event_id as seq, user_id as paper_id, ts, case event_type when 'purchase' then 'missing_work' when 'view' then 'claim_supported' when 'click' then 'claim_unverifiable' when 'signup' then 'unparsed_reference' else 'search_failure' end as type,
 case event_type when 'purchase' then 'medium' when 'view' then 'info' when 'error' then 'info' else 'low' end as severity, concat(event_type, ' ', cast(event_id % 11 as varchar(20))) as title, value / 100.0 as score from events""",
    "v_region": """select paper_id, page, cast(page * 3 + r as int) as region_no, case r when 0 then 'table' when 1 then 'box' else 'figure' end as kind,
 cast(60 + 20 * r as double) as x0, cast(110 + 30 * r as double) as y0, cast(300 + 40 * r as double) as x1, cast(150 + 30 * r as double) as y1
 from (select distinct paper_id, page from v_line) p cross join (select 0 as r union all select 1 union all select 2) k""",
    "v_source": """select doc_id as seq, case when doc_id % 2 = 0 then 'openalex' else 'semantic_scholar' end as api, concat('W', cast(doc_id as varchar(20))) as api_id,
 split_part(replace(text, chr(10), ' '), '.', 1) as title, cast(1980 + doc_id % 40 as int) as year,
 case when doc_id % 3 = 0 then concat('10.1000/X', cast(doc_id % 80 as varchar(20))) else null end as doi,
 concat('https://example.org/W', cast(doc_id as varchar(20))) as url, cast(n_chars as int) as cited_by_count from documents""",
}
#: Each paper has a bibliography of its own: up to 40 references, dealt from all by its id.
VIEWS["v_paper_ref"] = """select d.doc_id as paper_id, k.item_id + 1 as ord, concat('ref_', cast(k.item_id + 1 as varchar(20))) as ref_id, cast(k.item_id + 1 as varchar(20)) as label, r.author1, r.year, r.title, r.doi, r.container,
 case when k.item_id % 4 = 3 then concat('2101.', cast(10000 + k.item_id + d.doc_id % 7 as varchar(20))) end as arxiv from documents d join benchmark k on k.item_id < 40 and (d.doc_id + k.item_id) % 5 <> 0 join (select count(*) as n from benchmark) c on true join v_ref r on r.ord = (d.doc_id * 7 + k.item_id) % c.n + 1"""
_LINE = """select doc_id as paper_id, cast(line_seq as int) as line_seq, cast(floor(line_seq / 12.0) as int) as page,
 case when line_seq % 12 = 0 then concat('Running head ', cast(cast(floor(line_seq / 12.0) as int) as varchar(20))) else text end as text,
 cast(case when line_seq % 12 in (5, 6, 7) and doc_id % 2 = 0 then 330 when line_seq % 3 = 2 then 90 else 72 end as double) as x0,
 cast(case when line_seq % 12 = 0 then 20 else 90 + 14 * (line_seq % 12) end as double) as y0,
 cast(case when line_seq % 12 = 1 then 12 else 10 end as double) as size from ({raw}) z"""
#: Lines of at most 60 characters, on pages of 40 lines in another order than they are read: two of three papers in two columns
#: with three lines across, the third in one column with number-only lines beside their headings.
VIEWS["v_page_line"] = """select paper_id, line_seq, page, text, x0, case when x0 = 60 and n = 1 then 72.0 when n = 1 then x0 + 10 when wide = 1 then 540.0 when two = 1 then x0 + 230 else 540.0 end as x1, y0, y0 + 11 as y1, size, bold, n as is_number from (
 select paper_id, line_seq, page, two, size, bold, n, wide, case when n = 1 then case line_seq % 3 when 0 then '2.1' when 1 then 'IV.' else 'B.' end else text end as text,
 cast(case when wide = 1 then 60 when two = 1 then case when side = 0 then 60 else 320 end when side = 0 then case when row5 = 2 then 100 else 60 end when row5 = 1 then 80 when row5 = 2 then 118 else 80 end as double) as x0,
 cast(40 + 18 * row_no as double) + case when two = 1 then side * 0.02 when row5 = 2 then -17 when row5 in (0, 3, 4) then side * 9 else 0 end as y0 from (
 select *, case when two = 1 and slot in (0, 14, 26) then 1 else 0 end as wide, case when two = 0 and ((side = 0 and row5 in (1, 2) and not (row5 = 2 and paper_id % 2 = 0)) or (side = 1 and row5 = 1)) then 1 else 0 end as n from (
 select *, cast(floor(slot / 2.0) as int) as row_no, slot % 2 as side, cast(floor(slot / 2.0) as int) % 5 as row5 from (
 select doc_id as paper_id, cast(line_seq as int) as line_seq, cast(floor(line_seq / 40.0) as int) as page, cast((line_seq % 40) * 7 % 40 as int) as slot, case when doc_id % 3 = 2 then 0 else 1 end as two, text,
 cast(case when line_seq % 40 = 2 then 14 when line_seq % 40 = 9 then 13.8 else 10 end as double) as size, case when line_seq % 11 = 4 then 1 else 0 end as bold from v_raw_line) a) b) c) d"""
#: Three spans a line; some are raised numbers, some raised letters.
VIEWS["v_span"] = """select paper_id, page, line_seq, span_no, case raised when 1 then case when line_seq % 4 = 3 then 'th' when span_no = 0 then '1' else ' 2,3 ' end else text end as text,
 size, case when (line_seq + span_no) % 9 = 1 then 'Serif-Bold' when (line_seq + span_no) % 9 = 4 then 'Serif-Oblique' else 'Serif' end as font, raised + case when line_seq % 8 = 1 then 16 else 0 end + case when span_no = 2 and line_seq % 6 = 2 then 2 else 0 end as flags, x0 + 70 * span_no as x0, y0, x0 + 70 * span_no + 60 as x1, y1 from (
 select l.paper_id, l.page, l.line_seq, cast(k.item_id as int) as span_no, substring(l.text, cast(20 * k.item_id + 1 as int), 20) as text, l.size, l.x0, l.y0, l.y1, case when (l.line_seq * 3 + k.item_id) % 7 in (0, 1) then 1 else 0 end as raised from v_page_line l join benchmark k on k.item_id < 3) z"""
#: Front matter on the first page, and lines that are, or nearly are, headings.
VIEWS["v_head_line"] = """select paper_id, line_seq, page, x0, y0, x1, y1, size, case when bold = 1 or (line_seq > 9 and line_seq % 10 in (0, 6)) then 1 = 1 else 1 = 0 end as mostly_bold, case
 when line_seq = 1 and paper_id % 2 = 0 then 'Abstract—We show that this holds' when line_seq = 3 then 'Ada M. Lovelace' when line_seq = 4 then 'Alan Turing∗†' when line_seq = 5 then 'University of Tests' when line_seq = 6 then 'Grace Hopper1,2' when line_seq = 7 then 'someone@tests.org' when line_seq = 8 and paper_id % 5 = 0 then 'Open Academy' when line_seq = 8 then 'O''Neil van Stone'
 when line_seq % 10 = 0 and line_seq > 9 then case (paper_id + line_seq) % 9 when 0 then 'Introduction' when 1 then '3.1 Training Details' when 2 then '3.1 Training Details.' when 3 then 'IV. RESULTS' when 4 then 'B. Ablation Study' when 5 then '2 x = y + 4 - 12' when 6 then 'REFERENCES' when 7 then '12.4.1. Long Runs' else 'Discussion:' end
 when line_seq % 10 = 3 and line_seq > 9 then case paper_id % 3 when 0 then 'methods' when 1 then '5 Conclusion' else 'APPENDIX' end else text end as text from v_page_line"""
#: Nine drawings, tables and images a page, among them panels over each other, frames of the page and rules.
VIEWS["v_drawing"] = """select paper_id, page, case when j = 0 and paper_id % 3 = 0 then 'table' when j < 6 then 'drawing' else 'image' end as kind, cast(j as bigint) as seq, x0, y0, x0 + w as x1, y0 + h as y1, case when j = 0 and paper_id % 3 = 0 then 'a | b' else '' end as body from (
 select p.paper_id, p.page, k.item_id as j, cast(case when k.item_id % 4 = 3 then 320 else 60 + 3 * k.item_id end as double) as x0, cast(60 + (p.paper_id * 31 + p.page * 17 + k.item_id * k.item_id * 23) % 280 as double) as y0,
 cast(case when k.item_id = 4 then 590 when k.item_id = 5 then 80 else 200 + (p.paper_id + k.item_id * 7) % 40 end as double) as w, cast(case when k.item_id = 4 and p.paper_id % 2 = 0 then 790 else 22 + (p.paper_id * 5 + k.item_id * 13) % 34 end as double) as h
 from (select distinct paper_id, page from v_page_line) p join benchmark k on k.item_id < 9) z"""
#: Pages with captions: some near a region, some apart, most with lines that go on.
VIEWS["v_caption_line"] = """select paper_id, line_seq, page, x0, y0, x1, y1, size, case when line_seq % 9 = 5 and is_number = 0 then concat(case (paper_id + line_seq) % 4 when 0 then 'Table ' when 1 then 'Fig. ' when 2 then 'FIGURE ' else 'Figured ' end, cast(line_seq as varchar(20)), case when line_seq % 2 = 0 then '. ' else ': ' end, text) else text end as text from v_page_line"""
VIEWS["v_paper"] = "select doc_id as paper_id, substring(replace(text, chr(10), ' '), 1, 50) as title from documents"
#: What a search brought: every third reference of the paper, under another title, address or spelling, and the paper itself.
VIEWS["v_search"] = """select r.paper_id, cast(r.ord as bigint) as seq, case (r.paper_id + r.ord) % 7 when 0 then upper(r.doi) else null end as doi,
 case when (r.paper_id + r.ord) % 7 = 4 and r.arxiv is not null then concat('https://arxiv.org/abs/', r.arxiv, 'v2') else 'https://example.org/' end as url, case when (r.paper_id + r.ord) % 7 = 5 and r.arxiv is not null then concat('arXiv:', r.arxiv) else null end as note,
 case (r.paper_id + r.ord) % 7 when 1 then substring(r.title, 4, 60) when 2 then concat(substring(r.title, 1, 20), 'Xy', substring(r.title, 26, 35)) when 3 then substring(r.title, 15, 60) when 6 then concat(substring(p.title, 3, 50), '!') else concat('Quite another work of ', r.author1, cast(r.ord as varchar(20))) end as title
 from v_paper_ref r join v_paper p on p.paper_id = r.paper_id where r.ord % 3 = 0"""
#: Author-year parts: families as printed, misspelt, or of another year.
VIEWS["v_author_part"] = """select paper_id, cast(ord as int) as k, concat(split_part(author1, ',', 1), case (paper_id + ord) % 4 when 1 then 's' when 2 then 'sen' else '' end) as family, cast(year + case when ord % 9 = 0 then 1 else 0 end as int) as year, case ord % 5 when 1 then 'b' when 2 then 'a' else '' end as letter from v_paper_ref where ord % 2 = 0"""
#: Sentences as a reviewer quotes them.
VIEWS["v_claim"] = """select doc_id as paper_id, concat('sec_', cast(doc_id % 3 + 1 as varchar(20))) as section_id, cast(k.item_id as int) as claim_no, case k.item_id when 0 then substring(replace(d.text, chr(10), ' '), 1, 70) when 1 then 'Early work, prior work holds!' when 2 then 'Others also agree (1993; Doe 1991)' else 'nothing of the kind' end as sentence from documents d join benchmark k on k.item_id < 4"""
#: Findings that a reviewer accepted: new works, known ones by DOI or title, ones without a source or a section.
VIEWS["v_accept"] = """select c.paper_id * 4 + c.claim_no as finding_id, c.paper_id, case when c.claim_no = 3 and c.paper_id % 2 = 0 then 'sec_9' else c.section_id end as section_id, c.sentence as claim, 'openalex' as api, concat('https://example.org/', cast(c.paper_id as varchar(20))) as url,
 case when c.paper_id % 6 = 1 and c.claim_no = 1 then upper(r.doi) end as doi, case when c.claim_no = 2 and c.paper_id % 4 = 0 then null when c.claim_no = 0 and c.paper_id % 5 = 0 then concat(' ', upper(r.title), ' ') else concat('New work ', cast(c.claim_no as varchar(20))) end as title
 from v_claim c join (select paper_id, min(ord) as ord from v_paper_ref group by paper_id) m on m.paper_id = c.paper_id join v_paper_ref r on r.paper_id = c.paper_id and r.ord = m.ord"""
#: Operations of commands: two of three look for citations; every fifth names an unknown section; every other rewrite begins from the section as it was.
VIEWS["v_op"] = """select s.paper_id as proposal_id, s.paper_id, cast(k.item_id as int) as op_no, case when (s.paper_id + k.item_id) % 3 = 2 then 'rewrite_section' else 'find_citations' end as op,
 case when (s.paper_id + k.item_id) % 5 = 4 then 'sec_9' else s.section_id end as section_id, cast(1 + (s.paper_id + k.item_id) % 3 as int) as max_new, case when (s.paper_id + k.item_id) % 3 = 2 and s.paper_id % 4 <> 3 then concat('In short, ', s.content) end as text
 from v_section s join benchmark k on k.item_id < 2 + s.paper_id % 3"""
VIEWS["v_asked"] = """select o.proposal_id, o.op_no, c.claim_no, c.sentence, case when (o.proposal_id + c.claim_no) % 4 = 3 then 'Same Query' when c.claim_no = 1 and o.proposal_id % 6 = 0 then ' ' else concat('query ', cast(c.claim_no as varchar(20))) end as query from v_op o join v_claim c on c.paper_id = o.paper_id where o.op = 'find_citations'"""
VIEWS["v_offer"] = """select a.proposal_id, a.op_no, a.claim_no, cast(k.item_id as bigint) as seq, concat(case when k.item_id % 2 = 0 then 'Source ' else 'SOURCE ' end, cast((a.proposal_id + k.item_id + a.claim_no) % 4 as varchar(20))) as title, (a.proposal_id * 7 + a.claim_no * 3 + k.item_id * 5) % 10 / 10.0e0 as score from v_asked a join benchmark k on k.item_id < 5"""
VIEWS["v_spot"] = """select a.proposal_id, o.max_new, a.claim_no, a.query, case when a.claim_no = (a.proposal_id % 4) then null else a.claim_no end as sentence_no from v_asked a join v_op o on o.proposal_id = a.proposal_id and o.op_no = a.op_no where a.op_no = 0"""
#: Proposals of two changes, in sec_1 and sec_2, with new references of which some lack a source or are cited by nothing.
VIEWS["v_change"] = """select paper_id * 2 as proposal_id, paper_id, paper_id * 10 + 1 as change_id, 'sec_1' as section_id, before_text as before, after_text as after, concat('Improve the text of paper ', cast(paper_id as varchar(20))) as command from v_token_section
 union all select paper_id * 2, paper_id, paper_id * 10 + 2, case when paper_id % 13 = 5 then 'sec_9' else 'sec_2' end, 'Nets [[citep:ref_2]] learn.', case when paper_id % 6 = 1 then 'Nets learn.' else concat('Nets [[citep:ref_2]] learn [[citet:ref_9', cast(paper_id % 4 as varchar(20)), ']].') end, 'x' from v_token_section
 union all select paper_id * 2 + 1, paper_id, paper_id * 10 + 3, 'sec_2', 'Nets [[citep:ref_2]] learn.', 'Nets [[citep:ref_2]] learn well.', null from v_token_section where paper_id % 3 = 0"""
VIEWS["v_new_ref"] = """select paper_id * 2 as proposal_id, concat('ref_9', cast(k.item_id as varchar(20))) as ref_id, 'openalex' as source, case when paper_id % 8 = 3 and k.item_id = 1 then null else 'https://example.org' end as source_url from v_token_section t join benchmark k on k.item_id < 3"""
VIEWS["v_removal"] = """select paper_id * 2 as proposal_id, 'sec_1' as section_id, concat('ref_', cast(paper_id % 40 + 1 as varchar(20))) as ref_id from v_token_section where removal_ack = 1"""
VIEWS["v_state"] = """select paper_id, 'sec_1' as section_id, case when paper_id % 11 = 0 then concat(before_text, ' Edited.') else before_text end as content from v_token_section union all select paper_id, 'sec_2', 'Nets [[citep:ref_2]] learn.' from v_token_section"""
VIEWS["v_known_ref"] = """select d.doc_id as paper_id, concat('ref_', cast(k.item_id + 1 as varchar(20))) as ref_id from documents d join benchmark k on k.item_id < 40"""
VIEWS["v_manual"] = """select paper_id as edit_id, case when paper_id % 10 = 7 then -1 - paper_id else paper_id end as paper_id, case when paper_id % 10 = 6 then 'sec_9' else 'sec_2' end as section_id, case paper_id % 4 when 0 then 'Nets [[citep:ref_2]] learn.' when 1 then 'Nets [[citep:ref_77,ref_2]] learn [[citet:ref_66]].' else 'Nets learn.' end as content, cast(case paper_id % 3 when 0 then null when 1 then 3 else 2 end as int) as base_version from v_token_section"""
#: What a planning model answered: plans of several operations, in fences or prose, and malformed ones.
VIEWS["v_answer"] = """select doc_id as command_id, doc_id as paper_id, case doc_id % 16
 when 0 then concat('{"plan": "Add support", "operations": [{"op": "find_citations", "section_id": "sec_1", "topic": "nets ', cast(doc_id as varchar(20)), '", "max_new": ', cast(doc_id % 9 as varchar(20)), '}]}')
 when 1 then '```json
{"plan": "Shorten", "operations": [{"op": "rewrite_section", "section_id": "sec_2", "instruction": "  Cut it by half. "}]}
```' when 2 then 'Here it is: {"plan": "Both", "operations": [{"op": "find_citations", "section_id": "sec_1"}, {"op": "rewrite_section", "section_id": "sec_2", "instruction": "Tighten"}]} as asked.'
 when 3 then '{"plan": "I refuse", "operations": []}' when 4 then '{"plan": "No list", "operations": {"op": "x"}}' when 5 then '[1, 2' when 6 then '{"plan": "no operations"}' when 7 then null
 when 8 then '{"operations": [{"op": "find_citations", "section_id": "sec_9"}]}' when 9 then '{"operations": [{"op": "delete_all", "section_id": "sec_1"}]}' when 10 then '{"operations": [{"op": "rewrite_section", "section_id": "sec_1", "instruction": " "}]}'
 when 11 then '{"plan": "Six", "operations": [{"op": "find_citations", "section_id": "sec_1", "max_new": 2}, {"op": "find_citations", "section_id": "sec_2", "max_new": "4"}, {"op": "find_citations", "section_id": "sec_1", "max_new": 2.9}, {"op": "rewrite_section", "section_id": "sec_1", "instruction": "x"}, {"op": "nonsense"}, 7]}'
 when 12 then '{"operations": [7]}' when 13 then '[{"op": "find_citations", "section_id": "sec_1"}]' when 14 then '{"plan": "Bad", "operations": [{"op": "find_citations", "section_id": "sec_1", "max_new": "many"}]}' else '{"plan": null, "operations": null}' end as answer from documents"""
#: References with all that an entry may have; one in eleven can't be rendered. Names are parted by semicolons.
VIEWS["v_cite_ref"] = """select paper_id, ord, ref_id, case when ord % 13 = 0 then null else label end as label, case when ord % 10 = 9 then '' else concat(author1, case ord % 5 when 1 then ';Doe, Ann' when 2 then ';Roe, R. S.;Poe, Ed' when 3 then ';Van Dyke, A.;Bo, C.;Li, D E' when 4 then ';Collective' else '' end) end as names,
 case when ord % 17 = 3 then null else year end as year, case when ord % 10 = 9 then concat(title, ' & 5% more_') else title end as title, container, case when ord % 3 = 0 then cast(ord + 10 as varchar(20)) end as volume, case when ord % 4 = 1 then concat(cast(ord as varchar(20)), '-', cast(ord + 9 as varchar(20))) end as pages, doi, arxiv,
 case when ord % 6 = 5 then 'https://example.org/a_b' end as url, concat('raw entry #', cast(ord as varchar(20))) as raw_text, ord % 11 <> 5 as renderable, case when ord % 8 = 1 then 'agent' else 'pdf_parse' end as added_by, case when ord % 8 = 1 and ord % 3 <> 0 then 'supports a claim' end as added_reason, case when ord % 8 = 1 then 'openalex' end as source, case when ord % 8 = 1 then 'https://example.org/w' end as source_url from v_paper_ref"""
VIEWS["v_meta"] = """select doc_id as paper_id, case when doc_id % 9 = 4 then null else concat('On 5% & ', substring(replace(text, chr(10), ' '), 1, 20)) end as title, case doc_id % 3 when 0 then '' when 1 then 'Ada Lovelace' else 'A. Tu_ring;Grace Hopper' end as names, cast(doc_id % 3 + 1 as int) as version from documents"""
#: Five sections a paper: abstract, three levels, references.
VIEWS["v_doc_section"] = """select d.doc_id as paper_id, cast(k.item_id as int) as sec_no, concat('sec_', cast(k.item_id + 1 as varchar(20))) as section_id, case k.item_id when 0 then 'Abstract' when 1 then 'Intro & more' when 2 then 'Data_sets' when 3 then 'Fine points' else 'References' end as title,
 cast(case k.item_id when 2 then 2 when 3 then 4 else 1 end as int) as level, case k.item_id when 0 then 'abstract' when 4 then 'references' else 'body' end as kind,
 case k.item_id when 0 then concat('Abstract—', substring(d.text, 1, 80), ' [[citep:ref_3]].') when 4 then '' when 3 then case when d.doc_id % 2 = 0 then ' ' else concat('See [[citet:ref_', cast(d.doc_id % 40 + 1 as varchar(20)), ']] and [[citep:ref_5,ref_99]] or [[citep:ref_99]].') end
  else concat(replace(substring(d.text, cast(100 * k.item_id as int), 300), chr(10), concat(chr(10), chr(10), chr(10))), ' As in [[citep:ref_', cast((d.doc_id * 7 + k.item_id) % 40 + 1 as varchar(20)), ', ref_7]] by [[citet:ref_2]] (5% & #1).') end as content from documents d join benchmark k on k.item_id < 5"""
VIEWS["v_doc_float"] = """select d.doc_id as paper_id, cast(k.item_id as int) as float_no, case k.item_id % 3 when 0 then 'figure' when 1 then 'table' else 'box' end as kind, cast(k.item_id as int) as page, case when k.item_id = 2 then '' else concat('Figure ', cast(k.item_id as varchar(20)), '. A & B') end as caption,
 case when k.item_id = 0 then '' else concat('cell_1 | 5%', chr(10), substring(replace(d.text, chr(10), ' '), 1, 30), chr(10), chr(10), 'more [[citep:ref_2]]') end as text, case when k.item_id = 3 then null when k.item_id = 4 then 'sec_5' when k.item_id = 0 and d.doc_id % 4 = 0 then 'sec_1' else 'sec_2' end as section_id from documents d join benchmark k on k.item_id < 3 + d.doc_id % 3"""
VIEWS["v_history"] = """select paper_id, cast(k.item_id + 1 as int) as version, concat('edit: step ', cast(k.item_id as varchar(20))) as reason, cast('2026-01-02 03:04:05' as timestamp) as created_at from v_meta m join benchmark k on k.item_id < m.version - 1"""
#: Reference lists of two lines an entry: with numbers, with hanging indents, by author without either, and prose.
VIEWS["v_reflist"] = """select paper_id, cast(line_seq as int) as line_seq, cast(floor(line_seq / 30.0) as int) as page, cast(floor(line_seq / 15.0) as int) % 2 as column, cast(case when paper_id % 4 = 1 and part = 1 then 62 else 50 end as double) as x0, text from (
 select r.paper_id, r.ord * 2 + k.item_id as line_seq, k.item_id as part, case when r.paper_id % 4 = 3 then lower(substring(r.title, 1, 20)) when k.item_id = 0 then concat(case when r.paper_id % 4 = 0 then concat(case r.paper_id % 3 when 0 then '[' when 1 then '(' else '' end, cast(case when r.ord % 12 = 7 then r.ord + 20 else r.ord end as varchar(20)), case r.paper_id % 3 when 0 then '] ' when 1 then ') ' else '. ' end) else '' end, r.author1, ' Of things num-')
  else concat('bered ', substring(r.title, 1, 10), '. Journal ', cast(r.ord as varchar(20)), case when r.paper_id % 4 = 1 then ', pp. 3-9.' else concat(', ', cast(r.year as varchar(20)), '.') end) end as text
 from v_paper_ref r join benchmark k on k.item_id < 2) z"""
VIEWS["v_entry"] = """select concat(cast(paper_id as varchar(20)), '-', ref_id) as ref_id, concat(author1, ' (', cast(year as varchar(20)), '). Things in print. ', case ord % 4 when 0 then 'In Proc of Tests' when 1 then 'Journal of Tests' else 'arXiv preprint' end, case ord % 3 when 0 then concat(', vol. ', cast(ord as varchar(20)), ', pp. ', cast(ord as varchar(20)), ' - ', cast(ord + 8 as varchar(20))) when 1 then concat(', ', cast(ord as varchar(20)), '(2): ', cast(ord as varchar(20)), '–', cast(ord + 8 as varchar(20))) else '' end, '.',
 case when doi is not null then concat(' doi:', doi, '.') else '' end, case when arxiv is not null then concat(' arXiv:', arxiv, 'v3.') else '' end, case when ord % 6 = 1 then ' https://example.org/p_1999.' else '' end) as raw_text, doi, arxiv, year, case ord % 6 when 1 then 'https://example.org/p_1999' end as url from v_paper_ref"""
#: References with what their lookup gave, and records of two services.
VIEWS["v_work"] = """select *, case ord % 7 when 1 then 'resolved' when 2 then 'unresolved' when 3 then 'failed' else 'not_attempted' end as status, case when ord % 9 = 4 then 0.4e0 else 0.8e0 end as confidence, case when ord % 7 = 1 then '10.5555/r' end as res_doi,
 case when ord % 14 = 8 then '10.6666/c' end as csl_doi, case when ord % 5 = 0 then 'https://example.org/csl' end as csl_url, case when ord % 15 = 2 then null else title end as csl_title from v_cite_ref"""
VIEWS["v_record"] = """select r.paper_id, cast(r.ord * 2 + k.item_id as bigint) as seq, case k.item_id when 0 then 'openalex' else 'semantic_scholar' end as api, case when r.ord % 6 = 0 then upper(r.doi) end as doi, case when r.ord % 8 = 3 then r.arxiv end as arxiv,
 case (r.ord + k.item_id + r.paper_id) % 5 when 0 then substring(r.title, 1, 60) when 1 then substring(r.title, 5, 60) when 2 then substring(r.title, 16, 60) else concat('Another work ', cast(r.ord as varchar(20))) end as title from v_paper_ref r join benchmark k on k.item_id < 2"""
#: Claims of papers and what was found for each: parts of other papers, references under their titles or DOIs.
VIEWS["v_topic"] = """select d.doc_id as paper_id, cast(k.item_id as int) as claim_no, concat('The results of ', replace(substring(d.text, cast(1 + 60 * k.item_id as int), 60), chr(10), ' ')) as claim from documents d join benchmark k on k.item_id < 3"""
VIEWS["v_result"] = """select s.paper_id, cast(k.item_id as int) as claim_no, cast(s.seq * 3 + k.item_id as bigint) as seq, s.doi, s.url, s.note, case when s.seq % 4 = 0 then s.title else replace(substring(d.text, cast(1 + 50 * k.item_id as int), 70), chr(10), ' ') end as title, case when s.seq % 2 = 0 then substring(d.text, 1, 300) end as abstract, cast(d.n_chars * s.seq as int) as cited_by_count
 from v_search s join documents d on d.doc_id = s.paper_id join benchmark k on k.item_id < 3"""
#: Only the split into lines differs by engine.
LINE_SPARK = _LINE.format(raw="select doc_id, pos as line_seq, t as text from documents lateral view posexplode(split(text, '\\n')) e as pos, t")
LINE_DUCK = _LINE.format(raw="select doc_id, generate_subscripts(a, 1) - 1 as line_seq, unnest(a) as text from (select doc_id, string_split(text, chr(10)) a from documents) q")
_SHORT = "regexp_extract_all(replace(text, chr(10), ' '), '(?s).{1,60}', 0)"
BY_ENGINE = {
    "v_line": (LINE_SPARK, LINE_DUCK),
    "v_raw_line": (f"select doc_id, pos as line_seq, t as text from documents lateral view posexplode({_SHORT}) e as pos, t", f"select doc_id, generate_subscripts(a, 1) - 1 as line_seq, unnest(a) as text from (select doc_id, {_SHORT} as a from documents) q"),
}
_TABLES = re.compile(r"\b(from|join) (documents|benchmark|events)\b")
_NAMES = [*BY_ENGINE, *VIEWS]


def _text(name: str, duck: bool) -> str:
    return BY_ENGINE[name][duck] if name in BY_ENGINE else VIEWS[name]


def _needed(query: str, duck: bool) -> list[str]:
    """The views that a query names, and those that they name, each before its users."""
    out: list[str] = []
    for n in [n for n in _NAMES if re.search(rf"\b{n}\b", query)]:
        out += [m for m in [*_needed(_text(n, duck), duck), n] if m not in out]
    return out


def _with(query: str, duck: bool) -> str:
    ctes = ",\n".join(f"{n} as ({_text(n, duck)})" for n in _needed(query, duck))
    body = query.strip()
    if not ctes:
        return body
    return f"with {ctes},\n{body[5:]}" if body.lower().startswith("with ") else f"with {ctes}\n{body}"


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One injected relation as a DataFrame."""
    text = _with(_text(name, False), False)
    used = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in {t for _, t in _TABLES.findall(text)}}
    return spark.sql(_TABLES.sub(r"\1 {\2}", text.replace("{", "{{").replace("}", "}}")), **used)


def oracle(query: str) -> str:
    """query, for the SQL oracle, with the views that it names as common table expressions."""
    return _with(query, True)
