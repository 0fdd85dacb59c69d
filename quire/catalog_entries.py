"""Queries over reference lists and entries, with the SQL that gives the same rows."""

from __future__ import annotations

from .operators import entries, references
from .registry import over

_TEXT = r"regexp_replace(trim(regexp_replace(string_agg(trim({t}), ' ' order by {o}) filter (trim({t}) <> ''), '\s+', ' ', 'g')), '([a-z])- ([a-z])', '\1\2', 'g')"
_FINAL = entries.FINAL
_START = entries.AUTHOR_START.replace("'", "''")
_SHAPE = {k: v for k, v in entries.SHAPES.items()}
#: se: the entries of each list by its strategy; ss: the strategies.
SEGMENTS = rf"""
rl as (select * from v_reflist where trim(text) <> ''),
sh as (select paper_id, count(*) filter (regexp_matches(text, '{_SHAPE["bracket"]}')) as b, count(*) filter (regexp_matches(text, '{_SHAPE["paren"]}')) as p, count(*) filter (regexp_matches(text, '{_SHAPE["dot"]}')) as d from rl group by 1),
sk as (select paper_id, case when greatest(b, p, d) < 2 then '{_SHAPE["dot"]}' when b = greatest(b, p, d) then '{_SHAPE["bracket"]}' when p = greatest(b, p, d) then '{_SHAPE["paren"]}' else '{_SHAPE["dot"]}' end as rx,
 case when greatest(b, p, d) < 2 then 'd' when b = greatest(b, p, d) then 'b' when p = greatest(b, p, d) then 'p' else 'd' end as k from sh),
nl as (select paper_id, line_seq, text, try_cast(case k when 'b' then regexp_extract(text, '{_SHAPE["bracket"]}', 1) when 'p' then regexp_extract(text, '{_SHAPE["paren"]}', 1) else regexp_extract(text, '{_SHAPE["dot"]}', 1) end as int) as n,
 case k when 'b' then regexp_replace(text, '{_SHAPE["bracket"]}', '') when 'p' then regexp_replace(text, '{_SHAPE["paren"]}', '') else regexp_replace(text, '{_SHAPE["dot"]}', '') end as rest from rl join sk using (paper_id)),
nf as (select paper_id, list_reduce(list(struct_pack(n := n, s := line_seq) order by line_seq), lambda acc, x: case when x.n is not null and abs(x.n - (acc.last + 1)) <= 2 then struct_pack(last := x.n, out := list_append(acc.out, x.s)) else acc end, struct_pack(last := 0, out := cast([] as int[]))).out as starts from nl group by 1),
ne as (select nl.*, len(list_filter(starts, lambda q: q <= line_seq)) as entry_no, list_contains(starts, line_seq) as st from nl join nf using (paper_id)),
n1 as (select paper_id, entry_no, max(n) filter (st) as label, {_TEXT.format(t="case when st then rest else text end", o="line_seq")} as raw_text from ne where entry_no > 0 group by all),
ha as (select *, x0 <= min(x0) over (partition by paper_id, page, "column") + 2.5 as at_edge from rl),
hb as (select *, count(*) filter (at_edge) over (partition by paper_id order by line_seq) as c, count(*) filter (not at_edge) over (partition by paper_id) as indented from ha),
h1 as (select paper_id, greatest(c, 1) as entry_no, {_TEXT.format(t="text", o="line_seq")} as raw_text from hb where indented > 0 group by all),
aa as (select *, lag(text) over (partition by paper_id order by line_seq) as prev from rl),
ab as (select *, 1 + sum(case when prev is not null and regexp_matches(prev, '{_FINAL}') and regexp_matches(text, '{_START}') then 1 else 0 end) over (partition by paper_id order by line_seq) as entry_no from aa),
a1 as (select paper_id, entry_no, {_TEXT.format(t="text", o="line_seq")} as raw_text from ab group by all),
sc as (select paper_id, 0 as rank, 'numbered' as strategy, 0.6 * coalesce(sum(f), 0) / greatest(count(*) - 1, 1) + 0.4 * least(1.0, count(*) / 8.0) as score from (select *, case when label = lag(label) over (partition by paper_id order by entry_no) + 1 then 1 else 0 end as f from n1) z group by 1 having count(*) >= 2
 union all select paper_id, 1, 'hanging_indent', 0.5 * avg(case when regexp_matches(raw_text, '{_FINAL}') then 1.0 else 0 end) + 0.3 * least(1.0, avg(length(raw_text)) / 80.0) + 0.2 * least(1.0, count(*) / 8.0) from h1 group by 1 having count(*) >= 3
 union all select paper_id, 2, 'author_start', 0.5 * avg(case when regexp_matches(raw_text, '\b(?:19|20)\d{{2}}[a-z]?\b') then 1.0 else 0 end) + 0.2 * least(1.0, count(*) / 8.0) + 0.1 from a1 group by 1 having count(*) >= 3),
sb as (select paper_id, strategy, round(cast(score as double), 9) as score from sc qualify row_number() over (partition by paper_id order by round(cast(score as double), 9) desc, rank) = 1),
sp as (select p.paper_id, case when score >= 0.35 then strategy else 'none' end as strategy, case when score >= 0.35 then score else 0.0 end as score from (select distinct paper_id from rl) p left join sb using (paper_id)),
se as (select n1.paper_id, cast(entry_no as bigint) as entry_no, cast(label as varchar) as label, raw_text from n1 join sp using (paper_id) where strategy = 'numbered' union all select h1.paper_id, entry_no, null, raw_text from h1 join sp using (paper_id) where strategy = 'hanging_indent'
 union all select a1.paper_id, entry_no, null, raw_text from a1 join sp using (paper_id) where strategy = 'author_start' union all select rl.paper_id, 1, null, {_TEXT.format(t="text", o="line_seq")} from rl join sp using (paper_id) where strategy = 'none' group by 1),
ss as (select sp.*, (select count(*) from se where se.paper_id = sp.paper_id) as n_entries from sp)"""
over("segmented_entries", ("v_reflist",), lambda l: entries.segmented(l)[0], f"with {SEGMENTS} select * from se")
over("segmentation_strategies", ("v_reflist",), lambda l: entries.segmented(l)[1], f"with {SEGMENTS} select * from ss")
over("entry_identifiers", ("v_entry",), references.fields, "select ref_id, doi, arxiv, url, year from v_entry")
over("entry_fields", ("v_entry",), lambda e: entries.parse(e).select("ref_id", "authors", "title", "container", "volume", "pages", "confidence"),
     r"""with v as (select *, trim(regexp_extract(raw_text, 'Things in print\. ([^,.]*)', 1)) as c from v_entry)
 select ref_id, [regexp_extract(raw_text, '^(.*?) \(', 1)] as authors, 'Things in print' as title, case when c like 'In %' then substring(c, 4, 180) else c end as container, nullif(regexp_extract(raw_text, 'vol\. (\d+)', 1), '') as volume,
 coalesce(nullif(replace(regexp_extract(raw_text, 'pp\. (\d+ - \d+)', 1), ' ', ''), ''), nullif(regexp_extract(raw_text, '\d+\(2\): (\d+–\d+)', 1), '')) as pages, case when doi is not null or arxiv is not null or url is not null then 1.0 else 0.9 end as confidence from v""")  # fmt: skip
