"""Queries over placed lines: reading order, headings, front matter and joined text, with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from .operators import layout, pages, regions
from .plans import papers
from .registry import over

_KNOWN = " ".join(f"when key in ({', '.join(repr(x) for x in names)}) then '{kind}'" for kind, names in layout.KNOWN_HEADINGS.items())
#: hd: the headings of a relation ``lines`` that has mostly_bold.
HEADINGS = rf"""
hb as (select paper_id, size as body from (select paper_id, round(size, 1) as size, sum(length(text)) as mass, min(line_seq) as seq from {{lines}} group by paper_id, round(size, 1)) qualify row_number() over (partition by paper_id order by mass desc, seq) = 1),
hx as (select paper_id, line_seq, size, mostly_bold, trim(text) as t, regexp_matches(trim(text), '^\s*(?:(\d+(?:\.\d+)*)\.?|([IVXLC]+)\.|([A-H])\.)\s+(.*)$') as numbered, regexp_extract(trim(text), '^\s*(?:(\d+(?:\.\d+)*)\.?|([IVXLC]+)\.|([A-H])\.)\s+(.*)$', 1) as num,
 case when numbered then trim(regexp_extract(trim(text), '^\s*(?:(\d+(?:\.\d+)*)\.?|([IVXLC]+)\.|([A-H])\.)\s+(.*)$', 4)) else trim(text) end as title, regexp_replace(lower(title), '[.:]+$', '') as key from {{lines}}),
hk as (select hx.*, size > 1.02 * body as larger, case {_KNOWN} end as kind from hx join hb using (paper_id) where t <> '' and length(t) <= 90 and len(regexp_split_to_array(t, '\s+')) <= 12),
hd as (select paper_id, line_seq, title, cast(case when num <> '' then length(num) - length(replace(num, '.', '')) + 1 else 1 end as int) as level, coalesce(kind, 'body') as kind from hk
 where case when kind is not null then larger or mostly_bold or numbered or (upper(t) = t and lower(t) <> t)
  else numbered and (larger or mostly_bold) and not regexp_matches(t, '[.,:;]$') and length(regexp_replace(title, '[^\p{{{{L}}}}\s]', '', 'g')) > 0.75 * greatest(length(title), 1) end)"""
over("headings_of_pages", ("v_head_line",), layout.headings, f"with {HEADINGS.format(lines='v_head_line')} select * from hd")

#: ro: v_page_line in reading order.
ORDER = """
rs as (select *, case when x1 - x0 > 360 or (x0 < 300 and x1 > 300 and x1 - x0 > 270) then 2 when x0 >= 270 then 1 else 0 end as side from v_page_line),
rp as (select *, (select count(*) from rs f where f.paper_id = l.paper_id and f.page = l.page and f.side = 2 and (f.y0 < l.y0 or (f.y0 = l.y0 and (l.side <> 2 or f.line_seq < l.line_seq)))) as zone,
 count(*) filter (side = 1) over p >= 5 and count(*) filter (side = 0) over p >= 5 as two from rs l window p as (partition by paper_id, page)),
ro as (select * exclude (zone, two, side), cast(row_number() over (partition by paper_id, page order by case when two then zone else 0 end, case when two then side else 0 end, case when two then y0 else round(y0, 1) end, x0, line_seq) as int) as place, cast(case when two and side = 1 then 1 else 0 end as int) as "column" from rp)"""
over("reading_order_zones", ("v_page_line",), lambda l: pages.reading_order(l).select("paper_id", "page", "line_seq", "place", "column"), f'with {ORDER} select paper_id, page, line_seq, place, "column" from ro')
#: mg: those lines after merging; a pair begins at the odd places of an island of candidates.
MERGED = rf"""{ORDER},
mn as (select *, lead(text) over w as nt, lead(x0) over w as nx0, lead(x1) over w as nx1, lead(y0) over w as ny0, lead(y1) over w as ny1 from ro window w as (partition by paper_id, page order by place)),
mc as (select *, coalesce(regexp_matches(text, '^(?:\d{{1,2}}(?:\.\d{{1,2}})*\.?|[IVXLC]{{1,5}}\.?|[A-H]\.)$') and abs(ny0 - y0) < 3 and nx0 - x1 >= 0 and nx0 - x1 < 40, false) as can from mn),
mi as (select *, place - row_number() over (partition by paper_id, page, can order by place) as island from mc),
mo as (select *, can and (row_number() over (partition by paper_id, page, can, island order by place)) % 2 = 1 as mrg from mi),
mg as (select paper_id, page, line_seq, place, case when mrg then text || ' ' || nt else text end as text, x0, case when mrg then nx1 else x1 end as x1, case when mrg then least(y0, ny0) else y0 end as y0, case when mrg then greatest(y1, ny1) else y1 end as y1, "column"
 from (select *, coalesce(lag(mrg) over (partition by paper_id, page order by place), false) as gone from mo) where not gone)"""
_COLS = ["paper_id", "page", "line_seq", "place", "text", "x0", "x1", "y0", "y1", "column"]
over("merged_number_lines", ("v_page_line",), lambda l: pages.merged_numbers(pages.reading_order(l)).select(*_COLS), f"with {MERGED} select * from mg")
over("styled_lines", ("v_span",), lambda s: pages.styled_lines(s).drop("x0", "y0", "x1", "y1"),
     r"""with s as (select *, (flags & 1) <> 0 and regexp_matches(trim(text), '^[\d,\s\-–]+$') as up, case when trim(text) <> '' then length(text) else 0 end as n from v_span),
 c as (select *, case when up and lag(up) over w then 0 else 1 end as brk from s window w as (partition by paper_id, page, line_seq order by span_no)),
 i as (select *, sum(brk) over (partition by paper_id, page, line_seq order by span_no) as run from c),
 r as (select paper_id, page, line_seq, run, case when bool_or(up) then '⟨sup:' || string_agg(trim(text), ',' order by span_no) || '⟩' else string_agg(text, '' order by span_no) end as piece from i group by all),
 m as (select paper_id, page, line_seq, trim(string_agg(piece, '' order by run)) as marked_text from r group by all),
 l as (select paper_id, page, line_seq, trim(string_agg(text, '' order by span_no)) as text, coalesce(max(case when trim(text) <> '' then size end), 0.0) as size,
  sum(case when (flags & 16) <> 0 or lower(font) like '%bold%' then n else 0 end) > 0.6 * sum(n) as mostly_bold, cast(sum(case when (flags & 2) <> 0 or lower(font) like '%italic%' or lower(font) like '%oblique%' then n else 0 end) as bigint) as italic_chars from s group by all)
 select * from l join m using (paper_id, page, line_seq)""")  # fmt: skip


def flat(source: str, keys: str, out: str, order: str = "line_seq") -> str:
    """CTEs that give ``out`` (keys, text): the joined text of each group of lines of ``source``."""
    k = keys.replace(" ", "").split(",")
    using = ", ".join(k)
    return rf"""{out}_h as (select {using}, coalesce(median(y1 - y0) filter (y1 > y0), 10.0) as h from {source} group by all),
{out}_g as (select s.*, h from {source} s join {out}_h using ({using}) where trim(text) <> ''),
{out}_e as (select {using}, {order} as k, case when lag(text) over w is null then '' when lag(page) over w = page and lag("column") over w = "column" and y0 - lag(y1) over w > 0.85 * h then chr(10) || chr(10)
  when lag(text) over w like '%-' and regexp_matches(text, '^\p{{Ll}}') then '' else ' ' end as lead,
 case when text like '%-' and not coalesce(lead(page) over w = page and lead("column") over w = "column" and lead(y0) over w - y1 > 0.85 * h, false) and regexp_matches(coalesce(lead(text) over w, ''), '^\p{{Ll}}') then left(text, length(text) - 1) else text end as body
 from {out}_g window w as (partition by {using} order by {order})),
{out} as (select {using}, trim(regexp_replace(regexp_replace(string_agg(lead || body, '' order by k), '[ \t]+', ' ', 'g'), ' ?\n\n ?', chr(10) || chr(10), 'g')) as text from {out}_e group by all)"""


over("flattened_pages", ("v_page_line",), lambda l: pages.flattened(pages.numbered(pages.merged_numbers(pages.reading_order(l))), "paper_id"),
     f"with {MERGED}, q as (select * replace (row_number() over (partition by paper_id order by page, place) as line_seq) from mg), {flat('q', 'paper_id', 'fl')} select paper_id, text from fl")

_TITLE = """
tf as (select * from v_head_line where page = 0 qualify row_number() over (partition by paper_id order by line_seq) <= 40),
tl as (select *, row_number() over (partition by paper_id order by line_seq) as nth from (select * from tf qualify abs(size - max(size) over (partition by paper_id)) < 0.5) where length(text) > 3),
ti as (select paper_id, trim(string_agg(text, ' ' order by nth)) as title from tl where nth <= 3 group by paper_id)"""
over("paper_titles", ("v_head_line",), pages.titles, f"with {_TITLE} select * from ti")
over("paper_authors", ("v_head_line",), lambda l: pages.authors(l, layout.headings(l)),
     rf"""with {HEADINGS.format(lines='v_head_line')}, {_TITLE}, f1 as (select paper_id, min(line_seq) as f from hd group by 1),
 a as (select l.paper_id, l.line_seq, unnest(regexp_split_to_array(l.text, ',|\band\b')) as part, generate_subscripts(regexp_split_to_array(l.text, ',|\band\b'), 1) as k from v_head_line l left join f1 using (paper_id)
  where (f is null or l.line_seq < f) and not exists (select 1 from tl where tl.paper_id = l.paper_id and tl.line_seq = l.line_seq) and l.text not like '%@%' and length(l.text) >= 3
  and not regexp_matches(l.text, '{pages.AFFILIATION}') and regexp_matches(l.text, '{pages.NAME_LINE.replace("'", "''")}')),
 b as (select a.paper_id, a.line_seq, a.k, trim(regexp_replace(part, '{pages.NAME_MARKS}', '', 'g')) as author, title from a left join ti using (paper_id))
 select paper_id, cast(row_number() over (partition by paper_id order by line_seq, k) as int) as nth, author from b where author <> '' and len(regexp_split_to_array(author, '\s+')) <= 5 and lower(author) <> coalesce(lower(title), '')
 qualify row_number() over (partition by paper_id order by line_seq, k) <= 15""")  # fmt: skip

# ---- regions and floats ----------------------------------------------------------------------------

_BOXES = """
dr as (select paper_id, page, list(struct_pack(y0 := y0, x0 := x0, seq := seq, x1 := x1, y1 := y1) order by y0, x0, seq) as d from v_drawing
 where kind = 'drawing' and x1 - x0 >= 90 and y1 - y0 >= 24 and (x1 - x0) * (y1 - y0) < 432000 group by paper_id, page),
db as (select paper_id, page, list_reduce(d, lambda acc, r:
  case when len(list_filter(acc, lambda o: least(r.x1, o.x1) - greatest(r.x0, o.x0) > 0.8 * least(r.x1 - r.x0, o.x1 - o.x0) and r.y0 - o.y1 < 14 and o.y0 - r.y1 < 14)) > 0 then
   list_transform(acc, lambda o, i: case when i = list_position(list_transform(acc, lambda q: least(r.x1, q.x1) - greatest(r.x0, q.x0) > 0.8 * least(r.x1 - r.x0, q.x1 - q.x0) and r.y0 - q.y1 < 14 and q.y0 - r.y1 < 14), true)
    then struct_pack(x0 := least(o.x0, r.x0), y0 := least(o.y0, r.y0), x1 := greatest(o.x1, r.x1), y1 := greatest(o.y1, r.y1)) else o end)
  else list_append(acc, struct_pack(x0 := r.x0, y0 := r.y0, x1 := r.x1, y1 := r.y1)) end, cast([] as struct(x0 double, y0 double, x1 double, y1 double)[])) as boxes from dr),
bx as (select paper_id, page, cast(generate_subscripts(boxes, 1) - 1 as int) as box_no, unnest(boxes) as box from db)"""
_EDGES = [f"box.{c}" for c in regions.BOX]
over("merged_boxes", ("v_drawing",), lambda d: regions.merged_boxes(d.where("kind = 'drawing'")).select("paper_id", "page", "box_no", *_EDGES), f"with {_BOXES} select paper_id, page, box_no, box.x0, box.y0, box.x1, box.y1 from bx")
#: rg: accepted regions.
REGIONS = f"""{_BOXES},
ca as (select paper_id, page, 0 as rank, seq, x0, y0, x1, y1, body from v_drawing where kind = 'table' and x1 - x0 >= 90 and y1 - y0 >= 24
 union all select paper_id, page, 1, box_no, box.x0, box.y0, box.x1, box.y1, '' from bx
 union all select paper_id, page, 2, seq, x0, y0, x1, y1, '' from v_drawing where kind = 'image' and x1 - x0 >= 90 and y1 - y0 >= 24),
cl as (select paper_id, page, list(struct_pack(rank := rank, x0 := x0, y0 := y0, x1 := x1, y1 := y1, body := body) order by rank, seq) as x from ca group by all),
ac as (select paper_id, page, list_reduce(x, lambda acc, r: case when r.rank > 0 and len(list_filter(acc, lambda o: o.x0 < r.x1 and r.x0 < o.x1 and o.y0 < r.y1 and r.y0 < o.y1)) > 0 then acc else list_append(acc, r) end,
 cast([] as struct(rank int, x0 double, y0 double, x1 double, y1 double, body varchar)[])) as rs from cl),
rg as (select paper_id, page, cast(generate_subscripts(rs, 1) - 1 as int) as region_no, unnest(rs) as r from ac)"""
over("accepted_regions", ("v_drawing",), lambda d: regions.accepted(d).select("paper_id", "page", "region_no", "kind", "body", *_EDGES),
     f"with {REGIONS} select paper_id, page, region_no, case r.rank when 0 then 'table' when 1 then 'box' else 'figure' end as kind, r.body, r.x0, r.y0, r.x1, r.y1 from rg")
#: ql: caption lines in reading order with their claims; cp: the lines of captions.
_CAPTIONS = rf"""{REGIONS}, {ORDER.replace("v_page_line", "v_caption_line")},
qn as (select * replace (cast(row_number() over (partition by paper_id order by page, place) - 1 as int) as line_seq) from ro),
qc as (select q.paper_id, q.line_seq, min(region_no) as region_no from qn q join rg using (paper_id, page) where (q.x0 + q.x1) / 2 between r.x0 and r.x1 and (q.y0 + q.y1) / 2 between r.y0 and r.y1 group by all),
ql as (select q.*, region_no, regexp_matches(text, '(?i)^(Figure|Fig\.|Table)\s+(\d+)\s*[.:]') as is_cap from qn q left join qc using (paper_id, line_seq)),
cp as (with recursive g as (
  select paper_id, page, line_seq as cap_line, line_seq, 0 as nth, y1, y1 - y0 as h, "column" as c from ql where is_cap and region_no is null
  union all
  select g.paper_id, g.page, g.cap_line, n.line_seq, g.nth + 1, n.y1, g.h, g.c from g join ql n on n.paper_id = g.paper_id and n.page = g.page and n.line_seq = g.line_seq + 1
   where n.region_no is null and not n.is_cap and n."column" = g.c and n.y0 - g.y1 >= 0 and n.y0 - g.y1 < 1.2 * g.h)
 select paper_id, page, cap_line, line_seq, nth from g)"""


def _in_order(lines):
    return pages.numbered(pages.reading_order(lines))


over("caption_lines", ("v_caption_line", "v_drawing"), lambda l, d: regions.captions(_in_order(l), regions.claims(_in_order(l), regions.accepted(d))), f"with {_CAPTIONS} select paper_id, page, cap_line, line_seq, cast(nth as int) as nth from cp")
over("region_claims", ("v_caption_line", "v_drawing"), lambda l, d: regions.claims(_in_order(l), regions.accepted(d)), f"with {_CAPTIONS} select * from qc")


def _floats(lines, drawings):
    return regions.floats(_in_order(lines), drawings)[0]


_NEAR = "least(c.x1, {o}.x1) - greatest(c.x0, {o}.x0) > 0 and least(abs(c.y0 - {o}.y1), abs({o}.y0 - c.bottom)) < 40"
#: fz: floats; fa: their lines.
FLOATS = rf"""{_CAPTIONS},
rk as (select paper_id, page, region_no, r, case r.rank when 0 then 'table' when 1 then 'box' else 'figure' end as kind from rg
 where r.rank = 2 or r.body <> '' or (paper_id, page, region_no) in (select paper_id, page, ql.region_no from ql where ql.region_no is not null)),
rl as (select paper_id, page, list(struct_pack(region_no := region_no, kind := kind, body := r.body, x0 := r.x0, y0 := r.y0, x1 := r.x1, y1 := r.y1, cap_line := cast(null as int)) order by region_no) as rs from rk group by all),
hc as (select cp.paper_id, cp.page, cap_line, any_value(q.text) filter (nth = 0) as text, any_value(x0) filter (nth = 0) as x0, any_value(y0) filter (nth = 0) as y0, any_value(x1) filter (nth = 0) as x1, any_value(y1) filter (nth = 0) as y1, arg_max(y1, nth) as bottom
 from cp join ql q on q.paper_id = cp.paper_id and q.line_seq = cp.line_seq group by cp.paper_id, cp.page, cap_line),
hl as (select paper_id, page, list(struct_pack(cap_line := cap_line, kind := case when lower(text) like 't%' then 'table' else 'figure' end, x0 := x0, y0 := y0, x1 := x1, y1 := y1, bottom := bottom) order by cap_line) as caps from hc group by all),
fd as (select paper_id, page, list_reduce(coalesce(caps, []), lambda acc, c: case when len(list_filter(acc, lambda o: {_NEAR.format(o='o')})) > 0
  then list_transform(acc, lambda o, i: case when i = list_sort(list_transform(list_filter(list_transform(acc, lambda p, j: struct_pack(g := least(abs(c.y0 - p.y1), abs(p.y0 - c.bottom)), j := j, ok := {_NEAR.format(o='p')})), lambda z: z.ok), lambda z: struct_pack(g := z.g, j := z.j)))[1].j
    then struct_pack(region_no := o.region_no, kind := c.kind, body := o.body, x0 := o.x0, y0 := o.y0, x1 := o.x1, y1 := o.y1, cap_line := c.cap_line) else o end)
  else list_append(acc, struct_pack(region_no := cast(null as int), kind := c.kind, body := '', x0 := c.x0, y0 := c.y0, x1 := c.x1, y1 := c.y1, cap_line := c.cap_line)) end,
  coalesce(rs, cast([] as struct(region_no int, kind varchar, body varchar, x0 double, y0 double, x1 double, y1 double, cap_line int)[]))) as f from rl full join hl using (paper_id, page)),
fu as (select paper_id, page, generate_subscripts(f, 1) as nth, unnest(f) as f from fd),
fz as (select paper_id, page, f.kind as kind, f.body as body, f.region_no as region_no, f.cap_line as cap_line, cast(row_number() over (partition by paper_id order by page, nth) - 1 as int) as float_no from fu),
fa as (select q.paper_id, q.line_seq, float_no, false as is_caption from ql q join fz on fz.paper_id = q.paper_id and fz.page = q.page and fz.region_no = q.region_no
 union all select cp.paper_id, cp.line_seq, float_no, true from cp join fz on fz.paper_id = cp.paper_id and fz.cap_line = cp.cap_line),
fs as (select q.* exclude (line_seq), float_no, is_caption, row_number() over (partition by q.paper_id, float_no, is_caption order by case when is_caption then q.line_seq end, page, y0, x0, q.line_seq) as line_seq from fa join ql q on q.paper_id = fa.paper_id and q.line_seq = fa.line_seq),
{flat('fs', 'paper_id, float_no, is_caption', 'ft')},
fq as (select q.paper_id, q.line_seq, m.float_no, max(case when m.float_no is null then q.line_seq end) over (partition by q.paper_id order by q.line_seq rows between unbounded preceding and 1 preceding) as anchor
 from ql q left join (select paper_id, line_seq, min(float_no) as float_no from fa group by all) m on m.paper_id = q.paper_id and m.line_seq = q.line_seq),
fk as (select paper_id, float_no, anchor from fq where float_no is not null qualify row_number() over (partition by paper_id, float_no order by line_seq) = 1),
fx as (select fz.paper_id, fz.float_no, kind, page, coalesce(c.text, '') as caption, case when body <> '' then body else coalesce(b.text, '') end as text, anchor as anchor_line from fz
 left join ft c on c.paper_id = fz.paper_id and c.float_no = fz.float_no and c.is_caption left join ft b on b.paper_id = fz.paper_id and b.float_no = fz.float_no and not b.is_caption
 left join fk on fk.paper_id = fz.paper_id and fk.float_no = fz.float_no)"""
over("floats", ("v_caption_line", "v_drawing"), _floats, f"with {FLOATS} select * from fx")
over("float_counts", ("v_caption_line", "v_drawing"), lambda l, d: regions.counts(_floats(l, d)),
     f"with {FLOATS} select paper_id, count(*) filter (kind = 'table') as n_table, count(*) filter (kind = 'box') as n_box, count(*) filter (kind = 'figure') as n_figure from fx group by 1")


def _float_sections(lines, drawings):
    ordered = _in_order(lines)
    marks = ordered.where("line_seq % 25 = 7").select("paper_id", "line_seq")
    at = layout.section_lines(ordered, marks).where("section_no > 0")
    starts = layout.section_extents(ordered, marks).where("section_no > 0").select("paper_id", "section_no", "page_start")
    return regions.placed(_floats(lines, drawings), at, starts).select("paper_id", "float_no", "page", "anchor_line", "section_no")


over("float_sections", ("v_caption_line", "v_drawing"), _float_sections,
     f"""with {FLOATS}, sx as (select paper_id, line_seq, page, cast(sum(case when line_seq % 25 = 7 then 1 else 0 end) over (partition by paper_id order by line_seq) as bigint) as section_no from qn),
 sy as (select * from sx where section_no > 0 and line_seq % 25 <> 7), ss as (select paper_id, section_no, arg_min(page, line_seq) as page_start from sy group by all)
 select fx.paper_id, float_no, fx.page, anchor_line, coalesce(sy.section_no, (select max(section_no) from ss where ss.paper_id = fx.paper_id and page_start <= fx.page)) as section_no
 from fx left join sy on sy.paper_id = fx.paper_id and sy.line_seq = anchor_line""")  # fmt: skip


def _parsed(part: str):
    def of(lines, drawings):
        return getattr(papers.parse(lines, drawings), part)

    return of


over("parsed_sections", ("v_head_line", "v_drawing"), lambda l, d: _parsed("sections")(l, d).select("paper_id", "section_no", "title", "level", "kind", "page_start", "page_end", F.length("content").alias("n_chars")))
over("parsed_floats", ("v_head_line", "v_drawing"), _parsed("floats"))
