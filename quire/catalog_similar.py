"""Queries over similar texts, with SQL that compares all pairs."""

from __future__ import annotations

from .catalog_sentences import SENTENCES
from .operators import similar
from .registry import over


def _masks(a: str) -> str:
    """The places of each character of a text of at most 120 characters, as bits by character."""
    bits = f"list_reduce(range(1, length({a}) + 1), lambda bt, i: bt | case when substring({a}, i, 1) = ch then cast(1 as hugeint) << (i - 1) else cast(0 as hugeint) end, cast(0 as hugeint))"
    return f"map_from_entries(list_transform(list_distinct(string_split({a}, '')), lambda ch: struct_pack(k := ch, v := {bits})))"


def _ratio(a: str, m: str, b: str) -> str:
    """The indel ratio of a, whose masks are m, and b: a bit of the row falls where the common subsequence grows."""
    full, hit = f"((cast(1 as hugeint) << length({a})) - 1)", f"(rw & coalesce({m}[ch], cast(0 as hugeint)))"
    return f"200.0 * (length({a}) - bit_count(list_reduce(string_split({b}, ''), lambda rw, ch: ((rw + {hit}) | (rw - {hit})) & {full}, {full}))) / (length({a}) + length({b}))"


_PLAIN = r"trim(regexp_replace(lower(regexp_replace({c}, '\[\[cite([pt]):([A-Za-z0-9_,\- ]+?)\]\]', '', 'g')), '[^a-z0-9]+', ' ', 'g'))"

over("near_family_links", ("v_author_part", "v_paper_ref"), lambda p, r: similar.linked_families(p, r).select("paper_id", "k", "ref_id", "found"),
     f"""with rf as (select paper_id, lower(trim(split_part(author1, ',', 1))) as fam, year, list(ref_id order by ord) as ids, min(ord) as first from v_paper_ref where author1 is not null and year is not null group by all),
 pt as (select *, lower(family) as fam, {_masks("lower(family)")} as m from v_author_part), ex as (select pt.paper_id, pt.k, rf.fam as hit from pt join rf on rf.paper_id = pt.paper_id and rf.fam = pt.fam and rf.year = pt.year),
 nr as (select pt.paper_id, pt.k, rf.fam as hit from pt join rf on rf.paper_id = pt.paper_id and rf.year = pt.year where not exists (select 1 from ex where ex.paper_id = pt.paper_id and ex.k = pt.k)
  and {_ratio("pt.fam", "pt.m", "rf.fam")} > 88 qualify row_number() over (partition by pt.paper_id, pt.k order by {_ratio("pt.fam", "pt.m", "rf.fam")} desc, first) = 1),
 h as (select *, 'exact' as found from ex union all select *, 'near' from nr)
 select pt.paper_id, pt.k, coalesce(case when letter <> '' then ids[ascii(letter) - 96] end, ids[1]) as ref_id, found from pt left join h on h.paper_id = pt.paper_id and h.k = pt.k left join rf on rf.paper_id = pt.paper_id and rf.fam = h.hit and rf.year = pt.year""")  # fmt: skip
over("known_works", ("v_search", "v_paper_ref", "v_paper"), similar.known_works,
     f"""with f as (select *, {_PLAIN.format(c="title")} as s from v_search), fm as (select paper_id, seq, s, {_masks("s")} as m from f where s <> ''),
 rt as (select distinct paper_id, {_PLAIN.format(c="title")} as s from v_paper_ref), pt as (select paper_id, {_PLAIN.format(c="title")} as s from v_paper),
 w as (select paper_id, seq, 0 as why from v_search f where exists (select 1 from v_paper_ref r where r.paper_id = f.paper_id and lower(r.doi) = lower(f.doi))
  union all select f.paper_id, f.seq, 1 from v_search f join v_paper_ref r on r.paper_id = f.paper_id and contains(coalesce(url, '') || coalesce(note, ''), r.arxiv)
  union all select fm.paper_id, fm.seq, 2 from fm join rt on rt.paper_id = fm.paper_id where rt.s <> '' and {_ratio("fm.s", "fm.m", "rt.s")} >= 90
  union all select fm.paper_id, fm.seq, 3 from fm join pt on pt.paper_id = fm.paper_id where pt.s <> '' and {_ratio("fm.s", "fm.m", "pt.s")} >= 93)
 select paper_id, seq, ['doi', 'arxiv', 'title', 'self'][min(why) + 1] as reason from w group by paper_id, seq""")  # fmt: skip


def located(sections: str, claims: str, number: str, sentence: str) -> str:
    """CTEs that end in lo: number, sentence_no, ratio of each claim that has a sentence in its section."""
    return f"""{SENTENCES.format(c="content", v=sections)}, lx as (select s.paper_id, v.section_id, sentence_no, {_PLAIN.format(c="sentence")} as x from s join {sections} v using (paper_id)),
 lq as (select *, {_PLAIN.format(c=sentence)} as q from {claims}), lm as (select paper_id, section_id, {number}, q, {_masks("q")} as m from lq where q <> ''),
 ln as (select lm.paper_id, lm.section_id, lm.{number}, sentence_no, {_ratio("q", "m", "x")} as ratio from lm join (select * from lx where x <> '') lx on lx.paper_id = lm.paper_id and lx.section_id = lm.section_id and 200 * least(length(q), length(x)) >= 75 * (length(q) + length(x))),
 lo as (select * from ln where ratio >= 75 qualify row_number() over (partition by paper_id, section_id, {number} order by ratio desc, sentence_no) = 1)"""


over("located_sentences", ("v_section", "v_claim"), similar.located,
     f"""with {located("v_section", "v_claim", "claim_no", "sentence")}
 select c.paper_id, c.section_id, c.claim_no, cast(sentence_no as int) as sentence_no, ratio from lq c left join lo using (paper_id, section_id, claim_no)""")  # fmt: skip
