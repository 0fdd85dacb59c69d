"""Queries over proposed edits, with SQL where it can express them."""

from __future__ import annotations

from .catalog_sentences import SENTENCES
from .catalog_similar import located
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .fixtures import view
from .operators import commands, edits, integrity
from .registry import over, query
from .sources.kept import own_path
from .sources.versions import Store

_PIECES = SENTENCES.format(c="content", v="v_section").replace("'\\1' || chr(1) || '\\3'", "'\\1\\2' || chr(1) || '\\3'").replace("s0 ", "i0 ").replace("from s0", "from i0").replace("s1 ", "i1 ").replace("from s1", "from i1").replace("s2 ", "i2 ").replace("from s2", "from i2").replace("\ns as", "\nsp as")
over("cited_findings", ("v_accept", "v_section", "v_paper_ref"), edits.cite_findings,
     rf"""with {located("v_section", "v_accept", "finding_id", "coalesce(claim, '')")}, {_PIECES.strip()},
 nx as (select paper_id, coalesce(max(try_cast(regexp_extract(ref_id, '^ref_(\d+)$', 1) as int)), 0) + 1 as n from v_paper_ref group by 1),
 st as (select f.*, v.content as before, sentence_no, 'ref_' || coalesce(n, 1) as rid, case when f.title is null then 'no_source' when v.content is null then 'no_section'
  when exists (select 1 from v_paper_ref r where r.paper_id = f.paper_id and (lower(r.doi) = lower(f.doi) or lower(trim(r.title)) = lower(trim(f.title)))) then 'already_cited' when sentence_no is null then 'sentence_changed' else 'ok' end as status
  from v_accept f left join v_section v on v.paper_id = f.paper_id and v.section_id = f.section_id left join lo on lo.finding_id = f.finding_id left join nx on nx.paper_id = f.paper_id),
 af as (select st.finding_id, string_agg(case when sp.sentence_no <> st.sentence_no then sentence when regexp_matches(sentence, '[.!?]\s*$') then regexp_replace(sentence, '\s*([.!?]\s*)$', ' [[citep:' || rid || ']]\1')
  else rtrim(regexp_extract(sentence, '^((?s).*?)(\s*)$', 1)) || ' [[citep:' || rid || ']]' || regexp_extract(sentence, '(\s*)$', 1) end, '' order by sp.sentence_no) as after from st join sp on sp.paper_id = st.paper_id where status = 'ok' group by 1)
 select st.finding_id, paper_id, section_id, status, case when status = 'ok' then rid end as ref_id, case when status = 'ok' then before end as before, after from st left join af using (finding_id)""")  # fmt: skip
over("chosen_sources", ("v_spot", "v_offer"), lambda s, o: edits.chosen(s, o.where("op_no = 0").drop("op_no"), s.selectExpr("proposal_id", "array('source 1') as titles").where("proposal_id % 2 = 0").distinct()),
     """with of as (select proposal_id, claim_no, list(struct_pack(seq := seq, title := title, score := score) order by score desc, seq) as offers from v_offer where op_no = 0 group by all),
 cl as (select s.proposal_id, max(max_new) as max_new, list(struct_pack(claim_no := s.claim_no, query := lower(substring(trim(query), 1, 150)), sentence_no := sentence_no, offers := coalesce(offers, [])) order by s.claim_no) as claims from v_spot s left join of on of.proposal_id = s.proposal_id and of.claim_no = s.claim_no group by 1),
 fo as (select proposal_id, list_reduce(claims, lambda acc, c: case when len(acc.o) >= max_new or c.query = '' or list_contains(acc.used, c.query) then acc else
   struct_pack(used := list_append(acc.used, c.query), titles := case when c.sentence_no is not null and coalesce(list_filter(c.offers, lambda z: not list_contains(acc.titles, lower(z.title)))[1].score >= 0.5, false) then list_append(acc.titles, lower(list_filter(c.offers, lambda z: not list_contains(acc.titles, lower(z.title)))[1].title)) else acc.titles end,
    o := case when c.sentence_no is not null and coalesce(list_filter(c.offers, lambda z: not list_contains(acc.titles, lower(z.title)))[1].score >= 0.5, false) then list_append(acc.o, struct_pack(claim_no := c.claim_no, sentence_no := c.sentence_no, x := list_filter(c.offers, lambda z: not list_contains(acc.titles, lower(z.title)))[1])) else acc.o end) end,
   struct_pack(used := cast([] as varchar[]), titles := case when proposal_id % 2 = 0 then ['source 1'] else cast([] as varchar[]) end, o := cast([] as struct(claim_no int, sentence_no int, x struct(seq bigint, title varchar, score double))[]))).o as o from cl)
 select proposal_id, r.claim_no, r.sentence_no, cast(nth as int) as nth, r.x.seq as seq, r.x.title as title, r.x.score as score from (select proposal_id, unnest(o) as r, generate_subscripts(o, 1) - 1 as nth from fo) z""")  # fmt: skip
_VIEWS = ("v_op", "v_section", "v_paper_ref", "v_asked", "v_offer")
over("stacked_edits", _VIEWS, lambda *v: edits.execute(*v)[0])
over("stacked_new_references", _VIEWS, lambda *v: edits.execute(*v)[1])

# ---- checks and application -----------------------------------------------------------------------


def _counts(source: str) -> str:
    """ct: how often each change of source cites a reference before (b) and after (a)."""
    one = r"select proposal_id, paper_id, section_id, trim(unnest(string_split(ids, ','))) as ref_id from (select proposal_id, paper_id, section_id, unnest(regexp_extract_all({c}, '\[\[cite[pt]:([A-Za-z0-9_,\- ]+?)\]\]', 1)) as ids from {s})"
    return f"""cb as (select proposal_id, paper_id, section_id, ref_id, count(*) as b from ({one.format(c="before", s=source)}) group by all),
ca as (select proposal_id, paper_id, section_id, ref_id, count(*) as a from ({one.format(c="after", s=source)}) group by all)"""


_WRONG = """
vw as (select cb.proposal_id, cb.section_id, cb.ref_id, 'citation_lost' as kind, b - coalesce(a, 0) as n, not exists (select 1 from v_removal r where r.proposal_id = cb.proposal_id and r.section_id = cb.section_id and r.ref_id = cb.ref_id) as blocking
  from cb left join ca on ca.proposal_id = cb.proposal_id and ca.section_id = cb.section_id and ca.ref_id = cb.ref_id where b > coalesce(a, 0)
 union all select proposal_id, section_id, ref_id, 'unknown_ref', a, true from ca where not exists (select 1 from v_known_ref k where k.paper_id = ca.paper_id and k.ref_id = ca.ref_id) and not exists (select 1 from {new} n where n.proposal_id = ca.proposal_id and n.ref_id = ca.ref_id)
 union all select proposal_id, null, ref_id, 'no_provenance', 1, true from {new} where source is null or source_url is null)"""
over("edit_violations", ("v_change", "v_known_ref", "v_new_ref", "v_removal"), lambda c, r, n, x: integrity.violations(c, r, n, x, n),
     f"""with {_counts("v_change")}, {_WRONG.format(new="v_new_ref")} select * from vw union all select distinct proposal_id, null, ref_id, 'asserted_add_missing', 1, false from v_new_ref n where not exists (select 1 from ca where ca.proposal_id = n.proposal_id and ca.ref_id = n.ref_id)""")


def _applied(part: str):
    def of(changes, known, new, removals, state):
        papers = state.select("paper_id", F.lit(4).alias("version")).distinct()
        return integrity.apply_approved(state, papers, known, changes, changes.where("change_id % 7 <> 3").select("change_id"), new, removals)[part]

    return of


_APPLIED = f"""ch as (select * from v_change where change_id % 7 <> 3), {_counts("ch")},
nr as (select * from v_new_ref n where exists (select 1 from ca where ca.proposal_id = n.proposal_id and ca.ref_id = n.ref_id)), {_WRONG.format(new="nr").strip()},
hs as (select ch.proposal_id, count(*) filter (s.content is null) as missing, count(*) filter (s.content <> ch.before) as stale from ch left join v_state s on s.paper_id = ch.paper_id and s.section_id = ch.section_id group by 1),
s1 as (select p.proposal_id, p.paper_id, p.command, case when hs.proposal_id is null then 'rejected' when missing > 0 then 'missing_section' when exists (select 1 from vw where vw.proposal_id = p.proposal_id and blocking) then 'violations' when stale > 0 then 'stale' else 'applied' end as st
 from (select proposal_id, paper_id, max(command) as command from v_change group by all) p left join hs on hs.proposal_id = p.proposal_id),
s2 as (select proposal_id, paper_id, command, case when st = 'applied' and row_number() over (partition by paper_id, st order by proposal_id) > 1 then 'later' else st end as status from s1),
dn as (select * from s2 where status = 'applied'),
aft as (select s.paper_id, s.section_id, coalesce(ch.after, s.content) as content from v_state s left join dn on dn.paper_id = s.paper_id left join ch on ch.proposal_id = dn.proposal_id and ch.section_id = s.section_id)"""
_USED = ("v_change", "v_known_ref", "v_new_ref", "v_removal", "v_state")
over("applied_proposals", _USED, _applied("proposals"), f"with {_APPLIED} select proposal_id, paper_id, status from s2")
over("applied_sections", _USED, _applied("sections"), f"with {_APPLIED} select * from aft")
over("applied_papers", _USED, _applied("papers"), f"with {_APPLIED} select s.paper_id, cast(4 + (select count(*) from dn where dn.paper_id = s.paper_id) as int) as version from (select distinct paper_id from v_state) s")
over("applied_references", _USED, _applied("references"),
     f"with {_APPLIED} select distinct dn.paper_id, nr.ref_id, nr.proposal_id from nr join dn using (proposal_id) where not exists (select 1 from v_known_ref k where k.paper_id = dn.paper_id and k.ref_id = nr.ref_id)")
over("applied_snapshots", _USED, _applied("snapshots"), f"with {_APPLIED} select s.paper_id, 4 as version, 'edit: ' || substring(coalesce(command, ''), 1, 120) as reason, proposal_id, section_id, content from v_state s join dn using (paper_id)")
over("applied_citations", _USED, _applied("citations"),
     rf"""with {_APPLIED}, r as (select paper_id, section_id, regexp_extract_all(content, '\[\[cite[pt]:[A-Za-z0-9_,\- ]+?\]\]') as x from aft)
 select paper_id, section_id, cast(generate_subscripts(x, 1) - 1 as int) as nth, unnest(x) as raw, list_transform(string_split(regexp_extract(unnest(x), ':([A-Za-z0-9_,\- ]+?)\]\]', 1), ','), lambda y: trim(y)) as ref_ids from r""")  # fmt: skip
over("manual_edits", ("v_manual", "v_state", "v_known_ref"), lambda m, s, r: integrity.manual_edits(m, s, s.select("paper_id", F.lit(2).alias("version")).distinct(), r),
     r"""with i as (select edit_id, paper_id, unnest(regexp_extract_all(content, '\[\[cite[pt]:([A-Za-z0-9_,\- ]+?)\]\]', 1)) as ids from v_manual), e as (select edit_id, paper_id, trim(unnest(string_split(ids, ','))) as ref_id from i),
 u as (select edit_id, list(distinct ref_id order by ref_id) as unknown from e where not exists (select 1 from v_known_ref k where k.paper_id = e.paper_id and k.ref_id = e.ref_id) group by 1),
 t as (select m.*, p.paper_id is not null as there, s.content as old, unknown from v_manual m left join (select distinct paper_id from v_state) p on p.paper_id = m.paper_id left join v_state s on s.paper_id = m.paper_id and s.section_id = m.section_id left join u on u.edit_id = m.edit_id),
 z as (select *, case when not there then 'no_paper' when old is null then 'no_section' when base_version <> 2 then 'conflict' when unknown is not null then 'unknown_refs' when content = old then 'unchanged' else 'applied' end as status from t)
 select edit_id, paper_id, section_id, status, cast(case when there then 2 + case when status = 'applied' then 1 else 0 end end as int) as version, unknown from z""")  # fmt: skip


@query("versioned_sections",
       f"""with {_APPLIED} select 1 as version, 'parse' as reason, * from v_state union all select 2, 'edits', * from aft""")
def versioned_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sections committed as parsed, and again with the approved edits; both versions as the store gives them back."""
    store = Store(spark, own_path(spark, "versions"), ["paper_id", "section_id"])
    state = view(spark, sf_dir, "v_state")
    store.commit(state, 0, "parse")
    after = _applied("sections")(*(view(spark, sf_dir, v) for v in _USED))
    digest = F.sha2("content", 256).alias("digest")
    changed = after.select("*", digest).join(store.read().select("paper_id", "section_id", digest), ["paper_id", "section_id", "digest"], "left_anti").drop("digest")
    store.commit(changed, 1, "edits", expect=state)
    reasons = store.history().select("version", "reason")
    every = store.read(1).withColumn("version", F.lit(1)).unionByName(store.read(2).withColumn("version", F.lit(2)))
    return every.join(F.broadcast(reasons), "version").select("version", "reason", "paper_id", "section_id", "content")


# ---- commands ---------------------------------------------------------------------------------------

_PLANS = r"""ja as (select command_id, paper_id, regexp_replace(regexp_replace(trim(answer), '^```(?:json)?\s*', ''), '\s*```\s*$', '') as t from v_answer),
jv as (select command_id, paper_id, coalesce(try_cast(t as json), try_cast(nullif(regexp_extract(t, '(?s)\{.*\}', 0), '') as json), try_cast(nullif(regexp_extract(t, '(?s)\[.*\]', 0), '') as json)) as v from ja),
jo as (select command_id, paper_id, cast(i - 1 as int) as op_no, json_extract(v, '$.operations[' || (i - 1) || ']') as o from (select *, unnest(range(1, least(4, cast(json_array_length(v, '$.operations') as bigint)) + 1)) as i from jv where json_type(v) = 'OBJECT' and json_type(v, '$.operations') = 'ARRAY') z),
jx as (select jo.*, o ->> '$.op' as op, o ->> '$.section_id' as section_id, trim(coalesce(o ->> '$.instruction', '')) as instruction, o ->> '$.topic' as topic, case when o ->> '$.max_new' is null then 3 else floor(try_cast(o ->> '$.max_new' as double)) end as m from jo),
je as (select jx.*, case when json_type(o) <> 'OBJECT' then 'malformed operation' when s.paper_id is null then 'unknown section' when op = 'find_citations' and m is null then 'malformed operation' when op = 'rewrite_section' and instruction = '' then 'no instruction'
 when op is null or op not in ('find_citations', 'rewrite_section') then 'unknown operation' end as error from jx left join v_state s on s.paper_id = jx.paper_id and s.section_id = jx.section_id),
jb as (select command_id, count(*) as n, arg_min(error, op_no) filter (error is not null) as bad from je group by 1),
jp as (select jv.command_id, case when v is null or json_type(v) <> 'OBJECT' or not list_contains(json_keys(v), 'operations') then 'malformed plan' when json_type(v, '$.operations') not in ('ARRAY', 'NULL') then 'operations is not a list' when bad is not null then bad when n is null then 'no operation' end as error,
 case when json_type(v) = 'OBJECT' then substring(coalesce(v ->> '$.plan', ''), 1, 800) else '' end as plan, n from jv left join jb using (command_id))"""
over("command_plans", ("v_answer", "v_state"), lambda a, s: commands.plans(a, s)[0], f"with {_PLANS} select command_id, case when error is null then 'ok' else 'failed' end as status, error, plan, case when error is null then n else 0 end as n_operations from jp")
over("command_operations", ("v_answer", "v_state"), lambda a, s: commands.plans(a, s)[1],
     f"""with {_PLANS} select command_id, op_no, op, section_id, case when op = 'find_citations' then substring(coalesce(topic, ''), 1, 400) end as topic, cast(case when op = 'find_citations' then greatest(1, least(5, m)) end as int) as max_new,
 case when op = 'rewrite_section' then substring(instruction, 1, 600) end as instruction from je where command_id in (select command_id from jp where error is null)""")  # fmt: skip
over("operation_errors", ("v_answer", "v_state"), lambda a, s: commands.operations(a, s).where("error is not null").select("command_id", "op_no", "error"), f"with {_PLANS} select command_id, op_no, error from je where error is not null")
