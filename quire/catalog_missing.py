"""Queries over missing work and reviews, with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from .operators import pages
from .plans import missing
from .registry import over

over("reviewable_sections", ("v_doc_section",), lambda s: missing.reviewable(s).select("paper_id", "section_id"), "select paper_id, section_id from v_doc_section where kind in ('body', 'abstract') and length(content) >= 200")
over("upright_lines", ("v_page_line",), lambda l: pages.upright(l.withColumn("dx", F.when(F.col("line_seq") % 7 == 3, 0.5).when(F.col("line_seq") % 7 == 4, -1.0).otherwise(0.995))).select("paper_id", "line_seq"), "select paper_id, line_seq from v_page_line where line_seq % 7 <> 3")
_STOP = ", ".join(repr(w) for w in missing.works.PHRASE_STOP)
#: sr: the score of each result of a claim.
_RANKED = rf"""cw as (select paper_id, claim_no, list_filter(list_distinct(regexp_extract_all(lower(claim), '[a-z\-]{{3,}}')), lambda w: w not in ({_STOP})) as ws from v_topic),
sr as (select r.paper_id, r.claim_no, seq, round(cast(least(1.0, 0.7 * len(list_filter(ws, lambda w: contains(lower(coalesce(title, '') || ' ' || coalesce(abstract, '')), w))) / greatest(len(ws), 3) + 0.3 * log10(cast(coalesce(cited_by_count, 0) as double) + 1.0) / 5) as double), 9) as score
 from v_result r join cw on cw.paper_id = r.paper_id and cw.claim_no = r.claim_no)"""
over("ranked_results", ("v_topic", "v_result"), missing.ranked, f"with {_RANKED} select * from sr")
over("missing_work", ("v_topic", "v_result", "v_paper_ref", "v_paper"), missing.missing_work)
