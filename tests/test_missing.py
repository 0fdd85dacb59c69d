"""Missing work and rewrites on small cases."""

from __future__ import annotations

import json
import math

from quire.plans import missing


def test_ranking_dedupes_caps_and_then_drops(spark):
    claims = spark.createDataFrame([(1, 0, "Nets learn deep features of images"), (1, 1, "the of and")], "paper_id long, claim_no int, claim string")
    results = [(1, 0, 1, "10.1/known", "Deep nets", None, 10), (1, 0, 2, None, "Deep features: nets that learn from images", None, 0), (1, 0, 3, "10.2/x", "Deepest networks", "they learn features", 99999), (1, 0, 4, "10.2/X", "copy", None, 0), (1, 0, 5, None, "Nothing", None, None), (1, 0, 6, None, "images", None, 0), (1, 1, 7, None, "Other", None, 99)]
    found = spark.createDataFrame([(p, c, s, d, "", None, t, a, n) for p, c, s, d, t, a, n in results], "paper_id long, claim_no int, seq long, doi string, url string, note string, title string, abstract string, cited_by_count int")
    refs = spark.createDataFrame([(1, "10.1/KNOWN", None, "x")], "paper_id long, doi string, arxiv string, title string")
    papers = spark.createDataFrame([(1, "A paper")], "paper_id long, title string")
    scores = {r["seq"]: r["score"] for r in missing.ranked(claims, found).collect()}
    assert math.isclose(scores[2], 0.7, abs_tol=1e-9) and math.isclose(scores[3], 0.7 * 3 / 5 + 0.3, abs_tol=1e-6) and scores[5] == 0.0
    got = [(r["place"], r["seq"]) for r in missing.missing_work(claims, found, refs, papers).orderBy("place").collect()]
    assert got == [(1, 3), (2, 2)]


def test_rewrites_keep_every_token(spark):
    rows = [(1, "s", "shorten", "A [[citep:ref_1]] b."), (2, "s", "break", "A [[citep:ref_1]] b."), (3, "s", "mend", "A [[citep:ref_1,ref_2]] b."), (4, "s", "silent", "x")]

    def model(prompt):
        if "shorten" in prompt:
            return " B [[citet:ref_1]]. "
        if "mend" in prompt:
            return "C [[citep:ref_2]] [[citep:ref_1]]." if "missing: ['ref_2']" in prompt else "C [[citep:ref_1]]."
        return None if "silent" in prompt else "none"

    got = {r["proposal_id"]: (r["text"], r["attempts"], r["status"]) for r in missing.rewritten(spark.createDataFrame(rows, "proposal_id long, section_id string, instruction string, content string"), model).collect()}
    assert got == {1: ("B [[citet:ref_1]].", 1, "ok"), 2: (None, 2, "tokens"), 3: ("C [[citep:ref_2]] [[citep:ref_1]].", 2, "ok"), 4: (None, 1, "no answer")}


def test_report(spark):
    s = spark.createDataFrame([(1,), (1,), (2,)], "paper_id long")
    r = spark.createDataFrame([(1, 0.4), (1, 0.9)], "paper_id long, confidence double")
    styles = spark.createDataFrame([(1, "author_year", 0.5), (2, "unknown", 0.0)], "paper_id long, style string, confidence double")
    got = {x["paper_id"]: json.loads(x["report"]) for x in missing.report_json(s, r, s.where("paper_id = 2"), styles).collect()}
    assert got == {1: {"n_sections": 2, "n_references": 2, "n_parsed": 1, "n_unlinked": 0, "style": "author_year", "confidence": 0.5}, 2: {"n_sections": 1, "n_references": 0, "n_parsed": 0, "n_unlinked": 1, "style": "unknown", "confidence": 0.0}}
