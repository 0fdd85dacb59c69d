"""A whole parse of two papers, with its stages told and its counters equal to its tables."""

from __future__ import annotations

import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from quire.plans import papers
from quire.plans.stages import Stages

NUMBERED = [
    ("A Study of Many Small Things", 16, 0), ("Ada Lovelace", 10, 0), ("University of Tests", 10, 0), ("Abstract— We study things", 10, 0), ("as they are.", 10, 0), ("1 Introduction", 12, 0), ("Prior work [1] and [2, 3] is un-", 10, 0), ("known [9].", 10, 0),
    ("2 Method", 12, 0), ("We follow [3].", 10, 0), ("References", 12, 0), ("[1] A. Reed, \"The first of all titles,\" Journal of X, 2001.", 10, 0), ("[2] B. Vale, \"The second of titles,\" Journal of Y,", 10, 0), ("2002.", 10, 0), ("[3] C. Elm, \"The third of all titles,\" Journal of Z, 2003.", 10, 0), ("Figure 1. A drawing", 10, 0),
]
UNNUMBERED = [
    ("Another Study of Things", 16, 0), ("Introduction", 12, 0), ("Reed (2001) said so (Vale, 2002; Elm et al., 2003).", 10, 0), ("REFERENCES", 10, 0), ("Reed, A. (2001). The first of all titles. Journal of X.", 10, 0), ("Vale, B. (2002). The second of all titles. Journal", 10, 0), ("of Y.", 10, 12),
    ("Elm, C. (2003). The third of all titles. Journal of Z.", 10, 0), ("Müller, D. (2004). The fourth of all titles. Journal of Z.", 10, 0),
]


@pytest.fixture(scope="module")
def parsed(spark):
    rows = [(p, 0, i, t, 60.0 + dx, 400.0, 100.0 + 14 * i, 110.0 + 14 * i, float(s), False) for p, texts in enumerate((NUMBERED, UNNUMBERED)) for i, (t, s, dx) in enumerate(texts)]
    lines = spark.createDataFrame(rows, "paper_id long, page int, line_seq int, text string, x0 double, x1 double, y0 double, y1 double, size double, mostly_bold boolean")
    drawn = spark.createDataFrame([(0, 0, "image", 0, 380.0, 320.0, 560.0, 350.0, ""), (0, 0, "image", 1, 420.0, 100.0, 560.0, 140.0, "")], "paper_id long, page int, kind string, seq long, x0 double, y0 double, x1 double, y1 double, body string")
    told = []
    return papers.parse(lines, drawn, lambda *x: told.append(x)), told


def test_sections_meta_and_citations(parsed):
    p, _ = parsed
    assert [(r["title"], r["authors"], r["abstract"]) for r in p.meta.orderBy("paper_id").collect()] == [("A Study of Many Small Things", ["Ada Lovelace"], "We study things as they are."), ("Another Study of Things", [], None)]
    got = [(r["paper_id"], r["title"], r["kind"], r["content"]) for r in p.sections.orderBy("paper_id", "section_no").collect()]
    assert got == [
        (0, "Abstract", "abstract", "Abstract— We study things as they are."), (0, "Introduction", "body", "Prior work [[citep:ref_1]] and [[citep:ref_2,ref_3]] is unknown [9]."), (0, "Method", "body", "We follow [[citep:ref_3]]."), (0, "References", "references", ""),
        (1, "Introduction", "body", "Reed [[citet:ref_1]] said so [[citep:ref_2,ref_3]]."), (1, "REFERENCES", "references", ""),
    ]
    assert [(r["paper_id"], r["raw"]) for r in p.unlinked.collect()] == [(0, "[9]")]
    assert [(r["style"], r["csl_style"]) for r in p.styles.orderBy("paper_id").collect()] == [("numeric_bracket", "ieee"), ("author_year", "apa")]


def test_both_lists_are_parsed(parsed):
    p, _ = parsed
    got = [(r["paper_id"], r["ref_id"], r["label"], r["authors"], r["title"], r["year"]) for r in p.references.orderBy("paper_id", "ord").collect()]
    assert got[:3] == [(0, "ref_1", "1", ["Reed, A."], "The first of all titles", 2001), (0, "ref_2", "2", ["Vale, B."], "The second of titles", 2002), (0, "ref_3", "3", ["Elm, C."], "The third of all titles", 2003)]
    assert [x[3:] for x in got[3:]] == [(["Reed, A."], "The first of all titles", 2001), (["Vale, B."], "The second of all titles", 2002), (["Elm, C."], "The third of all titles", 2003), (["Müller, D."], "The fourth of all titles", 2004)]


def test_stages_are_told_and_counters_equal_the_tables(parsed):
    p, told = parsed
    assert [(k, phase) for k, phase, _ in told] == [(k, ph) for k in ("A", "A'", "B", "C", "D", "E") for ph in ("start", "done")]
    assert [t for _, phase, t in told if phase == "done"] == p.report
    c = p.counters
    assert c["n_lines"] == p.lines.count() and c["n_sections"] == p.sections.count() and c["n_references"] == p.references.count() == 7 and c["n_unlinked"] == p.unlinked.count() == 1
    assert c["n_parsed"] == p.references.where("confidence >= .5").count() == 7 and c["n_unparsed"] == 0 and c["n_linked"] == 5 and (c["n_figure"], c["n_table"], c["n_box"]) == (2, 0, 0)
    assert [(r["caption"], r["anchor_line"], r["section_no"]) for r in p.floats.orderBy("float_no").collect()] == [("Figure 1. A drawing", 14, 4), ("", None, 4)]


def test_counters_come_with_the_write(spark):
    """One job writes and counts; an empty table counts nothing."""
    seen = Observation()
    assert spark.range(5).observe(seen, F.count(F.lit(1)).alias("n")).count() == 5 and seen.get == {"n": 5}
    run, group = Stages(), "quire-stage"
    spark.sparkContext.setJobGroup(group, group)
    rows = run.keep(spark.range(100, numPartitions=3), "t", n=F.count(F.lit(1)), odd=F.count_if(F.col("id") % 2 == 1), top=F.max("id"))
    assert run.counters == {"n": 100, "odd": 50, "top": 99} and len(spark.sparkContext.statusTracker().getJobIdsForGroup(group)) == 1
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    run.keep(rows.where("id < 0"), "e", m=F.count(F.lit(1)), s=F.sum("id"))
    assert (run.counters["m"], run.counters["s"]) == (0, 0)
