"""Sources, sinks, the parse plan, the review's branches and the stream."""

from __future__ import annotations

import io
import json
import zipfile

from quire.plans import parse, review
from quire.sources import documents
from quire.streaming import intake


def paper(i, version=1, title="T"):
    return (f"p{i}", title, float(i), version, "ieee", "body")


def test_upsert_and_load(spark, tmp_path):
    path = str(tmp_path / "papers")
    documents.upsert(spark.createDataFrame([paper(i) for i in range(20)], documents.PAPER), path)
    documents.upsert(spark.createDataFrame([paper(3, 2, "New"), paper(30)], documents.PAPER), path)
    assert spark.read.parquet(path).count() == 21
    assert documents.load(spark, path, "p3").first()["title"] == "New" and documents.load(spark, path, "none").count() == 0
    assert documents.catalogue(spark.read.parquet(path)).first()["paper_id"] == "p30"


def test_stream(spark, tmp_path):
    src, out = tmp_path / "in", str(tmp_path / "out")
    src.mkdir()
    names = [c.split()[0] for c in documents.PAPER.split(", ")]
    (src / "a.json").write_text("\n".join(json.dumps(dict(zip(names, paper(i), strict=True))) for i in range(5)) + "\n{broken\n")
    for _ in range(2):
        q = intake.intake(spark, str(src), out, str(tmp_path / "cp"))
        q.awaitTermination()
    assert spark.read.parquet(out).count() == 5
    assert documents.read_json(spark, str(src)).count() == 5


def test_lines_of(spark):
    rows = [("p", 0, 0, 1, "bold", 12.0, "Times-Bold", 0, 5.0, 1.0, 9.0, 2.0), ("p", 0, 0, 0, "a ", 10.0, "Times", 0, 1.0, 1.0, 4.0, 2.0), ("p", 0, 1, 0, " ", 9.0, "Times", 16, 1.0, 3.0, 2.0, 4.0)]
    s = spark.createDataFrame(rows, "paper_id string, page int, line_seq long, span_no int, text string, size double, font string, flags int, x0 double, y0 double, x1 double, y1 double")
    got = [(r["text"], r["size"], r["mostly_bold"], r["x0"], r["x1"]) for r in documents.lines_of(s).orderBy("line_seq").collect()]
    assert got == [("a bold", 12.0, True, 1.0, 9.0), ("", 0.0, False, 1.0, 2.0)]


def test_zip(spark):
    z = zipfile.ZipFile(io.BytesIO(documents.zip_of(spark.createDataFrame([("b.md", "x"), ("a.tex", "y")], "path string, content string"))))
    assert z.namelist() == ["a.tex", "b.md"] and z.read("b.md") == b"x"


def test_parse(spark):
    text = ["Introduction", "Earlier work [1] and [2, 3] holds, un-", "like [7].", "References", "[1] J. Ba, \"First paper here,\" in Proc. X, 2015.", "[2] K. Cho, \"Second paper here,\" Journal, 2016.", "[3] A. Li, \"Third paper", "here,\" Journal, 2017."]
    rows = [(1, i, 0, t, 72.0, 40.0 + 14 * i, 12.0 if t in ("Introduction", "References") else 10.0) for i, t in enumerate(text)]
    p = parse.parse(spark.createDataFrame(rows, "paper_id long, line_seq int, page int, text string, x0 double, y0 double, size double"))
    assert [(r["title"], r["kind"]) for r in p.sections.orderBy("section_no").collect()] == [("Introduction", "body"), ("References", "references")]
    assert [r["label"] for r in p.entries.orderBy("entry_no").collect()] == [1, 2, 3]
    assert sorted((r["title"], r["year"]) for r in p.references.collect()) == [("First paper here", 2015), ("Second paper here", 2016), ("Third paper here", 2017)]
    assert [(r["linked"], r["ref_ids"]) for r in p.linked.orderBy("marker_no").collect()] == [(True, ["ref_1"]), (True, ["ref_2", "ref_3"]), (False, [None])]


def test_judged(spark):
    rows = [(1, 1, "alpha claim", "r1", "the alpha abstract"), (1, 2, "beta claim", "r2", "the beta abstract"), (1, 3, "c", None, None), (1, 4, "d", "r4", None), (1, 5, "gamma claim", "r5", "the gamma abstract"), (1, 6, "delta claim", "r6", "x")]
    df = spark.createDataFrame(rows, "paper_id long, seq long, claim string, ref_id string, abstract string")
    model = review.scripted({"alpha": '```json\n{"verdict": "supported", "quote": "alpha abstract"}\n```', "beta": 'So: {"verdict": "supported", "quote": "never written in there"}', "gamma": '{"verdict": "unsupported"}', "delta": "no json"})
    got = {r["seq"]: (r["type"], r["severity"]) for r in review.judged(df, model).collect()}
    assert got == {1: ("claim_supported", "info"), 2: ("claim_unverifiable", "low"), 3: ("unlinked_marker", "low"), 4: ("claim_unverifiable", "low"), 5: ("claim_unsupported", "high"), 6: ("claim_unverifiable", "low")}
    assert {r["type"] for r in review.judged(df, None).collect()} == {"claim_unverifiable", "unlinked_marker"}


def test_review_run(spark):
    sections = spark.createDataFrame([(4, "sec_1", "See [1] and [7].")], "paper_id long, section_id string, content string")
    refs = spark.createDataFrame([(4, 1, "ref_1", "1", "10.1/a"), (5, 1, "ref_1", "1", "10.1/b")], "paper_id long, ord int, ref_id string, label string, doi string")
    tokens = spark.createDataFrame([(4, "[[citep:ref_1]] and [[citep:ref_2]]", "[[citep:ref_1]]")], "paper_id long, before_text string, after_text string")
    sources = spark.createDataFrame([(4, 1, "W1", "10.1/A", "one"), (4, 2, "W2", "10.1/B", "two"), (5, 3, "W3", "10.1/B", "two")], "paper_id long, seq long, api_id string, doi string, title string")
    got = review.run(sections, refs, tokens, sources).collect()
    assert sorted((r["paper_id"], r["type"], r["title"]) for r in got) == [(4, "lost_citation", "ref_2"), (4, "missing_work", "10.1/b"), (4, "unlinked_marker", "[7]")]
