"""Styles and whole-paper exports of one small paper, as they read."""

from __future__ import annotations

import pytest

from pyspark.sql import functions as F

from quire.operators import exports, styles

REF = "paper_id long, ord int, ref_id string, label string, authors array<string>, year int, title string, container string, volume string, pages string, doi string, arxiv string, url string, raw_text string, renderable boolean, added_by string, added_reason string, source string, source_url string"


@pytest.fixture(scope="module")
def paper(spark):
    def ref(n, authors, year, title, container=None, renderable=True, agent=False, **more):
        return (1, n, f"ref_{n}", str(n), authors, year, title, container, more.get("volume"), more.get("pages"), more.get("doi"), more.get("arxiv"), more.get("url"), f"raw {n}", renderable, "agent" if agent else "pdf_parse", "why" if agent else None, "openalex" if agent else None, "https://w" if agent else None)

    refs = [ref(1, ["Smith, John A."], 2020, "Deep & wide", "Journal of Nets", volume="4", pages="1-9", doi="10.1/a_b"), ref(2, ["Doe, Ann", "Roe, Bo"], 2019, "Shallow", "Proceedings of X"), ref(3, ["Chen, Li", "Wu, D.", "Ma, E."], 2021, "Third", arxiv="2101.00001", agent=True), ref(4, [], None, None, renderable=False), ref(5, ["Young, Z."], None, "Uncited")]
    sections = [(1, 0, "sec_1", "Abstract", 1, "abstract", "Abstract. We test [[citep:ref_2]]."), (1, 1, "sec_2", "Intro", 1, "body", "See [[citep:ref_1,ref_2]] and [[citet:ref_3]] at 95% & more.\n\n\n\nThen [[citep:ref_4]], [[citep:ref_9]]."), (1, 2, "sec_3", "Deep", 5, "body", "F_1"), (1, 3, "sec_4", "References", 1, "references", "gone")]
    floats = [(1, 0, "table", 2, "Table 1. T", "a | b\n\nc", "sec_2"), (1, 1, "box", 0, "", "boxed", "sec_4"), (1, 2, "figure", 1, "", "", None)]
    return {
        "papers": spark.createDataFrame([(1, "On A & B", ["Ada L.", "Bob_M"], 2)], "paper_id long, title string, authors array<string>, version int"),
        "sections": spark.createDataFrame(sections, "paper_id long, sec_no int, section_id string, title string, level int, kind string, content string"),
        "floats": spark.createDataFrame(floats, "paper_id long, float_no int, kind string, page int, caption string, text string, section_id string"),
        "refs": spark.createDataFrame(refs, REF),
    }


@pytest.mark.parametrize(
    ("style", "want"),
    [
        ("apa", ["(Doe & Roe, 2019)", "(Smith, 2020; Doe & Roe, 2019)", "(2021)", "[4]", "[]"]),
        ("chicago-author-date", ["(Doe and Roe 2019)", "(Smith 2020; Doe and Roe 2019)", "(2021)", "[4]", "[]"]),
        ("harvard-cite-them-right", ["(Doe and Roe, 2019)", "(Smith, 2020; Doe and Roe, 2019)", "(2021)", "[4]", "[]"]),
        ("ieee", ["[1]", "[2], [1]", "[3]", "[4]", "[]"]),
        ("nature", ["1", "2,1", "3", "[4]", "[]"]),
    ],
)
def test_labels(paper, style, want):
    assert [r["label"] for r in styles.labels(paper["refs"], paper["sections"], style).orderBy("sec_no", "nth").collect()] == want


def test_names_of_three(spark, paper):
    three = spark.createDataFrame([(1, 0, "x", "t", 1, "body", "[[citep:ref_3]]")], paper["sections"].schema)
    got = {s: styles.labels(paper["refs"], three, s).first()["label"] for s in styles.STYLES}
    assert got == {"apa": "(Chen et al., 2021)", "chicago-author-date": "(Chen, Wu, and Ma 2021)", "harvard-cite-them-right": "(Chen, Wu and Ma, 2021)", "ieee": "[1]", "nature": "1"}


def test_bibliographies(paper):
    text = lambda s: [r["text"] for r in styles.bibliography(paper["refs"], paper["sections"], s).orderBy("place").collect()]
    assert text("ieee") == ["[1]A. Doe and B. Roe, “Shallow,” Proceedings of X, 2019.", "[2]J. A. Smith, “Deep & wide,” Journal of Nets, vol. 4, pp. 1-9, 2020.", "[3]L. Chen, D. Wu, and E. Ma, “Third,”, 2021.", "[4]Z. Young, “Uncited,”, n.d..", "raw 4"]
    assert text("apa") == ["Chen, L., Wu, D., & Ma, E. (2021). Third.", "Doe, A., & Roe, B. (2019). Shallow. Proceedings of X", "Smith, J. A. (2020). Deep & wide. Journal of Nets, 4, 1-9. https://doi.org/10.1/a_b", "Young, Z. (n.d.). Uncited.", "raw 4"]


def test_samples_are_of_the_papers_own_works(paper):
    one = styles.samples(paper["refs"], paper["sections"], "apa").first()
    assert (one["parenthetical"], one["narrative"], one["grouped"]) == ("(Doe & Roe, 2019)", "(2019)", "(Doe & Roe, 2019; Smith, 2020)")
    assert [e.split(",")[0] for e in one["entries"]] == ["Doe", "Smith"]
    assert styles.samples(paper["refs"], paper["sections"], "ieee").first()["grouped"] == "[1], [2]"


def test_latex(paper):
    tex = {s: exports.latex(**paper, style_id=s).first()["tex"] for s in ("ieee", "apa")}
    assert tex["apa"].startswith("% Citation style: apa\n\\documentclass[11pt]{article}\n\\usepackage[utf8]{inputenc}\n\\usepackage[round]{natbib}\n")
    for line in ("\\title{On A \\& B}", "\\author{Ada L. \\and Bob\\_M}", "\\begin{abstract}\nWe test \\citep{ref_2}.\n\\end{abstract}", "See \\citep{ref_1,ref_2} and \\citet{ref_3} at 95\\% \\& more.\n\nThen", "\\subsubsection{Deep}\nF\\_1", "\\bibitem[Smith(2020)]{ref_1}", "\\bibitem[Chen et al.(2021)]{ref_3}", "{ref_4} raw 4  % UNPARSED — raw text kept verbatim"):
        assert line in tex["apa"], line
    assert "\\usepackage{cite}" in tex["ieee"] and "\\cite{ref_3}" in tex["ieee"] and "\\citet" not in tex["ieee"] and "\\bibitem{ref_2} A. Doe and B. Roe" in tex["ieee"] and "gone" not in tex["ieee"]
    inner = tex["ieee"]
    assert inner.index("\\section{Intro}") < inner.index("\\begin{table}[htbp]") < inner.index("\\subsubsection{Deep}") < inner.index("\\section*{Unanchored floats}") < inner.index("\\begin{quote}") < inner.index("\\begin{figure}") < inner.index("\\begin{thebibliography}{9}")
    assert inner.endswith("\\end{thebibliography}\n\\end{document}\n") and "\\caption{Table 1. T}" in inner


def test_markdown_bibtex_and_provenance(spark, paper):
    md = exports.markdown(**paper, style_id="ieee").first()["markdown"]
    assert md.startswith("# On A & B\n\nAda L., Bob_M\n\n## Abstract\n\nAbstract. We test [1].\n") and "#### Deep" in md and "> **Table 1. T**\n>\n> a | b\n>\n> c\n>\n> _text preserved; original layout not reconstructed_\n" in md
    assert "## Unanchored floats\n\n> **Box (page 1)**" in md and "> **Figure (page 2)**" in md
    assert md.endswith("- raw 4  ⚠ unparsed (raw text)\n")
    by = {r["ref_id"]: r["entry"] for r in exports.bibtex(paper["refs"]).collect()}
    assert by["ref_1"] == "@article{ref_1,\n  title = {Deep \\& wide},\n  author = {Smith, John A.},\n  year = {2020},\n  journal = {Journal of Nets},\n  volume = {4},\n  pages = {1-9},\n  doi = {10.1/a\\_b}\n}"
    assert by["ref_2"].startswith("@inproceedings{ref_2,") and "booktitle = {Proceedings of X}" in by["ref_2"] and by["ref_3"].startswith("@misc{") and "url = {https://arxiv.org/abs/2101.00001},\n  note = {arXiv:2101.00001}" in by["ref_3"]
    history = spark.createDataFrame([(1, 1, "edit: x")], "paper_id long, version int, reason string").selectExpr("*", "timestamp'2026-01-02 03:04:05' as created_at")
    text = exports.provenance(paper["papers"], paper["refs"], history).first()["provenance"]
    assert "## Agent-added references (1)\n\n- **Third** — added because: why\n  - source: openalex — https://w\n" in text and text.endswith("- v1 → v2: edit: x (2026-01-02 03:04)\n")
    assert sorted(r["path"] for r in exports.files(**paper, history=history, style_id="apa").collect()) == ["PROVENANCE.md", "main.tex", "paper.md", "references.bib"]


def test_texts_are_written_after_joins(spark):
    """Pieces without a text are left out, but not by a filter: that was moved into the joins before and wrote each text for every pair of rows."""
    docs, nos = spark.createDataFrame([(1, "a b", 2), (2, "c d", 0), (3, None, 1)], "paper_id long, t string, n int"), spark.createDataFrame([(k,) for k in range(9)], "k int")
    pieces = docs.join(nos, F.col("k") < F.col("n")).select("paper_id", F.struct(F.lit(1).alias("p"), "k", F.lit(0).alias("b")).alias("path"), F.replace("t", F.lit(" "), F.lit("-")).alias("text"))
    out = exports.assembled([pieces], "x")
    assert [tuple(r) for r in out.collect()] == [(1, "a-b\na-b\n")]
    plan = out._jdf.queryExecution().optimizedPlan().toString().splitlines()
    assert not any("replace(" in line for line in plan if "Join" in line or "Filter" in line)
