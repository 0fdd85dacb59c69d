"""Golden cases of markers, tokens and integrity."""

from __future__ import annotations

import os

import pytest
from oracles import same_rows
from pyspark.sql import functions as F

from quire import catalog
from quire.functions import citations as C
from quire.functions import text as T
from quire.operators import integrity, links, render


@pytest.fixture(scope="module")
def refs(spark):
    rows = [(i, f"ref_{i}", str(i), a, y, "A title", None, None) for i, (a, y) in enumerate([("Smith, J.", 2020), ("Doe, A.", 2021), ("Chen, L.", 2019), ("Chen, M.", 2019), ("Müller, K.", 2020)], 1)]
    own = spark.createDataFrame(rows, "ord int, ref_id string, label string, author1 string, year int, title string, doi string, container string")
    return own.crossJoin(spark.range(3).select(F.col("id").cast("int").alias("paper_id")))


def sections(spark, *texts):
    return spark.createDataFrame([(i, "sec_1", t) for i, t in enumerate(texts)], "paper_id int, section_id string, content string")


@pytest.mark.parametrize(
    ("inside", "expected"),
    [("1", [1]), ("2, 3-5", [2, 3, 4, 5]), ("1; 4–5", [1, 4, 5]), ("5-3", None), ("1-60", None), ("1-41", list(range(1, 42))), ("1,", None), ("x", None)],
)
def test_numbers(spark, inside, expected):
    assert spark.createDataFrame([(inside,)], "x string").select(C.numbers(F.col("x"))).first()[0] == expected


def test_groups_link(spark, refs):
    out = links.tokenised(sections(spark, "Prior work [1] and later studies [2, 3-5] agree.", "See [1] and the bogus [42].", "None."), refs)
    got = {r["paper_id"]: r["content"] for r in out.collect()}
    assert got == {0: "Prior work [[citep:ref_1]] and later studies [[citep:ref_2,ref_3,ref_4,ref_5]] agree.", 1: "See [[citep:ref_1]] and the bogus [42].", 2: "None."}


def test_unmatched(spark, refs):
    assert [r["raw"] for r in links.unmatched_markers(sections(spark, "See [1] and [42]."), refs).collect()] == ["42"]


def test_author_year(spark, refs):
    out = links.author_year_links(sections(spark, "As said (Smith, 2020; Doe et al., 2021).", "Both (Chen, 2019a) and (Chen, 2019b).", "So Müller (2020) proposed."), refs)
    got = sorted((r["paper_id"], r["ref_id"]) for r in out.collect())
    assert got == [(0, "ref_1"), (0, "ref_2"), (1, "ref_3"), (1, "ref_4"), (2, "ref_5")]


def test_tokens(spark):
    t = spark.createDataFrame([("x [[citep:ref_1]] y [[citet:ref_2]] z [[citep:ref_1,ref_3]]",)], "t string")
    assert t.select(C.token_ids(F.col("t"))).first()[0] == ["ref_1", "ref_2", "ref_1", "ref_3"]
    assert t.select(C.without_tokens(F.col("t"))).first()[0] == "x y z"


def test_sentences(spark):
    t = spark.createDataFrame([("D. P. Kingma et al. wrote it. See Fig. 2 here! Was it? (Yes.) no",)], "t string")
    assert t.select(T.sentences(F.col("t"))).first()[0] == ["D. P. Kingma et al. wrote it.", "See Fig. 2 here!", "Was it?", "(Yes.) no"]


def test_paired_abbreviations(spark):
    """As in SQL, where a replacement takes the white space along: every other one of a row ends a sentence."""
    t = spark.createDataFrame([("la no. No. Y. Later. Dr. No. Et al. X e.g. Fig.  A. no.\nNo.\nNo. B",)], "t string")
    assert t.select(T.sentences(F.col("t"), paired=True)).first()[0] == ["la no. No.", "Y. Later.", "Dr. No.", "Et al.", "X e.g. Fig.", "A. no.", "No.\nNo.", "B"]
    assert "".join(t.select(T.sentence_pieces(F.col("t"), paired=True)).first()[0]) == t.first()["t"]


@pytest.mark.parametrize("name", ["sentence_spans", "citation_context", "claim_texts", "located_sentences", "cited_findings"])
def test_rows_of_abbreviations(spark, tmp_path, name):
    source = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{source}/documents.parquet").limit(20)
    text = F.concat(F.lit("El ieñ la queesjaos asosmi no. No. Y. Later that day, Dr. No. El asosmi mente no. vol. "), F.substring("text", 1, 300), F.lit(" Una no no. Y."))
    docs.withColumn("text", text).coalesce(1).write.parquet(f"{tmp_path}/d")
    os.rename(next(tmp_path.glob("d/*.parquet")), tmp_path / "documents.parquet")
    os.symlink(f"{source}/benchmark.parquet", tmp_path / "benchmark.parquet")
    same_rows(spark, catalog.QUERIES[name], catalog.ORACLES[name], str(tmp_path))


def test_numbers_in_parentheses_as_printed(spark, refs):
    got = links.marker_families(sections(spark, "a (03) b (3) c (1-3)", "a (03) b", "⟨sup:02⟩ a ⟨sup:1, 2⟩ [03]"), refs).collect()
    assert sorted((r["paper_id"], r["bracket"], r["paren"], r["superscript"], r["dominant"], r["confidence"]) for r in got) == [(0, 0, 1, 0, "paren", 1.0), (2, 1, 0, 1, "bracket", 0.5)]


def test_integrity(spark, refs):
    rows = [(1, "a [[citep:ref_1]] b [[citep:ref_1]]", "a [[citep:ref_1]] b", 0), (2, "a [[citep:ref_1]]", "a", 1), (3, "a", "a [[citep:ref_9]]", 0), (4, "a [[citep:ref_2]]", "b [[citet:ref_2]]", 0)]
    p = spark.createDataFrame(rows, "paper_id int, before_text string, after_text string, removal_ack int")
    got = {r["paper_id"]: (r["n_lost"], r["n_unknown"], r["n_blocking"], r["n_warning"], r["ok"]) for r in integrity.report(p, refs.drop("paper_id")).collect()}
    assert got == {1: (1, 0, 1, 0, False), 2: (1, 0, 0, 1, True), 3: (0, 1, 1, 0, False), 4: (0, 0, 0, 0, True)}


def test_unknown_references_are_a_papers_own(spark):
    """What another paper lists is unknown here."""
    refs = spark.createDataFrame([(1, "ref_1"), (2, "ref_2")], "paper_id int, ref_id string")
    p = spark.createDataFrame([(1, "", "[[citep:ref_1,ref_2]]", 0), (2, "", "[[citep:ref_2]]", 0)], "paper_id int, before_text string, after_text string, removal_ack int")
    assert [(r["paper_id"], r["ref_id"]) for r in integrity.unknown(p, refs).collect()] == [(1, "ref_2")]


def test_tex(spark):
    p = spark.createDataFrame([(1, "95% accuracy & more [[citep:ref_1]] [[citet:ref_2]]")], "paper_id int, after_text string")
    assert render.tex(p).first()["tex"] == r"95\% accuracy \& more \citep{ref_1} \citet{ref_2}"


def test_bibliographies_are_a_papers_own(spark):
    refs = spark.createDataFrame([(0, 1, "a", "1", "Smith, J.", 2020), (1, 1, "b", "1", "Smith, K.", 2020), (1, 2, "c", "2", "Doe, A.", 2021)], "paper_id int, ord int, ref_id string, label string, author1 string, year int")
    two = sections(spark, "See [1], [2] and (Smith, 2020).", "See [1], [2] and (Smith, 2020).")
    got = links.link_numbers(links.number_markers(two, C.BRACKET), refs).collect()
    assert sorted((r["paper_id"], r["raw"], *r["ref_ids"]) for r in got) == [(0, "1", "a"), (0, "2"), (1, "1", "b"), (1, "2", "c")]
    assert sorted((r["paper_id"], r["ref_id"]) for r in links.author_year_links(two, refs).collect()) == [(0, "a"), (1, "b")]
