"""Similarity joins against all pairs."""

from __future__ import annotations

import random

import pytest

from quire.fixtures import view
from quire.functions.similarity import common_length, common_lengths, indel_ratio
from quire.operators import similar

SF = "/root/testdata/sf0.001"


def texts(rng, n):
    """Random titles, near copies of some, and very short ones."""
    out = ["".join(rng.choice("abcdefg hij") for _ in range(rng.randrange(1, 60))) for _ in range(n)]
    for s in out[: n // 2]:
        t = list(s)
        for _ in range(rng.randrange(0, 6)):
            k = rng.randrange(len(t) + 1)
            t[k : k + rng.randrange(2)] = rng.choice(["", "z", "ab"])
        out.append("".join(t))
    return out


@pytest.mark.parametrize("least", [75.0, 88.0, 90.0, 97.0])
def test_pairs_equal_all_pairs(spark, least):
    rng = random.Random(int(least))
    a, b = texts(rng, 90), texts(rng, 60)
    b += a[:40]
    left, right = (spark.createDataFrame([(i % 2, s) for i, s in enumerate(x)], "p int, s string") for x in (a, b))
    keyed = lambda x: {(i % 2, s) for i, s in enumerate(x) if s}
    every = [(p, l, r) for p, l in keyed(a) for q, r in keyed(b) if p == q]
    for strict in (False, True):
        want = sorted((p, l, r) for p, l, r in every if (indel_ratio(l, r) > least if strict else indel_ratio(l, r) >= least))
        assert sorted((r["p"], r["l"], r["r"]) for r in similar.pairs(left, right, least, ["p"], strict).collect()) == want
        assert sorted((r["p"], r["l"], r["r"]) for r in similar.pairs(left, right, least, ["p"], strict, small_blocks=True).collect()) == want
    unkeyed = {(l, r) for l in set(a) for r in set(b) if l and r and indel_ratio(l, r) >= least}
    assert {(r["l"], r["r"]) for r in similar.pairs(left, right, least).collect()} == unkeyed
    if least >= 90:
        assert similar.candidates(left, right, least).count() < len(set(a)) * len(set(b)) / 2


def test_lengths_of_many_pairs_at_once():
    """Texts of none to several words of 64 places, letters of all planes, more pairs than a table of masks holds."""
    rng = random.Random(5)
    for letters, longest, n in (("abc ", 5, 400), ("abü漢字 x😀", 130, 400), ("ab", 400, 100), ("abcdefghijklmnop ", 60, 40_000)):
        a, b = (["".join(rng.choice(x) for _ in range(rng.randrange(longest))) for _ in range(n)] for x in (letters, letters + "z"))
        got = common_lengths(a, b)
        assert all(got[i] == common_length(a[i], b[i]) for i in range(0, n, max(n // 1000, 1)))


def test_small_blocks_meet_in_many_partitions(spark):
    """By the bytes of its texts a table of short blocks would lie in one partition, with all its pairs."""
    t = spark.range(400).selectExpr("id % 100 as p", "concat('title ', id) as s")
    assert similar.candidates(t, t, 75.0, ["p"], small_blocks=True).rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_titles_of_all_papers(spark):
    """Equal to all pairs over the whole small table, from a small part of them as candidates."""
    refs = view(spark, SF, "v_paper").selectExpr("title as s")
    found = view(spark, SF, "v_search").selectExpr("title as s")
    l, r = ({x["s"] for x in t.collect() if x["s"]} for t in (found, refs))
    got = {(x["l"], x["r"]) for x in similar.pairs(found, refs, 90.0).collect()}
    assert got == {(a, b) for a in l for b in r if 200 * min(len(a), len(b)) >= 90 * (len(a) + len(b)) and indel_ratio(a, b) >= 90} and len(got) > 100
    assert similar.candidates(found, refs, 90.0).count() < len(l) * len(r) / 4


def test_families_misspelt_and_lettered(spark):
    refs = spark.createDataFrame([(1, 1, "ref_1", "Vaswani, A.", 2017), (1, 2, "ref_2", "Vaswani, B.", 2017), (1, 3, "ref_3", "Wasvani, C.", 2017), (1, 4, "ref_4", "Bengio, Y.", 2015), (2, 5, "ref_5", "Vaswani, A.", 2017)], "paper_id long, ord int, ref_id string, author1 string, year int")
    asked = [("Vaswani", 2017, ""), ("vaswani", 2017, "b"), ("Vaswani", 2017, "z"), ("Vaswanis", 2017, "b"), ("Bengios", 2015, ""), ("Bengios", 2014, ""), ("Bungo", 2015, "")]
    parts = spark.createDataFrame([(1, k, *a) for k, a in enumerate(asked)], "paper_id long, k int, family string, year int, letter string")
    got = [(r["ref_id"], r["found"]) for r in similar.linked_families(parts, refs).orderBy("k").collect()]
    assert got == [("ref_1", "exact"), ("ref_2", "exact"), ("ref_1", "exact"), ("ref_2", "near"), ("ref_4", "near"), (None, None), (None, None)]


def test_known_works_by_each_reason(spark):
    title = "A long enough title of a known work"
    found = spark.createDataFrame([(1, 1, "10.1/X", "", None, "q"), (1, 2, None, "http://a/abs/2101.00001v3", None, "w"), (1, 3, None, None, "arXiv 2101.00001", "e"), (1, 4, None, "", None, "A long-enough title of a known works"), (1, 5, None, "", None, "The paper's very own name"), (1, 6, None, "", None, "New"), (2, 7, "10.1/x", "", None, title)], "paper_id long, seq long, doi string, url string, note string, title string")
    refs = spark.createDataFrame([(1, "10.1/x", None, "Something"), (1, None, "2101.00001", None), (1, None, None, title)], "paper_id long, doi string, arxiv string, title string")
    papers = spark.createDataFrame([(1, "The papers very own name")], "paper_id long, title string")
    assert {r["seq"]: r["reason"] for r in similar.known_works(found, refs, papers).collect()} == {1: "doi", 2: "arxiv", 3: "arxiv", 4: "title", 5: "self"}


def test_located_sentence_is_the_first_of_the_best(spark):
    sections = spark.createDataFrame([(1, "s", "Deep nets learn well [[citep:ref_1]]. Deep nets learn well. Other things do not.")], "paper_id long, section_id string, content string")
    claims = spark.createDataFrame([(1, "s", 0, "Deep nets learn well!"), (1, "s", 1, "Deep nets lern well"), (1, "s", 2, "No such words here"), (1, "s", 3, ""), (1, "t", 4, "Deep nets learn well")], "paper_id long, section_id string, claim_no int, sentence string")
    assert [r["sentence_no"] for r in similar.located(sections, claims).orderBy("claim_no").collect()] == [0, 0, None, None, None]


def test_families_are_not_broadcast(spark):
    """All papers' families would go through the driver: on disk they are small, in memory they aren't."""
    parts = spark.createDataFrame([(1, 0, "Smiths", 2020, "")], "paper_id int, k int, family string, year int, letter string")
    refs = spark.createDataFrame([(1, 1, "ref_1", "Smithy, J.", 2020)], "paper_id int, ord int, ref_id string, author1 string, year int")
    out = similar.linked_families(parts, refs)
    assert "Broadcast" not in out._jdf.queryExecution().executedPlan().toString()
    assert [(r["ref_id"], r["found"]) for r in out.select("ref_id", "found").collect()] == [(None, None)]
