"""References and records: resolution against all pairs, and small cases."""

from __future__ import annotations

import random
import re
from collections import Counter

from pyspark.sql import functions as F

from quire.fixtures import view
from quire.functions.similarity import indel_ratio
from quire.operators import similar, works


def plain(s):
    return re.sub("[^a-z0-9]+", " ", (s or "").lower()).strip()


def resolve_by_hand(ref, records):
    rank = {"openalex": 0, "semantic_scholar": 1}
    own = sorted(records, key=lambda r: (rank[r[1]], r[0]))
    for how, k, c in (("doi", 2, 2), ("arxiv", 3, 3)):
        hit = [r for r in own if ref[k] and r[c] and r[c].lower() == ref[k].lower()]
        if hit:
            return "resolved", how, hit[0][0], 1.0
    if not plain(ref[4]):
        return "unresolved", "none" if ref[2] or ref[3] else "no usable fields", None, None
    scored = [(indel_ratio(plain(ref[4]), plain(r[4])), -rank[r[1]], -r[0]) for r in own if plain(r[4])]
    first = max((s for s in scored if s[1] == 0), default=(0, 0, 0))
    best = first if first[0] >= 92 else max(scored, default=(0, 0, 0))
    if best[0] < 75:
        return "unresolved", "none", None, None
    return "resolved" if best[0] >= 92 else "ambiguous", "title", -best[2], round(best[0] / 100, 6)


def test_ladder_equals_all_pairs(spark):
    rng = random.Random(8)
    refs, recs, want = [], [], {}
    for p in range(8):
        titles = ["".join(rng.choice("abcde fgh") for _ in range(rng.randrange(8, 40))) for _ in range(14)]
        own = []
        for i in range(26):
            t = list(rng.choice(titles))
            for _ in range(rng.randrange(5)):
                t[rng.randrange(len(t))] = rng.choice("xyz ")
            own.append((p * 100 + i, rng.choice(["openalex", "semantic_scholar"]), rng.choice([None, None, "10.1/A%d" % (i % 3)]), rng.choice([None, None, "2101.%d" % (i % 3)]), "".join(t)))
        mine = [(p, f"ref_{i}", rng.choice([None, None, None, "10.1/a%d" % (i % 5)]), rng.choice([None, None, None, "2101.%d" % (i % 5)]), t if i % 6 else rng.choice([None, "", "!"])) for i, t in enumerate(titles)]
        refs += mine
        recs += [(p, *r) for r in own]
        want |= {(p, r[1]): resolve_by_hand(r, own) for r in mine}
    got = works.resolved(spark.createDataFrame(refs, "paper_id long, ref_id string, doi string, arxiv string, title string"), spark.createDataFrame(recs, "paper_id long, seq long, api string, doi string, arxiv string, title string"))
    assert {(r["paper_id"], r["ref_id"]): (r["status"], r["method"], r["seq"], r["score"]) for r in got.collect()} == want
    assert len(Counter(w[0] for w in want.values())) == 3 and {w[1] for w in want.values()} == {"doi", "arxiv", "title", "none", "no usable fields"}
    totals = works.resolution_counts(got).agg(F.sum("n_resolved"), F.sum("n_ambiguous"), F.sum("n_unresolved")).first()
    assert tuple(totals) == tuple(sum(w[0] == s for w in want.values()) for s in ("resolved", "ambiguous", "unresolved"))


def test_repeated_texts_are_compared_once(spark):
    """Titles that many papers share give the same rows as each paper's own pairs, whichever are fewer."""
    rng = random.Random(5)
    titles = [("a title of a work " + "".join(rng.choice("abcdef ") for _ in range(12))).strip() for _ in range(12)]
    left = [(p, rng.choice(titles)) for p in range(60) for _ in range(6)] + [(p, "") for p in range(3)]
    right = [(p, rng.choice(titles)[: rng.randrange(14, 30)]) for p in range(60) for _ in range(6)]
    for n in (60, 1):
        x, y = (spark.createDataFrame([r for r in rows if r[0] < n], "paper_id long, s string") for rows in (left, right))
        rows = lambda df: sorted(map(tuple, df.select("paper_id", "l", "r", "ratio").collect()))
        assert rows(similar.repeated(x, y, 75.0, ["paper_id"])) == rows(similar.pairs(x, y, 75.0, ["paper_id"], small_blocks=True)) != []


def test_resolution_filters_after_the_joins(spark):
    """No condition on a title or DOI is tried on the pairs of rows that references are joined from."""
    refs, records = (view(spark, "/root/testdata/sf0.001", v) for v in ("v_cite_ref", "v_record"))
    plan = works.resolved(refs, records)._jdf.queryExecution().executedPlan().toString()
    assert "item_id" not in plan and "NestedLoopJoin" not in plan


def test_clean_text(spark):
    df = spark.createDataFrame([("ﬁne ﬄow “so” ’t is",), ("plain",), ("Ａ²é",), (None,)], "t string")
    assert [r[0] for r in df.select(works.clean_text(F.col("t"))).collect()] == ['fine fflow "so" \'t is', "plain", "A2é", None]


def test_tex_and_back(spark):
    df = spark.createDataFrame([("See [[citep:ref_1, ref_2]] by [[citet:ref_3]].",)], "t string").withColumn("x", works.tex_tokens(F.col("t")))
    assert df.first()["x"] == "See \\citep{ref_1,ref_2} by \\citet{ref_3}."
    assert df.select(works.tokens_of_tex(F.col("x"))).first()[0] == "See [[citep:ref_1,ref_2]] by [[citet:ref_3]]."
    kinds = ["\\section*{A \\& B}", "  % note", "\\bibitem{x} y", "\\begin{document}", "prose"]
    tex = spark.createDataFrame([(1, "\n".join(kinds))], "paper_id int, tex string")
    sections = spark.createDataFrame([(1, 0, "sec_1", "A & B", ""), (1, 1, "sec_2", "A & B", "text")], "paper_id int, sec_no int, section_id string, title string, content string")
    assert [(r["kind"], r["section_id"]) for r in works.sections_of_tex(tex, sections).orderBy("line_no").collect()] == [("section", "sec_2"), ("comment", None), ("bibitem", None), ("cmd", None), ("plain", None)]
