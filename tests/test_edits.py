"""Stacked operations, chosen sources and cited findings against plain Python."""

from __future__ import annotations

import os
import random
from collections import defaultdict

import regex

from quire.fixtures import view
from quire.functions import text as T
from quire.functions.similarity import indel_ratio
from quire.operators import edits

SF = "/root/testdata/sf0.001"
END = regex.compile(rf"(?:(?<!\b(?:{T.ABBREVIATIONS}))(?<!\b[A-Z])\.|[!?])(\s+)(?=[A-Z\[\(\d“\"'])")
TOKEN = regex.compile(r"\[\[cite[pt]:([A-Za-z0-9_,\- ]+?)\]\]")


def pieces(text):
    out, at = [], 0
    for m in END.finditer(text):
        out.append(text[at : m.end()])
        at = m.end()
    return [*out, text[at:]]


def plain(s):
    return regex.sub("[^a-z0-9]+", " ", TOKEN.sub("", s).lower()).strip()


def ids(s):
    return sorted(x.strip() for m in TOKEN.finditer(s) for x in m[1].split(","))


def locate(text, sentence):
    best, at = 0.0, None
    for i, p in enumerate(pieces(text)):
        r = indel_ratio(plain(p), plain(sentence)) if plain(p) and plain(sentence) else 0.0
        if r > best:
            best, at = r, i
    return at if best >= 75 else None


def insert(text, at, token):
    ps = pieces(text)
    body = ps[at].rstrip()
    tail = ps[at][len(body) :]
    ps[at] = f"{body[:-1].rstrip()} {token}{body[-1]}{tail}" if body[-1:] in ".!?" else f"{body} {token}{tail}"
    return "".join(ps)


def run_by_hand(ops, sections, refs, claims, offers):
    changes, new = [], []
    by = defaultdict(list)
    for o in ops:
        by[o["proposal_id"]].append(o)
    for pid, own in by.items():
        paper = own[0]["paper_id"]
        number = max([int(r[4:]) for p, r in refs if p == paper], default=0) + 1
        work, titles = {}, []
        for o in sorted(own, key=lambda o: o["op_no"]):
            base = sections.get((paper, o["section_id"]))
            if base is None:
                continue
            text = work.get(o["section_id"], base)
            if o["op"] == "rewrite_section":
                if o["text"] is not None and ids(o["text"]) == ids(text):
                    text = o["text"].strip()
            else:
                used, n, old = set(), 0, text
                for c in sorted((c for c in claims if c["proposal_id"] == pid and c["op_no"] == o["op_no"]), key=lambda c: c["claim_no"]):
                    q = c["query"].strip()[:150].lower()
                    if n >= o["max_new"] or not q or q in used:
                        continue
                    used.add(q)
                    at = locate(old, c["sentence"])
                    best = [x for x in sorted(offers[pid, o["op_no"], c["claim_no"]], key=lambda x: (-x["score"], x["seq"])) if x["title"].lower() not in titles][:1]
                    if at is None or not best or best[0]["score"] < 0.5:
                        continue
                    titles.append(best[0]["title"].lower())
                    new.append((pid, f"ref_{number}", o["op_no"], c["claim_no"], best[0]["title"]))
                    text = insert(text, at, f"[[citep:ref_{number}]]")
                    number, n = number + 1, n + 1
            work[o["section_id"]] = text
        changes += [(pid, s, t) for s, t in work.items() if t != sections[paper, s]]
    return sorted(changes), sorted(new)


def rows(df):
    return [r.asDict() for r in df.collect()]


def test_stacked_operations_equal_a_run_by_hand(spark):
    v = {n: view(spark, SF, n) for n in ("v_op", "v_section", "v_paper_ref", "v_asked", "v_offer")}
    changes, new = edits.execute(*v.values())
    offers = defaultdict(list)
    for o in rows(v["v_offer"]):
        offers[o["proposal_id"], o["op_no"], o["claim_no"]].append(o)
    sections = {(r["paper_id"], r["section_id"]): r["content"] for r in rows(v["v_section"])}
    want = run_by_hand(rows(v["v_op"]), sections, {(r["paper_id"], r["ref_id"]) for r in rows(v["v_paper_ref"])}, rows(v["v_asked"]), offers)
    assert sorted((r["proposal_id"], r["section_id"], r["after"]) for r in rows(changes)) == want[0]
    assert sorted((r["proposal_id"], r["ref_id"], r["op_no"], r["claim_no"], r["title"]) for r in rows(new)) == want[1]
    assert len(want[1]) > 50 and len({(p, r) for p, r, *_ in want[1]}) == len(want[1]) and any(k > 0 for _, _, k, _, _ in want[1])


def test_skipped_claims_leave_room_and_a_query_is_tried_once(spark):
    claims = spark.createDataFrame([(1, 2, 0, "a", None), (1, 2, 1, "A ", 0), (1, 2, 2, "b", 1), (1, 2, 3, "c", 2), (1, 2, 4, "d", 3), (1, 2, 5, "e", 4)], "proposal_id long, max_new int, claim_no int, query string, sentence_no int")
    offers = spark.createDataFrame([(1, 1, 0, "T1", 0.9), (1, 2, 0, "low", 0.49), (1, 3, 0, "Old", 0.9), (1, 3, 1, "T2", 0.6), (1, 4, 0, "t2", 0.99), (1, 4, 1, "T3", 0.5), (1, 5, 0, "T4", 0.9)], "proposal_id long, claim_no int, seq long, title string, score double")
    taken = spark.createDataFrame([(1, ["old"])], "proposal_id long, titles array<string>")
    got = [(r["nth"], r["claim_no"], r["title"]) for r in edits.chosen(claims, offers, taken).orderBy("nth").collect()]
    assert got == [(0, 3, "T2"), (1, 4, "T3")]


def test_tokens_stand_before_the_last_mark(spark):
    texts = spark.createDataFrame([(1, "s", "One holds.  Two holds?\nThree goes on  ")], "paper_id long, section_id string, text string")
    adds = spark.createDataFrame([(1, "s", 0, 0, "ref_8"), (1, "s", 2, 1, "ref_9"), (1, "s", 0, 2, "ref_10")], "paper_id long, section_id string, sentence_no int, nth int, ref_id string")
    assert edits.cited(texts, adds).first()["text"] == "One holds [[citep:ref_8]] [[citep:ref_10]].  Two holds?\nThree goes on [[citep:ref_9]]  "


def test_findings_are_refused_for_a_reason(spark):
    sections = spark.createDataFrame([(1, "s", "Nets learn well. So it is.")], "paper_id long, section_id string, content string")
    refs = spark.createDataFrame([(1, "ref_1", "10.1/a", "Known"), (1, "ref_7", None, "Other"), (1, "odd", None, None)], "paper_id long, ref_id string, doi string, title string")
    found = [(1, 1, "s", "Nets learn well!", None, "New"), (2, 1, "s", "Nets learn well", None, None), (3, 1, "t", "Nets learn well", None, "New"), (4, 1, "s", "Nets learn well", "10.1/A", "New"), (5, 1, "s", "Nets learn well", None, " known "), (6, 1, "s", "Gone since", None, "New"), (7, 2, "s", "x", None, "New")]
    f = spark.createDataFrame([(i, p, s, c, "openalex", "u", d, t) for i, p, s, c, d, t in found], "finding_id long, paper_id long, section_id string, claim string, api string, url string, doi string, title string")
    got = {r["finding_id"]: (r["status"], r["ref_id"], r["after"]) for r in edits.cite_findings(f, sections, refs).collect()}
    assert got.pop(1) == ("ok", "ref_8", "Nets learn well [[citep:ref_8]]. So it is.")
    assert {i: x[0] for i, x in got.items()} == {2: "no_source", 3: "no_section", 4: "already_cited", 5: "already_cited", 6: "sentence_changed", 7: "no_section"}


def test_only_new_works_are_candidates(spark):
    cols = "proposal_id long, paper_id long, op_no int, claim_no int, seq long, title string, doi string, score double"
    results = spark.createDataFrame([(1, 1, 0, 0, 1, "A", "10.1/X", 0.9), (1, 1, 0, 0, 2, "B", "10.1/x", 0.8), (1, 1, 0, 0, 3, "C", "", 0.7), (1, 1, 0, 0, 4, "c", None, 0.6), (1, 1, 0, 1, 5, "A", "10.1/X", 0.9), (1, 1, 0, 1, 6, "K", None, 0.9)], cols)
    assert sorted(r["seq"] for r in edits.fresh(results, spark.createDataFrame([(1, 6)], "paper_id long, seq long")).collect()) == [1, 3, 5]


def test_titles_in_capitals_are_cited_already(spark):
    """The capitals of ß are two letters."""
    f = spark.createDataFrame([(1, 1, "sec_1", "Nets learn.", "openalex", "u", None, " STRASSE ")], "finding_id int, paper_id int, section_id string, claim string, api string, url string, doi string, title string")
    sections = spark.createDataFrame([(1, "sec_1", "Nets learn.")], "paper_id int, section_id string, content string")
    refs = spark.createDataFrame([(1, "ref_1", None, "Straße")], "paper_id int, ref_id string, doi string, title string")
    assert edits.cite_findings(f, sections, refs).first()["status"] == "already_cited"


def _moved(spark, run):
    """Bytes that run's shuffles write, nothing being broadcast."""
    dirs = [d.getPath() for d in spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()]
    files = lambda: {os.path.join(at, f) for d in dirs for at, _, names in os.walk(d) for f in names if f.startswith("shuffle_") and f.endswith(".data")}
    usual, before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold"), files()
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = run()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", usual)
    return out, sum(os.path.getsize(f) for f in files() - before)


def _texts(n):
    rng = random.Random(4)
    return [(p, "sec_1", " ".join(f"S{rng.getrandbits(4000):x} ends here." for _ in range(20))) for p in range(n)]


def test_findings_move_texts_once(spark):
    rows = _texts(30)
    size = sum(len(r[2]) for r in rows)
    asked = [(p * 8 + k, p, "sec_1", text.split(". ")[k] + ".", "openalex", "u", None, f"New {k}") for p, _, text in rows for k in range(8)]
    findings = spark.createDataFrame(asked, "finding_id long, paper_id long, section_id string, claim string, api string, url string, doi string, title string").repartition(3)
    sections = spark.createDataFrame(rows, "paper_id long, section_id string, content string").repartition(3)
    refs = spark.createDataFrame([(p, "ref_1", None, "Old") for p in range(30)], "paper_id long, ref_id string, doi string, title string")
    got, moved = _moved(spark, lambda: edits.cite_findings(findings, sections, refs).collect())
    assert len(got) == 240 and {r["status"] for r in got} == {"ok"}
    assert all(r["after"] == r["before"].replace(text + ".", text + " [[citep:ref_2]].") for r in got for text in [r["before"].split(". ")[r["finding_id"] % 8].rstrip(".")])
    assert moved < 6 * size


def test_operations_move_what_they_name(spark):
    """Sections that few operations name: their texts are moved to find them and to hold them against what came out, not once more a round."""
    rows = _texts(30)
    size = sum(len(r[2]) for r in rows)
    ops = [(p, p, k, "rewrite_section", "sec_1", 1, text + " More." if k == 0 and p == 3 else None) for p, _, text in rows for k in range(4)]
    ops = spark.createDataFrame(ops, "proposal_id long, paper_id long, op_no int, op string, section_id string, max_new int, text string").repartition(3)
    sections = spark.createDataFrame(rows, "paper_id long, section_id string, content string").repartition(3)
    refs = spark.createDataFrame([], "paper_id long, ref_id string")
    claims = spark.createDataFrame([], "proposal_id long, op_no int, claim_no int, sentence string, query string")
    offers = spark.createDataFrame([], "proposal_id long, op_no int, claim_no int, seq long, title string, score double")
    (got, new), moved = _moved(spark, lambda: tuple(df.collect() for df in edits.execute(ops, sections, refs, claims, offers)))
    assert [(r["proposal_id"], r["after"] == rows[3][2] + " More.") for r in got] == [(3, True)] and new == []
    assert moved < 4 * size
