"""Markers of all families as tokens, against a plain pass over each paper."""

from __future__ import annotations

import re
import time
from collections import Counter, defaultdict

import pytest
import regex

from quire.fixtures import view
from quire.functions.similarity import indel_ratio
from quire.operators import intext

REFS = [(1, "ref_1", "1", "Smith, J.", 2020), (2, "ref_2", "2", "Doe, A.", 2021), (3, "ref_3", "3", "Chen, L.", 2019), (4, "ref_4", "4", "Chen, L.", 2019), (5, "ref_5", "5", "Müller, H.", 2020), (6, "ref_6", "6", "Öztürk, Ü.", 2018)]


@pytest.fixture(scope="module")
def run(spark):
    def of(*texts, refs=REFS):
        papers = spark.createDataFrame([(p, "sec_1", t) for p, t in enumerate(texts)], "paper_id int, section_id string, content string")
        every = spark.createDataFrame([(p, *r) for p in range(len(texts)) for r in refs], "paper_id int, ord int, ref_id string, label string, author1 string, year int")
        s, u, f = intext.tokenised(papers, every)
        text = {r["paper_id"]: r["content"] for r in s.collect()}
        lost: dict = {p: [] for p in text}
        for r in u.collect():
            lost[r["paper_id"]].append((r["raw"], r["reason"]))
        return [(text[r["paper_id"]], sorted(lost[r["paper_id"]]), r["style"], r["confidence"], r["note"]) for r in f.orderBy("paper_id").collect()]

    return of


def test_families(run):
    got = run(
        "Prior work [1] and later studies [2, 3-5] agree, unlike [42] and [5-1]. ⟨sup:1⟩",
        "It grew (Smith, 2020; see Doe et al., 2021). Smith (2020) proposed; Chen (2019b) and Chen (2019z) did too. [Doe 2021] (Nobody, 1999) (in 2020)",
        "Nets⟨sup:1⟩ and sets⟨sup:2,3⟩ and maps⟨sup:4⟩, lost⟨sup:99⟩.",
        "One⟨sup:1⟩ only.",
        "Work (1) and (2) and more (3, 4), not (77).",
        "Substituting (1) into (2).",
        "Works [1], [2] and equations (1), (2), (3).",
        "(Müller, 2020) and Öztürk (2018) and (Mullers 2020) and Öztürkk (2018).",
        "Nothing here.",
        "Mixed [1] and (Smith, 2020).",
    )
    assert got[0] == ("Prior work [[citep:ref_1]] and later studies [[citep:ref_2,ref_3,ref_4,ref_5]] agree, unlike [42] and [5-1]. ", [("[42]", "no reference numbered 42")], "numeric_bracket", 0.67, None)
    assert got[1][0] == "It grew [[citep:ref_1,ref_2]]. Smith [[citet:ref_1]] proposed; Chen [[citet:ref_4]] and Chen [[citet:ref_3]] did too. [[citep:ref_2]] (Nobody, 1999) (in 2020)"
    assert got[1][1:4] == ([("(Nobody, 1999)", "no reference has this author and year")], "author_year", 1.0)
    assert got[2][:3] == ("Nets[[citep:ref_1]] and sets[[citep:ref_2,ref_3]] and maps[[citep:ref_4]], lost.", [("⟨sup:99⟩", "no reference numbered 99")], "numeric_superscript")
    assert got[3][0] == "One only." and got[3][2] == "numeric_superscript"
    assert got[4][:3] == ("Work [[citep:ref_1]] and [[citep:ref_2]] and more [[citep:ref_3,ref_4]], not (77).", [], "numeric_paren")
    assert got[5][0] == "Substituting (1) into (2)." and got[5][2:] == ("unknown", 0.0, "too few numbers in parentheses to be citations rather than equations")
    assert got[6][0] == "Works [[citep:ref_1]], [[citep:ref_2]] and equations (1), (2), (3)." and got[6][2] == "unknown"
    assert got[7][0] == "[[citep:ref_5]] and Öztürk [[citet:ref_6]] and (Mullers 2020) and Öztürkk [[citet:ref_6]]."
    assert got[8] == ("Nothing here.", [], "unknown", 0.0, "no marker could be linked to a reference")
    assert got[9][0] == "Mixed [[citep:ref_1]] and (Smith, 2020)." and got[9][2:4] == ("numeric_bracket", 0.5)


def test_contexts(spark):
    s = spark.createDataFrame([(1, "s", "First one [[citep:ref_1]]. Second [[citet:ref_2]] and [[citep:ref_3,ref_1]]! Last")], "paper_id int, section_id string, content string")
    assert [(r["nth"], r["ref_ids"], r["context"]) for r in intext.contexts(s).orderBy("nth").collect()] == [(0, ["ref_1"], "First one [[citep:ref_1]]."), (1, ["ref_2"], "Second [[citet:ref_2]] and [[citep:ref_3,ref_1]]!"), (2, ["ref_3", "ref_1"], "Second [[citet:ref_2]] and [[citep:ref_3,ref_1]]!")]


def test_contexts_of_long_texts(spark):
    """The text is cut once: places counted anew for each sentence and token took minutes here."""
    text = " ".join(f"Sentence {i} of this long text says so." if i % 50 else f"Number {i} cites [[citep:ref_{i}]] and goes on." for i in range(3000))
    begun = time.time()
    got = intext.contexts(spark.createDataFrame([(1, "sec_1", text)], "paper_id long, section_id string, content string")).orderBy("nth").collect()
    assert [(r["nth"], r["ref_ids"], r["context"]) for r in got] == [(k, [f"ref_{50 * k}"], f"Number {50 * k} cites [[citep:ref_{50 * k}]] and goes on.") for k in range(60)]
    assert time.time() - begun < 20


# ---- whole tables against one pass a paper -----------------------------------------------------------

WORD = r"[A-Z\u00C0-\u04FF&&\p{Lu}][\p{L}\p{M}\p{N}_'’\-]*"
NUM = r"\d{1,3}(?:\s*[,;–\-]\s*\d{1,3})*"


def rx(pattern):
    return regex.compile(pattern, regex.V1)


SHAPES = {"numeric": rx(rf"\[({NUM})\]"), "superscript": rx(r"⟨sup:([\d,\s\-–]+)⟩"), "paren_numeric": rx(rf"\(({NUM})\)")}
NARRATIVE = rx(rf"(?<![\p{{L}}\p{{N}}_])({WORD})(?:\s+(?:and|&)\s+{WORD}|\s+et\s+al\.?)?\s*\((\d{{4}})([a-z])?\)")
PART = rx(rf"({WORD})(?:\s+(?:and|&)\s+{WORD}|\s+et\s+al\.?|,)?[\s,]*((?:19|20)\d{{2}})([a-z])?")
GROUPS = [rx(r"\(([^()]{2,300}?)\)"), rx(r"\[([^\[\]]{2,300}?)\]")]


class Paper:
    def __init__(self, refs):
        self.labels = {r["label"]: r["ref_id"] for r in sorted(refs, key=lambda r: r["ord"]) if r["label"]}
        self.by = defaultdict(list)
        for r in sorted(refs, key=lambda r: r["ord"]):
            self.by[r["author1"].split(",")[0].strip().lower(), r["year"]].append(r["ref_id"])

    def numbers(self, inner):
        out = []
        for part in filter(None, (p.strip() for p in re.split("[,;]", inner))):
            if m := re.fullmatch(r"(\d+)\s*[–-]\s*(\d+)", part):
                a, b = map(int, m.groups())
                if not a <= b <= a + 40:
                    return None
                out += range(a, b + 1)
            elif part.isdigit():
                out.append(int(part))
            else:
                return None
        ids = [self.labels.get(str(n)) for n in out]
        return ids if ids and all(ids) else None

    def named(self, family, year, letter):
        family = family.lower()
        hits = self.by.get((family, int(year)))
        if not hits:
            near = [(indel_ratio(f, family), -i, refs) for i, ((f, y), refs) in enumerate(self.by.items()) if y == int(year)]
            best = max(near, default=(0,))
            hits = best[2] if best[0] > 88 else None
        i = ord(letter) - 97 if letter else 0
        return hits and (hits[i] if i < len(hits) else hits[0])

    def group(self, inner):
        if not re.search(r"\b(19|20)\d{2}[a-z]?\b", inner):
            return None
        ids = []
        for part in filter(None, (p.strip() for p in inner.split(";"))):
            m = PART.search(re.sub(intext.PREFIX, "", part))
            ids.append(m and self.named(*m.groups()))
        return ids if ids and all(ids) else None

    def count(self, text):
        n = Counter()
        for f, p in SHAPES.items():
            n[f] += sum(bool(self.numbers(m[1])) for m in p.finditer(text))
        n["author_year"] += sum(bool(self.named(*m.groups())) for m in NARRATIVE.finditer(text)) + sum(bool(self.group(m[1])) for k, p in enumerate(GROUPS) for m in p.finditer(text) if not k or re.search(r"[^\W\d_]", m[1]))
        return n

    def tokens(self, text):
        n = self.count(text)
        lead = max(["numeric", "superscript", "author_year", "paren_numeric"], key=lambda f: n[f])
        enough = n[lead] >= 3 and not n["numeric"]
        style = "unknown" if not n[lead] or (lead == "paren_numeric" and not enough) or (lead == "superscript" and n[lead] < 3) else lead

        def number(m):
            ids = self.numbers(m[1])
            return f"[[citep:{','.join(ids)}]]" if ids else "" if "sup:" in m[0] else m[0]

        for f in ("numeric", "superscript", "paren_numeric"):
            if style == f or (style == "unknown" and f == "numeric"):
                text = SHAPES[f].sub(number, text)
        text = SHAPES["superscript"].sub("", text)
        if style in ("author_year", "unknown"):
            text = NARRATIVE.sub(lambda m: f"{m[0][: m[0].rindex('(')].rstrip()} [[citet:{r}]]" if (r := self.named(*m.groups())) else m[0], text)
            for k, p in enumerate(GROUPS):
                text = p.sub(lambda m, k=k: f"[[citep:{','.join(ids)}]]" if (not k or re.search(r"[^\W\d_]", m[1])) and (ids := self.group(m[1])) else m[0], text)
        return text


def test_whole_tables_equal_a_pass_over_each_paper(spark):
    sf = "/root/testdata/sf0.001"
    sections, refs = view(spark, sf, "v_section"), view(spark, sf, "v_paper_ref")
    by = defaultdict(list)
    for r in refs.collect():
        by[r["paper_id"]].append(r)
    want = {r["paper_id"]: Paper(by[r["paper_id"]]).tokens(r["content"]) for r in sections.collect()}
    got, lost, styles = intext.tokenised(sections, refs)
    assert {r["paper_id"]: r["content"] for r in got.collect()} == want
    assert len({s["style"] for s in styles.collect()}) >= 4 and lost.count() > 10 and sum("[[cite" in t for t in want.values()) > 100


def test_sections_move_once(spark):
    """All shapes are looked up and replaced beside the paper's bibliography: joins for each of them ran 123 jobs here."""
    sections = spark.createDataFrame([(p, "sec_1", "Prior [1, 9], Smith (2020) and (Smyth, 2020; Nobody 1999)." if p % 2 else "Only (Smiths, 2020).") for p in range(40)], "paper_id int, section_id string, content string")
    refs = spark.createDataFrame([(p, *r) for p in range(40) for r in REFS], "paper_id int, ord int, ref_id string, label string, author1 string, year int")
    spark.sparkContext.setJobGroup("moved-once", "")
    done, lost, styles = (d.collect() for d in intext.tokenised(sections, refs))
    jobs = spark.sparkContext.statusTracker().getJobIdsForGroup("moved-once")
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert len(done) == len(styles) == 40 and {r["content"] for r in done} == {"Prior [1, 9], Smith [[citet:ref_1]] and (Smyth, 2020; Nobody 1999).", "Only [[citep:ref_1]]."}
    assert {(r["raw"], r["reason"]) for r in lost} == {("(Smyth, 2020; Nobody 1999)", "no reference has this author and year")}
    assert 0 < len(jobs) <= 16
