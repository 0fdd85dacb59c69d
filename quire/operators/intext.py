"""Citation markers of five families in the text: which family a paper uses, markers as tokens, and what couldn't be linked.

Families: numbers in brackets, raised numbers, numbers in parentheses, and author-year groups in
parentheses or brackets with narrative years. All is a paper's own: labels, families and years.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType
from pyspark.sql.window import Window

from ..functions import citations as C
from ..functions import text as T
from ..functions.similarity import common_lengths
from ..sources.kept import kept
from . import similar

#: A capitalised word of a name; the shapes of markers; words before the names of a group; letters make an author-year group of a bracket.
NAME = r"[A-ZÀ-ӿ&&\p{Lu}][\p{L}\p{M}\p{N}_'’\-]*"
NUMBERS = r"\d{1,3}(?:\s*[,;–\-]\s*\d{1,3})*"
NARRATIVE = rf"(?<![\p{{L}}\p{{N}}_])({NAME})(?:\s+(?:and|&)\s+{NAME}|\s+et\s+al\.?)?\s*\((\d{{4}})([a-z])?\)"
PART = rf"({NAME})(?:\s+(?:and|&)\s+{NAME}|\s+et\s+al\.?|,)?[\s,]*((?:19|20)\d{{2}})([a-z])?"
PREFIX = r"(?i)^(?:see|e\.g\.|i\.e\.|cf\.|see,? e\.g\.,?|also|as in)[\s,]+"
YEARISH = r"\b(?:19|20)\d{2}[a-z]?\b"
PATTERNS = {
    "numeric": rf"\[({NUMBERS})\]",
    "superscript": r"⟨sup:([\d,\s\-–]+)⟩",
    "narrative": NARRATIVE,
    "paren_group": r"\(([^()]{2,300}?)\)",
    "bracket_group": r"\[([^\[\]]{2,300}?)\]",
    "paren_numeric": rf"\(({NUMBERS})\)",
}
#: The style that a family stands for, in the order that decides between equals, and how many markers raised or parenthesised numbers need.
STYLES = {"numeric": "numeric_bracket", "superscript": "numeric_superscript", "author_year": "author_year", "paren_numeric": "numeric_paren"}
EVIDENCE = 3


def _numbers(inside: Column) -> Column:
    """The numbers of a marker; blank parts count for nothing, a bad one voids it."""
    kept = F.array_join(F.filter(F.transform(F.split(inside, "[,;]"), lambda x: F.trim(x)), lambda x: x != ""), ",")
    return F.when(kept != "", C.numbers(kept))


def bibliographies(refs: DataFrame) -> DataFrame:
    """One row a paper, in which its markers are looked up: paper_id, labels (label, ord, ref_id) and families (year, family, ord, ref_id), both in order."""
    own = refs.select("paper_id", "label", F.col("ord").cast("long").alias("ord"), "ref_id", F.lower(T.family_name(F.col("author1"))).alias("family"), F.col("year").cast("int").alias("year"))
    label = F.when(F.col("label").isNotNull(), F.struct("label", "ord", "ref_id"))
    family = F.when(F.col("family").isNotNull() & F.col("year").isNotNull(), F.struct("year", "family", "ord", "ref_id"))
    return own.groupBy("paper_id").agg(F.sort_array(F.collect_list(label)).alias("labels"), F.sort_array(F.collect_list(family)).alias("families"))


def _raw(shape: str, text: str) -> Column:
    return F.regexp_extract_all(text, F.lit(PATTERNS[shape]), F.lit(0))


def numeric_links(shape: str, text: str = "content") -> Column:
    """A shape's markers in the order of the text: raw, ids (null unless every number is a label), missing (numbers without a reference). Rows have ``labels``; the last of equal ones counts."""
    ref = lambda n: F.array_max(F.filter("labels", lambda l: l["label"] == n.cast("string")))["ref_id"]
    each = F.transform(_raw(shape, text), lambda m: F.struct(m.alias("raw"), F.transform(_numbers(F.regexp_extract(m, PATTERNS[shape], 1)), lambda n: F.struct(n.cast("string").alias("n"), ref(n).alias("id"))).alias("x")))

    def link(m: Column) -> Column:
        some = F.size(m["x"]) > 0
        ids = F.when(some & F.forall(m["x"], lambda e: e["id"].isNotNull()), F.transform(m["x"], lambda e: e["id"]))
        missing = F.when(some, F.transform(F.filter(m["x"], lambda e: e["id"].isNull()), lambda e: e["n"]))
        return F.struct(m["raw"].alias("raw"), ids.alias("ids"), missing.alias("missing"))

    return F.transform(each, link)


def _parts(shape: str, text: str) -> Column:
    """A shape's markers: raw, years (whether one is given), yearish (whether it has a name and a year at all), parts (family, year, letter). Bracket groups without letters belong to the numbers and are neither."""
    own, narrative = F.lit(True), shape == "narrative"

    def part(t: Column) -> Column:
        plain, pattern = (t, NARRATIVE) if narrative else (F.regexp_replace(t, PREFIX, ""), PART)
        pick = lambda i: F.regexp_extract(plain, pattern, i)
        return F.struct(F.lower(pick(1)).alias("family"), pick(2).try_cast("int").alias("year"), pick(3).alias("letter"))

    def one(m: Column) -> Column:
        if narrative:
            return F.struct(m.alias("raw"), own.alias("years"), own.alias("yearish"), F.array(part(m)).alias("parts"))
        inside = F.regexp_extract(m, PATTERNS[shape], 1)
        lettered = m.rlike(r"\p{L}") if shape == "bracket_group" else own
        years = inside.rlike(YEARISH) & lettered
        texts = F.filter(F.transform(F.split(inside, ";"), lambda x: F.trim(x)), lambda p: p != "")
        # Without a year nothing in it is looked up.
        return F.struct(m.alias("raw"), years.alias("years"), (years & inside.rlike(NAME)).alias("yearish"), F.when(years, F.transform(texts, part)).otherwise(F.array()).alias("parts"))

    return F.transform(_raw(shape, text), one)


@F.pandas_udf(ArrayType(StringType()))
def _nearest(asked: pd.Series, asked_years: pd.Series, families: pd.Series, years: pd.Series) -> pd.Series:
    """For each family that is asked for the most like one of its year, above similar.FAMILY; the first of equals."""
    rows, a, b, place = list(zip(asked, asked_years, families, years, strict=True)), [], [], []
    for r, (names, of, known, at) in enumerate(rows):
        for i, (name, year) in enumerate(zip(names, of, strict=True)):
            for other, y in zip(known, at, strict=True):
                if y == year:
                    a.append(name)
                    b.append(other)
                    place.append((r, i))
    best: dict[tuple[int, int], tuple[float, str]] = {}
    for x, y, common, at in zip(a, b, common_lengths(a, b).tolist(), place, strict=True):
        ratio = 200.0 * common / (len(x) + len(y))
        if ratio > max(similar.FAMILY, best.get(at, (0.0, ""))[0]):
            best[at] = ratio, y
    return pd.Series([[best[r, i][1] if (r, i) in best else None for i in range(len(x[0]))] for r, x in enumerate(rows)], dtype=object)


def author_year_links(rows: DataFrame, markers: str) -> DataFrame:
    """rows with each of ``markers`` (as _parts gives them) having ids, null unless every part links. Rows have ``families``.

    A family that no reference of the year has takes the most similar one of that year; of several references a letter
    picks the one in its place, else the first. All is looked up in the paper's own row.
    """
    held = lambda p: F.filter("families", lambda f: (f["year"] == p["year"]) & (f["family"] == p["family"]))
    every = F.transform(F.flatten(F.transform(markers, lambda m: m["parts"])), lambda p: F.struct(p["year"].alias("year"), p["family"].alias("family")))
    asked = F.array_distinct(F.filter(every, lambda p: (p["family"] != "") & p["year"].isNotNull() & (F.size(held(p)) == 0)))
    rows = rows.withColumn("_asked", F.coalesce(asked, F.array().cast("array<struct<year:int,family:string>>")))
    n = lambda x: F.length(x["family"])
    like = lambda f: F.exists("_asked", lambda p: (p["year"] == f["year"]) & (200 * F.least(n(p), n(f)) > similar.FAMILY * (n(p) + n(f))))
    some = F.transform(F.filter("families", lambda f: (f["family"] != "") & like(f)), lambda f: F.struct(f["ord"].cast("long").alias("ord"), f["year"].alias("year"), f["family"].alias("family")))
    rows = rows.withColumn("_some", F.when(F.size("_asked") > 0, F.sort_array(some)).otherwise(F.array().cast("array<struct<ord:long,year:int,family:string>>")))
    # Marked as it is so that it keeps a step of its own: no Python runs within a lambda.
    near = _nearest.asNondeterministic()(F.col("_asked.family"), F.col("_asked.year"), F.col("_some.family"), F.col("_some.year"))
    rows = rows.withColumn("_near", near)

    def ref(p: Column) -> Column:
        at = F.array_position("_asked", F.struct(p["year"].alias("year"), p["family"].alias("family")))
        name = F.when(at > 0, F.get("_near", (at - 1).cast("int"))).otherwise(p["family"])
        nth = F.when(p["letter"].rlike("^[a-z]$"), F.ascii(p["letter"]) - 96).otherwise(1)
        return F.transform(F.array(F.filter("families", lambda f: (f["year"] == p["year"]) & (f["family"] == name))), lambda x: F.coalesce(F.get(x, nth - 1), F.get(x, F.lit(0)))["ref_id"])[0]

    found = F.transform(markers, lambda k: k.withField("x", F.transform(k["parts"], lambda p: F.when(p["family"] != "", ref(p)))))
    rows = rows.withColumn("_x", found)
    whole = lambda k: k["years"] & (F.size(k["x"]) > 0) & F.forall(k["x"], lambda i: i.isNotNull())
    links = F.transform("_x", lambda k: F.struct(k["raw"].alias("raw"), F.when(whole(k), k["x"]).alias("ids"), k["yearish"].alias("yearish")))
    return rows.withColumn(markers, links).drop("_asked", "_some", "_near", "_x")


def _linked(links: Column | str) -> Column:
    return F.size(F.filter(links, lambda x: x["ids"].isNotNull()))


def _evidence(sections: DataFrame, refs: DataFrame) -> DataFrame:
    """paper_id, section_id, content, labels, families, n_<family>: each section with its paper's bibliography, and how many of its markers link."""
    texts = sections.select(*(c for c in ("paper_id", "section_id", "content") if c in sections.columns))
    rows = texts.join(bibliographies(refs), "paper_id", "left")
    rows = rows.withColumns({"labels": F.coalesce("labels", F.array().cast("array<struct<label:string,ord:long,ref_id:string>>")), "families": F.coalesce("families", F.array().cast("array<struct<year:int,family:string,ord:long,ref_id:string>>"))})
    rows = author_year_links(rows.withColumn("_m", F.concat(*(_parts(s, "content") for s in ("narrative", "paren_group", "bracket_group")))), "_m")
    by_number = {f"n_{s}": F.coalesce(_linked(numeric_links(s)), F.lit(0)) for s in ("numeric", "superscript", "paren_numeric")}
    return rows.withColumns({**by_number, "n_author_year": F.coalesce(_linked("_m"), F.lit(0))}).drop("_m")


def _decided(rows: DataFrame) -> dict[str, Column]:
    """style, confidence and note of rows with n_<family>."""
    total, most = sum((F.col(f"n_{f}") for f in STYLES), F.lit(0)), F.greatest(*(F.col(f"n_{f}") for f in STYLES))
    lead = F.coalesce(*(F.when((most > 0) & (F.col(f"n_{f}") == most), F.lit(f)) for f in STYLES))
    doubtful = (lead == "paren_numeric") & ~((most >= EVIDENCE) & (F.col("n_numeric") == 0))
    style = F.when(lead.isNull() | doubtful, "unknown").otherwise(F.coalesce(*(F.when(lead == f, F.lit(s)) for f, s in STYLES.items())))
    note = F.when(lead.isNull(), "no marker could be linked to a reference").when(doubtful, "too few numbers in parentheses to be citations rather than equations")
    return {"style": style, "confidence": F.when(style == "unknown", 0.0).otherwise(F.round(most / F.greatest(total, F.lit(1)), 2)), "note": note}


def styles_of(sections: DataFrame, refs: DataFrame) -> DataFrame:
    """paper_id, style, confidence, n_<family>, note of each paper with sections.

    Only markers that link count. The family with most gives the style, with its share as confidence.
    Raised numbers need EVIDENCE markers to be more than footnotes; parenthesised ones too, and no
    bracketed ones beside them, to be more than equations (else the style is unknown, and a note says so).
    """
    rows = _evidence(sections, refs).groupBy("paper_id").agg(*(F.sum(f"n_{f}").alias(f"n_{f}") for f in STYLES))
    # Raised numbers that are too few leave the style named, but nothing is done with them.
    return rows.withColumns(_decided(rows)).select("paper_id", "style", "confidence", *(f"n_{f}" for f in STYLES), "note")


def _pass(rows: DataFrame, shape: str) -> DataFrame:
    """rows after the links in ``_l`` have become tokens in the text (null: the shape isn't done for their paper). Narrative names stay in the text."""

    def new(m: Column) -> Column:
        token = F.concat(F.lit("[[citet:" if shape == "narrative" else "[[citep:"), F.array_join(m["ids"], ","), F.lit("]]"))
        if shape == "narrative":
            token = F.concat(F.rtrim(F.regexp_replace(m["raw"], r"\(\d{4}[a-z]?\)$", "")), F.lit(" "), token)
        return F.coalesce(token, F.lit("") if shape == "superscript" else m["raw"])

    done = F.array_join(F.zip_with(F.split("content", PATTERNS[shape]), F.transform("_l", new), lambda p, t: F.concat(p, F.coalesce(t, F.lit("")))), "")
    return rows.withColumn("content", F.when(F.col("_l").isNotNull(), done).otherwise(F.col("content")))


#: What is done in the text of each style, in order; raised numbers go where they aren't the style's.
DONE = {
    "numeric_bracket": ["numeric"], "numeric_superscript": ["superscript"], "numeric_paren": ["paren_numeric"],
    "author_year": ["narrative", "paren_group", "bracket_group"], "unknown": ["numeric", "narrative", "paren_group", "bracket_group"],
}


def tokenised(sections: DataFrame, refs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(sections with tokens, unlinked markers, styles). A marker becomes a token only if all of it links; else it stays as it is.

    sections: paper_id, section_id, content; refs: paper_id, ord, ref_id, label, author1, year. Each shape works on the
    text that the ones before it left. Raised numbers never stay as marks: where they don't cite, they go.
    Numbers in parentheses that don't link, and groups without a name and a year, are no markers.
    Unlinked: paper_id, section_id, raw, reason.

    A section meets its paper's bibliography once, as one row, and every shape is looked up and replaced there: no marker or text moves again.
    """
    rows = _evidence(sections, refs).where("paper_id is not null")
    of_paper = Window.partitionBy("paper_id")
    rows = rows.withColumns({f"n_{f}": F.sum(f"n_{f}").over(of_paper) for f in STYLES})
    rows = rows.withColumns(_decided(rows))
    few = (F.col("style") == "numeric_superscript") & (F.col("n_superscript") < EVIDENCE)
    doing = F.when(few, F.array(*(F.lit(x) for x in DONE["unknown"])))
    for style, shapes in DONE.items():
        doing = doing.when(F.col("style") == style, F.array(*(F.lit(x) for x in shapes)))
    rows = rows.withColumn("doing", doing)
    lost = []
    for shape in ("numeric", "superscript", "paren_numeric"):
        rows = _pass(rows.withColumn("_l", F.when(F.array_contains("doing", shape), numeric_links(shape))), shape)
        if shape != "paren_numeric":
            gone = F.filter("_l", lambda m: m["ids"].isNull() & m["missing"].isNotNull())
            rows = rows.withColumn(f"_{shape}", F.transform(gone, lambda m: F.struct(m["raw"].alias("raw"), F.concat(F.lit("no reference numbered "), F.array_join(m["missing"], ", ")).alias("reason"))))
            lost.append(f"_{shape}")
    rows = rows.withColumn("content", F.regexp_replace("content", PATTERNS["superscript"], ""))
    for shape in ("narrative", "paren_group", "bracket_group"):
        rows = _pass(author_year_links(rows.withColumn("_l", F.when(F.array_contains("doing", shape), _parts(shape, "content"))), "_l"), shape)
        if shape != "narrative":
            gone = F.filter("_l", lambda m: m["ids"].isNull() & m["yearish"])
            rows = rows.withColumn(f"_{shape}", F.transform(gone, lambda m: F.struct(m["raw"].alias("raw"), F.lit("no reference has this author and year").alias("reason"))))
            lost.append(f"_{shape}")
    none = F.array().cast("array<struct<raw:string,reason:string>>")
    rows = rows.withColumn("unlinked", F.concat(*(F.coalesce(c, none) for c in lost)))
    counts = [f"n_{f}" for f in STYLES]
    rows = kept(rows.select("paper_id", "section_id", "content", "unlinked", "style", "confidence", *counts, "note"), "tokenised")
    out = rows.select("paper_id", "section_id", F.explode("unlinked").alias("u")).select("paper_id", "section_id", "u.raw", "u.reason")
    return rows.select("paper_id", "section_id", "content"), out, rows.select("paper_id", "style", "confidence", *counts, "note").dropDuplicates(["paper_id"])


def contexts(sections: DataFrame) -> DataFrame:
    """paper_id, section_id, nth, ref_ids, context: each token with the sentence that it lies in.

    Sentences end behind a mark, which no token holds, so a token lies in one piece whole and is looked
    for there: the text is cut once, and no place in it is counted again for each piece or token.
    """
    held = F.transform(T.sentence_pieces(F.col("content")), lambda p: F.transform(F.regexp_extract_all(p, F.lit(C.TOKEN), F.lit(0)), lambda m: F.struct(m.alias("raw"), p.alias("p"))))
    rows = sections.where(F.col("content").rlike(C.TOKEN)).select("paper_id", "section_id", F.posexplode(F.flatten(held)).alias("nth", "t"))
    said = F.trim(F.regexp_replace(F.col("t.p"), r"^\s+|\s+$", ""))
    return rows.select("paper_id", "section_id", "nth", C.token_ids(F.col("t.raw")).alias("ref_ids"), said.alias("context"))
