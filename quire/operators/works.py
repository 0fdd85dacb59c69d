"""References and external records: what is parsed, where to find it, how it resolves, and how one becomes the other."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType
from pyspark.sql.window import Window

from ..functions import text as T
from ..sources.kept import kept
from . import references as R
from . import similar, styles

#: From which confidence an entry counts as parsed, how similar titles resolve or stay ambiguous, and the order of services.
PARSED, RESOLVED, AMBIGUOUS = 0.5, 92.0, 75.0
APIS = ["openalex", "semantic_scholar"]
#: Words that make no search phrase, and the bounds of phrases, of a title's words and of queries.
PHRASE_STOP = "a an the of and or to in for with on by is are was were be been this that these those we our us it its as from at which who whose can could may might using use used new novel approach method paper propose proposed present show shows result results state art".split()
SECTION_CHARS, TOP_PHRASES, PHRASES, TITLE_WORDS, QUERY_CHARS = 4000, 6, 2, 6, 120
#: Letters that fonts join, quotes and spaces that fonts vary.
LIGATURES = {"ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl", "’": "'", "‘": "'", "“": '"', "”": '"', "\u00a0": " "}


def is_parsed(refs: DataFrame) -> DataFrame:
    """paper_id, ref_id, parsed, renderable: parsed needs confidence and a title or authors; rendered is what has a title and is parsed, resolved or not from the PDF."""
    sure = F.col("confidence") >= PARSED
    named = (F.coalesce("title", F.lit("")) != "") | (F.size("authors") > 0)
    shown = (F.coalesce("csl_title", F.lit("")) != "") & (sure | (F.col("status") == "resolved") | (F.col("added_by") != "pdf_parse"))
    return refs.select("paper_id", "ref_id", (sure & named).alias("parsed"), shown.alias("renderable"))


def best_url(refs: DataFrame) -> DataFrame:
    """Where a work is: its record's address, its DOI (the record's first), arXiv, the address printed, that of its record's data."""
    full = lambda c: F.nullif(F.col(c), F.lit(""))
    url = F.coalesce(full("source_url"), F.concat(F.lit("https://doi.org/"), F.coalesce(full("res_doi"), full("doi"), full("csl_doi"))), F.concat(F.lit("https://arxiv.org/abs/"), full("arxiv")), full("url"), full("csl_url"))
    return refs.select("paper_id", "ref_id", url.alias("url"))


def display_names(refs: DataFrame) -> DataFrame:
    """``Family et al., Year``; a single author without "et al."; without authors the title."""
    year = F.when(F.col("year").isNotNull(), F.concat(F.lit(", "), F.col("year").cast("string"))).otherwise("")
    name = F.concat(T.family_name(F.get("authors", F.lit(0))), F.when(F.size("authors") > 1, " et al.").otherwise(""), year)
    return refs.select("paper_id", "ref_id", F.when(F.size("authors") > 0, name).otherwise(F.substring(F.coalesce("csl_title", "ref_id"), 1, 60)).alias("display_name"))


def filtered(refs: DataFrame, which: str = "all") -> DataFrame:
    """References as a list shows them: all, unparsed or unresolved."""
    return {"all": refs, "unparsed": refs.where(F.col("confidence") < PARSED), "unresolved": refs.where("status <> 'resolved'")}[which]


def csl_items(refs: DataFrame) -> DataFrame:
    """paper_id, ref_id, item: the CSL item of parsed fields as JSON, its fields in a fixed order, empty ones left out."""
    names = F.transform("authors", lambda a: F.when(F.contains(a, F.lit(",")), F.struct(T.family_name(a).alias("family"), F.trim(F.regexp_replace(a, "^[^,]*,", "")).alias("given"))).otherwise(F.struct(a.alias("family"), F.lit(None).cast("string").alias("given"))))
    full = lambda c: F.nullif(F.col(c), F.lit(""))
    arxiv = full("arxiv")
    note = F.concat_ws(" | ", F.concat(F.lit("arXiv:"), arxiv), F.when(full("title").isNull() & full("raw_text").isNotNull(), F.concat(F.lit("unparsed raw: "), F.substring("raw_text", 1, 200))))
    item = F.struct(
        F.col("ref_id").alias("id"), R.csl_type(full("container"), F.lit(""), arxiv).alias("type"), full("title").alias("title"), F.when(F.size("authors") > 0, names).alias("author"),
        F.when(F.col("year").isNotNull(), F.struct(F.array(F.array("year")).alias("date-parts"))).alias("issued"), full("container").alias("container-title"), full("doi").alias("DOI"),
        F.coalesce(full("url"), F.concat(F.lit("https://arxiv.org/abs/"), arxiv)).alias("URL"), full("pages").alias("page"), full("volume").alias("volume"), F.nullif(note, F.lit("")).alias("note"),
    )
    return refs.select("paper_id", "ref_id", F.to_json(item).alias("item"))


def as_references(records: DataFrame) -> DataFrame:
    """External records as references: names with the family first (12 at most), whole confidence, resolved by their record. records: paper_id, ref_id, api, api_id, title, year, authors, venue, doi, url, abstract, reason."""
    turned = F.transform(F.slice("authors", 1, 12), lambda a: F.when(F.contains(a, F.lit(" ")), F.concat(F.substring_index(a, " ", -1), F.lit(", "), F.regexp_replace(a, r" [^ ]*$", ""))).otherwise(a))
    return records.select(
        "paper_id", "ref_id", F.concat(F.lit("[agent-added] "), "title").alias("raw_text"), turned.alias("authors"), "year", "title", F.col("venue").alias("container"), "doi", "url", F.lit(1.0).alias("confidence"),
        F.lit("resolved").alias("status"), F.col("api").alias("source"), "api_id", F.col("url").alias("source_url"), "abstract", F.lit("agent").alias("added_by"), F.col("reason").alias("added_reason"),
    )


def as_sources(refs: DataFrame) -> DataFrame:
    """References as external sources: their record where they have one, else what was parsed with its best address; those without an address are none."""
    held = (F.coalesce("source", F.lit("")) != "") & (F.coalesce("source_url", F.lit("")) != "")
    rows = refs.join(best_url(refs).withColumnRenamed("url", "_best"), ["paper_id", "ref_id"]).where(held | F.col("_best").isNotNull())
    return rows.select(
        "paper_id", "ref_id", F.when(held, F.col("source")).otherwise("parsed").alias("api"), F.coalesce("csl_title", "title", F.lit("(unknown)")).alias("title"), "year",
        F.slice("authors", 1, 10).alias("authors"), F.when(held, F.col("res_doi")).otherwise(F.col("doi")).alias("doi"), F.when(held, F.col("source_url")).otherwise(F.col("_best")).alias("url"),
    )


def resolved(refs: DataFrame, records: DataFrame) -> DataFrame:
    """paper_id, ref_id, status, method, seq, score: what each reference resolves to among the records that services gave for its paper.

    By DOI, then by arXiv id, then by the title: the best of the first service if it is RESOLVED, else the best of
    both. From AMBIGUOUS on a title is ambiguous, below it is unresolved; a reference without any of the
    three can't be looked up. Of equal records the earlier service's, then the first, counts.
    """
    rank = F.coalesce(*(F.when(F.col("api") == a, F.lit(i)) for i, a in enumerate(APIS)), F.lit(len(APIS)))
    # Both are written before anything is filtered: a filter on a title or DOI would be moved between the joins that references come from, and tried there on every pair of their rows.
    recs = kept(records.select("paper_id", rank.alias("_api"), "seq", "doi", "arxiv", similar.plain(F.coalesce("title", F.lit(""))).alias("r")), "records")
    first = lambda c, name: recs.where(F.coalesce(c, F.lit("")) != "").groupBy("paper_id", F.lower(c).alias("_k")).agg(F.min_by("seq", F.struct("_api", "seq")).alias(name))
    rows = kept(refs.select("paper_id", "ref_id", "doi", "arxiv", F.lower("doi").alias("_d"), F.lower("arxiv").alias("_x"), similar.plain(F.coalesce("title", F.lit(""))).alias("s")), "references")
    rows = rows.join(first("doi", "by_doi").withColumnRenamed("_k", "_d"), ["paper_id", "_d"], "left").join(first("arxiv", "by_arxiv").withColumnRenamed("_k", "_x"), ["paper_id", "_x"], "left")
    titled = recs.select("paper_id", "_api", "seq", "r")
    open_ = rows.where("by_doi is null and by_arxiv is null").select("paper_id", "s")
    near = similar.repeated(open_, titled.select("paper_id", F.col("r").alias("s")), AMBIGUOUS, ["paper_id"]).join(titled, ["paper_id", "r"])
    order = F.struct(F.when((F.col("_api") == 0) & (F.col("ratio") >= RESOLVED), 0).otherwise(1), -F.col("ratio"), "_api", "seq")
    best = near.groupBy("paper_id", F.col("l").alias("s")).agg(F.min_by(F.struct("seq", "ratio"), order).alias("b"))
    rows = rows.join(best, ["paper_id", "s"], "left")
    full = lambda c: F.coalesce(c, F.lit("")) != ""
    method = F.when(F.col("by_doi").isNotNull(), "doi").when(F.col("by_arxiv").isNotNull(), "arxiv").when(F.col("b").isNotNull(), "title").when(full("doi") | full("arxiv") | (F.col("s") != ""), "none").otherwise("no usable fields")
    status = F.when(method.isin("doi", "arxiv"), "resolved").when(F.col("b.ratio") >= RESOLVED, "resolved").when(F.col("b").isNotNull(), "ambiguous").otherwise("unresolved")
    return rows.select("paper_id", "ref_id", status.alias("status"), method.alias("method"), F.coalesce("by_doi", "by_arxiv", "b.seq").alias("seq"), F.when(method.isin("doi", "arxiv"), 1.0).otherwise(F.round(F.col("b.ratio") / 100, 6)).alias("score"))


def resolution_counts(found: DataFrame) -> DataFrame:
    """Per paper how many references are resolved, ambiguous and neither."""
    return found.groupBy("paper_id").agg(F.count_if(F.col("status") == "resolved").alias("n_resolved"), F.count_if(F.col("status") == "ambiguous").alias("n_ambiguous"), F.count_if(F.col("status") == "unresolved").alias("n_unresolved"))


def uncited(refs: DataFrame, sections: DataFrame) -> DataFrame:
    """References that no token of the paper names."""
    cited = styles.tokens(sections).select("paper_id", F.explode("ids").alias("ref_id"))
    return refs.join(cited, ["paper_id", "ref_id"], "left_anti").select("paper_id", "ref_id")


def resolve_order(refs: DataFrame, sections: DataFrame) -> DataFrame:
    """The order in which references are looked up: cited ones first, then by id as text."""
    cited = styles.tokens(sections).select("paper_id", F.explode("ids").alias("ref_id")).distinct().withColumn("_c", F.lit(True))
    rows = refs.where("status = 'not_attempted'").select("paper_id", "ref_id").join(cited, ["paper_id", "ref_id"], "left")
    return rows.select("paper_id", "ref_id", F.row_number().over(Window.partitionBy("paper_id").orderBy(F.col("_c").isNull(), "ref_id")).alias("place"))


def findings(refs: DataFrame, sections: DataFrame, unlinked: DataFrame) -> DataFrame:
    """What a parse says about itself: paper_id, type, severity, title, detail.

    Entries that weren't parsed, how many markers have no reference, and cited works that were parsed but not found.
    """
    name = F.coalesce("label", "ref_id")
    a = refs.where(F.col("confidence") < PARSED).select("paper_id", F.lit("unparsed_reference").alias("type"), F.lit("medium").alias("severity"), F.concat(F.lit("Reference "), name, F.lit(" could not be parsed")).alias("title"), F.substring("raw_text", 1, 220).alias("detail"))
    b = unlinked.groupBy("paper_id").agg(F.count("*").alias("n")).select("paper_id", F.lit("style_note").alias("type"), F.lit("low").alias("severity"), F.concat(F.col("n").cast("string"), F.lit(" in-text markers could not be linked to a reference")).alias("title"), F.lit("They were left untouched in the text.").alias("detail"))
    cited = styles.tokens(sections).select("paper_id", F.explode("ids").alias("ref_id"))
    lost = refs.where((F.col("confidence") >= PARSED) & F.col("status").isin("unresolved", "failed")).join(cited, ["paper_id", "ref_id"], "left_semi")
    c = lost.select("paper_id", F.lit("unresolved_reference").alias("type"), F.lit("low").alias("severity"), F.concat(F.lit("Could not find “"), F.substring(F.coalesce("title", "raw_text"), 1, 70), F.lit("…”")).alias("title"), F.lit("No confident match.").alias("detail"))
    return a.unionAll(b).unionAll(c)


def search_queries(sections: DataFrame, papers: DataFrame, most: int = 10) -> DataFrame:
    """What to search for in each paper without a model: paper_id, place, section_id, query, claim.

    Of each section of 200 characters or more the most frequent word pairs without stop words that occur
    twice (of the first TOP_PHRASES, at most PHRASES), with the beginning of the paper's title; else the
    section's own title. A paper's first ``most`` queries in the order of its sections count.
    """
    text = F.substring("content", 1, SECTION_CHARS)
    ws = F.transform(F.regexp_extract_all(F.lower(text), F.lit(r"[a-z][a-z\-]{2,}"), F.lit(0)), lambda w: F.when(~w.isin(PHRASE_STOP), w))
    pairs = F.transform("w", lambda a, i: F.struct(F.concat(a, F.lit(" "), F.get("w", i + 1)).alias("p"), i.alias("i")))
    used = sections.where(F.col("kind").isin("body", "abstract") & (F.length("content") >= 200)).select("paper_id", "sec_no", "section_id", "title", ws.alias("w"))
    each = used.select("paper_id", "sec_no", F.explode(F.filter(pairs, lambda x: x["p"].isNotNull())).alias("x"))
    n = each.groupBy("paper_id", "sec_no", "x.p").agg(F.count("*").alias("n"), F.min("x.i").alias("at"))
    n = n.withColumn("k", F.row_number().over(Window.partitionBy("paper_id", "sec_no").orderBy(F.col("n").desc(), "at"))).where((F.col("k") <= TOP_PHRASES) & (F.col("n") >= 2) & (F.col("k") <= PHRASES))
    head = F.array_join(F.slice(F.regexp_extract_all(F.coalesce("t", F.lit("")), F.lit(r"[A-Za-z][A-Za-z\-]+"), F.lit(0)), 1, TITLE_WORDS), " ")
    rows = used.join(papers.select("paper_id", F.col("title").alias("t")), "paper_id").join(n.select("paper_id", "sec_no", "p", "k"), ["paper_id", "sec_no"], "left")
    rows = rows.where(F.col("p").isNotNull() | (F.coalesce("title", F.lit("")) != ""))
    query = F.substring(F.trim(F.concat(F.coalesce("p", "title"), F.lit(" "), head)), 1, QUERY_CHARS)
    claim = F.when(F.col("p").isNotNull(), F.concat(F.lit("Topic of section “"), "title", F.lit("”: "), "p")).otherwise(F.concat(F.lit("Section topic: "), "title"))
    place = F.row_number().over(Window.partitionBy("paper_id").orderBy("sec_no", F.coalesce("k", F.lit(0))))
    return rows.withColumn("place", place).where(F.col("place") <= most).select("paper_id", "place", "section_id", query.alias("query"), claim.alias("claim"))


def tex_tokens(text: Column) -> Column:
    """Tokens as cite commands, keys without white space."""
    parts = F.split(text, R"\[\[cite[pt]:[A-Za-z0-9_,\- ]+?\]\]")
    kinds, ids = (F.regexp_extract_all(text, F.lit(R"\[\[cite([pt]):([A-Za-z0-9_,\- ]+?)\]\]"), F.lit(i)) for i in (1, 2))
    made = F.zip_with(kinds, ids, lambda k, i: F.concat(F.lit("\\cite"), k, F.lit("{"), F.regexp_replace(i, r"\s", ""), F.lit("}")))
    return F.array_join(F.zip_with(parts, made, lambda p, m: F.concat(p, F.coalesce(m, F.lit("")))), "")


def tokens_of_tex(text: Column) -> Column:
    """Cite commands as tokens again."""
    return F.regexp_replace(text, r"\\cite([pt])\{([^}]*)\}", "[[cite$1:$2]]")


def tex_line_kind(line: Column) -> Column:
    """What a line of a LaTeX file is: section, comment, bibitem, cmd or plain."""
    command = r"^\\(documentclass|usepackage|title|author|date|maketitle|begin|end|bibliographystyle|setlength|newcommand)"
    return F.when(line.rlike(r"^\\(?:sub)*section\*?\{(.+?)\}"), "section").when(F.ltrim(line).startswith("%"), "comment").when(line.startswith("\\bibitem"), "bibitem").when(line.rlike(command), "cmd").otherwise("plain")


def sections_of_tex(tex: DataFrame, sections: DataFrame) -> DataFrame:
    """paper_id, line_no, kind, section_id of each line of LaTeX files (paper_id, tex): a heading's section is the first with its title and a text."""
    rows = tex.select("paper_id", F.posexplode(F.split("tex", "\n")).alias("line_no", "line")).withColumn("kind", tex_line_kind(F.col("line")))
    plain = F.replace(F.regexp_replace(F.regexp_extract("line", r"^\\(?:sub)*section\*?\{(.+?)\}", 1), r"\\([&%$#_{}])", "$1"), F.lit("\\textasciitilde{}"), F.lit("~"))
    rows = rows.withColumn("title", F.when(F.col("kind") == "section", plain))
    first = sections.where("content <> ''").groupBy("paper_id", "title").agg(F.min_by("section_id", "sec_no").alias("section_id"))
    return rows.join(first, ["paper_id", "title"], "left").select("paper_id", "line_no", "kind", "section_id")


@F.pandas_udf(StringType())
def _composed(s: pd.Series) -> pd.Series:
    return s.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))


def clean_text(text: Column) -> Column:
    """Text without joined letters, varied quotes and spaces, in composed form; what is ASCII already doesn't leave the JVM."""
    out = text
    for a, b in LIGATURES.items():
        out = F.replace(out, F.lit(a), F.lit(b))
    return F.when(out.rlike(r"^\p{ASCII}*$"), out).otherwise(_composed(out))


def children(rows: DataFrame, by: str) -> DataFrame:
    """Reviews or proposals of each paper, the latest first: rows with place."""
    return rows.withColumn("place", F.row_number().over(Window.partitionBy("paper_id").orderBy(F.col(by).desc(), F.col("seq").desc())))
