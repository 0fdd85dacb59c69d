"""Review: search results against the bibliography, claims, findings and job logs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import citations as C
from ..functions import text as T

SEVERITIES = ["high", "medium", "low", "info"]
#: Words that name no topic.
STOPWORDS = "the of and to in a is that for on with as by this it are be an or was from at we our".split()
GROUPS = {"act": ["missing_work", "claim_unsupported"], "checked": ["claim_supported", "claim_unverifiable"], "refs": ["unparsed_reference", "unresolved_reference"], "failed": ["search_failure"]}


def candidate_key():
    return F.coalesce(F.lower("doi"), F.concat(F.lit("t:"), F.substring(F.lower("title"), 1, 80)))


def already_cited(sources: DataFrame, refs: DataFrame) -> DataFrame:
    """Search results that the bibliography has, by DOI whatever its case."""
    known = refs.where("doi is not null").select(F.lower("doi").alias("d")).distinct()
    return sources.join(known, F.lower("doi") == F.col("d"), "left_semi")


def new_candidates(sources: DataFrame, refs: DataFrame) -> DataFrame:
    """Results that aren't cited yet, the first of each DOI or title; within each paper where both sides have a paper_id."""
    own = ["paper_id"] if "paper_id" in sources.columns and "paper_id" in refs.columns else []
    known = refs.where("doi is not null").select(*own, F.lower("doi").alias("d")).distinct()
    rest = sources.withColumn("d", F.lower("doi")).join(known, [*own, "d"], "left_anti").withColumn("key", candidate_key())
    return rest.groupBy(*own, "key").agg(F.min("seq").alias("seq"), F.min_by("api_id", "seq").alias("api_id"))


def ranked(claims: DataFrame, sources: DataFrame, per_claim: int = 3, most: int = 8, least: float = 0.4) -> DataFrame:
    """claim_id, seq, score, place of the best sources of each claim, then of all; the score's floor applies last.

    Claims meet the sources that hold one of their words (an equi-join on words), not all of them.
    """
    words = lambda c: F.filter(F.array_distinct(F.split(F.lower(c), r"[^\p{L}\p{N}]+")), lambda w: (F.length(w) >= 3) & ~w.isin(STOPWORDS))
    c = claims.select("claim_id", words(F.col("claim")).alias("ws")).withColumn("n", F.greatest(F.size("ws"), F.lit(3)))
    s = sources.select("seq", "cited_by_count", F.explode(words(F.col("title"))).alias("w"))
    met = c.select("claim_id", "n", F.explode("ws").alias("w")).join(s, "w").groupBy("claim_id", "n", "seq", "cited_by_count").agg(F.count("*").alias("hits"))
    score = F.least(F.lit(1.0), 0.7 * F.col("hits") / F.col("n") + 0.3 * F.log10(F.col("cited_by_count") + 1.0) / 5)
    rows = met.select("claim_id", "seq", F.round(score, 6).alias("score"))
    best = rows.withColumn("k", F.row_number().over(Window.partitionBy("claim_id").orderBy(F.col("score").desc(), "seq"))).where(F.col("k") <= per_claim)
    top = best.orderBy(F.col("score").desc(), "claim_id", "seq").limit(most)
    top = top.withColumn("place", F.row_number().over(Window.orderBy(F.col("score").desc(), "claim_id", "seq")))
    return top.where(F.col("score") >= least).select("claim_id", "seq", "score", "place")


def bigrams(sections: DataFrame, text: str = "content", top: int = 6) -> DataFrame:
    """The most frequent word pairs of each paper without stop words, ties by first occurrence; a pair needs two."""
    ws = F.filter(F.split(F.lower(F.col(text)), r"[^a-z]+"), lambda w: F.length(w) > 0)
    # Stop words are marked once a word and pairs with one go within the array, before anything is exploded.
    marked = F.transform(ws, lambda w: F.when(~w.isin(STOPWORDS), w))
    pairs = F.transform("w", lambda a, i: F.struct(a.alias("a"), F.get("w", i + 1).alias("b"), i.alias("pos")))
    rows = sections.select("paper_id", marked.alias("w")).select("paper_id", F.explode(F.filter(pairs, lambda p: p["a"].isNotNull() & p["b"].isNotNull())).alias("p")).select("paper_id", "p", "p.pos")
    n = rows.groupBy("paper_id", F.concat_ws(" ", "p.a", "p.b").alias("bigram")).agg(F.count("*").alias("n"), F.min("pos").alias("first")).where("n >= 2")
    k = F.row_number().over(Window.partitionBy("paper_id").orderBy(F.col("n").desc(), "first"))
    return n.withColumn("place", k).where(F.col("place") <= top).select("paper_id", "bigram", "n", "place")


def claim_sample(tokens: DataFrame, text: str = "before_text", most: int = 2) -> DataFrame:
    """Citations in covering order: first those that hold a reference unseen so far in the paper, then the others; ``most`` of each paper."""
    cites = tokens.select("paper_id", F.posexplode(F.regexp_extract_all(text, F.lit(C.TOKEN), F.lit(2))).alias("pos", "ids"))
    each = cites.select("paper_id", "pos", F.explode(F.split("ids", ",")).alias("ref_id"))
    first = F.min("pos").over(Window.partitionBy("paper_id", "ref_id")) == F.col("pos")
    by = each.withColumn("new", first).groupBy("paper_id", "pos").agg(F.max("new").alias("covers"))
    k = F.row_number().over(Window.partitionBy("paper_id").orderBy(F.col("covers").desc(), "pos"))
    return by.withColumn("place", k).where(F.col("place") <= most).select("paper_id", "pos", "covers", "place")


def claim_texts(sections: DataFrame, text: str, least: int = 25) -> DataFrame:
    """Sentences without their tokens, of ``least`` characters or more."""
    rows = sections.select("paper_id", F.posexplode(T.sentences(F.col(text), paired=True)).alias("sentence_no", "s"))
    return rows.select("paper_id", "sentence_no", C.without_tokens(F.col("s")).alias("claim")).where(F.length("claim") >= least)


def severity_rank():
    return F.coalesce(*(F.when(F.col("severity") == s, F.lit(i)) for i, s in enumerate(SEVERITIES)), F.lit(9))


def by_severity(findings: DataFrame) -> DataFrame:
    """Findings of each paper in order of severity, then as found."""
    return findings.select("paper_id", "seq", "severity", F.row_number().over(Window.partitionBy("paper_id").orderBy(severity_rank(), "seq")).alias("place"))


def group_counts(findings: DataFrame) -> DataFrame:
    group = F.coalesce(*(F.when(F.col("type").isin(v), F.lit(k)) for k, v in GROUPS.items()), F.lit("other"))
    return findings.groupBy("paper_id", group.alias("group")).agg(F.count("*").alias("n"))


def labels(findings: DataFrame) -> DataFrame:
    """Roll-up by type: how many, the first severity, the first position."""
    return findings.groupBy("paper_id", "type").agg(F.count("*").alias("n"), F.min_by("severity", "seq").alias("severity"), F.min("seq").alias("first_seq"))


def collapsed(findings: DataFrame) -> DataFrame:
    """Failures with the same title become one with a count; all else stays single."""
    key = F.when(F.col("type") == "search_failure", F.concat(F.lit("t:"), F.col("title"))).otherwise(F.concat(F.lit("s:"), F.col("seq").cast("string")))
    return findings.groupBy("paper_id", key.alias("key")).agg(F.count("*").alias("n"), F.min("seq").alias("seq"))


def status_histogram(findings: DataFrame) -> DataFrame:
    return findings.groupBy("type").agg(F.count("*").alias("n"), F.countDistinct("paper_id").alias("n_papers"))


def stage_durations(findings: DataFrame) -> DataFrame:
    """Whole seconds from each event of a paper to the next; the first has none."""
    w = Window.partitionBy("paper_id").orderBy("ts", "seq")
    secs = F.unix_micros(F.col("ts").cast("timestamp"))
    return findings.select("paper_id", "seq", F.floor((secs - F.lag(secs).over(w)) / 1_000_000).alias("elapsed")).where("elapsed is not null")


def warnings_by_stage(findings: DataFrame) -> DataFrame:
    return findings.where("severity = 'low'").groupBy("type").agg(F.count("*").alias("n"), F.min("title").alias("first_title"))


def resolution_counts(sources: DataFrame, refs: DataFrame) -> DataFrame:
    """Per reference the ladder's first hit: DOI, then exact title; else unresolved, with seq -1."""
    d = sources.where("doi is not null").groupBy(F.lower("doi").alias("key")).agg(F.min("seq").alias("by_doi"))
    t = sources.groupBy(F.lower("title").alias("key")).agg(F.min("seq").alias("by_title"))
    out = refs.join(d, F.lower(refs["doi"]) == d["key"], "left").drop("key").join(t, F.lower(refs["title"]) == t["key"], "left")
    how = F.when(F.col("by_doi").isNotNull(), "doi").when(F.col("by_title").isNotNull(), "title").otherwise("unresolved")
    return out.select("ref_id", how.alias("method"), F.coalesce("by_doi", "by_title", F.lit(-1)).alias("seq"))
