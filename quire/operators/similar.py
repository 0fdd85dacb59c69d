"""Joins of similar texts under the indel ratio, and the places that use them: misspelt families, titles that are cited already, sentences that have changed."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import citations as C
from ..functions import text as T
from ..functions.similarity import ratio
from ..sources.kept import kept

#: Grams of so many characters.
GRAM = 2
#: Frequencies of grams are broadcast up to so many, and joined by a shuffle beyond.
BROADCAST_GRAMS = 1_000_000
#: Pairs of near texts are broadcast up to so many.
BROADCAST_PAIRS = 100_000
#: How near families, titles, the paper's own title and sentences have to be.
FAMILY, TITLE, OWN_TITLE, SENTENCE = 88.0, 90.0, 93.0, 75.0


def plain(text: Column) -> Column:
    """Small letters and digits A-Z, 0-9 with single spaces between; citation tokens go."""
    return F.trim(F.regexp_replace(F.lower(F.regexp_replace(text, C.TOKEN, "")), "[^a-z0-9]+", " "))


def _grams(s: Column) -> Column:
    """The distinct grams of a text; a shorter text is one gram."""
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(s) - (GRAM - 1), F.lit(1))), lambda i: F.substring(s, i, GRAM)))


def _lost(s: Column, least: float) -> Column:
    """How many of its grams a text can lose on the way to any text at the least ratio.

    A ratio of r or more leaves (1 - r) * (n + m) characters out of both, m is at most n * (2 - r) / r,
    and each of them takes GRAM grams with it.
    """
    r = least / 100.0
    return F.lit(GRAM) * F.floor(F.length(s) * ((1 - r) * 2 / r) + 1e-9)


def _keyed(texts: DataFrame, by: Sequence[str], rank: DataFrame, least: float, broadcast: bool) -> DataFrame:
    """A row for each text and gram of its prefix: its rarest grams, one more than it can lose. Where a text can lose them all, a row without a gram too."""
    each = texts.select(*by, "s", F.explode(_grams(F.col("s"))).alias("g"))
    each = each.join(F.broadcast(rank) if broadcast else rank, "g", "left").groupBy(*by, "s")
    rare = each.agg(F.sort_array(F.collect_list(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "g"))).alias("x"))
    keep = F.transform(F.slice("x", 1, (_lost(F.col("s"), least) + 1).cast("int")), lambda e: e["g"])
    every = F.when(F.size("x") <= _lost(F.col("s"), least), F.concat(keep, F.array(F.lit("")))).otherwise(keep)
    return rare.select(*by, "s", F.explode(every).alias("g"))


def candidates(left: DataFrame, right: DataFrame, least: float, by: Sequence[str] = (), small_blocks: bool = False) -> DataFrame:
    """by, l, r: pairs of distinct texts (column s) that may reach the least ratio; each such pair once.

    Two texts that reach it share a gram of their prefixes, by a corpus-wide order of grams, or can both
    lose all grams; their lengths are near, and they have nearly all grams in common. Equal texts count
    once, so copies make no more pairs. small_blocks: ``by`` leaves so few rows together (families of a
    paper's year, sentences of a section, works of a paper) that all of them meet whose lengths are near.
    """
    by = list(by)
    a, b = (t.select(*by, "s").where("s <> ''") for t in (left, right))
    n, m = F.length("l"), F.length("r")
    if small_blocks:
        # Dealt by their blocks at once, for the copies and for the join, and into as many partitions as shuffles have: by their bytes these few columns would lie
        # in one or two, and so would all pairs. The ratio of a pair costs less than its common grams would.
        parts = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        a, b = (t.repartition(parts, *by).distinct() for t in (a, b))
        return a.withColumnRenamed("s", "l").join(b.withColumnRenamed("s", "r"), by).where(200 * F.least(n, m) >= least * (n + m))
    a, b = a.distinct(), b.distinct()
    lost = GRAM * F.floor((n + m) * (1 - least / 100) + 1e-9)
    rank = b.select(F.explode(_grams(F.col("s"))).alias("g")).groupBy("g").agg(F.count("*").alias("n"))
    small = rank.limit(BROADCAST_GRAMS + 1).count() <= BROADCAST_GRAMS
    x = _keyed(a, by, rank, least, small).withColumnRenamed("s", "l")
    y = _keyed(b, by, rank, least, small).withColumnRenamed("s", "r")
    met = x.join(y, [*by, "g"]).where(200 * F.least(n, m) >= least * (n + m)).select(*by, "l", "r").distinct()
    own, other = _grams(F.col("l")), _grams(F.col("r"))
    return met.where(F.size(F.array_intersect(own, other)) >= F.greatest(F.size(own), F.size(other)) - lost)


def pairs(left: DataFrame, right: DataFrame, least: float, by: Sequence[str] = (), strict: bool = False, small_blocks: bool = False) -> DataFrame:
    """by, l, r, ratio: all pairs of distinct texts of the two sides at the least ratio (strict: above it)."""
    out = candidates(left, right, least, by, small_blocks).withColumn("ratio", ratio("l", "r"))
    return out.where(F.col("ratio") > least if strict else F.col("ratio") >= least)


def repeated(left: DataFrame, right: DataFrame, least: float, by: Sequence[str]) -> DataFrame:
    """pairs() of small blocks whose texts repeat from block to block, as titles of works that many papers cite.

    Where all pairs of distinct texts are fewer than those of the blocks, each is compared once, and the
    blocks look up what is near; else the blocks' own pairs are compared. Both give the same rows.
    """
    by = list(by)
    parts = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    a, b = (kept(t.select(*by, "s").where("s <> ''").repartition(parts, *by).distinct(), "texts") for t in (left, right))
    n = a.groupBy(*by).agg(F.count("*").alias("n")).join(b.groupBy(*by).agg(F.count("*").alias("m")), by)
    own = n.agg(F.coalesce(F.sum(F.col("n") * F.col("m")), F.lit(0))).first()[0]
    x, y = (kept(t.select("s").distinct(), "distinct-texts") for t in (a, b))
    if x.count() * y.count() >= own:
        return pairs(a, b, least, by, small_blocks=True)
    # All pairs of what is left: the rows of one side are dealt over all tasks.
    l, r = x.repartition(parts).withColumnRenamed("s", "l"), y.withColumnRenamed("s", "r")
    met = l.crossJoin(r).where(200 * F.least(F.length("l"), F.length("r")) >= least * (F.length("l") + F.length("r")))
    near = kept(met.withColumn("ratio", ratio("l", "r")).where(F.col("ratio") >= least), "near")
    near = F.broadcast(near) if near.limit(BROADCAST_PAIRS + 1).count() <= BROADCAST_PAIRS else near
    return a.withColumnRenamed("s", "l").join(near, "l").join(b.withColumnRenamed("s", "r"), [*by, "r"]).select(*by, "l", "r", "ratio")


def nearest(left: DataFrame, right: DataFrame, least: float, by: Sequence[str], order: str, strict: bool = False) -> DataFrame:
    """Each text of left with the row of right that is most like it: by, l, r, ratio and ``order``, which breaks ties. ``by`` leaves few rows together.

    Both sides are dealt by their blocks once; copies, pairs and the best of them are found where they lie. Of equal texts of right the first counts.
    """
    by = list(by)
    parts = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    a = left.select(*by, F.col("s").alias("l")).where("l <> ''").repartition(parts, *by).distinct()
    b = right.select(*by, F.col("s").alias("r"), order).where("r <> ''").repartition(parts, *by).groupBy(*by, "r").agg(F.min(order).alias(order))
    n, m = F.length("l"), F.length("r")
    near = a.join(b, by).where(200 * F.least(n, m) >= least * (n + m)).withColumn("ratio", ratio("l", "r"))
    near = near.where(F.col("ratio") > least if strict else F.col("ratio") >= least)
    best = F.row_number().over(Window.partitionBy(*by, "l").orderBy(F.col("ratio").desc(), order))
    return near.withColumn("_k", best).where("_k = 1").drop("_k")


def linked_families(parts: DataFrame, refs: DataFrame) -> DataFrame:
    """parts (paper_id, k, family, year, letter) with ref_id and how it was found: exact, near or null.

    A family that no reference of the year has takes the most similar one of that year, above FAMILY;
    of several references a letter picks the one in its place, else the first.
    """
    own = refs.where("author1 is not null and year is not null").select("paper_id", F.lower(T.family_name(F.col("author1"))).alias("family"), "year", "ord", "ref_id")
    # Both are joined several times. On disk families compress so well that by their size there they would be broadcast, a row for each of all papers' families.
    keyed = kept(own.groupBy("paper_id", "family", "year").agg(F.sort_array(F.collect_list(F.struct("ord", "ref_id"))).alias("x"), F.min("ord").alias("first")), "families").hint("merge")
    rows = kept(parts.withColumn("family", F.lower("family")), "parts")
    missing = rows.join(keyed, ["paper_id", "family", "year"], "left_anti").select("paper_id", "year", F.col("family").alias("s"))
    near = nearest(missing, keyed.select("paper_id", "year", F.col("family").alias("s"), "first"), FAMILY, ["paper_id", "year"], "first", strict=True)
    near = near.select("paper_id", "year", F.col("l").alias("family"), F.col("r").alias("_near"))
    rows = rows.join(near.hint("merge"), ["paper_id", "year", "family"], "left").withColumn("_key", F.coalesce("_near", "family"))
    rows = rows.join(keyed.withColumnRenamed("family", "_key").drop("first"), ["paper_id", "year", "_key"], "left")
    nth = F.when(F.col("letter").rlike("^[a-z]$"), F.ascii("letter") - 96).otherwise(1)
    ref = F.coalesce(F.get("x", nth - 1)["ref_id"], F.get("x", F.lit(0))["ref_id"])
    how = F.when(F.col("x").isNull(), F.lit(None)).when(F.col("_near").isNotNull(), "near").otherwise("exact")
    return rows.withColumns({"ref_id": ref, "found": how}).drop("_near", "_key", "x")


def known_works(found: DataFrame, refs: DataFrame, papers: DataFrame) -> DataFrame:
    """paper_id, seq, reason of search results that the paper cites already, or that are the paper itself.

    found: paper_id, seq, doi, url, note, title; refs: paper_id, doi, arxiv, title; papers: paper_id, title.
    By DOI whatever its case, an arXiv id in the address or note, or a similar title; the first reason counts.
    """
    dois = refs.where("doi is not null").select("paper_id", F.lower("doi").alias("d")).distinct()
    a = found.withColumn("d", F.lower("doi")).join(dois, ["paper_id", "d"], "left_semi").select("paper_id", "seq", F.lit(0).alias("why"))
    place = F.concat(F.coalesce("url", F.lit("")), F.coalesce("note", F.lit("")))
    arxiv = refs.where("arxiv is not null").select("paper_id", "arxiv").distinct()
    b = found.select("paper_id", "seq", place.alias("p")).where("p <> ''").join(arxiv, "paper_id").where(F.contains("p", "arxiv")).select("paper_id", "seq", F.lit(1).alias("why"))
    titled = found.select("paper_id", "seq", plain(F.col("title")).alias("s"))
    out = a.unionAll(b)
    for why, side, least in ((2, refs, TITLE), (3, papers, OWN_TITLE)):
        near = pairs(titled, side.select("paper_id", plain(F.col("title")).alias("s")), least, ["paper_id"], small_blocks=True).select("paper_id", F.col("l").alias("s")).distinct()
        out = out.unionAll(titled.join(near, ["paper_id", "s"], "left_semi").select("paper_id", "seq", F.lit(why).alias("why")))
    reasons = F.array(*(F.lit(x) for x in ("doi", "arxiv", "title", "self")))
    return out.groupBy("paper_id", "seq").agg(F.min("why").alias("why")).select("paper_id", "seq", F.get(reasons, F.col("why")).alias("reason"))


def located(sections: DataFrame, claims: DataFrame, text: str = "content") -> DataFrame:
    """claims (paper_id, section_id, claim_no, sentence) with sentence_no and ratio: the most similar sentence of the section, at SENTENCE or more; the first of equals; null where none is."""
    keys = ["paper_id", "section_id"]
    spans = sections.select(*keys, F.posexplode(T.sentences(F.col(text), paired=True)).alias("sentence_no", "x")).select(*keys, "sentence_no", plain(F.col("x")).alias("s"))
    asked = claims.select(*keys, "claim_no", plain(F.col("sentence")).alias("s"))
    best = nearest(asked, spans, SENTENCE, keys, "sentence_no").select(*keys, F.col("l").alias("s"), "sentence_no", "ratio")
    return asked.join(best, [*keys, "s"], "left").select(*keys, "claim_no", "sentence_no", "ratio")
