"""Proposed edits: operations of a command run one after the other over working copies of sections, citations that findings ask for, and the checks of what came out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import citations as C
from ..functions import text as T
from ..sources.kept import kept
from . import similar

#: Operations of a command, how relevant a new source has to be, and how long a query may get.
MOST_OPERATIONS, RELEVANT, QUERY_CHARS = 4, 0.5, 150


def reference_numbers(refs: DataFrame) -> DataFrame:
    """paper_id, next_no: one more than the highest N of a paper's ref_N."""
    n = F.regexp_extract("ref_id", r"^ref_(\d+)$", 1).try_cast("int")
    return refs.groupBy("paper_id").agg((F.coalesce(F.max(n), F.lit(0)) + 1).alias("next_no"))


def inserted(piece: Column, tokens: Column) -> Column:
    """A sentence with tokens before its last mark, or at its end where it has none; one space stands before them. White space after it stays."""
    marked = F.regexp_replace(piece, r"\s*([.!?]\s*)$", F.concat(F.lit(" "), tokens, F.lit("$1")))
    bare = F.concat(F.rtrim(F.regexp_replace(piece, r"\s+$", "")), F.lit(" "), tokens, F.regexp_extract(piece, r"(\s*)$", 1))
    return F.when(tokens == "", piece).when(piece.rlike(r"[.!?]\s*$"), marked).otherwise(bare)


def same_tokens(a: Column, b: Column) -> Column:
    """Whether two texts cite the same, each reference as often."""
    return F.sort_array(C.token_ids(a)) == F.sort_array(C.token_ids(b))


def fresh(results: DataFrame, known: DataFrame) -> DataFrame:
    """Candidates of each claim, the first of each DOI or title, without those of ``known`` (paper_id, seq).

    results: proposal_id, paper_id, op_no, claim_no, seq, title, doi, score and what else a source has; seq
    numbers a paper's results in the order in which they came.
    """
    key = F.coalesce(F.nullif(F.lower("doi"), F.lit("")), F.concat(F.lit("t:"), F.substring(F.lower("title"), 1, 80)))
    rest = results.join(known.select("paper_id", "seq"), ["paper_id", "seq"], "left_anti").withColumn("_key", key)
    w = Window.partitionBy("proposal_id", "op_no", "claim_no", "_key").orderBy("seq")
    return rest.withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k", "_key")


def chosen(claims: DataFrame, candidates: DataFrame, taken: DataFrame) -> DataFrame:
    """Which claims of an operation get a new source: proposal_id, claim_no, sentence_no, nth (from 0), seq, title, score.

    claims: proposal_id, max_new, claim_no, query, sentence_no (null: not found); candidates: proposal_id,
    claim_no, seq, title, score; taken: proposal_id, titles that the proposal has added before.
    A claim counts against max_new only if it gets a source. Of claims with one query the first is
    tried, whether it gets one or not. A title is added once a proposal. Each of these depends on the
    claims before, so an operation's claims are folded.
    """
    ranked = F.transform(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("down"), "seq", "title", "score"))), lambda x: F.struct(x["seq"].alias("seq"), x["title"].alias("title"), x["score"].alias("score")))
    offers = candidates.groupBy("proposal_id", "claim_no").agg(ranked.alias("offers"))
    kind = "array<struct<seq:bigint,title:string,score:double>>"
    rows = claims.join(offers, ["proposal_id", "claim_no"], "left").withColumn("offers", F.coalesce("offers", F.array().cast(kind)).cast(kind))
    query = F.lower(F.substring(F.trim("query"), 1, QUERY_CHARS))
    each = F.struct("claim_no", query.alias("query"), "sentence_no", "offers")
    by = rows.groupBy("proposal_id").agg(F.max("max_new").alias("max_new"), F.sort_array(F.collect_list(each)).alias("claims")).join(taken, "proposal_id", "left")

    def step(acc: Column, c: Column) -> Column:
        go = (F.size(acc["out"]) < F.col("max_new")) & (F.coalesce(c["query"], F.lit("")) != "") & ~F.array_contains(acc["used"], F.coalesce(c["query"], F.lit("")))
        best = F.get(F.filter(c["offers"], lambda o: ~F.array_contains(acc["titles"], F.lower(o["title"]))), F.lit(0))
        hit = go & c["sentence_no"].isNotNull() & F.coalesce(best["score"] >= RELEVANT, F.lit(False))
        new = F.struct(c["claim_no"].alias("claim_no"), c["sentence_no"].alias("sentence_no"), best["seq"].alias("seq"), best["title"].alias("title"), best["score"].alias("score"))
        return F.struct(
            F.when(go, F.concat(acc["used"], F.array(c["query"]))).otherwise(acc["used"]).alias("used"),
            F.when(hit, F.concat(acc["titles"], F.array(F.lower(best["title"])))).otherwise(acc["titles"]).alias("titles"),
            F.when(hit, F.concat(acc["out"], F.array(new))).otherwise(acc["out"]).alias("out"),
        )

    start = F.struct(F.array().cast("array<string>").alias("used"), F.coalesce("titles", F.array().cast("array<string>")).alias("titles"), F.array().cast("array<struct<claim_no:int,sentence_no:int,seq:bigint,title:string,score:double>>").alias("out"))
    out = by.select("proposal_id", F.posexplode(F.aggregate("claims", start, step)["out"]).alias("nth", "x"))
    return out.select("proposal_id", "x.claim_no", "x.sentence_no", "nth", "x.seq", "x.title", "x.score")


def cited(texts: DataFrame, adds: DataFrame) -> DataFrame:
    """texts (paper_id, section_id, text) with tokens put in: adds has paper_id, section_id, sentence_no, nth, ref_id."""
    keys = ["paper_id", "section_id"]
    token = F.concat(F.lit("[[citep:"), "ref_id", F.lit("]]"))
    by = adds.groupBy(*keys, "sentence_no").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("nth", token.alias("t")))), lambda x: x["t"]), " ").alias("t"))
    maps = by.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("sentence_no", "t"))).alias("tokens"))
    done = F.transform(T.sentence_pieces(F.col("text"), paired=True), lambda p, i: inserted(p, F.coalesce(F.try_element_at("tokens", i), F.lit(""))))
    return texts.join(maps, keys, "left").withColumn("text", F.when(F.col("tokens").isNull(), F.col("text")).otherwise(F.array_join(done, ""))).drop("tokens")


def execute(ops: DataFrame, sections: DataFrame, refs: DataFrame, claims: DataFrame, candidates: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(changes, new references) of proposals, whose operations stack: each works on what the one before left.

    ops: proposal_id, paper_id, op_no (from 0, MOST_OPERATIONS at most), op ('find_citations', 'rewrite_section'),
    section_id, max_new, text (a rewrite's); claims: proposal_id, op_no, claim_no, sentence, query;
    candidates: as fresh() gives them. A rewrite counts only if it cites the same as before. Numbers of
    new references go on through a proposal's operations. Operations on unknown sections are passed over.
    Changes: proposal_id, paper_id, section_id, before, after; new references: proposal_id, paper_id,
    ref_id, op_no, claim_no, section_id, seq, title, score.
    """
    keys = ["proposal_id", "section_id"]
    # Texts as they were are written once, then those that a round works on, then those that it changes: texts that an operation doesn't name stay where they are.
    base = kept(ops.select(*keys, "paper_id").distinct().join(sections.select("paper_id", "section_id", F.col("content").alias("before")), ["paper_id", "section_id"]), "working")
    first = ops.select("proposal_id", "paper_id").distinct().join(reference_numbers(refs), "paper_id", "left").select("proposal_id", F.coalesce("next_no", F.lit(1)).alias("next_no"))
    added = changed = None
    for k in range(MOST_OPERATIONS):  # a bounded number of rounds, each over all proposals
        now = ops.where(F.col("op_no") == k).join(base.drop("paper_id"), keys)
        if changed is not None:
            now = now.join(changed.groupBy(*keys).agg(F.max_by("after", "op_no").alias("_last")), keys, "left").withColumn("before", F.coalesce("_last", "before")).drop("_last")
        now = kept(now.withColumnRenamed("before", "old"), "named")
        rewritten = now.where((F.col("op") == "rewrite_section") & F.col("text").isNotNull() & same_tokens(F.col("old"), F.col("text"))).select(*keys, F.trim("text").alias("after"))
        find = now.where("op = 'find_citations'")
        asked = claims.where(F.col("op_no") == k).join(find.select(*keys, "max_new"), "proposal_id")
        # similar.located knows papers; here a proposal's working copy stands for one.
        spots = similar.located(find.select(F.col("proposal_id").alias("paper_id"), "section_id", F.col("old").alias("content")), asked.select(F.col("proposal_id").alias("paper_id"), "section_id", "claim_no", "sentence"))
        placed = asked.join(spots.select(F.col("paper_id").alias("proposal_id"), "claim_no", "sentence_no"), ["proposal_id", "claim_no"], "left")
        before = added.groupBy("proposal_id").agg(F.collect_list(F.lower("title")).alias("titles"), F.count("*").alias("n")) if added is not None else first.select("proposal_id", F.array().cast("array<string>").alias("titles"), F.lit(0).cast("long").alias("n"))
        got = chosen(placed.select("proposal_id", "max_new", "claim_no", "query", "sentence_no"), candidates.where(F.col("op_no") == k).select("proposal_id", "claim_no", "seq", "title", "score"), before.select("proposal_id", "titles"))
        got = got.join(find.select(*keys, "paper_id"), "proposal_id").join(first, "proposal_id").join(before.select("proposal_id", "n"), "proposal_id", "left")
        number = F.col("next_no") + F.coalesce("n", F.lit(0)) + F.col("nth")
        new = kept(got.select("proposal_id", "paper_id", F.concat(F.lit("ref_"), number.cast("string")).alias("ref_id"), F.lit(k).alias("op_no"), "claim_no", "section_id", "sentence_no", "nth", "seq", "title", "score"), "new-references")
        added = new if added is None else added.unionAll(new)
        named = find.select(F.col("proposal_id").alias("paper_id"), "section_id", F.col("old").alias("text"))
        texts = cited(named.join(new.select(F.col("proposal_id").alias("paper_id"), "section_id").distinct(), ["paper_id", "section_id"], "left_semi"), new.select(F.col("proposal_id").alias("paper_id"), "section_id", "sentence_no", "nth", "ref_id"))
        done = kept(texts.select(F.col("paper_id").alias("proposal_id"), "section_id", F.col("text").alias("after")).unionAll(rewritten).withColumn("op_no", F.lit(k)), "changed")
        changed = done if changed is None else changed.unionAll(done)
    last = changed.groupBy(*keys).agg(F.max_by("after", "op_no").alias("after"))
    changes = base.join(last, keys).where("after <> before").select("proposal_id", "paper_id", "section_id", "before", "after")
    return changes, added.drop("sentence_no", "nth")


def cite_findings(findings: DataFrame, sections: DataFrame, refs: DataFrame) -> DataFrame:
    """Each accepted finding as a proposal of its own, or why there is none.

    findings: finding_id, paper_id, section_id, claim, api, url, doi, title (null: no source);
    refs: paper_id, ref_id, doi, title. Out: finding_id, paper_id, section_id, status ('no_source',
    'no_section', 'already_cited', 'sentence_changed', 'ok'), ref_id, before, after.
    """
    titled = lambda c: F.upper(F.trim(c))  # noqa: E731 - capitals: those of ß are SS, which small letters would not undo
    same_doi = findings.withColumn("_d", F.lower("doi")).join(refs.select("paper_id", F.lower("doi").alias("_d")), ["paper_id", "_d"], "left_semi").select("finding_id")
    same_title = findings.withColumn("_t", titled("title")).join(refs.select("paper_id", titled("title").alias("_t")), ["paper_id", "_t"], "left_semi").select("finding_id")
    known = same_doi.unionAll(same_title).distinct().withColumn("_known", F.lit(True))
    spots = similar.located(sections, findings.select("paper_id", "section_id", F.col("finding_id").alias("claim_no"), F.coalesce("claim", F.lit("")).alias("sentence")))
    rows = findings.select("finding_id", "paper_id", "section_id", "title").join(known, "finding_id", "left").join(spots.select(F.col("claim_no").alias("finding_id"), "sentence_no"), "finding_id", "left")
    rows = rows.join(reference_numbers(refs), "paper_id", "left").withColumn("ref_id", F.concat(F.lit("ref_"), F.coalesce("next_no", F.lit(1)).cast("string")))
    # Texts come last: they are moved once, and not again with each of their findings.
    rows = rows.join(sections.select("paper_id", "section_id", F.col("content").alias("before")), ["paper_id", "section_id"], "left")
    status = F.when(F.col("title").isNull(), "no_source").when(F.col("before").isNull(), "no_section").when(F.col("_known"), "already_cited").when(F.col("sentence_no").isNull(), "sentence_changed").otherwise("ok")
    token = F.concat(F.lit("[[citep:"), "ref_id", F.lit("]]"))
    after = F.array_join(F.transform(T.sentence_pieces(F.col("before"), paired=True), lambda p, i: inserted(p, F.when(i == F.col("sentence_no"), token).otherwise(""))), "")
    ok = status == "ok"
    return rows.select("finding_id", "paper_id", "section_id", status.alias("status"), F.when(ok, F.col("ref_id")).alias("ref_id"), F.when(ok, F.col("before")).alias("before"), F.when(ok, after).alias("after"))
