"""Work that a paper should cite: search results against what it cites already, ranked, and rewrites of sections that keep every citation."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators import similar, works

#: The best of a claim, of a paper, and the floor that applies last; attempts of a rewrite; the least text that is reviewed.
PER_CLAIM, MOST, FLOOR, ATTEMPTS, LEAST_TEXT = 3, 8, 0.4, 2, 200


def reviewable(sections: DataFrame) -> DataFrame:
    """Body sections and abstracts of LEAST_TEXT characters or more."""
    return sections.where(F.col("kind").isin("body", "abstract") & (F.length("content") >= LEAST_TEXT))


def ranked(claims: DataFrame, candidates: DataFrame) -> DataFrame:
    """paper_id, claim_no, seq, score: min(1, .7 * share of the claim's words that the title or abstract holds + .3 * log10(citations + 1) / 5).

    claims: paper_id, claim_no, claim; candidates: paper_id, claim_no, seq, title, abstract, cited_by_count. Words have
    three letters or more and are no stop words; they count as parts of words too; a claim counts for three words at least.
    """
    words = F.array_distinct(F.filter(F.regexp_extract_all(F.lower("claim"), F.lit(r"[a-z\-]{3,}"), F.lit(0)), lambda w: ~w.isin(works.PHRASE_STOP)))
    text = F.lower(F.concat(F.coalesce("title", F.lit("")), F.lit(" "), F.coalesce("abstract", F.lit(""))))
    rows = candidates.join(claims.select("paper_id", "claim_no", words.alias("ws")), ["paper_id", "claim_no"]).withColumn("t", text)
    hits = F.size(F.filter("ws", lambda w: F.contains(F.col("t"), w)))
    score = F.least(F.lit(1.0), 0.7 * hits / F.greatest(F.size("ws"), F.lit(3)) + 0.3 * F.log10(F.coalesce("cited_by_count", F.lit(0)) + 1.0) / 5)
    return rows.select("paper_id", "claim_no", "seq", F.round(score, 9).alias("score"))


def missing_work(claims: DataFrame, results: DataFrame, refs: DataFrame, papers: DataFrame) -> DataFrame:
    """paper_id, place, claim_no, seq, score: new works of each paper, the best first.

    results: paper_id, claim_no, seq, doi, url, note, title, abstract, cited_by_count. What the paper cites already, or
    is itself, goes; of results with one DOI or title the first of the paper stays; then PER_CLAIM of a claim, MOST of a paper, and
    only then those below FLOOR go.
    """
    known = similar.known_works(results, refs, papers)
    key = F.coalesce(F.nullif(F.lower("doi"), F.lit("")), F.concat(F.lit("t:"), F.substring(F.lower("title"), 1, 80)))
    new = results.join(known.select("paper_id", "seq"), ["paper_id", "seq"], "left_anti").withColumn("_key", key)
    new = new.withColumn("_k", F.row_number().over(Window.partitionBy("paper_id", "_key").orderBy("seq"))).where("_k = 1")
    rows = ranked(claims, new)
    by_claim = F.row_number().over(Window.partitionBy("paper_id", "claim_no").orderBy(F.col("score").desc(), "seq"))
    rows = rows.withColumn("_c", by_claim).where(F.col("_c") <= PER_CLAIM)
    place = F.row_number().over(Window.partitionBy("paper_id").orderBy(F.col("score").desc(), "claim_no", "seq"))
    return rows.withColumn("place", place).where((F.col("place") <= MOST) & (F.col("score") >= FLOOR)).select("paper_id", "place", "claim_no", "seq", "score")


def rewritten(sections: DataFrame, model: Callable[[str], str | None]) -> DataFrame:
    """Rewrites of sections (proposal_id, section_id, instruction, content) by a model: with text (null: none was safe), attempts and status.

    A rewrite has to cite the same references as often as before. One that doesn't is asked for once more
    with what is missing and what is too much; a model without an answer ends it. 'ok', 'tokens' or 'no answer'.
    """
    schema = "proposal_id long, section_id string, text string, attempts int, status string"

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import re
        from collections import Counter

        def ids(t: str) -> Counter:
            return Counter(x.strip() for m in re.findall(r"\[\[cite[pt]:([A-Za-z0-9_,\- ]+?)\]\]", t) for x in m.split(",") if x.strip())

        for b in batches:
            out = []
            for p, s, wish, text in zip(b["proposal_id"], b["section_id"], b["instruction"], b["content"], strict=True):
                want, feedback, n, found, status = ids(text or ""), "", 0, None, "tokens"
                while n < ATTEMPTS and found is None:
                    n += 1
                    got = model(f"{wish}\n{feedback}\n{text}")
                    if not got:
                        status = "no answer"
                        break
                    have = ids(got)
                    if have == want:
                        found, status = got.strip(), "ok"
                    feedback = f"missing: {sorted((want - have).elements())}; too much: {sorted((have - want).elements())}"
                out.append((p, s, found, n, status))
            yield pd.DataFrame(out, columns=["proposal_id", "section_id", "text", "attempts", "status"])

    return sections.select("proposal_id", "section_id", "instruction", "content").mapInPandas(ask, schema)


def report_json(sections: DataFrame, refs: DataFrame, unlinked: DataFrame, styles: DataFrame) -> DataFrame:
    """paper_id, report: what a parse counted, as JSON."""
    n = lambda df, name, c=None: df.groupBy("paper_id").agg((F.count("*") if c is None else F.count_if(c)).alias(name))
    rows = styles.select("paper_id", "style", "confidence")
    for df in (n(sections, "n_sections"), n(refs, "n_references"), n(refs, "n_parsed", F.col("confidence") >= works.PARSED), n(unlinked, "n_unlinked")):
        rows = rows.join(df, "paper_id", "left")
    counts = [F.coalesce(c, F.lit(0)).alias(c) for c in ("n_sections", "n_references", "n_parsed", "n_unlinked")]
    return rows.select("paper_id", F.to_json(F.struct(*counts, "style", "confidence")).alias("report"))
