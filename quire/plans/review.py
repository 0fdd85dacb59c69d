"""A review run: findings of several kinds as one relation in order of severity, with a pluggable model."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.similarity import quoted
from ..operators import integrity, links, review

#: A model is a function from a prompt to text; None means that there is none and says so in the findings.
Model = Callable[[str], str]
VERDICTS = {"supported": ("claim_supported", "info"), "unsupported": ("claim_unsupported", "high"), "unclear": ("claim_unverifiable", "low")}


def scripted(answers: dict[str, str], default: str = '{"verdict": "unclear"}') -> Model:
    """A deterministic model for tests: the answer of the first key that the prompt holds."""
    return lambda prompt: next((a for k, a in answers.items() if k in prompt), default)


def loose_json(text: str | None) -> dict | list | None:
    """JSON inside fences or prose: the outermost braces or brackets; None where there is none."""
    t = (text or "").strip().removeprefix("```json").removeprefix("```").removesuffix("```").strip()
    for a, b in (("", ""), ("{", "}"), ("[", "]")):
        try:
            return json.loads(t if not a else t[t.index(a) : t.rindex(b) + 1])
        except ValueError:
            continue
    return None


def judged(claims: DataFrame, model: Model | None) -> DataFrame:
    """claims (paper_id, seq, claim, ref_id, abstract) with type, severity, quote. The branch order: no reference, no abstract, no model, error, verdict; a quotation that the abstract lacks voids a support."""
    schema = "paper_id long, seq long, claim string, ref_id string, abstract string, verdict string, quote string"

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = b.copy()
            got = [loose_json(model(f"{c}\n{a}")) if model and a else None for c, a in zip(b["claim"], b["abstract"], strict=True)]
            out["verdict"] = [g.get("verdict") if isinstance(g, dict) else ("error" if model and a else None) for g, a in zip(got, b["abstract"], strict=True)]
            out["quote"] = [g.get("quote") if isinstance(g, dict) else None for g in got]
            yield out

    rows = claims.mapInPandas(ask, schema)
    ok = F.col("quote").isNull() | quoted(F.col("quote"), F.col("abstract"))
    kind = F.when(F.col("ref_id").isNull(), "unlinked_marker").when(F.col("abstract").isNull(), "claim_unverifiable").when(F.col("verdict").isNull() | (F.col("verdict") == "error"), "claim_unverifiable")
    for v, (t, _) in VERDICTS.items():
        kind = kind.when((F.col("verdict") == v) & (ok | F.lit(v != "supported")), t)
    rows = rows.withColumn("type", kind.otherwise("claim_unverifiable"))
    sev = F.coalesce(*(F.when(F.col("type") == t, F.lit(s)) for t, s in VERDICTS.values()), F.lit("low"))
    return rows.select("paper_id", "seq", "type", sev.alias("severity"), F.col("claim").alias("title"))


def run(sections: DataFrame, refs: DataFrame, tokens: DataFrame, sources: DataFrame) -> DataFrame:
    """Findings without a model: unlinked markers, lost citations, and candidates that aren't cited yet."""
    a = links.unmatched_markers(sections, refs).select("paper_id", F.lit("unlinked_marker").alias("type"), F.lit("low").alias("severity"), F.concat(F.lit("["), "raw", F.lit("]")).alias("title"))
    b = integrity.lost(tokens).select("paper_id", F.lit("lost_citation").alias("type"), F.lit("high").alias("severity"), F.col("ref_id").alias("title"))
    c = review.new_candidates(sources, refs).select("paper_id", F.lit("missing_work").alias("type"), F.lit("medium").alias("severity"), F.col("key").alias("title"))
    # Findings that are the same count once, so that type and title number a paper's findings.
    rows = a.unionByName(b).unionByName(c).groupBy("paper_id", "type", "severity", "title").agg(F.count("*").alias("n")).withColumn("seq", F.xxhash64("type", "title"))
    return rows.join(review.by_severity(rows).select("paper_id", "seq", "place"), ["paper_id", "seq"])
