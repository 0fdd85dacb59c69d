"""Citation integrity of proposed edits, and their application."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import citations as C


def multiset(rows: DataFrame, text: str, name: str = "n") -> DataFrame:
    return rows.select("paper_id", F.explode(C.token_ids(F.col(text))).alias("ref_id")).groupBy("paper_id", "ref_id").agg(F.count("*").alias(name))


def changes(rows: DataFrame) -> DataFrame:
    """paper_id, ref_id, n_before, n_after of every id in either text."""
    both = multiset(rows, "before_text", "n_before").join(multiset(rows, "after_text", "n_after"), ["paper_id", "ref_id"], "full")
    return both.na.fill(0, ["n_before", "n_after"])


def lost(rows: DataFrame) -> DataFrame:
    return changes(rows).where("n_before > n_after").select("paper_id", "ref_id", (F.col("n_before") - F.col("n_after")).alias("shortfall"))


def token_diff(rows: DataFrame) -> DataFrame:
    """Both multiset differences: missing and invented tokens."""
    d = F.col("n_before") - F.col("n_after")
    return changes(rows).where("n_before <> n_after").select("paper_id", "ref_id", F.when(d > 0, "missing").otherwise("invented").alias("kind"), F.abs(d).alias("n"))


def unknown(rows: DataFrame, refs: DataFrame) -> DataFrame:
    """Ids in the new text that the references don't have; a paper's own where refs have a paper_id."""
    own = [c for c in ("paper_id", "ref_id") if c in refs.columns]
    return multiset(rows, "after_text").join(refs.select(*own), own, "left_anti").select("paper_id", "ref_id", "n")


def report(rows: DataFrame, refs: DataFrame) -> DataFrame:
    """Per proposal: violations that block and that warn, and whether it may be applied. An acknowledged loss only warns."""
    a = lost(rows).groupBy("paper_id").agg(F.sum("shortfall").alias("n_lost"))
    b = unknown(rows, refs).groupBy("paper_id").agg(F.count("*").alias("n_unknown"))
    out = rows.select("paper_id", "removal_ack").join(a, "paper_id", "left").join(b, "paper_id", "left").na.fill(0, ["n_lost", "n_unknown"])
    blocking = F.when((F.col("n_lost") > 0) & (F.col("removal_ack") == 0), 1).otherwise(0) + F.when(F.col("n_unknown") > 0, 1).otherwise(0)
    warning = F.when((F.col("n_lost") > 0) & (F.col("removal_ack") == 1), 1).otherwise(0)
    return out.select("paper_id", "n_lost", "n_unknown", blocking.alias("n_blocking"), warning.alias("n_warning"), (blocking == 0).alias("ok"))


def apply(current: DataFrame, proposals: DataFrame, refs: DataFrame) -> DataFrame:
    """The current sections after their proposals: content, version and status.

    A proposal applies only where it may and where the text is still what it started from; else
    nothing changes and the status says why.
    """
    ok = report(proposals, refs).select("paper_id", "ok")
    rows = current.join(proposals.select("paper_id", "before_text", "after_text").join(ok, "paper_id"), "paper_id", "left")
    stale = F.col("content") != F.col("before_text")
    status = F.when(F.col("after_text").isNull(), "unchanged").when(~F.col("ok"), "blocked").when(stale, "stale").otherwise("applied")
    hit = status == "applied"
    return rows.select("paper_id", F.when(hit, F.col("after_text")).otherwise(F.col("content")).alias("content"), (F.col("version") + F.when(hit, 1).otherwise(0)).alias("version"), status.alias("status"))


def needed(new_refs: DataFrame, approved: DataFrame) -> DataFrame:
    """New references that an approved text cites."""
    cited = multiset(approved, "after_text").select("ref_id").distinct()
    return new_refs.join(cited, "ref_id", "left_semi")


def _said(changes: DataFrame) -> DataFrame:
    """changes without their texts, which are long: the ids that these cite (before_ids, after_ids) and a digest of the one before stand for them."""
    keys = [c for c in ("change_id", "proposal_id", "paper_id", "section_id") if c in changes.columns]
    return changes.select(*keys, C.token_ids(F.col("before")).alias("before_ids"), C.token_ids(F.col("after")).alias("after_ids"), F.sha2("before", 256).alias("before_digest"))


def _token_counts(said: DataFrame, ids: str, name: str) -> DataFrame:
    keys = ["proposal_id", "paper_id", "section_id"]
    return said.select(*keys, F.explode(ids).alias("ref_id")).groupBy(*keys, "ref_id").agg(F.count("*").alias(name))


def violations(changes: DataFrame, refs: DataFrame, new_refs: DataFrame, removals: DataFrame, adds: DataFrame) -> DataFrame:
    """What is wrong with proposals: proposal_id, section_id, ref_id, kind, n, blocking.

    changes: proposal_id, paper_id, section_id, before, after; refs: paper_id, ref_id; new_refs: proposal_id,
    ref_id, source, source_url; removals (acknowledged): proposal_id, section_id, ref_id; adds (declared):
    proposal_id, ref_id. citation_lost: a section cites a reference less often (only a warning where
    the removal is acknowledged); unknown_ref: cited, but neither the paper's nor new;
    no_provenance: new without a source and its address; asserted_add_missing: declared, but nowhere
    in the proposal's text (a warning).
    """
    return _wrong(_said(changes), refs, new_refs, removals, adds)


def _wrong(said_: DataFrame, refs: DataFrame, new_refs: DataFrame, removals: DataFrame, adds: DataFrame) -> DataFrame:
    keys = ["proposal_id", "section_id", "ref_id"]
    before, after = _token_counts(said_, "before_ids", "b"), _token_counts(said_, "after_ids", "a")
    short = before.join(after, ["proposal_id", "paper_id", "section_id", "ref_id"], "left").withColumn("n", F.col("b") - F.coalesce("a", F.lit(0))).where("n > 0")
    said = removals.select(*keys).distinct().withColumn("_said", F.lit(True))
    lost_ = short.join(said, keys, "left").select(*keys, F.lit("citation_lost").alias("kind"), "n", F.col("_said").isNull().alias("blocking"))
    unknown_ = after.join(refs.select("paper_id", "ref_id"), ["paper_id", "ref_id"], "left_anti").join(new_refs.select("proposal_id", "ref_id"), ["proposal_id", "ref_id"], "left_anti")
    unknown_ = unknown_.select(*keys, F.lit("unknown_ref").alias("kind"), F.col("a").alias("n"), F.lit(True).alias("blocking"))
    none = F.lit(None).cast("string").alias("section_id")
    bare = new_refs.where("coalesce(source, '') = '' or coalesce(source_url, '') = ''").select("proposal_id", none, "ref_id", F.lit("no_provenance").alias("kind"), F.lit(1).cast("long").alias("n"), F.lit(True).alias("blocking"))
    absent = adds.select("proposal_id", "ref_id").distinct().join(after.select("proposal_id", "ref_id"), ["proposal_id", "ref_id"], "left_anti")
    absent = absent.select("proposal_id", none, "ref_id", F.lit("asserted_add_missing").alias("kind"), F.lit(1).cast("long").alias("n"), F.lit(False).alias("blocking"))
    return lost_.unionAll(unknown_).unionAll(bare).unionAll(absent)


def apply_approved(sections: DataFrame, papers: DataFrame, refs: DataFrame, changes: DataFrame, approved: DataFrame, new_refs: DataFrame, removals: DataFrame) -> dict[str, DataFrame]:
    """Applies what of each proposal is approved, whole or not at all.

    sections: paper_id, section_id, content; papers: paper_id, version; refs: paper_id, ref_id; changes with
    change_id and command; approved: change_id. New references that no approved text cites fall away
    before the check, so that approving one change and not another leaves no dangling token.
    A proposal is 'rejected' (nothing approved), 'missing_section', 'violations', 'stale' (a section isn't
    what the change began from), 'later' (an earlier proposal of the paper is applied now) or 'applied'.
    Returns proposals (with status), sections (as they are then), papers (with versions), references
    (added: paper_id, ref_id, proposal_id), snapshots (the sections of changed papers as they were, with
    version, reason and proposal_id) and citations (paper_id, section_id, nth, raw, ref_ids).
    """
    # An inner join, since Spark would put a semi join before the texts are left behind; all but the last step goes without them.
    chosen = _said(changes).join(approved.select("change_id").distinct(), "change_id")
    cited = chosen.select("proposal_id", F.explode("after_ids").alias("ref_id")).distinct()
    pruned = new_refs.join(cited, ["proposal_id", "ref_id"], "left_semi")
    none = cited.limit(0)
    wrong = _wrong(chosen, refs, pruned, removals, none).where("blocking").select("proposal_id").distinct().withColumn("_wrong", F.lit(True))
    held = chosen.join(sections.select("paper_id", "section_id", F.sha2("content", 256).alias("digest")), ["paper_id", "section_id"], "left")
    state = held.groupBy("proposal_id").agg(F.count("*").alias("_n"), F.count_if(F.col("digest").isNull()).alias("_missing"), F.count_if(F.col("digest") != F.col("before_digest")).alias("_stale"))
    every = changes.groupBy("proposal_id", "paper_id").agg(F.max("command").alias("command"))
    rows = every.join(state, "proposal_id", "left").join(wrong, "proposal_id", "left")
    status = F.when(F.col("_n").isNull(), "rejected").when(F.col("_missing") > 0, "missing_section").when(F.col("_wrong"), "violations").when(F.col("_stale") > 0, "stale").otherwise("applied")
    rows = rows.withColumn("status", status)
    first = F.row_number().over(Window.partitionBy("paper_id", "status").orderBy("proposal_id"))
    rows = rows.withColumn("status", F.when((F.col("status") == "applied") & (first > 1), "later").otherwise(F.col("status")))
    done = rows.where("status = 'applied'").select("proposal_id", "paper_id", "command")
    hits = chosen.select("change_id", "proposal_id").join(done.select("proposal_id"), "proposal_id", "left_semi")
    new = changes.select("change_id", "proposal_id", "paper_id", "section_id", "after").join(hits, ["change_id", "proposal_id"], "left_semi").select("paper_id", "section_id", "after")
    after = sections.join(new, ["paper_id", "section_id"], "left").select("paper_id", "section_id", F.coalesce("after", "content").alias("content"))
    bumped = papers.join(done.select("paper_id", F.lit(1).alias("_up")), "paper_id", "left").select("paper_id", (F.col("version") + F.coalesce("_up", F.lit(0))).alias("version"))
    added = pruned.join(done.select("proposal_id", "paper_id"), "proposal_id").join(refs.select("paper_id", "ref_id"), ["paper_id", "ref_id"], "left_anti").select("paper_id", "ref_id", "proposal_id").distinct()
    reason = F.concat(F.lit("edit: "), F.substring(F.coalesce("command", F.lit("")), 1, 120))
    snapshots = sections.join(done, "paper_id").join(papers, "paper_id").select("paper_id", "version", reason.alias("reason"), "proposal_id", "section_id", "content")
    return {"proposals": rows.select("proposal_id", "paper_id", "status"), "sections": after, "papers": bumped, "references": added, "snapshots": snapshots, "citations": citations(after)}


def citations(sections: DataFrame) -> DataFrame:
    """The citations of sections as their tokens say: paper_id, section_id, nth (from 0), raw, ref_ids."""
    rows = sections.select("paper_id", "section_id", F.posexplode(F.regexp_extract_all("content", F.lit(C.TOKEN), F.lit(0))).alias("nth", "raw"))
    return rows.select("paper_id", "section_id", "nth", "raw", C.token_ids(F.col("raw")).alias("ref_ids"))


def manual_edits(edits: DataFrame, sections: DataFrame, papers: DataFrame, refs: DataFrame) -> DataFrame:
    """Edits by hand (edit_id, paper_id, section_id, content, base_version or null) with status and the paper's version after each.

    'no_paper', 'no_section', 'conflict' (another base version), 'unknown_refs', 'unchanged' or 'applied'. Lost citations are
    the editor's own business. One edit a paper at a time: several that would apply are tried each by itself.
    """
    strange = edits.select("edit_id", "paper_id", F.explode(C.token_ids(F.col("content"))).alias("ref_id")).join(refs.select("paper_id", "ref_id"), ["paper_id", "ref_id"], "left_anti")
    strange = strange.groupBy("edit_id").agg(F.array_sort(F.collect_set("ref_id")).alias("unknown"))
    rows = edits.join(sections.select("paper_id", "section_id", F.col("content").alias("_old")), ["paper_id", "section_id"], "left").join(papers.select("paper_id", "version"), "paper_id", "left").join(strange, "edit_id", "left")
    status = (
        F.when(F.col("version").isNull(), "no_paper").when(F.col("_old").isNull(), "no_section").when(F.col("base_version") != F.col("version"), "conflict")
        .when(F.col("unknown").isNotNull(), "unknown_refs").when(F.col("content") == F.col("_old"), "unchanged").otherwise("applied")
    )
    return rows.select("edit_id", "paper_id", "section_id", status.alias("status"), (F.col("version") + F.when(status == "applied", 1).otherwise(0)).alias("version"), "unknown")
