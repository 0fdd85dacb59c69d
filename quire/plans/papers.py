"""Whole papers from placed lines: order, floats, sections, references and linked citations, stage by stage, for all papers at once."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import citations as C
from ..operators import entries, intext, layout, pages, regions
from .stages import StageHook, Stages

#: An abstract that begins in its heading's line, the confidence from which an entry counts as parsed, and the style that each way of citing suggests.
RUN_IN = r"(?i)^abstract\s*[—\-–.:]\s+\S"
PARSED = 0.5
SUGGESTED = {"numeric_bracket": "ieee", "numeric_superscript": "nature", "numeric_paren": "ieee", "author_year": "apa", "unknown": "ieee"}
LINES = "paper_id, page, line_seq, text, x0, x1, y0, y1, size"


@dataclass
class Papers:
    """The relations of parsed papers, each a written table, and the run's counters and texts."""

    lines: DataFrame
    floats: DataFrame
    meta: DataFrame
    sections: DataFrame
    references: DataFrame
    unlinked: DataFrame
    styles: DataFrame
    counters: dict[str, int]
    report: list[str]


def sectioned(lines: DataFrame, heads: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(sections, their lines). Sections: paper_id, section_no (from 1), title, level, kind, page_start, page_end.

    A section runs from behind its heading to the next one. Before the first heading only an abstract
    that begins in a line of its own counts, with that line. A paper without either is one section.
    """
    first = heads.groupBy("paper_id").agg(F.min("line_seq").alias("_first"))
    led = lines.where(F.col("text").rlike(RUN_IN)).join(first, "paper_id", "left").where(F.col("_first").isNull() | (F.col("line_seq") < F.col("_first")))
    led = led.groupBy("paper_id").agg(F.min("line_seq").alias("line_seq")).select("paper_id", "line_seq", F.lit("Abstract").alias("title"), F.lit(1).alias("level"), F.lit("abstract").alias("kind"), F.lit(True).alias("inside"))
    marks = heads.withColumn("inside", F.lit(False)).unionByName(led)
    bare = lines.groupBy("paper_id").agg(F.min("line_seq").alias("line_seq")).join(marks.select("paper_id").distinct(), "paper_id", "left_anti")
    marks = marks.unionByName(bare.select("paper_id", "line_seq", F.lit("Body").alias("title"), F.lit(1).alias("level"), F.lit("body").alias("kind"), F.lit(True).alias("inside")))
    marks = marks.withColumn("section_no", F.row_number().over(Window.partitionBy("paper_id").orderBy("line_seq")))
    rows = pages.by_paper(lines).join(pages.by_paper(marks.select("paper_id", "line_seq", F.col("section_no").alias("_at"), "inside")), ["paper_id", "line_seq"], "left")
    rows = rows.withColumn("section_no", F.last("_at", ignorenulls=True).over(Window.partitionBy("paper_id").orderBy("line_seq"))).where("section_no is not null and (_at is null or inside)").drop("_at", "inside")
    ends = rows.groupBy("paper_id", "section_no").agg(F.min_by("page", "line_seq").alias("page_start"), F.max_by("page", "line_seq").alias("page_end"))
    return marks.select("paper_id", "section_no", "title", "level", "kind").join(ends, ["paper_id", "section_no"], "left"), rows


def parse(lines: DataFrame, found: DataFrame | None = None, hook: StageHook | None = None, width: float = 600.0, height: float = 800.0) -> Papers:
    """lines: LINES, and mostly_bold and marked_text where they are known; found: drawings, tables and images as regions.accepted takes them.

    Stages: A lines in reading order without furniture; A' floats; B structure; C reference lists; D entries; E citations.
    """
    run = Stages(hook)
    n = F.count(F.lit(1))
    run.start("A")
    if "marked_text" not in lines.columns:
        lines = lines.withColumn("marked_text", F.col("text"))
    clean = layout.without_furniture(lines, height)
    clean = run.keep(pages.numbered(pages.merged_numbers(pages.reading_order(clean, width))), "lines", n_lines=n)
    run.done("A", f"{run.counters['n_lines']} lines in reading order")

    run.start("A'")
    if found is None:
        floats = lines.sparkSession.createDataFrame([], "paper_id long, float_no int, kind string, page int, caption string, text string, anchor_line int")
        prose = clean
        run.counters |= {f"n_{k}": 0 for k in regions.KINDS} | {"n_moved": 0}
    else:
        floats, held = regions.floats(clean, found, width * height)
        floats = run.keep(floats, "floats", **{f"n_{k}": F.count_if(F.col("kind") == k) for k in regions.KINDS})
        held = run.keep(held.select("paper_id", "line_seq").distinct(), "float-lines", n_moved=n)
        prose = run.keep(clean.join(held, ["paper_id", "line_seq"], "left_anti"), "prose")
    c = run.counters
    run.done("A'", f"{c['n_figure']} figures, {c['n_table']} tables and {c['n_box']} boxes with {c['n_moved']} lines")

    run.start("B")
    heads = run.keep(layout.headings(prose), "headings", n_headings=n)
    parts, inner = sectioned(prose, heads)
    inner = run.keep(inner, "section-lines")
    text = pages.flattened(inner.drop("text"), "paper_id", "section_no", text="marked_text").withColumnRenamed("marked_text", "content")
    names = pages.authors(prose, heads).groupBy("paper_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("nth", "author"))), lambda x: x["author"]).alias("authors"))
    parts = parts.join(text, ["paper_id", "section_no"], "left").withColumn("content", F.when(F.col("kind") == "references", "").otherwise(F.coalesce("content", F.lit(""))))
    parts = run.keep(parts, "sections", n_sections=n)
    abstract = parts.where("kind = 'abstract'").groupBy("paper_id").agg(F.min_by(pages.abstract_text(F.col("content")), "section_no").alias("abstract"))
    every = prose.select("paper_id").distinct()
    meta = every.join(pages.titles(prose), "paper_id", "left").join(names, "paper_id", "left").join(abstract, "paper_id", "left")
    meta = run.keep(meta.withColumn("authors", F.coalesce("authors", F.array().cast("array<string>"))), "meta", n_papers=n, n_titled=F.count("title"), n_abstracts=F.count("abstract"))
    run.done("B", f"{c['n_papers']} papers, {c['n_titled']} with a title, {c['n_abstracts']} with an abstract; {c['n_sections']} sections")

    run.start("C")
    lists = pages.by_paper(parts.where("kind = 'references'").select("paper_id", "section_no"))
    listed = pages.by_paper(inner.select("paper_id", "section_no", "line_seq", "page", "column", "x0", "text")).join(lists, ["paper_id", "section_no"], "left_semi")
    raw, strategies = entries.segmented(listed.select("paper_id", "line_seq", "page", "column", "x0", "text"))
    raw = run.keep(raw, "entries", n_references=n)
    strategies = run.keep(strategies, "strategies", n_lists=n, n_unsegmented=F.count_if(F.col("strategy") == "none"))
    run.done("C", f"{c['n_references']} entries in {c['n_lists']} lists, {c['n_unsegmented']} kept as one block")

    run.start("D")
    own = F.concat_ws("|", F.col("paper_id").cast("string"), F.col("entry_no").cast("string"))
    keyed = raw.withColumn("_id", own)
    fields = entries.parse(keyed.select(F.col("_id").alias("ref_id"), "raw_text")).withColumnRenamed("ref_id", "_id")
    refs = keyed.join(fields, "_id").select("paper_id", F.col("entry_no").alias("ord"), F.concat(F.lit("ref_"), F.col("entry_no").cast("string")).alias("ref_id"), "label", "raw_text", *(x for x in fields.columns if x != "_id"))
    refs = run.keep(refs, "references", n_parsed=F.count_if(F.col("confidence") >= PARSED), n_unparsed=F.count_if(F.col("confidence") < PARSED))
    run.done("D", f"{c['n_parsed']} of {c['n_references']} entries parsed, {c['n_unparsed']} kept in their own words")

    run.start("E")
    asked = refs.select("paper_id", "ord", "ref_id", "label", F.get("authors", F.lit(0)).alias("author1"), "year")
    body = parts.where("kind <> 'references'").select("paper_id", F.concat(F.lit("sec_"), F.col("section_no").cast("string")).alias("section_id"), "content")
    done, unlinked, found_styles = intext.tokenised(body, asked)
    texts = parts.withColumn("section_id", F.concat(F.lit("sec_"), F.col("section_no").cast("string"))).drop("content").join(done, ["paper_id", "section_id"], "left").withColumn("content", F.coalesce("content", F.lit("")))
    linked = F.sum(F.size(F.regexp_extract_all("content", F.lit(C.TOKEN), F.lit(0))))
    texts = run.keep(texts, "tokenised-sections", n_linked=linked)
    unlinked = run.keep(unlinked, "unlinked", n_unlinked=n)
    suggested = F.coalesce(*(F.when(F.col("style") == s, F.lit(i)) for s, i in SUGGESTED.items()))
    styles = run.keep(found_styles.withColumn("csl_style", suggested), "paper-styles")
    run.done("E", f"{c['n_linked']} markers linked, {c['n_unlinked']} left as they are")
    at = inner.select("paper_id", "line_seq", F.col("section_no").cast("long").alias("section_no"))
    placed = floats if found is None else regions.placed(floats, at, parts.select("paper_id", F.col("section_no").cast("long").alias("section_no"), "page_start"))
    return Papers(clean, placed, meta, texts, refs, unlinked, styles, run.counters, run.texts)
