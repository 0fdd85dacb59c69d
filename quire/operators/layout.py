"""Layout: running heads, headings, reading order, sections, regions and floats."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as T
from . import pages

#: Section names that are headings by themselves, by kind.
KNOWN_HEADINGS = {
    "abstract": ["abstract"],
    "body": ["introduction", "related work", "background", "preliminaries", "method", "methods", "methodology", "approach", "model", "model architecture", "experiments", "experiment", "experimental setup", "results", "evaluation", "discussion", "analysis", "limitations", "conclusion", "conclusions", "future work"],
    "references": ["references", "bibliography"],
    "other": ["acknowledgements", "acknowledgments", "acknowledgement", "acknowledgment", "appendix", "broader impact", "ethics statement"],
}
PAGE_HEIGHT = 260.0
#: Numbers before a heading (3, 3.1, IV., B.) and the title after them; a line that holds a page's number.
NUMBERING = r"^\s*(?:(\d+(?:\.\d+)*)\.?|([IVXLC]+)\.|([A-H])\.)\s+(.*)$"
PAGE_NUMBER = r"(?i)^\s*(page\s+)?\d{1,4}(\s+of\s+\d{1,4})?\s*$"
#: A figure's caption is at most so far from it.
CAPTION_GAP = 40.0


def _lines(paper: str = "paper_id") -> Window:
    return Window.partitionBy(paper).orderBy("line_seq")


def running_heads(lines: DataFrame, share: float = 0.35, height: float = PAGE_HEIGHT) -> DataFrame:
    """paper_id, head, n_pages: masked lines of the top or bottom tenth that recur on 2 pages and on the share of all."""
    of_paper = lines.groupBy("paper_id").agg((F.max("page") + 1).alias("n"))
    band = (F.col("y0") < 0.1 * height) | (F.col("y0") > 0.9 * height)
    heads = lines.where(band).groupBy("paper_id", T.running_key(F.col("text")).alias("head")).agg(F.countDistinct("page").alias("n_pages"))
    return heads.join(of_paper, "paper_id").where(F.col("n_pages") >= F.greatest(F.lit(2.0), share * F.col("n"))).select("paper_id", "head", "n_pages")


def without_furniture(lines: DataFrame, height: float = PAGE_HEIGHT) -> DataFrame:
    """Lines that are neither blank, nor page numbers in the top or bottom tenth, nor running heads."""
    band = (F.col("y0") < 0.1 * height) | (F.col("y0") > 0.9 * height)
    plain = lines.where(F.trim("text") != "").where(~(F.col("text").rlike(PAGE_NUMBER) & band))
    heads = running_heads(lines, height=height).select("paper_id", "head")
    keyed = plain.withColumn("head", T.running_key(F.col("text")))
    return pages.by_paper(keyed).join(pages.by_paper(heads), ["paper_id", "head"], "left_anti").drop("head")


def body_size(lines: DataFrame) -> DataFrame:
    """The font size that most characters have; of equals the one seen first."""
    by = lines.groupBy("paper_id", F.round("size", 1).alias("size")).agg(F.sum(F.length("text")).alias("mass"), F.min("line_seq").alias("seq"))
    best = F.max_by(F.col("size"), F.struct("mass", -F.col("seq")))
    return by.groupBy("paper_id").agg(best.alias("body_size"))


def stripped(t: Column) -> tuple[Column, Column]:
    """A heading's title without its number, and its level: one more than the number's dots."""
    number = F.regexp_extract(t, NUMBERING, 1)
    title = F.when(t.rlike(NUMBERING), F.trim(F.regexp_extract(t, NUMBERING, 4))).otherwise(t)
    return title, F.when(number != "", F.length(number) - F.length(F.replace(number, F.lit("."), F.lit(""))) + 1).otherwise(1).cast("int")


def kind_of(title: Column) -> Column:
    """The kind of a known section name, else null."""
    key = F.regexp_replace(F.lower(title), r"[.:]+$", "")
    return F.coalesce(*(F.when(key.isin(v), F.lit(k)) for k, v in KNOWN_HEADINGS.items()))


def headings(lines: DataFrame) -> DataFrame:
    """Lines that are headings, with title, level and kind.

    At most 90 characters and 12 words. A known name only has to be set apart (larger, bold, in
    capitals or numbered); any other line has to be numbered, larger or bold, mostly letters, and
    not to end like a sentence. ``mostly_bold`` may be missing.
    """
    t = F.trim("text")
    title, level = stripped(t)
    bold = F.col("mostly_bold") if "mostly_bold" in lines.columns else F.lit(False)
    # Any heading has a known name or a number: other lines needn't meet their paper's size.
    rows = lines.where(kind_of(title).isNotNull() | t.rlike(NUMBERING)).join(body_size(lines), "paper_id").where((t != "") & (F.length(t) <= 90) & (F.size(F.split(t, r"\s+")) <= 12))
    larger, numbered = F.col("size") > 1.02 * F.col("body_size"), t.rlike(NUMBERING)
    apart = larger | bold | ((F.upper(t) == t) & (F.lower(t) != t)) | numbered
    letters = F.length(F.regexp_replace(title, r"[^\p{L}\s]", "")) / F.greatest(F.length(title), F.lit(1))
    other = numbered & (larger | bold) & ~t.rlike(r"[.,:;]$") & (letters > 0.75)
    kind = kind_of(title)
    return rows.where(F.when(kind.isNotNull(), apart).otherwise(other)).select("paper_id", "line_seq", title.alias("title"), level.alias("level"), F.coalesce(kind, F.lit("body")).alias("kind"))


def section_lines(lines: DataFrame, marks: DataFrame) -> DataFrame:
    """Each line with its section: the latest heading at or before it (0 before the first). Headings themselves are left out."""
    rows = lines.join(marks.select("paper_id", "line_seq", F.lit(1).alias("mark")), ["paper_id", "line_seq"], "left")
    rows = rows.withColumn("section_no", F.sum(F.coalesce("mark", F.lit(0))).over(_lines()))
    return rows.where("mark is null").select("paper_id", "line_seq", "section_no", "page")


def section_extents(lines: DataFrame, marks: DataFrame) -> DataFrame:
    s = section_lines(lines, marks)
    return s.groupBy("paper_id", "section_no").agg(F.min_by("page", "line_seq").alias("page_start"), F.max_by("page", "line_seq").alias("page_end"), F.count("*").alias("n_lines"))


def paragraphs(lines: DataFrame) -> DataFrame:
    """Paragraph number of each line: a new one after a gap above .85 of the median line height, on a new page or in a new column."""
    prev = lambda c: F.lag(c).over(_lines())
    gap = F.col("y0") - prev("y0") - F.col("size")
    med = lines.groupBy("paper_id").agg(F.median("size").alias("height"))
    rows = lines.join(med, "paper_id")
    rows = rows.withColumn("new", F.when(prev("page").isNull() | (prev("page") != F.col("page")) | ((prev("x0") < 200) != (F.col("x0") < 200)) | (gap > 0.85 * F.col("height")), 1).otherwise(0))
    return rows.select("paper_id", "line_seq", F.sum("new").over(_lines()).alias("paragraph_no"))


def entry_starts(lines: DataFrame) -> DataFrame:
    """Hanging-indent entries: a line within 2.5 of its page's least x0 begins one."""
    edge = F.min("x0").over(Window.partitionBy("paper_id", "page"))
    rows = lines.withColumn("start", F.when(F.col("x0") <= edge + 2.5, 1).otherwise(0))
    rows = rows.withColumn("entry_no", F.sum("start").over(_lines()))
    return rows.groupBy("paper_id", "entry_no").agg(F.count("*").alias("n_lines"), F.min("line_seq").alias("first_line"))


def reading_order(lines: DataFrame, width: float = 600.0) -> DataFrame:
    """Place of each line on its page: by column where 5 lines or more stand on both sides, else by y0 and x0."""
    page = Window.partitionBy("paper_id", "page")
    right = F.col("x0") >= 0.9 * width / 2
    two = (F.count_if(right).over(page) >= 5) & (F.count_if(~right).over(page) >= 5)
    rows = lines.withColumn("col", F.when(two & right, 1).otherwise(0))
    return rows.select("paper_id", "page", "line_seq", F.row_number().over(page.orderBy("col", F.round("y0", 1), "x0", "line_seq")).alias("place"))


def lines_in_regions(lines: DataFrame, regions: DataFrame, width: float = 200.0) -> DataFrame:
    """Lines whose centre lies in a region of their page, each claimed by the first such region."""
    cx, cy = F.col("l.x0") + width / 2, F.col("l.y0") + F.col("l.size") / 2
    r = regions.alias("r")
    met = lines.alias("l").join(r, (F.col("l.paper_id") == F.col("r.paper_id")) & (F.col("l.page") == F.col("r.page")) & cx.between(F.col("r.x0"), F.col("r.x1")) & cy.between(F.col("r.y0"), F.col("r.y1")))
    return met.groupBy(F.col("l.paper_id").alias("paper_id"), F.col("l.line_seq").alias("line_seq")).agg(F.min("r.region_no").alias("region_no"))


def free_regions(regions: DataFrame) -> DataFrame:
    """Regions that overlap no earlier one of another kind on their page."""
    a, b = regions.alias("a"), regions.alias("b")
    on = (F.col("a.paper_id") == F.col("b.paper_id")) & (F.col("a.page") == F.col("b.page")) & (F.col("b.region_no") < F.col("a.region_no")) & (F.col("a.kind") != F.col("b.kind"))
    cross = (F.col("a.x0") < F.col("b.x1")) & (F.col("b.x0") < F.col("a.x1")) & (F.col("a.y0") < F.col("b.y1")) & (F.col("b.y0") < F.col("a.y1"))
    return a.join(b, on & cross, "left_anti").select("paper_id", "page", "region_no", "kind")


def nearest_captions(lines: DataFrame, regions: DataFrame, width: float = 200.0) -> DataFrame:
    """Per region the line of its page that overlaps it sideways with the least gap below CAPTION_GAP; ties go to the earlier line."""
    l, r = lines.alias("l"), regions.alias("r")
    side = F.least(F.col("l.x0") + width, F.col("r.x1")) > F.greatest(F.col("l.x0"), F.col("r.x0"))
    gap = F.greatest(F.col("l.y0") - F.col("r.y1"), F.col("r.y0") - (F.col("l.y0") + F.col("l.size")), F.lit(0.0))
    met = r.join(l, (F.col("l.paper_id") == F.col("r.paper_id")) & (F.col("l.page") == F.col("r.page")) & side & (gap < CAPTION_GAP))
    return met.groupBy(F.col("r.paper_id").alias("paper_id"), F.col("r.region_no").alias("region_no")).agg(F.min_by(F.col("l.line_seq"), F.struct(gap, "l.line_seq")).alias("line_seq"), F.min(gap).alias("gap"))


def float_anchors(lines: DataFrame, regions: DataFrame) -> DataFrame:
    """Per region that claims lines: the last unclaimed line before its first claimed one."""
    claimed = lines_in_regions(lines, regions)
    rows = lines.select("paper_id", "line_seq").join(claimed, ["paper_id", "line_seq"], "left")
    before = F.last(F.when(F.col("region_no").isNull(), F.col("line_seq")), ignorenulls=True).over(_lines().rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("anchor", before).where("region_no is not null")
    return rows.groupBy("paper_id", "region_no").agg(F.min_by("anchor", "line_seq").alias("anchor_line"))


def readability(pages: DataFrame, least: int = 200) -> DataFrame:
    """Per document a status instead of an exception: error below ``least`` characters, warning where pages are empty."""
    out = pages.groupBy("paper_id").agg(F.sum("n_chars").alias("n_chars"), F.count_if(F.col("n_chars") == 0).alias("n_empty"))
    return out.withColumn("status", F.when(F.col("n_chars") < least, "error").when(F.col("n_empty") > 0, "warning").otherwise("ok"))
