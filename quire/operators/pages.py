"""From placed lines to reading text: the order of lines on a page, numbers set apart from their headings, raised numbers, joined text, and the title and authors of the first page."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: A line across has more than this share of the page's width, or the lesser one where it crosses the middle.
ACROSS, CROSSING = 0.6, 0.45
#: A page has two columns from so many lines on each side.
SIDE_LINES = 5
#: What a line is that holds nothing but a heading's number, and how near the heading stands.
NUMBER_ONLY = r"^(?:\d{1,2}(?:\.\d{1,2})*\.?|[IVXLC]{1,5}\.?|[A-H]\.)$"
LEVEL_GAP, SIDE_GAP = 3.0, 40.0
#: What raised spans hold where they cite.
RAISED = r"^[\d,\s\-–]+$"
PARAGRAPH_GAP = 0.85
#: The shape of author lines, what marks an affiliation, and the marks that follow names.
NAME_LINE = r"^[A-Z][a-zA-Z.\-']+(\s+[A-Z][a-zA-Z.\-']+){1,4}([,∗*†‡§¶\d\s]*)$"
AFFILIATION = r"(?i)universit|institute|department|school|college|research|lab\b|labs\b|brain|deepmind|google|microsoft|facebook|meta ai|amazon|ibm|openai|academy|center|centre|inc\.?$|corp"
NAME_MARKS = r"[∗*†‡§¶\d]+"
ABSTRACT_LEAD = r"(?i)^abstract\s*[—\-–.:]?\s*"
#: Partitions of lines for each one of other shuffles.
PARTS = 3
TITLE_LINES, FRONT_LINES, MOST_AUTHORS = 3, 40, 15


def _page() -> Window:
    return Window.partitionBy("paper_id", "page")


def by_paper(rows: DataFrame) -> DataFrame:
    """rows, a paper's in one partition: what is then done by page, column or float of a paper moves none of them again.

    The number of partitions is given, so that they aren't joined by their size on disk: lines are packed well and spread far.
    A task sorts its papers' lines several times and holds each sort, so there are more partitions than of other shuffles.
    """
    return rows.repartition(PARTS * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), "paper_id")


def reading_order(lines: DataFrame, width: float = 600.0) -> DataFrame:
    """lines (paper_id, page, line_seq, x0, x1, y0) with ``column`` and ``place``, the line's place on its page from 1.

    Lines across cut a page of two columns into zones; a zone is read left, right, then the line that
    closes it. How many lines across begin at or above a line is its zone, so that one running count
    and one sort give the order. Other pages are read by height, then from the left.
    """
    mid, w = width / 2, F.col("x1") - F.col("x0")
    across = (w > ACROSS * width) | ((F.col("x0") < mid) & (F.col("x1") > mid) & (w > CROSSING * width))
    side = F.when(across, 2).when(F.col("x0") >= 0.9 * mid, 1).otherwise(0)
    rows = by_paper(lines).withColumn("_side", side)
    two = (F.count_if(F.col("_side") == 1).over(_page()) >= SIDE_LINES) & (F.count_if(F.col("_side") == 0).over(_page()) >= SIDE_LINES)
    above = F.count_if(F.col("_side") == 2).over(_page().orderBy("y0").rangeBetween(Window.unboundedPreceding, 0))
    own = F.row_number().over(Window.partitionBy("paper_id", "page", "_side").orderBy("y0", "line_seq")) - 1
    rows = rows.withColumns({"_two": two, "_zone": F.when(F.col("_side") == 2, own).otherwise(above)})
    key = [F.when(F.col("_two"), F.col("_zone")).otherwise(0), F.when(F.col("_two"), F.col("_side")).otherwise(0), F.when(F.col("_two"), F.col("y0")).otherwise(F.round("y0", 1)), F.col("x0"), F.col("line_seq")]
    rows = rows.withColumn("place", F.row_number().over(_page().orderBy(*key)))
    return rows.withColumn("column", F.when(F.col("_two") & (F.col("_side") == 1), 1).otherwise(0)).drop("_side", "_two", "_zone")


def merged_numbers(lines: DataFrame) -> DataFrame:
    """Lines in reading order, those that hold only a heading's number joined with their right neighbour.

    A pair consumes both its lines, so that of a chain of candidates every second one begins a pair:
    candidates that follow each other are an island, and the even places of an island merge.
    """
    w = _page().orderBy("place")
    nxt = {c: F.lead(c).over(w) for c in ("text", "x0", "x1", "y0", "y1")}
    level = F.abs(nxt["y0"] - F.col("y0")) < LEVEL_GAP
    gap = nxt["x0"] - F.col("x1")
    rows = lines.withColumns({"_can": F.coalesce(F.col("text").rlike(NUMBER_ONLY) & level & (gap >= 0) & (gap < SIDE_GAP), F.lit(False)), **{f"_{c}": v for c, v in nxt.items()}})
    rows = rows.withColumn("_island", F.count_if(~F.col("_can")).over(w))
    rows = rows.withColumn("_nth", F.count_if("_can").over(Window.partitionBy("paper_id", "page", "_island").orderBy("place")))
    rows = rows.withColumn("_merge", F.col("_can") & (F.col("_nth") % 2 == 1))
    rows = rows.withColumn("_gone", F.coalesce(F.lag("_merge").over(w), F.lit(False)))
    m = F.col("_merge")
    out = rows.where(~F.col("_gone")).withColumns(
        {
            "text": F.when(m, F.concat_ws(" ", "text", "_text")).otherwise(F.col("text")),
            "x1": F.when(m, F.col("_x1")).otherwise(F.col("x1")),
            "y0": F.when(m, F.least("y0", "_y0")).otherwise(F.col("y0")),
            "y1": F.when(m, F.greatest("y1", "_y1")).otherwise(F.col("y1")),
        }
    )
    return out.drop("_can", "_island", "_nth", "_merge", "_gone", *(f"_{c}" for c in nxt))


def numbered(lines: DataFrame) -> DataFrame:
    """line_seq counts a paper's lines in reading order."""
    return lines.withColumn("line_seq", F.row_number().over(Window.partitionBy("paper_id").orderBy("page", "place")).cast("int") - 1)


def _spans() -> Column:
    return F.sort_array(F.collect_list(F.struct("span_no", "text", "raised")))


def styled_lines(spans: DataFrame) -> DataFrame:
    """Lines of spans: text, marked_text (runs of raised numbers as ``⟨sup:1,2⟩``), size, mostly_bold, italic characters, box.

    Flags: 1 raised, 2 italic, 16 bold; a font's name tells bold and slanted ones too.
    """
    has = lambda bit: F.col("flags").bitwiseAND(bit) != 0
    font = F.lower("font")
    solid = F.trim("text") != ""
    n = F.when(solid, F.length("text")).otherwise(0)
    bold, italic = has(16) | font.contains("bold"), has(2) | font.contains("italic") | font.contains("oblique")
    rows = spans.withColumn("raised", has(1) & F.trim("text").rlike(RAISED))

    def step(acc: Column, x: Column) -> Column:
        t = F.trim(x["text"])
        begun = F.concat(acc["s"], F.when(acc["open"], ",").otherwise("⟨sup:"), t)
        plain = F.concat(acc["s"], F.when(acc["open"], "⟩").otherwise(""), x["text"])
        return F.struct(F.when(x["raised"], begun).otherwise(plain).alias("s"), x["raised"].alias("open"))

    start = F.struct(F.lit("").alias("s"), F.lit(False).alias("open"))
    marked = F.aggregate("_x", start, step, lambda a: F.trim(F.concat(a["s"], F.when(a["open"], "⟩").otherwise(""))))
    out = rows.groupBy("paper_id", "page", "line_seq").agg(
        _spans().alias("_x"),
        F.coalesce(F.max(F.when(solid, F.col("size"))), F.lit(0.0)).alias("size"),
        F.coalesce(F.sum(F.when(bold, n).otherwise(0)) > 0.6 * F.sum(n), F.lit(False)).alias("mostly_bold"),
        F.sum(F.when(italic, n).otherwise(0)).alias("italic_chars"),
        F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"),
    )
    text = F.trim(F.array_join(F.transform("_x", lambda x: x["text"]), ""))
    return out.select("paper_id", "page", "line_seq", text.alias("text"), marked.alias("marked_text"), "size", "mostly_bold", "italic_chars", "x0", "y0", "x1", "y1")


def upright(lines: DataFrame, dx: str = "dx") -> DataFrame:
    """Lines that aren't rotated: their direction is level."""
    return lines.where(F.abs(F.col(dx)) >= 0.99)


def flattened(lines: DataFrame, *by: str, text: str = "text") -> DataFrame:
    """The text of each group of lines (``by``) in the order of line_seq.

    A gap above PARAGRAPH_GAP of the group's median line height, on the same page and in the same
    column, begins a paragraph; else lines join with a space, or without the hyphen where a word goes on.
    """
    w = Window.partitionBy(*by).orderBy("line_seq")
    height = F.col("y1") - F.col("y0")
    med = F.coalesce(F.median(F.when(height > 0, height)).over(Window.partitionBy(*by)), F.lit(10.0))
    rows = by_paper(lines.select(*by, "line_seq", text, "page", "column", "y0", "y1")).withColumn("_h", med).where(F.trim(text) != "")
    prev = lambda c: F.lag(c).over(w)
    flow = (prev("page") == F.col("page")) & (prev("column") == F.col("column"))
    rows = rows.withColumns({"_gap": F.when(flow, F.col("y0") - prev("y1")), "_first": F.row_number().over(w) == 1, "_prev": prev(text)})
    broken = F.col("_prev").endswith("-") & F.substring(text, 1, 1).rlike(r"^\p{Ll}")
    lead = F.when(F.col("_first"), "").when(F.col("_gap") > PARAGRAPH_GAP * F.col("_h"), "\n\n").when(broken, "\b").otherwise(" ")
    rows = rows.withColumn("_piece", F.concat(lead, F.col(text)))
    whole = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("line_seq", "_piece"))), lambda x: x["_piece"]), "")
    # \b stands where a hyphen goes with the line's end.
    tidy = F.regexp_replace(F.regexp_replace(F.regexp_replace(whole, "-\b", ""), r"[ \t]+", " "), r" ?\n\n ?", "\n\n")
    return rows.groupBy(*by).agg(F.trim(tidy).alias(text))


def _front(lines: DataFrame) -> DataFrame:
    """The first FRONT_LINES lines of page 0 with the largest size among them."""
    w = Window.partitionBy("paper_id")
    rows = lines.where("page = 0").withColumn("_k", F.row_number().over(w.orderBy("line_seq"))).where(F.col("_k") <= FRONT_LINES)
    return rows.withColumn("_top", F.max("size").over(w))


def title_lines(lines: DataFrame) -> DataFrame:
    """Lines near the top of the first page in its largest font: paper_id, line_seq, text, nth."""
    rows = _front(lines).where((F.abs(F.col("size") - F.col("_top")) < 0.5) & (F.length("text") > 3))
    return rows.select("paper_id", "line_seq", "text", F.row_number().over(Window.partitionBy("paper_id").orderBy("line_seq")).alias("nth"))


def titles(lines: DataFrame) -> DataFrame:
    """paper_id, title: the first three title lines; a paper without one has none."""
    rows = title_lines(lines).where(F.col("nth") <= TITLE_LINES)
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("nth", "text"))), lambda x: x["text"]), " ")
    return rows.groupBy("paper_id").agg(F.trim(joined).alias("title"))


def authors(lines: DataFrame, headings: DataFrame) -> DataFrame:
    """paper_id, nth, author: names on lines before the first heading that look like nothing but names, at most MOST_AUTHORS of a paper."""
    first = headings.groupBy("paper_id").agg(F.min("line_seq").alias("_first"))
    rows = lines.join(first, "paper_id", "left").where(F.col("_first").isNull() | (F.col("line_seq") < F.col("_first")))
    rows = rows.join(title_lines(lines).select("paper_id", "line_seq"), ["paper_id", "line_seq"], "left_anti")
    t = F.col("text")
    rows = rows.where(~t.contains("@") & (F.length(t) >= 3) & ~t.rlike(AFFILIATION) & t.rlike(NAME_LINE))
    rows = rows.select("paper_id", "line_seq", F.posexplode(F.split(t, r",|\band\b")).alias("k", "part"))
    rows = rows.withColumn("author", F.trim(F.regexp_replace("part", NAME_MARKS, ""))).join(titles(lines), "paper_id", "left")
    rows = rows.where((F.col("author") != "") & (F.size(F.split("author", r"\s+")) <= 5) & (F.lower("author") != F.coalesce(F.lower("title"), F.lit(""))))
    rows = rows.withColumn("nth", F.row_number().over(Window.partitionBy("paper_id").orderBy("line_seq", "k")))
    return rows.where(F.col("nth") <= MOST_AUTHORS).select("paper_id", "nth", "author")


def abstract_text(text: Column) -> Column:
    """A text without the word Abstract before it."""
    return F.regexp_replace(text, ABSTRACT_LEAD, "")
