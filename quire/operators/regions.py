"""Figures, tables and boxes: rectangles of a page become regions, regions claim lines, captions find regions, and each float finds its section."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.kept import kept
from . import pages

#: What is too small for a region, or so large that it frames the page; how near stacked panels are; what a caption begins with, how its lines follow, how near its region is.
LEAST_WIDTH, LEAST_HEIGHT, WHOLE_PAGE = 90.0, 24.0, 0.9
PANEL_GAP, ALIGNED = 14.0, 0.8
CAPTION = r"(?i)^(Figure|Fig\.|Table)\s+(\d+)\s*[.:]"
LINE_GAP, CAPTION_GAP = 1.2, 40.0
#: Regions of an earlier kind come first.
KINDS = ["table", "box", "figure"]
BOX = ("x0", "y0", "x1", "y1")
_RECT = "array<struct<x0:double,y0:double,x1:double,y1:double>>"


def _rect(x: Column) -> Column:
    return F.struct(*(x[c].alias(c) for c in BOX))


def _big(x: Column) -> Column:
    return (x["x1"] - x["x0"] >= LEAST_WIDTH) & (x["y1"] - x["y0"] >= LEAST_HEIGHT)


def _sorted_drawings(drawings: DataFrame) -> DataFrame:
    """One row a page: its drawings of any use, by height, then from the left."""
    r = F.struct("y0", "x0", "seq", "x1", "y1")
    return drawings.groupBy("paper_id", "page").agg(F.sort_array(F.collect_list(r)).alias("d"))


def _joins(a: Column, b: Column) -> Column:
    """Whether two rectangles stand over each other, nearly as wide, with hardly a gap."""
    overlap = F.least(a["x1"], b["x1"]) - F.greatest(a["x0"], b["x0"])
    return (overlap > ALIGNED * F.least(a["x1"] - a["x0"], b["x1"] - b["x0"])) & (a["y0"] - b["y1"] < PANEL_GAP) & (b["y0"] - a["y1"] < PANEL_GAP)


def merged_boxes(drawings: DataFrame, page_area: float = 600.0 * 800.0) -> DataFrame:
    """paper_id, page, box_no (from 0), box: drawings, each united with the first box so far that it stands on, else a box of its own.

    Which box is first depends on all before it, so a page's drawings, sorted, are folded over an
    array of boxes. It is no transitive closure: boxes that grow together later stay apart.
    """
    usable = drawings.where(_big(F.struct(*BOX)) & ((F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0")) < WHOLE_PAGE * page_area))

    def step(acc: Column, r: Column) -> Column:
        hits = F.transform(acc, lambda o: _joins(r, o))
        at = F.array_position(hits, True)
        united = F.transform(acc, lambda o, i: F.when(i + 1 == at, F.struct(F.least(o["x0"], r["x0"]).alias("x0"), F.least(o["y0"], r["y0"]).alias("y0"), F.greatest(o["x1"], r["x1"]).alias("x1"), F.greatest(o["y1"], r["y1"]).alias("y1"))).otherwise(o))
        return F.when(at > 0, united).otherwise(F.concat(acc, F.array(_rect(r))))

    boxes = F.aggregate("d", F.array().cast(_RECT), step)
    return _sorted_drawings(usable).select("paper_id", "page", F.posexplode(boxes).alias("box_no", "box"))


def accepted(found: DataFrame, page_area: float = 600.0 * 800.0) -> DataFrame:
    """Regions of each page in order of acceptance: paper_id, page, region_no (from 0), kind, box, body.

    found: paper_id, page, kind ('table', 'drawing', 'image'), seq, box columns, body (a table's cells).
    Tables are accepted as they are, then merged boxes and then images that overlap nothing accepted before.
    """
    tables = found.where((F.col("kind") == "table") & _big(F.struct(*BOX))).select("paper_id", "page", F.lit(0).alias("rank"), "seq", F.struct(*BOX).alias("box"), "body")
    boxes = merged_boxes(found.where("kind = 'drawing'"), page_area).select("paper_id", "page", F.lit(1).alias("rank"), F.col("box_no").cast("long").alias("seq"), "box", F.lit("").alias("body"))
    images = found.where((F.col("kind") == "image") & _big(F.struct(*BOX))).select("paper_id", "page", F.lit(2).alias("rank"), "seq", F.struct(*BOX).alias("box"), F.lit("").alias("body"))
    rows = tables.unionAll(boxes).unionAll(images).groupBy("paper_id", "page").agg(F.sort_array(F.collect_list(F.struct("rank", "seq", "box", "body"))).alias("x"))

    def step(acc: Column, r: Column) -> Column:
        b = r["box"]
        met = F.exists(acc, lambda o: (o["box"]["x0"] < b["x1"]) & (b["x0"] < o["box"]["x1"]) & (o["box"]["y0"] < b["y1"]) & (b["y0"] < o["box"]["y1"]))
        return F.when((r["rank"] > 0) & met, acc).otherwise(F.concat(acc, F.array(r)))

    start = F.array().cast("array<struct<rank:int,seq:bigint,box:struct<x0:double,y0:double,x1:double,y1:double>,body:string>>")
    out = rows.select("paper_id", "page", F.posexplode(F.aggregate("x", start, step)).alias("region_no", "r"))
    kind = F.element_at(F.array(*(F.lit(k) for k in KINDS)), F.col("r.rank") + 1)
    return out.select("paper_id", "page", "region_no", kind.alias("kind"), "r.box", F.coalesce("r.body", F.lit("")).alias("body"))


def _claimed(lines: DataFrame, regions: DataFrame) -> DataFrame:
    """lines with region_no: the first region of their page that holds their centre, else null. A page's regions come to its lines as one array."""
    cx, cy = (F.col("x0") + F.col("x1")) / 2, (F.col("y0") + F.col("y1")) / 2
    of_page = regions.groupBy("paper_id", "page").agg(F.sort_array(F.collect_list(F.struct("region_no", "box"))).alias("_regions"))
    rows = pages.by_paper(lines).join(pages.by_paper(of_page), ["paper_id", "page"], "left")
    holds = F.filter("_regions", lambda r: cx.between(r["box"]["x0"], r["box"]["x1"]) & cy.between(r["box"]["y0"], r["box"]["y1"]))
    return rows.withColumn("region_no", F.get(holds, F.lit(0))["region_no"]).drop("_regions")


def claims(lines: DataFrame, regions: DataFrame) -> DataFrame:
    """paper_id, line_seq, region_no: lines whose centre lies in a region of their page, each claimed by the first."""
    return _claimed(lines.select("paper_id", "page", "line_seq", *BOX), regions).where("region_no is not null").select("paper_id", "line_seq", "region_no")


def _captioned(rows: DataFrame) -> DataFrame:
    """rows (lines with region_no) with cap_line and nth where they belong to a caption."""
    w = Window.partitionBy("paper_id", "page").orderBy("line_seq")
    free = F.col("region_no").isNull()
    rows = rows.withColumns({"_begin": free & F.col("text").rlike(CAPTION), "_free": free})
    # Which caption a line would belong to, were there no break between.
    rows = rows.withColumns({"_cap": F.last(F.when(F.col("_begin"), F.struct("line_seq", "column", (F.col("y1") - F.col("y0")).alias("height"))), ignorenulls=True).over(w), "_gap": F.col("y0") - F.lag("y1").over(w)})
    goes_on = F.col("_free") & ~F.col("text").rlike(CAPTION) & (F.col("column") == F.col("_cap.column")) & (F.col("_gap") >= 0) & (F.col("_gap") < LINE_GAP * F.col("_cap.height"))
    rows = rows.withColumns({"_break": ~F.col("_begin") & ~F.coalesce(goes_on, F.lit(False)), "_line": F.col("_cap.line_seq")})
    own = Window.partitionBy("paper_id", "page", "_line").orderBy("line_seq")
    rows = rows.withColumns({"_broken": F.count_if("_break").over(own), "nth": F.row_number().over(own) - 1})
    held = F.col("_line").isNotNull() & (F.col("_broken") == 0)
    return rows.withColumns({"cap_line": F.when(held, F.col("_line")), "nth": F.when(held, F.col("nth"))}).drop("_begin", "_free", "_cap", "_gap", "_break", "_line", "_broken")


def captions(lines: DataFrame, claimed: DataFrame) -> DataFrame:
    """Caption lines: paper_id, page, cap_line (where the caption begins), line_seq, nth (from 0).

    A caption goes on while the next line of the page is unclaimed, begins no caption, stands in the same
    column and follows closely. Runs of lines between breaks are islands; a caption is the head of one.
    """
    rows = pages.by_paper(lines).join(pages.by_paper(claimed.select("paper_id", "line_seq", "region_no")), ["paper_id", "line_seq"], "left")
    return _captioned(rows).where("cap_line is not null").select("paper_id", "page", "cap_line", "line_seq", "nth")


_FLOAT = "struct<region_no:int,kind:string,body:string,x0:double,y0:double,x1:double,y1:double,cap_line:int>"


def attached(ends: DataFrame, regions: DataFrame) -> DataFrame:
    """Floats of each page in order: paper_id, page, nth (from 0), region_no (null: a caption alone), kind, body, cap_line (null: no caption).

    A caption goes to the nearest float above or below that overlaps its first line sideways, less than
    CAPTION_GAP away, and gives it its kind; ties go to the first. Where none is near, it is a float of
    its own, which a later caption may find near: so a page's captions are folded over its floats.
    ends: the lines of captions.
    """
    heads = ends.groupBy("paper_id", "page", "cap_line").agg(*(F.min_by(c, "nth").alias(c) for c in ("text", *BOX)), F.max_by("y1", "nth").alias("bottom"))
    kind = F.when(F.lower(F.regexp_extract("text", CAPTION, 1)).startswith("t"), "table").otherwise("figure")
    by_page = heads.groupBy("paper_id", "page").agg(F.sort_array(F.collect_list(F.struct(F.col("cap_line").cast("int").alias("cap_line"), kind.alias("kind"), *BOX, "bottom"))).alias("caps"))
    first = F.struct(F.col("region_no").cast("int").alias("region_no"), "kind", "body", "box.x0", "box.y0", "box.x1", "box.y1", F.lit(None).cast("int").alias("cap_line"))
    placed_ = regions.groupBy("paper_id", "page").agg(F.sort_array(F.collect_list(first)).alias("regions"))
    rows = placed_.join(by_page, ["paper_id", "page"], "full")

    def step(acc: Column, c: Column) -> Column:
        gap = lambda o: F.least(F.abs(c["y0"] - o["y1"]), F.abs(o["y0"] - c["bottom"]))
        near = lambda o: (F.least(c["x1"], o["x1"]) - F.greatest(c["x0"], o["x0"]) > 0) & (gap(o) < CAPTION_GAP)
        at = F.array_min(F.filter(F.transform(acc, lambda o, i: F.when(near(o), F.struct(gap(o).alias("gap"), i.alias("i")))), lambda g: g.isNotNull()))["i"]
        named = F.transform(acc, lambda o, i: F.when(i == at, o.withField("cap_line", c["cap_line"]).withField("kind", c["kind"])).otherwise(o))
        own = F.struct(F.lit(None).cast("int").alias("region_no"), c["kind"].alias("kind"), F.lit("").alias("body"), *(c[b].alias(b) for b in BOX), c["cap_line"].alias("cap_line")).cast(_FLOAT)
        return F.when(at.isNotNull(), named).otherwise(F.concat(acc, F.array(own)))

    start = F.coalesce("regions", F.array().cast(f"array<{_FLOAT}>"))
    whole = F.aggregate(F.coalesce("caps", F.array()), start.cast(f"array<{_FLOAT}>"), step)
    return rows.select("paper_id", "page", F.posexplode(whole).alias("nth", "r")).select("paper_id", "page", "nth", "r.region_no", "r.kind", "r.body", "r.cap_line")


def floats(lines: DataFrame, found: DataFrame, page_area: float = 600.0 * 800.0) -> tuple[DataFrame, DataFrame]:
    """(floats, their lines) of whole papers. lines: in reading order with line_seq, column and boxes; found: as accepted() takes it.

    Floats: paper_id, float_no (from 0), kind, page, caption, text, anchor_line (the last prose line
    before the float's first line; null where there is none). Boxes without lines or cells are
    decoration.
    """
    # Each of these serves several of the steps below. Lines move once, and are written with what claims them; floats take theirs from there.
    regions = kept(accepted(found, page_area), "regions")
    lines = kept(_captioned(_claimed(lines.select("paper_id", "line_seq", "page", "column", "text", *BOX), regions)), "lines")
    held, cap = lines.where("region_no is not null").drop("cap_line", "nth"), lines.where("cap_line is not null").drop("region_no")
    n = held.groupBy("paper_id", "page", "region_no").agg(F.count("*").alias("n_lines"))
    regions = regions.join(n, ["paper_id", "page", "region_no"], "left").where("n_lines > 0 or body <> '' or kind = 'figure'").drop("n_lines")
    every = kept(attached(cap, regions), "floats").withColumn("float_no", (F.row_number().over(Window.partitionBy("paper_id").orderBy("page", "nth")) - 1).cast("int"))
    columns = ["paper_id", "line_seq", "page", "column", "text", *BOX, "float_no"]
    inner = held.join(every.where("region_no is not null").select("paper_id", "page", "region_no", "float_no"), ["paper_id", "page", "region_no"]).select(*columns, F.lit(False).alias("is_caption"))
    outer = cap.join(every.where("cap_line is not null").select("paper_id", "cap_line", "float_no"), ["paper_id", "cap_line"]).select(*columns, F.lit(True).alias("is_caption"))
    of_floats = kept(inner.unionAll(outer), "float-lines")
    # The text of a float's lines runs by height, its caption in reading order.
    styled = pages.by_paper(of_floats).withColumn("_seq", F.row_number().over(Window.partitionBy("paper_id", "float_no", "is_caption").orderBy(F.when(F.col("is_caption"), F.col("line_seq")), "page", "y0", "x0", "line_seq")))
    text = pages.flattened(styled.drop("line_seq").withColumnRenamed("_seq", "line_seq"), "paper_id", "float_no", "is_caption")
    # One pass down each paper: what was the last line outside floats when a float's first line came.
    w = Window.partitionBy("paper_id").orderBy("line_seq").rowsBetween(Window.unboundedPreceding, -1)
    first = of_floats.groupBy("paper_id", "line_seq").agg(F.min("float_no").alias("float_no"))
    seen = lines.select("paper_id", "line_seq").join(first, ["paper_id", "line_seq"], "left").withColumn("anchor", F.last(F.when(F.col("float_no").isNull(), F.col("line_seq")), ignorenulls=True).over(w))
    anchors = seen.where("float_no is not null").groupBy("paper_id", "float_no").agg(F.min_by(F.struct("anchor"), "line_seq").alias("a"))
    keys = ["paper_id", "float_no"]
    said = lambda is_caption: F.max(F.when(F.col("is_caption") == is_caption, F.col("text")))
    text = text.groupBy(*keys).agg(said(True).alias("caption"), said(False).alias("text"))
    out = every.join(text, keys, "left").join(anchors, keys, "left")
    whole = F.when(F.col("body") != "", F.col("body")).otherwise(F.coalesce("text", F.lit("")))
    return out.select("paper_id", "float_no", "kind", "page", F.coalesce("caption", F.lit("")).alias("caption"), whole.alias("text"), F.col("a.anchor").alias("anchor_line")), of_floats


def placed(floats_: DataFrame, section_of_line: DataFrame, sections: DataFrame) -> DataFrame:
    """floats with section_no: that of the anchor line, else the last section that begins on the float's page or before (null: none).

    section_of_line: paper_id, line_seq, section_no; sections: paper_id, section_no, page_start.
    """
    at = section_of_line.select("paper_id", F.col("line_seq").alias("anchor_line"), F.col("section_no").alias("_near"))
    rows = floats_.join(at, ["paper_id", "anchor_line"], "left")
    late = rows.where("_near is null").select("paper_id", "float_no", "page").join(sections.select("paper_id", "section_no", "page_start"), "paper_id").where("page_start <= page")
    last = late.groupBy("paper_id", "float_no").agg(F.max("section_no").alias("_late"))
    return rows.join(last, ["paper_id", "float_no"], "left").withColumn("section_no", F.coalesce("_near", "_late")).drop("_near", "_late")


def counts(floats_: DataFrame) -> DataFrame:
    """Floats of each kind of a paper."""
    return floats_.groupBy("paper_id").agg(*(F.count_if(F.col("kind") == k).alias(f"n_{k}") for k in KINDS))
