"""Regions, captions and floats on pages drawn by hand."""

from __future__ import annotations

import random

from quire.operators import regions

DRAWN = "paper_id long, page int, kind string, seq long, x0 double, y0 double, x1 double, y1 double, body string"
LINE = "paper_id long, page int, line_seq int, text string, x0 double, x1 double, y0 double, y1 double, column int"


def drawn(spark, boxes, kind="drawing"):
    return spark.createDataFrame([(p, 0, kind, i, *map(float, b), "") for i, (p, b) in enumerate(boxes)], DRAWN)


def merged_by_hand(boxes):
    out: list[list[float]] = []
    for b in sorted(boxes, key=lambda b: (b[1], b[0])):
        for o in out:
            if min(b[2], o[2]) - max(b[0], o[0]) > 0.8 * min(b[2] - b[0], o[2] - o[0]) and b[1] - o[3] < 14 and o[1] - b[3] < 14:
                o[:] = [min(b[0], o[0]), min(b[1], o[1]), max(b[2], o[2]), max(b[3], o[3])]
                break
        else:
            out.append(list(map(float, b)))
    return out


def test_first_fit_is_no_closure(spark):
    """The third panel joins the first box only; the two boxes then touch each other and stay apart."""
    boxes = [(0, 0, 200, 50), (300, 10, 520, 60), (10, 55, 210, 120), (290, 65, 500, 130), (0, 125, 520, 180)]
    got = [tuple(r["box"]) for r in regions.merged_boxes(drawn(spark, [(1, b) for b in boxes])).orderBy("box_no").collect()]
    assert got == [tuple(b) for b in merged_by_hand(boxes)] == [(0, 0, 520, 180), (290, 10, 520, 130)]


def test_merging_equals_the_greedy_pass(spark):
    rng = random.Random(9)
    by = {p: [(x := rng.randrange(0, 300), y := rng.randrange(0, 500), x + rng.randrange(90, 260), y + rng.randrange(24, 90)) for _ in range(14)] for p in range(40)}
    got: dict = {p: [] for p in by}
    for r in regions.merged_boxes(drawn(spark, [(p, b) for p, bs in by.items() for b in bs])).orderBy("paper_id", "box_no").collect():
        got[r["paper_id"]].append(list(r["box"]))
    assert got == {p: merged_by_hand(bs) for p, bs in by.items()}


def test_priority_and_size(spark):
    rows = [("image", (0, 0, 100, 100), ""), ("table", (50, 50, 200, 90), "a"), ("drawing", (190, 60, 300, 95), ""), ("image", (400, 0, 500, 30), ""), ("image", (450, 10, 560, 60), ""), ("drawing", (0, 300, 80, 400), ""), ("drawing", (0, 0, 600, 790), ""), ("table", (0, 500, 200, 510), "thin")]
    found = spark.createDataFrame([(1, 0, k, i, *map(float, b), t) for i, (k, b, t) in enumerate(rows)], DRAWN)
    got = [(r["region_no"], r["kind"], r["body"], tuple(r["box"])) for r in regions.accepted(found).orderBy("region_no").collect()]
    assert got == [(0, "table", "a", (50, 50, 200, 90)), (1, "figure", "", (400, 0, 500, 30))]


def lines(spark, rows):
    return spark.createDataFrame([(1, 0, i, t, float(x0), float(x0 + 200), float(y), float(y + 10), c) for i, (t, x0, y, c) in enumerate(rows)], LINE)


def test_captions_go_on_until_something_breaks(spark):
    rows = [("Figure 1. A", 0, 0, 0), ("goes on", 0, 12, 0), ("far", 0, 34, 0), ("Fig. 2: B", 0, 46, 0), ("other column", 300, 58, 1), ("Table 3. C", 300, 70, 1), ("claimed", 300, 82, 1), ("free again", 300, 94, 1), ("Table 4. D", 300, 106, 1), ("Figure 5. E", 300, 118, 1), ("above", 300, 100, 1)]
    claimed = spark.createDataFrame([(1, 6, 0)], "paper_id long, line_seq int, region_no int")
    got = sorted((r["cap_line"], r["line_seq"], r["nth"]) for r in regions.captions(lines(spark, rows), claimed).collect())
    assert got == [(0, 0, 0), (0, 1, 1), (3, 3, 0), (5, 5, 0), (8, 8, 0), (9, 9, 0)]


def test_floats_of_a_page(spark):
    """A box with text and a caption below, an empty box, an orphan caption that a later caption finds, and a claimed caption."""
    rows = [("Prose before.", 0, 0, 0), ("inside one", 10, 110, 0), ("inside two", 10, 130, 0), ("Table 1. Of the box", 0, 165, 0), ("and more", 0, 177, 0), ("Prose between.", 0, 300, 0), ("Figure 2. Alone", 0, 400, 0), ("Figure 3. Near it", 0, 430, 0), ("Prose after.", 0, 600, 0)]
    found = spark.createDataFrame([(1, 0, "drawing", 0, 0.0, 100.0, 220.0, 160.0, ""), (1, 0, "drawing", 1, 300.0, 100.0, 500.0, 160.0, ""), (1, 0, "image", 2, 300.0, 700.0, 500.0, 760.0, "")], DRAWN)
    fl, of = regions.floats(lines(spark, rows), found)
    got = [tuple(r) for r in fl.orderBy("float_no").select("kind", "caption", "text", "anchor_line").collect()]
    assert got == [("table", "Table 1. Of the box and more", "inside one\n\ninside two", 0), ("figure", "", "", None), ("figure", "Figure 3. Near it", "", 6)]
    assert sorted((r["float_no"], r["line_seq"]) for r in of.collect()) == [(0, 1), (0, 2), (0, 3), (0, 4), (2, 7)]
    assert [tuple(r)[1:] for r in regions.counts(fl).collect()] == [(1, 0, 2)]


def test_a_float_without_an_anchored_section_takes_the_last_one_begun(spark):
    fl = spark.createDataFrame([(1, 0, 2, None), (1, 1, 0, 5), (1, 2, 0, None)], "paper_id long, float_no int, page int, anchor_line int")
    at = spark.createDataFrame([(1, 5, 1)], "paper_id long, line_seq int, section_no long")
    ss = spark.createDataFrame([(1, 1, 1), (1, 2, 2), (1, 3, 3), (1, 4, None)], "paper_id long, section_no long, page_start int")
    assert sorted((r["float_no"], r["section_no"]) for r in regions.placed(fl, at, ss).collect()) == [(0, 2), (1, 1), (2, None)]
