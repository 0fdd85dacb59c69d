"""Reading order, merged numbers, raised numbers, joined text and front matter against plain Python."""

from __future__ import annotations

import random

from quire.operators import layout, pages

LINE = "paper_id long, page int, line_seq int, text string, x0 double, x1 double, y0 double, y1 double, size double"


def read_by_hand(lines, width):
    """The order of one page's lines, zone by zone."""
    mid, across, left, right = width / 2, [], [], []
    for s in lines:
        w = s["x1"] - s["x0"]
        (across if w > 0.6 * width or (s["x0"] < mid < s["x1"] and w > 0.45 * width) else right if s["x0"] >= 0.9 * mid else left).append(s)
    if min(len(left), len(right)) < 5:
        return sorted(lines, key=lambda s: (round(s["y0"], 1), s["x0"], s["seq"]))
    across.sort(key=lambda s: (s["y0"], s["seq"]))
    out, low = [], float("-inf")
    for closing in [*across, None]:
        high = closing["y0"] if closing else float("inf")
        for side in (left, right):
            out += sorted((s for s in side if low <= s["y0"] < high), key=lambda s: (s["y0"], s["x0"], s["seq"]))
        out += [closing] if closing else []
        low = high
    return out


def frame(spark, rows):
    return spark.createDataFrame(rows, LINE)


def test_three_zones_are_read_one_after_the_other(spark):
    rows, want, rng = [], {}, random.Random(4)
    for paper in range(12):
        lines = []
        for i in range(40):
            kind = rng.choice(["left", "left", "right", "right", "full"] if paper % 4 else ["left", "left", "full", "full", "left"])
            x0 = {"left": 50, "right": 310, "full": 50}[kind] + rng.choice([0, 0, 8])
            y0 = float(rng.randrange(0, 20) * 12)
            lines.append({"seq": i, "x0": float(x0), "x1": float(x0 + (480 if kind == "full" else 230)), "y0": y0})
        rng.shuffle(lines)
        rows += [(paper, 0, s["seq"], f"t{s['seq']}", s["x0"], s["x1"], s["y0"], s["y0"] + 10, 10.0) for s in lines]
        want[paper] = [s["seq"] for s in read_by_hand(lines, 600.0)]
    got: dict = {}
    for r in pages.reading_order(frame(spark, rows)).orderBy("paper_id", "place").collect():
        got.setdefault(r["paper_id"], []).append(r["line_seq"])
    assert got == want


def test_a_chain_of_numbers_merges_in_pairs(spark):
    texts = [("1", 50, 56), ("2", 60, 66), ("IV.", 70, 80), ("3.1", 90, 99), ("End", 105, 300), ("B.", 320, 330), ("Far", 371, 400), ("4", 401, 405)]
    rows = [(1, 0, i, t, float(a), float(b), 20.0 + i % 2, 30.0, 10.0) for i, (t, a, b) in enumerate(texts)]
    lines = frame(spark, rows).withColumnRenamed("line_seq", "place").selectExpr("*", "place as line_seq", "0 as column")
    got = [(r["text"], r["x0"], r["x1"], r["y0"]) for r in pages.merged_numbers(lines).orderBy("place").collect()]
    assert [g[0] for g in got] == ["1 2", "IV. 3.1", "End", "B.", "Far", "4"]
    assert got[0][1:] == (50.0, 66.0, 20.0)


def test_raised_runs_and_styles(spark):
    cols = "paper_id long, page int, line_seq int, span_no int, text string, size double, font string, flags int, x0 double, y0 double, x1 double, y1 double"
    spans = [("Nets", 0), (" 1", 1), ("2,3", 1), (" and", 2), ("th", 1), ("4", 1)]
    rows = [(1, 0, 0, i, t, 9.0 + i, "Times", f, 1.0, 1.0, 2.0, 2.0) for i, (t, f) in enumerate(spans)] + [(1, 0, 1, 0, "Dark words", 10.0, "X-BoldItalic", 0, 1.0, 1.0, 2.0, 2.0), (1, 0, 2, 0, " ", 30.0, "T", 16, 0.0, 0.0, 1.0, 1.0)]
    a, b, c = pages.styled_lines(spark.createDataFrame(rows, cols)).orderBy("line_seq").collect()
    assert a["marked_text"] == "Nets⟨sup:1,2,3⟩ andth⟨sup:4⟩" and a["text"] == "Nets 12,3 andth4" and a["italic_chars"] == 4 and not a["mostly_bold"]
    assert b["mostly_bold"] and b["italic_chars"] == 10 and (c["text"], c["size"], c["mostly_bold"]) == ("", 0.0, False)


def test_flattened_joins_breaks_and_mends_words(spark):
    rows = [(1, 0, 0, "An optimi-", 0.0, 1.0, 0.0, 10.0, 10.0), (1, 0, 1, "zation  of", 0.0, 1.0, 12.0, 22.0, 10.0), (1, 0, 2, " ", 0.0, 1.0, 24.0, 34.0, 10.0), (1, 0, 3, "X-", 0.0, 1.0, 36.0, 46.0, 10.0), (1, 0, 4, "Rays", 0.0, 1.0, 48.0, 58.0, 10.0), (1, 1, 5, "next page", 0.0, 1.0, 900.0, 910.0, 10.0)]
    lines = frame(spark, rows).selectExpr("*", "0 as column")
    assert [r["text"] for r in pages.flattened(lines, "paper_id").collect()] == ["An optimization of\n\nX- Rays next page"]


def test_front_matter(spark):
    texts = ["A Title of", "Two Lines", "Ada Lovelace∗", "University of X", "a@b.c", "Grace Hopper1,2", "An Author And Far Too Many Names", "lower case", "Introduction", "Late Name"]
    rows = [(1, 0, i, t, 0.0, 1.0, float(i), i + 1.0, 14.0 if i < 2 else 11.0 if t == "Introduction" else 10.0) for i, t in enumerate(texts)]
    lines = frame(spark, rows)
    heads = layout.headings(lines)
    assert [(r["title"], r["kind"]) for r in heads.collect()] == [("Introduction", "body")]
    assert [r["title"] for r in pages.titles(lines).collect()] == ["A Title of Two Lines"]
    assert [r["author"] for r in pages.authors(lines, heads).orderBy("nth").collect()] == ["Ada Lovelace", "Grace Hopper"]


def test_page_numbers_count_in_the_bands_only(spark):
    rows = [(1, 0, 0, "7", 0.0, 1.0, 5.0, 9.0, 10.0), (1, 0, 1, "1998", 0.0, 1.0, 100.0, 109.0, 10.0), (1, 0, 2, "Page 7 of 9", 0.0, 1.0, 250.0, 259.0, 10.0), (1, 0, 3, "words", 0.0, 1.0, 120.0, 129.0, 10.0)]
    assert sorted(r["line_seq"] for r in layout.without_furniture(frame(spark, rows)).collect()) == [1, 3]


def test_lines_move_once(spark):
    """Order, merging and numbers of a paper's lines share one shuffle; there were two before."""
    lines = spark.createDataFrame([(p, 0, k, f"line {k}", 60.0, 500.0, 20.0 * k, 20.0 * k + 11) for p in range(3) for k in range(6)], "paper_id long, page int, line_seq int, text string, x0 double, x1 double, y0 double, y1 double")
    out = pages.numbered(pages.merged_numbers(pages.reading_order(lines)))
    assert [r["text"] for r in out.where("paper_id = 1").orderBy("line_seq").collect()] == [f"line {k}" for k in range(6)]
    assert out._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0].count("Exchange ") == 1
