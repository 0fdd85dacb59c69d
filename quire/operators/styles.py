"""Citation styles: labels in the text, numbers by first appearance, the order of bibliographies, and their entries."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import citations as C
from ..functions.text import once


@dataclass(frozen=True)
class Style:
    """How a style writes labels and entries."""

    author_year: bool
    #: In labels: between two names, before the last of more, and how many names are written out; what stands before the year and between works.
    two: str = " and "
    last: str = " and "
    names: int = 2
    before_year: str = ", "
    between: str = "; "
    #: In entries: whether names are inverted ('all', 'first', 'none'), given names shortened, what stands before the last, from how many names on only the first.
    inverted: str = "all"
    initials: bool = True
    entry_last: str = " and "
    et_al_from: int = 100


STYLES = {
    "apa": Style(True, two=" & ", entry_last=", & "),
    "chicago-author-date": Style(True, last=", and ", names=3, before_year=" ", inverted="first", initials=False, entry_last=", and "),
    "harvard-cite-them-right": Style(True, names=3, et_al_from=4),
    "ieee": Style(False, inverted="none", entry_last=", and ", et_al_from=7),
    "nature": Style(False, entry_last=" & ", et_al_from=6),
}


def _family(a: Column) -> Column:
    return F.trim(F.substring_index(a, ",", 1))


def _given(a: Column) -> Column:
    return F.when(F.contains(a, F.lit(",")), F.trim(F.regexp_replace(a, r"^[^,]*,", ""))).otherwise("")


def _short(given: Column) -> Column:
    """Initials of given names."""
    return F.array_join(F.transform(F.filter(F.split(given, r"[\s.]+"), lambda w: w != ""), lambda w: F.concat(F.substring(w, 1, 1), F.lit("."))), " ")


def tokens(sections: DataFrame) -> DataFrame:
    """paper_id, sec_no, nth, kind ('p', 't'), ids: the citation tokens of a paper's sections in order."""
    raw = F.regexp_extract_all("content", F.lit(C.TOKEN), F.lit(0))
    rows = sections.select("paper_id", "sec_no", F.posexplode(raw).alias("nth", "raw"))
    ids = F.filter(F.transform(F.split(F.regexp_extract("raw", C.TOKEN, 2), ","), lambda x: F.trim(x)), lambda x: x != "")
    return rows.select("paper_id", "sec_no", "nth", F.regexp_extract("raw", C.TOKEN, 1).alias("kind"), ids.alias("ids"))


def numbers(refs: DataFrame, sections: DataFrame) -> DataFrame:
    """paper_id, ref_id, number of each reference that can be rendered: by first appearance, then uncited ones as listed."""
    each = tokens(sections).select("paper_id", "sec_no", "nth", F.posexplode("ids").alias("k", "ref_id"))
    first = each.groupBy("paper_id", "ref_id").agg(F.min(F.struct("sec_no", "nth", "k")).alias("at"))
    rows = refs.where("renderable").select("paper_id", "ref_id", "ord").join(first, ["paper_id", "ref_id"], "left")
    order = Window.partitionBy("paper_id").orderBy(F.col("at").isNull(), "at", "ord")
    return rows.select("paper_id", "ref_id", F.row_number().over(order).alias("number"), F.col("at").isNotNull().alias("cited"))


def label_names(authors: Column, style: Style) -> Column:
    """The names of a label; a work without authors has none."""
    return once(F.transform(authors, _family), lambda fam: _few_names(fam, style))


def _few_names(fam: Column, style: Style) -> Column:
    n = F.size(fam)
    several = F.concat(F.array_join(F.slice(fam, 1, F.greatest(n - 1, F.lit(1))), ", "), F.lit(style.last), F.element_at(fam, -1))
    return (
        F.when(n == 0, "").when(n == 1, F.get(fam, F.lit(0))).when((n == 2), F.concat(F.get(fam, F.lit(0)), F.lit(style.two), F.get(fam, F.lit(1))))
        .when(n <= style.names, several).otherwise(F.concat(F.get(fam, F.lit(0)), F.lit(" et al.")))
    )


def labels(refs: DataFrame, sections: DataFrame, style_id: str) -> DataFrame:
    """paper_id, sec_no, nth, ids, label of each citation token.

    A group without any reference that can be rendered shows their labels in brackets. Narrative
    labels of author-year styles keep the years only, as the names stand in the text.
    """
    style = STYLES[style_id]
    each = tokens(sections).select("paper_id", "sec_no", "nth", "kind", "ids", F.posexplode("ids").alias("k", "ref_id"))
    known = refs.select("paper_id", "ref_id", "renderable", F.coalesce("label", "ref_id").alias("label"), "authors", "year", "title").join(numbers(refs, sections).select("paper_id", "ref_id", "number"), ["paper_id", "ref_id"], "left")
    rows = each.join(known, ["paper_id", "ref_id"], "left")
    year = F.coalesce(F.col("year").cast("string"), F.lit("n.d."))
    if style.author_year:
        names = label_names(F.col("authors"), style)
        piece = F.concat(F.when(names == "", F.coalesce("title", F.lit(""))).otherwise(names), F.lit(style.before_year), year)
    else:
        piece = F.col("number").cast("string")
    group = rows.groupBy("paper_id", "sec_no", "nth", "kind", "ids").agg(
        F.array_sort(F.collect_list(F.when(F.col("renderable"), F.struct("k", piece.alias("p"), F.col("year").cast("string").alias("y"))))).alias("used"),
        F.array_sort(F.collect_list(F.when(F.col("label").isNotNull(), F.struct("k", "label")))).alias("all"),
    )
    parts = F.transform("used", lambda x: x["p"])
    if style.author_year:
        years = F.filter(F.transform("used", lambda x: x["y"]), lambda y: y.isNotNull())
        whole = F.concat(F.lit("("), F.array_join(parts, style.between), F.lit(")"))
        label = F.when((F.col("kind") == "t") & (F.size(years) > 0), F.concat(F.lit("("), F.array_join(years, ", "), F.lit(")"))).otherwise(whole)
    elif style_id == "ieee":
        label = F.array_join(F.transform(parts, lambda p: F.concat(F.lit("["), p, F.lit("]"))), ", ")
    else:
        label = F.array_join(parts, ",")
    raw = F.concat(F.lit("["), F.array_join(F.transform("all", lambda x: x["label"]), ","), F.lit("]"))
    return group.select("paper_id", "sec_no", "nth", "ids", F.when(F.size("used") == 0, raw).otherwise(label).alias("label"))


def entry_names(authors: Column, style: Style) -> Column:
    """The names of an entry."""

    def name(a: Column, i: Column) -> Column:
        def order(given: Column) -> Column:
            back = F.when(given == "", _family(a)).otherwise(F.concat_ws(", ", _family(a), given))
            front = F.when(given == "", _family(a)).otherwise(F.concat_ws(" ", given, _family(a)))
            return back if style.inverted == "all" else front if style.inverted == "none" else F.when(i == 0, back).otherwise(front)

        return once(_short(_given(a)) if style.initials else _given(a), order)

    def joined(each: Column) -> Column:
        n = F.size(each)
        last = style.entry_last if style.entry_last not in (", and ",) or style.inverted == "first" else " and "
        two = F.concat(F.get(each, F.lit(0)), F.lit(last), F.get(each, F.lit(1)))
        more = F.concat(F.array_join(F.slice(each, 1, F.greatest(n - 1, F.lit(1))), ", "), F.lit(style.entry_last), F.element_at(each, -1))
        return F.when(n == 0, "").when(n >= style.et_al_from, F.concat(F.get(each, F.lit(0)), F.lit(" et al."))).when(n == 1, F.get(each, F.lit(0))).when(n == 2, two).otherwise(more)

    # Where only the first of many is printed, the others aren't written out.
    shown = F.slice(authors, 1, F.lit(style.et_al_from)) if style.et_al_from < 100 else authors
    return once(F.transform(shown, name), joined)


def _after(lead: str, c: str) -> Column:
    """A field with what stands before it, or nothing where the field is empty."""
    return F.when(F.coalesce(F.col(c), F.lit("")) != "", F.concat(F.lit(lead), F.col(c))).otherwise("")


def entry_text(style_id: str) -> Column:
    """An entry from authors, year, title, container, volume, pages, doi; numbers of numeric styles come before it."""
    return once(entry_names(F.col("authors"), STYLES[style_id]), lambda names: _entry(names, style_id))


def _entry(names: Column, style_id: str) -> Column:
    stop = F.when(names.endswith("."), names).when(names == "", "").otherwise(F.concat(names, F.lit(".")))
    year = F.coalesce(F.col("year").cast("string"), F.lit("n.d."))
    title = F.coalesce("title", F.lit(""))
    if style_id == "apa":
        parts = [names, F.lit(" ("), year, F.lit("). "), title, F.lit("."), _after(" ", "container"), _after(", ", "volume"), _after(", ", "pages"), _after(". https://doi.org/", "doi")]
    elif style_id == "chicago-author-date":
        parts = [stop, F.lit(" "), year, F.lit(". “"), title, F.lit(".”"), _after(" ", "container"), _after(" ", "volume"), _after(": ", "pages"), F.lit("."), _after(" https://doi.org/", "doi")]
    elif style_id == "harvard-cite-them-right":
        parts = [names, F.lit(" ("), year, F.lit(") ‘"), title, F.lit("’"), _after(", ", "container"), _after(", ", "volume"), _after(", pp. ", "pages"), F.lit(".")]
    elif style_id == "ieee":
        parts = [names, F.lit(", “"), title, F.lit(",”"), _after(" ", "container"), _after(", vol. ", "volume"), _after(", pp. ", "pages"), F.lit(", "), year, F.lit(".")]
    else:
        parts = [stop, F.lit(" "), title, F.lit("."), _after(" ", "container"), _after(" ", "volume"), _after(", ", "pages"), F.lit(" ("), year, F.lit(").")]
    return F.trim(F.concat(*parts))


def bibliography(refs: DataFrame, sections: DataFrame, style_id: str) -> DataFrame:
    """paper_id, place (from 1), ref_id, number (numeric styles), text, raw: the entries of each paper in the style's order.

    Author-year styles sort by family (none last), year (none last) and title, numeric ones as numbered.
    References that can't be rendered follow as listed, in their own words.
    """
    style = STYLES[style_id]
    rows = refs.join(numbers(refs, sections).select("paper_id", "ref_id", "number"), ["paper_id", "ref_id"], "left")
    family = F.lower(_family(F.get("authors", F.lit(0))))
    key = [F.col("number").isNull()]
    if style.author_year:
        key += [F.when(F.col("number").isNotNull(), F.coalesce(F.nullif(family, F.lit("")), F.lit("￿"))), F.when(F.col("number").isNotNull(), F.coalesce("year", F.lit(9999))), F.when(F.col("number").isNotNull(), F.lower("title"))]
    else:
        key += [F.col("number")]
    place = F.row_number().over(Window.partitionBy("paper_id").orderBy(*key, "ord"))
    number = F.lit(None).cast("int") if style.author_year else F.col("number")
    lead = F.lit("") if style.author_year else F.concat(F.lit("["), number.cast("string"), F.lit("]")) if style_id == "ieee" else F.concat(number.cast("string"), F.lit("."))
    text = F.when(F.col("number").isNull(), F.col("raw_text")).otherwise(F.concat(lead, entry_text(style_id)))
    return rows.select("paper_id", place.alias("place"), "ref_id", number.alias("number"), text.alias("text"), F.col("number").isNull().alias("raw"))


def natbib_label(authors: Column, year: Column, title: Column) -> Column:
    """``Smith(2020)``, ``Smith and Doe(2020)``, ``Smith et al.(2020)``; without authors the title's beginning."""
    fam = F.transform(authors, _family)
    n = F.size(fam)
    names = F.when(n == 0, F.substring(title, 1, 20)).when(n == 1, F.get(fam, F.lit(0))).when(n == 2, F.concat(F.get(fam, F.lit(0)), F.lit(" and "), F.get(fam, F.lit(1)))).otherwise(F.concat(F.get(fam, F.lit(0)), F.lit(" et al.")))
    return F.concat(names, F.lit("("), F.coalesce(year.cast("string"), F.lit("n.d.")), F.lit(")"))


def rendered(sections: DataFrame, refs: DataFrame, style_id: str) -> DataFrame:
    """sections with their tokens as labels."""
    by = labels(refs, sections, style_id).groupBy("paper_id", "sec_no").agg(F.map_from_entries(F.collect_list(F.struct("nth", "label"))).alias("_labels"))
    rows = sections.join(by, ["paper_id", "sec_no"], "left")
    done = F.transform(F.split("content", C.TOKEN), lambda p, i: F.concat(p, F.coalesce(F.try_element_at("_labels", i), F.lit(""))))
    return rows.withColumn("content", F.array_join(done, "")).drop("_labels")


def samples(refs: DataFrame, sections: DataFrame, style_id: str, most: int = 2) -> DataFrame:
    """What a style makes of a paper's own works: paper_id, parenthetical, narrative, grouped (null: one work only), entries.

    Of the first ``most`` references that can be rendered, cited ones first.
    """
    picked = numbers(refs, sections).where(F.col("number") <= most).select("paper_id", "ref_id", F.col("number").alias("_n"))
    own = refs.join(picked, ["paper_id", "ref_id"]).withColumn("ord", F.col("_n"))
    ids = own.groupBy("paper_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("_n", "ref_id"))), lambda x: x["ref_id"]).alias("ids"))
    one, every = F.get("ids", F.lit(0)), F.array_join("ids", ",")
    text = F.concat(F.lit("[[citep:"), one, F.lit("]] [[citet:"), one, F.lit("]] [[citep:"), every, F.lit("]]"))
    page = ids.select("paper_id", F.lit(0).alias("sec_no"), text.alias("content"), F.size("ids").alias("_k"))
    said = labels(own, page, style_id).groupBy("paper_id").agg(*(F.max(F.when(F.col("nth") == i, F.col("label"))).alias(c) for i, c in enumerate(("parenthetical", "narrative", "grouped"))))
    entries = bibliography(own, page, style_id).groupBy("paper_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("place", "text"))), lambda x: x["text"]).alias("entries"))
    rows = said.join(entries, "paper_id").join(page.select("paper_id", "_k"), "paper_id")
    return rows.select("paper_id", "parenthetical", "narrative", F.when(F.col("_k") > 1, F.col("grouped")).alias("grouped"), "entries")
