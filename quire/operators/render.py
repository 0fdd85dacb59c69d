"""Exports: TeX and Markdown text, parts of paragraphs, catalogues."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import citations as C
from ..functions import text as T


def tex(tokens: DataFrame, text: str = "after_text") -> DataFrame:
    """Prose escaped, tokens turned into \\citep and \\citet with their ids untouched."""
    prose = F.split(text, C.TOKEN)
    kinds, ids = F.regexp_extract_all(text, F.lit(C.TOKEN), F.lit(1)), F.regexp_extract_all(text, F.lit(C.TOKEN), F.lit(2))
    cites = F.zip_with(kinds, ids, lambda k, i: F.concat(F.lit("\\cite"), k, F.lit("{"), i, F.lit("}")))
    out = F.array_join(F.zip_with(prose, cites, lambda p, c: F.concat(T.tex_escape(p), F.coalesce(c, F.lit("")))), "")
    return tokens.select("paper_id", out.alias("tex"))


def markdown(sections: DataFrame, marks: str = "section_id") -> DataFrame:
    """One Markdown text per paper: sections by id, each under a heading."""
    part = F.concat(F.lit("## "), F.col(marks), F.lit("\n\n"), F.col("content"))
    rows = sections.groupBy("paper_id").agg(F.sort_array(F.collect_list(F.struct(marks, part.alias("md")))).alias("x"))
    return rows.select("paper_id", F.array_join(F.transform("x", lambda x: x["md"]), "\n\n").alias("markdown"))


def paragraph_parts(tokens: DataFrame, text: str = "after_text") -> DataFrame:
    """Alternating text and citation parts, in order."""
    prose, ids = F.split(text, C.TOKEN), F.regexp_extract_all(text, F.lit(C.TOKEN), F.lit(2))
    both = F.flatten(F.zip_with(prose, ids, lambda p, i: F.array(F.struct(F.lit("text").alias("kind"), p.alias("value")), F.struct(F.lit("cite").alias("kind"), i.alias("value")))))
    rows = tokens.select("paper_id", F.posexplode(F.filter(both, lambda x: x["value"].isNotNull())).alias("part_no", "x"))
    return rows.select("paper_id", "part_no", "x.kind", "x.value")


def catalogue(sections: DataFrame) -> DataFrame:
    """A row per paper with sizes, as a list of documents would show."""
    return sections.groupBy("paper_id").agg(F.count("*").alias("n_sections"), F.sum(F.length("content")).alias("n_chars"), F.max("section_id").alias("last_section"))
