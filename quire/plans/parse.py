"""From styled lines to sections, references and linked citations, for all papers at once.

Each step is a DataFrame of the one before, so that a corpus is one lazy plan keyed by paper.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators import entries, layout, links


@dataclass
class Parsed:
    lines: DataFrame
    sections: DataFrame
    entries: DataFrame
    references: DataFrame
    linked: DataFrame


def sections(lines: DataFrame, marks: DataFrame) -> DataFrame:
    """paper_id, section_id, title, kind, content of lines under their headings."""
    held = layout.section_lines(lines, marks).where("section_no > 0").join(lines.select("paper_id", "line_seq", "text"), ["paper_id", "line_seq"])
    number = F.row_number().over(Window.partitionBy("paper_id").orderBy("line_seq"))
    heads = marks.withColumn("section_no", number.cast("long")).select("paper_id", "section_no", "title", "kind")
    body = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("line_seq", "text"))), lambda x: x["text"]), " ")
    text = held.groupBy("paper_id", "section_no").agg(entries.joined(body).alias("content"))
    out = heads.join(text, ["paper_id", "section_no"], "left")
    return out.select("paper_id", F.concat(F.lit("sec_"), F.col("section_no").cast("string")).alias("section_id"), "title", "kind", F.coalesce("content", F.lit("")).alias("content"), "section_no")


def parse(lines: DataFrame) -> Parsed:
    """lines: paper_id, line_seq, page, text, x0, y0, size."""
    clean = layout.without_furniture(lines)
    marks = layout.headings(clean)
    parts = sections(clean, marks)
    listed = layout.section_lines(clean, marks).join(parts.where("kind = 'references'").select("paper_id", "section_no"), ["paper_id", "section_no"], "left_semi")
    listed = listed.join(clean.select("paper_id", "line_seq", "text"), ["paper_id", "line_seq"])
    raw = entries.numbered(listed)
    keyed = raw.withColumn("ref_id", F.concat(F.lit("ref_"), F.col("entry_no").cast("string")))
    fields = entries.parse(keyed.withColumn("ref_id", F.concat_ws("|", F.col("paper_id").cast("string"), "ref_id")))
    # Labels are a paper's own: the paper is part of the key that markers are matched with.
    refs = keyed.select("paper_id", F.col("entry_no").alias("ord"), F.col("label").cast("string").alias("label"), "ref_id")
    body = parts.where("kind <> 'references'")
    marks_of = links.number_markers(body, links.FAMILIES["bracket"]).where("numbers is not null")
    each = marks_of.select("paper_id", "section_id", "marker_no", F.posexplode("numbers").alias("k", "n")).withColumn("label", F.col("n").cast("string"))
    met = each.join(refs, ["paper_id", "label"], "left").groupBy("paper_id", "section_id", "marker_no")
    ids = F.transform(F.sort_array(F.collect_list(F.struct("k", "ref_id"))), lambda x: x["ref_id"])
    linked = met.agg((F.count("*") == F.count("ref_id")).alias("linked"), ids.alias("ref_ids"))
    return Parsed(clean, parts, raw, fields, linked)
