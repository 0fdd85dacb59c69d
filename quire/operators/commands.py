"""Plans of edit commands: a model's answer as JSON becomes typed, checked operations, or one error that says why not."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .edits import MOST_OPERATIONS

#: Lengths of texts, and the bounds of how many new references an operation may bring.
PLAN_CHARS, TOPIC_CHARS, INSTRUCTION_CHARS = 800, 400, 600
LEAST_NEW, MOST_NEW, USUAL_NEW = 1, 5, 3


def parsed_json(text: Column) -> Column:
    """The JSON of an answer as a variant: all of it, without fences, else its outermost braces, else brackets; null where none parses."""
    bare = F.regexp_replace(F.regexp_replace(F.trim(text), r"^```(?:json)?\s*", ""), r"\s*```\s*$", "")
    inner = lambda a, b: F.nullif(F.regexp_extract(bare, rf"(?s)\{a}.*\{b}", 0), F.lit(""))
    return F.coalesce(*(F.try_parse_json(t) for t in (bare, inner("{", "}"), inner("[", "]"))))


def _shape(v: Column) -> Column:
    """What a variant is: object, array, null, or another."""
    s = F.schema_of_variant(v)
    return F.when(v.isNull() | (s == "VOID"), "null").when(s.startswith("OBJECT"), "object").when(s.startswith("ARRAY"), "array").otherwise("other")


def _field(v: Column, name: str, kind: str = "string") -> Column:
    return F.try_variant_get(v, f"$.{name}", kind)


def operations(answers: DataFrame, sections: DataFrame) -> DataFrame:
    """Every operation of each answer, with an error where it isn't one: command_id, op_no, op, section_id, topic, max_new, instruction, error.

    answers: command_id, paper_id, answer. Only the first MOST_OPERATIONS count.
    """
    rows = answers.select("command_id", "paper_id", parsed_json(F.col("answer")).alias("v"))
    rows = rows.where(_shape(F.col("v")) == "object").withColumn("ops", F.try_variant_get("v", "$.operations", "array<variant>"))
    rows = rows.select("command_id", "paper_id", F.posexplode(F.slice("ops", 1, MOST_OPERATIONS)).alias("op_no", "o"))
    known = sections.select("paper_id", "section_id", F.lit(True).alias("_known")).distinct()
    rows = rows.withColumns({"op": _field(F.col("o"), "op"), "section_id": _field(F.col("o"), "section_id"), "instruction": F.trim(F.coalesce(_field(F.col("o"), "instruction"), F.lit("")))})
    rows = rows.join(known, ["paper_id", "section_id"], "left")
    asked = F.try_variant_get("o", "$.max_new", "variant")
    number = F.when(asked.isNull(), USUAL_NEW).otherwise(F.floor(_field(F.col("o"), "max_new", "double")).cast("int"))
    error = (
        F.when(_shape(F.col("o")) != "object", "malformed operation").when(F.col("_known").isNull(), "unknown section")
        .when((F.col("op") == "find_citations") & number.isNull(), "malformed operation")
        .when((F.col("op") == "rewrite_section") & (F.col("instruction") == ""), "no instruction")
        .when(~F.coalesce(F.col("op").isin("find_citations", "rewrite_section"), F.lit(False)), "unknown operation")
    )
    find, rewrite = F.col("op") == "find_citations", F.col("op") == "rewrite_section"
    return rows.select(
        "command_id", "op_no", "op", "section_id", F.when(find, F.substring(F.coalesce(_field(F.col("o"), "topic"), F.lit("")), 1, TOPIC_CHARS)).alias("topic"),
        F.when(find, F.greatest(F.lit(LEAST_NEW), F.least(F.lit(MOST_NEW), number))).alias("max_new"), F.when(rewrite, F.substring("instruction", 1, INSTRUCTION_CHARS)).alias("instruction"), error.alias("error"),
    )


def plans(answers: DataFrame, sections: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(plans, their operations). Plans: command_id, status ('ok', 'failed'), error, plan, n_operations.

    One bad operation fails the plan, with the first one's error; a failed plan has no operations.
    An answer without operations is a refusal, and its plan says why.
    """
    ops = operations(answers, sections)
    by = ops.groupBy("command_id").agg(F.count("*").alias("n"), F.min_by("error", F.when(F.col("error").isNotNull(), F.col("op_no"))).alias("bad"))
    rows = answers.select("command_id", parsed_json(F.col("answer")).alias("v")).join(by, "command_id", "left")
    listed = F.try_variant_get("v", "$.operations", "variant")
    shape = _shape(F.col("v"))
    plan = F.when(shape == "object", F.substring(F.coalesce(_field(F.col("v"), "plan"), F.lit("")), 1, PLAN_CHARS)).otherwise("")
    has = F.coalesce(F.array_contains(F.json_object_keys(F.to_json("v")), "operations"), F.lit(False))
    error = F.when((shape != "object") | ~has, "malformed plan").when(~_shape(listed).isin("array", "null"), "operations is not a list").when(F.col("bad").isNotNull(), F.col("bad")).when(F.col("n").isNull(), "no operation")
    out = rows.select("command_id", F.when(error.isNull(), "ok").otherwise("failed").alias("status"), error.alias("error"), plan.alias("plan"), F.when(error.isNull(), F.col("n")).otherwise(0).alias("n_operations"))
    good = ops.join(out.where("status = 'ok'").select("command_id"), "command_id", "left_semi").drop("error")
    return out, good
