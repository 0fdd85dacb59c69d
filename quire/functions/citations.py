"""Citation markers and tokens as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A citation token: p is parenthetical, t is narrative; ids are joined by commas.
TOKEN = r"\[\[cite([pt]):([A-Za-z0-9_,\- ]+?)\]\]"
#: Numbers in square brackets, in parentheses, and raised.
BRACKET, PAREN, RAISED = r"\[(\d[\d\s,;–-]*)\]", r"\((\d{1,3}(?:\s*[,;–-]\s*\d{1,3})*)\)", r"⟨sup:(\d[\d\s,;–-]*)⟩"
#: The longest range of numbers that one part of a marker may stand for.
LONGEST_RANGE = 40


def token(ids: Column, narrative: bool = False) -> Column:
    return F.concat(F.lit("[[citet:" if narrative else "[[citep:"), F.array_join(ids, ","), F.lit("]]"))


def token_ids(text: Column) -> Column:
    """All ids of all tokens in order, with repetitions."""
    groups = F.regexp_extract_all(text, F.lit(TOKEN), F.lit(2))
    return F.filter(F.flatten(F.transform(groups, lambda g: F.transform(F.split(g, ","), lambda x: F.trim(x)))), lambda x: x != "")


def without_tokens(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(text, TOKEN, ""), r"\s+", " "))


def markers(text: Column, pattern: str) -> Column:
    """The insides of all markers of a family, in order."""
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(1))


def numbers(inside: Column) -> Column:
    """The numbers that a marker stands for, ranges expanded; null if any part is no number or a bad range."""
    parts = F.transform(F.split(inside, "[,;]"), lambda x: F.trim(x))

    def one(p: Column) -> Column:
        a = F.regexp_extract(p, r"^(\d+)\s*[–-]\s*(\d+)$", 1).try_cast("int")
        b = F.regexp_extract(p, r"^(\d+)\s*[–-]\s*(\d+)$", 2).try_cast("int")
        span = F.when((b >= a) & (b - a <= LONGEST_RANGE), F.sequence(a, b))
        return F.when(p.rlike(r"^\d+$"), F.array(p.try_cast("int"))).otherwise(span)

    each = F.transform(parts, one)
    return F.when(F.exists(each, lambda x: x.isNull()), F.lit(None)).otherwise(F.flatten(each))
