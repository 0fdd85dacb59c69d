"""Whole papers as LaTeX, Markdown, BibTeX, provenance and a report: pieces with a path each, put in order per paper."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import citations as C
from ..functions import text as T
from . import pages, references, styles

#: Section commands by level, environments of floats, and types of BibTeX entries.
COMMANDS = {1: "\\section", 2: "\\subsection", 3: "\\subsubsection"}
ENVIRONMENTS = {"table": "table", "figure": "figure"}
ENTRY_TYPES = {"article-journal": "article", "paper-conference": "inproceedings", "chapter": "incollection", "book": "book", "thesis": "phdthesis", "report": "techreport", "article": "misc"}
#: What a file says about text that was kept without its look.
BOX_NOTE, FLOAT_NOTE = "text preserved, original framing not reconstructed", "text preserved, visual layout not reconstructed"
ASTRAY_NOTE = "% Captured from the PDF but not attachable to an exported section; text preserved here rather than dropped."
QUOTE_NOTE, RAW_TEX, RAW_MARKDOWN = "_text preserved; original layout not reconstructed_", "  % UNPARSED — raw text kept verbatim", "  ⚠ unparsed (raw text)"
#: Places of the parts of a file.
HEAD, BODY, LEFT, BIB, END = range(5)


def _text(*parts: Column | str) -> Column:
    return F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts))


def tex_body(text: Column, author_year: bool) -> Column:
    """Prose escaped and paragraphs one blank line apart; tokens become cite commands with their keys untouched."""
    prose = F.split(text, C.TOKEN)
    kinds, ids = (F.regexp_extract_all(text, F.lit(C.TOKEN), F.lit(i)) for i in (1, 2))
    command = (lambda k: F.concat(F.lit("\\cite"), k, F.lit("{"))) if author_year else (lambda k: F.lit("\\cite{"))
    keys = lambda i: F.array_join(F.filter(F.transform(F.split(i, ","), lambda x: F.trim(x)), lambda x: x != ""), ",")
    cites = F.zip_with(kinds, ids, lambda k, i: F.concat(command(k), keys(i), F.lit("}")))
    out = F.array_join(F.zip_with(prose, cites, lambda p, c: F.concat(T.tex_escape(p), F.coalesce(c, F.lit("")))), "")
    return F.regexp_replace(out, r"\n\n+", "\n\n")


def _pieces(df: DataFrame, part: int, a: Column | int, b: Column | int, text: Column) -> DataFrame:
    """A file's pieces: paper_id, path (part, a, b), text."""
    at = [F.lit(part), *(x if isinstance(x, Column) else F.lit(x) for x in (a, b))]
    return df.select("paper_id", F.struct(*(c.cast("long").alias(n) for c, n in zip(at, "pab", strict=True))).alias("path"), text.alias("text"))


def assembled(pieces: list[DataFrame], name: str, between: str = "\n") -> DataFrame:
    """One text a paper: its pieces in the order of their paths. A paper's own pieces meet, never those of several."""
    # Pieces without a text are left out where they meet: a filter would be moved before the joins that the pieces come from, and write each text for every pair of rows there.
    own = F.sort_array(F.collect_list(F.when(F.col("text").isNotNull(), F.struct("path", "text"))))
    rows = reduce(DataFrame.unionAll, pieces).groupBy("paper_id").agg(own.alias("_own")).where(F.size("_own") > 0)
    return rows.select("paper_id", F.concat(F.array_join(F.transform("_own", lambda x: x["text"]), between), F.lit("\n")).alias(name))


def tex_float(author_year: bool) -> Column:
    """A float's environment: what was kept of it is its text, and a comment says so."""
    env = F.coalesce(*(F.when(F.col("kind") == k, F.lit(v)) for k, v in ENVIRONMENTS.items()))
    page = (F.col("page") + 1).cast("string")
    body, caption = F.trim(tex_body(F.col("text"), author_year)), F.trim(T.tex_escape(F.col("caption")))
    name = F.concat(F.lit("float_"), (F.col("float_no") + 1).cast("string"))
    boxed = F.concat_ws("\n", F.lit("\\begin{quote}"), _text("% ", name, ": boxed panel captured from page ", page, "; " + BOX_NOTE), F.when(caption != "", _text("\\textbf{", caption, "}")), body, F.lit("\\end{quote}"))
    placed = F.concat_ws(
        "\n", _text("\\begin{", env, "}[htbp]"), _text("% ", name, ": ", F.col("kind"), " captured from page ", page, "; " + FLOAT_NOTE), F.lit("\\centering"),
        F.when(body != "", body), F.when(caption != "", _text("\\caption{", caption, "}")), _text("\\end{", env, "}"),
    )
    return F.when(env.isNull(), boxed).otherwise(placed)


def _homed(floats: DataFrame, sections: DataFrame) -> DataFrame:
    """floats with the sec_no of the section they are printed in; null where that is none or isn't printed."""
    held = sections.where("kind not in ('references', 'abstract')").select("paper_id", "section_id", "sec_no")
    return floats.join(held, ["paper_id", "section_id"], "left")


def latex(papers: DataFrame, sections: DataFrame, floats: DataFrame, refs: DataFrame, style_id: str) -> DataFrame:
    """paper_id, tex: whole LaTeX files.

    papers: paper_id, title, authors; sections: paper_id, sec_no, section_id, title, level, kind, content; floats:
    paper_id, float_no, kind, page, caption, text, section_id; refs as styles takes them. References sections
    aren't printed, and floats without a printed section come in one of their own before the bibliography.
    """
    ay = styles.STYLES[style_id].author_year
    names = F.transform("authors", T.tex_escape)
    cite = "\\usepackage[round]{natbib}" if ay else "\\usepackage{cite}"
    front = ["% Citation style: " + style_id, "\\documentclass[11pt]{article}", "\\usepackage[utf8]{inputenc}", cite, "\\usepackage[margin=1in]{geometry}"]
    head = F.concat_ws(
        "\n", *(F.lit(x) for x in front), _text("\\title{", T.tex_escape(F.coalesce("title", F.lit(""))), "}"),
        _text("\\author{", F.when(F.size("authors") > 0, F.array_join(names, " \\and ")).otherwise("~"), "}"), F.lit("\\date{}"), F.lit("\\begin{document}"), F.lit("\\maketitle"),
    )
    body = tex_body(F.col("content"), ay)
    abstract = F.concat_ws("\n", F.lit("\\begin{abstract}"), pages.abstract_text(body), F.lit("\\end{abstract}"))
    command = F.coalesce(*(F.when(F.col("level") == k, F.lit(v)) for k, v in COMMANDS.items()), F.lit(COMMANDS[3]))
    plain = F.concat_ws("\n", _text(command, "{", T.tex_escape(F.col("title")), "}"), F.when(F.trim(body) != "", body))
    printed = sections.where("kind <> 'references'")
    homed = _homed(floats, sections)
    astray = homed.where("sec_no is null")
    bib = styles.bibliography(refs, sections, style_id).join(refs.select("paper_id", "ref_id", "authors", "year", "title"), ["paper_id", "ref_id"])
    label = _text("[", styles.natbib_label(F.col("authors"), F.col("year"), F.coalesce("title", "ref_id")), "]") if ay else F.lit("")
    words = F.col("text") if ay else F.regexp_replace("text", r"^\s*\[?\d+\]?\.?\s*", "")
    item = _text("\\bibitem", label, "{", F.col("ref_id"), "} ", T.tex_escape(words), F.when(F.col("raw"), RAW_TEX).otherwise(""))
    count = papers.select("paper_id").join(bib.groupBy("paper_id").agg(F.count("*").alias("n")), "paper_id", "left")
    widest = F.greatest(F.lit(9), F.coalesce("n", F.lit(0))).cast("string")
    return assembled(
        [
            _pieces(papers, HEAD, 0, 0, head),
            _pieces(printed, BODY, F.col("sec_no"), -1, F.when(F.col("kind") == "abstract", abstract).otherwise(plain)),
            _pieces(homed.where("sec_no is not null"), BODY, F.col("sec_no"), F.col("float_no"), tex_float(ay)),
            _pieces(astray.select("paper_id").distinct(), LEFT, 0, 0, F.lit("\\section*{Unanchored floats}\n" + ASTRAY_NOTE)),
            _pieces(astray, LEFT, 1, F.col("float_no"), tex_float(ay)),
            _pieces(count, BIB, 0, 0, _text("\n\\begin{thebibliography}{", widest, "}")),
            _pieces(bib, BIB, 1, F.col("place"), item),
            _pieces(papers, END, 0, 0, F.lit("\\end{thebibliography}\n\\end{document}")),
        ],
        "tex",
    )


def markdown(papers: DataFrame, sections: DataFrame, floats: DataFrame, refs: DataFrame, style_id: str) -> DataFrame:
    """paper_id, markdown: headings by level (at most four), floats as quotations, the bibliography as a list."""
    shown = styles.rendered(sections.where("kind <> 'references'"), refs, style_id)
    head = F.concat_ws("\n", _text("# ", F.coalesce("title", F.lit(""))), F.lit(""), F.when(F.size("authors") > 0, _text(F.array_join("authors", ", "), "\n")))
    part = F.concat_ws("\n", _text(F.repeat(F.lit("#"), F.least(F.col("level") + 1, F.lit(4))), " ", F.col("title")), F.lit(""), F.when(F.trim("content") != "", _text(F.col("content"), "\n")))
    name = F.when(F.col("caption") != "", F.col("caption")).otherwise(_text(F.initcap("kind"), " (page ", (F.col("page") + 1).cast("string"), ")"))
    paragraphs = F.array_join(F.transform(F.split("text", "\n\n"), lambda p: F.concat(F.lit("> "), F.replace(p, F.lit("\n"), F.lit("\n> ")), F.lit("\n>"))), "\n")
    note = "\n> " + QUOTE_NOTE
    quote = lambda tail: _text("> **", name, "**\n>\n", paragraphs, tail, "\n")
    held = sections.where("kind <> 'references'").select("paper_id", "section_id", "sec_no")
    homed = floats.join(held, ["paper_id", "section_id"], "left")
    astray = homed.where("sec_no is null")
    bib = styles.bibliography(refs, sections, style_id)
    return assembled(
        [
            _pieces(papers, HEAD, 0, 0, head),
            _pieces(shown, BODY, F.col("sec_no"), -1, part),
            _pieces(homed.where("sec_no is not null"), BODY, F.col("sec_no"), F.col("float_no"), quote(note)),
            _pieces(astray.select("paper_id").distinct(), LEFT, 0, 0, F.lit("## Unanchored floats\n")),
            _pieces(astray, LEFT, 1, F.col("float_no"), quote("")),
            _pieces(papers, BIB, 0, 0, F.lit("## References\n")),
            _pieces(bib, BIB, 1, F.col("place"), _text("- ", F.col("text"), F.when(F.col("raw"), RAW_MARKDOWN).otherwise(""))),
        ],
        "markdown",
    )


def bibtex(refs: DataFrame) -> DataFrame:
    """paper_id, ref_id, ord, entry: one BibTeX entry a reference, of its fields those that it has."""
    kind = references.csl_type(F.col("container"), F.col("raw_text"), F.col("arxiv"))
    entry = F.coalesce(*(F.when(kind == k, F.lit(v)) for k, v in ENTRY_TYPES.items()), F.lit("misc"))
    url = F.coalesce(F.nullif("url", F.lit("")), _text("https://arxiv.org/abs/", F.col("arxiv")))
    note = _text("arXiv:", F.col("arxiv"))

    def field(name: Column | str, value: Column, escape: bool = True) -> Column:
        return F.when(F.coalesce(value, F.lit("")) != "", _text("  ", name, " = {", T.bibtex_escape(value) if escape else value, "}"))

    parts = F.concat_ws(
        ",\n", field("title", F.col("title")), field("author", F.array_join("authors", " and ")), field("year", F.col("year").cast("string")),
        field(F.when(entry == "inproceedings", "booktitle").otherwise("journal"), F.col("container")), field("volume", F.col("volume")), field("pages", F.col("pages")),
        field("doi", F.col("doi")), field("url", url, escape=False), field("note", note),
    )
    return refs.select("paper_id", "ref_id", "ord", _text("@", entry, "{", F.col("ref_id"), ",\n", parts, "\n}").alias("entry"))


def provenance(papers: DataFrame, refs: DataFrame, history: DataFrame) -> DataFrame:
    """paper_id, provenance: what the agent added and why, and the edits. refs: with added_by, added_reason, source, source_url; history: paper_id, version, reason, created_at (a timestamp)."""
    added = refs.where("added_by = 'agent'")
    n = papers.join(added.groupBy("paper_id").agg(F.count("*").alias("n")), "paper_id", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    head = _text("# Provenance\n\nPaper: ", F.coalesce("title", F.lit("")), "\nVersion: ", F.col("version").cast("string"), "\n\n## Agent-added references (", F.col("n").cast("string"), ")\n", F.when(F.col("n") == 0, "\n(none)").otherwise(""))
    line = _text("- **", F.coalesce("title", F.lit("?")), "** — added because: ", F.coalesce("added_reason", F.lit("?")), "\n  - source: ", F.coalesce("source", F.lit("None")), " — ", F.coalesce("source_url", F.lit("None")))
    edits = papers.select("paper_id").join(history.groupBy("paper_id").agg(F.count("*").alias("n")), "paper_id", "left")
    step = _text("- v", F.col("version").cast("string"), " → v", (F.col("version") + 1).cast("string"), ": ", F.col("reason"), " (", F.date_format("created_at", "yyyy-MM-dd HH:mm"), ")")
    return assembled(
        [
            _pieces(n, HEAD, 0, 0, head), _pieces(added, BODY, 0, F.col("ord"), line),
            _pieces(edits, LEFT, 0, 0, F.when(F.col("n").isNull(), "\n## Edit history\n\n(no edits applied — original parse)").otherwise("\n## Edit history\n")), _pieces(history, LEFT, 1, F.col("version"), step),
        ],
        "provenance",
    )


def files(papers: DataFrame, sections: DataFrame, floats: DataFrame, refs: DataFrame, history: DataFrame, style_id: str) -> DataFrame:
    """paper_id, path, content of the exports of each paper."""
    entries = bibtex(refs.where("renderable")).withColumn("_k", F.row_number().over(Window.partitionBy("paper_id").orderBy("ord")))
    bib = assembled([_pieces(entries, BIB, 0, F.col("_k"), F.col("entry"))], "content", "\n\n")
    named = {
        "main.tex": latex(papers, sections, floats, refs, style_id).withColumnRenamed("tex", "content"), "references.bib": bib,
        "paper.md": markdown(papers, sections, floats, refs, style_id).withColumnRenamed("markdown", "content"), "PROVENANCE.md": provenance(papers, refs, history).withColumnRenamed("provenance", "content"),
    }
    return reduce(DataFrame.unionAll, (df.select("paper_id", F.lit(path).alias("path"), "content") for path, df in named.items()))
