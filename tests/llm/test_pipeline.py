"""The pipeline's stages keep what they should."""

from __future__ import annotations

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from quire.llm.common import written

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def kept(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = {"": docs}
    for name, stage in corpus_pipeline.STAGES:
        docs = written(stage(spark, docs, SF), name)
        out[name] = docs
    return out


def test_stages(spark, kept):
    names = ["", *(n for n, _ in corpus_pipeline.STAGES)]
    for a, b in zip(names, names[1:-1], strict=False):
        assert kept[b].columns == kept[a].columns
        assert kept[b].select("doc_id").exceptAll(kept[a].select("doc_id")).count() == 0
    assert 0 < kept["ngram_jaccard_join"].count() <= kept["line_dedup"].count() < kept["toxicity"].count() <= kept[""].count()
    assert kept["pii"].count() == kept["ngram_jaccard_join"].count()
    assert kept["pii"].where(F.length("text") != F.col("n_chars")).count() == 0
    tokens = kept["packing"].groupBy("doc_id").agg(F.sum("length").alias("n"), F.max("doc_tokens").alias("m"))
    assert tokens.where("n <> m").count() == 0 and tokens.count() == kept["pii"].count()


def test_run(spark, kept):
    assert sorted(map(str, corpus_pipeline.run(spark, SF).drop("sequence_id", "offset").collect())) == sorted(map(str, kept["packing"].drop("sequence_id", "offset").collect()))


def test_near_copies_leave_one(spark):
    t = " ".join(f"w{i}" for i in range(60))
    rows = [(3, t, "en", "s", 1), (1, t + " end", "en", "s", 1), (1, t + " end", "de", "s", 1), (None, t, "en", "s", 1), (7, None, "en", "s", 1), (8, None, "en", "s", 1), (9, "other", "en", "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    out = corpus_pipeline.drop_near_copies(spark, docs, SF).collect()
    assert sorted(r["doc_id"] for r in out) == [1, 7, 8, 9]


@pytest.mark.parametrize("empty", [True, False])
def test_stages_on_edges(spark, empty):
    names = ["row", "group", "deleted", "_toxicity", "known", "cut", "score", "toxic"]
    rows = [] if empty else [(1, None, *names), (None, "no id", *names), (2, "", *names), (3, "a b\nc", *names), (3, "a b\nc", *names)]
    schema = "doc_id long, text string, " + ", ".join(f"{n} string" for n in names)
    for name, stage in corpus_pipeline.STAGES:
        docs = spark.createDataFrame(rows, schema)
        out = stage(spark, docs, SF).collect()
        if name == "packing":
            # A document may be cut into pieces; each begins once.
            assert sum(r["start"] == 0 for r in out) == len(rows)
            continue
        assert not out or [list(r)[2:] for r in out] == [names] * len(out)
        assert len(out) == len(rows) - (name == "ngram_jaccard_join" and not empty)
