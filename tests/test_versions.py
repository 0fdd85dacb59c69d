"""Versioned tables: history, conflicts, and writers that fail."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from quire.sources.versions import Conflict, Store

ROWS = "paper_id string, section_id string, content string"


def frame(spark, *rows):
    return spark.createDataFrame(list(rows), ROWS)


def content(df):
    return sorted((r["paper_id"] or "", r["section_id"], r["content"]) for r in df.collect())


@pytest.fixture
def store(spark, tmp_path):
    s = Store(spark, f"file://{tmp_path}/t", ["paper_id", "section_id"], buckets=4)
    assert s.latest() == 0
    s.commit(frame(spark, *[(f"p{i}", "s", "old") for i in range(20)], (None, "s", "null key")), 0, "parse")
    return s


def test_every_version_stays_readable(spark, store):
    assert store.commit(frame(spark, ("p3", "s", "new"), ("p3", "t", "more"), (None, "s", "again")), 1, "edit: shorten", "prop_1") == 2
    assert store.commit(frame(spark), 2, "nothing") == 3
    old, new = content(store.read(1)), content(store.read())
    assert len(old) == 21 and all(c != "new" for *_, c in old)
    assert [x for x in new if x not in old] == [("", "s", "again"), ("p3", "s", "new"), ("p3", "t", "more")] and len(new) == 22
    assert content(store.read(paper_id="p3", section_id="s")) == [("p3", "s", "new")] and content(store.read(1, paper_id="p3", section_id="s")) == [("p3", "s", "old")]
    assert store.read(paper_id="none", section_id="s").collect() == []
    assert [tuple(r)[:2] + tuple(r)[3:] for r in store.history().orderBy("version").collect()] == [(1, 0, "parse", None), (2, 1, "edit: shorten", "prop_1"), (3, 2, "nothing", None)]
    with pytest.raises(ValueError, match="no version"):
        store.read(9)


def test_only_touched_buckets_are_written(spark, store):
    before = store.manifest(1)["files"]
    store.commit(frame(spark, ("p3", "s", "new")), 1, "edit")
    assert sum(before[b] != f for b, f in store.manifest(2)["files"].items()) == 1


def test_the_second_of_two_writers_gets_a_conflict(spark, store):
    other = Store(spark, store.path, store.keys, buckets=4)
    store.commit(frame(spark, ("p1", "s", "mine")), 1, "mine")
    with pytest.raises(Conflict):
        other.commit(frame(spark, ("p1", "s", "theirs")), 1, "theirs")
    # The same when both have passed the first look.
    other.latest = lambda: 1
    with pytest.raises(Conflict, match="already"):
        other.commit(frame(spark, ("p1", "s", "theirs")), 1, "theirs")
    assert [x for x in content(store.read()) if x[0] == "p1"] == [("p1", "s", "mine")]


def test_a_failing_writer_leaves_the_old_table_whole(spark, store):
    broken = frame(spark, ("p1", "s", "x"), ("p2", "s", "y")).withColumn("content", F.when(F.col("paper_id") == "p2", F.raise_error(F.lit("lost"))).otherwise(F.col("content")).cast("string"))
    was = content(store.read())
    with pytest.raises(Exception, match="lost"):
        store.commit(broken, 1, "fails")
    assert store.latest() == 1 and content(store.read()) == was
    assert store.commit(frame(spark, ("p1", "s", "x")), 1, "works") == 2


def test_expected_rows_have_to_be_there(spark, store):
    new = frame(spark, ("p1", "s", "new"))
    with pytest.raises(Conflict, match="changed"):
        store.commit(new, 1, "edit", expect=frame(spark, ("p1", "s", "other")))
    assert store.commit(new, 1, "edit", expect=frame(spark, ("p1", "s", "old"))) == 2


def test_vacuum_keeps_what_is_named(spark, store, tmp_path):
    for k in range(3):
        store.commit(frame(spark, (f"p{k}", "s", f"v{k}")), k + 1, "edit")
    was = content(store.read())
    assert store.vacuum(keep=2) >= 1 and store.versions() == [3, 4]
    assert content(store.read()) == was and len(content(store.read(3))) == 21
    assert json.loads((tmp_path / "t/manifests/0000000004.json").read_text())["base"] == 3


def test_rows_of_a_commit_are_made_once_and_compared_by_digest(spark, store):
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(len(b))
            yield b

    new = frame(spark, ("p3", "s", "new"), ("p4", "s", "newer"), (None, "s", "again")).mapInPandas(count, ROWS)
    assert store.commit(new, 1, "edit", expect=store.read(1)) == 2
    assert seen.value == 3
    assert [x for x in content(store.read()) if x[2] != "old"] == [("", "s", "again"), ("p3", "s", "new"), ("p4", "s", "newer")] and store.read().count() == 21
    with pytest.raises(Conflict):
        store.commit(frame(spark, ("p5", "s", "x")), 2, "edit", expect=frame(spark, ("p3", "s", None)))
    assert store.commit(frame(spark, ("p5", "s", None)), 2, "edit", expect=frame(spark, ("p3", "s", "new"))) == 3
    assert store.commit(frame(spark, ("p5", "s", "")), 3, "edit", expect=frame(spark, ("p5", "s", None))) == 4
    with pytest.raises(Conflict):
        store.commit(frame(spark, ("p5", "s", "x")), 4, "edit", expect=frame(spark, ("p5", "s", None)))
