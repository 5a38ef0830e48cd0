"""Compaction of the cache and the appending audit sink."""

import json

import pytest
from pyspark.sql import functions as F

from tracemill.sources import records


def entries(spark, path):
    return {r["key"]: r["response"] for r in records.read_cache(spark, path).collect()}


def put(spark, path, *rows):
    import time

    records.append_cache(spark.createDataFrame(list(rows), "key string, response string").coalesce(1), path)
    time.sleep(0.02)  # files are told apart by their time


def test_compaction_keeps_the_last_record_and_later_appends(spark, tmp_path):
    path = str(tmp_path / "cache")
    assert entries(spark, path) == {}
    put(spark, path, ("a", "1"), ("b", "1"))
    put(spark, path, ("a", "2"), ("c", ""))
    before = {"a": "2", "b": "1", "c": ""}
    assert entries(spark, path) == before

    seen = []

    def meanwhile():
        seen.append(entries(spark, path))  # a reader before the switch
        put(spark, path, ("b", "9"), ("d", "1"))  # an append after the read and before the switch

    old_reader = records.read_cache(spark, path)
    assert records.compact_cache(spark, path, meanwhile) == 1
    assert seen == [before]
    after = before | {"b": "9", "d": "1"}
    assert entries(spark, path) == after
    assert {r["key"] for r in old_reader.collect()} >= {"a", "b", "c"}  # what it was to read is still there
    put(spark, path, ("a", "3"))
    after |= {"a": "3"}
    assert entries(spark, path) == after
    assert records.compact_cache(spark, path) == 2
    assert entries(spark, path) == after
    assert records.compact_cache(spark, path) == 3
    assert entries(spark, path) == after
    assert sorted(p.name for p in (tmp_path / "cache").glob("_gen-*")) == ["_gen-2", "_gen-3"]
    assert not list((tmp_path / "cache").glob("part-*"))  # the third removed what the second had merged


def test_second_of_two_compactions_changes_nothing(spark, tmp_path):
    path = str(tmp_path / "cache")
    put(spark, path, ("a", "1"))
    with pytest.raises(ValueError, match="meanwhile"):
        records.compact_cache(spark, path, lambda: records.compact_cache(spark, path) and None)
    assert entries(spark, path) == {"a": "1"}
    assert not list((tmp_path / "cache").glob("_new-*"))


def test_an_interrupted_compaction_is_not_seen(spark, tmp_path):
    path = str(tmp_path / "cache")
    put(spark, path, ("a", "1"))

    def lost():
        raise KeyboardInterrupt

    with pytest.raises(KeyboardInterrupt):
        records.compact_cache(spark, path, lost)
    assert entries(spark, path) == {"a": "1"}
    put(spark, path, ("a", "2"))
    assert records.compact_cache(spark, path) == 1 and entries(spark, path) == {"a": "2"}


def event(command, code):
    return json.dumps({"tool_name": "Bash", "tool_input": {"command": command, "cwd": "/w/proj"}, "tool_response": {"exit_code": code}})


def test_audit_sink_writes_a_replayed_batch_once(spark, tmp_path):
    source, target, check = (str(tmp_path / x) for x in ("in", "out", "check"))
    at = F.to_timestamp(F.lit("2026-01-02 03:04:05"))

    def run(folder):
        lines = spark.readStream.schema("value string").option("maxFilesPerTrigger", 1).text(source)
        records.audit_sink(records.events(lines), target, folder, "END", at, branch=F.lit("main")).awaitTermination()

    for n, code in enumerate((0, 3)):
        spark.createDataFrame([(event(f"run {n}", code),), (event("ls", 0),)], "value string").coalesce(1).write.mode("append").text(source)
    run(check)
    first = sorted(tuple(r) for r in records.read_audit(spark, target).select("cmd", "exit").collect())
    assert first == [("ls", 0), ("ls", 0), ("run 0", 0), ("run 1", 3)]
    # The batches' commits are lost with the checkpoint, so both are run again, under the same numbers.
    run(check + "-2")
    assert sorted(tuple(r) for r in records.read_audit(spark, target).select("cmd", "exit").collect()) == first
    human = sorted(r["value"] for r in spark.read.text(f"{target}/human").select("value").collect())
    assert human == ["03:04 [!3]  proj (main) | run 1", "03:04 [OK]  proj (main) | ls", "03:04 [OK]  proj (main) | ls", "03:04 [OK]  proj (main) | run 0"]
    # A later batch is appended.
    spark.createDataFrame([(event("last", 0),)], "value string").coalesce(1).write.mode("append").text(source)
    run(check)
    assert records.read_audit(spark, target).count() == 5


def test_audit_of_starts_has_no_human_lines(spark, tmp_path):
    source, target = str(tmp_path / "in"), str(tmp_path / "out")
    spark.createDataFrame([(event("run", None),)], "value string").coalesce(1).write.text(source)
    records.audit_sink(records.events(spark.readStream.schema("value string").text(source)), target, str(tmp_path / "check"), "START", F.current_timestamp()).awaitTermination()
    assert [(r["cmd"], r["exit"]) for r in records.read_audit(spark, target).collect()] == [("run", None)]
    assert spark.read.text(f"{target}/human").count() == 0
