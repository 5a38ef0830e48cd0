import json

from pyspark.sql import functions as F

from tracemill.functions import records
from tracemill.operators import checks, sampling
from tracemill.sources import transcripts as t


def write(path, text):
    path.write_text(text, encoding="utf-8")
    return str(path)


def test_jsonl_aliases_scores_and_gaps(spark, tmp_path):
    lines = [
        json.dumps({"input": "q", "output": "a long answer", "score": 1, "id": "x"}),
        "",
        "not json",
        json.dumps({"prompt": None, "question": "later", "response": "r", "score": "0.7"}),
        json.dumps({"task": "t", "completion": "c", "score": "0.5d", "sample_id": 7}),
        json.dumps({"question": "t", "answer": None, "score": True}),
        "[1, 2]",
        json.dumps({"score": "nan", "messages": [{"role": "user", "content": "hi"}, {"content": "x"}, 3]}),
        json.dumps({"score": " 0.5 "}),
        json.dumps({"score": "1_000"}),
    ]
    path = write(tmp_path / "a.jsonl", "\n".join(lines) + "\n")
    got = {r.id: r for r in t.read_transcripts(spark, path).collect()}
    assert sorted(got) == [f"sample_{i:04d}" for i in (0, 3, 4, 5, 7, 8, 9)]
    assert got["sample_0003"].input == "None" and got["sample_0003"].score == 0.7 and got["sample_0003"].score_label == "pass"
    assert got["sample_0004"].score is None and got["sample_0004"].score_label == "error" and got["sample_0004"].metadata.original_id == "7"
    assert got["sample_0005"].score == 1.0 and got["sample_0005"].output == "None"
    assert got["sample_0007"].score_label == "fail"
    assert [(m.role, m.content) for m in got["sample_0007"].messages] == [("user", "hi"), ("unknown", "x")]
    assert got["sample_0008"].score == 0.5 and got["sample_0008"].score_label == "pass" and got["sample_0008"].messages == []
    assert got["sample_0009"].score is None
    assert [(m.role, m.content) for m in got["sample_0000"].messages] == [("user", "q"), ("assistant", "a long answer")]
    assert t.malformed(spark, path).count() == 2


def test_nested_score_and_threshold(spark, tmp_path):
    path = write(tmp_path / "a.jsonl", json.dumps({"result": {"score": 0.6}}) + "\n" + json.dumps({"result": 1}))
    got = [tuple(r) for r in t.read_jsonl(spark, path, "result.score", 0.7).orderBy("idx").select("score", "score_label").collect()]
    assert got == [(0.6, "fail"), (None, "error")]


def test_json_documents(spark, tmp_path):
    cases = {"list": [{"id": 1}, 5, {"id": 2}], "samples": {"samples": [{"id": 3}], "results": [{"id": 9}]}, "data": {"data": {"id": 4}, "id": 8}, "none": {"id": 5}}
    got = {}
    for name, value in cases.items():
        path = write(tmp_path / f"{name}.json", json.dumps(value))
        got[name] = [(r.id, r.metadata.original_id) for r in t.read_transcripts(spark, path).orderBy("idx").collect()]
    assert got == {"list": [("sample_0000", "1"), ("sample_0002", "2")], "samples": [("sample_0000", "3")], "data": [("sample_0000", "8")], "none": []}


def test_text_delimiters(spark, tmp_path):
    texts = {"a": "one\n===\ntwo\n---\nthree", "b": "one\n==\ntwo", "c": " \n ", "d": "x\n## head\ny", "e": "p\n****\n  \n****\nq"}
    got = {}
    for name, value in texts.items():
        got[name] = [r.output for r in t.read_transcripts(spark, write(tmp_path / f"{name}.txt", value)).orderBy("idx").collect()]
    assert got == {"a": ["one", "two\n---\nthree"], "b": ["one\n==\ntwo"], "c": [], "d": ["x", "head\ny"], "e": ["p", "q"]}


def test_folder_and_detection(spark, tmp_path):
    write(tmp_path / "b.jsonl", '{"id": 1}\n\n{"id": 2}\n')
    write(tmp_path / "a.json", '[{"id": 3}]')
    write(tmp_path / "c.log", "free text that is long")
    write(tmp_path / "d.eval", "ignored")
    write(tmp_path / "e.JSON", "[]")
    got = [(r.id, r.metadata.original_id) for r in t.read_transcripts(spark, str(tmp_path)).orderBy("idx").collect()]
    assert got == [("sample_0000", "3"), ("sample_0001", "1"), ("sample_0002", "2"), ("sample_0003", "")]
    assert t.detect_format(spark, str(tmp_path)) == "dir"
    assert t.detect_format(spark, write(tmp_path / "x.EVAL", "")) == "inspect"
    assert t.detect_format(spark, write(tmp_path / "y", '{"a":1}\n{"a":2}')) == "jsonl"
    assert t.detect_format(spark, write(tmp_path / "z", ' [{"a":1}]')) == "json"
    assert t.detect_format(spark, write(tmp_path / "w", "plain")) == "text"


def samples(spark, outputs, scores):
    found = spark.createDataFrame([(i, f"s{i}", o, s) for i, (o, s) in enumerate(zip(outputs, scores))], "idx int, id string, output string, score double")
    return found.withColumn("score_label", records.score_label(F.col("score")))


def kinds(df):
    return {(r.severity, r.type): r.affected for r in checks.findings(df).collect()}


LONG = "a long enough answer"


def test_findings_boundaries(spark):
    assert kinds(samples(spark, [], [])) == {}
    assert kinds(samples(spark, [LONG] * 3, [1.0] * 3)) == {("CRITICAL", "degenerate_scores"): 3}
    assert kinds(samples(spark, [LONG] * 2, [1.0] * 2)) == {}
    assert ("WARNING", "degenerate_scores") in kinds(samples(spark, [LONG] * 20, [1.0] * 9 + [0.0] * 11))
    assert ("WARNING", "degenerate_scores") not in kinds(samples(spark, [LONG] * 20, [1.0] * 8 + [0.0] * 12))
    assert kinds(samples(spark, ["\t123456789 "] + [LONG] * 9, [0.1 * i for i in range(10)])) == {("WARNING", "empty_truncated_responses"): 1}
    assert kinds(samples(spark, [None] + [LONG] * 8, [0.1 * i for i in range(9)])) == {("CRITICAL", "empty_truncated_responses"): 1}
    assert kinds(samples(spark, ["1234567890"] + [LONG] * 8, [0.1 * i for i in range(9)])) == {}
    half = ["As an AI I will not", "I Must Decline now"] + [LONG] * 2
    assert kinds(samples(spark, half, [0.1, 0.2, 0.3, 0.4])) == {("CRITICAL", "refusal_markers"): 2}
    assert kinds(samples(spark, ["Rate Limit reached"] + [LONG] * 3, [0.1, 0.2, 0.3, 0.4])) == {("WARNING", "tool_call_errors"): 1}
    assert ("WARNING", "score_distribution_anomaly") in kinds(samples(spark, [LONG] * 20, [0.9] * 18 + [0.8, 0.1]))
    assert ("WARNING", "score_distribution_anomaly") not in kinds(samples(spark, [LONG] * 20, [0.9] * 17 + [0.8, 0.1, 0.1]))
    assert ("WARNING", "score_distribution_anomaly") not in kinds(samples(spark, [LONG] * 19, [0.9] * 18 + [0.8]))
    assert kinds(samples(spark, [LONG] * 3, [None, 0.5, 0.6])) == {("WARNING", "format_parsing_failures"): 1}
    assert kinds(samples(spark, [LONG] * 3, [None] * 3)) == {}
    assert kinds(samples(spark, [LONG] * 3, [float("nan"), 1.0, 1.0])) == {}


def test_affected_and_summary(spark):
    df = samples(spark, [""] * 7 + [LONG] * 3, [None] * 2 + [0.1 * i for i in range(8)])
    first = {r.type: (r.ids, r.more) for r in checks.first_affected(df).collect()}
    assert first == {"empty_truncated_responses": (["s0", "s1", "s2", "s3", "s4"], 2), "format_parsing_failures": (["s0", "s1"], 0)}
    one = checks.summary(df, "here", "jsonl", sampling.stratified_sample(df)).first()
    assert one.total_samples == 10 and one.score_distribution == {"pass": 3, "fail": 5, "error": 2} and one.samples_extracted >= 5


def test_sampler_counts(spark):
    assert sampling.quotas(1000, 10) == (15, 6, 4, 5)
    assert sampling.quotas(60, 10) == (3, 1, 1, 1)
    assert sampling.quotas(19, 19) == (3, 19, 1, 1)
    every = samples(spark, [LONG] * 19, [0.0] * 19)
    assert sampling.stratified_sample(every).groupBy("stratum").count().collect()[0][1] == 19
    few = samples(spark, [LONG] * 100, [1.0] * 98 + [0.0, None])
    got = {r[0]: r[1] for r in sampling.stratified_sample(few).groupBy("stratum").count().collect()}
    assert got == {"failures": 1, "successes": 1, "random": 3}
    ids = [r.id for r in sampling.stratified_sample(few).collect()]
    assert len(set(ids)) == 5 and ids == [r.id for r in sampling.stratified_sample(few.repartition(7)).collect()]


def test_grades_and_turns(spark):
    df = spark.createDataFrame([("c",), ("Incorrect",), ("0.25",), ("odd",), (None,)], "g string")
    assert [r[0] for r in df.select(records.grade(F.col("g"))).collect()] == [1.0, 0.0, 0.25, None, None]
    turns = spark.createDataFrame([([("system", "s"), ("user", "u1"), ("assistant", "a1"), ("user", "u2"), ("assistant", "a2")],), ([],)], "m array<struct<role:string,content:string>>")
    assert [tuple(r) for r in turns.select(records.first_user(F.col("m")), records.last_assistant(F.col("m"))).collect()] == [("u1", "a2"), (None, None)]
    parts = spark.createDataFrame([('"plain"',), ('[{"type":"text","text":"a"},{"type":"image"},{"type":"text","text":"b"}]',)], "j string")
    assert [r[0] for r in parts.select(records.content_text(F.parse_json("j"))).collect()] == ["plain", "a b"]
