import json

from pyspark.sql import functions as F

from tracemill.operators import cluster, journal, stats
from tracemill.sources import records as r
from tracemill.sources.transcripts import lines_with_numbers


def test_usage(spark, tmp_path, rows):
    path = str(tmp_path / "usage")
    assert rows(r.usage_totals(r.read_usage(spark, path))) == [(0.0, 0, 0, 0)]
    calls = spark.createDataFrame([("t", "m", 1, 2, 99, 0.5, "a"), ("t", "m", 3, None, 0, None, "b")], r.USAGE)
    r.append_usage(calls, path)
    extra = F.create_map(F.lit("timestamp"), F.lit("mine"), F.lit("note"), F.lit('q"x'))
    r.append_usage(calls.limit(1), path, extra)
    got = r.read_usage(spark, path)
    assert rows(r.usage_totals(got)) == [(1.0, 5, 4, 9)] and rows(r.usage_totals(got, "a")) == [(1.0, 2, 4, 6)] and rows(r.usage_totals(got, "zz")) == [(0.0, 0, 0, 0)]
    assert "mine" in {x.timestamp for x in got.collect()}
    assert any(json.loads(x.value).get("note") == 'q"x' for x in spark.read.text(path).collect())


def test_sessions_and_audit(spark, tmp_path):
    events = [
        {"type": "user", "message": {"content": "first"}}, {"type": "custom-title", "customTitle": "old"},
        {"type": "user", "message": {"content": [{"type": "text", "text": "a"}, {"type": "image"}, {"type": "text", "text": "b"}]}}, {"type": "custom-title", "customTitle": "✅ done"},
    ]
    (tmp_path / "s.jsonl").write_text("\n".join(map(json.dumps, events)))
    one = r.session_titles(lines_with_numbers(spark, str(tmp_path / "s.jsonl"))).first()
    assert (one.title, one.done, one.context) == ("✅ done", True, "first\na b")
    df = spark.createDataFrame([("ls", "/a/proj", "2"), ("", "", None)], "command string, cwd string, exit_code string")
    at = F.to_timestamp(F.lit("2026-01-31 12:34:56"))
    end = r.audit_rows(df, "END", at, F.lit("main"), "/d/home").collect()
    assert end[0].human == "12:34 [!2]  proj (main) | ls" and end[0].exit == 2 and end[1].human == "12:34 [OK]  home (main) | unknown"
    assert r.audit_rows(df, "START", at).first().exit is None
    newest = r.newest_files(spark, str(tmp_path)).first()
    assert newest.path.endswith("s.jsonl")


def test_front_matter_threads_journal(spark, tmp_path, rows):
    (tmp_path / "a.md").write_text('---\ntitle: "A"\nstatus: active\ntags: [x, y]\n---\nstatus: done\n')
    (tmp_path / "b.md").write_text("status: complete\n")
    (tmp_path / "README.md").write_text("status: active\n")
    found = r.read_front_matter(spark, str(tmp_path))
    assert rows(found, "file", "title", "status", "tags") == [("a.md", "A", "active", ["x", "y"]), ("b.md", "", "complete", [])]
    assert rows(r.active(found), "file") == [("a.md",)]
    df = spark.createDataFrame([("intro\n## Thread 1\nfix ✅\n## Thread 2\nopen",)], "value string")
    assert rows(r.review_threads(df), "num", "done") == [(1, True), (2, False)]
    df = spark.createDataFrame([("- 2026-01-31: [tag] some words (source: f.md)\n- 2026-02-01: [REVISED] [t2] more\nnone",)], "value string")
    assert [(str(a), *b) for a, *b in rows(r.journal_entries(df))] == [("2026-01-31", "tag", "some words", "f.md", False), ("2026-02-01", "t2", "more", None, True)]
    assert spark.createDataFrame([("x\nval_bpb: 0.93\n",)], "t string").select(r.metric(F.col("t"), "val_bpb")).first()[0] == 0.93
    (tmp_path / "r.tsv").write_text("run\tmetric\n1\t0.5\n")
    assert rows(r.read_results(spark, str(tmp_path / "r.tsv"), "run int, metric double")) == [(1, 0.5)]
    (tmp_path / "lex.json").write_text(json.dumps({"patterns": {"k": {"category": "c", "severity": "low", "count": 1, "patterns": [{"phrase": "p", "fix": "f", "confidence": "91", "sources": ["s"], "rationale": "r"}]}}}))
    assert rows(r.flat_lexicon(spark, str(tmp_path / "lex.json")), "category_key", "phrase", "confidence", "declared") == [("k", "p", 91, 1)]


def test_cluster(spark, rows):
    lines = spark.createDataFrame([("n1 16 65536 gpu:a100:4 idle",), ("n2  8 1024 gpu:2 mixed",), ("n3 8 1024 (null) drained",), ("n4 8 2048 (null) idle",)], "value string")
    nodes = r.table_rows(lines, ["node", "cpus", "memory_mb", "gres", "state"]).withColumn("cpus", F.col("cpus").cast("int")).withColumn("memory_mb", F.col("memory_mb").cast("bigint"))
    jobs = spark.createDataFrame([("n1", 4, "16G", "gpu:a100:1"), ("n1", 2, "512M", "gpu:a100:1,gpu:x:1"), ("n2", 1, "100", "gpu:t:1"), ("n4", 9, None, "gpu:a:1")], "node string, job_cpus int, job_mem string, tres string")
    assert rows(cluster.free_resources(nodes, jobs), "node", "free_cpus", "free_memory_gb", "gpus", "free_gpus") == [("n1", 10, 47, 4, 1), ("n2", 7, 1, 2, 1), ("n4", -1, 2, 0, 0)]
    assert spark.range(1).select(cluster.chunk_size(F.lit(100), F.lit(8)), cluster.chunk_size(F.lit(3), F.lit(8))).first()[:] == (3, 1)


def test_journal(spark, rows):
    runs = spark.createDataFrame([("a", 1, 5.0), ("a", 2, 5.0), ("a", 3, 4.0), ("a", 4, 6.0), ("b", 1, None)], "k string, t int, m double")
    assert rows(journal.running_best(runs, ["k"], ["t"], "m"), "t", "keep") == [(1, True), (1, True), (2, False), (3, True), (4, False)]
    assert [x.keep for x in journal.running_best(runs.where("k = 'a'"), ["k"], ["t"], "m", True).orderBy("t").collect()] == [True, False, False, True]
    assert [x.may_run for x in journal.budget_stop(runs.where("k = 'a'"), ["k"], ["t"], "m", 15, 1).orderBy("t").collect()] == [True, True, True, False]
    fails = spark.createDataFrame([("a", i, f) for i, f in enumerate([True, True, False, True, True, True, None, True])], "k string, t int, f boolean")
    assert rows(journal.streaks(fails, ["k"], ["t"], F.col("f"))) == [("a", 3, 5, 3)]
    cache = spark.createDataFrame([("x", "1", 0), ("x", "2", 1), ("y", "", 0)], "key string, response string, pos int")
    last = journal.last_wins(cache, ["key"], ["pos"])
    found = journal.cached(spark.createDataFrame([("x",), ("y",), ("z",)], "key string"), last)
    assert rows(found) == [("x", "2", True), ("y", None, False), ("z", None, False)] and abs(journal.hit_rate(found).first()[0] - 1 / 3) < 1e-9
    places = [spark.createDataFrame([("a", "p1")], "k string, v string"), spark.createDataFrame([("a", "p2"), ("b", "q2")], "k string, v string")]
    assert rows(journal.first_existing(spark.createDataFrame([("a",), ("b",), ("c",)], "k string"), "k", places, "v")) == [("a", "p1"), ("b", "q2"), ("c", None)]
    log = spark.createDataFrame([("1", None, "c", "d"), ("2", 0, "c", "d"), ("3", None, "c", "d")], "ts string, exit int, cmd string, cwd string")
    assert rows(journal.phase_pairs(log), "ts", "end_ts", "end_exit") == [("1", "2", 0), ("3", None, None)]
    stale = lambda d, n: spark.range(1).select(journal.staleness(F.lit(86400 * (100 + d)), F.lit(86400 * 100), F.lit(n))).first()[0]
    assert [stale(7, 11), stale(8, 11), stale(8, 10), stale(15, 1), stale(900, 0)] == [False, True, False, True, False]
    commits = spark.createDataFrame([(1000, "src/a"), (900000, "src/b"), (950000, "docs/c")], "epoch bigint, path string")
    assert rows(journal.commit_activity(commits, 1000000, ["src/"])) == [(900000, 1)]
    train, test = spark.createDataFrame([("A  b",)], "text string"), spark.createDataFrame([("a B",), ("c",)], "text string")
    assert rows(journal.overlap(train, test)) == [("a B",)]


def test_statistics(spark):
    few = spark.createDataFrame([("m", i, 1.0 * i) for i in range(3)], "model string, q int, s double")
    assert stats.mean_se_ci(few, ["model"], "q", "s").first().ci_low is None
    constant = spark.createDataFrame([(m, i, 0.1 * i + (0.5 if m == "a" else 0)) for m in "ab" for i in range(10)], "model string, q int, s double")
    one = stats.paired_diff(constant, "model", "q", "s", "a", "b").first()
    assert one.n == 10 and abs(one.mean_diff - 0.5) < 1e-9 and one.se_diff < 1e-9
    same = spark.createDataFrame([(c, float(c % 2)) for c in range(10) for _ in range(9)], "c int, s double")
    assert abs(stats.clustered_se(same, [], "c", "s").first().ratio - 3) < 0.2
    assert abs(spark.range(1).select(stats.all_right_interval(F.lit(20))).first()[0] - 0.832) < 1e-3
    assert spark.range(1).select(stats.required_n(F.lit(0.1125), 0.03)).first()[0] == 1000
    both = spark.createDataFrame([("x", 0.9, 0.85, 0.95), ("y", 0.7, 0.6, 0.8), ("z", 0.1, 0.0, 0.2)], "m string, mean double, ci_low double, ci_high double")
    assert [x.bold for x in stats.rank_vs_second(both).orderBy("rank").collect()] == [True, False, False]
    ci = stats.bootstrap_ci(spark.range(200).withColumn("v", F.col("id").cast("double")), [], "id", "v").first()
    assert 85 < ci.ci_low < 99.5 < ci.ci_high < 115
    repro = spark.createDataFrame([(1.2, 1.0, 5, 5), (1.21, 1.0, 5, 5), (1.0, 1.0, 4, 5)], "a double, b double, c int, d int")
    assert [x.reproduced for x in stats.reproduced(repro, "a", "b", "c", "d").collect()] == [True, False, False]


def test_docs_samples_cache_specs(spark, tmp_path, rows):
    (tmp_path / "d/node_modules").mkdir(parents=True)
    (tmp_path / "d/a.md").write_text("one\ntwo\nKey point\nfour\nfive\nsix")
    (tmp_path / "d/node_modules/b.md").write_text("key")
    assert rows(r.search_docs(spark, str(tmp_path / "d"), "key"), "line_no", "is_match") == [(1, False), (2, False), (3, True), (4, False), (5, False)]
    (tmp_path / "c").mkdir()
    (tmp_path / "c/x.md").write_text("---\nsource: here\nexpected_score_range: 10-40\ncategory: edited\nnotes: n\n---\n\nThe text\n")
    assert rows(r.corpus_samples(spark, str(tmp_path / "c")), "source", "category", "low", "high", "body") == [("here", "edited", 10, 40, "The text")]
    path = str(tmp_path / "cache")
    assert r.read_cache(spark, path).count() == 0
    r.append_cache(spark.createDataFrame([("k", "1"), ("j", "")], "key string, response string").coalesce(1), path)
    import time

    time.sleep(1.1)
    r.append_cache(spark.createDataFrame([("k", "2")], "key string, response string"), path)
    assert rows(r.read_cache(spark, path)) == [("j", ""), ("k", "2")]
    spec = {c: "stated" for c in (*r.BLOCKING, *r.ADVISED)}
    df = spark.createDataFrame([{"name": "a", **spec}, {"name": "b", **spec, "metrics": " ", "baseline": None}])
    assert rows(r.validated(df, "name")) == [("a", 9, [], [], "PASS"), ("b", 8, ["baseline"], ["metrics"], "STOP")]


def test_report_files(spark, tmp_path):
    from tracemill.sources.reports import report, write_output
    from tracemill.sources.transcripts import read_jsonl

    records = [{"id": i, "input": "q" * 130, "output": "" if i < 7 else "a fine answer", "score": i % 2} for i in range(30)]
    (tmp_path / "a.jsonl").write_text("\n".join(map(json.dumps, records)))
    samples = read_jsonl(spark, str(tmp_path / "a.jsonl"))
    summary, drawn = write_output(samples, f"file://{tmp_path}/out", "a.jsonl", "jsonl")
    assert json.loads((tmp_path / "out/summary.json").read_text()) == summary and summary["total_samples"] == 30 and summary["samples_extracted"] == 3
    assert sorted(p.stem for p in (tmp_path / "out/samples").glob("*.json")) == sorted(d["id"] for d in drawn)
    text = report(summary, drawn, True)
    assert "(+2 more)" in text and "q" * 120 + "..." in text and "[!!!] CRITICAL empty_truncated_responses" in text
    nothing, _ = write_output(samples.where("false"), f"file://{tmp_path}/none", "none", "jsonl")
    assert nothing["total_samples"] == 0 and nothing["issues"] == [] and "no issues found" in report(nothing, [])


def test_more_statistics(spark, rows):
    df = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("b", 5.0), ("b", 7.0)], "g string, v double")
    one = stats.cohens_d(df, [], "g", "v", "a", "b").first()
    assert (one.na, one.nb, one.diff) == (2, 2, -4.0) and abs(one.pooled - 2**0.5) < 1e-9 and abs(one.d + 4 / 2**0.5) < 1e-9 and abs(one.t + 4 / 2**0.5) < 1e-9
    table = spark.createDataFrame([("x", "p")] * 10 + [("x", "q")] * 20 + [("y", "p")] * 30, "a string, b string")
    chi = stats.chi_square(table, "a", "b").first()
    e = [30 * 40 / 60, 30 * 20 / 60, 30 * 40 / 60, 30 * 20 / 60]
    assert chi.df == 1 and abs(chi.chi_square - sum((o - x) ** 2 / x for o, x in zip([10, 20, 30, 0], e))) < 1e-9
    ps = spark.createDataFrame([(0.01,), (0.04,), (0.03,), (0.5,)], "p double")
    got = [(r.bonferroni, round(r.fdr, 6)) for r in stats.adjusted(ps).orderBy("p").collect()]
    assert got == [(0.04, 0.04), (0.12, 0.053333), (0.16, 0.053333), (1.0, 0.5)]
    v = spark.createDataFrame([(x,) for x in (-1.0, 0.0, 0.5, 0.99, 1.0, None)], "v double")
    assert rows(stats.histogram(v, [], "v", 0.0, 1.0, 2)) == [(0, 1), (1, 1), (2, 2), (3, 1)]
    assert rows(stats.ecdf(v, [], "v"))[0] == (-1.0, 0.2)
    c = spark.createDataFrame([(0.05, False), (0.06, True), (1.0, True)], "s double, y boolean")
    assert rows(stats.calibration(c, "s", "y"), "bin", "n", "share") == [(0, 2, 0.5), (9, 1, 1.0)]
    assert abs(stats.correlation(spark.createDataFrame([(1.0, 2.0), (2.0, 4.0), (3.0, None)], "x double, y double"), [], "x", "y").first().r - 1) < 1e-9


def test_decision_bodies(spark):
    from tracemill.operators.rules import decision

    df = spark.createDataFrame([("block",), ("warn",), ("error",), ("allow",)], "a string")
    got = [tuple(r.d) for r in df.select(decision(F.col("a"), F.lit("why")).alias("d")).collect()]
    assert got == [(2, '{"decision":"block","reason":"why"}'), (0, '{"decision":"allow","systemMessage":"why"}'), (1, None), (0, None)]


def test_exact_quantiles_without_a_whole_group(spark, monkeypatch):
    import random

    import numpy as np

    from tracemill.operators import segments, stats

    monkeypatch.setattr(segments, "HOT_ROWS", 20)
    r = random.Random(3)
    held = [(k % 3, r.choice([r.random(), 0.5, float(r.randint(0, 9))])) for k in range(900)] + [(0, None)]
    df = spark.createDataFrame(held, "g int, v double")
    got = {x.g: x.q for x in stats.quantiles(df, ["g"], "v", (0.0, 0.05, 0.5, 1.0)).collect()}
    for g, q in got.items():
        assert np.allclose(q, np.quantile([v for k, v in held if k == g and v is not None], (0.0, 0.05, 0.5, 1.0)))
    assert stats.quantiles(df.where("v > 100"), [], "v", (0.5,)).collect() == []
    whole = stats.quantiles(df, [], "v", (0.25,)).first().q[0]
    assert abs(whole - np.quantile([v for _, v in held if v is not None], 0.25)) < 1e-12


def test_strip_and_cache_key(spark):
    import hashlib

    from tracemill.functions.text import strip
    from tracemill.operators.journal import cache_key

    blanks = "　  \x1c \t\n "
    assert spark.createDataFrame([(blanks + "a　b" + blanks,)], "t string").select(strip(F.col("t"))).first()[0] == (blanks + "a　b" + blanks).strip()
    df = spark.createDataFrame([(2, 1, None, (5, None, "x"))], "b int, a int, c string, d struct<z:int,y:string,k:string>")
    assert df.select(cache_key("b", "a", "c", "d")).first()[0] == hashlib.sha1(b'{"a":1,"b":2,"d":{"k":"x","z":5}}').hexdigest()


def test_spelled_cache_key_is_that_of_default_json(spark):
    import hashlib
    import json

    from tracemill.operators.journal import spelled_cache_key

    rows = [("a: b, \"c\\d\" é👍\n", 1, None), ("", -5, "x"), (None, None, "漢,:"), ("k" * 30000 + '\\"', 3, '","')]
    df = spark.createDataFrame(rows, "z string, a bigint, m string")
    nested = F.struct("z", F.array("a", "a").alias("l")).alias("n")
    got = [r[0] for r in df.select(spelled_cache_key("z", "a", nested, "m")).collect()]
    expected = [hashlib.sha1(json.dumps({"z": z, "a": a, "n": {"z": z, "l": [a, a]}, "m": m}, sort_keys=True).encode()).hexdigest() for z, a, m in rows]
    assert got == expected


def test_several_globs_and_context_of_many_turns(spark, tmp_path):
    import json

    from tracemill.sources import records as r
    from tracemill.sources.transcripts import lines_with_numbers, malformed_documents, read_json

    for name in ("a.jsonl", "b.log", "c.txt"):
        (tmp_path / name).write_text("x")
    assert sorted(f.path.rsplit("/")[-1] for f in r.newest_files(spark, str(tmp_path), ["*.jsonl", "*.log"], 5).collect()) == ["a.jsonl", "b.log"]
    turns = [json.dumps({"type": "user", "message": {"content": str(k)}}) for k in range(3000)]
    (tmp_path / "s.jsonl").write_text("\n".join(turns))
    found = r.session_titles(lines_with_numbers(spark, str(tmp_path / "s.jsonl"))).first()
    assert found["context"] == "\n".join(map(str, range(3000)))[:1500] and found["title"] is None
    docs = tmp_path / "docs"
    docs.mkdir()
    for name, text in {"ok.json": '[{"output": "a"}]', "cut.json": '[{"output": ', "text.json": '"x"', "blank.json": " \n", "numbers.json": "[1, 2]"}.items():
        (docs / name).write_text(text)
    assert read_json(spark, str(docs)).count() == 1
    assert {x.file.rsplit("/")[-1]: x.reason for x in malformed_documents(spark, str(docs)).collect()} == {"cut.json": "no JSON", "text.json": "neither list nor object", "numbers.json": "no samples"}


def test_defaults_stand_in_for_false(spark):
    import json

    rows = [{"tool_name": False, "tool_input": {"command": False, "cwd": False, "run_in_background": False}, "tool_response": {"stdout": False, "exit_code": False}, "tool_output": {"exit_code": 2}}, {"tool_name": "false", "tool_response": {"exit_code": 0, "error": True}}]
    got = [r.asDict() for r in r.events(spark.createDataFrame([(json.dumps(x),) for x in rows], "value string")).collect()]
    assert (got[0]["tool"], got[0]["command"], got[0]["cwd"], got[0]["stdout"], got[0]["exit_code"], got[0]["background"]) == ("", "", None, "", "2", False)
    assert (got[1]["tool"], got[1]["exit_code"], got[1]["response"]) == ("false", "0", "true")
