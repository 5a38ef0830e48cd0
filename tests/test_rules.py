import json

import pytest
from pyspark.sql import functions as F

from tracemill.functions import text
from tracemill.operators import lines, rules
from tracemill.sources.records import events
from tracemill.streaming.rules import changed_files, decide_stream, decided, weekly_sessions


def decide(spark, values, rule):
    return [r[0] for r in spark.createDataFrame([(v,) for v in values], "c string").select(rule(F.col("c"))).collect()]


def test_destructive(spark):
    cases = {"sudo rm -r /": "block", "sudo rm -rf /": "allow", "sudo  reboot": "block", "ls | xargs rm -r": "block", "xargs -n1 pkill": "block", "make && kill 3": "warn", "x=$(kill 1)": "warn", "kill 3": "allow", "sudo ls": "allow", "": "allow", "sudo killer": "allow"}
    assert decide(spark, cases, rules.destructive) == list(cases.values())


def test_long_running(spark):
    cases = {
        "sleep 5": "force", "npm ci": "force", "pip3 install x": "force", "uv pip install x": "force", "brew update": "force", "apt-get upgrade": "force", "conda create -n x": "force", "yarn run watch": "force",
        "bun test": "force", "npm run test": "force", "cargo test": "force", "docker build .": "force", "docker compose up": "force", "go test ./...": "force", "python3 -m http.server": "force", "next dev": "force", "vite": "force",
        "git clone u": "force", "python a.py train": "force", "HYDRA_FULL_ERROR=1 x": "force", "pytest -q": "suggest", "docker run x": "suggest", "curl http://a/b.tar": "suggest", "rsync a b": "suggest", "make all": "suggest", "tsc": "suggest",
        "pip install --help": "none", "make clean": "none", "git status && sleep 3": "none", "echo hi": "none", "": "none", "sleepy 3": "none",
    }
    assert decide(spark, cases, rules.long_running) == list(cases.values())
    assert decide(spark, ["sleep 1"], lambda c: rules.long_running(c, mode="suggest")) == ["suggest"]
    assert decide(spark, ["mine"], lambda c: rules.long_running(c, extra="mine")) == ["force"]
    assert decide(spark, ["sleep 1"], lambda c: rules.long_running(c, enabled=False)) == ["none"]
    assert [decide(spark, ["sleep 1"], lambda c, t=t: rules.long_running(c, F.lit(False), F.lit(t)))[0] for t in (0, 1, 30000, 30001)] == ["force", "none", "none", "force"]
    assert decide(spark, ["sleep 1"], lambda c: rules.long_running(c, F.lit(True))) == ["none"]


def test_pipes_experiments_delegation(spark):
    cases = {"a | less": "pager", "git log | head": "git_log_head", "kubectl logs x | tail": "kubectl_logs_tail", "docker logs x | tail": "docker_logs_tail", "docker logs x": "docker_logs_unlimited", "docker logs --tail=2 x": "none", "docker logs x | grep y": "none", "journalctl": "journalctl_unlimited", "journalctl -n 3": "none", "ls": "none"}
    assert decide(spark, cases, rules.pipe_advice) == list(cases.values())
    cases = {"./run_all.sh": True, "inspect  eval x": True, "python run x": True, "uv run python -m my.Evaluation": True, "/a/benchmark_x.py": True, "pytest tests/Eval": True, "python check_transcripts run_x.py": False, "ls": False, "": False}
    assert decide(spark, cases, lambda c: rules.is_experiment(c, F.lit("0"))) == list(cases.values())
    assert decide(spark, ["./run_all.sh"], lambda c: rules.is_experiment(c, F.lit("1"))) == [False]
    tools = {"Read": "read", "Write": "edit", "Grep": "search", "WebFetch": "research", "NotebookEdit": "notebook", "Skill": "none", "Odd": "other"}
    assert decide(spark, tools, lambda c: rules.delegation(c, F.lit(""), F.lit(True))) == list(tools.values())
    assert decide(spark, ["git diff --stat", "git push"], lambda c: rules.delegation(F.lit("Bash"), c, F.lit(True))) == ["none", "command"]
    assert decide(spark, ["git push"], lambda c: rules.delegation(F.lit("Bash"), c, F.lit(False))) == ["none"]


def test_places_and_sizes(spark):
    size = lambda n, limit=None, **k: decide(spark, ["Read"], lambda c: rules.read_size(c, F.lit(n), F.lit(limit), **k))[0]
    assert [size(499), size(500), size(500, 10), size(900, strict=True)] == ["allow", "warn", "allow", "block"]
    plan = lambda p: decide(spark, [p], lambda c: rules.plan_location(c, "/home/me/global/", F.lit("/repo")))[0]
    assert [plan("/home/me/global/x.md"), plan("/repo/plans/x.md"), plan("/repo/20260131_120000_UTC_x.md"), plan("/other/20260131_120000_UTC_x.md")] == ["error", "warn_name", "allow", "warn_place"]
    assert decide(spark, ["/g/x", "/r/x"], lambda c: rules.task_location(c, "/g/")) == ["error", "allow"]
    hint = lambda p, r="File does not exist": decide(spark, [p], lambda c: rules.missing_file_hint(F.lit("Read"), F.lit(r), c))[0]
    assert hint("/a/b/c.py") == 'Glob("**/b/c.py") first, then Glob("**/c.py") if no results'
    assert hint("c.py") == 'Glob("**/c.py") or fd -H "c.py"' and hint("/a/c.py", "fine") is None
    assert decide(spark, ["/r/sub", "/r"], lambda c: rules.folder_check(c, F.lit("/r"))) == ["warn", "allow"]


@pytest.mark.parametrize("n, cut", [(500, False), (501, True)])
def test_line_cut(spark, n, cut):
    line = "é" * n
    got = decide(spark, [line], text.truncate_line)[0]
    assert got == (line[:200] + f" ... [{n} chars] ... " + line[-100:] if cut else line)


def test_output_cut_and_route(spark):
    long = "\n".join(f"line {i} " + "x" * 40 for i in range(46))
    got = decide(spark, [long], text.truncate_stdout)[0].split("\n")
    assert got[:15] == long.split("\n")[:15] and got[-30:] == long.split("\n")[-30:] and got[16] == f"... [{len(long)} chars, 46 lines truncated] ..." and len(got) == 48
    short = "\n".join(long.split("\n")[:45])
    assert decide(spark, [short], text.truncate_stdout) == [short]
    errors = "\n".join(f"e{i} " + "y" * 30 for i in range(25))
    assert decide(spark, [errors], text.truncate_stderr)[0] == "... [stderr truncated] ...\n\n" + "\n".join(errors.split("\n")[-20:])
    route = lambda a, b, c: decide(spark, ["Bash"], lambda t: rules.output_route(t, F.lit("o" * a), F.lit("e" * b), F.lit(c)))[0]
    assert [route(4999, 0, 9), route(5000, 0, 15000), route(5000, 0, 15001), route(2100, 7900, 15001), route(2000, 8000, 15001)] == ["none", "truncate", "gemini", "gemini", "truncate"]


def test_redaction_titles_paths(spark):
    value = "ok\nMY_TOKEN=1\nAuthorization: x\n" + "A" * 100 + "\n" + "B" * 99
    assert decide(spark, [value], text.redact_lines) == ["ok\n" + "B" * 99]
    assert decide(spark, ['"a\x01b" ' + "c" * 80], text.session_title) == ["ab " + "c" * 57]
    assert decide(spark, ["/a/b/c.py", "c.py", "/a/b/"], text.base_name) == ["c.py", "c.py", "b"]
    assert decide(spark, ["/a/b/c.py", "c.py"], text.dir_name) == ["b", ""]
    assert decide(spark, ["\t a \x0b\n"], text.strip) == ["a"]
    assert decide(spark, ["a — b - c-d"], text.dash_asides) == [2]
    assert decide(spark, ["w " * 41 + ". w"], text.run_on_sentences) == [1]


def test_lint_search(spark, rows):
    body = "We leverage it and utilize it\nnothing\nI hope this helps!\nin order to in order to\nleveraged"
    df = spark.createDataFrame([(1, body), (2, ""), (3, None)], "doc_id int, text string")
    assert rows(lines.phrase_lint(df), "line_no", "phrase", "tier", "times") == [(1, "leverage", "likely", 1), (3, "I hope this helps!", "definite", 1), (4, "in order to", "definite", 2), (5, "leverage", "likely", 1)]
    assert rows(lines.lint_score(df), "doc_id", "matches", "band") == [(1, 5, "40-100"), (2, 0, "0-10"), (3, 0, "0-10")]
    text_ = "\n".join("abcdefghij")
    df = spark.createDataFrame([(1, text_), (2, "zz")], "doc_id int, text string")
    assert rows(lines.search(df, "E|f"), "line_no", "line", "is_match") == [(3, "c", False), (4, "d", False), (5, "e", True), (6, "f", True), (7, "g", False), (8, "h", False)]
    assert rows(lines.search(df, "a", 2), "line_no") == [(1,), (2,), (3,)]
    assert rows(lines.slide_count(spark.createDataFrame([(1, "a\n---\nb")], "doc_id int, text string"))) == [(1, 1, 2)]
    checked = lines.lexicon_check(lines.lexicon(spark), spark.createDataFrame([("ai_vocabulary", 3), ("filler_phrases", 4)], "category string, declared int"))
    assert {r.category: r.ok for r in checked.collect()}["ai_vocabulary"] is True and lines.lexicon(spark).count() == 15


def test_other_rules(spark, rows):
    assert decide(spark, ["Typo here", "please clarify", "restructure it", "fine"], rules.edit_complexity) == ["simple", "medium", "complex", None]
    t = spark.createDataFrame([(None,), ((("x", None)),)], "i struct<command:string,run_in_background:boolean>")
    got = t.select(rules.with_override(F.col("i"), "command string, run_in_background boolean", run_in_background=F.lit(True)).alias("i")).collect()
    assert [tuple(r.i) for r in got] == [(None, True), ("x", True)]
    assert decide(spark, ["x"], lambda c: rules.doc_state(F.lit(True), F.lit(False), F.lit(True), F.lit(20), F.lit(True))) == ["MISSING"]
    assert decide(spark, ["x"], lambda c: rules.review_route(F.lit(501), F.lit(0))) == ["async"]


EVENTS = [
    {"tool_name": "Bash", "tool_input": {"command": "sudo rm -r x"}},
    {"tool_name": "Bash", "tool_input": {"command": "sleep 3", "timeout": 30000}},
    {"tool_name": "Bash", "tool_input": {"command": "python run_x.py"}, "tool_response": {"exit_code": 0}},
    {"tool_name": "Read", "tool_input": None, "tool_response": "No such file"},
]


def test_stream_equals_batch(spark, tmp_path, rows):
    source = tmp_path / "in"
    source.mkdir()
    for i, e in enumerate(EVENTS):
        (source / f"{i}.json").write_text(json.dumps(e) + "\nbroken\n")
    decide_stream(spark, str(source), str(tmp_path / "out"), str(tmp_path / "cp"), 2).awaitTermination()
    batch = decided(events(spark.read.text(str(source))))
    assert rows(batch) == rows(spark.read.parquet(str(tmp_path / "out"))) and batch.count() == 4
    assert {tuple(r) for r in batch.select("destructive", "background", "experiment").collect()} == {("block", "none", False), ("allow", "none", False), ("allow", "none", True)}


def test_changed_files_and_weeks(spark, tmp_path, rows):
    (tmp_path / "s").mkdir()
    (tmp_path / "s/a.jsonl").write_text("{}")
    manifest = spark.createDataFrame(changed_files(spark, str(tmp_path / "s"), None).collect())
    (tmp_path / "s/b.jsonl").write_text("{}")
    assert [r.path.rsplit("/", 1)[1] for r in changed_files(spark, str(tmp_path / "s"), manifest).collect()] == ["b.jsonl"]
    assert changed_files(spark, str(tmp_path / "s"), manifest, force=True).count() == 2
    sessions = spark.createDataFrame([("2026-01-04 10:00:00", True), ("2026-01-05 10:00:00", False), ("2026-01-11 23:00:00", True)], "ts string, success boolean")
    assert [(str(a), b, c) for a, b, c in rows(weekly_sessions(sessions))] == [("2025-12-29", 1, 1.0), ("2026-01-05", 2, 0.5)]


def test_monitored_runs_keep_state(spark, tmp_path):
    from tracemill.streaming.rules import monitored_runs

    source = tmp_path / "runs"
    source.mkdir()
    seen = {}

    def keep(batch, _):
        seen.update({r.experiment: (r.runs, r.spent, r.failures, r.stop) for r in batch.collect()})

    batches = [[("a", 1, 2.0, True), ("a", 2, 3.0, False), ("b", 1, None, None)], [("a", 3, 1.0, False), ("b", 2, 1.0, True)], [("a", 4, 0.5, False), ("b", 3, 99.0, True)]]
    for i, rows_ in enumerate(batches):
        (source / f"{i}.json").write_text("\n".join(json.dumps(dict(zip(("experiment", "ts", "cost", "ok"), r))) for r in rows_))
        stream = spark.readStream.schema("experiment string, ts bigint, cost double, ok boolean").json(str(source))
        query = monitored_runs(stream, 50.0).writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        query.awaitTermination()
        if i == 1:
            assert seen == {"a": (3, 6.0, 2, False), "b": (2, 1.0, 0, False)}
    assert seen == {"a": (4, 6.5, 3, True), "b": (3, 100.0, 0, True)}
