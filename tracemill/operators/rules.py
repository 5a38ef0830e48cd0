"""Ordered rules over tool events: the first that matches decides. A rule set becomes one CASE expression, so the same
code serves batch and streaming frames. Cheap literal tests stand before regular expressions."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracemill.functions.text import base_name, dir_name

Rule = tuple[Column, str]


def cascade(rules: Sequence[Rule], default: str = "allow") -> Column:
    """The action of the first rule whose condition holds. A null condition does not hold."""
    out = F.lit(default)
    for when, action in reversed(rules):
        out = F.when(when, F.lit(action)).otherwise(out)
    return out


def any_contains(text: Column, marks: Sequence[str]) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(text, F.lit(m)) for m in marks])


# The rules' patterns and literals, in order.
SUDO = r"\bsudo\s+(rm\s+-r|kill|killall|pkill|shutdown|reboot|halt|mkfs|fdisk|wipefs|dd)\b"
XARGS = r"\bxargs\s+.*(rm\s+-r|kill|killall|pkill)\b"
COMPOUND_KILL = r"(&&|;|\|\||`|\$\()\s*(kill|killall|pkill)\b"

NOT_LONG = (
    "--version", "--help", "--dry-run", " -h", " -V", "pip list", "pip show", "pip freeze", "npm list", "npm ls", "npm --version",
    "brew list", "brew info", "docker ps", "docker images", "docker inspect", "git status", "git log", "git diff", "git branch", "git show",
    "make -n", "make clean", "make help", "make format", "make lint", "make check", "npm run lint", "npm run format", "pnpm run lint",
    "pnpm run format", "yarn lint", "yarn format", "bun run lint", "bun run format",
)
LONG = (
    r"\bsleep\s+[0-9]", r"\b(npm|yarn|pnpm|bun)\s+(install|ci|add)\b", r"\b(pip|pip3)\s+install\b", r"\buv\s+(sync|pip\s+install|add)\b",
    r"\bbrew\s+(install|upgrade|update)\b", r"\b(apt|apt-get)\s+(install|update|upgrade|dist-upgrade)\b", r"\bconda\s+(install|update|create)\b",
    r"\b(npm|yarn|pnpm|bun)\s+run\s+(build|dev|start|serve|watch)\b", r"\b(npm|yarn|pnpm|bun)\s+(test|start)\b", r"\b(npm|yarn|pnpm|bun)\s+run\s+test\b",
    r"\bcargo\s+(build|test)\b", r"\bdocker\s+build\b", r"\bdocker\s+compose\s+(up|build)\b", r"\bgo\s+test\s+\./\.\.\.",
    r"\b(python|python3).*\b(manage\.py\s+runserver|http\.server|flask\s+run|uvicorn|gunicorn)\b", r"\bnext\s+(dev|start)\b", r"\bvite(\s|$)",
    r"\bgit\s+clone\b", r"\b(python3?|uv\s+run)\s+.*\b(train|finetune|eval)\b", r"HYDRA_FULL_ERROR",
)
MAYBE_LONG = (r"\bpytest\b", r"\bdocker\s+(exec|run)\b", r"\b(wget|curl)\b.*\.(tar|zip|gz)\b", r"\b(rsync|scp)\b", r"\bmake\b", r"\btsc(\s|$)")
SHORT_TIMEOUT_MS = 30000

PAGER = r"\|\s*(less|more)\b"
GIT_LOG_HEAD = r"\bgit\s+log\b.*\|\s*head\b"
KUBECTL_LOGS_TAIL = r"\bkubectl\s+logs\b.*\|\s*tail\b"
DOCKER_LOGS_TAIL = r"\bdocker\s+logs\b.*\|\s*tail\b"
DOCKER_LOGS = r"\bdocker\s+logs\b"
JOURNALCTL = r"\bjournalctl\b"
JOURNALCTL_LIMIT = r"(\s-n\b|--lines)"

OWN_TOOLS = ("check_transcripts", "scout scan", "transcript_review")
EXPERIMENTS = (
    r"run_[a-zA-Z0-9_]*\.(py|sh)", r"inspect\s+eval", r"(python3?|uv\s+run\s+python3?)\s+(run_|run\s)",
    r"(python3?|uv\s+run\s+python3?)\s+-m\s+.*([Ee]val|[Ee]xperiment|[Bb]enchmark)",
    r"(^|[/\s])(eval|experiment|benchmark|scaffold|latteries|safety.tooling)[a-zA-Z0-9_]*\.(py|sh)", r"pytest.*([Ee]val|[Bb]enchmark)",
)

COORDINATION_TOOLS = (
    "Agent", "SendMessage", "TaskCreate", "TaskUpdate", "TaskGet", "TaskList", "TaskOutput", "TaskStop", "TodoWrite", "TodoRead", "EnterPlanMode",
    "ExitPlanMode", "Skill", "AskUserQuestion", "ToolSearch", "Config",
)
READ_ONLY_GIT = r"^\s*git\s+(status|log|diff\s+--stat|branch|remote)"
NOT_FOUND = r"(?i)does not exist|no such file|ENOENT|not found"
PLAN_NAME = r"^[0-9]{8}_[0-9]{6}_UTC"


def destructive(command: Column) -> Column:
    """block, warn or allow. The patterns end at a word's end, so `rm -r` is met and `rm -rf` is not."""
    return cascade([(command.rlike(SUDO), "block"), (command.rlike(XARGS), "block"), (command.rlike(COMPOUND_KILL), "warn")])


def long_running(command: Column, background: Column | None = None, timeout: Column | None = None, mode: str = "force", extra: str | None = None, enabled: bool = True) -> Column:
    """force or suggest running in the background, or none. `extra` is one more pattern for the first tier."""
    if not enabled:
        return F.lit("none")
    first = F.lit(False) if background is None else F.coalesce(background, F.lit(False))
    ms = F.lit(0) if timeout is None else F.coalesce(timeout, F.lit(0))
    skip = (command == "") | first | ((ms > 0) & (ms <= SHORT_TIMEOUT_MS)) | any_contains(command, NOT_LONG)
    tier1 = "|".join([*LONG, *([extra] if extra else [])])
    return cascade([(skip, "none"), (command.rlike(tier1), mode), (command.rlike("|".join(MAYBE_LONG)), "suggest")], "none")


def pipe_advice(command: Column) -> Column:
    """Which advice a command's pipes or missing limits call for."""
    piped = command.rlike(r"\|")
    return cascade(
        [
            (command.rlike(PAGER), "pager"),
            (command.rlike(GIT_LOG_HEAD), "git_log_head"),
            (command.rlike(KUBECTL_LOGS_TAIL), "kubectl_logs_tail"),
            (command.rlike(DOCKER_LOGS_TAIL), "docker_logs_tail"),
            (command.rlike(DOCKER_LOGS) & ~F.contains(command, F.lit("--tail")) & ~piped, "docker_logs_unlimited"),
            (command.rlike(JOURNALCTL) & ~command.rlike(JOURNALCTL_LIMIT) & ~piped, "journalctl_unlimited"),
        ],
        "none",
    )


def is_experiment(command: Column, exit_code: Column) -> Column:
    """Whether a command that succeeded ran an experiment (and is not one of the review tools)."""
    ok = F.coalesce(exit_code.cast("string"), F.lit("0")) == "0"
    return (command != "") & ok & ~any_contains(command, OWN_TOOLS) & command.rlike("|".join(EXPERIMENTS))


def delegation(tool: Column, command: Column, active: Column) -> Column:
    """What kind of work an orchestrating session should hand on; none where it may do it itself."""
    return cascade(
        [
            (~F.coalesce(active, F.lit(False)), "none"),
            (tool.isin(*COORDINATION_TOOLS), "none"),
            ((tool == "Bash") & command.rlike(READ_ONLY_GIT), "none"),
            (tool == "Read", "read"),
            (tool.isin("Edit", "Write"), "edit"),
            (tool == "Bash", "command"),
            (tool.isin("Grep", "Glob"), "search"),
            (tool.isin("WebFetch", "WebSearch"), "research"),
            (tool == "NotebookEdit", "notebook"),
        ],
        "other",
    )


def read_size(tool: Column, line_count: Column, limit: Column, threshold: int = 500, strict: bool = False) -> Column:
    """Reading a long file whole is blocked (strict) or warned about; the count is of newlines."""
    return cascade([(tool != "Read", "allow"), (line_count.isNull(), "allow"), (limit.isNotNull(), "allow"), (line_count < threshold, "allow")], "block" if strict else "warn")


def plan_location(path: Column, global_folder: str, repository: Column) -> Column:
    """error for a plan in the global folder; warn for a name without a time stamp or a place outside the repository."""
    named = base_name(path).rlike(PLAN_NAME)
    outside = (repository != "") & ~F.contains(path, repository)
    return cascade([(F.startswith(path, F.lit(global_folder)), "error"), (~named, "warn_name"), (F.coalesce(outside, F.lit(False)), "warn_place")])


def task_location(path: Column, global_folder: str) -> Column:
    return cascade([(F.startswith(path, F.lit(global_folder)), "error")])


def folder_check(cwd: Column, root: Column) -> Column:
    return cascade([(root.isNotNull() & (root != "") & (cwd != root), "warn")])


# The hint's wording, an output that must match; with and without the folder's name.
HINTS = ('Glob("**/%s/%s") first, then Glob("**/%s") if no results', 'Glob("**/%s") or fd -H "%s"')


def missing_file_hint(tool: Column, response: Column, path: Column) -> Column:
    """Where to look for a file that was not found; null where that is not the matter."""
    name, folder = base_name(path), dir_name(path)
    hint = F.when(folder != "", F.format_string(HINTS[0], folder, name, name)).otherwise(F.format_string(HINTS[1], name, name))
    return F.when((tool == "Read") & response.rlike(NOT_FOUND) & (name != ""), hint)


def output_route(tool: Column, stdout: Column, stderr: Column, cut: Column, smallest: int = 5000, largest: int = 15000, large: str = "gemini", mostly_errors: int = 80) -> Column:
    """none, truncate, or the name of the way for output that is large even when cut (unless it is mostly errors).
    cut: the length of the output once truncated."""
    total = F.length(stdout) + F.length(stderr)
    errors = F.floor(F.length(stderr) * 100 / F.nullif(total, F.lit(0)))
    return cascade([((tool != "Bash") | (total < smallest), "none"), (cut <= largest, "truncate"), (errors >= mostly_errors, "truncate")], large)


def with_override(tool_input: Column, schema: str, **values: Column) -> Column:
    """tool_input (a struct of the DDL schema) with fields set; a null input counts as an empty one."""
    out = F.coalesce(tool_input, F.from_json(F.lit("{}"), schema))
    for k, v in values.items():
        out = out.withField(k, v)
    return out


def confidence_tier(confidence: Column) -> Column:
    """definite from 90, likely from 70, ambiguous from 50; null below."""
    return F.when(confidence >= 90, "definite").when(confidence >= 70, "likely").when(confidence >= 50, "ambiguous")


def report_part(confidence: Column) -> Column:
    """The part of a report that a finding goes to: high above 85, medium from 70 on; null below, which is not reported."""
    return F.when(confidence > 85, "high").when(confidence >= 70, "medium")


def edit_complexity(comment: Column) -> Column:
    """complex, medium or simple by the words of a review comment; null if none is there."""
    low = F.lower(comment)
    return F.when(any_contains(low, ("restructure", "move to")), "complex").when(any_contains(low, ("rewrite", "clarify")), "medium").when(any_contains(low, ("typo", "nit")), "simple")


def doc_state(in_code: Column, in_docs: Column, active: Column, last_log_days: Column, stale: Column) -> Column:
    return F.when(in_code & ~in_docs, "MISSING").when(active & (last_log_days > 14), "ABANDONED").when(stale, "STALE").otherwise("OK")


def review_route(lines_changed: Column, minutes: Column) -> Column:
    return F.when((lines_changed > 500) | (minutes > 1), "async").otherwise("sync")


# What is done about a failed call, by its status.
RETRIES = [("429", "backoff"), ("503", "backoff"), ("500", "backoff"), ("400", "skip"), ("401", "fail"), ("timeout", "retry")]


def retry_policy(calls: DataFrame, status: str = "status", attempt: str = "attempt", most: int = 3) -> DataFrame:
    """calls with policy (null: none known) and the seconds to wait before the next attempt (1, 2, 4, 8, 16)."""
    known = F.create_map(*[F.lit(x) for pair in RETRIES for x in pair])
    policy = F.try_element_at(known, F.col(status).cast("string"))
    policy = F.when((policy == "retry") & (F.col(attempt) > most), "fail").otherwise(policy)
    return calls.withColumn("policy", policy).withColumn("wait_s", F.when(F.col("policy") == "backoff", F.least(F.pow(F.lit(2), F.col(attempt) - 1), F.lit(16.0))))


def decision(action: Column, message: Column) -> Column:
    """A rule's answer as struct(exit_code, body): blocked with a reason, allowed with a message, or nothing to say."""
    body = F.when(action == "block", F.to_json(F.struct(F.lit("block").alias("decision"), message.alias("reason")))).when(action.isin("warn", "suggest"), F.to_json(F.struct(F.lit("allow").alias("decision"), message.alias("systemMessage"))))
    return F.struct(F.when(action == "block", 2).when(action == "error", 1).otherwise(0).alias("exit_code"), body.alias("body"))
