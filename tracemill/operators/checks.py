"""Deterministic checks of samples (idx, id, output, score, score_label).

All checks share one pass: rows are summed up by score (with partial sums in each task), and the few numbers that the
findings need are taken from that. Findings carry counts and the first affected ids; affected() has all of them as
rows, since a list in one row would grow with the data."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tracemill.functions.text import contains_any, strip

# What refusals and tool errors say.
REFUSALS = ("i cannot", "i'm sorry", "as an ai", "i apologize", "i'm not able", "i must decline")
TOOL_ERRORS = ("timeout", "permission denied", "api error", "rate limit", "connection refused")
SHORT = 10
# The longer lists of what to look for when a transcript is reviewed, and the marks of a cut at the end.
RED_FLAGS = {
    "refusal": ("I cannot", "I can't", "I'm sorry", "I apologize", "as an AI", "as a language model", "I'm not able to", "I must decline", "I'm unable to", "It would be inappropriate"),
    "eval_aware": ("this is a test", "being evaluated", "benchmark", "being tested", "being assessed", "evaluation", "appears to be a", "seems like a test"),
    "error": ("Error:", "Traceback", "Exception", "Permission denied", "timeout", "rate limit", "connection refused", "404", "500", "OOM", "out of memory", "killed"),
}
CUT_MARKS = ("[truncated]", "...")


def flags(output: Column, refusals: Sequence[str] = REFUSALS, errors: Sequence[str] = TOOL_ERRORS) -> dict[str, Column]:
    text = F.coalesce(output, F.lit(""))
    return {"empty": F.length(strip(text)) < SHORT, "refusal": contains_any(text, refusals), "tool_error": contains_any(text, errors)}


def totals(samples: DataFrame, refusals: Sequence[str] = REFUSALS, errors: Sequence[str] = TOOL_ERRORS) -> DataFrame:
    """One row of counts. NaN scores count as scored and failed, but not among distinct values."""
    score = F.col("score")
    read = samples.select(F.when(~F.isnan(score), score).alias("value"), score.isNull().alias("unscored"), F.col("score_label").alias("label"), *[c.cast("int").alias(k) for k, c in flags(F.col("output"), refusals, errors).items()])
    groups = read.groupBy("value", "unscored", "label").agg(F.count("*").alias("n"), *[F.sum(k).alias(k) for k in ("empty", "refusal", "tool_error")])
    add = lambda c, when=None: F.coalesce(F.sum(F.col(c) if when is None else F.when(when, F.col(c))), F.lit(0))
    known = F.col("value").isNotNull()
    return groups.agg(
        add("n").alias("total"), add("n", F.col("label") == "pass").alias("passed"), add("n", F.col("label") == "fail").alias("failed"), add("n", F.col("unscored")).alias("unscored"),
        add("n", known).alias("scores"), F.count(F.when(known, 1)).alias("distinct_scores"), F.min(F.when(known, F.col("n"))).alias("rarest"), F.max(F.when(known, F.col("n"))).alias("commonest"),
        *[add(k).alias(k) for k in ("empty", "refusal", "tool_error")],
    )


def findings(samples: DataFrame, refusals: Sequence[str] = REFUSALS, errors: Sequence[str] = TOOL_ERRORS) -> DataFrame:
    """severity, type, affected, message; no rows for an empty input."""
    t = totals(samples, refusals, errors)
    rate = F.col("passed") / F.nullif(F.col("passed") + F.col("failed"), F.lit(0))
    percent = lambda c: F.format_string("%.1f%%", F.bround(c * 100, 1))
    share = lambda n: F.col(n) / F.nullif(F.col("scores"), F.lit(0))
    uniform = (F.col("distinct_scores") == 2) & (F.col("scores") >= 10) & share("rarest").between(0.45, 0.55) & share("commonest").between(0.45, 0.55)
    same = (F.col("scores") >= 3) & (F.col("distinct_scores") == 1)

    def found(when: Column, severity: Column | str, kind: str, affected: Column, *message: Column | str) -> Column:
        text = F.concat(*[F.lit(m) if isinstance(m, str) else m.cast("string") for m in message])
        level = F.lit(severity) if isinstance(severity, str) else severity
        return F.when(when, F.struct(level.alias("severity"), F.lit(kind).alias("type"), affected.cast("bigint").alias("affected"), text.alias("message")))

    n = F.col
    rows = F.array(
        found(same, "CRITICAL", "degenerate_scores", n("scores"), "All ", n("scores"), " scores are identical"),
        found(uniform, "WARNING", "degenerate_scores", F.lit(0), "Suspiciously uniform score distribution"),
        found(n("empty") > 0, F.when(n("empty") > n("total") * 0.1, "CRITICAL").otherwise("WARNING"), "empty_truncated_responses", n("empty"), n("empty"), " samples have empty or very short (<10 char) responses"),
        found(n("refusal") > 0, F.when(n("refusal") >= n("total") * 0.5, "CRITICAL").otherwise("WARNING"), "refusal_markers", n("refusal"), n("refusal"), " samples contain refusal language"),
        found(n("tool_error") > 0, "WARNING", "tool_call_errors", n("tool_error"), n("tool_error"), " samples contain tool/API error markers"),
        found((n("total") >= 20) & (rate > 0.9), "WARNING", "score_distribution_anomaly", F.lit(0), "Very high pass rate: ", percent(rate)),
        found((n("total") >= 20) & (rate < 0.1), "WARNING", "score_distribution_anomaly", F.lit(0), "Very high fail rate: ", percent(1 - rate)),
        found((n("unscored") > 0) & (n("unscored") < n("total")), "WARNING", "format_parsing_failures", n("unscored"), n("unscored"), "/", n("total"), " samples have null scores"),
    )
    return t.select(F.explode(F.filter(rows, lambda x: x.isNotNull())).alias("f")).select("f.*")


def affected(samples: DataFrame, refusals: Sequence[str] = REFUSALS, errors: Sequence[str] = TOOL_ERRORS) -> DataFrame:
    """type, idx, id of every sample that a per-sample finding is about."""
    kinds = {"empty": "empty_truncated_responses", "refusal": "refusal_markers", "tool_error": "tool_call_errors"}
    hits = [F.when(c, F.lit(kinds[k])) for k, c in flags(F.col("output"), refusals, errors).items()]
    hits.append(F.when(F.col("score").isNull(), F.lit("format_parsing_failures")))
    return samples.select(F.explode(F.array_compact(F.array(*hits))).alias("type"), "idx", "id")


def first_affected(samples: DataFrame, most: int = 5, **lexicons) -> DataFrame:
    """type, ids (the first `most` in input order), more (how many others there are)."""
    rows = affected(samples, **lexicons)
    counts = rows.groupBy("type").agg(F.count("*").alias("n"))
    first = rows.withColumn("rank", F.row_number().over(Window.partitionBy("type").orderBy("idx", "id"))).where(F.col("rank") <= most)
    ids = first.groupBy("type").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "id"))), lambda x: x["id"]).alias("ids"))
    return ids.join(counts, "type").select("type", "ids", F.greatest(F.col("n") - most, F.lit(0)).alias("more"))


def score_distribution(samples: DataFrame) -> DataFrame:
    """label, n with a row for pass, fail and error each, also where there are none."""
    counts = samples.groupBy("score_label").agg(F.count("*").alias("n"))
    every = counts.sparkSession.createDataFrame([("pass",), ("fail",), ("error",)], "label string")
    return every.join(counts, F.col("label") == F.col("score_label"), "left").select("label", F.coalesce("n", F.lit(0)).alias("n"))


def summary(samples: DataFrame, source: str, kind: str, chosen: DataFrame) -> DataFrame:
    """One row: source, format, counts, findings and what was drawn (chosen, with its stratum)."""
    spread = score_distribution(samples).agg(F.map_from_entries(F.collect_list(F.struct("label", "n"))).alias("score_distribution"), F.sum("n").alias("total_samples"))
    issues = findings(samples).agg(F.collect_list(F.struct("severity", "type", "affected", "message")).alias("issues"))
    parts = chosen.groupBy("stratum").agg(F.count("*").alias("n"))
    parts = parts.agg(F.map_from_entries(F.collect_list(F.struct("stratum", "n"))).alias("extraction_breakdown"), F.coalesce(F.sum("n"), F.lit(0)).alias("samples_extracted"))
    return spread.join(issues).join(parts).select(F.lit(source).alias("source"), F.lit(kind).alias("format_detected"), "total_samples", "score_distribution", "issues", "samples_extracted", "extraction_breakdown")


def red_flags(samples: DataFrame, by: Sequence[str] = (), key: str = "id", output: str = "output", lists: dict[str, Sequence[str]] = RED_FLAGS, share: float = 0.5) -> DataFrame:
    """by, key, n_chars, expected, a flag for each list, and truncated, for every sample. Lists are matched without regard to
    case. A response counts as truncated if it ends in a mark of a cut, or if it stops within a sentence and is shorter
    than `share` of what is expected, the exact median of its group (by; all samples, if empty). A null output is an empty one."""
    from tracemill.operators import stats

    text = strip(F.coalesce(F.col(output), F.lit("")))
    low = F.lower(text)
    found = {k: reduce(lambda x, y: x | y, [F.contains(low, F.lit(m.lower())) for m in marks], F.lit(False)) for k, marks in lists.items()}
    marked = reduce(lambda x, y: x | y, [F.endswith(low, F.lit(m)) for m in CUT_MARKS])
    read = samples.select(*by, key, F.length(text).alias("n_chars"), *[c.alias(k) for k, c in found.items()], marked.alias("_marked"), (~text.rlike(r"[.!?:;\"'`)\]}]$")).alias("_open"))
    medians = stats.quantiles(read, by, "n_chars", (0.5,)).select(*by, F.col("q")[0].alias("expected"))
    same = [F.col(f"r.{c}").eqNullSafe(F.col(f"m.{c}")) for c in by]
    rows = read.alias("r").join(F.broadcast(medians).alias("m"), reduce(lambda x, y: x & y, same)) if by else read.alias("r").join(F.broadcast(medians).alias("m"), how="cross")
    cut = F.col("_marked") | F.col("_open") & (F.col("n_chars") < share * F.col("expected"))
    return rows.select(*[F.col(f"r.{c}").alias(c) for c in [*by, key]], "n_chars", "expected", *found, cut.alias("truncated"))


def red_flag_counts(flagged: DataFrame, by: Sequence[str] = (), lists: dict[str, Sequence[str]] = RED_FLAGS) -> DataFrame:
    """n and the samples with each flag, by group."""
    return flagged.groupBy(*by).agg(F.count("*").alias("n"), *[F.count_if(k).alias(k) for k in [*lists, "truncated"]])
