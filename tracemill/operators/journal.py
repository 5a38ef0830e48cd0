"""Operators over ordered records: loops of runs, budgets, streaks, last values, trends, staleness, caches."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tracemill.operators.segments import PART, Segments


def last_wins(rows: DataFrame, by: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The last row of each key: a grouped maximum (summed up in each task first), not a window over whole groups."""
    rest = [c for c in rows.columns if c not in by]
    held = F.max_by(F.struct(*rest), F.struct(*order)).alias("last")
    return rows.groupBy(*by).agg(held).select(*by, *[F.col(f"last.{c}").alias(c) for c in rest]).select(rows.columns)


def running_best(runs: DataFrame, by: Sequence[str], order: Sequence[str], metric: str, higher: bool = False) -> DataFrame:
    """runs with the best before each and whether the run is better; equal is not better, the first is."""
    seg, least = Segments(runs, by, order), "max" if higher else "min"
    within = getattr(F, least)(metric).over(seg.window().rowsBetween(Window.unboundedPreceding, -1))
    rows = seg.carry(seg.rows.withColumn("best_before", within), _carried=(getattr(F, least)(metric), least))
    rows = rows.withColumn("best_before", (F.greatest if higher else F.least)("best_before", "_carried")).drop("_carried", PART)
    better = F.col(metric) > F.col("best_before") if higher else F.col(metric) < F.col("best_before")
    return rows.withColumn("keep", F.col("best_before").isNull() | better)


def budget_stop(runs: DataFrame, by: Sequence[str], order: Sequence[str], cost: str, budget: float, reserve: float = 0.0) -> DataFrame:
    """runs with what is spent up to each, and whether it may run: the sum stays within the budget less a reserve."""
    seg = Segments(runs, by, order)
    return seg.summed(seg.rows, F.col(cost), "spent").drop(PART).withColumn("may_run", F.col("spent") <= budget - reserve)


def streaks(runs: DataFrame, by: Sequence[str], order: Sequence[str], failed: Column, least: int = 3) -> DataFrame:
    """by, first and last of the order columns, length: runs of `least` or more failures in a row. A failure's number less the
    failures up to it is the same within a streak, however many segments it spans."""
    rows = runs.select(*by, F.struct(*order).alias("at"), F.coalesce(failed, F.lit(False)).alias("failed"))
    seg = Segments(rows, by, ["at"])
    numbered = seg.summed(seg.numbered("i"), F.col("failed").cast("bigint"), "f")
    inside = numbered.where("failed").withColumn("island", F.col("i") - F.col("f"))
    found = inside.groupBy(*by, "island").agg(F.count("*").alias("length"), F.min("at").alias("first"), F.max("at").alias("last"))
    return found.where(F.col("length") >= least).select(*by, *[F.col(f"first.{c}").alias(f"first_{c}") for c in order], *[F.col(f"last.{c}").alias(f"last_{c}") for c in order], "length")


def nth_run(runs: DataFrame, by: Sequence[str], order: Sequence[str], most: int) -> DataFrame:
    """runs with their number within the key, and whether it is within the cap (runs per idea, tries per experiment)."""
    return Segments(runs, by, order).numbered("run").drop(PART).withColumn("allowed", F.col("run") <= most)


def token_bucket(calls: DataFrame, by: Sequence[str], at: str, order: Sequence[str], rate: float, size: float) -> DataFrame:
    """calls with `tokens`, what the key's bucket holds after each, and `wait_s`, how long the call has to wait for its token
    (our own definition). A bucket starts full with `size` tokens, gains `rate` a second up to that, and each call takes one, on
    credit if need be. Unrolled, that is rate * t - i + the least of size - rate * t + i - 1 over the calls so far (t seconds,
    i calls of the key): a running minimum, so calls of a key may be scanned in segments. A null time gives nulls."""
    seg = Segments(calls.where(F.col(at).isNotNull()), by, [at, *order])
    rows = seg.numbered("_i").withColumn("_t", F.unix_micros(F.col(at).cast("timestamp")) / 1e6 * rate)
    low = F.lit(float(size)) - F.col("_t") + F.col("_i") - 1
    rows = rows.withColumn("_low", low).withColumn("_within", F.min("_low").over(seg.window().rowsBetween(Window.unboundedPreceding, 0)))
    rows = seg.carry(rows, _carried=(F.min("_low"), "min"))
    rows = rows.withColumn("tokens", F.col("_t") - F.col("_i") + F.least("_within", "_carried"))
    return rows.withColumn("wait_s", F.greatest(F.lit(0.0), -F.col("tokens")) / rate).drop("_i", "_t", "_low", "_within", "_carried", PART)


def weekly_trend(sessions: DataFrame, at: str, success: Column, by: Sequence[str] = ()) -> DataFrame:
    """week (its Monday), sessions, success_rate."""
    return sessions.groupBy(*by, F.date_trunc("week", F.col(at)).cast("date").alias("week")).agg(F.count("*").alias("sessions"), F.avg(success.cast("int")).alias("success_rate"))


def since(rows: DataFrame, at: str, now: Column, days: int | None = None, project: str | None = None, column: str = "project") -> DataFrame:
    """rows of the last `days` days and of one project; either may be left out."""
    if days is not None:
        rows = rows.where(F.col(at) >= now - F.make_interval(days=F.lit(days)))
    return rows if project is None else rows.where(F.col(column) == project)


def whole_days(later: Column, earlier: Column) -> Column:
    """Elapsed days, rounded down (not calendar days)."""
    return F.floor((F.unix_timestamp(later) - F.unix_timestamp(earlier)) / 86400).cast("bigint")


def staleness(code_epoch: Column, docs_epoch: Column, commits_in_week: Column) -> Column:
    """Whether code is further ahead of docs than its activity allows: 7 days when busy, 14 when active, else never."""
    allowed = F.when(commits_in_week > 10, 7).when(commits_in_week >= 1, 14).otherwise(999)
    days = F.floor((code_epoch - docs_epoch) / 86400)
    return F.coalesce((code_epoch > 0) & (docs_epoch > 0) & (days > allowed), F.lit(False))


def reflection_due(last: Column, now: Column, days: int = 14) -> Column:
    return whole_days(now, last.cast("timestamp")) > days


def commit_activity(commits: DataFrame, now_epoch: int, prefix: Sequence[str]) -> DataFrame:
    """last (epoch) and last_week (count) of commits (epoch, path) below the prefixes."""
    inside = F.lit(False)
    for p in prefix:
        inside = inside | F.startswith(F.col("path"), F.lit(p))
    return commits.where(inside).agg(F.coalesce(F.max("epoch"), F.lit(0)).alias("last"), F.count_if(F.col("epoch") >= now_epoch - 7 * 86400).alias("last_week"))


def cached(requests: DataFrame, cache: DataFrame, key: str = "key", value: str = "response") -> DataFrame:
    """requests with their cached value and whether there was one; an empty value is a miss. cache: last_wins of the log."""
    held = cache.select(key, value).where(F.col(value) != "")
    return requests.join(held, key, "left").withColumn("hit", F.col(value).isNotNull())


def hit_rate(found: DataFrame) -> DataFrame:
    return found.agg(F.avg(F.col("hit").cast("int")).alias("hit_rate"))


def cache_key(*values: Column) -> Column:
    """SHA-1 of the named values as compact JSON, nulls left out and names sorted, in nested records too (a variant keeps
    its fields in the order of their names)."""
    return F.sha1(F.to_json(F.parse_json(F.to_json(F.struct(*values)))))


def spelled_cache_key(*values: Column) -> Column:
    """SHA-1 of the named values as JSON with a space behind each comma and colon, nulls kept, names sorted, and characters
    beyond ASCII as \\u escapes: what the common encoders write by default."""
    text = F.to_json(F.parse_json(F.to_json(F.struct(*values), {"ignoreNullFields": "false"})), {"ignoreNullFields": "false"})
    quoted = r'"[^"\\]*+(?:\\.[^"\\]*+)*+"'
    spaced = F.regexp_replace(text, rf'\G((?:{quoted}|[^":,])++)([:,])', "$1$2 ")
    unit = lambda n: F.lower(F.concat(F.lit("\\u"), F.lpad(F.hex(n), 4, "0")))
    pair = lambda n: F.concat(unit(F.lit(0xD800) + F.shiftright(n - 0x10000, 10)), unit(F.lit(0xDC00) + (n - 0x10000).bitwiseAND(0x3FF)))
    escaped = F.array_join(F.transform(F.split(spaced, ""), lambda c: F.when(F.ascii(c) < 128, c).when(F.ascii(c) < 0x10000, unit(F.ascii(c))).otherwise(pair(F.ascii(c)))), "")
    return F.sha1(F.when(spaced.rlike(r"[^\x00-\x7f]"), escaped).otherwise(spaced))


def first_existing(rows: DataFrame, key: str, places: Sequence[DataFrame], value: str) -> DataFrame:
    """rows with the value of the first place (in order) that has the key."""
    for i, place in enumerate(places):
        rows = rows.join(place.select(key, F.col(value).alias(f"_{i}")), key, "left")
    names = [f"_{i}" for i in range(len(places))]
    return rows.withColumn(value, F.coalesce(*names)).drop(*names)


def missing(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Rows of left whose key right does not have."""
    return left.join(right.select(key), key, "left_anti")


def overlap(train: DataFrame, test: DataFrame, text: str = "text") -> DataFrame:
    """Rows of test whose text, lower-cased and with white space evened out, is in train (our own definition)."""
    even = lambda df: F.md5(F.trim(F.regexp_replace(F.lower(df[text]), r"\s+", " ")).cast("binary"))
    return test.withColumn("_k", even(test)).join(train.select(even(train).alias("_k")), "_k", "left_semi").drop("_k")


def phase_pairs(log: DataFrame) -> DataFrame:
    """START rows (exit null) of a command log with the END that follows for the same command and folder."""
    w = Window.partitionBy("cmd", "cwd").orderBy("ts", F.col("exit").isNotNull())
    rows = log.withColumn("end_ts", F.lead("ts").over(w)).withColumn("end_exit", F.lead("exit").over(w))
    return rows.where("exit is null").select("ts", "cmd", "cwd", F.when(F.col("end_exit").isNotNull(), F.col("end_ts")).alias("end_ts"), "end_exit")


def newest_first(entries: DataFrame, section: str, at: str) -> DataFrame:
    return entries.orderBy(section, F.desc(at))


def status_tally(threads: DataFrame, status: str = "status") -> DataFrame:
    return threads.groupBy(status).agg(F.count("*").alias("n"))


def to_process(threads: DataFrame, status: str = "status") -> DataFrame:
    """Threads that are open or in progress; done, skipped and blocked ones stay out."""
    return threads.where(F.col(status).isin("📋", "⏳"))
