"""The rule sets over streams, and incremental reading of folders."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracemill.operators import rules
from tracemill.sources.records import events


def decided(found: DataFrame, mode: str = "force") -> DataFrame:
    """events() with the decision of each rule set; the same for batch and streaming frames."""
    c = F.col("command")
    return found.select(
        "tool", "command", rules.destructive(c).alias("destructive"), rules.long_running(c, F.col("background"), F.col("timeout"), mode).alias("background"),
        rules.pipe_advice(c).alias("pipe"), F.coalesce(rules.is_experiment(c, F.col("exit_code")), F.lit(False)).alias("experiment"),
    )


def decide_stream(spark: SparkSession, source: str, target: str, checkpoint: str, files_per_trigger: int = 100):
    """Decisions for event files as they come, appended as Parquet. Runs until all that is there is done."""
    lines = spark.readStream.schema("value string").option("maxFilesPerTrigger", files_per_trigger).text(source)
    writer = decided(events(lines)).writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint)
    return writer.outputMode("append").trigger(availableNow=True).start()


def weekly_sessions(sessions: DataFrame, at: str = "ts", late: str = "1 day") -> DataFrame:
    """Sessions a week (from Monday) and their success rate over a stream; weeks close once `late` has passed."""
    rows = sessions.withColumn("_at", F.col(at).cast("timestamp")).withWatermark("_at", late)
    weeks = rows.groupBy(F.window("_at", "7 days", startTime="4 days").alias("w"))
    return weeks.agg(F.count("*").alias("sessions"), F.avg(F.col("success").cast("int")).alias("success_rate")).select(F.col("w.start").cast("date").alias("week"), "sessions", "success_rate")


def call_rate(calls: DataFrame, at: str = "ts", width: str = "1 minute", step: str = "10 seconds", most: int = 60) -> DataFrame:
    """Calls in each sliding window and whether they keep to the limit (our own definition of a rate limit)."""
    return calls.groupBy(F.window(F.col(at).cast("timestamp"), width, step).alias("w")).agg(F.count("*").alias("calls")).select(F.col("w.start").alias("start"), "calls", (F.col("calls") <= most).alias("within"))


def changed_files(spark: SparkSession, folder: str, manifest: DataFrame | None, glob: str = "*.jsonl", force: bool = False) -> DataFrame:
    """path, modified of files that are new, or modified since the manifest (path, modified) was made; all with force."""
    now = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(folder).select("path", F.col("modificationTime").alias("modified"))
    return now if force or manifest is None else now.join(manifest, ["path", "modified"], "left_anti")


def monitored_runs(runs: DataFrame, budget: float, most_failures: int = 3, key: str = "experiment"):
    """Over a stream of runs (key, ts, cost, ok): for each key the runs so far, what they spent, how many of the last
    failed in a row, and whether to stop (budget used up, or too many failures). State is three numbers a key; runs of a
    batch are taken in order of ts, and a null ok counts as a failure, a null cost as 0."""
    import numpy as np
    import pandas as pd
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def update(name, batches, state: GroupState):
        spent, streak, n = state.get if state.exists else (0.0, 0, 0)
        marks = []  # of each run its time and whether it is all right: only the streak needs their order
        for rows in batches:
            spent, n = spent + float(rows["cost"].fillna(0.0).sum()), n + len(rows)
            marks.append((rows["ts"].to_numpy(), np.array([x is not None and not pd.isna(x) and bool(x) for x in rows["ok"]], bool)))
        order = np.argsort(np.concatenate([t for t, _ in marks]), kind="stable")
        good = np.flatnonzero(np.concatenate([ok for _, ok in marks])[order])
        streak = len(order) - 1 - int(good[-1]) if len(good) else streak + len(order)
        state.update((spent, streak, n))
        yield pd.DataFrame([(*name, n, spent, streak, spent >= budget or streak >= most_failures)], columns=[key, "runs", "spent", "failures", "stop"])

    kind = dict(runs.dtypes)[key]
    return runs.select(key, "ts", F.col("cost").cast("double").alias("cost"), "ok").groupBy(key).applyInPandasWithState(
        update, f"{key} {kind}, runs bigint, spent double, failures int, stop boolean", "spent double, failures int, runs bigint", "update", GroupStateTimeout.NoTimeout
    )


def token_bucket_stream(calls: DataFrame, by: str, at: str, order: str, rate: float, size: float):
    """journal.token_bucket over a stream, with transformWithState: by, at, order, tokens, wait_s for each call as it comes. A key's
    state is two numbers, the calls so far and the least of the running minimum; a key's calls of one trigger are put in
    order together, so a trigger's size bounds them (maxFilesPerTrigger). A call that comes in a later trigger than a younger one
    counts as made after it. Calls without a time are left out. Needs the RocksDB state store provider."""
    import numpy as np
    import pandas as pd
    from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

    class Bucket(StatefulProcessor):
        def init(self, handle: StatefulProcessorHandle) -> None:
            self.state = handle.getValueState("bucket", "calls bigint, low double")

        def handleInputRows(self, key, rows, timerValues):
            held = pd.concat(list(rows)).sort_values([at, order], kind="stable")
            before, low = self.state.get() if self.state.exists() else (0, np.inf)
            i = before + 1 + np.arange(len(held))
            t = held[at].astype("datetime64[us]").astype("int64").to_numpy() / 1e6 * rate
            lows = np.minimum(np.minimum.accumulate(size - t + i - 1), low)
            self.state.update((int(i[-1]), float(lows[-1])))
            tokens = t - i + lows
            yield pd.DataFrame({by: held[by], at: held[at], order: held[order], "tokens": tokens, "wait_s": np.maximum(0.0, -tokens) / rate})

        def close(self) -> None:
            pass

    rows = calls.select(by, F.col(at).cast("timestamp_ntz").alias(at), order).where(F.col(at).isNotNull())
    kinds = dict(rows.dtypes)
    return rows.groupBy(by).transformWithStateInPandas(Bucket(), f"{by} {kinds[by]}, {at} {kinds[at]}, {order} {kinds[order]}, tokens double, wait_s double", "append", "none")
