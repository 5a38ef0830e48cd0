"""Free resources of cluster nodes: what they have less what their jobs hold."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed value: states of nodes that do not count.
DOWN = r"^(down|drain|maint|fail|unk)"


def gpus(gres: Column) -> Column:
    """GPUs that a node's resource text states, with or without a model."""
    typed, plain = F.regexp_extract(gres, r"gpu:.*:([0-9]+)", 1), F.regexp_extract(gres, r"gpu:([0-9]+)", 1)
    return F.coalesce(F.when(typed != "", typed.cast("int")).when(plain != "", plain.cast("int")), F.lit(0))


def memory_mb(text: Column) -> Column:
    """Megabytes of a text such as 64G or 512M; a number without a unit counts as nothing."""
    g, m = F.regexp_extract(text, r"([0-9]+)G", 1), F.regexp_extract(text, r"([0-9]+)M", 1)
    return F.coalesce(F.when(g != "", g.cast("bigint") * 1024).when(m != "", m.cast("bigint")), F.lit(0).cast("bigint"))


def job_gpus(tres: Column) -> Column:
    """The sum of all typed GPU counts in a job's resource text."""
    return F.aggregate(F.regexp_extract_all(tres, F.lit(r"gpu:[^:]*:([0-9]+)"), 1), F.lit(0), lambda a, x: a + x.cast("int"))


def free_resources(nodes: DataFrame, jobs: DataFrame) -> DataFrame:
    """node, totals and what is free. jobs: a row for each node that a job is on, counted in full on each."""
    held = jobs.groupBy("node").agg(F.sum(F.coalesce("job_cpus", F.lit(0))).alias("c"), F.sum(memory_mb(F.col("job_mem"))).alias("m"), F.sum(F.coalesce(job_gpus(F.col("tres")), F.lit(0))).alias("g"))
    up = nodes.where(~F.col("state").rlike(DOWN)).withColumn("gpus", gpus(F.coalesce("gres", F.lit(""))))
    zero = lambda c: F.coalesce(c, F.lit(0))
    rows = up.join(held, "node", "left")
    used_gpus = F.when(F.col("gpus") > 0, zero("g")).otherwise(0)
    return rows.select("node", "cpus", (F.col("cpus") - zero("c")).alias("free_cpus"), "memory_mb", F.expr("(memory_mb - coalesce(m, 0)) div 1024").alias("free_memory_gb"), "gpus", (F.col("gpus") - used_gpus).alias("free_gpus"), "state")


def memory_safe(used_gb: Column, limit_gb: Column) -> Column:
    """Whether use stays below 80 % of the limit."""
    return used_gb < limit_gb * 0.8


def chunk_size(n: Column, workers: Column) -> Column:
    return F.greatest(F.lit(1), F.floor(n / (workers * 4)).cast("int"))
