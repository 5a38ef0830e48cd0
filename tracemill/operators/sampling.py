"""Stratified samples of reproducible membership: about 40 % failures, 30 % successes, the rest from everything else."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def quotas(total: int, failures: int, most: int = 15) -> tuple[int, int, int, int]:
    """(n, failures, successes, random) to draw; of fewer than 20 samples all failures are drawn, beyond n if need be."""
    n = min(max(3, int(total * 0.05)), most)
    fail = failures if total < 20 else max(1, int(n * 0.4))
    success = max(1, int(n * 0.3))
    return n, fail, success, max(1, n - fail - success)


def order(seed: int, key: Column, salt: str = "") -> Column:
    """A shuffle that any engine repeats: MD5 of seed and key."""
    return F.md5(F.concat(F.lit(f"{seed}:{salt}"), key.cast("string")).cast("binary"))


def stratified_sample(samples: DataFrame, most: int = 15, seed: int = 42, key: str = "id", label: str = "score_label") -> DataFrame:
    """samples' columns and stratum (failures, successes, random). Three counts come to the driver; each draw is a
    distributed top-n, and what was drawn (at most the quotas) is kept out of the last by a broadcast anti-join."""
    counts = samples.agg(F.count("*"), F.count_if(F.col(label) == "fail"), F.count_if(F.col(label) == "pass")).first()
    n, fail, success, rest = quotas(counts[0], counts[1], most)
    draw = lambda rows, salt, k, name: rows.orderBy(order(seed, F.col(key), salt), key).limit(k).withColumn("stratum", F.lit(name))
    picked = draw(samples.where(F.col(label) == "fail"), "", fail, "failures").unionByName(draw(samples.where(F.col(label) == "pass"), "", success, "successes"))
    taken = min(fail, counts[1]) + min(success, counts[2])
    others = samples.join(F.broadcast(picked.select(key)), key, "left_anti").select(samples.columns)
    return picked.unionByName(draw(others, "r:", max(rest, n - taken), "random"))
