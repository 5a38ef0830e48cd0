"""Evaluation statistics as grouped aggregates. Deviations are of samples (n - 1)."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tracemill.functions import distributions
from tracemill.operators.segments import PART, Segments

Z = 1.96
#: From this many questions down an interval says nothing; the range is given instead.
SMALL = 5


def collapsed(scores: DataFrame, by: Sequence[str], question: str, score: str) -> DataFrame:
    """One row a question: the mean over its seeds."""
    return scores.groupBy(*by, question).agg(F.avg(score).alias(score))


def _interval(mean: Column, se: Column) -> list[Column]:
    return [(mean - Z * se).alias("ci_low"), (mean + Z * se).alias("ci_high")]


def mean_se_ci(scores: DataFrame, by: Sequence[str], question: str, score: str) -> DataFrame:
    """n, mean, se, ci_low, ci_high, low, high by group over questions (seeds averaged first); no interval for few."""
    rows = collapsed(scores, by, question, score).groupBy(*by).agg(F.count(score).alias("n"), F.avg(score).alias("mean"), (F.stddev_samp(score) / F.sqrt(F.count(score))).alias("se"), F.min(score).alias("low"), F.max(score).alias("high"))
    enough = F.when(F.col("n") > SMALL, F.col("se"))
    return rows.select(*by, "n", "mean", "se", *_interval(F.col("mean"), enough), "low", "high")


def paired(scores: DataFrame, method: str, question: str, score: str, a: object, b: object) -> DataFrame:
    """question, diff (a - b) for questions that both methods have. One grouped pass instead of a self-join."""
    mean = lambda m: F.avg(F.when(F.col(method) == m, F.col(score)))
    rows = scores.where(F.col(method).isin(a, b)).groupBy(question).agg(mean(a).alias("x"), mean(b).alias("y"))
    return rows.where("x is not null and y is not null").select(question, (F.col("x") - F.col("y")).alias("diff"))


def paired_diff(scores: DataFrame, method: str, question: str, score: str, a: object, b: object) -> DataFrame:
    """n, mean_diff, se_diff, its interval, and the effect that so many questions could have shown."""
    rows = paired(scores, method, question, score, a, b).agg(F.count("diff").alias("n"), F.avg("diff").alias("mean_diff"), (F.stddev_samp("diff") / F.sqrt(F.count("diff"))).alias("se_diff"), F.var_samp("diff").alias("var_diff"))
    return rows.select("n", "mean_diff", "se_diff", *_interval(F.col("mean_diff"), F.col("se_diff")), detectable(F.col("var_diff"), F.col("n")).alias("detectable"))


def detectable(variance: Column, n: Column) -> Column:
    return F.sqrt(8 * variance / n)


def required_n(variance: Column, effect: float) -> Column:
    """Questions needed to show an effect."""
    return F.ceil(8 * variance / F.lit(effect**2))


def clustered_se(scores: DataFrame, by: Sequence[str], cluster: str, score: str) -> DataFrame:
    """Standard errors from cluster means and from single rows, and their ratio."""
    groups = scores.groupBy(*by, cluster).agg(F.avg(score).alias("m"), F.count(score).alias("k"), F.sum(score).alias("s"), F.sum(F.col(score) * F.col(score)).alias("ss"))
    rows = groups.groupBy(*by).agg(F.count("*").alias("clusters"), F.sum("k").alias("n"), F.avg("m").alias("mean"), F.stddev_samp("m").alias("sd"), F.sum("s").alias("s"), F.sum("ss").alias("ss"))
    naive = F.sqrt((F.col("ss") - F.col("s") * F.col("s") / F.col("n")) / F.nullif(F.col("n") - 1, F.lit(0)) / F.col("n"))
    return rows.select(*by, "clusters", "n", "mean", (F.col("sd") / F.sqrt("clusters")).alias("se_clustered"), naive.alias("se_naive")).withColumn("ratio", F.col("se_clustered") / F.nullif(F.col("se_naive"), F.lit(0.0)))


def running(groups: DataFrame, by: Sequence[str], value: str, count: str, rows: DataFrame | None = None) -> DataFrame:
    """groups (a row for each by and value; rows: what they count) with `upto`, the sum of count over values up to this one. A group with very many
    values is scanned in ranges of them (see segments), so no task sorts all values of a group, and the result is exact."""
    seg = Segments(groups, by, [value], rows)
    return seg.summed(seg.rows, F.col(count), "upto").drop(PART)


def quantiles(rows: DataFrame, by: Sequence[str], value: str, shares: Sequence[float]) -> DataFrame:
    """by, q: exact quantiles, interpolated between neighbours, in the order of shares. Values are counted and ranked by
    `running`; nothing keeps all values of a group, as F.percentile does."""
    by = list(by)
    rows = rows.where(F.col(value).isNotNull())
    groups = rows.groupBy(*by, value).agg(F.count("*").alias("_k"))
    ranked = _beside(running(groups, by, value, "_k", rows), rows.groupBy(*by).agg(F.count("*").alias("_n")), by, "inner").withColumn("_x", F.col(value).cast("double"))
    place = lambda p: F.lit(p) * (F.col("_n") - 1)
    at = lambda rank: F.min(F.when(F.col("upto") > rank, F.col("_x")))
    ends = [c for i, p in enumerate(shares) for c in (at(F.floor(place(p))).alias(f"_l{i}"), at(F.ceil(place(p))).alias(f"_h{i}"))]
    found = ranked.groupBy(*by, "_n").agg(*ends)
    each = [F.when(F.col(f"_l{i}") == F.col(f"_h{i}"), F.col(f"_l{i}")).otherwise((F.ceil(place(p)) - place(p)) * F.col(f"_l{i}") + (place(p) - F.floor(place(p))) * F.col(f"_h{i}")) for i, p in enumerate(shares)]
    return found.select(*by, F.array(*each).alias("q"))


def _beside(left: DataFrame, right: DataFrame, by: Sequence[str], how: str = "left") -> DataFrame:
    """left with right's columns; right has a row a group (one row, if there are no groups). A null is a group like any other."""
    if not by:
        return left.join(F.broadcast(right), how="cross")
    keyed = right.withColumnsRenamed({c: f"_by_{c}" for c in by})
    return left.join(keyed, reduce(lambda x, y: x & y, [F.col(c).eqNullSafe(F.col(f"_by_{c}")) for c in by]), how).drop(*[f"_by_{c}" for c in by])


def describe(rows: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    sums = rows.groupBy(*by).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"))
    return _beside(sums, quantiles(rows, by, value, (0.25, 0.5, 0.75)), by).select(*by, "n", "mean", "sd", F.col("q")[0].alias("q1"), F.col("q")[1].alias("median"), F.col("q")[2].alias("q3"))


def sensitivity(rows: DataFrame, by: Sequence[str], value: str, share: float = 0.05, against: float = 0.0) -> DataFrame:
    """mean, median and mean without the lowest and highest `share`; fragile where they fall on both sides of `against`."""
    cuts = quantiles(rows, by, value, (share, 0.5, 1 - share)).withColumn("median", F.col("q")[1])
    bounds = _beside(cuts, rows.groupBy(*by).agg(F.avg(value).alias("mean")), by)
    inner = _beside(rows, bounds, by, "inner")
    inner = inner.where(F.col(value).between(F.col("q")[0], F.col("q")[2])).groupBy(*by, "mean", "median").agg(F.avg(value).alias("trimmed_mean"))
    above = [F.col(c) > against for c in ("mean", "median", "trimmed_mean")]
    return inner.select(*by, "mean", "median", "trimmed_mean", F.when((above[0] == above[1]) & (above[1] == above[2]), "ROBUST").otherwise("FRAGILE").alias("verdict"))


def rank_vs_second(stats: DataFrame) -> DataFrame:
    """stats (mean, ci_low, ci_high, ...) with rank, and bold for a best method whose interval is clear of the second's.
    stats has one row a method, so one window over it is small."""
    best = Window.orderBy(F.desc("mean"), *[c for c in stats.columns if c not in ("mean", "ci_low", "ci_high")][:1])
    ranked = stats.withColumn("rank", F.row_number().over(best)).withColumn("next_high", F.lead("ci_high").over(best))
    return ranked.withColumn("bold", F.coalesce((F.col("rank") == 1) & (F.col("ci_low") > F.col("next_high")), F.lit(False))).drop("next_high")


def all_right_interval(n: Column, alpha: float = 0.05) -> Column:
    """The exact lower bound where all n trials succeed (the upper is 1)."""
    return F.pow(F.lit(alpha / 2), 1 / n)


def rate_at_false_positives(rows: DataFrame, by: Sequence[str], score: str, positive: str, share: float = 0.05) -> DataFrame:
    """Share of positives with at least the score that `share` of the negatives exceed. Ties count as detected."""
    cuts = quantiles(rows.where(~F.col(positive)), by, score, (1 - share,)).withColumn("cut", F.col("q")[0])
    return _beside(rows.where(F.col(positive)), cuts, by, "inner").groupBy(*by, "cut").agg(F.avg((F.col(score) >= F.col("cut")).cast("int")).alias("rate"))


def detector_quality(rows: DataFrame, by: Sequence[str], predicted: str, actual: str) -> DataFrame:
    p, a = F.col(predicted), F.col(actual)
    counts = rows.groupBy(*by).agg(F.count_if(p & a).alias("tp"), F.count_if(p & ~a).alias("fp"), F.count_if(~p & a).alias("fn"), F.count_if(~p & ~a).alias("tn"))
    ratio = lambda x, y: F.col(x) / F.nullif(F.col(x) + F.col(y), F.lit(0))
    f1 = 2 * F.col("tp") / F.nullif(2 * F.col("tp") + F.col("fp") + F.col("fn"), F.lit(0))
    return counts.select("*", ratio("tp", "fp").alias("precision"), ratio("tp", "fn").alias("recall"), ratio("fp", "tn").alias("fp_rate"), f1.alias("f1"))


def reproduced(rows: DataFrame, cost: str, was_cost: str, n: str, was_n: str, tolerance: float = 0.2) -> DataFrame:
    """rows with whether cost is within the tolerance of what it was and the number of samples is the same."""
    near = F.abs(F.col(cost) - F.col(was_cost)) <= tolerance * F.col(was_cost)
    return rows.withColumn("reproduced", near & (F.col(n) == F.col(was_n)))


# What follows has no definition elsewhere; these are this library's own.


def bootstrap_ci(rows: DataFrame, by: Sequence[str], key: str, value: str, replicates: int = 200, seed: int = 42) -> DataFrame:
    """Percentile interval of the mean by Poisson bootstrap. Weights come from a hash of (seed, key, replicate), so the
    result does not depend on partitions; sums are partial in each task."""
    cut = [0.36787944117144233, 0.7357588823428847, 0.9196986029286058, 0.9810118431238462, 0.9963401531726563]
    u = F.pmod(F.xxhash64(F.lit(seed), key, "replicate"), F.lit(1 << 53)) / F.lit(float(1 << 53))
    weight = F.lit(0)
    for c in cut:
        weight = weight + (u >= c).cast("int")
    drawn = rows.select(*by, key, value, F.explode(F.sequence(F.lit(1), F.lit(replicates))).alias("replicate")).withColumn("w", weight)
    means = drawn.groupBy(*by, "replicate").agg((F.sum(F.col("w") * F.col(value)) / F.nullif(F.sum("w"), F.lit(0))).alias("m"))
    return means.groupBy(*by).agg(F.percentile("m", F.array(F.lit(0.025), F.lit(0.975))).alias("q")).select(*by, F.col("q")[0].alias("ci_low"), F.col("q")[1].alias("ci_high"))


def data_quality(rows: DataFrame, key: str, value: str) -> DataFrame:
    """Rows, missing and NaN values, repeated keys, and values beyond 1.5 quartile ranges."""
    v = F.col(value).cast("double")
    found = quantiles(rows.select(v.alias("v")).where(~F.isnan("v")), [], "v", (0.25, 0.75)).first()
    q = found[0] if found else [None, None]
    spread = None if q[0] is None else 1.5 * (q[1] - q[0])
    odd = F.lit(False) if spread is None else ~F.isnan(v) & ((v < q[0] - spread) | (v > q[1] + spread))
    groups = rows.groupBy(key).agg(F.count("*").alias("n"), F.count_if(v.isNull()).alias("missing"), F.count_if(F.isnan(v)).alias("nan"), F.count_if(odd).alias("outliers"))
    return groups.agg(F.sum("n").alias("n"), F.sum("missing").alias("missing"), F.sum("nan").alias("nan"), F.sum("outliers").alias("outliers"), F.count_if(F.col("n") > 1).alias("repeated_keys"))


def confusion(rows: DataFrame, actual: str, predicted: str) -> DataFrame:
    """actual, predicted, n and its share of the actual class."""
    counts = rows.groupBy(actual, predicted).agg(F.count("*").alias("n"))
    return counts.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(actual)))


def t_test(rows: DataFrame, by: Sequence[str], group: str, value: str, a: object, b: object) -> DataFrame:
    """Welch's test of two groups' means: n and mean of each, diff, t, df, two-sided p, and the interval of the difference by
    its own standard error. Null for a group of fewer than two rows, or where nothing varies."""
    pick = lambda f, g: f(F.when(F.col(group) == g, F.col(value)))
    s = rows.where(F.col(group).isin(a, b)).groupBy(*by).agg(*[pick(f, g).alias(f"{n}{k}") for k, g in (("a", a), ("b", b)) for n, f in (("n", F.count), ("m", F.avg), ("v", F.var_samp))])
    each = {k: F.col(f"v{k}") / F.nullif(F.col(f"n{k}"), F.lit(0)) for k in "ab"}
    s = s.withColumn("diff", F.col("ma") - F.col("mb")).withColumn("se", F.nullif(F.sqrt(each["a"] + each["b"]), F.lit(0.0))).withColumn("t", F.col("diff") / F.col("se"))
    s = s.withColumn("df", F.pow("se", F.lit(4)) / sum(F.pow(each[k], F.lit(2)) / F.nullif(F.col(f"n{k}") - 1, F.lit(0)) for k in "ab"))
    return s.select(*by, "na", "nb", "ma", "mb", "diff", "t", "df", distributions.t_p(F.col("t"), F.col("df")).alias("p"), *_interval(F.col("diff"), F.col("se")))


def paired_t_test(scores: DataFrame, method: str, question: str, score: str, a: object, b: object) -> DataFrame:
    """n, mean_diff, t, df, p over questions that both methods have (see paired)."""
    rows = paired(scores, method, question, score, a, b).agg(F.count("diff").alias("n"), F.avg("diff").alias("mean_diff"), F.stddev_samp("diff").alias("sd"))
    rows = rows.withColumn("t", F.col("mean_diff") / F.nullif(F.col("sd") / F.sqrt("n"), F.lit(0.0))).withColumn("df", (F.col("n") - 1).cast("double"))
    return rows.select("n", "mean_diff", "t", "df", distributions.t_p(F.col("t"), F.col("df")).alias("p"))


def share_interval(rows: DataFrame, by: Sequence[str], success: Column, alpha: float = 0.05) -> DataFrame:
    """n, k, share and its exact binomial interval by group, for any k; rows where success is null do not count."""
    counts = rows.groupBy(*by).agg(F.count(success).alias("n"), F.count_if(success).alias("k")).where("n > 0")
    low, high = distributions.binomial_interval(F.col("k"), F.col("n"), alpha)
    return counts.select(*by, "n", "k", (F.col("k") / F.col("n")).alias("share"), low.alias("low"), high.alias("high"))


def mann_whitney(rows: DataFrame, by: Sequence[str], group: str, value: str, a: object, b: object) -> DataFrame:
    """na, nb, u (of group a), z and two-sided p by the normal approximation, ties at their middle rank and taken from the
    variance, without a correction for continuity. Equal values are counted first; ranks are running sums of the counts."""
    held = rows.where(F.col(group).isin(a, b) & F.col(value).isNotNull())
    groups = held.groupBy(*by, value).agg(F.count_if(F.col(group) == a).alias("_a"), F.count_if(F.col(group) == b).alias("_b")).withColumn("_k", F.col("_a") + F.col("_b"))
    middle = F.col("upto") - (F.col("_k") - 1) / 2
    k = F.col("_k").cast("double")
    ranked = running(groups, by, value, "_k", held).groupBy(*by).agg(F.sum("_a").alias("na"), F.sum("_b").alias("nb"), F.sum(F.col("_a") * middle).alias("_ra"), F.sum(k * k * k - k).alias("_ties"))
    n, na, nb = F.col("na") + F.col("nb"), F.col("na").cast("double"), F.col("nb").cast("double")
    spread = F.sqrt(na * nb / 12 * (n + 1 - F.col("_ties") / F.nullif(n * (n - 1.0), F.lit(0.0))))
    u = ranked.withColumn("u", F.col("_ra") - na * (na + 1) / 2).withColumn("z", (F.col("u") - na * nb / 2) / F.nullif(spread, F.lit(0.0)))
    return u.select(*by, "na", "nb", "u", "z", distributions.normal_p(F.col("z")).alias("p"))


#: Hexadecimal digits of a hash that name its range in a replicate: 4096 ranges.
RANGE_DIGITS = 3


def permutation_test(units: DataFrame, key: Sequence[str], group: str, value: str, a: object, b: object, replicates: int = 200, seed: int = 42) -> DataFrame:
    """na, nb, diff (mean of a less mean of b), replicates, as_large (replicates with a difference at least as large) and
    p = (as_large + 1) / (replicates + 1). units: a row a unit, which `key` tells apart.

    A replicate relabels: of the units in the order of their hashes (MD5 of seed, replicate and key) the first na are a. No
    replicate is sorted: counts and sums by ranges of the hash say in which range the na-th unit lies, and only the units
    of that one range, a 4096th of all, are ranked. Units meet replicates one task at a time and are summed up there."""
    rows = units.where(F.col(group).isin(a, b) & F.col(value).isNotNull()).select(F.concat_ws(":", *key).alias("unit"), (F.col(group) == a).alias("first"), F.col(value).cast("double").alias("v"))
    seen = rows.agg(F.count_if("first").alias("na"), F.count_if(~F.col("first")).alias("nb"), F.sum(F.when(F.col("first"), F.col("v"))).alias("sa"), F.sum("v").alias("s")).first()
    na, nb = seen["na"], seen["nb"]
    diff = lambda sa, s: sa / F.nullif(F.lit(na), F.lit(0)) - (s - sa) / F.nullif(F.lit(nb), F.lit(0))
    drawn = rows.select("unit", "v", F.explode(F.sequence(F.lit(1), F.lit(replicates))).alias("replicate"))
    drawn = drawn.withColumn("hash", F.md5(F.concat_ws(":", F.lit(seed), "replicate", "unit").cast("binary"))).withColumn("range", F.substring("hash", 1, RANGE_DIGITS))
    before = Window.partitionBy("replicate").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)  # 4096 rows
    ranges = drawn.groupBy("replicate", "range").agg(F.count("*").alias("n"), F.sum("v").alias("sum"))
    ranges = ranges.withColumn("n_before", F.coalesce(F.sum("n").over(before), F.lit(0))).withColumn("s_before", F.coalesce(F.sum("sum").over(before), F.lit(0.0)))
    edge = ranges.where((F.col("n_before") < na) & (F.col("n_before") + F.col("n") >= na)).select("replicate", "range", (F.lit(na) - F.col("n_before")).alias("wanted"), "s_before")
    inside = drawn.join(F.broadcast(edge), ["replicate", "range"]).withColumn("place", F.row_number().over(Window.partitionBy("replicate", "range").orderBy("hash", "unit")))
    made = inside.groupBy("replicate").agg((F.first("s_before") + F.coalesce(F.sum(F.when(F.col("place") <= F.col("wanted"), F.col("v"))), F.lit(0.0))).alias("sa"))
    observed = diff(F.lit(seen["sa"]).cast("double"), F.lit(seen["s"]).cast("double"))
    each = made.select(diff(F.col("sa"), F.lit(seen["s"]).cast("double")).alias("d"))
    # A difference counts as as large from a billionth below on, since sums of another order differ in the last digits.
    out = each.agg(F.count("d").alias("replicates"), F.count_if(F.abs("d") >= F.abs(observed) * (1 - 1e-9)).alias("as_large"))
    return out.select(F.lit(na).cast("bigint").alias("na"), F.lit(nb).cast("bigint").alias("nb"), observed.alias("diff"), "replicates", "as_large", ((F.col("as_large") + 1) / (F.col("replicates") + 1)).alias("p"))


def subgroups(rows: DataFrame, by: Sequence[str], subgroup: str, value: str, against: float = 0.0) -> DataFrame:
    """For each subgroup of a group: n, mean, the group's mean, the mean without the subgroup, and FRAGILE where leaving it out
    moves the group's mean to the other side of `against`. One pass: totals of subgroups, and totals less a part."""
    parts = rows.groupBy(*by, subgroup).agg(F.count(value).alias("_n"), F.sum(value).alias("_s")).where("_n > 0")
    whole = _beside(parts, parts.groupBy(*by).agg(F.sum("_n").alias("_all_n"), F.sum("_s").alias("_all_s")), by, "inner")
    rest = F.nullif(F.col("_all_n") - F.col("_n"), F.lit(0))
    out = whole.select(*by, subgroup, F.col("_n").alias("n"), (F.col("_s") / F.col("_n")).alias("mean"), (F.col("_all_s") / F.col("_all_n")).alias("group_mean"), ((F.col("_all_s") - F.col("_s")) / rest).alias("mean_without"))
    return out.withColumn("verdict", F.when((F.col("group_mean") > against) == (F.col("mean_without") > against), "ROBUST").otherwise("FRAGILE"))


def levels(scores: DataFrame, sets: Sequence[Sequence[str]], question: str, score: str) -> DataFrame:
    """level (its columns' names), the columns (null above their level), n, mean, se and interval for each of several sets of
    columns at once. Seeds are averaged first; a question then counts once a level, as the mean of its cells there, so n is
    the level's own number of questions. Few questions: no interval. The columns themselves should not be null."""
    names = list(dict.fromkeys(c for s in sets for c in s))
    cells = collapsed(scores, names, question, score)
    each = cells.groupingSets([[*s, question] for s in sets], *names, question).agg(F.avg(score).alias("x"), F.grouping_id().alias("set"))
    rows = each.groupBy("set", *names).agg(F.count("x").alias("n"), F.avg("x").alias("mean"), (F.stddev_samp("x") / F.sqrt(F.nullif(F.count("x"), F.lit(0)))).alias("se"))
    numbers = {sum((c not in s) << (len(names) - k) for k, c in enumerate(names)): " x ".join(s) or "all" for s in sets}
    level = F.create_map(*[F.lit(x) for kv in numbers.items() for x in kv])[F.col("set").cast("int")]
    return rows.select(level.alias("level"), *names, "n", "mean", "se", *_interval(F.col("mean"), F.when(F.col("n") > SMALL, F.col("se"))))


def precision_recall(rows: DataFrame, by: Sequence[str], score: str, positive: str) -> DataFrame:
    """For each distinct score as a threshold (at or above it is positive): precision and recall."""
    groups = rows.where(F.col(score).isNotNull()).groupBy(*by, score).agg(F.count_if(F.col(positive)).alias("_p"), F.count("*").alias("_k")).withColumn("_down", -F.col(score))
    seg = Segments(groups, by, ["_down"], rows)
    found = seg.summed(seg.summed(seg.rows, F.col("_p"), "_tp"), F.col("_k"), "_called").drop(PART, "_down")
    found = _beside(found, groups.groupBy(*by).agg(F.sum("_p").alias("_all")), by, "inner")
    return found.select(*by, score, (F.col("_tp") / F.col("_called")).alias("precision"), (F.col("_tp") / F.nullif(F.col("_all"), F.lit(0))).alias("recall"))


def auc(rows: DataFrame, by: Sequence[str], score: str, positive: str) -> DataFrame:
    """Area under the ROC curve, ties counted half. Scores are counted first, then ranked by `running`."""
    groups = rows.groupBy(*by, score).agg(F.count_if(F.col(positive)).alias("p"), F.count_if(~F.col(positive)).alias("q"))
    ranked = running(groups, list(by), score, "q", rows).withColumn("won", F.col("p") * (F.col("upto") - F.col("q") / 2))
    sums = ranked.groupBy(*by).agg(F.sum("won").alias("w"), F.sum("p").alias("p"), F.sum("q").alias("q"))
    return sums.select(*by, (F.col("w") / F.nullif(F.col("p") * F.col("q"), F.lit(0))).alias("auc"))


def cohens_d(rows: DataFrame, by: Sequence[str], group: str, value: str, a: object, b: object) -> DataFrame:
    """n of each group, difference of means, pooled deviation, d, and Welch's t; one grouped pass."""
    pick = lambda f, g: f(F.when(F.col(group) == g, F.col(value)))
    s = rows.where(F.col(group).isin(a, b)).groupBy(*by).agg(*[pick(f, g).alias(f"{n}{k}") for k, g in (("a", a), ("b", b)) for n, f in (("n", F.count), ("m", F.avg), ("v", F.var_samp))])
    pooled = F.sqrt(((F.col("na") - 1) * F.col("va") + (F.col("nb") - 1) * F.col("vb")) / F.nullif(F.col("na") + F.col("nb") - 2, F.lit(0)))
    diff = F.col("ma") - F.col("mb")
    return s.select(*by, "na", "nb", diff.alias("diff"), pooled.alias("pooled"), (diff / F.nullif(pooled, F.lit(0.0))).alias("d"), (diff / F.nullif(F.sqrt(F.col("va") / F.col("na") + F.col("vb") / F.col("nb")), F.lit(0.0))).alias("t"))


def correlation(rows: DataFrame, by: Sequence[str], x: str, y: str) -> DataFrame:
    return rows.groupBy(*by).agg(F.count_if(F.col(x).isNotNull() & F.col(y).isNotNull()).alias("n"), F.corr(x, y).alias("r"))


def chi_square(rows: DataFrame, a: str, b: str) -> DataFrame:
    """Statistic and degrees of freedom of the table of two columns; cells that do not occur count through their
    expectations, so no cross product of the columns' values is made."""
    cells = rows.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(a, b).agg(F.count("*").alias("o"))
    cells = cells.withColumn("ra", F.sum("o").over(Window.partitionBy(a))).withColumn("rb", F.sum("o").over(Window.partitionBy(b)))
    # Sum of (o - e)^2 / e over all cells is n * (sum of o^2 / (ra * rb)) - n.
    s = cells.agg(F.sum("o").alias("n"), F.sum(F.col("o") * F.col("o") / (F.col("ra") * F.col("rb"))).alias("s"), F.count_distinct(a).alias("ka"), F.count_distinct(b).alias("kb"))
    return s.select("n", (F.col("n") * F.col("s") - F.col("n")).alias("chi_square"), ((F.col("ka") - 1) * (F.col("kb") - 1)).alias("df"))


def chi_square_test(rows: DataFrame, a: str, b: str) -> DataFrame:
    """chi_square with p; no p without a degree of freedom."""
    return chi_square(rows, a, b).withColumn("p", distributions.chi_square_p(F.greatest("chi_square", F.lit(0.0)), F.col("df")))


def correlation_test(rows: DataFrame, by: Sequence[str], x: str, y: str) -> DataFrame:
    """correlation with t, df and two-sided p of no correlation."""
    found = correlation(rows, by, x, y).withColumn("df", (F.col("n") - 2).cast("double"))
    found = found.withColumn("t", F.col("r") * F.sqrt(F.when(F.col("df") > 0, F.col("df"))) / F.nullif(F.sqrt(1 - F.col("r") * F.col("r")), F.lit(0.0)))
    return found.select(*by, "n", "r", "t", "df", distributions.t_p(F.col("t"), F.col("df")).alias("p"))


def adjusted(tests: DataFrame, p: str = "p") -> DataFrame:
    """tests (one row a test) with Bonferroni's and Benjamini and Hochberg's adjusted p-values."""
    every = Window.partitionBy()
    rank = F.row_number().over(Window.orderBy(p))
    rows = tests.withColumn("_n", F.count("*").over(every)).withColumn("_r", rank)
    rows = rows.withColumn("bonferroni", F.least(F.lit(1.0), F.col(p) * F.col("_n")))
    step = F.min(F.col(p) * F.col("_n") / F.col("_r")).over(Window.orderBy("_r").rowsBetween(0, Window.unboundedFollowing))
    return rows.withColumn("fdr", F.least(F.lit(1.0), step)).drop("_n", "_r")


def histogram(rows: DataFrame, by: Sequence[str], value: str, low: float, high: float, bins: int) -> DataFrame:
    """bin (0 below, 1 to bins, bins + 1 above) and n."""
    return rows.where(F.col(value).isNotNull()).groupBy(*by, F.width_bucket(F.col(value), F.lit(low), F.lit(high), F.lit(bins)).alias("bin")).agg(F.count("*").alias("n"))


def calibration(rows: DataFrame, score: str, positive: str, bins: int = 10) -> DataFrame:
    """bin, n, mean score and share of positives, for scores from 0 to 1."""
    bin_ = F.least(F.floor(F.col(score) * bins), F.lit(bins - 1))
    return rows.groupBy(bin_.cast("int").alias("bin")).agg(F.count("*").alias("n"), F.avg(score).alias("mean_score"), F.avg(F.col(positive).cast("int")).alias("share"))


def ecdf(rows: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """value and the share of rows at or below it; values are counted first."""
    rows = rows.where(F.col(value).isNotNull())
    groups = rows.groupBy(*by, value).agg(F.count("*").alias("_k"))
    total = rows.groupBy(*by).agg(F.count("*").alias("_total"))
    return _beside(running(groups, list(by), value, "_k", rows), total, by).select(*by, value, (F.col("upto") / F.col("_total")).alias("share"))
