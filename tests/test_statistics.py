"""Distribution functions against tabulated values; scans of keys that are cut into segments against plain loops; the tests
of significance, levels and red flags on small tables."""

import hashlib
import math
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tracemill.functions import distributions as d
from tracemill.functions.text import style
from tracemill.operators import checks, journal, lines, segments, stats


def values(spark, rows, schema, *columns):
    return [tuple(r) for r in spark.createDataFrame(rows, schema).select(*columns).collect()]


def test_student_t_against_tables(spark):
    # Two-sided critical values of printed tables, to their last digit.
    table = [(12.7062047364, 1, 0.05), (4.3026527297, 2, 0.05), (2.7764451052, 4, 0.05), (2.2281388520, 10, 0.05), (2.0422724563, 30, 0.05), (63.6567411629, 1, 0.01), (3.1692726726, 10, 0.01), (2.7499956536, 30, 0.01), (1.3721836411, 10, 0.2)]
    for (t, df, p), (got,) in zip(table, values(spark, [(float(t), float(v), p) for t, v, p in table], "t double, df double, p double", d.t_p(F.col("t"), F.col("df")))):
        assert abs(got - p) < 1e-9, (t, df)
    # df 1 and 2 have closed forms; a large df is all but normal.
    rows = [(t,) for t in (0.0, 0.01, 0.5, 1.0, 3.0, 40.0, -2.0)]
    for (t,), (one, two, many) in zip(rows, values(spark, rows, "t double", d.t_p(F.col("t"), F.lit(1.0)), d.t_p(F.col("t"), F.lit(2.0)), d.t_p(F.col("t"), F.lit(1e7)))):
        assert abs(one - (1 - 2 / math.pi * math.atan(abs(t)))) < 1e-10
        assert abs(two - (1 - abs(t) / math.sqrt(2 + t * t))) < 1e-10
        assert abs(many - math.erfc(abs(t) / math.sqrt(2))) < 1e-6


def test_chi_square_against_tables(spark):
    table = [(3.841458820694124, 1, 0.05), (5.991464547107979, 2, 0.05), (18.307038053275146, 10, 0.05), (6.6348966010212145, 1, 0.01), (23.209251158954356, 10, 0.01), (124.34211340400407, 100, 0.05), (2.7055434540954142, 1, 0.1)]
    for (x, df, p), (got,) in zip(table, values(spark, table, "x double, df int, p double", d.chi_square_p(F.col("x"), F.col("df")))):
        assert abs(got - p) < 1e-10, (x, df)
    # An even df has a finite series.
    rows = [(x, k) for x in (0.0, 0.1, 1.0, 9.0, 60.0, 300.0) for k in (2, 8, 50, 200)]
    for (x, k), (got,) in zip(rows, values(spark, rows, "x double, df int", d.chi_square_p(F.col("x"), F.col("df")))):
        exact = math.fsum(math.exp(-x / 2 + i * math.log(x / 2) - math.lgamma(i + 1)) if x else float(i == 0) for i in range(k // 2))
        assert abs(got - exact) < 1e-10, (x, k)


def test_normal_beta_and_bounds(spark):
    for (z,), (got,) in zip([(0.0,), (0.3,), (1.959963984540054,), (-5.0,), (30.0,)], values(spark, [(0.0,), (0.3,), (1.959963984540054,), (-5.0,), (30.0,)], "z double", d.normal_p(F.col("z")))):
        assert math.isclose(got, math.erfc(abs(z) / math.sqrt(2)), rel_tol=1e-9)
    got = values(spark, [(0.3, 2.0, 3.0), (0.0, 1.0, 1.0), (1.0, 2.0, 2.0), (0.5, 0.0, 1.0), (0.5, None, 1.0)], "x double, a double, b double", d.beta_cdf(F.col("x"), F.col("a"), F.col("b")))
    assert [x if x is None else round(x, 12) for (x,) in got] == [0.3483, 0.0, 1.0, None, None]


def test_binomial_interval_solves_its_equations(spark):
    rows = [(20, 20), (0, 20), (7, 20), (1, 3), (150, 1000), (0, 1), (1, 1), (None, 5)]
    low, high = d.binomial_interval(F.col("k"), F.col("n"))
    tail = lambda ks, n, p: math.fsum(math.exp(math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p)) for i in ks)
    for (k, n), (a, b) in zip(rows, values(spark, rows, "k bigint, n bigint", low, high)):
        if k is None:
            assert a is None and b is None
            continue
        assert a == 0 if k == 0 else abs(tail(range(k, n + 1), n, a) - 0.025) < 1e-9
        assert b == 1 if k == n else abs(tail(range(k + 1), n, b) - 0.025) < 1e-9
    assert abs(values(spark, [(20, 20)], "k bigint, n bigint", low)[0][0] - 0.025 ** (1 / 20)) < 1e-12


@pytest.fixture
def cut(monkeypatch):
    monkeypatch.setattr(segments, "HOT_ROWS", 40)


def runs_of(seed, n=900):
    """key (one has nearly all rows, null is one), at, value (some null), bad."""
    r = random.Random(seed)
    return [(r.choice(["hot"] * 12 + [None, "b", "c"]), i // 2, i, r.choice([None, float(r.randrange(50))]) if i % 9 == 0 else float(r.randrange(1000)), r.random() < 0.7) for i in range(n)]


SCHEMA = "k string, at int, id int, v double, bad boolean"


def by_key(rows):
    out = defaultdict(list)
    for r in sorted(rows, key=lambda r: (r[1], r[2])):
        out[r[0]].append(r)
    return out


def test_hot_keys_are_cut_and_no_task_gets_a_whole_key(spark, cut):
    seg = segments.Segments(spark.createDataFrame(runs_of(1), SCHEMA), ["k"], ["at", "id"])
    sizes = {(r["k"], r[segments.PART]): r["n"] for r in seg.rows.groupBy("k", segments.PART).agg(F.count("*").alias("n")).collect()}
    assert seg.cut and sum(sizes.values()) == 900
    assert max(n for (k, _), n in sizes.items() if k == "hot") < 120 and sum(k == "hot" for k, _ in sizes) > 10


def test_one_key_for_all_rows(spark, monkeypatch):
    monkeypatch.setattr(segments, "HOT_ROWS", 100)
    rows = spark.range(2000).select(F.lit(7).alias("k"), F.col("id"), (F.col("id") * 37 % 101).cast("double").alias("v"))
    seg = segments.Segments(rows, ["k"], ["id"])
    assert seg.rows.groupBy(segments.PART).count().agg(F.max("count")).first()[0] < 400
    got = {r["id"]: r["spent"] for r in journal.budget_stop(rows, ["k"], ["id"], "v", 1e9).collect()}
    total = 0.0
    for i in range(2000):
        total += i * 37 % 101
        assert got[i] == total


def test_running_best_over_segments(spark, cut):
    for higher in (False, True):
        made = {r["id"]: (r["best_before"], r["keep"]) for r in journal.running_best(spark.createDataFrame(runs_of(2), SCHEMA), ["k"], ["at", "id"], "v", higher).collect()}
        for own in by_key(runs_of(2)).values():
            best = None
            for _, _, i, v, _ in own:
                better = best is None or (None if v is None else (v > best if higher else v < best))
                assert made[i] == (best, better)
                if v is not None:
                    best = v if best is None else (max if higher else min)(best, v)


def test_counts_sums_and_streaks_over_segments(spark, cut):
    df, rows = spark.createDataFrame(runs_of(3), SCHEMA), by_key(runs_of(3))
    number = {r["id"]: (r["run"], r["allowed"]) for r in journal.nth_run(df, ["k"], ["at", "id"], 50).collect()}
    spent = {r["id"]: r["spent"] for r in journal.budget_stop(df, ["k"], ["at", "id"], "v", 100.0).collect()}
    expected = []
    for k, own in rows.items():
        total, streak = None, []
        for n, (_, at, i, v, bad) in enumerate(own, 1):
            total = total if v is None else (total or 0.0) + v
            assert number[i] == (n, n <= 50) and spent[i] == total
            if bad:
                streak.append(i)
            if (not bad or n == len(own)) and len(streak) >= 3:
                expected.append((k, streak[0], streak[-1], len(streak)))
            streak = streak if bad else []
    found = journal.streaks(df, ["k"], ["at", "id"], F.col("bad"))
    assert sorted(map(str, ((r["k"], r["first_id"], r["last_id"], r["length"]) for r in found.collect()))) == sorted(map(str, expected))


@pytest.mark.parametrize("width", [1, 3, 70])
def test_moving_average_over_segments(spark, cut, width):
    made = {r["id"]: r["moving_average"] for r in lines.moving_average(spark.createDataFrame(runs_of(4), SCHEMA), ["k"], "id", "v", width).collect()}
    assert len(made) == 900
    for own in by_key(runs_of(4)).values():
        for n in range(len(own)):
            held = [r[3] for r in own[max(0, n - width + 1) : n + 1] if r[3] is not None]
            got = made[own[n][2]]
            assert got is None if not held else math.isclose(got, sum(held) / len(held), rel_tol=1e-12)


def buckets(rows, rate, size):
    out = {}
    for own in by_key(rows).values():
        tokens, last = None, None
        for _, at, i, *_ in own:
            tokens = size - 1 if tokens is None else min(size, tokens + rate * (at - last)) - 1
            last = at
            out[i] = tokens
    return out


def test_token_bucket_equals_a_loop(spark, cut):
    rows = runs_of(5)
    df = spark.createDataFrame(rows, SCHEMA).withColumn("ts", F.timestamp_seconds("at"))
    made = journal.token_bucket(df, ["k"], "ts", ["id"], 1.5, 4.0).collect()
    expected = buckets(rows, 1.5, 4.0)
    assert len(made) == len(rows) and any(r["wait_s"] > 0 for r in made)
    for r in made:
        assert abs(r["tokens"] - expected[r["id"]]) < 1e-6 and abs(r["wait_s"] - max(0, -r["tokens"]) / 1.5) < 1e-9


def test_token_bucket_stream_equals_batch(spark, tmp_path):
    from tracemill.streaming.rules import token_bucket_stream

    rows = [r for r in runs_of(6, 300)]
    df = spark.createDataFrame(rows, SCHEMA).select("k", F.timestamp_seconds("at").alias("ts"), "id")
    for n in range(3):  # files in the order of time
        df.where(f"id div 100 = {n}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        import time

        time.sleep(1.1)
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        made = token_bucket_stream(stream, "k", "ts", "id", 1.5, 4.0)
        made.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set(name, before)
    got = {r["id"]: r["tokens"] for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    batch = {r["id"]: r["tokens"] for r in journal.token_bucket(df, ["k"], "ts", ["id"], 1.5, 4.0).collect()}
    assert len(got) == 300 and all(abs(got[i] - batch[i]) < 1e-6 for i in batch)


def test_ranks_over_segments(spark, cut):
    r = random.Random(8)
    rows = [("g", r.choice("ab"), float(r.randrange(300))) for _ in range(2500)] + [("h", "a", 1.0), ("h", "b", 1.0), ("i", "a", None), ("j", "a", 2.0)]
    df = spark.createDataFrame(rows, "k string, side string, v double")
    got = {x["k"]: x for x in stats.mann_whitney(df, ["k"], "side", "v", "a", "b").collect()}
    a, b = ([v for k, s, v in rows if k == "g" and s == side] for side in "ab")
    u = sum((x > y) + 0.5 * (x == y) for x in a for y in b)
    counts, n = defaultdict(int), len(a) + len(b)
    for v in a + b:
        counts[v] += 1
    sd = math.sqrt(len(a) * len(b) / 12 * (n + 1 - sum(c**3 - c for c in counts.values()) / (n * (n - 1))))
    z = (u - len(a) * len(b) / 2) / sd
    assert got["g"]["u"] == u and math.isclose(got["g"]["z"], z, rel_tol=1e-9) and math.isclose(got["g"]["p"], math.erfc(abs(z) / math.sqrt(2)), rel_tol=1e-9)
    assert (got["h"]["u"], got["h"]["z"], got["h"]["p"]) == (0.5, None, None) and got["j"]["p"] is None and "i" not in got
    exact = {x["k"]: x["q"] for x in stats.quantiles(df, ["k"], "v", (0.0, 0.25, 0.5, 1.0)).collect()}
    held = sorted(a + b)
    assert exact["g"][0] == held[0] and exact["g"][3] == held[-1] and exact["g"][2] == (held[(n - 1) // 2] + held[n // 2]) / 2
    whole = stats.quantiles(df, [], "v", (0.5,)).first()["q"][0]
    every = sorted(v for *_, v in rows if v is not None)
    assert whole == (every[(len(every) - 1) // 2] + every[len(every) // 2]) / 2


@pytest.mark.parametrize("digits", [1, 3])
def test_permutation_is_that_of_sorted_hashes(spark, monkeypatch, digits):
    monkeypatch.setattr(stats, "RANGE_DIGITS", digits)
    r = random.Random(3)
    units = [(i, "a" if i % 3 == 0 else "b", float(r.randrange(100)) + (8 if i % 3 == 0 else 0)) for i in range(90)] + [(900, "c", 5.0), (901, "a", None)]
    got = stats.permutation_test(spark.createDataFrame(units, "id int, g string, v double"), ["id"], "g", "v", "a", "b", replicates=60, seed=7).first()
    held = [(str(i), g, v) for i, g, v in units if g in "ab" and v is not None]
    na = sum(g == "a" for _, g, _ in held)
    diff = lambda first, rest: sum(first) / len(first) - sum(rest) / len(rest)
    seen = diff([v for _, g, v in held if g == "a"], [v for _, g, v in held if g == "b"])
    large = 0
    for k in range(1, 61):
        order = sorted(held, key=lambda u: hashlib.md5(f"7:{k}:{u[0]}".encode()).hexdigest())
        large += abs(diff([u[2] for u in order[:na]], [u[2] for u in order[na:]])) >= abs(seen) * (1 - 1e-9)
    assert (got["na"], got["nb"], got["replicates"], got["as_large"]) == (na, len(held) - na, 60, large)
    assert math.isclose(got["diff"], seen) and got["p"] == (large + 1) / 61


def test_tests_without_variance_or_rows(spark):
    df = spark.createDataFrame([("x", "a", 1.0), ("x", "a", 1.0), ("x", "b", 1.0), ("x", "b", 1.0), ("y", "a", 2.0), ("y", "b", None)], "k string, g string, v double")
    got = {r["k"]: (r["t"], r["p"]) for r in stats.t_test(df, ["k"], "g", "v", "a", "b").collect()}
    assert got == {"x": (None, None), "y": (None, None)}
    assert stats.t_test(df.limit(0), ["k"], "g", "v", "a", "b").count() == 0
    assert stats.mann_whitney(df.limit(0), ["k"], "g", "v", "a", "b").count() == 0
    assert stats.permutation_test(df.limit(0), ["k"], "g", "v", "a", "b").first()["as_large"] == 0


def test_subgroups_and_levels(spark):
    rows = [("m", "s", 10.0), ("m", "t", -4.0), ("m", "t", -4.0), ("n", "s", 3.0), ("n", None, 5.0), ("o", "s", None)]
    got = {(r["k"], r["s"]): (r["n"], r["mean"], r["group_mean"], r["mean_without"], r["verdict"]) for r in stats.subgroups(spark.createDataFrame(rows, "k string, s string, v double"), ["k"], "s", "v").collect()}
    assert got[("m", "s")] == (1, 10.0, 2 / 3, -4.0, "FRAGILE") and got[("m", "t")] == (2, -4.0, 2 / 3, 10.0, "ROBUST")
    assert got[("n", None)] == (1, 5.0, 4.0, 3.0, "ROBUST") and ("o", "s") not in got
    # Two seeds of a question are one; a question in two conditions is one above them.
    scores = [("a", "x", q, s, float(q + s)) for q in range(8) for s in (0, 2)] + [("a", "y", q, 0, 3.0) for q in range(4)]
    made = {(r["level"], r["m"], r["c"]): (r["n"], r["mean"]) for r in stats.levels(spark.createDataFrame(scores, "m string, c string, q int, seed int, v double"), [[], ["m"], ["m", "c"]], "q", "v").collect()}
    per = {q: [q + 1.0] + ([3.0] if q < 4 else []) for q in range(8)}
    mean = sum(sum(v) / len(v) for v in per.values()) / 8
    assert made == {("all", None, None): (8, mean), ("m", "a", None): (8, mean), ("m x c", "a", "x"): (8, 4.5), ("m x c", "a", "y"): (4, 3.0)}


def test_red_flags(spark):
    said = [(1, "u", "I CANNOT do that."), (2, "u", "This is a test?"), (3, "u", "Traceback (most recent"), (4, "u", "All is well and there is more to say about it"), (5, "u", "cut ..."), (6, "u", None), (7, "v", "x"), (8, "u", "Short."), (9, None, "no role [TRUNCATED] \n")]
    got = {r["id"]: (r["refusal"], r["eval_aware"], r["error"], r["truncated"]) for r in checks.red_flags(spark.createDataFrame(said, "id int, role string, output string"), ["role"]).collect()}
    # The median of role u is 16.
    assert got == {1: (True, False, False, False), 2: (False, True, False, False), 3: (False, False, True, False), 4: (False,) * 4, 5: (False, False, False, True), 6: (False, False, False, True), 7: (False,) * 4, 8: (False,) * 4, 9: (False, False, False, True)}
    n = checks.red_flag_counts(checks.red_flags(spark.createDataFrame(said, "id int, role string, output string"))).first()
    assert (n["n"], n["refusal"], n["eval_aware"], n["error"]) == (9, 1, 1, 1)


def test_page_offsets(spark):
    decks = [("main", "title\n---\nsrc: ./a.md\n---\nsrc: b\n---\nend\n---\nsrc: ./a.md"), ("./a.md", "one\n---\ntwo"), ("b", "---\nx\n---\nsrc: c\n---\nsrc: gone"), ("c", None), ("round", "src: round")]
    df = spark.createDataFrame(decks, "deck string, text string")
    got = sorted((r["place"], r["deck"], r["first_page"], r["last_page"]) for r in lines.page_offsets(df, "main").collect())
    # b begins with a separator, so its first page is an empty one; c is one empty page.
    assert got == [([], "main", 1, 10), ([1], "./a.md", 2, 3), ([2], "b", 4, 6), ([2, 2], "c", 6, 6), ([4], "./a.md", 8, 9)] or got == [([], "main", 1, 9), ([1], "./a.md", 2, 3), ([2], "b", 4, 6), ([2, 2], "c", 6, 6), ([4], "./a.md", 8, 9)]
    with pytest.raises(ValueError, match="circle"):
        lines.page_offsets(df, "round")


def test_style(spark):
    text = "One two three. Four five six! Seven eight nine? Ten eleven twelve. A b c.\n- item — x\n* item\n"
    rows = spark.createDataFrame([(text,), ("",), ("Two words. And then a good many more of them - so it goes.",)], "t string").select(style(F.col("t")).alias("s")).collect()
    first, empty, last = (r["s"] for r in rows)
    assert (first["sentences"], first["lists_overused"], round(first["list_share"], 6)) == (6, True, 0.666667)
    assert (empty["sentences"], empty["mean_words"], empty["sd_words"], empty["dashes"], empty["uniform"], empty["lists_overused"]) == (0, None, None, None, False, False)
    assert (last["sentences"], last["mean_words"], last["uniform"]) == (2, 7.0, False) and last["dashes"] == 1000 / 14
