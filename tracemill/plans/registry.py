"""The named queries of the library and their DuckDB equivalents. Each applies an operator to whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracemill.functions import records, text
from tracemill.operators import checks, cluster, journal, lines, rules, sampling, stats

#: Words that do occur in the test tables, for queries whose own lexicons would find nothing there.
WORDS = ("worthless", "password", "token", "license")
PHRASES = [("markers", "high", "password=", 95), ("markers", "low", "All rights reserved", 75), ("markers", "medium", "License", 88)]
MARKS = r"(password=|api_key=|token = )"

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as samples, scored by the quality label."""
    labels = _t(spark, sf_dir, "labels").select("doc_id", F.col("quality").cast("double").alias("score"))
    rows = _t(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("output")).join(labels, "doc_id", "left")
    return rows.select(F.col("doc_id").alias("idx"), F.col("doc_id").cast("string").alias("id"), "output", "score", records.score_label(F.col("score")).alias("score_label"))


_SAMPLES = """s AS (SELECT d.doc_id AS idx, CAST(d.doc_id AS VARCHAR) AS id, d.text AS output, CAST(l.quality AS DOUBLE) AS score,
    CASE WHEN l.quality IS NULL THEN 'error' WHEN l.quality >= 0.5 THEN 'pass' ELSE 'fail' END AS label
    FROM documents d LEFT JOIN labels l USING (doc_id))"""


@query(f"WITH {_SAMPLES} SELECT k AS label, count(label) AS n FROM (VALUES ('pass'), ('fail'), ('error')) v(k) LEFT JOIN s ON label = k GROUP BY k")
def score_distribution(spark, sf_dir):
    """A1"""
    return checks.score_distribution(_samples(spark, sf_dir))


@query(rf"""WITH {_SAMPLES}, f AS (SELECT *, length(regexp_replace(coalesce(output, ''), '^\s+|\s+$', '', 'g')) < 10 AS e,
    lower(output) LIKE '%worthless%' OR lower(output) LIKE '%password%' OR lower(output) LIKE '%token%' OR lower(output) LIKE '%license%' AS r,
    lower(output) LIKE '%timeout%' OR lower(output) LIKE '%permission denied%' OR lower(output) LIKE '%api error%' OR lower(output) LIKE '%rate limit%' OR lower(output) LIKE '%connection refused%' AS t FROM s),
    c AS (SELECT count(*) AS n, count(*) FILTER (e) AS e, count(*) FILTER (r) AS r, count(*) FILTER (t) AS t, count(*) FILTER (score IS NULL) AS u,
    count(*) FILTER (label = 'pass') AS p, count(*) FILTER (label = 'fail') AS f, count(score) AS k, count(DISTINCT score) AS d, count(*) FILTER (score = 1) AS one FROM f)
    SELECT 'CRITICAL' AS severity, 'degenerate_scores' AS type, k AS affected FROM c WHERE k >= 3 AND d = 1
    UNION ALL SELECT 'WARNING', 'degenerate_scores', 0 FROM c WHERE d = 2 AND k >= 10 AND one / k BETWEEN 0.45 AND 0.55
    UNION ALL SELECT CASE WHEN e > n * 0.1 THEN 'CRITICAL' ELSE 'WARNING' END, 'empty_truncated_responses', e FROM c WHERE e > 0
    UNION ALL SELECT CASE WHEN r >= n * 0.5 THEN 'CRITICAL' ELSE 'WARNING' END, 'refusal_markers', r FROM c WHERE r > 0
    UNION ALL SELECT 'WARNING', 'tool_call_errors', t FROM c WHERE t > 0
    UNION ALL SELECT 'WARNING', 'score_distribution_anomaly', 0 FROM c WHERE n >= 20 AND p + f > 0 AND (p / (p + f) > 0.9 OR p / (p + f) < 0.1)
    UNION ALL SELECT 'WARNING', 'format_parsing_failures', u FROM c WHERE u > 0 AND u < n""")
def findings(spark, sf_dir):
    """A2-A8"""
    return checks.findings(_samples(spark, sf_dir), refusals=WORDS).select("severity", "type", "affected")


@query(rf"""WITH {_SAMPLES}, a AS (SELECT 'empty_truncated_responses' AS type, idx, id FROM s WHERE length(regexp_replace(coalesce(output, ''), '^\s+|\s+$', '', 'g')) < 10
    UNION ALL SELECT 'refusal_markers', idx, id FROM s WHERE lower(output) LIKE '%worthless%' OR lower(output) LIKE '%password%' OR lower(output) LIKE '%token%' OR lower(output) LIKE '%license%'
    UNION ALL SELECT 'tool_call_errors', idx, id FROM s WHERE lower(output) LIKE '%timeout%' OR lower(output) LIKE '%permission denied%' OR lower(output) LIKE '%api error%' OR lower(output) LIKE '%rate limit%' OR lower(output) LIKE '%connection refused%'
    UNION ALL SELECT 'format_parsing_failures', idx, id FROM s WHERE score IS NULL),
    r AS (SELECT *, row_number() OVER (PARTITION BY type ORDER BY idx) AS k, count(*) OVER (PARTITION BY type) AS n FROM a)
    SELECT type, string_agg(id, ',' ORDER BY k) AS ids, greatest(any_value(n) - 5, 0) AS more FROM r WHERE k <= 5 GROUP BY type""")
def affected_samples(spark, sf_dir):
    """A9 T3"""
    return checks.first_affected(_samples(spark, sf_dir), refusals=WORDS).select("type", F.array_join("ids", ",").alias("ids"), "more")


@query(f"""WITH {_SAMPLES}, c AS (SELECT count(*) AS total, count(*) FILTER (label = 'fail') AS nf, count(*) FILTER (label = 'pass') AS np FROM s),
    q AS (SELECT *, least(greatest(3, CAST(floor(total * 0.05) AS INT)), 15) AS n FROM c),
    k AS (SELECT *, CASE WHEN total < 20 THEN nf ELSE greatest(1, CAST(floor(n * 0.4) AS INT)) END AS fq, greatest(1, CAST(floor(n * 0.3) AS INT)) AS pq FROM q),
    r AS (SELECT id, label, row_number() OVER (PARTITION BY label ORDER BY md5('42:' || id), id) AS i FROM s),
    p AS (SELECT id, label, CASE label WHEN 'fail' THEN 'failures' ELSE 'successes' END AS stratum FROM r, k WHERE label = 'fail' AND i <= fq OR label = 'pass' AND i <= pq),
    o AS (SELECT id, label, row_number() OVER (ORDER BY md5('42:r:' || id), id) AS i FROM s WHERE id NOT IN (SELECT id FROM p))
    SELECT id, label, stratum FROM p UNION ALL SELECT id, label, 'random' FROM o, k WHERE i <= greatest(greatest(1, n - fq - pq), n - (SELECT count(*) FROM p))""")
def stratified_sample(spark, sf_dir):
    """2.11"""
    return sampling.stratified_sample(_samples(spark, sf_dir)).select("id", F.col("score_label").alias("label"), "stratum")


def _conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conv_id, record: each conversation as one record of no fixed shape. A conversation's turns fit a record."""
    turns = F.array_sort(F.collect_list(F.struct("turn", "role", F.col("text").alias("content"))))
    rows = _t(spark, sf_dir, "conversations").groupBy("conv_id").agg(turns.alias("messages"))
    return rows.select("conv_id", F.parse_json(F.to_json(F.struct("messages"))).alias("record"))


@query("""SELECT conv_id, arg_min(text, turn) FILTER (role = 'user') AS first_user, arg_max(text, turn) FILTER (role = 'assistant') AS last_assistant,
    count(*) AS turns FROM conversations GROUP BY conv_id""")
def first_last_turn(spark, sf_dir):
    """P7"""
    rows = _conversations(spark, sf_dir).select("conv_id", records.messages(F.col("record")).alias("m"))
    return rows.select("conv_id", records.first_user(F.col("m")).alias("first_user"), records.last_assistant(F.col("m")).alias("last_assistant"), F.size("m").cast("bigint").alias("turns"))


@query("SELECT conv_id, string_agg(coalesce(role, 'unknown') || ':' || text, '|' ORDER BY turn) AS messages FROM conversations GROUP BY conv_id")
def messages_array(spark, sf_dir):
    """P6"""
    rows = _conversations(spark, sf_dir).select("conv_id", records.messages(F.col("record")).alias("m"))
    return rows.select("conv_id", F.array_join(F.transform("m", lambda x: F.concat(x["role"], F.lit(":"), x["content"])), "|").alias("messages"))


@query("""SELECT CAST(user_id AS VARCHAR) AS experiment_id, round(coalesce(sum(value), 0), 4) AS cost, count(*) AS tokens_in, CAST(sum(CAST(json_extract(props, '$.k') AS BIGINT)) AS BIGINT) AS tokens_out,
    CAST(count(*) + sum(CAST(json_extract(props, '$.k') AS BIGINT)) AS BIGINT) AS total_tokens FROM events GROUP BY user_id""")
def usage_by_experiment(spark, sf_dir):
    """A10 A11 P23"""
    from tracemill.sources.records import usage_totals

    e = _t(spark, sf_dir, "events")
    rows = e.select(F.col("user_id").cast("string").alias("experiment_id"), F.col("value").alias("cost"), F.lit(1).cast("bigint").alias("tokens_in"), F.get_json_object("props", "$.k").cast("bigint").alias("tokens_out"))
    return usage_totals(rows, by="experiment_id").withColumn("cost", F.round("cost", 4))


@query("""WITH e AS (SELECT TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE) AS score FROM events)
    SELECT CASE WHEN score IS NULL THEN 'error' WHEN score >= 50 THEN 'pass' ELSE 'fail' END AS label, count(*) AS n, sum(score) AS total FROM e GROUP BY 1""")
def json_path_score(spark, sf_dir):
    """P1 P3 P4"""
    score = records.score_at(F.try_parse_json("props"), "k")
    rows = _t(spark, sf_dir, "events").select(score.alias("score"))
    return rows.groupBy(records.score_label(F.col("score"), 50).alias("label")).agg(F.count("*").alias("n"), F.sum("score").alias("total"))


_R = "round({0}, 6) AS {1}"


def _rounded(df: DataFrame, *names: str, digits: int = 6) -> DataFrame:
    return df.select(*[F.round(c, digits).alias(c) if c in names else F.col(c) for c in df.columns])


_MEAN_CI = """q AS (SELECT event_type, user_id, avg(value) AS v FROM events GROUP BY ALL),
    g AS (SELECT event_type, count(v) AS n, avg(v) AS mean, stddev_samp(v) / sqrt(count(v)) AS se, min(v) AS low, max(v) AS high FROM q GROUP BY event_type)"""


@query(f"""WITH {_MEAN_CI} SELECT event_type, n, round(mean, 6) AS mean, round(se, 6) AS se, round(CASE WHEN n > 5 THEN mean - 1.96 * se END, 6) AS ci_low,
    round(CASE WHEN n > 5 THEN mean + 1.96 * se END, 6) AS ci_high, round(low, 6) AS low, round(high, 6) AS high FROM g""")
def mean_se_ci(spark, sf_dir):
    """A17 A18 A21"""
    return _rounded(stats.mean_se_ci(_t(spark, sf_dir, "events"), ["event_type"], "user_id", "value"), "mean", "se", "ci_low", "ci_high", "low", "high")


_PAIRED = """p AS (SELECT user_id, avg(value) FILTER (event_type = 'click') AS x, avg(value) FILTER (event_type = 'purchase') AS y FROM events GROUP BY user_id),
    d AS (SELECT x - y AS d FROM p WHERE x IS NOT NULL AND y IS NOT NULL), a AS (SELECT count(d) AS n, avg(d) AS m, stddev_samp(d) / sqrt(count(d)) AS se, var_samp(d) AS v FROM d)"""


@query(f"WITH {_PAIRED} SELECT n, round(m, 6) AS mean_diff, round(se, 6) AS se_diff, round(m - 1.96 * se, 6) AS ci_low, round(m + 1.96 * se, 6) AS ci_high, round(sqrt(8 * v / n), 6) AS detectable FROM a")
def paired_diff(spark, sf_dir):
    """J4 A19 A24"""
    rows = stats.paired_diff(_t(spark, sf_dir, "events"), "event_type", "user_id", "value", "click", "purchase")
    return _rounded(rows, "mean_diff", "se_diff", "ci_low", "ci_high", "detectable")


@query(f"WITH {_PAIRED} SELECT CAST(ceil(8 * v / 25.0) AS BIGINT) AS n_for_5, CAST(ceil(8 * v / 100.0) AS BIGINT) AS n_for_10 FROM a")
def power_n(spark, sf_dir):
    """A22"""
    d = stats.paired(_t(spark, sf_dir, "events"), "event_type", "user_id", "value", "click", "purchase").agg(F.var_samp("diff").alias("v"))
    return d.select(stats.required_n(F.col("v"), 5.0).alias("n_for_5"), stats.required_n(F.col("v"), 10.0).alias("n_for_10"))


@query("""WITH c AS (SELECT l_returnflag, l_orderkey, avg(l_quantity) AS m FROM lineitem GROUP BY ALL), k AS (SELECT l_returnflag, count(*) AS clusters, avg(m) AS mean, stddev_samp(m) / sqrt(count(*)) AS sc FROM c GROUP BY 1),
    r AS (SELECT l_returnflag, count(*) AS n, stddev_samp(l_quantity) / sqrt(count(*)) AS sn FROM lineitem GROUP BY 1)
    SELECT l_returnflag, clusters, n, round(mean, 6) AS mean, round(sc, 6) AS se_clustered, round(sn, 6) AS se_naive, round(sc / sn, 6) AS ratio FROM k JOIN r USING (l_returnflag)""")
def clustered_se(spark, sf_dir):
    """A20"""
    return _rounded(stats.clustered_se(_t(spark, sf_dir, "lineitem"), ["l_returnflag"], "l_orderkey", "l_quantity"), "mean", "se_clustered", "se_naive", "ratio")


@query("""WITH b AS (SELECT event_type, quantile_cont(value, 0.05) AS lo, quantile_cont(value, 0.95) AS hi, median(value) AS med, avg(value) AS mean FROM events GROUP BY 1),
    t AS (SELECT event_type, avg(value) AS tm FROM events JOIN b USING (event_type) WHERE value BETWEEN lo AND hi GROUP BY 1)
    SELECT event_type, round(mean, 6) AS mean, round(med, 6) AS median, round(tm, 6) AS trimmed_mean,
    CASE WHEN (mean > 50) = (med > 50) AND (med > 50) = (tm > 50) THEN 'ROBUST' ELSE 'FRAGILE' END AS verdict FROM b JOIN t USING (event_type)""")
def sensitivity(spark, sf_dir):
    """A23"""
    return _rounded(stats.sensitivity(_t(spark, sf_dir, "events"), ["event_type"], "value", against=50.0), "mean", "median", "trimmed_mean")


@query("""SELECT event_type, count(value) AS n, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS sd, round(quantile_cont(value, 0.25), 6) AS q1,
    round(quantile_cont(value, 0.5), 6) AS median, round(quantile_cont(value, 0.75), 6) AS q3 FROM events GROUP BY 1""")
def describe(spark, sf_dir):
    """A26"""
    return _rounded(stats.describe(_t(spark, sf_dir, "events"), ["event_type"], "value"), "mean", "sd", "q1", "median", "q3")


@query(f"""WITH {_MEAN_CI}, i AS (SELECT event_type, mean, mean - 1.96 * se AS lo, mean + 1.96 * se AS hi FROM g), r AS (SELECT *, row_number() OVER (ORDER BY mean DESC) AS rank, lead(hi) OVER (ORDER BY mean DESC) AS nh FROM i)
    SELECT event_type, round(mean, 6) AS mean, CAST(rank AS INT) AS rank, coalesce(rank = 1 AND lo > nh, false) AS bold FROM r""")
def rank_vs_second(spark, sf_dir):
    """A25 W9"""
    rows = stats.rank_vs_second(stats.mean_se_ci(_t(spark, sf_dir, "events"), ["event_type"], "user_id", "value"))
    return _rounded(rows.select("event_type", "mean", "rank", "bold"), "mean")


@query("SELECT l_returnflag, count(*) AS n, round(pow(0.025, 1.0 / count(*)), 9) AS lower_bound FROM lineitem GROUP BY 1")
def all_right_interval(spark, sf_dir):
    """A27"""
    rows = _t(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(F.count("*").alias("n"))
    return rows.select("l_returnflag", "n", F.round(stats.all_right_interval(F.col("n")), 9).alias("lower_bound"))


@query("""WITH r AS (SELECT lang, CAST(n_chars AS DOUBLE) AS s, toxic = 1 AS p FROM documents JOIN labels USING (doc_id)), c AS (SELECT lang, quantile_cont(s, 0.95) AS cut FROM r WHERE NOT p GROUP BY 1)
    SELECT lang, round(any_value(cut), 6) AS cut, round(avg(CAST(s >= cut AS INT)), 6) AS rate FROM r JOIN c USING (lang) WHERE p GROUP BY lang""")
def rate_at_false_positives(spark, sf_dir):
    """A28"""
    rows = _t(spark, sf_dir, "documents").join(_t(spark, sf_dir, "labels"), "doc_id").select("lang", F.col("n_chars").cast("double").alias("s"), (F.col("toxic") == 1).alias("p"))
    return _rounded(stats.rate_at_false_positives(rows, ["lang"], "s", "p"), "cut", "rate")


@query("""WITH r AS (SELECT lang, text LIKE '%!!%' AS p, quality = 0 AS a FROM documents JOIN labels USING (doc_id)),
    c AS (SELECT lang, count(*) FILTER (p AND a) AS tp, count(*) FILTER (p AND NOT a) AS fp, count(*) FILTER (NOT p AND a) AS fn, count(*) FILTER (NOT p AND NOT a) AS tn FROM r GROUP BY 1)
    SELECT lang, tp, fp, fn, tn, round(tp / nullif(tp + fp, 0), 6) AS precision, round(tp / nullif(tp + fn, 0), 6) AS recall, round(fp / nullif(fp + tn, 0), 6) AS fp_rate,
    round(2 * tp / nullif(2 * tp + fp + fn, 0), 6) AS f1 FROM c""")
def detector_quality(spark, sf_dir):
    """A29"""
    rows = _t(spark, sf_dir, "documents").join(_t(spark, sf_dir, "labels"), "doc_id").select("lang", F.contains("text", F.lit("!!")).alias("p"), (F.col("quality") == 0).alias("a"))
    return _rounded(stats.detector_quality(rows, ["lang"], "p", "a"), "precision", "recall", "fp_rate", "f1")


@query("""WITH r AS (SELECT n_chars AS s, toxic = 1 AS p FROM documents JOIN labels USING (doc_id)), g AS (SELECT s, count(*) FILTER (p) AS p, count(*) FILTER (NOT p) AS q FROM r GROUP BY s),
    w AS (SELECT p, q, sum(q) OVER (ORDER BY s) - q / 2 AS b FROM g) SELECT round(sum(p * b) / (sum(p) * sum(q)), 6) AS auc FROM w""")
def auc(spark, sf_dir):
    """A36 (own definition)"""
    rows = _t(spark, sf_dir, "documents").join(_t(spark, sf_dir, "labels"), "doc_id").select("n_chars", (F.col("toxic") == 1).alias("p"))
    return _rounded(stats.auc(rows, [], "n_chars", "p"), "auc")


@query("""WITH q AS (SELECT quantile_cont(value, 0.25) AS a, quantile_cont(value, 0.75) AS b FROM events), k AS (SELECT count(*) AS c FROM events GROUP BY event_id)
    SELECT count(*) AS n, count(*) FILTER (value IS NULL) AS missing, count(*) FILTER (isnan(value)) AS nan, count(*) FILTER (value < a - 1.5 * (b - a) OR value > b + 1.5 * (b - a)) AS outliers,
    (SELECT count(*) FROM k WHERE c > 1) AS repeated_keys FROM events, q""")
def data_quality(spark, sf_dir):
    """A31 (own definition)"""
    return stats.data_quality(_t(spark, sf_dir, "events"), "event_id", "value")


@query("""SELECT quality, toxic, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY quality), 6) AS share FROM labels GROUP BY quality, toxic""")
def confusion(spark, sf_dir):
    """A33 (own definition)"""
    return _rounded(stats.confusion(_t(spark, sf_dir, "labels"), "quality", "toxic"), "share")


@query(r"""SELECT doc_id, CASE WHEN regexp_matches(text, '\b[0-9a-f]{18}\b') AND contains(text, 'password') THEN 'block' WHEN contains(text, 'api_key') OR contains(text, 'token') THEN 'warn'
    WHEN regexp_matches(text, '(?i)\blicense\b') THEN 'note' ELSE 'allow' END AS decision FROM documents""")
def rule_cascade(spark, sf_dir):
    """P12-P16 shape"""
    t = F.col("text")
    found = [(t.rlike(r"\b[0-9a-f]{18}\b") & F.contains(t, F.lit("password")), "block"), (rules.any_contains(t, ("api_key", "token")), "warn"), (t.rlike(r"(?i)\blicense\b"), "note")]
    return _t(spark, sf_dir, "documents").select("doc_id", rules.cascade(found).alias("decision"))


@query(rf"SELECT doc_id, array_to_string(list_filter(string_split(text, chr(10)), lambda x: NOT regexp_matches(x, '{MARKS}|[A-Za-z0-9+/=]{{100,}}')), chr(10)) AS text FROM documents")
def redact_lines(spark, sf_dir):
    """P21"""
    return _t(spark, sf_dir, "documents").select("doc_id", text.redact_lines(F.col("text"), MARKS).alias("text"))


@query("""SELECT doc_id, array_to_string(list_transform(string_split(text, chr(10)), lambda x: CASE WHEN length(x) > 500 THEN substr(x, 1, 200) || ' ... [' || length(x) || ' chars] ... ' || right(x, 100) ELSE x END), chr(10)) AS text,
    CAST(len(list_filter(string_split(text, chr(10)), lambda x: length(x) > 500)) AS INT) AS cut_lines FROM documents""")
def truncate_lines(spark, sf_dir):
    """P30"""
    return lines.truncated(_t(spark, sf_dir, "documents"))


@query("""WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS a, text FROM documents),
    c AS (SELECT doc_id, a, text, list_transform(a, lambda x: CASE WHEN length(x) > 500 THEN substr(x, 1, 200) || ' ... [' || length(x) || ' chars] ... ' || right(x, 100) ELSE x END) AS t FROM l)
    SELECT doc_id, CASE WHEN length(text) > 1500 AND len(a) > 45 THEN array_to_string(t[1:15] || ['', '... [' || length(text) || ' chars, ' || len(a) || ' lines truncated] ...', ''] || t[-30:], chr(10)) ELSE array_to_string(t, chr(10)) END AS text FROM c""")
def truncate_stdout(spark, sf_dir):
    """T4"""
    return _t(spark, sf_dir, "documents").select("doc_id", text.truncate_stdout(F.col("text")).alias("text"))


_LINES = "l AS (SELECT doc_id, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS line_no, unnest(string_split(text, chr(10))) AS line FROM documents)"


@query(f"""WITH {_LINES}, h AS (SELECT *, CASE WHEN contains(line, 'password=') THEN 1 WHEN contains(line, 'All rights reserved') THEN 2 WHEN contains(line, 'License') THEN 3 END AS k FROM l)
    SELECT doc_id, CAST(line_no AS INT) AS line_no, ['password=', 'All rights reserved', 'License'][k] AS phrase, 'markers' AS category, ['high', 'low', 'medium'][k] AS severity, [95, 75, 88][k] AS confidence,
    ['definite', 'likely', 'likely'][k] AS tier, CAST(len(string_split(line, ['password=', 'All rights reserved', 'License'][k])) - 1 AS INT) AS times FROM h WHERE k IS NOT NULL""")
def phrase_lint(spark, sf_dir):
    """P25 P26 J5"""
    return lines.phrase_lint(_t(spark, sf_dir, "documents"), PHRASES)


@query(f"""WITH {_LINES}, m AS (SELECT *, contains(lower(line), 'license') AS hit FROM l),
    w AS (SELECT *, bool_or(hit) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS near FROM m)
    SELECT doc_id, CAST(line_no AS INT) AS line_no, line, hit AS is_match FROM w WHERE near""")
def context_lines(spark, sf_dir):
    """P31 W5"""
    return lines.search(_t(spark, sf_dir, "documents"), "License", 2, literal=True)


@query(r"SELECT doc_id, CAST(len(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '(?i)\blicense\b'))) AS INT) AS n FROM documents WHERE len(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '(?i)\blicense\b'))) > 0")
def matches_by_text(spark, sf_dir):
    """A39"""
    return lines.matches_by_text(_t(spark, sf_dir, "documents"), r"\blicense\b")


@query("""SELECT event_id, user_id, event_type, ts, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) = 1""")
def last_wins(spark, sf_dir):
    """W3 W4"""
    rows = _t(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "ts", "value")
    return journal.last_wins(rows, ["user_id", "event_type"], ["ts", "event_id"])


@query("SELECT CAST(date_trunc('week', ts) AS DATE) AS week, count(*) AS sessions, round(avg(CAST(event_type <> 'error' AS INT)), 6) AS success_rate FROM events GROUP BY 1")
def weekly_trend(spark, sf_dir):
    """A15 R5"""
    return _rounded(journal.weekly_trend(_t(spark, sf_dir, "events"), "ts", F.col("event_type") != "error"), "success_rate")


@query("""WITH w AS (SELECT o_custkey, o_orderkey, o_totalprice, min(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS best_before FROM orders)
    SELECT *, best_before IS NULL OR o_totalprice < best_before AS keep FROM w""")
def running_best(spark, sf_dir):
    """W6"""
    return journal.running_best(_t(spark, sf_dir, "orders"), ["o_custkey"], ["o_orderdate", "o_orderkey"], "o_totalprice").select("o_custkey", "o_orderkey", "o_totalprice", "best_before", "keep")


@query("""WITH w AS (SELECT o_custkey, o_orderkey, sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS UNBOUNDED PRECEDING) AS s FROM orders)
    SELECT o_custkey, o_orderkey, round(s, 2) AS spent, s <= 1000000 - 50000 AS may_run FROM w""")
def budget_stop(spark, sf_dir):
    """W7"""
    rows = journal.budget_stop(_t(spark, sf_dir, "orders"), ["o_custkey"], ["o_orderdate", "o_orderkey"], "o_totalprice", 1_000_000, 50_000)
    return _rounded(rows.select("o_custkey", "o_orderkey", "spent", "may_run"), "spent", digits=2)


@query("""WITH i AS (SELECT user_id, ts, event_id, event_type = 'view' AS f, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events),
    g AS (SELECT *, k - row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS isl FROM i WHERE f)
    SELECT user_id, min(ts) AS first_ts, arg_min(event_id, (ts, event_id)) AS first_event_id, max(ts) AS last_ts, arg_max(event_id, (ts, event_id)) AS last_event_id, count(*) AS length FROM g GROUP BY user_id, isl HAVING count(*) >= 3""")
def failure_streaks(spark, sf_dir):
    """W8"""
    return journal.streaks(_t(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], F.col("event_type") == "view")


@query("""SELECT o_custkey, o_orderkey, CAST(row_number() OVER w AS INT) AS run, row_number() OVER w <= 3 AS allowed FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)""")
def runs_per_idea(spark, sf_dir):
    """W10 W12"""
    return journal.nth_run(_t(spark, sf_dir, "orders"), ["o_custkey"], ["o_orderdate", "o_orderkey"], 3).select("o_custkey", "o_orderkey", F.col("run").cast("int").alias("run"), "allowed")


@query("""WITH j AS (SELECT p_partkey % 1000 AS s, p_size AS c, CASE p_size % 3 WHEN 0 THEN p_size * 1024 WHEN 1 THEN p_size ELSE 0 END AS m, p_size % 4 AS g FROM part),
    n AS (SELECT s_suppkey, s_nationkey, CASE WHEN s_nationkey % 5 = 0 THEN 0 ELSE 8 END AS gp FROM supplier WHERE s_nationkey % 7 <> 0),
    h AS (SELECT s, sum(c) AS c, sum(m) AS m, sum(g) AS g FROM j GROUP BY s)
    SELECT 'n' || s_suppkey AS node, 4096 AS cpus, CAST(4096 - coalesce(c, 0) AS BIGINT) AS free_cpus, CAST(4194304 AS BIGINT) AS memory_mb, CAST((4194304 - coalesce(m, 0)) // 1024 AS BIGINT) AS free_memory_gb,
    gp AS gpus, CAST(gp - CASE WHEN gp > 0 THEN coalesce(g, 0) ELSE 0 END AS BIGINT) AS free_gpus, 'idle' AS state FROM n LEFT JOIN h ON s = s_suppkey""")
def node_free(spark, sf_dir):
    """J1 A13 P29"""
    nodes = _t(spark, sf_dir, "supplier").select(F.concat(F.lit("n"), "s_suppkey").alias("node"), F.lit(4096).alias("cpus"), F.lit(4194304).cast("bigint").alias("memory_mb"), F.when(F.col("s_nationkey") % 5 == 0, "(null)").otherwise("gpu:a100:8").alias("gres"), F.when(F.col("s_nationkey") % 7 == 0, "drained").otherwise("idle").alias("state"))
    size = F.col("p_size")
    jobs = _t(spark, sf_dir, "part").select(F.concat(F.lit("n"), F.col("p_partkey") % 1000).alias("node"), size.alias("job_cpus"), F.concat(size.cast("string"), F.when(size % 3 == 0, "G").when(size % 3 == 1, "M").otherwise("")).alias("job_mem"), F.concat(F.lit("gpu:a100:"), (size % 4).cast("string")).alias("tres"))
    return cluster.free_resources(nodes, jobs)


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL)")
def missing_docs(spark, sf_dir):
    """J2 J6 U3"""
    return journal.missing(_t(spark, sf_dir, "documents").select("doc_id"), _t(spark, sf_dir, "labels"), "doc_id")


@query("""WITH d AS (SELECT o_orderkey, o_orderdate, CAST(floor((epoch(TIMESTAMP '1999-01-01') - epoch(o_orderdate)) / 86400) AS BIGINT) AS days FROM orders)
    SELECT o_orderkey, days, epoch(o_orderdate) > 0 AND days > CASE WHEN o_orderkey % 13 > 10 THEN 7 WHEN o_orderkey % 13 >= 1 THEN 14 ELSE 999 END AS stale FROM d""")
def staleness_class(spark, sf_dir):
    """date CASE (2.9)"""
    now = F.to_timestamp_ntz(F.lit("1999-01-01 00:00:00")).cast("timestamp")
    at = F.col("o_orderdate").cast("timestamp")
    return _t(spark, sf_dir, "orders").select("o_orderkey", journal.whole_days(now, at).alias("days"), journal.staleness(F.unix_timestamp(now), F.unix_timestamp(at), F.col("o_orderkey") % 13).alias("stale"))


@query("SELECT line, count(*) AS n FROM (SELECT unnest(string_split(text, chr(10))) AS line FROM documents) WHERE line <> '' GROUP BY 1 HAVING count(*) >= 2")
def duplicate_lines(spark, sf_dir):
    """A31 (own definition)"""
    return lines.duplicate_lines(_t(spark, sf_dir, "documents"))


@query("""WITH c AS (SELECT c_custkey AS key, CASE WHEN c_custkey % 3 = 0 THEN '' ELSE c_name END AS response FROM customer WHERE c_custkey % 2 = 0)
    SELECT count(*) AS n, count(response) FILTER (response <> '') AS hits, round(avg(CAST(coalesce(response, '') <> '' AS INT)), 6) AS hit_rate FROM orders LEFT JOIN c ON key = o_custkey""")
def cache_aside(spark, sf_dir):
    """J3 A30"""
    cache = _t(spark, sf_dir, "customer").where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("key"), F.when(F.col("c_custkey") % 3 == 0, "").otherwise(F.col("c_name")).alias("response"))
    found = journal.cached(_t(spark, sf_dir, "orders").select(F.col("o_custkey").alias("key")), cache)
    return _rounded(found.agg(F.count("*").alias("n"), F.count_if("hit").alias("hits"), F.avg(F.col("hit").cast("int")).alias("hit_rate")), "hit_rate")


@query("""SELECT o_orderkey, CASE o_orderkey % 7 WHEN 0 THEN 'backoff' WHEN 1 THEN 'backoff' WHEN 2 THEN 'backoff' WHEN 3 THEN 'skip' WHEN 4 THEN 'fail' WHEN 5 THEN CASE WHEN o_orderkey % 6 + 1 > 3 THEN 'fail' ELSE 'retry' END END AS policy,
    CASE WHEN o_orderkey % 7 < 3 THEN least(pow(2, o_orderkey % 6), 16) END AS wait_s FROM orders""")
def retry_policy(spark, sf_dir):
    """P44"""
    status = F.get(F.array(*[F.lit(x) for x in ("429", "503", "500", "400", "401", "timeout", "200")]), (F.col("o_orderkey") % 7).cast("int"))
    calls = _t(spark, sf_dir, "orders").select("o_orderkey", status.alias("status"), (F.col("o_orderkey") % 6 + 1).alias("attempt"))
    return rules.retry_policy(calls).select("o_orderkey", "policy", "wait_s")


@query("""SELECT event_id, event_type, round(avg(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW), 6) AS moving_average FROM events""")
def moving_average(spark, sf_dir):
    """W13 A37 (own definition)"""
    rows = _t(spark, sf_dir, "events").withColumn("at", F.struct("ts", "event_id"))
    return _rounded(lines.moving_average(rows, ["user_id"], "at", "value", 5).select("event_id", "event_type", "moving_average"), "moving_average")


@query("""SELECT date_trunc('hour', ts) AS start, count(*) AS calls, count(*) <= 20 AS within FROM events GROUP BY 1""")
def call_rate(spark, sf_dir):
    """R7 (own definition)"""
    from tracemill.streaming.rules import call_rate as rate

    rows = rate(_t(spark, sf_dir, "events"), "ts", "1 hour", "1 hour", 20)
    return rows.select(F.col("start").cast("timestamp_ntz").alias("start"), "calls", "within")


# Commands that the rule queries deal out over orders: one for most alternatives, near misses, exclusions.
COMMANDS = (
    "sudo rm -r /tmp/x", "sudo rm -rf /tmp/x", "ls | xargs kill", "make && kill 7", "kill 7", "sleep 30", "npm install", "pip install --help", "uv run train.py train", "pytest tests/Eval_x",
    "docker logs web", "docker logs web | tail", "docker logs --tail=5 web", "git log | head", "git status", "journalctl", "journalctl -n 5", "cat a | less", "kubectl logs p | tail", "./run_all.py",
    "inspect eval task.py", "python -m lab.benchmark", "python check_transcripts.py run_x.py", "curl http://h/a.zip", "make all", "make clean", "tsc", "echo done", "", "vite",
)


def _commands(spark, sf_dir):
    pick = F.element_at(F.array(*[F.lit(c) for c in COMMANDS]), (F.col("o_orderkey") % len(COMMANDS) + 1).cast("int"))
    return _t(spark, sf_dir, "orders").select("o_orderkey", pick.alias("command"))


_CMD = "c AS (SELECT o_orderkey, [" + ", ".join("'" + c + "'" for c in COMMANDS) + f"][o_orderkey % {len(COMMANDS)} + 1] AS command FROM orders)"


def _any(marks) -> str:
    return " OR ".join(f"contains(command, '{m}')" for m in marks)


@query(f"WITH {_CMD} SELECT o_orderkey, CASE WHEN regexp_matches(command, '\\bsudo\\s+(rm\\s+-r|kill|killall|pkill|shutdown|reboot|halt|mkfs|fdisk|wipefs|dd)\\b') OR regexp_matches(command, '\\bxargs\\s+.*(rm\\s+-r|kill|killall|pkill)\\b') THEN 'block' WHEN regexp_matches(command, '(&&|;|\\|\\||`|\\$\\()\\s*(kill|killall|pkill)\\b') THEN 'warn' ELSE 'allow' END AS decision FROM c")
def destructive_commands(spark, sf_dir):
    """P12"""
    return _commands(spark, sf_dir).select("o_orderkey", rules.destructive(F.col("command")).alias("decision"))


@query(f"""WITH {_CMD}, t AS (SELECT *, o_orderkey % 3 * 20000 AS ms FROM c) SELECT o_orderkey, CASE WHEN command = '' OR ms BETWEEN 1 AND 30000 OR {_any(rules.NOT_LONG)} THEN 'none'
    WHEN regexp_matches(command, '{"|".join(rules.LONG)}') THEN 'force' WHEN regexp_matches(command, '{"|".join(rules.MAYBE_LONG)}') THEN 'suggest' ELSE 'none' END AS decision FROM t""")
def long_running_commands(spark, sf_dir):
    """P13"""
    return _commands(spark, sf_dir).select("o_orderkey", rules.long_running(F.col("command"), timeout=F.col("o_orderkey") % 3 * 20000).alias("decision"))


@query(rf"""WITH {_CMD} SELECT o_orderkey, CASE WHEN regexp_matches(command, '\|\s*(less|more)\b') THEN 'pager' WHEN regexp_matches(command, '\bgit\s+log\b.*\|\s*head\b') THEN 'git_log_head'
    WHEN regexp_matches(command, '\bkubectl\s+logs\b.*\|\s*tail\b') THEN 'kubectl_logs_tail' WHEN regexp_matches(command, '\bdocker\s+logs\b.*\|\s*tail\b') THEN 'docker_logs_tail'
    WHEN regexp_matches(command, '\bdocker\s+logs\b') AND NOT contains(command, '--tail') AND NOT contains(command, '|') THEN 'docker_logs_unlimited'
    WHEN regexp_matches(command, '\bjournalctl\b') AND NOT regexp_matches(command, '(\s-n\b|--lines)') AND NOT contains(command, '|') THEN 'journalctl_unlimited' ELSE 'none' END AS advice FROM c""")
def pipe_advice(spark, sf_dir):
    """P14"""
    return _commands(spark, sf_dir).select("o_orderkey", rules.pipe_advice(F.col("command")).alias("advice"))


@query(f"""WITH {_CMD} SELECT o_orderkey, command <> '' AND o_orderkey % 4 <> 1 AND NOT ({_any(rules.OWN_TOOLS)}) AND regexp_matches(command, '{"|".join(rules.EXPERIMENTS)}') AS experiment FROM c""")
def experiment_commands(spark, sf_dir):
    """P15"""
    code = F.when(F.col("o_orderkey") % 4 == 1, "1").when(F.col("o_orderkey") % 4 == 2, "0")
    return _commands(spark, sf_dir).select("o_orderkey", rules.is_experiment(F.col("command"), code).alias("experiment"))


@query("""SELECT doc_id, CASE WHEN length(text) > 500 THEN '... [stderr truncated] ...' || chr(10) || chr(10) ELSE '' END || array_to_string(list_transform(CASE WHEN length(text) > 500 THEN string_split(text, chr(10))[-20:] ELSE string_split(text, chr(10)) END,
    lambda x: CASE WHEN length(x) > 500 THEN substr(x, 1, 200) || ' ... [' || length(x) || ' chars] ... ' || right(x, 100) ELSE x END), chr(10)) AS text FROM documents""")
def truncate_stderr(spark, sf_dir):
    """T4"""
    return _t(spark, sf_dir, "documents").select("doc_id", text.truncate_stderr(F.col("text")).alias("text"))


@query(r"""SELECT doc_id, CAST(len(list_filter(regexp_split_to_array(text, '[.!?]+'), lambda s: len(list_filter(regexp_split_to_array(s, '\s+'), lambda w: w <> '')) > 40)) AS INT) AS run_ons,
    CAST(len(list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> '')) AS INT) AS words FROM documents""")
def run_on_sentences(spark, sf_dir):
    """P33"""
    return _t(spark, sf_dir, "documents").select("doc_id", text.run_on_sentences(F.col("text")).alias("run_ons"), text.word_count(F.col("text")).alias("words"))


@query("""WITH s AS (SELECT l_returnflag, count(*) FILTER (l_linestatus = 'F') AS na, count(*) FILTER (l_linestatus = 'O') AS nb, avg(l_quantity) FILTER (l_linestatus = 'F') AS ma, avg(l_quantity) FILTER (l_linestatus = 'O') AS mb,
    var_samp(l_quantity) FILTER (l_linestatus = 'F') AS va, var_samp(l_quantity) FILTER (l_linestatus = 'O') AS vb FROM lineitem GROUP BY 1), p AS (SELECT *, sqrt(((na - 1) * va + (nb - 1) * vb) / nullif(na + nb - 2, 0)) AS sd FROM s)
    SELECT l_returnflag, na, nb, round(ma - mb, 6) AS diff, round(sd, 6) AS pooled, round((ma - mb) / sd, 6) AS d, round((ma - mb) / sqrt(va / na + vb / nb), 6) AS t FROM p""")
def cohens_d(spark, sf_dir):
    """A35 (own definition)"""
    return _rounded(stats.cohens_d(_t(spark, sf_dir, "lineitem"), ["l_returnflag"], "l_linestatus", "l_quantity", "F", "O"), "diff", "pooled", "d", "t")


@query("""WITH o AS (SELECT source AS a, lang AS b, count(*) AS o FROM documents WHERE source IS NOT NULL AND lang IS NOT NULL GROUP BY ALL), m AS (SELECT *, sum(o) OVER (PARTITION BY a) AS ra, sum(o) OVER (PARTITION BY b) AS rb FROM o)
    SELECT CAST(sum(o) AS BIGINT) AS n, round(sum(o) * sum(o * o / (ra * rb)) - sum(o), 6) AS chi_square, (count(DISTINCT a) - 1) * (count(DISTINCT b) - 1) AS df FROM m""")
def chi_square(spark, sf_dir):
    """A35 (own definition)"""
    return _rounded(stats.chi_square(_t(spark, sf_dir, "documents"), "source", "lang"), "chi_square")


@query("SELECT l_returnflag, count(*) AS n, round(corr(l_quantity, l_extendedprice), 6) AS r FROM lineitem GROUP BY 1")
def correlation(spark, sf_dir):
    """A35 (own definition)"""
    return _rounded(stats.correlation(_t(spark, sf_dir, "lineitem"), ["l_returnflag"], "l_quantity", "l_extendedprice"), "r")


@query("""SELECT event_type, CAST(CASE WHEN value < 0 THEN 0 WHEN value >= 200 THEN 21 ELSE floor(value / 10) + 1 END AS BIGINT) AS bin, count(*) AS n FROM events GROUP BY ALL""")
def histogram(spark, sf_dir):
    """A36 (own definition)"""
    return stats.histogram(_t(spark, sf_dir, "events"), ["event_type"], "value", 0.0, 200.0, 20)


@query("""SELECT lang, n_chars, round(sum(count(*)) OVER (PARTITION BY lang ORDER BY n_chars) / sum(count(*)) OVER (PARTITION BY lang), 9) AS share FROM documents WHERE n_chars IS NOT NULL GROUP BY lang, n_chars""")
def ecdf(spark, sf_dir):
    """A36 (own definition)"""
    return _rounded(stats.ecdf(_t(spark, sf_dir, "documents"), ["lang"], "n_chars"), "share", digits=9)


@query("""SELECT doc_id, CAST(len(list_filter(string_split(text, chr(10)), lambda x: x = '---')) AS INT) AS separators, CAST(len(list_filter(string_split(text, chr(10)), lambda x: x = '---')) + 1 AS INT) AS slides FROM documents""")
def slide_count(spark, sf_dir):
    """A43"""
    return lines.slide_count(_t(spark, sf_dir, "documents"))


@query(f"""WITH {_LINES}, h AS (SELECT *, CASE WHEN contains(line, 'password=') THEN 1 WHEN contains(line, 'All rights reserved') THEN 2 WHEN contains(line, 'License') THEN 3 END AS k FROM l),
    s AS (SELECT doc_id, len(string_split(line, ['password=', 'All rights reserved', 'License'][k])) - 1 AS times, [95, 75, 88][k] * [3, 1, 2][k] / 100 AS w FROM h WHERE k IS NOT NULL),
    g AS (SELECT doc_id, CAST(sum(times) AS BIGINT) AS matches, sum(times * w) AS weight FROM s GROUP BY 1),
    d AS (SELECT doc_id, CAST(len(list_filter(regexp_split_to_array(coalesce(text, ''), '\\s+'), lambda w: w <> '')) AS INT) AS words FROM documents),
    r AS (SELECT doc_id, coalesce(matches, 0) AS matches, words, least(100.0, coalesce(weight, 0) * 100 / greatest(words, 1)) AS score FROM d LEFT JOIN g USING (doc_id))
    SELECT doc_id, matches, words, round(score, 6) AS score, CASE WHEN score < 10 THEN '0-10' WHEN score < 20 THEN '10-20' WHEN score < 40 THEN '20-40' ELSE '40-100' END AS band FROM r""")
def lint_score(spark, sf_dir):
    """A38 (own definition)"""
    return _rounded(lines.lint_score(_t(spark, sf_dir, "documents"), PHRASES), "score")


@query("""SELECT event_type, count(*) AS sessions FROM events GROUP BY 1""")
def session_counts(spark, sf_dir):
    """A14"""
    from tracemill.sources.records import session_counts as counts

    return counts(_t(spark, sf_dir, "events"), "event_type")


@query("""SELECT o_orderkey, CASE o_orderkey % 9 WHEN 0 THEN 'read' WHEN 1 THEN 'edit' WHEN 2 THEN 'search' WHEN 3 THEN 'research' WHEN 4 THEN 'notebook' WHEN 5 THEN 'none' WHEN 6 THEN 'other'
    ELSE CASE WHEN o_orderkey % 9 = 7 THEN 'none' ELSE 'command' END END AS kind FROM orders""")
def delegation(spark, sf_dir):
    """P16"""
    k = (F.col("o_orderkey") % 9).cast("int")
    tool = F.get(F.array(*[F.lit(x) for x in ("Read", "Edit", "Grep", "WebFetch", "NotebookEdit", "Skill", "Odd", "Bash", "Bash")]), k)
    command = F.when(k == 7, "git log -3").otherwise("git push")
    return _t(spark, sf_dir, "orders").select("o_orderkey", rules.delegation(tool, command, F.lit(True)).alias("kind"))


@query(r"""WITH k AS (SELECT doc_id, trim(regexp_replace(lower(text), '\s+', ' ', 'g')) AS t, doc_id IN (SELECT doc_id FROM labels) AS labelled FROM documents)
    SELECT doc_id FROM k WHERE NOT labelled AND t IN (SELECT t FROM k WHERE labelled)""")
def train_test_overlap(spark, sf_dir):
    """J9"""
    docs, labels = _t(spark, sf_dir, "documents").select("doc_id", "text"), _t(spark, sf_dir, "labels").select("doc_id")
    return journal.overlap(docs.join(labels, "doc_id", "left_semi"), docs.join(labels, "doc_id", "left_anti")).select("doc_id")


@query("""SELECT c_custkey, coalesce(o.v, c_acctbal) AS v FROM customer LEFT JOIN (SELECT o_custkey, max(o_totalprice) AS v FROM orders WHERE o_orderstatus = 'F' GROUP BY 1) o ON o_custkey = c_custkey""")
def first_existing_place(spark, sf_dir):
    """J7"""
    orders, customers = _t(spark, sf_dir, "orders"), _t(spark, sf_dir, "customer")
    dearest = orders.where("o_orderstatus = 'F'").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max("o_totalprice").alias("v"))
    return journal.first_existing(customers.select("c_custkey"), "c_custkey", [dearest, customers.select("c_custkey", F.col("c_acctbal").alias("v"))], "v")


@query("""WITH c AS (SELECT o_custkey, avg(o_totalprice) FILTER (o_orderstatus = 'F') AS a, avg(o_totalprice) FILTER (o_orderstatus = 'O') AS b,
    count(*) FILTER (o_orderstatus = 'F') AS n, count(*) FILTER (o_orderstatus = 'O') AS m FROM orders GROUP BY 1)
    SELECT o_custkey, abs(a - b) <= 0.2 * b AND n = m AS reproduced FROM c WHERE n > 0 AND m > 0""")
def cost_reproduced(spark, sf_dir):
    """A41"""
    done = lambda s: F.col("o_orderstatus") == s
    each = [x for s in "FO" for x in (F.avg(F.when(done(s), F.col("o_totalprice"))).alias(f"cost{s}"), F.count_if(done(s)).alias(f"n{s}"))]
    rows = _t(spark, sf_dir, "orders").groupBy("o_custkey").agg(*each).where("nF > 0 and nO > 0")
    return stats.reproduced(rows, "costF", "costO", "nF", "nO").select("o_custkey", "reproduced")


@query("""SELECT CAST(least(floor(s * 10), 9) AS INT) AS bin, count(*) AS n, round(avg(s), 6) AS mean_score, round(avg(p), 6) AS share
    FROM (SELECT least(greatest(value / 100, 0), 1) AS s, CAST(user_id % 2 = 0 AS INT) AS p FROM events WHERE value IS NOT NULL) GROUP BY 1""")
def calibration_by_bin(spark, sf_dir):
    """A36"""
    rows = _t(spark, sf_dir, "events").where("value is not null").select(F.least(F.greatest(F.col("value") / 100, F.lit(0.0)), F.lit(1.0)).alias("s"), (F.col("user_id") % 2 == 0).alias("p"))
    return _rounded(stats.calibration(rows, "s", "p"), "mean_score", "share")


@query("SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY 1")
def status_tally(spark, sf_dir):
    """A16"""
    return journal.status_tally(_t(spark, sf_dir, "orders"), "o_orderstatus")


# Distribution functions in SQL, independent of the library's: Simpson's rule over what is left of the density.
_POINTS = "range(0, 4001)"
_W = "CASE WHEN i = 0 OR i = 4000 THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END"


def _t_p(t: str, df: str) -> str:
    """Two-sided p of Student's t: with t = sqrt(df) tan(x), the density is a power of cos(x)."""
    low = f"atan(abs({t}) / sqrt({df}))"
    step = f"((least(pi() / 2, {low} + 14 / sqrt({df})) - {low}) / 4000)"
    total = f"list_sum(list_transform({_POINTS}, lambda i: {_W} * exp(({df} - 1) * ln(greatest(cos({low} + i * {step}), 1e-300))))) * {step} / 3"
    return f"(2 * {total} * exp(lgamma(({df} + 1) / 2) - lgamma({df} / 2) - lgamma(0.5)))"


def _chi_p(x: str, df: str) -> str:
    """Upper tail of chi-square, over its root."""
    step = f"((sqrt({df}) + 14) / 4000)"
    at = f"greatest(sqrt({x}) + i * {step}, 1e-300)"
    total = f"list_sum(list_transform({_POINTS}, lambda i: {_W} * exp(({df} - 1) * ln({at}) - {at} * {at} / 2))) * {step} / 3"
    return f"(2 * {total} / exp({df} / 2.0 * ln(2) + lgamma({df} / 2.0)))"


@query(f"""WITH s AS (SELECT l_returnflag, count(*) FILTER (l_linestatus = 'F') AS na, count(*) FILTER (l_linestatus = 'O') AS nb, avg(l_quantity) FILTER (l_linestatus = 'F') AS ma, avg(l_quantity) FILTER (l_linestatus = 'O') AS mb,
    var_samp(l_quantity) FILTER (l_linestatus = 'F') / count(*) FILTER (l_linestatus = 'F') AS va, var_samp(l_quantity) FILTER (l_linestatus = 'O') / count(*) FILTER (l_linestatus = 'O') AS vb FROM lineitem GROUP BY 1),
    t AS (SELECT *, (ma - mb) / sqrt(va + vb) AS t, (va + vb) * (va + vb) / (va * va / (na - 1) + vb * vb / (nb - 1)) AS df FROM s)
    SELECT l_returnflag, na, nb, round(ma - mb, 9) AS diff, round(t, 9) AS t, round(df, 4) AS df, round({_t_p('t', 'df')}, 9) AS p, round(ma - mb - 1.96 * sqrt(va + vb), 9) AS ci_low, round(ma - mb + 1.96 * sqrt(va + vb), 9) AS ci_high FROM t""")
def t_test(spark, sf_dir):
    """A35 (own definition)"""
    rows = stats.t_test(_t(spark, sf_dir, "lineitem"), ["l_returnflag"], "l_linestatus", "l_quantity", "F", "O").drop("ma", "mb")
    return _rounded(_rounded(rows, "diff", "t", "p", "ci_low", "ci_high", digits=9), "df", digits=4)


@query(f"""WITH {_PAIRED}, t AS (SELECT n, m, m / se AS t, CAST(n - 1 AS DOUBLE) AS df FROM a) SELECT n, round(m, 9) AS mean_diff, round(t, 9) AS t, df, round({_t_p('t', 'df')}, 9) AS p FROM t""")
def paired_t_test(spark, sf_dir):
    """A35 A19 (own definition)"""
    return _rounded(stats.paired_t_test(_t(spark, sf_dir, "events"), "event_type", "user_id", "value", "click", "purchase"), "mean_diff", "t", "p", digits=9)


@query(f"""WITH o AS (SELECT user_id % 7 AS a, event_type AS b, count(*) AS o FROM events GROUP BY ALL), m AS (SELECT *, sum(o) OVER (PARTITION BY a) AS ra, sum(o) OVER (PARTITION BY b) AS rb FROM o),
    c AS (SELECT CAST(sum(o) AS BIGINT) AS n, sum(o) * sum(o * o / (ra * rb)) - sum(o) AS x, (count(DISTINCT a) - 1) * (count(DISTINCT b) - 1) AS df FROM m)
    SELECT n, round(x, 6) AS chi_square, df, round({_chi_p('x', 'df')}, 9) AS p FROM c""")
def chi_square_test(spark, sf_dir):
    """A35 (own definition)"""
    rows = _t(spark, sf_dir, "events").select((F.col("user_id") % 7).alias("a"), F.col("event_type").alias("b"))
    return _rounded(_rounded(stats.chi_square_test(rows, "a", "b"), "chi_square"), "p", digits=9)


@query(f"""WITH c AS (SELECT event_type, count(*) AS n, corr(value, user_id) AS r FROM events GROUP BY 1), t AS (SELECT *, CAST(n - 2 AS DOUBLE) AS df, r * sqrt((n - 2) / (1 - r * r)) AS t FROM c)
    SELECT event_type, n, round(r, 9) AS r, round(t, 9) AS t, df, round({_t_p('t', 'df')}, 9) AS p FROM t""")
def correlation_test(spark, sf_dir):
    """A35 (own definition)"""
    return _rounded(stats.correlation_test(_t(spark, sf_dir, "events"), ["event_type"], "value", "user_id"), "r", "t", "p", digits=9)


_TAIL = "list_sum(list_transform(range({0}), lambda i: exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln({1}) + (n - i) * ln(1 - {1}))))"


@query(f"""WITH c AS (SELECT lang, count(*) AS n, count(*) FILTER (quality = 1) AS k FROM documents JOIN labels USING (doc_id) WHERE quality IS NOT NULL GROUP BY 1),
    b AS (SELECT *, list_reduce(range(60), lambda s, _: CASE WHEN {_TAIL.format('0, k + 1', '(s[1] + s[2]) / 2')} > 0.025 THEN [(s[1] + s[2]) / 2, s[2]] ELSE [s[1], (s[1] + s[2]) / 2] END, [CAST(0 AS DOUBLE), 1]) AS h,
        list_reduce(range(60), lambda s, _: CASE WHEN {_TAIL.format('k, n + 1', '(s[1] + s[2]) / 2')} > 0.025 THEN [s[1], (s[1] + s[2]) / 2] ELSE [(s[1] + s[2]) / 2, s[2]] END, [CAST(0 AS DOUBLE), 1]) AS l FROM c)
    SELECT lang, n, k, round(k / n, 9) AS share, round(CASE WHEN k = 0 THEN 0 ELSE (l[1] + l[2]) / 2 END, 9) AS low, round(CASE WHEN k = n THEN 1 ELSE (h[1] + h[2]) / 2 END, 9) AS high FROM b""")
def share_interval(spark, sf_dir):
    """A27"""
    rows = _t(spark, sf_dir, "documents").join(_t(spark, sf_dir, "labels"), "doc_id").select("lang", (F.col("quality") == 1).alias("good"))
    return _rounded(stats.share_interval(rows, ["lang"], F.col("good")), "share", "low", "high", digits=9)


@query(f"""WITH v AS (SELECT l_returnflag, l_linestatus = 'F' AS a, l_discount * 100 + l_quantity % 7 AS x FROM lineitem WHERE l_linestatus IN ('F', 'O')),
    r AS (SELECT *, rank() OVER (PARTITION BY l_returnflag ORDER BY x) + (count(*) OVER (PARTITION BY l_returnflag, x) - 1) / 2 AS rank, count(*) OVER (PARTITION BY l_returnflag, x) AS k FROM v),
    s AS (SELECT l_returnflag, CAST(count(*) FILTER (a) AS DOUBLE) AS na, CAST(count(*) FILTER (NOT a) AS DOUBLE) AS nb, coalesce(sum(rank) FILTER (a), 0) AS ra, sum(CAST(k AS DOUBLE) * k - 1) AS ties FROM r GROUP BY 1),
    z AS (SELECT *, ra - na * (na + 1) / 2 AS u, (ra - na * (na + 1) / 2 - na * nb / 2) / nullif(sqrt(na * nb / 12 * (na + nb + 1 - ties / ((na + nb) * (na + nb - 1)))), 0) AS z FROM s)
    SELECT l_returnflag, CAST(na AS BIGINT) AS na, CAST(nb AS BIGINT) AS nb, u, round(z, 9) AS z, CASE WHEN z IS NOT NULL THEN round({_chi_p('z * z', '1')}, 9) END AS p FROM z""")
def mann_whitney(spark, sf_dir):
    """A35 (own definition)"""
    rows = _t(spark, sf_dir, "lineitem").select("l_returnflag", "l_linestatus", (F.col("l_discount") * 100 + F.col("l_quantity") % 7).alias("x"))
    return _rounded(stats.mann_whitney(rows, ["l_returnflag"], "l_linestatus", "x", "F", "O"), "z", "p", digits=9)


@query("""WITH u AS (SELECT user_id || ':' || event_type AS unit, event_type = 'click' AS a, avg(value) AS v FROM events WHERE event_type IN ('click', 'purchase') GROUP BY user_id, event_type HAVING avg(value) IS NOT NULL),
    n AS (SELECT count(*) FILTER (a) AS na, count(*) FILTER (NOT a) AS nb, avg(v) FILTER (a) - avg(v) FILTER (NOT a) AS diff FROM u),
    d AS (SELECT r, v, row_number() OVER (PARTITION BY r ORDER BY md5('42:' || r || ':' || unit), unit) <= na AS first FROM u, n, (SELECT unnest(range(1, 201)) AS r)),
    e AS (SELECT r, avg(v) FILTER (first) - avg(v) FILTER (NOT first) AS d FROM d GROUP BY r)
    SELECT na, nb, round(any_value(diff), 6) AS diff, count(*) AS replicates, count(*) FILTER (abs(d) >= abs(diff) * (1 - 1e-9)) AS as_large, round((count(*) FILTER (abs(d) >= abs(diff) * (1 - 1e-9)) + 1) / 201, 9) AS p FROM e, n GROUP BY na, nb""")
def permutation_test(spark, sf_dir):
    """A34 (own definition)"""
    units = stats.collapsed(_t(spark, sf_dir, "events").where(F.col("event_type").isin("click", "purchase")), ["event_type"], "user_id", "value")
    return _rounded(stats.permutation_test(units, ["user_id", "event_type"], "event_type", "value", "click", "purchase"), "diff", "p", digits=6).withColumn("p", F.round("p", 9))


@query("""WITH p AS (SELECT lang, source, count(n_chars) AS n, sum(CAST(n_chars AS DOUBLE)) AS s FROM documents GROUP BY ALL), w AS (SELECT *, sum(n) OVER (PARTITION BY lang) AS an, sum(s) OVER (PARTITION BY lang) AS a FROM p)
    SELECT lang, source, n, round(s / n, 6) AS mean, round(a / an, 6) AS group_mean, round((a - s) / nullif(an - n, 0), 6) AS mean_without, CASE WHEN (a / an > 3500) = ((a - s) / nullif(an - n, 0) > 3500) THEN 'ROBUST' ELSE 'FRAGILE' END AS verdict FROM w""")
def sensitivity_subgroups(spark, sf_dir):
    """A23"""
    rows = _t(spark, sf_dir, "documents").select("lang", "source", F.col("n_chars").cast("double").alias("n_chars"))
    return _rounded(stats.subgroups(rows, ["lang"], "source", "n_chars", 3500.0), "mean", "group_mean", "mean_without")


@query("""WITH c AS (SELECT l_returnflag AS model, l_linestatus AS condition, l_partkey AS q, avg(l_discount) AS x FROM lineitem GROUP BY ALL),
    g AS (SELECT model, condition, q, avg(x) AS x, grouping(model) AS gm, grouping(condition) AS gc FROM c GROUP BY GROUPING SETS ((q), (model, q), (model, condition, q)))
    SELECT CASE WHEN gm = 1 THEN 'all' WHEN gc = 1 THEN 'model' ELSE 'model x condition' END AS level, model, condition, count(x) AS n, round(avg(x), 6) AS mean, round(stddev_samp(x) / sqrt(count(x)), 6) AS se,
    CASE WHEN count(x) > 5 THEN round(avg(x) - 1.96 * stddev_samp(x) / sqrt(count(x)), 6) END AS ci_low, CASE WHEN count(x) > 5 THEN round(avg(x) + 1.96 * stddev_samp(x) / sqrt(count(x)), 6) END AS ci_high FROM g GROUP BY gm, gc, model, condition""")
def levels(spark, sf_dir):
    """A32 (own definition)"""
    rows = _t(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("model"), F.col("l_linestatus").alias("condition"), F.col("l_partkey").alias("q"), "l_discount")
    return _rounded(stats.levels(rows, [[], ["model"], ["model", "condition"]], "q", "l_discount"), "mean", "se", "ci_low", "ci_high")


@query("""WITH g AS (SELECT n_chars, count(*) FILTER (toxic = 1) AS p, count(*) AS k FROM documents JOIN labels USING (doc_id) WHERE n_chars IS NOT NULL GROUP BY 1),
    w AS (SELECT n_chars, sum(p) OVER (ORDER BY n_chars DESC) AS tp, sum(k) OVER (ORDER BY n_chars DESC) AS called, sum(p) OVER () AS all_p FROM g)
    SELECT n_chars, round(tp / called, 9) AS precision, round(tp / nullif(all_p, 0), 9) AS recall FROM w""")
def precision_recall(spark, sf_dir):
    """A36 (own definition)"""
    rows = _t(spark, sf_dir, "documents").join(_t(spark, sf_dir, "labels"), "doc_id").select("n_chars", (F.col("toxic") == 1).alias("p"))
    return _rounded(stats.precision_recall(rows, [], "n_chars", "p"), "precision", "recall", digits=9)


@query("""WITH c AS (SELECT user_id, event_id, epoch_us(ts) / 1e6 * 0.0001 AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events WHERE ts IS NOT NULL),
    b AS (SELECT *, t - i + min(5 - t + i - 1) OVER (PARTITION BY user_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS tokens FROM c)
    SELECT user_id, event_id, round(tokens, 3) AS tokens, round(greatest(0, -tokens) / 0.0001, 0) AS wait_s FROM b""")
def token_bucket(spark, sf_dir):
    """R7 (own definition)"""
    rows = journal.token_bucket(_t(spark, sf_dir, "events").select("user_id", "event_id", "ts"), ["user_id"], "ts", ["event_id"], 0.0001, 5.0)
    return rows.select("user_id", "event_id", F.round("tokens", 3).alias("tokens"), F.round("wait_s", 0).alias("wait_s"))


_FLAG = lambda marks: " OR ".join(f"contains(t, '{m}')" for m in marks)
_SAID = {
    "refusal": ["i cannot", "i can''t", "i''m sorry", "i apologize", "as an ai", "as a language model", "i''m not able to", "i must decline", "i''m unable to", "it would be inappropriate"],
    "eval_aware": ["this is a test", "being evaluated", "benchmark", "being tested", "being assessed", "evaluation", "appears to be a", "seems like a test"],
    "error": ["error:", "traceback", "exception", "permission denied", "timeout", "rate limit", "connection refused", "404", "500", "oom", "out of memory", "killed"],
}


@query(rf"""WITH s AS (SELECT conv_id, turn, role, regexp_replace(coalesce(text, ''), '^[\s\p{{Z}}\x0b\x1c-\x1f\x85]+|[\s\p{{Z}}\x0b\x1c-\x1f\x85]+$', '', 'g') AS x FROM conversations), l AS (SELECT *, lower(x) AS t, length(x) AS n FROM s),
    m AS (SELECT role, quantile_cont(n, 0.5) AS expected FROM l GROUP BY role)
    SELECT conv_id, turn, l.role, n AS n_chars, expected, {_FLAG(_SAID["refusal"])} AS refusal, {_FLAG(_SAID["eval_aware"])} AS eval_aware, {_FLAG(_SAID["error"])} AS error,
    ends_with(t, '[truncated]') OR ends_with(t, '...') OR (NOT regexp_matches(x, '[.!?:;"''`)\]}}]$') AND n < 0.5 * expected) AS truncated FROM l JOIN m ON l.role IS NOT DISTINCT FROM m.role""")
def red_flags(spark, sf_dir):
    """P32"""
    turns = _t(spark, sf_dir, "conversations").withColumn("id", F.struct("conv_id", "turn"))
    rows = checks.red_flags(turns, ["role"], "id", "text")
    return rows.select("id.conv_id", "id.turn", "role", F.col("n_chars").cast("bigint").alias("n_chars"), "expected", "refusal", "eval_aware", "error", "truncated")


@query("""WITH s AS (SELECT n_nationkey, any_value(n_regionkey) AS r, count(s_suppkey) AS k FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey GROUP BY 1),
    g AS (SELECT *, dense_rank() OVER (ORDER BY r) AS titles, sum(k + 1) OVER (ORDER BY r, n_nationkey) AS upto FROM s),
    h AS (SELECT n_nationkey, r, CAST(1 + titles + upto - k AS BIGINT) AS first_page, CAST(1 + titles + upto AS BIGINT) AS last_page FROM g)
    SELECT 'nation-' || n_nationkey AS deck, first_page, last_page FROM h UNION ALL SELECT 'region-' || r, min(first_page) - 1, max(last_page) FROM h GROUP BY r UNION ALL SELECT 'all', 1, max(last_page) FROM h""")
def page_offsets(spark, sf_dir):
    """A43"""
    nations = _t(spark, sf_dir, "nation").join(_t(spark, sf_dir, "supplier"), F.col("s_nationkey") == F.col("n_nationkey"), "left").groupBy("n_nationkey", "n_regionkey").agg(F.count("s_suppkey").cast("int").alias("k"))
    name = lambda kind, c: F.concat(F.lit(f"{kind}-"), F.col(c).cast("string"))
    deck = lambda title, imports: F.concat_ws("\n---\n", F.lit(title), F.transform(F.array_sort(F.collect_list(imports)), lambda x: F.concat(F.lit("src: "), x["deck"])))
    low = nations.select(name("nation", "n_nationkey").alias("deck"), F.concat(F.lit("a nation"), F.repeat(F.lit("\n---\na supplier"), F.col("k"))).alias("text"))
    mid = nations.groupBy("n_regionkey").agg(deck("a region", F.struct("n_nationkey", name("nation", "n_nationkey").alias("deck"))).alias("text")).select(name("region", "n_regionkey").alias("deck"), "text")
    top = nations.select("n_regionkey").distinct().agg(deck("all", F.struct("n_regionkey", name("region", "n_regionkey").alias("deck"))).alias("text")).select(F.lit("all").alias("deck"), "text")
    return lines.page_offsets(low.unionByName(mid).unionByName(top), "all").select("deck", "first_page", "last_page")


@query(r"""WITH w AS (SELECT doc_id, text, list_filter(list_transform(regexp_split_to_array(text, '[.!?]+'), lambda s: len(list_filter(regexp_split_to_array(s, '\s+'), lambda w: w <> ''))), lambda n: n > 0) AS s,
    list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '\S')) AS l, len(list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> '')) AS words FROM documents WHERE text IS NOT NULL),
    m AS (SELECT *, list_avg(s) AS mean, CASE WHEN len(s) > 1 THEN list_stddev_samp(s) END AS sd, len(list_filter(l, lambda x: regexp_matches(x, '^\s*([-*+•]|[0-9]+[.)])\s'))) AS items FROM w)
    SELECT doc_id, CAST(len(s) AS BIGINT) AS sentences, round(mean, 6) AS mean_words, round(sd, 6) AS sd_words, round(1000 * (len(regexp_split_to_array(text, '—| - ')) - 1) / nullif(words, 0), 6) AS dashes,
    round(items / nullif(len(l), 0), 6) AS list_share, len(s) >= 5 AND coalesce(sd < 0.3 * mean, false) AS uniform, coalesce(items > 0.3 * len(l), false) AS lists_overused FROM m""")
def style(spark, sf_dir):
    """A42 (own definition)"""
    rows = _t(spark, sf_dir, "documents").where("text is not null").select("doc_id", text.style(F.col("text")).alias("s")).select("doc_id", "s.*")
    return _rounded(rows, "mean_words", "sd_words", "dashes", "list_share")


@query("""SELECT conv_id, turn, CASE role WHEN 'user' THEN text WHEN 'system' THEN 'None' ELSE '' END AS input, CASE role WHEN 'assistant' THEN text ELSE '' END AS output,
    CASE WHEN turn % 2 = 0 THEN conv_id || '-' || turn ELSE 'none' END AS id FROM conversations""")
def records_by_alias(spark, sf_dir):
    """Each turn as a record that names its fields in one of several ways"""
    role, name = F.col("role"), F.concat_ws("-", "conv_id", "turn")
    text = lambda r: F.when(role == r, F.col("text"))
    fields = F.map_filter(F.create_map(F.lit("question"), text("user"), F.lit("completion"), text("assistant"), F.lit("sample_id"), F.when(F.col("turn") % 2 == 0, name)), lambda k, v: v.isNotNull())
    fields = F.when(role == "system", F.map_concat(fields, F.create_map(F.lit("task"), F.lit(None).cast("string")))).otherwise(fields)
    record = F.parse_json(F.to_json(fields, {"ignoreNullFields": "false"}))
    rows = _t(spark, sf_dir, "conversations").select("conv_id", "turn", record.alias("record"))
    read = lambda names, default="": records.first_present(F.col("record"), names, default)
    return rows.select("conv_id", "turn", read(records.INPUT).alias("input"), read(records.OUTPUT).alias("output"), read(records.ID, "none").alias("id"))


@query("""SELECT doc_id, CAST(quality AS DOUBLE) AS quality, CASE toxic WHEN 1 THEN 1.0 WHEN 0 THEN 0.0 END AS toxic, CASE WHEN quality = 1 THEN 1.0 WHEN quality = 0 THEN 0.0 END AS word, CAST(doc_id AS DOUBLE) / 8 AS stated, CAST(NULL AS DOUBLE) AS odd FROM labels""")
def grades(spark, sf_dir):
    """P5"""
    rows = _t(spark, sf_dir, "labels")
    letter = F.when(F.col("toxic") == 1, "c").when(F.col("toxic") == 0, "i")
    word = F.when(F.col("quality") == 1, "Correct").when(F.col("quality") == 0, "FALSE")
    stated, odd = F.concat(F.lit(" "), (F.col("doc_id") / 8).cast("string")), F.concat(F.col("doc_id").cast("string"), F.lit("_0"))
    return rows.select("doc_id", records.grade(F.col("quality").cast("string")).alias("quality"), records.grade(letter).alias("toxic"), records.grade(word).alias("word"), records.grade(stated).alias("stated"), records.grade(odd).alias("odd"))


@query("SELECT conv_id, string_agg(text, ' ' ORDER BY turn) FILTER (role <> 'system') AS said FROM conversations GROUP BY conv_id HAVING count(*) FILTER (role <> 'system') > 0")
def content_parts(spark, sf_dir):
    """A conversation as one message of many parts, of which some are no text"""
    part = F.struct("turn", F.when(F.col("role") == "system", "image").otherwise("text").alias("type"), "text")
    rows = _t(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.parse_json(F.to_json(F.array_sort(F.collect_list(part)))).alias("content"))
    return rows.select("conv_id", records.content_text(F.col("content")).alias("said")).where("said <> ''")


@query("""SELECT doc_id, CASE WHEN lang = 'de' OR len(string_split(text, chr(10))) - 1 < 12 THEN 'allow' ELSE 'warn' END AS decision, CASE WHEN lang = 'de' OR len(string_split(text, chr(10))) - 1 < 12 THEN 'allow' ELSE 'block' END AS strict FROM documents""")
def read_sizes(spark, sf_dir):
    """P17"""
    n, limit = F.size(F.split("text", "\n", -1)) - 1, F.when(F.col("lang") == "de", F.col("n_chars"))
    ask = lambda strict: rules.read_size(F.lit("Read"), n, limit, 12, strict)
    return _t(spark, sf_dir, "documents").select("doc_id", ask(False).alias("decision"), ask(True).alias("strict"))


@query(r"""WITH p AS (SELECT page_id, CASE WHEN page_id % 3 = 0 THEN '20260101_000000_UTC_' ELSE '' END || regexp_extract(url, '([^/]*)/*$', 1) AS name, regexp_extract(url, '^(https?://[^/]*)', 1) AS host FROM pages),
    q AS (SELECT *, host || '/' || name AS path FROM p)
    SELECT page_id, CASE WHEN starts_with(path, 'http://') THEN 'error' WHEN NOT regexp_matches(regexp_extract(path, '([^/]*)/*$', 1), '^[0-9]{8}_[0-9]{6}_UTC') THEN 'warn_name' WHEN host NOT LIKE '%.com' THEN 'warn_place' ELSE 'allow' END AS plan,
    CASE WHEN starts_with(path, 'http://') THEN 'error' ELSE 'allow' END AS task, CASE WHEN host LIKE '%.com' THEN 'allow' ELSE 'warn' END AS folder FROM q""")
def locations(spark, sf_dir):
    """Pages as files below their hosts"""
    host = F.regexp_extract("url", r"^(https?://[^/]*)", 1)
    name = F.concat(F.when(F.col("page_id") % 3 == 0, "20260101_000000_UTC_").otherwise(""), F.regexp_extract("url", r"([^/]*)/*$", 1))
    path, home = F.concat(host, F.lit("/"), name), F.when(F.endswith(host, F.lit(".com")), host).otherwise(F.lit("https://elsewhere"))
    return _t(spark, sf_dir, "pages").select("page_id", rules.plan_location(path, "http://", home).alias("plan"), rules.task_location(path, "http://").alias("task"), rules.folder_check(host, home).alias("folder"))


@query(r"""WITH p AS (SELECT page_id, regexp_extract(url, '([^/]*)/*$', 1) AS name, regexp_extract(url, '([^/]+)/+[^/]+/*$', 1) AS folder FROM pages WHERE url IS NOT NULL)
    SELECT page_id, CASE WHEN page_id % 4 < 2 OR name = '' THEN NULL WHEN folder <> '' THEN 'Glob("**/' || folder || '/' || name || '") first, then Glob("**/' || name || '") if no results' ELSE 'Glob("**/' || name || '") or fd -H "' || name || '"' END AS hint FROM p""")
def missing_file_hints(spark, sf_dir):
    """P20"""
    k = F.col("page_id") % 4
    tool, said = F.when(k == 0, "Edit").otherwise("Read"), F.when(k == 1, "1: fine").when(k == 2, "File does NOT EXIST.").otherwise("enoent")
    return _t(spark, sf_dir, "pages").where("url is not null").select("page_id", rules.missing_file_hint(tool, said, F.col("url")).alias("hint"))


@query("""SELECT event_id, CASE WHEN event_type = 'error' THEN NULL ELSE event_type END AS command, CASE WHEN event_type = 'error' THEN NULL ELSE CAST(json_extract(props, '$.k') AS BIGINT) END AS timeout, true AS run_in_background FROM events""")
def overridden_inputs(spark, sf_dir):
    """P28"""
    fields = F.struct(F.col("event_type").alias("command"), F.get_json_object("props", "$.k").cast("bigint").alias("timeout"), F.lit(None).cast("boolean").alias("run_in_background"))
    given = F.when(F.col("event_type") != "error", fields)
    made = rules.with_override(given, "command string, timeout bigint, run_in_background boolean", run_in_background=F.lit(True))
    return _t(spark, sf_dir, "events").select("event_id", made.alias("i")).select("event_id", "i.*")


@query("""WITH c AS (SELECT c_custkey AS spec, c_name AS h, CASE WHEN c_custkey % 4 = 0 THEN ' ' ELSE c_mktsegment END AS o, CASE WHEN c_acctbal >= 0 THEN 'x' END AS m, CASE WHEN c_nationkey % 5 = 0 THEN '' ELSE 'y' END AS r FROM customer)
    SELECT spec, CAST(7 + (CASE WHEN trim(o) <> '' THEN 1 ELSE 0 END) + (CASE WHEN m IS NOT NULL THEN 1 ELSE 0 END) AS INT) AS passed, CASE WHEN r = '' THEN 'random_seeds' ELSE '' END AS warnings,
    array_to_string(list_filter([CASE WHEN trim(o) = '' THEN 'output_path' END, CASE WHEN m IS NULL THEN 'metrics' END], lambda x: x IS NOT NULL), ',') AS missing, CASE WHEN trim(o) <> '' AND m IS NOT NULL THEN 'PASS' ELSE 'STOP' END AS verdict FROM c""")
def specifications(spark, sf_dir):
    """P34"""
    from tracemill.sources.records import validated

    full = {n: F.col("c_name") for n in ("hyperparameters", "hypothesis", "datasets", "graphs", "caching", "concurrency", "error_handling", "resources", "baseline")}
    part = {"output_path": F.when(F.col("c_custkey") % 4 == 0, " ").otherwise(F.col("c_mktsegment")), "metrics": F.when(F.col("c_acctbal") >= 0, "x"), "random_seeds": F.when(F.col("c_nationkey") % 5 == 0, "").otherwise("y")}
    specs = _t(spark, sf_dir, "customer").select(F.col("c_custkey").alias("spec"), *[c.alias(n) for n, c in (full | part).items()])
    return validated(specs, "spec").select("spec", "passed", F.array_join("warnings", ",").alias("warnings"), F.array_join("missing", ",").alias("missing"), "verdict")


@query("""WITH o AS (SELECT o_custkey, max(o_orderdate) AS last, count(*) AS n FROM orders GROUP BY 1), c AS (SELECT c_custkey, n IS NOT NULL AS code, c_acctbal > 0 AS docs, coalesce(n > 8, false) AS active, coalesce(date_diff('day', last, TIMESTAMP '2001-08-01'), 0) AS days, c_nationkey % 4 = 0 AS stale FROM customer LEFT JOIN o ON o_custkey = c_custkey)
    SELECT c_custkey, CASE WHEN code AND NOT docs THEN 'MISSING' WHEN active AND days > 14 THEN 'ABANDONED' WHEN stale THEN 'STALE' ELSE 'OK' END AS state FROM c""")
def doc_states(spark, sf_dir):
    """P35"""
    last = _t(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max("o_orderdate").alias("last"), F.count("*").alias("n"))
    rows = _t(spark, sf_dir, "customer").join(last, "c_custkey", "left")
    days = F.coalesce(F.date_diff(F.lit("2001-08-01").cast("date"), F.col("last").cast("date")), F.lit(0))
    state = rules.doc_state(F.col("n").isNotNull(), F.col("c_acctbal") > 0, F.coalesce(F.col("n") > 8, F.lit(False)), days, F.col("c_nationkey") % 4 == 0)
    return rows.select("c_custkey", state.alias("state"))


@query("SELECT event_id, user_id FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 5 DAY AND event_type = 'view'")
def recent_sessions(spark, sf_dir):
    """P37"""
    events = _t(spark, sf_dir, "events")
    now = F.lit(events.agg(F.max("ts")).first()[0])
    return journal.since(events, "ts", now, 5, "view", "event_type").select("event_id", "user_id")


@query("""WITH t AS (SELECT doc_id, length(text) AS chars, array_to_string(list_transform(string_split(text, chr(10)), lambda x: CASE WHEN length(x) > 500 THEN substr(x, 1, 200) || ' ... [' || length(x) || ' chars] ... ' || right(x, 100) ELSE x END), chr(10)) AS cut, length(source) * 400 AS errors FROM documents)
    SELECT doc_id, CASE WHEN doc_id % 5 = 0 OR chars + errors < 5000 THEN 'none' WHEN length(cut) <= 9000 THEN 'truncate' WHEN floor(errors * 100 / (chars + errors)) >= 40 THEN 'truncate' ELSE 'aside' END AS route FROM t""")
def output_routes(spark, sf_dir):
    """Texts as what a command printed"""
    tool, errors = F.when(F.col("doc_id") % 5 == 0, "Read").otherwise("Bash"), F.repeat(F.col("source"), F.lit(400))
    cut = F.length(F.array_join(F.transform(text.lines(F.col("text")), lambda x: text.truncate_line(x)), "\n"))
    route = rules.output_route(tool, F.col("text"), errors, cut, 5000, 9000, "aside", 40)
    return _t(spark, sf_dir, "documents").select("doc_id", route.alias("route"))


@query("""SELECT doc_id, CASE WHEN contains(t, 'restructure') OR contains(t, 'move to') THEN 'complex' WHEN contains(t, 'rewrite') OR contains(t, 'clarify') THEN 'medium' WHEN contains(t, 'typo') OR contains(t, 'nit') THEN 'simple' END AS edit FROM (SELECT doc_id, lower(text) AS t FROM documents)""")
def edit_complexities(spark, sf_dir):
    """P41"""
    return _t(spark, sf_dir, "documents").select("doc_id", rules.edit_complexity(F.col("text")).alias("edit"))


@query("SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity * 12 > 500 OR l_discount * 12 > 1 THEN 'async' ELSE 'sync' END AS route FROM lineitem")
def review_routes(spark, sf_dir):
    """P45"""
    return _t(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", rules.review_route(F.col("l_quantity") * 12, F.col("l_discount") * 12).alias("route"))


@query("""WITH l AS (SELECT ts, event_type AS cmd, user_id AS cwd, CASE WHEN event_id % 2 = 1 THEN event_id % 3 END AS exit FROM events),
    w AS (SELECT *, lead(ts) OVER o AS e, lead(exit) OVER o AS x FROM l WINDOW o AS (PARTITION BY cmd, cwd ORDER BY ts, exit IS NOT NULL))
    SELECT ts, cmd, cwd, CASE WHEN x IS NOT NULL THEN e END AS end_ts, x AS end_exit FROM w WHERE exit IS NULL""")
def phase_pairs(spark, sf_dir):
    """Events as STARTs and ENDs of commands"""
    log = _t(spark, sf_dir, "events").select("ts", F.col("event_type").alias("cmd"), F.col("user_id").alias("cwd"), F.when(F.col("event_id") % 2 == 1, F.col("event_id") % 3).alias("exit"))
    return journal.phase_pairs(log)


@query("""SELECT conv_id, CAST(turn AS INT) AS num, role = 'assistant' AS done, length(text) AS chars FROM conversations""")
def review_threads(spark, sf_dir):
    """Conversations as review files, a thread for each turn"""
    from tracemill.sources.records import review_threads as threads

    head = F.concat(F.lit("## Thread "), F.col("turn").cast("string"), F.lit(" c"), F.col("conv_id").cast("string"), F.when(F.col("role") == "assistant", " ✅").otherwise(""))
    part = F.concat(head, F.lit("\n"), F.regexp_replace("text", r"(?m)^## Thread ", "Thread "))
    files = _t(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", part.alias("part")))).alias("parts"))
    out = threads(files.select(F.concat(F.lit("# review\n"), F.array_join(F.col("parts.part"), "\n")).alias("value")))
    own = F.regexp_extract("content", r"^\d+ c(\d+)", 1).cast("bigint")
    return out.select(own.alias("conv_id"), "num", "done", F.length(F.regexp_extract("content", r"(?s)^[^\n]*\n(.*?)\n?$", 1)).alias("chars"))


@query("""SELECT CAST(ts AS DATE) AS date, event_type AS tag, 'value ' || event_id AS description, CASE WHEN user_id % 2 = 0 THEN 'u' || user_id END AS source, user_id % 3 = 0 AS revised FROM events""")
def journal_entries(spark, sf_dir):
    """Events as lines of a journal"""
    from tracemill.sources.records import journal_entries as entries

    line = F.concat(F.lit("- "), F.col("ts").cast("date").cast("string"), F.when(F.col("user_id") % 3 == 0, ": [REVISED] [").otherwise(": ["), "event_type", F.lit("] value "), F.col("event_id").cast("string"), F.when(F.col("user_id") % 2 == 0, F.concat(F.lit(" (source: u"), F.col("user_id").cast("string"), F.lit(")"))).otherwise(""))
    files = _t(spark, sf_dir, "events").select(F.concat(F.lit("# journal\n"), line, F.lit("\nno entry")).alias("value"))
    return entries(files)


@query("""WITH s AS (SELECT CASE confidence WHEN 95 THEN 'high' WHEN 88 THEN 'high' ELSE 'medium' END AS part, times FROM (SELECT [95, 75, 88][k] AS confidence, len(string_split(line, ['password=', 'All rights reserved', 'License'][k])) - 1 AS times FROM
    (SELECT line, CASE WHEN contains(line, 'password=') THEN 1 WHEN contains(line, 'All rights reserved') THEN 2 WHEN contains(line, 'License') THEN 3 END AS k FROM (SELECT unnest(string_split(text, chr(10))) AS line FROM documents)) WHERE k IS NOT NULL))
    SELECT part, count(*) AS lines, CAST(sum(times) AS BIGINT) AS times FROM s GROUP BY 1""")
def phrase_report(spark, sf_dir):
    """The report's parts"""
    found = lines.phrase_lint(_t(spark, sf_dir, "documents"), PHRASES)
    return found.groupBy(rules.report_part(F.col("confidence")).alias("part")).agg(F.count("*").alias("lines"), F.sum("times").cast("bigint").alias("times"))


_T_BY_TYPE = f"""c AS (SELECT event_type, count(*) AS n, corr(value, user_id) AS r FROM events GROUP BY 1), t AS (SELECT *, CAST(n - 2 AS DOUBLE) AS df, r * sqrt((n - 2) / (1 - r * r)) AS t FROM c),
    p AS (SELECT event_type, {_t_p('t', 'df')} AS p FROM t)"""


@query(f"""WITH {_T_BY_TYPE}, k AS (SELECT *, count(*) OVER () AS n, row_number() OVER (ORDER BY p) AS r FROM p)
    SELECT event_type, round(p, 9) AS p, round(least(1.0, p * n), 9) AS bonferroni, round(least(1.0, min(p * n / r) OVER (ORDER BY r ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)), 9) AS fdr FROM k""")
def adjusted_p(spark, sf_dir):
    """P-values of several tests, corrected (own definition)"""
    tests = stats.correlation_test(_t(spark, sf_dir, "events"), ["event_type"], "value", "user_id").select("event_type", "p")
    return _rounded(stats.adjusted(tests), "p", "bonferroni", "fdr", digits=9)


@query(ORACLE_SQL["stratified_sample"].replace("SELECT id, label, stratum FROM p UNION ALL SELECT id, label, 'random' FROM o, k WHERE", ", x AS (SELECT stratum FROM p UNION ALL SELECT 'random' FROM o, k WHERE") + """)
    SELECT (SELECT total FROM c) AS total_samples, (SELECT np FROM c) AS passed, (SELECT nf FROM c) AS failed, (SELECT total - np - nf FROM c) AS unscored, (SELECT count(*) FROM x) AS samples_extracted,
    count(*) FILTER (stratum = 'failures') AS failures, count(*) FILTER (stratum = 'successes') AS successes, count(*) FILTER (stratum = 'random') AS random FROM x""")
def extraction_summary(spark, sf_dir):
    """A12"""
    samples = _samples(spark, sf_dir)
    row = checks.summary(samples, "documents", "table", sampling.stratified_sample(samples))
    part = lambda c, k: F.coalesce(F.try_element_at(c, F.lit(k)), F.lit(0).cast("bigint"))
    each = {"passed": ("score_distribution", "pass"), "failed": ("score_distribution", "fail"), "unscored": ("score_distribution", "error")} | {k: ("extraction_breakdown", k) for k in ("failures", "successes", "random")}
    return row.select("total_samples", "samples_extracted", *[part(F.col(c), k).alias(n) for n, (c, k) in each.items()])


@query("""SELECT conv_id, CASE WHEN conv_id % 2 = 0 THEN '✅ talk ' || conv_id ELSE 'talk ' || conv_id END AS title, conv_id % 2 = 0 AS done,
    substr(coalesce(string_agg(substr(text, 1, 1500), chr(10) ORDER BY turn) FILTER (role = 'user'), ''), 1, 1500) AS context FROM conversations GROUP BY conv_id""")
def session_titles(spark, sf_dir):
    """Conversations as session files, titled twice"""
    from tracemill.sources.records import session_titles as titles

    turns = _t(spark, sf_dir, "conversations")
    line = F.to_json(F.struct(F.col("role").alias("type"), F.struct(F.col("text").alias("content")).alias("message")))
    said = turns.select("conv_id", F.col("turn").alias("idx"), line.alias("line"))
    name = F.concat(F.when(F.col("conv_id") % 2 == 0, "✅ ").otherwise(""), F.lit("talk "), F.col("conv_id").cast("string"))
    named = lambda at, c: F.to_json(F.struct(F.lit("custom-title").alias("type"), c.alias("customTitle")))
    ids = turns.select("conv_id").distinct()
    early, late = ids.select("conv_id", F.lit(-1).cast("bigint").alias("idx"), named(0, F.lit("untitled")).alias("line")), ids.select("conv_id", F.lit(10**6).cast("bigint").alias("idx"), named(1, name).alias("line"))
    return titles(said.unionByName(early).unionByName(late), "conv_id").select("conv_id", "title", "done", "context")


@query("""SELECT event_id, CASE WHEN event_type = 'view' THEN '' ELSE event_type END AS tool, 'run ' || user_id AS command, CAST(json_extract(props, '$.k') AS BIGINT) AS timeout, user_id % 2 = 0 AS background,
    CASE WHEN event_type = 'error' THEN 'failed' WHEN event_id % 2 = 0 THEN 'said ' || event_id ELSE '' END AS response, CAST(CASE WHEN event_type = 'error' OR event_id % 2 = 1 THEN event_id % 3 END AS VARCHAR) AS exit_code FROM events""")
def tool_events(spark, sf_dir):
    """Events as JSON lines of tool use, with responses that are texts or objects"""
    from tracemill.sources.records import events as read

    e = _t(spark, sf_dir, "events")
    kind, code = F.col("event_type"), (F.col("event_id") % 3)
    given = F.struct(F.concat(F.lit("run "), F.col("user_id").cast("string")).alias("command"), F.get_json_object("props", "$.k").cast("bigint").alias("timeout"), (F.col("user_id") % 2 == 0).alias("run_in_background"), F.col("event_id").cast("string").alias("file_path"))
    full = F.to_json(F.struct(F.when(kind != "view", kind).alias("tool_name"), given.alias("tool_input"), F.struct(F.when(kind == "error", "failed").alias("error"), code.alias("exit_code")).alias("tool_response")))
    said = F.to_json(F.struct(F.when(kind != "view", kind).alias("tool_name"), given.alias("tool_input"), F.concat(F.lit("said "), F.col("event_id").cast("string")).alias("tool_response")))
    rows = read(e.select(F.when((kind == "error") | (F.col("event_id") % 2 == 1), full).otherwise(said).alias("value")))
    return rows.select(F.col("file_path").cast("bigint").alias("event_id"), "tool", "command", "timeout", "background", "response", "exit_code")
