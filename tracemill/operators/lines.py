"""Operators over the lines of texts: search with context, phrase lint, counts by file."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracemill.functions.text import lines, truncate_line, word_count
from tracemill.operators.rules import confidence_tier
from tracemill.operators.segments import PART, Segments
from tracemill.shared import stored

# The phrase lexicon. category key, severity, phrase to look for, confidence.
LEXICON = [
    ("blatant_hedging", "high", "It's worth noting that", 95),
    ("blatant_hedging", "high", "Interestingly,", 90),
    ("blatant_hedging", "high", "This is particularly important because", 92),
    ("blatant_hedging", "high", "As a matter of fact,", 94),
    ("blatant_hedging", "high", "In fact,", 85),
    ("chatbot_artifacts", "critical", "As a large language model", 99),
    ("chatbot_artifacts", "critical", "I hope this helps!", 98),
    ("chatbot_artifacts", "critical", "I don't have personal opinions", 99),
    ("ai_vocabulary", "medium", "leverage", 88),
    ("ai_vocabulary", "medium", "utilize", 89),
    ("ai_vocabulary", "medium", "facilitate", 87),
    ("false_enthusiasm", "medium", "Great question!", 91),
    ("false_enthusiasm", "medium", "Absolutely!", 86),
    ("filler_phrases", "low", "in order to", 92),
    ("filler_phrases", "low", "is able to", 93),
]
#: Lint weights by severity, for the score that is this library's own definition.
WEIGHTS = {"critical": 4.0, "high": 3.0, "medium": 2.0, "low": 1.0}


def lexicon(spark: SparkSession, rules: Sequence[tuple] = LEXICON) -> DataFrame:
    return spark.createDataFrame(list(rules), "category string, severity string, phrase string, confidence int")


def numbered(texts: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, line_no (from 1), line."""
    return texts.select(key, F.posexplode(lines(F.col(text))).alias("p", "line")).select(key, (F.col("p") + 1).alias("line_no"), "line")


def phrase_lint(texts: DataFrame, rules: Sequence[tuple] = LEXICON, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, line_no, phrase, category, severity, confidence, tier, count. A line reports the first phrase of the lexicon
    that is in it. The lexicon is a list of literals in the plan, so no join is needed and lines are never multiplied."""
    line = F.col("line")
    hits = [F.when(F.contains(line, F.lit(p)), F.struct(F.lit(p).alias("phrase"), F.lit(c).alias("category"), F.lit(s).alias("severity"), F.lit(n).alias("confidence"))) for c, s, p, n in rules]
    found = numbered(texts, key, text).withColumn("hit", F.coalesce(*hits)).where(F.col("hit").isNotNull())
    rows = found.select(key, "line_no", "hit.*", "line")
    count = F.lit(0)
    for _, _, p, _ in rules:
        count = F.when(F.col("phrase") == p, F.size(F.split(line, _quoted(p), -1)) - 1).otherwise(count)
    return rows.select(key, "line_no", "phrase", "category", "severity", "confidence", confidence_tier(F.col("confidence")).alias("tier"), count.alias("times"))


def _quoted(phrase: str) -> str:
    return "\\Q" + phrase.replace("\\E", "\\E\\\\E\\Q") + "\\E"


def lint_score(texts: DataFrame, rules: Sequence[tuple] = LEXICON, key: str = "doc_id", text: str = "text", scale: float = 100.0) -> DataFrame:
    """key, matches, words, score 0 to 100 and band: weighted confidences per word times `scale` (our own definition)."""
    weight = F.create_map(*[F.lit(x) for pair in WEIGHTS.items() for x in pair])
    hits = phrase_lint(texts, rules, key, text).groupBy(key).agg(F.sum("times").alias("matches"), F.sum(F.col("times") * F.col("confidence") / 100 * weight[F.col("severity")]).alias("weight"))
    rows = texts.select(key, word_count(F.coalesce(F.col(text), F.lit(""))).alias("words")).join(hits, key, "left")
    score = F.least(F.lit(100.0), F.coalesce(F.col("weight"), F.lit(0.0)) * scale / F.greatest("words", F.lit(1)))
    rows = rows.select(key, F.coalesce("matches", F.lit(0)).alias("matches"), "words", score.alias("score"))
    return rows.withColumn("band", F.when(F.col("score") < 10, "0-10").when(F.col("score") < 20, "10-20").when(F.col("score") < 40, "20-40").otherwise("40-100"))


def lexicon_check(rules: DataFrame, declared: DataFrame) -> DataFrame:
    """category, declared, found, ok. rules: a lexicon; declared: category, declared."""
    counts = rules.groupBy("category").agg(F.count("*").alias("found"))
    return declared.join(counts, "category", "full").select("category", "declared", F.coalesce("found", F.lit(0)).alias("found")).withColumn("ok", F.col("declared") == F.col("found"))


def line_matches(line: Column, pattern: str, case_sensitive: bool = False, literal: bool = False) -> Column:
    if literal:
        return F.contains(line, F.lit(pattern)) if case_sensitive else F.contains(F.lower(line), F.lit(pattern.lower()))
    return line.rlike(pattern if case_sensitive else f"(?i){pattern}")


def search(texts: DataFrame, pattern: str, context: int = 2, key: str = "doc_id", text: str = "text", **how: bool) -> DataFrame:
    """key, line_no, line, is_match for matching lines and those within `context` lines of one. Neighbours come from the
    text's own array of lines, so nothing is shuffled."""
    held = lines(F.col(text))
    rows = texts.select(key, held.alias("all"), F.transform(held, lambda x: line_matches(x, pattern, **how)).alias("hit")).where(F.exists("hit", lambda x: x))
    near = F.expr(f"filter(sequence(0, size(hit) - 1), i -> exists(slice(hit, greatest(i + 1 - {context}, 1), least(i, {context}) + 1 + {context}), x -> x))")
    picked = rows.select(key, F.explode(F.transform(near, lambda i: F.struct((i + 1).alias("line_no"), F.get("all", i).alias("line"), F.get("hit", i).alias("is_match")))).alias("r"))
    return picked.select(key, "r.*")


def matches_by_text(texts: DataFrame, pattern: str, key: str = "doc_id", text: str = "text", **how: bool) -> DataFrame:
    """key and the number of matching lines, where there are any."""
    n = F.size(F.filter(lines(F.col(text)), lambda x: line_matches(x, pattern, **how)))
    return texts.select(key, n.alias("n")).where(F.col("n") > 0)


def truncated(texts: DataFrame, limit: int = 500, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, text with long lines cut, and how many were."""
    held = lines(F.col(text))
    return texts.select(key, F.array_join(F.transform(held, lambda x: truncate_line(x, limit)), "\n").alias("text"), F.size(F.filter(held, lambda x: F.length(x) > limit)).alias("cut_lines"))


def duplicate_lines(texts: DataFrame, text: str = "text", least: int = 2) -> DataFrame:
    """line, n, of lines that occur `least` times or more."""
    return texts.select(F.explode(lines(F.col(text))).alias("line")).where("line <> ''").groupBy("line").agg(F.count("*").alias("n")).where(F.col("n") >= least)


def slide_count(texts: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, slides: parts between lines of three dashes."""
    return texts.select(key, F.size(F.filter(lines(F.col(text)), lambda x: x == "---")).alias("separators")).withColumn("slides", F.col("separators") + 1)


#: Imports within imports that are followed.
DEPTH = 32


def page_offsets(decks: DataFrame, root: str, deck: str = "deck", text: str = "text") -> DataFrame:
    """deck, place (positions of the imports that lead to it), first_page and last_page of every import below the deck `root`
    and of the root itself. A deck is parts between lines of three dashes; a part with a line `src: name` stands for the
    deck of that name, any other is one page. Imports are walked level by level, one join each; pages are numbered along the
    order of the positions, by ranges (see segments). An import of an unknown deck has no pages and is left out, as is one of a
    deck without pages; imports that run in a circle raise ValueError."""
    part = F.posexplode(F.split(F.concat(F.lit("\n"), F.coalesce(F.col(text), F.lit("")), F.lit("\n")), r"\n---(?=\n)", -1))
    parts = decks.select(F.col(deck).alias("owner"), part.alias("at", "part"))
    parts = parts.select("owner", "at", F.nullif(F.regexp_extract("part", r"(?m)^src:[ \t]*(\S+)", 1), F.lit("")).alias("src"))
    level = parts.where(F.col("owner") == root).select(F.array("at").alias("path"), F.array(F.col("owner")).alias("owners"), "src")
    pages, depth = level.where("src is null"), 0
    imports = stored(level.where("src is not null"))
    while imports.take(1):
        depth += 1
        if depth > DEPTH:
            raise ValueError(f"imports are nested more than {DEPTH} deep, or run in a circle")
        below = imports.join(parts.withColumnRenamed("src", "next"), F.col("src") == F.col("owner"))
        level = stored(below.select(F.concat("path", F.array("at")).alias("path"), F.concat("owners", F.array("owner")).alias("owners"), F.col("next").alias("src")))
        pages = pages.unionByName(level.where("src is null"))
        imports = level.where("src is not null")
    numbered = Segments(pages.select("path", "owners"), [], ["path"]).numbered("page")
    each = numbered.select("page", F.explode(F.transform("owners", lambda o, i: F.struct(o.alias("deck"), F.slice("path", F.lit(1), i).alias("place")))).alias("o"))
    return each.groupBy("o.deck", "o.place").agg(F.min("page").alias("first_page"), F.max("page").alias("last_page"))


def tail(rows: DataFrame, order: str, n: int = 50) -> DataFrame:
    """The last n rows, in order."""
    return rows.orderBy(F.desc(order)).limit(n).orderBy(order)


def sequence_of_words(text: Column) -> Column:
    return F.filter(F.split(text, r"\s+"), lambda w: w != "")


def moving_average(rows: DataFrame, by: Sequence[str], order: str, value: str, width: int) -> DataFrame:
    """rows with the mean of value over each row and the width - 1 before it. Where a key is cut into segments, a segment also
    reads the last width - 1 rows before it."""
    seg = Segments(rows, by, [order])
    frame = seg.window().rowsBetween(1 - width, 0)
    if not seg.cut:
        return seg.rows.withColumn("moving_average", F.avg(value).over(frame)).drop(PART)
    numbered = seg.numbered("_i").withColumn("_lent", F.lit(False))
    parts = numbered.where(F.col(PART) > 0).groupBy(*by, PART).agg(F.min("_i").alias("_first"), F.max("_i").alias("_last"))
    parts = F.broadcast(parts.select(*[F.col(c).alias(f"_k_{c}") for c in by], F.col(PART).alias("_later"), "_first", "_last"))
    same = lambda more: reduce(lambda x, y: x & y, [F.col(c).eqNullSafe(F.col(f"_k_{c}")) for c in by], more)
    ends = numbered.join(parts.drop("_first"), same(F.col(PART) == F.col("_later"))).where(F.col("_i") > F.col("_last") - (width - 1)).select(*numbered.columns)
    lent = ends.join(parts.drop("_last"), same((F.col(PART) < F.col("_later")) & (F.col("_i") > F.col("_first") - width)))
    lent = lent.withColumn(PART, F.col("_later")).withColumn("_lent", F.lit(True)).select(*numbered.columns)
    means = numbered.unionByName(lent).withColumn("moving_average", F.avg(value).over(frame))
    return means.where("not _lent").drop(PART, "_i", "_lent")
