"""Column functions over text. Lengths and cuts count code points, as the logs' own tools do."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# What marks a line as holding a credential, and how long an encoded run is too long to keep.
SECRET_MARKS = r"(KEY=|SECRET=|PASSWORD=|TOKEN=|Authorization:|Bearer |token=|api_key=)"
ENCODED_RUN = r"[A-Za-z0-9+/=]{100,}"
# What stands where something was cut, outputs that must match.
CHARS_CUT = (" ... [", " chars] ... ")
LINES_CUT = ("... [", " chars, ", " lines truncated] ...")
STDERR_CUT = "... [stderr truncated] ...\n\n"


def strip(text: Column) -> Column:
    """Without white space of any kind at either end (trim knows spaces only), Unicode's blanks included."""
    return F.regexp_replace(text, r"^[\p{IsWhite_Space}\x1c-\x1f]+|[\p{IsWhite_Space}\x1c-\x1f]+$", "")


def contains_any(text: Column, marks: Sequence[str]) -> Column:
    """Whether the lower-cased text holds one of the (lower-case) marks. The text is lower-cased once, not for each mark."""
    return F.exists(F.array(F.lower(text)), lambda low: reduce(lambda x, y: x | y, [F.contains(low, F.lit(m)) for m in marks], F.lit(False)))


def lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def truncate_line(line: Column, limit: int = 500, head: int = 200, tail: int = 100) -> Column:
    """A longer line becomes its head, a marker with its length, and its tail."""
    marked = F.concat(F.substring(line, 1, head), F.lit(CHARS_CUT[0]), F.length(line).cast("string"), F.lit(CHARS_CUT[1]), F.right(line, F.lit(tail)))
    return F.when(F.length(line) > limit, marked).otherwise(line)


def truncate_stdout(text: Column, limit: int = 500, chars: int = 1500, most: int = 45, head: int = 15, tail: int = 30) -> Column:
    """Lines cut one by one; of more than `most` lines in over `chars` characters only the first and the last stay."""
    each = F.transform(lines(text), lambda x: truncate_line(x, limit))
    n = F.size(lines(text))
    marker = F.concat(F.lit(LINES_CUT[0]), F.length(text).cast("string"), F.lit(LINES_CUT[1]), n.cast("string"), F.lit(LINES_CUT[2]))
    cut = F.concat(F.slice(each, 1, head), F.array(F.lit(""), marker, F.lit("")), F.slice(each, F.greatest(n - (tail - 1), F.lit(1)), F.lit(tail)))
    return F.array_join(F.when((F.length(text) > chars) & (n > most), cut).otherwise(each), "\n")


def truncate_stderr(text: Column, limit: int = 500, chars: int = 500, tail: int = 20) -> Column:
    """Lines cut one by one; of more than `chars` characters only the last lines stay, under a marker."""
    n = F.size(lines(text))
    cut = lambda x: F.array_join(F.transform(x, lambda y: truncate_line(y, limit)), "\n")
    last = F.slice(lines(text), F.greatest(n - (tail - 1), F.lit(1)), F.lit(tail))
    return F.when(F.length(text) > chars, F.concat(F.lit(STDERR_CUT), cut(last))).otherwise(cut(lines(text)))


def redact_lines(text: Column, marks: str = SECRET_MARKS, encoded: str | None = ENCODED_RUN) -> Column:
    """Without the lines that hold a mark or a long encoded run."""
    pattern = f"{marks}|{encoded}" if encoded else marks
    return F.array_join(F.filter(lines(text), lambda x: ~x.rlike(pattern)), "\n")


def base_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)/*$", 1)


def dir_name(path: Column) -> Column:
    """The name of the folder that a path is in; empty at the top."""
    return F.regexp_extract(path, r"([^/]+)/+[^/]+/*$", 1)


def session_title(name: Column, limit: int = 60) -> Column:
    """A title without quotes and control characters, cut to the limit."""
    return F.substring(F.regexp_replace(name, r'["\x00-\x1f]', ""), 1, limit)


def word_count(text: Column) -> Column:
    return F.size(F.filter(F.split(text, r"\s+"), lambda w: w != ""))


def run_on_sentences(text: Column, most: int = 40) -> Column:
    """The number of sentences (cut at . ! ?) with more than `most` words."""
    return F.size(F.filter(F.split(text, r"[.!?]+"), lambda s: word_count(s) > most))


def dash_asides(text: Column) -> Column:
    """How often a long dash, or a hyphen between spaces, occurs."""
    return F.size(F.split(text, "—| - ", -1)) - 1


def sentence_lengths(text: Column) -> Column:
    """Words of each sentence (cut at . ! ?) that has any."""
    return F.filter(F.transform(F.split(text, r"[.!?]+"), word_count), lambda n: n > 0)


def spread(values: Column) -> Column:
    """n, mean and sd (of a sample; null below two) of an array of numbers, in one pass (Welford's update)."""
    start = F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(0.0).alias("mean"), F.lit(0.0).alias("m2"))

    def add(s: Column, x: Column) -> Column:
        mean = s["mean"] + (x - s["mean"]) / (s["n"] + 1)
        return F.struct((s["n"] + 1).alias("n"), mean.alias("mean"), (s["m2"] + (x - s["mean"]) * (x - mean)).alias("m2"))

    done = lambda s: F.struct(s["n"].alias("n"), F.when(s["n"] > 0, s["mean"]).alias("mean"), F.when(s["n"] > 1, F.sqrt(s["m2"] / F.nullif(s["n"] - 1, F.lit(0)))).alias("sd"))
    return F.aggregate(values, start, add, done)


def style(text: Column, even: float = 0.3, listed: float = 0.3, least: int = 5) -> Column:
    """Measures of a text's style (our own definitions): sentences, their mean length and sd in words, dashes a 1000 words, the
    share of its non-empty lines that are list items, and whether sentences are uniform (sd under `even` of the mean, from `least`
    sentences on) or lists overused (over `listed` of the lines)."""
    held = F.filter(lines(text), lambda x: strip(x) != "")
    items = F.size(F.filter(held, lambda x: x.rlike(r"^\s*([-*+•]|[0-9]+[.)])\s")))
    s = spread(sentence_lengths(text))
    return F.struct(
        s["n"].alias("sentences"), s["mean"].alias("mean_words"), s["sd"].alias("sd_words"), (1000 * dash_asides(text) / F.nullif(word_count(text), F.lit(0))).alias("dashes"),
        (items / F.nullif(F.size(held), F.lit(0))).alias("list_share"), ((s["n"] >= least) & F.coalesce(s["sd"] < even * s["mean"], F.lit(False))).alias("uniform"),
        F.coalesce(items > listed * F.size(held), F.lit(False)).alias("lists_overused"),
    )
