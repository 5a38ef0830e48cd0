"""Column functions over variant records of unknown shape."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Names that a field goes by, in order of preference.
INPUT = ("input", "prompt", "question", "task")
OUTPUT = ("output", "response", "answer", "completion")
ID = ("id", "sample_id")

# Grades that stand for 1 and for 0.
RIGHT = ("C", "CORRECT", "PASS", "TRUE", "1")
WRONG = ("I", "INCORRECT", "FAIL", "FALSE", "0")

NUMBER = r"^\s*[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?\s*$|^\s*[+-]?(?i:nan|inf|infinity)\s*$"


def is_object(record: Column) -> Column:
    return F.startswith(F.schema_of_variant(record), F.lit("OBJECT"))


def is_array(record: Column) -> Column:
    return F.startswith(F.schema_of_variant(record), F.lit("ARRAY"))


def path(dotted: str) -> str:
    """A dotted name as a variant path; each part is an object's key."""
    return "$" + "".join("['" + p.replace("'", "\\'") + "']" for p in dotted.split("."))


def text_at(record: Column, dotted: str) -> Column:
    return F.try_variant_get(record, path(dotted), "string")


def keys(record: Column) -> Column:
    return F.coalesce(F.json_object_keys(F.to_json(record)), F.array().cast("array<string>"))


def first_present(record: Column, names: Sequence[str], default: str | None = "") -> Column:
    """The text of the first name that the record has. A name that is there with null wins, as the text `None`."""
    held = keys(record)
    out = F.lit(default)
    for name in reversed(names):
        out = F.when(F.array_contains(held, name), F.coalesce(text_at(record, name), F.lit("None"))).otherwise(out)
    return out


def number(text: Column) -> Column:
    """A number that a text states; null for anything else (underscores and suffixes as well)."""
    return F.when(text.rlike(NUMBER), F.regexp_replace(F.trim(text), r"(?i)^\+?(-?)inf$", "$1Infinity").try_cast("double"))


def score_at(record: Column, dotted: str) -> Column:
    """The score at a dotted name: a number, a boolean or a text that states a number; null for anything else."""
    kind = F.schema_of_variant(F.try_variant_get(record, path(dotted), "variant"))
    direct = F.try_variant_get(record, path(dotted), "double")
    return F.when(kind == "STRING", number(text_at(record, dotted))).when(kind.rlike("^(OBJECT|ARRAY)"), F.lit(None)).otherwise(direct)


def score_label(score: Column, threshold: float = 0.5) -> Column:
    """error without a score; pass from the threshold on; else fail (as NaN is)."""
    return F.when(score.isNull(), "error").when(~F.isnan(score) & (score >= threshold), "pass").otherwise("fail")


def grade(value: Column) -> Column:
    """1 or 0 for a letter or word grade, else the number that it states."""
    top = F.upper(value)
    return F.when(top.isin(*RIGHT), 1.0).when(top.isin(*WRONG), 0.0).otherwise(number(value))


MESSAGES = "array<struct<role:string,content:string>>"


def messages(record: Column) -> Column:
    """The record's messages, else a user and an assistant turn made of its input and output. Elements that are no
    objects are left out; a role that is missing is `unknown`."""
    items = F.try_variant_get(record, "$.messages", "array<variant>")
    given = F.transform(
        F.filter(items, is_object),
        lambda m: F.struct(first_present(m, ["role"], "unknown").alias("role"), first_present(m, ["content"]).alias("content")),
    )
    made = F.filter(
        F.array(
            F.struct(F.lit("user").alias("role"), first_present(record, INPUT, None).alias("content")),
            F.struct(F.lit("assistant").alias("role"), first_present(record, OUTPUT, None).alias("content")),
        ),
        lambda m: m["content"].isNotNull(),
    )
    return F.coalesce(given, made).cast(MESSAGES)


def content_text(content: Column) -> Column:
    """Text of a message's content: a text as it is; of a list of parts the text parts, joined by spaces."""
    parts = F.try_variant_get(content, "$", "array<variant>")
    texts = F.transform(F.filter(parts, lambda p: text_at(p, "type") == "text"), lambda p: text_at(p, "text"))
    return F.when(F.schema_of_variant(content) == "STRING", F.try_variant_get(content, "$", "string")).otherwise(F.array_join(texts, " "))


def first_user(turns: Column) -> Column:
    return F.try_element_at(F.filter(turns, lambda m: m["role"] == "user"), F.lit(1))["content"]


def last_assistant(turns: Column) -> Column:
    return F.try_element_at(F.filter(turns, lambda m: m["role"] == "assistant"), F.lit(-1))["content"]
