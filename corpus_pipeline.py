"""A corpus pipeline of five stages from tracemill.llm: toxicity, near-duplicates, benchmark decontamination, personal data,
packing. Four are operators of it as they are; near-duplicates are linked by fingerprints and pigeonring, then an exact check of
shingle sets, and an exact search for what fingerprints can't find at a similarity of 0.8 (simhash.near_copies). A stage takes (spark, docs, sf_dir) and works on
all that its predecessor kept; run() writes each stage's result as Parquet to the shared folder, reads it for the next, and
removes all but the last when it is done.

Rows with null or repeated ids are kept apart by their text. Empty tables pass through, and extra columns with any name
come out of the first four stages as they went in."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracemill.llm import decontam, packing, pii, simhash, toxicity
from tracemill.llm.base import identity, scratch, small, table, written
from tracemill.llm.queries import vocabulary


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a score below 0.5, by a model fitted to the labels of the documents that came in. A null or blank
    text has no word to reject it for and stays; repeated rows are judged alike; with no labels all stay."""
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    score = toxicity.toxicity(model, spark)(F.col("text"))
    read = docs.select(F.struct("*").alias("row"), score.alias("score"))
    return read.where("score < 0.5 or row.text is null or trim(row.text) = ''").select("row.*")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (texts linked by a Jaccard similarity of 0.8 or more of their five-word
    shingles; found by SimHash with pigeonring, checked exactly, and completed by an exact search): the one with the smallest id (null ids last; null texts are one group). Rows are told apart by id and text;
    of rows that repeat both, one stays. Texts meet the list of what goes in an anti-join, which is broadcast up to base.SMALL rows."""
    mark = identity(F.col("doc_id"), F.col("text"))
    keyed = docs.select(F.struct(F.col("doc_id").isNull().alias("nameless"), F.col("doc_id").alias("id"), mark.alias("mark")).alias("key"), "text")
    marked = simhash.near_copies(keyed, "key").select(F.col("doc_id.mark").alias("mark"), (F.col("doc_id") == F.col("component_id")).alias("stays"))
    counts = written(marked.groupBy("mark").agg(F.max("stays").alias("stays"), F.count("*").alias("n")))
    gone = small(written(counts.where("not stays").select("mark")))
    repeated = small(written(counts.where("stays and n > 1").select("mark")))
    rows = docs.select(F.struct("*").alias("row"), mark.alias("mark")).join(gone, "mark", "left_anti")
    once = rows.join(repeated, "mark", "left_anti")
    again = rows.join(repeated, "mark", "left_semi").dropDuplicates(["mark"])
    return once.unionByName(again).select("row.*")


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item (0.8 or more of its five-word shingles). Null and short texts hold none and
    stay; of repeated rows all stay or all go."""
    return decontam.clean(docs, table(spark, sf_dir, "benchmark"))


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data replaced in text, and n_chars (if there is such a column) counted anew. A null
    text stays null, with null n_chars; repeated rows are treated alike."""
    text = docs.withColumn("text", pii.redaction()(F.col("text")))
    if "n_chars" in docs.columns:
        text = text.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return text.select(docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, packed into sequences of 1024 tokens: a row for each piece. A null text is its end token alone."""
    return packing.packed(docs, vocabulary())


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", decontaminate),
    ("pii", redact),
    ("packing", pack),
]

#: SQL cannot express the fitted classifier, the fingerprints or the tokenizer; the tests use brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    with scratch(spark) as keep:
        for _, stage in STAGES:
            docs = written(stage(spark, docs, sf_dir))
        return keep(docs)
