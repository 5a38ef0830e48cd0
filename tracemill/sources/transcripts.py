"""Evaluation transcripts of unknown shape, read into one schema.

Formats: a line of JSON a record, one JSON document (a list, or an object that holds one), plain text cut at delimiter
lines, and folders of these. Ids number the records of a source in order: for JSON lines by physical line (so blank and
malformed lines leave gaps), for folders densely over all files."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tracemill.functions import records
from tracemill.functions.text import strip

COLUMNS = ["idx", "id", "input", "output", "score", "score_label", "messages", "metadata"]

# Lines that divide a text log, in order of preference.
DELIMITERS = (r"\n={3,}\n", r"\n-{3,}\n", r"\n\*{3,}\n", r"\n#{2,}\s")
WRAPPERS = ("samples", "results", "data")


def sample_id(idx: Column) -> Column:
    return F.format_string("sample_%04d", idx)


def normalised(found: DataFrame, score_field: str = "score", threshold: float = 0.5) -> DataFrame:
    """Samples of found (file, idx, record variant, source_format)."""
    r = F.col("record")
    rows = found.select("file", "idx", "source_format", records.first_present(r, records.INPUT).alias("input"), records.first_present(r, records.OUTPUT).alias("output"), records.score_at(r, score_field).alias("score"), records.messages(r).alias("messages"), records.first_present(r, records.ID).alias("original_id"))
    return _finished(rows, threshold)


def _finished(rows: DataFrame, threshold: float) -> DataFrame:
    return rows.select("file", "idx", sample_id(F.col("idx")).alias("id"), "input", "output", "score", records.score_label(F.col("score"), threshold).alias("score_label"), "messages", F.struct("source_format", "original_id").alias("metadata"))


def whole_files(spark: SparkSession, paths: str | list[str], glob: str | None = None) -> DataFrame:
    """file, value: each file's text as one value."""
    reader = spark.read.option("pathGlobFilter", glob) if glob else spark.read
    return reader.text(paths, wholetext=True).select(F.col("_metadata.file_path").alias("file"), "value")


#: Numbers of a file's lines that one task ranks.
STRETCH = 1_000_000


def lines_with_numbers(spark: SparkSession, paths: str | list[str], glob: str | None = None) -> DataFrame:
    """file, idx (physical line, from 0), line. Files of any size are read in splits: a line's number is its place in
    its split plus the number of lines in the file's splits before it, so only counts by split are gathered."""
    reader = spark.read.option("pathGlobFilter", glob) if glob else spark.read
    place = [F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start")]
    rows = reader.text(paths).select(*place, F.monotonically_increasing_id().alias("at"), F.col("value").alias("line"))
    splits = rows.groupBy("file", "start").agg(F.count("*").alias("n"), F.min("at").alias("first"))
    before = F.sum("n").over(Window.partitionBy("file").orderBy("start")) - F.col("n")
    splits = splits.select("file", "start", (before - F.col("first")).alias("shift"))
    return rows.join(splits, ["file", "start"]).select("file", (F.col("at") + F.col("shift")).cast("bigint").alias("idx"), "line")


def read_jsonl(spark: SparkSession, paths: str | list[str], score_field: str = "score", threshold: float = 0.5, glob: str | None = None) -> DataFrame:
    """Lines that are no JSON object are left out (count them with malformed())."""
    rows = lines_with_numbers(spark, paths, glob).withColumn("record", F.try_parse_json(strip(F.col("line"))))
    rows = rows.where(F.col("record").isNotNull()).where(records.is_object(F.col("record")))
    return normalised(rows.select("file", "idx", "record", F.lit("jsonl").alias("source_format")), score_field, threshold)


def malformed(spark: SparkSession, paths: str | list[str], glob: str | None = None) -> DataFrame:
    """file, idx, line of the lines with text that read_jsonl leaves out."""
    rows = lines_with_numbers(spark, paths, glob).where(strip(F.col("line")) != "").withColumn("record", F.try_parse_json(strip(F.col("line"))))
    return rows.where(F.col("record").isNull() | ~records.is_object(F.col("record"))).select("file", "idx", "line")


def malformed_documents(spark: SparkSession, paths: str | list[str], glob: str | None = None) -> DataFrame:
    """file, reason of the files that read_json gives no sample of, although they are not blank: no JSON, neither a list nor
    an object, a wrapper that holds null, or no object among the items."""
    files = whole_files(spark, paths, glob).where(strip(F.col("value")) != "").select("file", F.try_parse_json("value").alias("document"))
    found = read_json(spark, paths, glob=glob).select("file").distinct()
    kind = F.when(F.col("document").isNull(), "no JSON").when(records.is_array(F.col("document")) | records.is_object(F.col("document")), "no samples").otherwise("neither list nor object")
    return files.select("file", kind.alias("reason")).join(found, "file", "left_anti")


def read_json(spark: SparkSession, paths: str | list[str], score_field: str = "score", threshold: float = 0.5, glob: str | None = None) -> DataFrame:
    """One document a file: a list, or an object's samples, results or data (the object itself, if that is no list).
    An object without these has no samples. Items that are no objects are left out, but take a number; files that give no
    sample are listed by malformed_documents()."""
    files = whole_files(spark, paths, glob).select("file", F.try_parse_json("value").alias("document"))
    whole, held = F.col("document"), records.keys(F.col("document"))
    inner = F.lit(None).cast("variant")
    for name in reversed(WRAPPERS):
        inner = F.when(F.array_contains(held, name), F.coalesce(F.try_variant_get(whole, f"$.{name}", "variant"), F.parse_json(F.lit("null")))).otherwise(inner)
    files = files.where(whole.isNotNull()).select("file", whole, F.when(records.is_array(whole), whole).when(records.is_object(whole), inner).alias("inner"))
    files = files.where(F.col("inner").isNotNull())
    items = F.when(records.is_array(F.col("inner")), F.try_variant_get("inner", "$", "array<variant>")).otherwise(F.array("document"))
    rows = files.select("file", F.posexplode(items).alias("idx", "record")).where(records.is_object(F.col("record")))
    return normalised(rows.withColumn("source_format", F.lit("json")), score_field, threshold)


def text_chunks(text: Column) -> Column:
    """The stripped, non-empty parts of a text, cut at the first delimiter that occurs; else, or where all parts are
    blank, the stripped text itself."""
    whole = F.array(strip(text))
    cut = F.array(text)
    for d in reversed(DELIMITERS):
        parts = F.split(text, d, -1)
        cut = F.when(F.size(parts) > 1, parts).otherwise(cut)
    parts = F.filter(F.transform(cut, strip), lambda c: c != "")
    return F.when((F.size(parts) == 0) & (whole[0] != ""), whole).otherwise(parts)


def read_text(spark: SparkSession, paths: str | list[str], glob: str | None = None) -> DataFrame:
    """Chunks of text logs: samples without a score, whose only message is the chunk."""
    rows = whole_files(spark, paths, glob).select("file", F.posexplode(text_chunks(F.col("value"))).alias("idx", "output"))
    turn = F.array(F.struct(F.lit("assistant").alias("role"), F.col("output").alias("content"))).cast(records.MESSAGES)
    rows = rows.select("file", "idx", F.lit("text").alias("source_format"), F.lit("").alias("input"), "output", F.lit(None).cast("double").alias("score"), turn.alias("messages"), F.lit("").alias("original_id"))
    return _finished(rows, 0.5)


def read_folder(spark: SparkSession, path: str, score_field: str = "score", threshold: float = 0.5) -> DataFrame:
    """The .json, .jsonl and .log files of a folder (not of folders in it), numbered densely in path order. Numbers are
    a rank in each stretch of a file plus the counts of the stretches and files before, so no task sees a whole file."""
    found = [read_jsonl(spark, path, score_field, threshold, "*.jsonl"), read_json(spark, path, score_field, threshold, "*.json"), read_text(spark, path, "*.log")]
    rows = reduce(DataFrame.unionByName, found)
    counts = rows.groupBy("file").agg(F.count("*").alias("n"))
    before = counts.select("file", (F.sum("n").over(Window.orderBy("file")) - F.col("n")).alias("before"))
    rows = rows.withColumn("stretch", F.expr(f"idx div {STRETCH}"))
    stretches = rows.groupBy("file", "stretch").agg(F.count("*").alias("n"))
    earlier = stretches.select("file", "stretch", (F.sum("n").over(Window.partitionBy("file").orderBy("stretch")) - F.col("n")).alias("earlier"))
    rank = F.row_number().over(Window.partitionBy("file", "stretch").orderBy("idx")) - 1
    rows = rows.withColumn("rank", rank).join(earlier, ["file", "stretch"]).join(before, "file")
    rows = rows.withColumn("idx", (F.col("rank") + F.col("earlier") + F.col("before")).cast("bigint"))
    return rows.withColumn("id", sample_id(F.col("idx"))).select("file", *COLUMNS)


def detect_format(spark: SparkSession, path: str) -> str:
    """dir, inspect, jsonl, json or text: by kind and suffix, else by the first 4096 bytes."""
    space = spark.sparkContext._jvm.org.apache.hadoop.fs
    place = space.Path(path)
    system = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if system.exists(place) and system.getFileStatus(place).isDirectory():
        return "dir"
    for suffix, name in ((".eval", "inspect"), (".jsonl", "jsonl"), (".json", "json")):
        if path.lower().endswith(suffix):
            return name
    stream = system.open(place)
    try:
        start = bytes(spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toByteArray(stream, int(min(4096, system.getFileStatus(place).getLen()))))
    finally:
        stream.close()
    if start.lstrip()[:1] in (b"{", b"["):
        return "jsonl" if sum(x.strip().startswith(b"{") for x in start.split(b"\n")[:10]) >= 2 else "json"
    return "text"


READERS = {"jsonl": read_jsonl, "json": read_json, "dir": read_folder, "text": lambda spark, path, *_: read_text(spark, path)}


def read_transcripts(spark: SparkSession, path: str, score_field: str = "score", threshold: float = 0.5, kind: str | None = None) -> DataFrame:
    """Samples of any format. Register further formats in READERS; the container of `inspect` files has no public
    definition here, so reading it needs one."""
    kind = kind or detect_format(spark, path)
    if kind not in READERS:
        raise ValueError(f"no reader for {kind!r}: add one to READERS")
    return READERS[kind](spark, path, score_field, threshold).select(*COLUMNS)
