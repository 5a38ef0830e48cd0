"""Sources of the record-keeping kind: usage logs, events, sessions, front matter, review threads, journals, tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tracemill.functions.records import content_text, text_at
from tracemill.functions.text import base_name, strip
from tracemill.sources.transcripts import whole_files

USAGE = "timestamp string, model string, tokens_in bigint, tokens_out bigint, total_tokens bigint, cost double, experiment_id string"


def _exists(spark: SparkSession, path: str) -> bool:
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place)


def read_usage(spark: SparkSession, path: str) -> DataFrame:
    """Usage records; a malformed line fails the read, a blank one is passed over, a missing path is no records."""
    if not _exists(spark, path):
        return spark.createDataFrame([], USAGE)
    return spark.read.schema(USAGE).option("mode", "FAILFAST").json(path)


def append_usage(calls: DataFrame, path: str, extra: Column | None = None) -> None:
    """Append records; `extra`, a map, adds fields, and wins over fields of the same name."""
    rows = calls
    if extra is not None:
        spark = calls.sparkSession
        names = [c for c in calls.columns]
        base = F.map_from_arrays(F.array(*[F.lit(c) for c in names]), F.array(*[F.to_json(F.struct(F.col(c).alias("v"))) for c in names]))
        keep = F.map_filter(base, lambda k, v: ~F.coalesce(F.array_contains(F.map_keys(extra), k), F.lit(False)))
        more = F.transform_values(extra, lambda k, v: F.to_json(F.struct(v.alias("v"))))
        parts = F.transform(F.map_entries(F.map_concat(keep, F.coalesce(more, F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))))), lambda e: F.when(e["value"] != "{}", F.concat(F.lit('"'), e["key"], F.lit('":'), F.regexp_extract(e["value"], r'(?s)^\{"v":(.*)\}$', 1))))
        line = F.concat(F.lit("{"), F.array_join(parts, ","), F.lit("}"))
        calls.select(line.alias("value")).write.mode("append").text(path)
        return
    rows.write.mode("append").json(path)


def usage_totals(usage: DataFrame, experiment: str | None = None, by: str | None = None) -> DataFrame:
    """cost, tokens_in, tokens_out, total_tokens (recomputed; a stored total is not used); nulls count as 0."""
    rows = usage if experiment is None else usage.where(F.col("experiment_id") == experiment)
    total = lambda c: F.coalesce(F.sum(F.coalesce(F.col(c), F.lit(0))), F.lit(0))
    sums = (rows.groupBy(by) if by else rows.groupBy()).agg(total("cost").cast("double").alias("cost"), total("tokens_in").alias("tokens_in"), total("tokens_out").alias("tokens_out"))
    return sums.withColumn("total_tokens", F.col("tokens_in") + F.col("tokens_out"))


def events(lines: DataFrame, line: str = "value") -> DataFrame:
    """Tool events of JSON lines (batch or streaming): the fields that rules use, with their defaults. A default also stands
    in for a field that is false, as the logs' own tools have it."""
    e = F.try_parse_json(line)

    def get(p: str, kind: str = "string") -> Column:
        found = F.try_variant_get("e", p, kind)
        off = (F.schema_of_variant(F.try_variant_get("e", p, "variant")) == "BOOLEAN") & (F.try_variant_get("e", p, "string") == "false")
        return F.when(~F.coalesce(off, F.lit(False)), found) if kind == "string" else found

    rows = lines.withColumn("e", e).where(F.col("e").isNotNull())
    text = lambda p: F.coalesce(get(p), F.lit(""))
    error = F.when(F.schema_of_variant(F.try_variant_get("e", "$.tool_response", "variant")).startswith("OBJECT"), text("$.tool_response.error")).otherwise(text("$.tool_response"))
    return rows.select(
        text("$.tool_name").alias("tool"), text("$.tool_input.command").alias("command"), text("$.tool_input.file_path").alias("file_path"), get("$.tool_input.limit").alias("limit"),
        get("$.tool_input.timeout", "bigint").alias("timeout"), get("$.tool_input.run_in_background", "boolean").alias("background"), get("$.tool_input.cwd").alias("cwd"),
        text("$.tool_response.stdout").alias("stdout"), text("$.tool_response.stderr").alias("stderr"), error.alias("response"),
        F.coalesce(get("$.tool_response.exit_code"), get("$.tool_output.exit_code")).alias("exit_code"), F.octet_length(line).alias("bytes"),
    )


def audit_rows(found: DataFrame, phase: str, at: Column, branch: Column | None = None, default_cwd: str = "") -> DataFrame:
    """ts, exit (null at START), cmd, cwd, branch, and the human line of an END."""
    code = F.when(F.lit(phase) == "END", F.nullif("exit_code", F.lit("")).cast("int"))
    cmd, cwd = F.coalesce(F.nullif("command", F.lit("")), F.lit("unknown")), F.coalesce(F.nullif("cwd", F.lit("")), F.lit(default_cwd))
    rows = found.select(F.date_format(at, "yyyy-MM-dd'T'HH:mm:ssXXX").alias("ts"), code.alias("exit"), cmd.alias("cmd"), cwd.alias("cwd"), (F.lit(None).cast("string") if branch is None else branch).alias("branch"))
    state = F.when(F.coalesce("exit", F.lit(0)) == 0, "[OK]").otherwise(F.concat(F.lit("[!"), F.col("exit").cast("string"), F.lit("]")))
    place = F.concat(base_name(F.col("cwd")), F.coalesce(F.concat(F.lit(" ("), F.nullif("branch", F.lit("")), F.lit(")")), F.lit("")))
    human = F.format_string("%s %-5s %s | %s", F.substring("ts", 12, 5), state, place, "cmd")
    return rows.withColumn("human", F.when(F.lit(phase) == "END", human))


def newest_files(spark: SparkSession, path: str, glob: str | Sequence[str] = "*.jsonl", n: int = 1) -> DataFrame:
    """path, modified of the n newest files of one or several patterns. Contents are not read."""
    pattern = glob if isinstance(glob, str) else "{" + ",".join(glob) + "}"
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path).select("path", F.col("modificationTime").alias("modified"))
    return files.orderBy(F.desc("modified"), "path").limit(n)


#: Characters of what the user said that a session's context has.
CONTEXT = 1500


def session_titles(lines: DataFrame, by: str = "file", pos: str = "idx", line: str = "line") -> DataFrame:
    """by, title (the last one set), done (it begins with a tick), context (first CONTEXT characters of the user's words). Of a
    session's turns the first CONTEXT are gathered: each adds a character at least, so no later one can be in the context."""
    rows = lines.withColumn("e", F.try_parse_json(line)).where(F.col("e").isNotNull())
    kind, title = text_at(F.col("e"), "type"), text_at(F.col("e"), "customTitle")
    said = content_text(F.try_variant_get("e", "$.message.content", "variant"))
    rows = rows.select(by, pos, F.when(kind == "custom-title", title).alias("title"), F.when(kind == "user", said).alias("said"))
    titles = rows.groupBy(by).agg(F.max_by("title", F.when(F.col("title").isNotNull(), F.col(pos))).alias("title"))
    first = rows.where("said is not null").select(by, pos, F.substring("said", 1, CONTEXT).alias("said"))
    first = first.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(pos))).where(F.col("rank") <= CONTEXT)
    words = F.transform(F.array_sort(F.collect_list(F.struct("rank", "said"))), lambda x: x["said"])
    context = first.groupBy(by).agg(F.substring(F.array_join(words, "\n"), 1, CONTEXT).alias("context"))
    out = titles.join(context, by, "left")
    return out.select(by, "title", F.coalesce(F.startswith("title", F.lit("✅ ")), F.lit(False)).alias("done"), F.coalesce("context", F.lit("")).alias("context"))


def read_front_matter(spark: SparkSession, path: str, fields: tuple[str, ...] = ("title", "date", "status", "dataset", "method", "priority")) -> DataFrame:
    """file, the first value of each field in each .md file (README and templates left out), tags as an array."""
    files = whole_files(spark, path, "*.md").select(base_name(F.col("file")).alias("file"), "value")
    files = files.where(~F.col("file").isin("README.md", "_template.md"))
    value = lambda name: F.regexp_replace(strip(F.regexp_extract("value", rf"(?m)^{name}: *(.*)$", 1)), '"', "")
    tags = F.regexp_replace(value("tags"), r"[\[\]]", "")
    return files.select("file", *[value(f).alias(f) for f in fields], F.when(tags != "", F.split(tags, r"\s*,\s*")).otherwise(F.array().cast("array<string>")).alias("tags"), "value")


def active(experiments: DataFrame, most: int = 15) -> DataFrame:
    return experiments.where(F.col("status").isin("planned", "active")).orderBy("file").limit(most)


def review_threads(texts: DataFrame, text: str = "value") -> DataFrame:
    """num, content, done of the threads in a review file."""
    parts = F.slice(F.split(F.col(text), r"(?m)^## Thread ", -1), 2, 1 << 30)
    rows = texts.select(F.explode(parts).alias("content"))
    return rows.select(F.regexp_extract("content", r"^#?(\d+)", 1).try_cast("int").alias("num"), "content", F.contains("content", F.lit("✅")).alias("done"))


def journal_entries(texts: DataFrame, text: str = "value") -> DataFrame:
    """date, tag, description, source, revised of lines such as `- 2026-01-31: [tag] words (source: file)`."""
    rows = texts.select(F.explode(F.split(text, "\n", -1)).alias("line"))
    pattern = r"^- (\d{4}-\d{2}-\d{2}): (?:\[REVISED\] )?\[([^\]]+)\] (.*?)(?: \(source: ([^)]*)\))?\s*$"
    part = lambda k: F.regexp_extract("line", pattern, k)
    rows = rows.where(F.col("line").rlike(pattern))
    return rows.select(part(1).try_cast("date").alias("date"), part(2).alias("tag"), part(3).alias("description"), F.nullif(part(4), F.lit("")).alias("source"), F.contains("line", F.lit("[REVISED]")).alias("revised"))


def read_results(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    reader = spark.read.option("sep", "\t").option("header", "true")
    return (reader.schema(schema) if schema else reader).csv(path)


def metric(text: Column, name: str) -> Column:
    """The number on the first line `name: number`."""
    return F.regexp_extract(text, rf"(?m)^{name}:\s*(\S+)", 1).try_cast("double")


def table_rows(lines: DataFrame, names: list[str], line: str = "value") -> DataFrame:
    """Columns of a table printed with white space between them."""
    cells = F.split(F.trim(F.col(line)), r"\s+", len(names))
    return lines.where(F.trim(line) != "").select(*[F.get(cells, i).alias(n) for i, n in enumerate(names)])


def flat_lexicon(spark: SparkSession, path: str) -> DataFrame:
    """category_key, category, severity, declared, phrase, fix, confidence, sources of a nested JSON lexicon."""
    schema = "struct<patterns:map<string,struct<category:string,severity:string,count:int,patterns:array<struct<phrase:string,fix:string,confidence:string,sources:array<string>,rationale:string>>>>>"
    held = whole_files(spark, path).select(F.explode(F.map_entries(F.from_json("value", schema)["patterns"])).alias("g"))
    rows = held.select(F.col("g.key").alias("category_key"), "g.value.category", "g.value.severity", F.col("g.value.count").alias("declared"), F.explode("g.value.patterns").alias("p"))
    return rows.select("category_key", "category", "severity", "declared", "p.phrase", "p.fix", F.col("p.confidence").try_cast("int").alias("confidence"), "p.sources", "p.rationale")


def read_docs(spark: SparkSession, paths: str | list[str], skip: str = r"/(node_modules|\.git)/") -> DataFrame:
    """file, value of the Markdown files below some folders (a file that several folders reach comes once)."""
    files = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.md").text(paths, wholetext=True)
    rows = files.select(F.col("_metadata.file_path").alias("file"), "value").where(~F.col("file").rlike(skip))
    return rows.dropDuplicates(["file"])


def search_docs(spark: SparkSession, paths: str | list[str], pattern: str, context: int = 2, most: int = 100) -> DataFrame:
    """file, line_no, line, is_match: the first `most` lines of a search with context."""
    from tracemill.operators.lines import search

    return search(read_docs(spark, paths), pattern, context, "file", "value").orderBy("file", "line_no").limit(most)


def corpus_samples(spark: SparkSession, path: str) -> DataFrame:
    """file, source, category, notes, low, high (the score range that is expected) and body of lint samples."""
    rows = read_front_matter(spark, path, ("source", "expected_score_range", "category", "notes"))
    band = F.split("expected_score_range", r"\s*-\s*")
    body = F.regexp_replace("value", r"(?s)\A---\n.*?\n---\n", "")
    return rows.select("file", "source", "category", "notes", F.get(band, 0).try_cast("int").alias("low"), F.get(band, 1).try_cast("int").alias("high"), strip(body).alias("body"))


def append_cache(entries: DataFrame, path: str) -> None:
    """Append (key, response) records; readers take the last of a key."""
    entries.select("key", "response").write.mode("append").json(path)


_CACHE = "key string, response string"


def _folder(spark: SparkSession, path: str):
    made = spark._jvm.org.apache.hadoop.fs.Path(path)
    return made.getFileSystem(spark._jsc.hadoopConfiguration()), made


def _generation(spark: SparkSession, path: str) -> int:
    """The number of the newest generation; 0 if there is none."""
    fs, folder = _folder(spark, path)
    names = [f.getPath().getName() for f in fs.listStatus(folder)]
    return max([int(n[5:]) for n in names if n.startswith("_gen-")], default=0)


def _cache_rows(spark: SparkSession, path: str, generation: int) -> DataFrame:
    """key, response, order, file of a generation and of the appended files that it does not hold. What was appended since
    comes after the generation; within it the newest file counts."""
    order = lambda later, at, file, pos: F.struct(F.lit(later).alias("later"), at.cast("timestamp").alias("at"), file.cast("string").alias("file"), pos.cast("bigint").alias("pos")).alias("order")
    file, none = F.col("_metadata.file_name"), F.lit(None)
    loose = spark.read.schema(_CACHE).json(path).select("*", order(1, F.col("_metadata.file_modification_time"), file, F.monotonically_increasing_id()), file.alias("file"))
    if not generation:
        return loose
    held = f"{path}/_gen-{generation}"
    loose = loose.join(spark.read.schema("file string").json(f"{held}/merged"), "file", "left_anti").select(loose.columns)
    return loose.unionByName(spark.read.schema(_CACHE).json(f"{held}/entries").select("*", order(0, none, none, none), none.cast("string").alias("file")))


def _last(rows: DataFrame) -> DataFrame:
    return rows.groupBy("key").agg(F.max_by("response", "order").alias("response"))


def read_cache(spark: SparkSession, path: str) -> DataFrame:
    """The cache's entries: of each key the last record. Two records that one append gives to a key are in no order."""
    if not _exists(spark, path):
        return spark.createDataFrame([], _CACHE)
    return _last(_cache_rows(spark, path, _generation(spark, path)))


def compact_cache(spark: SparkSession, path: str, before_switch: Callable[[], None] = lambda: None) -> int:
    """Merge the cache into its next generation, and return that one's number. It is written aside, with the names of the
    files that went in, and becomes visible by one rename: a reader sees the old generation with all appended files, or the new
    one with those that came later. An append meanwhile is in neither list and stays. What a generation replaced is
    removed by the compaction after it, so readers that began before the switch can end. Of two compactions at a time
    the second fails with ValueError and changes nothing. before_switch is called before the rename, for tests."""
    fs, folder = _folder(spark, path)
    at = lambda name: spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{name}")
    now = _generation(spark, path)
    if now:
        for row in spark.read.schema("file string").json(f"{path}/_gen-{now}/merged").toLocalIterator():
            fs.delete(at(row["file"]), False)
        fs.delete(at(f"_gen-{now - 1}"), True)
    names = [f.getPath().getName() for f in fs.listStatus(folder) if f.isFile()]
    merged = spark.createDataFrame([(n,) for n in names if n[0] not in "._"], "file string")
    rows = _cache_rows(spark, path, now)
    inside = rows.join(merged, "file", "left_semi").select(rows.columns).unionByName(rows.where("file is null"))
    aside = f"_new-{uuid.uuid4().hex}"
    _last(inside).write.json(f"{path}/{aside}/entries")
    merged.coalesce(1).write.json(f"{path}/{aside}/merged")
    before_switch()
    if fs.exists(at(f"_gen-{now + 1}")) or not fs.rename(at(aside), at(f"_gen-{now + 1}")):
        fs.delete(at(aside), True)
        raise ValueError(f"{path} was compacted meanwhile")
    return now + 1


def audit_sink(found: DataFrame, path: str, checkpoint: str, phase: str, at: Column, name: str = "audit", **more):
    """Append a stream of events() as audit rows (see audit_rows) below path: JSON lines in records/, and the human lines of ENDs as
    text in human/. A batch has folders named by the stream and its number, which a replay of the batch writes over, so nothing is
    written twice, whichever of the two was whole when the job was lost. Runs until all that is there is done."""

    def write(rows: DataFrame, number: int) -> None:
        made = audit_rows(rows, phase, at, **more)
        made.select("ts", "exit", "cmd", "cwd").write.mode("overwrite").option("ignoreNullFields", "false").json(f"{path}/records/stream={name}/batch={number}")
        made.where("human is not null").select("human").write.mode("overwrite").text(f"{path}/human/stream={name}/batch={number}")

    return found.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_audit(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("ts string, exit int, cmd string, cwd string, stream string, batch bigint").json(f"{path}/records")


# What a run's specification must state, and what it should.
BLOCKING = ("hyperparameters", "output_path", "hypothesis", "metrics", "datasets", "graphs", "caching", "concurrency", "error_handling")
ADVISED = ("random_seeds", "resources", "baseline")


def validated(specs: DataFrame, key: str) -> DataFrame:
    """key, passed, warnings, missing, verdict of specifications with a text column for each item; empty is missing."""
    blank = lambda c: F.coalesce(strip(F.col(c).cast("string")), F.lit("")) == ""
    listed = lambda names: F.array_compact(F.array(*[F.when(blank(c), F.lit(c)) for c in names]))
    rows = specs.select(key, listed(BLOCKING).alias("missing"), listed(ADVISED).alias("warnings"))
    return rows.select(key, (len(BLOCKING) - F.size("missing")).alias("passed"), "warnings", "missing", F.when(F.size("missing") == 0, "PASS").otherwise("STOP").alias("verdict"))


def session_counts(sessions: DataFrame, by: str = "project") -> DataFrame:
    return sessions.groupBy(by).agg(F.count("*").alias("sessions"))
