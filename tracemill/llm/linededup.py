"""Line dedup by levelled sorted runs of line hashes.

A line's key is the line without blanks at its ends, in lower-case ASCII; only keys of LEAST code points or more are
looked at. A store of runs (hash, n, last) says how many documents hold a key and which was the first to bring it. A run
is a table bucketed and sorted by hash. A new batch is counted by hash, merge-anti-joined with every run, which
leaves the keys that none has, and added as a run of its own: new keys with their holder, known ones with their count
alone. Runs have as many buckets as the batch's shuffle has partitions, so only the batch moves. Once a level holds
EVERY runs, they are merged into one run of the next level; so a batch meets at most EVERY - 1 runs a level, and each row is
rewritten once a level.

deduplicated() feeds documents in descending ranges of their ids, so the first to bring a key is the largest id that holds it.
Keys that `documents` documents or more hold then lose all lines but those of that id. The list of what goes from a text
meets the texts by a mark of id and text; both joins are on written tables, which Catalyst may broadcast when small and AQE
may split when skewed.

Defined cases: a null or empty text is one empty line. Documents are rows: repeated rows count each, and rows that repeat the
largest id of a key all keep it. A null id is smaller than any other: a key that only such rows hold stays. An empty
table gives an empty result. Texts are read whole. Only the named columns are read, so others may have any name."""

from __future__ import annotations

import uuid
from functools import reduce

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracemill.llm.base import scratch, shared_dir, text_udf, written

#: What is stripped from a line's ends.
BLANKS = " \t\n\x0b\x0c\r"
#: Code points from which on a key counts, documents from which on it is common.
LEAST, COMMON = 40, 5
#: Runs of a level that are merged into one of the next, and ranges of ids that are fed one after the other.
EVERY, BATCHES = 3, 6


def keys(text: str | None, least: int) -> list[bytes | None]:
    """For each line its key's 128 bits, or None if the key is too short."""
    digest = xxhash.xxh3_128_digest
    out = []
    for line in (text or "").split("\n"):
        key = line.strip(BLANKS)
        out.append(digest(key.encode("utf-8", "surrogatepass").lower()) if len(key) >= least else None)  # bytes: ASCII only
    return out


def line_keys(least: int = LEAST):
    """A column function: text -> its distinct keys."""

    @text_udf("array<binary>")
    def distinct(text: pa.Array) -> pa.Array:
        return pa.array([list({k for k in keys(x, least) if k is not None}) for x in text.to_pylist()], pa.list_(pa.binary()))

    return distinct


def kept_lines(least: int = LEAST):
    """A column function: struct of text and the keys that go -> n_lines, n_dropped, kept."""

    @text_udf("struct<n_lines: bigint, n_dropped: bigint, kept: string>")
    def kept(rows: pa.Array) -> pa.Array:
        total, dropped, out = [], [], []
        for x, g in zip(rows.field(0).to_pylist(), rows.field(1).to_pylist()):
            held = (x or "").split("\n")
            stay = held
            if g:
                g = set(g)
                stay = [line for line, k in zip(held, keys(x, least)) if k not in g]
            total.append(len(held))
            dropped.append(len(held) - len(stay))
            out.append("\n".join(stay))
        return pa.StructArray.from_arrays([pa.array(total, pa.int64()), pa.array(dropped, pa.int64()), pa.array(out, pa.string())], ["n_lines", "n_dropped", "kept"])

    return kept


class Runs:
    """Levelled runs of (hash, n, last) below a shared folder. Each is written once and replaced only after the run that
    merges it is whole."""

    def __init__(self, spark: SparkSession, every: int = EVERY):
        self.spark, self.every = spark, every
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[list[str]] = [[]]

    def _write(self, rows: DataFrame) -> str:
        name = f"tracemill_run_{uuid.uuid4().hex}"
        rows.write.bucketBy(self.buckets, "hash").sortBy("hash").option("path", f"{shared_dir(self.spark)}/{name}").saveAsTable(name)
        return name

    def _remove(self, names: list[str]) -> None:
        for name in names:
            self.spark.sql(f"DROP TABLE {name}")
            folder = self.spark._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(self.spark)}/{name}")
            folder.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(folder, True)

    def runs(self) -> list[DataFrame]:
        return [self.spark.table(name) for level in self.levels for name in level]

    def new(self, batch: DataFrame) -> DataFrame:
        """Rows of batch (a row a hash) whose hash no run has."""
        return reduce(lambda left, run: left.join(run.select("hash"), "hash", "left_anti"), self.runs(), batch)

    def add(self, batch: DataFrame) -> None:
        """batch: hash, doc_id; a row for each document and key."""
        counts = batch.groupBy("hash").agg(F.count("*").alias("n"), F.max("doc_id").alias("last"))
        new = self.new(counts).select("hash", F.lit(True).alias("new"))
        self.levels[0].append(self._write(counts.join(new, "hash", "left").select("hash", "n", F.when(F.col("new"), F.col("last")).alias("last"))))
        self.compact()

    def compact(self) -> None:
        for k, level in enumerate(self.levels):
            if len(level) >= self.every:
                merged = self._write(self.merged(level))
                if k + 1 == len(self.levels):
                    self.levels.append([])
                self.levels[k] = []
                self.levels[k + 1].append(merged)
                self._remove(level)

    def merged(self, names: list[str]) -> DataFrame:
        """At most one of the runs knows a key's holder. Runs are read as plain files here: over a union of bucketed tables
        Spark 4.1.2 leaves out the exchange and then reads them without their buckets, which gave several rows a hash."""
        runs = [self.spark.read.schema(self.spark.table(name).schema).parquet(f"{shared_dir(self.spark)}/{name}") for name in names]
        return reduce(DataFrame.unionByName, runs).groupBy("hash").agg(F.sum("n").alias("n"), F.max("last").alias("last"))

    def totals(self) -> DataFrame:
        return self.merged([name for level in self.levels for name in level])

    def close(self) -> None:
        self._remove([name for level in self.levels for name in level])
        self.levels = [[]]


def mark(*columns: Column) -> Column:
    """128 bits that tell rows with other values apart."""
    sized = [F.coalesce(F.concat(F.octet_length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string")), F.lit("-")) for c in columns]
    return F.unhex(F.md5(F.concat(*sized).cast("binary")))


def deduplicated(documents: DataFrame, key: str = "doc_id", text: str = "text", least: int = LEAST, common: int = COMMON, batches: int = BATCHES) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept (the text that is left) for each row of documents."""
    spark = documents.sparkSession
    docs = documents.select(F.col(key).alias("doc_id"), F.col(text).alias("text")).withColumn("mark", mark(F.col("doc_id"), F.col("text")))
    with scratch(spark) as keep:
        held = written(docs.select("doc_id", "mark", line_keys(least)(F.col("text")).alias("hashes")))
        cuts = held.agg(F.percentile_approx("doc_id", [k / batches for k in range(1, batches)])).first()[0] or []
        cuts = sorted(set(cuts), reverse=True)
        store = Runs(spark)
        try:
            for k in range(len(cuts) + 1):
                inside = F.lit(True) if k == len(cuts) else F.col("doc_id") >= cuts[k]
                inside = inside & (F.coalesce(F.col("doc_id") < cuts[k - 1], F.lit(True)) if k else F.lit(True))
                store.add(held.where(inside).select(F.explode("hashes").alias("hash"), "doc_id"))
            frequent = written(store.totals().where(F.col("n") >= common).select("hash", "last"))
        finally:
            store.close()
        lines = held.select("mark", "doc_id", F.explode("hashes").alias("hash"))
        beyond = lines.join(frequent, "hash").where("doc_id < last or doc_id is null and last is not null")
        gone = keep(written(beyond.groupBy("mark").agg(F.collect_set("hash").alias("gone"))))  # of one text's keys
    read = docs.join(gone, "mark", "left").select("doc_id", kept_lines(least)(F.struct("text", "gone")).alias("k"))
    return read.select("doc_id", "k.*")
