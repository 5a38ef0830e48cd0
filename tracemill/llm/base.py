"""What the operators of this package share: the shared work folder, written intermediate tables, and a
small numpy kernel that turns texts into folded letters and word hashes without a Python loop over words."""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from functools import lru_cache, wraps

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Characters that one numpy step works on. Longer texts are worked through in slices.
SLICE = 1 << 18


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Only a local master may do without it."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not found:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = f"file://{tempfile.mkdtemp(prefix='tracemill-')}"
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


#: Spark's setting that removes a query's shuffle files at its end (from 4.1 on; earlier ones do not look at it).
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame) -> DataFrame:
    """df, written once as Parquet to the shared folder and read again: lineage ends there, lost executors do not
    recompute it, and Catalyst knows its true size when it chooses between broadcast and shuffled joins. What was shuffled for
    it is of no use once it is written, and removed at once rather than at some collection of garbage. See scratch."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tracemill-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    if _made:
        _made[-1].append(path)
    return spark.read.schema(df.schema).parquet(path)


#: Rows of a list of ids, hashes or 32-byte marks up to which it is broadcast: some 100 MB in memory at most.
SMALL = 1_000_000
#: Folders that `written` has made within the innermost `scratch`.
_made: list[list[str]] = []


def small(rows: DataFrame) -> DataFrame:
    """rows (a written list), marked for a broadcast if their number is within SMALL; otherwise Spark decides."""
    return F.broadcast(rows) if rows.count() <= SMALL else rows


@contextmanager
def scratch(spark: SparkSession):
    """Within, tables are written as ever; on leaving, all are removed but those of the frame given to the function that
    this yields. What is kept must be written: then no later job reads, or makes again, what is gone."""
    _made.append([])
    kept: list[str] = []

    def keep(df: DataFrame) -> DataFrame:
        kept.append(_made[-1][-1])
        return df

    try:
        yield keep
    finally:
        paths = _made.pop()
        if _made:
            _made[-1] += kept
        for path in set(paths) - set(kept):
            folder = spark._jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


#: Rows of text that go to or from a Python worker at once, so that long texts do not pile up there.
ROWS_A_BATCH = 256


def small_batches(spark: SparkSession) -> None:
    """Lower the session's Arrow batches to ROWS_A_BATCH rows, unless they are smaller already."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= ROWS_A_BATCH:
        spark.conf.set(name, str(ROWS_A_BATCH))


@lru_cache(1)
def _trim():
    """The C library's call that gives free memory back to the system, if there is one. Arrow then uses that allocator."""
    pa.set_memory_pool(pa.system_memory_pool())
    return getattr(ctypes.CDLL(None), "malloc_trim", lambda keep: 0)


@contextmanager
def given_back():
    """For the driver's Python, which lives beside its JVM: within, Arrow's memory is the C library's, and on leaving all that is free
    goes back to the system. Else what a fit took once would stay with the driver for good."""
    trim = _trim()
    try:
        yield
    finally:
        trim(0)


def text_udf(kind: str):
    """An Arrow UDF over a column of texts, fed in small batches. Workers live on and serve other operators, so each batch
    gives its memory back."""
    small_batches(SparkSession.active())

    def made(f):
        @wraps(f)
        def one(texts: pa.Array) -> pa.Array:
            out = f(texts)
            _trim()(0)
            return out

        return F.arrow_udf(kind)(one)

    return made


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def identity(*columns: Column) -> Column:
    """128 bits for each column's value: tells rows apart where 64 bits would meet by chance in a very large table."""
    return F.concat(*[F.coalesce(F.unhex(F.md5(c.cast("string").cast("binary"))), F.lit(b"-")) for c in columns])


def drawn(rows: DataFrame, group: str, order: str, most: int, groups: int) -> DataFrame:
    """group, order: of distinct rows (group, order) at most `most` a group, those with the lowest `order` (a hash) among a
    share that suffices; of more than `groups` groups the largest. Copies count once, so `most` times `groups` is a bound."""
    sizes = rows.groupBy(group).agg(F.approx_count_distinct(order).alias("n")).orderBy(F.desc("n"), group).limit(groups)
    some = rows.join(F.broadcast(written(sizes)), group).where(F.pmod(order, F.lit(1_000_003)) * F.col("n") <= F.lit(4 * most * 1_000_003))
    rank = F.row_number().over(Window.partitionBy(group).orderBy(order))
    return written(some.select(group, order).distinct().withColumn("rank", rank).where(F.col("rank") <= most).select(group, order))


def id_remainder(column: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n; null for a null id."""
    return F.crc32(column.cast("string").cast("binary")) % F.lit(n)


@lru_cache(1)
def letters() -> np.ndarray:
    """For every code point its lower-cased letter, or 0 if it is no letter."""
    out = np.zeros(0x110000, np.uint32)
    found = [i for i in range(0x110000) if chr(i).isalpha()]
    out[found] = [ord(chr(i).lower()[0]) for i in found]
    return out


@lru_cache(1)
def _usual_powers() -> tuple[np.ndarray, np.ndarray]:
    return _powers(2 * SLICE + 2)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    base = 0x9E3779B97F4A7C15 | 1
    inverse = pow(base, -1, 1 << 64)
    out = []
    for b in (base, inverse):
        p = np.full(n, b, np.uint64)
        p[0] = 1
        out.append(np.multiply.accumulate(p))
    return out[0], out[1]


def mixed(h: np.ndarray) -> np.ndarray:
    """A finalizer that spreads the bits of 64-bit hashes."""
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(29))


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def _slice_end(text: str, at: int) -> int:
    """Where the slice that begins at `at` ends: behind its last character that is no letter, so no word is cut. A word that
    is longer than a slice is taken whole."""
    size = SLICE
    while True:
        found = np.flatnonzero(letters()[code_points(text[at : at + size])] == 0)
        if len(found):
            return at + int(found[-1 if size == SLICE else 0]) + 1
        if at + size >= len(text):
            return len(text)
        size *= 2


def _last_words(text: str, begin: int, end: int, words: int) -> int:
    """Where the last `words` words of text[begin:end] begin."""
    inside = letters()[code_points(text[begin:end])] != 0
    starts = np.flatnonzero(inside & ~np.concatenate(([False], inside[:-1])))
    return begin + int(starts[-words]) if len(starts) >= words else begin


def pieces(texts: list[str | None], overlap: int = 0) -> Iterator[tuple[np.ndarray, list[str]]]:
    """Groups of (row numbers, texts) with about SLICE characters each. A longer text comes in several pieces, cut between
    words; each but its first begins with the `overlap` words before the cut, so that words, and runs of overlap + 1 words, are
    those of the whole text."""
    rows: list[int] = []
    held: list[str] = []
    size = 0
    for k, text in enumerate(texts):
        if not text:
            continue
        begin = at = 0
        while at < len(text):
            end = len(text) if len(text) - at <= SLICE else _slice_end(text, at)
            part = text[begin:end]
            if held and size + len(part) > SLICE:
                yield np.array(rows), held
                rows, held, size = [], [], 0
            rows.append(k)
            held.append(part)
            size += len(part)
            begin = _last_words(text, begin, end, overlap) if overlap and end < len(text) else end
            at = end
    if held:
        yield np.array(rows), held


def folded(held: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The folded letters of the texts in a row, a 0 before each; and where each begins (at its 0)."""
    lengths = np.array([len(x) for x in held]) + 1
    starts = np.concatenate(([0], np.cumsum(lengths)[:-1]))
    return letters()[code_points("\0" + "\0".join(held))], starts


def word_hashes(held: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words (runs of letters, case folded) and the number of the text that each is from."""
    chars, starts = folded(held)
    inside = np.concatenate(([False], chars != 0, [False]))
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    first, last = edges[::2], edges[1::2]
    if len(first) == 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    power, inverse = _usual_powers() if len(chars) <= 2 * SLICE + 2 else _powers(len(chars))
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(chars.astype(np.uint64) * power[: len(chars)], dtype=np.uint64)))
    hashes = (sums[last] - sums[first]) * inverse[first]
    return mixed(hashes), np.searchsorted(starts, first, side="right") - 1
