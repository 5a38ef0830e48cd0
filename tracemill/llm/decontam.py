"""Benchmark decontamination: size-partitioned MinHash containment search, verified by exact shingle containment.

Items are put into size classes by their number of distinct shingles (powers of two). An item's sketch is its k shingle
hashes that fewest items hold (then the lowest), so a passage that many items share makes few candidates; k is set by its class: if at most m shingles of an item may be missing, k = m(class) + 2. A document that
holds the asked share of an item's shingles misses at most m of them, so at least k - m of the sketch are in it: the
search, by an equi-join of the document's shingle hashes with the sketches, loses no pair however long the document is.
Candidates are verified on the shingles themselves. All steps are DataFrame functions.

Words are runs of letters and digits, lower-cased; a shingle is five words. Defined cases: items of fewer than five
words (or null) have no shingle and match nothing, and likewise documents; repeated item rows count once, items that
share an id are looked for one by one; repeated documents are reported each; an empty table on either side gives no
row (`clean`: all rows). Only the named columns are read, so others may have any name. Texts are read whole."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracemill.llm.base import identity, small, written


def _words(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), "")


def _windows(column: str, words: int, made: str) -> Column:
    """For each start i of a window over the array column: made, SQL over i."""
    return F.expr(f"case when size({column}) >= {words} then transform(sequence(0, size({column}) - {words}), i -> {made}) end")


def _hashes(words: int) -> Column:
    return _windows("h", words, f"xxhash64({', '.join(f'h[i + {k}]' for k in range(words))})")


def _shingles(words: int) -> Column:
    return F.array_distinct(_windows("w", words, f"array_join(slice(w, i + 1, {words}), ' ')"))


def sketches(items: DataFrame, words: int = 5, share: float = 0.8) -> DataFrame:
    """item (a number that tells rows apart by id and text), q (distinct shingles), need, sketch, shingles."""
    read = items.select(F.col("item_id"), _words(F.col("text")).alias("w")).where(f"size(w) >= {words}").distinct()
    held = read.select("item_id", "w", F.expr("transform(w, x -> xxhash64(x))").alias("h"))
    held = held.select("item_id", F.xxhash64("item_id", "w").alias("item"), F.array_distinct(_hashes(words)).alias("hashes"), _shingles(words).alias("shingles"))
    each = held.select("item", F.explode("hashes").alias("hash"))
    rarity = each.groupBy("hash").agg(F.count("*").alias("n"))
    rarest = each.join(rarity, "hash").groupBy("item").agg(F.array_sort(F.collect_list(F.struct("n", "hash"))).alias("o"))  # one item's
    held = held.drop("hashes").join(rarest, "item").withColumn("hashes", F.col("o.hash"))
    sized = held.withColumn("q", F.size("hashes")).withColumn("most", F.expr("cast(shiftleft(1, cast(floor(log2(q)) as int) + 1) - 1 as int)"))
    missing = f"cast(floor((1 - {share}D) * {{}} + 1e-9) as int)"
    sized = sized.withColumn("k", F.expr(f"least(q, {missing.format('most')} + 2)"))
    return sized.select("item_id", "item", "q", F.expr(f"k - {missing.format('q')}").alias("need"), F.expr("slice(hashes, 1, k)").alias("sketch"), "shingles")


def contained(documents: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", words: int = 5, share: float = 0.8) -> DataFrame:
    """doc_id, item_id, item_shingles, matched, containment for each pair that reaches the share."""
    items = written(sketches(written(items.select("item_id", "text")), words, share))
    sketch = written(items.select("item", "need", F.explode("sketch").alias("hash")))
    docs = documents.select(F.col(key).alias("doc_id"), F.col(text).alias("text")).where("text is not null")
    hashed = docs.select(F.xxhash64("text").alias("text_key"), F.transform(_words(F.col("text")), lambda x: F.xxhash64(x)).alias("h"))
    flat = hashed.select("text_key", F.explode(F.array_distinct(_hashes(words))).alias("hash"))
    hits = flat.join(sketch, "hash").groupBy("text_key", "item", "need").agg(F.count_distinct("hash").alias("hits"))
    candidates = written(hits.where("hits >= need").select("text_key", "item"))
    keys = written(candidates.select("text_key").distinct())
    read = docs.select("doc_id", "text", F.xxhash64("text").alias("text_key")).join(keys, "text_key", "left_semi")
    read = read.select("doc_id", "text_key", _words(F.col("text")).alias("w")).select("doc_id", "text_key", _shingles(words).alias("own"))
    pairs = read.join(candidates, "text_key").join(items.select("item", "item_id", "q", "shingles"), "item")
    counted = pairs.select("doc_id", "item_id", F.col("q").cast("bigint").alias("item_shingles"), F.size(F.array_intersect("own", "shingles")).cast("bigint").alias("matched"))
    return counted.where(f"matched >= {share}D * item_shingles - 1e-9").withColumn("containment", F.col("matched") / F.col("item_shingles"))


def clean(documents: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", words: int = 5, share: float = 0.8) -> DataFrame:
    """The rows of documents, all columns, whose text holds no item. Rows are told apart by (id, text)."""
    mark = identity(F.col(key), F.col(text)).alias("mark")
    own = documents.select(mark, F.col(text).alias("text"))
    found = written(contained(own, items, "mark", "text", words, share).select(F.col("doc_id").alias("mark")).distinct())
    return documents.select(F.struct("*").alias("row"), mark).join(small(found), "mark", "left_anti").select("row.*")
