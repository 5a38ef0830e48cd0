"""A Merkle manifest of a data set: every row is a leaf, every group of rows a tree, and the trees' tops make one more tree.

Levels are DataFrames. Leaves get their index in their tree by row_number; a level's nodes are grouped by tree and index
divided by the fanout, and the sorted child digests of a group, hashed, are the parent. Then the way back: from the root
down, each level joins the paths of its nodes with their children, whose siblings go in front of the path, so all joins
together touch about fanout / (fanout - 1) rows a leaf, and a leaf's path is moved once. Trees may end at different
levels; where one has a single node left, that is its subroot.

An index needs no sort of a whole tree in a task: rows are dealt into ranges of (tree, order), written, numbered within
their range, and moved on by the counts of the ranges before. Every level is written to the shared folder, so a lost
executor costs a part of one level. The driver gets the size of the largest tree and the root, nothing else.

Defined cases: a null column gives `-` in the leaf; leaves with a null key come first in their tree, and a null group is a
tree of its own, the first. Rows with equal keys stand in the order of their digests, so repeated rows are interchangeable.
A single leaf is its tree's subroot, a single subroot is the root; a proof without siblings is the digest of nothing. An
empty table gives an empty manifest. Only the named columns are read, so others may have any name."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tracemill.llm.base import id_remainder, scratch, written

#: Rows in a range that one task numbers, and the fewest ranges.
RANGE_ROWS, RANGES = 1 << 20, 16
#: Levels on the way down that one job joins.
LEVELS_A_JOB = 4
PATH = "array<struct<place: int, siblings: array<binary>>>"


def digest(text: Column) -> Column:
    """SHA-256 as 32 bytes."""
    return F.unhex(F.sha2(text, 256))


def hexed(digests: Column) -> Column:
    """The digests of an array as lowercase hex, joined."""
    return F.lower(F.array_join(F.transform(digests, F.hex), ""))


def field(column: Column) -> Column:
    """A value in a leaf: `-` for null, else its length in bytes, `:`, and the value as text."""
    text = column.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(*columns: Column) -> Column:
    return digest(F.concat(*[field(c) for c in columns]))


def numbered(rows: DataFrame, tree: str, order: Sequence[str]) -> DataFrame:
    """rows (written; `tree` not null) with `index`, from 0 within each tree by order, and `n`, the rows of the tree."""
    ranges = max(RANGES, -(-rows.count() // RANGE_ROWS))
    dealt = written(rows.repartitionByRange(ranges, tree, *order).withColumn("range", F.spark_partition_id()))
    each = Window.partitionBy(tree)
    counts = dealt.groupBy(tree, "range").agg(F.count("*").alias("k"))
    counts = written(counts.select(tree, "range", (F.sum("k").over(each.orderBy("range")) - F.col("k")).alias("before"), F.sum("k").over(each).alias("n")))
    within = F.row_number().over(Window.partitionBy(tree, "range").orderBy(*order)) - 1
    return dealt.withColumn("within", within).join(counts, [tree, "range"]).withColumn("index", F.col("within") + F.col("before")).drop("within", "before", "range")


def climb(nodes: DataFrame, fanout: int) -> list[DataFrame]:
    """All levels (tree, index, n, hash, and from the second on kids), each written; nodes is the first."""
    levels = [nodes]
    left = nodes.agg(F.max("n")).first()[0] or 0
    while left > 1:
        below = levels[-1].where("n > 1")
        kids = F.array_sort(F.collect_list(F.struct("index", "hash")))  # at most `fanout`
        up = below.groupBy("tree", F.expr(f"index div {fanout}").alias("index")).agg(F.max("n").alias("n"), kids.alias("kids"))
        up = up.select("tree", "index", F.expr(f"(n + {fanout - 1}) div {fanout}").alias("n"), F.col("kids.hash").alias("kids"))
        levels.append(written(up.withColumn("hash", digest(hexed(F.col("kids"))))))
        left = -(-left // fanout)
    return levels


def subroots(levels: list[DataFrame]) -> DataFrame:
    """tree, height, hash of each tree's last node."""
    tops = [level.where("n = 1").select("tree", F.lit(k).alias("height"), "hash") for k, level in enumerate(levels)]
    out = tops[0]
    for top in tops[1:]:
        out = out.unionByName(top)
    return out


def descend(levels: list[DataFrame], tops: DataFrame, fanout: int) -> DataFrame:
    """tree, index, subroot, path for every node of the first level. tops (tree, height, hash, path; written): the subroots and
    what lies above them. A path lists for each level the node's place in its run and the run's others."""
    at = lambda k: tops.where(F.col("height") == k).select("tree", F.lit(0).cast("bigint").alias("index"), F.col("hash").alias("subroot"), "path")
    paths = at(len(levels) - 1)
    for k in range(len(levels) - 1, 0, -1):
        kin = levels[k].select("tree", "index", "kids").join(paths, ["tree", "index"]).select("tree", "index", "subroot", "path", "kids", F.posexplode("kids").alias("place", "own"))
        step = F.struct("place", F.filter("kids", lambda x, i: i != F.col("place")).alias("siblings"))
        down = kin.select("tree", (F.col("index") * fanout + F.col("place")).alias("index"), "subroot", F.concat(F.array(step), "path").alias("path"))
        paths = down.unionByName(at(k - 1))
        if (len(levels) - k) % LEVELS_A_JOB == 0:
            paths = written(paths)
    return paths


def folded(start: Column, path: Column) -> Column:
    """The root that a leaf and its path lead to."""
    run = lambda own, s: F.concat(F.slice(s["siblings"], 1, s["place"]), F.array(own), F.slice(s["siblings"], s["place"] + 1, F.size(s["siblings"])))
    return F.aggregate(path, start, lambda own, s: digest(hexed(run(own, s))))


def siblings(path: Column) -> Column:
    """All siblings of a path, level by level, each level left to right."""
    return F.flatten(F.transform(path, lambda s: s["siblings"]))


def manifest(rows: DataFrame, leaves: dict[str, Column], tree: Column, key: Column, fanout: int = 2) -> DataFrame:
    """For each row: `key`, the digests named in leaves (the first is the leaf in the tree), subroot, root, path. To be used
    within base.scratch, since its tables are."""
    names = list(leaves)
    first = F.coalesce(F.concat(F.lit("="), tree.cast("string")), F.lit(""))  # a null tree comes first; none is null any more
    read = written(rows.select(first.alias("tree"), key.alias("key"), *[c.alias(k) for k, c in leaves.items()]).withColumn("row", F.monotonically_increasing_id()))
    nodes = written(numbered(read, "tree", ["key", names[0], "row"]).withColumnRenamed(names[0], "hash"))
    levels = climb(nodes, fanout)
    ends = written(subroots(levels))
    top = written(numbered(ends.select("tree", "height", "hash", F.lit("").alias("all")), "all", ["tree"]))
    above = climb(top.select(F.col("all").alias("tree"), "index", "n", "hash"), fanout)
    root = above[-1].where("n = 1").select("hash").first()
    start = written(subroots(above).withColumn("path", F.array().cast(PATH)))
    ways = descend(above, start, fanout).select("index", "path")
    tops = written(top.select("tree", "height", "hash", "index").join(ways, "index").drop("index"))
    paths = descend(levels, tops, fanout)
    out = nodes.drop("n", "row").join(paths, ["tree", "index"]).withColumnRenamed("hash", names[0])
    return out.select("key", *names, "subroot", F.lit(root[0] if root else None).cast("binary").alias("root"), "path")


def audited(documents: DataFrame, fanout: int = 2) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified: trees by lang, leaves by doc_id. A row whose id's CRC-32
    is divisible by 7 is read again with n_chars one larger; folded_root is what that leaf and the siblings lead to."""
    columns = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars", "text")]
    altered = F.col("n_chars").cast("decimal(38,0)") + F.when(id_remainder(F.col("doc_id"), 7) == 0, 1).otherwise(0)
    leaves = {"leaf": leaf(*columns), "read_again": leaf(*columns[:3], altered, columns[4])}
    hexes = lambda c: F.lower(F.hex(c))
    with scratch(documents.sparkSession) as keep:
        made = manifest(documents, leaves, F.col("lang"), F.col("doc_id"), fanout)
        out = made.select(
            F.col("key").alias("doc_id"), hexes("leaf").alias("leaf"), hexes("subroot").alias("subroot"), hexes("root").alias("root"),
            F.sha2(hexed(siblings(F.col("path"))), 256).alias("proof_sha256"), hexes(folded(F.col("read_again"), F.col("path"))).alias("folded_root"),
        )
        return keep(written(out.withColumn("verified", F.col("folded_root") == F.col("root"))))
