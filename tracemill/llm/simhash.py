"""SimHash near-duplicates with pigeonring filtering, down to connected components.

Fingerprints are 64 bits over word shingles. Two are linked if at most `bits` (4) bits differ. The 64 bits form a ring
of five segments. If at most 4 bits differ, some segment starts a chain all of whose prefixes stay within the
proportional budget: the first l segments differ in at most floor(4 l / 5) bits, that is 0, 1, 2, 3, 4. So candidates
agree in a segment and differ in at most one bit of the next: an equi-join on about 25 bits (the second segment with
one bit left out), then the budgets of longer chains, then the full Hamming check.

Dense groups make no quadratic work: equal fingerprints are one node; nodes are first linked to the smallest member of
each 26-bit bucket and joined to components; after that only buckets that hold several components count. A bucket of two
gives its pair from the grouping itself; in larger ones members outside the bucket's largest component look for partners by
a join, if they are few, or else meet them in the points between (see _met). Links inside a component would change nothing.

Defined cases: a null text, or one without a word, has fingerprint zero and is linked like any other; a text of fewer
words than a shingle is one shingle. Repeated rows share a component. The id of a component is its smallest non-null
doc_id (null if it has none). An empty table gives an empty result.

near_copies links texts by the Jaccard similarity of their shingle sets. Fingerprints and their links come first, an exact check
of the sets follows; pairs too far apart for 4 bits are found by prefix filtering, which loses none: see there."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracemill.llm.base import scratch, small, text_udf, written

BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.float64)
#: Where the ring's segments begin, counted from the highest bit, and how wide they are.
STARTS, WIDTHS = (0, 13, 26, 39, 52), (13, 13, 13, 13, 12)
#: Points within 2 bits of a fingerprint. Buckets with a larger minority than DENSE are linked by these points, smaller
#: ones by a join, which compares a member with no more others than it has points.
BALL = 1 + 64 + 64 * 63 // 2
DENSE = BALL
#: Fingerprints in a task that gives each its 64 bucket keys.
NODES_A_TASK = 16384
#: Rows of the sample that tells common shingles, how many of them make one common, and the most that are taken from it.
SAMPLE, COMMON, MOST_COMMON = 8192, 4, 1 << 17
#: Sets that share a shingle of their prefixes from which on it is moved to the end of the order, and the most such shingles
#: that are broadcast; more meet the sets in a join.
CROWD, MOST_LATE = 128, 1 << 20


def shingle_hashes(text: str | None, words: int, seed: int) -> list[int]:
    found = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: ASCII only
    if not found:
        return []
    joined = b" ".join(found)
    if len(found) <= words:
        return [xxhash.xxh64_intdigest(joined, seed)]
    ends = np.cumsum([len(w) + 1 for w in found]) - 1
    starts = [0, *(ends[: -words] + 1).tolist()]
    digest = xxhash.xxh64_intdigest
    return [digest(joined[a:b], seed) for a, b in zip(starts, ends[words - 1 :].tolist())]


def fingerprints(texts: list[str | None], words: int = 4, seed: int = 42) -> np.ndarray:
    """A bit is 1 if it is set in over half of the shingles' hashes, repeats included."""
    return majorities([np.array(shingle_hashes(x, words, seed), np.uint64) for x in texts])


def majorities(held: list[np.ndarray]) -> np.ndarray:
    """For each array of hashes (unsigned) the bits that are set in over half of them."""
    out = np.zeros(len(held), np.uint64)
    for first in range(0, len(held), 256):
        hashes = held[first : first + 256]
        sizes = np.array([len(h) for h in hashes])
        flat = np.concatenate(hashes)
        row = np.repeat(np.arange(len(hashes)), sizes)
        octets = flat.astype(">u8").view(np.uint8).reshape(-1, 8).astype(np.int64)
        counts = np.empty((len(hashes), 8, 8))
        for k in range(8):
            counts[:, k] = np.bincount(row * 256 + octets[:, k], minlength=256 * len(hashes)).reshape(-1, 256).astype(np.float64) @ BITS
        ones = (2 * counts.reshape(-1, 64) > sizes[:, None]).astype(np.uint8)
        out[first : first + 256] = np.packbits(ones, axis=1).view(">u8").ravel()
    return out


def simhash(words: int = 4, seed: int = 42):
    """A column function: text -> fingerprint, as a signed 64-bit integer."""

    @text_udf("bigint")
    def fingerprint(text: pa.Array) -> pa.Array:
        return pa.array(fingerprints(text.to_pylist(), words, seed).view(np.int64))

    return fingerprint


def _ring(fp: str, start: str) -> str:
    """fp turned so that the segment at bit `start` comes first."""
    return f"(shiftleft({fp}, {start}) | shiftrightunsigned({fp}, 64 - {start}))"


def _pair(x: str, y: str, key: str) -> str:
    """SQL: x and y are linked, and the bucket `key` is the first that holds them: the first segment that starts a chain
    within all budgets, and the bit in which the next segment differs (0 if in none). So a pair is given once."""
    z, i, p = f"({x} ^ {y})", f"cast({key} % 5 as int)", f"cast({key} div 5 % 13 as int)"
    upto = lambda k, n: f"shiftrightunsigned({_ring(z, str(STARTS[k]))}, {64 - sum((WIDTHS * 2)[k : k + n])})"
    chains = " ".join(f"when {' and '.join(f'bit_count({upto(k, n)}) <= {4 * n // 5}' for n in range(1, 5))} then {k}" for k in range(5))
    two = f"case {i} {' '.join(f'when {k} then {upto(k, 2)}' for k in range(5))} end"
    return f"{i} = case {chains} end and {two} = if({p} = 0 and {two} = 0, 0L, shiftleft(1L, {p})) and bit_count({z}) <= 4"


def _stars(edges: DataFrame) -> tuple[DataFrame, tuple]:
    """edges (a > b), written, and what tells whether they changed."""
    edges = written(edges.distinct())
    state = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    return edges, tuple(state)


def components(edges: DataFrame) -> DataFrame:
    """node, root (the smallest node reachable) for every node of edges (a, b): alternating large and small stars. Each
    round is two grouped minima, written and joined back, so one node with many links is no single task's work."""
    edges = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    edges, state = _stars(edges)
    while state[0]:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = written(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")))
        large = written(both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct())
        least = written(large.groupBy("a").agg(F.min("b").alias("m")))
        small = large.join(least, "a")
        small = small.select(F.greatest("b", "m").alias("a"), F.col("m").alias("b")).where("a <> b").unionByName(least.select("a", F.col("m").alias("b")))
        edges, new = _stars(small)
        if new == state:
            break
        state = new
    roots = edges.groupBy("a").agg(F.min("b").alias("root"))
    return written(roots.select(F.col("a").alias("node"), "root").unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()))


def links(nodes: DataFrame) -> DataFrame:
    """fp, root for distinct fingerprints `fp` (written): the smallest fingerprint reachable by links."""
    tasks = -(-nodes.count() // NODES_A_TASK) or 1
    start, width = (f"element_at(array({', '.join(map(str, v))}), i + 1)" for v in (STARTS, WIDTHS * 2))
    following = width.replace("i + 1", "i + 2")
    ringed = nodes.select("fp", F.explode(F.expr("sequence(0, 4)")).alias("i"))
    held = ringed.select("fp", F.expr(f"shiftrightunsigned({_ring('fp', start)}, 64 - {width} - {following}) * 5 + i").alias("key"))
    hubs = written(held.groupBy("key").agg(F.min("fp").alias("hub"), F.count("*").alias("n")).where("n > 1").select("key", "hub"))
    near = held.join(hubs, "key").where("fp <> hub and bit_count(fp ^ hub) <= 4").select(F.col("fp").alias("a"), F.col("hub").alias("b"))
    first = components(near)
    marked = written(nodes.select("fp").join(first.withColumnRenamed("node", "fp"), "fp", "left").select("fp", F.coalesce("root", "fp").alias("root")))

    # Every bucket: segment i equal, the next equal but for bit p.
    spread = marked.repartition(tasks, "fp").select("fp", "root", F.explode(F.expr("transform(sequence(0, 64), j -> struct(cast(j div 13 as int) as i, cast(j % 13 as int) as p))")).alias("j")).select("fp", "root", F.col("j.i").alias("i"), F.col("j.p").alias("p")).where(f"p < {following}")
    bucket = f"shiftrightunsigned({_ring('fp', start)}, 64 - {width} - {following}) & ~shiftleft(1L, p)"
    spread = spread.select("fp", "root", F.expr(f"(({bucket}) * 13 + p) * 5 + i").alias("key"))
    mixed = spread.groupBy("key").agg(F.min("root").alias("x"), F.max("root").alias("y"), F.min("fp").alias("a"), F.max("fp").alias("b"), F.count("*").alias("n"))
    mixed = written(mixed.where("x < y"))
    twos = mixed.where("n = 2 and " + _pair("a", "b", "key")).select(F.col("x").alias("a"), F.col("y").alias("b"))
    members = written(spread.join(written(mixed.where("n > 2").select("key")), "key"))
    share = written(members.groupBy("key", "root").agg(F.count("*").alias("n")))
    major = share.groupBy("key").agg(F.max(F.struct("n", "root")).alias("m"), F.sum("n").alias("n"))
    major = written(major.select("key", F.col("m.root").alias("major"), (F.col("n") - F.col("m.n")).alias("others")))
    minor = written(members.join(major.where(f"others <= {DENSE}"), "key").where("root <> major").select("key", "major", F.col("fp").alias("fp2"), F.col("root").alias("root2")))
    across = members.join(minor, "key").where("root <> root2 and (root = major or fp < fp2) and " + _pair("fp", "fp2", "key"))
    dense = written(members.join(major.where(f"others > {DENSE}").select("key"), "key").select("fp", "root").distinct())
    edges = across.select(F.col("root").alias("a"), F.col("root2").alias("b")).unionByName(twos).unionByName(_met(dense))
    joined = components(edges)
    second = marked.join(joined.select(F.col("node").alias("root"), F.col("root").alias("top")), "root", "left")
    return written(second.select("fp", F.coalesce("top", "root").alias("root")))


def _met(dense: DataFrame) -> DataFrame:
    """Edges (a, b) between roots of linked fingerprints in `dense` (fp, root; written). Two fingerprints differ in at most
    4 bits if and only if some point is within 2 bits of both. So each gives the BALL points around it, and those that
    meet in a point are linked to the least of them: linear in fingerprints, however near each other they are. At most
    BALL fingerprints meet in a point, which bounds its set."""
    flips = "flatten(transform(sequence(0, 64), a -> transform(sequence(least(a + 1, 64), 64), b -> fp ^ if(a < 64, shiftleft(1L, a), 0L) ^ if(b < 64, shiftleft(1L, b), 0L))))"
    tasks = -(-dense.count() * BALL // (64 * NODES_A_TASK)) or 1
    points = dense.repartition(tasks, "fp").select("root", F.explode(F.expr(flips)).alias("point"))
    met = points.groupBy("point").agg(F.collect_set("root").alias("roots")).where("size(roots) > 1")
    return met.select(F.explode("roots").alias("a"), F.array_min("roots").alias("b")).where("a <> b").distinct()


def near_duplicates(documents: DataFrame, key: str = "doc_id", text: str = "text", words: int = 4, seed: int = 42) -> DataFrame:
    """doc_id, fp, component_id for each row of documents."""
    with scratch(documents.sparkSession) as keep:
        marked = written(documents.select(F.col(key).alias("doc_id"), simhash(words, seed)(F.col(text)).alias("fp")))
        nodes = written(marked.groupBy("fp").agg(F.min("doc_id").alias("first")))
        roots = links(nodes)
        named = written(nodes.join(roots, "fp"))
        least = written(named.groupBy("root").agg(F.min("first").alias("component_id")))
        by_fp = written(named.select("fp", "root").join(least, "root").select("fp", "component_id"))
        return keep(written(marked.join(by_fp, "fp").select("doc_id", "fp", "component_id")))


def shingle_set(text: str | None, words: int, seed: int) -> np.ndarray:
    """The distinct shingle hashes of a text, sorted."""
    return np.unique(np.array(shingle_hashes(text, words, seed), np.uint64).view(np.int64))


def _arrays(found: list[np.ndarray]) -> pa.Array:
    offsets = np.concatenate(([0], np.cumsum([len(x) for x in found], dtype=np.int64))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([np.zeros(0, np.int64), *found])))


def shingle_sets(words: int = 5, seed: int = 42):
    """A column function: text -> sig (128 bits of its shingle set) and held, the distinct shingle hashes."""

    @text_udf("struct<sig: binary, held: array<bigint>>")
    def sets(text: pa.Array) -> pa.Array:
        found = [shingle_set(x, words, seed) for x in text.to_pylist()]
        return pa.StructArray.from_arrays([pa.array([xxhash.xxh128_digest(x.tobytes(), seed) for x in found], pa.binary()), _arrays(found)], ["sig", "held"])

    return sets


def prefixes(spark: SparkSession, common: np.ndarray, words: int, share: float, seed: int):
    """A column function: text -> sig (128 bits of its shingle set), its fingerprint fp (each shingle once), size, and the set's
    prefix, common shingles last."""
    held = spark.sparkContext.broadcast(common)

    @text_udf("struct<sig: binary, fp: bigint, size: int, prefix: array<bigint>>")
    def prefix(text: pa.Array) -> pa.Array:
        sets = [shingle_set(x, words, seed) for x in text.to_pylist()]
        flat, common = np.concatenate([np.zeros(0, np.int64), *sets]), held.value
        at = np.searchsorted(common, flat)
        at[at == len(common)] = 0
        last = common[at] == flat if len(common) else np.zeros(len(flat), bool)
        rare_first, end = [], 0
        for own in sets:
            begin, end = end, end + len(own)
            late = last[begin:end]
            rare_first.append(np.concatenate((own[~late], own[late]))[: len(own) - int(np.ceil(share * len(own) - 1e-9)) + 1])
        sigs = pa.array([xxhash.xxh128_digest(own.tobytes(), seed) for own in sets], pa.binary())
        fps = pa.array(majorities([own.view(np.uint64) for own in sets]).view(np.int64))
        return pa.StructArray.from_arrays([sigs, fps, pa.array([len(own) for own in sets], pa.int32()), _arrays(rare_first)], ["sig", "fp", "size", "prefix"])

    return prefix


def common_shingles(documents: DataFrame, text: str, words: int, seed: int) -> np.ndarray:
    """Shingles that COMMON or more distinct texts of a sample hold. It only sets an order, so no result depends on it."""
    parts = -(-documents.count() // SAMPLE) or 1
    read = documents.select(F.xxhash64(text).alias("mark"), F.col(text).alias("text")).where(f"pmod(mark, {parts}) = 0").dropDuplicates(["mark"])
    each = read.select("mark", shingle_sets(words, seed)(F.col("text")).alias("s")).select("mark", F.explode("s.held").alias("hash")).distinct()
    found = each.groupBy("hash").count().where(f"count >= {COMMON}").orderBy(F.desc("count"), "hash").limit(MOST_COMMON)
    return np.sort(found.select("hash").toArrow()["hash"].to_numpy())


def _uncrowded(spark: SparkSession, sets: DataFrame, common: np.ndarray, texts_of, words: int, share: float, seed: int) -> DataFrame:
    """sets (node, size, prefix) with prefixes cut anew until no shingle that could stand elsewhere is in more than CROWD of
    them. Of texts that have such a shingle in their prefixes all shingles are counted; those that more than CROWD of them hold
    become late: they move to the end of the order, and every set with one of them in its prefix is cut anew, so all sets
    keep to one order. A group of texts that are alike, but less than `share`, so meets in what each has of its own, which is
    nothing, and not in what all have. Each round makes at least one more shingle late; a few rounds will do, as the first
    counts whole texts. Shingles that stay crowded are those of texts with little else: near copies, which find their hub."""
    late = written(spark.createDataFrame(pa.table({"hash": pa.array(common, pa.int64())})))
    while True:
        flat = sets.select("node", F.explode("prefix").alias("hash"))
        crowded = written(flat.groupBy("hash").count().where(f"count > {CROWD}").select("hash").join(late, "hash", "left_anti"))
        if not crowded.take(1):
            return sets
        crowd = written(flat.join(small(crowded), "hash").select("node").distinct())
        each = texts_of(crowd, shingle_sets(words, seed), "held").select(F.explode("held").alias("hash"))
        more = written(each.groupBy("hash").count().where(f"count > {CROWD}").select("hash").union(crowded).distinct().join(late, "hash", "left_anti"))
        late = written(late.unionByName(more))
        touched = written(flat.join(small(more), "hash").select("node").distinct())
        if late.count() <= MOST_LATE:
            order = np.sort(late.toArrow()["hash"].to_numpy())
            anew = texts_of(touched, prefixes(spark, order, words, share, seed), "size", "prefix")
        else:
            whole = texts_of(touched, shingle_sets(words, seed), "held")
            marked = whole.select("node", F.explode_outer("held").alias("hash")).join(late.withColumn("late", F.lit(True)), "hash", "left")
            ordered = F.array_sort(F.collect_list(F.when(F.col("hash").isNotNull(), F.struct(F.coalesce("late", F.lit(False)).alias("late"), "hash"))))  # one text's
            anew = marked.groupBy("node").agg(ordered.alias("o")).select("node", F.size("o").alias("size"), F.expr(f"transform(slice(o, 1, size(o) - cast(ceil({share!r}D * size(o) - 1e-9) as int) + 1), x -> x.hash)").alias("prefix"))
        sets = written(sets.join(small(touched), "node", "left_anti").unionByName(anew.select("node", "size", "prefix")))


def near_copies(documents: DataFrame, key: str = "doc_id", text: str = "text", words: int = 5, share: float = 0.8, seed: int = 42) -> DataFrame:
    """doc_id, component_id for each row of documents. Two texts are linked if the Jaccard similarity of their sets of
    shingles (64-bit hashes) is `share` or more; no other link is made and none is lost. See _near_copies."""
    with scratch(documents.sparkSession) as keep:
        return keep(written(_near_copies(documents, key, text, words, share, seed)))


def _by_fingerprint(nodes: DataFrame) -> DataFrame:
    """Pairs (a, b; distinct, written) of nodes (node, fp; written): each with the first of those that its fingerprint is
    linked to, directly or by others. Linear, however many are linked."""
    with scratch(nodes.sparkSession) as keep:
        prints = written(nodes.groupBy("fp").agg(F.min("node").alias("hub"), F.count("*").alias("n")))
        named = written(prints.join(links(prints), "fp"))
        hubs = written(named.groupBy("root").agg(F.min("hub").alias("hub"), F.sum("n").alias("n")).where("n > 1").select("root", "hub"))
        by_fp = written(named.select("fp", "root").join(hubs, "root").select("fp", "hub"))
        return keep(written(nodes.select("node", "fp").join(by_fp, "fp").where("node <> hub").select(F.col("hub").alias("a"), F.col("node").alias("b"))))


def _near_copies(documents: DataFrame, key: str, text: str, words: int, share: float, seed: int) -> DataFrame:
    """Each distinct set has a fingerprint of its shingles, and fingerprints are linked to components as those of near_duplicates
    are, by pigeonring. A component's members are checked against its first on the whole sets; those that are similar are
    linked to it. Fingerprints of similar sets differ in more than 4 bits as a rule (10 at a similarity of 0.8), and members
    of a long chain need not be similar, so what they leave is looked for exactly:

    In any one order of all shingles, two such sets of n and m shingles share one, and the first that they share has at
    most n - share / (1 + share) * (n + m) before it in the set of n, and likewise in that of m: an equi-join on prefixes
    finds every pair. The order puts shingles that a sample finds common last, so a line that many texts hold makes few
    candidates, and then those that crowd (see _uncrowded). Candidates are thinned by a bound from the two prefixes, then decided
    on the whole sets.
    Equal sets are one node. Nodes not linked by their fingerprints are first compared with one member of each bucket, that with fewest rare
    shingles (it is the most like the others), and joined to components; then members outside a bucket's largest component look for
    partners in it. In a dense group few are left by then, as each that can have a partner has met the one most alike.

    Defined cases: null and wordless texts are equal sets (empty ones) and linked; a text of fewer words than a shingle is
    one shingle. Repeated rows share a component. A component's id is its smallest non-null key. Empty table: empty result."""
    spark = documents.sparkSession
    common = common_shingles(documents, text, words, seed)
    made = prefixes(spark, common, words, share, seed)
    marked = documents.select(F.col(key).alias("doc_id"), F.xxhash64(text).alias("mark"), made(F.col(text)).alias("p"))
    marked = written(marked.select("doc_id", "mark", "p.*", F.monotonically_increasing_id().alias("row")))
    nodes = written(marked.groupBy("sig").agg(F.min("row").alias("node"), F.min("doc_id").alias("first"), F.min("mark").alias("mark"), F.min("fp").alias("fp"), F.count("*").alias("n")))
    again = written(marked.select("row", "sig").join(nodes.where("n > 1").select("sig", "node"), "sig").where("row <> node").select("row"))
    sets = marked.select(F.col("row").alias("node"), "size", "prefix").join(small(again).withColumnRenamed("row", "node"), "node", "left_anti")
    most = lambda n, m: f"{n} - {share / (1 + share)!r}D * ({n} + {m}) + 1e-6"

    def overlapping(pairs: DataFrame, sets: DataFrame, beyond: str) -> DataFrame:
        """The pairs whose sets' overlap, and what may lie beyond the arrays at hand, reach the share."""
        a, b = (sets.select(F.col("node").alias(x), F.col("size").alias(f"n{x}"), F.col("held").alias(f"s{x}")) for x in "ab")
        reached = f"{1 + share}D * (size(array_intersect(sa, sb)) + {beyond}) >= {share}D * (na + nb) - 1e-6"
        return written(pairs.join(a, "a").join(b, "b").where(f"na >= {share}D * nb - 1e-6 and nb >= {share}D * na - 1e-6 and {reached}").select("a", "b"))

    def similar(pairs: DataFrame) -> DataFrame:
        """The pairs (a, b; distinct, written) of similar sets."""
        wanted = lambda df: written(df.select(F.explode(F.array("a", "b")).alias("node")).distinct())
        short = written(sets.join(small(wanted(pairs)), "node", "left_semi").select("node", "size", F.col("prefix").alias("held")))
        pairs = overlapping(pairs, short, "greatest(na - size(sa), nb - size(sb))")
        whole = texts_of(wanted(pairs), shingle_sets(words, seed), "held")
        return overlapping(pairs, whole.select("node", F.size("held").alias("size"), "held"), "0")

    def texts_of(wanted: DataFrame, read, *columns: str) -> DataFrame:
        """node and what the column function `read` gives for its text, for the nodes of wanted (written)."""
        marks = written(nodes.join(small(wanted), "node", "left_semi").select("node", "sig", "mark"))
        texts = documents.select(F.xxhash64(text).alias("mark"), F.col(text).alias("text")).join(small(marks.select("mark")), "mark", "left_semi")
        whole = texts.select(read(F.col("text")).alias("s")).select("s.*").dropDuplicates(["sig"])
        return written(whole.join(marks.select("node", "sig"), "sig").select("node", *columns))

    linked = similar(_by_fingerprint(nodes))
    known = components(linked)
    sets = _uncrowded(spark, sets, common, texts_of, words, share, seed)
    flat = sets.select("node", "size", F.posexplode("prefix").alias("at", "hash"))
    shared = written(flat.groupBy("hash").count().where("count > 1").select("hash"))
    members = written(flat.join(shared, "hash"))
    buckets = written(members.groupBy("hash").agg(F.min(F.struct("at", "size", "node")).alias("hub"), F.min("size").alias("least")))
    members = members.join(buckets, "hash").where(f"at <= {most('size', f'greatest({share}D * size, least)')}")
    members = written(members.select("hash", "node", "size", "at", "hub"))
    fit = lambda n, m, i, j: f"{n} >= {share}D * {m} - 1e-6 and {m} >= {share}D * {n} - 1e-6 and {i} <= {most(n, m)} and {j} <= {most(m, n)}"
    near = members.where("node <> hub.node and " + fit("size", "hub.size", "at", "hub.at"))
    near = near.select(F.least("node", "hub.node").alias("a"), F.greatest("node", "hub.node").alias("b")).distinct()
    for x in "ab":
        near = near.join(small(known).select(F.col("node").alias(x), F.col("root").alias(f"r{x}")), x, "left")
    near = similar(written(near.where("ra is null or rb is null or ra <> rb").select("a", "b")))
    first = components(near.unionByName(linked))
    rooted = written(nodes.select("node", "sig", "first").join(first, "node", "left").select("node", "sig", "first", F.coalesce("root", "node").alias("root")))
    members = written(members.join(rooted.select("node", "root"), "node").select("hash", "node", "size", "at", "root"))
    mixed = written(members.groupBy("hash").agg(F.min("root").alias("x"), F.max("root").alias("y")).where("x < y").select("hash"))
    members = written(members.join(mixed, "hash"))
    held = written(members.groupBy("hash", "root").agg(F.count("*").alias("n")))
    major = written(held.groupBy("hash").agg(F.max(F.struct("n", "root")).alias("m")).select("hash", F.col("m.root").alias("major")))
    minor = written(members.join(major, "hash").where("root <> major").select("hash", "major", F.col("node").alias("node2"), F.col("size").alias("size2"), F.col("at").alias("at2"), F.col("root").alias("root2")))
    across = members.join(minor, "hash").where("root <> root2 and (root = major or node < node2) and " + fit("size", "size2", "at", "at2"))
    across = similar(written(across.select(F.least("node", "node2").alias("a"), F.greatest("node", "node2").alias("b")).distinct()))
    root = lambda x: rooted.select(F.col("node").alias(x), F.col("root").alias(f"r{x}"))
    joined = components(across.join(root("a"), "a").join(root("b"), "b").select(F.col("ra").alias("a"), F.col("rb").alias("b")))
    named = written(rooted.join(joined.select(F.col("node").alias("root"), F.col("root").alias("top")), "root", "left").select("sig", "first", F.coalesce("top", "root").alias("root")))
    least = written(named.groupBy("root").agg(F.min("first").alias("component_id")))
    by_sig = written(named.select("sig", "root").join(least, "root").select("sig", "component_id"))
    return marked.select("doc_id", "sig").join(by_sig, "sig").select("doc_id", "component_id")
