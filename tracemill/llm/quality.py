"""Quality: an interpolated modified Kneser-Ney n-gram model of trusted text, and perplexities by sharded count joins.

The n-grams are of UTF-8 bytes (order 5), so no two characters share a symbol; case and punctuation are kept. They are
counted per model over all trusted documents in full. An n-gram is one 64-bit key: model, then eight bits a symbol.
Counts are summed by Spark; lower orders are continuation counts (distinct left neighbours); discounts D1, D2, D3+ come
from counts of counts by model and order. Joins of each order with its contexts and its suffix give, for each n-gram seen,
its interpolated probability and, for each context, its back-off weight.

Documents are scored by joins. A shard of the documents is a file, or part of one: each task gives the distinct n-grams of
its shards, which Spark makes distinct over all shards and joins with the model, order by order, those not yet met backing off
to their suffixes. The log-probabilities go back to the shards that asked for them, where the texts meet them: per document
the sum of count times log-probability. Nothing of the model passes through the driver, no table is broadcast that Spark has
not found small, and the passes over documents are a fixed few, whatever the model's size. An n-gram asked for by every shard is a hot
key of the last join; its other side has one row a key, so AQE can split it.

A document is kept if its perplexity (by character) lies between two quantiles of the trusted documents' perplexities in its
language (too high: noise; too low: repetition). No text is scored by a model that learned it: documents are dealt into FOLDS
parts by a hash of the text, so that copies stay together, and each part is scored by the counts of the trusted texts
of the others; each language has a model a part. So the quantiles are those of unseen good text.

Defined cases: a null lang counts as the language `und`. A null or empty text has null perplexity and is not kept. A
document whose language has no trusted text in the other parts has null perplexity, and is kept: nothing speaks against
it; likewise where no trusted document of the language could be scored. Repeated rows are answered each, with their own
n_chars. An empty table gives an empty result. Of the columns of documents only doc_id, lang and text are read, of labels
doc_id and those of the condition, so others may have any names. Rows of labels with null ids, or for ids without documents,
do nothing. Texts are read whole. More than 8191 models (languages times parts) are refused with a ValueError."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracemill.llm.base import scratch, small, small_batches, written

ORDER, BITS = 5, 8
SYMBOLS = 1 << BITS
#: The symbol before a text's first byte; UTF-8 has no such byte.
START = 255
UND = "und"
#: Parts of the documents, by a hash of the text; each is scored by a model of the trusted texts in the others.
FOLDS = 2
#: Bytes of text that one numpy step works on.
WINDOW = 1 << 19
#: Bytes of text that share a table of n-grams.
SHARD_BYTES = 64 << 20
#: n-grams that a task holds before it makes them distinct.
HELD = 2_000_000
#: n-grams that a task remembers to have asked for, by a hash: most of a text's are among the last ones met.
SEEN, SEEN_SHARDS = 1 << 17, 64
#: Answers that move together.
BUNDLE = 1 << 14
FREE = np.uint64(0xFFFFFFFFFFFFFFFF)


def spans(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a column of texts in a row, and where each text begins and the last ends. A null is empty."""
    texts = texts.fill_null("")
    ends = np.frombuffer(texts.buffers()[1], np.int64 if pa.types.is_large_string(texts.type) else np.int32)[texts.offset : texts.offset + len(texts) + 1]
    held = texts.buffers()[2]
    data = np.frombuffer(held, np.uint8)[ends[0] : ends[-1]] if held is not None and len(texts) else np.zeros(0, np.uint8)
    return data, ends.astype(np.int64) - (int(ends[0]) if len(texts) else 0)


def windows(data: np.ndarray, ends: np.ndarray):
    """(a, b, grams): the n-gram that ends at each byte from a to b, symbols before its text's first byte being START."""
    starts = ends[:-1]
    sizes = np.diff(ends)
    for a in range(0, len(data), WINDOW):
        b = min(len(data), a + WINDOW)
        before = data[max(0, a - ORDER + 1) : b]
        s = np.concatenate((np.zeros(ORDER - 1 + b - a - len(before), np.uint8), before)).astype(np.uint64)
        out = np.zeros(b - a, np.uint64)
        for k in range(ORDER):
            out = (out << np.uint64(BITS)) | s[k : k + b - a]
        for j in range(ORDER - 1):  # the j-th byte of a text has j symbols of its text before it
            at = starts[sizes > j] + j
            at = at[(at >= a) & (at < b)] - a
            pad = sum(START << (BITS * k) for k in range(j + 1, ORDER))
            out[at] = (out[at] & np.uint64((1 << (BITS * (j + 1))) - 1)) | np.uint64(pad)
        yield a, b, out


def summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(keys):
        return keys, counts
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    return keys[first], np.add.reduceat(counts, first)


def models(trusted: DataFrame) -> dict[tuple[str, int], int]:
    """Numbers of the models: one for each language and part of which trusted (lang, part) text outside the part is known."""
    most = 8191
    found = trusted.select("lang", "part").distinct().limit(most + 1).collect()
    pairs = sorted({(r.lang, k) for r in found for k in range(FOLDS) if k != r.part})
    if len(pairs) > most:
        raise ValueError(f"more than {most} models")
    return {x: i for i, x in enumerate(pairs)}


def counted(trusted: DataFrame, number: dict[tuple[str, int], int]) -> DataFrame:
    """gram, n over trusted (lang, part, text): counts of n-grams by model, summed in each task before the shuffle. A text
    counts in its language's models of the other parts."""
    small_batches(trusted.sparkSession)

    def count(batches):
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0
        for batch in batches:
            data, ends = spans(batch.column(2))
            sizes = np.diff(ends)
            for k in range(FOLDS):
                keys = zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())
                mine = np.repeat(np.array([-1 if p == k else number[lang, k] for lang, p in keys], np.int64), sizes)
                for a, b, g in windows(data, ends):
                    m = mine[a:b]
                    g = g[m >= 0] | (m[m >= 0].astype(np.uint64) << np.uint64(ORDER * BITS))
                    held.append(summed(g, np.ones(len(g), np.int64)))
                    size += len(held[-1][0])
            if size > HELD:
                held = [summed(*map(np.concatenate, zip(*held)))]
                size = len(held[0][0]) // 2
        if held:
            keys, n = summed(*map(np.concatenate, zip(*held)))
            for at in range(0, len(keys), 1 << 16):
                yield pa.RecordBatch.from_arrays([pa.array(keys[at : at + (1 << 16)].view(np.int64)), pa.array(n[at : at + (1 << 16)])], ["gram", "n"])

    return trusted.select("lang", "part", "text").where("text is not null").mapInArrow(count, "gram bigint, n bigint").groupBy("gram").agg(F.sum("n").alias("n"))


def _suffix(gram: str, n: int) -> str:
    return f"(shiftleft(shiftright({gram}, {BITS * n}), {BITS * (n - 1)}) | ({gram} & {(1 << (BITS * (n - 1))) - 1}))"


def model(counts: DataFrame) -> dict[int, tuple[DataFrame, DataFrame]]:
    """By order n, the frames (gram, logp) of n-grams and (gram, logb) of their contexts: the natural logarithm of an n-gram's
    interpolated probability and of a context's back-off weight. A gram has its model above the symbols of its order."""
    lang = lambda n: f"shiftright(gram, {BITS * n})"
    levels = {ORDER: written(counts.select("gram", "n"))}
    for n in range(ORDER - 1, 0, -1):  # continuation counts: drop the first symbol
        shorter = f"(shiftleft(shiftright(gram, {BITS * (n + 1)}), {BITS * n}) | (gram & {(1 << (BITS * n)) - 1}))"
        levels[n] = written(levels[n + 1].select(F.expr(shorter).alias("gram")).groupBy("gram").agg(F.count("*").alias("n")))
    lower = None
    out = []
    for n in range(1, ORDER + 1):
        level = levels[n].withColumn("lang", F.expr(lang(n)))
        stats = level.groupBy("lang").agg(*[F.sum(F.when(F.col("n") == k, 1).otherwise(0)).alias(f"n{k}") for k in range(1, 5)])
        y = "n1 / greatest(n1 + 2 * n2, 1)"
        d = [f"if(n{k} = 0, {k} * 0.5D, greatest(least({k} - {k + 1} * ({y}) * n{k + 1} / nullif(n{k}, 0), {k} * 0.95D), 0.05D))" for k in (1, 2, 3)]
        stats = stats.select("lang", *[F.expr(x).cast("double").alias(f"d{k}") for k, x in enumerate(d, 1)])
        level = level.join(F.broadcast(stats), "lang").withColumn("d", F.expr("case n when 1 then d1 when 2 then d2 else d3 end"))
        level = level.withColumn("context", F.shiftright("gram", BITS))
        totals = level.groupBy("context").agg(F.sum("n").alias("total"), F.sum("d").alias("off"))
        joined = level.join(totals, "context")
        if n == 1:
            p = F.expr(f"(n - d) / total + off / total / {SYMBOLS}")
        else:
            joined = joined.withColumn("suffix", F.expr(_suffix("gram", n))).join(lower, "suffix")
            p = F.expr("(n - d) / total + off / total * q")
        probs = written(joined.select("gram", p.alias("p")))
        backoff = written(totals.select(F.col("context").alias("gram"), F.log(F.col("off") / F.col("total")).alias("logb")))
        lower = probs.select(F.col("gram").alias("suffix"), F.col("p").alias("q"))
        out.append((probs, backoff))
    return {n: (probs.select("gram", F.log("p").alias("logp")), backoff) for n, (probs, backoff) in enumerate(out, 1)}


class Table:
    """Keys to values, by open addressing in numpy arrays."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        size = 1 << max(4, int(2 * len(keys)).bit_length())
        self.shift = np.uint64(64 - size.bit_length() + 1)
        self.mask = np.uint64(size - 1)
        self.keys = np.full(size, FREE)
        self.values = np.zeros(size, np.float32)
        left, at = np.arange(len(keys)), self._home(keys)
        while len(left):
            free = self.keys[at] == FREE
            self.keys[at[free]] = keys[left[free]]
            won = self.keys[at] == keys[left]
            self.values[at[won]] = values[left[won]]
            left, at = left[~won], (at[~won] + np.uint64(1)) & self.mask

    def _home(self, keys: np.ndarray) -> np.ndarray:
        return (keys * np.uint64(0x9E3779B97F4A7C15)) >> self.shift

    def get(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(found, values or 0)."""
        at = self._home(keys)
        met = self.keys[at]
        found = met == keys
        out = np.where(found, self.values[at], np.float32(0))
        left = np.flatnonzero(~found & (met != FREE))
        at = at[left]
        while len(left):
            at = (at + np.uint64(1)) & self.mask
            met = self.keys[at]
            hit = met == keys[left]
            found[left[hit]] = True
            out[left[hit]] = self.values[at[hit]]
            go = ~hit & (met != FREE)
            left, at = left[go], at[go]
        return found, out


def sharded(documents: DataFrame) -> DataFrame:
    """documents (doc_id, text, ...) with a column shard: the file that a row is read from (rows of other frames are as of one
    file), cut by a hash of id and text as often as leaves SHARD_BYTES a shard, were the largest file's texts spread evenly.
    This depends on the data alone, not on the splits, which may differ between scans."""
    largest = documents.groupBy(F.input_file_name()).agg(F.sum(F.octet_length("text")).alias("n")).agg(F.max("n")).first()[0] or 0
    cut = F.pmod(F.xxhash64("doc_id", "text"), F.lit(max(1, -(-largest // SHARD_BYTES))))
    return documents.withColumn("shard", F.xxhash64(F.input_file_name(), cut))


def _keys(batch: pa.RecordBatch, number: dict[tuple[str, int], int]) -> np.ndarray:
    """The number of each row's model, -1 where there is none. batch: ..., lang, part, text as the last columns."""
    lang, part = (batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("lang", "part"))
    return np.array([number.get(x, -1) for x in zip(lang, part)], np.int64)


def asked(documents: DataFrame, number: dict[tuple[str, int], int]) -> DataFrame:
    """shard, gram: the distinct n-grams of each shard of documents (shard, lang, part, text), with their models. A shard that
    several tasks hold, or one task in several rounds, may give an n-gram more than once."""
    small_batches(documents.sparkSession)

    def ask(batches):
        held: dict[int, list[np.ndarray]] = {}
        seen: dict[int, np.ndarray] = {}
        size = 0

        def out():
            for at, arrays in held.items():
                keys = np.unique(np.concatenate(arrays))
                for i in range(0, len(keys), 1 << 16):
                    part = keys[i : i + (1 << 16)].view(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), at)), pa.array(part)], ["shard", "gram"])
            held.clear()

        for batch in batches:
            data, ends = spans(batch.column(3))
            sizes = np.diff(ends)
            mine = np.repeat(_keys(batch, number), sizes)
            shards = batch.column(0).to_numpy()
            whole = np.repeat(shards, sizes)
            for a, b, g in windows(data, ends):
                g = g | (mine[a:b].astype(np.uint64) << np.uint64(ORDER * BITS))
                for at in np.unique(whole[a:b]):
                    if at not in seen:
                        if len(seen) == SEEN_SHARDS:
                            seen.clear()
                        seen[at] = np.full(SEEN, FREE)
                    some = g[(whole[a:b] == at) & (mine[a:b] >= 0)]
                    slot = (some * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - SEEN.bit_length() + 1)
                    new = seen[at][slot] != some
                    some = some[new]
                    seen[at][slot[new]] = some
                    some = np.unique(some)
                    held.setdefault(int(at), []).append(some)
                    size += len(some)
            if size > HELD:
                held.update({at: [np.unique(np.concatenate(arrays))] for at, arrays in held.items()})
                size = sum(len(x[0]) for x in held.values())
                if size > HELD // 2:
                    yield from out()
                    size = 0
        yield from out()

    return documents.select("shard", "lang", "part", "text").mapInArrow(ask, "shard bigint, gram bigint")


def resolved(grams: DataFrame, made: dict[int, tuple[DataFrame, DataFrame]]) -> DataFrame:
    """gram, logp: the interpolated log-probability of each of these n-grams of the highest order, seen or not. Each order in
    turn is joined; what it does not hold adds the back-off weight of its context and goes on with its suffix."""
    left = grams.select("gram", F.col("gram").alias("now"), F.lit(0.0).alias("sum"))
    parts = []
    for n in range(ORDER, 0, -1):
        probs, backoff = made[n]
        met = written(left.join(probs.withColumnRenamed("gram", "now"), "now", "left").select("gram", "now", "sum", "logp"))
        parts.append(met.where("logp is not null").select("gram", (F.col("sum") + F.col("logp")).alias("logp")))
        on = met.where("logp is null").withColumn("context", F.shiftright("now", BITS)).join(backoff.withColumnRenamed("gram", "context"), "context", "left")
        left = on.select("gram", F.expr(_suffix("now", n)).alias("now"), (F.col("sum") + F.coalesce("logb", F.lit(0.0))).alias("sum"))
    parts.append(left.select("gram", (F.col("sum") - float(np.log(SYMBOLS))).alias("logp")))
    return reduce(DataFrame.unionByName, parts)


def _stream(rows: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, rows.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_batch(rows)
    return sink.getvalue().to_pybytes()


def bundled(answers: DataFrame) -> DataFrame:
    """shard, rows: answers (shard, gram, logp) as compressed Arrow streams (step, logp), up to BUNDLE of a shard in each. They are sorted,
    and a gram is told by its distance from the one before, which takes a fraction of the bytes of a row each."""

    def bundle(batches):
        held: list[tuple[np.ndarray, ...]] = []
        size = 0

        def out():
            shards, grams, logp = map(np.concatenate, zip(*held))
            order = np.lexsort((grams, shards))
            shards, grams, logp = shards[order], grams[order], logp[order]
            edges = [0, *(np.flatnonzero(np.diff(shards)) + 1).tolist(), len(shards)]
            for first, end in zip(edges, edges[1:]):
                for a in range(first, end, BUNDLE):
                    b = min(end, a + BUNDLE)
                    rows = pa.RecordBatch.from_arrays([pa.array(np.diff(grams[a:b], prepend=0)), pa.array(logp[a:b])], ["step", "logp"])
                    yield pa.RecordBatch.from_arrays([pa.array([int(shards[a])]), pa.array([_stream(rows)], pa.binary())], ["shard", "rows"])
            held.clear()

        for batch in batches:
            if batch.num_rows:
                held.append(tuple(batch.column(c).to_numpy() for c in ("shard", "gram", "logp")))
                size += batch.num_rows
            if size > HELD // 2:
                yield from out()
                size = 0
        if held:
            yield from out()

    small_batches(answers.sparkSession)
    return answers.select("shard", "gram", F.col("logp").cast("float").alias("logp")).mapInArrow(bundle, "shard bigint, rows binary")


def packed(documents: DataFrame) -> DataFrame:
    """shard, rows: documents (shard, ...) as compressed Arrow streams, a shard's rows of a batch in each, to move few bytes."""
    names = [c for c in documents.columns if c != "shard"]

    def pack(batches):
        for batch in batches:
            shards = batch.column("shard").to_numpy()
            for at in np.unique(shards):
                rows = batch.select(names).filter(pa.array(shards == at))
                yield pa.RecordBatch.from_arrays([pa.array([int(at)]), pa.array([_stream(rows)], pa.binary())], ["shard", "rows"])

    small_batches(documents.sparkSession)
    return documents.mapInArrow(pack, "shard bigint, rows binary")


def answered(documents: DataFrame, made: dict[int, tuple[DataFrame, DataFrame]], number: dict[tuple[str, int], int]) -> DataFrame:
    """shard, rows: what the n-grams of documents (shard, lang, part, text) got from the model, bundled and written."""
    grams = written(asked(documents, number))
    return written(bundled(grams.join(resolved(grams.select("gram").distinct(), made), "gram")))


def perplexities(documents: DataFrame, made: dict[int, tuple[DataFrame, DataFrame]], number: dict[tuple[str, int], int]) -> DataFrame:
    """doc_id, lang, trusted, n, logp for each row of documents (doc_id, shard, lang, part, trusted, text). See told."""
    return told(documents, answered(documents, made, number), number)


def told(documents: DataFrame, answers: DataFrame, number: dict[tuple[str, int], int]) -> DataFrame:
    """doc_id, lang, trusted, n, logp for each row of documents (doc_id, shard, lang, part, trusted, text) from the answers to
    its n-grams: characters and log-probability, null where there is no model or no text. Rows of a shard follow its
    log-probabilities through a task, so that a task holds one shard's table and one batch of texts."""
    kind = dict(documents.dtypes)["doc_id"]
    texts = packed(documents.select("shard", "doc_id", "lang", "part", "trusted", "text"))
    union = answers.withColumn("doc", F.lit(False)).unionByName(texts.withColumn("doc", F.lit(True)))

    def score(batches):
        at, table, keys, values = None, None, [], []
        for batch in batches:
            edges = np.flatnonzero(np.diff(batch.column("shard").to_numpy())) + 1
            for a, b in zip([0, *edges], [*edges, batch.num_rows]):
                one = batch.slice(a, b - a)
                if not one.num_rows:
                    continue
                if one.column("shard")[0].as_py() != at:
                    at, table, keys, values = one.column("shard")[0].as_py(), None, [], []
                for blob in one.filter(pc.invert(one.column("doc"))).column("rows"):
                    for answers in pa.ipc.open_stream(blob.as_buffer()):
                        keys.append(np.cumsum(answers.column("step").to_numpy()).view(np.uint64))
                        values.append(answers.column("logp").to_numpy())
                for blob in one.filter(one.column("doc")).column("rows"):
                    if table is None:
                        table = _table(keys, values)
                        keys, values = [], []
                    for docs in pa.ipc.open_stream(blob.as_buffer()):
                        total, n = _scores(docs, _keys(docs, number), table)
                        yield pa.RecordBatch.from_arrays([*(docs.column(c) for c in ("doc_id", "lang", "trusted")), n, total], ["doc_id", "lang", "trusted", "n", "logp"])

    return union.repartition("shard").sortWithinPartitions("shard", "doc").mapInArrow(score, f"doc_id {kind}, lang string, trusted boolean, n bigint, logp double")


def _table(keys: list[np.ndarray], values: list[np.ndarray]) -> Table:
    if not keys:
        return Table(np.zeros(0, np.uint64), np.zeros(0, np.float32))
    found, first = np.unique(np.concatenate(keys), return_index=True)
    return Table(found, np.concatenate(values)[first])


def _scores(docs: pa.RecordBatch, model_of: np.ndarray, table: Table) -> tuple[pa.Array, pa.Array]:
    """For each text its log-probability, null where there is no text or no model (model_of is -1), and its characters."""
    data, ends = spans(docs.column("text"))
    mine = np.repeat(model_of, np.diff(ends))
    total, n = np.zeros(docs.num_rows), np.zeros(docs.num_rows, np.int64)
    for a, b, g in windows(data, ends):
        known = mine[a:b] >= 0
        met, logp = table.get(g[known] | (mine[a:b][known].astype(np.uint64) << np.uint64(ORDER * BITS)))
        if not met.all():
            raise RuntimeError("a row's shard was not the same in two scans")
        each = np.zeros(b - a)
        each[known] = logp
        cut = np.clip(ends, a, b) - a
        total += np.diff(np.concatenate(([0.0], np.cumsum(each)))[cut])
        n += np.diff(np.concatenate(([0], np.cumsum((data[a:b] & 0xC0) != 0x80)))[cut])
    return pa.array(total, pa.float64(), mask=(model_of < 0) | (n == 0)), pa.array(n)


def classified(documents: DataFrame, labels: DataFrame, trusted: Column | None = None, low: float = 0.002, high: float = 0.995) -> DataFrame:
    """doc_id, lang, n_chars, perplexity, low, high, keep for each row of documents. trusted: the condition on labels
    that makes a document trusted; the default is quality = 1."""
    with scratch(documents.sparkSession) as keep:
        ids = small(written(labels.where(F.col("quality") == 1 if trusted is None else trusted).select(F.col("doc_id").alias("i")).where("i is not null").distinct()))
        part = F.pmod(F.xxhash64("text"), F.lit(FOLDS)).cast("int").alias("part")
        docs = documents.select("doc_id", F.coalesce(F.col("lang"), F.lit(UND)).alias("lang"), "text", part)
        docs = sharded(docs)
        docs = docs.join(ids.withColumn("trusted", F.lit(True)), F.col("doc_id") == F.col("i"), "left").drop("i")
        docs = docs.withColumn("trusted", F.coalesce("trusted", F.lit(False)))
        good = docs.where("trusted and text is not null and text <> ''")
        number = models(good)
        with scratch(documents.sparkSession) as hold:  # before the texts move, the model and the n-grams are gone
            answers = hold(answered(docs, model(counted(good, number)), number))
        each = keep(written(told(docs, answers, number)))
    each = each.withColumn("perplexity", F.when(F.col("n") > 0, F.exp(-F.col("logp") / F.col("n"))))
    bounds = each.where("trusted and perplexity is not null").groupBy(F.col("lang").alias("l")).agg(F.percentile_approx("perplexity", [low, high], 10000).alias("q"))
    bounds = bounds.select("l", F.col("q")[0].alias("low"), F.col("q")[1].alias("high"))
    joined = each.join(F.broadcast(bounds), F.col("lang") == F.col("l"), "left")
    kept = F.coalesce(F.col("perplexity").between(F.col("low"), F.col("high")), F.col("low").isNull() & (F.col("n") > 0))
    return joined.select("doc_id", "lang", F.col("n").alias("n_chars"), "perplexity", "low", "high", kept.alias("keep"))
