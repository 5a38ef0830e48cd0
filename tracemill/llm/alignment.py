"""Alignment of two tokenizers' tokens over the same bytes, with a dictionary of token groups.

A text is tokenized by A (byte-level BPE over space + text) and by B (sentencepiece BPE, which adds that space itself). Where
tokens of both end at the same byte, a group ends; every A token of a group is linked to every B token of it. Groups
repeat, so they are interned: a task reads documents in shards of bounded size, gives each distinct group of a shard a local
number, and keeps of a document only these numbers with their frequencies. Links are expanded once per distinct group:
in a shard to count how many of its documents hold an id pair (documents lie in one shard, so the shards' counts add up),
and once in the whole corpus to sum the pairs' counts by group. The sums come back by group key to the shards that
hold the group, and from there to documents by the local numbers: the corpus moves as distinct groups of shards, and as
arrays of small numbers, never as a row for each link.

Both tokenizers cut before a space that follows a visible character: A's pre-tokens and B's pieces begin there. So a text is
worked through in such words, and a worker remembers what a word's groups are, in bounded generations. What it remembers
changes speed and nothing else.

Defined cases: texts that are null or empty, or that a tokenizer does not give back byte by byte, have no tokens: zeros and an
empty groups_sha256. Strings of special tokens are plain text. Repeated rows are documents of their own, with equal
results; a null id is carried like any other. A word of any length is tokenized whole. An empty table gives an empty
result. Only the named columns are read, so others may have any name."""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracemill.llm.base import _trim, scratch, small_batches, written
from tracemill.llm.tokens import PATTERN, byte_symbols, pre_tokens

#: Characters of text from which on a shard ends, words in a generation of those that a worker remembers, and the groups that
#: it numbers before it forgets both at the end of a shard.
SHARD, REMEMBERED, MOST_GROUPS = 8 << 20, 250_000, 200_000
#: Characters from which on a word goes to the library that takes words of any length.
LONG = 400
#: Two spaces, or a space beside another blank or control character: there words are put together one by one.
_ODD = re.compile(r"  |[^\S ] |[\x00-\x1f] ").search
#: Fixed value: how the sentencepiece vocabulary writes a space.
SPACE = "▁"

SCHEMA = (
    "kind int, shard bigint, doc_id {key}, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string, local array<int>, times array<int>,"
    " group string, number int, a int, b int, documents bigint"
)
DOCUMENT, GROUP, PAIR = 0, 1, 2
#: What is remembered of a word: (A tokens, B tokens, groups, links), the groups as text, their numbers. None: bytes differ.
Word = tuple[tuple[int, int, int, int], str, tuple[int, ...]]


class Aligner:
    """Groups of words by both tokenizers. Group numbers are the worker's own, and hold until forget() is called."""

    def __init__(self, path_a: str, path_b: str):
        import sentencepiece
        import tiktoken
        from tokenizers import Tokenizer

        stand_in = {b: c for c, b in byte_symbols().items()}
        tokenizer = Tokenizer.from_file(path_a)
        special = tokenizer.get_added_tokens_decoder()
        byte = {chr(c): b for b, c in stand_in.items()}
        ranks = {bytes([byte[c] for c in t]): i for t, i in tokenizer.get_vocab(with_added_tokens=True).items() if i not in special}
        # The same vocabulary by the faster of two libraries; ids are in the order of merges. Long words go to the other.
        self.a = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.model, self.stand_in = tokenizer.model, stand_in
        self.size_a = {i: len(t) for t, i in ranks.items()}
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.vocab_size())]
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else b"" if self.b.is_control(i) or self.b.is_unknown(i) else p.replace(SPACE, " ").encode() for i, p in enumerate(pieces)]
        self.forget()

    def forget(self) -> None:
        self.numbers: dict[str, int] = {}
        self.ones: dict[int, tuple[str, int]] = {}  # groups of one token each
        self.pairs: list[frozenset[int]] = []
        self.young: dict[str, Word] = {}
        self.old: dict[str, Word] = {}

    def tokens_a(self, data: str) -> list[int]:
        if len(data) <= LONG:
            return self.a.encode_ordinary(data)
        words = (w.encode("utf-8").decode("latin-1").translate(self.stand_in) for w in pre_tokens(data))
        return [t.id for w in words for t in self.model.tokenize(w)]

    def number(self, group: str) -> int:
        found = self.numbers.get(group)
        if found is None:
            found = self.numbers[group] = len(self.pairs)
            self.pairs.append(pairs_of(group))
        return found

    def align(self, word: str, b: list[int]) -> Word | None:
        """The groups of space + word, whose B tokens are given."""
        data = " " + word
        whole, a = data.encode("utf-8"), self.tokens_a(data)
        bytes_b = [self.bytes_b[x] for x in b]
        sizes_a, sizes_b = [self.size_a[x] for x in a], [len(x) for x in bytes_b]
        if sum(sizes_a) != len(whole) or b"".join(bytes_b) != whole:
            return None
        ones, said, numbers, links, i, j, n, k, ahead = self.ones, [], [], 0, 0, 0, 0, 0, 0
        for size in sizes_a:  # ahead: bytes by which the B tokens so far pass the A tokens
            n += 1
            ahead -= size
            while ahead < 0:
                ahead += sizes_b[k]
                k += 1
            if not ahead:
                if n - i == 1 == k - j:
                    pair = a[i] << 16 | b[j]
                    if pair not in ones:
                        ones[pair] = (group := f"{a[i]}|{b[j]}"), self.number(group)
                    group, number = ones[pair]
                    links += 1
                else:
                    group = ",".join(map(str, a[i:n])) + "|" + ",".join(map(str, b[j:k]))
                    number = self.number(group)
                    links += (n - i) * (k - j)
                said.append(group)
                numbers.append(number)
                i, j = n, k
        return (n, k, len(said), links), ";".join(said), tuple(numbers)

    def known(self, words: Iterable[str]) -> list[Word | None]:
        """The groups of each word, remembered in two generations: once the younger is full, the older is let go."""
        young, old, out, new = self.young, self.old, [], []
        for w in words:
            found = young.get(w, young)
            if found is young and (found := old.get(w, young)) is not young:
                young[w] = found
            out.append(found)
            if found is young:
                new.append(w)
        if new:
            made = iter([self.align(w, b) for w, b in zip(new, self.b.encode(new, num_threads=1))])
            out = [next(made) if x is young else x for x in out]
            young.update((w, x) for w, x in zip(words, out) if len(w) <= 64)
        if len(young) >= REMEMBERED:
            self.young, self.old = {}, young
        return out


def words(text: str) -> list[str]:
    """The words of space + text, each without its first space."""
    parts = text.split(" ")
    if parts[0] and parts[-1] and not _ODD(text):
        return parts
    out, open_ = [], False
    for part in parts:
        if open_:
            out[-1] += " " + part
        else:
            out.append(part)
        # The next space begins a word only behind a visible character.
        open_ = not part or part[-1].isspace() or part[-1] < "!"
    if len(out) > 1 and not out[-1]:
        out[-2:] = [out[-2] + " "]
    return out


@lru_cache(2)
def aligner(path_a: str, path_b: str) -> Aligner:
    return Aligner(path_a, path_b)


def pairs_of(group: str) -> frozenset[int]:
    """The id pairs of a group, each as one number."""
    a, b = ([int(x) for x in side.split(",")] for side in group.split("|"))
    return frozenset([x << 32 | y for x in a for y in b]) if len(a) == 1 or len(b) == 1 else frozenset([x << 32 | y for x in set(a) for y in set(b)])


class Shard:
    """Documents with their groups' numbers, and the number of documents that hold each pair."""

    def __init__(self, found: Aligner):
        self.found = found
        self.held: Counter[int] = Counter()
        self.documents: list[tuple] = []
        self.size = 0

    def add(self, key: object, text: str | None) -> None:
        self.size += len(text or "") + 64
        ordered = words(text) if text else []
        each = Counter(ordered)
        known = self.found.known(each)
        if not text or None in known:
            self.documents.append((key, 0, 0, 0, 0, "", np.zeros(0, np.int64), np.zeros(0, np.int64)))
            return
        n = np.fromiter(each.values(), np.int64, len(each))
        sizes = np.array([x[0] for x in known], np.int64)
        numbers = np.fromiter(chain.from_iterable([x[2] for x in known]), np.int64)
        own, place = np.unique(numbers, return_inverse=True)
        times = np.bincount(place, np.repeat(n, sizes[:, 2])).astype(np.int64)
        pairs = self.found.pairs
        self.held.update(set().union(*[pairs[k] for k in own.tolist()]))
        said = dict(zip(each, [x[1] for x in known]))
        sha = hashlib.sha256(";".join([said[w] for w in ordered]).encode()).hexdigest()
        self.documents.append((key, *(n @ sizes).tolist(), sha, own, times))

    def rows(self, shard: int, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
        def batch(kind: int, n: int, **columns):
            held = {"kind": np.full(n, kind, np.int32), "shard": np.full(n, shard, np.int64)} | columns
            return pa.RecordBatch.from_arrays([x if isinstance(x := held.get(f.name), pa.Array) else pa.nulls(n, f.type) if x is None else pa.array(x, f.type) for f in schema], schema=schema)

        def lists(arrays: list[np.ndarray]) -> pa.Array:
            offsets = np.concatenate(([0], np.cumsum([len(x) for x in arrays]))).astype(np.int32)
            return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(arrays), pa.int32()))

        used = np.unique(np.concatenate([x[6] for x in self.documents]))  # the shard's numbers are places in this
        names = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256")
        for first in range(0, len(self.documents), 256):
            some = self.documents[first : first + 256]
            yield batch(DOCUMENT, len(some), **{k: [x[i] for x in some] for i, k in enumerate(names)}, local=lists([np.searchsorted(used, x[6]) for x in some]), times=lists([x[7] for x in some]))
        groups = dict(zip(self.found.numbers.values(), self.found.numbers))
        for first in range(0, len(used), 1 << 14):
            some = used[first : first + (1 << 14)]
            yield batch(GROUP, len(some), group=[groups[k] for k in some.tolist()], number=np.arange(first, first + len(some), dtype=np.int32))
        codes, counts = np.fromiter(self.held.keys(), np.int64, len(self.held)), np.fromiter(self.held.values(), np.int64, len(self.held))
        for first in range(0, len(codes), 1 << 16):
            some = codes[first : first + (1 << 16)]
            yield batch(PAIR, len(some), a=(some >> 32).astype(np.int32), b=(some & 0xFFFFFFFF).astype(np.int32), documents=counts[first : first + (1 << 16)])


def read_shards(documents: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """Rows of all kinds, in shards of about SHARD characters, for documents (doc_id, text)."""
    from pyspark.sql.pandas.types import to_arrow_schema

    made = documents.sparkSession.createDataFrame([], SCHEMA.format(key=documents.schema["doc_id"].dataType.simpleString())).schema
    schema = to_arrow_schema(made)

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        found, task, k = aligner(path_a, path_b), TaskContext.get().partitionId(), 0
        shard = Shard(found)
        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                shard.add(key, text)
                if shard.size >= SHARD:
                    yield from shard.rows(task << 32 | k, schema)
                    if len(found.pairs) > MOST_GROUPS:
                        found.forget()
                    k, shard = k + 1, Shard(found)
                    _trim()(0)
        if shard.documents:
            yield from shard.rows(task << 32 | k, schema)
        _trim()(0)

    small_batches(documents.sparkSession)
    return documents.mapInArrow(shards, made)


def summed(key: tuple, documents: pa.Table, groups: pa.Table) -> pa.Table:
    """A shard's documents with the sums of their groups' values. Both tables are bounded by the shard's size."""
    order = np.argsort(groups["number"].to_numpy())
    values = [groups[c].to_numpy()[order] for c in ("best", "total")]
    local, times = (documents[c].combine_chunks() for c in ("local", "times"))
    lengths = np.asarray(local.value_lengths())
    at, n = local.flatten().to_numpy(), times.flatten().to_numpy().astype(np.int64)
    sums = []
    for v in values:
        run = np.concatenate((np.zeros(1, np.int64), np.cumsum(v[at] * n if len(at) else np.zeros(0, np.int64))))
        ends = np.cumsum(lengths)
        sums.append(pa.array(run[ends] - run[ends - lengths], pa.int64()))
    return documents.drop_columns(["shard", "local", "times"]).append_column("n_best", sums[0]).append_column("count_sum", sums[1])


def aligned(documents: DataFrame, path_a: str, path_b: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 for each row of documents."""
    docs = documents.select(F.col(key).alias("doc_id"), F.col(text).alias("text"))
    columns = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256")
    with scratch(documents.sparkSession) as keep:
        rows = written(read_shards(docs, path_a, path_b))
        pairs = written(rows.where(F.col("kind") == PAIR).groupBy("a", "b").agg(F.sum("documents").alias("documents")))
        highest = pairs.groupBy("a").agg(F.max("documents").alias("highest"))
        rated = written(pairs.join(highest, "a").select("a", "b", "documents", (F.col("documents") == F.col("highest")).cast("bigint").alias("best")))
        local = rows.where(F.col("kind") == GROUP).select("shard", "number", "group")
        counted = lambda c: F.transform(F.array_distinct(c), lambda v: F.struct(v.cast("int").alias("id"), F.size(F.filter(c, lambda x: x == v)).alias("n")))
        side = lambda k: counted(F.split(F.split_part("group", F.lit("|"), F.lit(k)), ","))
        links = local.select("group").distinct().select("group", F.explode(side(1)).alias("x"), side(2).alias("ys")).select("group", "x", F.explode("ys").alias("y"))
        links = links.select("group", F.col("x.id").alias("a"), F.col("y.id").alias("b"), (F.col("x.n").cast("bigint") * F.col("y.n")).alias("n"))
        sums = written(links.join(rated, ["a", "b"]).groupBy("group").agg(F.sum(F.col("n") * F.col("best")).alias("best"), F.sum(F.col("n") * F.col("documents")).alias("total")))
        back = written(local.join(sums, "group").select("shard", "number", "best", "total"))
        held = rows.where((F.col("kind") == DOCUMENT)).select("shard", *columns, "local", "times")
        out = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in held.select(*columns).schema) + ", n_best bigint, count_sum bigint"
        done = held.where("n_groups > 0").groupBy("shard").cogroup(back.groupBy("shard")).applyInArrow(summed, out)
        none = held.where("n_groups = 0").select(*columns, F.lit(0).cast("bigint").alias("n_best"), F.lit(0).cast("bigint").alias("count_sum"))
        return keep(written(done.unionByName(none)))
