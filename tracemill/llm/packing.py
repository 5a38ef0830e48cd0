"""Packing of documents into training sequences by shortest-pack-first over the length histogram.

Each document's token ids, with an end id, are cut into full pieces of the sequence length and one remainder. Only
the histogram of piece lengths reaches the driver: lengths are placed longest first, each into the packs that are
filled least and still have room, moving whole counts of equal packs ("patterns") at a time; where none has room, as
few new packs as the length needs are opened. Patterns then meet the pieces again by rank: a slot of a pattern with
count c owns c consecutive ranks of its length. Ranks come from a window over (length, salt), with at least SALTS salts a
length and as many as keep a salt near SALT_ROWS pieces, so that a length that a third of all pieces share is spread over
tasks of bounded size. The ranks of a length are cut into as many equal stretches as it has slots, and a piece looks for
its slot among those of its stretch: two on average, in any histogram.

Defined cases: a null text is an empty one, so its document is the end id alone. Repeated rows and null ids are packed
like any other row; pieces that are equal in all columns are interchangeable. No documents: no pieces. Only the named
columns of documents are read, so others may have any name."""

from __future__ import annotations

import json
import re
import zlib
from array import array
from collections import defaultdict
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tracemill.llm.base import text_udf, written
from tracemill.llm.tokens import PATTERN, Words, _is_latin, byte_symbols, pre_tokens

SALTS, SALT_ROWS = 64, 1 << 20
#: Pre-tokens in a generation of those whose ids a worker remembers.
REMEMBERED = 60_000
#: Texts without longer runs of blanks or of other characters: tiktoken's time grows with the square of a pre-token.
_short_runs = re.compile(r"\s{0,400}+(?>\S{1,400}+\s{1,400}+)*+\S{0,400}+").fullmatch


def by_rank(path: str, tokenizer):
    """tiktoken's encoding of this vocabulary file, or None if it could give other ids than the tokenizers library. tiktoken
    merges any two neighbours that make a token, tokenizers only those in its list of merges. The ids are the same if ids rise
    with the merges and each token, as a text of its own, becomes that one token: as long as two neighbours that make a
    token have not been merged with what is around them, they went through the steps of that token alone, and its
    last step is in the list."""
    import tiktoken

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)["model"]
    vocabulary, model = tokenizer.get_vocab(with_added_tokens=False), tokenizer.model
    byte = {chr(c): bytes([b]) for c, b in byte_symbols().items()}
    ids = [vocabulary["".join(m.split(" ") if isinstance(m, str) else m)] for m in spec["merges"]]
    special = tokenizer.get_added_tokens_decoder()
    words = {t: i for t, i in vocabulary.items() if i not in special}
    if any(a >= b for a, b in zip(ids, ids[1:])) or any(c not in byte for t in words for c in t) or not byte.keys() <= words.keys():
        return None
    if any(len(model.tokenize(t)) != 1 for t in words):
        return None
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks={b"".join(map(byte.__getitem__, t)): i for t, i in words.items()}, special_tokens={})


class Encoder:
    """Token ids of whole texts as little-endian unsigned 32-bit bytes. Texts of Latin characters go through tiktoken whole,
    if the vocabulary allows it (see by_rank), which takes half of the time. Of other texts, and of those with very long
    runs, the tokenizers library's model encodes each pre-token once; what it gave is remembered (see tokens.Words)."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        special = {t.content: i.to_bytes(4, "little") for i, t in tokenizer.get_added_tokens_decoder().items()}
        model, stand_in = tokenizer.model, {b: c for c, b in byte_symbols().items()}

        def ids(word: str) -> bytes:
            symbols = word.encode("utf-8", "surrogatepass").decode("latin-1").translate(stand_in)
            return b"".join([t.id.to_bytes(4, "little") for t in model.tokenize(symbols)])

        self.whole = by_rank(path, tokenizer)
        self.special_ids = special
        self.special = regex.compile("(" + "|".join(map(regex.escape, special)) + ")") if special else None
        self.words = Words(ids, REMEMBERED)

    def plain(self, text: str) -> bytes:
        if self.whole and _is_latin(text) and _short_runs(text):
            return array("I", self.whole.encode_ordinary(text)).tobytes()
        return b"".join(map(self.words.__getitem__, pre_tokens(text)))

    def ids(self, text: str) -> bytes:
        if self.special is None or not self.special.search(text):
            return self.plain(text)
        parts = self.special.split(text)  # every second one is a special token
        return b"".join(self.special_ids[p] if k % 2 else self.plain(p) for k, p in enumerate(parts))


@lru_cache(2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def cut(vocabulary: str, size: int = 1024, end: int = 0):
    """A column function: text -> its number of tokens and its pieces (start, length, CRC-32 of the ids)."""

    @text_udf("tokens bigint, pieces array<struct<start:bigint,length:bigint,crc:bigint>>")
    def pieces(text: pa.Array) -> pa.Array:
        encode, tail = encoder(vocabulary).ids, end.to_bytes(4, "little")
        total, offsets, start, length, crc = [], [0], [], [], []
        for x in text.to_pylist():
            ids = memoryview((encode(x) if x else b"") + tail)
            n = len(ids) // 4
            for a in range(0, n, size):
                start.append(a)
                length.append(min(size, n - a))
                crc.append(zlib.crc32(ids[4 * a : 4 * (a + size)]))
            total.append(n)
            offsets.append(len(start))
        each = pa.StructArray.from_arrays([pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())], ["start", "length", "crc"])
        return pa.StructArray.from_arrays([pa.array(total, pa.int64()), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), each)], ["tokens", "pieces"])

    return pieces


def patterns(histogram: dict[int, int], size: int) -> list[tuple[list[int], int]]:
    """(lengths in a pack, number of such packs); every length is placed as often as the histogram says."""
    open_packs: dict[int, list[tuple[list[int], int]]] = defaultdict(list)  # by room left
    for length in sorted((x for x, n in histogram.items() if n), reverse=True):
        left = histogram[length]
        while left:
            room = max((r for r, packs in open_packs.items() if packs), default=0)
            if room < length:  # open as few packs as will do
                each = size // length
                for copies, n in ((each, left // each), (left % each, 1)):
                    if copies and n:
                        open_packs[size - copies * length].append(([length] * copies, n))
                break
            held, n = open_packs[room].pop()
            moved = min(n, left)
            if n > moved:
                open_packs[room].append((held, n - moved))
            open_packs[room - length].append((held + [length], moved))
            left -= moved
    return [pack for room in sorted(open_packs) for pack in open_packs[room]]


def slots(histogram: dict[int, int], size: int) -> list[tuple[int, int, int, int, int]]:
    """(length, first rank, last rank, sequence of the first rank, offset in the sequence)."""
    used: dict[int, int] = defaultdict(int)
    out, sequence = [], 0
    for held, n in patterns(histogram, size):
        at = 0
        for length in held:
            out.append((length, used[length], used[length] + n - 1, sequence, at))
            used[length] += n
            at += length
        sequence += n
    return out


def pack(pieces: DataFrame, order: list[str], length: str = "length", size: int = 1024) -> DataFrame:
    """pieces (any columns but sequence_id and offset) with sequence_id and offset. order: columns that tell pieces apart.
    The driver gets the histogram and a count for each salt: at most size * SALTS, and one more for SALT_ROWS pieces; the
    tables it sends back are bounded likewise."""
    spark = pieces.sparkSession
    histogram = {n: k for n, k in pieces.groupBy(F.col(length).cast("bigint")).count().collect()}
    made = slots(histogram, size)
    each: dict[int, int] = defaultdict(int)
    for slot in made:
        each[slot[0]] += 1
    salts = {n: max(SALTS, -(-k // SALT_ROWS)) for n, k in histogram.items()}
    width = {n: -(-k // each[n]) for n, k in histogram.items()}
    lengths = spark.createDataFrame([(n, salts[n], width[n]) for n in histogram], "n bigint, salts bigint, width bigint")
    held = pieces.select(F.struct("*").alias("row"), F.col(length).cast("bigint").alias("n"), F.struct(*order).alias("o"))
    held = held.join(F.broadcast(lengths), "n").withColumn("salt", F.pmod(F.xxhash64("o"), F.col("salts")))
    before, total = [], defaultdict(int)
    for n, salt, k in sorted(tuple(r) for r in held.groupBy("n", "salt").count().collect()):
        before.append((n, salt, total[n]))
        total[n] += k
    first = spark.createDataFrame(before, "n bigint, salt bigint, before bigint")
    stretches = [(n, b, low, high, sequence, at) for n, low, high, sequence, at in made for b in range(low // width[n], high // width[n] + 1)]
    places = spark.createDataFrame(stretches, "n bigint, stretch bigint, low bigint, high bigint, sequence bigint, at bigint")
    rank = F.row_number().over(Window.partitionBy("n", "salt").orderBy("o")) - 1 + F.col("before")
    ranked = held.join(F.broadcast(first), ["n", "salt"]).withColumn("rank", rank).withColumn("stretch", F.expr("rank div width"))
    placed = ranked.join(F.broadcast(places), ["n", "stretch"]).where("rank between low and high")
    return placed.select("row.*", (F.col("sequence") + F.col("rank") - F.col("low")).alias("sequence_id"), F.col("at").alias("offset"))


def packed(documents: DataFrame, vocabulary: str, key: str = "doc_id", text: str = "text", size: int = 1024, end: int = 0, where: Column | None = None) -> DataFrame:
    """A row for each piece of each document: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    docs = documents.where(F.lit(True) if where is None else where).select(F.col(key).alias("doc_id"), cut(vocabulary, size, end)(F.col(text)).alias("c"))
    flat = docs.select("doc_id", F.col("c.tokens").alias("doc_tokens"), F.explode("c.pieces").alias("p"))
    pieces = written(flat.select("doc_id", F.col("p.start").alias("start"), F.col("p.length").alias("length"), F.col("p.crc").alias("ids_crc32"), "doc_tokens", F.monotonically_increasing_id().alias("row")))
    return pack(pieces, ["doc_id", "start", "ids_crc32", "doc_tokens", "row"], size=size).drop("row")  # the row spreads equal ones over salts
