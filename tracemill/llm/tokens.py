"""Token counts by heap-and-linked-list byte-pair merging.

A text is cut into pre-tokens. The bytes of a pre-token are the nodes of a linked list; a heap holds adjacent pairs
by merge rank and place. The lowest is popped and its two nodes become one, until no pair has a rank. The count is
the number of initial symbols minus the number of merges: no token identifiers are made. Pre-tokens repeat, so each
Python worker keeps a bounded table of counts; its size changes speed and nothing else.

Defined cases: a null text counts as empty (0 bytes, 0 tokens). Strings of added special tokens inside a text count
as one token each, as the tokenizers library takes them by default. Texts are read whole; a pre-token of any length
costs n log n. Repeated rows are counted alike, each for itself; an empty table gives an empty result. A column function reads its
own column alone, so other columns may have any name."""

from __future__ import annotations

import heapq
import json
import re
from collections.abc import Callable
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import functions as F

from tracemill.llm.base import text_udf

#: The pre-token pattern and the printable stand-ins for bytes of byte-level BPE vocabularies.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: The same cut for texts of these characters only (most Latin text), for Python's own, faster matcher.
LATIN = r"[\t\n\r -~\xc0-\xd6\xd8-\xf6\xf8-\u024f]*"
LATIN_PATTERN = r" ?[A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\u024f]+| ?[0-9]+|'s|'t|'re|'ve|'m|'ll|'d| ?[!-/:-@\[-`{-~]+|\s+(?!\S)|\s+"
PRINTABLE = (range(33, 127), range(161, 173), range(174, 256))

#: Pre-tokens in a generation of what a worker remembers.
REMEMBERED = 500_000


_is_latin, _split_latin, _split_any = re.compile(LATIN).fullmatch, re.compile(LATIN_PATTERN).findall, regex.compile(PATTERN).findall


def pre_tokens(text: str) -> list[str]:
    return _split_latin(text) if _is_latin(text) else _split_any(text)


def byte_symbols() -> dict[int, int]:
    """Code point that stands for a byte in vocabularies: the byte. Bytes without a printable form follow from 256 on."""
    plain = {b for r in PRINTABLE for b in r}
    return {b: b for b in plain} | {256 + k: b for k, b in enumerate(b for b in range(256) if b not in plain)}


class Merges:
    """Ranks of the merges of a byte-level BPE vocabulary file (tokenizers' JSON)."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        byte = {chr(c): bytes([b]) for c, b in byte_symbols().items()}
        pairs = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        whole = lambda s: b"".join(byte[c] for c in s)
        self.ranks = {(whole(a), whole(b)): k for k, (a, b) in reversed(list(enumerate(pairs)))}
        special = [regex.escape(t["content"]) for t in spec.get("added_tokens", [])]
        self.special = regex.compile("|".join(special)) if special else None

    def count(self, symbols: bytes) -> int:
        """Tokens of one pre-token."""
        n = len(symbols)
        ranks = self.ranks
        node: list[bytes | None] = [symbols[k : k + 1] for k in range(n)]
        following, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, k, symbols[k : k + 2]) for k in range(n - 1) if (r := ranks.get((node[k], node[k + 1]))) is not None]
        heapq.heapify(heap)
        merges = 0
        while heap:
            _, k, joined = heapq.heappop(heap)
            right = following[k]
            if node[k] is None or right >= n or len(joined) != len(node[k]) + len(node[right]) or node[k] + node[right] != joined:
                continue  # one of its nodes has been merged meanwhile
            node[k], node[right] = joined, None
            after = following[k] = following[right]
            merges += 1
            if after < n:
                before[after] = k
                if (r := ranks.get((joined, node[after]))) is not None:
                    heapq.heappush(heap, (r, k, joined + node[after]))
            if (left := before[k]) >= 0 and (r := ranks.get((node[left], joined))) is not None:
                heapq.heappush(heap, (r, left, node[left] + joined))
        return n - merges


class Words(dict):
    """What each pre-token counts for. Remembered in two generations of `most` entries: what is looked up moves to the
    younger, and once that is full the older is let go."""

    def __init__(self, one: Callable[[str], object], most: int):
        self.one, self.most, self.old = one, most, {}

    def __missing__(self, word: str):
        value = self.old[word] if word in self.old else self.one(word)
        if len(word) <= 64:
            if len(self) >= self.most:
                self.old = dict(self)
                self.clear()
            self[word] = value
        return value


class Counter:
    """Tokens of whole texts."""

    def __init__(self, merges: Merges):
        self.special = merges.special
        self.words = Words(lambda word: merges.count(word.encode("utf-8", "surrogatepass")), REMEMBERED)

    def plain(self, text: str) -> int:
        return sum(map(self.words.__getitem__, pre_tokens(text)))

    def tokens(self, text: str) -> int:
        if self.special is None or not (n := len(self.special.findall(text))):
            return self.plain(text)
        return n + sum(map(self.plain, self.special.split(text)))


@lru_cache(4)
def counter(path: str) -> Counter:
    return Counter(Merges(path))


def token_count(vocabulary: str):
    """A column function: text -> number of tokens (bigint; 0 for null). vocabulary: path of the file on each node."""

    @text_udf("bigint")
    def count(text: pa.Array) -> pa.Array:
        tokens = counter(vocabulary).tokens
        return pa.array([tokens(x) if x else 0 for x in text.to_pylist()], pa.int64())

    return count
