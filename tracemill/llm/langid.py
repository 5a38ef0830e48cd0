"""Language identification: averaged hashed subword embeddings under a linear softmax, trained by stochastic
gradient descent, with temperature-calibrated confidence and a calibrated rejection threshold.

A text is the mean of the embeddings of its hashed subwords (1 to 4 letters of a word, word ends marked). Because
the layer above the mean is linear, prediction needs no embedding lookups: each bucket's contribution to each
language's logit is tabulated once, and a text's logits are the mean of its buckets' rows.

Defined cases: a null text, or one without a letter, is `und` with score 0 and not reliable. Rows whose lang or
text is null teach nothing. With no labelled text at all every row is `und`. Repeated rows are predicted alike;
equal logits go to the language that sorts first. An empty table gives an empty result. Only the named columns are read,
so others may have any name. Texts are read whole, in slices."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracemill.llm.base import drawn, folded, mixed, pieces, text_udf

BUCKETS = 1 << 16
UND = "und"
RESULT = "lang string, score double, reliable boolean"


@dataclass
class LanguageModel:
    languages: list[str]
    table: np.ndarray  # buckets x languages: what a subword adds to the logits
    bias: np.ndarray
    temperature: float
    threshold: float  # confidence below which a prediction is rejected


def subwords(held: list[str]) -> tuple[list[np.ndarray], list[np.ndarray], np.ndarray]:
    """For each n-gram length the buckets and whether they are subwords, by position; and each text's first position."""
    chars, starts = folded(held)
    chars = np.append(chars, 0)  # the last text ends like the others
    keep = chars != 0
    keep[1:] |= chars[:-1] != 0
    keep[starts] = True
    where = np.cumsum(keep) - 1
    letters, starts = chars[keep].astype(np.uint64), where[starts]
    full = letters != 0
    buckets, valid = [], []
    hashed = np.zeros(len(letters), np.uint64)
    for n in range(1, 5):
        m = max(0, len(letters) - n + 1)
        hashed = hashed[:m] * np.uint64(0x100000001B3) + letters[n - 1 : n - 1 + m] + np.uint64(1)
        ok = full[:m] & full[n - 1 : n - 1 + m] if n == 1 else full[:m] | full[n - 1 : n - 1 + m]
        for k in range(1, n - 1):  # word ends only at either end
            ok = ok & full[k : k + m]
        buckets.append((mixed(hashed + np.uint64(n << 40)) & np.uint64(BUCKETS - 1)).astype(np.int32))
        valid.append(ok)
    return buckets, valid, starts


def bag(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Distinct buckets of a text and the share of its subwords that falls on each."""
    total = np.zeros(BUCKETS)
    for _, held in pieces([text]):
        for b, ok in zip(*subwords(held)[:2]):
            total += np.bincount(b[ok], minlength=BUCKETS)
    found = np.flatnonzero(total)
    return found, total[found] / max(1.0, total.sum())


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def fit(rows: list[tuple[tuple[np.ndarray, np.ndarray], str]], dim: int = 16, epochs: int = 8, rate: float = 4.0, precision: float = 0.99, seed: int = 7) -> LanguageModel:
    """rows: (bag, language). Every fifth row calibrates the temperature and the rejection threshold: the lowest
    confidence from which on the predictions of those rows have the precision asked for."""
    bags = [x for x in rows if len(x[0][0])]
    names = sorted({language for _, language in bags})
    if not names:
        return LanguageModel([], np.zeros((BUCKETS, 0), np.float32), np.zeros(0), 1.0, 1.0)
    label = {x: i for i, x in enumerate(names)}
    held_out = [x for i, x in enumerate(bags) if i % 5 == 4]
    learn = [x for i, x in enumerate(bags) if i % 5 != 4] or bags
    rng = np.random.default_rng(seed)
    embed, top, bias = rng.normal(0, 1, (BUCKETS, dim)), np.zeros((dim, len(names))), np.zeros(len(names))
    steps, step = epochs * len(learn), 0
    for _ in range(epochs):
        for i in rng.permutation(len(learn)):
            (found, share), language = learn[i]
            lr = rate * (1 - step / steps)
            hidden = share @ embed[found]
            error = softmax(hidden @ top + bias)
            error[label[language]] -= 1
            back = top @ error
            top -= lr * np.outer(hidden, error)
            bias -= lr * 0.05 * error
            embed[found] -= (lr * share)[:, None] * back
            step += 1
    table = (embed @ top).astype(np.float32)
    check = held_out or learn
    logits = np.array([share @ table[found] + bias for (found, share), _ in check])
    truth = np.array([label[x] for _, x in check])
    temperature = min(np.geomspace(0.05, 20, 60), key=lambda t: -np.log(softmax(logits / t)[np.arange(len(truth)), truth] + 1e-12).sum())
    confidence = softmax(logits / temperature)
    right = confidence.argmax(axis=1) == truth
    order = np.argsort(-confidence.max(axis=1), kind="stable")
    precise = np.flatnonzero(np.cumsum(right[order]) >= precision * np.arange(1, len(order) + 1))
    threshold = float(confidence.max(axis=1)[order[precise[-1]]]) if len(precise) else 1.0
    return LanguageModel(names, table, bias, float(temperature), threshold)


def predicted(model: LanguageModel, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Best language, its calibrated probability and whether it reaches the threshold, for each text."""
    n = max(1, len(model.languages))
    sums, counts = np.zeros((len(texts), n)), np.zeros(len(texts))
    if model.languages:
        for rows, held in pieces(texts):
            buckets, valid, starts = subwords(held)
            for b, ok in zip(buckets, valid):
                at = starts[starts < len(b)]
                if len(at):
                    sums[rows[: len(at)]] += _per_text(rows[: len(at)], model.table[b] * ok[:, None], at, sums)
                    np.add.at(counts, rows[: len(at)], np.add.reduceat(ok, at, dtype=np.int64))
    known = counts > 0
    p = softmax((sums / np.maximum(counts, 1)[:, None] + (model.bias if model.languages else 0)) / model.temperature)
    best = p.argmax(axis=1)
    score = np.where(known, p.max(axis=1), 0.0)
    return [model.languages[i] if k else UND for i, k in zip(best, known)], score, known & (score >= model.threshold)


def _per_text(rows: np.ndarray, values: np.ndarray, at: np.ndarray, like: np.ndarray) -> np.ndarray:
    return np.add.reduceat(values, at, axis=0, dtype=like.dtype)


def train(documents: DataFrame, text: str = "text", lang: str = "lang", where: Column | None = None, rows_per_language: int = 600, languages: int = 256, seed: int = 7) -> LanguageModel:
    """Fit on at most rows_per_language distinct texts of each language (of more than `languages` the most frequent), drawn
    by a hash of the text among the rows that pass `where`. Tasks turn them into bags of at most BUCKETS numbers; these are
    all that the driver gets, however often a text repeats and however long it is."""

    @text_udf("at array<int>, share array<double>")
    def bags(texts: pa.Array) -> pa.Array:
        found = [bag(x) for x in texts.to_pylist()]
        lists = [pa.array([b[k] for b in found], pa.list_(kind)) for k, kind in enumerate((pa.int32(), pa.float64()))]
        return pa.StructArray.from_arrays(lists, ["at", "share"])

    docs = documents.select(F.col(text).alias("t"), F.col(lang).alias("l"), (F.lit(True) if where is None else where).alias("w"))
    docs = docs.where("w and l is not null and t is not null").select("l", "t", F.xxhash64("t", F.lit(seed)).alias("h"))
    chosen = drawn(docs.select("l", "h"), "l", "h", rows_per_language, languages)
    texts = docs.join(F.broadcast(chosen), ["l", "h"]).dropDuplicates(["l", "h"])
    got = texts.select("l", "h", bags("t").alias("b")).select("l", "h", "b.*").toArrow().sort_by([("l", "ascending"), ("h", "ascending")])
    columns = [got[c] for c in ("at", "share", "l")]
    return fit([((a.values.to_numpy(), s.values.to_numpy()), name.as_py()) for a, s, name in zip(*columns)], seed=seed)


def identify(model: LanguageModel, spark, reject: bool = True):
    """A column function: text -> struct(lang, score, reliable). With `reject`, unreliable predictions are `und`."""
    held = spark.sparkContext.broadcast(model)

    @text_udf(RESULT)
    def language(text: pa.Array) -> pa.Array:
        names, score, reliable = predicted(held.value, text.to_pylist())
        if reject:
            names = [x if r else UND for x, r in zip(names, reliable)]
        return pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(score), pa.array(reliable)], ["lang", "score", "reliable"])

    return language
