"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features are 64-bit hashes of words, of neighbouring pairs and of pairs with one word between, each counted once a
text. Learning rates are per coordinate; L1 leaves a few thousand non-zero weights, which are broadcast as sorted
hashes with their weights. 64 bits keep features apart, so that a clean text does not meet a weight by collision.

Defined cases: a null or empty text, or one without a word, gets the score of the intercept alone. Rows with a null
label, id or text teach nothing; of several labels for an id the largest counts. With no labels (or one class only)
all scores are the share of label 1 (0 if there is none). Repeated rows are scored alike; an empty table gives an empty
result. Only the named columns are read, so others may have any name. Texts are read whole, in slices that
overlap by two words, which changes no feature."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracemill.llm.base import drawn, given_back, mixed, pieces, text_udf, word_hashes

#: Words of overlap between slices of a long text, so that pairs and skip pairs across a cut are seen.
OVERLAP = 2
_PAIR, _SKIP = np.uint64(0x9FB21C651E98DF25), np.uint64(0xC2B2AE3D27D4EB4F)


@dataclass
class ToxicityModel:
    features: np.ndarray  # sorted hashes
    weights: np.ndarray
    intercept: float


def features(held: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of words, pairs and skip pairs of all texts, and the text of each."""
    words, doc = word_hashes(held)
    near, far = doc[1:] == doc[:-1], doc[2:] == doc[:-2]
    pairs = mixed(words[:-1] * _PAIR + words[1:])[near]
    skips = mixed(words[:-2] * _SKIP + words[2:])[far]
    return np.concatenate((words, pairs, skips)), np.concatenate((doc, doc[:-1][near], doc[:-2][far]))


def bag(text: str) -> np.ndarray:
    found = [features(held)[0] for _, held in pieces([text], OVERLAP)]
    return np.unique(np.concatenate(found)) if found else np.zeros(0, np.uint64)


def fit(bags: list[np.ndarray], marks: list[int], alpha: float = 2.0, beta: float = 1.0, l1: float = 4.0, l2: float = 0.1, epochs: int = 8, admit: int = 2, beta_f: float = 1.0, seed: int = 8) -> ToxicityModel:
    """A bag of features and a label for each row. A feature is admitted once `admit` rows have it. A first fit leaves out every fifth row; the
    cut between the classes that has the best F score on those (beta_f below 1: precision counts more) is where the
    final model, fitted to all rows, has score 0.5."""
    labels = np.array(marks, float)
    if len(set(labels)) < 2:
        share = labels.mean() if len(labels) else 0.0
        return ToxicityModel(np.zeros(0, np.uint64), np.zeros(0, np.float32), float(np.log(max(share, 1e-9) / max(1 - share, 1e-9))))
    bags = list(bags)
    bags = _admitted(bags, admit)
    known, counts = np.unique(np.concatenate(bags), return_counts=True)
    known = known[counts >= admit]
    bags = [_places(known, b).astype(np.int32) for b in bags]
    rng = np.random.default_rng(seed)
    held = rng.permutation(len(bags)) % 5 == 4
    how = {"size": len(known), "alpha": alpha, "beta": beta, "l1": l1, "l2": l2, "epochs": epochs, "rng": rng}
    shift = 0.0
    if min(labels[held].sum(), (1 - labels[held]).sum(), labels[~held].sum(), (1 - labels[~held]).sum()) >= 3:
        learn = np.flatnonzero(~held)
        w, intercept = _descend([bags[i] for i in learn], labels[learn], **how)
        shift = -_cut(np.array([w[bags[i]].sum() + intercept for i in np.flatnonzero(held)]), labels[held] == 1, beta_f)
    w, intercept = _descend(bags, labels, **how)
    kept = np.flatnonzero(w)
    return ToxicityModel(known[kept], w[kept].astype(np.float32), float(intercept + shift))


def _admitted(bags: list[np.ndarray], least: int) -> list[np.ndarray]:
    """The bags without most features that fewer than `least` of them hold: one counter for many features, so a
    feature's counter is at least its count."""
    counters = np.zeros(1 << 25, np.uint8)
    for b in bags:
        at = (b >> np.uint64(39)).astype(np.int32)
        counters[at] = np.minimum(counters[at], 254) + 1
    for i, b in enumerate(bags):
        bags[i] = b[counters[(b >> np.uint64(39)).astype(np.int32)] >= least]
    return bags


def _descend(bags: list[np.ndarray], labels: np.ndarray, size: int, alpha: float, beta: float, l1: float, l2: float, epochs: int, rng) -> tuple[np.ndarray, float]:
    """FTRL-proximal over the rows, in a new order each epoch: weights and intercept (which is not shrunk)."""
    z, n = np.zeros(size + 1), np.zeros(size + 1)  # the last is the intercept's
    rate = lambda at: (beta + np.sqrt(n[at])) / alpha

    def weights(at: np.ndarray | slice) -> np.ndarray:
        return -np.sign(z[at]) * np.maximum(np.abs(z[at]) - l1, 0) / (rate(at) + l2)

    for _ in range(epochs):
        for i in rng.permutation(len(bags)):
            at = np.append(bags[i], size)
            w = weights(at)
            w[-1] = -z[-1] / rate(-1)
            g = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35))) - labels[i]
            z[at] += g - (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / alpha * w
            n[at] += g * g
    return weights(slice(0, size)), float(-z[-1] / rate(-1))


def _cut(logits: np.ndarray, positive: np.ndarray, beta_f: float) -> float:
    """A point in the gap (nearer its upper end) between logits at which the F score of calling all above it positive is best; at most 0,
    so that what the fit itself calls positive stays so."""
    order = np.argsort(-logits, kind="stable")
    logits, hits = logits[order], np.cumsum(positive[order])
    f = (1 + beta_f**2) * hits / (np.arange(1, len(hits) + 1) + beta_f**2 * hits[-1])
    k = int(np.argmax(f))
    below = logits[k + 1] if k + 1 < len(logits) else logits[k] - 1
    return float(min(0.0, (2 * logits[k] + below) / 3))


def _places(known: np.ndarray, b: np.ndarray) -> np.ndarray:
    at = np.searchsorted(known, b)
    at[at == len(known)] = 0
    return at[known[at] == b] if len(known) else at[:0]


def scored(model: ToxicityModel, texts: list[str | None], seen: np.ndarray | None = None) -> np.ndarray:
    """Probability of label 1 for each text. seen: a table over the hashes' top 22 bits of those with a weight."""
    total = np.full(len(texts), model.intercept)
    if len(model.features):
        seen = prefilter(model) if seen is None else seen
        done: dict[int, np.ndarray] = {}
        for rows, held in pieces(texts, OVERLAP):
            h, doc = features(held)
            hit = np.flatnonzero(seen[(h >> np.uint64(42)).astype(np.int32)])
            at = np.searchsorted(model.features, h[hit])
            at[at == len(model.features)] = 0
            right = model.features[at] == h[hit]
            pair = np.unique(np.stack((rows[doc[hit[right]]], at[right])), axis=1)
            for row in set(rows[[0, -1]]):  # a long text's pieces: count each feature once
                mine = pair[1][pair[0] == row]
                if row in done:
                    pair = pair[:, (pair[0] != row) | ~np.isin(pair[1], done[row])]
                    mine = np.union1d(mine, done[row])
                done[row] = mine
            np.add.at(total, pair[0], model.weights[pair[1]])
            done = {rows[-1]: done[rows[-1]]}
    return 1 / (1 + np.exp(-np.clip(total, -35, 35)))


def prefilter(model: ToxicityModel) -> np.ndarray:
    seen = np.zeros(1 << 22, bool)
    seen[(model.features >> np.uint64(42)).astype(np.int32)] = True
    return seen


def train(documents: DataFrame, labels: DataFrame, label: str = "toxic", where: Column | None = None, rows_per_class: int = 2500, features_a_row: int = 1 << 14, seed: int = 8) -> ToxicityModel:
    """Fit on at most rows_per_class labelled ids of each class (label above 0, or not), drawn by a hash of the id; `where`
    is a condition over labels. Their ids, so bounded, are broadcast to fetch the texts; of texts that share an id the
    least is taken. Tasks turn these into features; of more than features_a_row those with the lowest hashes teach. So the
    driver gets at most 2 * rows_per_class * features_a_row hashes, however often ids repeat and however long texts are."""

    @text_udf("array<bigint>")
    def bags(texts: pa.Array) -> pa.Array:
        return pa.array([bag(x)[:features_a_row].view(np.int64) for x in texts.to_pylist()], pa.list_(pa.int64()))

    known = labels.where(F.lit(True) if where is None else where).select(F.col("doc_id").alias("i"), (F.col(label) > 0).cast("int").alias("y"))
    known = known.where("i is not null and y is not null").groupBy("i").agg(F.max("y").alias("y")).select("i", "y", F.xxhash64("i", F.lit(seed)).alias("h"))
    chosen = drawn(known.select("y", "h"), "y", "h", rows_per_class, 2)
    docs = documents.select(F.col("doc_id").alias("i"), F.col("text").alias("t")).where("t is not null and i is not null").withColumn("h", F.xxhash64("i", F.lit(seed)))
    texts = docs.join(F.broadcast(chosen), "h").groupBy("h", "y").agg(F.min("t").alias("t"))
    with given_back():
        return fit(*_ordered(texts.select("h", "y", bags("t").alias("b")).toArrow()), seed=seed)


def _ordered(got: pa.Table) -> tuple[list[np.ndarray], list[int]]:
    """Bags and labels in the order of h. The bags are views: nothing is copied, and what holds them goes with the last."""
    order = np.argsort(got["h"].to_numpy(), kind="stable")
    bags = [b.values.to_numpy().view(np.uint64) for b in got["b"]]
    return [bags[i] for i in order], got["y"].to_numpy()[order].tolist()


def toxicity(model: ToxicityModel, spark):
    """A column function: text -> probability that the text is toxic."""
    held = spark.sparkContext.broadcast((model, prefilter(model)))

    @text_udf("double")
    def score(text: pa.Array) -> pa.Array:
        model, seen = held.value
        return pa.array(scored(model, text.to_pylist(), seen))

    return score
