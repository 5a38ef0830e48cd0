"""Exact top-k search by Fagin's threshold algorithm over sorted per-dimension lists.

Vectors become integers, floor(scale * x). Candidates are dealt into blocks; in a block each dimension has a list of
the candidates sorted by value. For a query the lists are read in step, from the end that its sign favours; every
candidate met is scored in full; reading stops once the bound (the sum over dimensions of query value times the value
last read) cannot reach the kth score any more, or once every candidate is met. A tie at the bound reads on, so that
ties go to the smaller id. Steps down the lists grow threefold, which reads at most three times too deep.
Each block gives k rows a query; the k best of all blocks are exact, as blocks partition the candidates.

Queries and candidates meet block by block: a query block is dealt to each candidate block. Both kinds of block have a
bounded number of rows, so no task or broadcast holds a whole side.

Defined cases: vectors that are null, or hold null or non-finite components, take no part, nor do rows with a null id.
All others do, however large: scores are exact integers, and one that 64 bits do not hold counts as the nearest number
that they do; a query's own id is no candidate; vectors of another length than the query's are no candidates for it. Repeated rows
are candidates each, and a repeated query id is answered once for each of its distinct vectors. Fewer than k
candidates: all of them. An empty table gives an empty result. Only the named columns are read; others may have any name."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

FOUND = "query_id bigint, query_mark bigint, vec_id bigint, score bigint"


LEAST, MOST = -(2**63), 2**63 - 1


def scaled(values: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x): whole numbers as doubles, or as Python's integers where a double would overflow."""
    with np.errstate(over="ignore"):
        out = np.floor(values * scale)
    if np.isfinite(out).all():
        return out
    return np.array([int(x) * scale if not np.isfinite(y) else int(y) for x, y in zip(values.flat, out.flat)], object).reshape(values.shape)


def doubles(values: np.ndarray) -> np.ndarray:
    """values as doubles; Python's integers beyond 10^300 are cut there, which is far above what doubles are used for."""
    if values.dtype != np.object_:
        return values.astype(np.float64)
    return np.array([float(min(max(x, -(10**300)), 10**300)) for x in values.flat]).reshape(values.shape)


class Lists:
    """A block of candidates (whole numbers) with a sorted list for each dimension."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.ids, self.vectors = ids[order], vectors[order]
        self.order = np.argsort(self.vectors, axis=0, kind="stable").astype(np.int32)
        self.held = {np.float64: doubles(self.vectors)}
        self.sizes = np.abs(self.held[np.float64]).max(axis=1, initial=0)

    def scores(self, rows: np.ndarray, query: np.ndarray) -> np.ndarray:
        """Exact inner products with the query, no further from 0 than 64 bits reach: in the narrowest type that holds
        them, and row by row in Python's integers where a double would not."""
        weights = doubles(query)
        reach = len(query) * np.abs(weights).max(initial=0)
        if self.sizes.max(initial=0) < 2**24 / max(reach, 1):
            if np.float32 not in self.held:
                self.held[np.float32] = self.vectors.astype(np.float32)
            return (self.held[np.float32][rows] @ weights.astype(np.float32)).astype(np.int64)
        wide = self.sizes[rows] >= 2**53 / max(reach, 1)
        out = np.zeros(len(rows), np.int64)
        out[~wide] = (self.held[np.float64][rows[~wide]] @ weights).astype(np.int64)
        exact = [int(x) for x in query] if wide.any() else []
        for k in np.flatnonzero(wide):
            out[k] = min(max(sum(a * int(b) for a, b in zip(exact, self.vectors[rows[k]])), LEAST), MOST)
        return out

    def best(self, own: int, query: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids, scores) of the k best candidates, highest score first, ties to the smaller id."""
        n = len(self.ids)
        used = np.flatnonzero(query)
        falling = query[used] > 0
        met = np.zeros(n, bool)
        best, top = np.zeros(0, np.int64), np.zeros(0, np.int64)
        depth, step = 0, 32
        while depth < n and not met.all():
            to = min(n, depth + step)
            before = met.copy()
            for j, down in zip(used, falling):  # one step down each list
                met[self.order[n - to : n - depth, j] if down else self.order[depth:to, j]] = True
            if not len(used):
                met[:] = True
            fresh = np.flatnonzero(met & ~before)
            scores = self.scores(fresh, query)
            hopeful = self.ids[fresh] != own
            if len(best) == k:
                hopeful &= scores >= top[-1]
            elif hopeful.sum() > 8 * k:
                hopeful &= scores >= np.partition(scores[hopeful], -k)[-k]
            best, top = np.concatenate((best, fresh[hopeful])), np.concatenate((top, scores[hopeful]))
            order = np.lexsort((self.ids[best], ~top))[:k]  # ~x falls as x grows, and never overflows
            best, top = best[order], top[order]
            if len(used):
                last = self.vectors[[self.order[n - to if down else to - 1, j] for j, down in zip(used, falling)], used]
                bound = sum(int(a) * int(b) for a, b in zip(query[used], last))
                if len(best) == k and bound < top[-1]:
                    break
            depth, step = to, step * 3
        return self.ids[best], top


def _blocks(n: int, rows: int) -> int:
    return max(1, math.ceil(n / rows))


def top_k(vectors: DataFrame, queries: Column, key: str = "vec_id", vector: str = "embedding", k: int = 5, scale: int = 256, block: int = 16384, query_block: int = 4096) -> DataFrame:
    """query_id, rank (from 1), vec_id, score. queries: the condition on vectors' columns that makes a row a query."""
    value = F.col(vector)
    fits = "forall(v, x -> x is not null and not isnan(x) and abs(x) < double('Infinity'))"
    rows = vectors.select(F.col(key).cast("bigint").alias("vec_id"), F.transform(value, lambda x: x.cast("double")).alias("v"), F.coalesce(queries, F.lit(False)).alias("asks"))
    rows = rows.where(f"vec_id is not null and v is not null and {fits}")
    if scale & (scale - 1) == 0:  # then dividing is exact: components that become the same integer are made equal here
        rows = rows.withColumn("v", F.expr(f"transform(v, x -> if(abs(x) < {2.0**52 / scale!r}D, cast(floor({scale} * x) as double) / {scale}, x))"))
    rows = rows.groupBy("vec_id", "v").agg(F.least(F.count("*"), F.lit(k)).alias("copies"), F.max("asks").alias("asks"))
    rows = rows.select("*", F.xxhash64("vec_id", "v").alias("mark"), F.size("v").alias("dims"))
    n = rows.agg(F.count("*"), F.coalesce(F.sum(F.col("asks").cast("int")), F.lit(0))).first()
    blocks, query_blocks = _blocks(n[0], block), _blocks(n[1], query_block)
    own = lambda name, count: F.pmod(F.col("mark"), F.lit(count)).cast("int").alias(name)
    every = lambda name, count: F.explode(F.sequence(F.lit(0), F.lit(count - 1))).alias(name)
    sides = ["dims", "mark", "vec_id", "v", "copies"]
    asked = rows.where("asks").select(own("qb", query_blocks), every("cb", blocks), *sides)
    held = rows.select(own("cb", blocks), every("qb", query_blocks), *sides)

    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if left.num_rows and right.num_rows:
            read = lambda t: (t.column("vec_id").to_numpy(), scaled(t.column("v").combine_chunks().flatten().to_numpy().reshape(t.num_rows, -1), scale))
            copies = right.column("copies").to_numpy()
            ids, values = read(right)
            lists = Lists(np.repeat(ids, copies), np.repeat(values, copies, axis=0))
            for one, query, mark in zip(*read(left), left.column("mark").to_pylist()):
                out += [(one, mark, i, s) for i, s in zip(*lists.best(one, query, k))]
        columns = list(zip(*out)) or [[]] * 4
        return pa.table({c: pa.array(x, pa.int64()) for c, x in zip(("query_id", "query_mark", "vec_id", "score"), columns)})

    met = asked.groupBy("dims", "qb", "cb").cogroup(held.groupBy("dims", "qb", "cb")).applyInArrow(search, FOUND)
    order = Window.partitionBy("query_id", "query_mark").orderBy(F.desc("score"), "vec_id")
    return met.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
