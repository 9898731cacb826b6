"""Nearest neighbours by an inverted multi-index.

Vectors are scaled to length one and cut into halves; each half is quantised by its own k-means, fitted on a bounded
sample (sample_rows vectors of least hash, a parameter). A pair of centroids is a cell, and every vector is in one. For
a query, a heap gives the cells in the order of their summed distances; cells are taken until they hold at least
min_entries vectors (so that there are k of them) and at least the given share of all. The entries of these cells are reranked by the exact cosine.

Entries lie in blocks of about block_rows, made from the cells' counts: small cells share a block, a large cell (a
third of all rows may be one) has many, by hash of the id. A query goes once to each block in which it visits cells.
Queries come in teams of about group_rows, made in the same way, so that a team's queries are near each other and no
task holds more than a block and a team; a block goes only to the teams that visit it. The result of a block is each
query's best entries; the best of these are the answer.

Vectors that are null, zero, of another length than most, or hold null or non-finite components take no part, nor do
rows without an id. Ties go to the smaller id. Rows that share an id are one candidate, at its nearest, and not a
candidate for themselves. A query has fewer results if there are fewer candidates; an empty table gives no rows. Other
columns are ignored.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow, sample_by_hash, slices, stash

OUT = "query_id long, vec_id long, score double"


def usable(vector: str) -> Column:
    fine = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return F.coalesce(F.forall(vector, fine) & F.exists(vector, lambda x: x != 0), F.lit(False))


def lengths(x: np.ndarray) -> np.ndarray:
    return np.sqrt((x * x).sum(axis=1))


def scaled(x: np.ndarray) -> np.ndarray:
    """Rows of x in a range in which squares neither overflow nor vanish; most are returned as they are."""
    with np.errstate(over="ignore", under="ignore"):
        n = lengths(x)
    odd = ~np.isfinite(n) | (n < 1e-140)
    if odd.any():
        x = x.copy()
        x[odd] /= np.abs(x[odd]).max(axis=1, keepdims=True)
    return x


def kmeans(x: np.ndarray, k: int, rounds: int = 12, seed: int = 11) -> np.ndarray:
    rnd = np.random.default_rng(seed)
    centres = np.unique(x, axis=0)
    centres = centres[np.sort(rnd.permutation(len(centres))[:k])]
    for _ in range(rounds):
        at = distances(x, centres).argmin(axis=1)
        n = np.bincount(at, minlength=len(centres))
        sums = np.zeros_like(centres)
        np.add.at(sums, at, x)
        centres = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centres)
    return centres


def distances(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return (x * x).sum(1)[:, None] + (centres * centres).sum(1)[None, :] - 2 * x @ centres.T


def cells_by_distance(first: np.ndarray, second: np.ndarray) -> Iterator[int]:
    """Cells i * len(second) + j in the order of first[i] + second[j]: a heap holds the next pair of each row that has begun."""
    a, b = np.argsort(first, kind="stable"), np.argsort(second, kind="stable")
    x, y = first[a].tolist(), second[b].tolist()
    heap = [(x[0] + y[0], 0, 0)]
    while heap:
        _, i, j = heapq.heappop(heap)
        yield int(a[i]) * len(b) + int(b[j])
        if j + 1 < len(y):
            heapq.heappush(heap, (x[i] + y[j + 1], i, j + 1))
        if j == 0 and i + 1 < len(x):
            heapq.heappush(heap, (x[i + 1] + y[0], i + 1, 0))


class Index:
    """Two codebooks, and by cell its rows, first block and number of blocks."""

    def __init__(self, codebooks: list[np.ndarray], half: int) -> None:
        self.codebooks, self.half = codebooks, half

    def halves(self, x: np.ndarray) -> list[np.ndarray]:
        x = scaled(x)
        x = x / lengths(x)[:, None]
        return [distances(part, c) for part, c in zip((x[:, : self.half], x[:, self.half :]), self.codebooks)]

    def cells(self, x: np.ndarray) -> np.ndarray:
        a, b = self.halves(x)
        return a.argmin(1) * len(self.codebooks[1]) + b.argmin(1)

    def place(self, counts: dict[int, int], block_rows: int) -> None:
        n = len(self.codebooks[0]) * len(self.codebooks[1])
        self.rows = np.zeros(n, np.int64)
        self.rows[list(counts)] = list(counts.values())
        self.dealt = Dealt(self.rows, block_rows)

    def blocks(self, cells: np.ndarray, ids: np.ndarray) -> np.ndarray:
        return self.dealt.parts(cells, ids)


class Dealt:
    """Rows of cells dealt to parts of some number of rows: cells that follow each other go together, one of more rows is split by a hash of the id."""

    def __init__(self, rows: np.ndarray, most: int) -> None:
        self.split = np.maximum(1, -(-rows // most))
        filled = np.cumsum(np.where(self.split > 1, 0, rows)) // most
        shared = int(filled[-1]) + 1
        big = self.split > 1
        self.first = np.where(big, shared + np.cumsum(np.where(big, self.split, 0)) - self.split, filled)

    def parts(self, cells: np.ndarray, ids: np.ndarray) -> np.ndarray:
        mixed = ((ids.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)).astype(np.int64)
        return self.first[cells] + mixed % self.split[cells]


def matrix(batch: pa.RecordBatch, name: str) -> np.ndarray:
    col = batch.column(name)
    return col.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(batch.num_rows, -1)


def search(vectors: DataFrame, queries: Column, k: int = 5, vec_id: str = "vec_id", vector: str = "embedding", centroids: int = 64, sample_rows: int = 20_000, share: float = 0.4, min_entries: int = 250, block_rows: int = 4_096, group_rows: int = 4_096) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of each row for which queries, a condition on vec_id, holds."""
    spark = vectors.sparkSession
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("x")).where(F.col("vec_id").isNotNull() & usable("x"))
    sizes = rows.groupBy(F.size("x").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "d").first()
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    if sizes is None:
        return empty
    rows = rows.where(F.size("x") == sizes["d"])
    sample = sample_by_hash(rows, "vec_id", sample_rows).toPandas().sort_values("vec_id")
    x = scaled(np.stack(sample["x"]))
    x, half = x / lengths(x)[:, None], max(1, sizes["d"] // 2)
    index = Index([kmeans(part, centroids) for part in (x[:, :half], x[:, half:])], half)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 4096):
            yield arrow({"vec_id": (batch.column("vec_id"), None), "x": (batch.column("x"), None), "cell": (index.cells(matrix(batch, "x")), pa.int32())})

    entries = stash(rows.mapInArrow(assign, "vec_id long, x array<double>, cell int"), "entries")
    counts = {r["cell"]: r["n"] for r in entries.groupBy("cell").agg(F.count("*").alias("n")).toLocalIterator()}  # at most centroids squared
    index.place(counts, block_rows)
    asked = entries.where(queries)
    # queries near each other are a team, so that it visits few blocks where the share is small
    at_cell = np.zeros(len(index.rows), np.int64)
    for r in asked.groupBy("cell").agg(F.count("*").alias("n")).toLocalIterator():
        at_cell[r["cell"]] = r["n"]
    teams = Dealt(at_cell, group_rows)
    need = max(min_entries, math.ceil(share * int(index.rows.sum())))

    def block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells, ids = (batch.column(c).to_numpy() for c in ("cell", "vec_id"))
            yield arrow({"block": (index.blocks(cells, ids), pa.int64()), "vec_id": (ids, pa.int64()), "x": (batch.column("x"), None), "cell": (cells, pa.int32())})

    def visited(batch: pa.RecordBatch) -> Iterator[tuple[int, dict[int, list[int]]]]:
        """Of each query its place and the cells it visits, by block."""
        for i, (first, second) in enumerate(zip(*index.halves(matrix(batch, "x")))):
            held, by = 0, {}
            for cell in cells_by_distance(first, second):
                if n := int(index.rows[cell]):
                    for b in range(index.dealt.first[cell], index.dealt.first[cell] + index.dealt.split[cell]):
                        by.setdefault(b, []).append(cell)
                    held += n
                    if held >= need:
                        break
            yield i, by

    def team(batch: pa.RecordBatch) -> np.ndarray:
        return teams.parts(*(batch.column(c).to_numpy() for c in ("cell", "vec_id")))

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            blocks, at, cells = [], [], []
            for i, by in visited(batch):
                blocks += by
                at += [i] * len(by)
                cells += by.values()
            take = batch.take(pa.array(at, pa.int64()))
            yield arrow({"block": (blocks, pa.int64()), "team": (team(take), pa.int64()), "query_id": (take.column("vec_id"), None), "q": (take.column("x"), None), "cells": (cells, pa.list_(pa.int32()))})

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            of = team(batch).tolist()
            pairs = {(b, of[i]) for i, by in visited(batch) for b in by}
            yield arrow({"block": ([b for b, _ in pairs], pa.int64()), "team": ([t for _, t in pairs], pa.int64())})

    def rerank(found: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple[int, int, float]] = []
        if len(found) and len(asked):
            x = scaled(np.stack(found["x"]))
            ids, cell, n = found["vec_id"].to_numpy(), found["cell"].to_numpy(), lengths(x)
            qs = scaled(np.stack(asked["q"]))
            rough = (qs / lengths(qs)[:, None]) @ (x / n[:, None]).T
            for own, q, cells, near in zip(asked["query_id"], qs, asked["cells"], rough):
                near[~np.isin(cell, cells) | (ids == own)] = -9
                # all that may be among the k nearest, up to rounding; repeated ids must not crowd others out
                top = np.flatnonzero(near > -9)
                if len(top) > k:
                    bound = _kth(ids[top], near[top], k)
                    top = top[near[top] >= bound - 1e-9]
                exact = (x[top] * q).sum(axis=1) / (n[top] * lengths(q[None])[0])
                taken: set[int] = set()
                for i in np.lexsort((ids[top], -exact)):
                    if len(taken) == k:
                        break
                    if (v := int(ids[top[i]])) not in taken:
                        taken.add(v)
                        out.append((own, v, float(exact[i])))
        return pd.DataFrame(out, columns=["query_id", "vec_id", "score"]).astype({"query_id": "int64", "vec_id": "int64", "score": "float64"})

    spread = entries.mapInArrow(block, "block long, vec_id long, x array<double>, cell int")
    # a block goes to the teams that visit it
    spread = spread.join(asked.mapInArrow(meet, "block long, team long").distinct(), "block")
    sent = asked.mapInArrow(visit, "block long, team long, query_id long, q array<double>, cells array<int>")
    near = spread.groupBy("block", "team").cogroup(sent.groupBy("block", "team")).applyInPandas(rerank, OUT)
    near = near.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return near.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _kth(ids: np.ndarray, near: np.ndarray, k: int) -> float:
    """The k-th largest value over distinct ids; the least if there are fewer."""
    m = min(len(near), 4 * k)
    while True:
        part = np.argpartition(-near, m - 1)[:m]
        part = part[np.argsort(-near[part], kind="stable")]
        _, first = np.unique(ids[part], return_index=True)
        if len(first) >= k:
            return float(near[part[np.sort(first)[k - 1]]])
        if m == len(near):
            return float(near.min())
        m = min(len(near), 4 * m)
