"""Nearest neighbours by cosine with cross-polytope hashing.

A pseudo-rotation (three times: random signs, then a fast Hadamard transform) spreads a unit vector over its
coordinates; its bucket is the nearest signed axis, the largest coordinate with its sign. A bucket of ``depth`` such
rotations is finer. Every row is in one bucket of each of several tables; a query looks into the buckets of each table
whose axes it is nearest to, in that order, which is what multiprobing means here.

- **Fit.** How many rotations, tables and probes: on at most ``SAMPLE`` rows, those of least hash, and at most
  ``SAMPLE_QUERIES`` of them as queries, compared with each other exactly. Of the settings that find ``recall`` of the
  true neighbours, the one that reads fewest rows is taken. The neighbours of a sample are farther than those of the
  table, so the table's recall is that or better. Looking into all buckets of a table is exact, and among the settings.
- **Search.** Buckets are cut into blocks of ``BLOCK`` rows and ``BLOCK`` queries at most, so a bucket that holds a
  third of all vectors is many tasks' work. A pair of blocks is compared exactly, on the original vectors, and sends at
  most ``k`` candidates for each query; candidates of all blocks and tables meet by query, limited before they are sent.
- **The rest.** A query that found fewer than ``k`` looks into all buckets of the first table.

Results by case: vectors that are null, empty, zero, or hold a null or a component that is not finite take no part, nor do
rows without a ``vec_id``; only vectors of one length are compared; ties go to the smaller ``vec_id``; rows that
repeat a ``vec_id`` are versions of one vector, whose nearness is that of its nearest version, and never answer
themselves; an empty table, or one without queries, gives an empty result; extra columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from parcelry.llm.common import stage

#: Rows, and queries, of a block.
BLOCK = 2048
SAMPLE, SAMPLE_QUERIES = 8192, 256
#: Buckets of a table, at most: what a query ranks, and what the table of block counts is bounded by.
BUCKETS = 1 << 14
TABLES = (2, 3, 4)
DEPTHS = (1, 2)
ROUNDS = 3
PROBES = 512
TILE = 512


def transform(x: np.ndarray) -> np.ndarray:
    """The orthonormal Hadamard transform of every row; their length is a power of two."""
    n, width = x.shape
    step = 1
    while step < width:
        x = x.reshape(n, width // (2 * step), 2, step)
        x = np.stack([x[:, :, 0] + x[:, :, 1], x[:, :, 0] - x[:, :, 1]], axis=2)
        step *= 2
    return x.reshape(n, width) / math.sqrt(width)


def rotated(unit: np.ndarray, table: int, turn: int, seed: int) -> np.ndarray:
    """One pseudo-rotation of every row, padded to a power of two."""
    n, length = unit.shape
    width = 1 << max(1, length - 1).bit_length()
    x = np.zeros((n, width))
    x[:, :length] = unit
    signs = np.random.Generator(np.random.PCG64([seed, table, turn, width])).integers(0, 2, (ROUNDS, width)) * 2.0 - 1
    for s in signs:
        x = transform(x * s)
    return x


@dataclass(frozen=True)
class Setting:
    depth: int
    tables: int
    probes: int
    seed: int = 1

    def axes(self, length: int) -> list[int]:
        """Signed axes that each rotation of a bucket chooses among: all of them, later ones fewer if buckets would be too many."""
        every = 2 << max(1, length - 1).bit_length()
        found = [min(every, BUCKETS)]
        while len(found) < self.depth:
            found.append(max(2, min(every, BUCKETS // math.prod(found))))
        return found

    def signed(self, unit: np.ndarray, table: int) -> list[np.ndarray]:
        """For each rotation, every row's product with each of its signed axes."""
        made = []
        for turn, n in enumerate(self.axes(unit.shape[1])):
            x = rotated(unit, table, turn, self.seed)[:, : n // 2]
            made.append(np.concatenate([x, -x], axis=1))
        return made

    def buckets(self, unit: np.ndarray, table: int) -> np.ndarray:
        code = np.zeros(len(unit), dtype=np.int64)
        for products in self.signed(unit, table):
            code = code * products.shape[1] + products.argmax(axis=1)
        return code

    def ranked(self, unit: np.ndarray, table: int, probes: int | None = None) -> np.ndarray:
        """For every row the ``probes`` buckets nearest to it, nearest first."""
        scores = np.zeros((len(unit), 1))
        for products in self.signed(unit, table):
            scores = (scores[:, :, None] + products[:, None, :]).reshape(len(unit), -1)
        wanted = min(probes or self.probes, scores.shape[1])
        if wanted == scores.shape[1]:
            return np.argsort(-scores, axis=1, kind="stable")
        near = np.argpartition(-scores, wanted - 1, axis=1)[:, :wanted]
        order = np.argsort(-np.take_along_axis(scores, near, axis=1), axis=1, kind="stable")
        return np.take_along_axis(near, order, axis=1)


def matrix(vectors: pa.Array) -> np.ndarray:
    """Vectors of one length as rows of doubles."""
    return vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(vectors), -1)


def units(x: np.ndarray) -> np.ndarray:
    """Every row at length 1; a power of two taken out first keeps very large and very small ones apart from overflow."""
    _, power = np.frexp(np.abs(x).max(axis=1, keepdims=True))
    x = np.ldexp(x, -power)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The cosine of row i of ``a`` and row i of ``b``; equal rows give equal values wherever they stand."""
    a, b = (np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, keepdims=True))[1]) for x in (a, b))
    return (a * b).sum(axis=1) / (np.sqrt((a * a).sum(axis=1)) * np.sqrt((b * b).sum(axis=1)))


def usable(rows: DataFrame, key: str, vector: str) -> DataFrame:
    """(vec_id, v, size) of the rows that take part."""
    x = rows.select(F.col(key).cast("long").alias("vec_id"), F.col(vector).alias("v")).where("vec_id IS NOT NULL AND size(v) > 0")
    finite = F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")))
    return x.where(finite & F.exists("v", lambda c: c != 0)).withColumn("size", F.size("v"))


def fitted(rows: DataFrame, k: int, recall: float, seed: int = 1) -> Setting:
    """The setting for ``rows`` (vec_id, v, size), from a sample of them; see the module."""
    sample = rows.orderBy(F.xxhash64("vec_id", F.lit(seed)), "vec_id").limit(SAMPLE).toPandas()
    lengths = sample["size"].value_counts()
    exact = Setting(1, 1, BUCKETS, seed)
    if lengths.empty or lengths.iloc[0] < 4 * k:
        return exact
    unit = units(np.stack(sample.loc[sample["size"] == lengths.index[0], "v"].to_numpy()).astype(np.float64))
    q = unit[:SAMPLE_QUERIES]
    near = q @ unit.T
    near[np.arange(len(q)), np.arange(len(q))] = -2
    true = np.argpartition(-near, k, axis=1)[:, :k]
    best, least = exact, 1.0
    for depth in DEPTHS:
        tries = Setting(depth, max(TABLES), PROBES, seed)
        # The place of every row's bucket in the order in which a query looks into the buckets of a table.
        places = []
        for table in range(max(TABLES)):
            ranked = tries.ranked(q, table)
            n = math.prod(tries.axes(unit.shape[1]))
            order = np.full((len(q), n), n, dtype=np.int32)
            np.put_along_axis(order, ranked, np.arange(ranked.shape[1], dtype=np.int32)[None, :].repeat(len(q), 0), axis=1)
            places.append(order[:, tries.buckets(unit, table)])
        for tables in TABLES:
            first = np.minimum.reduce(places[:tables])
            found = np.sort(np.take_along_axis(first, true, axis=1).ravel())
            at = int(math.ceil(recall * len(found))) - 1
            probes = int(found[at]) + 1
            if probes > PROBES or probes > math.prod(tries.axes(unit.shape[1])):
                continue
            read = sum(float((p < probes).mean()) for p in places[:tables])
            if read < least:
                best, least = Setting(depth, tables, probes, seed), read
    return best


def hashed(rows: DataFrame, setting: Setting, probes: int | None = None) -> DataFrame:
    """``rows`` with ``cells``: of each table the bucket, or the ``probes`` buckets nearest, numbered over all tables."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = batch.column("size").to_numpy()
            for size in np.unique(sizes):
                for at in range(0, int((sizes == size).sum()), 1024):
                    some = batch.take(pa.array(np.flatnonzero(sizes == size)[at : at + 1024]))
                    unit = units(matrix(some.column("v")))
                    cells = np.concatenate(
                        [
                            (setting.buckets(unit, t)[:, None] if probes is None else setting.ranked(unit, t, probes)) + t * BUCKETS
                            for t in range(setting.tables)
                        ],
                        axis=1,
                    ).astype(np.int32)
                    lists = pa.ListArray.from_arrays(pa.array(np.arange(len(unit) + 1, dtype=np.int32) * cells.shape[1]), pa.array(cells.ravel()))
                    yield pa.RecordBatch.from_arrays([*some.columns, lists], [*batch.schema.names, "cells"])

    kinds = ", ".join(f"{c} {k}" for c, k in rows.dtypes)
    return rows.mapInArrow(run, f"{kinds}, cells array<int>")


def block_candidates(k: int):
    """Compares a block of rows with a block of queries; at most ``k`` candidates a query, exact, ties kept in order."""

    def run(rows: pa.Table, queries: pa.Table) -> pa.Table:
        made: list[list] = [[], [], []]
        if rows.num_rows and queries.num_rows:
            x, ids = matrix(rows.column("v").combine_chunks()), rows.column("vec_id").to_numpy()
            unit = units(x)
            wanted = matrix(queries.column("v").combine_chunks())
            names = queries.column("vec_id").to_numpy()
            for at in range(0, len(names), TILE):
                q, own = wanted[at : at + TILE], names[at : at + TILE]
                near = units(q) @ unit.T
                near[own[:, None] == ids[None, :]] = -2
                # The fast products decide all but what lies within their error of the last place; that is settled exactly.
                edge = np.partition(near, -k, axis=1)[:, -k] if near.shape[1] > k else np.full(len(q), -1.5)
                i, j = np.nonzero((near >= edge[:, None] - 1e-9) & (near > -1.5))
                score = cosines(q[i], x[j])
                order = np.lexsort((ids[j], -score, i))
                i, j, score = i[order], j[order], score[order]
                # Versions of one vector: the nearest, which is the first in order, stands for them.
                _, first = np.unique(np.stack([i, ids[j]]), axis=1, return_index=True)
                first = np.sort(first)
                i, j, score = i[first], j[first], score[first]
                place = np.arange(len(i)) - np.searchsorted(i, i)
                kept = place < k
                for column, values in zip(made, (own[i[kept]], ids[j[kept]], score[kept]), strict=True):
                    column.append(values)
        columns = [np.concatenate(c) if c else np.zeros(0) for c in made]
        return pa.table([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.float64()), strict=True)], ["query_id", "vec_id", "score"])

    return run


def candidates(rows: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    """(query_id, vec_id, score): ``rows`` and ``asked`` (vec_id, v, size, cell) compared where their cells and sizes agree."""
    counts = rows.groupBy("size", "cell").agg(F.count("*").alias("n")).join(
        asked.groupBy("size", "cell").agg(F.count("*").alias("m")), ["size", "cell"]
    )
    blocks = stage(counts.select("size", "cell", F.ceil(F.col("n") / BLOCK).alias("row_blocks"), F.ceil(F.col("m") / BLOCK).alias("query_blocks")), "ann-blocks")
    # As many rows as there are buckets, at most, for each length of vector that the table holds.
    if blocks.count() <= BUCKETS * len(TABLES):
        blocks = F.broadcast(blocks)
    pick = lambda n: F.pmod(F.xxhash64("vec_id", "v", F.monotonically_increasing_id()), F.col(n))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    placed = rows.join(blocks, ["size", "cell"]).withColumn("row_block", pick("row_blocks")).withColumn("query_block", every("query_blocks"))
    asked = asked.join(blocks, ["size", "cell"]).withColumn("query_block", pick("query_blocks")).withColumn("row_block", every("row_blocks"))
    keys = ["size", "cell", "row_block", "query_block"]
    left, right = (x.select(*keys, "vec_id", "v").groupBy(*keys) for x in (placed, asked))
    return left.cogroup(right).applyInArrow(block_candidates(k), "query_id long, vec_id long, score double")


def nearest(found: DataFrame, k: int) -> DataFrame:
    """The ``k`` nearest of each query among ``found``, each vec_id once."""
    best = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def search(rows: DataFrame, queries: DataFrame, k: int = 5, recall: float = 0.98, key: str = "vec_id", vector: str = "embedding", setting: Setting | None = None) -> DataFrame:
    """(query_id, rank, vec_id, score): for each of ``queries`` the ``k`` nearest of ``rows`` that were found."""
    rows, queries = usable(rows, key, vector), usable(queries, key, vector)
    setting = setting or fitted(rows, k, recall)
    cells = lambda x: x.select("vec_id", "v", "size", F.explode("cells").alias("cell"))
    held = stage(hashed(rows, setting), "ann-rows")
    asked = stage(hashed(queries, setting, setting.probes), "ann-queries")
    found = stage(nearest(candidates(cells(held), cells(asked), k), k), "ann-found")
    if setting.probes >= BUCKETS:
        return found
    full = found.groupBy("query_id").agg(F.max("rank").alias("n")).where(F.col("n") >= k).select("query_id")
    short = stage(asked.join(full, asked["vec_id"] == full["query_id"], "left_anti").select("vec_id", "v", "size"), "ann-short")
    if short.isEmpty():
        return found
    one = Setting(setting.depth, 1, BUCKETS, setting.seed)
    rest = stage(nearest(candidates(cells(hashed(rows, one)), cells(hashed(short, one, BUCKETS)), k), k), "ann-rest")
    return found.join(short.select("vec_id").distinct().toDF("query_id"), "query_id", "left_anti").select(found.columns).unionByName(rest)
