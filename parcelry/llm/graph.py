"""Connected components of links too many for one machine."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parcelry.llm.common import stage

#: Links that are few enough for one task, 16 bytes each; more are never gathered.
FEW_LINKS = 100_000


def components(links: DataFrame, label: str = "components") -> DataFrame:
    """(node, component) for every node of ``links`` (a, b); the component is its smallest node.

    Alternates large and small stars: every node's neighbours move to the smallest node around, so
    rounds grow with the logarithm of a component's diameter. Only sums of hashes reach the driver;
    every round is a written table. At most ``FEW_LINKS`` links are merged in one task instead, which saves the rounds.
    A link with a null end, or of a node to itself, is left out.
    """
    edges = stage(
        links.where("a IS NOT NULL AND b IS NOT NULL AND a <> b")
        .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        .distinct(),
        label,
    )
    seen = _mark(edges)
    if seen[0] <= FEW_LINKS:
        return stage(edges.coalesce(1).mapInArrow(_merged, "node long, component long"), label)
    while seen[0]:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        near = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = large.join(near, "u")
        edges = stage(
            moved.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionByName(near.select("u", F.col("m").alias("v")))
            .distinct(),
            label,
        )
        now = _mark(edges)
        if now == seen:
            break
        seen = now
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )


def _merged(batches):
    """(node, component) of links (u, v), by a forest whose roots are the smallest nodes."""
    above = {}

    def root(x):
        while above[x] != x:
            above[x] = x = above[above[x]]
        return x

    for batch in batches:
        for u, v in zip(batch.column("u").to_pylist(), batch.column("v").to_pylist(), strict=True):
            x, y = root(above.setdefault(u, u)), root(above.setdefault(v, v))
            above[max(x, y)] = min(x, y)
    if above:
        yield pa.RecordBatch.from_arrays([pa.array(list(above), pa.int64()), pa.array([root(x) for x in above], pa.int64())], ["node", "component"])


def _mark(edges: DataFrame) -> tuple[int, int]:
    """Equal for equal sets of edges."""
    row = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")).alias("s")).first()
    return row["n"], int(row["s"] or 0)
