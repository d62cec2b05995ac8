"""File-set operators: canonical order, cursor pages, digests and version pins."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from itertools import groupby
from operator import itemgetter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parcelry.functions.cursors import encode_cursor
from parcelry.functions.paths import path_key, top_root
from parcelry.operators.numbering import number_rows

MANIFEST_PAGE = 1000


def canonical_order(df: DataFrame) -> DataFrame:
    """Manifest rows with their 1-based place in the canonical order."""
    rows, _ = number_rows(df.withColumn("_key", path_key(F.col("path"))), ["_key"], unique=["_key"], name="position")
    return rows.drop("_key")


def path_pages(df: DataFrame, n: int = MANIFEST_PAGE) -> DataFrame:
    """Every page of the manifest; the cursor is null exactly on the last page."""
    n = max(1, n)
    rows, total = number_rows(
        df.select("path", "size").withColumn("_key", path_key(F.col("path"))), ["_key"], unique=["_key"]
    )
    page = F.floor((F.col("rn") - 1) / F.lit(n)).cast("bigint")
    place = (F.col("rn") - 1) % F.lit(n)
    opens, closes = place == 0, (place == n - 1) | (F.col("rn") == total)
    # The totals are numbers and hash-aggregate; only the rows at page ends carry their paths.
    totals = rows.groupBy(page.alias("page")).agg(F.count("*").alias("files"), F.sum("size").alias("bytes"))
    ends = rows.filter(opens | closes).groupBy(page.alias("page")).agg(
        F.max(F.when(opens, F.col("path"))).alias("first_path"), F.max(F.when(closes, F.col("path"))).alias("last_path")
    )
    more = (F.col("page") + 1) * n < total
    return totals.join(ends, "page").withColumn("cursor", F.when(more, encode_cursor(F.col("last_path"))))


def manifest_page(df: DataFrame, after: Sequence[str] | None, n: int = MANIFEST_PAGE) -> DataFrame:
    """One page after a decoded cursor: a filter on the component array and a top-k."""
    rows = df.withColumn("_key", path_key(F.col("path")))
    if after is not None:
        rows = rows.filter(F.col("_key") > F.array(*[F.lit(part) for part in after]))
    return rows.orderBy("_key").limit(n).drop("_key")


def files_digest(df: DataFrame, group: str) -> DataFrame:
    """Count, bytes, top-level roots and SHA-256 of the sorted path list joined by LF, per file set of any size.

    A list's digest is one sequential pass, so a set is sorted into one task, which spills, and hashed as it streams by:
    no cell ever holds the list. ``tree_digest`` spreads a set over tasks.
    """
    rooted = df.groupBy(group, top_root(F.col("path")).alias("_root")).agg(F.count("*").alias("_n"), F.sum("size").alias("_bytes"))
    roots = F.array_join(F.array_sort(F.collect_list("_root")), ",")
    totals = rooted.groupBy(group).agg(F.sum("_n").alias("files"), F.sum("_bytes").alias("bytes"), roots.alias("roots"))
    hashed = _list_digests(df, [group]).select(F.col(group).alias("_group"), "sha256")
    joined = totals.join(hashed, F.col(group).eqNullSafe(F.col("_group")), "left").drop("_group")
    return joined.withColumn("digest", F.lit("paths"))


def range_digests(df: DataFrame, group: str, depth: int = 1) -> DataFrame:
    """Count and digest of each range of a file set: the paths that share their first ``depth`` components.

    A range's digest depends on its own paths alone, so ranges that did not change keep theirs.
    """
    own = F.array_join(F.slice(path_key(F.col("path")), 1, depth), "/")
    return _list_digests(df.select(group, own.alias("range"), "path"), [group, "range"])


def tree_digest(ranges: DataFrame, group: str) -> DataFrame:
    """Files and digest per file set from its ranges' digests, whatever its size; ``ranges`` may be merged from several lists."""
    line = F.concat_ws("\t", "range", F.col("files").cast("string"), "sha256")
    listed = _list_digests(ranges.select(group, F.struct("range", line.alias("line")).alias("path")), [group], "path.line")
    files = ranges.groupBy(F.col(group).alias("_group")).agg(F.sum("files").alias("_files"))
    joined = listed.withColumnRenamed("files", "ranges").join(files, F.col(group).eqNullSafe(F.col("_group")))
    return joined.select(group, F.col("_files").alias("files"), "ranges", "sha256")


def _list_digests(df: DataFrame, groups: list[str], text: str = "path") -> DataFrame:
    """Rows and SHA-256 of ``text`` joined by LF in the order of ``path``, per group; null paths are not listed."""
    rows = df.filter(F.col("path").isNotNull()).repartition(*groups).sortWithinPartitions(*groups, "path")
    kept = rows.select(*groups, F.col(text).alias("_text"))
    schema = T.StructType([*[kept.schema[name] for name in groups], T.StructField("files", T.LongType()), T.StructField("sha256", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, digest, files = None, None, 0
        for batch in batches:
            done = []
            keys = list(zip(*[batch.column(i).to_pylist() for i in range(len(groups))], strict=True))
            for key, members in groupby(zip(keys, batch.column(len(groups)).to_pylist(), strict=True), key=itemgetter(0)):
                part = [text for _, text in members]
                if key != known or digest is None:
                    if digest is not None:
                        done.append((*known, files, digest.hexdigest()))
                    known, digest, files = key, hashlib.sha256(), 0
                elif files:
                    digest.update(b"\n")
                digest.update("\n".join(part).encode())
                files += len(part)
            if done:
                yield _digest_rows(done, batch.schema, groups)
            seen = batch.schema
        if digest is not None:
            yield _digest_rows([(*known, files, digest.hexdigest())], seen, groups)

    return kept.mapInArrow(run, schema)


def _digest_rows(done: list[tuple], schema: pa.Schema, groups: list[str]) -> pa.RecordBatch:
    kinds = [*[schema.field(i).type for i in range(len(groups))], pa.int64(), pa.string()]
    columns = [pa.array(values, kind) for values, kind in zip(zip(*done, strict=True), kinds, strict=True)]
    return pa.RecordBatch.from_arrays(columns, [*groups, "files", "sha256"])


def version_pin(observations: DataFrame, group: Sequence[str] = ("path",)) -> DataFrame:
    """What a file's observations during packaging mean for it.

    ``observations`` has ``at`` (a total order within a file), ``present``, ``size`` and
    ``mtime``. A file gone before any part is a skip; gone afterwards, or changed in size or
    time between parts, it fails. Only mergeable numeric aggregates, so a hot file combines
    map-side in a hash table.
    """
    seen = {name: F.when(F.col("present"), F.col(name)) for name in ("size", "mtime")}
    gone_at = F.min(F.when(~F.col("present"), F.col("at")))
    part_at = F.min(F.when(F.col("present"), F.col("at")))
    summary = observations.groupBy(*group).agg(
        F.count("*").alias("observed"),
        *[(F.min(value) != F.max(value)).alias(f"_{name}_moved") for name, value in seen.items()],
        gone_at.alias("_gone"),
        part_at.alias("_part"),
    )
    verdict = (
        F.when(F.col("_part").isNull() | (F.col("_gone") < F.col("_part")), "skipped")
        .when(F.col("_size_moved") | F.col("_mtime_moved"), "changed")
        .when(F.col("_gone").isNotNull(), "vanished")
        .otherwise("pinned")
    )
    return summary.select(*group, "observed", verdict.alias("verdict"))
