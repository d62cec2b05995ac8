"""A whole extraction: check the selection, slice and render, publish, and record it."""

from __future__ import annotations

import time
from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from parcelry.functions.paths import is_restricted, resolved
from parcelry.operators import selection as sel
from parcelry.operators.manifest import files_digest
from parcelry.operators.ordered import running_sum_in_group
from parcelry.operators.segments import PART_BYTES, table_segments
from parcelry.operators.slicing import SLICE_BYTES, SLICE_ROWS, slice_table
from parcelry.plans import sql_text as sql
from parcelry.plans.bindings import table
from parcelry.plans.registry import query
from parcelry.plans.tables import NUMBERED_ORDERS, ORDERS_DDL
from parcelry.session import scratch_path, scratch_scope
from parcelry.sources.audit_log import append_audit
from parcelry.sources.files import MANIFEST_SCHEMA, file_manifest, read_parts, read_present_parts
from parcelry.sources.segment_store import read_segments, write_segments
from parcelry.sources.tables import data_header, structure_segments, structure_text

API_VERSION = 7


class SelectionRefused(ValueError):
    """A selection that fails a check; ``verdict`` names the check, ``names`` what failed it."""

    def __init__(self, verdict: str, names: list[str]) -> None:
        super().__init__(f"{verdict}: {', '.join(names)}" if names else verdict)
        self.verdict, self.names = verdict, names


@dataclass(frozen=True)
class Source:
    """A table that may be selected: its rows, and its key or (keyless) its total order."""

    rows: DataFrame
    key: Sequence[str] = ()
    order: Sequence[str | Column] = ()


@dataclass(frozen=True)
class Request:
    """What to extract, and how large its pieces may be."""

    job_id: int
    tables: Sequence[str] = ()
    structure_only: Sequence[str] = ()
    files: Sequence[str] = ()
    strict: bool = True
    part_bytes: int = PART_BYTES
    slice_rows: int = SLICE_ROWS
    slice_bytes: int = SLICE_BYTES
    user_id: int = 0
    user_login: str = ""
    skipped: list[str] = field(default_factory=list)


def selection_rows(spark: SparkSession, request: Request) -> DataFrame:
    """The request's lists as selection rows; a request holds at most half a million names."""
    lists = {"table": request.tables, "structure": request.structure_only, "file": request.files}
    rows = [(request.job_id, kind, i, name) for kind, names in lists.items() for i, name in enumerate(names)]
    return spark.createDataFrame(rows, "job_id bigint, kind string, ordinal bigint, name string")


def check(spark: SparkSession, request: Request, sources: dict[str, Source], manifest: DataFrame) -> DataFrame:
    """The selection's rows when every check passes; raises with every offending name otherwise."""
    rows = selection_rows(spark, request)
    catalog = spark.createDataFrame([(name,) for name in sources], "name string")
    head = [(request.job_id, str(request.strict).lower(), str(request.part_bytes))]
    heads = spark.createDataFrame(head, "job_id bigint, strict string, chunk_size string")
    verdict = sel.selection_verdict(heads, rows, catalog, manifest).first()["verdict"]
    if verdict == "ok":
        return rows
    failing = {
        "restricted": lambda: rows.filter((F.col("kind") == "file") & is_restricted(F.col("name"))),
        "overlap": lambda: sel.selection_overlap(rows),
        "unknown": lambda: sel.all_missing(rows, catalog, manifest),
    }
    names = [row["name"] for row in failing[verdict]().select("name").collect()] if verdict in failing else []
    raise SelectionRefused(verdict, sorted(names))


def extract(
    spark: SparkSession, request: Request, sources: dict[str, Source], path: str, root: str | None = None, log: str | None = None
) -> DataFrame:
    """Publishes the selected tables, structures and files as segments below ``path``."""
    with scratch_scope(spark):
        manifest = file_manifest(spark, root) if root and request.files else spark.createDataFrame([], MANIFEST_SCHEMA)
        rows = check(spark, request, sources, manifest)
        chosen = _chosen_files(rows, manifest)
        if request.files:
            gone = sel.classify_files(rows, manifest).filter(F.col("class") == "vanished").orderBy("ordinal")
            request.skipped[:] = [row["name"] for row in gone.collect()]
        content = None
        if request.files and request.strict:
            content = read_parts(chosen, root, request.part_bytes)
        elif request.files:
            content, gone = read_present_parts(chosen, root, request.part_bytes)
            request.skipped.extend(row["name"] for row in chosen.join(gone, "path", "left_semi").orderBy("ordinal").collect())
            chosen = chosen.join(gone, "path", "left_anti")
        pieces = _pieces(spark, request, sources, chosen, content)
        write_segments(pieces.withColumn("artifact", F.lit(str(request.job_id))), path)
        if log:
            append_audit(_audit_entry(spark, request, chosen), log)
    return read_segments(spark, path)


def _pieces(spark: SparkSession, request: Request, sources: dict[str, Source], chosen: DataFrame, content: DataFrame | None) -> DataFrame:
    """Segments with their place in the artifact.

    Every place is known before anything is rendered: slices are counted when they are cut,
    parts follow from the sizes of the files that are there. So payloads are rendered once and never renumbered.
    """
    pieces, seq = [], 0
    for name in request.tables:
        source = sources[name]
        sliced = slice_table(
            source.rows, list(source.key), request.slice_rows, request.slice_bytes, order=list(source.order) or None
        )
        prefix = structure_text(name, source.rows.schema) + data_header(name)
        parts = table_segments(sliced, name, source.rows.columns, prefix)
        pieces.append(parts.select((F.col("part") + seq).alias("seq"), "name", "payload"))
        seq += sliced.count + (1 if sliced.needs_empty_tail else 0)
    if request.structure_only:
        definitions = structure_segments({name: sources[name].rows for name in request.structure_only})
        pieces.append(definitions.select((F.col("ordinal") + seq).alias("seq"), "name", "payload"))
        seq += len(request.structure_only)
    if request.files:
        pieces.append(_file_pieces(chosen, content, request.part_bytes, seq))
    return reduce(DataFrame.unionByName, pieces)


def _chosen_files(rows: DataFrame, manifest: DataFrame) -> DataFrame:
    wanted = rows.filter(F.col("kind") == "file").select("ordinal", "name", resolved(F.col("name")).alias("path"))
    return wanted.join(manifest, "path")


def _file_pieces(chosen: DataFrame, content: DataFrame, part_bytes: int, first: int) -> DataFrame:
    parts = F.greatest(F.ceil(F.col("size") / part_bytes), F.lit(1)).cast("bigint")
    placed = running_sum_in_group(chosen.withColumn("_parts", parts).withColumn("_job", F.lit(0)), ["_job"], ["ordinal"], {"_upto": F.col("_parts")})
    starts = placed.select("path", "name", (F.col("_upto") - F.col("_parts") + first).alias("_start"))
    joined = content.join(starts, "path")
    return joined.select((F.col("_start") + F.floor(F.col("offset") / part_bytes)).alias("seq"), "name", "payload")


def _audit_entry(spark: SparkSession, request: Request, chosen: DataFrame) -> DataFrame:
    names = chosen.select(F.lit(request.job_id).alias("job"), F.col("name").alias("path"), "size")
    digest = files_digest(names, "job").first() if request.files else None
    summary = (0, 0, [], "") if digest is None else (digest["files"], digest["bytes"], digest["roots"].split(","), digest["sha256"])
    entry = (
        int(time.time()), request.job_id, request.user_id, request.user_login, API_VERSION, request.job_id,
        list(request.tables), list(request.structure_only), summary,
    )
    schema = (
        "ts bigint, seq bigint, user_id bigint, user_login string, api_version int, job_id bigint, tables array<string>, "
        "tables_structure_only array<string>, files struct<count: bigint, bytes: bigint, roots: array<string>, sha256: string>"
    )
    return spark.createDataFrame([entry], schema)


_talk_tuple = sql.row_tuple(sql.whole("conv_id"), sql.whole("turn"), "role", "text")
_talk_head = (
    "--\n-- Table structure for table `conversations`\n--\n\nDROP TABLE IF EXISTS `conversations`;\nCREATE TABLE `conversations` (\n"
    "  `conv_id` BIGINT,\n  `turn` BIGINT,\n  `role` STRING,\n  `text` STRING\n);\n\n--\n-- Dumping data for table `conversations`\n--\n\n"
)
_nation_ddl = (
    "--\n-- Table structure for table `nation`\n--\n\nDROP TABLE IF EXISTS `nation`;\nCREATE TABLE `nation` (\n"
    "  `n_nationkey` INT,\n  `n_name` STRING,\n  `n_regionkey` INT\n);\n"
)


@query(
    "extraction",
    f"""with {NUMBERED_ORDERS}, talks as (select row_number() over (order by conv_id, turn) - 1 as rn, {_talk_tuple} as tuple from conversations),
statements as (
  select 0 as place, 'orders' as name, rn // 1000 as part, (rn % 1000) // 100 as batch, 'INSERT INTO `orders` VALUES ' || string_agg(tuple, ',' order by rn) || ';' || chr(10) as statement
  from numbered group by 3, 4
  union all select 1, 'conversations', rn // 1000, (rn % 1000) // 100, 'INSERT INTO `conversations` VALUES ' || string_agg(tuple, ',' order by rn) || ';' || chr(10)
  from talks group by 3, 4),
payloads as (
  select place, name, part, case when part > 0 then '' when name = 'orders' then '{ORDERS_DDL}' else '{_talk_head}' end || string_agg(statement, '' order by batch) as payload
  from statements group by 1, 2, 3
  union all select 0, 'orders', (select count(*) from orders) // 1000, '' where (select count(*) from orders) % 1000 = 0
  union all select 1, 'conversations', (select count(*) from conversations) // 1000, '' where (select count(*) from conversations) % 1000 = 0
  union all select 2, 'nation', 0, '{_nation_ddl}')
select row_number() over (order by place, part) - 1 as seq, name, strlen(payload) as bytes, md5(payload) as payload_md5 from payloads""",
)
def _extraction(spark: SparkSession, sf: str) -> DataFrame:
    sources = {
        "orders": Source(table(spark, sf, "orders"), ["o_orderkey"]),
        "conversations": Source(table(spark, sf, "conversations"), ["conv_id", "turn"]),
        "nation": Source(table(spark, sf, "nation"), ["n_nationkey"]),
    }
    request = Request(1, ["orders", "conversations"], ["nation"], slice_bytes=1 << 40)
    published = extract(spark, request, sources, scratch_path(spark, "artifact"))
    return published.select(
        "seq", "name", F.octet_length("payload").cast("bigint").alias("bytes"), F.md5("payload").alias("payload_md5")
    )
