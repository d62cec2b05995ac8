"""Table queries: catalogue, rendering, paging and slicing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parcelry.functions.literals import row_size, row_tuple, sql_literal
from parcelry.functions.scalars import bounded_message, to_integer
from parcelry.operators import paging, segments, slicing
from parcelry.operators.numbering import number_stored
from parcelry.plans import sql_text as sql
from parcelry.plans.bindings import TABLES, table
from parcelry.plans.registry import query
from parcelry.sources.tables import data_header, structure_text, table_catalog

ORDER_COLUMNS = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"]
LINE_COLUMNS = (
    "l_orderkey l_partkey l_suppkey l_linenumber l_quantity l_extendedprice l_discount l_tax l_returnflag l_linestatus l_shipdate"
).split()
NUMBERED_ORDERS = f"""numbered as (
  select o_orderkey, row_number() over (order by o_orderkey) - 1 as rn, {sql.ORDERS_TUPLE} as tuple from orders)"""
DOC_BUDGET = 100_000
NUMBERED_DOCS = f"""numbered as (
  select doc_id, strlen(tuple) + 1 as bytes, rn, total, sum(strlen(tuple) + 1) over (order by rn) as upto from (
    select doc_id, {sql.DOCUMENTS_TUPLE} as tuple, row_number() over (order by doc_id) as rn, count(*) over () as total from documents)),
jumps as (
  select a.rn, least(a.rn + 1000, coalesce(min(b.rn) + 1, any_value(a.total) + 1)) as next_rn
  from numbered a left join numbered b on b.rn >= a.rn and b.upto - a.upto + a.bytes >= {DOC_BUDGET} group by a.rn),
cuts as (
  select cast(0 as bigint) as slice, cast(1 as bigint) as first_rn, (select next_rn from jumps where rn = 1) as next_rn
  union all select c.slice + 1, c.next_rn, j.next_rn from cuts c join jumps j on j.rn = c.next_rn)"""
LINE_SELECT = ", ".join(LINE_COLUMNS[:-1]) + ", strftime(l_shipdate, '%Y-%m-%d') as l_shipdate"


@query("table_catalog", " union all ".join(f"select '{t}' as name, count(*) as rows from {t}" for t in TABLES))
def _catalog(spark: SparkSession, sf: str) -> DataFrame:
    return table_catalog(spark, {name: f"{sf}/{name}.parquet" for name in TABLES}).select("name", "rows")


@query("sql_literal", f"select doc_id, md5({sql.literal('text')}) as literal_md5, strlen({sql.literal('text')}) as bytes from documents")
def _literal(spark: SparkSession, sf: str) -> DataFrame:
    text = sql_literal(F.col("text"))
    return table(spark, sf, "documents").select(
        "doc_id", F.md5(text.cast("binary")).alias("literal_md5"), F.octet_length(text).cast("bigint").alias("bytes")
    )


@query("row_tuple", f"select {sql.LINEITEM_TUPLE} as tuple from lineitem")
def _tuple(spark: SparkSession, sf: str) -> DataFrame:
    lines = table(spark, sf, "lineitem")
    return lines.select(row_tuple(lines).alias("tuple"))


@query("bounded_message", "select doc_id, case when length(text) > 300 then left(text, 300) || '…' else text end as message from documents")
def _message(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", bounded_message(F.col("text")).alias("message"))


@query(
    "numeric_text",
    """with forms as (
  select event_id, unnest([cast(cast(value as decimal(18,2)) as varchar), regexp_extract(props, '([0-9]+)', 1),
    '-' || regexp_extract(props, '([0-9]+)', 1), regexp_extract(props, '([0-9]+)', 1) || 'e2', props, event_type]) as text, unnest(range(6)) as form
  from events)
select event_id, cast(form as int) as form, case when regexp_full_match(text, '[+-]?([0-9]+(\\.[0-9]*)?|\\.[0-9]+)([eE][+-]?[0-9]+)?')
  then cast(trunc(try_cast(text as double)) as bigint) else 0 end as number from forms""",
)
def _numbers(spark: SparkSession, sf: str) -> DataFrame:
    digits = F.regexp_extract("props", "([0-9]+)", 1)
    forms = F.array(
        F.col("value").cast("decimal(18,2)").cast("string"), digits, F.concat(F.lit("-"), digits),
        F.concat(digits, F.lit("e2")), F.col("props"), F.col("event_type"),
    )
    spread = table(spark, sf, "events").select("event_id", F.posexplode(forms).alias("form", "text"))
    return spread.select("event_id", "form", to_integer(F.col("text")).alias("number"))


@query("keyset_after", "select conv_id, turn, role from conversations where (conv_id, turn) > (40, 2)")
def _after(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "conversations").filter(paging.after_key(["conv_id", "turn"], [40, 2]))
    return rows.select("conv_id", "turn", "role")


@query("page_after", "select o_orderkey, o_custkey, o_orderstatus from orders where o_orderkey > 500 order by o_orderkey limit 1000")
def _page(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    return paging.page_after(rows, ["o_orderkey"], [500], 1000)


def _dated_lines(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").select(*LINE_COLUMNS)


@query("page_offset", f"select {LINE_SELECT} from lineitem order by {', '.join(f'lineitem.{c}' for c in LINE_COLUMNS)} limit 500 offset 2000")
def _offset(spark: SparkSession, sf: str) -> DataFrame:
    page = paging.page_offset_by(_dated_lines(spark, sf), LINE_COLUMNS, 2000, 500)
    return page.withColumn("l_shipdate", F.date_format("l_shipdate", "yyyy-MM-dd"))


@query("page_offset_stored", f"select {LINE_SELECT} from lineitem limit 500 offset 2000")
def _offset_stored(spark: SparkSession, sf: str) -> DataFrame:
    page = paging.page_offset(_dated_lines(spark, sf), 2000, 500)
    return page.withColumn("l_shipdate", F.date_format("l_shipdate", "yyyy-MM-dd"))


@query(
    "keyset_pages",
    """with pages_of as (
  select conv_id, turn, (row_number() over (order by conv_id, turn) - 1) // 37 as page from conversations)
select page, count(*) as rows, arg_min(conv_id, row(conv_id, turn)) as first_conv_id, arg_min(turn, row(conv_id, turn)) as first_turn,
  arg_max(conv_id, row(conv_id, turn)) as last_conv_id, arg_max(turn, row(conv_id, turn)) as last_turn
from pages_of group by page""",
)
def _pages(spark: SparkSession, sf: str) -> DataFrame:
    return paging.keyset_pages(table(spark, sf, "conversations"), ["conv_id", "turn"], 37)


@query(
    "slice_rows",
    f"with {NUMBERED_ORDERS} select o_orderkey, rn // 1000 as slice, rn % 1000 + 1 as row_in_slice from numbered",
)
def _slice_rows(spark: SparkSession, sf: str) -> DataFrame:
    return sliced_orders(spark, sf, ["o_orderkey"]).rows.select("o_orderkey", "slice", "row_in_slice")


@query(
    "slice_keyless",
    """with numbered as (select l_orderkey, l_partkey, l_suppkey, l_linenumber, row_number() over () - 1 as rn from lineitem)
select l_orderkey, l_partkey, l_suppkey, l_linenumber, rn // 700 as slice, rn % 700 + 1 as row_in_slice from numbered""",
)
def _slice_keyless(spark: SparkSession, sf: str) -> DataFrame:
    lines = table(spark, sf, "lineitem")
    numbered, total = number_stored(lines)
    sized = numbered.withColumn("row_bytes", row_size(lines) + 1)
    sliced = slicing.cut_slices(sized, total, 750, slicing.SLICE_BYTES)
    return sliced.rows.select(*LINE_COLUMNS[:4], "slice", "row_in_slice")


@query(
    "slice_bytes",
    f"""with recursive {NUMBERED_DOCS}
select n.doc_id, c.slice, n.rn - c.first_rn + 1 as row_in_slice from numbered n join cuts c on n.rn >= c.first_rn and n.rn < c.next_rn""",
)
def _slice_bytes(spark: SparkSession, sf: str) -> DataFrame:
    sliced = slicing.slice_table(table(spark, sf, "documents"), ["doc_id"], 1000, DOC_BUDGET, keep=["doc_id"])
    return sliced.rows.select("doc_id", "slice", "row_in_slice")


SUMMARY_SQL = f"""with {NUMBERED_ORDERS}, filled as (
  select rn // 1000 as slice, count(*) as rows, cast(sum(strlen(tuple) + 1) as bigint) as bytes, min(o_orderkey) as first_o_orderkey, max(o_orderkey) as last_o_orderkey
  from numbered group by 1),
closed as (
  select * from filled union all
  select (select count(*) from filled), 0, 0, -1, -1 where (select count(*) from orders) % 1000 = 0)
select *, slice = (select max(slice) from closed) as complete from closed"""


@query("slice_summary", SUMMARY_SQL)
def _slice_summary(spark: SparkSession, sf: str) -> DataFrame:
    summary = slicing.slice_summary(sliced_orders(spark, sf, ["o_orderkey"]), ["o_orderkey"])
    return summary.fillna(-1, ["first_o_orderkey", "last_o_orderkey"])


@query(
    "insert_batches",
    f"""with {NUMBERED_ORDERS}
select rn // 1000 as slice, (rn % 1000) // 100 as batch, count(*) as rows,
  'INSERT INTO `orders` VALUES ' || string_agg(tuple, ',' order by rn) || ';' || chr(10) as statement from numbered group by 1, 2""",
)
def _batches(spark: SparkSession, sf: str) -> DataFrame:
    return segments.insert_batches(sliced_orders(spark, sf), "orders", ORDER_COLUMNS)


ORDERS_DDL = (
    "--\n-- Table structure for table `orders`\n--\n\nDROP TABLE IF EXISTS `orders`;\nCREATE TABLE `orders` (\n"
    "  `o_orderkey` BIGINT,\n  `o_custkey` BIGINT,\n  `o_orderstatus` STRING,\n  `o_totalprice` DOUBLE,\n"
    "  `o_orderdate` TIMESTAMP_NTZ,\n  `o_orderpriority` STRING\n);\n\n--\n-- Dumping data for table `orders`\n--\n\n"
)


@query(
    "table_segments",
    f"""with {NUMBERED_ORDERS}, statements as (
  select rn // 1000 as part, (rn % 1000) // 100 as batch,
    'INSERT INTO `orders` VALUES ' || string_agg(tuple, ',' order by rn) || ';' || chr(10) as statement from numbered group by 1, 2),
payloads as (
  select part, case when part = 0 then '{ORDERS_DDL}' else '' end || string_agg(statement, '' order by batch) as payload from statements group by part
  union all select (select count(*) from orders) // 1000, '' where (select count(*) from orders) % 1000 = 0)
select part, 'orders' as name, strlen(payload) as bytes, md5(payload) as payload_md5 from payloads""",
)
def _table_segments(spark: SparkSession, sf: str) -> DataFrame:
    orders = table(spark, sf, "orders")
    prefix = structure_text("orders", orders.schema) + data_header("orders")
    parts = segments.table_segments(sliced_orders(spark, sf), "orders", ORDER_COLUMNS, prefix)
    return parts.select(
        "part", "name", F.octet_length("payload").cast("bigint").alias("bytes"), F.md5("payload").alias("payload_md5")
    )


def sliced_orders(spark: SparkSession, sf: str, keep: list[str] | None = None) -> slicing.Slices:
    return slicing.slice_table(table(spark, sf, "orders"), ["o_orderkey"], keep=keep)


def flagship(spark: SparkSession, sf: str) -> DataFrame:
    """One row per 1000-row slice of the orders: its key range, rows and rendered bytes."""
    return _slice_summary(spark, sf).drop("complete")


