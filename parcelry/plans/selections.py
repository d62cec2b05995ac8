"""Selection queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parcelry.operators import selection as sel
from parcelry.plans import sql_text as sql
from parcelry.plans.bindings import order_requests, order_selection, part_manifest, supplier_catalog
from parcelry.plans.registry import query

MISSING_SQL = "select job_id, kind, ordinal, name from selection where kind in ('table', 'structure') and name not in (select name from catalog)"


@query("missing_tables", f"with {sql.ORDER_SELECTION} {MISSING_SQL}")
def _missing(spark: SparkSession, sf: str) -> DataFrame:
    return sel.missing_tables(order_selection(spark, sf), supplier_catalog(spark, sf))


@query("classify_files", f"with {sql.ORDER_SELECTION} select job_id, ordinal, name, class from classified")
def _classify(spark: SparkSession, sf: str) -> DataFrame:
    return sel.classify_files(order_selection(spark, sf), part_manifest(spark, sf))


@query(
    "selection_overlap",
    f"""with {sql.ORDER_SELECTION} select job_id, name from selection where kind = 'table'
intersect select job_id, name from selection where kind = 'structure'""",
)
def _overlap(spark: SparkSession, sf: str) -> DataFrame:
    return sel.selection_overlap(order_selection(spark, sf))


@query(
    "all_missing",
    f"""with {sql.ORDER_SELECTION}, gone as ({MISSING_SQL})
select job_id, kind, ordinal, name, 'no_table' as reason from gone
union all select job_id, 'file', ordinal, name, class from classified where class <> 'kept'""",
)
def _all_missing(spark: SparkSession, sf: str) -> DataFrame:
    return sel.all_missing(order_selection(spark, sf), supplier_catalog(spark, sf), part_manifest(spark, sf))


@query(
    "skip_report",
    f"""with {sql.ORDER_REQUESTS}, {sql.ORDER_SELECTION}
select c.job_id, c.ordinal, c.name from classified c join requests r on r.job_id = c.job_id
where c.class = 'vanished' and coalesce(r.strict, 'true') <> 'true'""",
)
def _skips(spark: SparkSession, sf: str) -> DataFrame:
    return sel.skip_report(order_selection(spark, sf), part_manifest(spark, sf), order_requests(spark, sf))


@query(
    "selection_verdict",
    f"""with {sql.ORDER_REQUESTS}, {sql.ORDER_SELECTION},
entries as (
  select s.*, c.class, case when kind <> 'file' and s.name not in (select name from catalog) then 1 else 0 end as no_table,
    count(*) over (partition by s.job_id, s.kind, s.name) as copies,
    case when kind = 'file' and regexp_matches(lower(regexp_extract(s.name, '[^/]*$')), '^wp-config\\.php\\..+$') then 1 else 0 end as restricted
  from selection s left join (select distinct job_id, ordinal, name, class from classified) c
    on c.job_id = s.job_id and c.ordinal = s.ordinal and c.name = s.name and s.kind = 'file'),
both_lists as (
  select job_id, name from selection where kind = 'table' intersect select job_id, name from selection where kind = 'structure'),
per_job as (
  select job_id, count(*) as entries, max(copies) as copies, max(no_table) as no_table, max(restricted) as restricted,
    bool_or(class = 'out_of_bounds') as out_of_bounds, bool_or(class = 'vanished') as vanished, bool_or(kind <> 'file') as has_table,
    bool_or(class = 'kept') as has_kept from entries group by job_id)
select r.job_id, coalesce(p.entries, 0) as entries, case
  when p.entries is null or p.copies > 1 then 'malformed'
  when p.entries > 500000 then 'too_large'
  when r.job_id in (select job_id from both_lists) then 'overlap'
  when r.strict is not null and r.strict not in ('true', 'false') then 'bad_flag'
  when r.chunk_size is not null and cast(r.chunk_size as bigint) < 1 then 'bad_size'
  when p.restricted = 1 then 'restricted'
  when p.no_table = 1 or coalesce(p.out_of_bounds, false) then 'unknown'
  when coalesce(r.strict, 'true') = 'true' and coalesce(p.vanished, false) then 'unknown'
  when coalesce(r.strict, 'true') <> 'true' and not p.has_table and not coalesce(p.has_kept, false) then 'unknown'
  else 'ok' end as verdict
from requests r left join per_job p on p.job_id = r.job_id""",
)
def _verdict(spark: SparkSession, sf: str) -> DataFrame:
    return sel.selection_verdict(
        order_requests(spark, sf), order_selection(spark, sf), supplier_catalog(spark, sf), part_manifest(spark, sf)
    )


@query(
    "distinct_first",
    f"""with {sql.ORDER_SELECTION} select kind, name, min(job_id * 100000000000 + ordinal) as first_seen from selection group by kind, name""",
)
def _first(spark: SparkSession, sf: str) -> DataFrame:
    position = F.col("job_id") * 100000000000 + F.col("ordinal")
    return sel.distinct_first(order_selection(spark, sf), ["kind"], "name", position)
