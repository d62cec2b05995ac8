"""Audit and job-journal queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parcelry.operators import budgets, journal, paging, segments
from parcelry.plans import sql_text as sql
from parcelry.plans.bindings import NOW, chat_selection, document_segments, jobs, table
from parcelry.plans.bindings import journal as events
from parcelry.plans.bindings import unix
from parcelry.plans.registry import query
from parcelry.session import scratch_path
from parcelry.sources.audit_log import append_audit, read_audit, rotate_audit
from parcelry.sources.segment_store import read_segments, write_segments

API_VERSION = 7
READY = "ready as (select event_id as seq, ts, job_id, us, k from journal where state = 'ready')"


def audit_entries(spark: SparkSession, sf: str) -> DataFrame:
    return entries_of(events(spark, sf))


def entries_of(rows: DataFrame) -> DataFrame:
    """One entry per ready event of the journal."""
    k = F.col("k").cast("string")
    ready = rows.filter(F.col("state") == "ready")
    return ready.select(
        "ts",
        F.col("event_id").alias("seq"),
        F.col("job_id").alias("user_id"),
        F.concat(F.lit("user"), k).alias("user_login"),
        F.lit(API_VERSION).alias("api_version"),
        "job_id",
        F.array(F.concat(F.lit("t"), k)).alias("tables"),
        F.array().cast("array<string>").alias("tables_structure_only"),
        F.struct(
            F.col("k").alias("count"), F.col("us").alias("bytes"), F.array(F.lit("f")).alias("roots"),
            F.sha2(F.concat(F.lit("f/"), k).cast("binary"), 256).alias("sha256"),
        ).alias("files"),
    )


@query(
    "audit_read",
    f"""with {sql.JOURNAL}, {READY}
select ts, seq, job_id, 'user' || k as user_login, {API_VERSION} as api_version, 't' || k as tables, k as files, us as bytes,
  'f' as roots, sha256('f/' || k) as sha256, strftime(to_timestamp(ts) at time zone 'UTC', '%Y-%m-%d') as day from ready""",
)
def _read(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_path(spark, "audit")
    append_audit(audit_entries(spark, sf), path)
    return read_audit(spark, path).select(
        "ts", "seq", "job_id", "user_login", "api_version", F.array_join("tables", ",").alias("tables"),
        F.col("files.count").alias("files"), "files.bytes", F.array_join("files.roots", ",").alias("roots"), "files.sha256",
        F.col("day").cast("string").alias("day"),
    )


@query(
    "audit_window",
    f"""with {sql.JOURNAL}, {READY} select seq, job_id, ts from ready
where ts >= epoch(timestamp '2024-01-10 00:00:00') and ts < epoch(timestamp '2024-01-14 00:00:00')""",
)
def _window(spark: SparkSession, sf: str) -> DataFrame:
    return paging.day_window(audit_entries(spark, sf), "2024-01-10", "2024-01-13").select("seq", "job_id", "ts")


@query("audit_retention", f"with {sql.JOURNAL}, {READY} select seq, job_id, ts from ready where ts > {NOW} - 10 * 86400")
def _retention(spark: SparkSession, sf: str) -> DataFrame:
    return journal.retain(audit_entries(spark, sf), NOW, 10).select("seq", "job_id", "ts")


@query("audit_rotation", f"with {sql.JOURNAL}, {READY} select seq, job_id, ts from ready where ts > {NOW} - 10 * 86400")
def _rotation(spark: SparkSession, sf: str) -> DataFrame:
    """What a stored log holds after its rotation."""
    path = scratch_path(spark, "audit")
    append_audit(audit_entries(spark, sf), path)
    rotate_audit(spark, path, NOW, 10)
    return read_audit(spark, path).select("seq", "job_id", "ts")


@query(
    "audit_page",
    f"""with {sql.JOURNAL}, {READY}
select strftime(to_timestamp(ts) at time zone 'UTC', '%Y-%m-%dT%H:%M:%SZ') as ts, seq, job_id, (select count(*) from ready) as total
from ready order by ready.ts desc, seq limit 50 offset 100""",
)
def _page(spark: SparkSession, sf: str) -> DataFrame:
    return paging.audit_page(audit_entries(spark, sf), page=3, per_page=50).select("ts", "seq", "job_id", "total")


@query(
    "audit_logins",
    f"""with {sql.JOURNAL}, {READY} select seq, r.job_id as user_id, coalesce(c.c_name, '') as user_login
from ready r left join customer c on c.c_custkey = r.job_id and c.c_acctbal >= 2000""",
)
def _logins(spark: SparkSession, sf: str) -> DataFrame:
    users = table(spark, sf, "customer").filter(F.col("c_acctbal") >= 2000)
    users = users.select(F.col("c_custkey").alias("user_id"), F.col("c_name").alias("login"))
    return journal.with_login(audit_entries(spark, sf).select("seq", "user_id"), users)


def job_segments(spark: SparkSession, sf: str) -> DataFrame:
    """Chunks sealed per job: one per advance."""
    k = F.col("k")
    kind = F.when(k < 30, "table").when(k < 40, "structure").otherwise("file")
    return events(spark, sf).filter(F.col("kind") == "advance").select(
        "job_id", kind.alias("kind"), (k % 6).alias("ordinal"), (F.col("us") > 15000).alias("last")
    )


PROGRESS_SQL = """sealed as (
  select job_id, case when k < 30 then 'table' when k < 40 then 'structure' else 'file' end as kind, k % 6 as ordinal,
    count(*) as chunks, max(us) > 15000 as done from journal where kind = 'advance' group by 1, 2, 3),
done as (
  select job_id, count(*) filter (kind <> 'file' and done) as tables_sealed, count(*) filter (kind = 'file' and done) as files_sealed,
    cast(sum(chunks) as bigint) as chunks from sealed group by job_id),
totals as (
  select job_id, count(*) filter (kind <> 'file') as tables_total, count(*) filter (kind = 'file') as files_total from chat_selection group by job_id),
progress as (
  select j.job_id, j.state,
    coalesce(case when state = 'ready' then tables_total else tables_sealed end, 0) as tables_done, coalesce(tables_total, 0) as tables_total,
    coalesce(case when state = 'ready' then files_total else files_sealed end, 0) as files_done, coalesce(files_total, 0) as files_total,
    coalesce(chunks, 0) as chunks_done
  from jobs j left join totals t using (job_id) left join done d using (job_id) where state in ('running', 'ready'))"""


@query("job_progress", f"with {sql.JOBS}, {sql.CHAT_SELECTION}, {PROGRESS_SQL} select * from progress")
def _progress(spark: SparkSession, sf: str) -> DataFrame:
    return journal.progress(job_segments(spark, sf), chat_selection(spark, sf), jobs(spark, sf))


@query(
    "list_jobs",
    f"""with {sql.JOBS}, {sql.CHAT_SELECTION}, {PROGRESS_SQL}
select j.job_id, j.owner, j.state, j.created_at, j.updated_at, coalesce(p.chunks_done, -1) as chunks_done, coalesce(p.files_total, -1) as files_total
from jobs j left join progress p using (job_id) where owner in (select n_nationkey from nation where n_regionkey in (select r_regionkey from region where r_name <> 'ASIA'))""",
)
def _list(spark: SparkSession, sf: str) -> DataFrame:
    """Jobs of every owner outside one region, finished ones included."""
    known = jobs(spark, sf)
    counters = journal.progress(job_segments(spark, sf), chat_selection(spark, sf), known).select("job_id", "chunks_done", "files_total")
    nations, regions = table(spark, sf, "nation"), table(spark, sf, "region").filter(F.col("r_name") != "ASIA")
    owners = nations.join(regions, nations["n_regionkey"] == regions["r_regionkey"], "left_semi")
    listed = journal.list_jobs(
        known.join(counters, "job_id", "left"), owners.select(F.col("n_nationkey").cast("bigint").alias("owner")), include_terminal=True
    )
    return listed.fillna(-1, ["chunks_done", "files_total"])


@query(
    "expired_jobs",
    f"""with {sql.JOBS} select job_id, state, created_at, updated_at, coalesce(progressed_at, -1) as progressed_at from jobs
where state <> 'consumed' and ({NOW} - updated_at > 14400 or {NOW} - coalesce(progressed_at, created_at) > 86400)""",
)
def _expired(spark: SparkSession, sf: str) -> DataFrame:
    late = journal.expired(jobs(spark, sf), NOW, ttl=14400)
    return late.select("job_id", "state", "created_at", "updated_at", "progressed_at").fillna(-1, ["progressed_at"])


@query(
    "stale_jobs",
    f"with {sql.JOBS} select job_id, state, updated_at from jobs where state = 'queued' or (state = 'running' and {NOW} - updated_at > 120)",
)
def _stale(spark: SparkSession, sf: str) -> DataFrame:
    return journal.needs_advance(jobs(spark, sf), NOW).select("job_id", "state", "updated_at")


@query(
    "orphan_artifacts",
    """with artifacts as (
  select md5(cast(o_orderkey as varchar)) || case when o_orderstatus = 'P' then '.tmp' else '.sealed' end as artifact, epoch_us(o_orderdate) // 1000000 as mtime
  from orders)
select artifact, mtime from artifacts where artifact like '%.sealed' and 946684800 - mtime > 3600
  and artifact not in (select md5(cast(l_orderkey as varchar)) || '.sealed' from lineitem where l_returnflag = 'A')""",
)
def _orphans(spark: SparkSession, sf: str) -> DataFrame:
    """Order artifacts against the jobs of the order lines, as of 2000-01-01."""
    name = lambda column: F.md5(F.col(column).cast("string").cast("binary"))
    suffix = F.when(F.col("o_orderstatus") == "P", ".tmp").otherwise(".sealed")
    artifacts = table(spark, sf, "orders").select(
        F.concat(name("o_orderkey"), suffix).alias("artifact"), unix(F.col("o_orderdate")).alias("mtime")
    )
    claimed = table(spark, sf, "lineitem").filter(F.col("l_returnflag") == "A")
    claimed = claimed.select(F.concat(name("l_orderkey"), F.lit(".sealed")).alias("artifact"))
    return journal.orphans(artifacts, claimed, 946684800).select("artifact", "mtime")


@query(
    "attempt_names",
    f"""with {sql.JOURNAL}, {sql.CHAT_SELECTION}, attempts as (
  select event_id, job_id, ts, case when k < 50 then 'file' when k < 80 then 'table' when k < 90 then 'structure' else 'index' end as kind, k % 8 as n
  from journal where kind = 'attempt')
select event_id, a.job_id, a.kind, n, coalesce(s.name, '') as name from attempts a
left join chat_selection s on s.job_id = a.job_id and s.kind = a.kind and s.ordinal = a.n""",
)
def _attempts(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("k")
    kind = F.when(k < 50, "file").when(k < 80, "table").when(k < 90, "structure").otherwise("index")
    attempts = events(spark, sf).filter(F.col("kind") == "attempt").select("event_id", "job_id", kind.alias("kind"), (k % 8).alias("n"))
    return journal.resolve_attempts(attempts, chat_selection(spark, sf)).fillna("", ["name"])


@query(
    "last_attempts",
    f"""with {sql.JOURNAL}, ranked as (
  select job_id, event_id, ts, k, row_number() over (partition by job_id order by ts desc, event_id desc) as recency from journal where kind = 'attempt')
select job_id, event_id, ts, k, cast(recency as int) as recency from ranked where recency <= 8""",
)
def _ring(spark: SparkSession, sf: str) -> DataFrame:
    attempts = events(spark, sf).filter(F.col("kind") == "attempt").select("job_id", "event_id", "ts", "k")
    return journal.last_n(attempts)


@query(
    "stall_runs",
    f"""with {sql.JOURNAL}, runs as (
  select job_id, kind, sum(case when kind = 'advance' then 1 else 0 end) over (partition by job_id order by ts, event_id rows unbounded preceding) as run from journal)
select job_id, cast(run as bigint) as run, count(*) filter (kind = 'attempt') as attempts, count(*) filter (kind = 'attempt') >= 2 as stalled from runs group by 1, 2""",
)
def _stalls(spark: SparkSession, sf: str) -> DataFrame:
    return journal.stall_runs(events(spark, sf).select("job_id", "ts", "event_id", "kind"))


@query(
    "illegal_transitions",
    f"""with {sql.JOURNAL}, moves as (
  select job_id, event_id, ts, state, lag(state) over (partition by job_id order by ts, event_id) as from_state from journal)
select * from moves where from_state is not null and (from_state || '>' || state) not in
  ('queued>queued', 'queued>running', 'running>running', 'running>ready', 'running>failed', 'ready>ready')""",
)
def _illegal(spark: SparkSession, sf: str) -> DataFrame:
    return journal.illegal_transitions(events(spark, sf).select("job_id", "event_id", "ts", "state"))


def stall_events(rows: DataFrame) -> DataFrame:
    """Attempts and advances, and what an attempt spends."""
    k = F.col("k")
    spends = F.when(k < 60, "file").when(k < 97, "table").when(k < 99, "structure").otherwise("index")
    return rows.filter(F.col("kind").isin("attempt", "advance")).select(
        "job_id", "ts", "event_id", "kind", spends.alias("spends")
    )


BUDGETS_SQL = f"""with {sql.JOURNAL}, steps as (
  select job_id, ts, event_id, kind, case when k < 60 then 'file' when k < 97 then 'table' when k < 99 then 'structure' else 'index' end as spends,
    sum(case when kind = 'advance' then 1 else 0 end) over (partition by job_id order by ts, event_id rows unbounded preceding) as run
  from journal where kind in ('attempt', 'advance')),
nth as (
  select *, row_number() over (partition by job_id, run order by ts, event_id) as nth from steps where kind = 'attempt'),
stalls as (
  select job_id, sum(cast(spends = 'file' as int)) over along as files, sum(cast(spends = 'table' as int)) over along as tables,
    sum(cast(spends not in ('file', 'table') as int)) over along as rigid
  from nth where nth > 2 and (nth - 1) % 2 = 0 window along as (partition by job_id order by ts, event_id rows unbounded preceding)),
outcome as (
  select job_id, coalesce(max(files) filter (rigid = 0 and files <= 18 and tables <= 22), 0) as files,
    coalesce(max(tables) filter (rigid = 0 and files <= 18 and tables <= 22), 0) as tables, bool_or(rigid > 0 or files > 18 or tables > 22) as failed
  from stalls group by job_id),
job_ids as (select distinct job_id from steps)
select job_id, cast(greatest(1, floor(262144 / pow(2, coalesce(files, 0)))) as bigint) as file_bytes,
  cast(greatest(1, floor(4194304 / pow(2, coalesce(tables, 0)))) as bigint) as table_bytes,
  cast(greatest(1, floor(1000 / pow(2, coalesce(tables, 0)))) as bigint) as table_rows, coalesce(failed, false) as failed
from job_ids left join outcome using (job_id)"""


@query("stall_budgets", BUDGETS_SQL)
def _budgets(spark: SparkSession, sf: str) -> DataFrame:
    return budgets.stall_budgets(stall_events(events(spark, sf)))


@query(
    "segment_pairing",
    """with names as (select conv_id as artifact, turn as seq, role as name from conversations),
parts as (select doc_id // 5 as artifact, doc_id % 5 as seq, strlen(text) as bytes from documents)
select coalesce(n.artifact, p.artifact) as artifact, coalesce(n.seq, p.seq) as seq, coalesce(name, '') as name, coalesce(bytes, -1) as bytes,
  case when name is null then 'no_name' when bytes is null then 'no_segment' else 'paired' end as status
from names n full join parts p on n.artifact = p.artifact and n.seq = p.seq""",
)
def _pairing(spark: SparkSession, sf: str) -> DataFrame:
    names = table(spark, sf, "conversations").select(F.col("conv_id").alias("artifact"), F.col("turn").alias("seq"), F.col("role").alias("name"))
    parts = table(spark, sf, "documents").select(
        F.floor(F.col("doc_id") / 5).alias("artifact"), (F.col("doc_id") % 5).alias("seq"), F.col("text").alias("payload")
    )
    size = F.octet_length("payload").cast("bigint")
    paired = segments.pair_names(names, parts)
    return paired.select("artifact", "seq", F.coalesce("name", F.lit("")).alias("name"), F.coalesce(size, F.lit(-1)).alias("bytes"), "status")


OUTLINE_SQL = """select lang as artifact, 'name' as level, source as name, count(*) as segments, cast(sum(strlen(text)) as bigint) as bytes, max(strlen(text)) as largest
from documents group by lang, source
union all select lang, 'artifact', '', count(*), cast(sum(strlen(text)) as bigint), max(strlen(text)) from documents group by lang"""


@query("artifact_outline", OUTLINE_SQL)
def _outline(spark: SparkSession, sf: str) -> DataFrame:
    return segments.artifact_outline(document_segments(spark, sf)).fillna("", ["name"])


@query("segment_roundtrip", OUTLINE_SQL)
def _roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_path(spark, "segments")
    write_segments(document_segments(spark, sf).withColumn("payload", F.col("payload").cast("binary")), path)
    return segments.artifact_outline(read_segments(spark, path)).fillna("", ["name"])


@query(
    "segment_order",
    """with parts as (
  select conv_id as job_id, case role when 'user' then 'file' when 'assistant' then 'table' else 'structure' end as kind, turn as ordinal,
    unnest(range(cast(greatest(strlen(text), 1) + 199 as bigint) // 200)) as part from conversations)
select job_id, kind, ordinal, part, row_number() over (partition by job_id order by
  case kind when 'table' then 1 when 'structure' then 2 else 3 end, ordinal, part) - 1 as seq from parts""",
)
def _order(spark: SparkSession, sf: str) -> DataFrame:
    """Parts of 200 bytes of every turn, in build order."""
    kind = F.when(F.col("role") == "user", "file").when(F.col("role") == "assistant", "table").otherwise("structure")
    size = F.octet_length("text").cast("bigint")
    parts = table(spark, sf, "conversations").select(
        F.col("conv_id").alias("job_id"), kind.alias("kind"), F.col("turn").alias("ordinal"),
        F.explode(segments.part_offsets(size, 200)).alias("offset"),
    )
    cut = parts.select("job_id", "kind", "ordinal", F.floor(F.col("offset") / 200).alias("part"))
    return segments.segment_order(cut)
