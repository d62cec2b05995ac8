"""How the given tables play the roles of the operators' inputs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from parcelry.session import use_utc

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()
NOW = 1706659200  # 2024-01-31T00:00:00Z, just after the last event


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return use_utc(spark).read.parquet(f"{sf}/{name}.parquet")


def unix(ts: Column) -> Column:
    return F.unix_seconds(ts.cast("timestamp"))


def page_path(url: Column) -> Column:
    """Path of a page: its address without scheme, query and fragment; a folder gets an index file."""
    bare = F.regexp_replace(F.regexp_replace(url, "^https?://", ""), "[?#].*$", "")
    return F.when(F.endswith(bare, F.lit("/")), F.concat(bare, F.lit("index.html"))).otherwise(bare)


def page_files(spark: SparkSession, sf: str) -> DataFrame:
    """One file per path; a path written twice holds its latest page."""
    pages = table(spark, sf, "pages").select("page_id", page_path(F.col("url")).alias("path"), "html")
    latest = pages.groupBy("path").agg(
        F.max_by("html", "page_id").alias("content"), F.max("page_id").alias("page_id")
    )
    return latest


def manifest(spark: SparkSession, sf: str) -> DataFrame:
    return page_files(spark, sf).select(
        "path", F.octet_length("content").cast("bigint").alias("size"), (F.col("page_id") + NOW).alias("mtime")
    )


def table_stream(spark: SparkSession, sf: str, name: str, **options: str) -> DataFrame:
    """The table's files as a stream; the pattern lets it be one file or a folder of them."""
    schema = table(spark, sf, name).schema
    bounded = {"maxFilesPerTrigger": "64", **options}
    return spark.readStream.schema(schema).options(**bounded).parquet(f"{sf}/{name}.parquet*")


def journal(spark: SparkSession, sf: str) -> DataFrame:
    return journal_of(table(spark, sf, "events"))


def journal_of(events: DataFrame) -> DataFrame:
    """Job journal: the user is the job, the event its state or kind."""
    event = F.col("event_type")
    state = (
        F.when(event == "signup", "queued").when(event == "purchase", "ready").when(event == "error", "failed")
        .otherwise("running")
    )
    kind = F.when(event == "view", "attempt").when(event == "click", "advance").otherwise("other")
    return events.select(
        "event_id",
        F.col("user_id").alias("job_id"),
        unix(F.col("ts")).alias("ts"),
        state.alias("state"),
        kind.alias("kind"),
        F.round(F.col("value") * 1000).cast("bigint").alias("us"),
        F.regexp_extract("props", r"([0-9]+)", 1).cast("bigint").alias("k"),
    )


def jobs(spark: SparkSession, sf: str) -> DataFrame:
    """Job records as the journal leaves them; the owner is the customer's nation."""
    newest = F.struct("ts", "event_id")
    records = journal(spark, sf).groupBy("job_id").agg(
        F.max_by("state", newest).alias("state"),
        F.min("ts").alias("created_at"),
        F.max("ts").alias("updated_at"),
        F.max(F.when(F.col("kind") == "advance", F.col("ts"))).alias("progressed_at"),
    )
    owners = table(spark, sf, "customer").select(
        F.col("c_custkey").alias("job_id"), F.col("c_nationkey").cast("bigint").alias("owner")
    )
    return records.join(owners, "job_id", "left")


def chat_selection(spark: SparkSession, sf: str) -> DataFrame:
    """Selection of a job: one entry per turn of its conversation."""
    role = F.col("role")
    kind = F.when(role == "user", "file").when(role == "assistant", "table").otherwise("structure")
    return table(spark, sf, "conversations").select(
        F.col("conv_id").alias("job_id"),
        kind.alias("kind"),
        F.col("turn").alias("ordinal"),
        F.concat(role, F.lit("/"), F.md5(F.col("text").cast("binary"))).alias("name"),
    )


def order_requests(spark: SparkSession, sf: str) -> DataFrame:
    """One request per order; the raw flag and size come from its priority and status."""
    priority, status = F.col("o_orderpriority"), F.col("o_orderstatus")
    strict = (
        F.when(priority.startswith("1"), "true").when(priority.startswith("2"), "false")
        .when(priority.startswith("3"), "yes").when(priority.startswith("4"), "false")
    )
    size = F.when(status == "F", F.floor("o_totalprice").cast("bigint").cast("string")).when(
        (status == "P") & (F.col("o_totalprice") < 100000), "0"
    )
    return table(spark, sf, "orders").select(F.col("o_orderkey").alias("job_id"), strict.alias("strict"), size.alias("chunk_size"))


def order_selection(spark: SparkSession, sf: str) -> DataFrame:
    """Entries of a request: its order lines, as tables, bare structures and files."""
    flag, part = F.col("l_returnflag"), F.col("l_partkey").cast("string")
    kind = F.when(flag == "A", "table").when(flag == "R", "structure").otherwise("file")
    file_name = (
        F.when((F.col("l_tax") == 0.08) & (F.col("l_discount") == 0.1), F.concat(F.lit("f/../"), part))
        .when((F.col("l_tax") == 0.07) & (F.col("l_discount") == 0.1), F.concat(F.lit("f/"), part, F.lit("/wp-config.php.bak")))
        .when((F.col("l_tax") == 0.06) & (F.col("l_discount") == 0.1), F.concat(F.lit("./f//"), part))
        .otherwise(F.concat(F.lit("f/"), part))
    )
    table_name = F.concat(F.lit("t"), F.col("l_suppkey").cast("string"))
    return table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("job_id"),
        kind.alias("kind"),
        (F.col("l_partkey") * 1000000 + F.col("l_suppkey") * 10 + F.col("l_linenumber")).alias("ordinal"),
        F.when(kind == "file", file_name).otherwise(table_name).alias("name"),
    )


def supplier_catalog(spark: SparkSession, sf: str) -> DataFrame:
    """Tables that exist: suppliers in good standing."""
    solvent = table(spark, sf, "supplier").filter(F.col("s_acctbal") >= 0)
    return solvent.select(F.concat(F.lit("t"), F.col("s_suppkey").cast("string")).alias("name"))


def part_manifest(spark: SparkSession, sf: str) -> DataFrame:
    """Files that exist: parts above size 5."""
    kept = table(spark, sf, "part").filter(F.col("p_size") > 5)
    return kept.select(
        F.concat(F.lit("f/"), F.col("p_partkey").cast("string")).alias("path"),
        (F.col("p_size") * 1000).cast("bigint").alias("size"),
    )


def document_segments(spark: SparkSession, sf: str) -> DataFrame:
    """Segments of an artifact per language, named by source, in document order."""
    return table(spark, sf, "documents").select(
        F.col("lang").alias("artifact"), F.col("source").alias("name"), F.col("doc_id").alias("seq"), F.col("text").alias("payload")
    )
