"""Disclosure queries over configuration derived from the given texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parcelry.functions.disclosure import DISCLOSABLE_NAMES, SECRET_PARTS, define_names, define_records
from parcelry.plans import sql_text as sql
from parcelry.plans.bindings import page_files, table
from parcelry.plans.registry import query

EXTRA = ["SITE_MODE", "SITE_TOKEN_TTL"]
_allowed = ", ".join(f"'{name}'" for name in [*DISCLOSABLE_NAMES, *EXTRA])


@query(
    "define_names",
    r"""with sources as (
  select doc_id, regexp_extract_all(regexp_replace(text, '([A-Za-z]+)\.', 'define( ''\1'', 1 );', 'g'),
    '\bdefine\s*\(\s*[''"]([A-Za-z_][A-Za-z0-9_]*)[''"]', 1) as names from documents),
found as (select doc_id, unnest(names) as name, unnest(range(len(names))) as spot from sources),
firsts as (select doc_id, name, min(spot) as spot from found group by doc_id, name)
select doc_id, name, cast(row_number() over (partition by doc_id order by spot) - 1 as int) as place from firsts""",
)
def _names(spark: SparkSession, sf: str) -> DataFrame:
    """Every sentence's last word stands in a definition; names come back in source order."""
    source = F.regexp_replace("text", r"(?<![A-Za-z])([A-Za-z]++)\.", "define( '$1', 1 );")
    # The outer form keeps Spark from matching every text twice; texts without a name drop out after.
    found = table(spark, sf, "documents").select("doc_id", F.posexplode_outer(define_names(source)).alias("place", "name"))
    return found.filter(F.col("name").isNotNull())


@query(
    "disclosure_policy",
    rf"""with {sql.PAGE_FILES}, sites as (
  select page_id, split_part(path, '/', 1) as host, path from page_files),
records as (
  select page_id, '/srv/' || host as root,
    unnest(['WP_HOME', 'ABSPATH', 'WP_CONTENT_DIR', 'WP_TEMP_DIR', 'AUTH_KEY', 'DB_PASSWORD', upper(regexp_replace(host, '[^A-Za-z]', '_', 'g')), 'SITE_MODE', 'SITE_TOKEN_TTL', 'abspath']) as name,
    unnest(['https://' || path, '/srv/' || host || '/', '/srv/' || path, '\tmp\\' || host, host, path, path, 'mode ' || host, '60', '/srv/' || path]) as value
  from sites),
judged as (
  select *, {sql.normalized('value')} as norm, case when regexp_matches(upper(name), '{'|'.join(SECRET_PARTS)}') then 'secret'
    when name in ({_allowed}) then 'included' else 'not_allow_listed' end as disclosure from records)
select page_id, name, disclosure, coalesce(case when disclosure = 'included' then
  case when regexp_matches(norm, '^(/|[A-Za-z]:/)') then {sql.relative('norm', 'root')} else value end end, '(withheld)') as value from judged""",
)
def _policy(spark: SparkSession, sf: str) -> DataFrame:
    path, host = F.col("path"), F.substring_index("path", "/", 1)
    site = F.concat(F.lit("/srv/"), host)
    values = {
        "WP_HOME": F.concat(F.lit("https://"), path),
        "ABSPATH": F.concat(site, F.lit("/")),
        "WP_CONTENT_DIR": F.concat(F.lit("/srv/"), path),
        "WP_TEMP_DIR": F.concat(F.lit("\\tmp\\\\"), host),
        "AUTH_KEY": host,
        "DB_PASSWORD": path,
        None: path,
        "SITE_MODE": F.concat(F.lit("mode "), host),
        "SITE_TOKEN_TTL": F.lit("60"),
        "abspath": F.concat(F.lit("/srv/"), path),
    }
    own_name = F.upper(F.regexp_replace(host, "[^A-Za-z]", "_"))
    records = F.array(
        *[F.struct((own_name if name is None else F.lit(name)).alias("name"), value.alias("value")) for name, value in values.items()]
    )
    spread = page_files(spark, sf).select("page_id", site.alias("root"), F.inline(records))
    judged = define_records(spread, F.col("root"), EXTRA)
    return judged.select("page_id", "name", "disclosure", F.coalesce("value", F.lit("(withheld)")).alias("value"))
