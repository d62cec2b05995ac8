"""File-set queries: order, pages, cursors, parts, digests and the tree scan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from parcelry.functions.cursors import decode_cursor, encode_cursor
from parcelry.functions.paths import is_hostile, is_restricted, relative_path, relative_value
from parcelry.operators import manifest as files
from parcelry.operators import segments
from parcelry.plans import sql_text as sql
from parcelry.plans.bindings import manifest, page_files, table
from parcelry.plans.registry import query
from parcelry.session import scratch_path
from parcelry.sources.files import file_manifest, read_parts

PART = 4096
# Names put beside every page to try each pattern of the deny-list on, and names that miss it narrowly.
SIBLINGS = [
    "wp-config.php", "Wp-Config.Php", "wp-config.php.2", "WP-CONFIG.PHP~", "wp-config-staging.php", "wp-config-sample.php", "wp-config.txt", "my.wp-config.php",
    ".ENV", ".env.7", ".envrc", "a.env", "orders.sql", "ORDERS.SQL.GZ", "orders.sql.zip", "orders.sql.bz2", "chain.PEM", "sign.key", "key.md", "id_rsa_7", "my_id_rsa",
]
_names = "[" + ", ".join(f"'{name}'" for name in SIBLINGS) + "]"


def _beside_pages(spark: SparkSession, sf: str) -> DataFrame:
    """Each sibling name beside the page, directly in the root, and in the root after ``./``."""
    folder = F.regexp_extract("path", "^(.*)/[^/]*$", 1)
    names = F.array(*[F.lit(name) for name in SIBLINGS])
    spread = page_files(spark, sf).select("page_id", folder.alias("folder"), F.explode(names).alias("name"))
    forms = F.array(
        F.concat("folder", F.lit("/"), "name"), F.concat(F.translate("folder", "/", "\\"), F.lit("\\"), "name"),
        F.col("name"), F.concat(F.lit("./"), "name"),
    )
    return spread.select("page_id", F.explode(forms).alias("path"))


@query(
    "restricted_paths",
    f"""with {sql.PAGE_FILES}, beside as (
  select page_id, regexp_extract(path, '^(.*)/[^/]*$', 1) as folder, unnest({_names}) as name from page_files),
forms as (
  select page_id, unnest([folder || '/' || name, replace(folder, '/', '\\') || '\\' || name, name, './' || name]) as path from beside),
parts as (
  select page_id, path, lower(regexp_extract(replace(path, '\\', '/'), '[^/]*$')) as name,
    not contains(regexp_replace(replace(path, '\\', '/'), '^(\\./)+', ''), '/') as at_root from forms)
select page_id, path,
  regexp_matches(name, '^wp-config\\.php$|^wp-config\\.php\\..+$|^wp-config\\.php~$|^\\.env$|^\\.env\\..+$')
  or (regexp_matches(name, '^wp-config-.+\\.php$') and name <> 'wp-config-sample.php')
  or (at_root and regexp_matches(name, '\\.sql$|\\.sql\\.gz$|\\.sql\\.zip$|\\.pem$|\\.key$|^id_rsa')) as restricted
from parts""",
)
def _restricted(spark: SparkSession, sf: str) -> DataFrame:
    return _beside_pages(spark, sf).withColumn("restricted", is_restricted(F.col("path")))


def _spellings(path: Column) -> Column:
    return F.array(
        path, F.concat(F.lit("../"), path), F.concat(path, F.lit("/../x")), F.concat(F.lit("a\\..\\"), path),
        F.concat(path, F.lit("..")), F.concat(F.lit("..."), path), F.concat(path, F.lit("\0")),
    )


@query(
    "path_safety",
    f"""with {sql.PAGE_FILES}, forms as (
  select page_id, cast(unnest(range(7)) as int) as form,
    unnest([path, '../' || path, path || '/../x', 'a\\..\\' || path, path || '..', '...' || path, path || chr(0)]) as path from page_files)
select page_id, form, contains(path, chr(0)) or list_contains(string_split(replace(path, '\\', '/'), '/'), '..') as hostile from forms""",
)
def _safety(spark: SparkSession, sf: str) -> DataFrame:
    spread = page_files(spark, sf).select("page_id", F.posexplode(_spellings(F.col("path"))).alias("form", "path"))
    return spread.select("page_id", "form", is_hostile(F.col("path")).alias("hostile"))


@query(
    "canonical_order",
    f"with {sql.PAGE_FILES} select path, strlen(content) as size, row_number() over (order by string_split(path, '/')) as position from page_files",
)
def _order(spark: SparkSession, sf: str) -> DataFrame:
    return files.canonical_order(manifest(spark, sf).select("path", "size"))


@query(
    "path_pages",
    f"""with {sql.PAGE_FILES}, placed as (
  select path, strlen(content) as size, row_number() over (order by string_split(path, '/')) - 1 as rn from page_files),
pages_of as (
  select rn // 40 as page, count(*) as files, cast(sum(size) as bigint) as bytes, arg_min(path, rn) as first_path, arg_max(path, rn) as last_path
  from placed group by 1)
select *, case when page < (select max(page) from pages_of)
  then rtrim(translate(base64(encode(last_path)), '+/', '-_'), '=') else '' end as cursor from pages_of""",
)
def _pages(spark: SparkSession, sf: str) -> DataFrame:
    return files.path_pages(manifest(spark, sf), 40).fillna("", ["cursor"])


@query(
    "manifest_page",
    f"""with {sql.PAGE_FILES} select path, strlen(content) as size from page_files
where string_split(path, '/') > ['m.z', 'zz'] order by string_split(path, '/') limit 100""",
)
def _manifest_page(spark: SparkSession, sf: str) -> DataFrame:
    return files.manifest_page(manifest(spark, sf).select("path", "size"), ["m.z", "zz"], 100)


@query(
    "cursor_encode",
    f"with {sql.PAGE_FILES} select path, rtrim(translate(base64(encode(path)), '+/', '-_'), '=') as cursor from page_files",
)
def _encode(spark: SparkSession, sf: str) -> DataFrame:
    return page_files(spark, sf).select("path", encode_cursor(F.col("path")).alias("cursor"))


_B64 = "translate(base64(encode({0})), '+/', '-_')"


@query(
    "cursor_decode",
    f"""with {sql.PAGE_FILES}, forms as (
  select page_id, unnest([rtrim({_B64.format('path')}, '='), {_B64.format('path')}, rtrim({_B64.format("'../' || path")}, '='),
    rtrim({_B64.format("'/' || path")}, '='), '!!' || rtrim({_B64.format('path')}, '='), rtrim({_B64.format('path')}, '=') || '===', '']) as cursor,
    unnest(range(7)) as form, path from page_files)
select page_id, cast(form as int) as form, case when form < 2 then path else '' end as path, form < 2 as valid from forms""",
)
def _decode(spark: SparkSession, sf: str) -> DataFrame:
    path = F.col("path")
    padded = lambda c: F.translate(F.regexp_replace(F.base64(c.cast("binary")), r"[\r\n]", ""), "+/", "-_")
    forms = F.array(
        encode_cursor(path), padded(path), encode_cursor(F.concat(F.lit("../"), path)), encode_cursor(F.concat(F.lit("/"), path)),
        F.concat(F.lit("!!"), encode_cursor(path)), F.concat(encode_cursor(path), F.lit("===")), F.lit(""),
    )
    spread = page_files(spark, sf).select("page_id", F.posexplode(forms).alias("form", "cursor"))
    decoded = spread.withColumn("path", decode_cursor(F.col("cursor")))
    return decoded.select(
        "page_id", "form", F.coalesce("path", F.lit("")).alias("path"), F.col("path").isNotNull().alias("valid")
    )


_host = "split_part(path, '/', 1)"
_target = "'/srv/' || path"


@query(
    "relative_path",
    f"""with {sql.PAGE_FILES}, forms as (
  select page_id, '/srv/' || {_host} || '/en' as root, cast(unnest(range(4)) as int) as form,
    unnest(['/srv/' || path, '/srv/' || {_host} || '/en/', '/srv/' || {_host} || '/en2/' || path, '/var/log/x']) as target from page_files)
select page_id, form, {sql.relative('target', 'root')} as relative from forms""",
)
def _relative(spark: SparkSession, sf: str) -> DataFrame:
    host = F.concat(F.lit("/srv/"), F.substring_index("path", "/", 1))
    forms = F.array(
        F.concat(F.lit("/srv/"), "path"), F.concat(host, F.lit("/en/")), F.concat(host, F.lit("/en2/"), "path"), F.lit("/var/log/x")
    )
    spread = page_files(spark, sf).select(
        "page_id", F.concat(host, F.lit("/en")).alias("root"), F.posexplode(forms).alias("form", "target")
    )
    return spread.select("page_id", "form", relative_path(F.col("target"), F.col("root")).alias("relative"))


@query(
    "relative_value",
    f"""with {sql.PAGE_FILES}, forms as (
  select page_id, '/srv/' || {_host} as root, cast(unnest(range(5)) as int) as form,
    unnest(['/srv//' || path, 'c:\\sites\\' || path, path, 'https://' || path, '']) as value from page_files),
plain as (select *, {sql.normalized('value')} as norm from forms)
select page_id, form, case when regexp_matches(norm, '^(/|[A-Za-z]:/)') then {sql.relative('norm', 'root')} else value end as value from plain""",
)
def _value(spark: SparkSession, sf: str) -> DataFrame:
    forms = F.array(
        F.concat(F.lit("/srv//"), "path"), F.concat(F.lit("c:\\sites\\"), "path"), F.col("path"),
        F.concat(F.lit("https://"), "path"), F.lit(""),
    )
    root = F.concat(F.lit("/srv/"), F.substring_index("path", "/", 1))
    spread = page_files(spark, sf).select("page_id", root.alias("root"), F.posexplode(forms).alias("form", "value"))
    return spread.select("page_id", "form", relative_value(F.col("value"), F.col("root")).alias("value"))


PARTS_SQL = f"""{sql.PAGE_FILES}, cut as (
  select path, content, strlen(content) as size, unnest(range(0, greatest(strlen(content), 1), {PART})) as part_offset from page_files)"""


@query(
    "file_parts",
    f"""with {PARTS_SQL}
select path, part_offset as "offset", least({PART}, size - part_offset) as length, part_offset + {PART} >= size as done,
  md5(unhex(substr(hex(encode(content)), part_offset * 2 + 1, {PART} * 2))) as payload_md5 from cut""",
)
def _parts(spark: SparkSession, sf: str) -> DataFrame:
    parts = segments.file_parts(page_files(spark, sf), PART)
    return parts.withColumn("payload_md5", F.md5("payload")).drop("payload")


@query(
    "reassemble",
    f"with {sql.PAGE_FILES} select path as name, strlen(content) as bytes, md5(content) as content_md5 from page_files",
)
def _reassemble(spark: SparkSession, sf: str) -> DataFrame:
    parts = segments.file_parts(page_files(spark, sf), PART)
    pieces = parts.select(F.col("path").alias("name"), F.col("offset").alias("seq"), "length", "payload")
    whole = segments.reassemble(pieces)
    return whole.select(
        "name", F.octet_length("payload").cast("bigint").alias("bytes"), F.md5("payload").alias("content_md5")
    )


@query(
    "files_digest",
    f"""with {sql.PAGE_FILES}, sets as (
  select regexp_extract({_host}, '[^.]+$') as site, path, strlen(content) as size from page_files)
select site, count(*) as files, cast(sum(size) as bigint) as bytes, array_to_string(list_sort(list_distinct(list({_host}))), ',') as roots,
  sha256(string_agg(path, chr(10) order by path)) as sha256, 'paths' as digest from sets group by site""",
)
def _digest(spark: SparkSession, sf: str) -> DataFrame:
    sets = manifest(spark, sf).withColumn("site", F.regexp_extract(F.substring_index("path", "/", 1), "[^.]+$", 0))
    return files.files_digest(sets, "site")


@query(
    "tree_digest",
    f"""with {sql.PAGE_FILES}, ranges as (
  select regexp_extract({_host}, '[^.]+$') as site, {_host} as host, count(*) as files, sha256(string_agg(path, chr(10) order by path)) as digest
  from page_files group by 1, 2)
select site, cast(sum(files) as bigint) as files, count(*) as ranges,
  sha256(string_agg(host || chr(9) || files || chr(9) || digest, chr(10) order by host)) as sha256 from ranges group by site""",
)
def _tree(spark: SparkSession, sf: str) -> DataFrame:
    sets = manifest(spark, sf).withColumn("site", F.regexp_extract(F.substring_index("path", "/", 1), "[^.]+$", 0))
    return files.tree_digest(files.range_digests(sets, "site"), "site")


@query(
    "version_pin",
    """with seen as (
  select l_partkey as path, l_orderkey * 10 + l_linenumber as moment, not (l_discount = 0.1 and l_returnflag = 'A') as present,
    l_partkey * 10 + case when l_tax = 0.08 and l_returnflag = 'R' then 1 else 0 end as size, l_partkey as mtime from lineitem),
summary as (
  select path, count(*) as observed, count(distinct size) filter (present) as versions, min(moment) filter (not present) as gone,
    min(moment) filter (present) as part from seen group by path)
select path, observed, case when part is null or gone < part then 'skipped' when versions > 1 then 'changed'
  when gone is not null then 'vanished' else 'pinned' end as verdict from summary""",
)
def _pin(spark: SparkSession, sf: str) -> DataFrame:
    flag = F.col("l_returnflag")
    seen = table(spark, sf, "lineitem").select(
        F.col("l_partkey").alias("path"),
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("at"),
        (~((F.col("l_discount") == 0.1) & (flag == "A"))).alias("present"),
        (F.col("l_partkey") * 10 + F.when((F.col("l_tax") == 0.08) & (flag == "R"), 1).otherwise(0)).alias("size"),
        F.col("l_partkey").alias("mtime"),
    )
    return files.version_pin(seen)


def _page_tree(spark: SparkSession, sf: str) -> str:
    """The pages written out as text files, one folder per host."""
    root = scratch_path(spark, "tree")
    pages = page_files(spark, sf).select(
        F.substring_index("path", "/", 1).alias("host"), F.regexp_replace("content", "[\r\n]", " ").alias("value"),
        (F.col("page_id") % 16).alias("salt"),
    )
    # The salt keeps a host with many pages in several files.
    pages.repartition("host", "salt").drop("salt").write.partitionBy("host").text(root)
    return root.removeprefix("file:")


@query("file_manifest")
def _tree(spark: SparkSession, sf: str) -> DataFrame:
    return file_manifest(spark, _page_tree(spark, sf))


@query("read_parts")
def _tree_parts(spark: SparkSession, sf: str) -> DataFrame:
    root = _page_tree(spark, sf)
    parts = read_parts(file_manifest(spark, root), root, PART)
    return parts.withColumn("payload", F.md5("payload"))


