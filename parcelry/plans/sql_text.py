"""Shared pieces of the check SQL (DuckDB)."""

from __future__ import annotations


def literal(text: str) -> str:
    out = text
    for raw, written in [("'\\'", "'\\\\'"), ("''''", "'\\'''"), ("chr(0)", "'\\0'"), ("chr(10)", "'\\n'"), ("chr(13)", "'\\r'"), ("chr(26)", "'\\Z'")]:
        out = f"replace({out}, {raw}, {written})"
    return f"coalesce('''' || {out} || '''', 'NULL')"


def row_tuple(*texts: str) -> str:
    return "'(' || " + " || ',' || ".join(literal(text) for text in texts) + " || ')'"


def money(column: str) -> str:
    return f"cast(cast({column} as decimal(18,2)) as varchar)"


def whole(column: str) -> str:
    return f"cast({column} as varchar)"


def stamp(column: str) -> str:
    return f"strftime({column}, '%Y-%m-%d %H:%M:%S.%f')"


ORDERS_TUPLE = row_tuple(
    whole("o_orderkey"), whole("o_custkey"), "o_orderstatus", money("o_totalprice"), stamp("o_orderdate"), "o_orderpriority"
)
LINEITEM_TUPLE = row_tuple(
    whole("l_orderkey"), whole("l_partkey"), whole("l_suppkey"), whole("l_linenumber"), money("l_quantity"),
    money("l_extendedprice"), money("l_discount"), money("l_tax"), "l_returnflag", "l_linestatus", stamp("l_shipdate"),
)
DOCUMENTS_TUPLE = row_tuple(whole("doc_id"), "text", "lang", "source", whole("n_chars"))

PAGE_FILES = r"""page_rows as (
  select page_id, html, regexp_replace(regexp_replace(url, '^https?://', ''), '[?#].*$', '') as bare from pages),
page_files as (
  select path, arg_max(html, page_id) as content, max(page_id) as page_id
  from (select page_id, html, case when bare like '%/' then bare || 'index.html' else bare end as path from page_rows)
  group by path)"""

JOURNAL = """journal as (
  select event_id, user_id as job_id, epoch_us(ts) // 1000000 as ts,
    case event_type when 'signup' then 'queued' when 'purchase' then 'ready' when 'error' then 'failed' else 'running' end as state,
    case event_type when 'view' then 'attempt' when 'click' then 'advance' else 'other' end as kind,
    cast(round(value * 1000) as bigint) as us,
    cast(regexp_extract(props, '([0-9]+)', 1) as bigint) as k
  from events)"""

JOBS = JOURNAL + """, jobs as (
  select j.*, cast(c.c_nationkey as bigint) as owner from (
    select job_id, arg_max(state, row(ts, event_id)) as state, min(ts) as created_at, max(ts) as updated_at,
      max(case when kind = 'advance' then ts end) as progressed_at
    from journal group by job_id) j
  left join customer c on c.c_custkey = j.job_id)"""

CHAT_SELECTION = """chat_selection as (
  select conv_id as job_id, case role when 'user' then 'file' when 'assistant' then 'table' else 'structure' end as kind,
    turn as ordinal, role || '/' || md5(text) as name from conversations)"""

ORDER_REQUESTS = """requests as (
  select o_orderkey as job_id,
    case when o_orderpriority like '1%' then 'true' when o_orderpriority like '2%' then 'false'
      when o_orderpriority like '3%' then 'yes' when o_orderpriority like '4%' then 'false' end as strict,
    case when o_orderstatus = 'F' then cast(cast(floor(o_totalprice) as bigint) as varchar)
      when o_orderstatus = 'P' and o_totalprice < 100000 then '0' end as chunk_size
  from orders)"""

ORDER_SELECTION = """selection as (
  select l_orderkey as job_id,
    case l_returnflag when 'A' then 'table' when 'R' then 'structure' else 'file' end as kind,
    l_partkey * 1000000 + l_suppkey * 10 + l_linenumber as ordinal,
    case when l_returnflag in ('A', 'R') then 't' || l_suppkey
      when l_tax = 0.08 and l_discount = 0.1 then 'f/../' || l_partkey
      when l_tax = 0.07 and l_discount = 0.1 then 'f/' || l_partkey || '/wp-config.php.bak'
      when l_tax = 0.06 and l_discount = 0.1 then './f//' || l_partkey
      else 'f/' || l_partkey end as name
  from lineitem),
catalog as (select 't' || s_suppkey as name from supplier where s_acctbal >= 0),
manifest as (select 'f/' || p_partkey as path from part where p_size > 5),
files as (
  select s.job_id, s.ordinal, s.name, list_contains(string_split(s.name, '/'), '..') as hostile,
    array_to_string(list_filter(string_split(s.name, '/'), lambda p: p <> '' and p <> '.'), '/') as path
  from selection s where kind = 'file'),
classified as (
  select f.job_id, f.ordinal, f.name,
    case when hostile then 'out_of_bounds' when m.path is not null then 'kept' else 'vanished' end as class
  from files f left join manifest m on m.path = f.path and not f.hostile)"""


def relative(path: str, root: str) -> str:
    """``path`` seen from ``root``; both already use single forward slashes."""
    target, base = f"rtrim({path}, '/')", f"rtrim({root}, '/')"
    t, b = f"string_split(trim({target}, '/'), '/')", f"string_split(trim({base}, '/'), '/')"
    common = f"len(list_filter(range(1, least(len({t}), len({b})) + 1), lambda i: {t}[1:i] = {b}[1:i]))"
    up = f"repeat('../', len({b}) - {common})"
    return (
        f"case when {target} = {base} then '' when starts_with({target}, {base} || '/') then substr({target}, length({base}) + 2) "
        f"else rtrim({up} || array_to_string({t}[{common} + 1:], '/'), '/') end"
    )


def normalized(path: str) -> str:
    forward = f"replace({path}, '\\', '/')"
    single = f"(left({forward}, 1) || regexp_replace(substr({forward}, 2), '/+', '/', 'g'))"
    return f"(case when substr({single}, 2, 1) = ':' then upper(left({single}, 1)) || substr({single}, 2) else {single} end)"
