"""Text rendering of values and rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The six characters a quoted literal escapes, in the order they are replaced.
LITERAL_ESCAPES = [
    ("\\", "\\\\"),
    ("'", "\\'"),
    ("\0", "\\0"),
    ("\n", "\\n"),
    ("\r", "\\r"),
    ("\x1a", "\\Z"),
]

ROWS_PER_INSERT = 100


def canonical_text(column: Column, data_type: T.DataType) -> Column:
    """One stable text form per type, from which the value can be read back: microsecond timestamps, ISO dates, and
    doubles with two decimals where these are the whole value, else with as many digits as it takes.
    """
    if isinstance(data_type, (T.DoubleType, T.FloatType)):
        fixed, exact = column.try_cast("decimal(18,2)"), column.cast("string")
        whole = (fixed.cast(data_type) == column) & ((column != 0) | (exact == "0.0"))  # a negative zero keeps its sign
        return F.when(whole, fixed.cast("string")).otherwise(exact)
    if isinstance(data_type, (T.TimestampType, T.TimestampNTZType)):
        return F.date_format(column, "yyyy-MM-dd HH:mm:ss.SSSSSS")
    if isinstance(data_type, T.BooleanType):
        return column.cast("int").cast("string")
    if isinstance(data_type, (T.ArrayType, T.MapType, T.StructType)):
        return F.to_json(column, {"ignoreNullFields": "false"})
    return column.cast("string")


def quoted_name(name: str) -> str:
    """A name between backticks, those inside it doubled."""
    return f"`{name.replace('`', '``')}`"


def sql_literal(text: Column) -> Column:
    """``NULL`` unquoted, anything else quoted and escaped."""
    escaped = text
    for raw, written in LITERAL_ESCAPES:
        escaped = F.replace(escaped, F.lit(raw), F.lit(written))
    return F.coalesce(F.concat(F.lit("'"), escaped, F.lit("'")), F.lit("NULL"))


def _field_literal(field: T.StructField) -> Column:
    text = canonical_text(F.col(quoted_name(field.name)), field.dataType)
    if isinstance(field.dataType, (T.NumericType, T.BooleanType, T.DateType, T.TimestampType, T.TimestampNTZType)):
        # The text of a number or a time holds nothing to escape.
        return F.coalesce(F.concat(F.lit("'"), text, F.lit("'")), F.lit("NULL"))
    return sql_literal(text)


def row_tuple(df: DataFrame, columns: Sequence[str] | None = None) -> Column:
    """``(v1,v2,…)`` over the columns in definition order."""
    fields = [field for field in df.schema.fields if columns is None or field.name in columns]
    literals = [_field_literal(field) for field in fields]
    return F.concat(F.lit("("), F.concat_ws(",", *literals), F.lit(")"))


STAMP_BYTES = 26  # yyyy-MM-dd HH:mm:ss.SSSSSS


def row_size(df: DataFrame, columns: Sequence[str] | None = None) -> Column:
    """Bytes of ``row_tuple`` without building it."""
    fields = [field for field in df.schema.fields if columns is None or field.name in columns]
    total = F.lit(1 + len(fields))  # the parentheses, and commas between the fields
    for field in fields:
        total = total + _literal_size(field)
    return total.cast("bigint")


def _literal_size(field: T.StructField) -> Column:
    column = F.col(quoted_name(field.name))
    if isinstance(field.dataType, (T.TimestampType, T.TimestampNTZType)):
        written = F.octet_length(_field_literal(field))
        return F.when(column.isNull(), 4).when(F.year(column).between(0, 9999), STAMP_BYTES + 2).otherwise(written)
    return F.octet_length(_field_literal(field))
