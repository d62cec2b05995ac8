"""Path expressions: canonical order, safety, the deny-list, and relative forms."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Credential-bearing names refused anywhere in the tree, by last component.
CONFIG_PATTERNS = [
    r"^wp-config\.php$",
    r"^wp-config\.php\..+$",
    r"^wp-config\.php~$",
    r"^wp-config-(?!sample\.php$).+\.php$",
]
ENV_PATTERNS = [
    r"^\.env$",
    r"^\.env\..+$",
]
# Dumps and key material refused only directly in the root.
ROOT_PATTERNS = [
    r"\.sql$",
    r"\.sql\.gz$",
    r"\.sql\.zip$",
    r"\.pem$",
    r"\.key$",
    r"^id_rsa",
]


def _any_pattern(text: Column, patterns: list[str]) -> Column:
    """ASCII case-insensitive match of any pattern; only LF counts as a line end."""
    return text.rlike("(?id)" + "|".join(f"(?:{pattern})" for pattern in patterns))


def path_key(path: Column) -> Column:
    """Sort key of the canonical order: components compared pairwise by byte."""
    return F.split(path, "/", -1)


def forward_slashes(path: Column) -> Column:
    return F.translate(path, "\\", "/")


def base_name(path: Column) -> Column:
    return F.substring_index(F.rtrim(path, F.lit("/")), "/", -1)


def top_root(path: Column) -> Column:
    """First component, or the whole name when there is no separator."""
    return F.substring_index(path, "/", 1)


def is_restricted(path: Column) -> Column:
    """Whether a requested path matches the deny-list."""
    forward = forward_slashes(path)
    name = base_name(forward)
    without_dots = F.regexp_replace(forward, r"^(?:\./)+", "")
    at_root = ~F.ltrim(without_dots, F.lit("/")).contains("/")
    return _any_pattern(name, CONFIG_PATTERNS + ENV_PATTERNS) | (at_root & _any_pattern(name, ROOT_PATTERNS))


def is_hostile(path: Column) -> Column:
    """A NUL byte or a ``..`` component: never a real selection, whatever exists on disk."""
    return path.contains("\0") | path.rlike(r"(?:^|[/\\])\.\.(?:[/\\]|\z)")


def resolved(path: Column) -> Column:
    """The manifest spelling of a harmless path: no empty and no ``.`` components."""
    kept = F.filter(F.split(path, "/", -1), lambda part: (part != "") & (part != "."))
    odd = path.rlike(r"(?:^|/)\.?(?:/|\z)")
    return F.when(odd, F.array_join(kept, "/")).otherwise(path)


def scattered(key: Column, *row: str) -> Column:
    """A join key that matches nothing for rows without one, spread out instead of all null.

    No path or table name starts with NUL, so the stand-ins never meet a real key.
    """
    return F.coalesce(key, F.concat(F.lit("\0"), F.xxhash64(*row).cast("string")))


def normalized(path: Column) -> Column:
    """Forward slashes, no doubled ones after the start, upper-case drive letter."""
    single = F.regexp_replace(forward_slashes(path), r"(?<=.)/+", "/")
    drive = F.substring(single, 2, 1) == ":"
    return F.when(drive, F.concat(F.upper(F.substring(single, 1, 1)), F.substr(single, F.lit(2)))).otherwise(single)


def _comparable(path: Column) -> Column:
    return F.rtrim(normalized(path), F.lit("/"))


def relative_path(path: Column, root: Column) -> Column:
    """``path`` as seen from ``root``, walking up with ``..`` where it lies outside."""
    base, target = _comparable(root), _comparable(path)
    base_parts = F.split(F.trim(base, F.lit("/")), "/", -1)
    target_parts = F.split(F.trim(target, F.lit("/")), "/", -1)
    agree = F.zip_with(base_parts, target_parts, lambda a, b: a.eqNullSafe(b))
    first_split = F.array_position(agree, F.lit(False))
    common = F.when(first_split == 0, F.size(agree)).otherwise(first_split - 1).cast("int")
    up = F.array_repeat(F.lit(".."), F.size(base_parts) - common)
    down = F.slice(target_parts, common + 1, F.size(target_parts))
    return (
        F.when(target == base, F.lit(""))
        .when(F.startswith(target, F.concat(base, F.lit("/"))), F.substr(target, F.length(base) + 2))
        .otherwise(F.array_join(F.concat(up, down), "/"))
    )


def relative_value(value: Column, root: Column) -> Column:
    """Relativises a value only when it reads as an absolute path, POSIX or drive-letter."""
    absolute = normalized(value).rlike(r"^(?:/|[A-Za-z]:/)")
    return F.when(absolute, relative_path(value, root)).otherwise(value)


def any_of(flags: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, flags)
