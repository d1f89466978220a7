"""Lexical path expressions that treat POSIX, drive and network paths alike.  NULL gives NULL throughout."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Base names Windows reserves for devices.
RESERVED_NAMES = ("CON", "PRN", "AUX", "NUL", *(f"COM{i}" for i in range(1, 10)), *(f"LPT{i}" for i in range(1, 10)))


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body over value, which is computed once a row however often body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def slashed(path: Column | str) -> Column:
    """'/' as the only separator, runs collapsed (but for the two that begin a network path), none at the end."""
    text = F.regexp_replace(F.translate(_col(path), "\\", "/"), "(?<=.)/+", "/")
    return F.regexp_replace(F.regexp_replace(text, "(?<=[^/])/+$", ""), "^//$", "/")


def path_key(path: Column | str) -> Column:
    """Key for comparisons: slashed, in lower case for drive and network paths."""
    return F.when(_col(path).rlike(r"^([A-Za-z]:|[\\/]{2}.)"), F.lower(slashed(path))).otherwise(slashed(path))


def in_scope(path: Column | str, root: Column | str) -> Column:
    """True for root itself and all that lies below it.  root: a column, or a literal given by F.lit."""
    key, top = path_key(path), F.regexp_replace(path_key(root), "/$", "")
    return (key == top) | key.startswith(F.concat(top, F.lit("/")))


def relative(path: Column | str, root: Column | str) -> Column:
    """Path below root as stored ('' for root itself), NULL outside."""
    text, top = slashed(path), F.regexp_replace(slashed(root), "/$", "")
    return F.when(in_scope(path, root), F.substring(text, F.length(top) + 2, F.length(text)))


def parent(path: Column | str) -> Column:
    """All before the last separator; NULL without one."""
    return F.nullif(F.regexp_extract(_col(path), r"^(.*)[/\\][^/\\]*$", 1), F.lit(""))


def basename(path: Column | str) -> Column:
    return F.regexp_extract(_col(path), r"([^/\\]*)$", 1)


def suffix(name: Column | str) -> Column:
    """Last extension with its dot, '' if none; a leading dot begins no extension."""
    return F.regexp_extract(_col(name), r"[^/\\.](\.[^./\\ ]+)$", 1)


def stem(name: Column | str) -> Column:
    base = basename(name)
    return F.substring(base, F.lit(1), F.length(base) - F.length(suffix(base)))


def folders_above(text: Column) -> Column:
    """Array of all folders above a slashed path or path key, outermost first, without the empty root."""

    def made(parts: Column) -> Column:
        heads = F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
        return F.when(F.size(parts) > 1, F.filter(heads, lambda x: ~x.isin("", "/"))).otherwise(F.array().cast("array<string>"))

    return let(F.split(text, "/"), made)


def ancestors(path: Column | str) -> Column:
    """Array of the keys of all folders above a path, outermost first, without the empty root."""
    return folders_above(path_key(path))


def is_ancestor(a: Column, b: Column) -> Column:
    """a lies above b (both path keys)."""
    return b.startswith(F.concat(a, F.lit("/")))


def name_collision_key(name: Column | str) -> Column:
    """What a case-insensitive file system that drops trailing dots and blanks makes of one name."""
    return F.lower(F.regexp_replace(_col(name), r"[ .]+$", ""))


def path_collision_key(path: Column | str) -> Column:
    """name_collision_key for every component of the path key."""
    return F.array_join(F.transform(F.split(path_key(path), "/"), lambda x: F.when(x.isin("", "."), x).otherwise(F.lower(F.regexp_replace(x, r"[ .]+$", "")))), "/")


def reserved_name(name: Column | str) -> Column:
    """The device name a component stands for, NULL if none."""
    base = F.upper(F.split(F.regexp_replace(_col(name), r"[ .]+$", ""), r"\.")[0])
    return F.when(base.isin(*RESERVED_NAMES), base)


def trimmed_by_windows(name: Column | str) -> Column:
    return _col(name).rlike(r"[ .]$")


def like_escaped(text: str) -> str:
    """A literal for LIKE with backslash as its escape."""
    return text.replace("\\", "\\\\").replace("%", r"\%").replace("_", r"\_")
