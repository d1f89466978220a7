"""Registry of catalog queries: name -> (DataFrame function, SQL with the same result or None)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        QUERIES[fn.__name__] = fn
        if sql is not None:
            SQL[fn.__name__] = sql
        return fn

    return add


# --- SQL fragments for the oracle -----------------------------------------


def slashed(c: str) -> str:
    t = f"replace({c}, '\\', '/')"
    body = f"regexp_replace({t}, '/+', '/', 'g')"
    joined = f"(CASE WHEN starts_with({t}, '//') THEN '/' || {body} ELSE {body} END)"
    return f"(CASE WHEN regexp_full_match({joined}, '/+') THEN left({joined}, 1) ELSE rtrim({joined}, '/') END)"


def key(c: str) -> str:
    return f"(CASE WHEN regexp_matches({slashed(c)}, '^([A-Za-z]:|//)') THEN lower({slashed(c)}) ELSE {slashed(c)} END)"


def base(c: str) -> str:
    return f"regexp_extract({c}, '([^/\\\\]*)$', 1)"


def parent(c: str) -> str:
    return f"nullif(regexp_extract({c}, '^(.*)[/\\\\][^/\\\\]*$', 1), '')"


def suffix(c: str) -> str:
    return f"regexp_extract({c}, '[^/\\\\.](\\.[^./\\\\ ]+)$', 1)"


def stem(c: str) -> str:
    return f"left({base(c)}, length({base(c)}) - length({suffix(base(c))}))"


def ancestors(c: str) -> str:
    """Table of (folder) for a path key expression, to be unnested."""
    k = key(c)
    return f"list_filter(list_transform(range(1, greatest(len(string_split({k}, '/')), 2)), lambda n: array_to_string(string_split({k}, '/')[1:n], '/')), lambda x: x <> '' AND x <> '/' AND len(string_split({k}, '/')) > 1)"
