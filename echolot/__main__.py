"""Command line: ``python -m echolot DIR ls 'ext:wav'`` or ``python -m echolot DIR QUERY [--out PATH]``."""

from __future__ import annotations

import argparse

from . import dsl
from .queries.catalog import QUERIES
from .session import make_session, table


def main() -> None:
    p = argparse.ArgumentParser(prog="echolot")
    p.add_argument("dir", help="folder with the catalog's Parquet tables")
    p.add_argument("command", choices=["ls", *sorted(QUERIES)])
    p.add_argument("query", nargs="?", default="", help="filter of ls")
    p.add_argument("--sort", default="path")
    p.add_argument("--limit", type=int, default=100)
    p.add_argument("--out", help="write the result there as Parquet instead of showing it")
    a = p.parse_args()
    spark = make_session()
    try:
        df = dsl.listing(table(spark, a.dir, "files"), a.query, a.sort, a.limit) if a.command == "ls" else QUERIES[a.command](spark, a.dir)
    except dsl.QueryError as e:
        p.exit(1, f"{e}\n")
    if a.out:
        df.write.mode("overwrite").parquet(a.out)
    else:
        df.show(a.limit or 100, truncate=80)
    spark.stop()


if __name__ == "__main__":
    main()
