"""Best representative of each duplicate group (problem 1).

Fields that depend on each other form a bundle and are taken whole from one row.
For each group one row is chosen per bundle so that the summed trust is greatest
while the functional dependencies between bundles hold.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


@dataclass(frozen=True)
class Bundle:
    """name: of the bundle; fields: columns taken together; trust: greater is better, NULL or NaN: unusable."""

    name: str
    fields: tuple[str, ...]
    trust: Column


@dataclass(frozen=True)
class Dependency:
    """The value of left (in bundle left_bundle) determines right (in bundle right_bundle).

    Which right value belongs to a left value is read from the whole collection: the most
    frequent one, the smallest on a tie.  A NULL left value determines nothing.
    """

    left_bundle: str
    left: str
    right_bundle: str
    right: str


def best_choice(candidates: dict[str, list[tuple]], links: Sequence[tuple[str, int, str, int]]) -> dict[str, tuple] | None:
    """Branch and bound over one group.

    candidates: by bundle (trust, id, slots) with the best first; links: (bundle x, slot,
    bundle y, slot) whose slots must be equal unless x's slot is None.  Returns for each
    bundle the candidate of the assignment with the greatest summed trust, on a tie with
    the smallest ids in the order of the bundles; None if no assignment is consistent.
    """
    names = sorted(candidates, key=lambda n: (len(candidates[n]), n))
    best_rest = [0.0] * (len(names) + 1)
    for i in range(len(names) - 1, -1, -1):
        best_rest[i] = best_rest[i + 1] + (candidates[names[i]][0][0] if candidates[names[i]] else 0.0)
    order = list(candidates)
    best: list = [None, None, None]

    def fits(chosen: dict[str, tuple]) -> bool:
        for x, i, y, j in links:
            if x in chosen and y in chosen:
                left, right = chosen[x][2][i], chosen[y][2][j]
                if left is not None and left != right:
                    return False
        return True

    def search(depth: int, chosen: dict[str, tuple], trust: float) -> None:
        if best[0] is not None and trust + best_rest[depth] < best[0]:
            return
        if depth == len(names):
            ids = [chosen[n][1] for n in order]
            if best[0] is None or (trust, [-i for i in ids]) > (best[0], [-i for i in best[1]]):
                best[:] = trust, ids, dict(chosen)
            return
        name = names[depth]
        for candidate in candidates[name]:
            if best[0] is not None and trust + candidate[0] + best_rest[depth + 1] < best[0]:
                break  # candidates come best first: none of the rest can do better
            chosen[name] = candidate
            if fits(chosen):
                search(depth + 1, chosen, trust + candidate[0])
            del chosen[name]

    search(0, {}, 0.0)
    return best[2]


def linked(names: Sequence[str], links: Sequence[tuple[str, int, str, int]]) -> list[tuple[list[str], list[tuple[str, int, str, int]]]]:
    """Sets of bundles that links hold together, in the order of names, each with its links."""
    of = {n: {n} for n in names}
    for x, _, y, _ in links:
        both = of[x] | of[y]
        of |= dict.fromkeys(both, both)
    return [([n for n in names if n in of[head]], [k for k in links if k[0] in of[head]]) for head in names if head == next(n for n in names if n in of[head])]


def surviving_rows(df: DataFrame, group_col: str, id_col: str, bundles: Sequence[Bundle], dependencies: Sequence[Dependency] = ()) -> DataFrame:
    """(group, n_rows, consistent, <bundle>_id for each bundle): the row each bundle is taken from.

    Only groups of two or more rows with distinct ids; rows with NULL group or id take no
    part.  A bundle without any usable (non-NULL) trust in the group gets NULL.  On a tie
    the smallest id wins; repeated rows change nothing but n_rows is of distinct ids where
    ids repeat.  If no choice satisfies the dependencies, each bundle keeps its most
    trusted row (the constraint cannot be met within the group).

    Every group is solved by branch and bound over its candidates.  These are what one
    aggregation with map-side combining leaves of a group of any size: for bundles without
    dependencies the rows that are best for one of them, each a candidate for all of them
    that it is usable for; for the others the best row for each combination of the values
    that the dependencies look at (left values replaced by what they determine).  Neither
    loses an optimum.  Bundles that no dependency links are searched apart, so a great trust
    of one cannot swallow a small difference of another.
    """
    tied = {d.left_bundle for d in dependencies} | {d.right_bundle for d in dependencies}
    # only what is needed, under names of our own: other columns of df cannot clash
    base = df.where(F.col(group_col).isNotNull() & F.col(id_col).isNotNull()).select(
        F.col(group_col).alias("_group"), F.col(id_col).alias("_id"), *[F.when(~F.isnan(b.trust.cast("double")), b.trust.cast("double")).alias(f"_t_{b.name}") for b in bundles],
        *[c for n, d in enumerate(dependencies) for c in (F.col(d.left).alias(f"_left{n}"), F.col(d.right).alias(f"_right{n}"))],
    )
    slots: dict[str, list[Column]] = {b.name: [] for b in bundles}
    links: list[tuple[str, int, str, int]] = []
    for n, d in enumerate(dependencies):
        counts = base.where(F.col(f"_left{n}").isNotNull() & F.col(f"_right{n}").isNotNull()).groupBy(f"_left{n}", f"_right{n}").count()
        # the most frequent right value, the smallest on a tie
        ranked = counts.groupBy(f"_left{n}").agg(F.min_by(f"_right{n}", F.struct(-F.col("count"), F.col(f"_right{n}"))).alias(f"_fd{n}"))
        base = base.join(ranked, f"_left{n}", "left")
        links.append((d.left_bundle, len(slots[d.left_bundle]), d.right_bundle, len(slots[d.right_bundle])))
        slots[d.left_bundle].append(F.col(f"_fd{n}").cast("string"))
        slots[d.right_bundle].append(F.col(f"_right{n}").cast("string"))

    names = [b.name for b in bundles]
    free = [b.name for b in bundles if b.name not in tied]

    def entry(b: Bundle) -> Column:
        rest = [] if b.name in tied else [F.array(*[F.col(f"_t_{n}") for n in free]).alias("trusts")]
        return F.when(F.col(f"_t_{b.name}").isNotNull(), F.struct(F.col(f"_t_{b.name}").alias("trust"), (-F.col("_id")).alias("neg_id"), *rest))

    base = base.select(
        "_group", "_id", *[entry(b).alias(f"_e_{b.name}") for b in bundles], *[F.array(*slots[b.name]).alias(f"_s_{b.name}") for b in bundles if b.name in tied]
    )
    groups = base.groupBy("_group").agg(F.count("*").alias("n_rows"), F.min("_id").alias("_lo"), F.max("_id").alias("_hi"), *[F.max(f"_e_{n}").alias(f"_e_{n}") for n in free]).where("_lo < _hi")
    nothing = F.lit(None).cast("array<string>")
    groups = groups.withColumns({"_free": F.array_compact(F.array(*[F.col(f"_e_{n}") for n in free])) if free else nothing, "_tied": nothing})
    # candidates of the tied bundles: the best row per combination of slots
    if tied:
        entries = [F.struct(F.lit(n).alias("bundle"), F.col(f"_s_{n}").alias("slots"), F.col(f"_e_{n}").alias("best")) for n in names if n in tied]
        stacked = base.select("_group", F.explode(F.array(*entries)).alias("c")).where("c.best IS NOT NULL")
        reduced = stacked.groupBy("_group", "c.bundle", "c.slots").agg(F.max("c.best").alias("best"))
        gathered = reduced.groupBy("_group").agg(F.collect_list(F.struct("bundle", "slots", "best")).alias("_tied"))
        groups = groups.drop("_tied").join(gathered, "_group", "left")
    parts = linked(names, links)

    @F.pandas_udf(T.StructType([*[T.StructField(f"{n}_id", T.LongType()) for n in names], T.StructField("consistent", T.BooleanType())]))
    def choose(free_: pd.Series, tied_: pd.Series) -> pd.DataFrame:
        rows = []
        for free_rows, tied_rows in zip(free_, tied_):
            by: dict[str, list[tuple]] = {}
            for c in free_rows if free_rows is not None else ():
                for n, trust in zip(free, c["trusts"]):
                    if trust is not None and trust == trust:  # NULL comes as NaN
                        by.setdefault(n, []).append((trust, -c["neg_id"], ()))
            for c in tied_rows if tied_rows is not None else ():
                by.setdefault(c["bundle"], []).append((c["best"]["trust"], -c["best"]["neg_id"], tuple(c["slots"])))
            row: dict = {"consistent": True}
            for part, of_part in parts:
                cands = {n: sorted(by[n], key=lambda x: (-x[0], x[1])) for n in part if n in by}
                found = best_choice(cands, of_part)
                row["consistent"] &= found is not None
                row |= {f"{n}_id": c[1] for n, c in (found or {n: v[0] for n, v in cands.items()}).items()}
            rows.append(row)
        out = pd.DataFrame(rows, columns=[*[f"{n}_id" for n in names], "consistent"])
        return out.astype({**{f"{n}_id": "Int64" for n in names}, "consistent": "bool"})

    chosen = groups.withColumn("p", choose("_free", "_tied"))
    return chosen.select(F.col("_group").alias(group_col), "n_rows", "p.consistent", *[f"p.{n}_id" for n in names])


EMPTY_MD5 = "d41d8cd98f00b204e9800998ecf8427e"


def canonical_md5(col: Column | str) -> Column:
    """32 lower-case hex digits, however spelled (case, blanks, dashes, 'md5' before it); NULL if no digest of a content.

    The digest of nothing and a digit repeated 32 times (placeholders) are none.
    """
    col = F.col(col) if isinstance(col, str) else col
    digits = F.regexp_replace(F.lower(col), r"[\s\p{Z}{}\"'\-]+", "")
    digits = F.regexp_replace(digits, r"^md5[:=(]?|\)$", "")
    return F.when(digits.rlike(r"^[0-9a-f]{32}$") & ~digits.rlike(r"^(.)\1{31}$") & (digits != EMPTY_MD5), digits)


def canonical_path(col: Column | str) -> Column:
    """Drive paths in lower case with '/'; other paths as they are."""
    col = F.col(col) if isinstance(col, str) else col
    return F.when(col.rlike(r"^[A-Za-z]:"), F.lower(F.translate(col, "\\", "/"))).otherwise(col)


#: Up to so many folder rules go into the plan as literals; more are joined on the path's ancestors.
MAX_LITERAL_RULES = 200


def with_folder_rank(df: DataFrame, path_col: str, rules: DataFrame, id_col: str, out_col: str = "folder_rank") -> DataFrame:
    """df with the smallest rule_order of the rules' folders that path_col lies below; NULL if none."""
    rules = rules.where("folder IS NOT NULL AND rule_order IS NOT NULL").select(F.regexp_replace(canonical_path("folder"), "/+$", "").alias("folder"), "rule_order")
    head = rules.limit(MAX_LITERAL_RULES + 1).collect()
    path = canonical_path(path_col)
    if not head:
        return df.withColumn(out_col, F.lit(None).cast("int"))
    if len(head) <= MAX_LITERAL_RULES:
        return df.withColumn(out_col, F.array_min(F.array(*[F.when(path.startswith(r["folder"] + "/"), F.lit(r["rule_order"])) for r in head])))
    parts = F.split(path, "/")
    above = F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    ranks = df.select(F.col(id_col).alias("_ranked_id"), F.explode(above).alias("folder")).join(rules, "folder").groupBy("_ranked_id").agg(F.min("rule_order").alias(out_col))
    return df.drop(out_col).join(ranks, F.col(id_col) == F.col("_ranked_id"), "left").drop("_ranked_id")


def source_count(col: Column | str) -> Column:
    """Number of distinct names in a list written as text, apart from case and blanks; NULL if none.

    JSON lists, lists with other quotes, cut-off lists, bare names and names parted by
    comma, semicolon or bar are read alike; 'null' and empty names are no names.
    """
    col = F.col(col) if isinstance(col, str) else col
    bare = F.regexp_replace(F.lower(col), r"[\[\]{}()\"'\s\p{Z}]+", "")
    names = F.array_distinct(F.split(bare, r"[,;|/]+"))
    n = F.size(F.filter(names, lambda x: (x != "") & ~x.isin("null", "none", "nan")))
    return F.when(n > 0, n)
