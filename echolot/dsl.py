"""The filter language: text -> terms -> one boolean Column.

``ext:wav rate:>=48000 size:1..10 depth:16,24 has:bext missing:ixml -name:x "free text"``
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Names of the query fields.
FIELDS = {
    "ext": "extension", "extension": "extension", "path": "path", "stem": "stem", "name": "filename", "filename": "filename", "size": "size_bytes",
    "size_bytes": "size_bytes", "duration": "duration_s", "duration_s": "duration_s", "channels": "channels", "sample_rate": "sample_rate",
    "rate": "sample_rate", "sr": "sample_rate", "bit_depth": "bit_depth", "depth": "bit_depth", "md5": "md5", "is_ucs": "is_ucs",
}
NUMBERS = ("size_bytes", "duration_s", "channels", "sample_rate", "bit_depth", "is_ucs")
FLAGS = ("bext", "ixml", "riff_info", "adm", "cue_markers", "sampler")
LISTED = ("id", "path", "filename", "extension", "size_bytes", "sample_rate", "bit_depth", "channels", "duration_s", "md5", "has_bext", "has_ixml", "has_riff_info")
_COMPARE = {
    ">=": lambda a, b: a >= b, "<=": lambda a, b: a <= b, ">": lambda a, b: a > b, "<": lambda a, b: a < b, "=": lambda a, b: a == b,
}


_NUMBER = re.compile(r"-?\d+(\.\d+)?")


class QueryError(ValueError):
    """A query that cannot be read."""


@dataclass(frozen=True)
class Term:
    """field '' is free text; op one of = > >= < <= between in has missing text."""

    field: str
    op: str
    value: object = None
    negated: bool = False


def tokens(query: str) -> list[str]:
    """Words parted by blanks; double quotes keep blanks and vanish."""
    pieces = query.split('"')
    if len(pieces) % 2 == 0:
        raise QueryError("unmatched double quote")
    out, word = [], ""
    for i, piece in enumerate(pieces):
        if i % 2:
            word += piece
            continue
        parts = piece.split()
        if not parts:
            if piece and word:
                out.append(word)
                word = ""
            continue
        if piece[0].isspace() and word:
            out.append(word)
            word = ""
        parts[0] = word + parts[0]
        word = "" if piece[-1].isspace() else parts.pop()
        out += parts
    return [*out, word] if word else out


def _number(text: str) -> int | float:
    if not _NUMBER.fullmatch(text):
        raise QueryError(f"not a number: {text!r}")
    return float(text) if "." in text else int(text)


def _value(field: str, text: str) -> tuple[str, object]:
    numeric = field in NUMBERS
    op = next((p for p in (">=", "<=", ">", "<") if text.startswith(p)), "=")
    rest = text if op == "=" else text[len(op) :]
    if op != "=":
        if not numeric:
            raise QueryError(f"{field} cannot be compared with {op}")
        return op, _number(rest)
    if ".." in rest:
        if not numeric:
            raise QueryError(f"{field} has no ranges")
        low, _, high = rest.partition("..")
        return "between", (_number(low), _number(high))
    if "," in rest:
        items = [x for x in map(str.strip, rest.split(",")) if x]
        if not items:
            raise QueryError(f"empty list for {field}")
        return "in", tuple(_number(x) for x in items) if numeric else tuple(items)
    return "=", _number(rest) if numeric else rest


def parse(query: str) -> list[Term]:
    """Terms of a query; [] for an empty one.  A minus negates only a term with a colon."""
    out = []
    for word in tokens(query.strip()):
        negated = len(word) > 1 and word[0] == "-" and ":" in word[1:]
        name, colon, text = word[negated:].partition(":")
        if not colon:
            out.append(Term("", "text", word))
        elif name.lower() in ("has", "missing"):
            if text not in FLAGS:
                raise QueryError(f"unknown flag {text!r}; known: {', '.join(FLAGS)}")
            out.append(Term(f"has_{text}", name.lower(), None, negated))
        elif name.lower() in FIELDS:
            field = FIELDS[name.lower()]
            out.append(Term(field, *_value(field, text), negated))
        else:
            raise QueryError(f"unknown field {name!r}")
    return out


def _dotted(ext: str) -> str:
    ext = ext.strip().lower()
    return ext if ext.startswith(".") else f".{ext}"


def _term(t: Term) -> Column:
    col = F.col(t.field) if t.field else None
    if t.op == "text":
        # % and _ stay wildcards in free text
        pattern = f"%{t.value}%".lower().replace("\\", "\\\\")
        return reduce(lambda a, b: a | b, [F.lower(F.col(c)).like(pattern) for c in ("path", "filename", "stem")])
    if t.op == "has":
        return col == 1
    if t.op == "missing":
        return col.isNull() | (col == 0)
    if t.op == "between":
        return col.between(*t.value)
    if t.op == "in":
        return col.isin(*[_dotted(v) for v in t.value] if t.field == "extension" else t.value)
    if t.field == "extension":
        return F.lower(col) == _dotted(str(t.value))
    return _COMPARE[t.op](col, F.lit(t.value))


def condition(terms: list[Term]) -> Column:
    """All terms together; SQL's three-valued logic holds, so a negated comparison drops NULLs."""
    return reduce(lambda a, b: a & b, [~_term(t) if t.negated else _term(t) for t in terms], F.lit(True))


def listing(files: DataFrame, query: str = "", sort: str = "path", limit: int = 100) -> DataFrame:
    """Readable files that match a query, sorted ('-' before the key: descending, ties by id); limit 0: all."""
    descending = sort.startswith("-")
    raw = sort.lstrip("-")
    key = raw if raw in LISTED else FIELDS.get(raw.lower())
    if key not in LISTED:
        raise QueryError(f"cannot sort by {sort!r}")
    rows = files.where(F.col("scan_error").isNull() & condition(parse(query))).select(*LISTED)
    rows = rows.orderBy(F.col(key).desc() if descending else F.col(key).asc(), "id")
    return rows if limit == 0 else rows.limit(limit)


__all__ = ["FIELDS", "QueryError", "Term", "condition", "listing", "parse", "tokens"]
