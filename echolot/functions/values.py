"""Expressions over stored values: lists as text, tag fields, JSON."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

# Other names of the tag fields, and where each is embedded in a file (namespace, key).
FIELD_ALIASES = {
    "keywords": "keyword", "ikey": "keyword", "genre": "category", "ignr": "category", "ww:subcategory": "subcategory", "isbj": "subcategory",
    "inam": "title", "icmt": "comment", "ww:ucs_category": "ucs_category", "ww:ucs_subcategory": "ucs_subcategory", "organization": "originator",
    "encodedby": "originator_reference", "ww:take_number": "take_number", "ww:channel_position": "channel_position",
}
EMBEDDED_KEYS = {
    "description": (("bext", "description"), ("tag", "description"), ("id3", "description"), ("vorbis", "description"), ("mp4", "description")),
    "keyword": (("riff_info", "ikey"), ("tag", "keywords")),
    "category": (("riff_info", "ignr"), ("tag", "genre"), ("tag", "category")),
    "subcategory": (("riff_info", "isbj"), ("tag", "ww:subcategory"), ("tag", "subcategory")),
    "title": (("riff_info", "inam"), ("tag", "title"), ("id3", "title"), ("vorbis", "title"), ("mp4", "title")),
    "comment": (("riff_info", "icmt"), ("tag", "comment"), ("id3", "comment"), ("vorbis", "comment"), ("mp4", "comment")),
    "ucs_category": (("tag", "ww:ucs_category"),),
    "ucs_subcategory": (("tag", "ww:ucs_subcategory"),),
    "originator": (("bext", "originator"), ("tag", "organization")),
    "originator_reference": (("bext", "originatorreference"), ("tag", "encodedby")),
    "take_number": (("tag", "ww:take_number"),),
    "channel_position": (("tag", "ww:channel_position"),),
}
MULTIVALUED = ("keyword",)
# Rank of the sources of suggestions.
SOURCE_RANK = {"ucs_stem": 60, "ucs_catalog": 50, "group": 40, "path": 30, "filename": 20, "synonym": 10}


def literal_map(d: dict) -> Column:
    return F.create_map(*[F.lit(x) for x in chain.from_iterable(d.items())])


def canonical_field(name: Column) -> Column:
    """The field a name stands for; unknown names in lower case."""
    low = F.lower(F.trim(name))
    return F.coalesce(literal_map(FIELD_ALIASES)[low], low)


def is_multivalued(field: Column) -> Column:
    return field.isin(*MULTIVALUED)


def source_rank(source: Column) -> Column:
    return F.coalesce(literal_map(SOURCE_RANK)[source], F.lit(0))


def value_key(value: Column) -> Column:
    """Values that differ in case or blanks only have one key."""
    return F.lower(F.trim(F.regexp_replace(value, r"[\s ]+", " ")))


def text_list(text: Column) -> Column:
    """A JSON list as array<string>; a JSON scalar or other text as a list of one; NULL and '' as the empty list."""
    parsed = F.from_json(text, "array<string>", {"allowSingleQuotes": "false"})
    whole = F.trim(text)
    bare = F.when(whole.rlike(r'^".*"$'), F.regexp_replace(whole, r'^"|"$', "")).otherwise(text)
    empty = F.array().cast("array<string>")
    return F.when(text.isNull() | (whole == "") | (whole == "null"), empty).when(whole.startswith("[") & parsed.isNotNull(), F.filter(parsed, lambda x: x.isNotNull())).otherwise(F.array(bare))
