"""Expressions over file names: related keys, category stems, health rules, junk, processed variants."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import paths

# File kinds.
AUDIO_SUFFIXES = (".wav", ".aif", ".aiff", ".mp3", ".flac", ".ogg", ".opus", ".m4a", ".w64", ".rf64")
JUNK_FOLDERS = ("_wfCache", "__MACOSX")
JUNK_NAMES = (".DS_Store", "desktop.ini", "Thumbs.db")
JUNK_SUFFIXES = (".reapeaks", ".sfk", ".pkf", ".wf")
# Words that name a processing step.
PROCESSED_WORDS = (
    "audiosuite", "bounce", "bounced", "clean", "cleaned", "comp", "compressed", "denoise", "denoised", "eq", "limited", "limiter",
    "norm", "normalized", "pitch", "pitched", "processed", "render", "rendered", "reverb", "stretch", "stretched", "varispeed", "wet",
)
# Channel markers at the end of a stem.
CHANNEL_MARKERS = ("l", "r", "left", "right", "mid", "side", "ms", "mono", "stereo", "ortf", "xy")

_CHANNEL = rf"(?i)[\s._-]+({'|'.join(CHANNEL_MARKERS)})$"
_NUMBER = r"(?i)(?:[\s._-]*(?:take|tk))?[\s._-]*(\d{1,4})$"
_UCS = r"^([A-Z]{2,5})_([A-Z]{2,8})(?:_([\s\S]*)|$)"


def _or_null(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def _trimmed(base: Column) -> Column:
    return F.regexp_replace(base, r"^[ \-_.]+|[ \-_.]+$", "")


def _letters(base: Column) -> Column:
    return F.length(F.regexp_replace(base, "[^A-Za-z]", "")) >= 3


def related(stem: Column) -> Column:
    """Struct (key, marker, reason) of the series a stem belongs to, NULL if none.

    A channel marker at the end comes first, else a number of up to four digits; what
    stands before must hold three letters.  The key has its separators as one blank, in
    lower case.
    """
    channel_base = _trimmed(F.regexp_replace(stem, _CHANNEL, ""))
    number_base = _trimmed(F.regexp_replace(stem, _NUMBER, ""))

    def made(base: Column, marker: Column, reason: str) -> Column:
        key = F.lower(F.trim(F.regexp_replace(base, r"[\s._-]+", " ")))
        return F.struct(key.alias("key"), marker.alias("marker"), F.lit(reason).alias("reason"))

    return F.when(stem.rlike(_CHANNEL) & _letters(channel_base), made(channel_base, F.upper(F.regexp_extract(stem, _CHANNEL, 1)), "channel_set")).when(
        stem.rlike(_NUMBER) & _letters(number_base), made(number_base, F.regexp_extract(stem, _NUMBER, 1), "numbered_sequence")
    )


def ucs_parts(stem: Column) -> Column:
    """Struct (is_ucs, category, subcategory, remainder) of a stem named by category; upper case only."""
    return F.struct(
        F.coalesce(stem.rlike(_UCS), F.lit(False)).alias("is_ucs"), _or_null(F.regexp_extract(stem, _UCS, 1)).alias("category"),
        _or_null(F.regexp_extract(stem, _UCS, 2)).alias("subcategory"), _or_null(F.regexp_extract(stem, _UCS, 3)).alias("remainder"),
    )


@F.pandas_udf(T.StringType())
def composed(names: pd.Series) -> pd.Series:
    """Canonical composition of each name (Spark has no expression for it)."""
    return names.map(lambda x: x if x is None or x.isascii() else unicodedata.normalize("NFC", x))


def health_issues(component: Column, composed_form: Column) -> Column:
    """Array of issue names of one path component; composed_form: its canonical composition."""
    checks = [
        ("unicode_normalization", component != composed_form),
        ("illegal_chars", component.rlike(r'[:*?"<>|]')),
        ("windows_reserved_name", paths.reserved_name(component).isNotNull()),
        ("trailing_dot_or_space", paths.trimmed_by_windows(component)),
        ("risky_chars", component.rlike(r"[#&;'\\!]")),
        ("name_too_long", F.octet_length(component) > 255),
        ("non_ascii", component.rlike(r"[^\x00-\x7f]")),
        ("leading_trailing_space", component.rlike(r"^\s|\s$")),
        ("dot_prefix", component.startswith(".") & ~component.isin(".", "..")),
    ]
    return F.filter(F.array(*[F.when(test, F.lit(name)) for name, test in checks]), lambda x: x.isNotNull())


def is_junk_file(path: Column, keep_ds_store: bool = False) -> Column:
    """Resource forks always; else junk names and sidecar suffixes, but never audio."""
    name = paths.basename(path)
    low = F.lower(paths.suffix(name))
    names = [n for n in JUNK_NAMES if not (keep_ds_store and n == ".DS_Store")]
    return name.startswith("._") | (~low.isin(*AUDIO_SUFFIXES) & (name.isin(*names) | low.isin(*JUNK_SUFFIXES)))


def in_junk_folder(path: Column) -> Column:
    return F.arrays_overlap(F.split(F.translate(path, "\\", "/"), "/"), F.array(*[F.lit(n) for n in JUNK_FOLDERS]))


def is_audio(path: Column) -> Column:
    return F.lower(paths.suffix(paths.basename(path))).isin(*AUDIO_SUFFIXES)


def words(text: Column) -> Column:
    """Runs of ASCII letters and digits, lower case."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"([a-z0-9]+)"), F.lit(1))


def processed_words(text: Column) -> Column:
    return F.array_sort(F.array_distinct(F.filter(words(text), lambda w: w.isin(*PROCESSED_WORDS))))


def unprocessed_key(text: Column) -> Column:
    """What is left of a name without processing words and numbers."""
    return F.array_join(F.filter(words(text), lambda w: ~w.isin(*PROCESSED_WORDS) & ~w.rlike(r"^\d+$")), " ")


def scan_error_class(prefix: Column, message: Column) -> Column:
    """Class of a file that could not be read, from its first 16 bytes and the message."""
    return (
        F.when(F.substring(F.hex(prefix), 1, 8) == "00051607", "appledouble")
        .when((F.octet_length(prefix) > 0) & F.hex(prefix).rlike("^(00)+$"), "all_zero")
        .when(message.contains("No 'data' chunk marker"), "riff_missing_data")
        .when(message.contains("Malformed 'fmt ' chunk"), "riff_malformed_fmt")
        .when(F.substring(F.hex(prefix), 1, 8) == "52494646", "riff_unrecognized")
        .when(message.contains("Format not recognised"), "unknown_data")
        .otherwise("unknown")
    )


def scan_error_action(kind: Column) -> Column:
    return F.when(kind.isin("all_zero", "appledouble"), "quarantine").otherwise("review")


def human_bytes(size: Column) -> Column:
    """Sizes in the largest unit of 1024 that keeps them at 1 or more."""
    out = F.concat(F.format_string("%.1f", size / F.lit(1024.0**4)), F.lit(" TB"))
    for power, unit in ((3, "GB"), (2, "MB"), (1, "KB")):
        out = F.when(size < 1024 ** (power + 1), F.concat(F.format_string("%.1f", size / F.lit(1024.0**power)), F.lit(f" {unit}"))).otherwise(out)
    return F.when(size < 1024, F.concat(size.cast("string"), F.lit(" B"))).otherwise(out)
