"""One consistent character form for text (problem 2).

Text that a reader cannot tell apart may be stored with different characters.
``consistent`` gives such texts one form:

1. compatibility decomposition (width, ligatures, presentation forms); characters
   that a reader does tell apart (superscripts, circled digits, fractions) stay;
2. default-ignorable characters removed, every blank mapped to U+0020, hyphens and
   apostrophes that look like the ASCII ones mapped to them;
3. letters of other scripts that look like Latin ones mapped to these;
4. canonical composition;
5. a word that holds letters of a script without Latin twins is given wholly in
   that script (its Latin letters mapped back), so that native words stay native.

Every step depends only on the looks of the text, so equal-looking texts get one
form and the mapping is idempotent.  NULL gives NULL, '' gives ''.  Letter case and
accents are kept; ``folded`` adds full case folding.

The work is done once per distinct value of an Arrow batch; plain ASCII never
leaves the JVM's side as text (the UDF receives NULL for it).
"""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Default-ignorable code points (Unicode DerivedCoreProperties).
DEFAULT_IGNORABLE = (
    (0x00AD, 0x00AD), (0x034F, 0x034F), (0x061C, 0x061C), (0x115F, 0x1160), (0x17B4, 0x17B5), (0x180B, 0x180F),
    (0x200B, 0x200F), (0x202A, 0x202E), (0x2060, 0x206F), (0x3164, 0x3164), (0xFE00, 0xFE0F), (0xFEFF, 0xFEFF),
    (0xFFA0, 0xFFA0), (0xFFF0, 0xFFF8), (0x1BCA0, 0x1BCA3), (0x1D173, 0x1D17A), (0xE0000, 0xE0FFF),
)

# Letters that look like Latin ones, by script, each with its twin.
CYRILLIC_TWINS = dict(zip("АВЕЅІЈКМНОРСТУХԚԜаеѕіјорсухһԛԝԁѵӏү", "ABESIJKMHOPCTYXQWaesijopcyxhqwdvly"))
GREEK_TWINS = dict(zip("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧαινορυϳϲ", "ABEZHIKMNOPTYXaivopujc"))
ARMENIAN_TWINS = dict(zip("օհսոցզ", "ohungq"))
LATIN_TWINS = {"ı": "i", "ɑ": "a", "ɡ": "g", "ɩ": "i", "ʋ": "v", "ǀ": "l", "ѐ": "è"}
PUNCTUATION_TWINS = dict(zip("‐‑‒–−⁃’‘ʼ′ʹ“”„∕⁄․‚", "-----" + "-" + "'''''" + '"""' + "//" + ".,"))
# Compatibility tags whose characters a reader tells from their plain form.
VISIBLE_TAGS = ("<super>", "<sub>", "<circle>", "<fraction>", "<square>", "<font>")

_TWINS = CYRILLIC_TWINS | GREEK_TWINS | ARMENIAN_TWINS | LATIN_TWINS
_BACK = {
    "CYRILLIC": {v: k for k, v in CYRILLIC_TWINS.items() if k in "АВЕКМНОРСТУХаеорсух"},
    "GREEK": {v: k for k, v in GREEK_TWINS.items() if k not in "ϳϲ"},
}
_WORD = re.compile(r"[^\W\d_](?:[^\W\d_]|[\u0300-\u036f])*")


@lru_cache(maxsize=None)
def _table() -> dict[int, str | None]:
    table: dict[int, str | None] = {}
    for first, last in DEFAULT_IGNORABLE:
        table.update(dict.fromkeys(range(first, last + 1)))
    for code in (*range(0x09, 0x0E), 0x1C, 0x1D, 0x1E, 0x1F, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000):
        table[code] = " "
    table.update({ord(a): b for a, b in (PUNCTUATION_TWINS | _TWINS).items()})
    return table


@lru_cache(maxsize=65536)
def _expanded(ch: str) -> str:
    """Compatibility decomposition of one character, unless a reader sees the difference."""
    tag = unicodedata.decomposition(ch).partition(" ")[0]
    return ch if tag in VISIBLE_TAGS else unicodedata.normalize("NFKD", ch)


@lru_cache(maxsize=65536)
def _script(ch: str) -> str:
    return unicodedata.name(ch, "").partition(" ")[0]


def _native(match: re.Match) -> str:
    word = match[0]
    if word.isascii():
        return word
    for script, back in _BACK.items():
        if any(ord(c) > 0x24F and _script(c) == script for c in word):
            return "".join(back.get(c, c) for c in word)
    return word


def consistent(text: str) -> str:
    """The consistent form of one text."""
    if text.isascii():
        return text if text.isprintable() else text.translate(_table())
    s = "".join(map(_expanded, text))
    s = unicodedata.normalize("NFD", s).translate(_table())
    return unicodedata.normalize("NFC", _WORD.sub(_native, s))


def folded(text: str) -> str:
    """The consistent form under full case folding, composed."""
    return unicodedata.normalize("NFC", consistent(text).casefold())


def lowered(text: str) -> str:
    """The consistent form in lower case, composed."""
    return unicodedata.normalize("NFC", consistent(text).lower())


def by_distinct(fn, values: pd.Series) -> pd.Series:
    """fn over each distinct value of a batch once; NULL stays NULL."""
    codes, distinct = pd.factorize(values)
    done = [fn(v) for v in distinct]
    return pd.Series([done[c] if c >= 0 else None for c in codes], dtype=object)


def _vectorized(fn):
    @F.pandas_udf(T.StringType())
    def udf(values: pd.Series) -> pd.Series:
        return by_distinct(fn, values)

    return udf


_FORMS = {"keep": (consistent, lambda c: c), "lower": (lowered, F.lower), "fold": (folded, F.lower)}


def consistent_col(col: Column | str, case: str = "keep") -> Column:
    """Column of consistent forms; case: 'keep', 'lower' or 'fold'.

    Printable ASCII is handled by JVM expressions, all else by the Arrow UDF.
    """
    col = F.col(col) if isinstance(col, str) else col
    fn, plain = _FORMS[case]
    ascii_ = col.rlike(r"^[\x20-\x7e]*$")
    return F.when(ascii_, plain(col)).otherwise(_vectorized(fn)(F.when(~ascii_, col)))
