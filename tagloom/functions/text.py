"""Column expressions for Unicode folding, tokens and n-grams."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType

# Special tokens and token patterns.
PAD, UNK, NUM = "<PAD>", "<UNK>", "<NUM>"
PUNCTUATION = r"[\p{P}\p{S}]"
DIGIT_RUN = r"\p{Nd}{2}"
ALPHANUMERIC = r"[\p{L}\p{N}]"
WORD = r"[\p{L}\p{N}_]{2,}"

_LATIN = range(0x00C0, 0x0250)


def _folded(cp: int) -> str:
    parts = unicodedata.normalize("NFKD", chr(cp))
    return "".join(c for c in parts if not unicodedata.combining(c))


# Latin letters with a one-letter fold, by rule.
_FOLD = {chr(cp): _folded(cp) for cp in _LATIN if len(_folded(cp)) == 1}
_FOLD_FROM = "".join(k for k, v in _FOLD.items() if k != v)
_FOLD_TO = "".join(v for k, v in _FOLD.items() if k != v)

# Characters that may change and send their row to the Python function. Few
# ranges on purpose: a class of many ranges costs more than the work it saves.
_NEEDS_NFKC = r"[\x80-\xBF\x{132}-\x{133}\x{13F}-\x{140}\x{149}\x{17F}-\x{10FFFF}]"
# After the table above, Latin-1 letters that are left have no fold.
_NEEDS_FOLD = r"[\x80-\xBF\x{100}-\x{10FFFF}]"

# The functions are built inside functions, so that they travel to the workers
# by value and the package need not be installed there.


def _nfkc(col: Column) -> Column:
    @pandas_udf(StringType())
    def compose(text: pd.Series) -> pd.Series:
        return text.map(lambda s: unicodedata.normalize("NFKC", s), na_action="ignore")

    return compose(col)


def _strip_marks(col: Column) -> Column:
    def fold(s: str) -> str:
        return "".join(c for c in unicodedata.normalize("NFKD", s) if not unicodedata.combining(c))

    @pandas_udf(StringType())
    def decompose(text: pd.Series) -> pd.Series:
        return text.map(fold, na_action="ignore")

    return decompose(col)


def _only_where(col: Column, pattern: str, fn) -> Column:
    """Apply a pandas UDF to the rows that match; the others pass null through it."""
    not_ascii = F.octet_length(col) > F.length(col)
    return F.coalesce(fn(F.when(not_ascii & col.rlike(pattern), col)), col)


def nfkc(col: Column) -> Column:
    """Unicode NFKC; texts of ASCII and plain Latin letters never leave the JVM."""
    return _only_where(col, _NEEDS_NFKC, _nfkc)


def strip_accents(col: Column) -> Column:
    """Compatibility-decompose and drop combining marks; Latin letters by table."""
    return _only_where(F.translate(col, _FOLD_FROM, _FOLD_TO), _NEEDS_FOLD, _strip_marks)


def tokenize(col: Column, anonymize_numbers: bool = True, unicode_fold: bool = True) -> Column:
    """Text → tokens.

    Lower-case, NFKC, control characters to spaces, punctuation and symbols
    stripped at token edges, tokens with two digits in a row become ``<NUM>``,
    tokens without any letter or digit dropped. Edges are stripped on the
    whole text in one pass; look-arounds keep long punctuation runs linear.
    """
    text = F.lower(F.coalesce(col, F.lit("")))
    if unicode_fold:
        text = nfkc(text)
    text = F.regexp_replace(text, r"\p{C}", " ")
    space = r"(?U:\s)"
    edges = (
        rf"(?<!(?U:\S)){PUNCTUATION}++|(?<!{PUNCTUATION}){PUNCTUATION}++(?=(?U:\s)|\z)"
    )
    tokens = F.split(F.regexp_replace(text, edges, ""), rf"{space}+")
    tokens = F.filter(tokens, lambda t: t.rlike(ALPHANUMERIC))
    if anonymize_numbers:
        tokens = F.transform(tokens, lambda t: F.when(t.rlike(DIGIT_RUN), F.lit(NUM)).otherwise(t))
    return tokens


def words(text: Column) -> Column:
    """Runs of two or more word characters."""
    return F.regexp_extract_all(text, F.lit(f"({WORD})"))


def collapse_blanks(text: Column) -> Column:
    """Runs of two or more blanks count as one space."""
    return F.regexp_replace(text, r"(?U)\s\s+", " ")


def wide_characters(text: Column) -> Column:
    """Characters of a text outside the basic plane; null for every other text."""
    wide = text.rlike(r"[\x{10000}-\x{10FFFF}]")
    return F.when(wide, F.filter(F.split(text, ""), lambda c: c != ""))


def char_ngrams(text: str, wide: str, low: int, high: int) -> Column:
    """All character n-grams of a text *column*.

    A zero-width look-ahead yields every start in one pass of compiled code
    (``substring`` would walk the UTF-8 text for every gram). Java steps by
    16-bit units, so texts with wider characters take the list form.
    """
    quick = F.concat(*[F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{n}}}))")) for n in range(low, high + 1)])
    return F.when(F.col(wide).isNull(), quick).otherwise(ngrams(wide, low, high, ""))


def ngrams(items: str, low: int, high: int, sep: str) -> Column:
    """All n-grams of an array *column*, n from ``low`` to ``high``.

    The items must be a stored column: an expression inside the lambda would
    be evaluated again for every gram. Positions are read one by one, since
    ``slice`` copies the whole array each time.
    """

    def of_size(n: int) -> Column:
        last = F.size(items) - n
        starts = F.when(last >= 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))

        def gram(i: Column) -> Column:
            parts = [F.get(items, i)]
            for k in range(1, n):
                parts += [F.lit(sep), F.get(items, i + k)] if sep else [F.get(items, i + k)]
            return F.concat(*parts)

        return F.transform(starts, gram)

    return F.concat(*[F.col(items) if n == 1 else of_size(n) for n in range(low, high + 1)])
