"""Column expressions for text, code and label-cell cleaning (JVM only)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Every character a full Unicode strip removes (White_Space and
# the four information separators).
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009"
    "\u200a\u2028\u2029\u202f\u205f\u3000"
)


def strip(col: Column) -> Column:
    """Strip all Unicode whitespace at both ends (plain ``trim`` removes spaces only)."""
    return F.btrim(col, F.lit(WHITESPACE))


def normalize_text(col: Column) -> Column:
    """Unify line ends, collapse runs of spaces/tabs, strip both ends."""
    lines = F.regexp_replace(col, r"\r\n?", "\n")
    return strip(F.regexp_replace(lines, r"[ \t]+", " "))


def normalize_code(col: Column) -> Column:
    """Code as stripped, upper-cased text; leading zeros survive."""
    return F.upper(strip(col.cast("string")))


def json_list(col: Column) -> Column:
    """JSON list text → ``array<string>``; null when it is not a JSON list."""
    return F.from_json(col, "array<string>")


def _clean_tokens(tokens: Column, uppercase: bool, remove_dots: bool, drop_empty: bool) -> Column:
    def one(token: Column) -> Column:
        token = strip(token)
        if remove_dots:
            token = F.replace(token, F.lit("."), F.lit(""))
        return F.upper(token) if uppercase else token

    cleaned = F.transform(F.filter(tokens, lambda t: t.isNotNull()), one)
    return F.filter(cleaned, lambda t: t != "") if drop_empty else cleaned


def normalize_label_list(
    col: Column, *, uppercase: bool = True, remove_dots: bool = False, drop_empty: bool = True
) -> Column:
    """Label cell that already is an array → cleaned array; null → empty."""
    empty = F.array().cast("array<string>")
    return F.coalesce(_clean_tokens(col.cast("array<string>"), uppercase, remove_dots, drop_empty), empty)


def normalize_labels(
    col: Column,
    *,
    uppercase: bool = True,
    remove_dots: bool = False,
    parse_json_list: bool = True,
    split_commas: bool = True,
    drop_empty: bool = True,
) -> Column:
    """Label cell stored as text → cleaned array.

    ``[...]`` is read as JSON and kept whole if that fails; otherwise commas
    separate labels; null and blank cells give an empty array.
    """
    text = strip(col)
    empty = F.array().cast("array<string>")
    tokens = F.array(text)
    if split_commas:
        tokens = F.when(F.contains(text, F.lit(",")), F.split(text, ",")).otherwise(tokens)
    if parse_json_list:
        bracketed = F.startswith(text, F.lit("[")) & F.endswith(text, F.lit("]"))
        tokens = F.when(bracketed, F.coalesce(json_list(text), F.array(text))).otherwise(tokens)
    cleaned = _clean_tokens(tokens, uppercase, remove_dots, drop_empty)
    return F.when(text.isNull() | (text == ""), empty).otherwise(cleaned)


def labels_any_to_list(col: Column) -> Column:
    """Loose text cell → array: JSON list if it parses, else one label; null → empty."""
    empty = F.array().cast("array<string>")
    return F.when(col.isNull(), empty).otherwise(F.coalesce(json_list(col), F.array(col)))


def labels_to_json(col: Column) -> Column:
    """Text cell → JSON list text: valid lists pass, null → ``[]``, scalars are wrapped."""
    text = strip(col)
    bracketed = F.startswith(text, F.lit("[")) & F.endswith(text, F.lit("]"))
    return (
        F.when(col.isNull(), F.lit("[]"))
        .when(bracketed & json_list(text).isNotNull(), text)
        .otherwise(F.to_json(F.array(text)))
    )


def label_list_to_json(col: Column) -> Column:
    """``array<string>`` → JSON list text; null → ``[]``."""
    return F.coalesce(F.to_json(col), F.lit("[]"))


def coerce_index_cell(col: Column) -> Column:
    """Label-index text cell → ``array<int>``; bad text or a negative index raises."""
    text = strip(col)
    parsed = F.from_json(text, "array<int>")
    bad = parsed.isNull() | F.exists(parsed, lambda i: i.isNull() | (i < 0))
    return (
        F.when(text.isNull() | (text == ""), F.array().cast("array<int>"))
        .when(bad, F.raise_error(F.concat(F.lit("bad label index cell: "), text)).cast("array<int>"))
        .otherwise(parsed)
    )
