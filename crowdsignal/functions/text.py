"""String expressions shared by the operators; all of them stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The cells that a CSV reader of the pandas family takes as missing.
NA_VALUES = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>",
    "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)

TIMESTAMP_FORMAT = "yyyy-MM-dd HH:mm:ss"


def contributor(author: Column) -> Column:
    """The author's name without surrounding spaces, a leading ``u/`` or ``/u/`` and letter case.

    Null for nobody: a null author, or ``[deleted]``. An empty name stays a contributor of its own.
    """
    name = F.lower(F.regexp_replace(F.trim(author), "^/?u/", ""))
    return F.when(name != "[deleted]", name)


def unicode_strip(text: Column) -> Column:
    """Without white space of any script on either side; null stays null.

    A run of blanks is tried once, at its first sign, and never given back in part, so the time is linear in the text.
    """
    return F.regexp_replace(text, r"(?U)^[\s\x1c-\x1f]++|(?<![\s\x1c-\x1f])[\s\x1c-\x1f]++\z", "")


def letters_and_digits(text: Column) -> Column:
    """Only the letters and digits of any script (Unicode L and N), in lower case; null counts as empty."""
    return F.lower(F.regexp_replace(F.coalesce(text, F.lit("")), r"[^\p{L}\p{N}]+", ""))


def na_to_null(text: Column) -> Column:
    return F.when(~text.isin(*NA_VALUES), text)


def number(value: Column) -> Column:
    """A double, with null in place of NaN."""
    value = value.cast("double")
    return F.when(~F.isnan(value), value)
