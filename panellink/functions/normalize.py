"""Normal forms as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_BLANKS = " \t\r\n"


def pick(df: DataFrame, name: str | None) -> str | None:
    """The physical name of a column that may be spelled with dots or underscores, or None."""
    if name is None:
        return None
    for spelled in (name, name.replace("_", "."), name.replace(".", "_")):
        if spelled in df.columns:
            return spelled
    return None


def column(df: DataFrame, name: str | None, otherwise: str = "string") -> Column:
    """A column by its logical name; a typed null where the frame lacks it."""
    found = pick(df, name)
    return F.lit(None).cast(otherwise) if found is None else F.col(f"`{found}`")


def trimmed(c: Column) -> Column:
    return F.btrim(c.cast("string"), F.lit(_BLANKS))


def feature(c: Column) -> Column:
    """Upper case without outer blanks; empty is null."""
    return F.nullif(F.upper(trimmed(c)), F.lit(""))


def known(c: Column) -> Column:
    """As ``feature``, with the text NA as null too."""
    return F.nullif(feature(c), F.lit("NA"))


def squished(c: Column) -> Column:
    """As ``feature``, with inner runs of white space as one blank."""
    return F.nullif(F.regexp_replace(F.upper(trimmed(c)), r"\s+", " "), F.lit(""))


def raw_key(c: Column) -> Column:
    """As ``squished``, with null as the empty string."""
    return F.coalesce(squished(c), F.lit(""))


def name_tokens(c: Column) -> Column:
    """Upper-case tokens between blanks and hyphens."""
    return F.filter(F.split(F.upper(trimmed(c)), "[ -]"), lambda t: t != "")


def letters(c: Column) -> Column:
    return F.regexp_replace(F.upper(c), "[^A-Z]", "")


def as_year(c: Column) -> Column:
    return c.try_cast("double").cast("int")


def joined(values: Column, sep: str) -> Column:
    """The distinct non-empty strings of an array, sorted and joined."""
    return F.array_join(F.array_sort(F.array_distinct(F.filter(values, lambda v: v.isNotNull() & (v != "")))), sep)
