"""Column functions that several operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# White space, ASCII and beyond, one by one and as the inside of a character class.
SPACE_CHARACTERS = " \t\n\x0b\f\r\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"
SPACES = r"\s\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"


def trimmed(col: Column) -> Column:
    """Without white space of any kind at either end."""
    return F.btrim(col, F.lit(SPACE_CHARACTERS))


def starts_blank(col: Column) -> Column:
    """Whether a text starts with white space of any kind."""
    return (col != "") & F.contains(F.lit(SPACE_CHARACTERS), F.substring(col, 1, 1))


def ends_blank(col: Column) -> Column:
    """Whether a text ends with white space of any kind."""
    return (col != "") & F.contains(F.lit(SPACE_CHARACTERS), F.substring(col, -1, 1))


def one_space(col: Column) -> Column:
    """Each run of white space as one space."""
    return F.regexp_replace(col, rf"[{SPACES}]+", " ")


def settings(df: DataFrame, most: int = 10_000) -> DataFrame:
    """A table of settings to be broadcast, once its size is known: more than `most` rows are an error, not a memory problem."""
    n = df.limit(most + 1).count()
    if n > most:
        raise ValueError(f"a table of settings has at most {most} rows")
    return F.broadcast(df)
