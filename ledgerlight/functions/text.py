"""Text repair expressions: trimming, placeholder detection and safe casts.

All are built-in column expressions, so they stay inside whole-stage codegen.
The two shape patterns gate the casts because Spark's own casts accept text a
business table should not (``'12d'``, ``'2026'`` as a date, trailing junk).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# Text that stands for "no value" once trimmed and lower-cased.
NULL_TOKENS = ("", "na", "n/a", "n.a.", "null", "none", "nil", "-", "--", "?", "unknown")
# Accepted spellings of the two truth values.
TRUE_WORDS = ("true", "yes", "y", "t", "1")
FALSE_WORDS = ("false", "no", "n", "f", "0")
# Currency signs and separators dropped before a number is read.
NUMBER_NOISE = "$€£, \t\n\f\r"
# Unicode space separators (general category Zs).
SPACES = (
    "\u0020\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u202f\u205f\u3000"
)

NUMBER_SHAPE = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"
DATE_SHAPE = (
    r"^[0-9]{4}[-/][0-9]{1,2}[-/][0-9]{1,2}([ T][0-9]{2}:[0-9]{2}(:[0-9]{2}(\.[0-9]+)?)?)?$"
)


def trim_spaces(text: Column) -> Column:
    return F.trim(text, F.lit(SPACES))


def is_null_token(trimmed: Column) -> Column:
    return F.lower(trimmed).isin(*NULL_TOKENS)


def to_number(text: Column) -> Column:
    """DOUBLE for text that is a number once currency noise is gone, else NULL."""
    bare = F.translate(text, NUMBER_NOISE, "")
    return F.when(bare.rlike(NUMBER_SHAPE), bare.try_cast("double"))


def to_date(text: Column) -> Column:
    """DATE for ISO-like text, else NULL; impossible calendar days are NULL too."""
    return F.when(text.rlike(DATE_SHAPE), F.translate(text, "/", "-").try_cast("date"))


def to_boolean(text: Column) -> Column:
    word = F.lower(text)
    return F.when(word.isin(*TRUE_WORDS), F.lit(True)).when(word.isin(*FALSE_WORDS), F.lit(False))


# What a text value looks like, one bit each.
BLANK, TOKEN, PADDED, NUMBER, DATE, BOOLEAN, REAL = (1 << i for i in range(7))


def with_shape(df: DataFrame, text: str, shape: str) -> DataFrame:
    """Add an integer column of shape bits for a text column.

    Number, date and boolean bits are only set on real values: neither null nor token.
    """
    bare, word, real = F.col("__bare"), F.col("__word"), F.col("__real")
    bit = lambda holds, value: F.when(holds, value).otherwise(0)
    return (
        df.withColumn("__bare", trim_spaces(F.col(text)))
        .withColumn("__word", F.lower(bare))
        .withColumn("__real", ~word.isin(*NULL_TOKENS))
        .withColumn(
            shape,
            bit(bare == "", BLANK) + bit(~real, TOKEN) + bit(F.col(text) != bare, PADDED)
            + bit(real & to_number(bare).isNotNull(), NUMBER)
            + bit(real & to_date(bare).isNotNull(), DATE)
            + bit(real & word.isin(*TRUE_WORDS, *FALSE_WORDS), BOOLEAN) + bit(real, REAL),
        )
        .drop("__bare", "__word", "__real")
    )
