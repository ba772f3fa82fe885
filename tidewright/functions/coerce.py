"""Coercions that every job shares: one notion of missing, numbers and dates out of text, group labels."""

from __future__ import annotations

import re
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MISSING_LABEL = "Missing"

_NUMBER = r"^[+-]?(?:(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?|(?i:inf|infinity))$"
#: What a date may look like, and how it is then read; the first that fits and parses counts.
DATE_FORMATS: list[tuple[str, str]] = [
    (r"\d{4}-\d{1,2}-\d{1,2}", "yyyy-M-d"),
    (r"\d{4}-\d{1,2}-\d{1,2} \d{1,2}:\d{2}", "yyyy-M-d H:mm"),
    (r"\d{4}-\d{1,2}-\d{1,2} \d{1,2}:\d{2}:\d{2}", "yyyy-M-d H:mm:ss"),
    (r"\d{4}-\d{1,2}-\d{1,2} \d{1,2}:\d{2}:\d{2}\.\d{1,9}", "yyyy-M-d H:mm:ss.[SSSSSSSSS][SSSSSSSS][SSSSSSS][SSSSSS][SSSSS][SSSS][SSS][SS][S]"),
    (r"\d{4}-\d{1,2}-\d{1,2}T\d{1,2}:\d{2}", "yyyy-M-d'T'H:mm"),
    (r"\d{4}-\d{1,2}-\d{1,2}T\d{1,2}:\d{2}:\d{2}", "yyyy-M-d'T'H:mm:ss"),
    (r"\d{4}-\d{1,2}-\d{1,2}T\d{1,2}:\d{2}:\d{2}(?:Z|[+-]\d{2}:\d{2})", "yyyy-M-d'T'H:mm:ssXXX"),
    (r"\d{4}/\d{1,2}/\d{1,2}", "yyyy/M/d"),
    (r"\d{1,2}/\d{1,2}/\d{4}", "M/d/yyyy"),
    (r"\d{1,2}/\d{1,2}/\d{4}", "d/M/yyyy"),
    (r"\d{1,2}/\d{1,2}/\d{4} \d{1,2}:\d{2}", "M/d/yyyy H:mm"),
    (r"\d{1,2}/\d{1,2}/\d{4} \d{1,2}:\d{2}:\d{2}", "M/d/yyyy H:mm:ss"),
    (r"\d{1,2}-\d{1,2}-\d{4}", "M-d-yyyy"),
    (r"\d{1,2}-\d{1,2}-\d{4}", "d-M-yyyy"),
    (r"[A-Z][a-z]{2} \d{1,2} \d{4}", "MMM d yyyy"),
    (r"[A-Z][a-z]{2} \d{1,2}, \d{4}", "MMM d, yyyy"),
    (r"\d{1,2} [A-Z][a-z]{2} \d{4}", "d MMM yyyy"),
    (r"[A-Z][a-z]{3,8} \d{1,2},? \d{4}", "MMMM d[,] yyyy"),
    (r"\d{8}", "yyyyMMdd"),
    (r"\d{4}-\d{2}", "yyyy-MM"),
    (r"\d{4}", "yyyy"),
]


#: A capital and small letters, as names of months are written.
_NAME = "[A-Z][a-z]{2,8}"
_PART = re.compile(r"\\d\{(\d)(?:,(\d))?\}|(\[A-Z\]\[a-z\]\{[\d,]+\})|(\(\?:Z\|\[\+-\]\\d\{2\}:\\d\{2\}\))|(,\?)|\\?(.)")


def signatures(shape: str) -> list[str]:
    """What a date of a shape comes to when every digit is a 9 and every name an M."""
    choices = []
    for low, high, name, zone, comma, letter in _PART.findall(shape):
        if low:
            choices.append(["9" * n for n in range(int(low), int(high or low) + 1)])
        else:
            choices.append(["M"] if name else ["Z", "+99:99", "-99:99"] if zone else ["", ","] if comma else [letter])
    return ["".join(c) for c in product(*choices)]


def _readings() -> list[tuple[list[str], list[str]]]:
    """(signatures, formats): the signatures that are read in the same ways."""
    ways: dict[str, list[str]] = {}
    for shape, how in DATE_FORMATS:
        for signature in signatures(shape):
            ways.setdefault(signature, []).append(how)
    groups: dict[tuple, list[str]] = {}
    for signature, formats in ways.items():
        groups.setdefault(tuple(formats), []).append(signature)
    return [(found, list(formats)) for formats, found in groups.items()]


READINGS = _readings()


def col(name: str) -> Column:
    """The column of that very name, spaces and dots and all."""
    return F.col("`" + name.replace("`", "``") + "`")


def is_float(t: T.DataType) -> bool:
    return isinstance(t, (T.DoubleType, T.FloatType))


def is_number(t: T.DataType) -> bool:
    """Numbers, and booleans, which count as numbers."""
    return isinstance(t, (T.NumericType, T.BooleanType))


def is_date(t: T.DataType) -> bool:
    return isinstance(t, (T.TimestampType, T.TimestampNTZType, T.DateType))


def nan_to_null(df: DataFrame) -> DataFrame:
    """NaN becomes null in every float column: one notion of missing."""
    floats = {f.name for f in df.schema if is_float(f.dataType)}
    return df.select([F.when(~F.isnan(col(c)), col(c)).alias(c) if c in floats else col(c) for c in df.columns])


def number(c: Column, t: T.DataType) -> Column:
    """c as double; what does not parse is null."""
    if is_float(t):
        return F.when(~F.isnan(c), c.cast("double"))
    if is_number(t):
        return c.cast("double")
    if isinstance(t, T.StringType):
        return number_of(without_space(c))
    return F.lit(None).cast("double")


def without_space(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def number_of(text: Column) -> Column:
    """The number that a text without white space around it says; null if none."""
    return F.when(text.rlike(_NUMBER), text.try_cast("double"))


def timestamp_of(text: Column) -> Column:
    """The time that a text without white space around it says: its signature names the ways in which it is read. Null if none fits."""
    signature = F.regexp_replace(F.translate(text, "0123456789", "9" * 10), _NAME, "M")
    out = None
    for found, formats in READINGS:
        ways = [F.try_to_timestamp(text, F.lit(how)) for how in formats]
        value = F.coalesce(*ways) if len(ways) > 1 else ways[0]
        out = F.when(signature.isin(found), value) if out is None else out.when(signature.isin(found), value)
    return out


def timestamp(c: Column, t: T.DataType) -> Column:
    """c as timestamp; what does not parse, times without a date among it, is null."""
    if is_date(t):
        return c.cast("timestamp")
    if isinstance(t, T.StringType):
        return timestamp_of(without_space(c))
    return F.lit(None).cast("timestamp")


def num(df: DataFrame, name: str) -> Column:
    return number(col(name), df.schema[name].dataType)


def dt(df: DataFrame, name: str) -> Column:
    return timestamp(col(name), df.schema[name].dataType)


def text_of(c: Column, t: T.DataType) -> Column:
    return c if isinstance(t, T.StringType) else c.cast("string")


def label(c: Column) -> Column:
    """The group label of a key: its text, or "Missing"."""
    return F.coalesce(c.cast("string"), F.lit(MISSING_LABEL))
