"""Scalar rules as native expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import DURATION_KEYS, HIDDEN_ATTRIBUTES

# What varies inside a name, in order of replacement.
EMAIL = r"[\w.+-]+@[\w-]+\.[\w.-]+"
HEX = r"(?i)\b[0-9a-f]{8,}\b"
DIGITS = r"(?<![A-Za-z])\d+"
# Words that tell nothing about a complaint.
STOPWORDS = (
    "the a an and or but of to in on for it is are was were we our us they their i my "
    "that this these those some any all not no never ever got get see saw seems looks "
    "like only just back from with at as by up out about said someone really probably "
    "confirmed think one two none went"
).split()

ISO = r"^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}.*)?$"


def unicode_classes(pattern: str) -> str:
    """The pattern for Java with word characters, digits and word ends of all scripts, which Java limits to ASCII."""
    inside = {r"[\w]": r"[\p{L}\p{N}_]", r"[\w": r"[\p{L}\p{N}_", r"\d": r"\p{Nd}"}
    for old, new in inside.items():
        pattern = pattern.replace(old, new)
    before, after = pattern.find(r"\b"), pattern.rfind(r"\b")
    if before >= 0:
        pattern = pattern[:before] + r"(?<![\p{L}\p{N}_])" + pattern[before + 2 : after] + r"(?![\p{L}\p{N}_])" + pattern[after + 2 :]
    return pattern


def parse_time(text: Column) -> Column:
    """ISO dates and date-times; anything else is null.  Zone-less times are UTC (the session's zone)."""
    return F.when(text.rlike(ISO), F.try_to_timestamp(text))


def format_time(moment: Column) -> Column:
    """UTC, milliseconds (cut, not rounded), Z."""
    return F.date_format(moment, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def clock(moment: Column) -> Column:
    return F.date_format(moment, "HH:mm:ss.SSS")


def collapse(text: Column) -> Column:
    for pattern, to in ((EMAIL, "{addr}"), (HEX, "{hex}"), (DIGITS, "{n}")):
        text = F.regexp_replace(text, unicode_classes(pattern), to)
    return text


def substitute(name: Column, vocabulary: Column) -> Column:
    """vocabulary: array<struct<value, placeholder>> in order of application; each replacement sees the last's result."""
    return F.aggregate(vocabulary, name, lambda text, v: F.replace(text, v["value"], v["placeholder"]))


def short(node: Column) -> Column:
    return F.regexp_replace(node, "^[^:]*:", "")


def node_source(node: Column) -> Column:
    return F.split_part(node, F.lit(":"), F.lit(1))


def tokens(text: Column) -> Column:
    """Words of three letters and more, without the telling-nothing ones."""
    found = F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit("([a-z]{3,})"), 1))
    return F.array_except(found, F.array(*map(F.lit, STOPWORDS)))


def duration_ms(attributes: Column = None) -> Column:
    """The first of the known duration attributes that is a number (true and false count)."""
    attributes = F.col("attributes") if attributes is None else attributes
    return F.coalesce(*[attributes[k]["n"] for k in DURATION_KEYS])


def millis_between(start: Column, end: Column) -> Column:
    return (F.unix_micros(end) - F.unix_micros(start)) / F.lit(1000.0)


def rank_index(q: float, n: Column) -> Column:
    """1-based rank of a percentile: half-even rounding of q n + 1/2, held inside 1..n."""
    return F.least(n, F.greatest(F.lit(1.0), F.rint(F.lit(q) * n + F.lit(0.5)))).cast("bigint")


def rounded(number: Column) -> Column:
    """Whole number text, ties to even."""
    return F.format_string("%.0f", F.rint(number))


def detail(attributes: Column, skip: Column | None = None, most: int = 6) -> Column:
    """Sorted ``k=v`` of the first attributes that are not shown elsewhere."""
    hidden = F.array(*map(F.lit, HIDDEN_ATTRIBUTES))
    if skip is not None:
        hidden = F.concat(hidden, F.coalesce(skip, F.array().cast("array<string>")))
    rest = F.map_filter(attributes, lambda k, v: ~F.array_contains(hidden, k))
    pairs = F.transform(F.array_sort(F.map_keys(rest)), lambda k: F.concat(k, F.lit("="), attributes[k]["s"]))
    return F.concat_ws(" ", F.slice(pairs, 1, most))
