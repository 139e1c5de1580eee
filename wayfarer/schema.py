"""The one shape that every record takes, and small column helpers around it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: t is str, int, float, bool or json; s is the value as text; n is its number, where it has one.
VALUE = "struct<t:string,s:string,n:double>"
EVENT = f"event_time timestamp, source string, name string, kind string, ids map<string,string>, attributes map<string,{VALUE}>, file_name string, ordinal bigint"

#: Time first, then the file a record came from and its place there.  The node settles rows that agree in all three.
ORDER = ("event_time", "file_name", "ordinal")

# Fixed values of the data model.
CHANGE_KIND = "deploy"
PER_RECORD_IDS = ("span_id", "parent_span_id", "event_id", "record_id")
DURATION_KEYS = ("duration_ms", "duration", "elapsed_ms", "latency_ms")
HIDDEN_ATTRIBUTES = ("kind", "duration_ms", "duration", "elapsed_ms", "latency_ms")


def typed(t: str, column: Column) -> Column:
    """A plain column as an attribute value."""
    text = F.when(column, "True").otherwise("False") if t == "bool" else column.cast("string")
    number = F.lit(None).cast("double") if t in ("str", "json") else column.cast("double")
    return F.when(column.isNotNull(), F.struct(F.lit(t).alias("t"), text.alias("s"), number.alias("n")))


def _held(columns: dict[str, Column], kind: str) -> Column:
    """A map of the columns that are not null, without lambdas, which would leave the generated code."""
    none = F.create_map().cast(f"map<string,{kind}>")
    return F.map_concat(none, *[F.when(v.isNotNull(), F.create_map(F.lit(k), v)).otherwise(none) for k, v in columns.items()])


def attribute_map(**columns: Column) -> Column:
    return _held(columns, VALUE)


def id_map(**columns: Column) -> Column:
    return _held({k: v.cast("string") for k, v in columns.items()}, "string")


def raw_node(source: str = "source", name: str = "name") -> Column:
    return F.concat_ws(":", F.col(source), F.col(name))


def with_value(events: DataFrame, key: str) -> DataFrame:
    """Events that carry the identifier, with it as ``value``."""
    return events.withColumn("value", F.col("ids")[key]).where(F.col("value").isNotNull())


def in_order(*partition: str):
    return Window.partitionBy(*partition).orderBy(*ORDER, "source", "name")
