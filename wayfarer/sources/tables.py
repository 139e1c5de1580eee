"""The supplied Parquet tables as events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import attribute_map, id_map, typed

COLUMNS = ["event_time", "source", "name", "kind", "ids", "attributes", "file_name", "ordinal"]


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fulfilment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders and their lines, joined by order_id."""
    o = read(spark, sf_dir, "orders").select(
        F.col("o_orderdate").cast("timestamp").alias("event_time"),
        F.lit("orders").alias("source"),
        F.lit("placed").alias("name"),
        F.lit("order").alias("kind"),
        id_map(order_id=F.col("o_orderkey"), customer_key=F.col("o_custkey")).alias("ids"),
        attribute_map(status=typed("str", F.col("o_orderstatus")), priority=typed("str", F.col("o_orderpriority")), total=typed("float", F.col("o_totalprice"))).alias("attributes"),
        F.lit("orders").alias("file_name"),
        F.lit(0).cast("bigint").alias("ordinal"),
    )
    li = read(spark, sf_dir, "lineitem").select(
        F.col("l_shipdate").cast("timestamp").alias("event_time"),
        F.lit("lineitem").alias("source"),
        F.concat(F.lit("ship "), F.col("l_linestatus")).alias("name"),
        F.lit("lineitem").alias("kind"),
        id_map(order_id=F.col("l_orderkey"), supplier_key=F.col("l_suppkey")).alias("ids"),
        attribute_map(status=typed("str", F.col("l_linestatus")), returned=typed("str", F.col("l_returnflag")), duration_ms=typed("float", F.col("l_quantity"))).alias("attributes"),
        F.lit("lineitem").alias("file_name"),
        F.col("l_linenumber").cast("bigint").alias("ordinal"),
    )
    return o.select(COLUMNS).unionByName(li.select(COLUMNS))


def activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table; a journey is one user's day."""
    ts = F.col("ts").cast("timestamp")
    return read(spark, sf_dir, "events").select(
        ts.alias("event_time"),
        F.col("event_type").alias("source"),
        F.col("event_type").alias("name"),
        F.lit("event").alias("kind"),
        id_map(day_key=F.concat_ws("/", F.col("user_id").cast("string"), F.date_format(ts, "yyyy-MM-dd")), user_key=F.col("user_id"), k_id=F.get_json_object("props", "$.k"), event_id=F.col("event_id")).alias("ids"),
        attribute_map(k=typed("int", F.get_json_object("props", "$.k").cast("bigint")), duration_ms=typed("float", F.col("value")), type=typed("str", F.col("event_type"))).alias("attributes"),
        F.lit("events").alias("file_name"),
        F.col("event_id").cast("bigint").alias("ordinal"),
    )


def dialogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations; the turn is the time."""
    return read(spark, sf_dir, "conversations").select(
        F.timestamp_seconds(F.col("turn")).alias("event_time"),
        F.col("role").alias("source"),
        F.lit("turn").alias("name"),
        F.lit("conversation").alias("kind"),
        id_map(conv_id=F.col("conv_id")).alias("ids"),
        attribute_map(n_chars=typed("int", F.length("text"))).alias("attributes"),
        F.lit("conversations").alias("file_name"),
        F.col("turn").cast("bigint").alias("ordinal"),
    )


def with_changes(events: DataFrame, attribute: str = "k", value: str = "7") -> DataFrame:
    """Events whose attribute has the value, re-labelled as deploys: the tables hold no changes of their own."""
    return events.withColumn("kind", F.when(F.col("attributes")[attribute]["s"] == value, "deploy").otherwise(F.col("kind")))
