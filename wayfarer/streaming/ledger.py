"""Beyond the batch views: accepted messages against settled ones, as streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def settlement(accepted: DataFrame, settled: DataFrame, key: str = "key", within: str = "1 hour", lateness: str = "10 minutes") -> DataFrame:
    """accepted, settled: streams (or tables) of (key, event_time).  One row per accepted message with settled_time,
    null where none came in time.  Watermarks bound the state on both sides."""
    a = accepted.select(F.col(key).alias("a_key"), F.col("event_time").alias("accepted_time")).withWatermark("accepted_time", lateness)
    s = settled.select(F.col(key).alias("s_key"), F.col("event_time").alias("settled_time")).withWatermark("settled_time", lateness)
    near = F.expr(f"a_key = s_key AND settled_time >= accepted_time AND settled_time <= accepted_time + interval {within}")
    return a.join(s, near, "leftOuter").select(F.col("a_key").alias("key"), "accepted_time", "settled_time")


def volume(events: DataFrame, every: str = "5 minutes", lateness: str = "10 minutes") -> DataFrame:
    """Records by source in tumbling windows."""
    w = F.window("event_time", every)
    return events.withWatermark("event_time", lateness).groupBy(w, "source").agg(F.count("*").alias("records")).select(F.col("window.start").alias("window_start"), "source", "records")
