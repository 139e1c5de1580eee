"""Where time goes, without a verdict."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import duration_ms, format_time, rank_index, rounded
from .grouping import journeys

# When percentiles mean something, and when a spread is worth showing.
MIN_SAMPLES = 8
WIDE = 3.0


def distributions(samples: DataFrame, by: str = "label") -> DataFrame:
    """samples: (label, ms).  Exact ranks from the histogram of values: nothing is collected per label, and a hot
    label's equal values are merged before they move.

    Ranks are two-level: values fall into buckets of about one per cent, whose counts are summed up in order, and only
    the values of one bucket are ordered together, so a label that holds all samples is spread over its buckets.
    """
    hist = samples.where("ms is not null").groupBy(by, "ms").agg(F.count("*").alias("c"))
    size = F.floor(F.log2(F.abs("ms") + 1) * 64)
    hist = hist.withColumn("bucket", F.when(F.col("ms") < 0, -size).otherwise(size))
    w = Window.partitionBy(by)
    sums = hist.groupBy(by, "bucket").agg(F.sum("c").alias("bc"))
    sums = sums.select(by, "bucket", F.sum("bc").over(w).alias("n"), (F.sum("bc").over(w.orderBy("bucket")) - F.col("bc")).alias("before"))
    hist = hist.withColumn("inside", F.sum("c").over(Window.partitionBy(by, "bucket").orderBy("ms"))).join(sums, [by, "bucket"])
    hist = hist.withColumn("upto", F.col("before") + F.col("inside"))
    at = lambda q: F.min(F.when(F.col("upto") >= rank_index(q, F.col("n")), F.col("ms")))
    out = hist.groupBy(by).agg(F.max("n").alias("count"), F.sum(F.col("ms") * F.col("c")).alias("total_ms"), at(0.5).alias("p50"), at(0.95).alias("p95"), F.max("ms").alias("max_ms"))
    return out.withColumn("reliable", F.col("count") >= MIN_SAMPLES).withColumn("spread", F.when(F.col("p50") != 0, F.col("max_ms") / F.col("p50")).otherwise(0.0))


def node_durations(events: DataFrame) -> DataFrame:
    """By node, over all events, also those that join to nothing."""
    return distributions(events.select(F.col("node").alias("label"), duration_ms().alias("ms")))


def end_to_end(events: DataFrame, key: str) -> DataFrame:
    rows = journeys(events, key).where("records > 1")
    return distributions(rows.select(F.lit("end to end").alias("label"), F.col("duration_ms").alias("ms")))


def described(found: DataFrame, samples: DataFrame) -> DataFrame:
    """With ``description``: percentiles only where there are enough samples, else the samples themselves (few)."""
    few = samples.where("ms is not null").join(found.where(~F.col("reliable")).select("label"), "label", "left_semi")
    few = few.groupBy("label").agg(F.array_sort(F.collect_list("ms")).alias("raw"))
    some = F.concat(F.format_string("%d samples: ", "count"), F.concat_ws(", ", F.transform("raw", rounded)), F.lit(" ms (too few for percentiles)"))
    many = F.concat(F.format_string("n=%d, p50 ", "count"), rounded(F.col("p50")), F.lit("ms, p95 "), rounded(F.col("p95")), F.lit("ms, max "), rounded(F.col("max_ms")), F.lit("ms"))
    return found.join(few, "label", "left").withColumn("description", F.when(F.col("reliable"), many).otherwise(some)).drop("raw")


def busiest(found: DataFrame, limit: int = 8) -> DataFrame:
    return found.orderBy(F.desc("total_ms"), "label").limit(limit)


def widest_spread(found: DataFrame, limit: int = 5) -> DataFrame:
    return found.where(F.col("reliable") & (F.col("spread") >= WIDE)).orderBy(F.desc("spread"), "label").limit(limit)


def longest(events: DataFrame, key: str, limit: int = 5) -> DataFrame:
    return journeys(events, key).where("records > 1").select("value", "duration_ms").orderBy(F.desc("duration_ms"), "value").limit(limit)


def tenths(ms: Column) -> Column:
    return F.bround(ms, 1).cast("decimal(18,1)")


def _shown(found: DataFrame, samples: DataFrame, section: str, *order: Column) -> DataFrame:
    """found (a handful) as JSON; percentiles only where there are samples enough."""
    only = lambda c: F.when(F.col("reliable"), tenths(F.col(c)))
    whole = F.to_json(F.struct("label", "count", "description", only("p50").alias("p50_ms"), only("p95").alias("p95_ms"), only("max_ms").alias("max_ms"), only("spread").alias("spread")))
    pos = F.row_number().over(Window.partitionBy(F.lit(section)).orderBy(*order))
    return described(found, samples).select(F.lit(section).alias("section"), pos.alias("pos"), whole.alias("json"))


def payload(events: DataFrame, key: str | None) -> DataFrame:
    """(section, pos, json): window, end_to_end, busiest_nodes, widest_spread, longest_journeys.  No threshold judges."""
    nodes = events.select(F.col("node").alias("label"), duration_ms().alias("ms"))
    each = distributions(nodes)
    bounds = events.agg(F.min("event_time").alias("a"), F.max("event_time").alias("b")).where("a is not null")
    out = bounds.select(F.lit("window").alias("section"), F.lit(1).alias("pos"), F.to_json(F.array(format_time(F.col("a")), format_time(F.col("b")))).alias("json"))
    out = out.unionByName(_shown(busiest(each), nodes, "busiest_nodes", F.desc("total_ms"), F.col("label")))
    out = out.unionByName(_shown(widest_spread(each), nodes, "widest_spread", F.desc("spread"), F.col("label")))
    if key is None:
        return out
    spans = journeys(events, key).where("records > 1").select(F.lit("end to end").alias("label"), F.col("duration_ms").alias("ms"))
    slow = longest(events, key)
    pos = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("duration_ms"), "value"))
    slow = slow.select(F.lit("longest_journeys").alias("section"), pos.alias("pos"), F.to_json(F.struct(F.col("value").alias("journey"), tenths(F.col("duration_ms")).alias("duration_ms"))).alias("json"))
    return out.unionByName(_shown(distributions(spans), spans, "end_to_end", F.col("label"))).unionByName(slow)


def table(events: DataFrame, key: str | None) -> dict:
    """The payload on the driver: at most twenty rows."""
    found: dict = {"window": None, "end_to_end": None, "busiest_nodes": [], "widest_spread": [], "longest_journeys": []}
    for row in payload(events, key).orderBy("section", "pos").collect():
        if isinstance(found[row["section"]], list):
            found[row["section"]].append(json.loads(row["json"]))
        else:
            found[row["section"]] = json.loads(row["json"])
    return found | {"note": "Descriptive only: nothing here is called slow, which would take a target that nobody has given."}
