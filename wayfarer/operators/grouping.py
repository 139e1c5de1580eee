"""Which identifier joins records into journeys, and the journeys that it makes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import millis_between
from ..schema import PER_RECORD_IDS, with_value


def distinct_values(events: DataFrame, column: str) -> DataFrame:
    return events.select(column).distinct()


def window_bounds(events: DataFrame) -> DataFrame:
    return events.agg(F.min("event_time").alias("first_time"), F.max("event_time").alias("last_time"), F.count("*").alias("records"))


def id_keys(events: DataFrame) -> DataFrame:
    return events.select(F.explode(F.map_keys("ids")).alias("key")).distinct()


def of_kind(events: DataFrame, kind: str) -> DataFrame:
    return events.where(F.col("kind") == kind)


def candidates(events: DataFrame) -> DataFrame:
    """A row per identifier: coverage, groups, mean sources of a group, upper median size, and why it cannot join.

    Groups are sized with map-side partial counts; the median comes from the histogram of sizes, so no key's groups
    are ever collected.
    """
    total = events.agg(F.count("*").alias("total"))
    long = events.select("source", F.explode("ids").alias("key", "value"))
    # Sources of a group are few: distinct first, then counted, keeps a hot value spread over its sources.
    per = long.groupBy("key", "value", "source").agg(F.count("*").alias("c"))
    groups = per.groupBy("key", "value").agg(F.sum("c").alias("size"), F.count("*").alias("n_sources"))
    hist = groups.groupBy("key", "size").agg(F.count("*").alias("c"), F.sum("n_sources").alias("sources"), F.max("n_sources").alias("most"))
    n = F.sum("c").over(Window.partitionBy("key"))
    below = F.sum("c").over(Window.partitionBy("key").orderBy("size"))
    hist = hist.withColumn("groups", n).withColumn("median", F.when(below > F.floor(n / 2), F.col("size")))
    keys = hist.groupBy("key").agg(
        F.sum(F.col("size") * F.col("c")).alias("carrying"),
        F.max("groups").alias("groups"),
        (F.sum("sources") / F.sum("c")).alias("sources_per_group"),
        F.min("median").alias("median_group_size"),
        F.max("most").alias("most"),
    )
    reason = (
        F.when(F.col("key").isin(*PER_RECORD_IDS), "identifies a single record")
        .when(F.col("median_group_size") <= 1, "most groups hold one record")
        .when(F.col("most") <= 1, "never leaves one source")
        .otherwise("")
    )
    return keys.crossJoin(F.broadcast(total)).select("key", (F.col("carrying") / F.col("total")).alias("coverage"), "groups", "sources_per_group", "median_group_size", reason.alias("disqualified"))


def ranked_candidates(found: DataFrame) -> DataFrame:
    return found.orderBy(F.col("disqualified") != "", F.desc("coverage"), "key")


def default_key(found: DataFrame) -> DataFrame:
    """At most one row: the usable key of largest coverage, ties in alphabetical order."""
    return found.where(F.col("disqualified") == "").orderBy(F.desc("coverage"), "key").limit(1).select("key")


def choose_key(events: DataFrame, key: str | None = None) -> str | None:
    if key:
        return key
    row = default_key(candidates(events)).head()
    return row["key"] if row else None


def unjoined(events: DataFrame, key: str | None) -> DataFrame:
    return events if key is None else events.where(F.col("ids")[key].isNull())


def unjoined_share(events: DataFrame, key: str | None) -> DataFrame:
    lost = F.count_if(F.lit(True) if key is None else F.col("ids")[key].isNull())
    return events.agg(lost.alias("unjoined"), F.count("*").alias("records")).withColumn("share", F.when(F.col("records") > 0, F.col("unjoined") / F.col("records")).otherwise(0.0))


def journeys(events: DataFrame, key: str) -> DataFrame:
    """(value, start_time, end_time, records, duration_ms, sources in order of first appearance)."""
    rows = with_value(events, key)
    # First appearance per source before collecting: what is collected is bounded by the number of sources.
    firsts = rows.groupBy("value", "source").agg(F.min(F.struct("event_time", "file_name", "ordinal")).alias("at"), F.max("event_time").alias("end"), F.count("*").alias("c"))
    out = firsts.groupBy("value").agg(
        F.min("at.event_time").alias("start_time"), F.max("end").alias("end_time"), F.sum("c").alias("records"), F.array_sort(F.collect_list(F.struct("at", "source"))).alias("s")
    )
    return out.select("value", "start_time", "end_time", "records", millis_between(F.col("start_time"), F.col("end_time")).alias("duration_ms"), F.col("s.source").alias("sources"))


def other_ids(events: DataFrame, key: str, other: str) -> DataFrame:
    """(value, other): the distinct values of another identifier within each journey."""
    return with_value(events, key).select("value", F.col("ids")[other].alias("other")).where("other is not null").distinct()


def values_of(events: DataFrame, key: str, attribute: str) -> DataFrame:
    return with_value(events, key).select("value", F.col("attributes")[attribute]["s"].alias("attribute_value")).where("attribute_value is not null").distinct()


def carries(name: str, wanted: str) -> Column:
    return F.coalesce(F.col("attributes")[name]["s"] == wanted, F.lit(False)) | F.coalesce(F.col("ids")[name] == wanted, F.lit(False))


def journeys_where(events: DataFrame, key: str, where: list[tuple[str, str]]) -> DataFrame:
    """Values of journeys in which each pair is met by some event, not necessarily the same one.  One pass."""
    rows = with_value(events, key)
    flags = [F.bool_or(carries(k, v)).alias(f"p{i}") for i, (k, v) in enumerate(where)]
    if not flags:
        return rows.select("value").distinct()
    out = rows.groupBy("value").agg(*flags)
    for i in range(len(where)):
        out = out.where(F.col(f"p{i}"))
    return out.select("value")
