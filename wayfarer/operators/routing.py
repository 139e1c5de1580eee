"""Journeys as node sequences, counted."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import node_source, short
from ..schema import CHANGE_KIND, ORDER, with_value


#: Cells in which the journeys of one route are looked through side by side.
CELLS = 64
#: Routes and names that one payload shows; it says how many there are.
SHOWN = 500


def paths(events: DataFrame, key: str) -> DataFrame:
    """(value, nodes).  events need ``node``.  Changes are left out; a node that repeats its predecessor is dropped
    before anything is collected, so a long journey in one place costs one entry.

    Events are ordered by days, so that an identifier that holds a large share of all events is spread over its days;
    the days' paths are then put together, and a node that two days share at their border is dropped too.  Journeys of
    changes alone have no nodes.
    """
    day = F.floor(F.unix_seconds("event_time") / F.lit(86400))
    rows = with_value(events, key).select("value", *ORDER, F.when(F.col("kind") != CHANGE_KIND, F.col("node")).alias("step"), day.alias("day"))
    w = Window.partitionBy("value", "day").orderBy(*ORDER, "step")
    rows = rows.withColumn("before", F.last("step", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1)))
    rows = rows.where(F.col("step").isNull() | F.col("before").isNull() | (F.col("before") != F.col("step")))
    days = rows.groupBy("value", "day").agg(F.array_sort(F.collect_list(F.when(F.col("step").isNotNull(), F.struct(*ORDER, "step")))).alias("s"))
    whole = days.groupBy("value").agg(F.array_sort(F.collect_list(F.struct("day", F.col("s.step").alias("part")))).alias("parts"))
    nodes = whole.select("value", F.flatten(F.col("parts.part")).alias("all"))
    return nodes.select("value", F.filter("all", lambda x, i: (i == 0) | (x != F.get("all", i - 1))).alias("nodes"))


def route_table(journey_paths: DataFrame) -> DataFrame:
    """(route, nodes, journeys): ranked by count, then by the nodes themselves.

    Ranks are two-level: routes of one count are ordered among themselves, in cells by their first node, and the sizes of
    the counts and cells, which are few, are summed up before them.  No task orders all routes.
    """
    counted = journey_paths.groupBy("nodes").agg(F.count("*").alias("journeys")).withColumn("first", F.coalesce(F.get("nodes", F.lit(0)), F.lit("")))
    inside = F.row_number().over(Window.partitionBy("journeys", "first").orderBy("nodes"))
    sizes = counted.groupBy("journeys", "first").agg(F.count("*").alias("c"))
    upto = F.sum("c").over(Window.partitionBy(F.lit(0)).orderBy(F.desc("journeys"), "first").rowsBetween(Window.unboundedPreceding, -1))
    starts = sizes.select("journeys", "first", F.coalesce(upto, F.lit(0)).alias("start"))
    ranked = counted.withColumn("k", inside).join(starts, ["journeys", "first"])
    return ranked.select((F.col("start") + F.col("k")).cast("int").alias("route"), "nodes", "journeys")


def journey_routes(journey_paths: DataFrame, routes: DataFrame) -> DataFrame:
    """(value, route).  Paths meet routes by a hash of the nodes; the few usual routes, those of a thousandth of all
    journeys and more, are broadcast, so the journeys of the usual route are not gathered anywhere."""
    all_journeys = routes.agg(F.sum("journeys").alias("n"))
    marked = routes.crossJoin(F.broadcast(all_journeys)).select("nodes", "route", (F.col("journeys") * 1000 >= F.col("n")).alias("usual"))
    usual = F.broadcast(marked.where("usual").select("nodes", F.col("route").alias("often")))
    rest = marked.where("not usual").select("nodes", "route")
    looked = journey_paths.join(usual, "nodes", "left")
    # A salt by value keeps the paths that were answered apart; they look for nothing.
    key = F.when(F.col("often").isNull(), F.col("nodes")).otherwise(F.array(F.lit("\x00"), F.col("value")))
    found = looked.withColumn("wanted", key).join(rest.withColumnRenamed("nodes", "wanted"), "wanted", "left")
    return found.select("value", F.coalesce("often", "route").alias("route")).where("route is not null")


def exemplars(membership: DataFrame, most: int = 3) -> DataFrame:
    """(route, exemplars): the first values of each route, in one pass.

    Values meet their route in cells by hash, each cell passes on its first few, and only those few are put together:
    the usual route, which may hold most journeys, is never ordered in one task.
    """
    cell = F.pmod(F.xxhash64("value"), F.lit(CELLS))
    inside = F.row_number().over(Window.partitionBy("route", "cell").orderBy("value"))
    first = membership.select("route", "value", cell.alias("cell")).withColumn("k", inside).where(F.col("k") <= most)
    return first.groupBy("route").agg(F.slice(F.array_sort(F.collect_list("value")), 1, most).alias("exemplars"))


def ends_at(nodes: Column) -> Column:
    return F.coalesce(F.try_element_at(nodes, F.lit(-1)), F.lit(""))


def route_sources(nodes: Column) -> Column:
    return F.array_distinct(F.transform(nodes, node_source))


def repeats(nodes: Column) -> Column:
    return F.array_sort(F.array_distinct(F.filter(nodes, lambda x: F.size(F.filter(nodes, lambda y: y == x)) > 1)))


def described(routes: DataFrame) -> DataFrame:
    n = F.col("nodes")
    return routes.withColumns({"ends_at": ends_at(n), "sources": route_sources(n), "repeats": repeats(n)})


def dominant(routes: DataFrame) -> DataFrame:
    return routes.where(F.col("route") == 1)


def total(routes: DataFrame) -> DataFrame:
    return routes.agg(F.coalesce(F.sum("journeys"), F.lit(0)).alias("journeys"), F.count("*").alias("routes"))


def common_prefix(routes: DataFrame) -> DataFrame:
    """(pos, node) of the longest opening that all routes share; nothing for fewer than two routes."""
    n = routes.agg(F.count("*").alias("n"))
    at = routes.select(F.posexplode("nodes").alias("pos", "node")).groupBy("pos").agg(F.count("*").alias("c"), F.count_distinct("node").alias("d"), F.min("node").alias("node"))
    agreed = at.crossJoin(F.broadcast(n)).where((F.col("c") == F.col("n")) & (F.col("d") == 1) & (F.col("n") > 1))
    # Positions are gapless from 0 exactly as long as the opening lasts.
    return agreed.withColumn("k", F.row_number().over(Window.orderBy("pos")) - 1).where("k = pos").select("pos", "node")


def rendered(routes: DataFrame, width: int = 96) -> DataFrame:
    """(line_no, line): the shared opening once, then a line per route; long ones lose their middle, never the tail."""
    opening = common_prefix(routes).agg(F.array_sort(F.collect_list(F.struct("pos", "node"))).alias("p")).select(F.col("p.node").alias("opening"))
    rows = routes.crossJoin(F.broadcast(opening)).withColumn("rest", F.transform(F.slice("nodes", F.size("opening") + 1, F.greatest(F.size("nodes") - F.size("opening"), F.lit(0))), short))
    n, arrow = F.size("rest"), " -> "
    whole = F.when(n == 0, "(ends here)").otherwise(F.concat_ws(arrow, "rest"))
    cut = F.concat_ws(arrow, F.try_element_at("rest", F.lit(1)), F.format_string("...%d more...", n - 3), F.try_element_at("rest", F.lit(-2)), F.try_element_at("rest", F.lit(-1)))
    path = F.when((F.length(whole) > width) & (n > 3), cut).otherwise(whole)
    mark = F.when(F.size(repeats(F.col("nodes"))) > 0, " (x2) visits a node twice").otherwise("")
    lines = rows.select((F.col("route") + 1).cast("bigint").alias("line_no"), F.concat(F.format_string("%3d. %4d  ...-> ", "route", "journeys"), path, mark).alias("line"))
    head = opening.where(F.size("opening") > 0).select(F.explode(F.array(F.struct(F.lit(0).cast("bigint").alias("line_no"), F.concat(F.lit("all journeys start: "), F.concat_ws(arrow, F.transform("opening", short))).alias("line")), F.struct(F.lit(1).cast("bigint").alias("line_no"), F.lit("").alias("line")))).alias("x")).select("x.*")
    return head.unionByName(lines)


def payload(routes: DataFrame, membership: DataFrame, limit: int | None = None) -> DataFrame:
    """One JSON object per route."""
    rows = described(routes if limit is None else routes.where(F.col("route") <= limit)).join(exemplars(membership), "route", "left")
    return rows.select("route", F.to_json(F.struct(F.concat(F.lit("route-"), "route").alias("route"), "journeys", "nodes", "ends_at", "sources", "repeats", "exemplars")).alias("json"))


def described_table(routes: DataFrame, membership: DataFrame, vocabulary: dict[str, str], names: DataFrame | None, limit: int = SHOWN) -> dict:
    """The route payload: the most common routes, up to a bound, and what names were made the same."""
    counts = total(routes).head()
    rows = [json.loads(r["json"]) for r in payload(routes, membership, limit).orderBy("route").collect()]
    same = names.where("label <> substituted").select("label").distinct().orderBy("label").limit(limit).collect() if names is not None else []
    return {
        "note": "Distinct paths, the most common first. A path that ends before the others is where journeys were last seen; a node that occurs twice was passed twice.",
        "vocabulary": dict(sorted(vocabulary.items())),
        "collapsed_names": [r["label"] for r in same],
        "total_journeys": counts["journeys"],
        "total_routes": counts["routes"],
        "routes": rows,
    }
