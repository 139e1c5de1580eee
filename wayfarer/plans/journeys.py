"""One query per operator (or small family) over the supplied tables; DuckDB SQL for each beside it."""

from __future__ import annotations

from collections.abc import Callable
from datetime import UTC, datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars
from ..operators import cost, grouping, naming, quality, routing, slices, timing, triage
from ..schema import raw_node
from ..sources import tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def registered(sql: str | None = None):
    def take(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLE_SQL[fn.__name__] = sql
        return fn

    return take


FULFILMENT = """
    SELECT CAST(o_orderkey AS VARCHAR) AS value, o_orderdate AS event_time, 'orders' AS file_name, 0::BIGINT AS ordinal, 'orders' AS source, 'placed' AS name, 'orders:placed' AS node,
           CAST(NULL AS DOUBLE) AS ms, o_orderstatus AS status, CAST(NULL AS VARCHAR) AS returned, o_orderpriority AS priority, CAST(o_custkey AS VARCHAR) AS customer_key, CAST(NULL AS VARCHAR) AS supplier_key FROM orders
    UNION ALL
    SELECT CAST(l_orderkey AS VARCHAR), l_shipdate, 'lineitem', l_linenumber, 'lineitem', 'ship ' || l_linestatus, 'lineitem:ship ' || l_linestatus,
           l_quantity, l_linestatus, l_returnflag, NULL, NULL, CAST(l_suppkey AS VARCHAR) FROM lineitem"""
ACTIVITY = """
    SELECT user_id || '/' || strftime(ts, '%Y-%m-%d') AS value, ts AS event_time, 'events' AS file_name, event_id AS ordinal, event_type AS source, event_type AS name, event_type || ':' || event_type AS node,
           value AS ms, json_extract_string(props, '$.k') AS k, CAST(user_id AS VARCHAR) AS user_key, CAST(event_id AS VARCHAR) AS event_key FROM events"""
DIALOGUE = """
    SELECT CAST(conv_id AS VARCHAR) AS value, make_timestamp(turn * 1000000) AS event_time, 'conversations' AS file_name, turn AS ordinal, role AS source, 'turn' AS name, role || ':turn' AS node FROM conversations"""
PATHS = """
    steps AS (SELECT *, lag(node) OVER (PARTITION BY value ORDER BY event_time, file_name, ordinal, node) AS before FROM ev),
    paths AS (SELECT value, list(node ORDER BY event_time, file_name, ordinal, node) AS nodes FROM steps WHERE before IS NULL OR before <> node GROUP BY value),
    counted AS (SELECT nodes, count(*) AS journeys FROM paths GROUP BY nodes),
    routes AS (SELECT CAST(row_number() OVER (ORDER BY journeys DESC, nodes) AS INTEGER) AS route, nodes, journeys FROM counted),
    membership AS (SELECT p.value, r.route FROM paths p JOIN routes r ON p.nodes = r.nodes)"""
SPANS = "spans AS (SELECT value, min(event_time) AS start_time, max(event_time) AS end_time, count(*) AS records FROM ev WHERE value IS NOT NULL GROUP BY value)"
MS = "(epoch_us({b}) - epoch_us({a})) / 1000.0"


def fulfilment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.fulfilment(spark, sf_dir).withColumn("node", raw_node())


def activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.activity(spark, sf_dir).withColumn("node", raw_node())


def dialogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.dialogue(spark, sf_dir).withColumn("node", raw_node())


KEYS = {"fulfilment": "order_id", "activity": "day_key", "dialogue": "conv_id"}


def joined(column: str = "nodes"):
    return F.concat_ws(" > ", column)


def routes_of(events: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    p = routing.paths(events, key)
    r = routing.route_table(p)
    return r, routing.journey_routes(p, r)


def ctes(ev: str, *more: str) -> str:
    return "WITH ev AS (" + ev + "), " + ", ".join(more) + " " if more else "WITH ev AS (" + ev + ") "


# --- routes -------------------------------------------------------------------------------------------------

TABLE = "SELECT route, array_to_string(nodes, ' > ') AS nodes, journeys FROM routes"


@registered(ctes(FULFILMENT, PATHS) + TABLE)
def route_table_fulfilment(spark, sf_dir):
    r, _ = routes_of(fulfilment(spark, sf_dir), "order_id")
    return r.select("route", joined().alias("nodes"), "journeys")


@registered(ctes(ACTIVITY, PATHS) + TABLE)
def route_table_activity(spark, sf_dir):
    r, _ = routes_of(activity(spark, sf_dir), "day_key")
    return r.select("route", joined().alias("nodes"), "journeys")


@registered(ctes(DIALOGUE, PATHS) + TABLE)
def route_table_dialogue(spark, sf_dir):
    r, _ = routes_of(dialogue(spark, sf_dir), "conv_id")
    return r.select("route", joined().alias("nodes"), "journeys")


@registered(ctes(ACTIVITY, PATHS) + "SELECT value, array_to_string(nodes, ' > ') AS nodes FROM paths")
def journey_paths(spark, sf_dir):
    return routing.paths(activity(spark, sf_dir), "day_key").select("value", joined().alias("nodes"))


@registered(ctes(FULFILMENT, PATHS) + "SELECT value, route FROM membership")
def journey_route_lookup(spark, sf_dir):
    return routes_of(fulfilment(spark, sf_dir), "order_id")[1]


@registered(
    ctes(FULFILMENT, PATHS)
    + "SELECT route, journeys, nodes[-1] AS ends_at, CASE WHEN nodes[1] LIKE 'orders:%' AND list_contains([split_part(x, ':', 1) FOR x IN nodes], 'lineitem') THEN 'orders,lineitem' "
    "WHEN list_contains([split_part(x, ':', 1) FOR x IN nodes], 'orders') AND nodes[1] LIKE 'lineitem:%' THEN 'lineitem,orders' ELSE split_part(nodes[1], ':', 1) END AS sources FROM routes"
)
def route_ends_sources(spark, sf_dir):
    r, _ = routes_of(fulfilment(spark, sf_dir), "order_id")
    return routing.described(r).select("route", "journeys", "ends_at", F.concat_ws(",", "sources").alias("sources"))


@registered(
    ctes(FULFILMENT, PATHS)
    + ", x AS (SELECT route, unnest(nodes) AS node FROM routes), d AS (SELECT route, node FROM x GROUP BY 1, 2 HAVING count(*) > 1) SELECT route, string_agg(node, ',' ORDER BY node) AS repeats FROM d GROUP BY route"
)
def route_repeats(spark, sf_dir):
    r, _ = routes_of(fulfilment(spark, sf_dir), "order_id")
    return routing.described(r).where(F.size("repeats") > 0).select("route", F.concat_ws(",", "repeats").alias("repeats"))


@registered(ctes(FULFILMENT, PATHS) + ", k AS (SELECT route, value, row_number() OVER (PARTITION BY route ORDER BY value) AS k FROM membership) SELECT route, string_agg(value, ',' ORDER BY value) AS exemplars FROM k WHERE k <= 3 GROUP BY route")
def route_exemplars(spark, sf_dir):
    _, m = routes_of(fulfilment(spark, sf_dir), "order_id")
    return routing.exemplars(m).select("route", F.concat_ws(",", "exemplars").alias("exemplars"))


@registered(ctes(FULFILMENT, PATHS) + "SELECT CAST(sum(journeys) AS BIGINT) AS journeys, count(*) AS routes, max(journeys) FILTER (route = 1) AS dominant FROM routes")
def route_totals(spark, sf_dir):
    r, _ = routes_of(fulfilment(spark, sf_dir), "order_id")
    return routing.total(r).crossJoin(F.broadcast(routing.dominant(r).select(F.col("journeys").alias("dominant"))))


@registered(
    ctes(DIALOGUE, PATHS)
    + ", usual AS (SELECT * FROM routes WHERE nodes[1] = (SELECT nodes[1] FROM routes WHERE route = 1)), x AS (SELECT route, unnest(nodes) AS node, generate_subscripts(nodes, 1) - 1 AS pos FROM usual), "
    "a AS (SELECT pos, min(node) AS node FROM x GROUP BY pos HAVING count(*) = (SELECT count(*) FROM usual) AND count(DISTINCT node) = 1 AND count(*) > 1), "
    "k AS (SELECT pos, node, row_number() OVER (ORDER BY pos) - 1 AS k FROM a) SELECT CAST(pos AS INTEGER) AS pos, node FROM k WHERE pos = k"
)
def route_common_prefix(spark, sf_dir):
    r, _ = routes_of(dialogue(spark, sf_dir), "conv_id")
    first = routing.dominant(r).select(F.try_element_at("nodes", F.lit(1)).alias("first"))
    usual = r.join(F.broadcast(first), F.try_element_at("nodes", F.lit(1)) == F.col("first"), "left_semi")
    return routing.common_prefix(usual)


# --- events -------------------------------------------------------------------------------------------------


@registered(ctes(FULFILMENT) + "SELECT strftime(min(event_time), '%Y-%m-%dT%H:%M:%S.%gZ') AS first_time, strftime(max(event_time), '%Y-%m-%dT%H:%M:%S.%gZ') AS last_time, count(*) AS records, count(DISTINCT source) AS sources, count(DISTINCT name) AS names FROM ev")
def event_window_sources(spark, sf_dir):
    e = fulfilment(spark, sf_dir)
    n = e.agg(F.count_distinct("source").alias("sources"), F.count_distinct("name").alias("names"))
    return grouping.window_bounds(e).crossJoin(F.broadcast(n)).select(scalars.format_time(F.col("first_time")).alias("first_time"), scalars.format_time(F.col("last_time")).alias("last_time"), "records", "sources", "names")


@registered("SELECT 'order' AS kind, count(*) AS records FROM orders UNION ALL SELECT 'lineitem', count(*) FROM lineitem")
def records_by_kind(spark, sf_dir):
    return fulfilment(spark, sf_dir).groupBy("kind").agg(F.count("*").alias("records"))


@registered("SELECT * FROM (VALUES ('customer_key'), ('order_id'), ('supplier_key')) t(key)")
def id_keys(spark, sf_dir):
    return grouping.id_keys(fulfilment(spark, sf_dir))


def _replaced(text: str, *steps: tuple[str, str]) -> str:
    for pattern, to in steps:
        text = f"regexp_replace({text}, '{pattern}', '{to}', 'g')"
    return text


#: The patterns spelt out for an engine without lookaround, where a match takes the character beside it: the second
#: step for long hexadecimal words finds those that stand right behind one of the first.
HEX_STEP = (r"(^|[^\p{L}\p{N}_])[0-9a-fA-F]{8,}($|[^\p{L}\p{N}_])", r"\1{hex}\2")
COLLAPSED = _replaced("text", (r"[\p{L}\p{N}_.+-]+@[\p{L}\p{N}_-]+\.[\p{L}\p{N}_.-]+", "{addr}"), HEX_STEP, HEX_STEP, (r"([A-Za-z]\p{Nd})\p{Nd}+", r"\1{n}"), (r"(^|[^A-Za-z\p{Nd}])\p{Nd}+", r"\1{n}"))


@registered("SELECT doc_id, " + COLLAPSED + " AS collapsed FROM documents")
def collapse_text(spark, sf_dir):
    return tables.read(spark, sf_dir, "documents").select("doc_id", scalars.collapse(F.col("text")).alias("collapsed"))


# --- grouping -----------------------------------------------------------------------------------------------

LONG = ", long AS (SELECT source, 'order_id' AS key, value AS v FROM ev UNION ALL SELECT source, 'customer_key', customer_key FROM ev WHERE customer_key IS NOT NULL UNION ALL SELECT source, 'supplier_key', supplier_key FROM ev WHERE supplier_key IS NOT NULL)"
PROFILE = """, g AS (SELECT key, v, count(*) AS size, count(DISTINCT source) AS ns FROM long GROUP BY 1, 2),
    m AS (SELECT key, size, row_number() OVER (PARTITION BY key ORDER BY size) - 1 AS k, count(*) OVER (PARTITION BY key) AS n FROM g),
    c AS (SELECT key, sum(size) / (SELECT count(*) FROM ev) AS coverage, count(*) AS groups, avg(ns) AS per, max(ns) AS most FROM g GROUP BY key),
    p AS (SELECT c.*, (SELECT max(size) FROM m WHERE m.key = c.key AND k = n // 2) AS med FROM c),
    q AS (SELECT key, round(coverage, 6) AS coverage, groups, round(per, 6) AS sources_per_group, med AS median_group_size,
          CASE WHEN key IN ('span_id', 'parent_span_id', 'event_id', 'record_id') THEN 'identifies a single record' WHEN med <= 1 THEN 'most groups hold one record' WHEN most <= 1 THEN 'never leaves one source' ELSE '' END AS disqualified FROM p)"""
ACT_LONG = ", long AS (SELECT source, 'day_key' AS key, value AS v FROM ev UNION ALL SELECT source, 'user_key', user_key FROM ev UNION ALL SELECT source, 'k_id', k FROM ev WHERE k IS NOT NULL UNION ALL SELECT source, 'event_id', event_key FROM ev)"


def _candidates(events: DataFrame) -> DataFrame:
    return grouping.candidates(events).select("key", F.round("coverage", 6).alias("coverage"), "groups", F.round("sources_per_group", 6).alias("sources_per_group"), "median_group_size", "disqualified")


@registered(ctes(FULFILMENT) + LONG + PROFILE + " SELECT * FROM q")
def key_candidates(spark, sf_dir):
    return _candidates(fulfilment(spark, sf_dir))


@registered(ctes(ACTIVITY) + ACT_LONG + PROFILE + " SELECT * FROM q")
def key_candidates_activity(spark, sf_dir):
    return _candidates(activity(spark, sf_dir))


@registered(ctes(FULFILMENT) + LONG + PROFILE + " SELECT key FROM q WHERE disqualified = '' ORDER BY coverage DESC, key LIMIT 1")
def default_key(spark, sf_dir):
    return grouping.default_key(grouping.candidates(fulfilment(spark, sf_dir)))


@registered(ctes(FULFILMENT) + "SELECT count(*) FILTER (customer_key IS NULL) AS unjoined, count(*) AS records, round(count(*) FILTER (customer_key IS NULL) / count(*), 6) AS share FROM ev")
def unjoined_share(spark, sf_dir):
    return grouping.unjoined_share(fulfilment(spark, sf_dir), "customer_key").withColumn("share", F.round("share", 6))


@registered(ctes(FULFILMENT) + "SELECT name, count(*) AS records FROM ev WHERE customer_key IS NULL GROUP BY name ORDER BY records DESC, min((event_time, file_name, ordinal)) LIMIT 4")
def unjoined_names(spark, sf_dir):
    return quality.unjoined_by(fulfilment(spark, sf_dir), "customer_key", "name", 4)


@registered(
    ctes(ACTIVITY, SPANS)
    + ", f AS (SELECT value, source, min((event_time, file_name, ordinal)) AS first_at FROM ev GROUP BY 1, 2), o AS (SELECT value, string_agg(source, ',' ORDER BY first_at) AS sources FROM f GROUP BY value) "
    "SELECT value, strftime(start_time, '%Y-%m-%dT%H:%M:%S.%gZ') AS start_time, records, " + MS.format(a="start_time", b="end_time") + " AS duration_ms, sources FROM spans JOIN o USING (value)"
)
def journey_summary(spark, sf_dir):
    j = grouping.journeys(activity(spark, sf_dir), "day_key")
    return j.select("value", scalars.format_time(F.col("start_time")).alias("start_time"), "records", "duration_ms", F.concat_ws(",", "sources").alias("sources"))


@registered(ctes(ACTIVITY) + "SELECT value, count(DISTINCT k) AS distinct_k FROM ev GROUP BY value HAVING count(DISTINCT k) > 0")
def journey_other_ids(spark, sf_dir):
    return grouping.other_ids(activity(spark, sf_dir), "day_key", "k_id").groupBy("value").agg(F.count("*").alias("distinct_k"))


@registered(ctes(FULFILMENT) + "SELECT DISTINCT value, returned AS attribute_value FROM ev WHERE returned IS NOT NULL")
def journey_attribute_values(spark, sf_dir):
    return grouping.values_of(fulfilment(spark, sf_dir), "order_id", "returned")


@registered(ctes(FULFILMENT) + "SELECT value FROM ev GROUP BY value HAVING bool_or(coalesce(returned = 'R', false)) AND bool_or(coalesce(priority = '1-URGENT', false))")
def journeys_where_two_predicates(spark, sf_dir):
    return grouping.journeys_where(fulfilment(spark, sf_dir), "order_id", [("returned", "R"), ("priority", "1-URGENT")])


# --- names --------------------------------------------------------------------------------------------------

NAMED = """nm AS (SELECT event_type AS source, event_type || ' k=' || json_extract_string(props, '$.k') AS name, event_type AS type FROM events),
    vals AS (SELECT DISTINCT 'type' AS attribute, type AS v FROM nm WHERE length(type) >= 3), n AS (SELECT count(*) AS n FROM vals),
    vocab AS (SELECT v AS value, '{type}' AS placeholder FROM vals WHERE (SELECT n FROM n) BETWEEN 2 AND 12 AND EXISTS (SELECT 1 FROM nm, vals x WHERE contains(nm.name, x.v))),
    sub AS (SELECT DISTINCT name, regexp_replace(name, '^(' || (SELECT string_agg(value, '|' ORDER BY length(value) DESC, value) FROM vocab) || ')', '{type}') AS substituted FROM nm),
    col AS (SELECT *, regexp_replace(regexp_replace(substituted, '([A-Za-z]\\d)\\d+', '\\1{n}', 'g'), '(^|[^A-Za-z0-9])\\d+', '\\1{n}', 'g') AS collapsed FROM sub),
    lab AS (SELECT name, substituted, CASE WHEN (SELECT count(DISTINCT substituted) FROM col y WHERE y.collapsed = col.collapsed) > 1 THEN collapsed ELSE substituted END AS label FROM col)"""


def named(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Activity whose names hold an attribute's value and a number."""
    return tables.activity(spark, sf_dir).withColumn("name", F.concat("source", F.lit(" k="), F.col("ids")["k_id"]))


@registered("WITH " + NAMED + " SELECT value, placeholder FROM vocab")
def learned_vocabulary(spark, sf_dir):
    return naming.learn_vocabulary(named(spark, sf_dir))


@registered("WITH " + NAMED + " SELECT name, substituted FROM lab")
def substituted_names(spark, sf_dir):
    return _learned(spark, sf_dir).select("name", "substituted")


@registered("WITH " + NAMED + " SELECT name, label FROM lab")
def learned_names(spark, sf_dir):
    return _learned(spark, sf_dir).select("name", "label")


def _learned(spark, sf_dir):
    e = named(spark, sf_dir)
    return naming.learn_names(e, naming.vocabulary_column(naming.vocabulary_array(naming.learn_vocabulary(e))))


# --- quality ------------------------------------------------------------------------------------------------

FIELDS = """f AS (SELECT 'status' AS key, o_orderstatus AS v, 'str' AS t FROM orders UNION ALL SELECT 'priority', o_orderpriority, 'str' FROM orders UNION ALL SELECT 'total', CAST(o_totalprice AS VARCHAR), 'num' FROM orders
    UNION ALL SELECT 'status', l_linestatus, 'str' FROM lineitem UNION ALL SELECT 'returned', l_returnflag, 'str' FROM lineitem UNION ALL SELECT 'duration_ms', CAST(l_quantity AS VARCHAR), 'num' FROM lineitem)"""


@registered("WITH " + FIELDS + " SELECT key, count(DISTINCT v) AS distinct_values, count(*) AS observations FROM f GROUP BY key")
def field_profile(spark, sf_dir):
    return quality.field_values(fulfilment(spark, sf_dir)).groupBy("key").agg(F.count("*").alias("distinct_values"), F.sum("c").alias("observations"))


@registered("SELECT 'lane' AS key, 'OK' AS only, (SELECT count(*) FROM events) AS observations, true AS looks_healthy")
def constant_fields(spark, sf_dir):
    lane = F.struct(F.lit("str").alias("t"), F.lit("OK").alias("s"), F.lit(None).cast("double").alias("n"))
    e = activity(spark, sf_dir).withColumn("attributes", F.map_concat("attributes", F.create_map(F.lit("lane"), lane)))
    return quality.constant_fields(quality.field_values(e))


@registered("WITH v AS (SELECT DISTINCT lower(trim(event_type)) AS s FROM events) SELECT (SELECT count(*) FROM events) AS records, bool_or(s IN ('error', 'err', 'fail', 'failed', 'failure', 'fatal', 'critical', 'panic', 'exception', 'timeout', 'rejected', 'denied', 'aborted', 'cancelled')) AS signal, NOT bool_or(s IN ('error', 'err', 'fail', 'failed', 'failure', 'fatal', 'critical', 'panic', 'exception', 'timeout', 'rejected', 'denied', 'aborted', 'cancelled')) AND (SELECT count(*) FROM events) >= 20 AS fires FROM v")
def failure_signal(spark, sf_dir):
    e = activity(spark, sf_dir)
    return quality.failure_signal(e, quality.field_values(e))


@registered("WITH " + FIELDS + " SELECT key, string_agg(DISTINCT v, ',' ORDER BY v) AS seen, key = 'status' AS hinted FROM f WHERE t = 'str' GROUP BY key HAVING count(DISTINCT v) BETWEEN 2 AND 8")
def enum_shaped_fields(spark, sf_dir):
    return quality.enum_shaped_fields(quality.field_values(fulfilment(spark, sf_dir))).select("key", F.concat_ws(",", "seen").alias("seen"), "hinted")


FRAG = ", o AS (SELECT value, 'k_id' AS other_key, k AS other, event_time, file_name, ordinal, source, name FROM ev WHERE k IS NOT NULL UNION ALL SELECT value, 'user_key', user_key, event_time, file_name, ordinal, source, name FROM ev)"


@registered(ctes(ACTIVITY) + FRAG + ", d AS (SELECT other_key, value, count(DISTINCT other) AS n FROM o GROUP BY 1, 2) SELECT other_key, count(*) AS carrying, count(*) FILTER (n > 1) AS broken FROM d GROUP BY 1 HAVING count(*) FILTER (n > 1) > 0")
def fragmented_ids(spark, sf_dir):
    return quality.fragmentation(activity(spark, sf_dir), "day_key")


@registered(
    ctes(ACTIVITY) + FRAG + ", a AS (SELECT other_key, value, other, min((event_time, file_name, ordinal, source, name)) AS first_at, arg_min(source || ':' || name, (event_time, file_name, ordinal, source, name)) AS node FROM o GROUP BY 1, 2, 3), "
    "r AS (SELECT *, row_number() OVER (PARTITION BY other_key, value ORDER BY first_at) AS k FROM a) SELECT other_key, node, count(*) AS breaks FROM r WHERE k > 1 GROUP BY 1, 2"
)
def fragment_breaks(spark, sf_dir):
    return quality.fragment_breaks(activity(spark, sf_dir), "day_key").select("other_key", "node", "breaks")


# --- timing -------------------------------------------------------------------------------------------------

PERCENTILES = """d AS (SELECT label, list(ms ORDER BY ms) AS xs, count(*) AS n, sum(ms) AS total, max(ms) AS mx FROM s GROUP BY label),
    t AS (SELECT label, n AS count, round(total, 4) AS total_ms, xs[CAST(least(n, greatest(1, round_even(0.5::DOUBLE * n + 0.5, 0))) AS INTEGER)] AS p50, xs[CAST(least(n, greatest(1, round_even(0.95::DOUBLE * n + 0.5, 0))) AS INTEGER)] AS p95, mx AS max_ms FROM d)"""
RANKED = ", s AS (SELECT node AS label, ms FROM ev WHERE ms IS NOT NULL), " + PERCENTILES


def _timed(found: DataFrame) -> DataFrame:
    return found.select("label", "count", F.round("total_ms", 4).alias("total_ms"), "p50", "p95", "max_ms")


@registered(ctes(ACTIVITY) + RANKED + " SELECT * FROM t")
def node_durations(spark, sf_dir):
    return _timed(timing.node_durations(activity(spark, sf_dir)))


@registered(ctes(FULFILMENT) + RANKED + " SELECT * FROM t ORDER BY total_ms DESC, label LIMIT 8")
def busiest_nodes(spark, sf_dir):
    return _timed(timing.busiest(timing.node_durations(fulfilment(spark, sf_dir))))


@registered(ctes(ACTIVITY) + RANKED + " SELECT label, round(max_ms / p50, 4) AS spread FROM t WHERE count >= 8 AND p50 <> 0 AND max_ms / p50 >= 3 ORDER BY max_ms / p50 DESC, label LIMIT 5")
def widest_spread(spark, sf_dir):
    return timing.widest_spread(timing.node_durations(activity(spark, sf_dir))).select("label", F.round("spread", 4).alias("spread"))


@registered(ctes(FULFILMENT, SPANS) + ", s AS (SELECT 'end to end' AS label, " + MS.format(a="start_time", b="end_time") + " AS ms FROM spans WHERE records > 1), " + PERCENTILES + " SELECT * FROM t")
def end_to_end(spark, sf_dir):
    return _timed(timing.end_to_end(fulfilment(spark, sf_dir), "order_id"))


@registered(ctes(ACTIVITY, SPANS) + "SELECT value, " + MS.format(a="start_time", b="end_time") + " AS duration_ms FROM spans WHERE records > 1 ORDER BY duration_ms DESC, value LIMIT 5")
def longest_journeys(spark, sf_dir):
    return timing.longest(activity(spark, sf_dir), "day_key")


# --- slices -------------------------------------------------------------------------------------------------

AFTER, BEFORE = datetime(1995, 3, 1, tzinfo=UTC), datetime(1995, 4, 1, tzinfo=UTC)
OVERLAP = "m AS (SELECT spans.*, route FROM spans JOIN membership USING (value) WHERE end_time >= TIMESTAMP '1995-03-01' AND start_time <= TIMESTAMP '1995-04-01')"
TIMED = slices.Filter(after=AFTER, before=BEFORE)


@registered(ctes(FULFILMENT, PATHS, SPANS, OVERLAP) + "SELECT value, route FROM m")
def journeys_overlapping_window(spark, sf_dir):
    e = fulfilment(spark, sf_dir)
    return slices.matching(e, "order_id", routes_of(e, "order_id")[1], TIMED).select("value", "route")


@registered(ctes(FULFILMENT, PATHS, SPANS, OVERLAP) + "SELECT value, route FROM m ORDER BY start_time, value LIMIT 3")
def slice_select_capped(spark, sf_dir):
    e = fulfilment(spark, sf_dir)
    return slices.shown(slices.matching(e, "order_id", routes_of(e, "order_id")[1], TIMED)).select("value", "route")


@registered(ctes(ACTIVITY, PATHS, SPANS) + ", j AS (SELECT spans.*, route FROM spans JOIN membership USING (value)), m AS (SELECT * FROM j WHERE route = 2), a AS (SELECT min(start_time) AS anchor FROM m) SELECT value, abs(epoch_us(start_time) - epoch_us(anchor)) AS gap_us FROM j, a WHERE route = 1 ORDER BY gap_us, value LIMIT 1")
def contrast_nearest(spark, sf_dir):
    e = activity(spark, sf_dir)
    m = routes_of(e, "day_key")[1]
    every = grouping.journeys(e, "day_key").join(m, "value")
    return slices.contrast(every, every.where("route = 2")).select("value", "gap_us")


CHANGED = "c AS (SELECT ts AS event_time, event_id AS ordinal, event_type AS target FROM events WHERE json_extract_string(props, '$.k') = '7')"


@registered(ctes(ACTIVITY.replace(" FROM events", " FROM events WHERE coalesce(json_extract_string(props, '$.k'), '') <> '7'"), SPANS, CHANGED) + "SELECT value, ordinal, target, event_time BETWEEN start_time AND end_time AS inline FROM spans JOIN c ON event_time BETWEEN start_time - INTERVAL 45 MINUTE AND end_time + INTERVAL 45 MINUTE")
def changes_near_journeys(spark, sf_dir):
    e = tables.with_changes(activity(spark, sf_dir))
    spans = grouping.journeys(e.where("kind <> 'deploy'"), "day_key")
    return slices.changes_by_journey(spans, slices.changes(e)).select("value", "ordinal", "target", "inline")


@registered(
    "WITH a AS (SELECT min(ts) AS anchor FROM events), c AS (SELECT ts, event_id AS ordinal, event_type AS target FROM events WHERE json_extract_string(props, '$.k') = '7') "
    "SELECT ordinal, target, CAST(round_even(abs(epoch_us(anchor) - epoch_us(ts)) / 60000000.0, 0) AS BIGINT) AS minutes, CASE WHEN anchor >= ts THEN 'before' ELSE 'after' END AS side FROM c, a"
)
def change_offset_minutes(spark, sf_dir):
    """All changes of the log's own period, seen from its first event."""
    e = tables.with_changes(activity(spark, sf_dir))
    row = e.agg(F.unix_micros(F.min("event_time")).alias("a"), F.unix_micros(F.max("event_time")).alias("b")).head()
    first, last = (datetime.fromtimestamp(0, UTC) + timedelta(microseconds=t or 0) for t in (row["a"], row["b"]))
    return slices.change_offsets(slices.changes_near(e, first, last), first).select("ordinal", "target", "minutes", "side")


@registered(
    ctes(FULFILMENT)
    + ", l AS (SELECT value, 'status' AS attribute, status AS v FROM ev UNION ALL SELECT value, 'returned', returned FROM ev WHERE returned IS NOT NULL UNION ALL SELECT value, 'priority', priority FROM ev WHERE priority IS NOT NULL) "
    "SELECT value, attribute, min(v) AS constant FROM l GROUP BY 1, 2 HAVING count(DISTINCT v) = 1"
)
def constants_within_journey(spark, sf_dir):
    return slices.constants_within(fulfilment(spark, sf_dir), "order_id")


@registered(
    ctes(FULFILMENT)
    + ", ch AS (SELECT value FROM ev WHERE priority = '1-URGENT'), l AS (SELECT value, 'status' AS attribute, status AS v FROM ev UNION ALL SELECT value, 'returned', returned FROM ev WHERE returned IS NOT NULL UNION ALL SELECT value, 'priority', priority FROM ev WHERE priority IS NOT NULL), "
    "k AS (SELECT value, attribute, min(v) AS constant FROM l WHERE value IN (SELECT value FROM ch) GROUP BY 1, 2 HAVING count(DISTINCT v) = 1) SELECT attribute, constant FROM k GROUP BY 1, 2 HAVING count(*) = (SELECT count(DISTINCT value) FROM ch)"
)
def constants_across_journeys(spark, sf_dir):
    e = fulfilment(spark, sf_dir)
    return slices.constants_across(slices.constants_within(e, "order_id"), grouping.journeys_where(e, "order_id", [("priority", "1-URGENT")]))


@registered(
    ctes(ACTIVITY) + ", n AS (SELECT *, last_value(k IGNORE NULLS) OVER (PARTITION BY value ORDER BY event_time, file_name, ordinal, source, name ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev FROM ev) "
    "SELECT value, ordinal, CASE WHEN prev IS NOT NULL AND k IS NOT NULL AND k <> prev THEN '!' ELSE '' END AS mark FROM n"
)
def trace_break_marks(spark, sf_dir):
    return slices.trace_marks(activity(spark, sf_dir), "day_key", "k_id").select("value", "ordinal", "mark")


# --- triage and cost ----------------------------------------------------------------------------------------


@registered(
    "WITH claims AS (SELECT o_orderkey AS claim, CASE o_orderkey % 5 WHEN 0 THEN NULL WHEN 1 THEN 'cust=' || o_custkey WHEN 2 THEN 'some prose here' WHEN 3 THEN CAST(o_custkey + 100000000 AS VARCHAR) ELSE CAST(o_custkey + 1000 AS VARCHAR) END AS ref FROM orders), "
    "known AS (SELECT CAST(c_custkey AS VARCHAR) AS ref FROM customer UNION SELECT CAST(c_custkey + 1000 AS VARCHAR) FROM customer), "
    "r AS (SELECT claim, ref, regexp_matches(ref, '^[\\p{L}\\p{N}_][\\p{L}\\p{N}_./:@=-]{2,}$') AS shaped, ref IN (SELECT ref FROM known) OR (contains(ref, '=') AND regexp_replace(ref, '^[^=]*=', '') IN (SELECT ref FROM known)) AS hit FROM claims), "
    "p AS (SELECT claim, count(ref) AS n, count(*) FILTER (shaped AND NOT hit) AS unknown, count(*) FILTER (NOT shaped) AS prose FROM r GROUP BY claim) "
    "SELECT claim, CASE WHEN n = 0 THEN 'cites no evidence at all' WHEN unknown > 0 THEN 'cites evidence that was never shown' ELSE 'cites prose rather than an identifier' END AS reason, unknown + prose AS n_bad FROM p WHERE n = 0 OR unknown > 0 OR prose > 0"
)
def citation_rejections(spark, sf_dir):
    o = tables.read(spark, sf_dir, "orders")
    by, cust = F.col("o_orderkey") % 5, F.col("o_custkey")
    ref = F.when(by == 0, None).when(by == 1, F.concat(F.lit("cust="), cust.cast("string"))).when(by == 2, "some prose here").when(by == 3, (cust + 100000000).cast("string")).otherwise((cust + 1000).cast("string"))
    c = tables.read(spark, sf_dir, "customer")
    known = c.select(F.col("c_custkey").cast("string").alias("ref")).union(c.select((F.col("c_custkey") + 1000).cast("string")))
    return triage.citation_rejections(o.select(F.col("o_orderkey").alias("claim"), ref.alias("ref")), known)


COMPLAINT = "the purchase never went through after a click, maybe a refund or signup problem"


@registered(
    ctes(ACTIVITY, PATHS)
    + ", w AS (SELECT unnest(['purchase', 'through', 'after', 'click', 'maybe', 'refund', 'signup', 'problem']) AS token), u AS (SELECT len(nodes) AS usual FROM routes WHERE route = 1), "
    "odd AS (SELECT route, nodes FROM routes, u WHERE route > 1 AND (len(nodes) < usual OR len(list_distinct(nodes)) < len(nodes))), "
    "t AS (SELECT route, unnest(regexp_extract_all(lower(array_to_string(nodes, ' ')), '[a-z]{3,}')) AS token FROM odd), "
    "v AS (SELECT DISTINCT route, unnest(regexp_extract_all(lower(name), '[a-z]{3,}')) AS token FROM ev JOIN membership USING (value) JOIN odd USING (route)) "
    "SELECT route, count(DISTINCT token) AS score FROM (SELECT * FROM t UNION ALL SELECT * FROM v) x WHERE token IN (SELECT token FROM w) GROUP BY route"
)
def lexical_route_match(spark, sf_dir):
    e = activity(spark, sf_dir)
    r, m = routes_of(e, "day_key")
    return triage.lexical_matches(triage.route_vocabulary(e, "day_key", m, r), r, COMPLAINT)


PARTS = "b AS (SELECT CASE WHEN event_type = 'click' THEN 'noise' WHEN event_type = 'view' THEN 'scoped' ELSE 'spans' END AS part, strlen(props) AS bytes FROM events), u AS (SELECT count(DISTINCT user_id) AS n FROM events), f AS (SELECT coalesce(sum(bytes) FILTER (part = 'spans'), 0) / any_value(n) AS spans, coalesce(sum(bytes) FILTER (part = 'scoped'), 0) / any_value(n) AS scoped, coalesce(sum(bytes) FILTER (part = 'noise'), 0) / any_value(n) AS noise, 320.0::DOUBLE AS ledger FROM b, u)"


def _footprint(spark, sf_dir):
    e = tables.read(spark, sf_dir, "events")
    part = F.when(F.col("event_type") == "click", "noise").when(F.col("event_type") == "view", "scoped").otherwise("spans")
    return cost.footprint(e.select(part.alias("part"), F.octet_length("props").alias("bytes")), e.select("user_id").distinct(), 320)


@registered("WITH " + PARTS + " SELECT round(spans, 6) AS spans, round(scoped, 6) AS scoped, round(noise, 6) AS noise, ledger FROM f")
def footprint_bytes(spark, sf_dir):
    return _footprint(spark, sf_dir).select(*[F.round(c, 6).alias(c) for c in ("spans", "scoped", "noise")], "ledger")


@registered(
    "WITH " + PARTS + ", d AS (SELECT (spans + scoped + noise) * 2000000 AS every, (spans + scoped) * 2000000 AS useful, scoped * 2000000 AS sc, noise * 2000000 AS nz, ledger * 2000000 AS lg FROM f) "
    "SELECT line, round(amount, 6) AS amount FROM (SELECT unnest(['telemetry_gb_per_day', 'useful_gb_per_day', 'noise_share', 'all_indexed_month', 'hot_month', 'warm_month', 'cold_month', 'one_scan', 'dashboard_month']) AS line, "
    "unnest([every / 1073741824, useful / 1073741824, nz / every, every * 30 / 1073741824 * 2.5::DOUBLE, sc * 7 / 1073741824 * 2.5::DOUBLE, useful * 30 / 1073741824 * 0.023::DOUBLE, lg * 395 / 1073741824 * 0.023::DOUBLE, every * 30 / 1099511627776.0::DOUBLE * 5, every * 30 / 1099511627776.0::DOUBLE * 5 * 720]) AS amount FROM d)"
)
def retention_cost(spark, sf_dir):
    return cost.report(_footprint(spark, sf_dir)).withColumn("amount", F.round("amount", 6))

