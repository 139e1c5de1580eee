"""Queries over what users read (payloads, lines, defects), over filters, and over JSON exports; SQL for each."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalars
from ..operators import grouping, naming, quality, routing, slices, timing, triage
from ..sources import export, tables
from .journeys import ACTIVITY, AFTER, BEFORE, CHANGED, DIALOGUE, FIELDS, FRAG, FULFILMENT, MS, NAMED, PATHS, PERCENTILES, RANKED, SPANS, activity, ctes, dialogue, fulfilment, joined, named, registered, routes_of

# --- filters ------------------------------------------------------------------------------------------------

WHOLE = "j AS (SELECT spans.*, route FROM spans JOIN membership USING (value))"


def _matching(spark, sf_dir, where: slices.Filter) -> DataFrame:
    e = fulfilment(spark, sf_dir)
    return slices.matching(e, "order_id", routes_of(e, "order_id")[1], where).select("value", "route")


@registered(ctes(FULFILMENT, PATHS, SPANS, WHOLE) + "SELECT value, route FROM j WHERE value IN ('1', '7', '32', '33', '100', 'none')")
def journeys_by_value(spark, sf_dir):
    return _matching(spark, sf_dir, slices.Filter(values=("1", "7", "32", "33", "100", "none")))


@registered(ctes(FULFILMENT, PATHS, SPANS, WHOLE) + "SELECT value, route FROM j WHERE route = 2")
def journeys_by_route(spark, sf_dir):
    return _matching(spark, sf_dir, slices.Filter(route=2))


@registered(
    ctes(FULFILMENT, PATHS, SPANS, WHOLE) + "SELECT value, route FROM j WHERE route = 1 AND end_time >= TIMESTAMP '1995-03-01' AND start_time <= TIMESTAMP '1995-04-01' "
    "AND value IN (SELECT value FROM ev WHERE returned = 'R') AND value IN (SELECT value FROM ev WHERE status = 'F')"
)
def journeys_by_whole_filter(spark, sf_dir):
    return _matching(spark, sf_dir, slices.Filter(where=(("returned", "R"), ("status", "F")), after=AFTER, before=BEFORE, route=1))


@registered(ctes(FULFILMENT, PATHS, SPANS, WHOLE) + "SELECT route, count(*) AS journeys FROM j WHERE end_time >= TIMESTAMP '1995-03-01' AND start_time <= TIMESTAMP '1995-04-01' GROUP BY route")
def matched_totals(spark, sf_dir):
    return _matching(spark, sf_dir, slices.Filter(after=AFTER, before=BEFORE)).groupBy("route").agg(F.count("*").alias("journeys"))


# --- events and names ---------------------------------------------------------------------------------------


@registered("SELECT CAST(o_orderkey AS VARCHAR) AS value, 'priority=' || o_orderpriority || ' status=' || o_orderstatus || ' total=' || CAST(CAST(o_totalprice AS DOUBLE) AS VARCHAR) AS detail FROM orders")
def event_details(spark, sf_dir):
    orders = grouping.of_kind(fulfilment(spark, sf_dir), "order")
    return orders.select(F.col("ids")["order_id"].alias("value"), scalars.detail(F.col("attributes")).alias("detail"))


@registered(ctes(FULFILMENT) + "SELECT DISTINCT node, regexp_replace(node, '^[^:]*:', '') AS label FROM ev")
def short_labels(spark, sf_dir):
    return fulfilment(spark, sf_dir).select("node").distinct().select("node", scalars.short(F.col("node")).alias("label"))


@registered("WITH " + NAMED + " SELECT nm.source || ':' || label AS node, count(*) AS records FROM nm JOIN lab USING (name) GROUP BY 1")
def learned_nodes(spark, sf_dir):
    return naming.learned_nodes(named(spark, sf_dir)).groupBy("node").agg(F.count("*").alias("records"))


@registered(
    "WITH " + NAMED + ", keyed AS (SELECT user_id || '/' || strftime(ts, '%Y-%m-%d') AS value, ts AS event_time, 'events' AS file_name, event_id AS ordinal, event_type AS source, event_type || ' k=' || json_extract_string(props, '$.k') AS name FROM events), "
    "ev AS (SELECT keyed.*, keyed.source || ':' || label AS node FROM keyed JOIN lab USING (name)), " + PATHS + " SELECT route, array_to_string(nodes, ' > ') AS nodes, journeys FROM routes"
)
def learned_route_table(spark, sf_dir):
    r, _ = routes_of(naming.learned_nodes(named(spark, sf_dir)), "day_key")
    return r.select("route", joined().alias("nodes"), "journeys")


# --- routes as read -----------------------------------------------------------------------------------------


@registered(
    ctes(ACTIVITY, PATHS)
    + ", x AS (SELECT route, unnest(nodes) AS node, generate_subscripts(nodes, 1) - 1 AS pos FROM routes), a AS (SELECT pos, min(node) AS node FROM x GROUP BY pos HAVING count(*) = (SELECT count(*) FROM routes) AND count(DISTINCT node) = 1 AND count(*) > 1), "
    "k AS (SELECT pos, node FROM (SELECT pos, node, row_number() OVER (ORDER BY pos) - 1 AS k FROM a) WHERE pos = k), o AS (SELECT count(*) AS n, string_agg(regexp_replace(node, '^[^:]*:', ''), ' -> ' ORDER BY pos) AS opening FROM k), "
    "s AS (SELECT route, journeys, nodes, [regexp_replace(y, '^[^:]*:', '') FOR y IN nodes[n + 1:]] AS rest FROM routes, o), w AS (SELECT *, len(rest) AS m, CASE WHEN len(rest) = 0 THEN '(ends here)' ELSE array_to_string(rest, ' -> ') END AS whole FROM s) "
    "SELECT CAST(route + 1 AS BIGINT) AS line_no, lpad(CAST(route AS VARCHAR), CAST(greatest(3, length(CAST(route AS VARCHAR))) AS INTEGER), ' ') || '. ' || lpad(CAST(journeys AS VARCHAR), CAST(greatest(4, length(CAST(journeys AS VARCHAR))) AS INTEGER), ' ') || '  ...-> ' || "
    "CASE WHEN length(whole) > 96 AND m > 3 THEN rest[1] || ' -> ...' || (m - 3) || ' more... -> ' || rest[-2] || ' -> ' || rest[-1] ELSE whole END || CASE WHEN len(list_distinct(nodes)) < len(nodes) THEN ' (x2) visits a node twice' ELSE '' END AS line FROM w "
    "UNION ALL SELECT 0, 'all journeys start: ' || opening FROM o WHERE n > 0 UNION ALL SELECT 1, '' FROM o WHERE n > 0"
)
def route_lines(spark, sf_dir):
    r, _ = routes_of(activity(spark, sf_dir), "day_key")
    return routing.rendered(r)


@registered(
    ctes(DIALOGUE, PATHS)
    + ", q AS (SELECT route, value, row_number() OVER (PARTITION BY route ORDER BY value) AS k FROM membership), e AS (SELECT route, list(value ORDER BY value) AS exemplars FROM q WHERE k <= 3 GROUP BY route), "
    "s AS (SELECT route, journeys, nodes, [split_part(x, ':', 1) FOR x IN nodes] AS src FROM routes), u AS (SELECT route, unnest(src) AS source, generate_subscripts(src, 1) AS pos FROM s), "
    "f AS (SELECT route, source, min(pos) AS pos FROM u GROUP BY 1, 2), so AS (SELECT route, list(source ORDER BY pos) AS sources FROM f GROUP BY route), "
    "d AS (SELECT route, unnest(nodes) AS node FROM routes), tw AS (SELECT route, node FROM d GROUP BY 1, 2 HAVING count(*) > 1), re AS (SELECT route, list(node ORDER BY node) AS repeats FROM tw GROUP BY route) "
    "SELECT route, CAST(to_json({'route': 'route-' || route, 'journeys': journeys, 'nodes': nodes, 'ends_at': nodes[-1], 'sources': sources, 'repeats': coalesce(repeats, CAST([] AS VARCHAR[])), 'exemplars': exemplars}) AS VARCHAR) AS json "
    "FROM s JOIN e USING (route) JOIN so USING (route) LEFT JOIN re USING (route)"
)
def route_payload(spark, sf_dir):
    return routing.payload(*routes_of(dialogue(spark, sf_dir), "conv_id"))


# --- quality as read ----------------------------------------------------------------------------------------

BROKEN = (
    FRAG + ", a AS (SELECT other_key, value, other, min((event_time, file_name, ordinal, source, name)) AS first_at, arg_min(source || ':' || name, (event_time, file_name, ordinal, source, name)) AS node FROM o GROUP BY 1, 2, 3), "
    "r AS (SELECT *, row_number() OVER (PARTITION BY other_key, value ORDER BY first_at) AS k FROM a), br AS (SELECT other_key, node, count(*) AS breaks, min(first_at) AS first FROM r WHERE k > 1 GROUP BY 1, 2), "
    "tp AS (SELECT *, row_number() OVER (PARTITION BY other_key ORDER BY breaks DESC, first) AS k FROM br), wh AS (SELECT other_key, string_agg(node || ': ' || breaks, ', ' ORDER BY k) AS places FROM tp WHERE k <= 3 GROUP BY other_key), "
    "pr AS (SELECT other_key, value, count(*) AS n FROM a GROUP BY 1, 2), cn AS (SELECT other_key, count(*) AS carrying, count(*) FILTER (n > 1) AS broken FROM pr GROUP BY 1), "
    "hv AS (SELECT other_key, value, row_number() OVER (PARTITION BY other_key ORDER BY value) AS k FROM pr WHERE n > 1), hu AS (SELECT other_key, list(value ORDER BY value) AS affected FROM hv WHERE k <= 5 GROUP BY 1), "
    "df AS (SELECT 4 AS \"check\", 'Q.fragmented.' || other_key AS id, '`' || other_key || '` changes within ' || broken || ' of ' || carrying || ' journeys' AS title, "
    "['in these journeys `' || other_key || '` reaches part of the path: whatever is keyed on it shows a fragment and does not say so'] AS limits, "
    "[broken || '/' || carrying || ' journeys fragment', 'later values first appear at ' || places] AS evidence, affected, ['how context is passed on there, compared with a path that keeps one value'] AS would_resolve "
    "FROM cn JOIN wh USING (other_key) JOIN hu USING (other_key) WHERE broken > 0)"
)


@registered(ctes(ACTIVITY) + BROKEN + ' SELECT "check", id, title, CAST(to_json(limits) AS VARCHAR) AS limits, CAST(to_json(evidence) AS VARCHAR) AS evidence, CAST(to_json(affected) AS VARCHAR) AS affected FROM df')
def quality_defects(spark, sf_dir):
    d = quality.assess(activity(spark, sf_dir), "day_key")
    return d.select("check", "id", "title", F.to_json("limits").alias("limits"), F.to_json("evidence").alias("evidence"), F.to_json("affected").alias("affected"))


@registered(ctes(ACTIVITY) + BROKEN + " SELECT \"check\", id, CAST(to_json({'defect': id, 'title': title, 'limits': limits, 'evidence': evidence, 'affected_journeys': affected, 'would_resolve': would_resolve}) AS VARCHAR) AS json FROM df")
def quality_payload(spark, sf_dir):
    return quality.payload(quality.assess(activity(spark, sf_dir), "day_key"))


SILENT = "si AS (SELECT 1 AS one FROM f HAVING count(*) FILTER (t = 'str' AND lower(trim(v)) IN ('error', 'err', 'fail', 'failed', 'failure', 'fatal', 'critical', 'panic', 'exception', 'timeout', 'rejected', 'denied', 'aborted', 'cancelled')) = 0 AND (SELECT count(*) FROM ev) >= 20)"
FLAT = "c AS (SELECT key, min(v) AS sole, format('{:,}', count(*)) AS n FROM f GROUP BY key HAVING count(DISTINCT v) = 1 AND count(*) >= 20)"
LOST = "lo AS (SELECT CAST(CAST(round_even(100.0::DOUBLE * count(*) FILTER (customer_key IS NULL) / count(*), 0) AS BIGINT) AS VARCHAR) || '%' AS share FROM ev HAVING count(*) FILTER (customer_key IS NULL) / count(*) >= 0.2)"


@registered(
    ctes(FULFILMENT, FIELDS, SILENT, FLAT, LOST)
    + ", fr AS (SELECT 1 AS one FROM (SELECT customer_key FROM ev WHERE customer_key IS NOT NULL GROUP BY 1 HAVING count(DISTINCT value) > 1) HAVING count(*) > 0) "
    "SELECT '`' || key || '` is ''' || sole || ''' in all ' || n || ' records that carry it: it separates nothing, and no alert on it can fire' AS \"limit\" FROM c "
    "UNION SELECT 'a healthy-looking `' || key || '` is no evidence that anything worked: it would read the same if all had failed' FROM c WHERE lower(trim(sole)) IN ('ok', 'success', 'healthy', '0', '0.0') "
    "UNION SELECT 'no finding can rest on an error signal, since there is none: only on structure, absence and timing' FROM si UNION SELECT 'alerting on error status or log level sees nothing in this window' FROM si "
    "UNION SELECT share || ' of this data supports claims about volume only, never about one journey' FROM lo UNION SELECT 'a search by identifier misses those records, however relevant' FROM lo "
    "UNION SELECT 'in these journeys `order_id` reaches part of the path: whatever is keyed on it shows a fragment and does not say so' FROM fr"
)
def quality_limits(spark, sf_dir):
    return quality.limits(quality.assess(fulfilment(spark, sf_dir), "customer_key"))


# --- timing as read -----------------------------------------------------------------------------------------

WHOLE_MS = "CAST(CAST(round_even({x}, 0) AS BIGINT) AS VARCHAR)"
SAID = (
    "CASE WHEN {t}.count >= 8 THEN 'n=' || {t}.count || ', p50 ' || " + WHOLE_MS.format(x="p50") + " || 'ms, p95 ' || " + WHOLE_MS.format(x="p95") + " || 'ms, max ' || " + WHOLE_MS.format(x="max_ms") + " || 'ms' "
    "ELSE {t}.count || ' samples: ' || array_to_string([" + WHOLE_MS.format(x="x") + " FOR x IN xs], ', ') || ' ms (too few for percentiles)' END"
)


@registered(ctes(ACTIVITY) + RANKED + " SELECT label, " + SAID.format(t="t") + " AS description FROM t JOIN d USING (label)")
def duration_descriptions(spark, sf_dir):
    e = activity(spark, sf_dir)
    return timing.described(timing.node_durations(e), e.select(F.col("node").alias("label"), scalars.duration_ms().alias("ms"))).select("label", "description")


TENTH = "CAST(round_even({x}, 1) AS DECIMAL(18, 1))"
SHOWN = (
    "CASE WHEN {t}.count >= 8 THEN CAST(to_json({{'label': label, 'count': {t}.count, 'description': description, 'p50_ms': " + TENTH.format(x="p50") + ", 'p95_ms': " + TENTH.format(x="p95") + ", 'max_ms': " + TENTH.format(x="max_ms") + ", 'spread': "
    "CASE WHEN p50 <> 0 THEN " + TENTH.format(x="max_ms / p50") + " ELSE 0 END}}) AS VARCHAR) ELSE CAST(to_json({{'label': label, 'count': {t}.count, 'description': description}}) AS VARCHAR) END AS json"
)


@registered(
    ctes(ACTIVITY, SPANS)
    + ", s AS (SELECT node AS label, ms FROM ev WHERE ms IS NOT NULL UNION ALL SELECT 'end to end', " + MS.format(a="start_time", b="end_time") + " FROM spans WHERE records > 1), " + PERCENTILES
    + ", de AS (SELECT t.*, " + SAID.format(t="t") + " AS description FROM t JOIN d USING (label)), by_time AS (SELECT *, row_number() OVER (ORDER BY total_ms DESC, label) AS pos FROM de WHERE label <> 'end to end'), "
    "by_spread AS (SELECT *, row_number() OVER (ORDER BY max_ms / p50 DESC, label) AS pos FROM de WHERE label <> 'end to end' AND count >= 8 AND p50 <> 0 AND max_ms / p50 >= 3), "
    "lg AS (SELECT value, " + MS.format(a="start_time", b="end_time") + " AS ms, row_number() OVER (ORDER BY epoch_us(end_time) - epoch_us(start_time) DESC, value) AS pos FROM spans WHERE records > 1) "
    "SELECT 'window' AS section, 1::INTEGER AS pos, CAST(to_json([strftime(min(event_time), '%Y-%m-%dT%H:%M:%S.%gZ'), strftime(max(event_time), '%Y-%m-%dT%H:%M:%S.%gZ')]) AS VARCHAR) AS json FROM ev "
    "UNION ALL SELECT 'busiest_nodes', CAST(pos AS INTEGER), " + SHOWN.format(t="by_time") + " FROM by_time WHERE pos <= 8 UNION ALL SELECT 'widest_spread', CAST(pos AS INTEGER), " + SHOWN.format(t="by_spread") + " FROM by_spread WHERE pos <= 5 "
    "UNION ALL SELECT 'end_to_end', 1, " + SHOWN.format(t="de") + " FROM de WHERE label = 'end to end' "
    "UNION ALL SELECT 'longest_journeys', CAST(pos AS INTEGER), CAST(to_json({'journey': value, 'duration_ms': " + TENTH.format(x="ms") + "}) AS VARCHAR) FROM lg WHERE pos <= 5"
)
def timing_payload(spark, sf_dir):
    return timing.payload(activity(spark, sf_dir), "day_key")


# --- timelines ----------------------------------------------------------------------------------------------

DETAIL = "concat_ws(' ', 'k=' || k, 'type=' || source)"


@registered("SELECT event_id AS ordinal, event_type AS target, concat_ws(' ', event_type, 'k=' || json_extract_string(props, '$.k'), 'type=' || event_type) AS what FROM events WHERE json_extract_string(props, '$.k') = '7'")
def change_descriptions(spark, sf_dir):
    return slices.changes(tables.with_changes(activity(spark, sf_dir))).select("ordinal", "target", "what")


@registered(
    "WITH " + CHANGED + ", b AS (SELECT max(ts) AS last FROM events) SELECT ordinal, target FROM c, b WHERE event_time >= TIMESTAMP '2024-01-03' - INTERVAL 45 MINUTE AND event_time <= last + INTERVAL 45 MINUTE"
)
def changes_of_open_period(spark, sf_dir):
    """A slice by time that is open to the right asks for the changes up to the log's end."""
    from datetime import UTC, datetime

    e = tables.with_changes(activity(spark, sf_dir))
    first = datetime(2024, 1, 1, tzinfo=UTC)
    where = slices.Filter(after=datetime(2024, 1, 3, tzinfo=UTC))
    return slices.changes_of_slice(e, where, [{"start_time": first, "end_time": first}]).select("ordinal", "target")


@registered(
    ctes(ACTIVITY, SPANS)
    + ", ch AS (SELECT * FROM spans ORDER BY start_time, value LIMIT CASE WHEN (SELECT count(*) FROM spans) <= 6 THEN 6 ELSE 3 END), own AS (SELECT ev.*, row_number() OVER (PARTITION BY value ORDER BY event_time, file_name, ordinal, source, name) AS n, "
    "last_value(nullif(k, '') IGNORE NULLS) OVER (PARTITION BY value ORDER BY event_time, file_name, ordinal, source, name ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev FROM ev WHERE value IN (SELECT value FROM ch)), "
    "co AS (SELECT value, count(DISTINCT k) = 1 AS one_k, count(DISTINCT source) = 1 AS one_type, min(k) AS k, min(source) AS type, count(*) AS size, count(DISTINCT k) AS traces FROM own GROUP BY value) "
    "SELECT value, 0 AS block, '  constant throughout: ' || concat_ws(', ', CASE WHEN one_k THEN 'k=' || k END, CASE WHEN one_type THEN 'type=' || type END) AS line FROM co WHERE one_k OR one_type "
    "UNION ALL SELECT own.value, 1, rtrim('  ' || rpad(CASE WHEN prev IS NOT NULL AND nullif(own.k, '') IS NOT NULL AND own.k <> prev THEN '!' ELSE '' END, 2, ' ') || strftime(event_time, '%H:%M:%S.%g') || '  ' || rpad(source, 20, ' ') || ' ' || rpad(name, 46, ' ') || ' ' || "
    "lpad(coalesce(" + WHOLE_MS.format(x="ms") + " || 'ms', ''), 8, ' ') || '  ' || concat_ws(' ', CASE WHEN NOT one_k THEN 'k=' || own.k END, CASE WHEN NOT one_type THEN 'type=' || source END)) FROM own JOIN co USING (value) WHERE n <= 60 "
    "UNION ALL SELECT value, 1, '  **' || strftime(event_time, '%H:%M:%S.%g') || '  ' || rpad('CHANGE ' || source, 20, ' ') || ' ' || source || ' ' || " + DETAIL + " FROM (SELECT ch.value, ev.event_time, ev.source, ev.k FROM ch JOIN ev ON ev.event_time BETWEEN ch.start_time AND ch.end_time AND ev.k = '7') "
    "UNION ALL SELECT value, 2, '  ... ' || (size - 60) || ' more records not shown' FROM co WHERE size > 60 "
    "UNION ALL SELECT value, 3, '  ! ' || traces || ' distinct trace identifiers: a search by one of them returns part of this journey' FROM co WHERE traces > 1"
)
def timeline_rows(spark, sf_dir):
    e = tables.with_changes(activity(spark, sf_dir))
    few = slices.shown(grouping.journeys(e, "day_key"))
    near = slices.changes_by_journey(few, slices.changes(e))
    return slices.timeline_lines(e, "day_key", few, near, "k_id").select("value", "block", "line")


# --- triage -------------------------------------------------------------------------------------------------


@registered(
    "WITH w AS (SELECT conv_id, turn, list_distinct(regexp_extract_all(lower(text), '[a-z]{4,}')) AS words, lag(list_distinct(regexp_extract_all(lower(text), '[a-z]{4,}'))) OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS before FROM conversations) "
    "SELECT conv_id, turn, len(words) = 0 OR (len(list_intersect(words, before)) > 0 AND len(list_intersect(words, before)) >= 0.6::DOUBLE * least(len(words), len(before))) AS repeated FROM w WHERE before IS NOT NULL"
)
def repeated_sentences(spark, sf_dir):
    from pyspark.sql import Window

    rows = tables.read(spark, sf_dir, "conversations")
    before = F.lag("text").over(Window.partitionBy("conv_id").orderBy("turn", "role", "text"))
    rows = rows.select("conv_id", "turn", "text", before.alias("before")).where("before is not null")
    return rows.select("conv_id", "turn", triage.repeats_words(F.col("text"), F.col("before")).alias("repeated"))


# --- JSON exports -------------------------------------------------------------------------------------------


def _files(spark, sf_dir) -> DataFrame:
    """(file_name, value): the tables as an export.  Orders by month as bare arrays with nested attributes and one record
    in ten without a time; suppliers wrapped in an object; customers without times; complaints; a broken file."""
    o = tables.read(spark, sf_dir, "orders")
    placed = F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    record = F.struct(
        F.when(F.col("o_orderkey") % 10 == 0, "not a time").otherwise(placed).alias("placed_at"),
        F.col("o_orderkey").alias("order_id"),
        F.when(F.col("o_orderkey") % 3 == 0, F.lit("")).otherwise(F.lit("shop")).alias("service"),
        F.col("o_orderpriority").alias("message"),
        F.col("o_totalprice").alias("total"),
        (F.col("o_orderstatus") == "F").alias("closed"),
        F.struct(F.col("o_custkey").alias("customerId"), F.col("o_orderstatus").alias("status"), F.lit("kept").alias("time")).alias("attributes"),
    )
    array = lambda: F.concat(F.lit("["), F.array_join(F.array_sort(F.collect_list("rec")), ","), F.lit("]"))
    months = o.select(F.concat(F.lit("orders-"), F.date_format("o_orderdate", "yyyy-MM"), F.lit("-accepts.json")).alias("file_name"), F.to_json(record).alias("rec")).groupBy("file_name").agg(array().alias("value"))
    s = tables.read(spark, sf_dir, "supplier").select(F.to_json(F.struct(F.col("s_suppkey").alias("supp_key"), F.lit("bad").alias("at"), F.lit("2024-05-06 07:08:09.123456Z").alias("seen_time"), F.col("s_name").alias("name"))).alias("rec"))
    wrapped = s.agg(F.concat(F.lit('{"count": 3, "empty": [], "rows": '), array(), F.lit("}")).alias("value")).select(F.lit("suppliers.json").alias("file_name"), "value")
    c = tables.read(spark, sf_dir, "customer").where("c_nationkey = 1").select(F.to_json(F.struct("c_custkey", F.lit("12:30").alias("time"), F.lit(5).alias("at"))).alias("rec"))
    timeless = c.agg(array().alias("value")).select(F.lit("customers.json").alias("file_name"), "value")
    n = tables.read(spark, sf_dir, "nation").select(F.to_json(F.struct(F.when(F.col("n_nationkey") % 2 == 0, F.col("n_name")).alias("from"), F.when(F.col("n_nationkey") % 5 != 0, F.concat(F.lit("complaint of "), "n_name")).alias("text"))).alias("rec"))
    told = n.agg(F.concat(F.lit('{"symptoms": '), array(), F.lit("}")).alias("value")).select(F.lit("symptoms.json").alias("file_name"), "value")
    broken = spark.createDataFrame([("broken.json", '[{"at": "2024-01-01T00:00:00Z"'), ("nothing.json", '{"rows": []}')], "file_name string, value string")
    return months.unionByName(wrapped).unionByName(timeless).unionByName(told).unionByName(broken)


def _export(spark, sf_dir) -> export.Export:
    return export.of_raw(export.unwrapped(_files(spark, sf_dir)))


@registered(
    "SELECT 'orders-' || strftime(o_orderdate, '%Y-%m') || '-accept' AS kind, CASE WHEN o_orderkey % 3 = 0 THEN 'orders-' || strftime(o_orderdate, '%Y-%m') || '-accept' ELSE 'shop' END AS source, o_orderpriority AS name, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S.%gZ') AS moment, "
    "'customerId=' || o_custkey || ' order_id=' || o_orderkey AS ids, 'closed:bool=' || CASE WHEN o_orderstatus = 'F' THEN 'True' ELSE 'False' END || ' status:str=' || o_orderstatus || ' time:str=kept total:float' AS attributes FROM orders WHERE o_orderkey % 10 <> 0 "
    "UNION ALL SELECT 'supplier', 'supplier', s_name, '2024-05-06T07:08:09.123Z', 'supp_key=' || s_suppkey, '' FROM supplier"
)
def export_events(spark, sf_dir):
    e = _export(spark, sf_dir).events
    said = lambda k: F.concat(k, F.lit(":"), F.col("attributes")[k]["t"], F.when(F.col("attributes")[k]["t"] != "float", F.concat(F.lit("="), F.col("attributes")[k]["s"])).otherwise(""))
    return e.select(
        "kind",
        "source",
        "name",
        scalars.format_time(F.col("event_time")).alias("moment"),
        F.concat_ws(" ", F.transform(F.array_sort(F.map_keys("ids")), lambda k: F.concat(k, F.lit("="), F.col("ids")[k]))).alias("ids"),
        F.concat_ws(" ", F.transform(F.array_sort(F.map_keys("attributes")), said)).alias("attributes"),
    )


@registered(
    "SELECT 'orders-' || strftime(o_orderdate, '%Y-%m') || '-accepts.json' AS file_name, count(*) AS records, count(*) FILTER (o_orderkey % 10 <> 0) AS parsed, "
    "CASE WHEN count(*) FILTER (o_orderkey % 10 <> 0) = 0 THEN 'no record has a time' WHEN count(*) FILTER (o_orderkey % 10 = 0) > 0 THEN 'some records have no time' END AS reason FROM orders GROUP BY 1 "
    "UNION ALL SELECT 'suppliers.json', count(*), count(*), NULL FROM supplier UNION ALL SELECT 'customers.json', count(*), 0, 'no record has a time' FROM customer WHERE c_nationkey = 1 "
    "UNION ALL SELECT 'broken.json', 0, 0, 'not readable as JSON' UNION ALL SELECT 'nothing.json', 0, 0, 'no list of records'"
)
def export_report(spark, sf_dir):
    return _export(spark, sf_dir).report


@registered("SELECT CASE WHEN n_nationkey % 2 = 0 THEN n_name ELSE 'unknown' END AS source, 'complaint of ' || n_name AS text FROM nation WHERE n_nationkey % 5 <> 0")
def export_symptoms(spark, sf_dir):
    return _export(spark, sf_dir).symptoms.select("source", "text")
