"""What is wrong with the input, and what that stops anyone from concluding."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schema import ORDER, with_value

# Fixed values of the checks.
MIN_OBSERVATIONS = 20
UNJOINED_SHARE = 0.2
FAILURE_HINTS = ("error", "err", "fail", "failed", "failure", "fatal", "critical", "panic", "exception", "timeout", "rejected", "denied", "aborted", "cancelled")
SEVERITY_NAME_HINTS = ("level", "severity", "status", "state", "result", "outcome")
HEALTHY = ("ok", "success", "healthy", "0", "0.0")
NOT_JOURNEY_SCOPED = ("span_id", "parent_span_id", "event_id", "record_id")

DEFECT = "check int, id string, title string, limits array<string>, evidence array<string>, affected array<string>, would_resolve array<string>"


def field_values(events: DataFrame) -> DataFrame:
    """(key, t, canon, s, c): counts of attribute values.  Numbers and booleans of equal value are one value, as
    1, 1.0 and True are in the language the exports come from; nested values are not profiled."""
    long = events.select(F.explode("attributes").alias("key", "v")).where(F.col("v.t") != "json")
    number = F.col("v.t").isin("int", "float", "bool")
    canon = F.when(number, F.concat(F.lit("n:"), F.coalesce(F.col("v.n"), F.lit(0.0)).cast("string"))).otherwise(F.concat(F.lit("s:"), F.col("v.s")))
    return long.groupBy("key", canon.alias("canon")).agg(F.min("v.s").alias("s"), F.bool_and(~number).alias("text"), F.count("*").alias("c"))


def constant_fields(values: DataFrame) -> DataFrame:
    """(key, only, observations, looks_healthy) of fields with one value in twenty or more records."""
    out = values.groupBy("key").agg(F.count("*").alias("d"), F.sum("c").alias("observations"), F.min("s").alias("only"))
    return out.where((F.col("d") == 1) & (F.col("observations") >= MIN_OBSERVATIONS)).select("key", "only", "observations", F.lower(F.trim("only")).isin(*HEALTHY).alias("looks_healthy"))


def failure_signal(events: DataFrame, values: DataFrame) -> DataFrame:
    """One row: records, whether any text value says that something failed, and whether the check fires."""
    said = values.where(F.col("text")).agg(F.coalesce(F.bool_or(F.lower(F.trim("s")).isin(*FAILURE_HINTS)), F.lit(False)).alias("signal"))
    n = events.agg(F.count("*").alias("records"))
    return n.crossJoin(F.broadcast(said)).withColumn("fires", ~F.col("signal") & (F.col("records") >= MIN_OBSERVATIONS))


def enum_shaped_fields(values: DataFrame) -> DataFrame:
    """(key, seen, hinted): text fields of two to eight values; those named like a severity come first."""
    # Fields with more values are dropped before their values would be gathered.
    few = values.groupBy("key").agg(F.count("*").alias("d"), F.sum("c").alias("n"), F.bool_and("text").alias("text")).where((F.col("d") >= 2) & (F.col("d") <= 8) & (F.col("n") >= MIN_OBSERVATIONS) & F.col("text")).select("key")
    out = values.join(few, "key", "left_semi").groupBy("key").agg(F.array_sort(F.collect_set("s")).alias("seen"))
    hinted = F.lit(False)
    for hint in SEVERITY_NAME_HINTS:
        hinted = hinted | F.contains(F.lower("key"), F.lit(hint))
    return out.withColumn("hinted", hinted)


def enum_evidence(values: DataFrame, most: int = 4) -> DataFrame:
    return enum_shaped_fields(values).orderBy(~F.col("hinted"), "key").limit(most)


def unjoined_by(events: DataFrame, key: str, column: str, most: int) -> DataFrame:
    """The most frequent values of a column among records that lack the key; ties as they first appear."""
    lost = events.where(F.col("ids")[key].isNull())
    return lost.groupBy(column).agg(F.count("*").alias("records"), F.min(F.struct(*ORDER)).alias("first")).orderBy(F.desc("records"), "first", column).limit(most).select(column, "records")


def other_keys(events: DataFrame, key: str) -> DataFrame:
    rows = with_value(events, key)
    return rows.select("value", *ORDER, "source", "name", F.explode("ids").alias("other_key", "other")).where((F.col("other_key") != key) & ~F.col("other_key").isin(*NOT_JOURNEY_SCOPED))


def fragmentation(events: DataFrame, key: str) -> DataFrame:
    """(other_key, carrying, broken): journeys that carry another identifier, and those that carry several of it."""
    distinct = other_keys(events, key).select("other_key", "value", "other").distinct()
    per = distinct.groupBy("other_key", "value").agg(F.count("*").alias("n"))
    out = per.groupBy("other_key").agg(F.count("*").alias("carrying"), F.count_if(F.col("n") > 1).alias("broken"))
    return out.where(F.col("broken") > 0)


def fragment_breaks(events: DataFrame, key: str) -> DataFrame:
    """(other_key, node, breaks): where later values of another identifier first appear.  First appearances are an
    aggregate; only they, not the events, are ranked within a journey."""
    at = F.struct(*ORDER, "source", "name")
    firsts = other_keys(events, key).groupBy("other_key", "value", "other").agg(F.min(at).alias("at"))
    w = Window.partitionBy("other_key", "value").orderBy("at")
    later = firsts.withColumn("k", F.row_number().over(w)).where("k > 1")
    return later.groupBy("other_key", F.concat_ws(":", "at.source", "at.name").alias("node")).agg(F.count("*").alias("breaks"), F.min("at").alias("first"))


def _some(rows: DataFrame, line: Column, order: Column, by: str | None = None) -> DataFrame:
    listed = F.transform(F.array_sort(F.collect_list(F.struct(order.alias("o"), line.alias("l")))), lambda x: x["l"])
    return (rows.groupBy(by) if by else rows.groupBy()).agg(listed.alias("lines"))


def assess(events: DataFrame, key: str | None) -> DataFrame:
    """All defects (DEFECT), in the order of the checks.  Every defect says what it prevents."""
    values = field_values(events)
    none = F.array().cast("array<string>")
    q, only = F.concat(F.lit("`"), F.col("key"), F.lit("`")), F.concat(F.lit("'"), F.col("only"), F.lit("'"))
    n = F.format_number("observations", 0)
    c = constant_fields(values)
    constants = c.select(
        F.lit(1).alias("check"),
        F.concat(F.lit("Q.uninformative."), "key").alias("id"),
        F.concat(q, F.lit(" never varies: recorded, but it measures nothing")).alias("title"),
        F.array_compact(
            F.array(
                F.concat(q, F.lit(" is "), only, F.lit(" in all "), n, F.lit(" records that carry it: it separates nothing, and no alert on it can fire")),
                F.when(F.col("looks_healthy"), F.concat(F.lit("a healthy-looking "), q, F.lit(" is no evidence that anything worked: it would read the same if all had failed"))),
            )
        ).alias("limits"),
        F.array(F.concat(n, F.lit(" observations, 1 distinct value: "), only)).alias("evidence"),
        none.alias("affected"),
        F.array(F.concat(F.lit("whether "), q, F.lit(" is set where it is emitted, or fixed in code"))).alias("would_resolve"),
    )
    shaped = _some(enum_evidence(values), F.concat(F.lit("`"), "key", F.lit("` only takes ["), F.concat_ws(", ", "seen"), F.lit("]")), F.struct(~F.col("hinted"), F.col("key")))
    f = failure_signal(events, values).where("fires").crossJoin(F.broadcast(shaped))
    silent = f.select(
        F.lit(2).alias("check"),
        F.lit("Q.no_failure_signal").alias("id"),
        F.lit("nothing in this data ever reports a failure").alias("title"),
        F.array(F.lit("no finding can rest on an error signal, since there is none: only on structure, absence and timing"), F.lit("alerting on error status or log level sees nothing in this window")).alias("limits"),
        F.concat(F.array(F.concat(F.lit("0 of "), F.format_number("records", 0), F.lit(" records carry any of: " + ", ".join(sorted(FAILURE_HINTS)[:6]) + ", ..."))), "lines").alias("evidence"),
        none.alias("affected"),
        F.array(F.lit("whether failures are caught before they reach telemetry")).alias("would_resolve"),
    )
    out = constants.unionByName(silent)
    if key is None:
        return out
    share = events.agg(F.count_if(F.col("ids")[key].isNull()).alias("u"), F.count("*").alias("r")).where((F.col("r") > 0) & (F.col("u") / F.col("r") >= UNJOINED_SHARE))
    sources = _some(unjoined_by(events, key, "source", 5), F.concat("source", F.lit(": "), F.format_number("records", 0)), F.struct(-F.col("records"), F.col("source")))
    names = _some(unjoined_by(events, key, "name", 4), F.concat(F.format_number("records", 0), F.lit(" records named '"), "name", F.lit("'")), F.struct(-F.col("records"), F.col("name")))
    s = share.crossJoin(F.broadcast(sources.withColumnRenamed("lines", "by_source"))).crossJoin(F.broadcast(names))
    percent = F.concat(F.format_string("%.0f", F.rint(100 * F.col("u") / F.col("r"))), F.lit("%"))
    lost = s.select(
        F.lit(3).alias("check"),
        F.lit("Q.unjoined_records").alias("id"),
        F.concat(percent, F.lit(f" of all records carry no `{key}` and join to nothing")).alias("title"),
        F.array(F.concat(percent, F.lit(" of this data supports claims about volume only, never about one journey")), F.lit("a search by identifier misses those records, however relevant")).alias("limits"),
        F.concat(F.array(F.concat(F.lit("by source: "), F.concat_ws(", ", "by_source"))), "lines").alias("evidence"),
        none.alias("affected"),
        F.array(F.lit(f"why these are emitted without `{key}`: outside of a request, or with its context lost")).alias("would_resolve"),
    )
    frag = fragmentation(events, key)
    ranked = fragment_breaks(events, key).withColumn("k", F.row_number().over(Window.partitionBy("other_key").orderBy(F.desc("breaks"), "first"))).where("k <= 3")
    where = _some(ranked, F.concat("node", F.lit(": "), F.col("breaks").cast("string")), F.col("k"), "other_key")
    hurt = other_keys(events, key).select("other_key", "value", "other").distinct().groupBy("other_key", "value").agg(F.count("*").alias("n")).where("n > 1")
    # Five exemplars, by rank within the key over first values only.
    shown = hurt.withColumn("k", F.row_number().over(Window.partitionBy("other_key").orderBy("value"))).where("k <= 5")
    hit = _some(shown, F.col("value"), F.col("k"), "other_key").withColumnRenamed("lines", "affected")
    g = frag.join(where, "other_key", "left").join(hit, "other_key", "left")
    o = F.concat(F.lit("`"), F.col("other_key"), F.lit("`"))
    broken = g.select(
        F.lit(4).alias("check"),
        F.concat(F.lit("Q.fragmented."), "other_key").alias("id"),
        F.concat(o, F.format_string(" changes within %d of %d journeys", "broken", "carrying")).alias("title"),
        F.array(F.concat(F.lit("in these journeys "), o, F.lit(" reaches part of the path: whatever is keyed on it shows a fragment and does not say so"))).alias("limits"),
        F.array(F.format_string("%d/%d journeys fragment", "broken", "carrying"), F.concat(F.lit("later values first appear at "), F.concat_ws(", ", "lines"))).alias("evidence"),
        F.coalesce("affected", none).alias("affected"),
        F.array(F.lit("how context is passed on there, compared with a path that keeps one value")).alias("would_resolve"),
    )
    return out.unionByName(lost).unionByName(broken)


def limits(defects: DataFrame) -> DataFrame:
    """(limit): each once, in order of first mention."""
    long = defects.select("check", "id", F.posexplode("limits").alias("pos", "limit"))
    return long.groupBy("limit").agg(F.min(F.struct("check", "id", "pos")).alias("at")).orderBy("at").select("limit")


def payload(defects: DataFrame, most: int = 5) -> DataFrame:
    """JSON per defect; empty lists are left out."""
    keep = lambda c: F.when(F.size(c) > 0, F.slice(c, 1, most))
    return defects.select("check", "id", F.to_json(F.struct(F.col("id").alias("defect"), "title", F.when(F.size("limits") > 0, F.col("limits")).alias("limits"), keep("evidence").alias("evidence"), keep("affected").alias("affected_journeys"), keep("would_resolve").alias("would_resolve"))).alias("json"))
