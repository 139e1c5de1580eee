"""JSON exports: a directory of files, each an array of records or an object that wraps one."""

from __future__ import annotations

from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import parse_time

# Fixed values of the classification by field name.
TIME_KEYS = ("timestamp", "start_time", "time", "at")
TIME_SUFFIX = "(_at|_time|_timestamp|_ts)$"
SOURCE_KEYS = ("service", "source", "component", "app", "logger", "emitter")
NAME_KEYS = ("name", "message", "event", "operation", "title", "msg")
ID_SUFFIX = "(_id|Id|_key|_uuid)$"
ANCHORS = ("spans.json", "logs.json")
SYMPTOMS = "symptoms.json"


@dataclass
class Export:
    events: DataFrame
    symptoms: DataFrame
    report: DataFrame
    directory: str


def _names(spark: SparkSession | None, place: str) -> list[str] | None:
    """File names in a folder, of any store that Spark reads where a session is given; None if there is no such folder."""
    if spark is None:
        at = Path(place)
        return [p.name for p in at.iterdir() if p.is_file()] if at.is_dir() else None
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(place)
    store = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not store.exists(at) or not store.getFileStatus(at).isDirectory():
        return None
    return [f.getPath().getName() for f in store.listStatus(at) if f.isFile()]


def find_export(start: str, spark: SparkSession | None = None) -> str:
    """The deepest of start, start/data, start/data/data with an anchor file, else with several JSON files."""
    root = start.rstrip("/") or "/"
    places = [(p, n) for p in (f"{root}/data/data", f"{root}/data", root) if (n := _names(spark, p)) is not None]
    for enough in (lambda names: any(a in names for a in ANCHORS), lambda names: sum(n.endswith(".json") for n in names) > 1):
        for place, names in places:
            if enough(names):
                return place
    raise FileNotFoundError(f"no JSON export below {start}")


def _array(*words: str) -> str:
    return "array(" + ", ".join(f"'{w}'" for w in words) + ")"


def raw_records(spark: SparkSession, directory: str) -> DataFrame:
    """(file_name, readable, ordinal, rec): each element's JSON text with its keys in order; rec is null for files
    without records, which still give a row for the report."""
    return unwrapped(spark.read.text(f"{directory}/*.json", wholetext=True).withColumn("file_name", F.col("_metadata.file_name")))


def unwrapped(files: DataFrame) -> DataFrame:
    """The same of (file_name, value), value being a file's whole text."""
    wrapped = (
        "get(filter(transform(json_object_keys(value), k -> from_json(get_json_object(value, concat('$[\\'', k, '\\']')), 'array<string>')),"
        " a -> size(a) > 0 and ltrim(a[0]) like '{%'), 0)"
    )
    records = F.when(F.ltrim("value").startswith("["), F.expr("from_json(value, 'array<string>')")).otherwise(F.expr(wrapped))
    files = files.withColumn("readable", F.expr("try_parse_json(value) is not null")).withColumn("records", F.when(F.col("readable"), records))
    return files.select("file_name", "readable", F.posexplode_outer("records").alias("ordinal", "rec"))


def _fields(record: str) -> str:
    """array<struct<k,t,s>> of a JSON object's text: keys in their order, of equal keys the last value, no nulls.

    The record is parsed twice, whatever its number of keys: as text, and as variants, which only tell the types.
    """
    kind = (
        "case when y is null or y = 'VOID' then null when y = 'STRING' then 'str' when y = 'BOOLEAN' then 'bool' when y like 'OBJECT%' then 'object' "
        "when y like 'ARRAY%' then 'json' when e.value rlike '^-?[0-9]+$' then 'int' else 'float' end"
    )
    types = f"transform(map_values(from_json({record}, 'map<string,variant>')), v -> schema_of_variant(v))"
    each = f"zip_with(map_entries(from_json({record}, 'map<string,string>')), {types}, (e, y) -> named_struct('k', e.key, 't', {kind}, 's', e.value))"
    last = "transform(array_distinct(transform(own, f -> f.k)), k -> element_at(filter(own, f -> f.k = k), -1))"
    once = f"transform(array({each}), own -> if(size(array_distinct(transform(own, f -> f.k))) = size(own), own, {last}))[0]"
    return f"filter({once}, f -> f.t is not null)"


def normalise(raw: DataFrame) -> DataFrame:
    """raw: (file_name, ordinal, rec).  One row per record; event_time is null where no field gives a time.

    Keys are classified by name and by their order in the record; the typed view of the record decides only types.
    """
    kind = F.regexp_replace(F.regexp_replace("file_name", r"\.json$", ""), "s+$", "")
    rows = raw.where("ltrim(rec) like '{%'").withColumn("kind", kind).withColumn("fields", F.expr(_fields("rec")))
    rows = rows.withColumn("inner", F.expr("get(filter(fields, f -> f.k = 'attributes' and f.t = 'object'), 0).s"))
    rows = rows.withColumn("nested", F.expr(f"coalesce({_fields('inner')}, filter(fields, f -> false))"))
    moment = "case when f.t = 'str' and f.s rlike '^\\\\d{4}-\\\\d{2}-\\\\d{2}([T ]\\\\d{2}:\\\\d{2}.*)?$' then try_to_timestamp(f.s) end"
    fixed = f"flatten(transform({_array(*TIME_KEYS)}, k -> filter(fields, f -> f.k = k)))"
    suffixed = f"filter(fields, f -> f.k rlike '{TIME_SUFFIX}' and not array_contains({_array(*TIME_KEYS)}, f.k))"
    rows = rows.withColumn("event_time", F.expr(f"get(filter(transform(concat({fixed}, {suffixed}), f -> {moment}), x -> x is not null), 0)"))
    text = "case when f.t = 'bool' then initcap(f.s) else f.s end"
    truthy = "f.s <> '' and not (f.t <> 'str' and f.s in ('0', '0.0', 'false', '[]', '{}'))"
    for out, keys in (("source", SOURCE_KEYS), ("name", NAME_KEYS)):
        rows = rows.withColumn(out, F.expr(f"coalesce(get(transform(filter(flatten(transform({_array(*keys)}, k -> filter(fields, f -> f.k = k))), f -> {truthy}), f -> {text}), 0), kind)"))
    spent = f"array_contains({_array(*TIME_KEYS, *SOURCE_KEYS, *NAME_KEYS)}, f.k) or f.k rlike '{TIME_SUFFIX}'"
    # The nested fields stand where their object stood in the record, so that the later of two equal keys wins.
    rows = rows.withColumn("rest", F.expr(f"flatten(transform(filter(fields, f -> not ({spent})), f -> if(f.k = 'attributes' and f.t = 'object', nested, array(f))))"))
    entry = "named_struct('t', if(f.t = 'object', 'json', f.t), 's', {text}, 'n', case when f.t in ('int', 'float') then try_cast(f.s as double) when f.t = 'bool' then if(f.s = 'true', 1D, 0D) end)".format(text=text)
    last = "transform(array_distinct(transform({own}, f -> f.k)), k -> transform(slice(filter({own}, f -> f.k = k), -1, 1), f -> struct(f.k, {to}))[0])"
    ids, others = f"filter(rest, f -> f.k rlike '{ID_SUFFIX}')", f"filter(rest, f -> not (f.k rlike '{ID_SUFFIX}'))"
    rows = rows.withColumn("ids", F.expr(f"map_from_entries({last.format(own=ids, to=text)})"))
    rows = rows.withColumn("attributes", F.expr(f"map_from_entries({last.format(own=others, to=entry)})"))
    return rows.select("event_time", "source", "name", "kind", "ids", "attributes", "file_name", F.col("ordinal").cast("bigint").alias("ordinal"))


def load(spark: SparkSession, directory: str) -> Export:
    """Events, the symptoms beside them, and a report for every file (also of partial losses)."""
    return of_raw(raw_records(spark, directory), directory)


def of_raw(raw: DataFrame, directory: str = "") -> Export:
    telemetry = raw.where(F.col("file_name") != SYMPTOMS)
    parsed = normalise(telemetry)
    events = parsed.where(F.col("event_time").isNotNull())
    counts = parsed.groupBy("file_name").agg(F.count("event_time").alias("parsed"))
    report = telemetry.groupBy("file_name").agg(F.count("rec").alias("records"), F.bool_and("readable").alias("readable")).join(counts, "file_name", "left")
    reason = F.when(~F.col("readable"), "not readable as JSON").when(F.col("records") == 0, "no list of records").when(F.col("parsed") == 0, "no record has a time").when(F.col("parsed") < F.col("records"), "some records have no time")
    report = report.select("file_name", "records", F.coalesce("parsed", F.lit(0)).alias("parsed"), reason.alias("reason"))
    told = raw.where((F.col("file_name") == SYMPTOMS) & F.col("rec").isNotNull())
    symptoms = told.select(F.coalesce(F.get_json_object("rec", "$.from"), F.lit("unknown")).alias("source"), F.get_json_object("rec", "$.text").alias("text"), "ordinal").where("text is not null")
    return Export(events, symptoms, report, directory)


def read_platform_notes(path: str | None) -> str:
    return Path(path).read_text() if path and Path(path).is_file() else ""


def write_events(events: DataFrame, path: str) -> None:
    """Normalised events, by day, so that later reads prune; a day with many events is written by several tasks."""
    events.withColumn("day", F.to_date("event_time")).repartitionByRange("day", "event_time").write.mode("overwrite").partitionBy("day").parquet(path)


__all__ = ["Export", "find_export", "load", "normalise", "parse_time", "raw_records", "read_platform_notes", "write_events"]
