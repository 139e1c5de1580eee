"""Bytes of telemetry per message, and what keeping them costs."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

GB = 1024**3
# Assumptions, each of them a parameter below.
PER_DAY, HOT, WARM, SCAN_PER_TB = 2_000_000, 2.50, 0.023, 5.00
HOT_DAYS, WARM_DAYS, COLD_DAYS, REFRESHES = 7, 30, 395, 24


@dataclass(frozen=True)
class Rates:
    per_day: int = PER_DAY
    hot_gb_month: float = HOT
    warm_gb_month: float = WARM
    scan_per_tb: float = SCAN_PER_TB


#: Rows that a ledger keeps for a message, and the bytes of one.
LEDGER_ROWS, LEDGER_ROW_BYTES = 2, 160


def measure(raw: DataFrame) -> DataFrame:
    """The footprint of an export.  raw: (file_name, rec), the records' JSON text.

    Spans count as such; logs are scoped where they carry a trace or a correlation, else noise; accepted messages divide.
    """
    truthy = lambda path: ~F.coalesce(F.get_json_object("rec", path), F.lit("")).isin("", "false", "0", "[]", "{}")
    part = F.when(F.col("file_name") == "spans.json", "spans").when(truthy("$.trace_id") | truthy("$.attributes.correlation_id"), "scoped").otherwise("noise")
    held = raw.where(F.col("file_name").isin("spans.json", "logs.json") & F.col("rec").isNotNull())
    messages = raw.where((F.col("file_name") == "accepted_messages.json") & F.col("rec").isNotNull())
    return footprint(held.select(part.alias("part"), F.octet_length("rec").alias("bytes")), messages, LEDGER_ROWS * LEDGER_ROW_BYTES)


def footprint(records: DataFrame, messages: DataFrame, ledger_bytes: int) -> DataFrame:
    """records: (part: spans, scoped or noise; bytes).  One row: bytes per message of each part."""
    n = messages.agg(F.greatest(F.count("*"), F.lit(1)).alias("n"))
    sums = records.agg(*[F.coalesce(F.sum(F.when(F.col("part") == p, F.col("bytes"))), F.lit(0)).alias(p) for p in ("spans", "scoped", "noise")])
    return sums.crossJoin(F.broadcast(n)).select(*[(F.col(p) / F.col("n")).alias(p) for p in ("spans", "scoped", "noise")], F.lit(float(ledger_bytes)).alias("ledger"))


def monthly(bytes_per_day, days: int, rate: float):
    return bytes_per_day * F.lit(float(days)) / F.lit(float(GB)) * F.lit(rate)


def report(found: DataFrame, rates: Rates = Rates()) -> DataFrame:
    """(line, amount): storage untiered and tiered, and what scans cost that a ledger would answer."""
    d = F.lit(float(rates.per_day))
    every = (F.col("spans") + F.col("scoped") + F.col("noise")) * d
    useful = (F.col("spans") + F.col("scoped")) * d
    scan = every * WARM_DAYS / F.lit(float(1024**4)) * rates.scan_per_tb
    rows = {
        "telemetry_gb_per_day": every / GB,
        "useful_gb_per_day": useful / GB,
        "noise_share": F.col("noise") * d / every,
        "all_indexed_month": monthly(every, WARM_DAYS, rates.hot_gb_month),
        "hot_month": monthly(F.col("scoped") * d, HOT_DAYS, rates.hot_gb_month),
        "warm_month": monthly(useful, WARM_DAYS, rates.warm_gb_month),
        "cold_month": monthly(F.col("ledger") * d, COLD_DAYS, rates.warm_gb_month),
        "one_scan": scan,
        "dashboard_month": scan * REFRESHES * 30,
    }
    return found.select(F.explode(F.array(*[F.struct(F.lit(k).alias("line"), v.alias("amount")) for k, v in rows.items()])).alias("x")).select("x.*")
