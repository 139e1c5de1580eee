"""All views of one export, lazily, over events that are normalised and cached once."""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from . import grouping, naming, quality, routing, timing


@dataclass
class Analysis:
    events: DataFrame  # with node
    key: str | None
    paths: DataFrame | None
    routes: DataFrame | None
    membership: DataFrame | None
    defects: DataFrame
    durations: DataFrame
    vocabulary: list[tuple[str, str]]
    names: DataFrame

    held: DataFrame | None = None  # what is persisted

    def release(self) -> None:
        if self.held is not None:
            self.held.unpersist()

    @property
    def limits(self) -> list[str]:
        return [r["limit"] for r in quality.limits(self.defects).collect()]


def analyse(events: DataFrame, key: str | None = None) -> Analysis:
    """Two small driver steps (the vocabulary, the key); everything else stays a plan."""
    events = events.persist(StorageLevel.MEMORY_AND_DISK)
    entries = naming.vocabulary_array(naming.learn_vocabulary(events))
    vocabulary = naming.vocabulary_column(entries)
    names = naming.learn_names(events, vocabulary)
    noded = naming.with_nodes(events, names, vocabulary)
    key = grouping.choose_key(events, key)
    paths = routes = membership = None
    if key:
        paths = routing.paths(noded, key)
        routes = routing.route_table(paths)
        membership = routing.journey_routes(paths, routes)
    return Analysis(noded, key, paths, routes, membership, quality.assess(noded, key), timing.node_durations(noded), entries, names, events)


def overview(a: Analysis, limit: int | None = None) -> dict:
    """The opening payload: bounded by the routes that it shows and by defects, not by traffic."""
    bounds = a.events.agg(F.date_format(F.min("event_time"), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'").alias("a"), F.date_format(F.max("event_time"), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'").alias("b"), F.count("*").alias("n"), F.array_sort(F.collect_set("source")).alias("s"), F.array_sort(F.collect_set("kind")).alias("k")).head()
    found = grouping.ranked_candidates(grouping.candidates(a.events)).collect()
    share = grouping.unjoined_share(a.events, a.key).head()
    routes = routing.described_table(a.routes, a.membership, dict(a.vocabulary), a.names, limit or routing.SHOWN) if a.key else {"routes": []}
    return {
        "window": {"from": bounds["a"], "to": bounds["b"]} if bounds["n"] else None,
        "records": bounds["n"],
        "services": bounds["s"],
        "record_kinds": bounds["k"],
        "journeys": {
            "key": a.key,
            "count": a.paths.count() if a.key else 0,
            "unjoined_records": share["unjoined"],
            "key_candidates": [{"key": c["key"], "coverage": round(c["coverage"], 3), "groups": c["groups"], "sources_per_group": round(c["sources_per_group"], 1), "median_group_size": c["median_group_size"], "disqualified": c["disqualified"]} for c in found],
        },
        "routes": routes,
        "timing": timing.table(a.events, a.key),
        "input_quality": {"defects": [json.loads(r["json"]) for r in quality.payload(a.defects).orderBy("check", "id").collect()]},
    }
