"""Small inputs with known answers."""

import json
from datetime import UTC, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from wayfarer.functions import scalars
from wayfarer.operators import grouping, naming, quality, routing, slices, timing, triage
from wayfarer.operators.overview import analyse, overview
from wayfarer.schema import EVENT, raw_node
from wayfarer.sources import export

T0 = datetime(2026, 1, 1, tzinfo=UTC)


def event(ms, source, name, kind="span", ids=None, attributes=None, file="a", ordinal=0):
    typed = {k: ("str", v, None) if isinstance(v, str) else ("float", str(v), float(v)) for k, v in (attributes or {}).items()}
    return (T0 + timedelta(milliseconds=ms), source, name, kind, ids or {}, typed, file, ordinal)


def frame(spark, *rows):
    return spark.createDataFrame(list(rows), EVENT).withColumn("node", raw_node())


def write(folder, **files):
    for name, body in files.items():
        (folder / f"{name}.json").write_text(body if isinstance(body, str) else json.dumps(body))
    return str(folder)


def test_ingestion(spark, tmp_path):
    good = [{"accepted_at": "2026-01-01T00:00:00Z", "order_id": "o-1", "n": 4}, {"service": "x", "name": "y"}, "not a dict"]
    nested = {"rows": [{"at": "bad", "z_time": "2026-01-01T00:00:01Z", "source": "s", "service": "", "ok": True, "attributes": {"k_id": 7, "time": "t"}}]}
    e = export.load(spark, write(tmp_path, process=good, wrapped=nested, broken="{not json", symptoms={"symptoms": [{"text": "slow"}]}))
    rows = {r["file_name"]: r for r in e.events.collect()}
    first = rows["process.json"]
    assert (first["kind"], first["ids"], first["attributes"]["n"]["t"]) == ("proce", {"order_id": "o-1"}, "int")
    second = rows["wrapped.json"]
    assert (second["source"], second["ids"], second["attributes"]["ok"]["s"], second["attributes"]["time"]["s"]) == ("s", {"k_id": "7"}, "True", "t")
    report = {r["file_name"]: r["reason"] for r in e.report.collect()}
    assert report == {"process.json": "some records have no time", "wrapped.json": None, "broken.json": "not readable as JSON"}
    assert [tuple(r) for r in e.symptoms.select("source", "text").collect()] == [("unknown", "slow")]


def test_finding_an_export(tmp_path, spark):
    (tmp_path / "data").mkdir()
    write(tmp_path, baseline=[])
    write(tmp_path / "data", a=[], b=[])
    assert export.find_export(str(tmp_path)) == export.find_export(str(tmp_path), spark) == str(tmp_path / "data")
    assert export.find_export(f"file://{tmp_path}/", spark) == f"file://{tmp_path}/data"
    with pytest.raises(FileNotFoundError):
        export.find_export(str(tmp_path / "none"))


def test_collapse(spark):
    cases = {"POST /api/v1/messages": "POST /api/v1/messages", "fetch over h2 in 45ms": "fetch over h2 in {n}ms", "depth=0": "depth={n}", "/api/v10/x": "/api/v1{n}/x", "a@b.co deadbeef01": "{addr} {hex}"}
    rows = spark.createDataFrame(list(cases.items()), "a string, b string").select(scalars.collapse(F.col("a")).alias("c"), "b").collect()
    assert all(r["c"] == r["b"] for r in rows)


@pytest.mark.parametrize(("n", "p50", "p95"), [(2, 2, 2), (4, 2, 4), (8, 4, 8), (100, 50, 96)])
def test_percentile_rank(spark, n, p50, p95):
    r = timing.distributions(spark.range(1, n + 1).select(F.lit("x").alias("label"), F.col("id").cast("double").alias("ms"))).head()
    assert (r["p50"], r["p95"], r["reliable"]) == (p50, p95, n >= 8)


def test_few_samples_are_listed(spark):
    s = spark.createDataFrame([("x", 3.0), ("x", 1.0), ("x", 2.5)], "label string, ms double")
    assert timing.described(timing.distributions(s), s).head()["description"] == "3 samples: 1, 2, 3 ms (too few for percentiles)"


def test_paths_keep_revisits_and_order_by_file(spark):
    rows = [event(0, "a", "x", ids={"o": "1"}, file="z"), event(0, "b", "x", ids={"o": "1"}, file="a"), event(1, "a", "x", ids={"o": "1"}), event(2, "a", "x", ids={"o": "1"}), event(3, "b", "x", ids={"o": "1"}), event(4, "d", "x", "deploy", ids={"o": "1"})]
    routes = routing.described(routing.route_table(routing.paths(frame(spark, *rows), "o"))).head()
    assert routes["nodes"] == ["b:x", "a:x", "b:x"] and routes["repeats"] == ["b:x"] and routes["ends_at"] == "b:x"


def test_key_rules(spark):
    rows = [event(i, s, "x", ids={"event_id": str(i), "o_id": str(i // 4), "t_id": "one" if s == "a" else ""}) for i in range(16) for s in ("a", "b")]
    found = {r["key"]: r["disqualified"] for r in grouping.candidates(frame(spark, *rows)).collect()}
    assert found["event_id"] and not found["o_id"]
    assert grouping.choose_key(frame(spark, *rows)) == "o_id"
    assert grouping.choose_key(frame(spark)) is None


def test_predicates_may_split(spark):
    rows = [event(0, "a", "x", ids={"o": "1"}, attributes={"x": "1"}), event(1, "a", "x", ids={"o": "1"}, attributes={"y": "2"}), event(0, "a", "x", ids={"o": "2"}, attributes={"x": "1"})]
    assert [r["value"] for r in grouping.journeys_where(frame(spark, *rows), "o", [("x", "1"), ("y", "2")]).collect()] == ["1"]


def test_names(spark):
    rows = [event(i, "s", f"send {c} {i}", attributes={"channel": c}) for i, c in enumerate(["email", "sms", "push"] * 2)] + [event(9, "s", "once 7")]
    e = frame(spark, *rows)
    entries = naming.vocabulary_array(naming.learn_vocabulary(e))
    assert entries == [("email", "{channel}"), ("push", "{channel}"), ("sms", "{channel}")]
    labels = {r["label"] for r in naming.learn_names(e, naming.vocabulary_column(entries)).collect()}
    assert labels == {"send {channel} {n}", "once 7"}


def test_quality_limits_travel(spark):
    rows = [event(i, "a" if i % 2 else "b", "x", ids={"o_id": str(i // 4), "trace_id": str(i // 2)} if i < 20 else {}, attributes={"status": "OK"}) for i in range(40)]
    found = {r["id"]: r for r in quality.assess(frame(spark, *rows), "o_id").collect()}
    assert set(found) == {"Q.uninformative.status", "Q.no_failure_signal", "Q.unjoined_records", "Q.fragmented.trace_id"}
    assert all(r["limits"] for r in found.values())


def slice_of(spark, n=4, limit=1, **where):
    rows = [event(i * 1000 + j, s, "x", ids={"o": str(i)}) for i in range(n) for j, s in enumerate("ab")] + [event(50, "c", "x", ids={"o": "9"}), event(-45 * 60_000, "web", "deploy", "deploy", attributes={"service": "web"})]
    e = frame(spark, *rows)
    m = routing.paths(e, "o")
    return slices.take(e, "o", routing.journey_routes(m, routing.route_table(m)), slices.Filter(**where), limit)


def test_small_slices_ignore_the_limit(spark):
    assert len(slice_of(spark, route=1).shown) == 4 and len(slice_of(spark, n=9, limit=2, route=1).shown) == 2


def test_contrast_and_interval_edge(spark):
    found = slice_of(spark, values=("9",))
    assert found.contrast == "0" and found.changes == 0  # the deploy is 45 min and 50 ms before
    assert slice_of(spark, values=("0",)).changes == 1


def test_empty_slice(spark):
    assert slice_of(spark, values=("none",)).lines[-1] == "no journeys match"
    with pytest.raises(ValueError):
        slices.Filter(route=0)


def test_overview_and_stub(spark):
    rows = [event(i * 1000 + j, s, "step", ids={"o_id": f"job-{i}"}, attributes={"k": "push" if i > 5 else "email"}) for i in range(8) for j, s in enumerate("abc" if i < 6 else "ab")]
    a = analyse(frame(spark, *rows).drop("node"))
    shown = overview(a)
    assert shown["journeys"]["key"] == "o_id" and len(shown["routes"]["routes"]) == 2
    out = triage.triage("push messages stopped", a)
    assert out.source == "stub" and out.hypotheses[0].evidence_refs[0] == "route-2"
    assert triage.triage("entirely unrelated", a).verdict == "insufficient_evidence"
    assert len(json.dumps(shown)) < 30_000


def test_model_loop_and_gate(spark):
    rows = [event(i, s, "step", ids={"o_id": str(i // 2)}) for i in range(8) for s in "ab"]
    a = analyse(frame(spark, *rows).drop("node"))
    replies = iter([{"tool": "list_routes"}, {"tool": "no_such"}, {"text": 'So: {"hypotheses": [{"summary": "first thing happened", "evidence_refs": ["route-1"]}, {"summary": "made up", "evidence_refs": ["route-99"]}]} done'}])
    out = triage.triage("?", a, lambda messages, tools: next(replies))
    assert [h.summary for h in out.hypotheses] == ["first thing happened"] and out.tool_calls == 2 and len(out.rejections) == 2


def test_duplicates_merge():
    index = triage.SliceIndex()
    index.add(["a-1", "sha=c52a0f9"])
    raw = {"hypotheses": [{"summary": "push provider never answered", "evidence_refs": ["a-1"], "alternative": "x"}, {"summary": "the push provider never answered them", "evidence_refs": ["c52a0f9"]}]}
    out = triage.validate(raw, index, ["alerting cannot fire"])
    assert out.hypotheses[0].evidence_refs == ["a-1", "c52a0f9"] and out.limits_unaddressed == ["alerting cannot fire"]
    for reply in ('{"a": 1}', 'text {not} {"a": 1} more }', '```json\n{"a": 1}\n```'):
        assert triage.extract_json(reply) == {"a": 1}
    with pytest.raises(triage.TriageError):
        triage.extract_json("nothing")
