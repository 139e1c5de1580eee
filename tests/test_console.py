"""The console, the Parquet sink, the ledger and the answerer's edges."""

import json
from datetime import UTC, datetime

import pytest
from pyspark.sql import functions as F

from wayfarer import cli
from wayfarer.operators import cost, routing, slices, triage
from wayfarer.operators.overview import analyse, overview
from wayfarer.sources import export
from wayfarer.streaming import ledger


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    """Twelve messages; the last two are never delivered."""
    at = tmp_path_factory.mktemp("export")
    accepted = [{"accepted_at": f"2026-01-01T00:{i:02d}:00Z", "message_id": f"m-{i}", "service": "gate", "name": "accept"} for i in range(12)]
    spans = [{"start_time": f"2026-01-01T00:{i:02d}:0{k}Z", "message_id": f"m-{i}", "trace_id": f"t-{i}-{k}", "service": s, "name": "handle", "duration_ms": 5 * k} for i in range(12) for k, s in ((1, "queue"), (2, "provider")) if i < 10 or k == 1]
    logs = [{"time": "2026-01-01T00:30:00Z", "service": "noise", "message": "tick"}, {"time": "2026-01-01T00:31:00Z", "service": "queue", "trace_id": "t", "message": "scoped"}]
    deploys = [{"at": "2026-01-01T00:10:30Z", "service": "provider", "name": "deploy provider", "sha_id": "c0ffee1"}]
    for name, rows in {"accepted_messages": accepted, "spans": spans, "logs": logs, "deploys": deploys, "symptoms": {"symptoms": [{"from": "a user", "text": "provider never answered"}]}}.items():
        (at / f"{name}.json").write_text(json.dumps(rows))
    return str(at)


def run(capsys, folder, *words):
    code = cli.main(["--data", folder, *words])
    return code, capsys.readouterr().out


def test_commands_and_exit_codes(spark, folder, capsys, tmp_path):
    assert run(capsys, str(tmp_path), "quality")[0] == 2
    assert run(capsys, folder, "quality", "--quiet")[0] == 0
    code, out = run(capsys, folder, "routes", "--limit", "3")
    assert code == 0 and "message_id" in out and "USED" in out
    shown = json.loads(run(capsys, folder, "routes", "--json")[1])
    assert [r["journeys"] for r in shown["routes"]] == [10, 2] and shown["total_journeys"] == 12 and shown["note"]
    code, out = run(capsys, folder, "slice", "--route", "2", "--after", "2026-01-01T00:00:00Z")
    assert code == 0 and "m-10" in out and "contrast" in out
    assert run(capsys, folder, "slice", "--where", "trace_id=none")[0] == 1
    assert run(capsys, folder, "trace", "m-3")[0] == 0 and run(capsys, folder, "trace", "m-99")[0] == 1
    code, out = run(capsys, folder, "ask", "--symptom", "1", "--stub")
    assert code == 0 and "provider never answered" in out
    assert run(capsys, folder, "ask", "--symptom", "7")[0] == 1
    for bad in (["slice", "--where", "novalue"], ["slice", "--after", "soon"], ["ask", "x", "--model", "nowhere:nothing"]):
        with pytest.raises(SystemExit):
            cli.main(["--data", folder, *bad])


def test_cost_command(spark, folder, capsys):
    code, out = run(capsys, folder, "cost", "--per-day", "1000", "--hot-gb-month", "5")
    lines = dict(x.split() for x in out.splitlines())
    assert code == 0 and float(lines["noise_share"]) > 0
    raw = export.raw_records(spark, folder)
    row = cost.measure(raw).head()
    size = lambda name, keep: sum(len(r["rec"]) for r in raw.where(F.col("file_name") == name).collect() if keep(r["rec"]))
    assert row["spans"] == size("spans.json", bool) / 12 and row["noise"] == size("logs.json", lambda r: "trace_id" not in r) / 12 and row["ledger"] == 320


class RateLimitError(Exception):
    pass


def model_for_tests(effort):
    replies = iter([{"tool": "get_slice", "arguments": {"journeys": ["m-11"]}}, {"text": json.dumps({"hypotheses": [{"summary": f"effort {effort} stops early", "evidence_refs": ["m-11"], "alternative": "x"}]})}])
    return lambda messages, tools: next(replies)


def failing_model(effort):
    def model(messages, tools):
        raise RateLimitError("slow down")

    return model


def test_a_named_model_answers(spark, folder, capsys):
    code, out = run(capsys, folder, "ask", "what stopped?", "--model", f"{__name__}:model_for_tests", "--effort", "high")
    assert code == 0 and "effort high stops early" in out and "m-11" in out
    code, out = run(capsys, folder, "ask", "what stopped?", "--model", f"{__name__}:failing_model")
    assert code == 1 and "come back later" in out
    with pytest.raises(ZeroDivisionError):
        triage.asked(lambda m, t: 1 / 0, [])


def test_what_becomes_citable(spark, folder):
    e = export.load(spark, folder)
    a = analyse(e.events, "message_id")
    shown, index = overview(a), triage.SliceIndex()
    index.add_overview(shown)
    assert index.knows("route-2") and index.knows("message_id=m-10") and not index.knows("m-5")
    box = triage.ToolBox(a, index)
    box.run("get_slice", {"route": 1, "before": "2026-01-01T01:00:00Z"})
    assert index.knows("m-5") and index.knows("key=m-9")  # matched, though three are shown
    assert not index.knows("journey") and not index.knows("records") and not index.knows("=")
    facts = json.loads(box.run("get_journey", {"value": "m-10"}))
    assert (facts["records"], facts["services"], facts["distinct_trace_ids"], facts["route"]) == (2, ["gate", "queue"], 1, 2)
    assert index.knows("provider") and index.knows("sha_id=c0ffee1") == index.knows("c0ffee1")
    assert len(json.loads(box.run("get_journey", {"value": "none"}))["for_example"]) == 5
    assert "error" in json.loads(box.run("get_slice", {"after": "soon"})) and "error" in json.loads(box.run("drop", {}))
    fresh = triage.SliceIndex()
    triage.ToolBox(a, fresh).run("list_routes", {})
    assert fresh.knows("m-7") and fresh.knows("route-1")
    a.release()


def test_gate_agrees_with_its_bulk_form(spark):
    refs = ["jürgen-7", "٣٤٥x", "a b c", "ab", "k=é1", "-abc", "plain.ref"]
    index = triage.SliceIndex()
    index.add(["jürgen-7", "é1", "٣٤٥x"])
    claims = spark.createDataFrame([(str(i), r) for i, r in enumerate(refs)], "claim string, ref string")
    bulk = {r["claim"]: r["reason"] for r in triage.citation_rejections(claims, spark.createDataFrame([(r,) for r in index.refs], "ref string")).collect()}
    assert bulk == {str(i): why for i, r in enumerate(refs) if (why := triage.judge_refs([r], index)[0])}


def test_repeats_words(spark):
    pairs = [("push provider never answered", "the push provider never answered them"), ("one two", "one two"), ("alpha beta gamma delta", "alpha something entirely different here"), ("", "word here"), ("words here", "")]
    rows = spark.createDataFrame(pairs, "a string, b string").select(triage.repeats_words(F.col("a"), F.col("b")).alias("r")).collect()
    assert [r["r"] for r in rows] == [triage.already_said(a, [b]) for a, b in pairs]


def test_events_written_by_day(spark, folder, tmp_path):
    e = export.load(spark, folder).events
    export.write_events(e, str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == e.count() and (tmp_path / "out" / "day=2026-01-01").is_dir()


def test_changes_meet_long_and_short_journeys(spark):
    at = lambda s: datetime.fromtimestamp(s, UTC)
    spans = [(f"j{i}", at(i * 10_000), at(i * 10_000 + n)) for i, n in enumerate((0, 60, 7_200, 200_000, 9_000_000, 500_000_000))]
    found = [(at(s), "f", k, "web", "deploy") for k, s in enumerate(range(0, 600_000_000, 7_777_777))] + [(at(s), "f", 1000 + s, "web", "d") for s in range(0, 60_000, 601)]
    near = slices.changes_by_journey(spark.createDataFrame(spans, "value string, start_time timestamp, end_time timestamp"), spark.createDataFrame(found, "event_time timestamp, file_name string, ordinal bigint, target string, what string"))
    got = sorted((r["value"], r["ordinal"], r["inline"]) for r in near.collect())
    want = sorted((v, c[2], a <= c[0] <= b) for v, a, b in spans for c in found if a.timestamp() - 2700 <= c[0].timestamp() <= b.timestamp() + 2700)
    assert got == want


def test_paths_over_days(spark):
    rows = [("1", at, "s", n, k) for k, (at, n) in enumerate([("2026-01-01 23:59:59", "a"), ("2026-01-02 00:00:01", "a"), ("2026-01-02 00:00:02", "b"), ("2026-01-03 00:00:00", "b"), ("2026-01-03 00:00:01", "a")])]
    e = spark.createDataFrame(rows, "v string, t string, source string, name string, ordinal bigint")
    kind = F.when(F.col("name") == "x", "deploy").otherwise("span")
    e = e.unionByName(spark.createDataFrame([("2", "2026-01-01 00:00:00", "s", "x", 9)], e.schema)).select(F.to_timestamp("t").alias("event_time"), "source", "name", kind.alias("kind"), F.create_map(F.lit("o"), "v").alias("ids"), F.lit("f").alias("file_name"), "ordinal", F.col("name").alias("node"))
    assert {r["value"]: r["nodes"] for r in routing.paths(e, "o").collect()} == {"1": ["a", "b", "a"], "2": []}


def test_ledger_streams(spark, tmp_path):
    rows = [("a", "2026-01-01 00:00:00", "2026-01-01 00:05:00"), ("b", "2026-01-01 00:10:00", None), ("c", "2026-01-01 00:11:00", "2026-01-01 03:00:00"), ("z", "2026-01-02 00:00:00", "2026-01-02 00:00:01")]
    table = spark.createDataFrame(rows, "key string, a string, s string")
    accepted = table.select("key", F.to_timestamp("a").alias("event_time"))
    settled = table.where("s is not null").select("key", F.to_timestamp("s").alias("event_time"))
    batch = {r["key"]: r["settled_time"] is not None for r in ledger.settlement(accepted, settled).collect()}
    assert batch == {"a": True, "b": False, "c": False, "z": True}
    for name, part in (("accepted", accepted), ("settled", settled)):
        part.coalesce(1).write.parquet(str(tmp_path / name))
    streams = [spark.readStream.schema("key string, event_time timestamp").parquet(str(tmp_path / n)) for n in ("accepted", "settled")]
    query = ledger.settlement(*streams).writeStream.format("memory").queryName("settlement_test").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    found = {r["key"]: r["settled_time"] is not None for r in spark.table("settlement_test").collect()}
    assert found["a"] and found["z"] and not found.get("b", False)
    counts = {(str(r["window_start"]), r["source"]): r["records"] for r in ledger.volume(accepted.withColumn("source", F.lit("s"))).collect()}
    assert counts == {("2026-01-01 00:00:00", "s"): 1, ("2026-01-01 00:10:00", "s"): 2, ("2026-01-02 00:00:00", "s"): 1}
