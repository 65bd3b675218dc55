import json
import urllib.request
from threading import Thread

import pytest

from loomspark import serve
from loomspark.errors import ConfigurationError
from loomspark.operators.events import CollectingListener, EventBus, TracesClosed
from loomspark.operators.store import LogStore
from loomspark.plans import config, pipeline
from loomspark.sources import generate
from loomspark.streaming import traces as streaming
from pyspark.sql import functions as F


@pytest.mark.parametrize(
    "data",
    [
        {}, {"source": {}}, {"source": {"path": "x", "extra": 1}}, {"source": {"path": "x"}, "more": 1}, {"source": {"kind": "tape", "path": "x"}}, {"source": {"path": "x"}, "runtime": {"num_workers": 0}},
        {"source": {"path": "x"}, "repository": {"kind": "postgres"}}, {"source": {"path": "x"}, "validation": [{"kind": "nope"}]}, {"source": {"path": 3}}, {"source": {"path": "x"}, "sessionizer": {"enabled": "yes"}},
    ],
)
def test_bad_configurations(data):
    with pytest.raises(ConfigurationError):
        config.parse_config(data)


def test_load(tmp_path):
    (tmp_path / "c.yaml").write_text("source: {kind: file, path: a.log}\ndetectors:\n  - {kind: z_score, window_size: 200}\nsessionizer: {enabled: true, idle_window_s: 5}\n")
    c = config.load_config(str(tmp_path / "c.yaml"))
    assert c.sessionizer.idle_window_s == 5.0 and c.detectors[0].options == {"metric_key": "metric", "window_size": 200} and c.parser.kind == "hdfs"
    (tmp_path / "bad.yaml").write_text("a: [")
    for path in ("bad.yaml", "none.yaml"):
        with pytest.raises(ConfigurationError):
            config.load_config(str(tmp_path / path))


def test_run_and_serve(spark, tmp_path):
    lines = [r["raw"] for r in generate.hdfs_lines(spark, 40, 0.3, 3).orderBy("seq").collect()] + ["junk"]
    (tmp_path / "a.log").write_text("\n".join(lines) + "\n")
    (tmp_path / "t.csv").write_text("EventId,EventTemplate\nE1,BLOCK* NameSystem.allocateBlock: <*>\nE2,Receiving block <*>\nE3,PacketResponder <*>\nE4,Received block <*>\nE9,Deleting block <*>\n")
    (tmp_path / "m.json").write_text(json.dumps({"n": 2, "normal_ngrams": [["E1", "E2"], ["E2", "E3"], ["E3", "E4"], ["E4", "E9"]], "vocabulary": []}))
    c = config.parse_config({
        "source": {"kind": "file", "path": str(tmp_path / "a.log")}, "validation": [{"kind": "schema"}, {"kind": "size", "max_message_bytes": 500}], "template_matcher": {"enabled": True, "templates_path": str(tmp_path / "t.csv")},
        "sessionizer": {"enabled": True}, "sequence_detector": {"model_path": str(tmp_path / "m.json")}, "repository": {"kind": "parquet", "path": str(tmp_path / "out")}, "detectors": [{"kind": "z_score"}],
    })
    bus, got = EventBus(), CollectingListener()
    bus.subscribe(TracesClosed, got)
    result, store = pipeline.run(spark, c, bus=bus)
    assert result.records_processed == len(lines) - 1 and result.records_failed == 1 and result.traces_closed == 40 and len(got.events) == 1
    assert 0 < result.anomalies_detected < 40
    first = store.all_records().first()
    assert first["stage_history"][0] == "parse:hdfs" and first["pipeline_run_id"] == result.run_id and "block_id" in first["enrichment"] and "raw" in first["raw_payload"]
    assert {r["closed_reason"] for r in store.all_traces().collect()} <= {"terminal", "timeout", "shutdown"}
    assert serve.respond(store, "/health")[0] == 200 and serve.respond(None, "/logs")[0] == 503 and serve.respond(store, "/none")[0] == 404
    status, body = serve.respond(store, "/logs?severity=INFO&limit=3")
    assert status == 200 and len(body) == 3
    for bad in ("/logs?limit=0", "/logs?limit=x", "/aggregate?group_by=message", "/logs?after=soon", "/logs?nope=1"):
        assert serve.respond(store, bad)[0] == 422
    assert serve.respond(store, "/aggregate")[1] == [{"key": "INFO", "count": len(lines) - 1}]
    assert len(serve.respond(store, "/anomalies?detector=sequence_ngram&limit=1")[1]) == 1
    http = serve.server(store, port=0)
    Thread(target=http.serve_forever, daemon=True).start()
    with urllib.request.urlopen(f"http://127.0.0.1:{http.server_port}/anomalies?limit=1") as r:
        assert json.load(r)[0]["detector_name"] == "sequence_ngram"
    http.shutdown()


def test_plan_errors(spark):
    base = {"source": {"kind": "iterable"}}
    for more in ({"parser": {"kind": "nope"}}, {"detectors": [{"kind": "nope"}]}, {"detectors": [{"kind": "z_score", "window_size": 1}]}, {"sequence_detector": {}}):
        with pytest.raises(ConfigurationError):
            pipeline.build(spark, config.parse_config(base | more), ["x"])
    with pytest.raises(ConfigurationError):
        pipeline.build(spark, config.parse_config(base))


def test_numeric_detectors_in_a_plan(spark):
    lines = [f"081109 {h:02d}{m:02d}00 1 INFO a: value {500 if (h, m) == (3, 30) else (h + m) % 7}" for h in range(4) for m in range(60)]
    c = config.parse_config({"source": {"kind": "iterable"}, "detectors": [{"kind": "z_score", "window_size": 50}, {"kind": "cusum"}]})
    plan = pipeline.build(spark, c, lines, metric=F.regexp_extract("message", r"(\d+)$", 1).cast("double"))
    assert {r["detector_name"] for r in plan.anomalies.collect()} == {"z_score", "cusum"}


def _stream(spark, folder, out, **options):
    lines = streaming.stream_lines(spark, folder, 1)
    from loomspark.functions.parsing import parse

    rows = parse(lines, "hdfs").where("parse_error is null").withColumn("event_id", F.regexp_extract("message", "^(E[0-9]+)", 1))
    got = []
    q = streaming.run_batches(streaming.stream_traces(rows, **options), out, lambda df, i: got.extend(df.collect()), available_now=True)
    q.awaitTermination(120)
    return got


def test_streaming_traces(spark, tmp_path):
    import os
    import time

    folder = tmp_path / "in"
    folder.mkdir()
    line = lambda second, block, event: f"081109 2000{second:02d} 1 INFO a: {event} blk_{block}"
    batches = [[line(0, 1, "E1"), line(1, 1, "E2"), line(1, 2, "E1"), line(2, 3, "E1"), line(3, 3, "E9")], [line(50, 4, "E1"), line(51, 4, "E2"), line(52, 4, "E3"), line(53, 4, "E4")], [line(59, 5, "E1")]]
    for i, b in enumerate(batches):
        (folder / f"{i}.log").write_text("\n".join(b) + "\n")
        os.utime(folder / f"{i}.log", (time.time() - 100 + i,) * 2)
    got = _stream(spark, str(folder), str(tmp_path / "ck"), idle_window_s=10.0, max_records_per_trace=3)
    by = {(r["block_id"], r["chunk"]): (r["closed_reason"], r["event_sequence"]) for r in got}
    assert by[("blk_3", 0)] == ("terminal", ["E1", "E9"]) and by[("blk_4", 0)] == ("evicted", ["E1", "E2", "E3"])
    assert by[("blk_1", 0)] == ("timeout", ["E1", "E2"]) and by[("blk_2", 0)] == ("timeout", ["E1"]) and ("blk_5", 0) not in by


def test_streaming_late_rows(spark, tmp_path):
    """Rows behind the watermark reopen a closed block, go to an open one, or open one of their own."""
    import os
    import time

    folder = tmp_path / "in"
    folder.mkdir()
    line = lambda second, block, event: f"081109 2000{second:02d} 1 INFO a: {event} blk_{block}"
    batches = [
        [line(0, 1, "E1"), line(1, 1, "E9"), line(45, 2, "E1"), line(2, 5, "E1")], [line(50, 3, "E1")], [line(2, 1, "E2"), line(40, 2, "E2"), line(3, 4, "E3"), line(4, 5, "E2")],
        [line(51, 3, "E2"), line(5, 1, "E4")], [line(59, 6, "E1")],
    ]
    for i, b in enumerate(batches):
        (folder / f"{i}.log").write_text("\n".join(b) + "\n")
        os.utime(folder / f"{i}.log", (time.time() - 100 + i,) * 2)
    got = _stream(spark, str(folder), str(tmp_path / "ck"), idle_window_s=10.0)
    events = {}
    for r in sorted(got, key=lambda r: (r["block_id"], r["chunk"])):
        events.setdefault(r["block_id"], []).append((r["closed_reason"], r["event_sequence"]))
    assert events["blk_1"] == [("terminal", ["E1", "E9"]), ("timeout", ["E2"]), ("timeout", ["E4"])]
    assert events["blk_2"] == [("timeout", ["E1", "E2"])] and events["blk_4"] == [("timeout", ["E3"])]
    assert events["blk_5"] == [("timeout", ["E1"]), ("timeout", ["E2"])] and set(events) == {"blk_1", "blk_2", "blk_4", "blk_5"}
    assert len({(r["block_id"], r["chunk"]) for r in got}) == len(got)


def test_streaming_equal_lines(spark, tmp_path):
    """Of equal lines the finalizer keeps those that no trace has, as many as there are."""
    folder = tmp_path / "in"
    folder.mkdir()
    line = "081109 200000 1 INFO a: E1 blk_1"
    (folder / "0.log").write_text("\n".join([line] * 5) + "\n")
    got = _stream(spark, str(folder), str(tmp_path / "ck"), max_records_per_trace=3)
    assert [(r["closed_reason"], r["record_count"]) for r in got] == [("evicted", 3)]
    records = spark.createDataFrame([(i, got[0]["record_ids"][0], "blk_1", "E1", got[0]["first_timestamp"]) for i in range(5)], "seq long, id string, block_id string, event_id string, timestamp timestamp")
    rest = streaming.finalize(records, spark.createDataFrame(got), ["seq"]).collect()
    assert [(r["block_id"], r["record_count"], r["closed_reason"]) for r in rest] == [("blk_1", 2, "shutdown")]


def test_streaming_windows(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.log").write_text("".join(f"081109 20{m:02d}00 1 INFO a: x blk_1\n" for m in (0, 1, 30, 59)))
    from loomspark.functions.parsing import parse

    rows = parse(streaming.stream_lines(spark, str(folder)), "hdfs")
    for i, df in enumerate((streaming.stream_rates(rows, "10 minutes"), streaming.stream_sessions(rows, "5 minutes"))):
        out = []
        streaming.run_batches(df, str(tmp_path / f"ck{i}"), lambda b, _: out.extend(b.collect()), available_now=True).awaitTermination(60)  # noqa: B023
        assert out


def test_session_gap_is_exclusive(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.log").write_text("".join(f"081109 {t} 1 INFO a: x blk_1\n" for t in ("200000", "200500", "200959", "201459", "203000")))
    from loomspark.functions.parsing import parse

    want = [("20:00:00", "20:05:00", 1), ("20:05:00", "20:14:59", 2), ("20:14:59", "20:19:59", 1), ("20:30:00", "20:35:00", 1)]
    seen = lambda rows: sorted((f"{r['start']:%H:%M:%S}", f"{r['end']:%H:%M:%S}", r["records"]) for r in rows)
    lines = spark.read.text(str(folder)).select(F.col("value").alias("raw"), F.col("value").alias("id"))
    assert seen(streaming.stream_sessions(parse(lines, "hdfs"), "5 minutes").collect()) == want
    out = []
    df = streaming.stream_sessions(parse(streaming.stream_lines(spark, str(folder)), "hdfs"), "5 minutes")
    streaming.run_batches(df, str(tmp_path / "ck"), lambda b, _: out.extend(b.collect()), available_now=True).awaitTermination(60)
    assert seen(out) == want[:3]


def test_train_and_evaluate(spark, tmp_path, capsys, monkeypatch):
    from loomspark.__main__ import main
    from loomspark.plans import evaluation

    rows = generate.hdfs_lines(spark, 120, 0.3, 9).orderBy("seq").collect()
    (tmp_path / "a.log").write_text("".join(r["raw"] + "\n" for r in rows))
    (tmp_path / "l.csv").write_text("BlockId,Label\n" + "".join(f"{b},{'Anomaly' if a else 'Normal'}\n" for b, a in sorted({(r["block"], r["anomaly"]) for r in rows}, key=str)))
    (tmp_path / "t.csv").write_text("EventId,EventTemplate\n" + "\n".join(f"E{i},<*>{x}<*>" for i, x in enumerate(("allocateBlock", "Receiving", "PacketResponder", "Received", "addStoredBlock", "Deleting", "exception"))) + "\n")
    files = [f"--{k}={tmp_path / v}" for k, v in (("log", "a.log"), ("templates", "t.csv"), ("labels", "l.csv"), ("model", "m.json"))]
    assert main(["train", *files]) == 0 and main(["evaluate-sequence", *files, f"--out={tmp_path / 'r.json'}"]) == 0
    r = json.loads((tmp_path / "r.json").read_text())
    own = {r["block"]: r["anomaly"] for r in rows}
    # cutting a block short leaves known n-grams; swapping and inserting steps doesn't
    assert r["fp"] == 0 and r["tp"] == sum(a in ("reorder", "inject") for a in own.values()) and r["fn"] == sum(a == "truncate" for a in own.values()) and r["blocks"] == 120
    lines = [x["raw"] for x in generate.bgl_lines(spark, 400, 0.1).collect()]
    (tmp_path / "b.log").write_text("\n".join(lines) + "\n")
    points = evaluation.evaluate_points(spark, str(tmp_path / "b.log"), 3600)
    assert set(points["results"]) == {"z_score", "iqr", "cusum"} and all(sum(v[c] for c in ("tp", "fp", "fn", "tn")) == points["windows"] for v in points["results"].values())
    assert "sequence_ngram" in capsys.readouterr().out


def test_knobs_without_a_counterpart_are_accepted():
    c = config.parse_config({"source": {"kind": "iterable"}, "runtime": {"num_workers": 8, "queue_size": 10, "batch_size": 5, "flush_interval_s": 0.5}, "sessionizer": {"max_open_traces": 9, "flush_interval_s": 5.0}})
    assert c.runtime.num_workers == 8 and c.sessionizer.max_open_traces == 9


def _lines(n=12):
    return [f"081109 2000{i:02d} 1 INFO a: E{1 + i % 3} blk_{i % 4}" for i in range(n)] + ["junk"]


def test_a_run_parses_once(spark, tmp_path, monkeypatch):
    """All outputs of a run come from rows that were parsed once; the registry counts detectors and reasons."""
    from loomspark.operators.metrics import MetricsRegistry

    registry = MetricsRegistry()
    monkeypatch.setattr(pipeline, "default_registry", registry)
    lines = spark.sparkContext.accumulator(0)

    def seen(batches):
        for pdf in batches:
            lines.add(len(pdf))
            yield pdf

    from loomspark.sources import text

    rows = text.from_iterable(spark, _lines())
    c = config.parse_config({"source": {"kind": "iterable"}, "sessionizer": {"enabled": True, "max_records_per_trace": 2}, "detectors": [{"kind": "z_score", "window_size": 5, "min_samples": 2}], "template_matcher": {"enabled": False}, "repository": {"kind": "parquet", "path": str(tmp_path / "out")}})
    result, store = pipeline.run(spark, c, rows.mapInPandas(seen, rows.schema))
    assert lines.value == 13 and (result.records_processed, result.records_failed) == (12, 1)
    counters = registry.snapshot()["counters"]
    assert sum(v for k, v in counters.items() if k.startswith("traces.closed.")) == counters["traces.closed"] == result.traces_closed == store.all_traces().count() == 4
    assert set(store.all_traces().toPandas()["closed_reason"]) == {k.removeprefix("traces.closed.") for k in counters if k.startswith("traces.closed.")}


def test_failed_saves_count_as_failed(spark):
    from loomspark.errors import RepositoryError

    class Broken(LogStore):
        def save_batch(self, records):
            raise RepositoryError("no")

    result, _ = pipeline.run(spark, config.parse_config({"source": {"kind": "iterable"}}), _lines(), store=Broken(spark))
    assert (result.records_processed, result.records_failed) == (0, 13)


def test_open_traces_are_bounded_in_a_plan(spark):
    """With more blocks than may be open, the one that was longest without a row is put out."""
    lines = [f"081109 2000{i:02d} 1 INFO a: x blk_{b}" for i, b in enumerate((1, 2, 1, 3, 2))]
    base = {"source": {"kind": "iterable"}}
    got = {}
    for most in (2, 3):
        plan = pipeline.build(spark, config.parse_config(base | {"sessionizer": {"enabled": True, "max_open_traces": most}}), lines)
        got[most] = sorted((r["block_id"], r["chunk"], r["record_count"], r["closed_reason"]) for r in plan.traces.collect())
    assert got[2] == [("blk_1", 0, 2, "evicted"), ("blk_2", 0, 1, "evicted"), ("blk_2", 1, 1, "shutdown"), ("blk_3", 0, 1, "shutdown")]
    assert got[3] == [("blk_1", 0, 2, "shutdown"), ("blk_2", 0, 2, "shutdown"), ("blk_3", 0, 1, "shutdown")]


def test_metrics_by_detector(spark):
    """Each detector reads its own metric, from the bag that its source_dict names."""
    from loomspark.operators.detect import Cusum, Iqr, ZScore

    lines = [f"081109 {h:02d}{m:02d}00 1 INFO a: value {500 if (h, m) == (3, 30) else (h + m) % 7}" for h in range(4) for m in range(60)]
    c = config.parse_config({"source": {"kind": "iterable"}, "detectors": [{"kind": "z_score", "window_size": 50, "metric_key": "a"}, {"kind": "iqr", "metric_key": "b"}]})
    number = F.regexp_extract("message", r"(\d+)$", 1).cast("double")
    found = lambda metric: {r["detector_name"] for r in pipeline.build(spark, c, lines, metric=metric).anomalies.collect()}
    assert found({"a": number}) == {"z_score"} and found({"a": number, "b": number}) == {"z_score", "iqr"} and found(None) == set()
    rows = spark.range(60).select(F.col("id").cast("string").alias("id"), F.col("id").alias("seq"), F.create_map(F.lit("ms"), F.when(F.col("id") == 50, "900").otherwise((F.col("id") % 5).cast("string"))).alias("raw_payload"))
    for cls in (ZScore, Iqr, Cusum):
        assert cls("ms", source_dict="raw_payload").fired(rows, ["seq"]).count() >= 1 and cls("ms").fired(rows, ["seq"]).count() == 0
        with pytest.raises(ValueError):
            cls(source_dict="message")
    with pytest.raises(ConfigurationError):
        pipeline.build(spark, config.parse_config({"source": {"kind": "iterable"}, "detectors": [{"kind": "cusum", "source_dict": "x"}]}), lines)


def test_replay_at_a_rate(spark, tmp_path):
    import time

    from loomspark.sources import text

    with pytest.raises(ConfigurationError):
        pipeline.build(spark, config.parse_config({"source": {"kind": "iterable", "throttle_rps": 5.0}}), ["x"])
    with pytest.raises(ConfigurationError):
        streaming.replay(spark, text.from_iterable(spark, ["x"]), 0.5)
    got, began = [], time.time()
    q = streaming.run_batches(streaming.replay(spark, text.from_iterable(spark, [f"line {i}" for i in range(12)]), 4), str(tmp_path / "ck"), lambda df, i: got.extend(r["raw"] for r in df.orderBy("seq").collect()))
    while len(got) < 12 and time.time() - began < 60:
        time.sleep(0.2)
    q.stop()
    assert got[:12] == [f"line {i}" for i in range(12)] and time.time() - began >= 2


def test_stdin_is_spooled_to_the_shared_folder(spark, tmp_path, monkeypatch):
    import io

    from loomspark.sources import text

    out = text.from_stdin(spark, io.StringIO("a\n\nb é\n"), str(tmp_path))
    assert [r["raw"] for r in out.orderBy("seq").collect()] == ["a", "", "b é"] and len(list(tmp_path.glob("stdin-*.log"))) == 1
    assert text.from_stdin(spark, io.StringIO("")).count() == 0


def test_training_counts(spark, tmp_path):
    from loomspark.plans import evaluation

    (tmp_path / "a.log").write_text("".join(f"081109 200000 1 INFO a: {m}\n" for m in ("x blk_1", "x blk_2", "y blk_1", "x")) + "junk\n")
    (tmp_path / "t.csv").write_text("EventId,EventTemplate\nE1,x<*>\n")
    (tmp_path / "l.csv").write_text("BlockId,Label\nblk_1,Normal\n")
    got = evaluation.training_counts(spark, *(str(tmp_path / f) for f in ("a.log", "t.csv", "l.csv")))
    assert got == {"parsed": 4, "matched": 2, "skipped": 2, "blocks": 2, "normal": 1, "unlabelled": 1}
