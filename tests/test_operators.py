import math
import random
from collections import OrderedDict, deque

import pytest

from loomspark.errors import ConfigurationError, TransientStageError
from loomspark.operators import detect, evaluate, events, metrics, ngram, sessionize, store, validate
from pyspark.sql import functions as F


# validation


def messages(spark, rows):
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, message string, source string, severity string, timestamp timestamp_ntz").withColumn("timestamp", F.col("timestamp").cast("timestamp"))


def reasons(df):
    return [r["reject_reason"] for r in df.orderBy("i").collect()]


def test_schema_and_size(spark):
    df = messages(spark, [("", "", "ERROR", None), ("a", "", "ERROR", None), ("a", "s", "ERROR", None), ("é" * 3, "s", None, None), (None, "s", "INFO", None)])
    strict = validate.SchemaValidator(require_source=True, allowed_severities=["INFO"])
    assert reasons(validate.chain(df, [strict])) == ["missing message", "missing source", "severity ERROR not in allowlist", None, "missing message"]
    assert [bool(x) for x in reasons(validate.chain(df, [validate.SizeValidator(6)]))] == [False] * 5
    assert [bool(x) for x in reasons(validate.chain(df, [validate.SizeValidator(5)]))] == [False, False, False, True, False]
    for bad in (lambda: validate.SizeValidator(0), lambda: validate.RateLimitValidator(0), lambda: validate.RateLimitValidator(1, 0), lambda: validate.chain(df, [])):
        with pytest.raises(ValueError):
            bad()
    assert validate.chain_name([strict, validate.SizeValidator()]) == "validate:schema,size"
    with pytest.raises(ConfigurationError):
        validate.build("nope")


def bucket(rows, capacity, refill):
    """A plain model of token buckets."""
    state, out = {}, []
    for source, now, skip in rows:
        if skip:
            out.append(False)
            continue
        key = source or "<unknown>"
        tokens, last = state.get(key, (float(capacity), now))
        tokens = min(float(capacity), tokens + max(0.0, now - last) * refill)
        out.append(tokens < 1.0)
        state[key] = (tokens - 1.0 if tokens >= 1.0 else tokens, now)
    return out


@pytest.mark.parametrize("parts", [1, 4, 7])
def test_rate_limit(spark, parts):
    rng = random.Random(3)
    rows, now = [], 0
    for _ in range(400):
        now += rng.choice((0, 0, 1, 2))
        rows.append((rng.choice(("a", "b", "", None)), now, rng.random() < 0.1))
    df = spark.createDataFrame([(i, "" if skip else "m", s, "INFO", t) for i, (s, t, skip) in enumerate(rows)], "i int, message string, source string, severity string, t long").withColumn("timestamp", F.timestamp_seconds("t"))
    out = validate.chain(df.repartition(parts), [validate.SchemaValidator(), validate.RateLimitValidator(2, 0.5)], ["i"])
    got = [r is not None and r.startswith("rate") for r in reasons(out)]
    assert got == bucket(rows, 2, 0.5) and any(got)


# traces


def trace_rows(spark, rows):
    return spark.createDataFrame([(i, f"r{i}", *r) for i, r in enumerate(rows)], "seq int, id string, block_id string, event_id string, t long").withColumn("timestamp", F.timestamp_seconds("t"))


def simulated(rows, cap):
    open_, out = OrderedDict(), []
    for i, (block, event, _) in enumerate(rows):
        if not block:
            continue
        state = open_.setdefault(block, [[], []])
        state[1].append(f"r{i}")
        if event:
            state[0].append(event)
        if len(state[0]) >= cap:
            out.append((block, tuple(open_.pop(block)[0]), "evicted"))
    return out + [(b, tuple(s[0]), "shutdown") for b, s in open_.items()]


@pytest.mark.parametrize("parts", [1, 4, 7])
def test_capped_traces(spark, parts):
    rng = random.Random(1)
    rows = [(rng.choice(("a", "b", "c", None, "")), rng.choice(("E1", "E2", "E3", None)), i) for i in range(300)]
    out = sessionize.traces(trace_rows(spark, rows).repartition(parts), ["seq"], 5, janitor="none").collect()
    assert sorted((r["block_id"], tuple(r["event_sequence"]), r["closed_reason"]) for r in out) == sorted(simulated(rows, 5))
    assert sum(r["record_count"] for r in out) == sum(bool(b) for b, _, _ in rows)


def test_close_reasons(spark):
    rows = [("a", "E1", 0), ("b", "E9", 0), ("c", "E1", 31), ("d", "E1", 60), ("e", "E1", 60), ("e", "E2", 60), ("e", None, 60), ("f", "E1", 30), ("g", "E1", None)]
    out = {(r["block_id"], r["chunk"]): r for r in sessionize.traces(trace_rows(spark, rows), ["seq"], 2, 30.0).collect()}
    got = {k: r["closed_reason"] for k, r in out.items()}
    assert got == {("a", 0): "timeout", ("b", 0): "terminal", ("c", 0): "shutdown", ("d", 0): "shutdown", ("e", 0): "evicted", ("e", 1): "shutdown", ("f", 0): "shutdown", ("g", 0): "shutdown"}
    assert out[("e", 1)]["record_count"] == 1 and out[("e", 1)]["event_sequence"] == [] and out[("e", 0)]["record_ids"] == ["r4", "r5"]
    for bad in ({"idle_window_s": 0}, {"max_records_per_trace": 0}, {"janitor": "x"}):
        with pytest.raises(ValueError):
            sessionize.traces(trace_rows(spark, rows), ["seq"], **bad)


def test_least_recent_eviction(spark):
    rows = [("a", "E1", 0), ("b", "E1", 1), ("a", "E2", 2), ("c", "E1", 3), ("b", "E2", 4)]
    out = {r["id"]: (r["trace"], r["evicted"]) for r in sessionize.evict_least_recent(trace_rows(spark, rows), ["seq"], 2).collect()}
    assert out == {"r0": (0, None), "r1": (0, None), "r2": (0, None), "r3": (0, "b"), "r4": (1, "a")}


def test_trace_records(spark):
    df = trace_rows(spark, [("a", "E1", 0), ("b", "E1", 1), ("a", None, 2)])
    out = sessionize.trace_records(sessionize.traces(df, ["seq"]), df)
    assert sorted((r["block_id"], r["position"], r["id"]) for r in out.collect()) == [("a", 0, "r0"), ("a", 1, "r2"), ("b", 0, "r1")]


# detectors


def series(spark, values, parts=1):
    return spark.createDataFrame([(i, f"r{i}", v) for i, v in enumerate(values)], "seq int, id string, metric double").repartition(parts).withColumn("timestamp", F.timestamp_seconds("seq"))


def z_model(values, threshold, window, least):
    held, out = deque(maxlen=window), {}
    for i, x in enumerate(values):
        if x is None:
            continue
        if len(held) >= least:
            mean = math.fsum(held) / len(held)
            sigma = math.sqrt(math.fsum((v - mean) ** 2 for v in held) / len(held))
            if sigma and abs((x - mean) / sigma) > threshold:
                out[i] = abs((x - mean) / sigma)
        held.append(x)
    return out


def iqr_model(values, k, window, least):
    held, out = deque(maxlen=window), {}

    def at(s, p):
        r = p * (len(s) - 1)
        low = int(r)
        return s[low] + (r - low) * (s[min(low + 1, len(s) - 1)] - s[low])

    for i, x in enumerate(values):
        if x is None:
            continue
        if len(held) >= least:
            s = sorted(held)
            q1, q3 = at(s, 0.25), at(s, 0.75)
            if q3 > q1:
                low, high = q1 - k * (q3 - q1), q3 + k * (q3 - q1)
                if x < low or x > high:
                    out[i] = low - x if x < low else x - high
        held.append(x)
    return out


def cusum_model(values, threshold, slack, warmup):
    first, out, high, low, target = [], {}, 0.0, 0.0, None
    for i, x in enumerate(values):
        if x is None:
            continue
        if target is None:
            first.append(x)
            if len(first) == warmup:
                target = sum(first) / warmup
                sigma = max(math.sqrt(sum((v - target) ** 2 for v in first) / warmup), 1e-12)
            continue
        d = (x - target) / sigma
        high, low = max(0.0, high + d - slack), max(0.0, low - d - slack)
        if high > threshold or low > threshold:
            out[i] = max(high, low)
            high = low = 0.0
    return out


def values(seed, n=400):
    rng = random.Random(seed)
    return [None if rng.random() < 0.05 else (rng.gauss(10, 1) + (8 if rng.random() < 0.03 else 0) + (1.5 if i > 300 else 0)) for i in range(n)]


@pytest.mark.parametrize("seed", [1, 2])
@pytest.mark.parametrize("parts", [1, 5])
def test_detectors_against_models(spark, seed, parts):
    x = values(seed)
    df = series(spark, x, parts)
    for detector, want in (
        (detect.ZScore(window_size=50, min_samples=20), z_model(x, 3.0, 50, 20)),
        (detect.Iqr(window_size=50, min_samples=20), iqr_model(x, 1.5, 50, 20)),
        (detect.Cusum(threshold=4.0, slack=0.5, warmup_samples=30), cusum_model(x, 4.0, 0.5, 30)),
    ):
        got = {r["seq"]: r["score"] for r in detector.fired(df, ["seq"]).collect()}
        assert got.keys() == want.keys() and want
        assert all(abs(got[i] - want[i]) < 1e-9 for i in want)
        anomalies = detector.anomalies(df, ["seq"]).collect()
        assert {r["log_record_id"] for r in anomalies} == {f"r{i}" for i in want} and {r["detector_name"] for r in anomalies} == {detector.name}


def test_values_on_a_fence(spark):
    """The last bit of a quartile decides; the SQL's quantile_cont is a fused multiply-add."""
    import duckdb

    from loomspark.streaming.series import detector_step

    cases = [[0.43, 4.38, 5.8, 9.19, 11.53], [0.43, 4.38, 5.8, 9.19, -1.49], [2.16, 2.36, 14.95, 16.15, -17.1], [3.5, 4.3, 8.69, 10.17, 16.5], [3.5, 4.3, 8.69, 10.17, -3.34], [2.99, 9.15, 14.23, 17.43, 26.16]]
    rows = [(k, i, f"{k}.{i}", x) for k, c in enumerate(cases) for i, x in enumerate(c)]
    detector = detect.Iqr(window_size=4, min_samples=4)
    got = {r["k"] for r in detector.fired(spark.createDataFrame(rows, "k int, seq int, id string, metric double"), ["seq"], ["k"]).collect()}
    q = "SELECT quantile_cont(x, 0.25), quantile_cont(x, 0.75) FROM (SELECT unnest(?::DOUBLE[]) AS x)"
    fences = [(q1 - 1.5 * (q3 - q1), q3 + 1.5 * (q3 - q1)) for q1, q3 in (duckdb.execute(q, [c[:4]]).fetchall()[0] for c in cases)]
    assert got == {3, 4} == {k for k, (c, (low, high)) in enumerate(zip(cases, fences, strict=True)) if not low <= c[4] <= high}
    step = detector_step(detector)
    assert got == {k for k, c in enumerate(cases) if step([], c)[1][4][1]}


@pytest.mark.parametrize("rows", [7, 60, 150, 1000])
def test_long_series_in_runs(spark, rows):
    x = values(4)
    df = series(spark, x, 3)
    for detector, want in ((detect.ZScore(window_size=50, min_samples=20, chunk_rows=rows), z_model(x, 3.0, 50, 20)), (detect.Iqr(window_size=50, min_samples=20, chunk_rows=rows), iqr_model(x, 1.5, 50, 20))):
        scored = detector.score(df, ["timestamp", "seq"])
        assert scored.count() == sum(v is not None for v in x) and "_chunk" not in scored.columns
        got = {r["seq"]: r["score"] for r in scored.where("fired").collect()}
        assert got.keys() == want.keys() and all(abs(got[i] - want[i]) < 1e-9 for i in want)


def test_thousands_of_runs(spark):
    x = values(4, 4000)
    got = {r["seq"]: r["score"] for r in detect.ZScore(window_size=5, min_samples=4, chunk_rows=1).fired(series(spark, x), ["timestamp", "seq"]).collect()}
    want = z_model(x, 3.0, 5, 4)
    assert len(want) > 100 and got.keys() == want.keys() and all(abs(got[i] - want[i]) < 1e-6 * want[i] for i in want)


def test_series_by(spark):
    a, b = values(5), values(6)
    df = series(spark, a).withColumn("source", F.lit("a")).unionByName(series(spark, b).withColumn("source", F.lit("b")))
    for detector, model in ((detect.ZScore(window_size=50, min_samples=20), lambda x: z_model(x, 3.0, 50, 20)), (detect.Cusum(threshold=4.0), lambda x: cusum_model(x, 4.0, 0.5, 30))):
        got = {(r["source"], r["seq"]) for r in detector.fired(df, ["seq"], ["source"]).collect()}
        assert got == {("a", i) for i in model(a)} | {("b", i) for i in model(b)}


def test_constant_series_and_guards(spark):
    df = series(spark, [0.1] * 60 + [99.0])
    assert detect.ZScore().fired(df, ["seq"]).count() == 0 and detect.Iqr().fired(df, ["seq"]).count() == 0
    assert detect.ZScore().fired(df.withColumn("metric", F.lit("x")), ["seq"]).count() == 0 and detect.ZScore().fired(df.withColumn("metric", F.lit(True)), ["seq"]).count() == 0
    for make in (lambda: detect.ZScore(window_size=1), lambda: detect.ZScore(threshold=0), lambda: detect.ZScore(min_samples=1), lambda: detect.Iqr(window_size=1), lambda: detect.Iqr(k=0), lambda: detect.Iqr(min_samples=3), lambda: detect.Cusum(threshold=0), lambda: detect.Cusum(slack=-1), lambda: detect.Cusum(warmup_samples=1)):
        with pytest.raises(ValueError):
            make()
    tagged = detect.tagged(series(spark, [None, *([1.0, 2.0] * 40), 50.0]), detect.ZScore(), ["seq"])
    assert tagged.count() == 82 and [r["seq"] for r in tagged.where("anomaly_z_score is not null").collect()] == [81]


# n-grams


def test_ngrams_and_scores(spark, tmp_path):
    rows = [("a", ["A", "B", "C", "D"], "Normal"), ("b", ["A", "B", "D"], "Anomaly"), ("c", ["A"], "Normal"), ("d", [], "Anomaly"), ("e", ["A", "B"], None)]
    df = spark.createDataFrame([(b, e, [f"{b}0"], b, l) for b, e, l in rows], "block_id string, event_sequence array<string>, record_ids array<string>, closed_reason string, l string")  # noqa: E741
    df = df.withColumn("first_timestamp", F.timestamp_seconds(F.lit(0))).withColumn("last_timestamp", F.timestamp_seconds(F.lit(9)))
    assert [r[0] for r in df.orderBy("block_id").select(ngram.ngrams(F.col("event_sequence"), 2)).collect()] == [[["A", "B"], ["B", "C"], ["C", "D"]], [["A", "B"], ["B", "D"]], [], [], [["A", "B"]]]
    assert df.select(ngram.ngrams(F.col("event_sequence"), 0).alias("g")).where("size(g) > 0").count() == 0
    labels = df.where("l is not null").select(F.col("block_id").alias("BlockId"), F.col("l").alias("Label"))
    model = ngram.train(df, labels, 2)
    assert model.normal_ngrams == {("A", "B"), ("B", "C"), ("C", "D")} and model.vocabulary == {"A", "B", "C", "D"}
    model.save(str(tmp_path / "m.json"))
    assert ngram.SequenceModel.load(str(tmp_path / "m.json")) == model
    for scored in (ngram.score(df, model), ngram.score(df, model.frame(spark), n=2)):
        got = {r["block_id"]: (r["ratio"], r["fired"], r["novel_ngrams"]) for r in scored.collect()}
        assert got["b"] == (0.5, True, [["B", "D"]]) and got["a"] == (0.0, False, []) and got["c"][:2] == (None, False)
    assert ngram.score(df, model, 0.5).where("fired").count() == 0
    assert {r["block_id"] for r in ngram.score(df, ngram.SequenceModel.load_or_empty("/none")).where("fired").collect()} == {"a", "b", "e"}
    a = ngram.SequenceDetector(model=model).anomalies(df).first()
    assert a["log_record_id"] == "b0" and a["metadata"]["novel_count"] == "1" and a["metadata"]["novel_ngrams"] == '[["B","D"]]'
    joined = {r["block_id"]: (r["observed_count"], r["novel_count"]) for r in ngram.score_by_join(df, model.frame(spark), "block_id").collect()}
    assert joined == {"a": (3, 0), "b": (2, 1), "e": (1, 0)}
    for bad in ({}, {"n": "2", "normal_ngrams": [], "vocabulary": []}, {"n": 2, "normal_ngrams": 1, "vocabulary": []}, None):
        with pytest.raises(ValueError):
            ngram.SequenceModel.from_dict(bad)
    with pytest.raises(ValueError):
        ngram.score(df, model, -1)


# evaluation, metrics, store, events


def test_bins(spark):
    df = spark.createDataFrame([("2024-01-01 10:59:50",), ("2024-01-01 10:59:30",), (None,)], "t string").select(F.col("t").cast("timestamp").alias("timestamp"))
    for width, want in ((45, {"10:59:45", "10:59:00"}), (60, {"10:59:00"}), (90, {"10:59:00"}), (600, {"10:50:00"}), (3600, {"10:00:00"}), (7200, {"10:00:00"})):
        assert {str(r["bin"])[11:] for r in evaluate.rates(df, width).collect()} == want, width


def test_confusion(spark):
    df = spark.createDataFrame([(True, True), (True, False), (False, True), (None, True), (False, False)], "p boolean, a boolean")
    r = evaluate.confusion(df, "p", "a").first()
    assert (r.tp, r.fp, r.fn, r.tn, r.precision, r.recall, r.f1) == (1, 1, 2, 1, 0.5, 0.3333, 0.4)
    empty = evaluate.confusion(df.where("false"), "p", "a").first()
    assert (empty.tp, empty.precision, empty.recall, empty.f1) == (0, 0.0, 0.0, 0.0)
    keys = lambda *x: spark.createDataFrame([(k,) for k in x], "k string")
    r = evaluate.confusion_from_sets(keys("a", "b", "c"), keys("a", "z"), keys("a", "b"), "k").first()
    assert (r.tp, r.fp, r.fn, r.tn) == (1, 0, 1, 1)
    assert evaluate.markdown([{"a": 1, "b": 2}]) == "| a | b |\n|---|---|\n| 1 | 2 |\n"


def test_metrics(spark):
    rng = random.Random(2)
    x = [rng.randint(0, 30) / 2 for _ in range(101)]
    df = spark.createDataFrame([("g", v) for v in x], "g string, v double")
    want = {p: sorted(x)[max(0, min(100, int(p * 101)))] for p in (0.5, 0.95, 0.99)}
    r = metrics.percentiles(df, "v", ["g"]).first()
    assert (r["count"], r.p50, r.p95, r.p99) == (101, want[0.5], want[0.95], want[0.99]) and abs(r.total - sum(x)) < 1e-9
    r = df.groupBy("g").agg(F.collect_list("v").alias("s")).select(metrics.nearest_rank(F.col("s"), 0.95), metrics.nearest_rank(F.array().cast("array<double>"), 0.5)).first()
    assert (r[0], r[1]) == (want[0.95], 0.0)
    m = metrics.MetricsRegistry()
    m.inc("a", 2), m.gauge("g", 1.5), m.timing("t", 0.5), m.timing("t", 0.25)
    assert m.snapshot() == {"counters": {"a": 2}, "gauges": {"g": 1.5}, "timers": {"t": {"count": 2.0, "total_s": 0.75, "p50_s": 0.5, "p95_s": 0.5, "p99_s": 0.5}}}


def records(spark):
    rows = [("1", "run", "2024-01-01 00:00:00", "api", "INFO", "a"), ("2", "run", "2024-01-01 00:00:01", "api", "ERROR", "b"), ("3", "other", "2024-01-01 00:00:02", "db", "INFO", "c"), ("4", "other", None, "db", "INFO", "d")]
    df = spark.createDataFrame(rows, "id string, pipeline_run_id string, timestamp string, source string, severity string, message string").withColumn("timestamp", F.col("timestamp").cast("timestamp"))
    return df.withColumns({"raw_payload": F.create_map(F.lit("raw"), F.lit("x")), "enrichment": F.create_map().cast("map<string,string>"), "stage_history": F.array(F.lit("parse"))})


@pytest.mark.parametrize("kind", ["memory", "parquet"])
def test_store(spark, tmp_path, kind):
    s = store.LogStore(spark, str(tmp_path / "t") if kind == "parquet" else None)
    assert s.query().count() == 0
    s.save_batch(records(spark).where("id < 3"))
    s.save_batch(records(spark).where("id >= 3"))
    ids = lambda **f: [r["id"] for r in s.query(store.QueryFilters(**f)).collect()]
    assert ids(severity="INFO", source="api") == ["1"] and sorted(ids(pipeline_run_id="other")) == ["3", "4"]
    assert ids(after="2024-01-01 00:00:00", before="2024-01-01 00:00:01") == ["1", "2"] and len(ids(limit=2)) == 2
    assert [tuple(r) for r in s.aggregate().collect()] == [("INFO", 3), ("ERROR", 1)]
    with pytest.raises(NotImplementedError):
        s.aggregate("message")
    with pytest.raises(ValueError):
        s.query(store.QueryFilters(limit=0))
    s.clear()
    assert s.all_records().count() == 0


def test_filters_reach_the_scan(spark, tmp_path):
    s = store.LogStore(spark, str(tmp_path / "t"))
    s.save_batch(records(spark))
    df = s.query(store.QueryFilters(severity="ERROR", after="2024-01-01 00:00:01", before="2024-01-03", limit=5)).select("id", "message")
    assert [r["id"] for r in df.collect()] == ["2"]
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(severity,ERROR)" in plan and "PartitionFilters: [isnotnull(date" in plan and "TakeOrderedAndProject" in plan and "enrichment" not in plan


def test_events_and_wrappers(spark):
    bus, got = events.EventBus(), events.CollectingListener()

    def broken(event):
        raise RuntimeError

    bus.subscribe(events.TracesClosed, broken)
    bus.subscribe(events.TracesClosed, got)
    df = spark.range(1)
    bus.publish(events.TracesClosed(df))
    bus.publish(events.AnomaliesPublished(df))
    assert len(got.events) == 1
    bus.unsubscribe(events.TracesClosed, got)
    bus.publish(events.TracesClosed(df))
    assert len(got.events) == 1
    waits, calls = [], []

    def flaky(df):
        calls.append(1)
        if len(calls) < 4:
            raise TransientStageError
        return df

    assert events.with_retry(flaky, 3, 0.05, 0.15, 2.0, waits.append)(df) is df and waits == [0.05, 0.1, 0.15]
    with pytest.raises(TransientStageError):
        calls.clear()
        events.with_retry(flaky, 1, sleep=waits.append)(df)
    m = metrics.MetricsRegistry()
    count = events.MetricsListener(m)
    count(events.TracesClosed(spark.createDataFrame([("timeout",), ("timeout",), ("evicted",)], "closed_reason string")))
    count(events.AnomaliesPublished(spark.createDataFrame([("iqr",)], "detector_name string")))
    assert m.snapshot()["counters"] == {"event.TracesClosed": 1, "event.AnomaliesPublished": 1, "traces.closed.timeout": 2, "traces.closed.evicted": 1, "anomalies.iqr": 1}
    m.reset()
    with pytest.raises(RuntimeError):
        events.with_timing(events.with_logging(broken, "s"), "s", m)(df)
    assert m.snapshot()["counters"] == {"stage.s.invocations": 1}
