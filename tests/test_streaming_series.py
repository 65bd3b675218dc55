"""Buckets and detectors of a stream in several micro-batches against those of a batch."""

import json
import os
import random

import pytest

from loomspark.errors import ConfigurationError
from loomspark.operators.detect import Cusum, Iqr, ZScore
from loomspark.operators.validate import RateLimitValidator
from loomspark.streaming import series
from loomspark.streaming.traces import run_batches

SCHEMA = "id long, timestamp timestamp, source string, metric double"


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    rng = random.Random(4)
    path = tmp_path_factory.mktemp("series")
    rows = [{"id": i, "timestamp": f"2024-01-01 00:{i // 120:02d}:{i // 2 % 60:02d}", "source": rng.choice(["a", "b", "", None]), "metric": None if i % 31 == 0 else rng.gauss(5, 1) + 40 * (i % 97 == 0) + 3 * (i > 500)} for i in range(700)]
    for n in range(5):
        at = path / f"{n}.json"
        at.write_text("".join(json.dumps(r) + "\n" for r in rows[n * 140 : n * 140 + 140]))
        os.utime(at, (1_700_000_000 + n, 1_700_000_000 + n))
    return path


def streamed(spark, folder, checkpoint, build):
    got = []
    kept = spark.conf.get("spark.sql.streaming.stateStore.providerClass", None)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        rows = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).json(str(folder))
        q = run_batches(build(rows), str(checkpoint), lambda df, _: got.extend(df.collect()), available_now=True)
        assert q.awaitTermination(120)
        assert q.exception() is None
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass") if kept is None else spark.conf.set("spark.sql.streaming.stateStore.providerClass", kept)
    return {r["id"]: r for r in got}


@pytest.mark.parametrize("detector", [ZScore(window_size=40, min_samples=10), Iqr(window_size=40, min_samples=10), Cusum(warmup_samples=20)], ids=lambda d: d.name)
def test_detectors_of_a_stream(spark, folder, tmp_path, detector):
    got = streamed(spark, folder, tmp_path, lambda df: series.stream_scored(df, detector, ["id"], ["source"]))
    want = {r["id"]: r for r in detector.score(spark.read.schema(SCHEMA).json(str(folder)), ["id"], ["source"]).collect()}
    assert set(got) == set(want) and any(r["fired"] for r in want.values())
    for k, r in want.items():
        assert got[k]["fired"] == r["fired"] and (got[k]["score"] is None) == (r["score"] is None), k
        assert r["score"] is None or abs(got[k]["score"] - r["score"]) < 1e-6


def test_buckets_of_a_stream(spark, folder, tmp_path):
    limit = RateLimitValidator(capacity=3, refill_per_sec=0.25)
    got = streamed(spark, folder, tmp_path, lambda df: series.stream_limited(df, limit, ["id"]))
    want = {r["id"]: r["reject_reason"] for r in limit.apply(spark.read.schema(SCHEMA).json(str(folder)), ["id"]).collect()}
    assert {k: r["reject_reason"] for k, r in got.items()} == want and None in want.values() and len(set(want.values())) == 4


def test_other_detectors_have_no_streaming_form():
    with pytest.raises(ConfigurationError):
        series.detector_step(object())
