import datetime as dt
import gzip

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from loomspark.errors import ConfigurationError, SourceError
from loomspark.functions import templates
from loomspark.functions.parsing import HDFS, default_parsers, detect, parse
from loomspark.operators import metrics
from loomspark.sources import generate, text
from pyspark.sql import functions as F

LINE = "081109 203615 148 INFO dfs.DataNode$PacketResponder: PacketResponder 1 for block blk_38865049064139660 terminating"


def rows(spark, lines, kind):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "i int, raw string")
    return [r.asDict() for r in parse(df, kind).orderBy("i").collect()]


def test_hdfs_line(spark):
    r = rows(spark, [LINE], "hdfs")[0]
    assert r["parse_error"] is None and r["severity"] == "INFO" and r["pid"] == "148" and r["source"] == "dfs.DataNode$PacketResponder"
    assert r["block_id"] == "blk_38865049064139660" and r["message"].startswith("PacketResponder 1") and r["raw"] == LINE and r["parse_warning"] is None
    assert r["timestamp"] == dt.datetime(2008, 11, 9, 20, 36, 15)


@pytest.mark.parametrize(
    ("line", "want"),
    [
        ("081109 203615 148 WARN a.B: x blk_-12 y blk_7", {"severity": "WARNING", "block_id": "blk_-12"}),
        ("081109 203615 148 FATAL a.B: ", {"severity": "CRITICAL", "message": "", "block_id": None, "parse_error": None}),
        ("081109 203615 148 NOTICE a: b", {"severity": "INFO", "parse_warning": "unknown level: NOTICE", "level_raw": "NOTICE"}),
        ("990101 000000 1 INFO a: b", {"timestamp": dt.datetime(1999, 1, 1)}),
        ("690101 000000 1 INFO a: b", {"timestamp": dt.datetime(1969, 1, 1)}),
        ("680101 000000 1 INFO a: b", {"timestamp": dt.datetime(2068, 1, 1)}),
        ("081109 203615 1 INFO a: b\rc", {"message": "b\rc"}),
    ],
)
def test_hdfs_cases(spark, line, want):
    r = rows(spark, [line], "hdfs")[0]
    assert {k: r[k] for k in want} == want


@pytest.mark.parametrize("line", ["junk", "", "991399 999999 1 INFO a: b", "081109 203660 1 INFO a: b", "081109 203615 x INFO a: b", "081109 203615 1 INFO a:b", "081109 203615 1 IN-FO a: b", None])
def test_hdfs_failures(spark, line):
    r = rows(spark, [line], "hdfs")[0]
    assert r["parse_error"] and r["timestamp"] is None and r["message"] is None


BGL = "KERNDTLB 1117838570 2005.06.03 R02-M1 2005-06-03-15.42.50.363779 R02-M1 RAS KERNEL FATAL data TLB  error "


def test_bgl(spark):
    r = rows(spark, [BGL, "  " + BGL, "- 1 2 3 4", BGL.replace("15.42", "25.42"), " ".join(BGL.split()[:9]) + "  ", ""], "bgl")
    assert r[0]["severity"] == "CRITICAL" and r[0]["bgl_label"] == "KERNDTLB" and r[0]["node"] == "R02-M1" and r[0]["message"] == "data TLB  error " and r[0]["type"] == "RAS"
    assert r[0]["timestamp"] == dt.datetime(2005, 6, 3, 15, 42, 50, 363779) and r[1]["message"] == r[0]["message"]
    assert all(x["parse_error"] for x in r[2:])


def test_structured_csv(spark):
    good = '7,081109,203615,148,INFO,dfs.A,"a, ""b"" blk_1",E5,a <*>'
    r = rows(spark, [good, "1,2,3", "", good.replace("203615", "993615"), good + ",more", '7,081109,203615,148,INFO,dfs.A,m,,t'], "hdfs_structured_csv")
    assert r[0]["message"] == 'a, "b" blk_1' and r[0]["event_id"] == "E5" and r[0]["line_id"] == "7" and r[0]["raw"] == '081109 203615 148 INFO dfs.A: a, "b" blk_1'
    assert [bool(x["parse_error"]) for x in r] == [False, True, True, True, False, False] and r[5]["event_id"] is None


def test_detect_and_auto(spark):
    lines = [LINE, '7,081109,203615,148,INFO,dfs.A,m,E1,t', BGL, "- x", "??", "", "   "]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "i int, raw string")
    assert [r[0] for r in df.orderBy("i").select(detect(F.col("raw"))).collect()] == ["hdfs", "hdfs_structured_csv", "bgl", "bgl", None, None, None]
    auto = rows(spark, lines, "auto")
    assert [bool(r["parse_error"]) for r in auto] == [False, False, False, True, True, True, True]
    assert auto[2]["bgl_label"] == "KERNDTLB" and auto[0]["block_id"]


def test_registry():
    parsers = default_parsers()
    with pytest.raises(ConfigurationError):
        parsers.register("hdfs", lambda: HDFS)
    with pytest.raises(ConfigurationError):
        parsers.create("nope")
    assert parsers.known_kinds() == ["bgl", "hdfs", "hdfs_structured_csv"]


def test_earlier_enrichment_is_kept_and_the_parser_wins(spark):
    df = spark.createDataFrame([(LINE, "blk_0", "E7")], "raw string, block_id string, event_id string")
    r = parse(df, "hdfs").first()
    assert r["block_id"] == "blk_38865049064139660" and r["event_id"] == "E7"


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet=st.characters(blacklist_categories=("Cs",)), max_size=60) | st.just(LINE), max_size=30))
def test_no_line_breaks_the_parsers(spark, lines):
    df = spark.createDataFrame([(x,) for x in lines], "raw string")
    for kind in ("hdfs", "bgl", "hdfs_structured_csv", "auto"):
        t = metrics.totals(parse(df.repartition(3), kind)).first()
        assert t["processed"] + t["failed"] == t["lines"] == len(lines)


def test_templates(spark):
    found = [("E10", "PacketResponder <*> for block blk_<*> terminating"), ("E1", "[*]Served block blk_<*> to"), ("E2", "Served block blk_5 to"), ("E3", "a.b(c)<*>\\E")]
    messages = [("PacketResponder 1 for block blk_3 terminating at once",), ("x Served block blk_5 to",), ("nothing",), ("a.b(c) \\E",), ("aXb(c) \\E",), ("PacketResponder 1\nfor block blk_3",)]
    df = spark.createDataFrame(messages, "message string")
    assert [r["event_id"] for r in templates.classify(df, found).collect()] == ["E10", "E1", None, "E3", None, None]
    assert [r["event_id"] for r in templates.classify(df, []).collect()] == [None] * 6


def test_sources(spark, tmp_path):
    (tmp_path / "a.log").write_text("one\n\n  \ntwo\n")
    with gzip.open(tmp_path / "b.log.gz", "wt") as f:
        f.write("three\n")
    assert sorted(r["raw"] for r in text.lines(spark, str(tmp_path)).collect()) == ["  ", "one", "three", "two"]
    assert [r["raw"] for r in text.cap(text.lines(spark, str(tmp_path / "a.log")), 2).collect()] == ["one", "  "]
    with pytest.raises(SourceError):
        text.lines(spark, str(tmp_path / "missing"))
    assert [r["raw"] for r in text.from_iterable(spark, ["a", "", "b"]).orderBy("seq").collect()] == ["a", "", "b"]
    import io

    assert [r["raw"] for r in text.from_stdin(spark, io.StringIO("x\n\ny\n"), str(tmp_path.parent)).orderBy("seq").collect()] == ["x", "", "y"]
    ids = [r["id"] for r in text.lines(spark, str(tmp_path)).collect()]
    assert len(set(ids)) == 4 and sorted(ids) == sorted(r["id"] for r in text.lines(spark, str(tmp_path)).collect())


def test_templates_and_labels_files(spark, tmp_path):
    (tmp_path / "t.csv").write_text('EventId,EventTemplate\nE1,"a, <*>"\nE2,\nE3,b\n')
    assert text.templates(spark, str(tmp_path / "t.csv")) == [("E1", "a, <*>"), ("E3", "b")]
    (tmp_path / "l.csv").write_text("BlockId,Label\nb1,Normal\nb2,Anomaly\nb1,Anomaly\nb3,\n")
    assert {r[0]: r[1] for r in text.labels(spark, str(tmp_path / "l.csv")).collect()} == {"b1": "Anomaly", "b2": "Anomaly"}
    with pytest.raises(ConfigurationError):
        text.templates(spark, str(tmp_path / "none.csv"))


def test_generators(spark):
    lines = generate.hdfs_lines(spark, 200, 0.3, 5)
    assert parse(lines, "hdfs").where("parse_error is not null").count() == 0
    assert {r[0] for r in lines.select("anomaly").distinct().collect()} == {None, "truncate", "reorder", "inject"}
    assert lines.repartition(7).select("raw").exceptAll(generate.hdfs_lines(spark, 200, 0.3, 5).select("raw")).count() == 0
    bgl = parse(generate.bgl_lines(spark, 300, 0.2), "bgl")
    assert bgl.where("parse_error is null").count() == 300 and bgl.where("alert and severity = 'CRITICAL' or not alert and bgl_label = '-'").count() == 300
    assert parse(generate.bench_lines(spark, 10)).where("parse_error is null").count() == 10


def test_custom_source(spark):
    from loomspark.sources import custom

    custom.register(spark, "test_lines", ["a", "b"], lambda part: (f"{part}{i}" for i in range(3)))
    out = custom.lines(spark, "test_lines").orderBy("file", "seq").collect()
    assert [r["raw"] for r in out] == ["a0", "a1", "a2", "b0", "b1", "b2"] and len({r["id"] for r in out}) == 6
