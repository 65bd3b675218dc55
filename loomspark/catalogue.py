"""The registered queries of the engine over the driver's tables, and the SQL that states what they should give.

Log lines are synthesised from events, one for each; the SQL reads the source columns and never parses a line.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspark.functions import parsing, templates
from loomspark.operators import detect, evaluate, metrics, ngram, sessionize, store, validate
from loomspark.schema import to_records
from loomspark.sources import text
from loomspark.streaming import traces as streaming

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

TEMPLATES = [("E1", "Served block blk_<*> to /user/<*>"), ("E2", "Exception in block <*>"), ("E3", "Order <*> for <*> completed"), ("E4", "Viewed [*] page [*]"), ("E5", "Exception in block blk_<*> code <*>")]
ORDER = ("timestamp", "event_no")

#: The synthesised columns in SQL.
EV = """ev AS (SELECT *, CASE event_type WHEN 'error' THEN 'ERROR' WHEN 'purchase' THEN 'WARN' WHEN 'signup' THEN 'NOTICE' ELSE 'INFO' END AS lvl,
  CASE event_type WHEN 'error' THEN 'ERROR' WHEN 'purchase' THEN 'WARNING' ELSE 'INFO' END AS sev,
  CASE event_type WHEN 'click' THEN 'E1' WHEN 'error' THEN 'E2' WHEN 'purchase' THEN 'E3' WHEN 'view' THEN 'E4' END AS ev_id,
  'app.' || event_type AS src, 'blk_' || CASE WHEN user_id % 2 = 1 THEN -user_id ELSE user_id END AS blk,
  event_id % 97 = 0 AS cut, event_id % 89 = 0 AND event_id % 97 <> 0 AS bad FROM events),
l AS (SELECT *, CASE event_type WHEN 'click' THEN 'Served block ' || blk || ' to /user/' || user_id WHEN 'error' THEN 'Exception in block ' || blk || ' code ' || event_id
  WHEN 'purchase' THEN 'Order ' || event_id || ' for ' || blk || ' completed' WHEN 'signup' THEN 'Registered ' || blk || ' by ' || event_id ELSE 'Viewed ' || blk || ' page ' || event_id END AS msg FROM ev),
g AS (SELECT * FROM l WHERE NOT cut AND NOT bad)"""


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def _text(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd HH:mm:ss")


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind, own = F.col("event_type"), F.col("event_id").cast("string")
    block = F.concat(F.lit("blk_"), F.when(F.col("user_id") % 2 == 1, -F.col("user_id")).otherwise(F.col("user_id")).cast("string"))
    content = (
        F.when(kind == "click", F.concat(F.lit("Served block "), block, F.lit(" to /user/"), F.col("user_id").cast("string")))
        .when(kind == "error", F.concat(F.lit("Exception in block "), block, F.lit(" code "), own))
        .when(kind == "purchase", F.concat(F.lit("Order "), own, F.lit(" for "), block, F.lit(" completed")))
        .when(kind == "signup", F.concat(F.lit("Registered "), block, F.lit(" by "), own))
        .otherwise(F.concat(F.lit("Viewed "), block, F.lit(" page "), own))
    )
    level = F.when(kind == "error", "ERROR").when(kind == "purchase", "WARN").when(kind == "signup", "NOTICE").otherwise("INFO")
    return _read(spark, sf_dir, "events").select("*", F.col("ts").cast("timestamp").alias("at"), content.alias("content"), level.alias("level"), F.col("event_id").alias("event_no"), F.col("event_id").cast("string").alias("id"))


def _opaque(df: DataFrame) -> DataFrame:
    """df whose synthesised lines stand like read ones: filters on parsed fields don't carry the synthesis with them."""
    return df.withColumn("raw", F.explode(F.array("raw")))


def hdfs_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """event_no, id, user_id, value, raw: a line for each event, some cut short, some of the 13th month."""
    ev = _events(spark, sf_dir)
    date = F.when(F.col("event_id") % 89 == 0, F.concat(F.date_format("at", "yy"), F.lit("13"), F.date_format("at", "dd"))).otherwise(F.date_format("at", "yyMMdd"))
    raw = F.concat(date, F.date_format("at", " HHmmss "), F.col("id"), F.lit(" "), F.col("level"), F.lit(" app."), F.col("event_type"), F.lit(": "), F.col("content"))
    return _opaque(ev.select("event_no", "id", "user_id", "value", F.when(F.col("event_id") % 97 == 0, F.substring(raw, 1, 10)).otherwise(raw).alias("raw")))


def bgl_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = _events(spark, sf_dir)
    error = F.col("event_type") == "error"
    parts = (F.when(error, "KERNDTLB").otherwise("-"), F.unix_timestamp("at").cast("string"), F.date_format("at", "yyyy.MM.dd"), F.concat(F.lit("R"), F.col("user_id").cast("string")), F.date_format("at", "yyyy-MM-dd-HH.mm.ss.SSSSSS"), F.lit("N0"), F.lit("RAS"), F.col("event_type"), F.when(error, "FATAL").otherwise(F.col("level")), F.col("content"))
    return _opaque(ev.select("event_no", "id", F.concat_ws(" ", *parts).alias("raw")))


def csv_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = _events(spark, sf_dir)
    parts = (F.col("id"), F.date_format("at", "yyMMdd"), F.date_format("at", "HHmmss"), F.col("user_id").cast("string"), F.col("level"), F.concat(F.lit("app."), F.col("event_type")), F.concat(F.lit('"'), F.col("content"), F.lit(', ""quoted"""')), F.concat(F.lit("E"), F.length("event_type").cast("string")), F.lit("template <*>"))
    return _opaque(ev.select("event_no", "id", F.concat_ws(",", *parts).alias("raw")))


def parsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parsing.parse(hdfs_lines(spark, sf_dir), "hdfs")


def good(spark: SparkSession, sf_dir: str) -> DataFrame:
    return templates.classify(parsed(spark, sf_dir).where("parse_error is null"), TEMPLATES)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parse, classify, group into traces, train on normal ones, score all."""
    return ngram_score(spark, sf_dir)


# parsing


@query(f"WITH {EV} SELECT event_id AS event_no, strftime(ts, '%Y-%m-%d %H:%M:%S') AS at, sev AS severity, src AS source, msg AS message, event_id::VARCHAR AS pid, lvl AS level_raw, blk AS block_id, CASE WHEN event_type = 'signup' THEN 'unknown level: NOTICE' END AS parse_warning FROM g")
def parse_hdfs_fields(spark, sf_dir):
    return parsed(spark, sf_dir).where("parse_error is null").select("event_no", _text(F.col("timestamp")).alias("at"), "severity", "source", "message", "pid", "level_raw", "block_id", "parse_warning")


@query(f"WITH {EV} SELECT event_id AS event_no, CASE WHEN cut THEN 'shape' ELSE 'time' END AS kind FROM l WHERE cut OR bad")
def parse_hdfs_failures(spark, sf_dir):
    return parsed(spark, sf_dir).where("parse_error is not null").select("event_no", F.when(F.col("parse_error").startswith("invalid HDFS timestamp"), "time").otherwise("shape").alias("kind"))


@query(f"WITH {EV} SELECT sev AS severity, count(*) AS n FROM g WHERE event_type = 'signup' GROUP BY 1")
def parse_unknown_level(spark, sf_dir):
    return parsed(spark, sf_dir).where("parse_warning is not null").groupBy("severity").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {EV} SELECT event_id AS event_no, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS at, CASE WHEN event_type = 'error' THEN 'CRITICAL' ELSE sev END AS severity, event_type AS source, msg AS message, CASE WHEN event_type = 'error' THEN 'KERNDTLB' ELSE '-' END AS bgl_label, 'R' || user_id AS node, 'RAS' AS type, 'N0' AS node_repeat FROM l")
def parse_bgl_fields(spark, sf_dir):
    out = parsing.parse(bgl_lines(spark, sf_dir), "bgl").where("parse_error is null")
    return out.select("event_no", F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("at"), "severity", "source", "message", "bgl_label", "node", "type", "node_repeat")


@query("SELECT CASE WHEN event_type = 'error' THEN 'KERNDTLB' ELSE '-' END AS bgl_label, count(*) AS n FROM events GROUP BY 1")
def parse_bgl_label_counts(spark, sf_dir):
    return parsing.parse(bgl_lines(spark, sf_dir), "bgl").where("parse_error is null").groupBy("bgl_label").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {EV} SELECT event_id::VARCHAR AS line_id, 'E' || length(event_type) AS event_id, msg || ', "quoted"' AS message, blk AS block_id, sev AS severity, src AS source, strftime(ts, '%y%m%d %H%M%S') || ' ' || user_id || ' ' || lvl || ' ' || src || ': ' || msg || ', "quoted"' AS raw FROM l""")
def parse_structured_csv(spark, sf_dir):
    return parsing.parse(csv_lines(spark, sf_dir), "hdfs_structured_csv").where("parse_error is null").select("line_id", "event_id", "message", "block_id", "severity", "source", "raw")


def _any(spark, sf_dir):
    kinds = [x.select("event_no", F.col("raw").alias(n)) for x, n in ((hdfs_lines(spark, sf_dir), "h"), (csv_lines(spark, sf_dir), "c"), (bgl_lines(spark, sf_dir), "b"))]
    out = kinds[0].join(kinds[1], "event_no").join(kinds[2], "event_no")
    part = F.col("event_no") % 4
    return _opaque(out.select("event_no", F.when(part == 0, F.col("h")).when(part == 1, F.col("c")).when(part == 2, F.col("b")).otherwise("?? no format").alias("raw")))


@query("SELECT CASE event_id % 4 WHEN 0 THEN CASE WHEN event_id % 97 = 0 THEN 'none' ELSE 'hdfs' END WHEN 1 THEN 'hdfs_structured_csv' WHEN 2 THEN 'bgl' ELSE 'none' END AS format, count(*) AS n FROM events GROUP BY 1")
def detect_format(spark, sf_dir):
    return _any(spark, sf_dir).groupBy(F.coalesce(parsing.detect(F.col("raw")), F.lit("none")).alias("format")).agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {EV} SELECT event_id % 4 AS part, count(*) FILTER (event_id % 4 = 3 OR (event_id % 4 = 0 AND (cut OR bad))) AS failed, count(*) AS n FROM l GROUP BY 1")
def parse_auto(spark, sf_dir):
    out = parsing.parse(_any(spark, sf_dir), "auto")
    return out.groupBy((F.col("event_no") % 4).alias("part")).agg(F.sum(F.col("parse_error").isNotNull().cast("long")).alias("failed"), F.count(F.lit(1)).alias("n"))


@query("SELECT count(*) AS rows, count(*) AS severity, count(*) AS source, count(*) AS block_id, count(*) AS message FROM events WHERE event_id % 97 <> 0 AND event_id % 89 <> 0")
def parser_agreement(spark, sf_dir):
    """Two parsers of the same events agree in their fields."""
    left = parsed(spark, sf_dir).where("parse_error is null")
    right = parsing.parse(csv_lines(spark, sf_dir), "hdfs_structured_csv").withColumn("message", F.regexp_replace("message", ', "quoted"$', ""))
    return evaluate.agreement(left, right, "event_no", ["severity", "source", "block_id", "message"])


# validation


@query(f"WITH {EV} SELECT CASE WHEN event_id % 13 = 0 THEN 'missing message' WHEN event_id % 11 = 0 THEN 'missing source' WHEN sev = 'ERROR' THEN 'severity ERROR not in allowlist' ELSE 'valid' END AS reason, count(*) AS n FROM g GROUP BY 1")
def validate_schema(spark, sf_dir):
    rows = good(spark, sf_dir).withColumn("message", F.when(F.col("event_no") % 13 == 0, "").otherwise(F.col("message"))).withColumn("source", F.when(F.col("event_no") % 11 == 0, "").otherwise(F.col("source")))
    out = validate.chain(rows, [validate.SchemaValidator(require_source=True, allowed_severities=["INFO", "WARNING"])])
    return out.groupBy(F.coalesce("reject_reason", F.lit("valid")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT doc_id, octet_length(encode(text))::BIGINT AS n_bytes, octet_length(encode(text)) > 4000 AS rejected FROM documents")
def validate_size(spark, sf_dir):
    docs = _read(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("message"))
    out = validate.chain(docs, [validate.SizeValidator(4000)])
    return out.select("doc_id", F.octet_length("message").cast("long").alias("n_bytes"), F.col("reject_reason").isNotNull().alias("rejected"))


@query(f"WITH {EV} SELECT event_id AS event_no, CASE WHEN octet_length(encode(msg)) > 30 THEN 'size' ELSE 'schema' END AS first FROM g WHERE octet_length(encode(msg)) > 30 OR sev = 'INFO'")
def validate_chain_first_reason(spark, sf_dir):
    out = validate.chain(good(spark, sf_dir), [validate.SizeValidator(30), validate.SchemaValidator(allowed_severities=["WARNING", "ERROR"])])
    return out.where("reject_reason is not null").select("event_no", F.when(F.col("reject_reason").contains("bytes"), "size").otherwise("schema").alias("first"))


@query("""WITH RECURSIVE e AS (SELECT event_id, event_type, epoch_us(ts) / 1e6 AS t, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS rn FROM events),
r AS (SELECT event_id, event_type, rn, t, 2.0::DOUBLE AS tokens, false AS rejected FROM e WHERE rn = 1
  UNION ALL SELECT e.event_id, e.event_type, e.rn, e.t, s.tok - CASE WHEN s.tok >= 1 THEN 1 ELSE 0 END, s.tok < 1
  FROM (SELECT r.event_type, r.rn, least(3.0::DOUBLE, r.tokens + greatest(0.0::DOUBLE, n.t - r.t) * 0.0005::DOUBLE) AS tok FROM r JOIN e n ON n.event_type = r.event_type AND n.rn = r.rn + 1) s
  JOIN e ON e.event_type = s.event_type AND e.rn = s.rn + 1)
SELECT event_id AS event_no, rejected FROM r""")
def rate_limit(spark, sf_dir):
    rows = _events(spark, sf_dir).select("event_no", F.col("event_type").alias("source"), F.col("at").alias("timestamp"))
    out = validate.chain(rows, [validate.RateLimitValidator(3, 0.0005)], ["timestamp", "event_no"])
    return out.select("event_no", F.col("reject_reason").isNotNull().alias("rejected"))


@query(f"WITH {EV} SELECT CASE WHEN sev = 'INFO' THEN 'kept' ELSE 'severity ' || sev || ' not in allowlist' END AS lane, count(*) AS n FROM g GROUP BY 1")
def reject_routing(spark, sf_dir):
    """Rows that pass, and the quarantine with its reasons."""
    kept, rejected = validate.route(validate.chain(good(spark, sf_dir), [validate.SchemaValidator(allowed_severities=["INFO"])]))
    lanes = kept.select(F.lit("kept").alias("lane")).unionByName(rejected.select(F.col("reject_reason").alias("lane")))
    return lanes.groupBy("lane").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {EV} SELECT event_id AS event_no FROM g ORDER BY date_trunc('second', ts), event_id LIMIT 250")
def line_cap(spark, sf_dir):
    return text.cap(good(spark, sf_dir), 250, ORDER).select("event_no")


# records


@query(f"WITH {EV} SELECT 'run-7' AS pipeline_run_id, 'parse:hdfs>template_matcher' AS stages, sev AS severity, count(*) AS n FROM g GROUP BY 3")
def record_history(spark, sf_dir):
    rows = to_records(good(spark, sf_dir), "run-7", ("parse:hdfs", "template_matcher"))
    return rows.groupBy("pipeline_run_id", F.array_join("stage_history", ">").alias("stages"), "severity").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {EV} SELECT event_id::VARCHAR AS id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS at, sev AS severity, src AS source, msg AS message, event_id::VARCHAR AS pid, blk AS block_id, ev_id AS event, CASE WHEN event_type = 'signup' THEN 'unknown level: NOTICE' END AS warning FROM g")
def record_projection(spark, sf_dir):
    """Records as the read API has them: typed columns, and the open maps."""
    rows = to_records(good(spark, sf_dir))
    own = lambda bag, key: F.col(bag)[key]
    return rows.select("id", _text(F.col("timestamp")).alias("at"), "severity", "source", "message", own("raw_payload", "pid").alias("pid"), own("enrichment", "block_id").alias("block_id"), own("enrichment", "event_id").alias("event"), own("enrichment", "parse_warning").alias("warning"))


# templates


@query(f"WITH {EV} SELECT ev_id AS event_id, count(*) AS n FROM g WHERE ev_id IS NOT NULL GROUP BY 1")
def template_match(spark, sf_dir):
    return good(spark, sf_dir).where("event_id is not null").groupBy("event_id").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {EV} SELECT event_id AS event_no, msg AS message FROM g WHERE ev_id IS NULL")
def template_unmatched(spark, sf_dir):
    return good(spark, sf_dir).where("event_id is null").select("event_no", "message")


# traces


@query(f"WITH {EV} SELECT blk AS block_id, count(*)::INTEGER AS record_count, coalesce(string_agg(ev_id, ',' ORDER BY date_trunc('second', ts), event_id), '') AS events, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS first, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS last FROM g GROUP BY 1")
def sessions_per_block(spark, sf_dir):
    out = sessionize.traces(good(spark, sf_dir), ORDER, None, janitor="none")
    return out.select("block_id", "record_count", F.array_join("event_sequence", ",").alias("events"), _text(F.col("first_timestamp")).alias("first"), _text(F.col("last_timestamp")).alias("last"))


CAPPED = f"WITH {EV}, c AS (SELECT *, floor(count(ev_id) OVER (PARTITION BY blk ORDER BY date_trunc('second', ts), event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) / 7)::BIGINT AS chunk FROM g)"


@query(CAPPED + " SELECT blk AS block_id, chunk, count(*)::INTEGER AS record_count, coalesce(string_agg(ev_id, ',' ORDER BY date_trunc('second', ts), event_id), '') AS events FROM c GROUP BY 1, 2")
def sessions_capped(spark, sf_dir):
    out = sessionize.traces(good(spark, sf_dir), ORDER, 7, janitor="none")
    return out.select("block_id", "chunk", "record_count", F.array_join("event_sequence", ",").alias("events"))


@query(CAPPED + ", t AS (SELECT blk, chunk, count(ev_id) AS n, bool_or(ev_id = 'E3') AS done, max(date_trunc('second', ts)) AS last FROM c GROUP BY 1, 2) SELECT CASE WHEN n >= 7 THEN 'evicted' WHEN done THEN 'terminal' WHEN last < (SELECT max(date_trunc('second', ts)) FROM g) - INTERVAL 8 HOUR THEN 'timeout' ELSE 'shutdown' END AS closed_reason, count(*) AS n FROM t GROUP BY 1")
def sessions_close_reason(spark, sf_dir):
    return sessionize.traces(good(spark, sf_dir), ORDER, 7, 8 * 3600.0, ["E3"]).groupBy("closed_reason").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {EV} SELECT blk AS block_id, event_id AS event_no, (row_number() OVER (PARTITION BY blk ORDER BY date_trunc('second', ts), event_id) - 1)::INTEGER AS position FROM g")
def trace_records(spark, sf_dir):
    rows = good(spark, sf_dir)
    return sessionize.trace_records(sessionize.traces(rows, ORDER, None, janitor="none"), rows.select("id", "event_no")).select("block_id", "event_no", "position")


@query(f"WITH {EV}, o AS (SELECT blk, date_trunc('second', ts) AS t, CASE WHEN date_trunc('second', ts) - lag(date_trunc('second', ts)) OVER (PARTITION BY blk ORDER BY ts, event_id) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM g), s AS (SELECT blk, t, sum(new) OVER (PARTITION BY blk ORDER BY t ROWS UNBOUNDED PRECEDING) AS k FROM (SELECT * FROM o ORDER BY t)) SELECT block_id, strftime(first, '%Y-%m-%d %H:%M:%S') AS start, strftime(last + INTERVAL 6 HOUR, '%Y-%m-%d %H:%M:%S') AS end_, records FROM (SELECT blk AS block_id, min(t) AS first, max(t) AS last, count(*) AS records FROM s GROUP BY blk, k)")
def session_windows(spark, sf_dir):
    out = streaming.stream_sessions(good(spark, sf_dir), "6 hours")
    return out.select("block_id", _text(F.col("start")).alias("start"), _text(F.col("end")).alias("end_"), "records")


@query(f"WITH {EV} SELECT strftime(time_bucket(INTERVAL 3 HOUR, ts, TIMESTAMP '1970-01-01'), '%Y-%m-%d %H:%M:%S') AS bin, sev AS severity, count(*) AS n FROM g GROUP BY 1, 2")
def tumbling_windows(spark, sf_dir):
    return streaming.stream_rates(good(spark, sf_dir), "3 hours", by=["severity"]).select(_text(F.col("bin")).alias("bin"), "severity", "n")


# n-gram model


def _labelled(spark, sf_dir):
    traces = sessionize.traces(good(spark, sf_dir), ORDER, None, janitor="none")
    labels = _read(spark, sf_dir, "events").select(F.col("user_id"), F.concat(F.lit("blk_"), F.when(F.col("user_id") % 2 == 1, -F.col("user_id")).otherwise(F.col("user_id")).cast("string")).alias("BlockId"), F.when(F.col("user_id") % 3 == 0, "Normal").otherwise("Anomaly").alias("Label")).distinct()
    return ngram.labelled(traces, labels)


GRAMS = f"WITH {EV}, s AS (SELECT blk, user_id, ev_id, event_id, row_number() OVER (PARTITION BY blk ORDER BY date_trunc('second', ts), event_id) AS rn FROM g WHERE ev_id IS NOT NULL), b AS (SELECT blk, user_id, ev_id || ' ' || lead(ev_id) OVER w || ' ' || lead(ev_id, 2) OVER w || ' ' || lead(ev_id, 3) OVER w AS gram FROM s WINDOW w AS (PARTITION BY blk ORDER BY rn)), d AS (SELECT DISTINCT blk, user_id, gram FROM b WHERE gram IS NOT NULL), m AS (SELECT DISTINCT gram FROM d WHERE user_id % 3 = 0)"
N = 4


@query(GRAMS + " SELECT gram FROM m")
def ngram_train(spark, sf_dir):
    return ngram.normal_ngrams(_labelled(spark, sf_dir), N).select(F.array_join("gram", " ").alias("gram"))


@query(f"WITH {EV} SELECT DISTINCT ev_id AS event FROM g WHERE ev_id IS NOT NULL")
def ngram_vocab(spark, sf_dir):
    return ngram.vocabulary(_labelled(spark, sf_dir))


SCORED = GRAMS + ", x AS (SELECT d.blk, d.user_id, count(*) AS seen, count(*) FILTER (m.gram IS NULL) AS novel FROM d LEFT JOIN m USING (gram) GROUP BY 1, 2)"


def _scored(spark, sf_dir):
    traces = _labelled(spark, sf_dir)
    return ngram.score(traces, ngram.normal_ngrams(traces, N), 0.1, N)


@query(SCORED + " SELECT blk AS block_id, seen::INTEGER AS observed_count, novel::INTEGER AS novel_count, round(novel / seen, 6) AS ratio, novel / seen > 0.1 AS fired FROM x")
def ngram_score(spark, sf_dir):
    return _scored(spark, sf_dir).where("observed_count > 0").select("block_id", "observed_count", "novel_count", F.round("ratio", 6).alias("ratio"), "fired")


@query(SCORED + ", u AS (SELECT DISTINCT blk, user_id FROM g), p AS (SELECT u.user_id % 3 <> 0 AS a, coalesce(novel / seen > 0.1, false) AS p FROM u LEFT JOIN x USING (blk)), c AS (SELECT count(*) FILTER (p AND a) AS tp, count(*) FILTER (p AND NOT a) AS fp, count(*) FILTER (a AND NOT p) AS fn, count(*) FILTER (NOT a AND NOT p) AS tn FROM p), r AS (SELECT *, coalesce(tp / nullif(tp + fp, 0), 0.0)::DOUBLE AS pr, coalesce(tp / nullif(tp + fn, 0), 0.0)::DOUBLE AS re FROM c) SELECT tp, fp, fn, tn, round(pr, 4) AS precision, round(re, 4) AS recall, round(coalesce(2 * pr * re / nullif(pr + re, 0), 0.0), 4)::DOUBLE AS f1 FROM r")
def ngram_confusion(spark, sf_dir):
    return evaluate.confusion(_scored(spark, sf_dir), "fired", F.col("label") == "Anomaly")


#: As GRAMS, of six events.
LONG_GRAMS = GRAMS.replace("lead(ev_id, 3) OVER w AS gram", "lead(ev_id, 3) OVER w || ' ' || lead(ev_id, 4) OVER w || ' ' || lead(ev_id, 5) OVER w AS gram")


@query(LONG_GRAMS + ", n AS (SELECT d.blk, d.gram FROM d LEFT JOIN m USING (gram) WHERE m.gram IS NULL) SELECT blk AS block_id, array_to_string(list_sort(list(gram))[1:20], ',') AS novel FROM n GROUP BY 1")
def ngram_novel_sorted(spark, sf_dir):
    """The novel n-grams of a block, sorted, the first 20."""
    traces = _labelled(spark, sf_dir)
    out = ngram.score(traces, ngram.normal_ngrams(traces, 6), 0.1, 6).where("novel_count > 0")
    return out.select("block_id", F.array_join(F.transform("novel_ngrams", lambda g: F.array_join(g, " ")), ",").alias("novel"))


@query(f"WITH {EV}, u AS (SELECT DISTINCT blk, user_id FROM g), p AS (SELECT DISTINCT blk FROM g WHERE sev = 'ERROR'), c AS (SELECT count(*) FILTER (p.blk IS NOT NULL AND user_id % 3 <> 0) AS tp, count(*) FILTER (p.blk IS NOT NULL AND user_id % 3 = 0) AS fp, count(*) FILTER (p.blk IS NULL AND user_id % 3 <> 0) AS fn, count(*) FILTER (p.blk IS NULL AND user_id % 3 = 0) AS tn FROM u LEFT JOIN p USING (blk)), r AS (SELECT *, coalesce(tp / nullif(tp + fp, 0), 0.0)::DOUBLE AS pr, coalesce(tp / nullif(tp + fn, 0), 0.0)::DOUBLE AS re FROM c) SELECT tp, fp, fn, tn, round(pr, 4) AS precision, round(re, 4) AS recall, round(coalesce(2 * pr * re / nullif(pr + re, 0), 0.0), 4)::DOUBLE AS f1 FROM r")
def confusion_of_sets(spark, sf_dir):
    """Blocks, those with an error line, and those labelled: their union, intersections and differences counted."""
    rows = good(spark, sf_dir).select("block_id", "severity")
    return evaluate.confusion_from_sets(rows, rows.where("severity = 'ERROR'"), _labelled(spark, sf_dir).where("label = 'Anomaly'"), "block_id")


@query("WITH w AS (SELECT doc_id, toxic, string_split(text, ' ') AS ws FROM documents JOIN labels USING (doc_id)), b AS (SELECT DISTINCT doc_id, toxic, ws[i] || ' ' || ws[i + 1] AS gram FROM (SELECT doc_id, toxic, ws, unnest(range(1, len(ws))) AS i FROM w)), m AS (SELECT DISTINCT gram FROM b WHERE toxic = 0) SELECT doc_id, count(*) AS observed_count, count(*) FILTER (m.gram IS NULL) AS novel_count FROM b LEFT JOIN m USING (gram) WHERE toxic = 1 GROUP BY 1")
def ngram_documents(spark, sf_dir):
    docs = _read(spark, sf_dir, "documents").join(_read(spark, sf_dir, "labels"), "doc_id").select("doc_id", F.split("text", " ").alias("event_sequence"), F.when(F.col("toxic") == 0, "Normal").otherwise("Anomaly").alias("label"))
    out = ngram.score_by_join(docs.where("label = 'Anomaly'"), ngram.normal_ngrams(docs, 2), "doc_id", 2)
    return out


# series


def _series(spark, sf_dir):
    return _events(spark, sf_dir).select("event_no", "id", "event_type", F.col("at").alias("timestamp"), F.col("value").alias("metric"))


def _hourly(spark, sf_dir):
    return evaluate.rates(_series(spark, sf_dir), 3600).select(F.col("bin").alias("timestamp"), _text(F.col("bin")).alias("id"), F.col("n").alias("metric"))


HOURLY = "h AS (SELECT date_trunc('hour', ts) AS bin, count(*)::DOUBLE AS x FROM events GROUP BY 1)"


def _z_sql(source: str, key: str, order: str) -> str:
    return f"""z AS (SELECT {key}, x, count(x) OVER w AS n, avg(x) OVER w AS m, stddev_pop(x) OVER w AS s FROM {source} WINDOW w AS (ORDER BY {order} ROWS BETWEEN 200 PRECEDING AND 1 PRECEDING))
    SELECT {key}, round(abs((x - m) / s), 6) AS score FROM z WHERE n >= 50 AND s > 0 AND abs((x - m) / s) > 3"""


def _iqr_sql(source: str, key: str, order: str) -> str:
    return f"""q AS (SELECT {key}, x, count(x) OVER w AS n, quantile_cont(x, 0.25) OVER w AS q1, quantile_cont(x, 0.75) OVER w AS q3 FROM {source} WINDOW w AS (ORDER BY {order} ROWS BETWEEN 200 PRECEDING AND 1 PRECEDING)),
    f AS (SELECT *, q1 - 1.5 * (q3 - q1) AS lo, q3 + 1.5 * (q3 - q1) AS hi FROM q WHERE n >= 50 AND q3 > q1)
    SELECT {key}, CASE WHEN x < lo THEN 'below' ELSE 'above' END AS side, round(CASE WHEN x < lo THEN lo - x ELSE x - hi END, 6) AS score FROM f WHERE x < lo OR x > hi"""


def _cusum_sql(rows: str) -> str:
    """rows: a query of (k, series, x, rn)."""
    return f"""WITH RECURSIVE {HOURLY}, v AS ({rows}), t AS (SELECT series, avg(x) AS m, greatest(stddev_pop(x), 1e-12) AS s FROM v WHERE rn <= 50 GROUP BY 1),
    d AS (SELECT k, series, rn, (x - m) / s AS d FROM v JOIN t USING (series) WHERE rn > 50),
    c AS (SELECT k, series, rn, greatest(0, d - 0.25)::DOUBLE AS hi, greatest(0, -d - 0.25)::DOUBLE AS lo FROM d WHERE rn = 51
      UNION ALL SELECT d.k, d.series, d.rn, greatest(0, CASE WHEN c.hi > 2 OR c.lo > 2 THEN 0 ELSE c.hi END + d - 0.25)::DOUBLE, greatest(0, CASE WHEN c.hi > 2 OR c.lo > 2 THEN 0 ELSE c.lo END - d - 0.25)::DOUBLE FROM c JOIN d ON d.series = c.series AND d.rn = c.rn + 1)
    SELECT k AS id, CASE WHEN hi > 2 THEN 'up' ELSE 'down' END AS direction, round(greatest(hi, lo), 6) AS score FROM c WHERE hi > 2 OR lo > 2"""


@query(f"WITH {HOURLY} SELECT strftime(bin, '%Y-%m-%d %H:%M:%S') AS bin, x::BIGINT AS n FROM h")
def rate_bins_1h(spark, sf_dir):
    return evaluate.rates(_series(spark, sf_dir), 3600).select(_text(F.col("bin")).alias("bin"), "n")


@query("SELECT strftime(date_trunc('minute', ts) + INTERVAL 1 SECOND * (floor(second(ts) / 45) * 45)::INTEGER, '%Y-%m-%d %H:%M:%S') AS bin, count(*) AS n, bool_or(event_type = 'error') AS alert FROM events GROUP BY 1")
def rate_bins_45s_rule(spark, sf_dir):
    return evaluate.rates(_series(spark, sf_dir), 45, F.col("event_type") == "error").select(_text(F.col("bin")).alias("bin"), "n", "alert")


@query("WITH v AS (SELECT event_id AS event_no, ts, value AS x FROM events), " + _z_sql("v", "event_no", "ts, event_no"))
def zscore_value(spark, sf_dir):
    return detect.ZScore(window_size=200, min_samples=50).fired(_series(spark, sf_dir), ORDER).select("event_no", F.round("score", 6).alias("score"))


@query("WITH v AS (SELECT event_id AS event_no, ts, value AS x FROM events), " + _z_sql("v", "event_no", "ts, event_no"))
def zscore_value_in_runs(spark, sf_dir):
    """As zscore_value, with the one series cut into runs that are tasks of their own."""
    return detect.ZScore(window_size=200, min_samples=50, chunk_rows=2000).fired(_series(spark, sf_dir), ORDER).select("event_no", F.round("score", 6).alias("score"))


@query("WITH v AS (SELECT event_id AS event_no, ts, value AS x FROM events WHERE event_type <> 'view'), " + _z_sql("v", "event_no", "ts, event_no"))
def numeric_guard(spark, sf_dir):
    """Rows without a number are in no window; the metric is read from the raw payload."""
    rows = _series(spark, sf_dir).withColumn("raw_payload", F.create_map(F.lit("ms"), F.when(F.col("event_type") == "view", "n/a").otherwise(F.col("metric").cast("string")))).drop("metric")
    return detect.ZScore("ms", window_size=200, min_samples=50, source_dict="raw_payload").fired(rows, ORDER).select("event_no", F.round("score", 6).alias("score"))


@query(f"WITH {HOURLY}, k AS (SELECT strftime(bin, '%Y-%m-%d %H:%M:%S') AS id, x FROM h), " + _z_sql("k", "id", "id"))
def zscore_hourly(spark, sf_dir):
    return detect.ZScore(window_size=200, min_samples=50).fired(_hourly(spark, sf_dir), ["timestamp"]).select("id", F.round("score", 6).alias("score"))


@query("WITH v AS (SELECT event_id AS event_no, ts, value AS x FROM events), " + _iqr_sql("v", "event_no", "ts, event_no"))
def iqr_value(spark, sf_dir):
    return detect.Iqr(window_size=200, min_samples=50).fired(_series(spark, sf_dir), ORDER).select("event_no", "side", F.round("score", 6).alias("score"))


@query(f"WITH {HOURLY}, k AS (SELECT strftime(bin, '%Y-%m-%d %H:%M:%S') AS id, x FROM h), " + _iqr_sql("k", "id", "id"))
def iqr_hourly(spark, sf_dir):
    return detect.Iqr(window_size=200, min_samples=50).fired(_hourly(spark, sf_dir), ["timestamp"]).select("id", "side", F.round("score", 6).alias("score"))


def _cusum():
    return detect.Cusum(threshold=2.0, slack=0.25, warmup_samples=50)


@query(_cusum_sql("SELECT strftime(bin, '%Y-%m-%d %H:%M:%S') AS k, 'a' AS series, x, row_number() OVER (ORDER BY bin) AS rn FROM h"))
def cusum_hourly(spark, sf_dir):
    return _cusum().fired(_hourly(spark, sf_dir), ["timestamp"]).select("id", "direction", F.round("score", 6).alias("score"))


@query(_cusum_sql("SELECT event_id::VARCHAR AS k, event_type AS series, value AS x, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS rn FROM events"))
def cusum_by_type(spark, sf_dir):
    return _cusum().fired(_series(spark, sf_dir), ORDER, ["event_type"]).select("id", "direction", F.round("score", 6).alias("score"))


@query("WITH v AS (SELECT event_id AS event_no, ts, value AS x FROM events), " + _z_sql("v", "event_no", "ts, event_no").replace("SELECT event_no, round(abs((x - m) / s), 6) AS score FROM z WHERE n >= 50 AND s > 0 AND abs((x - m) / s) > 3", "SELECT event_no, CASE WHEN n >= 50 AND s > 0 AND abs((x - m) / s) > 3 THEN round(abs((x - m) / s), 6) END AS tag FROM z"))
def detector_tags(spark, sf_dir):
    out = detect.tagged(_series(spark, sf_dir), detect.ZScore(window_size=200, min_samples=50), ORDER)
    return out.select("event_no", F.round("anomaly_z_score", 6).alias("tag"))


# reading


@query(f"WITH {EV} SELECT event_id AS event_no, msg AS message FROM g WHERE sev = 'ERROR' AND src = 'app.error'")
def logs_filter(spark, sf_dir):
    return store.filtered(good(spark, sf_dir), store.QueryFilters(severity="ERROR", source="app.error")).select("event_no", "message")


@query(f"WITH {EV} SELECT event_id AS event_no FROM g WHERE date_trunc('second', ts) BETWEEN TIMESTAMP '2024-01-05 00:00:00' AND TIMESTAMP '2024-01-06 12:00:00'")
def logs_time_range(spark, sf_dir):
    return store.filtered(good(spark, sf_dir), store.QueryFilters(after="2024-01-05 00:00:00", before="2024-01-06 12:00:00")).select("event_no")


@query(f"WITH {EV} SELECT event_id AS event_no, src AS source FROM g WHERE sev = 'WARNING' ORDER BY date_trunc('second', ts), event_id LIMIT 100")
def logs_topn(spark, sf_dir):
    return store.query_logs(good(spark, sf_dir), store.QueryFilters(severity="WARNING", limit=100), ORDER).select("event_no", "source")


@query(f"WITH {EV} SELECT sev AS severity, count(*) AS count FROM g GROUP BY 1")
def agg_by_severity(spark, sf_dir):
    return store.aggregate_logs(good(spark, sf_dir), "severity")


@query(f"WITH {EV} SELECT src AS source, count(*) AS count FROM g GROUP BY 1")
def agg_by_source(spark, sf_dir):
    return store.aggregate_logs(good(spark, sf_dir), "source")


def _anomalies(spark, sf_dir):
    rows = _series(spark, sf_dir)
    return store.union_anomalies(detect.ZScore(window_size=200, min_samples=50).anomalies(rows, ORDER), detect.Iqr(window_size=200, min_samples=50).anomalies(rows, ORDER))


ZI = """v AS (SELECT event_id, ts, value AS x FROM events), o AS (SELECT *, count(x) OVER w AS n, avg(x) OVER w AS m, stddev_pop(x) OVER w AS s, quantile_cont(x, 0.25) OVER w AS q1, quantile_cont(x, 0.75) OVER w AS q3 FROM v WINDOW w AS (ORDER BY ts, event_id ROWS BETWEEN 200 PRECEDING AND 1 PRECEDING)),
u AS (SELECT event_id, ts, 'z_score' AS detector_name, round(abs((x - m) / s), 6) AS score FROM o WHERE n >= 50 AND s > 0 AND abs((x - m) / s) > 3
  UNION ALL SELECT event_id, ts, 'iqr', round(greatest(q1 - 1.5 * (q3 - q1) - x, x - q3 - 1.5 * (q3 - q1)), 6) FROM o WHERE n >= 50 AND q3 > q1 AND (x < q1 - 1.5 * (q3 - q1) OR x > q3 + 1.5 * (q3 - q1)))"""


@query(f"WITH {ZI} SELECT detector_name, count(*) AS n, round(max(score), 6) AS top FROM u GROUP BY 1")
def anomaly_union(spark, sf_dir):
    return _anomalies(spark, sf_dir).groupBy("detector_name").agg(F.count(F.lit(1)).alias("n"), F.round(F.max("severity_score"), 6).alias("top"))


@query(f"WITH {ZI} SELECT event_id::VARCHAR AS log_record_id, score FROM u WHERE detector_name = 'z_score' ORDER BY ts DESC, event_id LIMIT 20")
def anomalies_topn(spark, sf_dir):
    return store.list_anomalies(_anomalies(spark, sf_dir), "z_score", 20).select("log_record_id", F.round("severity_score", 6).alias("score"))


@query(f"WITH {EV}, t AS (SELECT blk, user_id, count(*) AS n FROM g GROUP BY 1, 2) SELECT CASE WHEN user_id % 3 = 0 THEN 'Normal' ELSE 'Anomaly' END AS label, count(*) AS blocks, sum(n)::BIGINT AS records FROM t GROUP BY 1")
def label_join(spark, sf_dir):
    return _labelled(spark, sf_dir).groupBy("label").agg(F.count(F.lit(1)).alias("blocks"), F.sum("record_count").cast("long").alias("records"))


@query("WITH s AS (SELECT event_type, list_sort(list(value)) AS v FROM events GROUP BY 1) SELECT event_type, len(v)::BIGINT AS count, round(list_sum(v), 4) AS total, v[least(len(v) - 1, floor(0.5 * len(v))::BIGINT) + 1] AS p50, v[least(len(v) - 1, floor(0.95 * len(v))::BIGINT) + 1] AS p95, v[least(len(v) - 1, floor(0.99 * len(v))::BIGINT) + 1] AS p99 FROM s")
def latency_nearest_rank(spark, sf_dir):
    return metrics.percentiles(_read(spark, sf_dir, "events"), "value", ["event_type"]).withColumn("total", F.round("total", 4))


@query("SELECT round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95, round(quantile_cont(value, 0.99), 6) AS p99 FROM events")
def latency_quantiles(spark, sf_dir):
    return metrics.quantiles(_read(spark, sf_dir, "events"), "value").select(*(F.round(c, 6).alias(c) for c in ("p50", "p95", "p99")))


@query(f"WITH {EV} SELECT count(*) AS lines, count(*) FILTER (NOT cut AND NOT bad) AS processed, count(*) FILTER (cut OR bad) AS failed FROM l")
def run_totals(spark, sf_dir):
    return metrics.totals(parsed(spark, sf_dir))
