"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspark.llm import hnsw, license_scan, mixing, ngram_join, packing, secret_scan, substring_dedup, toxicity, url_filter, vector_dedup
from loomspark.llm._common import LOWER, UPPER


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"))


def op2_mixing_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op3_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join(_table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def op4_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_dedup.dedup(_table(spark, sf_dir, "embeddings"))


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.dedup(_table(spark, sf_dir, "documents")).drop("kept")


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(_table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text", "blocks", "notices")


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.scan(_table(spark, sf_dir, "documents").select("doc_id", "text"), secret_scan.Forest(spark))
    secrets = F.filter("findings", lambda x: x["secret"])
    kinds = F.array_join(F.array_sort(F.array_distinct(F.transform(secrets, lambda x: x["kind"]))), ",")
    starts = F.transform(secrets, lambda x: x["start"])
    best = F.coalesce(F.array_max(F.transform("findings", lambda x: x["score"])), F.lit(0.0))
    return found.select("doc_id", F.size("findings").alias("n_candidates"), F.size(secrets).alias("n_secrets"), kinds.alias("kinds"), starts.alias("starts"), best.alias("best_score"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return toxicity.score(docs, toxicity.fit(docs, _table(spark, sf_dir, "labels")))


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    fitted = url_filter.UrlFilter(url_filter.labelled(spark))
    return fitted.judge(_table(spark, sf_dir, "pages").select("page_id", "url")).select("page_id", "host", "path", "rule", "verdict", "score")


def op10_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _table(spark, sf_dir, "embeddings")
    return hnsw.search(vectors, vectors.where(F.col("vec_id") % hnsw.QUERY_STEP == 0))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_best_fit_packing, op2_mixing_sources, op3_ngram_jaccard_join, op4_embedding_near_dedup, op5_substring_dedup, op6_license_scan, op7_secret_scan, op8_toxicity, op9_url_filter, op10_nearest_neighbours)
}



def _license_sql() -> str:
    import math

    word = license_scan.WORD
    rows, lists = [], []
    for label, text in license_scan.TEMPLATES:
        words = list(dict.fromkeys(text.split()))
        tokens = ", ".join(f"'{w}'" for w in words)
        rows.append(f"('{label}', [{tokens}], {math.ceil(license_scan.CONTAINMENT * len(words) - 1e-9)}, {len(text.split())})")
    for phrase, label in license_scan.PHRASES:
        parts = phrase.split()
        fits = " AND ".join(f"ws[i + {k}] = '{x}'" for k, x in enumerate(parts))
        lists.append(f"[{{'i': i - 1, 'l': '{label}'}} FOR i IN range(1, len(ws) + 1) IF {fits}]")
    return f"""
    WITH d AS (SELECT doc_id, translate(coalesce(text, ''), '{UPPER}', '{LOWER}') AS t FROM documents),
    w AS (SELECT doc_id, regexp_extract_all(t, '{word}') AS ws FROM d),
    p AS (SELECT doc_id, len(ws) AS n_words, {" || ".join(lists)} AS places FROM w),
    tm(label, tw, need, span) AS (VALUES {", ".join(rows)}),
    lb AS (SELECT doc_id, list_distinct(regexp_extract_all(l, '{word}')) AS lw FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS l FROM d)),
    wb AS (SELECT doc_id, label, tw, need, span, ws, unnest(range(1, greatest(len(ws) - span + 1, 1) + 1)) AS i FROM w, tm WHERE span >= {license_scan.LONG} AND len(list_intersect(list_distinct(ws), tw)) >= need),
    m AS (SELECT doc_id, label, len(list_intersect(lw, tw)) / len(tw)::DOUBLE AS share FROM lb, tm WHERE len(list_intersect(lw, tw)) >= need
      UNION ALL SELECT doc_id, label, len(list_intersect(list_distinct(ws[i:i + span - 1]), tw)) / len(tw)::DOUBLE FROM wb WHERE len(list_intersect(list_distinct(ws[i:i + span - 1]), tw)) >= need),
    g AS (SELECT doc_id, list(label) AS found, max(share) AS best FROM m GROUP BY doc_id)
    SELECT doc_id, n_words::BIGINT AS n_words, len(places)::BIGINT AS n_base, list_min([x.i FOR x IN places])::BIGINT AS first_word,
      list_max([x.i FOR x IN places])::BIGINT AS last_word, coalesce(array_to_string(list_sort(list_distinct([x.l FOR x IN places])), ','), '') AS base_labels,
      coalesce(array_to_string(list_sort(list_distinct([x.l FOR x IN places] || coalesce(found, []))), ','), '') AS labels,
      CASE WHEN len(places) > 0 THEN 1.0::DOUBLE ELSE coalesce(best, 0.0::DOUBLE) END AS score
    FROM p LEFT JOIN g USING (doc_id)
    """


#: All pairs of sets, and what links reach; only fit for small tables.
_NGRAM_SQL = f"""
    WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
    s AS (SELECT DISTINCT doc_id, array_to_string(ws[i:i + 4], ' ') AS g FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 3, 2))) AS i FROM w WHERE len(ws) > 0)),
    n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
    p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
    l AS (SELECT a, b FROM p JOIN n x ON a = x.doc_id JOIN n y ON b = y.doc_id WHERE 100 * c >= 80 * (x.n + y.n - c)),
    e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
    r AS (SELECT doc_id AS id, doc_id AS lo FROM documents UNION SELECT e.b, r.lo FROM r JOIN e ON e.a = r.id)
    SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, c.lo AS component_id
    FROM documents d LEFT JOIN n USING (doc_id) JOIN (SELECT id, min(lo) AS lo FROM r GROUP BY 1) c ON c.id = d.doc_id
"""

_VECTOR_SQL = """
    WITH RECURSIVE v AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings),
    u AS (SELECT * FROM v WHERE e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
    l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= 0.9),
    r AS (SELECT vec_id AS id, vec_id AS lo FROM embeddings UNION SELECT l.b, r.lo FROM r JOIN l ON l.a = r.id)
    SELECT d.vec_id, coalesce(n.n, 0)::BIGINT AS n_links, c.lo AS component_id, c.lo = d.vec_id AS kept
    FROM embeddings d LEFT JOIN (SELECT a, count(*) AS n FROM l GROUP BY 1) n ON n.a = d.vec_id JOIN (SELECT id, min(lo) AS lo FROM r GROUP BY 1) c ON c.id = d.vec_id
"""

_SUBSTRING_SQL = """
    WITH b AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, octet_length(encode(coalesce(text, '')))::BIGINT AS n FROM documents),
    x AS (SELECT doc_id, i, md5_number(substr(h, 2 * i + 1, 200)) AS x FROM (SELECT doc_id, h, unnest(range(0, n - 99)) AS i FROM b WHERE n >= 100)),
    g AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY x ORDER BY doc_id, i) AS k FROM x) WHERE k > 1),
    j AS (SELECT doc_id, i, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM (SELECT doc_id, i, CASE WHEN i <= lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 100 THEN 0 ELSE 1 END AS new FROM g)),
    s AS (SELECT doc_id, run, min(i) AS lo, max(i) + 100 AS hi FROM j GROUP BY 1, 2),
    t AS (SELECT doc_id, count(*) AS n_spans, sum(hi - lo)::BIGINT AS n_removed FROM s GROUP BY 1),
    c AS (SELECT doc_id, hi AS a, coalesce(lead(lo) OVER (PARTITION BY doc_id ORDER BY hi), n) AS z FROM (SELECT doc_id, 0 AS lo, 0 AS hi FROM b UNION ALL SELECT doc_id, lo, hi FROM s) JOIN b USING (doc_id)),
    q AS (SELECT doc_id, string_agg(substr(h, 2 * a + 1, 2 * (z - a)), '' ORDER BY a) AS kept FROM c JOIN b USING (doc_id) WHERE z > a GROUP BY 1)
    SELECT doc_id, n AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans, sha256(unhex(coalesce(kept, ''))) AS kept_sha256
    FROM b LEFT JOIN t USING (doc_id) LEFT JOIN q USING (doc_id)
"""

#: The exact neighbours; on small tables the graphs find them all.
_NEAREST_SQL = """
    WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings),
    u AS (SELECT * FROM v WHERE e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
    p AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e) AS score FROM u q JOIN u c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e) WHERE q.vec_id % 20 = 0)
    SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM p) WHERE rank <= 20
"""

ORACLE_SQL: dict[str, str] = {
    "op3_ngram_jaccard_join": _NGRAM_SQL, "op4_embedding_near_dedup": _VECTOR_SQL, "op5_substring_dedup": _SUBSTRING_SQL, "op6_license_scan": _license_sql(),
    "op10_nearest_neighbours": _NEAREST_SQL,
}
