import os

import pytest

import corpus_pipeline
from loomspark.llm import mixing, ngram_join, queries, secret_scan, toxicity
from loomspark.llm._common import components, written

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.exists(DATA), reason="no tables")


def test_stages(spark):
    docs = first = spark.read.parquet(f"{DATA}/documents.parquet")
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, written(stage(spark, docs, DATA), f"test-{name}")
        seen[name] = docs
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == first.columns
        if name == "toxicity":
            out = toxicity.score(before, toxicity.fit(before, spark.read.parquet(f"{DATA}/labels.parquet")))
            assert docs.count() == out.where("predicted = 0").count() < before.count()
        elif name == "ngram_jaccard_join":
            own = {r.doc_id for r in ngram_join.join(before).where("doc_id = component_id").collect()}
            assert {r.doc_id for r in docs.select("doc_id").collect()} == own and docs.count() == len(own)
        elif name == "secret_scan":
            assert docs.count() == before.count() and secret_scan.scan(docs, secret_scan.Forest(spark)).where("exists(findings, x -> x.secret)").count() == 0
        elif name == "mixing_sources":
            taken = mixing.mix(before).agg({"taken": "sum"}).first()[0]
            assert docs.select(mixing.words(docs["text"]).alias("n")).agg({"n": "sum"}).first()[0] == taken
    got = corpus_pipeline.run(spark, DATA)
    assert got.drop("sequence_id", "offset").exceptAll(seen["best_fit_packing"].drop("sequence_id", "offset")).count() == 0 and got.count() == seen["best_fit_packing"].count()


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_queries_run(spark, name):
    table = {"op4": "embeddings", "op9": "pages", "op10": "embeddings"}.get(name.split("_")[0], "documents")
    n = queries.QUERIES[name](spark, DATA).count()
    rows = spark.read.parquet(f"{DATA}/{table}.parquet").count()
    assert n == rows if not name.startswith(("op1_", "op10_")) else n >= rows


def test_components(spark):
    import random

    rng = random.Random(2)
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, 100 + i) for i in range(1, 50)] + [(rng.randrange(300, 400), rng.randrange(300, 400)) for _ in range(60)] + [(7, 7)]
    rng.shuffle(edges)
    parent = {n: n for e in edges for n in e}
    for _ in range(200):
        for a, b in edges:
            parent[a] = parent[b] = min(parent[a], parent[b])
    df = spark.createDataFrame([e if rng.random() < 0.5 else e[::-1] for e in edges], "u long, v long").repartition(6)
    got = {r.node: r.component for r in components(df, "test").collect()}
    linked = {n for a, b in edges if a != b for n in (a, b)}
    assert got == {n: parent[n] for n in linked}
    assert components(df.where("false"), "test").count() == 0
