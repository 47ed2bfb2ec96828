"""Searches as scans: what a task hands on, and that blocks of queries and parts of documents give the same rows."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.operators import scans
from millrace.operators import search as S

DOCS = [(k, " ".join(random.Random(k).choices("red fox blue whale song page limit of the export".split(), k=k % 9)), "fox page" if k % 4 else None) for k in range(120)]
ASKED = [(q, " ".join(random.Random(1000 + q).sample("red fox blue whale song page limit nowhere".split(), 1 + q % 4))) for q in range(23)]
FIELDS = {"title": 2.0, "content": 1.0}


@pytest.fixture(scope="module")
def tables(spark):
    docs = spark.createDataFrame(DOCS, "id long, body string, title string").repartition(3)
    terms = S.query_terms(spark.createDataFrame(ASKED, "qid long, q string"), "qid", F.col("q"))
    return docs, terms


def plain(depth, k):
    """Sums and cuts of the same scores, one query at a time."""
    out = []
    texts = {"content": {i: b.split() for i, b, _ in DOCS}, "title": {i: (t or "").split() for i, _, t in DOCS}}
    rank = lambda s, n: sorted(s.items(), key=lambda x: (-math.floor(x[1] * 1e9 + 0.5), x[0]))[:n]
    for qid, q in ASKED:
        total = {}
        for field, weight in FIELDS.items():
            own, score = texts[field], {}
            avg = sum(map(len, own.values())) / len(own)
            for i, t in own.items():
                for w in set(q.split()) & set(t):
                    df = sum(w in x for x in own.values())
                    score[i] = score.get(i, 0) + math.log(1 + (len(own) - df + 0.5) / (df + 0.5)) * t.count(w) * 2.5 / (t.count(w) + 1.5 * (0.25 + 0.75 * len(t) / avg))
            for i, s in rank(score, depth):
                total[i] = total.get(i, 0) + s * weight
        out += [(qid, i, round(s, 8), n) for n, (i, s) in enumerate(rank(total, k))]
    return sorted(out)


@pytest.mark.parametrize("block", [4, 16_384])
def test_fields_are_cut_alike_in_blocks_and_parts(spark, tables, monkeypatch, block):
    monkeypatch.setattr(scans, "BLOCK", block)
    docs, terms = tables
    idx = S.stored_index(docs, "id", {"title": F.col("title"), "content": F.col("body")})
    found = S.bm25(idx, terms, 7, FIELDS, 11)
    assert sorted((r.qid, r.id, round(r.score, 8), r.rank) for r in found.collect()) == plain(11, 7)
    if block == 4:
        assert found.rdd.getNumPartitions() >= 6  # the blocks of 23 questions don't end up in one task


def test_an_index_is_made_without_a_shuffle(spark, tables):
    postings = S.index(tables[0].coalesce(1), "id", {"title": F.col("title"), "content": F.col("body")})[0]
    assert postings.count() == 2 * len(DOCS)
    assert str(postings._jdf.queryExecution().executedPlan()).count("Exchange") == str(tables[0]._jdf.queryExecution().executedPlan()).count("Exchange")


def test_only_the_best_rows_leave_a_search(spark):
    """200 documents match each of 10 queries; the rows that are ranked are the best 5 of each part's, not all that match."""
    docs = spark.createDataFrame([(k, "fox " * (k % 7 + 1)) for k in range(200)], "id long, body string")
    terms = spark.createDataFrame([(q, "fox") for q in range(10)], "qid long, term string")
    idx = S.stored_index(docs, "id", {"content": F.col("body")})
    found = S.bm25(idx, terms, 5)
    assert found.count() == 50 and "MapInArrow" in str(found._jdf.queryExecution().executedPlan())


@pytest.mark.parametrize("block", [4, 16_384])
def test_cosine_in_blocks_with_ties_and_void_queries(spark, monkeypatch, block):
    monkeypatch.setattr(scans, "BLOCK", block)
    r = np.random.default_rng(3)
    v = r.integers(-2, 3, (150, 6)).astype(float)
    q = np.concatenate([r.integers(-2, 3, (12, 6)).astype(float), np.zeros((1, 6))])
    vectors = spark.createDataFrame([(k, x.tolist()) for k, x in enumerate(v)], "id long, v array<double>").repartition(5)
    queries = spark.createDataFrame([(k, x.tolist()) for k, x in enumerate(q)], "qid long, v array<double>")
    got = sorted((x.qid, x.id, x.score, x["rank"]) for x in S.cosine(vectors, queries, 9).collect())
    want = [(a, int(b), float(v[b] @ q[a]), n) for a in range(len(q)) for n, b in enumerate(sorted(range(len(v)), key=lambda i: (-(v[i] @ q[a]), i))[:9])]
    assert got == sorted(want)


def test_products_of_pairs(spark, monkeypatch):
    monkeypatch.setattr(scans, "BLOCK", 2)
    v, q = np.arange(24.0).reshape(8, 3), np.arange(15.0).reshape(5, 3) - 4
    vectors = spark.createDataFrame([(k, x.tolist()) for k, x in enumerate(v)], "id long, v array<double>").repartition(3)
    queries = spark.createDataFrame([(k, x.tolist()) for k, x in enumerate(q)], "qid long, v array<double>")
    pairs = [(a, b) for a in range(5) for b in range(8) if (a + b) % 3]
    got = sorted((x.qid, x.id, x.near) for x in S.pair_products(vectors, queries, spark.createDataFrame(pairs, "qid long, id long")).collect())
    assert got == [(a, b, float(v[b] @ q[a])) for a, b in pairs]


@pytest.mark.parametrize("name", ["retrieve", "grounded_prompts", "source_cards", "answer_batch", "answer_events", "focused_answers"])
def test_all_logged_questions_are_asked(spark, small, name):
    from millrace.plans import registry

    asked = {r.id for r in spark.read.parquet(f"{small}/query_log.parquet").filter("query is not null and id is not null").select("id").distinct().collect()}
    got = {r.qid for r in registry.queries()[name](spark, small).select("qid").distinct().collect()}
    assert got <= asked and len(got) > 0.5 * len(asked)
    if name in ("answer_batch", "focused_answers"):
        assert got == asked


@pytest.mark.parametrize("first, k", [(64, 7), (4096, 7), (64, 400)])
def test_vectors_of_counts_are_summed_in_short_numbers(monkeypatch, first, k):
    """The best rows are those of exact products, with ties by id; vectors that aren't counts, and empty ones, are there too."""
    import pyarrow as pa
    from types import SimpleNamespace

    monkeypatch.setattr(scans, "FIRST", first)
    draw = np.random.default_rng(5)
    docs = draw.integers(0, 3, (900, 32)) * (draw.random((900, 32)) < 0.5)
    docs[500:600] = docs[100:200]
    docs = (docs / np.maximum(np.linalg.norm(docs, axis=1, keepdims=True), 1e-12)).astype(np.float32)
    asked = (draw.integers(1, 3, (60, 32)) * (draw.random((60, 32)) < 0.2)).astype(float)
    asked[7], asked[8], asked[9] = 0, draw.random(32), -asked[9]
    asked = (asked / np.maximum(np.linalg.norm(asked, axis=1, keepdims=True), 1e-12)).astype(np.float32).astype(float)
    counts = scans.Counts(asked, np.flatnonzero(asked.any(axis=1)))
    assert len(counts.q) == 57 and set(counts.rest.tolist()) == {8, 9}
    ids = draw.permutation(900).astype(np.int64)
    batches = [pa.RecordBatch.from_arrays([pa.array(ids[a : a + 130]), pa.array(list(docs[a : a + 130]), pa.list_(pa.float32()))], ["id", "v"]) for a in range(0, 900, 130)]
    got = [r for b in scans.nearest(SimpleNamespace(value=(np.arange(60), asked)), k, True)(iter(batches)) for r in zip(*(c.to_pylist() for c in b.columns))]
    product = np.round(asked @ docs.astype(float).T, 9)
    want = [(q, int(ids[i]), n) for q in range(60) for n, i in enumerate(np.lexsort((ids, -scans.rounded(product[q])))[:k])]
    assert sorted((q, i, n) for q, i, _, n in got) == sorted(want)
