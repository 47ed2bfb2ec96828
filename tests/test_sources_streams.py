"""Files in and out, and streams against their batch twins."""

import json

import pytest
from pyspark.sql import functions as F

from millrace.sources import corpus as P
from millrace.sources.tables import one_of_each
from millrace.streaming import state as ST


def test_corpus_round_trip(spark, tmp_path):
    rows = [("i", 7, "t2", "b2", "u", "h", "T", 1, "x"), ("i", 3, "t1", "b1", "u", "h", "T", 0, "y"), ("j", 1, None, None, "v", None, None, 0, None)]
    df = spark.createDataFrame(rows, "index_id string, vector_id long, text string, body string, url string, heading_path string, title string, chunk_pos int, content_hash string")
    P.write_chunks(df, str(tmp_path / "c"))
    got = sorted((r.index_id, r.vector_id, r.body) for r in P.read_chunks(spark, str(tmp_path / "c")).collect())
    assert got == [("i", 0, "b1"), ("i", 1, "b2"), ("j", 0, None)]


def test_export_is_checked(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"version": 1, "indexId": "x", "chunks": [{"vectorId": 0, "body": "b"}]}))
    corpus, chunks = P.read_export(spark, str(tmp_path / "a.json"))
    assert corpus.first().indexId == "x" and chunks.first().body == "b"
    (tmp_path / "b.json").write_text("{")
    with pytest.raises(Exception):
        P.read_export(spark, str(tmp_path / "b.json"))[1].collect()


def test_question_lines(spark, tmp_path):
    (tmp_path / "q.jsonl").write_text('// note\n\n{"question": "a?", "mustInclude": ["x"]}\n{"question": ""}\n{bad\n')
    good, errors = P.read_questions(spark, str(tmp_path / "q.jsonl"))
    assert [(r.question, r.answerUrls, r.mustInclude) for r in good.collect()] == [("a?", [], ["x"])]
    assert errors.count() == 2


def test_upsert_and_vectors(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    assert sorted(map(tuple, P.upserted(old, spark.createDataFrame([(2, "c")], "k int, v string"), ["k"]).collect())) == [(1, "a"), (2, "c")]
    v = spark.createDataFrame([("i", 0, [1.0])], "index_id string, vector_id long, embedding array<double>")
    more = spark.createDataFrame([("i", 5, [2.0]), ("j", 1, [3.0])], "index_id string, ord int, embedding array<double>")
    assert sorted((r.index_id, r.vector_id, r.shard) for r in P.appended_vectors(v, more).collect()) == [("i", 0, 0), ("i", 1, 0), ("j", 0, 0)]


def test_one_of_each(spark):
    df = spark.createDataFrame([(1, "a"), (1, "a"), (2, "b"), (None, "c")], "k int, v string")
    assert sorted(map(tuple, one_of_each(df, "k").collect())) == [(1, "a"), (2, "b")]


def test_limit_and_breaker_rules():
    assert ST.limit([], [0] * 21 + [60_000])[1] == [True] * 20 + [False, True]
    events = [(k, True) for k in range(4)] + [(10, True), (30_004, False), (30_005, True)]
    assert ST.breaker([], -1, events)[2] == ["closed"] * 4 + ["open", "half-open", "closed"]


def run(stream, name, mode="append"):
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert q.exception() is None
    return stream.sparkSession.table(name)


def test_streams_equal_their_batch_twins(spark, tmp_path):
    rows = [(f"k{k % 3}", 1000 * k, k % 4 < 3, k) for k in range(120)]
    df = spark.createDataFrame(rows, "key string, at_ms long, failed boolean, id long").coalesce(1)
    df.write.parquet(str(tmp_path / "t"))
    stream = lambda: spark.readStream.schema(df.schema).parquet(str(tmp_path / "t"))
    want = sorted(map(tuple, ST.limited(df, "key", "at_ms").collect()))
    assert sorted(map(tuple, run(ST.limited_stream(stream(), "key", "at_ms"), "lim").collect())) == want
    want = sorted(map(tuple, ST.broken(df, "key", "at_ms", "failed").collect()))
    assert sorted(map(tuple, run(ST.broken_stream(stream(), "key", "at_ms", "failed"), "brk").collect())) == want
    timed = stream().withColumn("at", F.timestamp_millis(F.col("at_ms") + 1_000_000))
    assert run(ST.first_deliveries(timed.unionByName(timed), "id", "at"), "ded").count() == 120
    assert run(ST.trend(timed, "at", ["key"], "10 seconds", "1 second"), "trd").agg(F.sum("n")).first()[0] <= 120
    assert run(ST.sessions(timed, "at", "key", "2 seconds", "1 second"), "ses").count() > 0
