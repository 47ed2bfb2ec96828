"""Answers in blocks of questions: the same articles, bodies and answers as from ranked chunks."""

import random

import pytest
from pyspark.sql import functions as F

from millrace import api
from millrace.functions import text as X
from millrace.operators import articles as A
from millrace.operators import search as S
from millrace.session import cut

WORDS = "export billing invoice page limit workspace reset password profile avatar theme the of how again".split()


def _body(k):
    return None if k % 17 == 0 else "  " if k % 19 == 0 else ". ".join(" ".join(random.Random(k * 7 + j).choices(WORDS, k=5)) for j in range(1 + k % 5)) + "."


CHUNKS = [(k, f"h {k}:\n{_body(k)}", _body(k), None if k % 23 == 0 else f"https://h/{k // 3 % 40}", f"part {WORDS[k % 14]}", k % 3, f"{WORDS[k % 13]} {WORDS[k % 7]}") for k in range(150)]
ASKED = [(q, " ".join(random.Random(500 + q).sample(WORDS, 1 + q % 4))) for q in range(40)] + [(90, "nowhere"), (91, ""), (92, "export billing"), (93, "Billing, export")]


@pytest.fixture(scope="module")
def tables(spark):
    chunks = cut(spark.createDataFrame(CHUNKS, "vector_id long, text string, body string, url string, heading_path string, chunk_pos int, title string").repartition(4))
    return chunks, spark.createDataFrame(ASKED, "qid long, query string")


def test_heads_are_those_of_the_ranked_chunks(spark, tables):
    chunks, asked = tables
    ranked = S.retrieve(chunks, asked)
    want = A.heads(ranked, chunks, asked).collect()
    got = {(r.qid, r.article): r for r in S.heads(chunks, asked, 4, []).collect()}
    assert len(got) == len(want) > 100
    for r in want:
        g = got[r.qid, r.article]
        assert (g.url, g.first, g.title, g.heading_path, g.whole, sorted(set(g.at)), sorted(g.q)) == (r.url, r.first, r.title, r.heading_path, r.whole, sorted(r.at), sorted(r.q))
        assert abs(g.similarity - r.similarity) < 1e-12
        # what isn't wanted has at least 4 articles with text before it
        assert g.wanted or g.url is None or sum(got[r.qid, n].url is not None for n in range(r.article)) >= 4


def test_bodies_are_picked_at_the_page(spark, tables):
    chunks, asked = tables
    ranked = cut(S.retrieve(chunks, asked))
    want = {(r.qid, r.article): r.body for r in A.bodies(A.passages(ranked, chunks), chunks).collect()}
    got = {(r.qid, r.article): r.body for r in A.passage_bodies(A.heads(ranked, chunks, asked), chunks).collect()}
    assert got == want


def test_questions_of_the_same_words_are_asked_once(spark, tables, monkeypatch):
    seen = []
    plain = S.heads
    monkeypatch.setattr(api.search, "heads", lambda c, q, *a, **how: seen.append(q.count()) or plain(c, q, *a, **how))
    chunks, asked = tables
    said = {r.qid: r for r in api.answer(chunks, asked, 0.0, 0.9).collect()}
    assert set(said) == {q for q, _ in ASKED} and seen[0] < len(ASKED)
    assert said[92].outcome == "answered" and said[92][1:] == said[93][1:]


@pytest.mark.parametrize("focus", ["https://h/3", "https://h/none"])
def test_a_picked_page_answers_alike_in_blocks_and_from_ranked_chunks(spark, tables, focus):
    chunks, asked = tables
    got = sorted(map(str, api.answer(chunks, asked, 0.2, 0.4, focus=focus).collect()))
    want = sorted(map(str, api.answer(chunks, asked, 0.2, 0.4, focus=focus, priors=spark.createDataFrame([], "qid long, url string, boost double")).collect()))
    assert got == want


def test_answers_with_ranked_chunks_in_blocks_are_the_same(spark, tables):
    chunks, asked = tables
    for pack in ("extractive", "small"):
        got = sorted(map(str, api.answer(chunks, asked, 0.2, 0.4, pack).collect()))
        assert got == sorted(map(str, api.answer(chunks, asked, 0.2, 0.4, pack, priors=spark.createDataFrame([], "qid long, url string, boost double")).collect()))


def test_a_picked_page_is_not_shuffled_to_its_questions(spark, tables):
    """All questions ask for one page, so it goes to them; else one task would have the work of all."""
    chunks, asked = tables
    heads = S.heads(chunks, asked, 4, A.places(chunks, "https://h/3"))
    plan = A.passage_bodies(heads, chunks, "https://h/3")._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan


def test_events_are_of_every_question_though_words_are_asked_once(spark, tables):
    chunks, asked = tables
    rows = api.answer_events(api.answer(chunks, asked, 0.0, 0.9)).collect()
    of = lambda q: sorted((r.n, r.kind, r.detail) for r in rows if r.qid == q)
    assert of(92) == of(93) and [k for _, k, _ in of(92)][-1] == "done"


@pytest.mark.parametrize("page, alike", [("https://h/3", True), ("https://h/5", False)])
def test_a_picked_page_needs_rankings_only_of_questions_near_it(spark, tables, monkeypatch, page, alike):
    """Certainties and answers are those of the full rankings, at any floor; a page's different titles need all rankings."""
    chunks, asked = tables
    if alike:
        chunks = cut(chunks.withColumn("title", F.when(F.col("url") == page, F.lit("One")).otherwise(F.col("title"))).withColumn("heading_path", F.when(F.col("url") == page, F.lit("part")).otherwise(F.col("heading_path"))))
    ranked, plain = [], S.in_blocks
    monkeypatch.setattr(S, "in_blocks", lambda c, q, *a: ranked.append(q.count()) or plain(c, q, *a))
    certain = set()
    for floor in (0.2, 0.45, 0.7, 2.0):
        ranked.clear()
        got = api.answer(chunks, asked, 0.1, floor, focus=page, brief=True).collect()
        some = sum(ranked)
        want = api.answer(chunks, asked, 0.1, floor, focus=page).select("qid", "outcome", "certainty", "answer", F.size("sources").alias("n_sources")).collect()
        assert sorted(map(str, got)) == sorted(map(str, want))
        certain |= {r.certainty for r in got}
        assert not alike or floor < 0.7 or some < len(ASKED) / 2
        assert not alike or floor < 1 or not some
    assert {"confident", "uncertain"} <= certain


def test_vectors_count_tokens_and_first_letters(spark):
    texts = ["abcde ab abcde", None, "", "abcdef abcd"]
    got = {r.id: r.v for r in S.hashed_vectors(spark.createDataFrame(list(enumerate(texts)), "id long, text string"), "id", F.col("text"), 16).collect()}
    for n, t in enumerate(texts):
        want = [0.0] * 16
        for token in (t or "").split():
            for part in (token, token[:4]) if len(token) > 4 else (token,):
                want[int(X.fnv_of(part), 16) % 16] += 1
        norm = sum(x * x for x in want) ** 0.5 or 1
        assert got[n] == pytest.approx([x / norm for x in want], abs=1e-6)


def test_a_picked_page_is_cut_into_sentences_once(spark, tables):
    chunks, asked = tables
    heads = S.heads(chunks, asked, 4, A.places(chunks, "https://h/3"))
    got, want = (sorted((r.qid, r.body, r.first_body, r.excerpt) for r in A.excerpted(m).collect()) for m in (A.whole_page(heads, chunks, "https://h/3"), A.passage_bodies(heads, chunks, "https://h/3")))
    assert got == want and len(got) == len(ASKED)
