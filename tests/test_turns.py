"""Prompts, events, conversations, kept answers, evaluation, queues and budgets on small hand-made cases."""

from pyspark.sql import functions as F

from millrace import api
from millrace.functions import lexicon as L
from millrace.operators import crawl as C
from millrace.operators import decide as D
from millrace.operators import evaluate as E
from millrace.operators import search as S
from millrace.operators import turns as T
from millrace.operators import understand as U


def test_refusals_are_whole_replies(spark):
    rows = {L.REFUSAL: True, "  i don't have that in  this index ": True, L.REFUSAL + " However, the billing page lists three steps that may help you here.": False, "": False, "Yes.": False, None: False}
    df = spark.createDataFrame([(k,) for k in rows], "r string")
    assert {r.r: r.x for r in df.select("r", T.is_refusal(F.col("r")).alias("x")).collect()} == rows


def test_events_of_a_turn(spark):
    rows = [(1, "refuse", "nano", "x", None, 0), (2, "confident", "nano", "fine", None, 3), (3, "uncertain", "nano", L.REFUSAL, "extract", 3), (4, "uncertain", "nano", L.REFUSAL, None, 3), (5, "uncertain", "extractive", L.REFUSAL, "extract", 0), (6, "confident", "nano", None, "extract", 0)]
    df = spark.createDataFrame(rows, "qid long, certainty string, tier string, reply string, fallback string, refinements int")
    got = {}
    for r in T.events(df).orderBy("qid", "n").collect():
        got.setdefault(r.qid, []).append(r.kind)
    assert got == {1: ["refusal", "done"], 2: ["sources", "delta", "refine", "done"], 3: ["sources", "delta", "restart", "delta", "refine", "done"], 4: ["sources", "delta", "refusal", "done"], 5: ["sources", "delta", "refusal", "done"], 6: ["sources", "refusal", "done"]}


def test_a_picked_page_is_not_refused_for_its_score(spark):
    df = spark.createDataFrame([(0.1, 2, True, True), (0.1, 2, True, False), (0.1, 0, True, True), (0.9, 2, False, False)], "s double, n int, d boolean, f boolean")
    assert [r[0] for r in df.select(T.decision(F.col("s"), F.col("n"), F.lit(0.5), F.lit(0.8), F.col("d"), F.col("f"))).collect()] == ["uncertain", "refuse", "refuse", "uncertain"]


def test_prompts_number_their_articles(spark):
    df = spark.createDataFrame([(1, 1, "B", None, "two"), (1, 0, "A", "P > A", "one")], "qid long, article int, title string, heading_path string, body string")
    text = T.context(df).first().context
    assert text == "[1] A — P > A\none\n\n[2] B\ntwo"
    whole = T.context(df).select(T.prompt(F.lit("why?"), F.col("context")).alias("p")).first().p
    assert whole.endswith("CONTEXT:\n" + text + "\n\nQUESTION: why?\n\nANSWER:") and L.REFUSAL in whole


def test_feedback_goes_to_the_latest_row(spark):
    log = spark.createDataFrame([(1, "i", "mail [email]", None, 1), (2, "i", "mail [email]", None, 5), (3, "i", "other", "up", 9), (4, "j", "mail [email]", None, 7)], "id long, index_id string, query string, feedback string, at_ms long")
    given = spark.createDataFrame([("i", "mail a.b@c.de", "down"), ("i", "unknown", "up")], "index_id string, query string, feedback string")
    assert {r.id: r.feedback for r in T.with_feedback(log, given).collect()} == {1: None, 2: "down", 3: "up", 4: None}


def test_cache_put_read_and_limits(spark):
    empty = spark.createDataFrame([], "key string, index_id string, markdown string, hits bigint, at_ms bigint")
    new = spark.createDataFrame([("a", "i", "A", False, 1), ("b", "i", "B", False, 2), ("c", "i", "C", False, 3), ("d", "i", "D", True, 4)], "key string, index_id string, markdown string, refused boolean, at_ms bigint")
    cache = T.put(empty, new, 2)
    assert {r.key for r in cache.collect()} == {"b", "c"}
    asked = spark.createDataFrame([("b",), ("b",), ("x",)], "key string")
    assert {(r.key, r.hits, r.at_ms) for r in T.read(cache, asked, 10, 7).collect()} == {("c", 0, 3)}  # "b" is older than 7
    assert {(r.key, r.hits, r.at_ms) for r in T.read(cache, asked, 10, 70).collect()} == {("b", 2, 10), ("c", 0, 3)}
    df = spark.range(1).select(T.fingerprint(F.lit(0.7), F.lit(0.8), F.lit(True), F.lit(False), F.lit(True)).alias("x"))
    assert df.first().x == "0.700|0.800|rr||rw"


def test_results_age_though_they_are_read(spark):
    df = spark.createDataFrame([("s", str(k), k, 100 if k else 0) for k in range(4)], "session string, key string, read_ms long, at_ms long")
    assert {r.key for r in T.kept_results(df, 150, 3, 60).collect()} == {"1", "2", "3"}
    assert {r.key for r in T.kept_results(df, 150, 4, 60).collect()} == {"1", "2", "3"}


def test_report_of_cases(spark):
    rows = [
        (True, ["http://H.com/a/"], ["https://h.com/b", "https://h.com/A"], 0.9, False, "ctx has Save", "use Save", ["save", "other"]),
        (True, ["https://h.com/c"], ["https://h.com/c"], 0.1, None, "nothing", None, []),
        (False, [], ["https://h.com/c"], 0.9, False, "x", "y", []),
        (False, [], [], 0.0, None, "", None, []),
    ]
    df = spark.createDataFrame(rows, "answerable boolean, expected array<string>, retrieved array<string>, top_score double, refused boolean, context string, answer string, phrases array<string>")
    judged = E.judged(df, 0.5)
    r = E.report(judged).first()
    assert (r.answerable, r.unanswerable, r.hit_1, r.hit_3, r.mrr, r.false_answers, r.missed_answers, r.context_coverage, r.answer_coverage) == (2, 2, 0.5, 1.0, 0.75, 0.5, 0.5, 0.75, 0.75)
    assert [tuple(x) for x in E.most_missed(judged).collect()] == [("other", 1)]
    assert E.report(judged.limit(0)).first().mrr == 0.0


def test_queue_states(spark):
    empty = spark.createDataFrame([], "url string, depth int, status string, attempts int, last_status int, reason string")
    q = C.enqueued(empty, spark.createDataFrame([("a", 0), ("b", 1), ("b", 0), ("c", 2)], "url string, depth int"))
    assert {(r.url, r.depth, r.status) for r in q.collect()} == {("a", 0, "queued"), ("b", 0, "queued"), ("c", 2, "queued")}
    results = spark.createDataFrame([("a", "failed", 503, None), ("b", "failed", 404, None), ("c", "failed", None, "indexing"), ("zz", "done", 200, None)], "url string, status string, last_status int, reason string")
    q = C.marked(q, results)
    assert {(r.url, r.reason, r.attempts) for r in q.collect()} == {("a", "server", 1), ("b", "missing", 1), ("c", "indexing", 1)}
    assert C.counts(C.requeued(q)).first().asDict() == {"queued": 2, "done": 0, "failed": 1, "skipped": 0}
    assert C.counts(C.requeued(q.withColumn("attempts", F.lit(2)))).first().queued == 0
    assert [r.url for r in C.next_queued(C.recrawled(q), 2).collect()] == ["a", "b"]


def test_crawl_keeps_to_limits(spark):
    page = lambda u, links, status=200, html=True: (u, u, u, status, "".join(f'<a href="{x}">' for x in links) if html else None, None)
    rows = [page("https://h/a", ["/b", "/c", "/private/x"]), page("https://h/b", ["/d"]), page("https://h/c", [], 404, False), page("https://h/d", ["/e"]), page("https://h/e", [])]
    pages = C.outcome(spark.createDataFrame(rows, "page string, url string, final_url string, status int, html string, robots_tag string"))
    rules = C.robots_rules(spark.createDataFrame([("h", "User-agent: *\nDisallow: /private/")], "host string, text string"))
    seeds = spark.createDataFrame([("https://h/a",)], "url string")
    got = {r.url[10:]: (r.depth, r.status, r.reason) for r in C.crawled(pages, seeds, rules, "bot", [], [], 2, 100).collect()}
    assert got == {"a": (0, "done", None), "b": (1, "done", None), "c": (1, "failed", "missing"), "private/x": (1, "skipped", None), "d": (2, "done", None)}
    got = {r.url[10:]: r.status for r in C.crawled(pages, seeds, rules, "bot", [], [], 2, 2).collect()}
    assert (got["a"], got["b"], got["d"]) == ("done", "done", "skipped")


def test_what_lies_under_a_root(spark):
    urls = ["https://h/hc", "https://h/hc/", "https://H/hc/a", "https://h/hcx", "https://g/hc/a", "https://h", "https://h/", None]
    df = spark.createDataFrame([(u,) for u in urls], "u string")
    for root, bare in (("https://h/hc", True), ("https://h/hc/", False)):
        assert [r[0] for r in df.select(api.under_root(F.col("u"), root)).collect()] == [bare, True, True, False, False, False, False, False]
    for root in ("https://h", "https://h/"):
        assert [r[0] for r in df.select(api.under_root(F.col("u"), root)).collect()] == [True, True, True, True, False, True, True, False]


def test_render_budget_and_ceiling(spark):
    helped = [True, False, False, True, False, False, False, True, True]
    df = spark.createDataFrame([("h", k, h) for k, h in enumerate(helped)], "h string, k int, helped boolean")
    assert [r.allowed for r in C.renders(df, "h", ["k"], "helped", 50, 3).orderBy("k").collect()] == [True] * 7 + [False] * 2
    assert [r.allowed for r in C.renders(df, "h", ["k"], "helped", 2, 3).orderBy("k").collect()] == [True] * 2 + [False] * 7
    status = [503, 404, 200, 503, 404, 0, 200]
    df = spark.createDataFrame([("h", k, s) for k, s in enumerate(status)] + [("g", 0, 404), ("g", 1, 503)], "h string, k int, s int")
    assert [(r.h, r.k) for r in C.stopped(df, "h", ["k"], "s", 2).collect()] == [("h", 5)]


def test_places_are_found_without_collecting(spark):
    import random

    r = random.Random(2)
    rows = [(g, round(r.random() ** 3, r.choice([1, 4, 9]))) for g in "ab" for _ in range(400)] + [("c", 2.5), ("c", 3.5)]
    df = spark.createDataFrame(rows, "g string, s double")
    wanted = spark.createDataFrame([(g, f"n{k}", k) for g in "abc" for k in (0, 1, 17, 200, 399)], "g string, name string, place long")
    got = {(x.g, x.name): x.value for x in D.nth(df, "g", "s", wanted).collect()}
    for g in "abc":
        own = sorted(s for h, s in rows if h == g)
        assert {k: v for (h, k), v in got.items() if h == g} == {f"n{k}": own[k] for k in (0, 1, 17, 200, 399) if k < len(own)}


def test_combined_replies(spark):
    rows = ["QUERY: reset it\nPASSAGE: go to\nsettings", "just a query", "before\nPassage: text", "query: only"]
    df = spark.createDataFrame([(x,) for x in rows], "r string")
    assert [tuple(r.c) for r in df.select(U.combined(F.col("r")).alias("c")).collect()] == [("reset it", "go to\nsettings"), ("just a query", ""), ("before", "text"), ("only", "")]


def test_a_stored_index_gives_the_same_scores(spark):
    docs = spark.createDataFrame([(k, f"word{k % 3} fox common text {k % 5}x", f"T{k % 2} fox") for k in range(30)] + [(99, None, None)], "id long, body string, title string")
    fields = {"title": F.col("title"), "content": F.col("body")}
    terms = S.query_terms(spark.createDataFrame([(1, "word1 fox"), (2, "t1 common 3x")], "qid long, q string"), "qid", F.col("q"))
    a, b = (sorted((r.qid, r.id, round(r.score, 9), r.rank) for r in S.bm25(make(docs, "id", fields), terms, 10, {"title": 2.0, "content": 1.0}, 20).collect()) for make in (S.index, S.stored_index))
    assert a == b and len(a) == 20


def test_answers_from_a_picked_page(spark):
    rows = [(k, "i", f"P{k // 3}:\nhow to reset the printer number {k}", f"how to reset the printer number {k}. It is easy.", f"https://h/{k // 3}", k % 3, f"Page {k // 3}", f"P{k // 3}") for k in range(9)]
    chunks = spark.createDataFrame(rows, "vector_id long, index_id string, text string, body string, url string, chunk_pos int, title string, heading_path string")
    asked = spark.createDataFrame([(1, "reset the printer"), (2, "thanks!")], "qid long, query string")
    got = {r.qid: r for r in api.answer(chunks, asked, 0.99, 0.999, focus="https://h/2").collect()}
    assert got[1].outcome == "answered" and got[1].certainty == "uncertain" and [s.url.split("#")[0] for s in got[1].sources] == ["https://h/2"] and got[2].outcome == "small-talk"
    assert {r.outcome for r in api.answer(chunks, asked, 0.99, 0.999).collect()} == {"refused", "small-talk"}
    kinds = [r.kind for r in api.answer_events(api.answer(chunks, asked, 0.0, 0.999)).orderBy("n").collect()]
    assert kinds[:2] == ["sources", "delta"] and kinds[-1] == "done"


def test_finished_crawls_have_statistics_and_floors(spark):
    rows = [(k, f"i{k % 2}", f"alpha{k} beta{k % 2} gamma", f"alpha{k} beta{k % 2} gamma", f"https://h/{k}", 0, f"alpha{k} beta{k % 2}", "P") for k in range(40)]
    chunks = spark.createDataFrame(rows, "vector_id long, index_id string, text string, body string, url string, chunk_pos int, title string, heading_path string")
    done = api.finalize(chunks)
    assert {(r.index_id, r.chunks) for r in done["stats"].collect()} == {("i0", 20), ("i1", 20)} and done["floors"].count() == 2
