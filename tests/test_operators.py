"""Operators against small hand-made cases and plain reference versions."""

import math
import random
import re

from pyspark.sql import functions as F

from millrace.functions import text as X
from millrace.functions import urls as R
from millrace.functions.html import blocks
from millrace.operators import articles as A
from millrace.operators import chunker as K
from millrace.operators import crawl as C
from millrace.operators import decide as D
from millrace.operators import evaluate as E
from millrace.operators import extract as H
from millrace.operators import logs as G
from millrace.operators import render as V
from millrace.operators import search as S
from millrace.operators import understand as U


def one(spark, column, **values):
    schema = ", ".join(f"{k} string" for k in values)
    return spark.createDataFrame([tuple(values.values())], schema).select(column.alias("x")).first()["x"]


def test_fnv(spark):
    df = spark.createDataFrame([("a",), ("foobar",), ("",), (None,), ("é😀" * 300,)], "t string")
    got = [r[0] for r in df.select(X.fnv1a("t")).collect()]
    assert got[:4] == ["e40c292c", "bf9cf968", "811c9dc5", None]
    assert got[4] == X.fnv_of("é😀" * 300)


def test_tokens_are_ascii_and_long_enough(spark):
    assert one(spark, X.tokens(F.col("t")), t="Ünïted API-v2 a 10 x") == ["ted", "api", "v2", "10"]


def test_masks_in_order(spark):
    text = "mail a.b@c.de, key sk-abcdefghij0123456789, card 4111 1111 1111 1111, 123-45-6789, 192.168.1.44, +1 555 123 4567"
    assert one(spark, X.mask(F.col("t")), t=text) == "mail [email], key [api-key], card [card], [ssn], [ip], [phone]"
    assert "[ip]" not in one(spark, X.mask(F.col("t"), ("email",)), t=text)


def test_canonical_urls(spark):
    def c(url, base=None):
        return spark.createDataFrame([(url, base)], "u string, b string").select((R.canonical_url(F.col("u"), F.col("b")) if base else R.canonical_url(F.col("u"))).alias("x")).first().x

    assert c("https://Docs.Example.com/a#s") == "https://docs.example.com/a"
    assert c("https://x.com/p?utm_source=t&id=7&gclid=abc&q=hi") == "https://x.com/p?id=7&q=hi"
    assert c("https://x.com/p?b=2&a=1") == "https://x.com/p?a=1&b=2"
    assert c("http://x.com:80") == "http://x.com/" and c("https://x.com:8443/a") == "https://x.com:8443/a"
    assert c("../guide", "https://x.com/docs/intro") == "https://x.com/guide"
    assert c("http://x.com/a", "https://x.com/b") == "https://x.com/a"
    assert c("mailto:a@b.c") is None and c("javascript:1") is None and c(None) is None and c("http://[") is None
    assert c(" x/./y/../z/..\n", "https://x.com/d/e?q") == "https://x.com/d/x/" and c("?p=2", "https://x.com/d/e?z") == "https://x.com/d/e?p=2" and c("#top", "https://x.com/d#e") == "https://x.com/d"
    assert c("/a b/ü?q=a b&x=%41", "https://x.com/") == "https://x.com/a%20b/%C3%BC?q=a+b&x=A" and c("http://x.com:99999/") is None and c("//y.com", "https://x.com/a") == "https://y.com/"


def test_acting_and_binary_urls(spark):
    rows = {"https://a.b/log-out": True, "https://a.b/kb/how-to-log-out": False, "https://a.b/account/delete": True, "https://a.b/x?action=sign_out": True, "https://a.b/x?q=delete": False}
    df = spark.createDataFrame([(u,) for u in rows], "u string")
    assert {r.u: r.a for r in df.select("u", R.acts(F.col("u")).alias("a")).collect()} == rows
    assert one(spark, R.binary(F.col("t")), t="https://a.b/x/file.PDF?x") and not one(spark, R.binary(F.col("t")), t="https://a.b/pdf/x")


def test_section(spark):
    df = spark.createDataFrame([("https://a.b/x/y/1", "https://a.b/x/y/2"), ("https://a.b/x/z", "https://a.b/x/y"), ("https://a.b/", "https://a.b/"), (None, "https://a.b/x")], "a string, b string")
    assert [r[0] for r in df.select(R.same_section(F.col("a"), F.col("b"))).collect()] == [True, False, False, False]


def test_bm25_matches_a_plain_version(spark):
    docs = {0: "the red fox runs", 1: "a fox and a fox", 2: "blue whale song song", 3: ""}
    q = "fox song"
    df = spark.createDataFrame(list(docs.items()), "id long, text string")
    terms = S.query_terms(spark.createDataFrame([(1, q)], "qid long, q string"), "qid", F.col("q"))
    got = {r.id: r.score for r in S.bm25(S.index(df, "id", {"content": F.col("text")}), terms, 10).collect()}
    toks = {i: [t for t in re.split("[^a-z0-9]+", x) if len(t) > 1] for i, x in docs.items()}
    avg = sum(map(len, toks.values())) / 4
    for i, t in toks.items():
        want = sum(math.log(1 + (4 - n + 0.5) / (n + 0.5)) * t.count(w) * 2.5 / (t.count(w) + 1.5 * (0.25 + 0.75 * len(t) / avg)) for w in q.split() if t.count(w) for n in [sum(w in x for x in toks.values())])
        assert abs(got.get(i, 0) - want) < 1e-9
    part = S.bm25(S.index(df, "id", {"content": F.col("text")}, terms), terms, 10)
    assert {r.id: r.score for r in part.collect()} == got


def test_fusion_weights_empty_lists_too(spark):
    lists = spark.createDataFrame([(1, "sparse", 5, 3.0), (1, "sparse", 6, 1.0)], "qid long, list string, id long, score double")
    got = {r.id: r.score for r in S.weighted_fusion(lists, {"dense": 0.75, "sparse": 0.25}).collect()}
    assert got == {5: 0.25, 6: 0.0}
    flat = spark.createDataFrame([(1, "sparse", 5, 3.0)], "qid long, list string, id long, score double")
    assert S.weighted_fusion(flat, {"sparse": 1.0}).first().score == 1.0


def test_cosine_ties_and_nothing(spark):
    v = spark.createDataFrame([(2, [1.0, 0.0]), (1, [1.0, 0.0]), (3, [0.0, 1.0])], "id long, v array<double>")
    q = spark.createDataFrame([(7, [1.0, 0.0])], "qid long, v array<double>")
    assert [(r.id, r.score) for r in S.cosine(v, q, 2).orderBy("rank").collect()] == [(1, 1.0), (2, 1.0)]
    assert S.cosine(v, q.limit(0), 2).count() == 0


def test_verdicts(spark):
    df = spark.createDataFrame([(0.9, True, True), (0.75, True, True), (0.1, True, True), (None, False, True), (0.9, True, False)], "s double, f boolean, d boolean")
    got = [r[0] for r in df.select(D.verdict(F.col("s"), F.col("f"), F.lit(0.7), F.lit(0.8), F.col("d"))).collect()]
    assert got == ["confident", "uncertain", "refuse", "refuse", "uncertain"]


def test_calibration(spark):
    rows = [("few", 0.5, False)] * 4 + [("many", 0.5 + k / 100, False) for k in range(12)] + [("many", 0.72 + k / 100, True) for k in range(6)]
    got = {r.i: r for r in D.calibrate(spark.createDataFrame(rows, "i string, score double, positive boolean"), "i").collect()}
    assert (got["few"].refuse, got["few"].confident, got["few"].samples) == (0.7, 0.8, 4)
    assert (got["many"].refuse, got["many"].confident, got["many"].samples) == (0.7, 0.78, 12)


def test_facets_all_or_nothing(spark):
    pages = spark.createDataFrame([(1, 0, "u0", "Admin setup", ""), (1, 1, "u1", "Agent setup", "")], "qid long, article int, url string, title string, heading_path string")
    ok = spark.createDataFrame([(1, "QUESTION: Which role?\nOPTIONS: admin | \"agent\"")], "qid long, reply string")
    assert {(r.value, r.url) for r in D.facets(ok, pages).collect()} == {("admin", "u0"), ("agent", "u1")}
    bad = spark.createDataFrame([(1, "QUESTION: Which role?\nOPTIONS: admin | pilot")], "qid long, reply string")
    assert D.facets(bad, pages).count() == 0


def test_understanding(spark):
    df = spark.createDataFrame([("Thanks!",), ("great?",), ("  hi there ",), ("how do i reset",), ("",), ("ok.",)], "q string")
    assert [r[0] for r in df.select(U.intent(F.col("q"))).collect()] == ["thanks", "question", "greeting", "question", "question", "acknowledgement"]
    df = spark.createDataFrame([("and on mobile",), ("does it work",), ("how do i export a very long report it made",), (None,)], "q string")
    assert [r[0] for r in df.select(U.leans_back(F.col("q"))).collect()] == [True, True, False, False]
    turns = spark.createDataFrame([("c", 0, "how do i export the quarterly report"), ("c", 1, "and on mobile")], "c string, n int, q string")
    assert [r.search for r in U.resolved(turns, "c", "n", "q").orderBy("n").collect()][1] == "and on mobile export quarterly report"


def test_rewrite_guards(spark):
    def why(q, r):
        return one(spark, U.rejection(F.col("q"), F.col("r")), q=q, r=r)

    assert why("SAML login fails with AUTH-403", "saml login AUTH-403 error") is None
    assert why("SAML login fails", "login fails").startswith("dropped")
    assert why("reset password", "") == "empty" and why("reset password", "billing overview") == "no word in common"
    assert one(spark, U.cleaned(F.col("r")), r="\n Query: \"reset it\" \nbecause") == "reset it"


def test_gap_report_joins_the_most_similar(spark):
    rows = [(1, "i", "how to reset password", 0.1, False, None, 1), (2, "i", "reset password steps", 0.2, False, None, 2), (3, "i", "reset the password now", 0.3, False, "up", 3), (4, "i", "invoice pdf", 0.1, True, "down", 4), (5, "i", "fine one", 0.9, True, None, 5)]
    df = spark.createDataFrame(rows, "id long, index_id string, query string, top_score double, answered boolean, feedback string, at_ms long")
    got = sorted((r.topic, r["count"], round(r.avg_score, 3)) for r in G.gap_report(df, 0.4, 0.7).collect())
    assert got == [("how to reset password", 3, 0.2), ("invoice pdf", 1, 0.1)]


def test_robots(spark):
    files = spark.createDataFrame([("h", "User-agent: a\nUser-agent: b\nDisallow: /x # no\nAllow: /x/y\n\nUser-agent: *\nDisallow: /\n"), ("e", "")], "host string, text string")
    urls = spark.createDataFrame([("https://h/x/1", "h"), ("https://h/x/y/1", "h"), ("https://h/z", "h"), ("https://e/x", "e")], "url string, host string")
    rules = C.robots_rules(files)
    assert {r.url: r.allowed for r in C.allowed(urls, rules, "b/1.0").collect()} == {"https://h/x/1": False, "https://h/x/y/1": True, "https://h/z": True, "https://e/x": True}
    assert not {r.url: r.allowed for r in C.allowed(urls, rules, "zzz").collect()}["https://h/z"]


def test_first_fitting_robots_group_counts_alone(spark):
    files = spark.createDataFrame([("h", "User-agent: example\nDisallow: /a\nCrawl-delay: 2\nUser-agent: examplebot\nDisallow: /b\nSitemap: https://h/s.xml\n"), ("s", "User-agent: *\nDisallow: /a\n\nUser-agent: *\nDisallow: /b\n")], "host string, text string")
    urls = spark.createDataFrame([(f"https://{h}/{x}", h) for h in "hs" for x in "ab"], "url string, host string")
    rules = C.robots_rules(files)
    got = {r.url: (r.allowed, r.delay) for r in C.allowed(urls, rules, "examplebot").collect()}
    assert got == {"https://h/a": (False, 2.0), "https://h/b": (True, 2.0), "https://s/a": (True, None), "https://s/b": (False, None)}
    assert [tuple(r) for r in C.robots_sitemaps(rules).collect()] == [("h", "https://h/s.xml")]


def test_failed_pages_are_never_indexed(spark):
    rows = [(200, "x"), (200, None), (304, None), (0, None), (400, "x"), (402, "x"), (404, "x"), (405, "x"), (408, "x"), (451, "x"), (500, "x"), (301, "x")]
    df = spark.createDataFrame([("u", "u", s, h, None) for s, h in rows], "url string, final_url string, status int, html string, robots_tag string")
    got = [(r.failure, r.outcome) for r in C.outcome(df).collect()]
    assert [f for f, _ in got] == [None, "other", None, "network", "other", "other", "missing", "other", "throttled", "other", "server", "other"]
    assert [o for _, o in got] == ["indexed", "failed", "unchanged"] + ["failed"] * 9


def test_error_kinds(spark):
    cases = {(504, ""): "timeout", (400, "Invalid model"): "model_not_found", (500, "safety"): "provider_down", (429, "your credit card form"): "rate_limited", (200, "Overloaded"): "rate_limited", (429, "billing"): "quota_exhausted", (422, "x"): "bad_request", (0, "quota exceeded: rate limit"): "quota_exhausted", (418, ""): "unknown", (403, "quota"): "auth_invalid"}
    df = spark.createDataFrame(list(cases), "s int, b string")
    assert {(r.s, r.b): r.k for r in df.select("s", "b", G.error_kind(F.col("s"), F.col("b")).alias("k")).collect()} == cases
    thrown = spark.createDataFrame([("AbortError", "", True), ("AbortError", "", False), ("TimeoutError", "", None), ("TypeError", "", None), ("Error", "Failed to fetch", None), ("Error", None, None)], "n string, m string, c boolean")
    assert [r[0] for r in thrown.select(G.thrown_kind(F.col("n"), F.col("m"), F.col("c"))).collect()] == ["cancelled", "timeout", "timeout", "network", "network", "unknown"]


def test_rejected_pages_give_no_question(spark):
    rows = [("i", "u1", "Release Notes", "Product > Releases", "x" * 900, 0), ("i", "u2", "Filter results", "Search > Filter", "x" * 100, 0), ("i", "u3", "Roleplay ends in any of these many cases", "Trials > Troubleshoot sync", "x" * 50, 0), ("i", "u4", "Customise it", "What's new > 4", "x", 0)]
    df = spark.createDataFrame(rows, "index_id string, url string, title string, heading_path string, body string, chunk_pos int")
    assert [r.question for r in V.starters(df).orderBy("place").collect()] == ["How do I filter results?", "How do I troubleshoot sync?"]


def test_sitemap_and_frontier(spark):
    files = spark.createDataFrame([("s", "<urlset><url><loc> https://a/x?a=1&amp;b=2 </loc></url></urlset>")], "source string, xml string")
    assert C.sitemap(files).first().loc == "https://a/x?a=1&b=2"
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("b", "/logout")], "page string, link string")
    got = {r.url: r.depth for r in C.frontier(spark.createDataFrame([("a",)], "url string"), edges, [], [], 2).collect()}
    assert got.pop("/logout", 9) and got == {"a": 0, "b": 1, "c": 2}


def test_login_pages(spark):
    assert one(spark, C.login_shell(F.col("h")), h="<script>window.location = '/login?x'</script>")
    assert one(spark, C.login_shell(F.col("h")), h="<title>Sign in</title>") and not one(spark, C.login_shell(F.col("h")), h="<p>how to sign in</p>")
    assert one(spark, C.noindex(F.col("h"), F.lit(None).cast("string")), h='<META NAME="robots" CONTENT="noindex, follow">')


def test_articles_and_packing(spark):
    ranked = spark.createDataFrame([(1, 10, "u", 4, 0.9, 0), (1, 20, "v", 0, 0.85, 1)], "qid long, vector_id long, url string, chunk_pos int, score double, rank int")
    chunks = spark.createDataFrame([(k, "u", k - 6, f"body {k}") for k in range(6, 16)] + [(20, "v", 0, "other"), (21, "v", 9, "far")], "vector_id long, url string, chunk_pos int, body string")
    got = A.passages(ranked, chunks).collect()
    assert sorted(r.vector_id for r in got if r.url == "u") == [8, 9, 10, 11, 12] and [r.vector_id for r in got if r.url == "v"] == [20]
    text = {r.url: r.body for r in A.bodies(A.passages(ranked, chunks), chunks).collect()}
    assert text["u"] == "\n\n".join(f"body {k}" for k in range(8, 13))
    sized = spark.createDataFrame([(1, 0, "w " * 300), (1, 1, "w " * 300), (1, 2, "w")], "qid long, article int, body string")
    assert [r.article for r in A.pack(sized, 4, 100).collect()] == [0]


def test_summary(spark):
    found = spark.createDataFrame([(1, 5, 0), (1, 6, 1), (2, 9, 0)], "qid long, id long, rank int")
    rel = spark.createDataFrame([(1, 6), (2, 1)], "qid long, id long")
    r = E.summary(E.ranks(found, rel)).first()
    assert (r.questions, r.hit_1, r.hit_k, r.recall_k, r.mrr) == (2, 0.0, 0.5, 0.5, 0.25)
    phrases = spark.createDataFrame([("Use the **Save** button", ["the save  button", "Other"])], "a string, p array<string>")
    assert phrases.select(E.coverage(F.col("a"), F.col("p"))).first()[0] == 0.5


def test_extraction():
    page = H.page_of('<html><head><title>T – S</title></head><body><nav aria-label="Breadcrumb"><li>Home<li>Docs</nav><main><h1 id=x>Guide Copied!</h1><p>One<p>Two <b>bold</b><ul><li>a<ul><li>b</ul><li>c</ul><table><tr><td>1<td>2<tr><td>3</table><pre><code class="language-py">x &lt; 1\n</code></pre><div class="related">no</div><div>loose<p>in</div></main>')
    assert page["title"] == "Guide" and page["breadcrumb"] == ["Home", "Docs"]
    assert [(b["type"], b["text"]) for b in page["blocks"]] == [("heading", "Guide"), ("paragraph", "One"), ("paragraph", "Two bold"), ("list", "- a\n  - b\n- c"), ("table", "| 1 | 2 |\n| --- | --- |\n| 3 |  |"), ("code", "```py\nx < 1\n```"), ("paragraph", "loose"), ("paragraph", "in")]


def test_hostile_pages_never_fail():
    r = random.Random(3)
    bits = ["<div>", "</div>", "<p", ">", "<table><tr><td>", "</", "<ul><li>", "text ", "&amp;", "&#99999999;", "<script>", "</script>", '<a href="', "<!--", "-->", "<h2>", "é", "\x00", "<img alt=x>", "<pre>", "<"]
    for _ in range(300):
        html = "".join(r.choice(bits) for _ in range(r.randint(0, 80)))
        page = H.page_of(html)
        blocks(html)
        found = K.passages(page["blocks"], page["title"], page["breadcrumb"])
        assert [f["chunk_pos"] for f in found] == list(range(len(found))) and all(f["body"] for f in found)
    deep = "<div>" * 5000 + "x" + "</div>" * 5000
    assert H.page_of(deep)["blocks"][0]["text"] == "x"


def test_chunks_keep_to_size_and_headings():
    b = lambda kind, text, level=None: {"type": kind, "text": text, "level": level, "anchor": None}
    sentence = "This is one sentence of ten words in a row. "
    found = K.passages([b("heading", "A", 1), b("paragraph", sentence * 80), b("heading", "B", 2), b("code", "x " * 900), b("paragraph", "end " * 200)], "A", ["Home"])
    assert found[0]["heading_path"] == "Home > A" and found[-1]["heading_path"] == "Home > A > B"
    assert all(K.size(f["body"]) <= 800 or "x x" in f["body"] for f in found)
    assert sum("x x" in f["body"] for f in found) == 1
    small = K.passages([b("heading", "A", 1), b("paragraph", "one"), b("heading", "B", 1), b("paragraph", "two")], "T", [])
    assert len(small) == 1 and small[0]["text"] == "T:\none\n\ntwo"
    assert K.passages([], None, None) == []


def test_emphasis_begins_after_a_blank():
    assert V.html_of("a*b*c and *d* (*e*)") == "<p>a*b*c and <em>d</em> (<em>e</em>)</p>"


def test_junk_by_class_and_id():
    page = H.page_of('<main><div id="related-settings">kept</div><div class="x-related">gone</div><div id="cookie-bar">gone</div><div class="Related">kept too</div><p>a <span class="Tooltip-x">gone</span>b</p><h2 id="t">T <i class="copy-link">Copied!</i></h2><ol><li>one<div><ul><li>in</ul></div><li>two</ol></main>')
    assert [b["text"] for b in page["blocks"]] == ["kept", "kept too", "a b", "T", "1. one in\n  - in\n2. two"] and page["outline"] == ["T"]
    assert H.page_of('<div id="main-content"><div class="wiki-content">x</div></div>')["platform"] == "confluence" and H.page_of('<p data-testid="page.desktop">x</p>')["platform"] == "gitbook"
    assert H.page_of('<link rel="canonical" href="/a"><time datetime="2024">', "https://h/b")["canonical"] == "https://h/a"


def bodies_by_definition(units, carried="", put_off=False):
    """The passages of units (text, loose): of all places where a passage may end, the first."""
    if not units and not carried:
        return []
    join = lambda j: ([carried] if carried else []) + [t for t, _ in units[:j]]
    for j in range(len(units) + 1):
        n = sum(map(K.size, join(j)))
        if j and units[j - 1][1] and n >= 350:
            return ["\n\n".join(join(j))] + bodies_by_definition(units[j:], K._tail(units[j - 1][0]))
        if j < len(units) and n and n + K.size(units[j][0]) > 400 and (j or not put_off):
            return ["\n\n".join(join(j))] + bodies_by_definition(units[j:], K._tail(" ".join(join(j))) if units[j][1] else "", True)
    return ["\n\n".join(join(len(units)))]


def random_blocks(r):
    words = ["a", "word", "longer-word", "z" * 1400, "x" * 3000, "end.", "why?", "だ。"]
    for _ in range(r.randint(0, 25)):
        kind = r.choice(["heading", "paragraph", "paragraph", "paragraph", "list", "code"])
        n = r.choice([1, 3, 30, 120, 300, 900]) if kind != "heading" else 3
        yield {"type": kind, "text": " ".join(r.choices(words, [30, 30, 10, 0.05, 0.05, 6, 2, 2], k=n)), "level": r.choice([None, 1, 2, 3]), "anchor": r.choice([None, "x", "y"])}


def test_units_lose_nothing_and_are_as_large_as_they_may_be():
    r = random.Random(8)
    for _ in range(200):
        for block in random_blocks(r):
            section = K.Section([])
            section.add(block)
            assert "".join("".join(section.texts).split()) == "".join(block["text"].split())
            if block["type"] != "paragraph" or K.size(block["text"]) <= 350:
                assert section.texts == [block["text"]]
            for one, after in zip(section.texts, section.texts[1:]):
                assert K.size(one) <= 350 and K.size(one) + K.size(after) > 175


def test_passages_follow_the_rules():
    r = random.Random(9)
    for _ in range(300):
        found = K.sections(list(random_blocks(r)))
        for section in found:
            assert section.bodies() == bodies_by_definition(list(zip(section.texts, section.loose)))


def test_rendering():
    assert V.html_of("1. a **b**\n2. c [1] [9]\n\n```\n<x>\n```\nend", 3) == '<ol><li>a <strong>b</strong></li><li>c <a class="cite" href="#source-1" data-cite="1">1</a> [9]</li></ol><pre><code>&lt;x&gt;</code></pre><p>end</p>'


def test_questions_from_titles(spark):
    want = {"Creating a report": "How do I create a report?", "Setting up alerts [admin]": "How do I set up alerts?", "Export data": "How do I export data?", "Team roles": "What is Team roles?", "Release notes 4": None, "May 2024 update": None, "A long heading that is no question or task at all": None}
    df = spark.createDataFrame([(t,) for t in want], "t string")
    assert {r.t: r.q for r in df.select("t", V.question(F.col("t")).alias("q")).collect()} == want


def test_nested_lists_have_no_depth_limit():
    found = H.page_of("<body>" + "".join(f"<ul><li>item{k} " for k in range(1500)))["blocks"]
    assert [line.strip() for line in found[0]["text"].split("\n")] == [f"- item{k}" for k in range(1500)]
