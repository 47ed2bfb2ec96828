"""Queries of prompts, events, conversations, kept answers, evaluation and crawl states, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.functions import lexicon as L
from millrace.functions import text as X
from millrace.functions import urls as R
from millrace.operators import articles as A
from millrace.operators import crawl as C
from millrace.operators import evaluate as E
from millrace.operators import turns as T
from millrace.operators import understand as U
from millrace.plans import crawl_queries as K
from millrace.plans import log_queries as Q
from millrace.plans import search_queries as S
from millrace.sources.tables import table

#: What a model may reply besides an answer, so that every kind of reply meets the rules.
REPLIES = [L.REFUSAL, f"Sorry.  {L.REFUSAL}", f"{L.REFUSAL} But the pages about billing and about export say how to go on from there.", "i don't have THAT in this\nindex", "", None]


def _replied(spark, d):
    """The turns' answers, and each refusal form beside them by turn number."""
    t = Q.turns(spark, d)
    forms = F.array(*map(F.lit, REPLIES))
    return t.select("id", "turn_no", "tier", "markdown", F.when(F.col("turn_no") % 3 == 1, F.get(forms, (F.col("turn_no") % len(REPLIES)).cast("int"))).otherwise(F.col("markdown")).alias("reply"), F.coalesce(F.size("sources"), F.lit(0)).alias("n"), F.get(F.transform("sources", lambda s: s["relevance"] / 100), F.lit(0)).alias("top"))


def refusal_replies(spark, d):
    return _replied(spark, d).select("id", "turn_no", T.is_refusal(F.col("reply")).alias("refusal"))


def turn_events(spark, d):
    """The events of each turn under its best source's relevance; every fifth is on a picked page, every other has an extract."""
    r = _replied(spark, d)
    certainty = T.decision(F.col("top"), F.col("n"), F.lit(0.45), F.lit(0.7), F.lit(True), F.col("turn_no") % 5 == 4)
    told = r.select(F.concat_ws("/", "id", "turn_no").alias("qid"), certainty.alias("certainty"), "tier", "reply", F.when(F.col("turn_no") % 2 == 0, F.concat(F.lit("From the page: "), "id")).alias("fallback"), F.when(F.col("n") >= 3, F.col("n")).otherwise(0).alias("refinements"))
    return T.events(told).withColumn("n", F.col("n").cast("long"))


def grounded_prompts(spark, d):
    """The prompt of each logged question over its packed articles."""
    c, ranked = S.chunks(spark, d), S._ranked_chunks(spark, d, S.logged)
    heads = A.article_order(ranked.join(c.select("vector_id", "title", "heading_path"), "vector_id")).groupBy("qid", "article").agg(F.min_by("title", "rank").alias("title"), F.min_by("heading_path", "rank").alias("heading_path"))
    packed = A.pack(S._articles(spark, d, ranked), 4, 3000).select("qid", "article", "body")
    given = T.context(packed.join(heads, ["qid", "article"]))
    return given.join(S.logged(spark, d), "qid").select("qid", T.prompt(F.col("query"), F.col("context")).alias("prompt"))


def history_list(spark, d):
    return T.history(table(spark, d, "chat_sessions")).withColumns({"place": F.col("place").cast("long"), "n_turns": F.col("n_turns").cast("long")})


def stored_turns(spark, d):
    """Turns as they would be stored: every seventh is still written, and refusals keep their reason and pages only."""
    t = Q.turns(spark, d)
    told = t.select("id", "turn_no", "question", F.when(F.col("turn_no") % 7 != 6, F.when(F.col("refused"), "refused").otherwise("answered")).alias("outcome"), "tier", F.coalesce("refusal_reason", F.lit("unknown")).alias("reason"), F.coalesce("markdown", F.lit("")).alias("markdown"), F.slice("sources", 1, 3).alias("nearest"), "sources")
    return T.saved_turns(told).select("id", "turn_no", "question", "tier", "refused", "refusal_reason", "markdown", F.size("sources").cast("long").alias("n_sources"))


def feedback_update(spark, d):
    """The log after feedback on every tenth question, given in the words that were typed."""
    log = Q.log(spark, d).filter("query is not null").withColumn("query", X.mask(F.col("query")))
    given = Q.log(spark, d).filter("query is not null and id % 10 = 0").select("index_id", "query", F.lit("down").alias("feedback"))
    return T.with_feedback(log, given).select("id", "feedback")


def cache_cycle(spark, d):
    """Entries and hits of each index's answers after all logged questions were asked, answers being put in before."""
    log = Q.log(spark, d).filter("query is not null")
    settings = T.fingerprint(F.lit(0.45), F.lit(0.7), F.lit(True), F.lit(False), F.lit(True))
    key = T.cache_key(F.col("index_id"), F.lit(17), F.col("query"), F.lit("extractive"), F.lit("none"), F.lit(None).cast("string"), settings)
    keyed = log.select(key.alias("key"), "index_id", F.col("outcome").alias("markdown"), (~F.coalesce("answered", F.lit(False))).alias("refused"), "at_ms")
    empty = spark.createDataFrame([], "key string, index_id string, markdown string, hits bigint, at_ms bigint")
    last = Q.NOW
    filled = T.put(empty, keyed, 60)
    return T.cache_stats(T.read(filled, keyed.select("key"), last, 1 << 60))


def result_cache(spark, d):
    log = Q.log(spark, d)
    last = log.agg(F.max("at_ms")).first()[0] or 0
    return T.kept_results(log.select(F.col("index_id").alias("session"), F.col("id").cast("string").alias("key"), F.col("at_ms").alias("read_ms"), (F.col("at_ms") - F.col("id") % 7 * 86_400_000).alias("at_ms")), last, 20, 90 * 86_400_000)


def _cases(spark, d):
    """Cases made of turns: the last source counts as right, written in another way; turns without sources have no answer."""
    t = Q.turns(spark, d).filter("question is not null")
    urls = F.transform(F.coalesce("sources", F.array().cast("array<struct<rank_no:int,title:string,breadcrumb:string,snippet:string,relevance:int,url:string,display_url:string>>")), lambda s: s["url"])
    last = F.get(F.transform("sources", lambda s: s["url"]), F.size("sources") - 1)
    expected = F.when(F.size("sources") > 0, F.array(F.concat(F.regexp_replace(F.regexp_replace(last, "#.*$", ""), "^https", "http"), F.lit("/")))).otherwise(F.array().cast("array<string>"))
    return t.select(
        (F.coalesce(F.size("sources"), F.lit(0)) > 1).alias("answerable"), expected.alias("expected"), F.transform(urls, lambda u: F.regexp_replace(u, "#.*$", "")).alias("retrieved"),
        (F.get("sources", F.lit(0))["relevance"] / 100).alias("top_score"), "refused", F.array_join(F.transform("sources", lambda s: s["snippet"]), "\n\n").alias("context"), F.coalesce("markdown", F.lit("")).alias("answer"),
        F.transform(F.filter("sources", lambda s: s["title"].isNotNull()), lambda s: s["title"]).alias("phrases"),
    ).withColumns({"context": F.coalesce("context", F.lit("")), "phrases": F.coalesce("phrases", F.array().cast("array<string>"))})


def evaluation_report(spark, d):
    return E.report(E.judged(_cases(spark, d), 0.45))


def missed_phrases(spark, d):
    return E.most_missed(E.judged(_cases(spark, d), 0.45))


def turn_report(spark, d):
    t = Q.turns(spark, d)
    return E.turn_report(t.select(F.when(F.col("refused"), "refusal").when(F.coalesce("markdown", F.lit("")) == "", "blocked").otherwise("answer").alias("outcome"), F.when(F.size("sources") >= 3, 1).otherwise(0).alias("refinements")))


def combined_replies(spark, d):
    """Replies that name a query, a passage, both or neither, made of logged questions."""
    q = Q.log(spark, d).filter("query is not null")
    reply = F.when(F.col("id") % 4 == 0, F.concat(F.lit(" Query: "), "query", F.lit("\nPASSAGE: it works\nlike this "))).when(F.col("id") % 4 == 1, F.col("query")).when(F.col("id") % 4 == 2, F.concat("query", F.lit("\npassage:  so"))).otherwise(F.concat(F.lit("QUERY:"), "query"))
    return q.select("id", U.combined(F.regexp_replace(reply, "\n(?!PASSAGE|passage|like)", " ")).alias("c")).select("id", "c.*")


def _queue(spark, d):
    """The URLs of all fetches, after their last fetch."""
    last = C.outcome(C.latest_fetch(K.pages(spark, d)))
    empty = spark.createDataFrame([], "url string, depth int, status string, attempts int, last_status int, reason string")
    queue = C.enqueued(empty, last.select(F.col("page").alias("url"), (F.col("fetch_id") % 3).cast("int").alias("depth")))
    state = F.when(F.col("outcome").isin("indexed", "unchanged"), "done").when(F.col("outcome") == "skipped", "skipped").otherwise("failed")
    return C.marked(queue, last.select(F.col("page").alias("url"), state.alias("status"), F.when(state == "failed", F.col("status")).alias("last_status"), F.lit(None).cast("string").alias("reason")))


def frontier_states(spark, d):
    return _queue(spark, d)


def frontier_requeued(spark, d):
    """How many URLs are in each state before and after a sweep of retries, and after a second one without new attempts left."""
    q = _queue(spark, d)
    again = C.requeued(q)
    spent = C.requeued(q.withColumn("attempts", F.lit(2)))
    named = lambda df, n: C.counts(df).withColumn("step", F.lit(n))
    return named(q, "before").unionByName(named(again, "after")).unionByName(named(spent, "spent")).unionByName(named(C.recrawled(q), "recrawl"))


def next_batch(spark, d):
    """The next 20 URLs of a queue in which every third URL is still to be fetched."""
    q = _queue(spark, d).withColumn("status", F.when(F.col("depth") == 0, "queued").otherwise(F.col("status")))
    return C.next_queued(q, 20).select("url", "depth")


def crawl_run(spark, d):
    """A crawl over the fetched pages from the first fetches of each host, two links deep, at most 150 pages."""
    p = C.outcome(C.latest_fetch(K.pages(spark, d)))
    seeds = p.groupBy(R.host(F.col("page")).alias("h")).agg(F.min("page").alias("url")).select("url")
    return C.crawled(p, seeds, C.robots_rules(spark.createDataFrame(K.ROBOTS, "host string, text string")), "ExampleBot/1.0", [], ["*/jobs*"], 2, 150)


def render_budget(spark, d):
    """Which pages are rendered, if every page asks for it and those with an even number of characters gain by it."""
    p = K.pages(spark, d).select("fetch_id", R.host(F.col("url")).alias("host"), "fetched_at", (F.coalesce(F.length("html"), F.lit(1)) % 8 == 0).alias("helped"))
    return C.renders(p, "host", ["fetched_at", "fetch_id"], "helped", 30, 5).select("fetch_id", "allowed")


def failure_ceiling(spark, d):
    """Where crawls of each host would stop after two failures in a row; statuses are spread over the fetches by number."""
    status = F.when(F.col("fetch_id") % 5 == 0, 503).when(F.col("fetch_id") % 5 == 1, 404).when(F.col("fetch_id") % 7 == 0, 0).otherwise(200)
    p = K.pages(spark, d).select("fetch_id", R.host(F.col("url")).alias("host"), "fetched_at", status.alias("status"))
    return C.stopped(p, "host", ["fetched_at", "fetch_id"], "status", 2)


def site_preview(spark, d):
    """What a crawl of one part of a site would reach: its seeds are the site's chunk URLs, its root page has the fetches' links."""
    mine = lambda c: R.host(c) == "docs.yarnix.test"
    seeds = table(spark, d, "chunks").select("url").distinct().filter(mine(F.col("url")))
    linked = C.links(K.pages(spark, d)).filter(mine(F.col("link"))).select("link")
    rules = C.robots_rules(spark.createDataFrame(K.ROBOTS, "host string, text string"))
    return C.site_preview(seeds, rules, "ExampleBot/1.0", "https://docs.yarnix.test/hc/", linked, [], ["*/api/*"], 2000)


_T = Q._TURNS
_NONE = "NULL"
_FORMS = "[" + ", ".join("NULL" if r is None else "'" + r.replace("'", "''") + "'" for r in REPLIES) + "]"
_SENTENCE = "'" + L.REFUSAL.lower().rstrip(".").replace("'", "''") + "'"
_REPLIED = f"{_T}, r AS (SELECT id, turn_no, tier, CASE WHEN turn_no % 3 = 1 THEN {_FORMS}[turn_no % {len(REPLIES)} + 1] ELSE markdown END AS reply, coalesce(len(sources), 0) AS n, sources[1].relevance / 100 AS top FROM t)"
_SQUEEZED = "trim(regexp_replace(coalesce({}, ''), '[\\s\\x{{00A0}}\\x{{FEFF}}\\x{{2000}}-\\x{{200A}}\\x{{202F}}\\x{{3000}}]+', ' ', 'g'))"
_REFUSAL = f"(contains(lower({_SQUEEZED.format('reply')}), {_SENTENCE}) AND length({_SQUEEZED.format('reply')}) < length({_SENTENCE}) + 40)"
_BODIES = (
    f"{S._FIELDED}, {S._PAGED}, hd AS (SELECT qid, article, url, max(best) AS best FROM ao GROUP BY ALL), ld AS (SELECT qid, max(best) FILTER (article = 0) AS a, max(best) FILTER (article = 1) AS b2 FROM hd GROUP BY qid), sz AS (SELECT url, coalesce(sum(length(body)), 0) AS chars FROM c GROUP BY url),"
    " near AS (SELECT DISTINCT qid, article, url, unnest(range(chunk_pos - 2, chunk_pos + 3)) AS chunk_pos FROM ao), w AS (SELECT n.qid, n.article, n.url, c.vector_id FROM near n JOIN c ON c.url = n.url AND c.chunk_pos = n.chunk_pos UNION SELECT hd.qid, hd.article, hd.url, c.vector_id FROM hd JOIN ld USING (qid) JOIN sz USING (url) JOIN c ON c.url = hd.url WHERE article = 0 AND chars <= 8000 AND (b2 IS NULL OR (a > 0 AND (a - b2) / a >= 0.1 - 1e-9))),"
    " tx AS (SELECT w.*, c.chunk_pos, regexp_replace(coalesce(body, ''), '^[\\s\\x{00A0}\\x{2000}-\\x{200A}\\x{202F}\\x{3000}\\x{0085}]+|[\\s\\x{00A0}\\x{2000}-\\x{200A}\\x{202F}\\x{3000}\\x{0085}]+$', '', 'g') AS x FROM w JOIN c USING (vector_id)), wb AS (SELECT qid, article, url, string_agg(x, chr(10) || chr(10) ORDER BY chunk_pos, vector_id) AS b FROM tx WHERE x <> '' GROUP BY ALL),"
    " bd AS (SELECT qid, article, url, CASE WHEN length(b) <= 6000 THEN b WHEN strpos(reverse(b[:6000]), chr(10) || chr(10)) > 0 AND 6000 - strpos(reverse(b[:6000]), chr(10) || chr(10)) - 1 > 3000 THEN b[:6000 - strpos(reverse(b[:6000]), chr(10) || chr(10)) - 1] ELSE b[:6000] END AS body FROM wb),"
    f" sq AS (SELECT *, {_SQUEEZED.format('body')} AS s FROM bd), tk AS (SELECT *, CASE WHEN s = '' THEN 0 ELSE greatest(ceil(len(string_split(s, ' ')) / 0.75), ceil(length(s) / 6)) END::BIGINT AS tokens FROM sq),"
    " ru AS (SELECT *, row_number() OVER g AS place, sum(tokens) OVER g AS total FROM tk WINDOW g AS (PARTITION BY qid ORDER BY article)), pk AS (SELECT * FROM ru WHERE place <= 4 AND (place = 1 OR total <= 3000))"
)
_MASKED = Q._masked()
_WS = "regexp_replace({}, '^[\\s\\x{{00A0}}]+|[\\s\\x{{00A0}}]+$', '', 'g')"
_HOSTED = "lower(regexp_extract(url, '^[a-zA-Z]+://([^/?#:]*)', 1))"
_NAMED = "lower(regexp_extract({0}, '^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1) || regexp_replace(regexp_extract({0}, '^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)', 1), '/+$', '') || regexp_extract({0}, '(\\?[^#]*)', 1))"
_MISS = f"list_filter(phrases, lambda p: {Q._MATCH.format('p')} = '' OR NOT contains(HAY, {Q._MATCH.format('p')}))"
_JUDGED = (
    f"{_T}, cs AS (SELECT coalesce(len(sources), 0) > 1 AS answerable, CASE WHEN len(sources) > 0 THEN {_NAMED.format('sources[len(sources)].url')} END AS want, list_transform(coalesce(sources, []), lambda s: {_NAMED.format('s.url')}) AS got, coalesce(sources[1].relevance / 100, 0) AS top, refused, coalesce(markdown, '') AS answer,"
    " coalesce(array_to_string(list_transform(sources, lambda s: s.snippet), chr(10) || chr(10)), '') AS context, coalesce(list_transform(list_filter(sources, lambda s: s.title IS NOT NULL), lambda s: s.title), []) AS phrases FROM t WHERE question IS NOT NULL),"
    f" j AS (SELECT *, list_position(got, want) AS rank, len(got) > 0 AND top >= 0.45 AS clears, {Q._MATCH.format('context')} AS ch, {Q._MATCH.format('answer')} AS ah FROM cs), jj AS (SELECT *, CASE WHEN rank > 0 THEN rank END AS first_rank, clears AND NOT refused AS answered, {_MISS.replace('HAY', 'ch')} AS cm, {_MISS.replace('HAY', 'CASE WHEN clears THEN ah ELSE ch END')} AS am FROM j)"
)
_RATIO = "CASE WHEN len(phrases) = 0 THEN 1.0 ELSE 1 - len({}) / len(phrases) END"
_mean = lambda v, of: f"round(coalesce(avg({v}) FILTER ({of}), 0), 6)"
_LAST = f"{K._P}, la AS (SELECT *, {K._canonical('url')} AS page FROM p QUALIFY page IS NOT NULL AND row_number() OVER (PARTITION BY page ORDER BY fetched_at DESC, fetch_id DESC) = 1), oc AS (SELECT page AS url, fetch_id, html, base, status, {K._WHY} AS why, CASE WHEN status = 304 THEN 'unchanged' WHEN {{wall}} IS NOT NULL THEN 'auth' WHEN {K._WHY} IS NOT NULL THEN 'failed' WHEN no THEN 'skipped' ELSE 'indexed' END AS outcome FROM (SELECT *, {K._canonical('final_url')} AS base, coalesce(regexp_matches(robots_tag, '(?i)(^|[\\s,])(noindex|none)([\\s,]|$)'), false) OR {K._META} AS no, {K._WALL} AS wl FROM la))"
_LAST = _LAST.replace("{wall}", "wl")
_STATE = f"{_LAST}, qu AS (SELECT url, (fetch_id % 3)::INT AS depth, CASE WHEN outcome IN ('indexed', 'unchanged') THEN 'done' WHEN outcome = 'skipped' THEN 'skipped' ELSE 'failed' END AS status, 1 AS attempts, CASE WHEN outcome IN ('auth', 'failed') THEN status END AS last_status, CASE WHEN outcome IN ('auth', 'failed') THEN coalesce(CASE WHEN status = 0 THEN 'network' WHEN status IN (404, 410) THEN 'missing' WHEN status IN (401, 403) THEN 'forbidden' WHEN status IN (408, 429) THEN 'throttled' WHEN status >= 500 THEN 'server' END, 'other') END AS reason FROM oc)"
_count = lambda s: ", ".join(f"count(*) FILTER ({s} = '{x}') AS {x}" for x in ("queued", "done", "failed", "skipped"))
_AGAIN = "CASE WHEN status = 'failed' AND reason IN ('network', 'server', 'throttled', 'indexing') AND {} < 2 THEN 'queued' ELSE status END"

SQL = {
    "refusal_replies": f"WITH {_REPLIED} SELECT id, turn_no, {_REFUSAL} AS refusal FROM r",
    "turn_events": f"WITH {_REPLIED}, v AS (SELECT *, CASE WHEN n = 0 OR coalesce(top, 0) < 0.45 THEN CASE WHEN turn_no % 5 = 4 AND n > 0 THEN 'uncertain' ELSE 'refuse' END WHEN top >= 0.7 THEN 'confident' ELSE 'uncertain' END AS ce, {_REFUSAL} AS de, turn_no % 2 = 0 AND tier <> 'extractive' AS ex, CASE WHEN n >= 3 THEN [{{'kind': 'refine', 'detail': n::VARCHAR}}] ELSE [] END AS rf, 'From the page: ' || id AS fb FROM r),"
    " st AS (SELECT id || '/' || turn_no AS qid, CASE WHEN ce = 'refuse' THEN [{'kind': 'refusal', 'detail': 'below-floor'}, {'kind': 'done', 'detail': NULL}] WHEN reply IS NULL THEN [{'kind': 'sources', 'detail': ce}, {'kind': 'refusal', 'detail': 'generator-error'}, {'kind': 'done', 'detail': NULL}]"
    " WHEN de AND ex THEN list_concat(list_concat([{'kind': 'sources', 'detail': ce}, {'kind': 'delta', 'detail': reply}, {'kind': 'restart', 'detail': 'extractive'}, {'kind': 'delta', 'detail': fb}], rf), [{'kind': 'done', 'detail': NULL}]) WHEN de THEN [{'kind': 'sources', 'detail': ce}, {'kind': 'delta', 'detail': reply}, {'kind': 'refusal', 'detail': 'model-declined'}, {'kind': 'done', 'detail': NULL}]"
    " ELSE list_concat(list_concat([{'kind': 'sources', 'detail': ce}, {'kind': 'delta', 'detail': reply}], rf), [{'kind': 'done', 'detail': NULL}]) END AS e FROM v) SELECT qid, k - 1 AS n, e[k].kind AS kind, e[k].detail AS detail FROM (SELECT qid, e, unnest(range(1, len(e) + 1)) AS k FROM st)",
    "grounded_prompts": f"{_BODIES.replace(S._FIELDED, S._FIELDED_LOGGED)}, hh AS (SELECT qid, article, list(title ORDER BY rank)[1] AS title, list(heading_path ORDER BY rank)[1] AS heading_path FROM (SELECT ao.qid, ao.article, ao.rank, c.title, c.heading_path FROM ao JOIN c ON c.vector_id = ao.id) GROUP BY ALL), cx AS (SELECT qid, string_agg('[' || (article + 1) || '] ' || coalesce(title, '') || CASE WHEN coalesce(heading_path, '') <> '' THEN ' — ' || heading_path ELSE '' END || chr(10) || body, chr(10) || chr(10) ORDER BY article) AS context FROM pk JOIN hh USING (qid, article) GROUP BY qid) SELECT qid, '" + "\n".join(L.PROMPT_RULES).replace("'", "''") + "' || chr(10) || chr(10) || 'CONTEXT:' || chr(10) || context || chr(10) || chr(10) || 'QUESTION: ' || query || chr(10) || chr(10) || 'ANSWER:' AS prompt FROM cx JOIN q USING (qid)",
    "history_list": f"WITH {_T}, h AS (SELECT *, coalesce({_WS.format('turns[1].question')}, 'New conversation') AS f FROM s WHERE len(turns) > 0) SELECT index_id, row_number() OVER (PARTITION BY index_id ORDER BY updated_at DESC, id) - 1 AS place, id, CASE WHEN length(f) > 80 THEN f[:79] || '…' ELSE f END AS title, len(turns) AS n_turns, updated_at FROM h",
    "stored_turns": f"WITH {_T.replace('t.sources', 't.sources, t.refusal_reason')} SELECT id, turn_no, question, CASE WHEN refused THEN 'extractive' ELSE tier END AS tier, refused, CASE WHEN refused THEN coalesce(refusal_reason, 'unknown') END AS refusal_reason, CASE WHEN refused THEN '' ELSE coalesce(markdown, '') END AS markdown, CASE WHEN refused THEN least(3, len(sources)) ELSE len(sources) END AS n_sources FROM t WHERE turn_no % 7 <> 6",
    "feedback_update": f"WITH {Q._LOG}, m AS (SELECT *, {_MASKED} AS mq FROM l WHERE query IS NOT NULL), g AS (SELECT DISTINCT index_id, mq FROM m WHERE id % 10 = 0), la AS (SELECT arg_max(id, (at_ms, id)) AS id FROM m JOIN g USING (index_id, mq) GROUP BY index_id, mq) SELECT m.id, CASE WHEN la.id IS NOT NULL THEN 'down' ELSE feedback END AS feedback FROM m LEFT JOIN la ON la.id = m.id",
    "cache_cycle": f"WITH {Q._LOG}, k AS (SELECT index_id, lower({_SQUEEZED.format('query')}) AS q, answered, at_ms FROM l WHERE query IS NOT NULL), e AS (SELECT index_id, q, max(at_ms) AS at_ms FROM k WHERE answered GROUP BY index_id, q QUALIFY row_number() OVER (PARTITION BY index_id ORDER BY max(at_ms) DESC) <= 60), n AS (SELECT index_id, q, count(*) AS n FROM k GROUP BY ALL) SELECT index_id, count(*) AS entries, sum(coalesce(n, 0))::BIGINT AS hits FROM e LEFT JOIN n USING (index_id, q) GROUP BY index_id",
    "result_cache": f"WITH {Q._LOG}, x AS (SELECT index_id AS session, id::VARCHAR AS key, at_ms AS read_ms, at_ms - id % 7 * 86400000 AS at_ms, (SELECT max(at_ms) FROM l) AS now FROM l), y AS (SELECT *, row_number() OVER (PARTITION BY session ORDER BY read_ms DESC, key) AS n FROM x) SELECT session, key, read_ms, at_ms FROM y WHERE n <= 20 AND now - at_ms <= {90 * 86400000}",
    "evaluation_report": f"WITH {_JUDGED} SELECT count(*) FILTER (answerable) AS answerable, count(*) FILTER (NOT answerable) AS unanswerable, {', '.join(_mean(f'coalesce((first_rank <= {k})::INT, 0)', 'answerable') + f' AS hit_{k}' for k in (1, 3, 5))}, {_mean('coalesce(1 / first_rank, 0)', 'answerable')} AS mrr, {_mean('answered::INT', 'NOT answerable')} AS false_answers, {_mean('(first_rank IS NOT NULL AND NOT answered)::INT', 'answerable')} AS missed_answers, {_mean(_RATIO.format('cm'), 'answerable')} AS context_coverage, {_mean(_RATIO.format('am'), 'answerable')} AS answer_coverage FROM jj",
    "missed_phrases": f"WITH {_JUDGED} SELECT phrase, count(*) AS misses FROM (SELECT unnest(am) AS phrase FROM jj WHERE answerable) GROUP BY 1 ORDER BY misses DESC, phrase LIMIT 10",
    "turn_report": f"WITH {_T}, o AS (SELECT CASE WHEN refused THEN 'refusal' WHEN coalesce(markdown, '') = '' THEN 'blocked' ELSE 'answer' END AS o, coalesce(len(sources), 0) >= 3 AS r FROM t) SELECT count(*) AS n, round(avg((o = 'blocked')::INT), 6) AS blocked_rate, round(avg((o = 'answer' AND r)::INT), 6) AS refine_rate FROM o",
    "combined_replies": f"WITH {Q._LOG}, x AS (SELECT id, regexp_replace(query, '\n', ' ', 'g') AS q FROM l WHERE query IS NOT NULL) SELECT id, CASE WHEN {_WS.format('q')} <> '' OR id % 4 IN (1, 2) THEN {_WS.format('q')} WHEN id % 4 = 0 THEN 'PASSAGE: it works' ELSE 'QUERY:' END AS query, CASE id % 4 WHEN 0 THEN 'it works' || chr(10) || 'like this' WHEN 2 THEN 'so' ELSE '' END AS passage FROM x",
    "frontier_states": f"WITH {_STATE} SELECT * FROM qu",
    "frontier_requeued": f"WITH {_STATE} SELECT 'before' AS step, {_count('status')} FROM qu UNION ALL SELECT 'after', {_count(_AGAIN.format('attempts'))} FROM qu UNION ALL SELECT 'spent', {_count(_AGAIN.format('2'))} FROM qu UNION ALL SELECT 'recrawl', count(*), 0, 0, 0 FROM qu",
    "next_batch": f"WITH {_STATE} SELECT url, depth FROM qu WHERE depth = 0 OR status = 'queued' ORDER BY url LIMIT 20",
    "render_budget": f"WITH {K._P}, k AS (SELECT fetch_id, host, fetched_at, bad, row_number() OVER w AS k, sum(bad) OVER (PARTITION BY host ORDER BY fetched_at, fetch_id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS run FROM (SELECT fetch_id, {_HOSTED} AS host, fetched_at, (coalesce(length(html), 1) % 8 <> 0)::INT AS bad FROM p) WINDOW w AS (PARTITION BY host ORDER BY fetched_at, fetch_id)) SELECT fetch_id, k <= 30 AND k <= coalesce(min(k) FILTER (run = 5) OVER (PARTITION BY host), k) AS allowed FROM k",
    "failure_ceiling": f"WITH {K._P}, s AS (SELECT {_HOSTED} AS host, fetched_at, fetch_id, CASE WHEN fetch_id % 5 = 0 THEN 503 WHEN fetch_id % 5 = 1 THEN 404 WHEN fetch_id % 7 = 0 THEN 0 ELSE 200 END AS st FROM p), t AS (SELECT *, lag(st) OVER (PARTITION BY host ORDER BY fetched_at, fetch_id) AS before FROM s WHERE st <> 404) SELECT host, fetched_at, fetch_id FROM t WHERE st <> 200 AND before <> 200 QUALIFY row_number() OVER (PARTITION BY host ORDER BY fetched_at, fetch_id) = 1",
}
SQL["article_bodies"] = f"{_BODIES} SELECT qid, article, url, body FROM bd"
SQL["pack_context"] = f"{_BODIES} SELECT qid, article, url, tokens, total::BIGINT AS total FROM pk"

# all of this root lies under /hc/, which the host's last group for "*" bars
_FIT = "NOT regexp_matches({0}, '" + K._RE("*/api/*") + "') AND NOT regexp_matches({0}, '" + L.BINARY + "') AND NOT regexp_matches({0}, '" + L.ATTACHMENT + "')"
SQL["site_preview"] = (
    f"WITH {K._P}, {K._EDGES}, sd AS (SELECT DISTINCT url FROM chunks WHERE lower(regexp_extract(url, '^[a-zA-Z]+://([^/?#:]*)', 1)) = 'docs.yarnix.test'), cn AS (SELECT {K._canonical('url')} AS u FROM sd), ins AS (SELECT u, regexp_matches(u, '^[a-z]+://[^/]+/hc/') AND {_FIT.format('u')} AS inside FROM cn),"
    f" ln AS (SELECT DISTINCT link FROM ed WHERE regexp_extract(link, '^[a-z]+://([^/?#:]*)', 1) = 'docs.yarnix.test' AND {_FIT.format('link')}), n AS (SELECT (SELECT count(*) FROM ins) AS discovered, (SELECT count(*) FROM ins WHERE NOT inside) AS excluded, (SELECT count(*) FROM ins WHERE inside) AS blocked, (SELECT count(*) FROM ln WHERE regexp_matches(link, '^[a-z]+://[^/]+/hc/')) AS linked_here, (SELECT count(*) FROM ln) AS linked_on_host)"
    " SELECT *, greatest(1, least(2000, 1 + linked_here)) AS expected, CASE WHEN linked_on_host - linked_here >= 3 THEN 'https://docs.yarnix.test/' END AS better_root FROM n"
)

QUERIES = {f.__name__: f for f in (refusal_replies, turn_events, grounded_prompts, history_list, stored_turns, feedback_update, cache_cycle, result_cache, evaluation_report, missed_phrases, turn_report, combined_replies, frontier_states, frontier_requeued, next_batch, crawl_run, render_budget, failure_ceiling, site_preview)}
