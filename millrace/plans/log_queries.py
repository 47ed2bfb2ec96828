"""Queries of decisions, question understanding and log analytics over the project's tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions import lexicon as L
from millrace.functions import text as X
from millrace.operators import crawl as C
from millrace.operators import decide as D
from millrace.operators import evaluate as E
from millrace.operators import logs as G
from millrace.operators import understand as U
from millrace.plans.search_queries import TOK
from millrace.sources.tables import one_of_each, table

#: The moment that ages are counted from: fixed, so that results don't depend on the day of the run.
NOW = 1_735_689_600_000
FLOORS = [round(0.3 + 0.05 * k, 2) for k in range(13)]
DELTAS = [0.0, 0.01, 0.02, 0.03, 0.05, 0.08, 0.1, 0.15, 0.2]


def log(spark: SparkSession, d: str) -> DataFrame:
    return one_of_each(table(spark, d, "query_log"), "id")


def turns(spark: SparkSession, d: str) -> DataFrame:
    """The turns of the last save of each conversation."""
    last = G.latest_sessions(table(spark, d, "chat_sessions"))
    return last.select("id", "index_id", F.posexplode("turns").alias("turn_no", "t")).select("id", "index_id", F.col("turn_no").cast("long").alias("turn_no"), "t.*")


def verdict_bands(spark, d):
    v = D.verdict(F.col("top_score"), F.col("top_score").isNotNull(), F.lit(0.45), F.lit(0.7))
    return log(spark, d).select("index_id", v.alias("verdict")).groupBy("index_id", "verdict").agg(F.count("*").alias("n"))


def calibrate_floors(spark, d):
    scores = log(spark, d).select("index_id", F.col("top_score").alias("score"), F.coalesce("answered", F.lit(False)).alias("positive"))
    return D.calibrate(scores, "index_id")


def _cases(spark, d):
    return log(spark, d).filter("top_score is not null").select("top_score", F.coalesce("answered", F.lit(False)).alias("answerable"))


def floor_sweep(spark, d):
    return D.sweep(_cases(spark, d), FLOORS)


def recommended_floor(spark, d):
    return D.lowest_floor(D.sweep(_cases(spark, d), FLOORS))


def scatter_sweep(spark, d):
    one = turns(spark, d).filter(F.size("sources") >= 2).select(F.transform("sources", lambda s: s["relevance"] / 100).alias("leading"), (~F.col("refused")).alias("single_intent"))
    return D.scatter_sweep(one, DELTAS)


def pii_mask(spark, d):
    return log(spark, d).filter("query is not null").select("id", X.mask(F.col("query")).alias("masked"), X.mask(F.col("query"), L.EGRESS).alias("egress"))


def intents(spark, d):
    return log(spark, d).filter("query is not null").select("id", U.intent(F.col("query")).alias("intent"))


def follow_up(spark, d):
    asked = turns(spark, d).filter("question is not null")
    return U.resolved(asked, "id", "turn_no", "question").select("id", "turn_no", "search")


def rewrite_guard(spark, d):
    """Each question against the one that was asked after it in the same index, as if that were its rewrite."""
    from pyspark.sql import Window

    q = log(spark, d).filter("query is not null")
    pairs = q.withColumn("reply", F.lead("query").over(Window.partitionBy("index_id").orderBy("at_ms", "id"))).filter("reply is not null")
    return pairs.select("id", U.rejection(F.col("query"), U.cleaned(F.col("reply"))).alias("reason"))


def query_plans(spark, d):
    asked = U.resolved(turns(spark, d).filter("question is not null"), "id", "turn_no", "question")
    return U.planned(asked, "question", "search", "markdown").select("id", "turn_no", "plan", "source")


def failed_queries(spark, d):
    bad = G.failed(F.col("top_score"), F.col("answered"), F.col("feedback"), 0.45, 0.7)
    return log(spark, d).filter(bad).groupBy("index_id").agg(F.count("*").alias("n"), F.round(F.sum(F.coalesce("top_score", F.lit(0.0))), 6).alias("total_score"))


def gap_report(spark, d):
    return G.gap_report(log(spark, d), 0.45, 0.7)


def gap_csv(spark, d):
    return G.csv_lines(gap_report(spark, d))


def pick_priors(spark, d):
    return G.priors(log(spark, d))


def prior_boost(spark, d):
    asked = log(spark, d).filter("id % 100 = 0 and query is not null").select(F.col("id").alias("qid"), "index_id", "query")
    return G.prior_boosts(G.priors(log(spark, d)), asked, NOW).withColumn("boost", F.round("boost", 6))


def _usage(spark, d):
    e = table(spark, d, "events")
    return e.select(F.col("ts").alias("at"), F.col("event_type").alias("model"), F.floor(F.coalesce("value", F.lit(0.0))).cast("long").alias("prompt_tokens"), (F.col("event_id") % 100).alias("completion_tokens"), (F.col("user_id") % 7 == 0).alias("estimated"))


def spend_rollup(spark, d):
    rates = spark.createDataFrame([("view", 1.0, 4.0), ("click", 2.0, 8.0), ("purchase", 0.5, 1.5)], "model string, per_prompt double, per_completion double")
    return G.spend(_usage(spark, d), rates).withColumns({"day": F.col("day").cast("string"), "cost": F.round(F.col("cost") + 1e-9, 4)})


def cache_eviction(spark, d):
    entries = log(spark, d).filter("answered").select("id", "index_id", "at_ms")
    last = entries.agg(F.max("at_ms").alias("now")).first()["now"] or 0
    return G.kept_cache(entries, last, ttl_ms=30 * G.DAY, per_index=50)


def chat_sessions_latest(spark, d):
    return G.latest_sessions(table(spark, d, "chat_sessions")).select("id", "index_id", "updated_at", F.size("turns").cast("long").alias("n_turns"))


def chat_sessions_kept(spark, d):
    return G.latest_sessions(table(spark, d, "chat_sessions"), 50).select("id", "updated_at")


def index_stats(spark, d):
    return G.index_statistics(one_of_each(table(spark, d, "chunks"), "vector_id"), size=384)


def index_freshness(spark, d):
    return G.freshness(table(spark, d, "site_indexes"), NOW, "bge-small-en-v1.5", 7, 30).select("index_id", "age_days", "stale", "due", "rebuild")


def probe_titles(spark, d):
    return G.even_stride(table(spark, d, "chunks"), "index_id", "title")


def content_hashes(spark, d):
    c = one_of_each(table(spark, d, "chunks"), "vector_id").filter("body is not null")
    return c.select("vector_id", X.fnv1a(F.col("body")).alias("hash"), F.col("content_hash").alias("stored"))


def content_hash_dupes(spark, d):
    c = one_of_each(table(spark, d, "chunks"), "vector_id").filter("body <> ''")
    return C.duplicates(c, "body", "vector_id")


def failure_streaks(spark, d):
    return G.streaks(log(spark, d), "index_id", ["at_ms", "id"], ~F.coalesce(F.col("answered"), F.lit(False)))


def outcome_counts(spark, d):
    return log(spark, d).groupBy("index_id").pivot("outcome", ["answered", "refined", "refused"]).count().na.fill(0)


def log_dedupe(spark, d):
    return table(spark, d, "query_log").dropDuplicates(["id"]).groupBy("index_id").agg(F.count("*").alias("n"), F.min("at_ms").alias("first"), F.max("at_ms").alias("last"))


def event_sessions(spark, d):
    e = table(spark, d, "events")
    return e.groupBy("user_id", F.session_window("ts", "30 minutes").alias("w")).agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("start"), "n")


def event_windows(spark, d):
    e = table(spark, d, "events")
    return e.groupBy(F.window("ts", "1 day").alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def answer_coverage(spark, d):
    """How much of what its sources' titles name an answer mentions."""
    t = turns(spark, d).filter("markdown is not null").select("id", "turn_no", "markdown", F.transform(F.filter("sources", lambda s: s["title"].isNotNull()), lambda s: s["title"]).alias("titles"))
    return t.select("id", "turn_no", F.round(E.coverage(F.col("markdown"), F.col("titles")), 6).alias("ratio"))


def refusals(spark, d):
    return turns(spark, d).groupBy("index_id", "tier").agg(F.count_if("refused").alias("refused"), F.count("*").alias("turns"), F.round(F.avg(F.col("refused").cast("double")), 6).alias("rate"))


#: Statuses and texts that reach every branch of telling failures apart.
SAID = ["", *L.QUOTA_SAID, *L.MODEL_SAID, *L.FILTER_SAID, *L.RATE_SAID, *L.DOWN_SAID, *L.CONTEXT_SAID, "your credit card form", "Quota exceeded: rate limit reached", "SAFETY stop of an unknown model", "timed out"]
STATUSES = [0, 200, 400, 401, 402, 403, 404, 408, 418, 422, 429, 500, 502, 504]


def error_kinds(spark, d):
    """The kind and policy of each status with each text, and of the fetched pages' statuses."""
    literal = lambda xs: F.explode(F.array(*map(F.lit, xs)))
    cases = spark.range(1).select(literal(STATUSES).alias("status")).select("status", literal(SAID).alias("said"))
    both = cases.unionByName(one_of_each(table(spark, d, "pages_raw").select("fetch_id", "status"), "fetch_id").select("status", F.lit("").alias("said")))
    kinds = both.groupBy("status", "said").agg(F.count("*").alias("n")).withColumn("kind", G.error_kind(F.col("status"), F.col("said")))
    return kinds.join(F.broadcast(G.error_policies(spark)), "kind", "left")


def _duck(p: str) -> str:
    return L.duck(p).replace("'", "''")


_LOG = "l AS (SELECT DISTINCT ON (id) * FROM query_log)"
_TURNS = "s AS (SELECT * FROM chat_sessions QUALIFY row_number() OVER (PARTITION BY id ORDER BY updated_at DESC, len(turns) DESC) = 1), t AS (SELECT id, index_id, generate_subscripts(turns, 1) - 1 AS turn_no, unnest(turns, recursive := true) FROM (SELECT id, index_id, turns FROM s))"
_TURNS = "s AS (SELECT * FROM chat_sessions QUALIFY row_number() OVER (PARTITION BY id ORDER BY updated_at DESC, len(turns) DESC) = 1), t0 AS (SELECT id, index_id, generate_subscripts(turns, 1) - 1 AS turn_no, unnest(turns) AS t FROM s), t AS (SELECT id, index_id, turn_no, t.question, t.markdown, t.tier, t.refused, t.sources FROM t0)"


def _masked(kinds=None) -> str:
    out = "query"
    for kind, p, label in L.MASKS:
        if kinds is None or kind in kinds:
            out = f"regexp_replace({out}, '{_duck(p)}', '{label}', 'g')"
    return out


def _list(values) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


_FAILED = "(coalesce(feedback = 'down', false) OR coalesce(top_score, 0) < 0.45 OR (NOT coalesce(answered, false) AND coalesce(top_score, 0) < 0.7))"



def _telling(text: str) -> str:
    tok = TOK.format(text)
    return f"list_filter({tok}, lambda x, i: length(x) >= 3 AND x NOT IN ({_list([*L.QUESTION_STOPWORDS, *L.REFERENTIAL])}) AND list_position({tok}, x) = i)"


_PRIORS = f"picks AS (SELECT * FROM l WHERE picked_url IS NOT NULL QUALIFY row_number() OVER (PARTITION BY index_id ORDER BY at_ms DESC, id DESC) <= 500), base AS (SELECT index_id, picked_url AS url, count(*) AS picks, max(at_ms) AS last_at FROM picks GROUP BY ALL), pr AS (SELECT index_id, url, term, count(*) AS seen FROM (SELECT index_id, picked_url AS url, unnest({_telling('coalesce(picked_for, query)')}) AS term FROM picks) GROUP BY ALL), kn AS (SELECT * FROM pr JOIN base USING (index_id, url))"
_TRIM = "regexp_replace(regexp_replace(lower({}), '^[\\s\\x{{00A0}}]+|[\\s\\x{{00A0}}]+$', '', 'g'), '[!.,;:]+$', '')"
_PLAIN = f"trim(regexp_replace({_TRIM.format('query')}, '[\\s\\x{{00A0}}]+', ' ', 'g'))"

SQL = {
    "verdict_bands": f"WITH {_LOG} SELECT index_id, CASE WHEN top_score IS NULL OR top_score < 0.45 THEN 'refuse' WHEN top_score >= 0.7 THEN 'confident' ELSE 'uncertain' END AS verdict, count(*) AS n FROM l GROUP BY ALL",
    "calibrate_floors": f"WITH {_LOG}, g AS (SELECT index_id, coalesce(list_sort(list(top_score) FILTER (top_score > 0 AND NOT coalesce(answered, false))), []) AS neg, coalesce(list_sort(list(top_score) FILTER (top_score > 0 AND coalesce(answered, false))), []) AS pos FROM l GROUP BY 1), f AS (SELECT *, greatest(0.7, least(neg[CASE WHEN len(neg) >= 10 THEN len(neg) - 1 ELSE len(neg) END] + 0.08, 0.9)) AS floor, pos[least(len(pos) - 1, floor(len(pos) * 0.1)::INT) + 1] AS low FROM g), r AS (SELECT *, CASE WHEN len(pos) >= 5 AND floor > low THEN low ELSE floor END AS refuse FROM f) SELECT index_id, CASE WHEN len(neg) >= 5 THEN round(refuse, 3) ELSE 0.7 END AS refuse, CASE WHEN len(neg) >= 5 THEN round(least(refuse + 0.08, 0.98), 3) ELSE 0.8 END AS confident, len(neg) AS samples FROM r",
    "floor_sweep": f"WITH {_LOG}, c AS (SELECT top_score AS s, coalesce(answered, false) AS a FROM l WHERE top_score IS NOT NULL), f AS (SELECT unnest({FLOORS})::DOUBLE AS floor) SELECT floor, count(*) FILTER (NOT a AND s >= floor) AS false_answers, count(*) FILTER (a AND s < floor) AS missed_answers, count(*) FILTER (NOT a) AS negatives, count(*) FILTER (a) AS positives FROM c, f GROUP BY 1",
    "recommended_floor": f"WITH {_LOG}, c AS (SELECT top_score AS s, coalesce(answered, false) AS a FROM l WHERE top_score IS NOT NULL), f AS (SELECT unnest({FLOORS})::DOUBLE AS floor), w AS (SELECT floor, count(*) FILTER (NOT a AND s >= floor) AS x, count(*) FILTER (NOT a) AS n FROM c, f GROUP BY 1) SELECT min(floor) AS floor FROM w WHERE n = 0 OR x <= 0.03 * n",
    "scatter_sweep": f"WITH {_TURNS}, c AS (SELECT sources[1].relevance / 100 - sources[len(sources)].relevance / 100 AS spread, NOT refused AS one FROM t WHERE len(sources) >= 2), f AS (SELECT unnest({DELTAS})::DOUBLE AS delta) SELECT delta, count(*) FILTER (spread <= delta AND one) AS asked_needlessly, count(*) FILTER (spread > delta AND NOT one) AS not_asked FROM c, f GROUP BY 1",
    "pii_mask": f"WITH {_LOG} SELECT id, {_masked()} AS masked, {_masked(L.EGRESS)} AS egress FROM l WHERE query IS NOT NULL",
    "intents": f"WITH {_LOG}, x AS (SELECT id, query, {_PLAIN} AS p FROM l WHERE query IS NOT NULL), y AS (SELECT *, len(string_split(p, ' ')) <= 4 AND NOT contains(query, '?') AS small FROM x) SELECT id, CASE WHEN small AND p IN ({_list(L.GREETINGS)}) THEN 'greeting' WHEN small AND p IN ({_list(L.THANKS)}) THEN 'thanks' WHEN small AND p IN ({_list(L.FAREWELLS)}) THEN 'farewell' WHEN small AND p IN ({_list(L.ACKNOWLEDGEMENTS)}) THEN 'acknowledgement' ELSE 'question' END AS intent FROM y",
    "follow_up": f"WITH {_TURNS}, a AS (SELECT id, turn_no, question, lag(question) OVER (PARTITION BY id ORDER BY turn_no) AS before FROM t WHERE question IS NOT NULL), b AS (SELECT *, {TOK.format('question')} AS tk, regexp_replace(lower(question), '^[\\s\\x{{00A0}}]+|[\\s\\x{{00A0}}]+$', '', 'g') AS low, {_telling('before')} AS tel FROM a), c AS (SELECT *, before IS NOT NULL AND len(tk) > 0 AND (len(list_filter([{_list(L.FOLLOW_UP_OPENERS)}], lambda o: starts_with(low, o || ' '))) > 0 OR (len(tk) < 6 AND list_has_any(tk, [{_list(L.REFERENTIAL)}]))) AS leans, list_slice(list_filter(tel, lambda x: NOT list_contains(tk, x)), 1, 4) AS extra FROM b) SELECT id, turn_no, CASE WHEN leans AND len(extra) > 0 THEN question || ' ' || array_to_string(extra, ' ') ELSE question END AS search FROM c",
    "failed_queries": f"WITH {_LOG} SELECT index_id, count(*) AS n, round(sum(coalesce(top_score, 0)), 6) AS total_score FROM l WHERE {_FAILED} GROUP BY 1",
    "pick_priors": f"WITH {_LOG}, {_PRIORS} SELECT index_id, url, term, seen, picks, last_at FROM kn",
    "prior_boost": f"WITH {_LOG}, {_PRIORS}, a AS (SELECT id AS qid, index_id, {_telling('query')} AS tl FROM l WHERE id % 100 = 0 AND query IS NOT NULL), ax AS (SELECT qid, index_id, len(tl) AS n, unnest(tl) AS term FROM a), h AS (SELECT qid, url, n, last_at, sum(least(1.0, seen / 3)) AS e FROM ax JOIN kn USING (index_id, term) GROUP BY ALL) SELECT qid, url, round(1 + e / n * pow(2, -greatest(0, ({NOW} - last_at) / 86400000.0) / 30) * 0.12, 6) AS boost FROM h",
    "spend_rollup": "WITH r(model, a, b) AS (VALUES ('view', 1.0, 4.0), ('click', 2.0, 8.0), ('purchase', 0.5, 1.5)), u AS (SELECT ts::DATE AS day, event_type AS model, floor(coalesce(value, 0))::BIGINT AS p, event_id % 100 AS c, user_id % 7 = 0 AS est FROM events), x AS (SELECT u.*, (p * a + c * b)::DOUBLE / 1e6 AS cost FROM u LEFT JOIN r USING (model)) SELECT x.day::VARCHAR AS day, model, sum(p)::BIGINT AS prompt_tokens, sum(c)::BIGINT AS completion_tokens, count(*) AS calls, round(sum(cost) + 1e-9, 4) AS cost, coalesce(bool_or(est), false) AS estimated, bool_or(cost IS NULL) AS partial FROM x GROUP BY ROLLUP (x.day, model)",
    "cache_eviction": f"WITH {_LOG}, e AS (SELECT id, index_id, at_ms FROM l WHERE answered) SELECT * FROM e WHERE (SELECT max(at_ms) FROM e) - at_ms <= {30 * G.DAY} QUALIFY row_number() OVER (PARTITION BY index_id ORDER BY at_ms DESC, id) <= 50",
    "chat_sessions_latest": f"WITH {_TURNS} SELECT id, index_id, updated_at, len(turns) AS n_turns FROM s",
    "chat_sessions_kept": f"WITH {_TURNS} SELECT id, updated_at FROM s ORDER BY updated_at DESC, id LIMIT 50",
    "index_stats": "WITH c AS (SELECT DISTINCT ON (vector_id) * FROM chunks) SELECT index_id, count(DISTINCT url) AS pages, count(*) AS chunks, sum(coalesce(strlen(text), 0) + coalesce(strlen(body), 0) + coalesce(strlen(url), 0) + coalesce(strlen(heading_path), 0))::BIGINT AS text_bytes, count(*) * 384 * 4 AS vector_bytes FROM c GROUP BY 1",
    "index_freshness": f"SELECT index_id, floor(({NOW} - last_indexed_at) / {G.DAY})::BIGINT AS age_days, floor(({NOW} - last_indexed_at) / {G.DAY}) > 7 AS stale, coalesce({NOW} - last_indexed_at >= {30 * G.DAY}, false) AS due, coalesce(embedding_model <> 'bge-small-en-v1.5', true) AS rebuild FROM site_indexes",
    "probe_titles": "WITH o AS (SELECT DISTINCT index_id, title FROM chunks WHERE title IS NOT NULL), p AS (SELECT *, count(*) OVER (PARTITION BY index_id) AS n, row_number() OVER (PARTITION BY index_id ORDER BY title) - 1 AS k FROM o), s AS (SELECT *, greatest(1, n // 20) AS step FROM p) SELECT index_id, title FROM s WHERE k % step = 0 AND k // step < 20",
    "content_hashes": "WITH c AS (SELECT DISTINCT ON (vector_id) * FROM chunks) SELECT vector_id, lower(lpad(to_hex(list_reduce(list_concat([2166136261::BIGINT], flatten(list_transform(string_split(body, ''), lambda ch: CASE WHEN ch = '' THEN []::BIGINT[] WHEN unicode(ch) > 65535 THEN [55296 + ((unicode(ch) - 65536) >> 10), 56320 + ((unicode(ch) - 65536) & 1023)]::BIGINT[] ELSE [unicode(ch)]::BIGINT[] END))), lambda h, u: (xor(h, u) * 16777619) & 4294967295)), 8, '0')) AS hash, content_hash AS stored FROM c WHERE body IS NOT NULL",
    "content_hash_dupes": "WITH c AS (SELECT DISTINCT ON (vector_id) * FROM chunks WHERE body <> '') SELECT vector_id, kept FROM (SELECT vector_id, min(vector_id) OVER (PARTITION BY body) AS kept FROM c) WHERE vector_id <> kept",
    "failure_streaks": f"WITH {_LOG}, m AS (SELECT *, NOT coalesce(answered, false) AS bad, row_number() OVER (PARTITION BY index_id ORDER BY at_ms, id) AS k FROM l), i AS (SELECT *, k - row_number() OVER (PARTITION BY index_id ORDER BY at_ms, id) AS g FROM m WHERE bad) SELECT index_id, min(at_ms) AS start, count(*) AS length FROM i GROUP BY index_id, g",
    "outcome_counts": f"WITH {_LOG} SELECT index_id, count(*) FILTER (outcome = 'answered') AS answered, count(*) FILTER (outcome = 'refined') AS refined, count(*) FILTER (outcome = 'refused') AS refused FROM l GROUP BY 1",
    "log_dedupe": f"WITH {_LOG} SELECT index_id, count(*) AS n, min(at_ms) AS first, max(at_ms) AS last FROM l GROUP BY 1",
    "event_sessions": "WITH e AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS b FROM events), s AS (SELECT *, sum(b) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM e) SELECT user_id, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, k",
    "event_windows": "SELECT date_trunc('day', ts)::TIMESTAMP AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL",
    "refusals": f"WITH {_TURNS} SELECT index_id, tier, count(*) FILTER (refused) AS refused, count(*) AS turns, round(avg(refused::INT), 6) AS rate FROM t GROUP BY ALL",
}

_MATCH = "trim(regexp_replace(regexp_replace(replace(replace(replace(replace(lower({}), '‘', chr(39)), '’', chr(39)), '“', '\"'), '”', '\"'), '[*_`#>]', '', 'g'), '[\\s\\x{{00A0}}\\x{{FEFF}}\\x{{2000}}-\\x{{200A}}\\x{{202F}}\\x{{3000}}]+', ' ', 'g'))"
SQL["answer_coverage"] = f"WITH {_TURNS}, a AS (SELECT id, turn_no, {_MATCH.format('markdown')} AS hay, list_filter(list_transform(sources, lambda s: s.title), lambda x: x IS NOT NULL) AS titles FROM t WHERE markdown IS NOT NULL) SELECT id, turn_no, round(CASE WHEN len(titles) = 0 THEN 1 ELSE 1 - len(list_filter(titles, lambda p: {_MATCH.format('p')} = '' OR NOT contains(hay, {_MATCH.format('p')}))) / len(titles) END, 6) AS ratio FROM a"
_POLICIES = ", ".join(str((k, *map(str, r))) for k, *r in L.ERROR_POLICIES)
_has = lambda marks: "(" + " OR ".join(f"contains(lower(said), '{m}')" for m in marks) + ")"
SQL["error_kinds"] = (
    f"WITH c AS (SELECT unnest({STATUSES}) AS status), m AS (SELECT unnest([{_list(SAID)}]) AS said), b AS (SELECT status, said FROM c, m UNION ALL SELECT status, '' FROM (SELECT DISTINCT ON (fetch_id) * FROM pages_raw)), k AS (SELECT status, said, count(*) AS n, CASE status WHEN 401 THEN 'auth_invalid' WHEN 403 THEN 'auth_invalid' WHEN 402 THEN 'quota_exhausted' WHEN 404 THEN 'model_not_found' WHEN 408 THEN 'timeout' WHEN 504 THEN 'timeout'"
    f" WHEN 429 THEN if({_has(L.QUOTA_SAID)}, 'quota_exhausted', 'rate_limited') WHEN 400 THEN NULL WHEN 422 THEN NULL ELSE if(status >= 500, 'provider_down', if({_has(L.QUOTA_SAID)}, 'quota_exhausted', if({_has(L.MODEL_SAID)}, 'model_not_found', if({_has(L.FILTER_SAID)}, 'content_filtered', if({_has(L.CONTEXT_SAID)}, 'bad_request', if({_has(L.RATE_SAID)}, 'rate_limited', if({_has(L.DOWN_SAID)}, 'provider_down', 'unknown'))))))) END AS k1,"
    f" if({_has(L.MODEL_SAID)}, 'model_not_found', if({_has(L.FILTER_SAID)}, 'content_filtered', 'bad_request')) AS k2 FROM b GROUP BY ALL), e(kind, a, b, c, shown_as, d) AS (VALUES {_POLICIES}) SELECT coalesce(k1, k2) AS kind, status, said, n, a::BOOLEAN AS retryable, b::BOOLEAN AS terminal, c::BOOLEAN AS auto_retry, shown_as, d::BOOLEAN AS trips FROM k LEFT JOIN e ON e.kind = coalesce(k1, k2)"
)

# guards of a rewrite: what must be kept, in SQL
_EDGES = "^[\\s\\x{00A0}]+|[\\s\\x{00A0}]+$"
_SPLIT = "regexp_split_to_array({q}, '[\\s\\x{00A0}\\x{FEFF}\\x{2000}-\\x{200A}\\x{202F}\\x{3000}]+')"


def _kept(q: str) -> str:
    quoted = f"list_transform(regexp_extract_all({q}, '[\"''“”]([^\"''“”]{{2,60}})[\"''“”]', 1), lambda x: lower(trim(x)))"
    plain = f"list_filter(list_transform({_SPLIT.replace('{q}', q)}, lambda w: regexp_replace(w, '^[^A-Za-z0-9_-]+|[^A-Za-z0-9_-]+$', '', 'g')), lambda w: length(w) >= 2)"
    fixed = f"list_transform(list_filter({plain}, lambda w: regexp_matches(w, '^[A-Z]{{2,8}}$') OR regexp_matches(w, '[0-9]') OR regexp_matches(w, '^[A-Za-z0-9_]+[-.][A-Za-z0-9_.-]+$')), lambda w: lower(w))"
    return f"list_filter(list_concat({quoted}, {fixed}), lambda x: x <> '')"


_FIRST = "trim(coalesce(list_filter(string_split({r}, chr(10)), lambda x: trim(x) <> '')[1], ''))"


def _cleaned(r: str) -> str:
    return f"trim(regexp_replace(regexp_replace({_FIRST.replace('{r}', r)}, '(?i)^(query|search|rewritten|output)\\s*:\\s*', ''), '^[\"''“”]+|[\"''“”]+$', '', 'g'))"


def _reason(q: str, r: str) -> str:
    lost = f"list_filter({_kept(q)}, lambda t: NOT (contains(lower({r}), t) OR list_contains({TOK.format(r)}, t)))[1]"
    said = f"list_filter({TOK.format(q)}, lambda t: length(t) > 2)"
    return f"CASE WHEN {r} = '' THEN 'empty' WHEN length({r}) > 300 THEN 'too long' WHEN length({r}) > length({q}) * 3 THEN 'grown too much' WHEN {lost} IS NOT NULL THEN 'dropped: ' || {lost} WHEN len({said}) > 0 AND NOT list_has_any({said}, {TOK.format(r)}) THEN 'no word in common' END"


SQL["rewrite_guard"] = f"WITH {_LOG}, a AS (SELECT id, query, lead(query) OVER (PARTITION BY index_id ORDER BY at_ms, id) AS nx FROM l WHERE query IS NOT NULL), b AS (SELECT id, query, {_cleaned('nx')} AS rw FROM a WHERE nx IS NOT NULL) SELECT id, {_reason('query', 'rw')} AS reason FROM b"
SQL["query_plans"] = f"{SQL['follow_up'].rpartition(' SELECT id, turn_no')[0]}, z AS (SELECT c.id, c.turn_no, c.question, CASE WHEN leans AND len(extra) > 0 THEN c.question || ' ' || array_to_string(extra, ' ') ELSE c.question END AS search, t.markdown, {_cleaned('t.markdown')} AS rw FROM c JOIN t USING (id, turn_no)), y AS (SELECT *, markdown IS NOT NULL AND {_reason('question', 'rw')} IS NULL AS good FROM z) SELECT id, turn_no, CASE WHEN good THEN rw ELSE search END AS plan, CASE WHEN good THEN 'model' WHEN search <> question THEN 'followup' ELSE 'raw' END AS source FROM y"

QUERIES = {f.__name__: f for f in (verdict_bands, calibrate_floors, floor_sweep, recommended_floor, scatter_sweep, pii_mask, intents, follow_up, rewrite_guard, query_plans, failed_queries, gap_report, gap_csv, pick_priors, prior_boost, spend_rollup, cache_eviction, chat_sessions_latest, chat_sessions_kept, index_stats, index_freshness, probe_titles, content_hashes, content_hash_dupes, failure_streaks, outcome_counts, log_dedupe, event_sessions, event_windows, answer_coverage, refusals, error_kinds)}
