"""Queries of crawling, extraction, chunking, rendering and limits over the project's tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions import lexicon as L
from millrace.functions import text as X
from millrace.functions import urls as R
from millrace.operators import articles as A
from millrace.operators import chunker as K
from millrace.operators import crawl as C
from millrace.operators import extract as H
from millrace.operators import render as V
from millrace.plans import log_queries as Q
from millrace.plans import search_queries as S
from millrace.sources.tables import one_of_each, spread, table
from millrace.streaming import state as ST

INCLUDE, EXCLUDE = ["*/docs/*", "*/articles/*", "*/kb/*", "*/hc/*"], ["*/integrations/*", "*?utm_*"]


def pages(spark: SparkSession, d: str) -> DataFrame:
    return one_of_each(spread(table(spark, d, "pages_raw"), "fetch_id"), "fetch_id")


def canonical_urls(spark, d):
    return table(spark, d, "chunks").select("url").distinct().select("url", R.canonical_url(F.col("url")).alias("canonical"))


def scope_filter(spark, d):
    return table(spark, d, "chunks").select("url").distinct().filter(R.in_scope(F.col("url"), INCLUDE, EXCLUDE))


def unsafe_urls(spark, d):
    urls = pages(spark, d).select(F.explode(F.regexp_extract_all(F.coalesce("html", F.lit("")), F.lit(r'href="([^"]+)"'), F.lit(1))).alias("link")).select(F.concat(F.lit("https://site.example"), "link").alias("url")).distinct()
    return urls.select("url", R.acts(F.col("url")).alias("acts"), R.binary(F.col("url")).alias("binary"))


def noindex(spark, d):
    return pages(spark, d).select("fetch_id", C.noindex(F.col("html"), F.col("robots_tag")).alias("noindex"))


def crawl_outcomes(spark, d):
    """What becomes of every page with its own status, and with each other one that a server could have given."""
    each = pages(spark, d).withColumn("status", F.explode(F.array_distinct(F.array("status", *map(F.lit, _STATUSES)))))
    return C.outcome(each).select("fetch_id", "status", "wall", "failure", C.retryable(F.col("failure")).alias("again"), "outcome")


def latest_pages(spark, d):
    return C.latest_fetch(pages(spark, d)).select("page", "fetch_id", "status")


def incremental_diff(spark, d):
    """Every later fetch of a URL against the fetch before it."""
    return C.versions(pages(spark, d).withColumn("html_hash", F.md5("html")).select("fetch_id", "url", "etag", "lastmod", "html_hash", "fetched_at"))


def duplicate_pages(spark, d):
    return C.duplicates(pages(spark, d).withColumn("h", F.md5("html")), "h", "fetch_id")


def link_frontier(spark, d):
    p = pages(spark, d)
    edges = C.links(p)
    seeds = p.filter("status = 200").select(R.canonical_url(F.col("url")).alias("url")).filter("url is not null")
    return C.frontier(seeds, edges, [], ["*/jobs*"], 2)


def crawl_preview(spark, d):
    return C.preview(C.links(pages(spark, d)), [], ["*/jobs*"], 2000)


#: Files in which each rule of choosing a group and a rule decides: the first of two groups that fit the agent, the last of
#: two for "*", no group, a sitemap line among agents, equal lengths, lines without a colon.
ROBOTS = [
    ("help.sateko.test", "User-agent: example\nDisallow: /docs/ # first\nAllow: /docs/reporting/\nnonsense\nCrawl-delay: 2\n\nUser-agent: examplebot\nDisallow: /\n\nUser-agent: *\nDisallow: /\n"),
    ("docs.yarnix.test", "User-agent: *\nDisallow: /kb/\n\nUser-agent: *\nDisallow: /hc/\nCrawl-delay: 3.5\n"),
    ("docs.ulvane.test", "User-agent: otherbot\nDisallow: /\n"),
    ("support.pentra.example", "Disallow: /\nUser-agent: otherbot\nSitemap: https://support.pentra.example/map.xml\nUser-agent: *\nDisallow: /hc/\nAllow: /hc\nDisallow: /articles/\nAllow: /articles/\nDisallow:\n"),
]


def robots_allowed(spark, d):
    files = spark.createDataFrame(ROBOTS, "host string, text string")
    urls = table(spark, d, "chunks").select("url").distinct().withColumn("host", R.host(F.col("url")))
    return C.allowed(urls, C.robots_rules(files), "ExampleBot/1.0").select("url", "allowed", "delay")


def paced_fetches(spark, d):
    p = pages(spark, d).select("fetch_id", R.host(F.col("url")).alias("host"), "fetched_at")
    return C.paced(p, "host", "fetched_at", 2000, "fetch_id").select("fetch_id", "start_ms")


def html_blocks(spark, d):
    found = H.pages(pages(spark, d), "fetch_id", "html")
    return found.select("fetch_id", "title", "platform", F.posexplode("blocks").alias("block_no", "b")).select("fetch_id", "title", "platform", "block_no", "b.*")


def chunk_pages(spark, d):
    return K.chunks(H.pages(pages(spark, d), "fetch_id", "html"), "fetch_id")


def render_needed(spark, d):
    found = H.pages(pages(spark, d).filter("status = 200"), "fetch_id", "html")
    words = F.size(F.filter(F.split(F.array_join(F.transform("blocks", lambda b: b["text"]), " "), r"\s+"), lambda w: w != ""))
    return found.select("fetch_id", words.alias("words")).withColumn("render", F.col("words") < 50)


def markdown_render(spark, d):
    t = Q.turns(spark, d).filter("markdown is not null")
    return t.select("id", "turn_no", V.rendered(F.col("markdown"), F.coalesce(F.size("sources"), F.lit(0))).alias("html")).withColumn("plain", V.plain(F.col("html")))


def starters(spark, d):
    return V.starters(S.chunks(spark, d))


def title_questions(spark, d):
    return S.chunks(spark, d).filter("title is not null").select("title").distinct().select("title", V.question(F.col("title")).alias("question"))


def source_cards(spark, d):
    """The source cards of all logged questions."""
    c = S.chunks(spark, d)
    ranked = S._ranked_chunks(spark, d, S.logged)
    heads = A.article_order(ranked.join(c.select("vector_id", "title", "heading_path", "body"), "vector_id"))
    one = heads.groupBy("qid", "article", "url").agg(F.min_by("title", "rank").alias("title"), F.min_by("heading_path", "rank").alias("heading_path"), F.min_by("body", "rank").alias("first_body"))
    return V.source_cards(one.join(S._articles(spark, d, ranked), ["qid", "article", "url"]).withColumn("similarity", F.lit(None).cast("double")))


def chunk_sizes(spark, d):
    return S.chunks(spark, d).select("vector_id", X.chunk_tokens(F.col("body")).alias("tokens"), X.billing_tokens(F.col("body")).alias("billed"))


def seed_urls(spark, d):
    """Crawl seeds of hosts with a sitemap of their own, with one in robots.txt that is an index, and with the usual one."""
    roots = spark.createDataFrame([("https://support.pentra.example/", "support.pentra.example", None), ("https://docs.yarnix.test/hc/", "docs.yarnix.test", None), ("https://help.sateko.test/", "help.sateko.test", "https://help.sateko.test/own.xml")], "root string, host string, sitemap string")
    chunks = table(spark, d, "chunks").select("url").distinct().filter("url is not null")
    listing = lambda kind, tag: F.concat(F.lit(f"<{kind}>"), F.array_join(F.transform(F.array_sort(F.collect_set("url")), lambda u: F.concat(F.lit(f"<{tag}><loc> "), F.replace(u, F.lit("&"), F.lit("&amp;")), F.lit(f" </loc></{tag}>"))), ""), F.lit(f"</{kind}>"))
    host = R.host(F.col("url"))
    maps = chunks.filter(host == "support.pentra.example").agg(F.lit("https://support.pentra.example/1.xml").alias("source"), listing("urlset", "url").alias("xml"))
    maps = maps.unionByName(chunks.filter(host == "docs.yarnix.test").agg(F.lit("https://docs.yarnix.test/sitemap.xml").alias("source"), listing("urlset", "url").alias("xml")))
    maps = maps.unionByName(spark.createDataFrame([("https://support.pentra.example/map.xml", "<sitemapindex><sitemap><loc>https://support.pentra.example/1.xml</loc></sitemap></sitemapindex>"), ("https://help.sateko.test/own.xml", "<urlset></urlset>")], "source string, xml string"))
    return C.seeds(C.robots_rules(spark.createDataFrame(ROBOTS, "host string, text string")), maps, roots)


def limiter_state(spark, d):
    e = table(spark, d, "events").select("event_type", F.unix_millis(F.col("ts").cast("timestamp")).alias("at_ms"))
    return ST.limited(e, "event_type", "at_ms").groupBy("key", "accepted").agg(F.count("*").alias("n"))


def breaker_state(spark, d):
    e = table(spark, d, "events").select("user_id", F.unix_millis(F.col("ts").cast("timestamp")).alias("at_ms"), (F.col("event_type") == "error").alias("failed"))
    return ST.broken(e, "user_id", "at_ms", "failed").groupBy("key", "state").agg(F.count("*").alias("n"))


_P = "p AS (SELECT DISTINCT ON (fetch_id) * FROM pages_raw)"
_RE = lambda g: R.glob(g).replace("'", "''")
_META = "len(list_filter(regexp_extract_all(coalesce(html, ''), '(?i)<meta\\b[^>]*>'), lambda t: regexp_matches(t, '(?i)\\bname\\s*=\\s*[\"'']?(robots|googlebot)\\b') AND regexp_matches(regexp_extract(t, '(?i)\\bcontent\\s*=\\s*[\"'']([^\"'']*)[\"'']', 1), '(?i)(^|[\\s,])(noindex|none)([\\s,]|$)'))) > 0"

SQL = {
    "scope_filter": f"SELECT DISTINCT url FROM chunks WHERE ({' OR '.join(f'regexp_matches(url, {chr(39)}{_RE(g)}{chr(39)})' for g in INCLUDE)}) AND NOT ({' OR '.join(f'regexp_matches(url, {chr(39)}{_RE(g)}{chr(39)})' for g in EXCLUDE)})",
    "noindex": f"WITH {_P} SELECT fetch_id, coalesce(regexp_matches(robots_tag, '(?i)(^|[\\s,])(noindex|none)([\\s,]|$)'), false) OR {_META} AS noindex FROM p",
    "duplicate_pages": f"WITH {_P} SELECT fetch_id, kept FROM (SELECT fetch_id, min(fetch_id) OVER (PARTITION BY md5(html)) AS kept FROM p WHERE html IS NOT NULL) WHERE fetch_id <> kept",
    "incremental_diff": f"WITH {_P}, v AS (SELECT *, md5(html) AS h, row_number() OVER (PARTITION BY url ORDER BY fetched_at, fetch_id) AS n FROM p) SELECT b.url, b.fetch_id, CASE WHEN a.etag IS NOT NULL AND b.etag IS NOT NULL THEN a.etag <> b.etag WHEN a.lastmod IS NOT NULL AND b.lastmod IS NOT NULL THEN a.lastmod <> b.lastmod ELSE a.h IS DISTINCT FROM b.h END AS reindex FROM v b JOIN v a ON a.url = b.url AND a.n = b.n - 1",
    "paced_fetches": f"WITH {_P}, x AS (SELECT fetch_id, lower(regexp_extract(url, '^[a-zA-Z]+://([^/?#:]*)', 1)) AS host, fetched_at FROM p), k AS (SELECT *, row_number() OVER (PARTITION BY host ORDER BY fetched_at, fetch_id) - 1 AS k FROM x) SELECT fetch_id, max(fetched_at - k * 2000) OVER (PARTITION BY host ORDER BY fetched_at, fetch_id) + k * 2000 AS start_ms FROM k",
    "chunk_sizes": "WITH c AS (SELECT DISTINCT ON (vector_id) * FROM chunks), s AS (SELECT vector_id, body, trim(regexp_replace(coalesce(body, ''), '[\\s\\x{00A0}\\x{FEFF}\\x{2000}-\\x{200A}\\x{202F}\\x{3000}\\x{000B}\\x{0085}\\x{2028}\\x{2029}]+', ' ', 'g')) AS t FROM c) SELECT vector_id, CASE WHEN t = '' THEN 0 ELSE greatest(ceil(len(string_split(t, ' ')) / 0.75), ceil(length(t) / 6)) END::BIGINT AS tokens, ceil(length(body) / 4)::BIGINT AS billed FROM s",
}

_SEGMENTS = "list_transform(list_filter(string_split(regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1), '/'), lambda x: x <> ''), lambda x: regexp_replace(lower(x), '[\\s_-]+', '', 'g'))"
_in = lambda v: "[" + ", ".join(f"'{x}'" for x in v) + "]"
SQL["unsafe_urls"] = f"WITH {_P}, u AS (SELECT DISTINCT 'https://site.example' || unnest(regexp_extract_all(coalesce(html, ''), 'href=\"([^\"]+)\"', 1)) AS url FROM p), s AS (SELECT url, {_SEGMENTS} AS seg, regexp_extract(url, '\\?([^#]*)', 1) AS par, regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1) AS path FROM u) SELECT url, list_has_any(seg, {_in(L.ACTING_SEGMENTS)}) OR list_has_any(list_transform(range(1, len(seg)), lambda i: seg[i] || seg[i + 1]), {_in(L.ACTING_PAIRS)}) OR len(list_filter(string_split(par, '&'), lambda x: lower(string_split(x, '=')[1]) IN ('action', 'do', 'cmd', 'op', 'method') AND list_contains({_in(L.ACTIONS)}, regexp_replace(lower(string_split(x, '=')[-1]), '[\\s_-]+', '', 'g')))) > 0 AS acts, regexp_matches(url, '{L.BINARY}') OR regexp_matches(path, '{L.ATTACHMENT}') AS \"binary\" FROM s"
# the groups that hold, picked by hand: (host, delay), and their rules
SQL["robots_allowed"] = (
    "WITH u AS (SELECT DISTINCT url, lower(regexp_extract(url, '^[a-zA-Z]+://([^/?#:]*)', 1)) AS host, regexp_extract(url, '^[a-zA-Z]+://[^/?#]*([^#]*)', 1) AS path FROM chunks), g(host, delay) AS (VALUES ('help.sateko.test', 2.0::DOUBLE), ('docs.yarnix.test', 3.5), ('support.pentra.example', NULL)),"
    " r(host, allow, rule) AS (VALUES ('help.sateko.test', false, '/docs/'), ('help.sateko.test', true, '/docs/reporting/'), ('docs.yarnix.test', false, '/hc/'), ('support.pentra.example', false, '/hc/'), ('support.pentra.example', true, '/hc'), ('support.pentra.example', false, '/articles/'), ('support.pentra.example', true, '/articles/'))"
    " SELECT url, coalesce(max_by(allow, length(rule) * 2 + allow::INT), true) AS allowed, any_value(delay) AS delay FROM u LEFT JOIN g USING (host) LEFT JOIN r ON r.host = u.host AND starts_with(path, rule) GROUP BY url"
)
SQL["seed_urls"] = "SELECT DISTINCT CASE WHEN h = 'docs.yarnix.test' THEN 'https://docs.yarnix.test/hc/' ELSE 'https://support.pentra.example/' END AS root, url FROM (SELECT url, lower(regexp_extract(url, '^[a-zA-Z]+://([^/?#:]*)', 1)) AS h FROM chunks) WHERE h IN ('docs.yarnix.test', 'support.pentra.example')"

_URL = "'^([a-zA-Z][a-zA-Z0-9+.-]*)://(?:[^/?#@]*@)?([^/?#:\\s]+)(?::([0-9]*))?((?:/[^?#]*)?)(?:\\?([^#]*))?(?:#.*)?$'"


def _canonical(url: str) -> str:
    """The canonical form in SQL, of URLs whose paths and parameters need no encoding."""
    part = lambda k: f"regexp_extract({url}, {_URL}, {k})"
    scheme, port = f"lower({part(1)})", part(3)
    kept = f"list_transform(list_sort(list_transform(list_filter(string_split({part(5)}, '&'), lambda x: x <> '' AND NOT (lower(split_part(x, '=', 1)) IN ({', '.join(repr(t) for t in L.TRACKING)}) OR starts_with(lower(x), 'utm_'))), lambda x: [split_part(x, '=', 1), x])), lambda x: x[2])"
    return f"CASE WHEN {scheme} IN ('http', 'https') THEN {scheme} || '://' || lower({part(2)}) || CASE WHEN {port} = '' OR ({scheme} = 'http' AND {port} = '80') OR ({scheme} = 'https' AND {port} = '443') THEN '' ELSE ':' || {port} END || CASE WHEN {part(4)} = '' THEN '/' ELSE {part(4)} END || CASE WHEN len({kept}) > 0 THEN '?' || array_to_string({kept}, '&') ELSE '' END END"


SQL["canonical_urls"] = f"SELECT DISTINCT url, {_canonical('url')} AS canonical FROM chunks"
SQL["latest_pages"] = f"WITH {_P}, n AS (SELECT *, {_canonical('url')} AS page FROM p) SELECT page, fetch_id, status FROM n WHERE page IS NOT NULL QUALIFY row_number() OVER (PARTITION BY page ORDER BY fetched_at DESC, fetch_id DESC) = 1"
# pages link by paths from the root only, so a link is the origin of its page and the path
_EDGES = f"raw AS (SELECT {_canonical('url')} AS page, {_canonical('final_url')} AS base, unnest(regexp_extract_all(coalesce(html, ''), '(?is)<a\\s[^>]*?href\\s*=\\s*[\"'']?([^\"''\\s>]+)', 1)) AS href FROM p), ed AS (SELECT DISTINCT page, {_canonical('whole')} AS link FROM (SELECT page, regexp_extract(base, '^([a-z]+://[^/?#]+)', 1) || href AS whole FROM raw))"
_BAD = f"regexp_matches(link, '{_RE('*/jobs*')}')"
_ACTS = f"(list_has_any({_SEGMENTS.replace('url', 'link')}, {_in(L.ACTING_SEGMENTS)}) OR regexp_matches(link, '{L.BINARY}') OR regexp_matches(link, '{L.ATTACHMENT}'))"
SQL["crawl_preview"] = f"WITH {_P}, {_EDGES}, l AS (SELECT DISTINCT link FROM ed) SELECT count(*) AS found, count(*) FILTER ({_BAD}) AS out_of_scope, count(*) FILTER (NOT {_BAD} AND {_ACTS}) AS unsafe, least(2000, count(*) FILTER (NOT {_BAD} AND NOT {_ACTS})) AS kept FROM l"
SQL["link_frontier"] = f"WITH {_P}, {_EDGES}, fit AS (SELECT * FROM ed WHERE NOT {_BAD} AND NOT {_ACTS}), s AS (SELECT DISTINCT {_canonical('url')} AS url FROM p WHERE status = 200), a AS (SELECT DISTINCT link AS url FROM fit JOIN s ON page = s.url), b AS (SELECT DISTINCT link AS url FROM fit JOIN a ON page = a.url) SELECT url, min(depth) AS depth FROM (SELECT url, 0 AS depth FROM s WHERE url IS NOT NULL UNION ALL SELECT url, 1 FROM a UNION ALL SELECT url, 2 FROM b) GROUP BY url"
_GOES = "[\"''][^\"'']*(?:login|signin|sign-in|sso)[^\"'']*[\"'']"
_SHELL = (
    f"(length(html) <= 20000 AND (regexp_matches(html, '(?i)(?:window\\.)?location(?:\\.href)?\\s*=\\s*{_GOES}') OR regexp_matches(html, '(?i)location\\.(?:replace|assign)\\s*\\(\\s*{_GOES}') OR regexp_matches(html, '(?i)<meta[^>]+http-equiv\\s*=\\s*[\"'']?refresh[\"'']?[^>]+content\\s*=\\s*[\"''][^\"'']*(?:login|signin|sso)[^\"'']*[\"'']')"
    " OR (regexp_matches(html, '(?i)location\\.href\\s*=\\s*\\w+\\s*;') AND regexp_matches(html, '(?i)[\"''][^\"'']*/login[^\"'']*[\"'']')) OR (length(html) < 6000 AND regexp_matches(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '(?i)\\b(sign[\\s-]?in|log[\\s-]?in)\\b'))))"
)
_WALL = f"CASE WHEN status = 401 THEN 'basic' WHEN status = 403 OR (final_url <> url AND regexp_matches(final_url, '(?i)/(login|signin|sign-in|sso|auth|account/login|session/new)(/|$|\\?)')) THEN 'session' WHEN status BETWEEN 200 AND 299 AND {_SHELL} THEN 'session' END"
_WHY = "CASE WHEN (status BETWEEN 200 AND 299 AND html IS NOT NULL) OR status = 304 THEN NULL WHEN status = 0 THEN 'network' WHEN status IN (404, 410) THEN 'missing' WHEN status IN (401, 403) THEN 'forbidden' WHEN status IN (408, 429) THEN 'throttled' WHEN status >= 500 THEN 'server' ELSE 'other' END"
# every page again under each other status, so that all statuses meet all kinds of pages
_STATUSES = (0, 204, 301, 304, 400, 401, 402, 403, 404, 405, 408, 410, 429, 451, 500, 503)
SQL["crawl_outcomes"] = f"WITH {_P}, x AS (SELECT fetch_id, url, final_url, html, robots_tag, unnest([status, {', '.join(map(str, _STATUSES))}]) AS status FROM p), o AS (SELECT fetch_id, status, {_WALL} AS wall, {_WHY} AS failure, coalesce(regexp_matches(robots_tag, '(?i)(^|[\\s,])(noindex|none)([\\s,]|$)'), false) OR {_META} AS no FROM x) SELECT DISTINCT fetch_id, status, wall, failure, coalesce(failure IN ('network', 'server', 'throttled', 'indexing'), false) AS again, CASE WHEN status = 304 THEN 'unchanged' WHEN wall IS NOT NULL THEN 'auth' WHEN failure IS NOT NULL THEN 'failed' WHEN no THEN 'skipped' ELSE 'indexed' END AS outcome FROM o"

# a title's question by its shape: a question, a task by its first word in one of its forms, a short name
_VERBS = "[" + ", ".join(f"'{v}'" for v in L.TASK_VERBS) + "]"
_NOISY = " OR ".join(f"regexp_matches(x, '{L.duck(p)}')".replace("what'?s", "what''?s") for p in (L.NOISE_TITLES, L.MONTH_TITLES))
SQL["title_questions"] = (
    "WITH o AS (SELECT DISTINCT title FROM chunks WHERE title IS NOT NULL AND vector_id IS NOT NULL), s AS (SELECT title, trim(regexp_replace(regexp_replace(regexp_replace(title, '\\s*\\[[^\\]]*\\]\\s*$', ''), '\\s*\\([^)]*\\)\\s*$', ''), '[\\s\\x{00A0}\\x{FEFF}\\x{2000}-\\x{200A}\\x{202F}\\x{3000}]+', ' ', 'g')) AS x FROM o),"
    " w AS (SELECT *, lower(split_part(x, ' ', 1)) AS f, x[length(split_part(x, ' ', 1)) + 1:] AS rest FROM s), g AS (SELECT *, CASE WHEN suffix(f, 'ing') AND length(f) >= 5 THEN [f[:-4], regexp_replace(f[:-4], '(bb|cc|dd|ff|gg|kk|ll|mm|nn|pp|rr|ss|tt|zz)$', ''), f[:-4] || 'e'] ELSE [] END AS forms FROM w),"
    f" h AS (SELECT *, CASE WHEN len(forms) > 0 AND regexp_matches(f[:-4], '(bb|cc|dd|ff|gg|kk|ll|mm|nn|pp|rr|ss|tt|zz)$') THEN f[:-5] END AS half FROM g), v AS (SELECT *, list_filter(list_concat([f], [forms[1], half, forms[3]]), lambda y: list_contains({_VERBS}, y))[1] AS verb FROM h)"
    f" SELECT title, CASE WHEN length(x) < 6 OR length(x) > 70 OR {_NOISY} THEN NULL WHEN suffix(x, '?') THEN x WHEN verb IS NOT NULL THEN 'How do I ' || verb || rest || '?' WHEN len(string_split(x, ' ')) <= 5 THEN 'What is ' || x || '?' END AS question FROM v"
)

QUERIES = {f.__name__: f for f in (canonical_urls, scope_filter, unsafe_urls, noindex, crawl_outcomes, latest_pages, incremental_diff, duplicate_pages, link_frontier, crawl_preview, robots_allowed, seed_urls, paced_fetches, html_blocks, chunk_pages, render_needed, markdown_render, starters, title_questions, source_cards, chunk_sizes, limiter_state, breaker_state)}
