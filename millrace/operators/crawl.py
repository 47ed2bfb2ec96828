"""Crawl control as set operations: what may be fetched, what has changed, what comes next, and when."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions import urls as R
from millrace.session import cut

# Fixed value: how a page says that it wants to be left out of an index.
NOINDEX = r"(?i)(^|[\s,])(noindex|none)([\s,]|$)"
# Signs of a page that only leads to a sign-in.
LOGIN_PATH = r"(?i)/(login|signin|sign-in|sso|auth|account/login|session/new)(/|$|\?)"
_GO = r"[\"'][^\"']*(?:login|signin|sign-in|sso)[^\"']*[\"']"
LOGIN_SHELL = [rf"(?i)(?:window\.)?location(?:\.href)?\s*=\s*{_GO}", rf"(?i)location\.(?:replace|assign)\s*\(\s*{_GO}", r"(?i)<meta[^>]+http-equiv\s*=\s*[\"']?refresh[\"']?[^>]+content\s*=\s*[\"'][^\"']*(?:login|signin|sso)[^\"']*[\"']"]
SHELL_CHARS, TITLE_CHARS = 20_000, 6_000


def noindex(html: Column, header: Column) -> Column:
    tags = F.regexp_extract_all(F.coalesce(html, F.lit("")), F.lit(r"(?i)<meta(?![A-Za-z0-9_])[^>]*>"), F.lit(0))
    out = F.exists(tags, lambda t: t.rlike(r"(?i)(?<![A-Za-z0-9_])name\s*=\s*[\"']?(robots|googlebot)(?![\w-])") & F.regexp_extract(t, r"(?i)(?<![A-Za-z0-9_])content\s*=\s*[\"']([^\"']*)[\"']", 1).rlike(NOINDEX))
    return F.coalesce(header.rlike(NOINDEX), F.lit(False)) | out


def login_shell(html: Column) -> Column:
    """Whether a page is small and sends to a sign-in, or is tiny and titled as one."""
    title = F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1)
    small = F.length(html) <= SHELL_CHARS
    goes = F.greatest(*(html.rlike(p) for p in LOGIN_SHELL)) | (html.rlike(r"(?i)location\.href\s*=\s*\w+\s*;") & html.rlike(r"(?i)[\"'][^\"']*/login[^\"']*[\"']"))
    return F.coalesce(small & (goes | ((F.length(html) < TITLE_CHARS) & title.rlike(r"(?i)(?<![A-Za-z0-9_])(sign[\s-]?in|log[\s-]?in)(?![A-Za-z0-9_])"))), F.lit(False))


def wall(status: Column, url: Column, final: Column, html: Column) -> Column:
    """basic, session or null: what kind of sign-in bars a page."""
    return F.when(status == 401, "basic").when((status == 403) | ((final != url) & final.rlike(LOGIN_PATH)), "session").when(status.between(200, 299) & login_shell(html), "session")


def failure(status: Column, html: Column) -> Column:
    """Why a fetch failed: network, server, throttled, missing, forbidden or other; null if it didn't.

    An answer of 2xx without a text failed too (other). "indexing" stands for a page that was fetched but couldn't be
    read; extraction reports it, no status does.
    """
    fine = (status.between(200, 299) & html.isNotNull()) | (status == 304)
    why = F.when(status == 0, "network").when(status.isin(404, 410), "missing").when(status.isin(401, 403), "forbidden").when(status.isin(408, 429), "throttled").when(status >= 500, "server").otherwise("other")
    return F.when(~fine, why)


def retryable(reason: Column) -> Column:
    """Whether a failure is worth another attempt once the queue is empty."""
    return F.coalesce(reason.isin("network", "server", "throttled", "indexing"), F.lit(False))


def transient(status: Column) -> Column:
    return status.isin(429, 503)


def infrastructure(status: Column) -> Column:
    return status.isin(0, 408, 429) | (status >= 500)


def outcome(pages: DataFrame) -> DataFrame:
    """pages (…, url, final_url, status, html, robots_tag) with wall, failure and what becomes of each."""
    marked = pages.withColumns({"wall": wall(F.col("status"), F.col("url"), F.col("final_url"), F.col("html")), "failure": failure(F.col("status"), F.col("html")), "noindex": noindex(F.col("html"), F.col("robots_tag"))})
    return marked.withColumn("outcome", F.when(F.col("status") == 304, "unchanged").when(F.col("wall").isNotNull(), "auth").when(F.col("failure").isNotNull(), "failed").when(F.col("noindex"), "skipped").otherwise("indexed"))


def latest_fetch(pages: DataFrame) -> DataFrame:
    """One row for each canonical URL, the last fetched, with version columns for comparing."""
    named = pages.withColumn("page", R.canonical_url(F.col("url")))
    w = Window.partitionBy("page").orderBy(F.desc("fetched_at"), F.desc("fetch_id"))
    return named.filter("page is not null").withColumn("n", F.row_number().over(w)).filter("n = 1").drop("n")


def changed(old: DataFrame, new: DataFrame, on: str | list[str], keep: tuple[str, ...] = ()) -> DataFrame:
    """(on, keep, reindex): new rows against stored ones by etag where both have it, else by lastmod, else by hash."""
    keys = [on] if isinstance(on, str) else on
    o = old.select(*keys, F.col("etag").alias("e0"), F.col("lastmod").alias("l0"), F.col("html_hash").alias("h0"), F.lit(True).alias("known"))
    test = F.when(F.col("known").isNull(), True).when(F.col("e0").isNotNull() & F.col("etag").isNotNull(), F.col("e0") != F.col("etag")).when(F.col("l0").isNotNull() & F.col("lastmod").isNotNull(), F.col("l0") != F.col("lastmod")).otherwise(~F.col("h0").eqNullSafe(F.col("html_hash")))
    return new.join(o, keys, "left").select(*keys, *keep, test.alias("reindex"))


def versions(pages: DataFrame) -> DataFrame:
    """(url, fetch_id, reindex): each later fetch of a URL against the one before it, in order of time; html_hash tells texts apart."""
    numbered = pages.withColumn("n", F.row_number().over(Window.partitionBy("url").orderBy("fetched_at", "fetch_id")))
    return changed(numbered.withColumn("n", F.col("n") + 1), numbered.filter("n > 1"), ["url", "n"], ("fetch_id",)).drop("n")


def duplicates(pages: DataFrame, by: str, key: str) -> DataFrame:
    """(key, kept): pages that repeat another one's content, and the smallest key that stands for them.

    Contents are grouped by a hash of 256 bits, so texts aren't shuffled.
    """
    hashed = pages.filter(F.col(by).isNotNull()).select(key, F.sha2(F.col(by).cast("string"), 256).alias("__h"))
    least = hashed.groupBy("__h").agg(F.min(key).alias("kept"), F.count("*").alias("n")).filter("n > 1")
    return hashed.join(least, "__h").filter(F.col(key) != F.col("kept")).select(key, "kept")


def links(pages: DataFrame) -> DataFrame:
    """(page, link): canonical links of each page, resolved against it."""
    hrefs = F.regexp_extract_all(F.coalesce("html", F.lit("")), F.lit(r"""(?is)<a\s[^>]*?href\s*=\s*["']?([^"'\s>]+)"""), F.lit(1))
    named = pages.withColumn("page", R.canonical_url(F.col("url")))
    # resolved before they are exploded, so that filters on a link don't repeat its computation
    full = F.filter(F.array_distinct(F.transform(hrefs, lambda h: R.resolved_url(h, F.coalesce("final_url", "url")))), lambda x: x.isNotNull())
    return named.select("page", F.explode(full).alias("link")).distinct()


def frontier(seeds: DataFrame, edges: DataFrame, include: list[str], exclude: list[str], depth: int = 3) -> DataFrame:
    """(url, depth): what a crawl from seeds (url) reaches over edges (page, link) within scope, with the least depth.

    Each round is a join and an anti-join against what is known, written to the shared folder; no row reaches the driver.
    """
    fit = edges.filter(R.in_scope(F.col("link"), include, exclude) & ~R.acts(F.col("link")) & ~R.binary(F.col("link")))
    seen = cut(seeds.select("url").distinct().withColumn("depth", F.lit(0)))
    last = seen
    for d in range(1, depth + 1):
        new = last.join(fit, last["url"] == fit["page"]).select(F.col("link").alias("url")).distinct().join(seen.select("url"), "url", "left_anti")
        last = cut(new.withColumn("depth", F.lit(d)))
        if not last.head(1):
            break
        seen = seen.unionByName(last)
    return seen


def robots_rules(files: DataFrame) -> DataFrame:
    """(host, grp, agents, rules, delay, sitemaps) of robots.txt files (host, text): one row for each group, in order.

    Agents named one after another share a group. Row 0 of a host stands for the file itself, with its sitemaps and
    without agents. A file is read line by line in its task; hosts never meet.
    """
    rule = pa.list_(pa.struct([("allow", pa.bool_()), ("path", pa.string())]))
    kinds = (pa.string(), pa.int32(), pa.list_(pa.string()), rule, pa.float64(), pa.list_(pa.string()))
    names = ["host", "grp", "agents", "rules", "delay", "sitemaps"]

    def groups_of(host: str, text: str | None) -> list[list]:
        own = [[host, 0, [], [], None, []]]
        naming = False
        pairs = (line.split("#")[0].partition(":") for line in (text or "").splitlines())
        for name, value in ((n.strip().lower(), v.strip()) for n, colon, v in pairs if colon):
            if name == "sitemap":
                own[0][5].append(value)
            elif name == "user-agent":
                if not naming:
                    own.append([host, len(own), [], [], None, None])
                own[-1][2].append(value.lower())
                naming = True
            elif name not in ("allow", "disallow", "crawl-delay"):
                naming = False
            elif len(own) > 1:
                naming = False
                if name == "crawl-delay":
                    number = re.fullmatch(r"[+]?(\d+\.?\d*|\.\d+)(e[+-]?\d+)?|", value, re.I)
                    own[-1][4] = float(value or 0) if number else own[-1][4]
                elif value or name == "allow":
                    own[-1][3].append({"allow": name == "allow", "path": value})
        return own

    def run(batches):
        for batch in batches:
            rows = [r for host, text in zip(*(c.to_pylist() for c in batch.columns)) for r in groups_of(host, text)]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names)

    return files.select("host", "text").mapInArrow(run, "host string, grp int, agents array<string>, rules array<struct<allow:boolean,path:string>>, delay double, sitemaps array<string>")


def robots_group(rules: DataFrame, agent: str) -> DataFrame:
    """(host, rules, delay): the group that holds for an agent: the first that names a part of it, else the last for "*"."""
    name = F.lit(agent.lower())
    named = F.exists("agents", lambda a: (a != "*") & F.contains(name, a))
    order = F.when(named, F.col("grp")).when(F.array_contains("agents", "*"), F.lit(1 << 30) - F.col("grp"))
    return rules.withColumn("o", order).filter("o is not null").groupBy("host").agg(F.min_by(F.struct("rules", "delay"), "o").alias("g")).select("host", "g.rules", "g.delay")


def robots_sitemaps(rules: DataFrame) -> DataFrame:
    """(host, loc): the sitemaps that files name."""
    return rules.filter("grp = 0").select("host", F.explode("sitemaps").alias("loc"))


def allowed(pages: DataFrame, rules: DataFrame, agent: str) -> DataFrame:
    """pages (url, host) with allowed and delay: by the longest rule of the agent's group that path and query begin with; a tie allows.

    Groups meet pages by host in one equi-join, and a page's rules are weighed within its row.
    """
    whole = F.concat(F.when(R.path(F.col("url")) == "", "/").otherwise(R.path(F.col("url"))), F.when(R.query(F.col("url")) != "", F.concat(F.lit("?"), R.query(F.col("url")))).otherwise(F.lit("")))
    met = pages.withColumn("__p", whole).join(robots_group(rules, agent), "host", "left")
    best = F.array_max(F.transform(F.filter("rules", lambda r: F.startswith(F.col("__p"), r["path"])), lambda r: F.named_struct(F.lit("n"), F.length(r["path"]), F.lit("a"), r["allow"])))
    return met.withColumn("allowed", F.coalesce(best["a"], F.lit(True))).drop("__p", "rules")


def seeds(rules: DataFrame, maps: DataFrame, roots: DataFrame) -> DataFrame:
    """(root, url): where crawls of roots (root, host, sitemap) begin: the entries of the given sitemap, else of those that
    the host's robots file names, else of /sitemap.xml; indexes are followed one level. maps has (source, xml)."""
    named = robots_sitemaps(rules).groupBy("host").agg(F.collect_set("loc").alias("named"))
    usual = F.array(F.concat(F.regexp_extract("root", "^([a-zA-Z]+://[^/?#]+)", 1), F.lit("/sitemap.xml")))
    own = F.when(F.col("sitemap").isNotNull(), F.array("sitemap")).otherwise(F.coalesce(F.when(F.size("named") > 0, F.col("named")), usual))
    first = roots.join(named, "host", "left").select("root", F.explode(own).alias("source"))
    read = sitemap(maps)
    top = first.join(read, "source")
    below = top.filter("is_index").select("root", F.col("loc").alias("source")).distinct().join(read.filter("not is_index"), "source")
    return top.filter("not is_index").select("root", F.col("loc").alias("url")).unionByName(below.select("root", F.col("loc").alias("url"))).distinct()


def sitemap(files: DataFrame) -> DataFrame:
    """(source, loc, is_index) of sitemap files (source, xml)."""
    raw = files.select("source", F.col("xml").rlike("(?i)<sitemapindex").alias("is_index"), F.explode(F.regexp_extract_all("xml", F.lit(r"(?is)<loc>\s*(.*?)\s*</loc>"), F.lit(1))).alias("loc"))
    for a, b in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&#39;", "'"), ("&amp;", "&")):
        raw = raw.withColumn("loc", F.replace("loc", F.lit(a), F.lit(b)))
    return raw.filter("loc <> ''").distinct()


def paced(requests: DataFrame, by: str, at: str, gap_ms: int, order: str) -> DataFrame:
    """requests with start_ms: no two of one key start within gap_ms; a running maximum instead of a loop."""
    w = Window.partitionBy(by).orderBy(at, order)
    k = F.row_number().over(w) - 1
    slack = requests.withColumn("__k", k).withColumn("__s", F.col(at) - F.col("__k") * gap_ms)
    return slack.withColumn("start_ms", F.max("__s").over(w.rowsBetween(Window.unboundedPreceding, 0)) + F.col("__k") * gap_ms).drop("__k", "__s")


def backoff(attempt: Column, base: int = 500, most: int = 30_000) -> Column:
    return F.least(F.lit(most), (base * F.pow(F.lit(2), attempt - 1)).cast("long"))


def preview(found: DataFrame, include: list[str], exclude: list[str], most: int) -> DataFrame:
    """One row: how many links (link) of a site are found, out of scope, unsafe and kept."""
    url = F.col("link")
    scope, safe = R.in_scope(url, include, exclude), ~(R.acts(url) | R.binary(url))
    return found.select("link").distinct().agg(F.count("*").alias("found"), F.count_if(~scope).alias("out_of_scope"), F.count_if(scope & ~safe).alias("unsafe"), F.least(F.lit(most), F.count_if(scope & safe)).alias("kept"))


def site_preview(seeds_: DataFrame, rules: DataFrame, agent: str, root: str, linked: DataFrame, include: list[str], exclude: list[str], most: int, wider: int = 3) -> DataFrame:
    """One row for a crawl from root: discovered seeds (url), excluded, blocked by robots, links (link) of the root page
    within the root and on its host, pages to expect, and the host as a better root where that reaches so many more."""
    from millrace.api import under_root

    origin = "/".join(root.split("/")[:3]) + "/"
    fit = lambda u: R.in_scope(u, include, exclude) & ~(R.acts(u) | R.binary(u))
    named = seeds_.select(R.canonical_url(F.col("url"), F.lit(root)).alias("url"))
    inside = F.coalesce(under_root(F.col("url"), root) & fit(F.col("url")), F.lit(False))
    known = allowed(cut(named.withColumn("inside", inside)).withColumn("host", R.host(F.col("url"))), rules, agent)
    kept = F.count_distinct(F.when(F.col("inside") & F.col("allowed") & (F.col("url") != root), F.col("url")))
    seeded = known.agg(F.count("*").alias("discovered"), F.count_if(~F.col("inside")).alias("excluded"), F.count_if(F.col("inside") & ~F.col("allowed")).alias("blocked"), (kept + 1).alias("__kept"))
    near = linked.select("link").distinct().filter(fit(F.col("link")))
    reach = near.agg(F.count_if(under_root(F.col("link"), root)).alias("linked_here"), F.count_if(under_root(F.col("link"), origin)).alias("linked_on_host"))
    one = seeded.join(reach)  # one row each
    better = F.when(F.lit(origin != root) & (F.col("linked_on_host") - F.col("linked_here") >= wider), F.lit(origin))
    return one.select("discovered", "excluded", "blocked", "linked_here", "linked_on_host", F.greatest(F.lit(1), F.least(F.lit(most), F.col("__kept") + F.col("linked_here"))).alias("expected"), better.alias("better_root"))


def seconds_needed(pages: Column, per_second: float) -> Column:
    """Estimated seconds of a crawl: loading, then the slower of politeness and embedding."""
    return F.ceil(4 + F.greatest(pages / per_second, pages * 0.45) + 0.45)


#: Attempts after which a failed URL isn't tried again, renders of a crawl, and renders in a row without use.
ATTEMPTS, RENDERS, USELESS = 2, 50, 5


def enqueued(queue: DataFrame, new: DataFrame) -> DataFrame:
    """queue (url, depth, status, attempts, last_status, reason) with URLs of new (url, depth) that it doesn't know in any status."""
    fresh = new.groupBy("url").agg(F.min("depth").alias("depth")).join(queue.select("url"), "url", "left_anti")
    nothing = {"status": F.lit("queued"), "attempts": F.lit(0), "last_status": F.lit(None).cast("int"), "reason": F.lit(None).cast("string")}
    return queue.unionByName(fresh.withColumns(nothing).select(*queue.columns))


def marked(queue: DataFrame, results: DataFrame) -> DataFrame:
    """queue after attempts (url, status, last_status, reason): one more attempt each; a failure without a reason takes that
    of its HTTP status. Results of unknown URLs are passed over."""
    r = results.select("url", F.col("status").alias("__s"), F.col("last_status").alias("__h"), F.coalesce("reason", F.when(F.col("status") == "failed", F.coalesce(failure(F.col("last_status"), F.lit(None)), F.lit("other")))).alias("__r"))
    met = F.col("__s").isNotNull()
    return queue.join(r, "url", "left").withColumns({"status": F.coalesce("__s", "status"), "attempts": F.col("attempts") + met.cast("int"), "last_status": F.coalesce("__h", "last_status"), "reason": F.when(met, F.col("__r")).otherwise(F.col("reason"))}).drop("__s", "__h", "__r")


def requeued(queue: DataFrame, attempts: int = ATTEMPTS) -> DataFrame:
    """queue with failures worth another attempt queued again, up to so many attempts."""
    again = (F.col("status") == "failed") & retryable(F.col("reason")) & (F.col("attempts") < attempts)
    return queue.withColumn("status", F.when(again, "queued").otherwise(F.col("status")))


def recrawled(queue: DataFrame) -> DataFrame:
    return queue.withColumn("status", F.lit("queued"))


def next_queued(queue: DataFrame, most: int) -> DataFrame:
    """The next URLs of the queue, in order of URL; a batch, so bounded by what is asked for."""
    return queue.filter("status = 'queued'").orderBy("url").limit(most)


def counts(queue: DataFrame) -> DataFrame:
    """One row: how many are queued, done, failed and skipped."""
    return queue.agg(*(F.count_if(F.col("status") == s).alias(s) for s in ("queued", "done", "failed", "skipped")))


def crawled(pages: DataFrame, seeds: DataFrame, rules: DataFrame, agent: str, include: list[str], exclude: list[str], depth: int, most: int) -> DataFrame:
    """The queue after a crawl over fetched pages (one for each `page`, with outcome, status, html, final_url, url).

    Round by round, the queued URLs meet their pages: those that robots rules bar, or that come after `most` pages are
    done, are skipped, pages that ask not to be indexed too, but their links count; failures keep their reason. Links of a
    round within scope are queued one deeper. Each round is a join written to the shared folder; rows never reach the driver.
    """
    kinds = "url string, depth int, status string, attempts int, last_status int, reason string"
    queue = enqueued(pages.sparkSession.createDataFrame([], kinds), seeds.select("url", F.lit(0).alias("depth")))
    queue, done = cut(queue), 0
    fit = links(pages).filter(R.in_scope(F.col("link"), include, exclude) & ~R.acts(F.col("link")) & ~R.binary(F.col("link")))
    for d in range(depth + 1):
        now = allowed(queue.filter("status = 'queued'").select("url", R.host(F.col("url")).alias("host")), rules, agent)
        met = cut(now.join(pages.select(F.col("page").alias("url"), "outcome", F.col("status").alias("last_status"), "failure"), "url", "left"))
        good = F.col("allowed") & F.coalesce(F.col("outcome").isin("indexed", "unchanged"), F.lit(False))
        fine = met.filter(good).select("url")
        late = fine.limit(0)
        if fine.count() > most - done:  # the first ones in order of URL are kept, at most as many as a crawl may have
            late = fine.join(fine.orderBy("url").limit(max(0, most - done)), "url", "left_anti")
        late = late.withColumn("late", F.lit(True))
        state = F.when(~F.col("allowed") | F.col("late").isNotNull() | (F.col("outcome") == "skipped"), "skipped").when(good, "done").otherwise("failed")
        results = cut(met.join(late, "url", "left").select("url", state.alias("status"), F.when(state == "failed", F.coalesce("last_status", F.lit(0))).alias("last_status"), F.when(state == "failed", F.coalesce("failure", F.when(F.col("outcome") == "auth", "forbidden"), F.lit("network"))).alias("reason"), ((state == "done") | F.coalesce((F.col("outcome") == "skipped") & F.col("allowed"), F.lit(False))).alias("harvest")))
        done += results.filter("status = 'done'").count()
        queue = marked(queue, results)
        if d < depth:
            found = results.filter("harvest").join(fit, F.col("url") == F.col("page")).select(F.col("link").alias("url"), F.lit(d + 1).alias("depth"))
            queue = enqueued(queue, found)
        queue = cut(queue)
    return queue


def renders(pages: DataFrame, by: str, order: list[str], helped: str, most: int = RENDERS, useless: int = USELESS) -> DataFrame:
    """pages that ask to be rendered, with allowed: the first `most` of each crawl, until `useless` in a row brought nothing."""
    w = Window.partitionBy(by).orderBy(*order)
    placed = pages.withColumn("__k", F.row_number().over(w)).withColumn("__run", F.sum((~F.col(helped)).cast("int")).over(w.rowsBetween(-(useless - 1), 0)))
    over = F.min(F.when(F.col("__run") == useless, F.col("__k"))).over(Window.partitionBy(by))
    return placed.withColumn("allowed", (F.col("__k") <= most) & (F.col("__k") <= F.coalesce(over, F.col("__k")))).drop("__k", "__run")


def stopped(fetches: DataFrame, by: str, order: list[str], status: str, ceiling: int) -> DataFrame:
    """(by, order): where each crawl stops, after `ceiling` failures of site or network in a row. Missing pages neither
    count nor break a row of failures."""
    bad = infrastructure(F.col(status))
    w = Window.partitionBy(by).orderBy(*order)
    told = fetches.filter(bad | F.col(status).between(200, 399)).withColumn("__run", F.sum(bad.cast("int")).over(w.rowsBetween(-(ceiling - 1), 0)))
    first = F.min(F.when(F.col("__run") == ceiling, F.struct(*order))).alias("f")
    return told.groupBy(by).agg(first).filter("f is not null").select(by, *(F.col(f"f.{o}") for o in order))
