"""Analytics over logs: gaps in a corpus, learned preferences, spend, caches, sessions, registry and limits."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions import lexicon as L
from millrace.functions import text as X

DAY = 24 * 60 * 60 * 1000


def newest(df: DataFrame, key: str | list[str], order: list[str]) -> DataFrame:
    """The last row of each key."""
    w = Window.partitionBy(*([key] if isinstance(key, str) else key)).orderBy(*(F.desc(o) for o in order))
    return df.withColumn("__n", F.row_number().over(w)).filter("__n = 1").drop("__n")


def failed(score: Column, answered: Column, feedback: Column, floor: float, confident: float | None = None) -> Column:
    """Whether a logged question is evidence of a gap: disliked, below the floor, or unanswered without high confidence."""
    s = F.coalesce(score, F.lit(0.0))
    unanswered = ~F.coalesce(answered, F.lit(False)) & (F.lit(True) if confident is None else s < confident)
    return F.coalesce(feedback == "down", F.lit(False)) | (s < floor) | unanswered


def gap_report(log: DataFrame, floor: float = L.REFUSE, confident: float | None = L.CONFIDENT, threshold: float = 0.34) -> DataFrame:
    """(index_id, topic, count, avg_score, examples) of log (id, index_id, query, top_score, answered, feedback, at_ms).

    Failed questions of an index join, in order of time, the cluster that holds the most similar question so far, or
    open one; of equally similar clusters the later. That order is the definition, so each index is read by one task,
    but as a sorted stream: only token sets and clusters are held, never the rows.
    """
    bad = log.filter(failed(F.col("top_score"), F.col("answered"), F.col("feedback"), floor, confident)).filter("query is not null")
    rows = bad.select("index_id", "at_ms", "id", "query", F.coalesce("top_score", F.lit(0.0)).alias("score"), F.array_distinct(X.tokens(F.col("query"))).alias("t"))

    def run(batches):
        index, state = None, None
        for batch in batches:
            done = []
            for name, query, score, tokens in zip(*(batch.column(c).to_pylist() for c in ("index_id", "query", "score", "t"))):
                if state is None or name != index:
                    if state is not None:
                        done += [(index, *r) for r in state.rows()]
                    index, state = name, _Greedy(threshold)
                state.add(query, score, tokens)
            yield _report(done)
        if state is not None:
            yield _report([(index, *r) for r in state.rows()])

    sorted_ = rows.repartition("index_id").sortWithinPartitions("index_id", "at_ms", "id")
    return sorted_.mapInArrow(run, "index_id string, topic string, count long, avg_score double, examples array<string>")


def _report(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.string(), pa.int64(), pa.float64(), pa.list_(pa.string()))
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], ["index_id", "topic", "count", "avg_score", "examples"])


class _Greedy:
    """Single-link clusters of token sets in order of arrival. Only sets with a common token are compared."""

    def __init__(self, threshold: float):
        self.threshold, self.of_token, self.sets, self.cluster_of, self.clusters = threshold, {}, [], [], []

    def add(self, query: str, score: float, tokens: list[str]) -> None:
        own = frozenset(tokens)
        shared: dict[int, int] = {}
        for t in own:
            for k in self.of_token.get(t, ()):
                shared[k] = shared.get(k, 0) + 1
        if not own:
            shared = {k: 0 for k, s in enumerate(self.sets) if not s}
        best, best_score = -1, self.threshold
        for k, n in shared.items():
            s = n / (len(own) + len(self.sets[k]) - n) if own else 1.0
            if s > best_score or s == best_score and self.cluster_of[k] > best:
                best, best_score = self.cluster_of[k], s
        if best < 0:
            best = len(self.clusters)
            self.clusters.append([query, 0, 0.0, []])
        cluster = self.clusters[best]
        cluster[1] += 1
        cluster[2] += score
        if len(cluster[3]) < 3:
            cluster[3].append(query)
        for t in own:
            self.of_token.setdefault(t, []).append(len(self.sets))
        self.sets.append(own)
        self.cluster_of.append(best)

    def rows(self) -> list[tuple]:
        return [(topic, n, total / n, examples) for topic, n, total, examples in self.clusters]


def csv_lines(report: DataFrame) -> DataFrame:
    """(line): the report as quoted CSV lines, without a head."""
    q = lambda c: F.concat(F.lit('"'), F.regexp_replace(c, '"', '""'), F.lit('"'))
    return report.select(F.concat_ws(",", q(F.col("topic")), F.col("count").cast("string"), F.format_string("%.3f", "avg_score"), q(F.array_join("examples", " | "))).alias("line"))


def priors(log: DataFrame, most: int = L.PRIOR_ENTRIES) -> DataFrame:
    """(index_id, url, term, seen, picks, last_at): what was asked when a page was picked, from each index's latest picks."""
    w = Window.partitionBy("index_id").orderBy(F.desc("at_ms"), F.desc("id"))
    picks = log.filter("picked_url is not null").withColumn("n", F.row_number().over(w)).filter(F.col("n") <= most)
    base = picks.groupBy("index_id", F.col("picked_url").alias("url")).agg(F.count("*").alias("picks"), F.max("at_ms").alias("last_at"))
    terms = picks.select("index_id", F.col("picked_url").alias("url"), F.explode(X.distinctive(F.coalesce("picked_for", "query"))).alias("term")).groupBy("index_id", "url", "term").agg(F.count("*").alias("seen"))
    return terms.join(base, ["index_id", "url"])


def prior_boosts(known: DataFrame, queries: DataFrame, now_ms: int) -> DataFrame:
    """(qid, url, boost) for queries (qid, index_id, query): 1 and up to PRIOR_BOOST, by words seen before and by age."""
    asked = queries.select("qid", "index_id", X.distinctive(F.col("query")).alias("t")).withColumn("n", F.size("t")).select("qid", "index_id", "n", F.explode("t").alias("term"))
    hits = asked.join(known, ["index_id", "term"]).groupBy("qid", "url", "n", "last_at").agg(F.sum(F.least(F.lit(1.0), F.col("seen") / L.PRIOR_FULL)).alias("e"))
    age = F.greatest(F.lit(0.0), (F.lit(now_ms) - F.col("last_at")) / DAY)
    return hits.select("qid", "url", (1 + F.col("e") / F.col("n") * F.pow(F.lit(2.0), -age / L.PRIOR_HALF_LIFE) * (L.PRIOR_BOOST - 1)).alias("boost"))


def spend(usage: DataFrame, rates: DataFrame) -> DataFrame:
    """(day, model, prompt_tokens, completion_tokens, calls, cost, estimated, partial) by day and model, by day, and in all.

    usage has (at, model, prompt_tokens, completion_tokens, estimated), rates (model, per_prompt, per_completion) a
    million. A model without a rate has no cost; partial tells whether a sum lacks some.
    """
    cost = (F.col("prompt_tokens") * F.col("per_prompt") + F.col("completion_tokens") * F.col("per_completion")) / 1e6
    priced = usage.join(rates, "model", "left").select(F.to_date("at").alias("day"), "model", "prompt_tokens", "completion_tokens", "estimated", cost.alias("cost"))
    return priced.rollup("day", "model").agg(F.sum("prompt_tokens").alias("prompt_tokens"), F.sum("completion_tokens").alias("completion_tokens"), F.count("*").alias("calls"), F.sum("cost").alias("cost"), F.coalesce(F.bool_or("estimated"), F.lit(False)).alias("estimated"), F.coalesce(F.bool_or(F.col("cost").isNull()), F.lit(False)).alias("partial"))


def usage_of(replies: DataFrame, body: str) -> DataFrame:
    """replies with prompt_tokens and completion_tokens, whichever of the usual shapes the JSON reports them in; the largest counts."""
    found = lambda *paths: F.greatest(*(F.get_json_object(body, p).cast("long") for p in paths), F.lit(None).cast("long"))
    return replies.withColumn("prompt_tokens", found("$.usage.prompt_tokens", "$.usage.input_tokens", "$.message.usage.input_tokens", "$.usageMetadata.promptTokenCount")).withColumn("completion_tokens", found("$.usage.completion_tokens", "$.usage.output_tokens", "$.message.usage.output_tokens", "$.usageMetadata.candidatesTokenCount"))


def kept_cache(cache: DataFrame, now_ms: int, ttl_ms: int = 7 * DAY, per_index: int = 200) -> DataFrame:
    """Answers that are neither older than the limit nor beyond the latest per index; reading one renews its time."""
    w = Window.partitionBy("index_id").orderBy(F.desc("at_ms"), "id")
    return cache.filter(F.lit(now_ms) - F.col("at_ms") <= ttl_ms).withColumn("n", F.row_number().over(w)).filter(F.col("n") <= per_index).drop("n")


def answer_key(*parts: Column) -> Column:
    """A key of an answer: its query and settings, joined by a character that none holds."""
    return X.fnv1a(F.concat_ws("\u0000", *parts))


def latest_sessions(sessions: DataFrame, most: int | None = None) -> DataFrame:
    """The last save of each conversation, the one with most turns on a tie; the newest `most` of all if given."""
    one = newest(sessions.withColumn("__t", F.size("turns")), "id", ["updated_at", "__t"]).drop("__t")
    return one.orderBy(F.desc("updated_at"), "id").limit(most) if most else one


def index_statistics(chunks: DataFrame, vectors: DataFrame | None = None, size: int = 0) -> DataFrame:
    """(index_id, pages, chunks, text_bytes, vector_bytes)."""
    n = lambda c: F.coalesce(F.octet_length(c), F.lit(0))
    return chunks.groupBy("index_id").agg(F.count_distinct("url").alias("pages"), F.count("*").alias("chunks"), F.sum(n("text") + n("body") + n("url") + n("heading_path")).alias("text_bytes"), (F.count("*") * size * 4).alias("vector_bytes"))


def freshness(registry: DataFrame, now_ms: int, model: str, stale_days: int = 7, cadence_days: int | None = None) -> DataFrame:
    """registry with age_days, stale, due and rebuild (built by another model); due first by age."""
    age = F.floor((F.lit(now_ms) - F.col("last_indexed_at")) / DAY)
    due = F.lit(False) if cadence_days is None else (F.lit(now_ms) - F.col("last_indexed_at")) >= cadence_days * DAY
    return registry.withColumns({"age_days": age.cast("long"), "stale": age > stale_days, "due": F.coalesce(due, F.lit(False)), "rebuild": F.coalesce(F.col("embedding_model") != model, F.lit(True))})


def even_stride(titles: DataFrame, by: str, title: str, most: int = 20) -> DataFrame:
    """(by, title): up to `most` of each group's distinct titles at even distances in alphabetical order."""
    one = titles.filter(F.col(title).isNotNull()).select(by, title).distinct()
    w = Window.partitionBy(by)
    placed = one.withColumn("n", F.count("*").over(w)).withColumn("k", F.row_number().over(w.orderBy(title)) - 1)
    step = F.greatest(F.lit(1), F.floor(F.col("n") / most))
    return placed.filter((F.col("k") % step == 0) & (F.floor(F.col("k") / step) < most)).select(by, title)


def streaks(events: DataFrame, by: str, order: list[str], bad: Column) -> DataFrame:
    """(by, start, length): runs of consecutive bad rows of each key."""
    w = Window.partitionBy(by).orderBy(*order)
    marked = events.withColumn("bad", bad).withColumn("k", F.row_number().over(w))
    island = marked.filter("bad").withColumn("g", F.col("k") - F.row_number().over(w))
    return island.groupBy(by, "g").agg(F.min(F.struct(*order)).alias("first"), F.count("*").alias("length")).select(by, F.col("first")[order[0]].alias("start"), "length")


def error_policies(spark) -> DataFrame:
    return spark.createDataFrame(L.ERROR_POLICIES, "kind string, retryable boolean, terminal boolean, auto_retry boolean, shown_as string, trips boolean")


def _says(text: Column, marks: list[str]) -> Column:
    return F.greatest(*(F.contains(text, F.lit(m)) for m in marks))


def error_kind(status: Column, body: Column) -> Column:
    """The kind of a provider's failure from its HTTP status and text.

    Clear statuses decide alone. 400 and 422 are told apart by what the text says; so is any status that says nothing,
    such as a 200 whose stream turned into an error (0 stands for an error without a status). Quota is looked for before
    the rate, as a text about an exceeded quota may name both.
    """
    low = F.lower(F.coalesce(body, F.lit("")))
    quota, model, filtered = _says(low, L.QUOTA_SAID), _says(low, L.MODEL_SAID), _says(low, L.FILTER_SAID)
    said = F.when(quota, "quota_exhausted").when(model, "model_not_found").when(filtered, "content_filtered").when(_says(low, L.CONTEXT_SAID), "bad_request").when(_says(low, L.RATE_SAID), "rate_limited").when(_says(low, L.DOWN_SAID), "provider_down")
    return (
        F.when(status.isin(401, 403), "auth_invalid").when(status == 429, F.when(quota, "quota_exhausted").otherwise("rate_limited")).when(status == 404, "model_not_found")
        .when(status.isin(400, 422), F.when(model, "model_not_found").when(filtered, "content_filtered").otherwise("bad_request"))
        .when(status == 402, "quota_exhausted").when(status.isin(408, 504), "timeout").when(status >= 500, "provider_down").otherwise(F.coalesce(said, F.lit("unknown")))
    )


def thrown_kind(name: Column, message: Column, cancelled: Column) -> Column:
    """The kind of a failure that was thrown, from the error's name and message, and whether the user stopped it."""
    network = (name == "TypeError") | F.coalesce(message, F.lit("")).rlike("(?i)failed to fetch|networkerror|load failed")
    return F.when(name == "AbortError", F.when(F.coalesce(cancelled, F.lit(False)), "cancelled").otherwise("timeout")).when(name == "TimeoutError", "timeout").when(network, "network").otherwise("unknown")
