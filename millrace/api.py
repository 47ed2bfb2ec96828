"""The engine's entry points: build, refresh, move, search, answer, and look after an index."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.functions import lexicon as L
from millrace.functions import text as X
from millrace.functions import urls as R
from millrace.operators import articles as A
from millrace.operators import chunker, crawl, decide, evaluate, extract, logs, render, search, turns, understand
from millrace.session import cut, stored
from millrace.sources import corpus

__all__ = ["answer", "answer_events", "build_index", "calibrate", "due_indexes", "evaluate_questions", "export_corpus", "finalize", "gap_report", "import_corpus", "import_index", "load_index", "log_entries", "merge_refresh", "plan_refresh", "quota", "sample", "save_index", "search_chunks"]

# Bytes that a page takes, and articles and tokens that each kind of generator gets.
PAGE_BYTES = 23_000
UNBOUNDED = 1 << 60
PACKS = {"extractive": (4, UNBOUNDED), "small": (4, 3000), "large": (8, 12_000)}


def build_index(fetched: DataFrame, index_id: str, root: str | None = None) -> dict[str, DataFrame]:
    """pages and chunks of fetches (fetch_id, url, final_url, status, html, etag, lastmod, robots_tag, fetched_at).

    Of each page the last fetch counts; pages behind a sign-in, failed ones and those that ask not to be indexed are left
    out; of pages with the same content the smallest URL stays; with a root, only pages under it. A chunk's id is a hash
    of its page and place, so numbering needs no order over the whole corpus.
    """
    last = crawl.outcome(crawl.latest_fetch(fetched)).filter("outcome = 'indexed'").withColumn("html_hash", F.md5("html"))
    if root:
        last = last.filter(under_root(F.col("page"), root))
    kept = last.join(crawl.duplicates(last, "html_hash", "page").select("page"), "page", "left_anti")
    read = cut(extract.pages(kept.select("page", "html"), "page", "html"))
    pages = kept.select("page", "etag", "lastmod", "html_hash", "fetched_at").join(read.select("page", "title", "breadcrumb"), "page").withColumnRenamed("page", "url").withColumn("index_id", F.lit(index_id))
    chunks = chunker.chunks(read, "page").withColumnRenamed("page", "url")
    chunks = chunks.select(F.lit(index_id).alias("index_id"), F.xxhash64(F.lit(index_id), "url", "chunk_pos").alias("vector_id"), "text", "body", "url", "anchor", "heading_path", "chunk_pos", "title", X.fnv1a("body").alias("content_hash"))
    return {"pages": pages, "chunks": chunks}


def under_root(url: Column, root: str) -> Column:
    """Whether a URL has the root's path or lies below it, on the same host. Below "/a/" lies "/a/b", but "/a" doesn't."""
    r = F.lit(root)
    top, own = (F.regexp_replace(R.path(u), "^$", "/") for u in (r, url))
    below = F.when(top.endswith("/"), top).otherwise(F.concat(top, F.lit("/")))
    return F.coalesce((R.host(url) == R.host(r)) & ((own == top) | F.startswith(own, below)), F.lit(False))


def plan_refresh(stored: DataFrame, fetched: DataFrame) -> DataFrame:
    """(url, reindex): fetched pages (url, etag, lastmod, html_hash) against stored ones."""
    return crawl.changed(stored, fetched, "url")


def merge_refresh(stored: dict[str, DataFrame], new: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Stored pages and chunks with those of re-read pages replaced whole."""
    gone = new["pages"].select("url")
    return {k: stored[k].join(gone, "url", "left_anti").unionByName(new[k], allowMissingColumns=True) for k in ("pages", "chunks")}


def save_index(chunks: DataFrame, path: str) -> None:
    """Postings and statistics of the usual fields as tables, postings parted by field; search_chunks(idx=load_index(…)) reads them."""
    postings, terms, fields = search.chunk_index(chunks)
    postings.write.mode("overwrite").partitionBy("field").parquet(f"{path}/postings")
    terms.write.mode("overwrite").partitionBy("field").parquet(f"{path}/terms")
    fields.write.mode("overwrite").parquet(f"{path}/fields")


def load_index(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    return tuple(spark.read.parquet(f"{path}/{name}") for name in ("postings", "terms", "fields"))


def export_corpus(chunks: DataFrame, path: str) -> None:
    corpus.write_chunks(chunks, path)


def import_corpus(spark: SparkSession, path: str) -> DataFrame:
    return corpus.read_chunks(spark, path)


def search_chunks(chunks: DataFrame, queries: DataFrame, **how) -> DataFrame:
    """The chunks for each of queries (qid, query), ranked; see operators.search.retrieve."""
    return search.retrieve(chunks, queries, **how)


def answer(chunks: DataFrame, queries: DataFrame, refuse: float = L.REFUSE, confident: float = L.CONFIDENT, pack: str = "extractive", focus: str | None = None, brief: bool = False, **how) -> DataFrame:
    """(qid, outcome, certainty, top_score, answer, sources, refinements) for queries (qid, query).

    Small talk isn't looked up. A question is refused without results or below the floor; otherwise excerpts of the best
    articles answer it, with their sources as cards, below the confident floor marked uncertain. Where several pages lead
    about equally, refinements name them. With `focus`, the URL of a page that was picked, only that page answers, and a
    question isn't refused for its score.

    With `brief`, only (qid, outcome, certainty, answer, n_sources). On a picked page these need the rankings of questions
    that may reach the confident floor there, and no others.
    """
    talk = queries.select("qid", "query", understand.intent(F.col("query")).alias("intent"))
    # questions of the same words have the same answer, so one of them is asked, unless something looks beyond words
    key = F.col("qid").cast("string") if {"embed", "second", "priors"} & how.keys() else F.array_join(F.array_sort(X.tokens(F.col("query"))), " ")
    same = cut(talk.filter("intent = 'question'").withColumn("asked", F.min("qid").over(Window.partitionBy(key))).select("qid", "asked", "query"))
    asked = same.filter("qid = asked").select("qid", "query")
    most, budget = PACKS[pack]
    chunks = stored(chunks)
    page = A.places(chunks, focus) if focus else []
    if {"second", "priors", "current_url"} & how.keys():
        ranked = cut(search.retrieve(chunks, asked, **how))
        if page:
            near = ranked.select("qid", "vector_id", "similarity")
            ranked = cut(A.page_scope(ranked, chunks, focus).join(near, ["qid", "vector_id"], "left").join(chunks.select("vector_id", "url", "chunk_pos"), "vector_id").withColumnRenamed("place", "rank"))
        heads = cut(A.heads(ranked, chunks, asked))
    else:
        heads = cut(search.heads(chunks, asked, most, page, **how, **({"floor": confident} if brief and page else {})))
    whole = page and not {"second", "priors", "current_url"} & how.keys()
    met = A.excerpted(A.whole_page(heads, chunks, focus) if whole else A.passage_bodies(heads, chunks, focus if page else None))
    title = F.coalesce("title", "heading_path", F.lit("Untitled"))
    parts = met.select("qid", "article", "body", A.numbered(title).alias("line"), F.struct(*render.card_columns()).alias("card"))
    packed = (parts if budget >= UNBOUNDED else A.pack(parts, most, budget)).groupBy("qid").agg(F.slice(F.array_sort(F.collect_list(F.struct("article", "line", "card"))), 1, most).alias("p"))
    said = packed.select("qid", F.array_join(F.transform("p", lambda x: x["line"]), "\n\n").alias("answer"), F.transform("p", lambda x: x["card"]).alias("sources"))
    # rows of one question together, so that what follows needs no further shuffle
    options = decide.refinements(heads.select("qid", "article", "url", "title", "heading_path", "similarity").repartition("qid")).groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("place", "label", "url"))).alias("refinements"))
    top = heads.groupBy("qid").agg(F.round(F.max("similarity"), 6).alias("top_score"), F.count("*").alias("__n"))
    told = top.join(said, "qid", "left").join(options, "qid", "left").withColumnRenamed("qid", "asked")
    done = talk.join(same.select("qid", "asked"), "qid", "left").join(told, "asked", "left")
    verdict = turns.decision(F.col("top_score"), F.coalesce("__n", F.lit(0)), F.lit(refuse), F.lit(confident), F.lit(True), F.lit(bool(focus)))
    done = done.withColumn("certainty", F.when(F.col("intent") == "question", verdict))
    outcome = F.when(F.col("intent") != "question", "small-talk").when(F.col("certainty") == "refuse", "refused").otherwise("answered")
    answered = F.col("outcome") == "answered"
    if brief:
        return done.withColumn("outcome", outcome).select("qid", "outcome", "certainty", F.when(answered, F.col("answer")).alias("answer"), F.size(F.when(answered, F.col("sources"))).alias("n_sources"))
    return done.withColumn("outcome", outcome).select("qid", "outcome", "certainty", "top_score", F.when(answered, F.col("answer")).alias("answer"), F.when(answered, F.col("sources")).alias("sources"), F.when(answered, F.col("refinements")).alias("refinements"))


def answer_events(answers: DataFrame, replies: DataFrame | None = None, tier: str = "extractive") -> DataFrame:
    """(qid, n, kind, detail): the events of answers, in order; with a model's replies (qid, reply), those are shown, and an
    answer by extraction takes over where a reply declines."""
    own = answers.filter("outcome <> 'small-talk'")
    own = own.withColumn("reply", F.col("answer")) if replies is None else own.join(replies.select("qid", "reply"), "qid", "left")
    return turns.events(own.select("qid", "certainty", F.lit(tier).alias("tier"), "reply", F.col("answer").alias("fallback"), F.greatest(F.lit(0), F.coalesce(F.size("refinements"), F.lit(0))).alias("refinements")))


def log_entries(answers: DataFrame, queries: DataFrame, index_id: str, at_ms: Column) -> DataFrame:
    """Rows for the log of what was asked, with personal data of fixed forms masked."""
    return answers.join(queries, "qid").filter("outcome <> 'small-talk'").select(F.lit(index_id).alias("index_id"), X.mask(F.col("query")).alias("query"), F.coalesce("top_score", F.lit(0.0)).alias("top_score"), (F.col("outcome") == "answered").alias("answered"), "outcome", at_ms.alias("at_ms"))


def cached(queries: DataFrame, cache: DataFrame, index_id: str, settings: str) -> DataFrame:
    """queries (qid, query) with the key of their answer and, where one is kept, the answer (key, markdown). Refusals are never kept."""
    key = logs.answer_key(F.lit(index_id), F.lower(X.squeeze(F.col("query"))), F.lit(settings))
    return queries.withColumn("key", key).join(cache.select("key", "markdown"), "key", "left")


def cached_put(cache: DataFrame, answers: DataFrame) -> DataFrame:
    """cache with answers (key, index_id, markdown, refused, at_ms) put in, each index held to its latest 200; see operators.turns."""
    return turns.put(cache, answers)


def finalize(chunks: DataFrame, probes: int = 20, embed=search.hashed_vectors) -> dict[str, DataFrame]:
    """What a finished crawl leaves: statistics of each index and its floors, which probes calibrate.

    Titles at even distances are asked of all indexes at once: an index should answer its own, and not the others'. Probes
    are a fixed number for each index, so they are the small side of an exact nearest-neighbour search over all chunks.
    """
    asked = logs.even_stride(chunks, "index_id", "title", probes)
    queries = cut(asked.withColumn("qid", F.row_number().over(Window.orderBy("index_id", "title")).cast("long")))
    vectors = cut(embed(chunks, "vector_id", F.col("text")))
    near = search.cosine(vectors, embed(queries, "qid", F.col("title")).withColumnRenamed("id", "qid"), 50)
    met = near.join(chunks.select(F.col("vector_id").alias("id"), F.col("index_id").alias("of")), "id").groupBy("qid", "of").agg(F.max("score").alias("score"))
    scores = met.join(queries, "qid").select(F.col("of").alias("index_id"), "score", (F.col("of") == F.col("index_id")).alias("positive"))
    return {"stats": logs.index_statistics(chunks), "floors": decide.calibrate(cut(scores), "index_id")}


def import_index(spark: SparkSession, path: str, index_path: str) -> DataFrame:
    """Chunks of a corpus file, numbered anew, with their postings and statistics saved, so that they can be searched at once."""
    chunks = cut(corpus.read_chunks(spark, path))
    save_index(chunks, index_path)
    return chunks


def gap_report(log: DataFrame, **floors) -> DataFrame:
    return logs.gap_report(log, **floors)


def calibrate(scores: DataFrame, by: str = "index_id") -> DataFrame:
    return decide.calibrate(scores, by)


def floors_for(registry: DataFrame, calibrated: DataFrame, refuse: float = L.REFUSE, confident: float = L.CONFIDENT, override: bool = False) -> DataFrame:
    """registry with the floors that hold: an index's own, unless the settings override them or it has none."""
    both = registry.join(calibrated.select("index_id", F.col("refuse").alias("r"), F.col("confident").alias("c")), "index_id", "left")
    own = F.lit(not override) & F.col("r").isNotNull()
    return both.withColumn("refuse", F.when(own, F.col("r")).otherwise(refuse)).withColumn("confident", F.when(own, F.col("c")).otherwise(confident)).drop("r", "c")


def evaluate_questions(found: DataFrame, relevant: DataFrame, k: int = 5) -> DataFrame:
    return evaluate.summary(evaluate.ranks(found, relevant), k)


def due_indexes(registry: DataFrame, now_ms: int, days: int | None, model: str = "bge-small-en-v1.5") -> DataFrame:
    """Indexes whose refresh is due, the oldest first; none without a cadence."""
    return logs.freshness(registry, now_ms, model, cadence_days=days).filter("due").orderBy("last_indexed_at", "index_id")


def quota(pages: Column, available: Column) -> Column:
    """(bytes, fits) that a crawl of so many pages needs."""
    need = F.ceil(pages * PAGE_BYTES)
    return F.struct(need.alias("bytes"), (need <= available).alias("fits"))


def background(registry: DataFrame, rate: str = "requests_per_second") -> DataFrame:
    """Half the rate, not below 0.2 a second, and one request at a time, for refreshes nobody waits for."""
    return registry.withColumns({rate: F.greatest(F.lit(0.2), F.col(rate) / 2), "concurrency": F.lit(1)})


def sample(df: DataFrame, key: str, n: int, seed: int = 0) -> DataFrame:
    """n rows in an order that only seed and key decide."""
    return df.orderBy(F.xxhash64(F.lit(seed), F.col(key)), key).limit(n)


def markdown_table(report: DataFrame) -> DataFrame:
    """(line): a gap report's rows as lines of a Markdown table, without its head."""
    return report.select(F.format_string("| %s | %d | %.2f |", F.col("topic"), F.col("count"), F.col("avg_score")).alias("line"))
