"""Queries of retrieval over the project's tables, with their SQL.

Searches take as queries every logged question, or vector, whose id is divisible by 100, against all chunks or vectors;
retrieve, and what answers, prompts or shows sources, takes all logged questions.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions import lexicon as L
from millrace.functions import urls as R
from millrace.operators import articles as A
from millrace.operators import decide as D
from millrace.operators import evaluate as E
from millrace.operators import search as S
from millrace.session import cut, stamp
from millrace.sources.tables import one_of_each, spread, table



def chunks(spark: SparkSession, d: str) -> DataFrame:
    return one_of_each(spread(table(spark, d, "chunks"), "vector_id"), "vector_id")


def logged(spark: SparkSession, d: str) -> DataFrame:
    """All logged questions."""
    log = table(spark, d, "query_log").filter("query is not null").select("id", "query", "index_id")
    return one_of_each(log, "id").withColumnRenamed("id", "qid")


def questions(spark: SparkSession, d: str) -> DataFrame:
    """The logged questions whose id is divisible by 100."""
    log = table(spark, d, "query_log").filter("id % 100 = 0 and query is not null").select("id", "query", "index_id")
    return one_of_each(log, "id").withColumnRenamed("id", "qid")


def _terms(spark, d, asked=questions):
    return S.query_terms(asked(spark, d), "qid", F.col("query"))


#: What was built in this application from tables that haven't changed since.
_BUILT: dict = {}


def _built(spark: SparkSession, d: str, name: str, build) -> object:
    """An index of the chunks is built once, as a user would, and read by every batch of questions after that."""
    key = (spark.sparkContext.applicationId, d, name, stamp(spark, f"{d}/chunks.parquet"))
    if key not in _BUILT:
        _BUILT[key] = build(chunks(spark, d) if name == "corpus" else _corpus(spark, d))
    return _BUILT[key]


def _corpus(spark, d):
    """One row of each chunk, as the index keeps them."""
    return _built(spark, d, "corpus", cut)


def _texts(spark, d):
    return _built(spark, d, "texts", lambda c: S.stored_index(c, "vector_id", {"content": F.col("text")}))


def _index_of(spark, d):
    return _built(spark, d, "fields", S.chunk_index)


def _vectors(spark, d):
    return _built(spark, d, "vectors", lambda c: cut(S.hashed_vectors(c, "vector_id", F.col("text"))))


def search_index(spark, d):
    """Builds what the searches read: postings of the fields and of whole texts, and vectors; rows of each."""
    _BUILT.clear()
    terms = F.coalesce(F.sum(F.size("terms")), F.lit(0)).cast("long")
    parts = {"fields": (_index_of(spark, d)[0], terms), "texts": (_texts(spark, d)[0], terms), "vectors": (_vectors(spark, d), F.count("*"))}
    return reduce(DataFrame.unionByName, [t.groupBy().agg(F.lit(n).alias("part"), rows.alias("n")) for n, (t, rows) in parts.items()])


def tokenize_tf(spark, d):
    return S.term_frequencies(chunks(spark, d), "vector_id", F.col("body")).select(F.col("id").alias("vector_id"), "term", "tf", F.col("dl").cast("long").alias("dl"))


def term_stats(spark, d):
    return _index_of(spark, d)[1]


def _bm25(spark, d, k=10):
    return S.bm25(_texts(spark, d), _terms(spark, d), k)


def _fielded(spark, d, k, asked=questions):
    return S.bm25(_index_of(spark, d), _terms(spark, d, asked), k, L.FIELDS, L.FIELD_DEPTH)


def _out(df, *more):
    return df.select("qid", F.col("id").alias("vector_id"), F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"), *more)


def bm25_topk(spark, d):
    return _out(_bm25(spark, d))


def fielded_bm25_topk(spark, d):
    return _out(_fielded(spark, d, L.TOP_K))


def _cosine(spark, d, k):
    v = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    return S.cosine(v, v.filter("id % 100 = 0").select(F.col("id").alias("qid"), "v"), k)


def cosine_topk(spark, d):
    return _out(_cosine(spark, d, L.TOP_K))


def _lists(spark, d):
    dense = _cosine(spark, d, L.TOP_K).select("qid", F.lit("dense").alias("list"), "id", "score", "rank")
    sparse = _fielded(spark, d, L.TOP_K).select("qid", F.lit("sparse").alias("list"), "id", "score", "rank")
    return dense.unionByName(sparse)


def rrf_fusion(spark, d):
    return _out(S.reciprocal_fusion(_lists(spark, d)))


def hybrid_search(spark, d):
    return _out(S.weighted_fusion(_lists(spark, d), {"dense": L.DENSE, "sparse": L.SPARSE}))


def _feedback(spark, d, sparse):
    texts = _corpus(spark, d).select(F.col("vector_id").alias("id"), "text")
    return S.feedback_terms(sparse, texts, _terms(spark, d))


def rm3_terms(spark, d):
    return _feedback(spark, d, cut(_fielded(spark, d, L.TOP_K)))


def hybrid_search_rm3(spark, d):
    both = S.both_passes(_corpus(spark, d), questions(spark, d).select("qid", "query"), idx=_index_of(spark, d))
    dense = _cosine(spark, d, L.TOP_K).select("qid", F.lit("dense").alias("list"), "id", "score", "rank")
    return _out(S.weighted_fusion(dense.unionByName(both), {"dense": L.DENSE, "sparse": L.SPARSE, "expanded": L.EXPANDED}))


def retrieve(spark, d):
    found = S.retrieve(_corpus(spark, d), logged(spark, d).select("qid", "query"), second=S.lexical_overlap, idx=_index_of(spark, d), vectors=_vectors(spark, d))
    return found.withColumns({"score": F.round("score", 6), "similarity": F.round("similarity", 6)})


def _ranked_chunks(spark, d, asked=questions):
    """Fielded results with page and place, written once."""
    return cut(_fielded(spark, d, L.TOP_K, asked).join(_corpus(spark, d).select(F.col("vector_id").alias("id"), "url", "chunk_pos"), "id").withColumnRenamed("id", "vector_id"))


def section_boost(spark, d):
    found = cut(_fielded(spark, d, L.TOP_K)).join(_corpus(spark, d).select(F.col("vector_id").alias("id"), "url"), "id")
    current = found.filter("rank = 0").select("qid", F.col("url").alias("current"))
    scaled = S.min_max(found.withColumn("list", F.lit("sparse"))).join(current, "qid")
    return _out(S.ranked(S.boosted(scaled, [F.when(R.same_section(F.col("url"), F.col("current")), F.lit(L.SECTION_BOOST))]), L.TOP_K, ["qid"]))


def articles_neighbours(spark, d):
    found = A.passages(_ranked_chunks(spark, d), _corpus(spark, d), whole=False)
    return found.select("qid", F.col("article").cast("long").alias("article"), "vector_id", F.round("score", 6).alias("score"), "via_neighbour")


def _articles(spark, d, ranked=None):
    return A.bodies(A.passages(_ranked_chunks(spark, d) if ranked is None else ranked, _corpus(spark, d)), _corpus(spark, d))


def article_bodies(spark, d):
    return _articles(spark, d)


def pack_context(spark, d):
    return A.pack(_articles(spark, d), 4, 3000).select("qid", "article", "url", "tokens", "total")


def extractive_answer(spark, d):
    ranked = _ranked_chunks(spark, d)
    packed = A.pack(_articles(spark, d, ranked), 4, 1 << 60)
    titles = ranked.join(_corpus(spark, d).select("vector_id", F.coalesce(F.nullif("title", F.lit("")), "heading_path", F.lit("Untitled")).alias("title")), "vector_id")
    titles = A.article_order(titles, 4).groupBy("qid", "article").agg(F.min_by("title", "rank").alias("title"))
    return A.answers(A.best_sentences(packed, questions(spark, d).select("qid", "query")), titles)


def focused_search(spark, d):
    """Every question scoped to the page of the first chunk: all of that page's chunks, the found ones first."""
    url = _corpus(spark, d).orderBy("vector_id").first()["url"]
    found = A.page_scope(cut(_fielded(spark, d, L.TOP_K)).withColumnRenamed("id", "vector_id"), _corpus(spark, d), url)
    return found.select("qid", "vector_id", F.round("score", 6).alias("score"), F.col("place").cast("long").alias("place"))


def rerank_head(spark, d):
    found = _fielded(spark, d, L.TOP_K).join(_corpus(spark, d).select(F.col("vector_id").alias("id"), "body"), "id").join(questions(spark, d).select("qid", "query"), "qid")
    return _out(S.rerank(found, S.lexical_overlap(F.col("query"), F.col("body"))))


def refinements(spark, d):
    found = _ranked_chunks(spark, d).join(_corpus(spark, d).select("vector_id", "title", "heading_path"), "vector_id")
    heads = A.article_order(S.min_max(found.withColumn("list", F.lit("s"))).withColumn("score", F.round("score", 9)))
    one = heads.groupBy("qid", "article", "url").agg(F.min_by("title", "rank").alias("title"), F.min_by("heading_path", "rank").alias("heading_path"), F.max("best").alias("similarity"))
    return D.refinements(one).withColumn("place", F.col("place").cast("long"))


def recall_hit_mrr(spark, d):
    """Known-item questions: each chunk's own title of every hundredth id, all chunks with that title being relevant."""
    c = _corpus(spark, d)
    asked = c.filter("vector_id % 100 = 0 and title is not null").select(F.col("vector_id").alias("qid"), F.col("title").alias("query"))
    terms = S.query_terms(asked, "qid", F.col("query"))
    found = S.bm25(_texts(spark, d), terms, L.TOP_K)
    relevant = asked.join(c.select("vector_id", "title"), F.col("query") == F.col("title")).select("qid", F.col("vector_id").alias("id"))
    return E.summary(E.ranks(found.select("qid", "id", "rank"), relevant))


TOK = "list_filter(regexp_split_to_array(lower(coalesce({}, '')), '[^a-z0-9]+'), lambda x: length(x) > 1)"
_C = "c AS (SELECT DISTINCT ON (vector_id) * FROM chunks WHERE vector_id IS NOT NULL)"
_Q = f"q AS (SELECT DISTINCT id AS qid, query FROM query_log WHERE id % 100 = 0 AND query IS NOT NULL), qt AS (SELECT DISTINCT qid, unnest({TOK.format('query')}) AS term FROM q)"


def _index(fields: dict[str, str]) -> str:
    long = " UNION ALL ".join(f"SELECT vector_id AS id, '{f}' AS field, {TOK.format(c)} AS t FROM c" for f, c in fields.items())
    return f"long AS ({long}), p AS (SELECT field, term, id, dl, count(*) AS tf FROM (SELECT id, field, len(t) AS dl, unnest(t) AS term FROM long) GROUP BY ALL), st AS (SELECT field, term, count(*) AS df FROM p GROUP BY ALL), fs AS (SELECT field, count(*) AS n, avg(len(t)) AS avgdl FROM long GROUP BY ALL)"


def _scored(fields: dict[str, str], weights: dict[str, float], k: int, depth: int | None, terms: str = "qt", name: str = "b") -> str:
    w = "CASE field " + " ".join(f"WHEN '{f}' THEN {x}" for f, x in weights.items()) + " END"
    by = f"SELECT qid, field, id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (1 - 0.75 + 0.75 * dl / avgdl))) AS score FROM p JOIN {terms} USING (term) JOIN st USING (field, term) JOIN fs USING (field) GROUP BY ALL"
    cut = f"SELECT * FROM ({by}) QUALIFY row_number() OVER (PARTITION BY qid, field ORDER BY round(score, 9) DESC, id) <= {depth}" if depth else by
    return f"{name} AS (SELECT qid, id, score, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, id) - 1 AS rank FROM (SELECT qid, id, sum(score * {w}) AS score FROM ({cut}) GROUP BY ALL) QUALIFY rank < {k})"


_ALL = {"title": "title", "section": "heading_path", "content": "body"}
_FIELDED = f"WITH {_C}, {_Q}, {_index(_ALL)}, {_scored(_ALL, L.FIELDS, 30, 90)}"
_FIELDED_LOGGED = _FIELDED.replace("WHERE id % 100 = 0 AND query IS NOT NULL", "WHERE id IS NOT NULL AND query IS NOT NULL")
_COS = "e AS (SELECT vec_id AS id, embedding::DOUBLE[] AS v FROM embeddings), dn AS (SELECT a.id AS qid, b.id, round(list_sum(list_transform(list_zip(b.v, a.v), lambda x: x[1] * x[2])), 9) AS score, row_number() OVER (PARTITION BY a.id ORDER BY round(list_sum(list_transform(list_zip(b.v, a.v), lambda x: x[1] * x[2])), 9) DESC, b.id) - 1 AS rank FROM e a, e b WHERE a.id % 100 = 0 QUALIFY rank < 30)"
_FUSE = "lists AS (SELECT qid, 'dense' AS list, id, score, rank, 0.75 AS w FROM dn UNION ALL SELECT qid, 'sparse', id, score, rank, 0.25 FROM b{more}), mm AS (SELECT *, CASE WHEN max(score) OVER g = min(score) OVER g THEN 1 ELSE (score - min(score) OVER g) / (max(score) OVER g - min(score) OVER g) END AS s FROM lists WINDOW g AS (PARTITION BY qid, list)), fu AS (SELECT qid, id, greatest(0, least(1, sum(s * w) / {total})) AS score FROM mm GROUP BY ALL)"
_RANKED = "SELECT qid, id AS vector_id, round(score, 6) AS score, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, id) - 1 AS rank FROM fu"
_STOP = ", ".join("'" + w.replace("'", "''") + "'" for w in L.EXPANSION_STOPWORDS)
_RM3 = f"rm AS (SELECT * FROM (SELECT qid, term, count(*) AS docs, sum(n)::BIGINT AS n FROM (SELECT b.qid, c.vector_id, t.term, count(*) AS n FROM b JOIN c ON c.vector_id = b.id, unnest({TOK.format('c.text')}) t(term) WHERE b.rank < 3 AND length(t.term) >= 3 AND t.term NOT IN ({_STOP}) GROUP BY ALL) x ANTI JOIN qt USING (qid, term) GROUP BY qid, term) QUALIFY row_number() OVER (PARTITION BY qid ORDER BY docs DESC, n DESC, term) <= 10)"
_PAGED = "r AS (SELECT b.*, c.url, c.chunk_pos FROM b JOIN c ON c.vector_id = b.id), ao AS (SELECT *, dense_rank() OVER (PARTITION BY qid ORDER BY first) - 1 AS article FROM (SELECT *, min(rank) OVER (PARTITION BY qid, url) AS first, max(score) OVER (PARTITION BY qid, url) AS best FROM r) QUALIFY article < 8)"
_SEG = "list_filter(string_split(regexp_extract({0}, '^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)', 1), '/'), lambda x: x <> '')"
_HOST = "lower(regexp_extract({0}, '^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1))"
_SAME = f"coalesce({_HOST.format('url')} = {_HOST.format('cur')} AND least(2, len({_SEG.format('url')}), len({_SEG.format('cur')})) > 0 AND list_slice({_SEG.format('url')}, 1, least(2, len({_SEG.format('url')}), len({_SEG.format('cur')}))) = list_slice({_SEG.format('cur')}, 1, least(2, len({_SEG.format('url')}), len({_SEG.format('cur')}))), false)"

SQL = {
    "search_index": f"WITH {_C}, {_index(_ALL)}, x AS (SELECT count(DISTINCT (vector_id, term)) AS n FROM (SELECT vector_id, unnest({TOK.format('text')}) AS term FROM c)) SELECT 'fields' AS part, count(*) AS n FROM p UNION ALL SELECT 'texts', n FROM x UNION ALL SELECT 'vectors', count(*) FROM c",
    "tokenize_tf": f"WITH {_C} SELECT vector_id, term, count(*) AS tf, dl FROM (SELECT vector_id, len(t) AS dl, unnest(t) AS term FROM (SELECT vector_id, {TOK.format('body')} AS t FROM c)) GROUP BY ALL",
    "term_stats": f"WITH {_C}, {_index(_ALL)} SELECT field, term, df FROM st",
    "bm25_topk": f"WITH {_C}, {_Q}, {_index({'content': 'text'})}, {_scored({'content': 'text'}, {'content': 1.0}, 10, None)} SELECT qid, id AS vector_id, round(score, 6) AS score, rank FROM b",
    "fielded_bm25_topk": f"{_FIELDED} SELECT qid, id AS vector_id, round(score, 6) AS score, rank FROM b",
    "cosine_topk": f"WITH {_COS} SELECT qid, id AS vector_id, round(score, 6) AS score, rank FROM dn",
    "rrf_fusion": f"{_FIELDED}, {_COS}, {_FUSE.format(more='', total='1.0')} SELECT qid, id AS vector_id, round(s, 6) AS score, row_number() OVER (PARTITION BY qid ORDER BY round(s, 9) DESC, id) - 1 AS rank FROM (SELECT qid, id, sum(1 / (60.0 + rank + 1)) AS s FROM lists GROUP BY ALL)",
    "hybrid_search": f"{_FIELDED}, {_COS}, {_FUSE.format(more='', total='1.0')} {_RANKED}",
    "rm3_terms": f"{_FIELDED}, {_RM3} SELECT * FROM rm",
    "hybrid_search_rm3": f"{_FIELDED}, {_RM3}, wide AS (SELECT qt.* FROM qt SEMI JOIN rm USING (qid) UNION ALL SELECT qid, term FROM rm), {_scored(_ALL, L.FIELDS, 30, 90, 'wide', 'b2')}, {_COS}, {_FUSE.format(more=' UNION ALL SELECT qid, ' + chr(39) + 'expanded' + chr(39) + ', id, score, rank, 0.1 FROM b2', total='1.1')} {_RANKED}",
    "section_boost": f"{_FIELDED}, r AS (SELECT b.*, c.url FROM b JOIN c ON c.vector_id = b.id), cu AS (SELECT qid, url AS cur FROM r WHERE rank = 0), mm AS (SELECT *, CASE WHEN max(score) OVER g = min(score) OVER g THEN 1 ELSE (score - min(score) OVER g) / (max(score) OVER g - min(score) OVER g) END AS s FROM r JOIN cu USING (qid) WINDOW g AS (PARTITION BY qid)), fu AS (SELECT qid, id, CASE WHEN {_SAME} THEN least(1, s * 1.15) ELSE least(1, s) END AS score FROM mm) {_RANKED}",
    "recall_hit_mrr": f"WITH {_C}, q AS (SELECT vector_id AS qid, title AS query FROM c WHERE vector_id % 100 = 0 AND title IS NOT NULL), qt AS (SELECT DISTINCT qid, unnest({TOK.format('query')}) AS term FROM q), {_index({'content': 'text'})}, {_scored({'content': 'text'}, {'content': 1.0}, 30, None)}, rel AS (SELECT qid, vector_id AS id FROM q JOIN c ON title = query), x AS (SELECT qid, count(DISTINCT rel.id) AS n, min(rank) AS first, count(*) FILTER (rank < 5) AS near FROM rel LEFT JOIN b USING (qid, id) GROUP BY ALL) SELECT count(*) AS questions, round(avg(coalesce((first = 0)::INT, 0)), 6) AS hit_1, round(avg(coalesce((first < 5)::INT, 0)), 6) AS hit_k, round(avg(near / n), 6) AS recall_k, round(avg(coalesce(1 / (first + 1), 0)), 6) AS mrr FROM x",
}
SQL["articles_neighbours"] = f"{_FIELDED}, {_PAGED}, near AS (SELECT DISTINCT qid, article, url, unnest(range(chunk_pos - 2, chunk_pos + 3)) AS chunk_pos FROM ao), h AS (SELECT qid, article, max(best) AS best FROM ao GROUP BY ALL) SELECT n.qid, n.article, c.vector_id, round(coalesce(a.score, h.best), 6) AS score, a.score IS NULL AS via_neighbour FROM near n JOIN c ON c.url = n.url AND c.chunk_pos = n.chunk_pos JOIN h ON h.qid = n.qid AND h.article = n.article LEFT JOIN ao a ON a.qid = n.qid AND a.id = c.vector_id"
SQL["rerank_head"] = f"{_FIELDED}, o AS (SELECT b.*, list_distinct({TOK.format('q.query')}) AS qk, {TOK.format('c.body')} AS bk FROM b JOIN c ON c.vector_id = b.id JOIN q USING (qid)), s AS (SELECT *, CASE WHEN rank < 20 AND len(qk) > 0 THEN len(list_intersect(qk, bk)) / len(qk) END AS s2 FROM o) SELECT qid, id AS vector_id, round(score, 6) AS score, row_number() OVER (PARTITION BY qid ORDER BY rank >= 20, s2 IS NULL, s2 DESC, rank) - 1 AS rank FROM s"
SQL["focused_search"] = f"{_FIELDED}, pg AS (SELECT vector_id, chunk_pos FROM c WHERE url = (SELECT url FROM c ORDER BY vector_id LIMIT 1)) SELECT x.qid, pg.vector_id, round(coalesce(b.score, 0), 6) AS score, row_number() OVER (PARTITION BY x.qid ORDER BY b.rank IS NULL, b.rank, chunk_pos) - 1 AS place FROM (SELECT DISTINCT qid FROM b) x, pg LEFT JOIN b ON b.qid = x.qid AND b.id = pg.vector_id"

_LABEL = "trim(coalesce(nullif(trim(title), ''), string_split(heading_path, ' > ')[-1], ''))"
SQL["refinements"] = (
    f"{_FIELDED}, r AS (SELECT b.*, c.url, c.title, c.heading_path FROM b JOIN c ON c.vector_id = b.id), mm AS (SELECT *, round(CASE WHEN max(score) OVER g = min(score) OVER g THEN 1 ELSE (score - min(score) OVER g) / (max(score) OVER g - min(score) OVER g) END, 9) AS s FROM r WINDOW g AS (PARTITION BY qid)), ar AS (SELECT *, min(rank) OVER (PARTITION BY qid, url) AS first FROM mm),"
    f" hd AS (SELECT qid, url, first, dense_rank() OVER (PARTITION BY qid ORDER BY first) - 1 AS article, list(title ORDER BY rank)[1] AS title, list(heading_path ORDER BY rank)[1] AS heading_path, max(s) AS sim FROM ar GROUP BY qid, url, first QUALIFY article < 8), nm AS (SELECT *, {_LABEL} AS name FROM hd),"
    " lb AS (SELECT *, CASE WHEN length(name) <= 60 THEN name WHEN strpos(reverse(name[:59]), ' ') > 0 AND 59 - strpos(reverse(name[:59]), ' ') > 36 THEN name[:59 - strpos(reverse(name[:59]), ' ')] || '…' ELSE name[:59] || '…' END AS label FROM nm WHERE name <> ''),"
    " u1 AS MATERIALIZED (SELECT * FROM lb QUALIFY row_number() OVER (PARTITION BY qid, lower(label) ORDER BY article) = 1), pl AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY article) AS k FROM u1), ok AS (SELECT qid FROM pl WHERE k <= 3 GROUP BY qid HAVING count(*) = 3 AND max(sim) - min(sim) <= 0.03) SELECT qid, k - 1 AS place, label, url FROM pl SEMI JOIN ok USING (qid) WHERE k <= 3"
)

QUERIES = {f.__name__: f for f in (search_index, tokenize_tf, term_stats, bm25_topk, fielded_bm25_topk, cosine_topk, rrf_fusion, hybrid_search, rm3_terms, hybrid_search_rm3, retrieve, section_boost, articles_neighbours, article_bodies, pack_context, extractive_answer, focused_search, rerank_head, refinements, recall_hit_mrr)}
