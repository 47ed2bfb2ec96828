"""Queries through the entry points: an index built from the fetches, its refresh, and questions answered from it."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace import api
from millrace.functions import text as X
from millrace.operators import logs
from millrace.plans import log_queries as Q
from millrace.plans import search_queries as S
from millrace.plans.crawl_queries import pages
from millrace.sources.tables import table


def build_index(spark, d):
    return api.build_index(pages(spark, d), "all")["chunks"]


def built_pages(spark, d):
    return api.build_index(pages(spark, d), "all")["pages"]


def _answers(spark, d, **how):
    """Answers to all logged questions."""
    return api.answer(S._corpus(spark, d), S.logged(spark, d).select("qid", "query"), 0.2, 0.4, idx=S._index_of(spark, d), vectors=S._vectors(spark, d), **how)


def focused_answers(spark, d):
    """Every question answered from the page of the first chunk."""
    url = S.chunks(spark, d).filter("url is not null").orderBy("vector_id").first()["url"]
    return _answers(spark, d, focus=url, brief=True)


def answer_events(spark, d):
    return api.answer_events(_answers(spark, d))


def finalized(spark, d):
    done = api.finalize(S.chunks(spark, d))
    return done["stats"].join(done["floors"], "index_id", "left")


def answer_batch(spark, d):
    return _answers(spark, d).select("qid", "outcome", "certainty", "top_score", "answer", F.size("sources").alias("n_sources"))


def due_refresh(spark, d):
    return api.due_indexes(table(spark, d, "site_indexes"), Q.NOW, 30).select("index_id", "last_indexed_at")


def index_floors(spark, d):
    return api.floors_for(table(spark, d, "site_indexes"), Q.calibrate_floors(spark, d)).select("index_id", "refuse", "confident")


def seeded_sample(spark, d):
    """A sampling operator: 100 questions in an order that only the seed decides."""
    return api.sample(Q.log(spark, d).filter("query is not null"), "id", 100, 7).select("id")


def answer_keys(spark, d):
    key = logs.answer_key(F.col("index_id"), F.lower(X.squeeze(F.col("query"))), F.lit("v1"))
    return Q.log(spark, d).filter("query is not null").select("id", key.alias("key"))


_FLOORS = Q.SQL["calibrate_floors"]

def _fnv(text: str) -> str:
    """FNV-1a over UTF-16 units in SQL."""
    units = f"flatten(list_transform(string_split({text}, ''), lambda ch: CASE WHEN ch = '' THEN []::BIGINT[] WHEN unicode(ch) > 65535 THEN [55296 + ((unicode(ch) - 65536) >> 10), 56320 + ((unicode(ch) - 65536) & 1023)]::BIGINT[] ELSE [unicode(ch)]::BIGINT[] END))"
    return f"lower(lpad(to_hex(list_reduce(list_concat([2166136261::BIGINT], {units}), lambda h, u: (xor(h, u) * 16777619) & 4294967295)), 8, '0'))"


_PLAIN_QUERY = "lower(trim(regexp_replace(query, '[\\s\\x{00A0}\\x{FEFF}\\x{2000}-\\x{200A}\\x{202F}\\x{3000}]+', ' ', 'g')))"

SQL = {
    "answer_keys": f"WITH {Q._LOG}, k AS (SELECT id, {_fnv('index_id')} AS a, index_id, {_PLAIN_QUERY} AS q FROM l WHERE query IS NOT NULL) SELECT id, {_fnv('index_id || chr(0) || q || chr(0) || ' + chr(39) + 'v1' + chr(39))} AS key FROM k",
    "due_refresh": f"SELECT index_id, last_indexed_at FROM site_indexes WHERE {Q.NOW} - last_indexed_at >= {30 * 86400000}",
    "index_floors": f"SELECT s.index_id, coalesce(c.refuse, 0.7) AS refuse, coalesce(c.confident, 0.8) AS confident FROM site_indexes s LEFT JOIN ({_FLOORS}) c USING (index_id)",
}

QUERIES = {f.__name__: f for f in (build_index, built_pages, answer_batch, due_refresh, index_floors, seeded_sample, answer_keys, focused_answers, answer_events, finalized)}
