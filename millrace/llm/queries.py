"""The queries of the operators for training data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import bisecting, boilerplate, components, distinctive, packing, personal, quality, repeats, similar, tokens
from millrace.sources.tables import one_of_each, table

#: Tokens that one container holds.
CAPACITY = 2048


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    return repeats.find(table(spark, folder, "chunks"), "vector_id", repeats.host_of(F.col("url")), "body")


def p1_clean(spark: SparkSession, folder: str) -> DataFrame:
    return repeats.remove(table(spark, folder, "chunks"), "vector_id", repeats.host_of(F.col("url")), "body")


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    found = similar.pairs(table(spark, folder, "chunks"), "vector_id", "body", words=3, t=0.7, least=20)
    return found.select(F.col("a").alias("vector_id_a"), F.col("b").alias("vector_id_b"))


def p2_classes(spark: SparkSession, folder: str) -> DataFrame:
    return similar.all_classes(table(spark, folder, "chunks"), "vector_id", "body", words=5, t=0.8)


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    pages = one_of_each(table(spark, folder, "pages_raw").select("fetch_id", "html"), "fetch_id")
    return boilerplate.main_blocks(pages, "fetch_id", "html").select("fetch_id", F.md5(F.encode("text", "UTF-8")).alias("block_md5")).distinct()


def _low_questions(spark: SparkSession, folder: str) -> DataFrame:
    """Distinct logged questions that scored low."""
    log = table(spark, folder, "query_log").select("id", "query", "top_score")
    return one_of_each(log.filter("top_score < 0.45 and query is not null"), "id")


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    members, links = similar.similar(_low_questions(spark, folder), "id", "query", words=1, t=0.5, least=4, chain=True)
    low = members.groupBy("set").agg(F.min("key").alias("k"), F.count("*").alias("c"))
    name = low.select("set", "k")
    ends = links.select("a", "b").join(name.withColumnsRenamed({"set": "a", "k": "ka"}), "a").join(name.withColumnsRenamed({"set": "b", "k": "kb"}), "b")
    found = components.components(ends, "ka", "kb")
    own = low.join(found, F.col("k") == F.col("id"), "left").filter("c > 1 or component is not null").select("set", F.coalesce("component", "k").alias("cluster_id"))
    return members.join(own, "set").select("cluster_id", F.col("key").alias("id"))


def p4_groups(spark: SparkSession, folder: str) -> DataFrame:
    return bisecting.groups(_low_questions(spark, folder), "id", "query")


def _questions(spark: SparkSession, folder: str) -> DataFrame:
    """Distinct questions of the log and of the saved conversations, each with its place."""
    log = table(spark, folder, "query_log").select(F.lit("query_log").alias("source_name"), F.col("id").cast("string").alias("row_key"), F.lit(0).alias("turn_no"), F.col("query").alias("text"))
    turns = table(spark, folder, "chat_sessions").select(F.lit("chat_sessions").alias("source_name"), F.col("id").alias("row_key"), F.posexplode("turns.question").alias("turn_no", "text"))
    return log.unionByName(turns).filter("text is not null").distinct()


def p4_members(spark: SparkSession, folder: str) -> DataFrame:
    """The leaf of every low-scored question."""
    return bisecting.members(_low_questions(spark, folder), "id", "query")


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    found = personal.find(_questions(spark, folder), "text")
    return found.select("source_name", "row_key", "turn_no", F.explode("pieces").alias("p")).select("source_name", "row_key", "turn_no", "p.kind", "p.start_pos").distinct()


def p5_masked(spark: SparkSession, folder: str) -> DataFrame:
    return personal.mask(_questions(spark, folder), "text").select("source_name", "row_key", "turn_no", "masked")


def _terms(spark: SparkSession, folder: str, by: str) -> DataFrame:
    return distinctive.best_terms(table(spark, folder, "chunks"), "vector_id", distinctive.joined("title", "heading_path", "body"), by)


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    return _terms(spark, folder, "idf").select("vector_id", "term")


def p6_entropy(spark: SparkSession, folder: str) -> DataFrame:
    return _terms(spark, folder, "entropy")


def p7_ids(spark: SparkSession, folder: str) -> DataFrame:
    return tokens.encode(table(spark, folder, "documents"), "doc_id", "text")


def p7_text(spark: SparkSession, folder: str) -> DataFrame:
    """The texts again, decoded from their ids."""
    return tokens.decode(p7_ids(spark, folder), "doc_id", "ids")


def p8_containers(spark: SparkSession, folder: str) -> DataFrame:
    sizes = tokens.count(table(spark, folder, "documents"), "doc_id", "text")
    return packing.pack(sizes, "doc_id", "n_tokens", CAPACITY)


def _quality(spark: SparkSession, folder: str) -> DataFrame:
    return quality.classify(table(spark, folder, "documents"), "doc_id", "text", table(spark, folder, "doc_labels"), "kind", table(spark, folder, "common_words"))


def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    return _quality(spark, folder).filter("kind <> 'prose'").select("doc_id", "kind")


def p9_statistics(spark: SparkSession, folder: str) -> DataFrame:
    return _quality(spark, folder)


def queries() -> dict:
    return {"p1_found": p1_found, "p1_clean": p1_clean, "p2_found": p2_found, "p2_classes": p2_classes, "p3_found": p3_found, "p4_found": p4_found, "p4_groups": p4_groups, "p4_members": p4_members, "p5_found": p5_found, "p5_masked": p5_masked, "p6_found": p6_found, "p6_entropy": p6_entropy, "p7_ids": p7_ids, "p7_text": p7_text, "p8_containers": p8_containers, "p9_found": p9_found, "p9_statistics": p9_statistics}


_TERMS = """WITH one AS (SELECT vector_id, any_value(concat_ws(' ', coalesce(title, ''), coalesce(heading_path, ''), coalesce(body, ''))) AS x FROM chunks WHERE vector_id IS NOT NULL GROUP BY 1),
tok AS (SELECT vector_id, unnest(regexp_extract_all(lower(x), '[a-z0-9]{2,}')) AS term FROM one),
tf AS (SELECT vector_id, term, count(*) AS tf FROM tok GROUP BY 1, 2),
n AS (SELECT count(*) AS n FROM one),
st AS (SELECT term, count(*) AS df, sum(tf) AS gf, sum(tf * ln(tf)) AS s FROM tf GROUP BY 1),
sc AS (SELECT vector_id, term, round(SCORE, 6) AS score FROM tf JOIN st USING (term), n WHERE df >= 2)
SELECT COLUMNS_OUT FROM (SELECT *, row_number() OVER (PARTITION BY vector_id ORDER BY score DESC, term) AS k FROM sc) WHERE k = 1"""


# white space and the no-break space, lower case, digits as 0
_LINES = (
    "one AS (SELECT vector_id, any_value(url) AS url, any_value(body) AS body FROM chunks WHERE vector_id IS NOT NULL GROUP BY 1),"
    " h AS (SELECT vector_id, body, regexp_replace(lower(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)', 1)), '^www\\.', '') AS host FROM one WHERE body IS NOT NULL AND url IS NOT NULL),"
    " c AS (SELECT vector_id, host, unnest(string_split(body, chr(10))) AS line, generate_subscripts(string_split(body, chr(10)), 1) - 1 AS line_no FROM h WHERE host <> ''),"
    " l AS (SELECT *, regexp_replace(trim(regexp_replace(lower(line), '[\\s\\x{000B}\\x{001C}-\\x{001F}\\x{0085}\\x{00A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}]+', ' ', 'g')), '[0-9]+', '0', 'g') AS form FROM c),"
    " often AS (SELECT host, form FROM l WHERE form <> '' GROUP BY ALL HAVING count(DISTINCT vector_id) >= 10)"
)
# pairs that share a triple, with sets of hashes of triples; the two least of the rarer ones keep the join small
_SIMILAR = (
    "WITH one AS (SELECT vector_id, regexp_extract_all(lower(any_value(body)), '[a-z0-9]{2,}') AS t FROM chunks WHERE vector_id IS NOT NULL AND body IS NOT NULL GROUP BY 1),"
    " g AS (SELECT vector_id, list_distinct(list_transform(range(1, greatest(1, len(t) - 1)), lambda i: hash(t[i] || ' ' || t[i + 1] || ' ' || t[i + 2]))) AS s FROM one),"
    " k AS (SELECT vector_id, s, len(s) AS n FROM g WHERE len(s) >= 20), x AS (SELECT vector_id, n, unnest(s) AS e FROM k), f AS (SELECT e, count(*) AS c FROM x GROUP BY 1),"
    " o AS (SELECT vector_id, n, e, row_number() OVER (PARTITION BY vector_id ORDER BY c, e) AS place FROM x JOIN f USING (e)), p AS (SELECT * FROM o WHERE place <= n - ceil(0.7 * n - 1e-9) + 1),"
    " q AS (SELECT DISTINCT a.vector_id AS va, b.vector_id AS vb FROM p a JOIN p b ON a.e = b.e AND a.vector_id < b.vector_id WHERE least(a.n, b.n) >= 0.7 * greatest(a.n, b.n) - 1e-9),"
    " r AS (SELECT va, vb, len(list_intersect(a.s, b.s)) AS inter, a.n + b.n AS total FROM q JOIN k a ON a.vector_id = va JOIN k b ON b.vector_id = vb)"
    " SELECT va AS vector_id_a, vb AS vector_id_b FROM r WHERE inter >= 0.7 * (total - inter) - 1e-9"
)
_CHAINS = (
    "WITH RECURSIVE l AS (SELECT id, any_value(query) AS query FROM query_log WHERE top_score < 0.45 AND query IS NOT NULL GROUP BY 1), t AS (SELECT id, list_distinct(regexp_extract_all(lower(query), '[a-z0-9]{2,}')) AS s FROM l),"
    " k AS (SELECT id, s FROM t WHERE len(s) >= 4), x AS (SELECT id, len(s) AS n, unnest(s) AS e FROM k), pr AS (SELECT a.id AS u, b.id AS v FROM x a JOIN x b USING (e) GROUP BY a.id, b.id, a.n, b.n HAVING count(*) >= 0.5 * (a.n + b.n - count(*)) - 1e-9 AND a.id <> b.id),"
    " cc(id, c) AS (SELECT DISTINCT u, u FROM pr UNION SELECT pr.v, cc.c FROM cc JOIN pr ON pr.u = cc.id WHERE cc.c < pr.v)"
    " SELECT min(c) AS cluster_id, id FROM cc GROUP BY id"
)


def oracle_sql() -> dict[str, str]:
    return {
        "p7_text": "SELECT doc_id, coalesce(text, '') AS text FROM documents",
        "p1_found": f"WITH {_LINES} SELECT DISTINCT vector_id, line_no::INT AS line_no FROM l JOIN often USING (host, form)",
        "p2_found": _SIMILAR,
        "p4_found": _CHAINS,
        "p6_found": _TERMS.replace("SCORE", "tf * ln(n / df)").replace("COLUMNS_OUT", "vector_id, term"),
        "p6_entropy": _TERMS.replace("SCORE", "ln(1 + tf) * round(1 - (ln(gf) - s / gf) / ln(n), 9)").replace("COLUMNS_OUT", "vector_id, term, score"),
    }
