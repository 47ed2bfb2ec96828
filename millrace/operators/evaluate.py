"""Measures of retrieval and answers over labelled questions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions import text as X


def ranks(found: DataFrame, relevant: DataFrame) -> DataFrame:
    """(qid, first, hits, n) of found (qid, id, rank) and relevant (qid, id): the first relevant rank, ranks found, and how many there are."""
    n = relevant.groupBy("qid").agg(F.count_distinct("id").alias("n"))
    hits = found.join(relevant.distinct(), ["qid", "id"]).groupBy("qid").agg(F.min("rank").alias("first"), F.sort_array(F.collect_list("rank")).alias("hits"))
    return n.join(hits, "qid", "left")


def summary(ranked: DataFrame, k: int = 5) -> DataFrame:
    """One row: questions, hit@1, hit@k, recall@k and mean reciprocal rank of the output of ranks()."""
    near = F.coalesce(F.size(F.filter("hits", lambda r: r < k)), F.lit(0))
    return ranked.agg(F.count("*").alias("questions"), F.round(F.avg((F.col("first") == 0).cast("double")), 6).alias("x"), F.round(F.avg(F.coalesce((F.col("first") == 0).cast("double"), F.lit(0.0))), 6).alias("hit_1"), F.round(F.avg(F.coalesce((F.col("first") < k).cast("double"), F.lit(0.0))), 6).alias("hit_k"), F.round(F.avg(F.greatest(near, F.lit(0)) / F.col("n")), 6).alias("recall_k"), F.round(F.avg(F.coalesce(1 / (F.col("first") + 1), F.lit(0.0))), 6).alias("mrr")).drop("x")


def missing_phrases(answer: Column, phrases: Column) -> Column:
    """The phrases that an answer should hold and doesn't, in the form for matching."""
    hay = X.for_match(F.coalesce(answer, F.lit("")))
    return F.filter(phrases, lambda p: (X.for_match(p) == "") | ~F.contains(hay, X.for_match(p)))


def coverage(answer: Column, phrases: Column) -> Column:
    """Share of the phrases found; 1 if none is asked for."""
    return F.when(F.size(phrases) == 0, 1.0).otherwise(1 - F.size(missing_phrases(answer, phrases)) / F.size(phrases))


def article_name(url: Column) -> Column:
    """A URL as a labeller means it: host, path and query in lower case, without scheme and trailing slashes."""
    whole = F.concat(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.regexp_replace(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.\-]*://[^/?#]*([^?#]*)", 1), "/+$", ""), F.regexp_extract(url, r"(\?[^#]*)", 1))
    return F.lower(F.when(url.rlike("^[a-zA-Z][a-zA-Z0-9+.-]*://"), whole).otherwise(F.trim(url)))


def judged(cases: DataFrame, floor: float) -> DataFrame:
    """Cases with first_rank (from 1), answered, context_ratio, answer_ratio and missing.

    cases has expected and retrieved (URLs, the latter in order), top_score, refused (of a generated answer, or null),
    context, answer and phrases. Without an answer, what clears the floor counts as answered and the context as its text.
    """
    wanted = F.transform("expected", article_name)
    hit = F.array_position(F.transform(F.transform("retrieved", article_name), lambda u: F.array_contains(wanted, u)), F.lit(True))
    clears = (F.size("retrieved") > 0) & (F.coalesce("top_score", F.lit(0.0)) >= floor)
    text = F.when(clears & F.col("answer").isNotNull(), F.col("answer")).otherwise(F.col("context"))
    return cases.withColumns({
        "first_rank": F.when(hit > 0, hit), "answered": clears & ~F.coalesce("refused", F.lit(False)), "context_ratio": coverage(F.col("context"), F.col("phrases")),
        "answer_ratio": coverage(text, F.col("phrases")), "missing": missing_phrases(text, F.col("phrases")),
    })


def report(cases: DataFrame, ks: tuple[int, ...] = (1, 3, 5)) -> DataFrame:
    """One row over judged cases with answerable: hits at each k, reciprocal rank, false and missed answers, coverages."""
    yes, no = F.col("answerable"), ~F.col("answerable")
    mean = lambda value, of: F.round(F.coalesce(F.sum(F.when(of, value)) / F.nullif(F.count_if(of), F.lit(0)), F.lit(0.0)), 6)
    n = lambda c: c.cast("double")
    hits = [mean(n(F.coalesce(F.col("first_rank") <= k, F.lit(False))), yes).alias(f"hit_{k}") for k in ks]
    return cases.agg(
        F.count_if(yes).alias("answerable"), F.count_if(no).alias("unanswerable"), *hits, mean(F.coalesce(1 / F.col("first_rank"), F.lit(0.0)), yes).alias("mrr"), mean(n(F.col("answered")), no).alias("false_answers"),
        mean(n(F.col("first_rank").isNotNull() & ~F.col("answered")), yes).alias("missed_answers"), mean(F.col("context_ratio"), yes).alias("context_coverage"), mean(F.col("answer_ratio"), yes).alias("answer_coverage"),
    )


def most_missed(cases: DataFrame, most: int = 10) -> DataFrame:
    """(phrase, misses): what answers to answerable questions lack most often; a top list."""
    return cases.filter("answerable").select(F.explode("missing").alias("phrase")).groupBy("phrase").agg(F.count("*").alias("misses")).orderBy(F.desc("misses"), "phrase").limit(most)


def turn_report(turns: DataFrame) -> DataFrame:
    """One row of turns (outcome: answer, refusal or blocked; refinements): how many, and the shares that were blocked and refined."""
    share = lambda c: F.round(F.coalesce(F.count_if(c) / F.nullif(F.count("*"), F.lit(0)), F.lit(0.0)), 6)
    return turns.agg(F.count("*").alias("n"), share(F.col("outcome") == "blocked").alias("blocked_rate"), share((F.col("outcome") == "answer") & (F.col("refinements") > 0)).alias("refine_rate"))


def gate(measures: DataFrame, recall: float = 0.85, false_rate: float = 0.03) -> DataFrame:
    """measures (recall_k, false_answers, blocked) with passed."""
    return measures.withColumn("passed", (F.col("recall_k") >= recall) & (F.col("false_answers") <= false_rate) & (F.col("blocked") == 0))
