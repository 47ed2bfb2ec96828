"""How characteristic a term is of one record among all.

Log-entropy weighting: the logarithm of a term's local frequency times one minus the normalised entropy of its spread
over the records. Both that and the plain tf * ln(N / df) need the same two aggregations: frequencies within each
record, and over the records for each term. The first never leaves its record, so it needs no shuffle; the second is
summed within each batch before its shuffle.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions.spans import pieces, run_starts, tokens
from millrace.session import broadcast_value, cut
from millrace.sources.tables import one_of_each

#: A term found in at least this share of the records is common. There are at most (mean distinct terms of a record) / SHARE of them.
SHARE = 1 / 2000


def joined(*parts: str) -> Column:
    """Columns joined by spaces, null as empty."""
    return F.concat_ws(" ", *(F.coalesce(F.col(p).cast("string"), F.lit("")) for p in parts))


def _frequencies(texts: pa.Array):
    """Of each distinct term of each text: text number, hash, frequency, start and end; and the spans."""
    spans, doc, start, end = tokens(texts)
    key = spans.hash(start, end)
    order = np.lexsort((key, doc))
    doc, key, start, end = doc[order], key[order], start[order], end[order]
    at = run_starts(doc, key)
    return spans, doc[at], key[at], np.diff([*at, len(doc)]), start[at], end[at]


def term_statistics(df: DataFrame, text: str) -> DataFrame:
    """(term, df, gf, s): in how many rows of df a term is found, how often in all, and the sum of tf * ln(tf)."""

    def run(batches):
        for batch in batches:
            for part in pieces(batch, 0):
                spans, _, key, tf, start, end = _frequencies(part.column(0))
                order = np.argsort(key, kind="stable")
                key, tf = key[order], tf[order]
                at = run_starts(key)
                some = order[at]
                terms = [spans.text(a, b) for a, b in zip(start[some].tolist(), end[some].tolist())]
                sums = (np.diff([*at, len(key)]), *(np.add.reduceat(x, at) if len(at) else x for x in (tf, tf * np.log(tf))))
                yield pa.RecordBatch.from_arrays([pa.array(terms, pa.string()), *(pa.array(x, t) for x, t in zip(sums, (pa.int64(), pa.int64(), pa.float64())))], ["term", "df", "gf", "s"])

    own = df.select(F.col(text).cast("string"))
    return own.mapInArrow(run, "term string, df long, gf long, s double").groupBy("term").agg(F.sum("df").alias("df"), F.sum("gf").alias("gf"), F.sum("s").alias("s"))


def log_entropy(n: int) -> Column:
    """One minus the normalised entropy of a term's spread over n records: 1 where one record has all of it."""
    return F.lit(1.0) if n < 2 else F.round(1 - (F.log("gf") - F.col("s") / F.col("gf")) / F.lit(math.log(n)), 9)


def best_terms(df: DataFrame, key: str, text: Column, by: str = "idf", least_df: int = 2) -> DataFrame:
    """(key, term, score): the most characteristic term of each distinct key among terms of at least least_df keys.

    by "idf": tf * ln(N / df). by "entropy": ln(1 + tf) times the log-entropy weight. Scores are rounded to 6 decimals;
    ties go to the alphabetically first term. N counts all distinct keys, those with empty texts too. Keys without such
    a term have no row; rows with a null key are left out; of rows with one key, one counts.

    The weights of common terms are broadcast, as SHARE bounds their number; postings of all other terms are joined by
    term. No term's postings exceed the share of the records there, so no join partition is hot.
    """
    rows = one_of_each(df.select(F.col(key).alias("key"), text.alias("text")), "key").select("key", "text")
    n = rows.select("key").count()
    weight = F.log(F.lit(float(n)) / F.col("df")) if by == "idf" else log_entropy(n)
    terms = cut(term_statistics(rows, "text").filter(F.col("df") >= least_df).select("term", "df", weight.alias("weight")))
    common = terms.filter(F.col("df") >= max(least_df, n * SHARE)).select("term", "weight").toArrow()
    spans, doc, start, end = tokens(common.column("term").combine_chunks())
    known = spans.hash(start, end)
    order = np.argsort(known)
    table = broadcast_value(df.sparkSession, (known[order], common.column("weight").to_numpy()[doc][order]))
    local = (lambda tf: tf) if by == "idf" else np.log1p
    schema = T.StructType([T.StructField("key", df.schema[key].dataType), T.StructField("term", T.StringType()), T.StructField("tf", T.IntegerType()), T.StructField("weight", T.DoubleType())])

    def run(batches):
        hashes, weights = table.value
        for batch in batches:
            for part in pieces(batch, 1):
                spans, doc, key_, tf, start, end = _frequencies(part.column(1))
                at = np.searchsorted(hashes, key_)
                at[at == len(hashes)] = 0
                hit = hashes[at] == key_ if len(hashes) else np.zeros(len(key_), bool)
                w = np.where(hit, weights[at] if len(hashes) else 0.0, np.nan)
                score = local(tf) * w
                best = np.full(part.num_rows, -np.inf)
                np.maximum.at(best, doc[hit], score[hit])
                # of the common terms, those that rounding could make the best; all others are weighed later
                keep = np.flatnonzero(~hit | (score >= best[doc] - 1e-5))
                texts = [spans.text(a, b) for a, b in zip(start[keep].tolist(), end[keep].tolist())]
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(doc[keep])), pa.array(texts, pa.string()), pa.array(tf[keep], pa.int32()), pa.array(w[keep], pa.float64(), mask=~hit[keep])], ["key", "term", "tf", "weight"])

    found = rows.mapInArrow(run, schema)
    rare = found.filter("weight is null").select("key", "term", "tf").join(terms, "term").select("key", "term", "tf", "weight")
    score = F.round((F.col("tf") if by == "idf" else F.log1p("tf")) * F.col("weight"), 6)
    best = found.filter("weight is not null").unionByName(rare).select("key", F.struct((-score).alias("s"), "term").alias("b")).groupBy("key").agg(F.min("b").alias("b"))
    return best.select(F.col("key").alias(key), F.col("b.term").alias("term"), (-F.col("b.s")).alias("score"))
