"""Corpora and question sets in and out: JSON exports, question lines, keyed tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

CHUNK = "vectorId int, text string, body string, url string, headingPath string, title string, position int, contentHash string"
CORPUS = f"version int, indexId string, host string, root string, embeddingModel string, exportedAt bigint, pageCount int, chunks array<struct<{CHUNK.replace(' ', ':').replace(',:', ',')}>>"
QUESTION = "question string, answerUrls array<string>, mustInclude array<string>, notes string"


def write_chunks(chunks: DataFrame, path: str) -> None:
    """Chunks as JSON lines in order of page and place, in a folder for each index; vectors aren't written."""
    out = chunks.select("index_id", F.col("vector_id").alias("vectorId"), "text", "body", "url", F.col("heading_path").alias("headingPath"), "title", F.col("chunk_pos").alias("position"), F.col("content_hash").alias("contentHash"))
    out.repartitionByRange("index_id", "url").sortWithinPartitions("index_id", "url", "position").write.mode("overwrite").partitionBy("index_id").json(path)


def read_chunks(spark: SparkSession, path: str) -> DataFrame:
    """Chunks that write_chunks wrote, numbered anew from 0 in each index by page and place."""
    raw = spark.read.schema(CHUNK + ", index_id string").json(path)
    n = F.row_number().over(Window.partitionBy("index_id").orderBy("url", "position", "vectorId")) - 1
    return raw.select("index_id", n.cast("long").alias("vector_id"), "text", "body", "url", F.col("headingPath").alias("heading_path"), "title", F.col("position").alias("chunk_pos"), F.col("contentHash").alias("content_hash"))


def read_export(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(corpus, chunks) of whole-corpus JSON files; a file that doesn't parse, or of another version, is refused."""
    whole = spark.read.schema(CORPUS).option("multiLine", True).option("mode", "FAILFAST").json(path)
    corpus = whole.drop("chunks").withColumn("version", F.when(F.col("version") == 1, 1).otherwise(F.raise_error(F.lit("not a corpus of version 1")).cast("int")))
    return corpus, whole.select(F.col("indexId").alias("index_id"), F.explode("chunks").alias("c")).select("index_id", "c.*")


def read_questions(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(questions, errors) of JSON lines; blank ones and those that begin with // are passed over, bad ones reported with the line."""
    lines = spark.read.text(path).select(F.trim("value").alias("line")).filter("line <> '' and not startswith(line, '//')")
    parsed = lines.withColumn("q", F.from_json("line", QUESTION + ", _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}))
    ok = F.col("q._bad").isNull() & (F.coalesce(F.length("q.question"), F.lit(0)) > 0)
    empty = F.array().cast("array<string>")
    good = parsed.filter(ok).select("q.question", F.coalesce("q.answerUrls", empty).alias("answerUrls"), F.coalesce("q.mustInclude", empty).alias("mustInclude"), "q.notes")
    return good, parsed.filter(~ok | ok.isNull()).select("line")


def upserted(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """A keyed table with rows replaced or added."""
    return old.join(new.select(*key), key, "left_anti").unionByName(new, allowMissingColumns=True)


def without_index(df: DataFrame, index_id: str) -> DataFrame:
    return df.filter(~F.col("index_id").eqNullSafe(index_id))


def appended_vectors(old: DataFrame, new: DataFrame, per_shard: int = 5_000) -> DataFrame:
    """(index_id, vector_id, embedding, shard): new embeddings (index_id, ord, embedding) numbered after the old ones of each index."""
    start = old.groupBy("index_id").agg((F.max("vector_id") + 1).alias("s"))
    n = F.row_number().over(Window.partitionBy("index_id").orderBy("ord")) - 1
    more = new.withColumn("n", n).join(start, "index_id", "left").select("index_id", (F.coalesce("s", F.lit(0)) + F.col("n")).cast("long").alias("vector_id"), "embedding")
    return old.select("index_id", "vector_id", "embedding").unionByName(more).withColumn("shard", F.floor(F.col("vector_id") / per_shard))


def diagnostics(log: DataFrame, by: str, most: int = 300) -> DataFrame:
    """The latest entries (at, …) of each key."""
    return log.withColumn("__n", F.row_number().over(Window.partitionBy(by).orderBy(F.desc("at")))).filter(F.col("__n") <= most).drop("__n")
