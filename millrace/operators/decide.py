"""Whether to answer: floors, their calibration, ways to narrow a question down, and sweeps over labelled cases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions import lexicon as L

#: Fixed values of calibration: margin over negatives, span to confident, highest sane floor, and of narrowing down.
MARGIN, SPAN, SANE = 0.08, 0.08, 0.9
LEAST_PAGES, SCATTER, MOST_OPTIONS, LABEL_CHARS = 3, 0.03, 3, 60


def verdict(top: Column, found: Column, refuse: Column, confident: Column, dense: Column | None = None) -> Column:
    """refuse, uncertain or confident. Without results always refuse; without a dense side never better than uncertain."""
    by_score = F.when(~found | (F.coalesce(top, F.lit(0.0)) < refuse), "refuse").when(top >= confident, "confident").otherwise("uncertain")
    return by_score if dense is None else F.when(~dense, F.when(found, "uncertain").otherwise("refuse")).otherwise(by_score)


def quantile(sorted_: Column, q: float) -> Column:
    """Nearest rank, no interpolation, of a sorted array."""
    n = F.size(sorted_)
    return F.when(n > 0, F.get(sorted_, F.least(n - 1, F.floor(n * q)).cast("int")))


#: Bins into which scores are counted when one of them is looked for by its place.
BINS = 4096


def nth(scores: DataFrame, by: str, score: str, wanted: DataFrame) -> DataFrame:
    """(by, name, value): scores by their place from 0 in ascending order, for wanted (by, name, place).

    Scores are counted in bins first, and only those of the bin that holds a place are counted one by one. Both are sums,
    so no group's scores ever come together, however large it is.
    """
    binned = scores.withColumn("bin", F.floor(F.least(F.col(score), F.lit(1.0)) * BINS))
    w = Window.partitionBy(by).orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    bins = binned.groupBy(by, "bin").agg(F.count("*").alias("n")).withColumn("before", F.coalesce(F.sum("n").over(w), F.lit(0)))
    inside = bins.join(wanted, by).filter((F.col("place") >= F.col("before")) & (F.col("place") < F.col("before") + F.col("n"))).select(by, "bin", "name", (F.col("place") - F.col("before")).alias("place"))
    v = Window.partitionBy(by, "name").orderBy(score).rowsBetween(Window.unboundedPreceding, 0)
    few = binned.join(F.broadcast(inside), [by, "bin"]).groupBy(by, "name", "place", score).agg(F.count("*").alias("n")).withColumn("upto", F.sum("n").over(v))
    return few.filter(F.col("upto") > F.col("place")).groupBy(by, "name").agg(F.min(score).alias("value"))


def calibrate(scores: DataFrame, by: str) -> DataFrame:
    """(by, refuse, confident, samples) of scores (by, score, positive): floors from what should and shouldn't be answered.

    With fewer than five usable negatives the usual floors hold; only finite scores above 0 count. The worst negative,
    or from ten on the second worst, and the lowest tenth of the positives are found by place, see nth().
    """
    usable = scores.filter("score > 0 and not isnan(score) and score < double('infinity')").select(by, "score", "positive")
    sizes = scores.select(by).distinct().join(usable.groupBy(by).agg(F.count_if(~F.col("positive")).alias("neg"), F.count_if("positive").alias("pos")), by, "left").na.fill(0, ["neg", "pos"])
    n, m = F.col("neg"), F.col("pos")
    worst = nth(usable.filter(~F.col("positive")), by, "score", sizes.filter("neg > 0").select(by, F.lit("w").alias("name"), F.when(n >= 10, n - 2).otherwise(n - 1).alias("place")))
    low = nth(usable.filter("positive"), by, "score", sizes.filter("pos > 0").select(by, F.lit("l").alias("name"), F.least(m - 1, F.floor(m * 0.1)).alias("place")))
    both = sizes.join(worst.select(by, F.col("value").alias("worst")), by, "left").join(low.select(by, F.col("value").alias("low")), by, "left")
    floor = F.greatest(F.lit(L.REFUSE), F.least(F.col("worst") + MARGIN, F.lit(SANE)))
    refuse = F.when((m >= 5) & (floor > F.col("low")), F.col("low")).otherwise(floor)
    enough = n >= 5
    return both.select(by, F.when(enough, F.round(refuse, 3)).otherwise(L.REFUSE).alias("refuse"), F.when(enough, F.round(F.least(refuse + SPAN, F.lit(SANE + SPAN)), 3)).otherwise(L.CONFIDENT).alias("confident"), n.alias("samples"))


def sweep(cases: DataFrame, floors: list[float]) -> DataFrame:
    """(floor, false_answers, missed_answers, negatives, positives) of cases (top_score, answerable): each case meets each of a few floors."""
    each = cases.select("answerable", F.coalesce("top_score", F.lit(0.0)).alias("s"), F.explode(F.array(*map(F.lit, floors))).alias("floor"))
    yes, no = F.col("answerable"), ~F.col("answerable")
    return each.groupBy("floor").agg(F.count_if(no & (F.col("s") >= F.col("floor"))).alias("false_answers"), F.count_if(yes & (F.col("s") < F.col("floor"))).alias("missed_answers"), F.count_if(no).alias("negatives"), F.count_if(yes).alias("positives"))


def lowest_floor(swept: DataFrame, rate: float = 0.03) -> DataFrame:
    """(floor): the lowest floor at which at most this share of what can't be answered is."""
    return swept.filter((F.col("negatives") == 0) | (F.col("false_answers") <= rate * F.col("negatives"))).agg(F.min("floor").alias("floor"))


def scatter_sweep(cases: DataFrame, deltas: list[float]) -> DataFrame:
    """(delta, asked_needlessly, not_asked) of cases (leading: similarities in order, single_intent)."""
    spread = F.get("leading", F.lit(0)) - F.get("leading", F.size("leading") - 1)
    each = cases.select("single_intent", (spread <= F.col("delta")).alias("asks"), "delta") if "delta" in cases.columns else cases.select("single_intent", spread.alias("spread"), F.explode(F.array(*map(F.lit, deltas))).alias("delta")).withColumn("asks", F.col("spread") <= F.col("delta"))
    return each.groupBy("delta").agg(F.count_if(F.col("asks") & F.col("single_intent")).alias("asked_needlessly"), F.count_if(~F.col("asks") & ~F.col("single_intent")).alias("not_asked"))


def label(title: Column, path: Column) -> Column:
    """A page's name of at most LABEL_CHARS characters, cut at a word beyond 60 % of that."""
    name = F.trim(F.coalesce(F.nullif(F.trim(title), F.lit("")), F.element_at(F.split(path, " > "), -1), F.lit("")))
    cut = F.substring(name, 1, LABEL_CHARS - 1)
    space = F.locate(" ", F.reverse(cut))
    keep = F.when((space > 0) & (F.length(cut) - space > LABEL_CHARS * 0.6), F.substring(cut, F.lit(1), F.length(cut) - space)).otherwise(cut)
    return F.when(F.length(name) <= LABEL_CHARS, name).otherwise(F.concat(keep, F.lit("…")))


def refinements(articles: DataFrame) -> DataFrame:
    """(qid, place, label, url) of articles (qid, article, url, title, heading_path, similarity): up to three pages to
    choose from, if at least three distinct ones lead and are about as similar; none where a similarity is unknown."""
    named = articles.withColumn("label", label(F.col("title"), F.col("heading_path"))).filter("label <> ''")
    for key in ("url", "__l"):
        named = named.withColumn("__l", F.lower("label")).withColumn("__k", F.row_number().over(Window.partitionBy("qid", key).orderBy("article"))).filter("__k = 1").drop("__k")
    w = Window.partitionBy("qid")
    placed = named.withColumn("place", F.row_number().over(w.orderBy("article")) - 1)
    lead = placed.filter(F.col("place") < LEAST_PAGES).groupBy("qid").agg(F.count("*").alias("n"), F.count("similarity").alias("known"), (F.max("similarity") - F.min("similarity")).alias("spread"))
    ask = lead.filter((F.col("n") == LEAST_PAGES) & (F.col("known") == LEAST_PAGES) & (F.col("spread") <= SCATTER))
    return placed.join(ask.select("qid"), "qid", "left_semi").filter(F.col("place") < MOST_OPTIONS).select("qid", "place", "label", "url")


def facets(replies: DataFrame, articles: DataFrame) -> DataFrame:
    """(qid, question, value, url): the choices that a model's reply (qid, reply) offers, each found in the title or path
    of a distinct page (qid, article, url, title, heading_path). If one isn't, or sizes don't fit, all of them go."""
    text = F.trim("reply")
    question = F.trim(F.regexp_extract(text, r"(?i)QUESTION:\s*(.+)", 1))
    options = F.regexp_extract(text, r"(?i)OPTIONS:\s*(.+)", 1)
    values = F.filter(F.transform(F.split(options, r"\|"), lambda v: F.trim(F.regexp_replace(F.trim(v), "^[\"'“”]+|[\"'“”]+$", ""))), lambda v: v != "")
    parsed = replies.select("qid", question.alias("question"), values.alias("v")).filter((F.col("question") != "") & F.col("question").endswith("?") & (F.length("question") <= 80) & F.size("v").between(2, 4) & ~F.exists("v", lambda v: F.length(v) > 40))
    each = parsed.select("qid", "question", F.size("v").alias("n"), F.posexplode("v").alias("place", "value"))
    pages = articles.select("qid", "article", "url", F.lower(F.concat_ws(" ", F.coalesce("title", F.lit("")), F.coalesce("heading_path", F.lit("")))).alias("h"))
    hits = each.join(pages, "qid").filter(F.col("h").contains(F.lower("value"))).groupBy("qid", "question", "n", "place", "value").agg(F.min_by("url", "article").alias("url"))
    whole = hits.groupBy("qid").agg(F.count("*").alias("found"), F.count_distinct("url").alias("pages"), F.max("n").alias("n")).filter("found = n and pages = n").select("qid")
    return hits.join(whole, "qid", "left_semi").select("qid", "question", "value", "url")
