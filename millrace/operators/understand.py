"""Understanding questions: small talk, questions that lean on the one before, and guards around rewritten ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions import lexicon as L
from millrace.functions import text as X


def intent(query: Column) -> Column:
    """question, greeting, thanks, farewell or acknowledgement. A question mark always makes a question."""
    plain = F.regexp_replace(X.squeeze(F.regexp_replace(F.regexp_replace(F.lower(query), r"(?U)^\s+|\s+$", ""), r"[!.,;:]+$", "")), " +$", "")
    small = (F.size(F.split(plain, " ")) <= L.SMALL_TALK_WORDS) & ~query.contains("?")
    return F.when(small & plain.isin(*L.GREETINGS), "greeting").when(small & plain.isin(*L.THANKS), "thanks").when(small & plain.isin(*L.FAREWELLS), "farewell").when(small & plain.isin(*L.ACKNOWLEDGEMENTS), "acknowledgement").otherwise("question")


def leans_back(query: Column, alone: int = 6) -> Column:
    """Whether a question can't stand alone: it opens like a continuation, or is short and refers to something named before."""
    low = F.regexp_replace(F.lower(F.coalesce(query, F.lit(""))), r"(?U)^\s+|\s+$", "")
    t = X.tokens(low)
    opens = F.greatest(*(F.startswith(low, F.lit(o + " ")) for o in L.FOLLOW_UP_OPENERS))
    return (F.size(t) > 0) & (opens | ((F.size(t) < alone) & F.arrays_overlap(t, X.words(L.REFERENTIAL))))


def resolved(turns: DataFrame, conversation: str, order: str, question: str, carried: int = 4) -> DataFrame:
    """turns with search: the question, followed by up to four telling words of the one before it if it leans on that."""
    before = F.lag(question).over(Window.partitionBy(conversation).orderBy(order))
    extra = F.slice(F.array_except(X.distinctive(before), X.tokens(F.col(question))), 1, carried)
    return turns.withColumn("__x", F.when(leans_back(F.col(question)) & before.isNotNull(), extra)).withColumn("search", F.when(F.size("__x") > 0, F.concat_ws(" ", F.col(question), F.array_join("__x", " "))).otherwise(F.col(question))).drop("__x")


def kept_terms(query: Column) -> Column:
    """What a rewrite must keep, in lower case: quoted phrases, short words in capitals, words with digits, joined words."""
    quoted = F.transform(F.regexp_extract_all(query, F.lit("[\"'“”]([^\"'“”]{2,60})[\"'“”]"), F.lit(1)), lambda x: F.lower(F.trim(x)))
    plain = F.filter(F.transform(F.split(query, r"(?U)\s+"), lambda w: F.regexp_replace(w, r"^[^A-Za-z0-9_\-]+|[^A-Za-z0-9_\-]+$", "")), lambda w: F.length(w) >= 2)
    fixed = F.filter(plain, lambda w: w.rlike("^[A-Z]{2,8}$") | w.rlike("[0-9]") | w.rlike(r"^[A-Za-z0-9_]+[-.][A-Za-z0-9_\-.]+$"))
    return F.array_distinct(F.filter(F.concat(quoted, F.transform(fixed, F.lower)), lambda x: x != ""))


def cleaned(reply: Column) -> Column:
    """The first line of a model's reply without a label in front and quotes around it."""
    first = F.trim(F.coalesce(F.get(F.filter(F.split(reply, "\n"), lambda x: F.trim(x) != ""), F.lit(0)), F.lit("")))
    return F.trim(F.regexp_replace(F.regexp_replace(first, r"(?i)^(query|search|rewritten|output)\s*:\s*", ""), "^[\"'“”]+|[\"'“”]+$", ""))


def rejection(query: Column, rewrite: Column, longest: int = 300, growth: float = 3.0) -> Column:
    """Why a rewrite must not be used, or null: empty, too long, grown too much, a kept term dropped, no word in common."""
    low, own = F.lower(rewrite), X.tokens(rewrite)
    lost = F.get(F.filter(kept_terms(query), lambda t: ~(F.contains(low, t) | F.array_contains(own, t))), F.lit(0))
    said = F.filter(X.tokens(query), lambda t: F.length(t) > 2)
    return (
        F.when(rewrite == "", "empty").when(F.length(rewrite) > longest, "too long").when(F.length(rewrite) > F.length(query) * growth, "grown too much")
        .when(lost.isNotNull(), F.concat(F.lit("dropped: "), lost)).when((F.size(said) > 0) & ~F.arrays_overlap(said, own), "no word in common")
    )


def planned(turns: DataFrame, question: str, search: str, reply: str) -> DataFrame:
    """turns with plan and source: the model's rewrite where it passes all guards, else the resolved question."""
    new = cleaned(F.col(reply))
    good = F.col(reply).isNotNull() & rejection(F.col(question), new).isNull()
    return turns.withColumn("plan", F.when(good, new).otherwise(F.col(search))).withColumn("source", F.when(good, "model").when(F.col(search) != F.col(question), "followup").otherwise("raw"))


def combined(reply: Column) -> Column:
    """(query, passage) of a reply that should name both. Without any label all of it is the query; with only the
    passage's, what stands before that."""
    text = F.regexp_replace(F.coalesce(reply, F.lit("")), r"(?U)^\s+|\s+$", "")
    bare = lambda c: F.regexp_replace(c, r"(?U)^\s+|\s+$", "")
    passage = bare(F.regexp_extract(text, r"(?is)PASSAGE:\s*(.+)", 1))
    named = bare(F.regexp_extract(text, r"(?i)QUERY:\s*(.+)", 1))
    before = bare(F.regexp_extract(text, r"(?is)^(.*?)PASSAGE:", 1))
    return F.struct(F.when(named != "", named).when(passage == "", text).otherwise(before).alias("query"), passage.alias("passage"))


def dense_text(query: Column, passage: Column, most: int = 600) -> Column:
    """What is embedded: the question, and below it a passage that a model wrote as if it answered it."""
    return F.when(F.trim(F.coalesce(passage, F.lit(""))) == "", query).otherwise(F.concat(query, F.lit("\n\n"), F.substring(F.trim(passage), 1, most)))
