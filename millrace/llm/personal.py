"""Personal data in free text: found by a conditional random field and replaced by typed placeholders."""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.llm.crf import Tagger, words_of
from millrace.llm.labelled import LABELS, examples, tagged
from millrace.session import broadcast_value

#: Rows that the model is trained on, written from the labelled table.
TRAINED_ON = 9000

PIECE = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start_pos", T.IntegerType()), T.StructField("end_pos", T.IntegerType())]))
_AREA = re.compile(r"\(\d{1,4}\)(?=[ .-]?\d)")
_TITLE = re.compile(r"(?:dr|mr|mrs|ms|prof)\.?\s+", re.I)


def fit(n: int = TRAINED_ON) -> Tagger:
    """A model of n rows written from the labelled table; always the same weights. It takes some 20 s in the driver."""
    return Tagger(LABELS).fit([tagged(*x) for x in examples(n)])


def save(tagger: Tagger, path: str) -> None:
    """Weights in a compressed file, so that later runs needn't fit."""
    with open(path, "wb") as f:
        np.savez_compressed(f, weights=tagger.weights, moves=tagger.moves)


def load(path: str) -> Tagger:
    with np.load(path) as kept:
        return Tagger(LABELS, kept["weights"], kept["moves"])


def _exact(text: str, start: int, end: int, kind: str) -> tuple[str, int, int] | None:
    """A decoded piece with its ends as the definition wants them, or None if it can't be one of its kind."""
    digits = sum(c.isdigit() for c in text[start:end])
    if kind == "email":
        return (kind, start, end) if re.search(r"@|\bat\b", text[start:end], re.I) else None
    if kind == "phone":
        while start < end and text[start] == "(" and not _AREA.match(text, start):
            start += 1
        if start and text[start - 1] == "(" and _AREA.match(text, start - 1):
            start -= 1
        return (kind, start, end) if digits >= 6 else None
    if kind == "id_number":
        return (kind, start, end) if digits >= 5 else None
    if kind == "person":
        title = _TITLE.match(text, start, end)
        if re.match(r"\w(?!\w)[^.]", text[start : end + 1]):  # an initial has its full stop
            return None
        return (kind, title.end() if title else start, end) if any(c.isalpha() for c in text[start:end]) else None
    return (kind, start, end) if digits else None


def pieces_of(tagger: Tagger, texts: list[str | None]) -> list[list[tuple[str, int, int]]]:
    cut = [words_of(x) if x else [] for x in texts]
    out = []
    for text, words, tags in zip(texts, cut, tagger.decode([[w for _, w in c] for c in cut])):
        found: list[list] = []
        for (start, word), tag in zip(words, tags.tolist()):
            if not tag:
                found.append([])
                continue
            label = LABELS[tag]
            if label[2:] == "person" and word == "." and found and found[-1] and text[found[-1][2] - 2 : found[-1][2]].isalpha():
                found.append([])  # a sentence ends there; an initial has one letter
                continue
            if label[0] == "I" and found and found[-1] and found[-1][0] == label[2:]:
                found[-1][2] = start + len(word)
            else:
                found.append([label[2:], start, start + len(word), label[0] == "I"])
        # what runs on after a sentence's end is another piece only if it has two words
        found = [x for x in found if x and not (x[0] == "person" and x[3] and " " not in text[x[1] : x[2]])]
        out.append([y for x in found if (y := _exact(text, x[1], x[2], x[0]))])
    return out


def find(df: DataFrame, text: str, name: str = "pieces", model: Tagger | None = None) -> DataFrame:
    """df with a column of pieces (kind, start_pos, end_pos) of the text, positions counted in characters from 0.

    A null or empty text has an empty list. Texts are read whole; rows and other columns stay as they are. The model,
    a loaded one or else one that is fitted now, is broadcast, as its size is fixed. No shuffle.
    """
    tagger = broadcast_value(df.sparkSession, model or fit())
    if name in df.columns:
        df = df.drop(name)

    @F.pandas_udf(PIECE)
    def pieces(texts: pd.Series) -> pd.Series:
        return pd.Series([[{"kind": k, "start_pos": a, "end_pos": b} for k, a, b in x] for x in pieces_of(tagger.value, [t if isinstance(t, str) else None for t in texts])])

    return df.withColumn(name, pieces(F.col(text).cast("string")))


def mask(df: DataFrame, text: str, name: str = "masked", model: Tagger | None = None) -> DataFrame:
    """df with a column in which each piece is replaced by its kind in brackets, such as [email]; the rest stays readable.

    A null text stays null. The replacement is one native expression over the pieces.
    """
    found = find(df, text, "__pieces", model)
    parts = F.expr(
        f"aggregate(__pieces, struct(cast('' as string) as done, 0 as at), (s, p) -> struct(concat(s.done, substring(`{text}`, s.at + 1, p.start_pos - s.at), '[', p.kind, ']') as done, p.end_pos as at), s -> concat(s.done, substring(`{text}`, s.at + 1)))"
    )
    return found.withColumn(name, F.when(F.col(text).isNotNull(), parts)).drop("__pieces")
