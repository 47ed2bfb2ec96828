"""Native text expressions."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from millrace.functions import lexicon as L


def tokens(text: Column) -> Column:
    """Runs of a-z and 0-9 of two or more characters in the lower-cased text; none for null."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]+"), lambda x: F.length(x) > 1)


def squeeze(text: Column) -> Column:
    """White space, no-break and zero-width spaces included, as one space; ends trimmed."""
    return F.trim(F.regexp_replace(text, r"(?U)[\s\x{FEFF}]+", " "))


def words(list_: list[str]) -> Column:
    return F.array(*(F.lit(x) for x in list_))


def distinctive(text: Column, least: int = L.TERM_LENGTH) -> Column:
    """Distinct tokens in order of first occurrence, without short ones and filler."""
    return F.array_distinct(F.filter(tokens(text), lambda x: (F.length(x) >= least) & ~x.isin(*L.QUESTION_STOPWORDS, *L.REFERENTIAL)))


def chunk_tokens(text: Column) -> Column:
    """Estimated tokens of a text: by words or by characters, whichever is more."""
    t = squeeze(F.coalesce(text, F.lit("")))
    return F.when(t == "", 0).otherwise(F.greatest(F.ceil(F.size(F.split(t, " ")) / 0.75), F.ceil(F.length(t) / 6))).cast("long")


def billing_tokens(text: Column) -> Column:
    return F.ceil(F.length(text) / 4).cast("long")


def mask(text: Column, kinds: tuple[str, ...] | None = None) -> Column:
    """Personal data of fixed forms replaced by placeholders, the more specific forms first."""
    chosen = [(p, label) for kind, p, label in L.MASKS if kinds is None or kind in kinds]
    return reduce(lambda c, m: F.regexp_replace(c, L.java(m[0]), F.lit(m[1])), chosen, text)


def jaccard(a: Column, b: Column) -> Column:
    """Overlap of two token arrays as sets; 1 where both are empty."""
    both = F.size(F.array_union(a, b))
    return F.when(both == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / both)


def for_match(text: Column) -> Column:
    """The form in which phrases are looked for: lower case, straight quotes, no emphasis marks, single spaces."""
    return squeeze(F.regexp_replace(F.translate(F.lower(text), "‘’“”", "''\"\""), r"[*_`#>]", ""))


def sentences(text: Column, terminators: str = ".!?") -> Column:
    """Trimmed sentences: up to and with their closing marks, or the unclosed rest."""
    found = F.regexp_extract_all(text, F.lit(rf"[^{terminators}]+[{terminators}]+|\S[^{terminators}]*$"), F.lit(0))
    return F.filter(F.transform(found, lambda x: F.regexp_replace(x, r"(?U)^\s+|\s+$", "")), lambda x: x != "")


def fnv_of(text: str) -> str:
    """32-bit FNV-1a over UTF-16 units, eight hex digits."""
    h = 2166136261
    for unit in np.frombuffer(text.encode("utf-16-le", "surrogatepass"), "<u2").tolist():
        h = (h ^ unit) * 16777619 & 0xFFFFFFFF
    return f"{h:08x}"


@F.pandas_udf(StringType())
def fnv1a(texts: pd.Series) -> pd.Series:
    """FNV-1a of each text, null for null. All texts of a batch advance together, one unit at a time, longest first."""
    coded = [np.frombuffer(x.encode("utf-16-le", "surrogatepass"), "<u2") if isinstance(x, str) else None for x in texts]
    order = sorted((k for k in range(len(coded)) if coded[k] is not None), key=lambda k: -len(coded[k]))
    if not order:
        return pd.Series([None] * len(coded), dtype=object)
    sizes = np.array([len(coded[k]) for k in order])
    flat, start = np.concatenate([coded[k] for k in order]).astype(np.uint64), np.concatenate([[0], np.cumsum(sizes)[:-1]])
    h = np.full(len(order), 2166136261, np.uint64)
    alive = len(order)
    for t in range(int(sizes[0])):
        while alive and sizes[alive - 1] <= t:
            alive -= 1
        if alive < 4:  # a few long texts are faster one by one
            break
        h[:alive] = ((h[:alive] ^ flat[start[:alive] + t]) * np.uint64(16777619)) & np.uint64(0xFFFFFFFF)
    else:
        t = int(sizes[0])
    for j in range(alive):
        x = int(h[j])
        for unit in flat[start[j] + t : start[j] + sizes[j]].tolist():
            x = (x ^ unit) * 16777619 & 0xFFFFFFFF
        h[j] = x
    out = [None] * len(coded)
    for k, x in zip(order, h.tolist()):
        out[k] = f"{x:08x}"
    return pd.Series(out, dtype=object)
