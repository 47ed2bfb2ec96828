"""Statistics of a text's quality, and rules learnt from judgements that tell prose from lists, tables and junk."""

from __future__ import annotations

import random
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions.spans import Spans, U, mix, pieces, run_starts
from millrace.session import broadcast_value

#: Name and meaning of each statistic. Shares of lines are by their characters; an inline "•" begins a line too.
STATISTICS = {
    "n_words": "words: runs of letters, digits and marks inside words",
    "mean_word": "mean characters of a word",
    "symbols": "share of characters that are neither letters, digits nor white space",
    "digits": "share of characters that are digits",
    "ended": "share of lines that end in a full stop, question or exclamation mark, colon or the like",
    "common": "share of words that are common words of some language",
    "running": "share of lines with as many common words, or as much of a script without spaces, as sentences have",
    "bullets": "share of lines that begin with a bullet or number",
    "cells": "share of lines cut into cells: by tabs, bars, tags, wide gaps, or commas and semicolons without spaces",
    "shorts": "share of lines of at most SHORT words that aren't running, nor cut into cells",
    "listed": "share of lines that begin with a bullet or are short, and aren't running nor cut into cells",
    "neither": "share of lines that aren't running, listed or cut into cells",
    "line_words": "mean words of a line",
    "garbled": "share of characters in sequences that decoding in the wrong way leaves",
    "fresh": "share of three words in a row that didn't come before in the text",
    "top": "share of the text's most frequent word among its words, from 20 words on",
    "longest": "characters of the longest word",
}
#: Words of a short line; the share of common words from which a line counts as running, and from which it does if it
#: ends as sentences do; characters a word from which a line is no item of a list.
SHORT, RUNNING, ENDED, LONG = 9, 0.2, 0.07, 12

_KIND = np.zeros(256, np.uint8)  # 1 letter or part of one, 2 digit, 3 white space, 0 other
_KIND[list(range(65, 91)) + list(range(97, 123)) + list(range(128, 256))] = 1
_KIND[48:58] = 2
_KIND[[9, 10, 11, 12, 13, 32]] = 3


def _share(part: np.ndarray, whole: np.ndarray) -> np.ndarray:
    return np.where(whole > 0, part / np.maximum(whole, 1), 0.0)


def _measure(texts: pa.Array, common: np.ndarray) -> dict[str, np.ndarray]:
    rows = len(texts)
    texts = pc.replace_substring(pc.replace_substring(pc.fill_null(texts, ""), " ", " "), "•", "\n•")
    s = Spans(pc.utf8_lower(texts))
    b, n = s.bytes, len(s.bytes)
    if not n:
        return {k: np.zeros(rows) for k in STATISTICS}
    kind = _KIND[b]
    char = (b & 0xC0) != 0x80  # the first byte of each character
    doc = np.repeat(np.arange(rows), np.diff(s.at))
    wide = (b >= 0xE3) & (b <= 0xED)  # first bytes of kana, han and hangul
    # general punctuation and full-width marks begin with E2 or E3 80 and EF; they are no letters
    mark = ((b == 0xE2) & (np.append(b[1:], 0) == 0x80)) | ((b == 0xE3) & (np.append(b[1:], 0) == 0x80)) | (b == 0xEF)
    other = mark.copy()
    other[1:] |= mark[:-1]
    other[2:] |= mark[:-2]
    kind[other] = 0
    wide &= ~mark

    # lines
    newline = b == 10
    first = np.zeros(n, bool)
    first[s.at[:-1][s.at[:-1] < n]] = True
    first[1:] |= newline[:-1]
    line = np.cumsum(first) - 1
    start = np.flatnonzero(first)
    of = doc[start]
    lines = len(start)
    per = lambda x: np.bincount(line[x], minlength=lines)
    solid = kind != 3
    chars = per(char & solid)
    # words: letters and digits, with marks inside
    wordy = (kind == 1) | (kind == 2)
    inner = np.zeros(n, bool)
    inner[1:-1] = ((b[1:-1] == 39) | (b[1:-1] == 45) | (b[1:-1] == 46)) & wordy[:-2] & wordy[2:] if n > 2 else False
    wordy |= inner
    begins = wordy & ~np.append(False, wordy[:-1])
    ends = wordy & ~np.append(wordy[1:], False)
    edge = s.at[1:-1]
    edge = edge[(edge > 0) & (edge < n)]
    begins[edge] |= wordy[edge]
    ends[edge - 1] |= wordy[edge - 1]
    ws, we = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    wh, wd, wl = s.hash(ws, we), doc[ws], line[ws]
    seen = np.concatenate([[0], np.cumsum(char)])
    long = seen[we] - seen[ws]
    hit = common[np.minimum(np.searchsorted(common, wh), len(common) - 1)] == wh if len(common) else np.zeros(len(wh), bool)
    words, hits = np.bincount(wl, minlength=lines), np.bincount(wl[hit], minlength=lines)
    wides = per(wide)
    running = (hits >= RUNNING * np.maximum(words, 1)) & (words >= 2) | (wides >= 0.3 * np.maximum(chars, 1))
    # the first solid character of each line, and what follows it
    where = np.flatnonzero(solid & char)
    f = where[run_starts(line[where])] if len(where) else where
    fl = line[f]
    after = np.append(b, [10, 10, 10, 10])
    bullet = np.isin(b[f], [42, 43, 45]) & (after[f + 1] == 32) | (b[f] == 0xE2) & (after[f + 1] == 0x80) & (after[f + 2] == 0xA2)
    digit = kind[f] == 2
    d1 = (after[f + 1] == 46) | (after[f + 1] == 41)
    d2 = np.isin(after[f + 1], range(48, 58)) & np.isin(after[f + 2], [46, 41])
    d3 = np.isin(after[f + 1], range(48, 58)) & np.isin(after[f + 2], range(48, 58)) & np.isin(after[f + 3], [46, 41])
    bullet |= digit & (d1 & (after[f + 2] == 32) | d2 & (after[f + 3] == 32) | d3 & (after[np.minimum(f + 4, n)] == 32))
    bullets = np.zeros(lines, bool)
    bullets[fl] = bullet
    # cells
    b1 = np.append(b[1:], 10)
    b2 = np.append(b1[1:], 10)
    tight = (b == 44) & (b1 != 32)
    semi = (b == 59) & (b1 != 32)
    loose = per((b == 44) & (b1 == 32)) + per((b == 59) & (b1 == 32))
    gap = (b == 32) & (b1 == 32) & (b2 != 32) & (b2 != 10)
    gap[f[f > 0] - 1] = False
    gap[f[f > 1] - 2] = False
    # a field between two separators has few words
    tags = per((b == 60) & (b1 == 116) & (b2 == 100))
    # code has brackets between its commas and semicolons, rows have not
    brackets = per((b == 123) | (b == 125) | (b == 40) | (b == 41))
    fields = np.maximum.reduce([per(tight), per(semi), per(b == 124), per(gap) + per((b == 9) & np.append(solid[1:], False) & ~first), tags])
    cells = (fields >= 2) & (words <= np.where(tags >= 2, 4, 2) * fields + 4) & (brackets < 0.5 * fields) & (loose <= fields) & ((hits < 0.35 * np.maximum(words, 1)) | (per(b == 124) >= 2))
    # the last solid character
    last = np.full(lines, -1)
    solids = np.flatnonzero(solid)
    last[line[solids]] = solids
    lastb = np.where(last >= 0, b[np.maximum(last, 0)], 0)
    ended = np.isin(lastb, [33, 46, 58, 63]) | (last >= 2) & (b[np.maximum(last - 2, 0)] == 0xE3) & (b[np.maximum(last - 1, 0)] == 0x80) & (lastb == 0x82) | (last >= 2) & (b[np.maximum(last - 2, 0)] == 0xE2) & (b[np.maximum(last - 1, 0)] == 0x80) & (lastb == 0xA6)
    running |= ended & (words >= 6) & (hits >= ENDED * words) & (hits > 0)
    running &= ~cells & ((words > SHORT) | (hits >= 2) | (wides > 0)) & ~(bullets & (words <= SHORT) & (wides == 0) & (hits < 0.4 * words))
    # items of a list differ: a line that repeats the one before isn't one
    text = s.hash(start, np.append(start[1:], n))
    again = np.append(False, (text[1:] == text[:-1]) & (of[1:] == of[:-1]))
    shorts = (words <= SHORT) & (words > 0) & ~running & ~cells & (chars < LONG * words) & ~again
    listed = (bullets & ~again | shorts) & ~running & ~cells
    # two-byte letters that begin with C3 83, C3 82, C2 80-9F and the like come from reading UTF-8 in the wrong way
    odd = (b == 0xC3) & ((b1 & 0xFE) == 0x82) | (b == 0xC3) & (b1 == 0xA3) & (b2 >= 0xC2) | (b == 0xC2) & (b1 >= 0x80) & (b1 <= 0x9F) | (b == 0xEF) & (b1 == 0xBF) & (b2 == 0xBD)
    # lower case turns the first two into C3 A2, C3 A3
    odd |= (b == 0xC3) & ((b1 == 0xA2) | (b1 == 0xA3)) & np.isin(b2, [0xC2, 0xC5, 0xC6, 0xCB, 0xE2])
    sum_of = lambda x: np.bincount(of, weights=x, minlength=rows)
    total, n_words = sum_of(chars), np.bincount(wd, minlength=rows)
    m = max(0, len(wh) - 2)
    tri = mix(mix(wh[:m] * U(3) + wh[1 : m + 1]) * U(5) + wh[2:]) if m else wh[:0]
    same = wd[:m] == wd[2:] if m else np.zeros(0, bool)
    td, tri = wd[:m][same], tri[same]
    order = np.lexsort((tri, td))
    td, tri = td[order], tri[order]
    at = run_starts(td, tri)
    order = np.lexsort((wh, wd))
    first_word = run_starts(wd[order], wh[order])
    top = np.zeros(rows, np.int64)
    np.maximum.at(top, wd[order][first_word], np.diff([*first_word, len(wh)]))
    longest = np.zeros(rows, np.int64)
    np.maximum.at(longest, wd, long)
    by_chars = lambda x: _share(sum_of(chars * x), total)
    count = np.bincount(of[chars > 0], minlength=rows)
    all_chars = np.bincount(doc[char], minlength=rows)
    return {
        "n_words": n_words, "mean_word": _share(np.bincount(wd, weights=long, minlength=rows), n_words),
        "symbols": _share(np.bincount(doc[char & (kind == 0)], minlength=rows), all_chars), "digits": _share(np.bincount(doc[kind == 2], minlength=rows), all_chars),
        "ended": by_chars(ended), "common": _share(sum_of(hits), n_words), "running": by_chars(running), "bullets": by_chars(bullets & ~cells), "cells": by_chars(cells), "shorts": by_chars(shorts), "listed": by_chars(listed), "neither": by_chars(~running & ~listed & ~cells),
        "line_words": _share(n_words, count), "garbled": _share(np.bincount(doc[odd], minlength=rows), all_chars),
        "fresh": np.where(np.bincount(td, minlength=rows) > 0, _share(np.bincount(td[at], minlength=rows), np.bincount(td, minlength=rows)), 1.0), "top": np.where(n_words >= 20, _share(top, n_words), 0.0), "longest": longest,
    }


def statistics(df: DataFrame, key: str, text: str, common: DataFrame, word: str = "word") -> DataFrame:
    """(key, one column for each of STATISTICS): rounded to 6 decimals, over the whole text, one row for each row of df.

    A null, empty or blank text has 0 for all (1 for "fresh" where there are no three words). The common words are a
    fixed table of a few hundred rows, so they are broadcast; more than 100,000 are refused. No shuffle.
    """
    words = [r[0] for r in common.select(F.lower(word)).filter(F.col(word).isNotNull()).distinct().limit(100_001).collect()]
    if len(words) > 100_000:
        raise ValueError("the table of common words is too large to be broadcast")
    own = Spans(pa.array(words, pa.string()))
    table = broadcast_value(df.sparkSession, np.sort(own.hash(own.at[:-1], own.at[1:])))
    schema = T.StructType([T.StructField(key, df.schema[key].dataType), *(T.StructField(k, T.DoubleType()) for k in STATISTICS)])

    def run(batches):
        for batch in batches:
            for part in pieces(batch, 1):
                found = _measure(part.column(1), table.value)
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(np.round(np.asarray(x, float), 6)) for x in found.values())], [key, *found])

    return df.select(F.col(key), F.col(text).cast("string")).mapInArrow(run, schema)


@dataclass(frozen=True)
class Rule:
    """If all conditions hold, the text is of this kind. A condition is (statistic, "<=" or ">=", threshold)."""

    kind: str
    conditions: tuple[tuple[str, str, float], ...]

    def covers(self, x: dict[str, np.ndarray]) -> np.ndarray:
        hit = np.ones(len(next(iter(x.values()))), bool)
        for name, op, at in self.conditions:
            hit &= x[name] <= at if op == "<=" else x[name] >= at
        return hit

    def sql(self) -> str:
        return " AND ".join(f"{name} {op} {at!r}" for name, op, at in self.conditions)


def _grow(x, pos, neg, most: int):
    """Adds the condition of the highest information gain until no negative row is left."""
    conditions, p, n = [], pos.copy(), neg.copy()
    while n.any() and len(conditions) < most:
        base, best = np.log2(p.sum() / (p.sum() + n.sum())), (1e-9, None)
        for name, v in x.items():
            cuts = np.unique(v[p | n])
            if len(cuts) > 65:
                cuts = np.quantile(cuts, np.linspace(0, 1, 65))
            mids = (cuts[1:] + cuts[:-1]) / 2
            for op in ("<=", ">="):
                vp, vn = np.sort(v[p]), np.sort(v[n])
                a, c = np.searchsorted(vp, mids), np.searchsorted(vn, mids)
                if op == ">=":
                    a, c = len(vp) - a, len(vn) - c
                gain = np.where(a > 0, a * (np.log2(np.maximum(a, 1) / np.maximum(a + c, 1)) - base), 0)
                if len(gain) and gain.max() > best[0]:
                    k = int(gain.argmax())
                    best = (gain[k], (name, op, round(float(mids[k]), 6)))
        if best[1] is None:
            break
        conditions.append(best[1])
        hit = Rule("", (best[1],)).covers(x)
        p, n = p & hit, n & hit
        if not p.any():
            return conditions[:-1]
    return conditions


def induce(x: dict[str, np.ndarray], kinds: np.ndarray, default: str = "prose", seed: int = 11, most_rules: int = 12, most_conditions: int = 4) -> list[Rule]:
    """An ordered rule list by incremental reduced-error pruning; texts that no rule covers are of the default kind.

    Kinds come in order of frequency, the rarest first. Two thirds of the rows that no rule covers yet grow a rule, the
    rest prunes it to the prefix of the best (p - n) / (p + n). A kind is done when its next rule is wrong for half of
    the rows that prune it, so wrong judgements don't become rules.
    """
    names, counts = np.unique(kinds[kinds != default], return_counts=True)
    rules, left, rng = [], np.ones(len(kinds), bool), random.Random(seed)
    for kind in names[np.argsort(counts, kind="stable")]:
        failures = 0
        for _ in range(most_rules):
            is_kind = kinds == kind
            grow = np.zeros(len(kinds), bool)
            for group in (left & is_kind, left & ~is_kind):
                rows = np.flatnonzero(group).tolist()
                rng.shuffle(rows)
                grow[rows[: -(-2 * len(rows) // 3)]] = True
            if not (grow & is_kind).any() or not (grow & ~is_kind).any():
                break
            conditions = _grow(x, grow & is_kind, grow & ~is_kind, most_conditions)
            prune, best = left & ~grow, (-2.0, [])
            for k in range(len(conditions), 0, -1):
                hit = Rule(kind, tuple(conditions[:k])).covers(x) & prune
                p, n = (hit & is_kind).sum(), (hit & ~is_kind).sum()
                value = (p - n) / (p + n) if p + n else -1.0
                if value >= best[0]:
                    best = (value, conditions[:k])
            if best[0] <= 0:
                failures += 1
                if failures == 3:
                    break
                continue
            rule = Rule(str(kind), tuple(best[1]))
            rules.append(rule)
            left &= ~rule.covers(x)
    return rules


def case_sql(rules: list[Rule], default: str = "prose") -> str:
    """The rule list as one SQL expression over the statistics."""
    return "CASE " + " ".join(f"WHEN {r.sql()} THEN '{r.kind}'" for r in rules) + f" ELSE '{default}' END" if rules else f"'{default}'"


def learn(df: DataFrame, key: str, text: str, labels: DataFrame, kind: str, common: DataFrame, most: int = 20_000, **how) -> list[Rule]:
    """Rules from the judgements (key, kind) on rows of df. Judgements may be wrong and may differ; each counts once.

    If there are more than `most`, those with the smallest hash of the key are taken: a bounded sample for fitting only, so it is broadcast.
    """
    judged = labels.filter(F.col(key).isNotNull() & F.col(kind).isNotNull()).select(key, F.col(kind).alias("kind")).orderBy(F.xxhash64(key), "kind").limit(most)
    judged = judged.persist()
    known = statistics(df.join(F.broadcast(judged.select(key).distinct()), key, "left_semi"), key, text, common)
    rows = known.join(F.broadcast(judged), key).orderBy(F.xxhash64(key), "kind").toPandas()
    judged.unpersist()
    return induce({k: rows[k].to_numpy() for k in STATISTICS}, rows["kind"].to_numpy(), **how) if len(rows) else []


def classify(df: DataFrame, key: str, text: str, labels: DataFrame, kind: str, common: DataFrame, **how) -> DataFrame:
    """(key, statistics, kind): every row with the kind that the learnt rules give it. Null and blank texts have a null kind.

    The rules become one CASE expression over the statistics, so nothing is classified row by row in Python.
    """
    rules = learn(df, key, text, labels, kind, common, **how)
    found = statistics(df, key, text, common)
    return found.withColumn("kind", F.when((F.col("n_words") > 0) | (F.col("symbols") > 0), F.expr(case_sql(rules))))
