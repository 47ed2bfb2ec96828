"""Telling the main body of a page from its furniture: a recurrent labeller over the sequence of its text blocks.

Each block is read as the hashes of its words and of its path of tags, with a few numbers; a bidirectional LSTM in numpy
then labels every block in the light of all others. It is trained on a bounded sample of the given pages. Their labels
come from structure alone: what recurs on pages of other titles, what is linked, where the title stands.
"""

from __future__ import annotations

import math
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions.html import blocks, title_of
from millrace.session import broadcast_value

#: Pages of the training sample, and most blocks of a page that training reads, from anywhere in it. Labelling reads all
#: blocks of all pages.
SAMPLE, TRAINED_BLOCKS = 700, 300
#: Slots of words and of path entries; sizes of the network; words whose vectors are summed at once.
WORDS, PATHS, EMBED, HIDDEN, NUMBERS, AT_ONCE = 4096, 1024, 24, 28, 6, 500_000
#: Titles on whose pages a block must stand to count as recurring; words of a link's name, of a line with a date below the
#: title, and of a paragraph that speaks for the article.
RECURRING, LINK_WORDS, DATED_WORDS, SAID_WORDS = 3, 9, 12, 8
#: Elements that may recur within articles: cells, items, code and headings.
KEPT = frozenset("td th dt dd li pre code h2 h3 h4 h5 h6".split())

_SUFFIX = re.compile(r"\s+[–—|]\s+([^–—|]*)$|\s+-\s+([^-]*)$")
_DATE = re.compile(r"\d{1,4}[./ -](?:\w+|\d{1,2})[./ ,-]+\d{2,4}")


def _name(title: str) -> str:
    """A page's title without the name of its site."""
    return _SUFFIX.split(title)[0].strip().lower()


def _form(text: str, site: str) -> str:
    low = re.sub(r"\d+", "0", text.lower())
    return low.replace(site, "§") if site else low


def judge(pages: list[tuple[str, list[tuple[str, tuple[str, ...], bool]]]], recurring: int = RECURRING) -> list[list[int]]:
    """Labels of the blocks of a sample of pages (title, blocks), 1 for the article.

    Articles have words of their own, so a block that recurs under several titles, but for numbers and the site's name,
    is furniture, unless it is a cell, an item, code or a sub-heading. An article begins with the block that repeats the
    page's title. It ends where what follows is most clearly furniture: recurring blocks and short links speak for that,
    paragraphs of their own against. A short line with a date just below the title is a byline. Pages whose title no block
    repeats have no article.
    """
    titles: dict[str, set[str]] = {}
    forms = []
    for title, found in pages:
        site = (m[1] or m[2] or "").strip().lower() if (m := _SUFFIX.search(title)) else ""
        forms.append([_form(text, site) for text, _, _ in found])
        for f in forms[-1]:
            titles.setdefault(f, set()).add(_name(title))
    out = []
    for (title, found), own in zip(pages, forms):
        name = _name(title)
        at = next((k for k, (text, _, linked) in enumerate(found) if name and text.lower() == name and not linked), len(found))
        tags = [re.split("[.#@]", path[-1])[0] if path else "" for _, path, _ in found]
        words = [len(text.split()) for text, _, _ in found]
        again = [len(titles[f]) >= recurring for f in own]
        loose = [a and (linked or tag not in KEPT) for a, tag, (_, _, linked) in zip(again, tags, found)]
        link = [linked and n <= LINK_WORDS for n, (_, _, linked) in zip(words, found)]
        dated = [n <= DATED_WORDS and at < k <= at + 4 and bool(_DATE.search(text)) for k, (n, (text, _, _)) in enumerate(zip(words, found))]
        aside = [x or y for x, y in zip(loose, dated)]
        near = [any(loose[j] or link[j] for j in (k - 1, k + 1) if 0 <= j < len(found)) for k in range(len(found))]
        # furniture stands together; a single recurring block may be a prompt within the article
        weight = [(2.0 if n else 0.3) if x else 0.0 if d else 1.0 if y else 0.2 if a and tag[:1] == "h" else -1.0 if w >= SAID_WORDS else -0.6 for x, y, d, a, n, tag, w in zip(loose, link, dated, again, near, tags, words)]
        after = np.cumsum(weight[::-1])[::-1][at + 1 :] if at < len(found) else np.zeros(0)
        end = at + 1 + int(after.argmax()) if len(after) and after.max() > 0 else len(found)
        out.append([int(at <= k < end and not aside[k]) for k in range(len(found))])
    return out


_slots: dict[str, int] = {}


def _slot(word: str, size: int) -> int:
    key = f"{size}{word}"
    if key not in _slots:
        if len(_slots) > 200_000:
            _slots.clear()
        _slots[key] = zlib.crc32(word.encode()) % (size - 1) + 1
    return _slots[key]


def features(title: str, found: list[tuple[str, tuple[str, ...], bool]]) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Slots of all words, slots of path entries (0 for none), and numbers of each block."""
    n, name = len(found), _name(title)
    words, paths, numbers = [], np.zeros((n, 6), np.int32), np.zeros((n, NUMBERS), np.float32)
    for k, (text, path, linked) in enumerate(found):
        low = text.lower()
        own = low.split()
        words.append(np.array([_slot(w.strip(".,:;!?()") or w, WORDS) for w in own], np.int32))
        tags = path[-3:]
        for j, p in enumerate([*tags, "/".join(x.partition(".")[0] for x in path[-2:]), *(["in " + x for x in path if "." in x or "#" in x or "@" in x][-2:])][:6]):
            paths[k, j] = _slot(p, PATHS)
        numbers[k] = linked, low == name, bool(name) and name in low, math.log1p(len(own)) / 4, k / n, bool(text) and text[-1] in ".!?:"
    return words, paths, numbers


class Words:
    """The words' slots of pages side by side: slots of all blocks one after another, and where each block's begin."""

    def __init__(self, pages: list[list[np.ndarray]], long: int):
        size = np.zeros((len(pages), long), np.int64)
        for k, page in enumerate(pages):
            size[k, : len(page)] = [len(w) for w in page]
        self.size, self.start = size, (np.cumsum(size) - size.ravel()).reshape(size.shape)
        self.slots = np.concatenate([np.zeros(0, np.int32), *(w for page in pages for w in page)])

    def __getitem__(self, at: tuple[int, int, int]) -> int:
        page, block, k = at
        return self.slots[self.start[page, block] + k]

    def sums(self, table: np.ndarray) -> np.ndarray:
        """Of each block, the sum of its words' rows of the table."""
        out = np.zeros((self.size.size, table.shape[1]), table.dtype)
        some = np.flatnonzero(self.size.ravel())
        begin = self.start.ravel()[some]
        end = begin + self.size.ravel()[some]
        k = 0
        while k < len(some):
            j = max(k + 1, int(np.searchsorted(end, begin[k] + AT_ONCE, "right")))
            for lo in range(begin[k], end[j - 1], AT_ONCE):  # more than one step only for a single block
                out[some[k:j]] += np.add.reduceat(table[self.slots[lo : min(lo + AT_ONCE, end[j - 1])]], begin[k:j] - begin[k])
            k = j
        return out.reshape(*self.size.shape, -1)

    def add_to(self, table: np.ndarray, part: np.ndarray) -> None:
        """Adds each block's row of part to the table's rows of its words."""
        np.add.at(table, self.slots, np.repeat(part.reshape(-1, part.shape[-1]), self.size.ravel(), axis=0))


class Labeller:
    """Embeddings, two LSTMs in opposite directions and a logistic output."""

    def __init__(self, seed: int = 3):
        r = np.random.default_rng(seed)
        d = 2 * EMBED + NUMBERS
        make = lambda *s, scale=0.1: (r.standard_normal(s) * scale).astype(np.float32)
        self.p = {"words": make(WORDS, EMBED), "paths": make(PATHS, EMBED), "out": make(2 * HIDDEN, scale=0.2), "bias": np.zeros(1, np.float32)}
        for side in "fb":
            self.p |= {"x" + side: make(d, 4 * HIDDEN, scale=1 / math.sqrt(d)), "h" + side: make(HIDDEN, 4 * HIDDEN, scale=1 / math.sqrt(HIDDEN)), "c" + side: np.concatenate([np.ones(HIDDEN), np.zeros(3 * HIDDEN)]).astype(np.float32)}
        self.p["words"][0] = self.p["paths"][0] = 0

    def _input(self, words, paths, numbers):
        count = (np.maximum(words.size, 1)[:, :, None] ** 0.5).astype(np.float32)
        return np.concatenate([words.sums(self.p["words"]) / count, self.p["paths"][paths].sum(axis=2), numbers], axis=2), count

    def _run(self, x, here, side, keep):
        """Hidden states of one direction; padding passes states on unchanged."""
        size, long, _ = x.shape
        gates_x = x @ self.p["x" + side] + self.p["c" + side]
        h, c = np.zeros((size, HIDDEN), np.float32), np.zeros((size, HIDDEN), np.float32)
        out, kept = np.zeros((size, long, HIDDEN), np.float32), []
        for t in range(long) if side == "f" else range(long - 1, -1, -1):
            g = gates_x[:, t] + h @ self.p["h" + side]
            s = 1 / (1 + np.exp(-g[:, : 3 * HIDDEN]))
            f, i, o = s[:, :HIDDEN], s[:, HIDDEN : 2 * HIDDEN], s[:, 2 * HIDDEN :]
            u, m = np.tanh(g[:, 3 * HIDDEN :]), here[:, t, None]
            c_new = f * c + i * u
            th = np.tanh(c_new)
            if keep:
                kept.append((t, h, c, f, i, o, u, th, m))
            h, c = np.where(m, o * th, h), np.where(m, c_new, c)
            out[:, t] = h
        return out, kept

    def score(self, words, paths, numbers, here):
        x, _ = self._input(words, paths, numbers)
        return np.concatenate([self._run(x, here, side, False)[0] for side in "fb"], axis=2) @ self.p["out"] + self.p["bias"]

    def slopes(self, words, paths, numbers, here, gold) -> tuple[float, dict[str, np.ndarray]]:
        x, count = self._input(words, paths, numbers)
        runs = {side: self._run(x, here, side, True) for side in "fb"}
        both = np.concatenate([runs[s][0] for s in "fb"], axis=2)
        z = both @ self.p["out"] + self.p["bias"]
        prob = 1 / (1 + np.exp(-z))
        total = here.sum()
        loss = -(np.where(gold, np.log(prob + 1e-9), np.log(1 - prob + 1e-9)) * here).sum() / total
        dz = (prob - gold) * here / total
        g = {"out": np.einsum("bt,bth->h", dz, both), "bias": dz.sum(keepdims=True).reshape(1)}
        dboth = dz[:, :, None] * self.p["out"]
        dx = np.zeros_like(x)
        for k, side in enumerate("fb"):
            dout = dboth[:, :, k * HIDDEN : (k + 1) * HIDDEN]
            dh, dc = np.zeros((len(x), HIDDEN), np.float32), np.zeros((len(x), HIDDEN), np.float32)
            dgates, hs = np.zeros((*x.shape[:2], 4 * HIDDEN), np.float32), np.zeros((*x.shape[:2], HIDDEN), np.float32)
            for t, h, c, f, i, o, u, th, m in reversed(runs[side][1]):
                dh = dh + dout[:, t]
                do = dh * th * o * (1 - o)
                dcn = dc + dh * o * (1 - th * th)
                d = np.concatenate([dcn * c * f * (1 - f), dcn * u * i * (1 - i), do, dcn * i * (1 - u * u)], axis=1) * m
                dgates[:, t], hs[:, t] = d, h
                dh, dc = np.where(m, d @ self.p["h" + side].T, dh), np.where(m, dcn * f, dc)
            g["x" + side] = np.einsum("btd,btg->dg", x, dgates, optimize=True)
            g["h" + side] = np.einsum("bth,btg->hg", hs, dgates, optimize=True)
            g["c" + side] = dgates.sum(axis=(0, 1))
            dx += dgates @ self.p["x" + side].T
        g["words"], g["paths"] = np.zeros_like(self.p["words"]), np.zeros_like(self.p["paths"])
        words.add_to(g["words"], dx[:, :, :EMBED] / count)
        on = paths > 0
        np.add.at(g["paths"], paths[on], np.broadcast_to(dx[:, :, None, EMBED : 2 * EMBED], (*paths.shape, EMBED))[on])
        return float(loss), g

    def fit(self, pages: list[tuple], epochs: int = 7, rate: float = 0.01, batch: int = 24, seed: int = 3) -> Labeller:
        """Adam over batches of pages (words, paths, numbers, labels)."""
        rng, step = np.random.default_rng(seed), 0
        m, v = ({k: np.zeros_like(x) for k, x in self.p.items()} for _ in range(2))
        for epoch in range(epochs):
            groups = sorted(range(len(pages)), key=lambda k: len(pages[k][3]) + rng.random() * 12)
            groups = [groups[k : k + batch] for k in range(0, len(groups), batch)]
            for k in rng.permutation(len(groups)):
                *inputs, here = padded([pages[j][:3] for j in groups[k]])
                gold = np.zeros(here.shape, bool)
                for row, j in enumerate(groups[k]):
                    gold[row, : len(pages[j][3])] = pages[j][3]
                _, g = self.slopes(*inputs, here, gold)
                step += 1
                norm = math.sqrt(sum(float((x * x).sum()) for x in g.values()))
                at = rate * (1 if epoch < epochs - 2 else 0.3)
                for name, x in g.items():
                    x = x * min(1.0, 2.0 / (norm + 1e-9))
                    m[name] = 0.9 * m[name] + 0.1 * x
                    v[name] = 0.99 * v[name] + 0.01 * x * x
                    self.p[name] -= (at * (m[name] / (1 - 0.9**step)) / (np.sqrt(v[name] / (1 - 0.99**step)) + 1e-6)).astype(np.float32)
        return self


def padded(pages: list[tuple]) -> tuple[Words, np.ndarray, np.ndarray, np.ndarray]:
    long = max(len(p[0]) for p in pages)
    words, paths = Words([p[0] for p in pages], long), np.zeros((len(pages), long, 6), np.int32)
    numbers, here = np.zeros((len(pages), long, NUMBERS), np.float32), np.zeros((len(pages), long), bool)
    for k, (_, p, x) in enumerate(pages):
        paths[k, : len(p)], numbers[k, : len(p)], here[k, : len(p)] = p, x, True
    return words, paths, numbers, here


def train(html: list[str]) -> Labeller:
    """A labeller trained on pages; of a page with more than TRAINED_BLOCKS blocks, on as many from a place that its text decides."""
    pages = [(title_of(h), found) for h in html if (found := blocks(h))]
    rows = []
    for (title, found), labels in zip(pages, judge(pages)):
        more = len(found) - TRAINED_BLOCKS
        at = zlib.crc32(found[0][0].encode()) % (more + 1) if more > 0 else 0
        part = slice(at, at + TRAINED_BLOCKS)
        rows.append((*(x[part] for x in features(title, found)), labels[part]))
    return Labeller().fit(rows) if rows else Labeller()


def label(labeller: Labeller, html: list[str | None], most: int = 40_000) -> list[list[str]]:
    """The blocks of the main body of each page; pages are read together in batches of about `most` blocks."""
    cut = [blocks(h) for h in html]
    out: list[list[str]] = [[] for _ in html]
    order = sorted((k for k in range(len(cut)) if cut[k]), key=lambda k: len(cut[k]))
    at = 0
    while at < len(order):
        some = [order[at]]
        while at + len(some) < len(order) and (len(some) + 1) * len(cut[order[at + len(some)]]) <= most:
            some.append(order[at + len(some)])
        at += len(some)
        *inputs, here = padded([features(title_of(html[k]), cut[k]) for k in some])
        keep = labeller.score(*inputs, here) > 0
        for row, k in enumerate(some):
            out[k] = [x[0] for x, y in zip(cut[k], keep[row]) if y]
    return out


def main_blocks(df: DataFrame, key: str, html: str) -> DataFrame:
    """(key, block_no, text): the blocks of each row's main body, in order; block_no counts them from 0.

    Null and empty pages, and pages of furniture only, have no row. Repeated rows give repeated blocks. The training
    sample is the SAMPLE pages with the smallest hash of the key; every page is labelled, whole. The model has a fixed
    size and is broadcast. No shuffle but for the sample.
    """
    own = df.select(F.col(key), F.col(html).cast("string").alias("html")).filter("html is not null")
    sample = [r[0] for r in own.orderBy(F.xxhash64(key), F.xxhash64("html")).limit(SAMPLE).select("html").collect()]
    model = broadcast_value(df.sparkSession, train(sample))
    schema = T.StructType([T.StructField(key, df.schema[key].dataType), T.StructField("block_no", T.IntegerType()), T.StructField("text", T.StringType())])

    def run(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 500):
                part = batch.slice(lo, 500)
                found = label(model.value, part.column(1).to_pylist())
                row = np.repeat(np.arange(len(found)), [len(x) for x in found])
                number = [k for x in found for k in range(len(x))]
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(row)), pa.array(number, pa.int32()), pa.array([t for x in found for t in x], pa.string())], [key, "block_no", "text"])

    return own.mapInArrow(run, schema)


def main_text(df: DataFrame, key: str, html: str) -> DataFrame:
    """(key, text): the main body as one text, a block a line."""
    return main_blocks(df, key, html).groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block_no", "text"))), lambda x: x["text"]), "\n").alias("text"))


