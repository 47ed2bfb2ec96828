"""Texts that share most of their word sequences, found by vertical partitioning.

A text is its set of sequences of a few consecutive tokens. All sequences have one global order, rare ones first, which
is cut into fragments of about equally many members. Two sets above the threshold differ in few members, so the first
members of both must agree somewhere: either in a rare sequence, or in two of one class. Such agreements give the pairs
that lengths and parity bits can't rule out. Of these, every fragment counts its own share of the overlap, and the
shares of a pair are summed. That sum is exact.
"""

from __future__ import annotations

import hashlib
import math
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions.spans import U, mix, pieces, run_starts, tokens
from millrace.llm.components import components
from millrace.llm.marks import marks_of
from millrace.session import broadcast_value, cut

#: Counters for each text of the estimate of how frequent a sequence is, one byte each once summed; fewest and most of them.
#: At most 64 MB are broadcast. Beyond that, counters are shared by more sequences: the order gets less sharp, not wrong.
PER_TEXT, FEWEST, MOST = 8, 1 << 22, 1 << 26
BLOCK = 1 << 16
#: Sequences estimated to be in at most RARE texts are compared alone, all others two by two in CLASSES classes.
RARE, CLASSES = 128, 8
#: Parity bits that come with a set.
PARITY = 192
#: Sets of at most so many members travel with their members where only chains of links are wanted.
CARRIED = 64
#: Fragments of the order in which overlaps are counted.
FRAGMENTS = 4
#: Texts for each task that joins agreements; agreements that one task holds before it looks for frequent signatures; and
#: those of one signature that are compared at once. Parts of a more frequent one meet two by two in tasks of their own.
TEXTS_PER_TASK, HELD, SAME = 20_000, 8_000_000, 30_000
#: An agreement: a set and its signature. A size of LARGE or more isn't told from others.
AGREEMENT = np.dtype([("set", "<u8"), ("bits", "<u8", PARITY // 64), ("sig", "<u4"), ("size", "<u2")])
LARGE = 65535


def _sets(texts: pa.Array, words: int, least: int):
    """Of each member of each text's set: text number and hash, in that order; and set hash and size by text number.

    Texts with fewer than `least` members have none.
    """
    spans, doc, start, end = tokens(texts)
    h = spans.hash(start, end)
    m = max(0, len(h) - words + 1)
    x = np.zeros(m, U)
    for k in range(words):
        x = mix(x * U(0x100000001B3) + h[k : k + m])
    doc, x = doc[:m][(same := doc[words - 1 :][:m] == doc[:m])], x[same]
    order = np.lexsort((x, doc))
    doc, x = doc[order], x[order]
    at = run_starts(doc, x)
    doc, x = doc[at], x[at]
    n = np.bincount(doc, minlength=len(texts))
    keep = n[doc] >= least
    doc, x = doc[keep], x[keep]
    sums = np.zeros(len(texts), U)
    at = run_starts(doc)
    if len(at):
        sums[doc[at]] = np.add.reduceat(mix(x), at)
    return doc, x, mix(sums + n.astype(U)), np.where(n >= least, n, 0)


class Order:
    """The global order: by a byte that grows with the number of texts whose sequences share a counter, then by hash."""

    def __init__(self, codes: np.ndarray):
        self.codes, self.mask = codes, len(codes) - 1
        # pivots part the members evenly; those of one code lie evenly over the hashes
        texts = 2 ** (np.arange(256) / 12)
        mass = np.cumsum(np.concatenate([[0], np.bincount(codes[codes > 0], minlength=256) * texts]))
        at = mass[-1] * np.arange(1, FRAGMENTS) / FRAGMENTS
        code = np.minimum(np.searchsorted(mass, at, "right") - 1, 255)
        part = (at - mass[code]) / np.maximum(mass[code + 1] - mass[code], 1e-9)
        self.pivots = (code.astype(U) << U(56)) | np.minimum(part * 2.0**56, 2.0**56 - 1).astype(U)

    def rank(self, x: np.ndarray) -> np.ndarray:
        return self.codes[slot(x, self.mask)]

    def fragment(self, x: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.pivots, (self.rank(x).astype(U) << U(56)) | (x >> U(8)), "right")


def slot(x: np.ndarray, mask: int) -> np.ndarray:
    return ((x * U(0x9E3779B97F4A7C15)) >> U(32)).astype(np.int64) & mask


#: Codes of counters that one text and that RARE texts fell into.
ALONE, FEW = int(12 * math.log2(2)), int(12 * math.log2(RARE + 1))


def _order(df: DataFrame, text: str, words: int, least: int, rows: int) -> Order:
    """Codes of counters: exact for few texts, then logarithmic. Counters are summed block by block, streaming; the
    driver gets their bytes, whose number has a fixed most."""
    size = min(MOST, max(FEWEST, 1 << math.ceil(math.log2(max(1, rows * PER_TEXT)))))

    def count(batches):
        total = np.zeros(size, np.int32)
        for batch in batches:
            for part in pieces(batch, 0):
                _, x, _, _ = _sets(part.column(0), words, least)
                at, n = np.unique(slot(x, size - 1), return_counts=True)
                total[at] += n.astype(np.int32)
        some = [(k // BLOCK, np.minimum(total[k : k + BLOCK], 65535).astype("<u2").tobytes()) for k in range(0, size, BLOCK) if total[k : k + BLOCK].any()]
        yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in some], pa.int32()), pa.array([b for _, b in some], pa.binary())], ["block", "counts"])

    def add(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, b in zip(batch.column(0).to_pylist(), batch.column(1)):
                part = np.frombuffer(b.as_buffer(), "<u2")
                sums[k] = sums[k] + part if k in sums else part.astype(np.int64)
        code = {k: np.minimum(255, np.floor(12 * np.log2(v + 1.0))).astype(np.uint8).tobytes() for k, v in sums.items()}
        yield pa.RecordBatch.from_arrays([pa.array(list(code), pa.int32()), pa.array(list(code.values()), pa.binary())], ["block", "counts"])

    found = df.select(text).mapInArrow(count, "block int, counts binary").repartition("block").mapInArrow(add, "block int, counts binary").toArrow()
    out = np.zeros(size, np.uint8)
    for k, b in zip(found.column(0).to_pylist(), found.column(1).to_pylist()):
        out[k * BLOCK : (k + 1) * BLOCK] = np.frombuffer(b, np.uint8)
    return Order(out)


def _signatures(doc: np.ndarray, x: np.ndarray, rank: np.ndarray, t: float):
    """(text number, signature) such that any two texts with similarity >= t share a signature.

    Let two sets of sizes n and m have an overlap of at least a = ceil(t * n). With members in one order, if they share
    no rare member, the n - r others of the first, r of its being rare, still hold the whole overlap; so its first
    n - r - a + CLASSES + 1 others hold at least CLASSES + 1 shared ones, and two of them lie in one class. Of the rare
    ones, the first n - a + 1 do. Where the overlap may be as small as CLASSES, the first n - a + 1 members are compared
    alone; sets that may have partners of either kind give signatures of both kinds. A member that no other text has
    (its counter stands at one) is shared by none, so it gives none.
    """
    order = np.lexsort((x, rank, doc))
    doc, x, rank = doc[order], x[order], rank[order]
    first = run_starts(doc)
    size = np.diff([*first, len(doc)])
    n, place = np.repeat(size, size), np.arange(len(doc)) - np.repeat(first, size)
    need = np.ceil(t * n - 1e-9).astype(np.int64)
    least_partner, most_partner = need, np.floor(n / t + 1e-9)
    small = np.ceil(t * least_partner - 1e-9) <= CLASSES
    large = np.ceil(t * most_partner - 1e-9) > CLASSES
    rare = rank <= FEW
    rares = np.repeat(np.add.reduceat(rare, first, dtype=np.int64), size) if len(first) else n
    alone = (rare | small) & (place <= n - need) & (rank > ALONE)
    others = large & ~rare & (n - rares >= need) & (place - rares < n - rares - need + CLASSES + 1)
    d, y = doc[others], x[others]
    class_ = mix(y) % U(CLASSES)
    order = np.lexsort((y, class_, d))
    d, y, group = d[order], y[order], d[order] * CLASSES + class_[order].astype(np.int64)
    docs, out = [doc[alone]], [mix(x[alone])]
    for k in range(1, len(group)):
        near = group[k:] == group[:-k]
        if not near.any():
            break
        docs.append(d[k:][near])
        out.append(mix(y[k:][near] * U(3) + y[:-k][near]))
    return np.concatenate(docs), np.concatenate(out)


def _parity(doc: np.ndarray, x: np.ndarray, rows: int) -> np.ndarray:
    """PARITY bits for each text: each member flips one. Two sets' bits differ in no more places than the sets themselves."""
    out = np.zeros((rows, PARITY // 64), U)
    bit = mix(x ^ U(0x5BF03635)) % U(PARITY)
    np.bitwise_xor.at(out, (doc, (bit >> U(6)).astype(np.int64)), U(1) << (bit & U(63)))
    return out


class _Chains:
    """Components that grow by links; small sets' links are counted exactly at once."""

    def __init__(self, sizes: np.ndarray, members: list[np.ndarray], t: float):
        self.parent, self.label = list(range(len(sizes))), np.arange(len(sizes))
        self.sizes, self.small, self.t = sizes, sizes <= CARRIED, t
        self.width = int(sizes[self.small].max(initial=1))
        own = np.flatnonzero(self.small)
        at = np.arange(int(sizes[own].sum())) - np.repeat(np.cumsum(sizes[own]) - sizes[own], sizes[own])
        self.a, self.b = np.zeros((len(sizes), self.width), U), np.ones((len(sizes), self.width), U)
        for m in (self.a, self.b):
            m[np.repeat(own, sizes[own]), at] = np.concatenate(members) if members else []

    def root(self, k: int) -> int:
        while self.parent[k] != k:
            self.parent[k] = self.parent[self.parent[k]]
            k = self.parent[k]
        return k

    def apart(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return self.label[a] != self.label[b]

    def add(self, a: np.ndarray, b: np.ndarray) -> tuple[list[int], list[int]]:
        """Links of a forest among pairs of small sets."""
        out: tuple[list[int], list[int]] = ([], [])
        step = max(1, 64_000_000 // self.width**2)
        for lo in range(0, len(a), step):
            x, y = a[lo : lo + step], b[lo : lo + step]
            both = (self.a[x][:, :, None] == self.b[y][:, None, :]).sum(axis=(1, 2))
            ok = both >= self.t * (self.sizes[x] + self.sizes[y] - both) - 1e-9
            for i, j in zip(x[ok].tolist(), y[ok].tolist()):
                p, q = self.root(i), self.root(j)
                if p != q:
                    self.parent[max(p, q)] = min(p, q)
                    out[0].append(i)
                    out[1].append(j)
        if out[0]:
            label = np.array(self.parent)
            while (label != (new := label[label])).any():
                label = new
            self.label = label
        return out


def _join_agreements(all_: np.ndarray, members: np.ndarray, t: float, chain: bool) -> pa.RecordBatch:
    """All pairs of sets that agree in a signature and that size and parity don't rule out; with `chain`, of small sets
    only as many sure links as their components need. members holds those of the small sets, one after another."""
    sets, some, same = np.unique(all_["set"], return_index=True, return_inverse=True)
    sizes, bits = all_["size"].astype(np.int64), all_["bits"][some]
    chains = None
    if chain:
        n = np.where(sizes <= CARRIED, sizes, 0)
        start = np.cumsum(n) - n
        chains = _Chains(sizes[some], [members[start[k] : start[k] + n[k]] for k in some.tolist() if n[k]], t)
    sizes = sizes[some]
    order = np.lexsort((same, all_["sig"]))
    sig, doc = all_["sig"][order], same[order]
    at = run_starts(sig, doc)
    sig, doc = sig[at], doc[at]
    first = run_starts(sig)
    size = np.diff([*first, len(sig)])
    place, left = np.arange(len(sig)), np.repeat(first + size, size)
    found, held, sure = [np.empty(0, np.int64)], 0, ([], [])
    k = 1
    share = (1 - t) / (1 + t)
    while True:
        place, left = place[(more := place + k < left)], left[more]
        if not len(place):
            break
        for lo in range(0, len(place), 2_000_000):
            a, b = doc[place[lo : lo + 2_000_000]], doc[place[lo : lo + 2_000_000] + k]
            if chains:
                ok = chains.apart(a, b)
                a, b = a[ok], b[ok]
            na, nb = sizes[a], sizes[b]
            ok = np.minimum(na, nb) >= t * np.maximum(na, nb) - 1e-9
            a, b, most = a[ok], b[ok], np.where(np.maximum(na, nb)[ok] >= LARGE, PARITY, np.floor(share * (na + nb)[ok] + 1e-9))
            ok = np.bitwise_count(bits[a] ^ bits[b]).sum(axis=1) <= most
            a, b = a[ok], b[ok]
            if chains:
                both = chains.small[a] & chains.small[b]
                for have, new in zip(sure, chains.add(a[both], b[both])):
                    have += new
                a, b = a[~both], b[~both]
            found.append(a * len(sets) + b)
            held += len(found[-1])
        if held > 2_000_000:
            found, held = [np.unique(np.concatenate(found))], 0
        k += 1
    pair = np.unique(np.concatenate(found))
    a, b = (sets[np.concatenate([x, np.array(y, np.int64)])].view(np.int64) for x, y in zip((pair // len(sets), pair % len(sets)), sure))
    nothing = lambda kind: pa.nulls(len(a), kind)
    return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b)), pa.array(np.arange(len(a)) >= len(pair)), nothing(pa.int64()), nothing(pa.binary()), nothing(pa.binary())], FOUND)


#: What a task gives: pairs, or agreements of a signature that is too frequent to be joined there.
FOUND = ["a", "b", "sure", "sig", "own", "members"]
FOUND_TYPES = "a long, b long, sure boolean, sig long, own binary, members binary"


def _taken(all_: np.ndarray, members: np.ndarray, keep: np.ndarray, chain: bool) -> tuple[np.ndarray, np.ndarray]:
    """The kept agreements, and the members of their small sets."""
    if not chain:
        return all_[keep], members
    n = np.where(all_["size"] <= CARRIED, all_["size"], 0).astype(np.int64)
    return all_[keep], members[np.repeat(keep, n)]


def _put_off(all_: np.ndarray, members: np.ndarray, frequent: np.ndarray, task: int, same: int, chain: bool):
    """Rows of the agreements of frequent signatures, in parts."""
    for sig in frequent.tolist():
        own, inner = _taken(all_, members, all_["sig"] == sig, chain)
        n = np.where(own["size"] <= CARRIED, own["size"], 0).astype(np.int64) if chain else np.zeros(len(own), np.int64)
        ends = np.concatenate([[0], np.cumsum(n)])
        parts = [(lo, min(lo + same // 2, len(own))) for lo in range(0, len(own), same // 2)]
        nothing = lambda kind: pa.nulls(len(parts), kind)
        columns = ([own[lo:hi].tobytes() for lo, hi in parts], [inner[ends[lo] : ends[hi]].tobytes() for lo, hi in parts])
        yield pa.RecordBatch.from_arrays([nothing(pa.int64()), nothing(pa.int64()), nothing(pa.bool_()), pa.array([task << 32 | sig] * len(parts), pa.int64()), *(pa.array(c, pa.binary()) for c in columns)], FOUND)


def _candidates(df: DataFrame, text: str, words: int, t: float, least: int, order, rows: int, chain: bool = False) -> DataFrame:
    """(a, b, sure): pairs of set hashes, among them every pair with similarity >= t; with `chain`, enough of them that
    the same sets are linked by chains. Sure pairs have that similarity.

    Agreements go to tasks by signature, their number following the rows. A task that meets a signature of more than
    SAME sets doesn't join these but gives them on in parts, as soon as it holds too many; afterwards every two parts of
    such a signature meet in a task of their own. So no task's memory or time grows with how many sets share a signature.
    """
    tasks, same = max(1, math.ceil(rows / TEXTS_PER_TASK)), SAME
    held = HELD

    def split(batches):
        for batch in batches:
            for part in pieces(batch, 0):
                doc, x, sets, sizes = _sets(part.column(0), words, least)
                if not len(doc):
                    continue
                _, one = np.unique(sets, return_index=True)  # of equal sets in a batch, one is enough
                take = np.zeros(len(sets), bool)
                take[one] = True
                take &= sizes > 0
                doc, x = doc[(k := take[doc])], x[k]
                d, sig = _signatures(doc, x, order.value.rank(x), t)
                bits = _parity(doc, x, len(sets))
                task = (((sig >> U(32)) * U(tasks)) >> U(32)).astype(np.int64)
                by = np.argsort(task, kind="stable")
                d, sig, task = d[by], sig[by], task[by]
                all_ = np.zeros(len(d), AGREEMENT)
                all_["set"], all_["bits"], all_["sig"], all_["size"] = sets[d], bits[d], (sig & U(0xFFFFFFFF)).astype(np.uint32), np.minimum(sizes[d], LARGE)
                first = np.concatenate([[0], np.cumsum(np.bincount(doc, minlength=len(sets)))])
                small = np.flatnonzero(sizes[d] <= CARRIED) if chain else np.empty(0, np.int64)
                at = run_starts(task)
                found = []
                for lo, hi in zip(at.tolist(), [*at[1:].tolist(), len(task)]):
                    inner = [x[first[k] : first[k + 1]] for k in d[small[np.searchsorted(small, lo) : np.searchsorted(small, hi)]].tolist()]
                    found.append((int(task[lo]), all_[lo:hi].tobytes(), np.concatenate(inner).tobytes() if inner else b""))
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*found), (pa.int32(), pa.binary(), pa.binary()))], ["task", "own", "members"])

    def gathered(columns):
        return (np.concatenate([np.empty(0, kind), *(np.frombuffer(b.as_buffer(), kind) for c in column for b in c)]) for column, kind in zip(columns, (AGREEMENT, np.dtype("<u8"))))

    def join(batches):
        own, inner, n, task = [], [], 0, 0
        frequent = np.empty(0, np.uint32)
        for batch in batches:
            task = batch.column(0)[0].as_py()
            own.append(batch.column(1))
            inner.append(batch.column(2))
            n += sum(pc.binary_length(batch.column(1)).to_numpy()) // AGREEMENT.itemsize
            if n >= held:
                all_, members = gathered((own, inner))
                sig, count = np.unique(all_["sig"], return_counts=True)
                frequent = np.union1d(frequent, sig[count > same])
                yield from _put_off(all_, members, np.intersect1d(sig, frequent), task, same, chain)
                all_, members = _taken(all_, members, ~np.isin(all_["sig"], frequent), chain)
                own, inner = [pa.array([all_.tobytes()], pa.binary())], [pa.array([members.tobytes()], pa.binary())]
                n = len(all_) // 2  # looked through again once as many more have come
        if own:
            all_, members = gathered((own, inner))
            sig, count = np.unique(all_["sig"], return_counts=True)
            frequent = sig[(count > same) | np.isin(sig, frequent)]
            yield from _put_off(all_, members, frequent, task, same, chain)
            all_, members = _taken(all_, members, ~np.isin(all_["sig"], frequent), chain)
            if len(all_):
                yield _join_agreements(all_, members, t, chain)

    agreements = df.select(text).mapInArrow(split, "task int, own binary, members binary")
    found = cut(agreements.repartitionById(tasks, "task").mapInArrow(join, FOUND_TYPES))
    pairs, late = found.filter("a is not null").select("a", "b", "sure"), found.filter("sig is not null").select("sig", "own", "members")
    if late.head(1):
        w = Window.partitionBy("sig")
        placed = late.withColumn("i", F.row_number().over(w.orderBy(F.xxhash64("own")))).withColumn("parts", F.count("*").over(w))
        met = placed.withColumn("j", F.explode(F.sequence(F.lit(1), F.col("parts")))).select("sig", F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j"), "own", "members")

        def join_parts(tbl: pa.Table) -> pa.Table:
            all_, members = gathered((tbl.column("own").chunks, tbl.column("members").chunks))
            return pa.Table.from_batches([_join_agreements(all_, members, t, chain)])

        pairs = pairs.unionByName(met.groupBy("sig", "i", "j").applyInArrow(join_parts, FOUND_TYPES).select("a", "b", "sure"))
    return pairs.distinct()


def similar(df: DataFrame, key: str, text: str, words: int = 5, t: float = 0.8, least: int = 1, chain: bool = False) -> tuple[DataFrame, DataFrame]:
    """Members (key, set, n) and links (a, b, overlap, n_a, n_b), or with `chain` links (a, b) that join the same chains.

    Every distinct key whose text has at least `least` sequences of `words` consecutive tokens belongs to the set of its
    sequences; equal texts and copies belong to one set, which stands for them all. The links are all pairs of different
    sets with intersection / union >= t, by exact counts. With `chain`, a group of sets that are all alike isn't
    turned into all its pairs: only links between sets that no chain joins yet are kept. Texts that are null, empty or too short have no row.
    """
    own = df.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text")).filter("key is not null and text is not null")
    rows = own.count()
    order = broadcast_value(df.sparkSession, _order(own, "text", words, least, rows))
    found = cut(_candidates(own, "text", words, t, least, order, rows, chain))
    pairs = found.filter("not sure").select("a", "b")

    def member(batches):
        for batch in batches:
            for part in pieces(batch, 1):
                _, _, sets, sizes = _sets(part.column(1), words, least)
                k = np.flatnonzero(sizes)
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(k)), pa.array(sets[k].view(np.int64)), pa.array(sizes[k], pa.int32())], ["key", "set", "n"])

    kind = T.StructField("key", df.schema[key].dataType)
    members = cut(own.mapInArrow(member, T.StructType([kind, T.StructField("set", T.LongType()), T.StructField("n", T.IntegerType())])).distinct())
    marks = marks_of(pairs.select(F.explode(F.array("a", "b")).alias("set")).distinct())

    def fragments(batches):
        for batch in batches:
            for part in pieces(batch, 0):
                doc, x, sets, sizes = _sets(part.column(0), words, least)
                k = marks.value.hit(sets)[doc]
                doc, x = doc[k], x[k]
                fragment = order.value.fragment(x)
                by = np.lexsort((x, fragment, doc))
                doc, x, fragment = doc[by], x[by], fragment[by]
                at = run_starts(doc, fragment)
                ends = pa.array([*at, len(doc)], pa.int32())
                of = doc[at]
                yield pa.RecordBatch.from_arrays([pa.array(sets[of].view(np.int64)), pa.array(sizes[of], pa.int32()), pa.array(fragment[at], pa.int32()), pa.ListArray.from_arrays(ends, pa.array(x.view(np.int64)))], ["set", "n", "fragment", "x"])

    parts = own.select("text").mapInArrow(fragments, "set long, n int, fragment int, x array<long>").dropDuplicates(["set", "fragment"])
    parts = cut(parts)
    a = parts.select(F.col("set").alias("a"), F.col("n").alias("n_a"), "fragment", F.col("x").alias("x"))
    b = parts.select(F.col("set").alias("b"), F.col("n").alias("n_b"), "fragment", F.col("x").alias("y"))
    shares = pairs.join(a, "a").join(b, ["b", "fragment"]).select("a", "b", "n_a", "n_b", F.size(F.array_intersect("x", "y")).alias("share"))
    links = shares.groupBy("a", "b", "n_a", "n_b").agg(F.sum("share").alias("overlap")).filter(F.col("overlap") >= t * (F.col("n_a") + F.col("n_b") - F.col("overlap")) - 1e-9)
    if chain:
        links = links.select("a", "b").unionByName(found.filter("sure").select("a", "b"))
    return members, links


def pairs(df: DataFrame, key: str, text: str, words: int, t: float, least: int) -> DataFrame:
    """(a, b), a < b: all pairs of keys whose sets have a similarity of t or more, copies among them."""
    members, links = similar(df, key, text, words, t, least)
    links = cut(links.select("a", "b"))
    own = members.select("set", "key")
    copies = own.groupBy("set").agg(F.count("*").alias("c")).filter("c > 1").select(F.col("set").alias("a"), F.col("set").alias("b"))
    both = links.unionByName(copies).join(own.select(F.col("set").alias("a"), F.col("key").alias("x")), "a").join(own.select(F.col("set").alias("b"), F.col("key").alias("y")), "b")
    return both.filter("a <> b or x < y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).filter("a < b").distinct()


def classes(df: DataFrame, key: str, text: str, words: int = 5, t: float = 0.8, least: int = 1) -> DataFrame:
    """(key, class, copies, links): one row for each distinct key of a text with enough sequences.

    class is the smallest key that copies and chains of links lead to; copies counts the keys with the same set, itself
    among them; links the different sets that its set is similar to. Links hold between sets, so copies aren't expanded.
    """
    members, links = similar(df, key, text, words, t, least)
    links = cut(links.select("a", "b"))
    least_key = members.groupBy("set").agg(F.min("key").alias("k"), F.count("*").alias("copies"))
    low = least_key.select("set", "k")
    ends = links.join(low.withColumnsRenamed({"set": "a", "k": "ka"}), "a").join(low.withColumnsRenamed({"set": "b", "k": "kb"}), "b")
    found = components(ends, "ka", "kb")
    degree = links.select(F.explode(F.array("a", "b")).alias("set")).groupBy("set").agg(F.count("*").alias("links"))
    return (
        members.join(least_key, "set").join(degree, "set", "left").join(found, F.col("k") == F.col("id"), "left")
        .select(F.col("key").alias(key), F.coalesce("component", "k").alias("class"), "copies", F.coalesce("links", F.lit(0)).alias("links"))
    )


def all_classes(df: DataFrame, key: str, text: str, words: int = 5, t: float = 0.8) -> DataFrame:
    """(key, class, copies, links) as in classes, with a row for each distinct key that isn't null.

    Texts of fewer than `words` tokens have no sequences to compare: they are copies if their lists of tokens are equal,
    or, without any token, their texts in lower case with single spaces. Null and blank texts are alone.
    """
    own = df.select(F.col(key).alias("key"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text")).filter("key is not null")

    def short(batches):
        for batch in batches:
            for part in pieces(batch, 1):
                _, doc, _, _ = tokens(part.column(1))
                k = pa.array(np.flatnonzero(np.bincount(doc, minlength=part.num_rows) < words))
                low = [" ".join(re.findall("[a-z0-9]{2,}", x)) or " ".join(x.split()) for x in pc.utf8_lower(part.column(1).take(k)).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0).take(k), pa.array([hashlib.md5(x.encode()).hexdigest() if x else None for x in low], pa.string())], ["key", "same"])

    rest = cut(own.mapInArrow(short, T.StructType([T.StructField("key", df.schema[key].dataType), T.StructField("same", T.StringType())])).distinct())
    low = rest.filter("same is not null").groupBy("same").agg(F.min("key").alias("k"), F.count("*").alias("copies"))
    return classes(df, key, text, words, t).unionByName(
        rest.join(low, "same", "left").select(F.col("key").alias(key), F.coalesce("k", "key").alias("class"), F.coalesce("copies", F.lit(1)).alias("copies"), F.lit(0).cast("long").alias("links"))
    )
