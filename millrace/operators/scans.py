"""One pass over all documents for many queries: each task keeps its own best rows of every query while batches go by.

What leaves a task is the best rows alone, never what merely matches, so that no shuffle grows with queries times
documents. Few queries share tasks that each read a part of the documents; many are parted into blocks, and each block's
task reads all documents, so that its best rows are final.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Queries of a block: a task holds `depth` rows of 16 bytes for each, in each field; and rows that are scored at once.
BLOCK, ROWS = 16_384, 60_000

#: Products that are made and looked at together, so that they stay in a core's cache: 1.2 MB.
CACHED = 300_000

#: Vectors that are looked at together where few places are summed: few at first, for bounds, then more, of at most MANY
#: numbers: 64 MB. Counts of a query whose places are summed, at most.
FIRST, MANY, FEW = 4096, 8_388_608, 40


def plan(n: int, cores: int) -> tuple[int, int]:
    """(queries of a block, parts of the documents) of n queries: blocks are even over the cores once there are more than one."""
    blocks = max(1, -(-n // BLOCK))
    if blocks > 1:
        blocks = -(-blocks // cores) * cores
    return max(1, -(-n // blocks)), max(1, cores // blocks)


def rounded(score: np.ndarray) -> np.ndarray:
    """Scores as whole numbers of 9 decimals, as ranks use them."""
    return np.floor(score * 1e9 + 0.5)


def best_of(q: np.ndarray, id_: np.ndarray, score: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(places, ranks) of the best k rows of each q, by rounded score, then the smaller id."""
    order = np.lexsort((id_, -rounded(score), q))
    at = q[order]
    rank = np.arange(len(at)) - np.searchsorted(at, at)
    keep = rank < k
    return order[keep], rank[keep]


class Best:
    """The best k (id, score) of each of n queries so far."""

    def __init__(self, n: int, k: int):
        self.k, self.id, self.score = k, np.zeros((n, k), np.int64), np.zeros((n, k))
        self.filled, self.least = np.zeros(n, np.int64), np.full(n, -np.inf)  # least: the rounded score that a row must reach

    def add(self, q: int, id_: np.ndarray, score: np.ndarray) -> None:
        """Rows of one query."""
        had = self.filled[q]
        now = had + len(id_)
        if now <= self.k:
            self.id[q, had:now], self.score[q, had:now], self.filled[q] = id_, score, now
            if now == self.k:
                self.least[q] = rounded(self.score[q]).min()
            return
        id_, score = np.concatenate([self.id[q, :had], id_]), np.concatenate([self.score[q, :had], score])
        key = rounded(score)
        if now > 4 * self.k:
            some = np.flatnonzero(key >= np.partition(key, now - self.k)[now - self.k])
            id_, score, key = id_[some], score[some], key[some]
        order = np.lexsort((id_, -key))[: self.k]
        self.id[q], self.score[q], self.filled[q], self.least[q] = id_[order], score[order], self.k, key[order[-1]]

    def add_all(self, q: np.ndarray, id_: np.ndarray, score: np.ndarray) -> None:
        """Rows of many queries."""
        touched = np.unique(q)
        oq, oid, oscore = self.rows(touched)
        q, id_, score = np.concatenate([oq, q]), np.concatenate([oid, id_]), np.concatenate([oscore, score])
        at, rank = best_of(q, id_, score, self.k)
        self.id[q[at], rank], self.score[q[at], rank] = id_[at], score[at]
        self.filled[touched] = np.bincount(q[at], minlength=len(self.filled))[touched]
        full = touched[self.filled[touched] == self.k]
        self.least[full] = rounded(self.score[full, self.k - 1])

    def rows(self, of: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(q, id, score) of some queries."""
        there = np.arange(self.k) < self.filled[of][:, None]
        return np.repeat(of, self.filled[of]), self.id[of][there], self.score[of][there]


def counted(names: list[str]):
    """Over batches of (id, tokens of each field): a row of each field and document with its length, its distinct terms and
    how often each is in it. A document is whole within a batch, so nothing is shuffled, and its terms stay in one row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            for at, name in enumerate(names, 1):
                length = pc.list_value_length(batch.column(at)).to_numpy(zero_copy_only=False)
                coded = batch.column(at).flatten().dictionary_encode()
                size = max(1, len(coded.dictionary))
                key, tf = np.unique(np.repeat(np.arange(n), length) * size + coded.indices.to_numpy(), return_counts=True)
                ends = pa.array(np.concatenate([[0], np.cumsum(np.bincount(key // size, minlength=n))]).astype(np.int32))
                terms = pa.ListArray.from_arrays(ends, coded.dictionary.take(pa.array(key % size)))
                yield pa.RecordBatch.from_arrays([pa.array([name] * n, pa.string()), batch.column(0), pa.array(length.astype(np.int32)), terms, pa.ListArray.from_arrays(ends, pa.array(tf.astype(np.int32)))], ["field", "id", "dl", "terms", "tfs"])

    return run


def together(batches: Iterator[pa.RecordBatch], rows: int = ROWS) -> Iterator[pa.Table]:
    """Batches put together to tables of about so many rows."""
    some: list[pa.RecordBatch] = []
    for batch in batches:
        some.append(batch)
        if sum(b.num_rows for b in some) >= rows:
            yield pa.Table.from_batches(some)
            some = []
    if some:
        yield pa.Table.from_batches(some)


def scored(shared, asked, weights: dict[str, float], depth: int, k: int | None, k1: float, b: float):
    """Over postings (field, id, dl, terms, tfs): the best `depth` of each field and query of a block, by BM25.

    shared.value: the asked terms, and for each field their idf and the mean length; asked.value: numbers of queries, and
    where each one's terms begin. With k the task has seen all documents: the fields' lists are summed and cut at k.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, idf, mean = shared.value
        qids, begin, codes = asked.value
        best = {f: Best(len(qids), depth) for f in weights}
        for table in together(batches):
            for field, top in best.items():
                part = table.filter(pc.equal(table.column("field"), field)).combine_chunks()
                if part.num_rows:
                    score(part, top, words, idf[field], mean[field], begin, codes)
        yield from out(best, qids)

    def score(part, top, words, idf, mean, begin, codes):
        ids, dl = part.column("id").to_numpy(), part.column("dl").to_numpy()
        lists, tfs = (part.column(c).combine_chunks() for c in ("terms", "tfs"))
        code = pc.index_in(lists.flatten(), value_set=words).fill_null(-1).to_numpy()
        own = np.flatnonzero(code >= 0)
        doc = np.repeat(np.arange(len(ids)), pc.list_value_length(lists).to_numpy())[own]
        code, tf = code[own], tfs.flatten().to_numpy()[own].astype(float)
        value = idf[code] * tf * (k1 + 1) / (tf + k1 * (1 - b + b * dl[doc] / mean))
        order = np.argsort(code, kind="stable")
        doc, value = doc[order], value[order]
        start = np.concatenate([[0], np.cumsum(np.bincount(code, minlength=len(words)))])
        # how many postings each query meets; most meet few
        met = np.concatenate([[0], np.cumsum(np.diff(start)[codes])])
        met = met[begin[1:]] - met[begin[:-1]]
        total = np.zeros(len(ids))
        for q in np.flatnonzero(met):
            pieces = [slice(start[c], start[c + 1]) for c in codes[begin[q] : begin[q + 1]] if start[c] < start[c + 1]]
            least = max(1e-300, (top.least[q] - 1) * 1e-9)
            for s in pieces:  # a document is in a term's list once
                total[doc[s]] += value[s]
            if met[q] * 2 < len(total):
                touched = np.concatenate([doc[s] for s in pieces]) if len(pieces) > 1 else doc[pieces[0]]
                found = touched[total[touched] >= least]
                found = np.unique(found) if len(pieces) > 1 and len(found) else found
                sums = total[found]
                total[touched] = 0
            else:
                found = np.flatnonzero(total >= least)
                sums = total[found]
                total[:] = 0
            if len(found):
                top.add(q, ids[found], sums)

    def out(best, qids):
        for at in range(0, len(qids), 2048):
            some = np.arange(at, min(at + 2048, len(qids)))
            rows = {f: top.rows(some) for f, top in best.items()}
            if k is None:
                for field, (q, id_, score) in rows.items():
                    yield pa.RecordBatch.from_arrays([pa.array(qids[q]), pa.array([field] * len(q), pa.string()), pa.array(id_), pa.array(score)], ["qid", "field", "id", "score"])
                continue
            q, id_, score = (np.concatenate(x) for x in zip(*((q, id_, score * weights[f]) for f, (q, id_, score) in rows.items())))
            if not len(q):
                continue
            order = np.lexsort((id_, q))
            q, id_, score = q[order], id_[order], score[order]
            first = np.flatnonzero(np.concatenate([[True], (q[1:] != q[:-1]) | (id_[1:] != id_[:-1])]))
            q, id_, score = q[first], id_[first], np.add.reduceat(score, first)
            place, rank = best_of(q, id_, score, k)
            yield pa.RecordBatch.from_arrays([pa.array(qids[q[place]]), pa.array(id_[place]), pa.array(score[place]), pa.array(rank.astype(np.int32))], ["qid", "id", "score", "rank"])

    return run


def in_places(m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places, values): of each row the places that aren't 0, in order, and what is there; rows with fewer have zeros after them."""
    zero = m == 0
    places = np.argsort(zero, axis=1, kind="stable")[:, : max(1, int((~zero).sum(axis=1).max(initial=0)))]
    return places, np.take_along_axis(m, places, 1)


def inner(flat: np.ndarray, r: np.ndarray, places: np.ndarray, values: np.ndarray, q: np.ndarray) -> np.ndarray:
    """The inner product of each row r of flat and query q, summed in the order of places; zeros add nothing."""
    size = np.count_nonzero(values, axis=1)[q]
    order = np.argsort(-size, kind="stable")  # those of many places first, so that no zeros are added
    r, q = r[order], q[order]
    out = np.zeros(len(r))
    ends = len(r) - np.concatenate([[0], np.cumsum(np.bincount(size, minlength=places.shape[1] + 1))])
    for j in range(places.shape[1]):
        n = ends[j + 1]
        if not n:
            break
        out[:n] += flat[r[:n], places[q[:n], j]] * values[q[:n], j]
    back = np.empty(len(r))
    back[order] = out
    return back


def sized(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(ids, vectors) of batches put together, few at first."""
    some, held, full = [], 0, FIRST
    for batch in batches:
        if batch.num_rows:
            some.append((batch.column(0).to_numpy(), batch.column(1).flatten().to_numpy().reshape(-1, width)))
            held += batch.num_rows
        if held >= full:
            yield tuple(np.concatenate(x) for x in zip(*some))
            some, held, full = [], 0, min(max(FIRST, MANY // width), full * 8)
    if some:
        yield tuple(np.concatenate(x) for x in zip(*some))


class Counts:
    """Queries whose vectors are counts of few places, times a unit, as those of hashed words are.

    Their products with vectors in short whole numbers are sums of these at the places, made once for queries that begin
    with the same places. They are off by half for each count, so they only rule out what can't be among the best.
    """

    def __init__(self, m: np.ndarray, live: np.ndarray):
        own = m[live]
        unit = np.where(own > 0, own, np.inf).min(axis=1, initial=np.inf)
        ok = np.isfinite(unit) & (own >= 0).all(axis=1)
        unit[~ok] = 1.0
        count = np.rint(own / unit[:, None])
        off = np.abs(own - count * unit[:, None]).sum(axis=1)
        ok &= (off < 1e-4) & (count.sum(axis=1) <= FEW)
        self.rest, self.q = live[~ok], live[ok]
        count = count[ok].astype(np.int64)
        self.unit, self.off, self.size = unit[ok], off[ok], count.sum(axis=1)
        self.longest = float(np.sqrt((count * count).sum(axis=1).max(initial=1)))
        common = np.argsort(-count.astype(bool).sum(axis=0), kind="stable")
        at, place = np.nonzero(count[:, common])
        each = np.repeat(common[place], count[:, common][at, place])
        begin = np.concatenate([[0], np.cumsum(self.size)]).tolist()
        rank = np.argsort(common)[each].tolist()
        each = each.tolist()
        order = sorted(range(len(self.q)), key=lambda n: rank[begin[n] : begin[n + 1]])
        self.steps, last = [], []
        for n in order:
            own = each[begin[n] : begin[n + 1]]
            same = 0
            while same < len(own) and same < len(last) and own[same] == last[same]:
                same += 1
            self.steps.append((n, same, own[same:], len(own)))
            last = own

    def near(self, flat: np.ndarray, least: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(query, row) of the vectors that may be among the k best of a query, given the least product that it still takes."""
        n, width = flat.shape
        norm = float(np.sqrt(np.einsum("ij,ij->i", flat, flat, dtype=float).max(initial=0))) or 1.0
        scale = 32_000 / (norm * self.longest)
        short = np.zeros((width, -(-n // 8) * 8), np.int16)
        for lo in range(0, n, 4096):
            short[:, lo : min(n, lo + 4096)] = np.rint(flat[lo : lo + 4096] * scale).T
        error = self.size / 2 + self.off * norm * scale / self.unit + 1
        bars = np.where(np.isneginf(least), -np.inf, (least - 2e-9) * scale / self.unit - error)
        sums: list[np.ndarray] = [np.empty(short.shape[1], np.int16) for _ in range(int(self.size.max(initial=0)))]
        own = list(sums)
        found, rows, bars, twice = [], [], bars.tolist(), (2 * error).tolist()
        for q, same, more, size in self.steps:
            for d, place in enumerate(more, same):
                own[d] = np.add(own[d - 1], short[place], out=sums[d]) if d else short[place]
            total, bar = own[size - 1], bars[q]
            if bar == -np.inf:
                bar = -32_768 if n <= k else max(-32_768, int(np.partition(total[:n], n - k)[n - k] - twice[q]) - 1)
            if bar > 32_767:
                continue
            row = places(total >= max(-32_768, int(np.floor(bar))))
            if len(row) > 2 * k:
                value = total[row]
                row = row[value >= int(np.partition(value, len(row) - k)[len(row) - k]) - twice[q]]
            if len(row):
                rows.append(row)
                found.append((q, len(row)))
        if not rows:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        q, each = np.array(found).T
        q, row = np.repeat(self.q[q], each), np.concatenate(rows)
        return q[row < n], row[row < n]


def places(mask: np.ndarray) -> np.ndarray:
    """np.flatnonzero of a row with few true places and a whole number of eights, which are looked at together."""
    some = (np.flatnonzero(mask.view(np.uint64) != 0)[:, None] * 8 + np.arange(8)).ravel()
    return some[mask[some]]


def hits(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """np.nonzero of a table with few true places, eight of them looked at together."""
    if mask.size % 8:
        return np.nonzero(mask)
    flat = mask.reshape(-1)
    some = (np.flatnonzero(flat.view(np.uint64))[:, None] * 8 + np.arange(8)).ravel()
    some = some[flat[some]]
    return some // mask.shape[1], some % mask.shape[1]


def nearest(asked, k: int, last: bool):
    """Over vectors (id, v): the k of the largest inner product for each query of a block (numbers, matrix).

    Products of whole blocks, in single precision, only rule out what can't be among the best; what may be is summed in the
    order of places. A query without any non-zero place has the smallest ids, at 0.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        qids, m = asked.value
        best = Best(len(qids), k)
        quick, width = m.astype(np.float32), m.shape[1]
        norm = float(np.sqrt((m * m).sum(axis=1).max(initial=0)))
        void = np.flatnonzero(~m.any(axis=1))
        counts = Counts(m, np.flatnonzero(m.any(axis=1)))
        live = counts.rest
        some = quick[live]
        places, values = in_places(m)
        at_once = -(-max(k, 4_000_000 // max(1, len(qids))) // 8) * 8
        step = max(1, CACHED // at_once)
        waiting: list[tuple] = []

        def settle():
            if waiting:
                best.add_all(*(np.concatenate(x) for x in zip(*waiting)))
                waiting.clear()

        held = 0
        for own_all, flat_all in sized(batches, width):
            if len(counts.q):
                q, row = counts.near(flat_all, best.least[counts.q] * 1e-9, k)
                for cut in range(0, len(q), 500_000):
                    some_q, r = q[cut : cut + 500_000], row[cut : cut + 500_000]
                    best.add_all(some_q, own_all[r], np.round(inner(flat_all, r, places, values, some_q), 9))
            flat_all = np.asarray(flat_all, float) if len(live) else flat_all
            if len(void):
                low = np.sort(own_all)[:k]
                best.add_all(np.repeat(void, len(low)), np.tile(low, len(void)), np.zeros(len(void) * len(low)))
            for lo in range(0, len(own_all) if len(live) else 0, at_once):
                own, flat = own_all[lo : lo + at_once], flat_all[lo : lo + at_once]
                few = np.ascontiguousarray(flat.astype(np.float32).T)
                margin = width * 1.2e-7 * norm * float(np.sqrt((flat * flat).sum(axis=1).max())) + 2e-9
                least = best.least[live] * 1e-9
                for from_ in range(0, len(live), step):
                    product = some[from_ : from_ + step] @ few
                    bound = least[from_ : from_ + step]
                    if np.isneginf(bound).any():
                        take = min(k, len(own))
                        own_least = np.partition(product, len(own) - take, axis=1)[:, len(own) - take] - margin
                        bound = np.maximum(bound, own_least)
                    q, row = hits(product >= (bound - margin)[:, None].astype(np.float32))
                    if not len(q):
                        continue
                    q = live[q + from_]
                    waiting.append((q, own[row], np.round(inner(flat, row, places, values, q), 9)))
                    held += len(q)
                if held > 500_000 or np.isneginf(best.least).any():
                    settle()
                    held = 0
        settle()
        for at in range(0, len(qids), 8192):
            q, id_, score = best.rows(np.arange(at, min(at + 8192, len(qids))))
            place, rank = best_of(q, id_, score, k)
            yield pa.RecordBatch.from_arrays([pa.array(qids[q[place]]), pa.array(id_[place]), pa.array(score[place]), *([pa.array(rank.astype(np.int32))] if last else [])], ["qid", "id", "score", *(["rank"] if last else [])])

    return run


def products(asked):
    """Over vectors (id, v): the inner product of each pair of a block (numbers, matrix, pairs' queries, pairs' ids in order)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        qids, m, pair_q, pair_id = asked.value
        places, values = in_places(m)
        for batch in batches:
            own = batch.column(0).to_numpy()
            if not len(own):
                continue
            flat = batch.column(1).flatten().to_numpy().reshape(len(own), -1)
            low, high = np.searchsorted(pair_id, own), np.searchsorted(pair_id, own, "right")
            row = np.repeat(np.arange(len(own)), high - low)
            at = np.arange(len(row)) - np.repeat(np.cumsum(high - low) - (high - low), high - low) + low[row]
            for cut in range(0, len(row), 500_000):
                r, q = row[cut : cut + 500_000], pair_q[at[cut : cut + 500_000]]
                yield pa.RecordBatch.from_arrays([pa.array(qids[q]), pa.array(own[r]), pa.array(inner(flat, r, places, values, q))], ["qid", "id", "near"])

    return run


def reach(few: np.ndarray, floor: float):
    """Over vectors (id, v): whether the inner product with one of few reaches the floor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat = batch.column(1).flatten().to_numpy().astype(float).reshape(batch.num_rows, few.shape[1])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array((flat @ few.T).max(axis=1, initial=-np.inf) >= floor)], ["qid", "near"])

    return run
