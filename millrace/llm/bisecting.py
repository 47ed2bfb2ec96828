"""Bisecting k-means over texts: nodes are split in two until they are compact; the leaves are the groups.

Nodes of more than LOCAL records are split by passes over all records: their tree of centres lives on the driver, a
record's node is found by walking down the broadcast tree, and each pass sends only sums by node. A node of at most LOCAL
records that is still wide then goes to one task, which splits it to the end. So the driver's tree grows with the number
of records divided by LOCAL, whatever the number of groups.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions.spans import U, mix, pieces, tokens
from millrace.session import broadcast_value, cut

#: Dimensions of a record's vector, and passes that settle the two halves of a split.
SIZE, PASSES = 192, 3
#: Records of a node that one task splits to the end: about 6 MB of vectors.
LOCAL = 8192


def vectors(texts: pa.Array) -> np.ndarray:
    """A unit vector for each text: each of its distinct tokens adds one at a hashed place; 0 for texts without tokens."""
    spans, doc, start, end = tokens(texts)
    h = spans.hash(start, end)
    out = np.zeros((len(texts), SIZE), np.float32)
    if len(h):
        _, one = np.unique(mix(h ^ mix(doc.astype(U))), return_index=True)
        sign = np.where((h[one] >> U(63)) == 0, 1.0, -1.0).astype(np.float32)
        np.add.at(out, (doc[one], (h[one] % U(SIZE)).astype(np.int64)), sign)
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)


class Tree:
    """children[node] = (left, right) of a split node; centres[node] its mean."""

    def __init__(self, centre: np.ndarray):
        self.centres, self.children = [centre], {}

    def walk(self, x: np.ndarray) -> np.ndarray:
        node = np.zeros(len(x), np.int64)
        todo = np.arange(len(x))
        while len(todo):
            split = [k for k in np.unique(node[todo]).tolist() if k in self.children]
            if not split:
                break
            moved = []
            for k in split:
                rows = todo[node[todo] == k]
                a, b = self.children[k]
                near_a = ((x[rows] - self.centres[a]) ** 2).sum(axis=1) <= ((x[rows] - self.centres[b]) ** 2).sum(axis=1)
                node[rows] = np.where(near_a, a, b)
                moved.append(rows)
            todo = np.concatenate(moved)
        return node


def _sums(points: DataFrame, tree: Tree) -> dict[int, tuple[int, np.ndarray, float]]:
    """Of each leaf: size, sum of vectors, and sum of squared distances to its centre. As many rows as leaves come back."""
    shared = broadcast_value(points.sparkSession, tree)

    def run(batches):
        count, total, spread = {}, {}, {}
        for batch in batches:
            x = np.frombuffer(b"".join(batch.column(0).to_pylist()), np.float32).reshape(-1, SIZE)
            node = shared.value.walk(x)
            for k in np.unique(node).tolist():
                own = x[node == k]
                count[k] = count.get(k, 0) + len(own)
                total[k] = total.get(k, 0) + own.sum(axis=0, dtype=np.float64)
                spread[k] = spread.get(k, 0.0) + float(((own - shared.value.centres[k]) ** 2).sum())
        yield pa.RecordBatch.from_arrays([pa.array(list(count), pa.int64()), pa.array(list(count.values()), pa.int64()), pa.array([t.tolist() for t in total.values()], pa.list_(pa.float64())), pa.array(list(spread.values()), pa.float64())], ["node", "n", "total", "spread"])

    places = F.array(*(F.sum(F.col("total")[k]) for k in range(SIZE)))
    rows = points.select("x").mapInArrow(run, "node long, n long, total array<double>, spread double").groupBy("node").agg(F.sum("n").alias("n"), places.alias("total"), F.sum("spread").alias("spread")).collect()
    shared.destroy()
    return {r["node"]: (r["n"], np.array(r["total"]), r["spread"]) for r in rows}


def _wide(n: int, spread: float, compact: float, smallest: int) -> bool:
    return n >= 2 * smallest and spread / n > compact


def cluster(df: DataFrame, key: str, text: str, compact: float = 0.5, smallest: int = 1) -> tuple[DataFrame, Tree, set[int]]:
    """Points (key, text, x), the driver's tree, and those of its leaves that are left to be split by one task each.

    Nodes whose mean squared distance to the centre exceeds `compact` are split until they are compact, have fewer than
    2 * smallest members, can't be split, or have at most LOCAL members; every record is in a leaf at any time."""
    kind = df.schema[key].dataType
    own = df.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text")).filter("key is not null and text is not null")

    def embed(batches):
        for batch in batches:
            for part in pieces(batch, 1):
                x = vectors(part.column(1))
                some = np.flatnonzero(x.any(axis=1))
                yield pa.RecordBatch.from_arrays([*(c.take(pa.array(some)) for c in part.columns), pa.array([v.tobytes() for v in x[some]], pa.binary())], ["key", "text", "x"])

    points = cut(own.mapInArrow(embed, T.StructType([T.StructField("key", kind), T.StructField("text", T.StringType()), T.StructField("x", T.BinaryType())])))
    tree = Tree(np.zeros(SIZE, np.float32))
    sums = _sums(points, tree)
    if not sums:
        return points, tree, set()
    tree.centres[0] = (sums[0][1] / sums[0][0]).astype(np.float32)
    sums = _sums(points, tree)
    done: set[int] = set()
    rng = np.random.default_rng(17)
    while True:
        leaves = {k: v for k, v in sums.items() if k not in tree.children}
        open_ = {k for k, (n, _, s) in leaves.items() if k not in done and _wide(n, s, compact, smallest)}
        wide = sorted(k for k in open_ if leaves[k][0] > LOCAL)
        if not wide:
            return points, tree, open_
        for k in wide:
            step = (rng.standard_normal(SIZE) * 0.05).astype(np.float32)
            tree.children[k] = (len(tree.centres), len(tree.centres) + 1)
            tree.centres += [tree.centres[k] + step, tree.centres[k] - step]
        for _ in range(PASSES):
            sums = _sums(points, tree)
            for k, (n, total, _) in sums.items():
                tree.centres[k] = (total / n).astype(np.float32)
        sums = _sums(points, tree)
        for k in wide:  # a half that got nothing means that the node can't be split
            a, b = tree.children[k]
            if a not in sums or b not in sums:
                del tree.children[k]
                done.add(k)
        if done & set(wide):
            sums = _sums(points, tree)


def _split(x: np.ndarray, centre: np.ndarray, compact: float, smallest: int) -> tuple[np.ndarray, np.ndarray]:
    """The leaf of each row of a node, counted from 0, and the leaves' centres: the node split to the end."""
    rng = np.random.default_rng(17)
    leaf, centres, todo = np.zeros(len(x), np.int64), [], [(np.arange(len(x)), centre)]
    while todo:
        rows, centre = todo.pop()
        own = x[rows]
        if _wide(len(rows), float(((own - centre) ** 2).sum()), compact, smallest):
            step = (rng.standard_normal(SIZE) * 0.05).astype(np.float32)
            a, b = centre + step, centre - step
            for k in range(PASSES + 1):
                near_a = ((own - a) ** 2).sum(axis=1) <= ((own - b) ** 2).sum(axis=1)
                if near_a.all() or not near_a.any():
                    break
                if k < PASSES:
                    a, b = (own[half].mean(axis=0, dtype=np.float64).astype(np.float32) for half in (near_a, ~near_a))
            else:
                todo += [(rows[near_a], a), (rows[~near_a], b)]
                continue
        leaf[rows] = len(centres)
        centres.append(centre)
    return leaf, np.stack(centres)


def _nearest(frame: pd.DataFrame, x: np.ndarray, node: np.ndarray, centres: np.ndarray, typical: int | None) -> pd.DataFrame:
    """Of frame (key, text), whose rows lie in nodes: each node's rows nearest to its centre, or all; the first holds its sums."""
    far = ((x - centres) ** 2).sum(axis=1).astype(np.float64).round(6)
    frame = frame.assign(node=node, far=far).sort_values(["node", "far", "key"])
    place = frame.groupby("node").cumcount()
    sums = frame.groupby("node").far.agg(["size", "sum"])
    first = place == 0
    frame["n"], frame["spread"] = 0, 0.0
    frame.loc[first, "n"], frame.loc[first, "spread"] = sums["size"].to_numpy(), sums["sum"].to_numpy()
    return frame if typical is None else frame[place < typical]


def _leaves(df: DataFrame, key: str, text: str, typical: int | None, compact: float, smallest: int) -> DataFrame:
    """(key, text, node, far, n, spread): of every batch and leaf, the members nearest to the centre, or all of them."""
    points, tree, open_ = cluster(df, key, text, compact, smallest)
    shared = broadcast_value(points.sparkSession, (tree, open_))
    kind = points.schema["key"].dataType
    found = T.StructType([T.StructField("key", kind), T.StructField("text", T.StringType()), T.StructField("node", T.LongType()), T.StructField("far", T.DoubleType()), T.StructField("n", T.LongType()), T.StructField("spread", T.DoubleType())])
    vectors_of = lambda column: np.frombuffer(b"".join(column.to_pylist()), np.float32).reshape(-1, SIZE)

    def closed(batches):
        tree, open_ = shared.value
        for batch in batches:
            x = vectors_of(batch.column(2))
            node = tree.walk(x)
            k = np.flatnonzero(~np.isin(node, list(open_)))
            if len(k):
                frame = batch.select(["key", "text"]).take(pa.array(k)).to_pandas()
                frame = _nearest(frame, x[k], node[k] * LOCAL, np.stack(tree.centres)[node[k]], typical)
                yield pa.RecordBatch.from_pandas(frame, preserve_index=False)

    def to_split(batches):
        tree, open_ = shared.value
        for batch in batches:
            node = tree.walk(vectors_of(batch.column(2)))
            k = pa.array(np.flatnonzero(np.isin(node, list(open_))))
            yield pa.RecordBatch.from_arrays([*(c.take(k) for c in batch.columns), pa.array(node).take(k)], ["key", "text", "x", "node"])

    def split(tbl: pa.Table) -> pa.Table:
        tbl = tbl.sort_by([("key", "ascending"), ("text", "ascending")])
        x, node = vectors_of(tbl.column("x")), tbl.column("node")[0].as_py()
        leaf, centres = _split(x, shared.value[0].centres[node], compact, smallest)
        frame = _nearest(tbl.select(["key", "text"]).to_pandas(), x, node * LOCAL + leaf, centres[leaf], typical)
        return pa.Table.from_pandas(frame, preserve_index=False)

    rows = points.mapInArrow(closed, found)
    if open_:
        parts = points.mapInArrow(to_split, T.StructType([*points.schema.fields, T.StructField("node", T.LongType())]))
        rows = rows.unionByName(parts.groupBy("node").applyInArrow(split, found))
    return rows


def groups(df: DataFrame, key: str, text: str, typical: int = 3, compact: float = 0.5, smallest: int = 1) -> DataFrame:
    """(group_id, size, dispersion, typical): one row for each leaf, with the texts of its members nearest to the centre.

    Every leaf is compact, or its members can't be told apart; a larger `smallest` leaves nodes of fewer than twice as many members as they
    are. Texts that are null or have no tokens are in no group; repeated rows are separate members; ties go to the smaller key.
    """
    rows = cut(_leaves(df, key, text, typical, compact, smallest))
    best = rows.withColumn("place", F.row_number().over(Window.partitionBy("node").orderBy("far", "key"))).filter(F.col("place") <= typical)
    names = best.groupBy("node").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "text"))), lambda x: x["text"]).alias("typical"))
    size = rows.groupBy("node").agg(F.sum("n").alias("size"), F.sum("spread").alias("spread"))
    return size.join(names, "node").select(F.col("node").alias("group_id"), "size", F.round(F.col("spread") / F.col("size"), 6).alias("dispersion"), "typical")


def members(df: DataFrame, key: str, text: str, compact: float = 0.5, smallest: int = 1) -> DataFrame:
    """(key, group_id): the leaf of every row that is in one."""
    return _leaves(df, key, text, None, compact, smallest).select(F.col("key").alias(key), F.col("node").alias("group_id"))
