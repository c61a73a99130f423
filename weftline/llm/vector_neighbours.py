"""The most similar vectors of every vector (problem 1).

A forest of random-projection trees is fitted on a bounded sample; every vector is indexed in one leaf of each tree.
A vector searches all trees through one shared priority queue: nodes are taken by the smallest margin to the splits on
their path, whatever tree they are in, until ``visits`` leaves are found. Queries and members meet in the leaves, where
cosines come from blocked matrix products; the best few of each leaf are reranked in double precision.

Scale: nothing but the trees is broadcast or collected, and these are bounded by ``SAMPLE_ROWS``: a tree is fitted to
``rows / leaf_rows`` leaves, but never to more than half the sample's rows. Beyond that a leaf grows with the data; where one
holds more than ``SPLIT_FROM`` times ``leaf_rows`` members, the task that has it splits it on with a tree of its own, and a
query scans its ``INNER_VISITS`` nearest parts. So a query meets about ``leaf_rows`` members a visit at any size, and work
grows as rows times visits. Blocks hold fewer leaves as leaves grow, which bounds what a task holds. Exact copies - however
many - are searched as one vector that stands for its ``k + 1`` lowest ids, which is all that can be among anyone's k
nearest; the copies of a vector held by more than ``HOT`` rows get their answer from a short broadcast list, in place.

Defined results
    * a usable vector has the given width, only finite numbers and not all zero; others (null, short, empty) are left out.
    * similarities equal to 9 decimals are ties and the lower id wins; rows delivered twice count once.
    * with fewer than k + 1 usable vectors everybody else is returned; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from weftline.plans.runtime import written

#: Rows of the sample the trees are fitted on (bounded; every row is indexed).
SAMPLE_ROWS = 40_000
#: Nodes up to which margins come from one matrix product (a choice of speed, results are the same).
DENSE_NODES = 4_096
#: A leaf is split on where it holds so many times ``leaf_rows`` members; a query then scans so many of its parts.
SPLIT_FROM, INNER_VISITS = 4, 3
#: Rows of one vector from which its copies are answered from a broadcast list (at most rows / HOT vectors).
HOT = 100_000


def fit_tree(sample: np.ndarray, leaves: int, rng: np.random.Generator) -> dict[str, np.ndarray]:
    """One tree as arrays: per inner node a direction, an offset and two children (negative: leaf ``-child - 1``)."""
    direction, offset, children, count = [], [], [], 0
    if leaves <= 1 or len(sample) < 4:
        return {"direction": np.zeros((0, sample.shape[1]), np.float32), "offset": np.zeros(0, np.float32), "children": np.zeros((0, 2), np.int32), "leaves": 1}
    target = max(2.0, len(sample) / leaves)
    todo = [(np.arange(len(sample)), -1, 0)]
    while todo:
        rows, parent, side = todo.pop()
        split = _split(sample[rows], rng) if len(rows) > 1.5 * target else None
        if split is None:
            me, count = -count - 1, count + 1
        else:
            me = len(direction)
            direction.append(split[0])
            offset.append(split[1])
            children.append([0, 0])
            todo += [(rows[split[2]], me, 0), (rows[~split[2]], me, 1)]
        if parent >= 0:
            children[parent][side] = me
    if not direction:
        return fit_tree(sample[:0], 1, rng)
    return {"direction": np.array(direction, np.float32), "offset": np.array(offset, np.float32), "children": np.array(children, np.int32), "leaves": count}


def _split(x: np.ndarray, rng: np.random.Generator):
    """A hyperplane between two random members, pulled towards the two halves' means; halves of at least a tenth."""
    for _ in range(4):
        a, b = x[rng.choice(len(x), 2, replace=False)]
        part = x[rng.choice(len(x), min(len(x), 256), replace=False)]
        for _ in range(4):
            near = part @ (a - b) > 0
            if near.all() or not near.any():
                break
            a, b = part[near].mean(0), part[~near].mean(0)
            a, b = a / (np.linalg.norm(a) or 1), b / (np.linalg.norm(b) or 1)
        h = a - b
        norm = np.linalg.norm(h)
        if norm < 1e-7:
            continue
        h = h / norm
        p = x @ h
        if not 0.1 <= (p > 0).mean() <= 0.9:
            t = np.median(p)
            if not 0.1 <= (p > t).mean() <= 0.9:
                continue
            return h, t, p > t
        return h, 0.0, p > 0
    return None


class Forest:
    """Trees with one numbering of nodes and leaves, and the shared-queue search over them."""

    def __init__(self, trees: list[dict]) -> None:
        node = leaf = 0
        roots, children = [], []
        for t in trees:
            c = t["children"]
            children.append(np.where(c >= 0, c + node, c - leaf))
            roots.append(node if len(c) else -leaf - 1)
            node, leaf = node + len(c), leaf + t["leaves"]
        self.roots, self.leaves = np.array(roots, np.int32), leaf
        self.children = np.concatenate(children) if children else np.zeros((0, 2), np.int32)
        self.direction = np.concatenate([t["direction"] for t in trees])
        self.offset = np.concatenate([t["offset"] for t in trees])

    def margins(self, x: np.ndarray) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
        """A function of ``(rows, nodes)`` that gives the rows' signed margins to the nodes' splits.

        Up to ``DENSE_NODES`` nodes one matrix product for all of them is cheaper than a product for each pair asked for.
        """
        if len(self.direction) <= DENSE_NODES:
            every = x @ self.direction.T - self.offset
            return lambda r, nodes: every[r, nodes]
        return lambda r, nodes: np.einsum("ij,ij->i", x[r], self.direction[nodes]) - self.offset[nodes]

    def home(self, x: np.ndarray, margins=None) -> np.ndarray:
        """The leaf of each row in each tree, ``(rows, trees)``."""
        margins = margins or self.margins(x)
        at = np.broadcast_to(self.roots, (len(x), len(self.roots))).copy()
        while (inner := at >= 0).any():
            r, c = np.nonzero(inner)
            nodes = at[r, c]
            margin = margins(r, nodes)
            at[r, c] = self.children[nodes, (margin <= 0).astype(np.int8)]
        return -at - 1

    def search(self, x: np.ndarray, visits: int, margins=None) -> np.ndarray:
        """The ``visits`` leaves a shared priority queue over all trees reaches first, ``(rows, <= visits)``, -1 for none.

        The queues of all rows advance together, one level a step, each keeping its ``2 * visits`` best entries.
        """
        n, width = len(x), min(self.leaves, 2 * visits)
        margins = margins or self.margins(x)
        at = np.broadcast_to(self.roots, (n, len(self.roots))).copy()
        pri = np.full(at.shape, np.inf, np.float32)
        while (inner := (at >= 0) & (pri > -np.inf)).any():
            r, c = np.nonzero(inner)
            nodes = at[r, c]
            margin = margins(r, nodes)
            far = np.full(at.shape, -np.inf, np.float32)
            far_at = np.full(at.shape, -1, np.int32)
            far[r, c] = np.minimum(pri[r, c], -np.abs(margin))
            far_at[r, c] = self.children[nodes, (margin > 0).astype(np.int8)]
            at[r, c] = self.children[nodes, (margin <= 0).astype(np.int8)]
            pri[r, c] = np.minimum(pri[r, c], np.abs(margin))
            at, pri = np.concatenate([at, far_at], 1), np.concatenate([pri, far], 1)
            if at.shape[1] > width:
                best = np.argpartition(-pri, width - 1, axis=1)[:, :width]
                at, pri = np.take_along_axis(at, best, 1), np.take_along_axis(pri, best, 1)
        if at.shape[1] > visits:
            best = np.argpartition(-pri, visits - 1, axis=1)[:, :visits]
            at, pri = np.take_along_axis(at, best, 1), np.take_along_axis(pri, best, 1)
        return np.where(pri > -np.inf, -at - 1, -1)


def top_in_leaf(queries: np.ndarray, members: np.ndarray, keep: int, block: int = 512, fold: int = 8) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers of each query's ``keep`` best members by single-precision cosine, ``(queries, <= keep)``, and the cosines.

    Columns are folded: the best ``keep`` lie in the ``keep`` best of the columns' groups, so only those are ranked.
    """
    n = len(members)
    if n <= keep:
        return np.broadcast_to(np.arange(n), (len(queries), n)), queries @ members.T
    groups = -(-n // fold)
    if groups <= 2 * keep:
        fold, groups = 1, n
    found, cosines = np.empty((len(queries), keep), np.int64), np.empty((len(queries), keep), np.float32)
    for at in range(0, len(queries), block):
        part = queries[at : at + block]
        s = np.full((len(part), fold * groups), -2, np.float32)
        s[:, :n] = part @ members.T
        if fold > 1:
            best = s.reshape(len(part), fold, groups).max(axis=1)
            column = np.argpartition(-best, keep - 1, axis=1)[:, :keep]
            column = (column[:, None, :] + (np.arange(fold) * groups)[None, :, None]).reshape(len(part), -1)
            inner = np.argpartition(-np.take_along_axis(s, column, 1), keep - 1, axis=1)[:, :keep]
            found[at : at + block] = np.take_along_axis(column, inner, 1)
        else:
            found[at : at + block] = np.argpartition(-s, keep - 1, axis=1)[:, :keep]
        cosines[at : at + block] = np.take_along_axis(s, found[at : at + block], 1)
    return found, cosines


def parts_of(members: np.ndarray, queries: np.ndarray, leaf_rows: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """``(members, queries)`` row numbers of the parts that a leaf is scanned in: itself, or those of a tree of its own."""
    if len(members) <= SPLIT_FROM * leaf_rows:
        yield np.arange(len(members)), np.arange(len(queries))
        return
    rng = np.random.default_rng(len(members))
    sample = members if len(members) <= SAMPLE_ROWS else members[rng.choice(len(members), SAMPLE_ROWS, replace=False)]
    tree = Forest([fit_tree(sample, round(len(members) / leaf_rows), rng)])
    step = range(0, max(len(members), len(queries)), 2000)
    home = np.concatenate([tree.home(members[i : i + 2000])[:, 0] for i in step if i < len(members)])
    reached = np.concatenate([_wide(tree.search(queries[i : i + 2000], INNER_VISITS)) for i in step if i < len(queries)])
    order, asked = np.argsort(home, kind="stable"), np.argsort(reached.ravel(), kind="stable")
    start, first = (np.searchsorted(v, np.arange(tree.leaves + 1)) for v in (home[order], reached.ravel()[asked]))
    for leaf in range(tree.leaves):
        inside, ask = order[start[leaf] : start[leaf + 1]], asked[first[leaf] : first[leaf + 1]] // reached.shape[1]
        if len(inside) and len(ask):
            yield inside, ask


def _wide(reached: np.ndarray) -> np.ndarray:
    return np.pad(reached, ((0, 0), (0, INNER_VISITS - reached.shape[1])), constant_values=-1)


def search_block(vid: np.ndarray, raw: np.ndarray, member: np.ndarray, query: np.ndarray, k: int, leaf_rows: int = 512) -> tuple[np.ndarray, ...]:
    """Best ``k + 1`` others of each query of a block of leaves: ``(query id, far, other id)``, far = -cosine in 1e-9 units.

    ``member`` and ``query`` are ``(row, leaf)`` pairs. Leaves are ranked in single precision with a margin of three. One leaf
    alone shows how near a query's ``k + 2`` best (itself among them) must be at least: what is farther, by more than single
    precision can err, is out, and the survivors are reranked exactly in double precision.
    """
    unit = raw.astype(np.float64)
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    single = unit.astype(np.float32)
    qs, ms, ss, floor = [], [], [], np.full(len(vid), -2, np.float32)
    for leaf in np.unique(query[:, 1]):
        inside, ask = member[member[:, 1] == leaf, 0], query[query[:, 1] == leaf, 0]
        for some, asking in parts_of(single[inside], single[ask], leaf_rows) if len(inside) else ():
            asked, there = ask[asking], inside[some]
            best, cosines = top_in_leaf(single[asked], single[there], k + 4)
            if best.shape[1] >= k + 2:
                at = best.shape[1] - k - 2
                np.maximum.at(floor, asked, np.partition(cosines, at, axis=1)[:, at])
            qs.append(np.repeat(asked, best.shape[1]))
            ms.append(there[best.ravel()])
            ss.append(cosines.ravel())
    if not qs:
        return (np.zeros(0, np.int64),) * 3
    q, m = np.concatenate(qs), np.concatenate(ms)
    near = np.concatenate(ss) >= floor[q] - np.float32(1e-5)
    pairs = np.unique(q[near] * np.int64(len(vid)) + m[near])
    q, m = pairs // len(vid), pairs % len(vid)
    other = vid[q] != vid[m]
    q, m = q[other], m[other]
    far = np.empty(len(q), np.int64)
    for at in range(0, len(q), 50_000):
        part = slice(at, at + 50_000)
        far[part] = -np.rint(np.einsum("ij,ij->i", unit[q[part]], unit[m[part]]) * 1e9).astype(np.int64)
    order = np.lexsort((vid[m], far, q))
    q, m, far = q[order], m[order], far[order]
    start = np.flatnonzero(np.r_[True, q[1:] != q[:-1]]) if len(q) else np.zeros(0, np.int64)
    nth = np.arange(len(q)) - np.repeat(start, np.diff(np.r_[start, len(q)]))
    near = nth <= k
    return vid[q[near]], far[near], vid[m[near]]


def lists(flat: pa.Array, sizes: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(sizes)].astype(np.int32)), flat)


def binary_rows(x: np.ndarray) -> pa.Array:
    """Each row of a float32 matrix as one binary value, without a copy per row."""
    x = np.ascontiguousarray(x, np.float32)
    offsets = (np.arange(len(x) + 1) * x.shape[1] * 4).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(x), [None, pa.py_buffer(offsets), pa.py_buffer(x)])


def usable_vectors(df: DataFrame, key: str, vector: str, width: int) -> DataFrame:
    """``(id, h, v)`` of every usable row: 128 hash bits of the direction in millionths, and the vector as float32 bytes.

    One numpy pass an Arrow batch; expressions over array elements would cost the JVM fifty times as much.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, vectors = batch.column(0), batch.column(1)
            fits = pc.and_(pc.equal(pc.list_value_length(vectors), width), pc.is_valid(ids)).fill_null(False)
            ids, vectors = ids.filter(fits), vectors.filter(fits)
            x = np.asarray(vectors.flatten().to_numpy(zero_copy_only=False), np.float32).reshape(-1, width)
            good = np.isfinite(x).all(1) & (x != 0).any(1)
            x = x[good]
            unit = x.astype(np.float64)
            unit /= np.linalg.norm(unit, axis=1, keepdims=True)
            step = np.floor(unit * 1e6 + 0.5).astype(np.int32)
            digest = pa.array([xxhash.xxh3_128_digest(row.tobytes()) for row in step], pa.binary())
            yield pa.RecordBatch.from_arrays([ids.filter(pa.array(good)), digest, binary_rows(x)], names=["id", "h", "v"])

    return df.select(F.col(key).cast("bigint").alias("id"), F.col(vector).cast("array<float>").alias("v")).mapInArrow(run, "id bigint, h binary, v binary")


def distinct_vectors(rows: DataFrame, k: int) -> DataFrame:
    """Per distinct direction ``(h, vid, reps, v)``: ``vid`` is the lowest id with it, ``reps`` its ``k + 1`` lowest ids.

    The rank filter prunes a hot vector's copies before the shuffle, so a third of all rows in one vector costs no task
    more than ``k + 1`` rows a map task.
    """
    nth = F.row_number().over(Window.partitionBy("h").orderBy("id"))
    low = rows.groupBy("id", "h").agg(F.first("v").alias("v")).withColumn("nth", nth).where(F.col("nth") <= k + 1)
    return low.groupBy("h").agg(F.sort_array(F.collect_list("id")).alias("reps"), F.min_by("v", "id").alias("v")).withColumn("vid", F.col("reps")[0])


def similar_vectors(
    df: DataFrame,
    key: str = "datum_id",
    vector: str = "embedding",
    k: int = 5,
    width: int = 64,
    trees: int = 4,
    leaf_rows: int = 512,
    visits: int = 30,
    sample_rows: int = SAMPLE_ROWS,
    block_leaves: int = 32,
    seed: int = 7,
    hot_rows: int = HOT,
) -> DataFrame:
    """``(<key>, neighbour, similarity, rank)``: for each usable vector its ``k`` most similar others by cosine.

    A vector is sent once to each block of ``block_leaves`` neighbouring leaves it lives in or searches. The key must be
    an integer column.
    """
    spark = df.sparkSession
    rows = usable_vectors(df, key, vector, width)
    distinct = written(distinct_vectors(rows, k), "vectors")
    total = distinct.count()

    share = min(1.0, 1.2 * sample_rows / max(total, 1))
    taken = distinct.select("v") if share >= 1 else distinct.select("v").sample(fraction=share, seed=seed)
    sample = np.frombuffer(b"".join(taken.limit(sample_rows).toPandas()["v"]), np.float32).astype(np.float64).reshape(-1, width)
    sample = (sample / np.linalg.norm(sample, axis=1, keepdims=True)).astype(np.float32)
    rng = np.random.default_rng(seed)
    leaves = max(1, round(total / leaf_rows))
    fitted = Forest([fit_tree(sample, leaves, rng) for _ in range(trees)])
    forest = spark.sparkContext.broadcast(fitted)
    # leaves that outgrow their size come in smaller blocks
    block_leaves = max(1, min(block_leaves, int(block_leaves * leaf_rows * fitted.leaves / max(1, 0.75 * total * trees))))
    del sample, fitted

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = forest.value
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                batch = whole.slice(at, 1000)
                vid = batch.column(0).to_numpy()
                raw = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.float32).reshape(-1, width)
                unit = raw.astype(np.float64)
                unit = (unit / np.linalg.norm(unit, axis=1, keepdims=True)).astype(np.float32)
                margins = f.margins(unit)
                home, reached = f.home(unit, margins), f.search(unit, visits, margins)
                r, c = np.nonzero(reached >= 0)
                row = np.r_[np.repeat(np.arange(len(vid)), home.shape[1]), r]
                leaf = np.r_[home.ravel(), reached[r, c]].astype(np.int32)
                inside = np.r_[np.ones(home.size, bool), np.zeros(len(r), bool)]
                block = leaf // block_leaves
                order = np.lexsort((leaf, block, row))
                row, leaf, inside, block = row[order], leaf[order], inside[order], block[order]
                start = np.flatnonzero(np.r_[True, (row[1:] != row[:-1]) | (block[1:] != block[:-1])])
                group = np.repeat(np.arange(len(start)), np.diff(np.r_[start, len(row)]))
                columns = [pa.array(block[start]), pa.array(vid[row[start]]), binary_rows(raw[row[start]])]
                columns += [lists(pa.array(leaf[at_]), np.bincount(group[at_], minlength=len(start))) for at_ in (inside, ~inside)]
                yield pa.RecordBatch.from_arrays(columns, names=["block", "vid", "v", "member", "query"])

    def search(table: pa.Table) -> pa.Table:
        vid = table.column("vid").to_numpy()
        raw = np.frombuffer(b"".join(table.column("v").to_pylist()), np.float32).reshape(-1, width)
        pairs = []
        for name in ("member", "query"):
            column = table.column(name).combine_chunks()
            sizes = np.diff(column.offsets.to_numpy())
            pairs.append(np.stack([np.repeat(np.arange(len(vid)), sizes), column.flatten().to_numpy()], 1))
        q, far, other = search_block(vid, raw, *pairs, k, leaf_rows)
        start = np.flatnonzero(np.r_[True, q[1:] != q[:-1]]) if len(q) else np.zeros(0, np.int64)
        options = pa.StructArray.from_arrays([pa.array(far), pa.array(other)], names=["far", "b"])
        return pa.table({"a": pa.array(q[start]), "options": lists(options, np.diff(np.r_[start, len(q)]))})

    placed = distinct.select("vid", "v").mapInArrow(place, "block int, vid bigint, v binary, member array<int>, query array<int>")
    found = placed.groupBy("block").applyInArrow(search, "a bigint, options array<struct<far:bigint,b:bigint>>")
    merged = F.array_distinct(F.flatten(F.collect_list("options")))
    # exact similarities decide; the k + 1 nearest distinct vectors hold everyone's k nearest rows
    nearest = found.groupBy("a").agg(F.slice(F.array_sort(merged), 1, k + 1).alias("o")).select("a", F.explode("o").alias("o"))
    reps = distinct.select(F.col("vid").alias("b"), "reps")
    outside = nearest.select("a", "o.far", F.col("o.b").alias("b")).join(reps, "b").select("a", "far", F.explode("reps").alias("neighbour"))
    # every copy of a vector sees the same outsiders, and its own other copies at similarity 1
    own = distinct.where(F.size("reps") > 1).select(F.col("vid").alias("a"), F.lit(-1_000_000_000).cast("bigint").alias("far"), F.explode("reps").alias("neighbour"))
    option = F.struct("far", "neighbour")
    options = outside.unionByName(own).groupBy("a").agg(F.slice(F.array_sort(F.collect_list(option)), 1, 2 * k + 2).alias("options"))
    # rows of a vector: its representatives by their array; further copies of a hot vector by a join on its hash
    few = distinct.where(F.size("reps") <= k).select(F.col("vid").alias("a"), F.explode("reps").alias("id"))
    hot = distinct.where(F.size("reps") > k).select(F.col("vid").alias("a"), "h")
    many = rows.select("id", "h").join(hot, "h")
    very = [r["h"] for r in rows.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > hot_rows).select("h").collect()] if total else []
    if very:
        # rows of the hottest vectors never move: their few answers come to them
        shared = F.broadcast(hot.where(F.col("h").isin(very)).join(options, "a").select("h", "options"))
        many = many.where(~F.col("h").isin(very))
        copies = rows.select("id", "h").where(F.col("h").isin(very)).join(shared, "h").select("id", "options").dropDuplicates(["id"])
    members = few.unionByName(many.select("a", "id").distinct()).join(options, "a").select("id", "options")
    members = members.unionByName(copies) if very else members
    picked = F.slice(F.filter("options", lambda o: o["neighbour"] != F.col("id")), 1, k)
    out = members.select("id", F.posexplode(picked).alias("pos", "o"))
    kind = df.schema[key].dataType
    return out.select(F.col("id").cast(kind).alias(key), F.col("o.neighbour").cast(kind).alias("neighbour"), (F.col("o.far") / -1e9).alias("similarity"), (F.col("pos") + 1).alias("rank"))


def neighbour_pairs(df: DataFrame, key: str = "datum_id", **options) -> DataFrame:
    """Unordered pairs of which at least one is among the k most similar of the other."""
    near = similar_vectors(df, key, **options)
    return near.select(F.least(key, "neighbour").alias(f"{key}_a"), F.greatest(key, "neighbour").alias(f"{key}_b")).distinct()
