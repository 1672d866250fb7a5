"""Centroid clustering by dual-tree Lloyd rounds: exact, in integers.

Vectors are kept as whole numbers, floor(SCALE * x). They stay where they are: each task cuts its rows into blocks of at most BLOCK vectors and builds a cover tree
over each block, once; the blocks with their trees are written to the shared folder. Each round builds a cover tree over the centroids, sends it to
the tasks (k vectors), and walks both trees: a pair of a vector node and a centroid node is dropped where even its nearest points are farther apart than the
vector node's farthest point is from some other centroid. Where one centroid is left, the whole vector node is its own, and prefix sums give the node's sum
without a look at its vectors. Leaf pairs are compared exactly, in 64-bit integers. Bounds are in doubles with a margin of EPS, so equal distances are
never pruned: they reach the leaves, where the smaller number wins.

A task returns a count and a sum for each centroid, whatever the number of its vectors, and only their totals (k vectors) reach the driver.

A cover tree here: a node of level l has a point of its own and lies in a ball of BASE ** l around it; its children have points more than BASE ** (l - 1)
apart, the first of them its own; levels that change nothing are skipped. Nodes of up to LEAF points, or of equal points, are leaves. Each node knows
the true radius of its points, so copies of one vector are one node of radius 0.

Defined results: null vectors, vectors of another length, and those with null, NaN or infinite components are left out. So are those with a component whose whole number reaches
2 ** 27 in magnitude, where squared distances leave 64 bits. Repeated rows and ids are vectors of their own, and a null id is carried along, but it starts no
centroid. Of equal ids the least vector comes first as a start. With fewer than k vectors with ids there are as many centroids as there are. An empty table gives
an empty one; further columns are ignored. An inertia beyond 64 bits is null.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shotloom.llm._words import discard, only, settle, shared_folder

SCALE = 1024
BLOCK, LEAF, BASE = 2048, 16, 1.3
#: The share of the vectors' lengths by which bounds in doubles are widened.
EPS = 1e-6
LIMIT = 1 << 27

Tree = dict[str, np.ndarray]


def cover_tree(points: np.ndarray, leaf: int = LEAF) -> tuple[np.ndarray, Tree]:
    """The points' order, in which every node has a range, and the nodes: start, end, point (a place in the order), radius, first and last (their children), breadth first."""
    x = points.astype(np.float64)

    def far(rows: np.ndarray, centre: int) -> np.ndarray:
        d = x[rows] - x[centre]
        return np.sqrt((d * d).sum(1))

    rows = np.arange(len(x))
    # a node: its rows, its own point first, and their distances from it
    queue = [(rows, far(rows, 0))]
    start, end, radius, first, last = [0], [len(x)], [], [], []
    order = rows.copy()
    at = 0
    while at < len(queue):
        rows, d = queue[at]
        order[start[at] : end[at]] = rows
        radius.append(d.max())
        first.append(len(queue))
        if len(rows) > leaf and d.max() > 0:
            groups, spread = [(rows, d)], d.max()
            while len(groups) == 1:  # levels with one child are skipped
                spread /= BASE
                groups, rest, own, from_own = [], rows, int(rows[0]), d
                while len(rest):
                    near = from_own <= spread
                    near[0] = True
                    groups.append((rest[near], from_own[near]))
                    rest = rest[~near]
                    if len(rest):
                        own = int(rest[0])
                        from_own = far(rest, own)
            place = start[at]
            for group in groups:
                start.append(place)
                place += len(group[0])
                end.append(place)
                queue.append(group)
        last.append(len(queue))
        queue[at] = None
        at += 1
    order = np.empty(len(x), np.int64) if not len(x) else order
    tree = {"start": start, "end": end, "first": first, "last": last}
    return order, {k: np.array(v, np.int32) for k, v in tree.items()} | {"radius": np.array(radius)}


def ordered(points: np.ndarray, leaf: int = LEAF) -> tuple[np.ndarray, np.ndarray, Tree]:
    """Order, points in it, tree. Leaves are written after inner nodes' rows are dealt, so a node's own point is the first of its range."""
    order, tree = cover_tree(points, leaf)
    return order, points[order], tree


class Centroids:
    """The centroids of a round in a cover tree with one point a leaf."""

    def __init__(self, points: np.ndarray) -> None:
        self.points = points
        self.order, self.own, self.tree = ordered(points, 1)
        self.centre = self.own[self.tree["start"]].astype(np.float64)
        self.leaf = self.tree["first"] == self.tree["last"]


def nearest(points: np.ndarray, tree: Tree, c: Centroids, found: dict | None = None) -> tuple[list[tuple[int, int, int]], np.ndarray, np.ndarray]:
    """Ranges (start, end, centroid) that one centroid has alone, places of the other vectors, and the nearest centroid of each of those.

    ``found`` gets the number of node pairs that were looked at, and of pairs of vector and centroid that were compared.
    """
    k = len(c.points)
    whole: list[tuple[int, int, int]] = []
    nodes, alive = np.array([0]), np.ones((1, 1), bool)  # alive[n, j]: centroid node j of ``level`` is open for node n
    level = np.array([0])
    leaves, masks = [], []
    while len(nodes):
        centre = points[tree["start"][nodes]].astype(np.float64)
        radius = tree["radius"][nodes]
        while True:  # down the centroids' tree, dropping pairs on each level
            apart = np.sqrt(np.maximum((centre**2).sum(1)[:, None] - 2 * centre @ c.centre[level].T + (c.centre[level] ** 2).sum(1), 0))
            slack = EPS * (1 + np.sqrt((centre**2).sum(1).max()) + np.sqrt((c.centre**2).sum(1).max()))
            reach = np.where(alive, apart, np.inf).min(1) + radius  # the farthest vector of a node from some centroid
            alive &= apart - radius[:, None] - c.tree["radius"][level] <= (reach + slack)[:, None]
            if found is not None:
                found["nodes"] = found.get("nodes", 0) + int(alive.size)
            if c.leaf[level].all():
                break
            deeper, of = [], []
            for j, n in enumerate(level):
                kids = [n] if c.leaf[n] else range(c.tree["first"][n], c.tree["last"][n])
                deeper.extend(kids)
                of.extend([j] * len(kids))
            level, alive = np.array(deeper), alive[:, of]
        # equal centroids share a leaf; all of its points are candidates
        candidates = np.zeros((len(nodes), k), bool)
        for j, n in enumerate(level):
            candidates[:, c.order[c.tree["start"][n] : c.tree["end"][n]]] |= alive[:, j : j + 1]
        one = candidates.sum(1) == 1
        whole.extend(zip(tree["start"][nodes[one]].tolist(), tree["end"][nodes[one]].tolist(), candidates[one].argmax(1).tolist(), strict=True))
        rest = np.flatnonzero(~one)
        ends = tree["first"][nodes[rest]] == tree["last"][nodes[rest]]
        for n in rest[ends]:
            leaves.append(np.arange(tree["start"][nodes[n]], tree["end"][nodes[n]]))
            masks.append(np.broadcast_to(candidates[n], (len(leaves[-1]), k)))
        kids = [np.arange(tree["first"][nodes[n]], tree["last"][nodes[n]]) for n in rest[~ends]]
        nodes = np.concatenate(kids) if kids else np.zeros(0, np.int64)
        alive = np.repeat(alive[rest[~ends]], [len(x) for x in kids], axis=0) if kids else alive[:0]
    at = np.concatenate(leaves) if leaves else np.zeros(0, np.int64)
    mask = np.concatenate(masks) if masks else np.zeros((0, k), bool)
    if found is not None:
        found["compared"] = found.get("compared", 0) + int(mask.sum())
    best, own = np.full(len(at), np.iinfo(np.int64).max), np.zeros(len(at), np.int64)
    for j in range(k):  # in ascending order, so that equal distances leave the smaller number
        rows = np.flatnonzero(mask[:, j])
        d = squared(points[at[rows]], c.points[j])
        closer = d < best[rows]
        best[rows[closer]], own[rows[closer]] = d[closer], j
    return whole, at, own


def squared(points: np.ndarray, centre: np.ndarray) -> np.ndarray:
    d = points.astype(np.int64) - centre
    return (d * d).sum(-1)


TREE = ("start", "end", "first", "last")
BLOCKS = "ids array<long>, points binary, " + ", ".join(f"{k} binary" for k in TREE) + ", radius binary"


def kept(vectors: DataFrame, size: int, vector: str, id: str) -> DataFrame:
    """id and v, the vectors that take part, in doubles."""
    finite = lambda x: F.coalesce(~F.isnan(x) & (x * F.lit(float(SCALE)) >= F.lit(float(1 - LIMIT))) & (x * F.lit(float(SCALE)) < F.lit(float(LIMIT))), F.lit(False))
    own = only(vectors, id, vector).toDF("id", "v").select(F.col("id").cast("long").alias("id"), F.col("v").cast("array<double>").alias("v"))
    return own.where((F.size("v") == size) & F.forall("v", finite))


def blocks(vectors: DataFrame, size: int, vector: str, id: str) -> DataFrame:
    """The vectors in blocks with their cover trees; points are 32-bit numbers."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                part = batch.slice(at, BLOCK)
                x = np.asarray(part.column(1).flatten().to_numpy(zero_copy_only=False), np.float64).reshape(-1, size)
                order, own, tree = ordered(np.floor(x * SCALE).astype(np.int32))
                ids = part.column(0).take(pa.array(order))
                columns = [pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids), *(pa.array([y.tobytes()], pa.binary()) for y in (own, *(tree[k] for k in TREE), tree["radius"]))]
                yield pa.RecordBatch.from_arrays(columns, names=["ids", "points", *TREE, "radius"])

    return kept(vectors, size, vector, id).mapInArrow(build, BLOCKS)


def _opened(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple[pa.Array, np.ndarray, Tree]]:
    for batch in batches:
        for r in range(batch.num_rows):
            raw = [batch.column(k)[r].as_py() for k in range(1, 3 + len(TREE))]
            tree = {k: np.frombuffer(x, np.int32) for k, x in zip(TREE, raw[1:-1], strict=True)} | {"radius": np.frombuffer(raw[-1], np.float64)}
            yield batch.column(0)[r].values, np.frombuffer(raw[0], np.int32).reshape(-1, size).astype(np.int64), tree


def _totals(stored: DataFrame, centroids: np.ndarray) -> DataFrame:
    """(cluster, place, n, total): the sum of each component over each centroid's vectors."""
    k, size = centroids.shape

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = Centroids(centroids)
        n, sums = np.zeros(k, np.int64), np.zeros((k, size), np.int64)
        for _, points, tree in _opened(batches, size):
            until = np.concatenate([np.zeros((1, size), np.int64), np.cumsum(points, 0)])
            whole, at, own = nearest(points, tree, c)
            for a, b, j in whole:
                n[j] += b - a
                sums[j] += until[b] - until[a]
            n += np.bincount(own, minlength=k)
            for j in np.unique(own):
                sums[j] += points[at[own == j]].sum(0)
        for j in np.flatnonzero(n):
            yield pa.RecordBatch.from_arrays([pa.array([int(j)] * size), pa.array(range(size), pa.int64()), pa.array([int(n[j])] * size), pa.array(sums[j])], names=["cluster", "place", "n", "total"])

    rows = stored.mapInArrow(add, "cluster long, place long, n long, total long")
    exact = F.col("total").cast("decimal(38,0)")
    return rows.groupBy("cluster", "place").agg(F.sum("n").alias("n"), F.sum(exact).alias("total"))


def starts(vectors: DataFrame, k: int, size: int, vector: str, id: str, seed: int) -> np.ndarray:
    """The k vectors with the least hashes of their ids."""
    whole = F.transform("v", lambda x: F.floor(x * F.lit(float(SCALE))))
    first = kept(vectors, size, vector, id).where("id is not null").select(F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256).alias("h"), whole.alias("v"))
    return np.array([r["v"] for r in first.orderBy("h", "v").limit(k).collect()], np.int64).reshape(-1, size)


def fit(vectors: DataFrame, k: int = 8, size: int = 64, rounds: int = 10, vector: str = "embedding", id: str = "vec_id", seed: int = 3, folder: str | None = None) -> tuple[np.ndarray, DataFrame]:
    """The centroids after the rounds, and the blocks of vectors."""
    folder = folder or shared_folder(vectors.sparkSession)
    stored = settle(blocks(vectors, size, vector, id), folder, "blocks")
    centroids = starts(vectors, k, size, vector, id, seed)
    for _ in range(rounds if len(centroids) else 0):
        new = centroids.copy()
        for r in _totals(stored, centroids).collect():  # k * size numbers
            new[r["cluster"], r["place"]] = int(r["total"]) // r["n"]
        if (new == centroids).all():
            break  # further rounds would change nothing
        centroids = new
    return centroids, stored


def assign(stored: DataFrame, centroids: np.ndarray) -> DataFrame:
    """id, cluster, distance (squared) of every vector in the blocks."""
    size = centroids.shape[1]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = Centroids(centroids)
        for ids, points, tree in _opened(batches, size):
            whole, at, own = nearest(points, tree, c)
            cluster = np.zeros(len(points), np.int64)
            for a, b, j in whole:
                cluster[a:b] = j
            cluster[at] = own
            yield pa.RecordBatch.from_arrays([ids, pa.array(cluster), pa.array(squared(points, centroids[cluster]))], names=["id", "cluster", "distance"])

    return stored.mapInArrow(work, "id long, cluster long, distance long")


def cluster(vectors: DataFrame, k: int = 8, size: int = 64, rounds: int = 10, vector: str = "embedding", id: str = "vec_id", seed: int = 3) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256."""
    spark = vectors.sparkSession
    folder = shared_folder(spark)
    centroids, stored = fit(vectors, k, size, rounds, vector, id, seed, folder)
    if not len(centroids):
        return spark.createDataFrame([], "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    found = settle(assign(stored, centroids), folder, "assigned")
    discard(spark, folder, "blocks")
    hashes = [(j, hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest()) for j, c in enumerate(centroids)]
    own = found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("part"))  # k rows
    total = own.agg(F.sum("part").alias("all"))
    about = own.join(F.broadcast(spark.createDataFrame(hashes, "cluster long, centroid_sha256 string")), "cluster").crossJoin(F.broadcast(total))  # one row
    out = found.join(F.broadcast(about), "cluster")
    return out.select(F.col("id").alias("vec_id"), F.col("cluster").cast("int").alias("cluster"), "distance", F.expr("try_cast(part as long)").alias("cluster_inertia"), F.expr("try_cast(`all` as long)").alias("inertia"), "centroid_sha256")
