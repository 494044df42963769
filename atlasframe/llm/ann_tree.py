"""Nearest neighbours by a hierarchical k-means tree and best-bin-first traversal.

The tree is fitted on a bounded sample (about SAMPLE vectors, by hash), so it fits every task; every vector of the
table is then put into a leaf. A query takes nodes from a priority queue: leaves by the distance of their centre, inner
nodes by the least distance that a centre below them can have, so that leaves come nearest first. How many are visited
is calibrated: about PROBES vectors outside the sample are searched by brute force in blocks, and the number of leaves is
widened until they would have met TARGET of their true neighbours; a query goes on until its leaves hold k vectors
besides its own. Neighbouring leaves form regions of about BLOCK vectors, so that a query gives one list of its nearest for each
region and not for each leaf; larger leaves are cut into blocks, and blocks into parts, so a vector that a third of all rows
repeat makes many tasks, not one.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .storage import materialize, workers_import_us

SAMPLE, PROBES, TARGET, BRANCH, LEAF, BLOCK, QUERY_BLOCK = 32768, 96, 0.94, 8, 64, 2048, 256
#: Blocks of a leaf that one task compares with the leaf's queries.
PART = 8


def usable(vector: Column, size: int) -> Column:
    """Of the right length, with finite components, not all of them zero."""
    return vector.isNotNull() & (F.size(vector) == size) & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(vector, lambda x: x != 0)


class Tree:
    """Nested k-means. children[i] are the nodes below node i, leaf[i] its leaf number or -1."""

    def __init__(self, x: np.ndarray, branch: int = BRANCH, leaf: int = LEAF, seed: int = 7):
        self.centers, self.children, self.leaf, self.n_leaves = [x.mean(0) if len(x) else np.zeros(0)], [[]], [-1], 0
        rng = np.random.default_rng(seed)
        todo = [(0, x)]
        while todo:
            node, own = todo.pop()
            centers = _kmeans(np.unique(own, axis=0), branch, rng) if len(own) > leaf else None
            if centers is None or len(centers) < 2:
                self.leaf[node], self.n_leaves = self.n_leaves, self.n_leaves + 1
                continue
            side = _nearest(own, centers)
            for k, c in enumerate(centers):
                self.children[node].append(len(self.centers))
                todo.append((len(self.centers), own[side == k]))
                self.centers.append(c)
                self.children.append([])
                self.leaf.append(-1)
        # How far the centre of a leaf below a node can be from the node's own.
        self.reach = [0.0] * len(self.centers)
        for node in range(len(self.centers) - 1, -1, -1):  # children stand after their parents
            for c in self.children[node]:
                self.reach[node] = max(self.reach[node], self.reach[c] + float(np.sqrt(((self.centers[c] - self.centers[node]) ** 2).sum())))
        self.below = [np.stack([self.centers[c] for c in own]) if own else None for own in self.children]

    def assign(self, x: np.ndarray) -> np.ndarray:
        """The leaf that greedy descent reaches, for each row."""
        out = np.zeros(len(x), np.int32)
        todo = [(0, np.arange(len(x)))]
        while todo:
            node, rows = todo.pop()
            if self.leaf[node] >= 0:
                out[rows] = self.leaf[node]
            elif len(rows):
                side = _nearest(x[rows], self.below[node])
                todo += [(c, rows[side == k]) for k, c in enumerate(self.children[node])]
        return out

    def order(self, q: np.ndarray, most: int, enough: Callable[[int], bool] = lambda leaf: True) -> list[int]:
        """The first most leaves, nearest centre first, and further ones until enough, asked of each leaf in turn, holds."""
        queue, found, done = [(0.0, 0)], [], False
        while queue and not (len(found) >= most and done):
            _, node = heapq.heappop(queue)
            if self.leaf[node] >= 0:
                found.append(self.leaf[node])
                done = enough(self.leaf[node])
                continue
            far = np.sqrt(((self.below[node] - q) ** 2).sum(1))
            for c, d in zip(self.children[node], far, strict=True):
                heapq.heappush(queue, (float(d) - self.reach[c], c))
        return found


def _nearest(x: np.ndarray, centers: np.ndarray) -> np.ndarray:
    return ((centers**2).sum(1) - 2 * (x @ centers.T)).argmin(1)


def _kmeans(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 8) -> np.ndarray:
    centers = x[rng.choice(len(x), min(k, len(x)), replace=False)]
    for _ in range(rounds):
        side = _nearest(x, centers)
        centers = np.stack([x[side == j].mean(0) for j in range(len(centers)) if (side == j).any()])
    return centers


def _matrix(lists: pa.Array, size: int) -> np.ndarray:
    return lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, size)


def _topk(ids: np.ndarray, x: np.ndarray, leaves: np.ndarray, query_ids: np.ndarray, q: np.ndarray, visited: list | None, k: int) -> pa.RecordBatch:
    """Each query's k nearest of one block, by true distance, ties to the smaller id; of the leaves that it visits, if given."""
    order = np.argsort(leaves, kind="stable")
    ids, x, leaves = ids[order], x[order], leaves[order]
    out: list[list] = [[], [], [], []]
    for n, (i, v) in enumerate(zip(query_ids, q, strict=True)):
        at = np.arange(len(ids))
        if visited is not None:
            low, high = np.searchsorted(leaves, visited[n], "left"), np.searchsorted(leaves, visited[n], "right")
            at = np.concatenate([at[a:b] for a, b in zip(low, high, strict=True)])
        far = np.sqrt(((x[at] - v) ** 2).sum(1))
        far[ids[at] == i] = np.inf
        near = np.argpartition(far, k - 1)[:k] if len(far) > k else np.arange(len(far))
        near = np.flatnonzero(far <= far[near].max()) if len(near) else near
        near = near[np.lexsort((ids[at][near], far[near]))][:k]
        near = near[far[near] < np.inf]
        for column, values in zip(out, (np.full(len(near), i), ids[at][near], far[near], leaves[at][near]), strict=True):
            column.append(values)
    a, b, c, d = (np.concatenate(x) if x else np.zeros(0) for x in out)
    return pa.RecordBatch.from_arrays([pa.array(a.astype(np.int64)), pa.array(b.astype(np.int64)), pa.array(c.astype(np.float64)), pa.array(d.astype(np.int32))], names=["query_id", "vec_id", "score", "leaf"])


def _scan(rows: DataFrame, size: int, k: int, probes=None) -> DataFrame:
    """Each row has a block of vectors (block: array<struct<vec_id, v, leaf>>) and of queries (queries: array<struct<query_id, q, leaves>>), if not those of probes, a broadcast (ids, vectors)."""

    def run(batches):
        for batch in batches:
            blocks = batch.column(0)
            for r in range(batch.num_rows):
                b = blocks[r].values
                if probes is None:
                    q = batch.column(1)[r].values
                    ids, own = q.field("query_id").to_numpy(zero_copy_only=False), _matrix(q.field("q"), size)
                    visited = [x.values.to_numpy() for x in q.field("leaves")]
                else:
                    ids, own = probes.value
                    visited = None
                yield _topk(b.field("vec_id").to_numpy(zero_copy_only=False), _matrix(b.field("v"), size), b.field("leaf").to_numpy(zero_copy_only=False), ids, own, visited, k)

    return rows.select("block", *(["queries"] if probes is None else [])).mapInArrow(run, "query_id long, vec_id long, score double, leaf int")


def _best(found: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def _regions(leaf_rows: dict[int, int]) -> dict[int, tuple[int, int]]:
    """For each leaf its region and that region's rows: leaves of consecutive numbers, which lie near each other, up to BLOCK rows together."""
    found: dict[int, int] = {}
    held: list[int] = []
    for leaf, n in sorted(leaf_rows.items()):
        if not held or held[-1] + n > BLOCK:
            held.append(0)
        held[-1] += n
        found[leaf] = len(held) - 1
    return {leaf: (r, held[r]) for leaf, r in found.items()}


def _blocks(rows: DataFrame, sizes: DataFrame, most: int, fields: Column) -> DataFrame:
    """rows (vec_id, region, ...) as one row per block of about most rows of one region: (region, salt, block of fields). sizes (region, count): a row for each region."""
    salted = rows.join(F.broadcast(sizes), "region").withColumn("salt", F.pmod(F.xxhash64("vec_id", F.monotonically_increasing_id()), F.ceil(F.col("count") / most)))
    return salted.groupBy("region", "salt").agg(F.collect_list(fields).alias("block"))


def _hashed(rows: DataFrame, low: float, high: float, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and vectors of the rows whose hash lies in that share of its range, most at most."""
    place = F.pmod(F.xxhash64("vec_id", "v"), F.lit(1 << 30)) / (1 << 30)
    found = rows.where((place >= low) & (place < high)).select("vec_id", "v").limit(most).toPandas()
    return found["vec_id"].to_numpy(np.int64), np.stack(found["v"].to_numpy()).astype(np.float64) if len(found) else np.zeros((0, 0))


def nearest(vectors: DataFrame, is_query: Column, k: int = 10, vec_id: str = "vec_id", vector: str = "embedding", target: float = TARGET) -> DataFrame:
    """(query_id, rank, vec_id, score): for the rows that is_query picks, their k nearest of all other ids by Euclidean distance.

    Null ids and vectors that are null, zero, of another length than most (of equally frequent lengths the largest
    counts), or hold null or non-finite components take no part. Of rows repeated with one id, each can be found; none is found
    by its own id, and rows repeated with id and vector ask once. Equal distances go to the smaller id. Other columns may have any name. An empty table gives no rows.
    """
    spark = vectors.sparkSession
    workers_import_us(spark)
    sizes = vectors.groupBy(F.size(vector).alias("size")).count().orderBy(F.desc("count"), F.desc("size")).first()
    size = sizes["size"] if sizes and sizes["size"] and sizes["size"] > 0 else 0
    rows = vectors.where(F.col(vec_id).isNotNull() & usable(F.col(vector), size)).select(F.col(vec_id).cast("long").alias("vec_id"), F.col(vector).alias("v"), F.coalesce(is_query, F.lit(False)).alias("is_query"))
    total = rows.count()
    if not total:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    # Probes are rows that the tree wasn't fitted on, where there are so many.
    share = SAMPLE / total if total > SAMPLE + 2 * PROBES else 1.0
    ids, x = _hashed(rows, 0.0, share, 2 * SAMPLE)
    if not len(ids):
        ids, x = _hashed(rows, 0.0, 1.0, 2 * SAMPLE)
    probe_ids, probes = _hashed(rows, share, share + PROBES / total, 2 * PROBES) if share < 1 else (ids[:: max(1, len(ids) // PROBES)], x[:: max(1, len(ids) // PROBES)])
    if not len(probe_ids):
        probe_ids, probes = ids[:PROBES], x[:PROBES]
    tree = Tree(x)
    shared, shared_probes = spark.sparkContext.broadcast(tree), spark.sparkContext.broadcast((probe_ids, probes))
    kind = dict(rows.dtypes)["v"]

    def put(batches):
        for b in batches:
            yield b.append_column("leaf", pa.array(shared.value.assign(_matrix(b.column("v"), size)) if b.num_rows else [], pa.int32()))

    placed = materialize(rows.mapInArrow(put, f"vec_id long, v {kind}, is_query boolean, leaf int"))
    counted = placed.groupBy("leaf").count()
    leaf_rows = {r["leaf"]: r["count"] for r in counted.collect()}  # at most one row for each leaf of the tree
    regions = _regions(leaf_rows)
    region_of = F.broadcast(spark.createDataFrame([(leaf, r) for leaf, (r, _) in regions.items()], "leaf int, region int"))
    sizes = spark.createDataFrame(sorted(set(regions.values())), "region int, count long")
    blocks = materialize(_blocks(placed.join(region_of, "leaf"), sizes, BLOCK, F.struct("vec_id", "v", "leaf")))

    # Calibration: where the probes' true neighbours stand in the order of leaves says how many leaves are enough.
    true = _best(_scan(blocks, size, k, shared_probes), k).select("query_id", "leaf").collect()
    ranks = {int(i): {leaf: n for n, leaf in enumerate(tree.order(v, tree.n_leaves))} for i, v in zip(probe_ids, probes, strict=True)}
    needed = np.sort([ranks[r["query_id"]][r["leaf"]] + 1 for r in true])
    visits = int(needed[min(len(needed) - 1, int(np.ceil(target * len(needed))))]) if len(needed) else 1

    def visit(batches):
        for b in batches:
            rows, at, leaves = [], [], []
            for n, (q, own) in enumerate(zip(_matrix(b.column("v"), size) if b.num_rows else [], b.column("own").to_pylist(), strict=True)):
                left = k + own

                def enough(leaf: int) -> bool:
                    nonlocal left
                    left -= leaf_rows.get(leaf, 0)
                    return left <= 0

                of_region: dict[int, list[int]] = {}
                for leaf in shared.value.order(q, visits, enough):
                    if leaf in regions:
                        of_region.setdefault(regions[leaf][0], []).append(leaf)
                rows += [n] * len(of_region)
                at += of_region
                leaves += map(sorted, of_region.values())
            taken = b.select(["vec_id", "v"]).take(pa.array(rows, pa.int64()))
            yield pa.RecordBatch.from_arrays([*taken.columns, pa.array(at, pa.int32()), pa.array(leaves, pa.list_(pa.int32()))], names=["vec_id", "v", "region", "leaves"])

    repeated = placed.groupBy("vec_id").agg(F.count("*").alias("own")).where("own > 1")
    asked = placed.where("is_query").dropDuplicates(["vec_id", "v"]).join(repeated, "vec_id", "left").select("vec_id", "v", F.coalesce("own", F.lit(1)).alias("own"))
    asked = materialize(asked.mapInArrow(visit, f"vec_id long, v {kind}, region int, leaves array<int>"))
    packs = _blocks(asked, asked.groupBy("region").count(), QUERY_BLOCK, F.struct(F.col("vec_id").alias("query_id"), F.col("v").alias("q"), "leaves")).select("region", F.col("block").alias("queries"))
    # A region's packs go to each part of its blocks.
    n_parts = F.ceil(F.col("count") / (BLOCK * PART)).cast("int")
    packs = packs.join(F.broadcast(sizes), "region").withColumn("part", F.explode(F.sequence(F.lit(0), n_parts - 1))).drop("count")
    parted = blocks.join(F.broadcast(sizes), "region").withColumn("part", F.pmod(F.col("salt"), n_parts).cast("int"))
    found = _best(_scan(parted.join(packs, ["region", "part"]), size, k), k)
    return found.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
