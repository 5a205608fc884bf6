"""The k most similar vectors of every vector.

A hierarchical k-means tree is fitted on a bounded sample.  Every vector is
stored in one leaf, and searches the leaves in the order in which a priority
queue over the tree's nodes reaches them, best bin first.  How many leaves are
visited is calibrated: for a set of queries the exact neighbours are computed,
and visits are widened until the wanted share of them lies in a visited leaf.
Vectors and visits meet in a shuffle by region, a run of neighbouring leaves,
so a query is sent once for all leaves of a region; large regions are cut into
shards, so no task holds more than a bounded number of vectors.  Regions are
taken in rounds, whose shuffles hold a bounded multiple of the vectors.
"""

from __future__ import annotations

import gc
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from civicspark.session import cut

#: Rows the tree is fitted on: so many, or a dozen for each leaf where those are more; at most SAMPLE_MOST.
SAMPLE_ROWS, SAMPLE_LEAF, SAMPLE_MOST = 24_000, 12, 400_000
#: Queries whose exact neighbours calibrate the number of visits.
CALIBRATION_QUERIES = 400
#: Children of a node.
BRANCHES = 16
#: Leaves of a tree, at most: bounds the size of what is sent to the executors.
MAX_LEAVES = 32_768
#: Vectors of a leaf, on average.
LEAF_ROWS = 1600
#: Leaves of a region: neighbours in the tree, as leaves are numbered along its branches.
REGION_LEAVES = 16
#: Vectors of a shard of a region, on average at most; it holds up to QUERY_SHARE times as many queries.
SHARD_ROWS, QUERY_SHARE = 30_000, 4
#: Copies of the vectors that are shuffled in a round, of stored ones and of queries.
ROUND_COPIES = 4
#: Leaves that a query may visit at first; calibration doubles them until the recall is reached, with all leaves at the latest.
FIRST_VISITS = 64


class Tree:
    """A k-means tree: arrays of centres, children and leaves.

    Node 0 is the root.  ``children[n]`` holds the nodes below n, filled up
    with -1; ``leaf[n]`` is the number of n's leaf, or -1 for an inner node.
    """

    def __init__(self, centres: np.ndarray, children: np.ndarray, leaf: np.ndarray):
        self.centres, self.children, self.leaf = centres, children, leaf
        self.squares = (centres**2).sum(1)
        self.leaves = int(leaf.max()) + 1
        # squared distances between the children of each node
        near = centres[children]
        self.apart = ((near[:, :, None, :] - near[:, None, :, :]) ** 2).sum(-1) if len(centres) * children.shape[1] ** 2 * centres.shape[1] < 1 << 24 else np.stack(
            [((c[:, None] - c[None]) ** 2).sum(-1) for c in near]
        )

    @staticmethod
    def fit(x: np.ndarray, leaf_rows: float, branches: int = BRANCHES, rounds: int = 10) -> Tree:
        """The tree of ``x``, whose leaves hold at most ``leaf_rows`` rows of it, by Lloyd's iteration."""
        rng = np.random.default_rng(7)
        centres, children, leaf, leaves = [x.mean(0) if len(x) else np.zeros(x.shape[1], np.float32)], [[]], [-1], 0
        open_nodes = [(0, np.arange(len(x)))]
        while open_nodes:
            node, rows = open_nodes.pop()
            k = min(branches, int(np.ceil(len(rows) / leaf_rows)))
            part = np.zeros(len(rows), int)
            if k > 1:
                y = x[rows]
                c = y[rng.choice(len(rows), k, replace=False)]
                for _ in range(rounds):
                    part = (y @ c.T * -2 + (c**2).sum(1)).argmin(1)
                    for j in range(k):
                        if (own := part == j).any():
                            c[j] = y[own].mean(0)
                part = (y @ c.T * -2 + (c**2).sum(1)).argmin(1)
            kinds = np.unique(part)
            if len(kinds) < 2:  # small enough, or copies of one vector
                leaf[node], leaves = leaves, leaves + 1
                continue
            for j in kinds:
                own = rows[part == j]
                children[node].append(len(centres))
                open_nodes.append((len(centres), own))
                centres.append(x[own].mean(0))
                children.append([])
                leaf.append(-1)
        width = max(1, max(map(len, children)))
        table = np.full((len(centres), width), -1, np.int32)
        for n, below in enumerate(children):
            table[n, : len(below)] = below
        return Tree(np.asarray(centres, np.float32), table, np.asarray(leaf, np.int32))

    def _detours(self, x: np.ndarray, nodes: np.ndarray) -> np.ndarray:
        """Squared distances from each row to the boundaries between the cell it falls in and its siblings.

        0 for the nearest child of the row's node; infinite where there is no child.
        """
        below = self.children[nodes]
        d = self.squares[below] - 2 * np.einsum("ijk,ik->ij", self.centres[below], x, optimize=False)
        d[below < 0] = np.inf
        best = d.argmin(1)
        ahead = d - d[np.arange(len(d)), best][:, None]
        gap = np.maximum(self.apart[nodes, best], 1e-12)
        return np.where(np.isfinite(ahead), ahead**2 / (4 * gap), np.inf)

    def home(self, x: np.ndarray) -> np.ndarray:
        """The leaf in which each row of x is stored."""
        nodes = np.zeros(len(x), np.int64)
        inner = np.flatnonzero(self.leaf[nodes] < 0)
        while len(inner):
            # rows of one node share a product
            for n in np.unique(nodes[inner]):
                rows = inner[nodes[inner] == n]
                below = self.children[n][self.children[n] >= 0]
                nodes[rows] = below[(self.squares[below] - 2 * x[rows] @ self.centres[below].T).argmin(1)]
            inner = inner[self.leaf[nodes[inner]] < 0]
        return self.leaf[nodes]

    def visits(self, x: np.ndarray, most: int, widest: float = np.inf) -> tuple[np.ndarray, np.ndarray]:
        """The leaves that each row of x visits, in order (-1 where there are fewer), and their detours.

        A node's detour is the sum of the squared distances to the cell
        boundaries that are crossed on the way to it.  All rows go through
        their own priority queue at once: in each step a row takes the node
        with the smallest detour, and either visits it, if it is a leaf, or
        puts the node's children in.  A row ends after ``most`` leaves, or
        when no node within the detour ``widest`` is left.
        """
        n, most, w = len(x), min(most, self.leaves), self.children.shape[1]
        out, costs, found = np.full((n, most), -1, np.int32), np.full((n, most), np.inf, np.float32), np.zeros(n, np.int64)
        queue, cost = np.zeros((n, 4 * w), np.int32), np.full((n, 4 * w), np.inf, np.float32)
        used = np.ones(n, np.int64)
        cost[:, 0] = 0
        live = np.arange(n)
        while len(live):
            at = cost[live].argmin(1)
            best = cost[live, at]
            keep = np.isfinite(best) & (best <= widest)
            live, at, best = live[keep], at[keep], best[keep]
            nodes = queue[live, at]
            cost[live, at] = np.inf
            is_leaf = self.leaf[nodes] >= 0
            done = live[is_leaf]
            out[done, found[done]] = self.leaf[nodes[is_leaf]]
            costs[done, found[done]] = best[is_leaf]
            found[done] += 1
            grow, parents = live[~is_leaf], nodes[~is_leaf]
            if len(grow):
                if used[grow].max() + w > queue.shape[1]:
                    cost = np.pad(cost, ((0, 0), (0, queue.shape[1])), constant_values=np.inf)
                    queue = np.pad(queue, ((0, 0), (0, queue.shape[1])))
                place = used[grow][:, None] + np.arange(w)
                queue[grow[:, None], place] = self.children[parents]
                cost[grow[:, None], place] = best[~is_leaf][:, None] + self._detours(x[grow], parents)
                used[grow] += w
            live = live[found[live] < most]
        return out, costs


def _matrix(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The vectors of unit length in a list column, and which rows they are.

    Null vectors, vectors of another width, with a null or infinite element,
    or without direction take no part.
    """
    sizes = np.asarray(column.value_lengths().fill_null(-1))
    rows = np.flatnonzero(sizes == width)
    if not len(rows):
        return np.zeros((0, width), np.float32), rows
    flat = column.take(pa.array(rows)).flatten()
    x = flat.to_numpy(zero_copy_only=False).astype(np.float32).reshape(len(rows), width)
    norm = np.sqrt((x.astype(np.float64) ** 2).sum(1))
    good = np.isfinite(norm) & (norm > 0)
    return (x[good] / norm[good, None]).astype(np.float32), rows[good]


def _blobs(x: np.ndarray) -> pa.Array:
    """The rows of x as binary values."""
    x = np.ascontiguousarray(x, np.float32)
    step = x.shape[1] * 4
    offsets = np.arange(len(x) + 1, dtype=np.int32) * step
    return pa.Array.from_buffers(pa.binary(), len(x), [None, pa.py_buffer(offsets), pa.py_buffer(x)])


def _rows(column: pa.ChunkedArray | pa.Array, width: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks)
    return np.frombuffer(b"".join(column.to_pylist()), np.float32).reshape(-1, width)


def _top(sims: np.ndarray, k: int) -> np.ndarray:
    """The columns of each row's k largest entries."""
    if sims.shape[1] <= k:
        return np.tile(np.arange(sims.shape[1]), (len(sims), 1))
    return np.argpartition(-sims, k - 1, axis=1)[:, :k]


def _units(vectors: DataFrame, width: int, then, schema: str) -> DataFrame:
    """``then(ids, unit vectors)`` for every batch of (id, vec), as a table with ``schema``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, rows = _matrix(batch.column(1), width)
            if len(rows):
                yield from then(batch.column(0).take(pa.array(rows)), x)

    return vectors.mapInArrow(run, schema)


def _sample(units: DataFrame, rows: int, limit: int, width: int, salt: str) -> tuple[list, np.ndarray]:
    """At most ``limit`` of the unit vectors, picked by the hash of their id."""
    share = min(1.0, 1.2 * limit / max(rows, 1))
    picked = (
        units.withColumn("h", F.pmod(F.xxhash64("id", F.lit(salt)), F.lit(1 << 30)))
        .where(F.col("h") <= int(share * (1 << 30)))
        .orderBy("h", "id").limit(limit)
        .select("id", "vec").toArrow()
    )
    return picked.column("id").to_pylist(), _rows(picked.column("vec"), width) if picked.num_rows else np.zeros((0, width), np.float32)


def _calibrate(base: DataFrame, tree: Tree, ids: list, queries: np.ndarray, k: int, least: float, recall: float) -> tuple[float, int]:
    """The detour within which the share ``recall`` of the queries' exact neighbours lies, and the most leaves to visit.

    The queries, a bounded set, are held against all rows; of each batch of
    rows only the k best of each query are kept.
    """
    if not len(ids):
        return 0.0, 1
    own = {v: i for i, v in enumerate(ids)}

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _rows(batch.column(1), queries.shape[1])
            sims = queries @ x.T
            for r, v in enumerate(batch.column(0).to_pylist()):
                if v in own:
                    sims[own[v], r] = -2
            best = _top(sims, k)
            q = np.repeat(np.arange(len(queries)), best.shape[1])
            s = np.take_along_axis(sims, best, 1).ravel()
            good = s >= least
            yield pa.RecordBatch.from_arrays(
                [pa.array(q[good].astype(np.int32)), pa.array(s[good]), batch.column(0).take(pa.array(best.ravel()[good])), pa.array(tree.home(x[best.ravel()[good]]))],
                ["q", "sim", "id", "leaf"],
            )

    found = (
        base.mapInArrow(exact, "q int, sim float, id string, leaf int")
        .groupBy("q", "id").agg(F.max("sim").alias("sim"), F.first("leaf").alias("leaf"))
        .groupBy("q").agg(F.slice(F.sort_array(F.collect_list(F.struct("sim", "leaf")), asc=False), 1, k).alias("best"))
        .select("q", F.explode("best.leaf").alias("leaf")).toPandas()
    )
    if not len(found):
        return 0.0, 1
    q, leaf = found["q"].to_numpy(), found["leaf"].to_numpy()
    most = FIRST_VISITS
    while True:
        order, costs = tree.visits(queries, most)
        hit = order[q] == leaf[:, None]
        needed = np.sort(np.where(hit.any(1), costs[q, hit.argmax(1)], np.inf))
        widest = needed[min(len(needed) - 1, int(np.ceil(recall * len(needed))))]
        if np.isfinite(widest) or most >= tree.leaves:
            return float(widest), most
        most *= 2


def nearest(
    vectors: DataFrame, id_col: str, vector_col: str, k: int = 5, width: int = 64, min_similarity: float = -1.0, recall: float = 0.985,
    leaf_rows: int = LEAF_ROWS, sample_rows: int = SAMPLE_ROWS,
) -> DataFrame:
    """For every vector the k others with the highest cosine similarity.

    Gives ``id``, ``neighbor`` and ``similarity`` (at least
    ``min_similarity``), at most k rows for each id.  Rows with the same id
    count once.  Rows with a null id, a null or all-zero vector or one of
    another width take no part.  Ties at the k-th place are broken by id.
    ``recall`` is the share of the exact neighbours that the calibrated search
    has to reach on the calibration queries.
    """
    given = vectors.select(F.col(id_col).cast("string").alias("id"), F.col(vector_col).cast("array<float>").alias("vec")).where("id is not null and vec is not null")

    def plain(ids: pa.Array, x: np.ndarray) -> Iterator[pa.RecordBatch]:
        yield pa.RecordBatch.from_arrays([ids, _blobs(x)], ["id", "vec"])

    units = _units(given, width, plain, "id string, vec binary")
    rows = given.count()
    leaves = min(MAX_LEAVES, max(1, rows / leaf_rows))
    _, sample = _sample(units, rows, min(SAMPLE_MOST, max(sample_rows, int(leaves * SAMPLE_LEAF))), width, "tree")
    tree = Tree.fit(sample, max(1.0, len(sample) / leaves))
    ids, queries = _sample(units, rows, CALIBRATION_QUERIES, width, "calibration")
    widest, most = _calibrate(units, tree, ids, queries, k, min_similarity, recall)
    shared, size = vectors.sparkSession.sparkContext.broadcast(tree), REGION_LEAVES

    def place(ids: pa.Array, x: np.ndarray) -> Iterator[pa.RecordBatch]:
        tree = shared.value
        for lo in range(0, len(x), 2048):
            part = x[lo : lo + 2048]
            home, order = tree.home(part), tree.visits(part, most, widest)[0]
            yield pa.RecordBatch.from_arrays([ids.slice(lo, len(part)), _blobs(part), pa.array(home), _by_region(order, size)], ["id", "vec", "home", "visit"])

    placed = cut(_units(given, width, place, "id string, vec binary, home int, visit array<struct<region:int,leaves:array<int>>>"))
    return _meet(placed, k, width, min_similarity)


def _by_region(order: np.ndarray, size: int) -> pa.ListArray:
    """The leaves that each row visits (-1 is none), as a list of regions, of ``size`` leaves, with their leaves."""
    row, _ = np.nonzero(order >= 0)
    leaf = order[order >= 0]
    by = np.lexsort((leaf, row))
    row, leaf = row[by], leaf[by].astype(np.int32)
    region = leaf // size
    first = np.flatnonzero(np.r_[True, (row[1:] != row[:-1]) | (region[1:] != region[:-1])][: len(row)])
    leaves = pa.ListArray.from_arrays(pa.array(np.r_[first, len(row)].astype(np.int32)), pa.array(leaf))
    regions = pa.StructArray.from_arrays([pa.array(region[first]), leaves], ["region", "leaves"])
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(row[first], np.arange(len(order) + 1)).astype(np.int32)), regions)


def _rounds(placed: DataFrame) -> list[list[tuple[int, int, int, int]]]:
    """The shards of all regions by round: region, shard, shards of the region, and parts of its queries.

    A region's vectors are dealt out to as many shards, its queries to as many
    parts, as keep both bounded.  Vectors are copied for each part, queries for
    each shard.
    """
    stored = placed.groupBy(F.floor(F.col("home") / REGION_LEAVES).cast("int").alias("region")).agg(F.count("*").alias("n"))
    asked = placed.select(F.explode("visit.region").alias("region")).groupBy("region").agg(F.count("*").alias("q"))
    # a row for each region, at most MAX_LEAVES by REGION_LEAVES
    sizes = sorted(tuple(r) for r in stored.join(asked, "region").select("region", "n", "q").collect())
    most, held, out = ROUND_COPIES * sum(n for _, n, _ in sizes), 0, [[]]
    for region, n, q in sizes:
        shards, parts = -(-n // SHARD_ROWS), -(-q // (SHARD_ROWS * QUERY_SHARE))
        for shard in range(shards):
            copies = n // shards * parts + q
            if out[-1] and held + copies > most:
                out.append([])
                held = 0
            out[-1].append((region, shard, shards, parts))
            held += copies
    return out


def _meet(placed: DataFrame, k: int, width: int, least: float) -> DataFrame:
    """Vectors and visits brought together by region, in rounds, and the k best of each query."""
    spark = placed.sparkSession
    rounds = _rounds(placed)
    best = None
    for shards in rounds:
        found = _best(_searched(placed, shards, k, width, least), k)
        if len(rounds) > 1:
            found = cut(found)
            # the shuffle files of a round are removed when nothing refers to them any more
            gc.collect()
            spark._jvm.System.gc()
        best = found if best is None else best.unionByName(found)
    if len(rounds) > 1:
        best = _best(best.select("id", F.explode("best").alias("b")).select("id", "b.neighbor", (-F.col("b.less")).alias("similarity")), k)
    return best.select("id", F.explode("best").alias("b")).select("id", F.col("b.neighbor").alias("neighbor"), (-F.col("b.less")).alias("similarity"))


def _best(met: DataFrame, k: int) -> DataFrame:
    return met.groupBy("id").agg(F.slice(F.array_sort(F.collect_set(F.struct((-F.col("similarity")).alias("less"), "neighbor"))), 1, k).alias("best"))


def _searched(placed: DataFrame, shards: list[tuple[int, int, int, int]], k: int, width: int, least: float) -> DataFrame:
    """The k best of each query in each leaf that it visits, among the vectors of the given shards."""
    table = F.broadcast(placed.sparkSession.createDataFrame(shards, "region int, shard int, shards int, parts int"))
    homes = placed.select("id", "vec", "home", F.floor(F.col("home") / REGION_LEAVES).cast("int").alias("region")).join(table, "region").where(F.pmod(F.xxhash64("id"), "shards") == F.col("shard"))
    # stored once for each part of the queries, searched once for each shard of the region
    stored = homes.select("region", "shard", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(True).alias("stored"), "id", "vec", F.array("home").alias("leaves"))
    visits = placed.select("id", "vec", F.explode("visit").alias("v")).select("id", "vec", "v.region", "v.leaves").join(table, "region")
    asked = visits.select("region", "shard", F.pmod(F.xxhash64("id", F.lit("q")), "parts").cast("int").alias("part"), F.lit(False).alias("stored"), "id", "vec", "leaves")

    def search(table: pa.Table) -> pa.Table:
        is_stored = np.asarray(table.column("stored"))
        ids = np.asarray(table.column("id").to_pylist(), object)
        x = _rows(table.column("vec"), width)
        leaves = table.column("leaves").combine_chunks()
        leaf, owner = np.asarray(leaves.flatten()), np.repeat(np.arange(len(ids)), np.asarray(leaves.value_lengths()))
        by = np.argsort(leaf, kind="stable")
        leaf, owner = leaf[by], owner[by]
        out_id, out_nb, out_sim = [], [], []
        for own in np.split(owner, np.flatnonzero(np.diff(leaf)) + 1):
            here, there = own[is_stored[own]], own[~is_stored[own]]
            if not len(here) or not len(there):
                continue
            kept, first = np.unique(ids[here], return_index=True)
            q_ids, q_first = np.unique(ids[there], return_index=True)
            y, q = x[here[first]], there[q_first]
            same = np.searchsorted(kept, q_ids)
            for lo in range(0, len(q), 1024):
                sims = x[q[lo : lo + 1024]] @ y.T
                at = same[lo : lo + 1024]
                inside = np.flatnonzero(at < len(kept))
                inside = inside[kept[at[inside]] == q_ids[lo + inside]]
                sims[inside, at[inside]] = -2
                best = _top(sims, k)
                s = np.take_along_axis(sims, best, 1)
                r, c = np.nonzero(s >= max(least, -1.5))
                out_id.append(q_ids[lo + r])
                out_nb.append(kept[best[r, c]])
                out_sim.append(s[r, c])
        cat = lambda parts, kind: pa.array(np.concatenate(parts) if parts else [], kind)
        return pa.table({"id": cat(out_id, pa.string()), "neighbor": cat(out_nb, pa.string()), "similarity": cat(out_sim, pa.float32())})

    return stored.unionByName(asked).groupBy("region", "shard", "part").applyInArrow(search, "id string, neighbor string, similarity float")


def similar_chunks(chunks: DataFrame, k: int = 5, min_similarity: float = 0.85) -> DataFrame:
    """Pairs of chunks of which one is among the k most similar of the other (p6_found)."""
    found = nearest(chunks, "chunk_id", "embedding", k, 64, min_similarity)
    return found.select(F.least("id", "neighbor").alias("chunk_a"), F.greatest("id", "neighbor").alias("chunk_b")).distinct()
