"""Exact top-k by inner product with M-trees and best-first search.

Vectors become integers, floor(1024 x). Sampled vectors are pivots; each vector goes to its nearest
one, and what a pivot gathers is cut into blocks of bounded size. A block's paged M-tree is built once
and written out: a page has a routing vector, a covering radius, and for each entry the distance to
the routing vector. The pivots with their covering radii are the level above the trees.

For a query q and a vector x under a routing vector p with radius r, the inner product is at most
q.p + |q| r. A query first asks the blocks of the pivot with the highest such bound. Its k-th best score
there is a floor, and it goes on only to pivots whose bounds reach it. In a tree pages are taken in
the order of their bounds until no bound reaches the k-th best score or the floor, and inside a page
the stored distances leave out entries without computing their products. All bounds are rounded up,
so scores are exact integers.
"""

from __future__ import annotations

import heapq
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from meandra.llm.common import cut, group_starts, whole_groups

TOP = 10
SCALE = 1024
EVERY = 100
#: Vectors of a block (fewer if they are long: about VALUES numbers), queries that meet it in one task, pivots at most.
BLOCK, VALUES, QUERIES, PIVOTS = 16_384, 1 << 20, 4_096, 1024
#: Entries of a page, pages under a directory node.
PAGE, FANOUT = 128, 16
_EXACT = 1 << 53


def quantised(vectors: DataFrame) -> DataFrame:
    """(nr, vec_id, v array<long>) of the vectors that take part: not null, no null or non-finite component, not empty."""
    x = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("e"))
    bad = F.exists("e", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    whole = x.filter("vec_id is not null and e is not null and size(e) > 0").filter(~F.coalesce(bad, F.lit(True)))
    fits = lambda c: F.when(F.abs(c) < float(1 << 40), F.floor(c * SCALE)).otherwise(F.raise_error(F.lit("a component is too large for exact scores")).cast("long"))
    return whole.select(F.monotonically_increasing_id().alias("nr"), "vec_id", F.transform("e", fits).alias("v"))


class MTree:
    """Two levels of pages over integer vectors: directory nodes over leaf pages, each with routing vector and radius."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, rows: np.ndarray | None = None, page: int = PAGE):
        self.vectors = vectors.astype(np.float64)  # exact: top_k() sees that products stay under 2^53
        order = self._cluster(self.vectors, np.arange(len(ids)), page)
        place = np.concatenate(order)
        self.ids, self.vectors, self.rows = ids[place], self.vectors[place], (ids if rows is None else rows)[place]
        ends = np.cumsum([len(o) for o in order])
        self.pages = list(zip(np.concatenate(([0], ends[:-1])).tolist(), ends.tolist()))
        self.routing = np.stack([self.vectors[a] for a, _ in self.pages])
        # distance of each entry to its page's routing vector, rounded up
        self.parent = np.concatenate([np.sqrt(((self.vectors[a:b] - r) ** 2).sum(axis=1)) for (a, b), r in zip(self.pages, self.routing)]) + 1e-6
        for a, b in self.pages:  # near entries last: a prefix of each page is what a bound lets through
            far = np.lexsort((self.ids[a:b], -self.parent[a:b]))
            for column in (self.ids, self.rows, self.vectors, self.parent):
                column[a:b] = column[a:b][far]
        self.radius = np.array([self.parent[a] for a, _ in self.pages])
        self.low = np.array([self.ids[a:b].min() for a, b in self.pages])
        # directory: pages in the order of the clustering, FANOUT together
        self.nodes = [(i, min(len(self.pages), i + FANOUT)) for i in range(0, len(self.pages), FANOUT)]
        self.node_routing = np.stack([self.routing[i:j].mean(axis=0) for i, j in self.nodes])
        gaps = [np.sqrt(((self.routing[i:j] - c) ** 2).sum(axis=1)) for (i, j), c in zip(self.nodes, self.node_routing)]
        self.page_parent = np.concatenate(gaps) + 1e-6
        self.node_radius = np.array([(g + self.radius[i:j]).max() for g, (i, j) in zip(gaps, self.nodes)]) + 1e-6

    def packed(self) -> bytes:
        """The tree as bytes; vectors as 32-bit integers where they fit."""
        state = dict(self.__dict__)
        if np.abs(self.vectors).max(initial=0) < 1 << 31:
            state["vectors"] = self.vectors.astype(np.int32)
        return pickle.dumps(state, protocol=5)

    @classmethod
    def unpacked(cls, data: bytes) -> MTree:
        tree = cls.__new__(cls)
        tree.__dict__ = pickle.loads(data)
        tree.vectors = tree.vectors.astype(np.float64)
        return tree

    @staticmethod
    def _cluster(vectors: np.ndarray, rows: np.ndarray, page: int) -> list[np.ndarray]:
        """Halves rows between two far vectors until they fit a page; equal vectors are cut by number."""
        todo, done = [rows], []
        while todo:
            now = todo.pop()
            if len(now) <= page:
                done.append(now)
                continue
            v = vectors[now]
            a = v[((v - v[0]) ** 2).sum(axis=1).argmax()]
            b = v[((v - a) ** 2).sum(axis=1).argmax()]
            side = v @ (b - a)
            cut = np.argsort(side, kind="stable")
            half = len(now) // 2
            todo += [now[cut[half:]], now[cut[:half]]]
        return done

    def search(self, q: np.ndarray, own: int, k: int, floor: float = -np.inf) -> list[tuple[int, int]]:
        """The k best (score, vec_id) without the row `own`: highest score first, ties to the smaller id; none under `floor`."""
        size = float(np.sqrt((q * q).sum())) * (1 + 1e-12) + 1e-6
        at_node = self.node_routing @ q
        queue = [(-float(b), 0, n, 0.0) for n, b in enumerate(at_node + size * self.node_radius) if b >= floor]
        heapq.heapify(queue)
        best: list[tuple[int, int]] = []  # heap of (score, -vec_id), the worst first
        least = floor
        while queue:
            bound, kind, n, known = heapq.heappop(queue)
            if -bound < least:
                break
            if kind == 0:
                i, j = self.nodes[n]
                # first by the stored distance to the node's routing vector, then by the page's own product
                rough = at_node[n] + size * (self.page_parent[i:j] + self.radius[i:j])
                open_ = np.flatnonzero(rough >= least) + i
                if len(open_):
                    exact = self.routing[open_] @ q
                    for p, e, b in zip(open_.tolist(), exact.tolist(), (exact + size * self.radius[open_]).tolist()):
                        heapq.heappush(queue, (-b, 1, p, e))
                continue
            a, b = self.pages[n]
            # entries lie in falling distance to the routing vector: a prefix can still reach the k-th score
            b = a + int(np.searchsorted(-(known + size * self.parent[a:b]), -least, side="right"))
            if a == b:
                continue
            scores = self.vectors[a:b] @ q
            rows = np.flatnonzero(scores >= least)
            if len(rows) > 4 * k:
                rows = rows[np.lexsort((self.ids[a:b][rows], -scores[rows]))[: k + 1]]
            for s, i, row in zip(scores[rows].tolist(), self.ids[a:b][rows].tolist(), self.rows[a:b][rows].tolist()):
                if row == own:
                    continue
                if len(best) < k:
                    heapq.heappush(best, (int(s), -i))
                elif (int(s), -i) > best[0]:
                    heapq.heapreplace(best, (int(s), -i))
            if len(best) == k:
                least = max(floor, best[0][0])
        return [(s, -i) for s, i in sorted(best, reverse=True)]


def _matrix(column: pa.ChunkedArray) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Row numbers and matrix of the vectors of each length."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    ends = column.offsets.to_numpy()
    sizes, flat = np.diff(ends), column.values.to_numpy()
    out = {}
    for d in np.unique(sizes):
        rows = np.flatnonzero(sizes == d)
        out[int(d)] = rows, flat[(ends[:-1][rows][:, None] + np.arange(d)[None, :])]
    return out


def _assign(pivots: dict[int, np.ndarray]):
    """Adds the length, the number of the nearest pivot of that length (-1, the origin, if there is none), and the distance, rounded up."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            d, pivot, dist = (np.zeros(batch.num_rows, t) for t in (np.int64, np.int64, np.float64))
            for size, (rows, m) in _matrix(batch.column(2)).items():
                x = m.astype(np.float64)
                d[rows] = size
                p = pivots.get(size)
                if p is None:
                    pivot[rows], dist[rows] = -1, np.sqrt((x * x).sum(axis=1)) * (1 + 1e-12) + 1e-6
                    continue
                near = np.empty(len(x), np.int64)
                for lo in range(0, len(x), 1024):
                    near[lo : lo + 1024] = ((p * p).sum(axis=1)[None, :] - 2 * x[lo : lo + 1024] @ p.T).argmin(axis=1)
                pivot[rows], dist[rows] = near, np.sqrt(((x - p[near]) ** 2).sum(axis=1)) * (1 + 1e-12) + 1e-6
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(d), pa.array(pivot), pa.array(dist)], [*batch.schema.names, "d", "pivot", "dist"])

    return run


def _build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A packed tree for each block."""
    keys = ["d", "pivot", "part"]
    for found in whole_groups(batches, keys, rows=1):
        starts = group_starts(found, keys)
        for a, b in zip(starts[:-1].tolist(), starts[1:].tolist()):
            group = found.slice(a, b - a)
            ((_, m),) = _matrix(group.column("v")).values()
            tree = MTree(group.column("vec_id").to_numpy(), m, group.column("nr").to_numpy())
            yield pa.RecordBatch.from_arrays([*(pa.array([group.column(k)[0].as_py()], pa.int64()) for k in keys), pa.array([tree.packed()], pa.binary())], [*keys, "tree"])


def _route(levels: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]], first: bool):
    """(nr, vec_id, v, d, pivot, floor): queries to the pivot with the highest bound, or to all others whose bound reaches their floor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            floors = batch.column(batch.schema.get_field_index("floor")).to_numpy(zero_copy_only=False)
            at, to = [], []
            for size, (rows, m) in _matrix(batch.column(2)).items():
                numbers, routing, radius = levels[size]
                for lo in range(0, len(rows), 1024):
                    q = m[lo : lo + 1024].astype(np.float64)
                    norm = np.sqrt((q * q).sum(axis=1)) * (1 + 1e-12) + 1e-6
                    bound = q @ routing.T + norm[:, None] * radius[None, :]
                    best = bound.argmax(axis=1)
                    if first:
                        i, j = np.arange(len(q)), best
                    else:
                        bound[np.arange(len(q)), best] = -np.inf
                        i, j = np.nonzero(bound >= np.maximum(floors[rows[lo : lo + 1024]], -1e300)[:, None])
                    at.append(rows[lo : lo + 1024][i])
                    to.append(numbers[j])
            take = pa.array(np.concatenate(at) if at else np.empty(0, np.int64))
            part = batch.select(["nr", "vec_id", "v", "d", "floor"]).take(take)
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(np.concatenate(to) if to else np.empty(0, np.int64))], [*part.schema.names, "pivot"])

    return run


_KEYS = ["d", "pivot", "part", "spot"]


def _meet(k: int):
    """Queries, in the order of blocks, after the tree of their block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, tree = None, None
        for batch in batches:
            out: list[tuple[int, int, int, int]] = []
            columns = [batch.column(c) for c in (*_KEYS, "tree", "nr", "vec_id", "floor", "v")]
            for i in range(batch.num_rows):
                *now, data, nr, query, floor = (c[i] for c in columns[:-1])
                if data.is_valid:
                    key, tree = [x.as_py() for x in now], MTree.unpacked(data.as_py())
                    continue
                assert key == [x.as_py() for x in now]
                q = columns[-1][i].values.to_numpy().astype(np.float64)
                out += [(nr.as_py(), query.as_py(), vec, score) for score, vec in tree.search(q, nr.as_py(), k, floor.as_py())]
            cols = list(zip(*out)) or [(), (), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["nr", "query_id", "vec_id", "score"])

    return run


def _asked(queries: DataFrame, trees: DataFrame, parts: DataFrame, k: int) -> DataFrame:
    """(nr, query_id, vec_id, score): what the blocks of each query's pivots hold; a block that many ask is met in several tasks."""
    spots = cut(queries.groupBy("d", "pivot").agg(F.ceil(F.count("*") / F.lit(QUERIES)).cast("long").alias("spots")))
    upto = lambda c: F.explode(F.sequence(F.lit(0).cast("long"), F.col(c) - 1))
    places = F.broadcast(parts.join(spots, ["d", "pivot"]))  # a row for each pivot
    asks = queries.join(places, ["d", "pivot"]).withColumn("part", upto("parts")).withColumn("spot", F.pmod(F.xxhash64("nr"), "spots"))
    held = trees.join(places, ["d", "pivot"]).withColumn("spot", upto("spots"))
    none = {"tree": F.lit(None).cast("binary")}
    both = asks.withColumns(none).select(*_KEYS, "tree", "nr", "vec_id", "floor", "v")
    empty = [F.lit(None).cast(t).alias(c) for c, t in (("nr", "long"), ("vec_id", "long"), ("floor", "double"), ("v", "array<long>"))]
    both = both.unionByName(held.select(*_KEYS, "tree", *empty)).withColumn("asks", F.col("tree").isNull())
    both = both.repartition(*_KEYS).sortWithinPartitions(*_KEYS, "asks")
    return both.mapInArrow(_meet(k), "nr long, query_id long, vec_id long, score long")


def _best(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("nr").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def top_k(vectors: DataFrame, k: int = TOP, every: int = EVERY, block: int = BLOCK, pivots: int = PIVOTS) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row whose vec_id `every` divides, the k best other rows.

    Score: inner product of the quantised vectors; ties go to the smaller vec_id; fewer than k rows
    where there are no more. Vectors of another length than the query's are no candidates. Null
    vectors, and those with null or non-finite components, take no part, nor do rows without
    vec_id. Rows that share a vec_id are candidates each, also of each other. Vectors so large that
    scores might pass 2^53 are an error. Other columns are ignored. Empty: no rows.
    """
    rows = cut(quantised(vectors))
    top = F.aggregate(F.transform("v", F.abs), F.lit(0).cast("long"), lambda x, y: F.greatest(x, y))
    facts = rows.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("d"), F.max(top).alias("top")).first()
    n, longest = facts["n"], facts["d"] or 1
    if longest * (facts["top"] or 0) ** 2 >= _EXACT:
        raise ValueError("scores might pass 2^53 and would not be exact")
    block = max(1, min(block, VALUES // longest))
    drawn = rows.orderBy(F.xxhash64("nr", F.lit(5)), "nr").limit(max(1, min(pivots, -(-n // block)))).select("v").collect()
    known: dict[int, np.ndarray] = {}
    for size in {len(r["v"]) for r in drawn}:
        known[size] = np.array([r["v"] for r in drawn if len(r["v"]) == size], np.float64)
    placed = cut(rows.mapInArrow(_assign(known), "nr long, vec_id long, v array<long>, d long, pivot long, dist double"))
    parts = cut(placed.groupBy("d", "pivot").agg(F.ceil(F.count("*") / F.lit(block)).cast("long").alias("parts"), F.max("dist").alias("radius")))
    levels: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
    found = parts.orderBy("d", "pivot").collect()  # a row for each pivot
    for size in {r["d"] for r in found}:
        own = [r for r in found if r["d"] == size]
        numbers = np.array([r["pivot"] for r in own])
        levels[size] = numbers, known[size][numbers] if size in known else np.zeros((1, size)), np.array([r["radius"] for r in own])
    parts = parts.drop("radius")
    dealt = placed.join(F.broadcast(parts), ["d", "pivot"]).withColumn("part", F.pmod(F.xxhash64("nr"), "parts")).select("d", "pivot", "part", "nr", "vec_id", "v")
    trees = cut(dealt.repartition("d", "pivot", "part").sortWithinPartitions("d", "pivot", "part").mapInArrow(_build, "d long, pivot long, part long, tree binary"))
    queries = placed.filter(F.col("vec_id") % every == 0).select("nr", "vec_id", "v", "d", F.lit(float("-inf")).alias("floor"))
    schema = "nr long, vec_id long, v array<long>, d long, floor double, pivot long"
    near = cut(_best(_asked(queries.mapInArrow(_route(levels, True), schema), trees, parts, k), k))
    floors = near.filter(F.col("rank") == k).select("nr", F.col("score").cast("double").alias("tenth"))
    again = queries.join(floors, "nr", "left").withColumn("floor", F.coalesce("tenth", "floor")).select("nr", "vec_id", "v", "d", "floor")
    far = _asked(cut(again.mapInArrow(_route(levels, False), schema)), trees, parts, k)
    return _best(near.drop("rank").unionByName(far), k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
