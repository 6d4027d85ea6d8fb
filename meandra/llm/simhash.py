"""SimHash near-duplicates by a self-join of binary tries.

Fingerprints of 64 bits are the leaves of a binary trie. Two nodes of equal depth are walked
down together; the walk adds up the bits in which their paths differ and stops where the sum
passes the budget, so only pairs of leaves within the budget are met.

One trie over all rows does not fit one task. Three tries share the work: each takes one third
of the bits as its top. A pair with at most two differing bits agrees on at least one third
(two errors cannot hit three thirds), so in that trie the walk need not leave the node reached
by those bits: tops are met as equal pairs only, and a top is one task's group. Tops with more
than `PAGE` leaves go through the same argument again on the bits left (9, 27, 81 tries), so
no group is unbounded: at the last depth 13 bits remain, 8,192 leaves at most.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meandra.llm.common import as_bytes, cut, first_rows, group_starts, short, spread, whole_groups
from meandra.llm.components import components

SHINGLE = 3
BUDGET = 2
PAGE = 256
DEPTHS = 4
#: A fingerprint with so many rows, and over 1 / HOT_KEYS of all rows, is joined by broadcast.
HOT, HOT_KEYS = 5_000, 1_000
_SLICE = 65_536


def fingerprint(text: bytes | None, shingle: int = SHINGLE) -> int:
    """64-bit SimHash: a bit is set where over half the shingles' XXH64 have it; no words: 0."""
    words = text.lower().split() if text else []  # bytes: A-Z only, ASCII white space only
    if not words:
        return 0
    digest = xxhash.xxh64_intdigest
    joined = b" ".join(words)
    if len(words) <= shingle:
        return digest(joined, 42)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = len(words) - shingle + 1
    ones = np.zeros(64, np.int64)
    for lo in range(0, n, _SLICE):
        hi = min(n, lo + _SLICE)
        spans = zip(starts[lo:hi].tolist(), ends[lo + shingle - 1 : hi + shingle - 1].tolist())
        hashes = np.fromiter((digest(joined[a:b], 42) for a, b in spans), np.uint64, hi - lo)
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(sum(1 << int(i) for i in np.flatnonzero(2 * ones > n)))


def _fingerprint_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in short(batches):
        prints = np.array([fingerprint(t) for t in as_bytes(batch.column(1))], np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints)], ["doc_id", "fp"])


def _print_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in short(batches):
        prints = np.array([fingerprint(t) for t in as_bytes(batch.column(2))], np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(prints)], ["doc_id", "h", "fp"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp) for every row; fp holds the 64 bits as a signed long."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(_fingerprint_batches, "doc_id long, fp long")


def trie_pairs(values: np.ndarray, starts: np.ndarray, budget: int = BUDGET) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs at most `budget` bits apart within each group values[starts[i]:starts[i+1]].

    `values` are uint64, sorted and distinct within each group. A trie node is a range of a
    group; all groups' node pairs go down one bit at a time, together.
    """
    lo, hi = starts[:-1].astype(np.int64), starts[1:].astype(np.int64)
    many = hi - lo > 1
    a0, a1 = lo[many], hi[many]
    b0, b1, diff = a0, a1, np.zeros(len(a0), np.int8)
    left: list[np.ndarray] = []
    right: list[np.ndarray] = []
    for bit in range(63, -1, -1):
        if not len(a0):
            break
        ones = np.concatenate(([0], np.cumsum((values >> np.uint64(bit)) & np.uint64(1)).astype(np.int64)))
        am, bm = a1 - (ones[a1] - ones[a0]), b1 - (ones[b1] - ones[b0])
        same = a0 == b0
        other = ~same
        # the children: equal turns keep the sum, different turns add one; of (n, n) one mixed pair is enough
        p = (np.concatenate((a0, am, a0, am[other])), np.concatenate((am, a1, am, a1[other])))
        q = (np.concatenate((b0, bm, bm, b0[other])), np.concatenate((bm, b1, b1, bm[other])))
        d = np.concatenate((diff, diff, diff + 1, diff[other] + 1))
        keep = (d <= budget) & (p[0] < p[1]) & (q[0] < q[1]) & ~((p[0] == q[0]) & (p[1] - p[0] == 1))
        a0, a1, b0, b1, diff = p[0][keep], p[1][keep], q[0][keep], q[1][keep], d[keep]
        # a pair of leaves needs no further walk: the rest of both paths is known
        leaf = (a1 - a0 == 1) & (b1 - b0 == 1)
        if leaf.any():
            x, y = a0[leaf], b0[leaf]
            near = np.bitwise_count(values[x] ^ values[y]) <= budget
            left.append(x[near])
            right.append(y[near])
            a0, a1, b0, b1, diff = a0[~leaf], a1[~leaf], b0[~leaf], b1[~leaf], diff[~leaf]
    if not left:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return np.concatenate(left), np.concatenate(right)


def _forest(n: int, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """For each of n items the smallest item that pairs (x, y) lead to."""
    root = np.arange(n)
    while len(x):
        low = np.minimum(root[x], root[y])
        np.minimum.at(root, root[x], low)
        np.minimum.at(root, root[y], low)
        root = root[root]
        open_ = root[x] != root[y]
        x, y = x[open_], y[open_]
    while (root != root[root]).any():
        root = root[root]
    return root


def _linked(batches: Iterator[pa.RecordBatch], forest: bool) -> Iterator[pa.RecordBatch]:
    for found in whole_groups(batches, ["mask", "top"]):
        starts = group_starts(found, ["mask", "top"])
        signed = found.column("fp").to_numpy()
        values = signed.view(np.uint64).copy()
        group = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
        order = np.lexsort((values, group))
        values, signed = values[order], signed[order]
        x, y = trie_pairs(values, starts)
        if not forest:
            yield pa.RecordBatch.from_arrays([pa.array(signed[x]), pa.array(signed[y])], ["a", "b"])
            continue
        root = _forest(len(values), x, y)
        moved = np.flatnonzero(root != np.arange(len(root)))
        yield pa.RecordBatch.from_arrays([pa.array(signed[moved]), pa.array(signed[root[moved]])], ["a", "b"])


def _thirds(free: list[int]) -> list[list[int]]:
    return [list(map(int, part)) for part in np.array_split(np.array(free), BUDGET + 1)]


def _mask(bits: list[int]) -> int:
    m = sum(1 << b for b in bits)
    return m - (1 << 64) if m >= 1 << 63 else m


def _levels() -> list[dict[int, list[int]]]:
    """For each depth: mask of the bits that tops agree on -> the masks one depth further."""
    bits = list(range(63, -1, -1))
    now: list[list[int]] = [[]]
    out = []
    for _ in range(DEPTHS):
        step, nxt = {}, []
        for used in now:
            parts = [used + part for part in _thirds([b for b in bits if b not in used])]
            step[_mask(used)] = [_mask(p) for p in parts]
            nxt += parts
        out.append(step)
        now = nxt
    return out


def _deal(df: DataFrame, step: dict[int, list[int]]) -> DataFrame:
    """Every fingerprint under each mask that follows the one it stands under."""
    finer = F.create_map(*(x for k, v in step.items() for x in (F.lit(k).cast("long"), F.array(*(F.lit(m).cast("long") for m in v)))))
    return df.select("fp", F.explode(F.element_at(finer, F.col("mask"))).alias("mask")).withColumn("top", F.expr("fp & mask"))


def links(prints: DataFrame, page: int = PAGE, forest: bool = True) -> DataFrame:
    """(a, b) longs: within each top a forest of links between distinct fingerprints at most BUDGET bits apart.

    Following these links joins exactly the fingerprints that following all links would join. Without `forest` they are
    all pairs at most BUDGET bits apart, some more than once.
    """
    levels = _levels()
    distinct = prints.select("fp").distinct().withColumn("mask", F.lit(0).cast("long"))
    first = _deal(distinct, levels[0])
    parts = spread(first, ["mask", "top"], [lambda df, s=step: _deal(df, s) for step in levels[1:]], page)
    found = [p.select("mask", "top", "fp").repartition("mask", "top").sortWithinPartitions("mask", "top").mapInArrow(lambda batches: _linked(batches, forest), "a long, b long") for p in parts]
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def near_duplicates(docs: DataFrame, page: int = PAGE) -> DataFrame:
    """(doc_id, fingerprint, component_id, n_links) for every row of `docs`.

    fingerprint: 16 lowercase hex digits. component_id: the smallest doc_id reachable over links
    of at most two differing bits, the row's own included. n_links is the number of distinct
    fingerprints in the component less one.

    Null or wordless texts have fingerprint zero and link like any other. Repeated rows come
    back repeated. A null doc_id stays null and takes the smallest id of its component (null if
    there is none). Other columns are ignored. An empty table gives an empty result.
    """
    prints = cut(fingerprints(docs))
    classes = cut(prints.groupBy("fp").agg(F.min("doc_id").alias("low"), F.count("*").alias("n")))
    roots = components(links(prints, page)).select(F.col("node").alias("fp"), "root")
    placed = classes.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    lows = placed.groupBy("root").agg(F.min("low").alias("component_id"), (F.count("*") - 1).alias("n_links"))
    named = placed.join(lows, "root").select("fp", "component_id", "n_links")
    heavy = cut(classes.filter(F.col("n") >= F.lit(max(HOT, prints.count() // HOT_KEYS))).select("fp"))
    if heavy.isEmpty():
        out = prints.join(named, "fp")
    else:  # all copies of a text, or all empty ones, share a fingerprint: they must not meet in one task
        hot = F.broadcast(heavy)  # HOT_KEYS rows at most
        out = prints.join(F.broadcast(named.join(hot, "fp", "left_semi")), "fp")
        out = out.unionByName(prints.join(hot, "fp", "left_anti").join(named, "fp"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "n_links")


def deduplicate(docs: DataFrame, page: int = PAGE) -> DataFrame:
    """The rows of `docs` that represent their component: of each, the row with its smallest doc_id.

    Of rows with that doc_id several may hold other texts: of those in the component the one with the least
    hash of its text stays, and of equal texts the least row. Rows without a doc_id all stay: they cannot be
    told apart. Columns may have any names.
    """

    def chosen(rows: DataFrame) -> DataFrame:
        prints = cut(rows.mapInArrow(_print_rows, "doc_id long, h long, fp long"))
        classes = prints.groupBy("fp").agg(F.min(F.struct("doc_id", "h")).alias("m"))
        roots = components(links(prints, page)).select(F.col("node").alias("fp"), "root")
        placed = classes.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
        return placed.groupBy("root").agg(F.min("m").alias("m")).select("m.doc_id", "m.h")

    return first_rows(docs, chosen)
