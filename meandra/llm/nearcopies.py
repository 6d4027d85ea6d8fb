"""Near copies by similarity of word shingles: SimHash tries and MinHash bands find candidates, whole shingle sets decide.

Two texts are near copies if the Jaccard similarity of their sets of `SHINGLE`-word shingles is at
least `SIMILAR`. Equal texts are one node from the start. Nodes that share one of `BANDS` bands of
`ROWS` minima are candidates: at similarity 0.8 a pair shares none with probability 0.0004, above it
less. Nodes whose SimHash fingerprints the binary tries of simhash find within its budget are
candidates as well, from the start: they need no band in common, and the sets decide on them
without a look at sketches. Of a band's candidates, pairs whose sketches (a byte of each minimum) agree in under `AGREE` places are left
out unread; at similarity 0.8 that loses a pair with probability 0.000002.

Only connections count, so a crowded band need not give all its pairs. A band of at most `PAGE` nodes
does. In a larger one some `LEADERS` nodes are first compared with every other, in chunks. What is then
one connected group is done. In any other band the nodes outside its largest group are compared, block
by block, with all nodes of the band that are not yet connected to them. So no link that would connect
two groups is left out, and rows made grow with the band times what is still unconnected in it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meandra.llm import simhash
from meandra.llm.common import BROADCAST_KEYS, as_bytes, cut, first_rows, group_starts, short, whole_groups
from meandra.llm.components import components

SHINGLE = 5
SIMILAR = 0.8
BANDS, ROWS = 20, 5
PAGE = 16
#: Sketch places that agree, at least; leaders of a crowded band, about; nodes of a chunk beside the leaders, and of a block.
AGREE = 60
LEADERS, CHUNK, BLOCK = 16, 512, 256
_SLICE = 4096
_rng = np.random.Generator(np.random.PCG64(20))
_FLIP = _rng.integers(0, 1 << 63, BANDS * ROWS, np.uint64)
_TURN = _rng.integers(0, 1 << 63, BANDS * ROWS, np.uint64) * np.uint64(2) + np.uint64(1)


def shingles(text: bytes | None, width: int = SHINGLE) -> np.ndarray:
    """Sorted distinct XXH64 of the word shingles; of a text with fewer words that of all of them; no words: none."""
    words = text.lower().split() if text else []  # bytes: A-Z only, ASCII white space only
    if not words:
        return np.empty(0, np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    width = min(width, len(words))
    spans = zip(starts[: len(words) - width + 1].tolist(), ends[width - 1 :].tolist())
    return np.unique(np.fromiter((xxhash.xxh64_intdigest(joined[a:b]) for a, b in spans), np.uint64, len(words) - width + 1))


def _node(found: np.ndarray) -> int:
    """One number for one set of shingles."""
    return int(np.uint64(xxhash.xxh64_intdigest(found.tobytes())).view(np.int64))


def minima(found: np.ndarray) -> np.ndarray:
    """BANDS * ROWS minima of a set that is not empty."""
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for lo in range(0, len(found), _SLICE):
        mixed = (found[lo : lo + _SLICE, None] ^ _FLIP) * _TURN
        np.minimum(least, (mixed ^ (mixed >> np.uint64(32))).min(axis=0), out=least)
    return least


def bands(least: np.ndarray) -> list[int]:
    """A key for each band."""
    return [int(np.uint64(xxhash.xxh64_intdigest(part.tobytes(), k)).view(np.int64)) for k, part in enumerate(least.reshape(BANDS, ROWS))]


def _print_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, h, node, bands, sketch, fp); an empty set is like no other and has no bands."""
    for batch in short(batches):
        texts = as_bytes(batch.column(2))
        sets = [shingles(t) for t in texts]
        prints = pa.array(np.array([simhash.fingerprint(t) for t in texts], np.uint64).view(np.int64))
        least = [minima(s) if len(s) else None for s in sets]
        keys = pa.array([[] if m is None else bands(m) for m in least], pa.list_(pa.int64()))
        sketch = pa.array([b"" if m is None else (m >> np.uint64(7)).astype(np.uint8).tobytes() for m in least], pa.binary())
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(map(_node, sets), pa.int64()), keys, sketch, prints], ["doc_id", "h", "node", "bands", "sketch", "fp"])


def _set_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in short(batches, 64):
        sets = [shingles(t) for t in as_bytes(batch.column(1))]
        yield pa.RecordBatch.from_arrays([pa.array(map(_node, sets), pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())], ["node", "found"])


def _alike(x: bytes, y: bytes, least: float) -> bool:
    p, q = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
    if least * max(len(p), len(q)) > min(len(p), len(q)):
        return False
    both = len(np.intersect1d(p, q, assume_unique=True))
    return both >= least * (len(p) + len(q) - both)


def _agreeing(x: pa.ChunkedArray, y: pa.ChunkedArray) -> np.ndarray:
    """For each sketch of x and each of y whether they agree in enough places."""
    a, b = (np.frombuffer(b"".join(v.to_pylist()), np.uint8).reshape(len(v), -1) for v in (x, y))
    return (a[:, None, :] == b[None, :, :]).sum(axis=2) >= AGREE


def _pair_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of small bands whose sketches agree."""
    for found in whole_groups(batches, ["key"]):
        nodes, starts = found.column("node").to_numpy(), group_starts(found, ["key"])
        left, right = [], []
        for lo, hi in zip(starts[:-1].tolist(), starts[1:].tolist()):
            part = found.column("sketch").slice(lo, hi - lo)
            i, j = np.nonzero(np.triu(_agreeing(part, part), 1))
            left.append(nodes[lo + i])
            right.append(nodes[lo + j])
        a, b = np.concatenate(left), np.concatenate(right)
        yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])


def _similar_batches(batches: Iterator[pa.RecordBatch], least: float) -> Iterator[pa.RecordBatch]:
    for batch in short(batches, 64):
        keep = [_alike(x, y, least) for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())]
        yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))


def _meeting_batches(batches: Iterator[pa.RecordBatch], least: float) -> Iterator[pa.RecordBatch]:
    """(a, b) links between the askers of a block and its other nodes, as many as connect what is alike.

    Blocks hold (key, spot, asks, node, root, sketch, found); equal roots are connected already.
    """
    for table in whole_groups(batches, ["key", "spot"], rows=1):
        starts = group_starts(table, ["key", "spot"])
        for lo, hi in zip(starts[:-1].tolist(), starts[1:].tolist()):
            part = table.slice(lo, hi - lo)
            asks = part.column("asks").to_numpy(zero_copy_only=False).astype(bool)
            one, two = part.filter(pa.array(asks)), part.filter(pa.array(~asks))
            if not one.num_rows or not two.num_rows:
                continue
            above: dict[int, int] = {}

            def find(i: int) -> int:
                while (up := above.get(i, i)) != i:
                    above[i] = i = above.get(up, up)
                return i

            near = _agreeing(one.column("sketch"), two.column("sketch"))
            r1, r2 = one.column("root").to_pylist(), two.column("root").to_pylist()
            s1, s2 = one.column("found").to_pylist(), two.column("found").to_pylist()
            out: list[tuple[int, int]] = []
            for i, j in zip(*(x.tolist() for x in np.nonzero(near))):
                x, y = find(r1[i]), find(r2[j])
                if x != y and _alike(s1[i], s2[j], least):
                    above[max(x, y)] = min(x, y)
                    out.append((i, j))
            n1, n2 = one.column("node").to_numpy(), two.column("node").to_numpy()
            i, j = np.array(out, np.int64).reshape(-1, 2).T
            yield pa.RecordBatch.from_arrays([pa.array(n1[i]), pa.array(n2[j])], ["a", "b"])


_MEET = ["key", "spot", "asks", "node", "root", "sketch", "found"]


def _met(askers: DataFrame, others: DataFrame, least: float) -> DataFrame:
    both = askers.withColumn("asks", F.lit(True)).select(_MEET).unionByName(others.withColumn("asks", F.lit(False)).select(_MEET))
    return both.repartition("key", "spot").sortWithinPartitions("key", "spot").mapInArrow(lambda batches: _meeting_batches(batches, least), "a long, b long")


def _spots(count: str, size: int, seed: int) -> tuple[Column, Column]:
    """(number of parts of so many rows, the part of a node)."""
    parts = F.ceil(F.col(count) / F.lit(size)).cast("long")
    return parts, F.pmod(F.xxhash64("node", F.lit(seed)), parts)


def _all_parts(parts: Column) -> Column:
    return F.explode(F.sequence(F.lit(0).cast("long"), parts - 1))


def trie_pairs(nodes: DataFrame) -> DataFrame:
    """(a, b), a < b: nodes (node, fp) that the tries link, of each fingerprint the least one, and that one with the others that share it."""
    least = cut(nodes.groupBy("fp").agg(F.min("node").alias("least")))
    same = nodes.join(least, "fp").select(F.col("least").alias("a"), F.col("node").alias("b"))
    met = simhash.links(least, forest=False).distinct()
    for c in "ab":
        met = met.join(least.select(F.col("fp").alias(c), F.col("least").alias(f"least_{c}")), c)
    near = met.select(F.least("least_a", "least_b").alias("a"), F.greatest("least_a", "least_b").alias("b"))
    return same.unionByName(near).filter("a < b")


def links(nodes: DataFrame, docs: DataFrame, similar: float = SIMILAR, page: int = PAGE) -> DataFrame:
    """(a, b): links between nodes that are near copies, enough to connect what all links would connect.

    nodes: (node, low, h, bands, sketch, fp), low and h naming one text of the node, fp its fingerprint; docs: (doc_id, h, text).
    """
    close = trie_pairs(nodes.filter(F.size("bands") > 0))
    keyed = nodes.select("node", F.explode("bands").alias("key"))
    sizes = keyed.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1")
    members = cut(keyed.join(sizes, "key").join(nodes.select("node", "sketch"), "node").select("key", "node", "n", "sketch"))
    pairs = members.filter(F.col("n") <= page).select("key", "node", "sketch").repartition("key").sortWithinPartitions("key").mapInArrow(_pair_batches, "a long, b long").unionByName(close).distinct()
    pairs, large = cut(pairs), members.filter(F.col("n") > page)
    crowded = not large.isEmpty()
    wanted = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node")))
    if crowded:
        wanted = wanted.unionByName(large.select("node"))
    named = cut(nodes.join(wanted.distinct(), "node", "left_semi").select("node", F.col("low").alias("doc_id"), "h"))
    if named.count() <= BROADCAST_KEYS:  # checked size: then texts without a candidate are not moved
        named = F.broadcast(named)
    sets = cut(docs.join(named, ["doc_id", "h"]).dropDuplicates(["node"]).select("node", "text").mapInArrow(_set_batches, "node long, found binary"))
    left, right = (sets.select(F.col("node").alias(c), F.col("found").alias(f"found_{c}")) for c in "ab")
    out = cut(pairs.join(left, "a").join(right, "b").select("a", "b", "found_a", "found_b").mapInArrow(lambda batches: _similar_batches(batches, similar), "a long, b long"))
    if not crowded:
        return out
    full = cut(large.join(sets, "node").withColumn("root", F.col("node")))
    chunks, own = _spots("n", CHUNK, 1)
    draw = F.shiftrightunsigned(F.xxhash64("node", "key"), 11).cast("double") / float(1 << 53)
    leaders = full.filter(draw < LEADERS / F.col("n")).withColumn("spot", _all_parts(chunks))
    # links are few beside the parts they come from: dealt anew, they take fewer files
    out = cut(out.unionByName(_met(leaders, full.withColumn("spot", own), similar)).distinct())
    roots = components(out, few=BROADCAST_KEYS).select("node", F.col("root").alias("r"))
    full = full.join(roots, "node", "left").withColumn("root", F.coalesce("r", "root")).drop("r")
    counts = full.groupBy("key", "root").agg(F.count("*").alias("c")).groupBy("key").agg(F.max_by("root", F.struct("c", "root")).alias("main"), F.max("c").alias("c"), F.sum("c").alias("n"))
    open_ = counts.filter("c < n").select("key", "main", (F.col("n") - F.col("c")).alias("n_ask"))
    full = cut(full.join(open_, "key"))
    ask_parts, ask_own = _spots("n_ask", BLOCK, 2)
    parts, own = _spots("n", BLOCK, 3)
    askers = full.filter("root <> main").withColumn("_p", ask_own).withColumn("_q", _all_parts(parts))
    others = full.withColumn("_q", own).withColumn("_p", _all_parts(ask_parts))
    spot = F.col("_p") * parts + F.col("_q")
    return cut(out.unionByName(_met(askers.withColumn("spot", spot), others.withColumn("spot", spot), similar)).distinct())


def representatives(docs: DataFrame, similar: float = SIMILAR, page: int = PAGE) -> DataFrame:
    """(doc_id, h): of each group of near copies the smallest doc_id and the hash of its text; docs: (doc_id, h, text)."""
    made = cut(docs.select("doc_id", "h", "text").mapInArrow(_print_batches, "doc_id long, h long, node long, bands array<long>, sketch binary, fp long"))
    first = F.min(F.struct("doc_id", "h"))
    nodes = made.groupBy("node").agg(F.min(F.struct("doc_id", "h", "fp")).alias("m"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch")).select("node", F.col("m.doc_id").alias("low"), "m.h", "bands", "sketch", "m.fp")
    nodes = cut(nodes)
    roots = components(links(nodes, docs, similar, page), few=BROADCAST_KEYS).select("node", "root")
    placed = nodes.select("node", F.col("low").alias("doc_id"), "h").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    return placed.groupBy("root").agg(first.alias("m")).select("m.doc_id", "m.h")


def deduplicate(docs: DataFrame, similar: float = SIMILAR, page: int = PAGE) -> DataFrame:
    """The rows of `docs` that represent their group of near copies: of each, the row with its smallest doc_id.

    Groups follow links from text to text. Null or wordless texts are copies of each other. Of rows with
    that doc_id and that text the least one in its columns' order stays; rows that share a doc_id but hold
    other texts are judged each. Rows without a doc_id all stay: they cannot be told apart. Columns may have
    any names. Whole texts are read. An empty table gives an empty result.
    """
    return first_rows(docs, lambda rows: representatives(rows, similar, page))
