"""Removal of passages that an earlier document already holds, by prefix-partitioned suffix trees.

Suffixes are word suffixes cut off after `WINDOW` words: two documents repeat each other exactly
where such suffixes share a node at depth WINDOW, and stretches of such starts are their maximal
repeats. The trees are built over the suffixes that can share a deep node, and no others:

1. Of the `ANCHOR`-word grams inside a window, the one with the least hash is its anchor. Equal
   windows have equal anchors, so a window whose anchor occurs nowhere else is alone. A document
   is stored as runs of starts with a common anchor, with a hash of the words the run spans.
2. An anchor that all its runs hold amid the same words needs no tree: its windows are equal.
3. Where the words around differ, runs amid equal words are still alike, and one of them is looked
   into. The starts of these are the suffixes, given as hashes of their prefixes at the
   depths in `DEPTHS`, a tree with those levels. They are dealt to tasks by their first
   prefix; a prefix with over `PAGE` suffixes gives way to the next longer one. A task sorts its
   suffixes, which lays its subtree out in order, and reads off the nodes at depth WINDOW. A
   single node of that depth with over PAGE suffixes is no tree any more but a partial minimum.

Windows are compared by 128-bit hashes of their words.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meandra.llm.common import BROADCAST_KEYS, SPACE, as_bytes, cut, group_starts, short, spread, whole_groups

WINDOW = 50
ANCHOR = 8
DEPTHS = (8, 24, 50)
#: Suffixes of a subtree: some 50 bytes each, under 2 MB with the task's other groups beside it.
PAGE = 32_768
EMPTY_SHA = hashlib.sha256(b"").hexdigest()
_BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)


@lru_cache(maxsize=8)
def _powers(family: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    base = _BASES[family]
    up, down = np.full(size, base, np.uint64), np.full(size, pow(base, -1, 1 << 64), np.uint64)
    up[0] = down[0] = 1
    return np.cumprod(up), np.cumprod(down)


def _mix(v: np.ndarray) -> np.ndarray:
    v = (v ^ (v >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    v = (v ^ (v >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return v ^ (v >> np.uint64(31))


class _Words:
    """A text's words with prefix sums that hash any span of them in constant time."""

    def __init__(self, text: bytes | None):
        self.words = text.split() if text else []
        self.joined = b" ".join(self.words)
        self._sums: dict[int, np.ndarray] = {}
        self._hashes: np.ndarray | None = None

    def __len__(self) -> int:
        return len(self.words)

    @property
    def body(self) -> int:
        """XXH64 of the words joined by spaces, as a signed long."""
        return int(np.uint64(xxhash.xxh64_intdigest(self.joined, 42)).view(np.int64))

    def _prepare(self, family: int) -> tuple[np.ndarray, np.ndarray]:
        size = max(1024, 1 << len(self.words).bit_length())
        up, down = _powers(family, size)
        if family not in self._sums:
            if self._hashes is None:
                self._hashes = np.fromiter(map(xxhash.xxh64_intdigest, self.words), np.uint64, len(self.words))
            h = self._hashes if family == 0 else _mix(self._hashes + np.uint64(_BASES[1]))
            self._sums[family] = np.concatenate((np.zeros(1, np.uint64), np.cumsum(h * up[: len(h)], dtype=np.uint64)))
        return self._sums[family], down

    def spans(self, start: np.ndarray, end: np.ndarray, family: int = 0) -> np.ndarray:
        sums, down = self._prepare(family)
        return _mix((sums[end] - sums[start]) * down[start])


def _sliding_min(v: np.ndarray, width: int) -> np.ndarray:
    out, step = v, 1
    while 2 * step <= width:
        out = np.minimum(out[:-step], out[step:])
        step *= 2
    return np.minimum(out[: len(v) - width + 1], out[width - step :]) if step < width else out


def _runs(words: _Words) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, hash of the words spanned, first start, last start) of each run of starts with one anchor."""
    n = len(words)
    if n < WINDOW:
        none = np.empty(0, np.int64)
        return none, none, none, none
    at = np.arange(n - ANCHOR + 1)
    anchor = _sliding_min(words.spans(at, at + ANCHOR), WINDOW - ANCHOR + 1)
    turn = np.flatnonzero(anchor[1:] != anchor[:-1])
    lo, hi = np.concatenate(([0], turn + 1)), np.concatenate((turn, [n - WINDOW]))
    around = words.spans(lo, hi + WINDOW) + (hi - lo).astype(np.uint64)
    return anchor[lo].view(np.int64), around.view(np.int64), lo, hi


def _base(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in short(batches):
        rows: list[list] = [[], [], [], [], [], [], []]
        for text in as_bytes(batch.column(1)):
            words = _Words(text)
            for column, value in zip(rows, (len(words), hashlib.sha256(words.joined).hexdigest(), words.body, *_runs(words))):
                column.append(value)
        longs, ints = pa.list_(pa.int64()), pa.list_(pa.int32())
        arrays = [batch.column(0), pa.array(rows[0], pa.int64()), pa.array(rows[1], pa.string()), pa.array(rows[2], pa.int64())]
        arrays += [pa.array(rows[3], longs), pa.array(rows[4], longs), pa.array([x.astype(np.int32) for x in rows[5]], ints), pa.array([x.astype(np.int32) for x in rows[6]], ints)]
        yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "n_words", "sha", "body", "anchor", "around", "lo", "hi"])


def _suffixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each start.

    prefix: two 32-bit prefix hashes. p, q: the window's hashes. beside: half of p one word before
    and after. ref: half of body, a bit for the first start of a run, and the start.
    """
    low = np.int64(0xFFFFFFFF)
    for batch in short(batches):
        for doc, text, body, lows, highs in zip(batch.column(0).to_pylist(), as_bytes(batch.column(1)), batch.column(2).to_pylist(), batch.column(3).to_pylist(), batch.column(4).to_pylist()):
            words = _Words(text)
            if words.body != body or not lows:
                continue
            at = np.unique(np.concatenate([np.arange(a, b + 1) for a, b in zip(lows, highs)]))
            near, far = (words.spans(at, at + d).view(np.int64) for d in DEPTHS[:2])
            prefix = (near & ~low) | (far & low)
            window = [words.spans(at, at + WINDOW, family).view(np.int64) for family in (0, 1)]
            before, after = np.maximum(at - 1, 0), np.minimum(at + 1, len(words) - WINDOW)
            before, after = (np.where(x == at, 0, words.spans(x, x + WINDOW).view(np.int64) & low) for x in (before, after))
            ref = (np.int64(body) & ~low) | at | (np.isin(at, lows).astype(np.int64) << 31)
            rows = (prefix, *window, (before << 32) | after, np.full(len(at), doc, np.int64), ref)
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in rows], ["prefix", "p", "q", "beside", "doc_id", "ref"])


_NODE = ["p", "q"]


def _deep_nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of subtrees in suffix order: the starts below a node of full depth that a smaller document shares."""
    for found in whole_groups(batches, ["key"]):
        starts = group_starts(found, ["key", *_NODE])
        docs = found.column("doc_id").to_numpy()
        least = np.minimum.reduceat(docs, starts[:-1])
        again = np.flatnonzero(docs > np.repeat(least, np.diff(starts)))
        yield from found.select(["doc_id", "ref"]).take(pa.array(again)).to_batches()


def _large_nodes(rest: DataFrame) -> DataFrame:
    """(p_, q_, least, inner) of nodes too large for a subtree.

    A node is inner to a maximal repeat if the same number of suffixes, with the same least
    document, stands one word before and one word after it: its starts then add nothing to
    their neighbours. The first start of each run is kept in any case, so kept starts are
    never further apart than a window is wide and cover the same words.
    """
    half = lambda c: F.col(c).bitwiseAND(F.lit(0xFFFFFFFF))
    before, after = F.shiftrightunsigned("beside", 32), half("beside")
    nodes = rest.groupBy(F.col("p").alias("p_"), F.col("q").alias("q_")).agg(
        F.count("*").alias("n"), F.min("doc_id").alias("least"), F.min(before).alias("b0"), F.max(before).alias("b1"), F.min(after).alias("a0"), F.max(after).alias("a1")
    )
    known = nodes.groupBy(half("p_").alias("half")).agg(F.count("*").alias("c"), F.first("n").alias("m"), F.first("least").alias("l")).filter("c = 1").drop("c")
    one = nodes.filter("b0 = b1 and a0 = a1")
    for side in ("b0", "a0"):
        one = one.join(known, (F.col(side) == F.col("half")) & (F.col("n") == F.col("m")) & (F.col("least") == F.col("l")), "left_semi")
    inner = one.select(F.col("p_").alias("p2"), F.col("q_").alias("q2"), F.lit(True).alias("found"))
    joined = nodes.join(inner, (F.col("p_") == F.col("p2")) & (F.col("q_") == F.col("q2")), "left")
    return joined.select("p_", "q_", "least", F.coalesce("found", F.lit(False)).alias("inner"))


def _repeated_starts(suffixes: DataFrame, page: int) -> DataFrame:
    """(doc_id, ref) of the suffixes whose first WINDOW words also start in a smaller document."""
    # at the last depth a prefix is a node; where that is too large there is no tree left to build
    keyed = [F.col("prefix").bitwiseAND(F.lit(~0xFFFFFFFF)), F.col("prefix"), F.col("p")]
    at_depth = [lambda df, k=k: df.withColumn("key", k) for k in keyed]
    parts = spread(at_depth[0](suffixes), ["key"], [*at_depth[1:], lambda df: df], page)
    trees, large = parts[: len(keyed)], parts[len(keyed) :]
    out = [t.repartition("key").sortWithinPartitions("key", *_NODE).mapInArrow(_deep_nodes, "doc_id long, ref long") for t in trees]
    for rest in large:
        nodes = _large_nodes(rest)
        out.append(rest.join(nodes, (rest.p == nodes.p_) & (rest.q == nodes.q_) & (rest.doc_id > nodes.least) & (~nodes.inner | (F.col("ref").bitwiseAND(F.lit(1 << 31)) != 0))).select("doc_id", "ref"))
    found = out[0]
    for more in out[1:]:
        found = found.unionByName(more)
    return found


def _strip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in short(batches):
        out: list[tuple] = []
        for doc, text, body, lows, highs in zip(batch.column(0).to_pylist(), as_bytes(batch.column(1)), batch.column(2).to_pylist(), batch.column(3).to_pylist(), batch.column(4).to_pylist()):
            words = _Words(text)
            if words.body != body:
                continue
            edge = np.zeros(len(words) + 1, np.int32)
            np.add.at(edge, np.array(lows), 1)
            np.add.at(edge, np.array(highs) + WINDOW, -1)
            gone = np.cumsum(edge[:-1]) > 0
            kept = b" ".join([w for w, g in zip(words.words, gone.tolist()) if not g])
            turn = np.flatnonzero(np.diff(np.concatenate(([0], gone.astype(np.int8), [0])))).reshape(-1, 2)
            out.append((doc, body, int(gone.sum()), hashlib.sha256(kept).hexdigest(), kept.decode(), [{"start": int(a), "end": int(b)} for a, b in turn]))
        yield pa.RecordBatch.from_pylist([dict(zip(_STRIPPED.names, r)) for r in out], _STRIPPED)


_STRIPPED = pa.schema([("doc_id", pa.int64()), ("body", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string()), ("kept", pa.string()), ("removed", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))])
_STRIPPED_DDL = "doc_id long, body long, n_removed long, kept_sha256 string, kept string, removed array<struct<start:int,end:int>>"


def repeated_passages(docs: DataFrame, page: int = PAGE) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256, kept, removed, body) for every row of `docs`.

    A word goes if a window of WINDOW consecutive words over it also starts in a document with a
    smaller doc_id. kept: the words left, joined by one space; null if nothing was removed.
    removed: the spans [start, end) of words taken out, the maximal repeats; null for a whole
    copy, of which everything goes. body: XXH64 of the words joined by spaces.

    A null text has no words. A row without a doc_id is neither changed nor a reason for change.
    Rows that repeat a doc_id do not repeat each other. Other columns are ignored.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    base = cut(texts.mapInArrow(_base, "doc_id long, n_words long, sha string, body long, anchor array<long>, around array<long>, lo array<int>, hi array<int>"))
    long_enough = base.filter(F.col("doc_id").isNotNull() & (F.col("n_words") >= WINDOW))
    first = long_enough.groupBy("sha").agg(F.min("doc_id").alias("first_id"), F.first("body").alias("body"))
    # whole copies follow from the text's hash; the rest of the work sees one document of each
    single = long_enough.join(first.select(F.col("first_id").alias("doc_id"), "body"), ["doc_id", "body"], "left_semi").dropDuplicates(["doc_id", "body"])
    run = F.explode(F.arrays_zip("anchor", "around", "lo", "hi")).alias("r")
    runs = cut(single.select("doc_id", "body", run).select("doc_id", "body", "r.anchor", "r.around", "r.lo", "r.hi"))
    shared = runs.groupBy("anchor").agg(F.min("around").alias("c0"), F.max("around").alias("c1"), F.min("doc_id").alias("d0"), F.max("doc_id").alias("d1")).filter("d0 < d1")
    placed = cut(runs.join(shared, "anchor").select("doc_id", "body", "anchor", "around", "lo", "hi", (F.col("c0") == F.col("c1")).alias("alike"), "d0"))
    # amid the same words as in a smaller document a whole run is sure; of each surrounding one document is left to look into
    mixed = placed.filter("not alike").drop("d0")
    mixed = mixed.join(mixed.groupBy("anchor", "around").agg(F.min("doc_id").alias("d0")), ["anchor", "around"]).withColumn("alike", F.col("doc_id") > F.col("d0"))
    cols = ["doc_id", "body", "lo", "hi", "alike"]
    placed = placed.filter("alike and doc_id > d0").select(*cols).unionByName(mixed.select(*cols))
    span = F.collect_list(F.when(F.col("alike"), F.struct("lo", "hi")))
    open_ = F.collect_list(F.when(~F.col("alike"), F.struct("lo", "hi")))
    wanted = placed.groupBy("doc_id", "body").agg(span.alias("sure"), open_.alias("open"))
    wanted = cut(wanted)
    ids = wanted.select("doc_id").distinct()
    known = texts.join(F.broadcast(ids), "doc_id", "left_semi") if wanted.count() <= BROADCAST_KEYS else texts
    candidates = cut(known.join(wanted, "doc_id"))
    suffixes = cut(candidates.filter("size(open) > 0").select("doc_id", "text", "body", "open.lo", "open.hi").mapInArrow(_suffixes, "prefix long, p long, q long, beside long, doc_id long, ref long"))
    part = lambda c: F.shiftrightunsigned(c, 32)
    starts = _repeated_starts(suffixes, page).groupBy("doc_id", part("ref").alias("part")).agg(F.collect_set(F.expr("cast(ref & 2147483647 as int)")).alias("at"))
    hit = candidates.withColumn("part", part("body")).join(starts, ["doc_id", "part"], "left").filter("size(sure) > 0 or at is not null")
    none = F.expr("cast(array() as array<int>)")
    hit = hit.select("doc_id", "text", "body", F.concat("sure.lo", F.coalesce("at", none)).alias("lo"), F.concat("sure.hi", F.coalesce("at", none)).alias("hi"))
    stripped = hit.mapInArrow(_strip, _STRIPPED_DDL).dropDuplicates(["doc_id", "body"])
    rows = base.select("doc_id", "n_words", "sha", "body").join(first.select("sha", "first_id"), "sha", "left").join(stripped, ["doc_id", "body"], "left")
    copy = F.coalesce(F.col("doc_id") > F.col("first_id"), F.lit(False))
    return rows.select(
        "doc_id",
        "n_words",
        F.when(copy, F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(copy, F.lit(EMPTY_SHA)).otherwise(F.coalesce("kept_sha256", "sha")).alias("kept_sha256"),
        F.when(copy, F.lit("")).otherwise(F.col("kept")).alias("kept"),
        F.when(~copy, F.col("removed")).alias("removed"),
        "body",
    )


def remove_repeats(docs: DataFrame, page: int = PAGE) -> DataFrame:
    """`docs` with repeated passages taken out of text, n_chars brought up to date; emptied rows go.

    Texts without a repeat stay as they are; of the others the words left are joined by one space. Null and
    wordless texts, and rows without a doc_id, stay. Rows that repeat a doc_id are judged each. Columns may have
    any names.
    """
    changed = repeated_passages(docs, page).filter("n_removed > 0").select(F.col("doc_id").alias("_id"), F.col("body").alias("_body"), F.col("kept").alias("_kept")).dropDuplicates(["_id", "_body"])
    row = F.col("_row")
    boxed = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row"))
    body = F.xxhash64(F.trim(F.regexp_replace(F.coalesce(F.col("_row.text").cast("string"), F.lit("")), SPACE, " ")))
    joined = boxed.withColumn("_now", body).join(changed, (F.col("_row.doc_id").cast("long") == F.col("_id")) & (F.col("_now") == F.col("_body")), "left").filter("_kept is null or _kept <> ''")
    new = row.withField("text", F.coalesce("_kept", F.col("_row.text")))
    if "n_chars" in docs.columns:
        new = new.withField("n_chars", F.when(F.col("_kept").isNotNull(), F.length("_kept").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("_row.n_chars")))
    return joined.select(new.alias("_row")).select("_row.*")
