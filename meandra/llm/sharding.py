"""Shards of nearly equal bytes by sampled splitters.

Rows are ordered by a key, the hash of their text, so equal texts lie side by side. A sample of
keys, drawn with probability in proportion to size, gives quantiles as splitters; they part the
order into at most `TOPS` ranges. A range that is still overfull is subdivided evenly, which suits
keys that are hashes. A text whose copies alone overfill a range gets parts of its own, split by a
hash of doc_id. Exact sizes then place each range in the order by prefix sums in two levels, within
a splitter's range and over these; a running sum inside a range places each row, and shards are cut
at equal shares of the bytes. So balance does not hang on the sample's luck; only task sizes do.
The driver holds a fixed number of sampled keys and of splitters, however many rows there are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from meandra.llm.common import BROADCAST_KEYS, cut

SHARDS = 40
OVERHEAD = 16
#: Ranges: at least four a shard, then one for so many bytes of text.
RANGE_BYTES = 64 << 20
#: Ranges that splitters make, at most, and sampled keys for each of them.
TOPS, OVERSAMPLE = 1024, 32
#: Copies of one text stay together if they weigh at most this share of a shard.
TOGETHER = 0.02


def _deal(splitters: np.ndarray):
    """Adds top: the number of splitters below a key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            top = np.searchsorted(splitters, batch.column(batch.schema.get_field_index("h")).to_numpy(zero_copy_only=False), side="left")
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(top.astype(np.int64))], [*batch.schema.names, "top"])

    return run


def _sized(df: DataFrame, most: int = BROADCAST_KEYS) -> DataFrame:
    """Written out, and broadcast where that is small."""
    df = cut(df)
    return F.broadcast(df) if df.count() <= most else df


def shard(docs: DataFrame, shards: int = SHARDS, range_bytes: int = RANGE_BYTES, tops: int = TOPS) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) for every row of `docs`.

    size: UTF-8 bytes of the text plus 16. law is `bytes`: shards hold nearly equal bytes, apart by
    no more than a text or a small group of copies. Copies of a text share a shard unless they
    weigh over TOGETHER of one; then they may run on over as many as they fill. slot counts from 0
    without gaps in each shard. grown_shard is null under this law.

    A null text has no bytes (size 16, crc 0). Null doc_ids and repeated rows are placed like any
    other. Other columns are ignored. An empty table gives an empty result.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(text) + OVERHEAD).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.xxhash64(text).alias("h"),
        F.monotonically_increasing_id().alias("nr"),
    )
    # the hashes and row numbers stay what they are from here on, whatever is lost later
    rows = cut(rows.withColumn("tie", F.xxhash64("doc_id", "nr")))
    facts = rows.agg(F.sum("size").alias("bytes"), F.count("*").alias("n")).first()
    total = int(facts["bytes"] or 0)
    ranges = int(max(4 * shards, total // range_bytes))
    target, tops = max(1, total // ranges), min(tops, ranges)
    draw = F.shiftrightunsigned(F.xxhash64("tie", F.lit(7)), 11).cast("double") / float(1 << 53)
    sample = rows.filter(draw < F.col("size") * float(OVERSAMPLE * tops) / float(max(1, total))).select("h")
    # a row of many bytes is drawn once for its probability over 1; some OVERSAMPLE * TOPS keys come to the driver
    drawn = np.sort(np.array([r["h"] for r in sample.collect()], np.int64))
    splitters = np.unique(drawn[(np.arange(1, tops) * len(drawn)) // tops]) if len(drawn) else np.empty(0, np.int64)
    dealt = rows.mapInArrow(_deal(splitters), "doc_id long, size long, text_crc32 long, h long, nr long, tie long, top long")

    heavy = rows.groupBy("h").agg(F.sum("size").alias("s")).filter(F.col("s") > target).select("h", F.ceil(F.col("s") / F.lit(target)).cast("long").alias("parts"))
    dealt = dealt.join(_sized(heavy), "h", "left").withColumn("hot", F.col("parts").isNotNull())
    # overfull ranges, without the texts that have parts of their own, are cut into pieces of equal width
    widths = dealt.filter("not hot").groupBy("top").agg(F.ceil(F.sum("size") / F.lit(2 * target)).cast("long").alias("pieces"), F.min("h").alias("low"), F.max("h").alias("high"))
    dealt = dealt.join(F.broadcast(cut(widths)), "top", "left")  # a row for each splitter's range
    step = (F.col("high").cast("double") - F.col("low").cast("double")) / F.col("pieces") + 1.0
    piece = F.floor((F.col("h").cast("double") - F.col("low").cast("double")) / step)
    spot = {"piece": F.when(F.col("hot"), F.lit(-1)).otherwise(F.least(F.coalesce(piece, F.lit(0)), F.col("pieces") - 1)).cast("long"), "own": F.when(F.col("hot"), F.col("h")).otherwise(F.lit(0)), "part": F.when(F.col("hot"), F.pmod("tie", "parts")).otherwise(F.lit(0))}
    dealt = dealt.withColumns(spot).drop("pieces", "low", "high", "parts")

    spots = ["top", "piece", "own", "part"]
    place = cut(dealt.groupBy(*spots).agg(F.sum("size").alias("s"), F.count("*").alias("n")))
    before = lambda c, w: F.coalesce(F.sum(c).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    over = place.groupBy("top").agg(F.sum("s").alias("s"), F.sum("n").alias("n"))  # TOPS rows
    over = over.select("top", before("s", Window.orderBy("top")).alias("top_bytes"), before("n", Window.orderBy("top")).alias("top_rows"))
    within = Window.partitionBy("top").orderBy("piece", "own", "part")
    base = place.join(F.broadcast(over), "top").select(*spots, (F.col("top_bytes") + before("s", within)).alias("bytes_before"), (F.col("top_rows") + before("n", within)).alias("rows_before"))

    inside = Window.partitionBy(*spots).orderBy("h", "tie", "nr")
    texts = Window.partitionBy(*spots, "h")
    placed = dealt.join(_sized(base), spots)
    running = F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    placed = placed.withColumn("begin", F.col("bytes_before") + running - F.col("size")).withColumn("rank", F.col("rows_before") + F.row_number().over(inside) - 1)
    placed = placed.withColumn("group_size", F.sum("size").over(texts)).withColumn("group_begin", F.min("begin").over(texts))
    small = ~F.col("hot") & (F.col("group_size") <= F.lit(int(TOGETHER * total / shards)))
    anchor = F.when(small, F.col("group_begin") + F.expr("group_size div 2")).otherwise(F.col("begin") + F.expr("size div 2"))
    placed = placed.withColumn("shard", F.least(F.lit(shards - 1), F.floor(anchor * F.lit(shards) / F.lit(max(1, total)))).cast("int"))
    placed = cut(placed.select("doc_id", "size", "text_crc32", "shard", "rank"))
    first = placed.groupBy("shard").agg(F.min("rank").alias("first"))  # one row a shard
    out = placed.join(F.broadcast(first), "shard")
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("rank") - F.col("first")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
