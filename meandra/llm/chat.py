"""Chat logs: collapse of cumulative snapshots, then rendering.

A conversation is often logged again after each exchange, so shorter logs are prefixes of longer
ones. Each turn gets a rolling hash of all turns up to it. It is an exclusive-or of hashes that
hold a turn's place, role and text, so it can be built from parts: turns are dealt to ranges in the
order of conversation and turn, ranges are hashed on their own and put together, and a conversation
of any length is spread over as many tasks as it fills. A log whose last hash is a longer log's hash
at the same place is its prefix; an anti-join leaves the maximal logs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meandra.llm.common import cut

OPEN, MIDDLE, CLOSE = "<|", "|>\n", "<|end|>\n"


def render(role: Column, text: Column) -> Column:
    """One turn as text: its role in a marker, the text as it is, an end marker. Null reads as empty."""
    return F.concat(F.lit(OPEN), F.coalesce(role, F.lit("")), F.lit(MIDDLE), F.coalesce(text, F.lit("")), F.lit(CLOSE))


_ORDER = ["conv_id", "turn", "role", "text"]


def ranged(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, part, nr): distinct turns in order; nr counts on within a part, parts follow each other.

    Rows equal in all four columns count once; turns that share a number follow by role and text; a
    null number comes first. Rows without a conv_id belong to no conversation and are left out.
    """
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    rows = rows.filter("conv_id is not null").dropDuplicates()
    rows = rows.repartitionByRange(*_ORDER).sortWithinPartitions(*_ORDER)
    # written out: what a lost task does again must not deal other ranges
    return cut(rows.select("*", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("nr")))


def placed(rows: DataFrame) -> DataFrame:
    """(conv_id, part, base): add base to nr for the place of a turn in its conversation, from 1."""
    sizes = rows.groupBy("conv_id", "part").agg(F.count("*").alias("n"), F.min("nr").alias("first"))
    before = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each part
    return sizes.select("conv_id", "part", (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("first") + 1).alias("base"))


def rolled(rows: DataFrame, bases: DataFrame) -> DataFrame:
    """(conv_id, place, h1, h2): the rolling hashes up to each turn."""
    at = rows.join(bases, ["conv_id", "part"]).withColumn("place", F.col("nr") + F.col("base"))
    parts = [F.col("place"), F.col("role").isNull(), F.coalesce("role", F.lit("")), F.col("text").isNull(), F.coalesce("text", F.lit(""))]
    at = cut(at.select("conv_id", "part", "place", F.xxhash64(F.lit(1), *parts).alias("a"), F.xxhash64(F.lit(2), *reversed(parts)).alias("b")))
    before = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sums = at.groupBy("conv_id", "part").agg(F.bit_xor("a").alias("a"), F.bit_xor("b").alias("b"))
    carried = sums.select("conv_id", "part", *(F.coalesce(F.bit_xor(c).over(before), F.lit(0)).alias(f"{c}_before") for c in "ab"))
    run = Window.partitionBy("conv_id", "part").orderBy("place").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    hashes = [F.bit_xor(c).over(run).bitwiseXOR(F.col(f"{c}_before")).alias(h) for c, h in zip("ab", ("h1", "h2"))]
    return at.join(carried, ["conv_id", "part"]).select("conv_id", "place", *hashes)


def maximal(hashes: DataFrame) -> DataFrame:
    """(conv_id, n_turns) of the conversations that are no prefix of a longer one; of equal ones the smallest conv_id."""
    ends = hashes.groupBy("conv_id").agg(F.max_by(F.struct("h1", "h2"), "place").alias("h"), F.max("place").alias("place"))
    single = ends.groupBy("place", "h.h1", "h.h2").agg(F.min("conv_id").alias("conv_id"))
    # prefixes that go on: of all logs, the places before the last
    inner = hashes.join(ends.select("conv_id", F.col("place").alias("last")), "conv_id").filter("place < last").select("place", "h1", "h2").distinct()
    return single.join(inner, ["place", "h1", "h2"], "left_anti").select("conv_id", F.col("place").alias("n_turns"))


def format_chats(turns: DataFrame) -> DataFrame:
    """(conv_id, place, n_turns, rendered): the turns of maximal conversations, each rendered.

    A conversation's text is its turns' `rendered` in the order of place; they are kept apart, as one
    conversation may be larger than a task. Nulls read as empty; see ranged() for ties and repeated
    rows. Whole texts are kept, however long. Other columns are ignored. An empty table gives an empty result.
    """
    rows = ranged(turns)
    bases = cut(placed(rows))
    kept = maximal(cut(rolled(rows, bases)))
    out = rows.join(bases.join(kept, "conv_id"), ["conv_id", "part"])
    return out.select("conv_id", (F.col("nr") + F.col("base")).alias("place"), "n_turns", render(F.col("role"), F.col("text")).alias("rendered"))
