"""What the corpus operators share: tables, lineage cuts, Arrow helpers, splitting of crowded groups."""

from __future__ import annotations

import ctypes
import tempfile
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space, the only characters that part words.
SPACE = r"[\x20\x09-\x0D]+"
#: Key lists up to this number of rows (a few words each) are broadcast.
BROADCAST_KEYS = 100_000


def small_batches(spark: SparkSession) -> None:
    """Hand fewer rows at once to Python where the session leaves that at its default: a row may be a long text.

    Batches of ten thousand texts stand in an executor's memory twice beside its heap, for each task.
    """
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(name, "10000") == "10000":
        spark.conf.set(name, "512")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cut(df: DataFrame) -> DataFrame:
    """Materialise `df` in the shared checkpoint folder, so that later reads survive lost executors.

    The folder is the one the session names in spark.checkpoint.dir. Only a local
    session without that setting (tests) gets a temporary one.
    """
    spark = df.sparkSession
    small_batches(spark)
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not sc.master.startswith("local[") and sc.master != "local":
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="meandra-checkpoints-")
        sc.setCheckpointDir(folder)
    return df.checkpoint(eager=True)


def first_rows(docs: DataFrame, chosen: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The rows of `docs` whose (doc_id, h) `chosen` gives from (doc_id, h, text), h being a hash of the text; one for each.

    Where several rows share both, the least in the order of their columns stays, so that a task
    run again chooses alike. Rows without a doc_id all stay.
    """
    boxed = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row"))
    boxed = boxed.select(F.col("_row.doc_id").cast("long").alias("doc_id"), F.xxhash64(F.coalesce(F.col("_row.text").cast("string"), F.lit(""))).alias("h"), "_row")
    named = boxed.filter("doc_id is not null")
    keep = cut(chosen(named.select("doc_id", "h", F.coalesce(F.col("_row.text").cast("string"), F.lit("")).alias("text"))).select("doc_id", "h"))
    ids = cut(named.groupBy("doc_id", "h").agg(F.count("*").alias("n")))
    gone = cut(ids.join(keep, ["doc_id", "h"], "left_anti").select("doc_id", "h"))
    if gone.count() <= BROADCAST_KEYS:  # checked size: then texts need not move to meet what is kept
        kept = named.join(F.broadcast(gone), ["doc_id", "h"], "left_anti")
    else:
        kept = named.join(keep, ["doc_id", "h"], "left_semi")
    rows = kept
    several = cut(ids.filter("n > 1").join(keep, ["doc_id", "h"], "left_semi").select("doc_id", "h"))
    n = several.count()
    if n:
        if n <= BROADCAST_KEYS:
            several = F.broadcast(several)
        least = kept.join(several, ["doc_id", "h"], "left_semi").groupBy("doc_id", "h").agg(F.min("_row").alias("_row"))
        rows = kept.join(several, ["doc_id", "h"], "left_anti").unionByName(least)
    return rows.select("_row.*").unionByName(boxed.filter("doc_id is null").select("_row.*"))


def as_bytes(column: pa.ChunkedArray | pa.Array) -> list[bytes | None]:
    """UTF-8 bytes of a string column, without decoding."""
    wide = pa.large_binary() if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else pa.binary()
    return column.cast(wide).to_pylist()


def short(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """The batches in slices, so that few texts are Python objects at once; frees what is held when they end.

    Workers outlive their tasks. What an allocator keeps for later would add up over the stages
    of a job and stand against the executor's memory while other stages run.
    """
    try:
        for batch in batches:
            for i in range(0, batch.num_rows, rows):
                yield batch.slice(i, rows)
    finally:
        release()


def release() -> None:
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim is not None:
        trim(0)


def whole_groups(batches: Iterator[pa.RecordBatch], keys: Sequence[str], rows: int = 16_384) -> Iterator[pa.Table]:
    """Regroup batches sorted by `keys` so that no group is cut; tables of about `rows` rows.

    Memory follows `rows` plus the largest group, which callers bound with `spread`.
    """
    held: list[pa.RecordBatch] = []
    count = 0
    for batch in batches:
        if batch.num_rows == 0:
            continue
        held.append(batch)
        count += batch.num_rows
        if count < rows:
            continue
        found = pa.Table.from_batches(held)
        changed = np.zeros(found.num_rows, dtype=bool)
        for k in keys:
            v = found.column(k).to_numpy(zero_copy_only=False)
            changed[1:] |= v[1:] != v[:-1]
        edges = np.flatnonzero(changed)
        if not len(edges):
            held = [b for b in found.combine_chunks().to_batches()]
            continue
        yield found.slice(0, int(edges[-1]))
        rest = found.slice(int(edges[-1])).combine_chunks()
        held, count = rest.to_batches(), rest.num_rows
    if held:
        yield pa.Table.from_batches(held)
    held = []
    release()


def group_starts(found: pa.Table, keys: Sequence[str]) -> np.ndarray:
    """Offsets of the groups in a table sorted by `keys`, with the end of the table as the last."""
    changed = np.ones(found.num_rows, dtype=bool)
    changed[1:] = False
    for k in keys:
        v = found.column(k).to_numpy(zero_copy_only=False)
        changed[1:] |= v[1:] != v[:-1]
    return np.append(np.flatnonzero(changed), found.num_rows)


def spread(first: DataFrame, keys: Sequence[str], deeper: Sequence[Callable[[DataFrame], DataFrame]], most: int) -> list[DataFrame]:
    """Split groups over `most` rows by ever finer keys.

    `first` holds (keys, payload). Groups of at most `most` rows stay as they are; the rows
    of larger ones go through the next function of `deeper`, which deals them to finer keys,
    and so on. Returns one frame for each depth reached; together they hold every row. Counts
    are partial aggregates, and the list of crowded keys is at most 1/`most` of the rows.
    """
    parts, now = [], first
    for finer in deeper:
        crowded = cut(now.groupBy(*keys).count().filter(F.col("count") > most).select(*keys))
        n = crowded.count()
        if not n:
            return [*parts, now]
        if n <= BROADCAST_KEYS:  # checked size: else the rows themselves would be dealt out twice
            crowded = F.broadcast(crowded)
        parts.append(now.join(crowded, list(keys), "left_anti"))
        now = finer(now.join(crowded, list(keys), "left_semi"))
    return [*parts, now]
