"""Shared helpers of the training-data operators."""

from __future__ import annotations

import contextlib
import ctypes
import gc
from collections.abc import Callable, Iterator
from functools import lru_cache, partial

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..workers import kept, ship, spread

#: Text handed to Python code at once; bounds a worker's memory whatever the row count of an Arrow batch.
BLOCK_CHARS = 4_000_000


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of the data folder, through Spark's own reader only. A small file of texts is spread over all cores."""
    rows = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(rows) if name in ("documents", "pages") else rows


def map_batches(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """mapInArrow, with the package importable on the workers."""
    ship(df.sparkSession)
    operator = getattr(fn, "func", fn).__module__

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn_to(operator)
        yield from fn(batches)
        give_back()

    return df.mapInArrow(run, schema)


def give_back() -> None:
    """Returns memory that a worker, or the driver, no longer uses to the system, so that the next task finds it."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # where there is no such C library
        ctypes.CDLL(None).malloc_trim(0)


def blocks(batch: pa.RecordBatch, column: str = "text", limit: int = BLOCK_CHARS) -> Iterator[pa.RecordBatch]:
    """Slices a batch so that each slice holds about `limit` bytes of text, and at least one row."""
    if batch.num_rows == 0:
        return
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    begin, held = 0, 0
    for i, n in enumerate(sizes):
        if held and held + n > limit:
            yield batch.slice(begin, i - begin)
            begin, held = i, 0
        held += int(n)
    yield batch.slice(begin)


def cut(df: DataFrame) -> DataFrame:
    """Computes df once, writes it to the shared checkpoint folder and reads it from there.

    Lost executors cost nothing: the files are in the shared folder. They stay there, unless the session was started with
    spark.cleaner.referenceTracking.cleanCheckpoints, which removes those of frames no longer used."""
    return kept(df)


def few(df: DataFrame, rows: int, each: int = 16_384) -> DataFrame:
    """df in as few partitions as its number of rows asks for, so that small tables don't leave many small files behind
    each exchange. Larger tables keep all that the exchange made. For rows of at most some hundred bytes, not for texts,
    and not above Python steps."""
    return df.coalesce(max(2, -(-rows // each)))


def documents(df: DataFrame, *more: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text (null: empty) and the named columns; all else, whatever its name, is left behind."""
    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), *more)


def spread_join(rows: DataFrame, groups: DataFrame, *keys: str, how: str = "inner") -> DataFrame:
    """Joins rows to what was aggregated from them by the same keys, a hot key's rows being split over many tasks.

    A plain join would use the aggregate's partitioning as it is, which adaptive execution can't split. With a digest of
    the keys as one more key both sides are dealt anew."""
    key = F.xxhash64(*keys)
    return rows.withColumn("_spread", key).join(groups.withColumn("_spread", key), [*keys, "_spread"], how).drop("_spread")


#: Bits of the membership filter: 8 MB in 2,048 rows, at any scale. When it fills up it lets more pass, no fewer.
FILTER_BITS = 1 << 26


def flag_members(rows: DataFrame, key: str, members: DataFrame, flag: str = "_maybe") -> DataFrame:
    """rows with a flag that is true where the key may be one of members' keys, and false only where it isn't.

    Rows without the flag needn't be moved to be compared with members. The filter is a bitmap of hashed keys."""
    hashed = F.pmod(F.xxhash64(key), F.lit(FILTER_BITS)) + 1
    bits = members.select(hashed.alias("_h")).groupBy(F.bitmap_bucket_number("_h").alias("_bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("_h")).alias("_bits"))
    found = rows.withColumn("_h", hashed).withColumn("_bucket", F.bitmap_bucket_number("_h")).withColumn("_place", F.bitmap_bit_position("_h")).join(F.broadcast(bits), "_bucket", "left")
    test = F.expr("coalesce(cast(conv(hex(substring(_bits, cast(_place div 8 as int) + 1, 1)), 16, 10) as int) & shiftleft(1, cast(_place % 8 as int)), 0) <> 0")
    return found.withColumn(flag, test).drop("_h", "_bucket", "_place", "_bits")


def text_key(text: str | Column = "text") -> Column:
    """16 bytes of a text's SHA-256 digest, null counting as empty."""
    return F.unhex(F.substring(F.sha2(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")), 256), 1, 32))


def keep_rows(docs: DataFrame, decisions: DataFrame) -> DataFrame:
    """The rows of docs, with all their columns, that decisions (doc_id, text_id, kept) keep; of rows alike in doc_id and
    text, one. Only texts of which a row is dropped are compared, so all others aren't moved. A row travels as one value,
    so that its columns may have any names."""
    whole = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
    whole = whole.select("row", F.col("row.doc_id").alias("_id"), text_key(F.col("row.text")).alias("_text"))
    flagged = flag_members(whole, "_text", decisions.where("not kept").select(F.col("text_id").alias("_text")))
    kept = decisions.where("kept").select(F.col("doc_id").alias("_kept_id"), F.col("text_id").alias("_kept_text"))
    some = flagged.where("_maybe")
    some = some.join(kept, some["_id"].eqNullSafe(kept["_kept_id"]) & (some["_text"] == kept["_kept_text"]), "left_semi").dropDuplicates(["_id", "_text"])
    return flagged.where("not _maybe").unionByName(some).select("row.*")


_CACHES: list = []
_OPERATOR: list[str] = [""]


def worker_cache(make=None, size: int = 1):
    """A value of its own for each Python worker and the last `size` arguments, until the worker turns to another operator."""
    if make is None:
        return partial(worker_cache, size=size)
    cached = lru_cache(maxsize=size)(make)
    _CACHES.append(cached)
    return cached


def turn_to(operator: str) -> None:
    """Before a task of another operator than the last one's, a worker gives up all its tables, whether or not the task needs
    some of its own, so that it holds one operator's at a time."""
    if operator != _OPERATOR[0]:
        _OPERATOR[0] = operator
        for cached in _CACHES:
            cached.cache_clear()
        give_back()
