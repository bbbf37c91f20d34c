"""Exact deduplication by content-defined chunk recipes.

Each text is cut where its content says so, so that equal passages give equal chunks wherever they stand. A chunk is
known by a 64-bit key; it is verified by its length and SHA-256 digest: chunks of one key that differ in these get
identifiers of their own. A document is then the ordered list of its chunks' identifiers, and documents are compared by
these lists. The texts themselves are read once and never moved.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Windows of 32 bytes decide on cuts; a cut is due at one place in 2 ** BITS on average.
WINDOW, BITS, SHORTEST, LONGEST = 32, 11, 512, 16384
#: A pseudo-random 32-bit value for each byte.
GEAR = np.array([int.from_bytes(hashlib.sha256(bytes([i])).digest()[:4], "little") for i in range(256)], dtype=np.uint32)
SCHEMA = "row_id long, doc_id long, text_sha256 string, chunks array<struct<key: long, size: long, digest: binary>>"


def cuts(data: bytes) -> list[int]:
    """The ends of the chunks of a text, the last being its length.

    A place is a cut if the rolling value of the 32 bytes before it ends in BITS zeros; it is passed over less than
    SHORTEST bytes after the last cut, and forced after LONGEST bytes."""
    n = len(data)
    if n <= SHORTEST:
        return [n] if n else []
    value = GEAR[np.frombuffer(data, dtype=np.uint8)]
    width = 1
    while width < WINDOW:  # the sum over the window of GEAR[byte] << age, by doubling
        shifted = np.zeros_like(value)
        shifted[width:] = value[:-width] << np.uint32(width)
        value = value + shifted
        width *= 2
    places = np.flatnonzero(value >> np.uint32(32 - BITS) == 0) + 1
    out, last = [], 0
    for p in [*places.tolist(), n]:
        while p - last > LONGEST:
            last += LONGEST
            out.append(last)
        if p - last >= SHORTEST and p < n:
            out.append(p)
            last = p
    if last < n:
        out.append(n)
    return out


def recipe(data: bytes) -> list[dict]:
    out, at = [], 0
    for to in cuts(data):
        chunk = data[at:to]
        out.append({"key": xxhash.xxh64_intdigest(chunk) - (1 << 63), "size": len(chunk), "digest": hashlib.sha256(chunk).digest()})
        at = to
    return out


def _run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    row = TaskContext.get().partitionId() << 36
    kind = pa.list_(pa.struct([("key", pa.int64()), ("size", pa.int64()), ("digest", pa.binary())]))
    for batch in batches:
        for part in common.blocks(batch):
            data = [t.as_py().encode() for t in part.column("text")]
            n = part.num_rows
            yield pa.record_batch([pa.array(range(row, row + n), pa.int64()), part.column("doc_id"), pa.array([hashlib.sha256(d).hexdigest() for d in data]), pa.array([recipe(d) for d in data], kind)], names=["row_id", "doc_id", "text_sha256", "chunks"])
            row += n


def exact_dedup(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """One row per row: doc_id, keep_id, group_size, kept, text_sha256, n_chunks.

    Of equal texts the row with the largest doc_id stays (of repeated rows of that doc_id, one; a null doc_id counts
    as the smallest). Null counts as empty, and empty texts, having an empty recipe, equal each other.

    Recipes (about 60 bytes a KB of text) are computed in one pass and kept in the checkpoint folder. Chunk counts,
    list comparison and the choice of the row that stays are aggregated before they are shuffled, so a group of a third
    of all rows is as many partial sums as there are tasks; the joins back are plain equi-joins, which adaptive
    execution splits where a key is hot."""
    rows = common.cut(common.map_batches(common.documents(docs, id_col=id_col, text_col=text_col), _run, SCHEMA))
    chunk = rows.select("row_id", F.posexplode("chunks").alias("place", "chunk")).select("row_id", "place", "chunk.*")
    distinct = chunk.groupBy("key", "size", "digest").agg(F.count("*").alias("uses"))
    # a key whose chunks differ is told apart; each other key is its chunk's identifier as it is
    clash = distinct.groupBy("key").agg(F.count("*").alias("n"), F.sum("uses").alias("uses")).where("n > 1").select("key")
    differ = distinct.join(clash, "key", "left_semi")
    rank = F.expr("row_number() over (partition by key order by size, digest)")
    verified = distinct.where("uses > 1").join(clash, "key", "left_anti").select("key", "size", "digest", F.lit(0).alias("variant")).unionByName(differ.where("uses > 1").select("key", "size", "digest", rank.alias("variant")))
    # only texts all of whose chunks have another use can have an equal
    used = chunk.join(verified, ["key", "size", "digest"]).groupBy("row_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "key", "variant"))), lambda c: F.struct(c["key"].alias("key"), c["variant"].alias("variant"))).alias("recipe"))
    base = rows.select("row_id", "doc_id", "text_sha256", F.size("chunks").alias("n_chunks"))
    listed = base.join(used, "row_id", "left").withColumn("recipe", F.when(F.col("n_chunks") == 0, F.expr("cast(array() as array<struct<key: bigint, variant: int>>)")).when(F.size("recipe") == F.col("n_chunks"), F.col("recipe")))
    first = F.struct(F.coalesce("doc_id", F.lit(-(1 << 63))).alias("o"), F.col("doc_id").alias("doc_id"), F.col("row_id").alias("row_id"))
    shared = listed.where("recipe is not null")
    groups = shared.groupBy("recipe").agg(F.max(first).alias("stays"), F.count("*").alias("n"))
    found = common.spread_join(shared, groups, "recipe")
    size = F.col("n_chunks").cast("long").alias("n_chunks")
    grouped = found.select("doc_id", F.col("stays.doc_id").alias("keep_id"), F.col("n").alias("group_size"), (F.col("stays.row_id") == F.col("row_id")).alias("kept"), "text_sha256", size)
    alone = listed.where("recipe is null").select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "text_sha256", size)
    return grouped.unionByName(alone)


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of docs that stay, with all their columns: of equal texts, empty and null ones being equal, the one with the
    largest doc_id, null ids counting as the smallest; of rows alike in doc_id and text, one. Columns beyond doc_id and
    text, whatever their names, come along as they are. An empty table gives an empty one."""
    return common.keep_rows(docs, exact_dedup(docs).withColumn("text_id", F.unhex(F.substring("text_sha256", 1, 32))))
