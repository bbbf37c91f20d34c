"""Expected against actual cases, and other joins and set operations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.similarity import field_name_similarity


def reconcile(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """case_id, state, missing, extra of expected (case_id, formats) and actual (case_id, formats).

    Case numbers match whatever their case. Complete: all formats are there; Partial: some are missing; Missing: no
    actual case; Extra: no expected one."""
    e = expected.select(F.lower("case_id").alias("k"), F.col("case_id").alias("e"), F.col("formats").alias("wanted"))
    a = actual.groupBy(F.lower("case_id").alias("k")).agg(F.min("case_id").alias("a"), F.array_distinct(F.flatten(F.collect_list("formats"))).alias("there"))
    none = F.expr("cast(array() as array<string>)")
    both = e.join(a, "k", "full_outer").select(F.coalesce("e", "a").alias("case_id"), "e", "a", F.coalesce("wanted", none).alias("wanted"), F.coalesce("there", none).alias("there"))
    missing, extra = F.array_sort(F.array_except("wanted", "there")), F.array_sort(F.array_except("there", "wanted"))
    state = F.when(F.col("e").isNull(), "Extra").when(F.col("a").isNull(), "Missing").when(F.size(missing) == 0, "Complete").otherwise("Partial")
    return both.select("case_id", state.alias("state"), missing.alias("missing"), extra.alias("extra"))


def union_by_priority(key: str, *frames: DataFrame) -> DataFrame:
    """All rows of the first frame, then those of each next whose key hasn't come yet."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f.join(out.select(key), key, "left_anti"))
    return out


def differences(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """key and side: the keys that only one of the two has, whatever their case."""
    x, y = a.select(F.lower(key).alias(key)).distinct(), b.select(F.lower(key).alias(key)).distinct()
    return x.exceptAll(y).withColumn("side", F.lit("left")).unionByName(y.exceptAll(x).withColumn("side", F.lit("right")))


#: Rows of a right side that is broadcast; a longer one is dealt over blocks of so many rows.
SHORT = 10_000


def best_matches(left: DataFrame, right: DataFrame, score: Column, key: str, least: float = 0.7, short: int = SHORT) -> DataFrame:
    """For each left row (key, ...) the right row (place, ...) of the highest score, the first of equals.

    A score may be anything, so every left row is compared with every right one; only pairs that reach `least` come out.
    A right side of up to `short` rows, the usual list of field names, is broadcast. A longer one is dealt over blocks,
    and left rows go to each of them, so that no task holds more of it than a block."""
    n = right.limit(short + 1).count()
    if n <= short:
        pairs = left.join(F.broadcast(right), score >= least)
    else:
        blocks = -(-right.count() // short)
        dealt = right.withColumn("_block", F.pmod(F.xxhash64("place"), F.lit(blocks)))
        spread = left.withColumn("_block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))
        pairs = spread.join(dealt, (spread["_block"] == dealt["_block"]) & (score >= least)).drop("_block")
    best = F.max_by(F.struct(*(F.col(c) for c in right.columns)), F.struct(score.alias("s"), (-F.col("place")).alias("p")))
    return pairs.groupBy(*left.columns).agg(best.alias("best"), F.max(score).alias("score"))


def renamed_fields(missing: DataFrame, unmatched: DataFrame) -> DataFrame:
    """Missing fields (field) with the unmatched field (place, name) they were probably renamed to."""
    return best_matches(missing, unmatched, field_name_similarity(F.lower("field"), F.lower("name")), "field")
