"""Who is who: variants of tax numbers, duplicates of persons, files and catalogue entries."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.normalize import strip_accents
from ..functions.sequence import common_length, letter_places
from ..functions.validate import blank
from ..workers import kept


def clean_rfc(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"[-. ]", ""))


def canonical_rfc(c: Column) -> Column:
    """Without marks; the fourth letter of a person's number is left out, so that it equals a firm's form."""
    bare = clean_rfc(c)
    return F.when((F.length(bare) == 13) & F.substring(bare, 4, 1).rlike(r"\p{L}"), F.concat(F.substring(bare, 1, 3), F.substring(bare, 5, 9))).otherwise(bare)


def rfc_variants(c: Column) -> Column:
    """The number as it stands, without marks, and in groups of 3, 6 and 3 with hyphens and with spaces."""
    bare, short = clean_rfc(c), canonical_rfc(c)
    grouped = lambda mark: F.when(F.length(short) == 12, F.concat_ws(mark, F.substring(short, 1, 3), F.substring(short, 4, 6), F.substring(short, 10, 3)))
    return F.when(blank(c), F.expr("cast(array() as array<string>)")).otherwise(F.array_distinct(F.array_compact(F.array(F.trim(c), F.nullif(bare, F.lit("")), grouped("-"), grouped(" ")))))


def distinct_persons(rows: DataFrame, order: str = "place") -> DataFrame:
    """rows (rfc, name, order), the first of each person: by canonical number, or by name where there is none."""
    key = F.coalesce(F.when(~blank(F.col("rfc")), F.concat(F.lit("R:"), F.upper(canonical_rfc(F.col("rfc"))))), F.concat(F.lit("N:"), F.upper(F.trim("name"))))
    cols = F.struct(F.col(order).alias("_order"), *(F.col(c) for c in rows.columns if c != order))
    return rows.withColumn("_key", key).groupBy("_key").agg(F.min(cols).alias("r")).select(F.col("r._order").alias(order), *(F.col(f"r.{c}").alias(c) for c in rows.columns if c != order))


def find_by_rfc(persons: DataFrame, wanted: DataFrame) -> DataFrame:
    """wanted (rfc) with the first person (person_id, rfc) that shares a variant of it."""
    known = persons.select("person_id", F.explode(rfc_variants(F.col("rfc"))).alias("v")).withColumn("v", F.upper("v"))
    asked = wanted.select(F.col("rfc").alias("asked"), F.explode(F.array_distinct(F.concat(rfc_variants(F.col("rfc")), F.array(canonical_rfc(F.col("rfc")))))).alias("v")).withColumn("v", F.upper("v"))
    return asked.join(known, "v").groupBy("asked").agg(F.min("person_id").alias("person_id"))


def find_or_create(persons: DataFrame, wanted: DataFrame) -> DataFrame:
    """asked, person_id, created: the known person, or a new one named by the number's digest."""
    found = find_by_rfc(persons, wanted)
    every = wanted.select(F.col("rfc").alias("asked")).distinct()
    out = every.join(found, "asked", "left")
    new = F.concat(F.lit("new-"), F.substring(F.md5(F.upper(canonical_rfc(F.col("asked")))), 1, 12))
    return out.select("asked", F.coalesce(F.col("person_id").cast("string"), new).alias("person_id"), F.col("person_id").isNull().alias("created"))


def mark_duplicates(new: DataFrame, journal: DataFrame, keys: tuple[str, ...] = ("digest", "url")) -> DataFrame:
    """new files with stored (the path an equal file was stored at, if any) and duplicate."""
    known = journal.groupBy(*keys).agg(F.min("stored").alias("stored"))
    return new.join(known, list(keys), "left").withColumn("duplicate", F.col("stored").isNotNull())


def primary_file(files: DataFrame, case: str = "case_id", order: str = "place") -> DataFrame:
    """The first PDF of each case, else its first file."""
    cols = F.struct((F.lower("format") != "pdf").alias("_other"), F.col(order), F.col("name"), F.col("format"))
    return files.groupBy(case).agg(F.min(cols).alias("f")).select(case, "f.name", "f.format")


def case_guid(c: Column) -> Column:
    """A GUID that depends on the case's number alone."""
    h = F.md5(c)
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.substring(h, 13, 4), F.substring(h, 17, 4), F.substring(h, 21, 12))


def comparable_name(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(strip_accents(F.upper(c)), r"[^A-Z0-9 ]", " "), " +", " "))


def name_quality(name: Column) -> Column:
    """Which spelling of a name to keep: mixed case, a middling length and words that complete a court's name speak for it."""
    upper, lower = F.upper(name) != name, F.lower(name) != name
    mixed = F.when(~upper & lower, -10).when(upper & lower, 5).otherwise(0)
    size = F.when(F.length(name).between(20, 80), 10).when(F.length(name) > 80, -5).otherwise(0)
    whole = F.upper(name).contains("CON RESIDENCIA") | F.upper(name).contains("DEL DISTRITO")
    return mixed + size - F.when(name.rlike(r"[0-9]+$"), 5).otherwise(0) + F.when(whole, 3).otherwise(0)


#: Distinct names of a type in a block; pairs of blocks are compared, so no task grows with a type.
NAME_BLOCK = 1000


def _close_pairs(a: list[tuple[int, str]], b: list[tuple[int, str]] | None, threshold: int) -> list[tuple[int, int]]:
    """(later, earlier) places of names (place, sorted words) of a and b, or of a alone, with a ratio of threshold or more.

    The ratio is that of functions.similarity.token_sort_ratio. Letters that two names share, counted without their
    order, bound the common subsequence from above; only pairs that the bound admits are compared in full."""
    right = a if b is None else b
    letters = {x: i for i, x in enumerate(sorted({x for _, name in [*a, *right] for x in name}))}

    def counts(names: list[tuple[int, str]]) -> np.ndarray:
        out = np.zeros((len(names), len(letters)), dtype=np.int32)
        for i, (_, name) in enumerate(names):
            for x in name:
                out[i, letters[x]] += 1
        return out

    have = counts(right)
    size = have.sum(axis=1)
    out = []
    for i, ((place, name), own) in enumerate(zip(a, counts(a))):
        begin = i + 1 if b is None else 0
        total = len(name) + size[begin:]
        bound = np.minimum(have[begin:], own).sum(axis=1)
        places = letter_places(name)
        for j in np.flatnonzero((400 * bound >= (2 * threshold - 1) * total) & (size[begin:] > 0) & (len(name) > 0)) + begin:
            other, text = right[j]
            if int(200 * common_length(name, text, places) / (len(name) + len(text)) + 0.5) >= threshold:
                out.append((max(place, other), min(place, other)))
    return out


def _seeds(pairs: DataFrame) -> DataFrame:
    """place and seed of names that are like an earlier one that is a seed: the first such. A name is a seed if none of the
    earlier names that it is like is one.

    Decided in rounds: names whose earlier names are all decided, or among which there is a seed, are decided themselves.
    Any number of names is decided at once, so no task holds a type."""
    pairs = kept(pairs.select("later", "earlier").distinct())
    decided = kept(pairs.select(F.col("earlier").alias("place")).distinct().join(pairs.select(F.col("later").alias("place")).distinct(), "place", "left_anti").withColumn("is_seed", F.lit(True)))
    open_ = pairs.select(F.col("later").alias("place")).distinct()
    while True:
        seen = pairs.join(open_, F.col("later") == F.col("place"), "left_semi").join(decided.select(F.col("place").alias("earlier"), "is_seed"), "earlier", "left")
        told = seen.groupBy(F.col("later").alias("place")).agg(F.max(F.coalesce("is_seed", F.lit(False))).alias("has_seed"), F.min(F.col("is_seed").isNotNull()).alias("all_known"))
        new = kept(told.where("has_seed or all_known").select("place", (~F.col("has_seed")).alias("is_seed")))
        if new.isEmpty():
            break
        decided = kept(decided.unionByName(new))
        open_ = kept(open_.join(new, "place", "left_anti"))
    seeds = decided.where("is_seed").select(F.col("place").alias("earlier"))
    others = decided.where("not is_seed").select(F.col("place").alias("later"))
    return pairs.join(others, "later", "left_semi").join(seeds, "earlier", "left_semi").groupBy(F.col("later").alias("place")).agg(F.min("earlier").alias("seed"))


def cluster_names(rows: DataFrame, threshold: int = 85, shortest: int = 0, block: int = NAME_BLOCK) -> DataFrame:
    """rows (place, type, name) with the place of the name's seed, clustered greedily in order within a type.

    All distinct names of a type are compared: they are dealt over blocks, and each pair of blocks is a group of its own.
    The greedy step sees nothing but the pairs that are alike. Places are distinct. A null name counts as empty."""
    key = F.coalesce(comparable_name(F.col("name")), F.lit(""))
    keyed = rows.withColumn("key", key)
    first = keyed.groupBy("type", "key").agg(F.min("place").alias("place"))
    many = first.groupBy("type").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    words = F.array_join(F.array_sort(F.split("key", " ")), " ")
    dealt = first.join(F.broadcast(many), "type").select(F.xxhash64("type").alias("kind"), "type", "place", words.alias("words"), (F.length("key") > shortest).alias("long"), "blocks", F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int").alias("own"))
    pairs = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumn("low", F.least("own", "other")).withColumn("high", F.greatest("own", "other"))

    def alike(pdf: pd.DataFrame) -> pd.DataFrame:
        low, high = pdf["low"].iloc[0], pdf["high"].iloc[0]
        side = lambda k: [(int(p), w) for p, w in zip(pdf["place"][pdf["own"] == k], pdf["words"][pdf["own"] == k])]
        long = dict(zip(pdf["place"], pdf["long"]))
        found = [x for x in _close_pairs(side(low), None if low == high else side(high), threshold) if long[x[0]]]
        return pd.DataFrame({"kind": [pdf["kind"].iloc[0]] * len(found), "later": [x[0] for x in found], "earlier": [x[1] for x in found]}, dtype="int64")

    close = pairs.groupBy("type", "low", "high").applyInPandas(alike, "kind long, later long, earlier long")
    named = first.join(_seeds(close), "place", "left").select("type", "key", F.coalesce("seed", "place").alias("seed"))
    return keyed.join(named, ["type", "key"]).drop("key")


def survivors(clustered: DataFrame) -> DataFrame:
    """seed, name, region, n of clusters (seed, name, region): the best spelling, of equals the longest, then the first; the
    first region that is known."""
    quality = name_quality(F.col("name"))
    return clustered.groupBy("type", "seed").agg(F.max_by("name", F.struct(quality.alias("q"), F.length("name").alias("l"), (-F.col("place")).alias("p"))).alias("name"), F.min_by("region", F.struct(F.col("region").isNull(), F.col("place"))).alias("region"), F.count("*").alias("n"))
