"""Queries put together at run time: optional filters, order, pages, and a small repository."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass
class Specification:
    """What to select: conditions (all must hold), joined tables, order, page."""

    where: list[Column] = field(default_factory=list)
    include: list[tuple[DataFrame, str]] = field(default_factory=list)
    order: list[Column] = field(default_factory=list)
    skip: int = 0
    take: int | None = None

    def apply(self, rows: DataFrame) -> DataFrame:
        """where, then include, then order, then page. A page needs a total order to be the same each time."""
        if self.where:
            rows = rows.where(reduce(lambda a, b: a & b, self.where))
        for other, key in self.include:
            rows = rows.join(other, key, "left")
        if self.order:
            rows = rows.orderBy(*self.order)
        if self.skip:
            rows = rows.offset(self.skip)
        return rows if self.take is None else rows.limit(self.take)


def only(**filters: object) -> list[Column]:
    """Equality conditions for the filters that are given."""
    return [F.col(k) == F.lit(v) for k, v in filters.items() if v is not None]


def between(column: str, start: object = None, end: object = None) -> list[Column]:
    return [*([F.col(column) >= F.lit(start)] if start is not None else []), *([F.col(column) <= F.lit(end)] if end is not None else [])]


class Repository:
    """Rows by key. Changes give a new DataFrame; writing it is up to the caller."""

    def __init__(self, rows: DataFrame, key: str):
        self.rows, self.key = rows, key

    def get(self, value: object) -> DataFrame:
        return self.rows.where(F.col(self.key) == F.lit(value)).limit(1)

    def find(self, condition: Column) -> DataFrame:
        return self.rows.where(condition)

    def exists(self, condition: Column) -> bool:
        return not self.find(condition).isEmpty()

    def count(self, condition: Column | None = None) -> int:
        return (self.rows if condition is None else self.find(condition)).count()

    def first(self, condition: Column, *order: Column) -> DataFrame:
        return self.find(condition).orderBy(*order).limit(1)

    def select(self, condition: Column, *columns: Column | str) -> DataFrame:
        return self.find(condition).select(*columns)

    def list(self, specification: Specification) -> DataFrame:
        return specification.apply(self.rows)

    def add(self, new: DataFrame) -> Repository:
        return Repository(self.rows.unionByName(new), self.key)

    def update(self, new: DataFrame) -> Repository:
        return Repository(self.rows.join(new.select(self.key), self.key, "left_anti").unionByName(new), self.key)

    def remove(self, keys: DataFrame) -> Repository:
        return Repository(self.rows.join(keys.select(self.key), self.key, "left_anti"), self.key)


def effective(templates: DataFrame, now: Column, keys: tuple[str, ...] = ("type",)) -> DataFrame:
    """The active template of each type that is in force: the one that came into force last."""
    rows = templates.where(F.col("active") & (F.col("effective") <= now) & (F.col("expires").isNull() | (F.col("expires") > now)))
    cols = F.struct(*(F.col(c) for c in templates.columns))
    return rows.groupBy(*keys).agg(F.max_by(cols, F.struct("effective", "version")).alias("t")).select("t.*")


def version_key(c: Column) -> Column:
    """A version's numbers, to compare by."""
    return F.transform(F.split(c, r"\."), lambda x: F.coalesce(x.try_cast("int"), F.lit(0)))


def activate(templates: DataFrame, kind: str, version: str) -> DataFrame:
    """templates with just that version of its type active."""
    return templates.withColumn("active", F.when(F.col("type") == kind, F.col("version") == version).otherwise(F.col("active")))


def deletable(templates: DataFrame) -> DataFrame:
    """Templates that may be deleted: those that aren't active."""
    return templates.where(~F.col("active"))


def repeated_versions(templates: DataFrame) -> DataFrame:
    """type and version that occur more than once."""
    return templates.groupBy("type", "version").agg(F.count("*").alias("n")).where("n > 1")
