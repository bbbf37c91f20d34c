"""Export templates: mappings compiled to columns, rules compiled to predicates, and drift of schemas."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructType

from ..functions.similarity import field_name_similarity

CALL = re.compile(r"^\s*(\w+)\s*\((.*)\)\s*$", re.DOTALL)


def _arguments(raw: str) -> list[str]:
    return [a.strip().strip("'\"") for a in re.split(r",(?=(?:[^'\"]|'[^']*'|\"[^\"]*\")*$)", raw)] if raw.strip() else []


def transform(c: Column, expression: str | None) -> Column:
    """A column through steps such as "Trim() | ToUpper() | PadLeft(10, 0)". Places count from 0; padding never cuts off."""
    for step in (s for s in (expression or "").split("|") if s.strip()):
        m = CALL.match(step)
        if not m:
            raise ValueError(f"not a step: {step!r}")
        name, args = m[1].lower(), _arguments(m[2])
        if name == "toupper":
            c = F.upper(c)
        elif name == "tolower":
            c = F.lower(c)
        elif name == "trim":
            c = F.regexp_replace(c, r"^\s+|\s+$", "")
        elif name == "substring":
            start, n = int(args[0]), int(args[1]) if len(args) > 1 else 1 << 30
            c = F.when(F.length(c) > start, F.substring(c, start + 1, n)).otherwise(c)
        elif name == "replace":
            c = F.replace(c, F.lit(args[0]), F.lit(args[1] if len(args) > 1 else ""))
        elif name in ("padleft", "padright"):
            n, fill = int(args[0]), (args[1] if len(args) > 1 and args[1] else " ")
            c = F.when(F.length(c) < n, (F.lpad if name == "padleft" else F.rpad)(c, n, fill)).otherwise(c)
        else:
            raise ValueError(f"unknown step: {name}")
    return c


def rule(c: Column, text: str) -> Column:
    """A rule as a predicate: Required, Regex:, Range:a,b, MinLength:, MaxLength:, EmailAddress."""
    name, _, value = text.partition(":")
    name = name.strip().lower()
    if name == "required":
        return F.coalesce(c.rlike(r"\S"), F.lit(False))
    if name == "regex":
        return F.coalesce(c.rlike(value.strip()), F.lit(False))
    if name == "range":
        low, high = (float(x) for x in value.split(","))
        return F.coalesce(c.try_cast("double").between(low, high), F.lit(False))
    if name == "minlength":
        return F.coalesce(F.length(c) >= int(value), F.lit(False))
    if name == "maxlength":
        return F.coalesce(F.length(c) <= int(value), F.lit(True))
    if name == "emailaddress":
        return F.coalesce(c.rlike(r"^[^@\s]+@[^@\s]+\.[^@\s]+$"), F.lit(False))
    raise ValueError(f"unknown rule: {text}")


@dataclass
class Mapping:
    """A column of an export: where its value comes from and what is done with it."""

    source: str
    target: str
    place: int
    default: str | None = None
    required: bool = False
    format: str | None = None
    transform: str | None = None
    rules: list[str] = field(default_factory=list)

    def column(self) -> Column:
        c = F.col(self.source)
        c = F.date_format(c, self.format) if self.format else c.cast("string")
        if self.default is not None:
            c = F.coalesce(F.nullif(c, F.lit("")), F.lit(self.default))
        return transform(c, self.transform)


def project(rows: DataFrame, mappings: list[Mapping], *keys: str) -> DataFrame:
    """rows as the template's columns, in their order."""
    return rows.select(*keys, *(m.column().alias(m.target) for m in sorted(mappings, key=lambda m: m.place)))


def problems(rows: DataFrame, mappings: list[Mapping], *keys: str) -> DataFrame:
    """keys and the targets that a required value is missing for or whose rules fail."""
    tests = []
    for m in sorted(mappings, key=lambda m: m.place):
        for r in [*(["Required"] if m.required else []), *m.rules]:
            tests.append(F.when(~rule(m.column(), r), F.lit(f"{m.target}:{r.partition(':')[0]}")))
    return rows.select(*keys, F.array_compact(F.array(*tests)).alias("problems"))


def field_paths(schema: StructType, prefix: str = "") -> list[str]:
    """Dotted paths of all fields; an array of records gives those of its records."""
    out = []
    for f in schema.fields:
        kind = f.dataType.elementType if isinstance(f.dataType, ArrayType) else f.dataType
        out += field_paths(kind, f"{prefix}{f.name}.") if isinstance(kind, StructType) else [f"{prefix}{f.name}"]
    return out


def drift(rows: DataFrame, mappings: list[Mapping], least: float = 0.7) -> dict:
    """New, missing and renamed fields of a schema against a template, and how grave that is. Works on names alone, of
which there are as many as columns; their similarity is computed by the same column expression as everywhere."""
    there = {p.lower(): p for p in field_paths(rows.schema)}
    wanted = {m.source.lower(): m for m in mappings}
    new, gone = [p for k, p in there.items() if k not in wanted], [m for k, m in wanted.items() if k not in there]
    renamed = {}
    if new and gone:
        pairs = rows.sparkSession.createDataFrame([(m.source, p, i) for m in gone for i, p in enumerate(new)], "a string, b string, i int")
        scored = pairs.select("a", "b", "i", field_name_similarity(F.lower("a"), F.lower("b")).alias("s")).where(F.col("s") >= least)
        for r in scored.groupBy("a").agg(F.max_by("b", F.struct("s", (-F.col("i")).alias("p"))).alias("b")).collect():
            renamed[r["a"]] = r["b"]
    lost = [m for m in gone if m.source not in renamed]
    severity = "High" if any(m.required for m in lost) else "Medium" if renamed or lost else "Low" if [p for p in new if p not in renamed.values()] else "None"
    return {"new": [p for p in new if p not in renamed.values()], "missing": [m.source for m in lost], "renamed": renamed, "severity": severity}


def suggest(rows: DataFrame) -> list[Mapping]:
    """A mapping for each field of the schema, in its order."""
    return [Mapping(p, p.rpartition(".")[2], i) for i, p in enumerate(field_paths(rows.schema))]


#: Codes of languages, output formats, and for each figure the range that is an error to leave and the one
#: beyond which there is a warning (None: no bound). Values at a bound are within.
LANGUAGES = ("eng", "spa", "fra", "deu", "ita", "por", "rus", "jpn", "kor", "chi_sim", "chi_tra", "ara", "heb", "tha", "vie", "tur", "pol", "ces", "hun", "swe", "nor", "dan", "fin", "nld", "ell", "bul", "hrv", "slv", "est", "lav", "lit", "mlt", "ron", "slk", "sqi")
OUTPUT_FORMATS = ("json", "xml", "csv", "txt", "pdf")
SETTINGS = {
    "oem": ((0, 3), (None, None)),
    "psm": ((0, 13), (None, None)),
    "confidence": ((0, 1), (0.5, 0.95)),
    "timeout_seconds": ((1, 3600), (None, None)),
    "max_retries": ((0, None), (None, 10)),
    "retry_delay_seconds": ((0, None), (None, 300)),
    "max_file_size_mb": ((1, None), (None, 100)),
    "max_concurrency": ((1, None), (None, 20)),
    "batch_size": ((1, None), (None, 100)),
    "max_memory_mb": ((1, None), (None, 2048)),
}


def configuration_problems(columns: dict[str, Column]) -> Column:
    """struct(errors, warnings): names of the settings out of their range, in order; settings that aren't given are not
    looked at. A language is required and known, a fallback language and an output format are known where they are given.
    An error leaves no warning of the same figure, but for confidence."""
    empty = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    errors, warnings = [], []
    for name, known, required in (("language", LANGUAGES, True), ("fallback_language", LANGUAGES, False), ("output_format", OUTPUT_FORMATS, False)):
        if name in columns:
            c = columns[name]
            errors.append(F.when(F.when(empty(c), F.lit(required)).otherwise(~F.lower(c).isin(*known)), name))
    outside = lambda c, low, high: (F.lit(False) if low is None else c < low) | (F.lit(False) if high is None else c > high)
    for name, (hard, soft) in SETTINGS.items():
        if name in columns:
            wrong = outside(columns[name], *hard)
            errors.append(F.when(wrong, name))
            warnings.append(F.when(outside(columns[name], *soft) & (F.lit(True) if name == "confidence" else ~wrong), name))
    none = F.array().cast("array<string>")
    listed = lambda found: F.array_compact(F.array(*found)) if found else none
    return F.struct(listed(errors).alias("errors"), listed(warnings).alias("warnings"))


def as_of(text: str) -> datetime:
    return datetime.fromisoformat(text)
