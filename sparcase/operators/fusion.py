"""Fusing several observations of a case, field by field, with confidences and a next action."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from ..functions.normalize import normalize_name, sanitize
from ..functions.sequence import name_likeness
from ..functions.similarity import ratio
from ..functions.validate import blank

#: Sources, decisions and actions by number; base reliabilities, weights and thresholds.
XML, PDF, DOCX = 1, 2, 3
ALL_NULL, ALL_AGREE, FUZZY, VOTING, CONFLICT = 1, 2, 3, 4, 5
AUTO, RECOMMENDED, MANUAL = 1, 2, 3
BASE = {XML: 0.60, PDF: 0.85, DOCX: 0.70}
OTHER_BASE, CONFIDENCE_WEIGHT, QUALITY_WEIGHT, EXTRACTION_WEIGHT, NORMAL = 0.50, 0.50, 0.30, 0.20, 0.75
FUZZY_THRESHOLD, AUTO_THRESHOLD, MANUAL_THRESHOLD = 0.85, 0.85, 0.70
REQUIRED = ("NumeroExpediente", "NumeroOficio", "AreaDescripcion")
TEXT_FIELDS = ("AutoridadNombre", "NombreSolicitante", "Nombre", "Paterno", "Materno")
SOURCE_PRIORITY = ("XML", "DOCX", "PDF")
ALIASES = (("PEREZ", "PERES"), ("GONZALEZ", "GONZALES"), ("CRISTIAN", "CHRISTIAN"), ("CRISTINA", "CHRISTINA"))
NAME_ACCEPT, NAME_CONFLICT = 0.95, 0.80


def reliability(source: Column, confidence: Column, quality: Column, matches: Column, total: Column, violations: Column) -> Column:
    """0 to 1: a source's base, corrected by how its extraction went. Scan figures don't count for XML."""
    base = F.lit(OTHER_BASE)
    for k, v in BASE.items():
        base = F.when(source == k, v).otherwise(base)
    scanned = source != XML
    ocr = F.when(scanned & confidence.isNotNull(), (confidence - NORMAL) * CONFIDENCE_WEIGHT).otherwise(0.0)
    image = F.when(scanned & quality.isNotNull(), (quality - NORMAL) * QUALITY_WEIGHT).otherwise(0.0)
    extraction = F.when(total > 0, (matches - violations) / total * EXTRACTION_WEIGHT).otherwise(0.0)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), base + ocr + image + extraction))


Fields = tuple[tuple[int, str, bool], ...]


def _rated(observations: DataFrame, fields: Fields, strict: bool) -> tuple[DataFrame, list[Column]]:
    rate = reliability(*(F.col(c) for c in ("source", "mean_confidence", "quality_index", "regex_matches", "total_fields", "violations")))
    value = lambda name, clean: sanitize(F.col(name)) if clean else (F.col(name) if strict else F.trim(F.col(name)))
    return observations.withColumn("reliability", rate), [value(n, clean).cast("string") for _, n, clean in fields]


def candidates(observations: DataFrame, fields: Fields, strict: bool = True) -> DataFrame:
    """One row per case, field and source: case_id, place, field, source, value, reliability.

    fields: place in the order of fusion, name, whether the value is sanitised. strict compares other values as they
    are; else they are trimmed first."""
    rated, values = _rated(observations, fields, strict)
    cells = F.array(*(F.struct(F.lit(p).alias("place"), F.lit(n).alias("field"), v.alias("value")) for (p, n, _), v in zip(fields, values)))
    return rated.select("case_id", "source", "reliability", F.explode(cells).alias("f")).select("case_id", "f.place", "f.field", "source", "f.value", "reliability")


def fuse_observations(observations: DataFrame, fields: Fields, strict: bool = True, fuzzy: bool = True, digits: int | None = None) -> DataFrame:
    """As fuse_fields of the candidates. A case's observations, one a source, are brought together before they are dealt
    by field, so there is one shuffle, of the observations, and what follows by case needs none. digits rounds the
    reliabilities."""
    rated, values = _rated(observations, fields, strict)
    rate = F.col("reliability") if digits is None else F.round("reliability", digits)
    cases = rated.groupBy("case_id").agg(F.collect_list(F.struct("source", rate.alias("reliability"), F.array(*values).alias("cells"))).alias("o"))
    named = F.array(*(F.struct(F.lit(p).alias("place"), F.lit(n).alias("field"), F.lit(i).alias("i")) for i, (p, n, _) in enumerate(fields)))
    dealt = cases.select("case_id", "o", F.explode(named).alias("f"))
    cells = F.transform("o", lambda x: F.struct(x["source"].alias("source"), F.get(x["cells"], F.col("f.i")).alias("value"), x["reliability"].alias("reliability")))
    return _decided(dealt.select("case_id", "f.place", "f.field", F.array_sort(F.filter(cells, lambda x: ~blank(x["value"]))).alias("v")), fuzzy)


def fuse_fields(cands: DataFrame, fuzzy: bool = True) -> DataFrame:
    """case_id, place, field, value, confidence, decision, source, similarity, n_conflicts, review, suggest.

    One value: agreed, with the best source's reliability. Similar texts (names of authorities and applicants): the most
    reliable one, its confidence reduced. Else the most reliable value wins, outvoting or in conflict with the others."""
    item = F.when(~blank(F.col("value")), F.struct("source", "value", "reliability"))
    return _decided(cands.groupBy("case_id", "place", "field").agg(F.array_sort(F.collect_list(item)).alias("v")), fuzzy)


def _decided(groups: DataFrame, fuzzy: bool) -> DataFrame:
    """Decisions on groups (case_id, place, field, v), v being the values that aren't blank, by source."""
    v, w, k = F.col("v"), F.col("w"), F.col("k")
    best = F.array_max(F.transform(v, lambda x: x["reliability"]))
    rows = groups.withColumn("best", best).withColumn("k", F.size(F.array_distinct(F.transform(v, lambda x: F.lower(x["value"])))))
    rows = rows.withColumn("w", F.get(F.filter(v, lambda x: x["reliability"] == F.col("best")), F.lit(0)))
    losers = F.when(k > 1, F.size(F.filter(v, lambda x: F.lower(x["value"]) != F.lower(w["value"])))).otherwise(0)
    pairs = F.array(*(F.when(F.size(v) > j, ratio(F.get(v, F.lit(i))["value"], F.get(v, F.lit(j))["value"]) / 100.0) for i, j in ((0, 1), (0, 2), (1, 2))))
    similar = F.get(F.filter(pairs, lambda s: s >= FUZZY_THRESHOLD), F.lit(0))
    close = F.when(F.lit(fuzzy) & F.col("field").isin(*TEXT_FIELDS) & (k > 1), similar)
    rows = rows.withColumn("losers", losers).withColumn("close", close)
    decision = F.when(k == 0, ALL_NULL).when(k == 1, ALL_AGREE).when(F.col("close").isNotNull(), FUZZY).when(F.col("losers") >= F.size(v) - 1, CONFLICT).otherwise(VOTING)
    rows = rows.withColumn("decision", decision)
    d = F.col("decision")
    return rows.select(
        "case_id",
        "place",
        "field",
        F.when(k == 1, F.get(v, F.lit(0))["value"]).otherwise(w["value"]).alias("value"),
        F.coalesce(F.col("best") * F.coalesce("close", F.lit(1.0)), F.lit(0.0)).alias("confidence"),
        d.alias("decision"),
        F.when(k > 1, w["source"]).alias("source"),
        F.col("close").alias("similarity"),
        F.when(d.isin(CONFLICT, VOTING), F.col("losers")).otherwise(0).alias("n_conflicts"),
        (d == CONFLICT).alias("review"),
        d.isin(FUZZY, VOTING, CONFLICT).alias("suggest"),
    )


def fuse_cases(fused: DataFrame) -> DataFrame:
    """case_id, overall, required, optional, n_conflicts, conflicts, missing, next_action.

    An optional field whose value has counted already, in a required or an earlier field, doesn't count again."""
    required = F.col("field").isin(*REQUIRED)
    some = F.col("decision") != ALL_NULL
    order = F.expr("row_number() over (partition by case_id, lower(value) order by case when required then 0 else 1 end, place)")
    seen = fused.withColumn("required", required).withColumn("n", order).withColumn("counts", some & (required | (F.col("n") == 1)))
    split = F.col("decision").isin(CONFLICT, VOTING)
    agg = seen.groupBy("case_id").agg(
        F.coalesce(F.avg(F.when(F.col("counts") & F.col("required"), F.col("confidence"))), F.lit(0.0)).alias("required_confidence"),
        F.coalesce(F.avg(F.when(F.col("counts") & ~F.col("required"), F.col("confidence"))), F.lit(0.0)).alias("optional_confidence"),
        F.count_if(split).alias("n_conflicts"),
        F.max("review").alias("review"),
        F.array_sort(F.collect_set(F.when(split, F.col("field")))).alias("conflicts"),
        F.array_sort(F.collect_set(F.when(F.col("required") & ~some, F.col("field")))).alias("missing"),
    )
    overall = F.col("required_confidence") * 0.70 + F.col("optional_confidence") * 0.30
    action = F.when((overall < MANUAL_THRESHOLD) | (F.col("n_conflicts") > 0) | F.col("review"), MANUAL).when(overall >= AUTO_THRESHOLD, AUTO).otherwise(RECOMMENDED)
    return agg.select("case_id", overall.alias("overall"), "required_confidence", "optional_confidence", "n_conflicts", "conflicts", "missing", action.alias("next_action"))


def fused_view(fused: DataFrame) -> DataFrame:
    """Fields with their agreement: 1 where all agree, the similarity where texts are alike, else the confidence."""
    agreement = F.when(F.col("decision") == ALL_AGREE, 1.0).when(F.col("decision") == FUZZY, F.col("similarity")).when(F.col("decision") == ALL_NULL, 0.0).otherwise(F.col("confidence"))
    return fused.withColumn("agreement", agreement)


def best_values(values: DataFrame, keys: tuple[str, ...] = ("case_id",), priority: tuple[str, ...] = SOURCE_PRIORITY) -> DataFrame:
    """keys, value, source, confidence, agreement, conflict: the value most sources give.

    Values are equal if their trimmed upper-case forms are. Of groups of equal size the one that comes first by source
    priority and confidence wins, then of equal means the greatest value; its confidence is its mean confidence times its
    share. The order in which doubles are added up changes the last bits of their mean, so a group's are always added from the
    highest to the lowest: the result doesn't depend on the order of rows, and is one that some order of rows gives."""
    rank = F.coalesce(F.nullif(F.array_position(F.array(*(F.lit(p) for p in priority)), F.col("source")), F.lit(0)), F.lit(1 << 30))
    some = values.where(~blank(F.col("value"))).withColumn("norm", F.upper(F.trim("value")))
    # of a group, the first by priority and confidence; a confidence is compared descending, so it is negated
    lead = F.struct(rank.alias("rank"), (-F.col("confidence")).alias("c"), F.col("place"), F.col("value"), F.col("source"))
    # running, so that no group is held in memory; the mean of its last row is that of all
    down = Window.partitionBy(*keys, "norm").orderBy(F.desc("confidence")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    some = some.withColumn("mean", F.avg("confidence").over(down)).withColumn("nth", F.count("*").over(down))
    groups = some.groupBy(*keys, "norm").agg(F.count("*").alias("n"), F.max_by("mean", "nth").alias("mean"), F.min(lead).alias("lead"))
    best = F.max(F.struct("n", (-F.col("lead.rank")).alias("r"), (-F.col("lead.c")).alias("c"), (-F.col("lead.place")).alias("p"), F.col("mean"), F.col("lead.value").alias("value"), F.col("lead.source").alias("source")))
    out = groups.groupBy(*keys).agg(best.alias("b"), F.sum("n").alias("total"), F.count("*").alias("groups"))
    share = F.col("b.n") / F.col("total")
    single = F.col("total") == 1
    return out.select(*keys, F.col("b.value").alias("value"), F.col("b.source").alias("source"), F.when(single, F.col("b.mean")).otherwise(share * F.col("b.mean")).alias("confidence"), share.alias("agreement"), (F.col("groups") > 1).alias("conflict"))


def agreement(values: DataFrame, keys: tuple[str, ...] = ("case_id",), threshold: float = 0.5) -> DataFrame:
    """keys, agreement (the share of the most frequent value) and whether it is at most the threshold."""
    some = values.where(~blank(F.col("value"))).groupBy(*keys, F.upper(F.trim("value")).alias("norm")).agg(F.count("*").alias("n"))
    out = some.groupBy(*keys).agg((F.max("n") / F.sum("n")).alias("agreement"), F.sum("n").alias("total"))
    return out.select(*keys, "agreement", ((F.col("total") > 1) & (F.col("agreement") <= threshold)).alias("conflict"))


@pandas_udf(StructType([StructField("place", IntegerType()), StructField("agreement", DoubleType())]))
def central_name(names: pd.Series) -> pd.DataFrame:
    """Of an array of names the index of the one most like all others, the first of equals, and the score of the least alike
    pair. Each pair is compared once; a name is like itself."""
    known: dict[tuple[str, str], float] = {}

    def score(a: str, b: str) -> float:
        if (a, b) not in known:
            if len(known) > 100_000:
                known.clear()
            known[a, b] = known[b, a] = name_likeness(a, b)
        return known[a, b]

    out = []
    for some in names:
        n, least, affinity = len(some), 1.0, [1.0] * len(some)
        for i in range(n):
            for j in range(i):
                s = score(some[i], some[j])
                least = min(least, s)
                affinity[i], affinity[j] = affinity[i] + s, affinity[j] + s
        out.append((max(range(n), key=lambda i: (affinity[i], -i)), least))
    return pd.DataFrame(out, columns=["place", "agreement"])


def best_names(values: DataFrame, keys: tuple[str, ...] = ("case_id",)) -> DataFrame:
    """keys, value, agreement (of the least alike pair), conflict, review: the name that is most like all others."""
    alias = F.upper(F.trim("value"))
    for a, b in ALIASES:
        alias = F.regexp_replace(alias, rf"\b{b}\b", a)
    some = values.where(~blank(F.col("value"))).withColumn("shown", F.col("value")).withColumn("value", normalize_name(alias))
    names = some.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("place", "value", "shown"))).alias("names"))
    out = names.withColumn("best", central_name(F.transform("names", lambda x: x["value"])))
    return out.select(*keys, F.get("names", F.col("best.place"))["shown"].alias("value"), F.col("best.agreement").alias("agreement"), (F.col("best.agreement") < NAME_CONFLICT).alias("conflict"), (F.col("best.agreement") < NAME_ACCEPT).alias("review"))


def match_fields(values: DataFrame) -> DataFrame:
    """case_id, field, value, agreement, conflict: names by likeness, all other fields by number."""
    name = F.upper("field").contains("NOMBRE")
    keys = ("case_id", "field")
    plain = best_values(values.where(~name), keys).select(*keys, "value", "agreement", "conflict")
    return plain.unionByName(best_names(values.where(name), keys).select(*keys, "value", "agreement", "conflict"))


def merge_maps(first: Column, second: Column) -> Column:
    """struct(merged, conflicts): the first map's values, blanks and new keys filled from the second."""
    tidy = lambda c: F.coalesce(F.trim(c), F.lit(""))
    merged = F.map_zip_with(first, second, lambda k, a, b: F.when(tidy(a) != "", a).when(tidy(b) != "", b).otherwise(F.coalesce(a, b)))
    clash = F.filter(F.map_keys(merged), lambda k: (tidy(F.try_element_at(first, k)) != "") & (tidy(F.try_element_at(second, k)) != "") & (F.lower(tidy(F.try_element_at(first, k))) != F.lower(tidy(F.try_element_at(second, k)))))
    return F.struct(merged.alias("merged"), F.array_sort(clash).alias("conflicts"))


def reconcile_tracks(rows: DataFrame) -> DataFrame:
    """case_id, field, value, origin, flag of rows (case_id, field, track, value), track being rules or model.

    Rules decide. Where they found nothing, models fill in if they all agree, else the field is flagged; a model that
    differs from the rules is flagged too."""
    some = rows.where(~blank(F.col("value"))).groupBy("case_id", "field").agg(
        F.min(F.when(F.col("track") == "rules", F.col("value"))).alias("rules"),
        F.min(F.when(F.col("track") == "model", F.col("value"))).alias("model"),
        F.count_distinct(F.when(F.col("track") == "model", F.col("value"))).alias("kinds"),
    )
    fill = F.col("rules").isNull() & (F.col("kinds") == 1)
    flag = F.when(F.col("rules").isNull() & (F.col("kinds") > 1), "models_disagree").when(F.col("rules").isNotNull() & (F.col("kinds") > 0) & ((F.col("kinds") > 1) | (F.col("model") != F.col("rules"))), "differs_from_rules")
    return some.select("case_id", "field", F.coalesce("rules", F.when(fill, F.col("model"))).alias("value"), F.when(F.col("rules").isNotNull(), "rules").when(fill, "model").alias("origin"), flag.alias("flag"))


def merge_first(rows: DataFrame) -> DataFrame:
    """case_id, field, value, conflict of rows (case_id, field, place, value): the first value that isn't blank."""
    some = rows.where(~blank(F.col("value")))
    return some.groupBy("case_id", "field").agg(F.min_by("value", F.struct("place", "value")).alias("value"), (F.count_distinct("value") > 1).alias("conflict"))


def choose_strategy(rows: DataFrame, mode: str) -> DataFrame:
    """case_id, field, value of rows (case_id, field, strategy, confidence, value).

    best: all fields from the most confident strategy of the case; merge: each field from the most confident one that
    has it; complement: the best strategy's fields, blanks filled by the others."""
    if mode == "best":
        top = rows.where("confidence > 0").groupBy("case_id").agg(F.max_by("strategy", F.struct("confidence", "strategy")).alias("strategy"))
        return rows.join(top, ["case_id", "strategy"]).where(~blank(F.col("value"))).select("case_id", "field", "value")
    some = rows.where(~blank(F.col("value")) & (F.col("confidence") > 0))
    return some.groupBy("case_id", "field").agg(F.max_by("value", F.struct("confidence", "strategy", "value")).alias("value"))
