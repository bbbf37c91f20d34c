"""Fusion of observations and matching of values."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import fusion as U
from . import inputs as I
from .registry import query, table
from .text import _sanitized

_REL = """r AS (SELECT *, greatest(0.0::double, least(1.0::double, CASE source WHEN 1 THEN 0.60::double WHEN 2 THEN 0.85::double WHEN 3 THEN 0.70::double ELSE 0.5::double END
   + CASE WHEN source <> 1 AND mean_confidence IS NOT NULL THEN (mean_confidence - 0.75) * 0.5 ELSE 0 END + CASE WHEN source <> 1 AND quality_index IS NOT NULL THEN (quality_index - 0.75) * 0.3 ELSE 0 END
   + CASE WHEN total_fields > 0 THEN (regex_matches - violations)::double / total_fields * 0.2 ELSE 0 END)) AS reliability FROM observations)"""
_CANDS = "c AS (" + " UNION ALL ".join(f"SELECT case_id, {p} AS place, '{n}' AS field, source, {_sanitized(n) if clean else n} AS value, round(reliability, 9) AS reliability FROM r" for p, n, clean in I.FIELDS) + ")"
_FUSED = """v AS (SELECT * FROM c WHERE value IS NOT NULL AND regexp_matches(value, '\\S')),
 g AS (SELECT case_id, place, field, count(*) AS n, count(DISTINCT lower(value)) AS k, count(DISTINCT value) < count(*) AND field IN ('AutoridadNombre', 'NombreSolicitante') AS alike, arg_min(value, source) AS first_value, max(reliability) AS best FROM v GROUP BY 1, 2, 3),
 w AS (SELECT case_id, place, value AS wv, source AS ws FROM v QUALIFY row_number() OVER (PARTITION BY case_id, place ORDER BY reliability DESC, source) = 1),
 l AS (SELECT v.case_id, v.place, count(*) FILTER (lower(v.value) <> lower(w.wv)) AS losers FROM v JOIN w USING (case_id, place) GROUP BY 1, 2),
 f AS (SELECT e.case_id, e.place, e.field, CASE WHEN k = 1 THEN first_value ELSE wv END AS value, coalesce(best, 0.0::double) AS confidence,
   CASE WHEN k IS NULL THEN 1 WHEN k = 1 THEN 2 WHEN alike THEN 3 WHEN losers >= n - 1 THEN 5 ELSE 4 END AS decision, CASE WHEN k > 1 THEN ws END AS source,
   CASE WHEN k > 1 AND NOT alike THEN losers ELSE 0 END AS n_conflicts FROM (SELECT DISTINCT case_id, place, field FROM c) e LEFT JOIN g USING (case_id, place) LEFT JOIN w USING (case_id, place) LEFT JOIN l USING (case_id, place))"""
_CASES = """s AS (SELECT *, field IN ('NumeroExpediente', 'NumeroOficio', 'AreaDescripcion') AS req, row_number() OVER (PARTITION BY case_id, lower(value) ORDER BY CASE WHEN field IN ('NumeroExpediente', 'NumeroOficio', 'AreaDescripcion') THEN 0 ELSE 1 END, place) AS n FROM f),
 t AS (SELECT case_id, coalesce(avg(confidence) FILTER (decision <> 1 AND req), 0) AS rc, coalesce(avg(confidence) FILTER (decision <> 1 AND NOT req AND n = 1), 0) AS oc,
   count(*) FILTER (decision IN (4, 5)) AS n_conflicts, coalesce(string_agg(field, ',' ORDER BY field) FILTER (decision IN (4, 5)), '') AS conflicts, coalesce(string_agg(field, ',' ORDER BY field) FILTER (req AND decision = 1), '') AS missing FROM s GROUP BY 1)"""
_BASE = f"WITH {I.OBSERVATIONS}, {_REL}, {_CANDS}, {_FUSED}"
FLAGSHIP_SQL = f"{_BASE}, {_CASES} SELECT case_id, round(rc * 0.7 + oc * 0.3, 6) AS overall, n_conflicts, conflicts, missing, CASE WHEN rc * 0.7 + oc * 0.3 < 0.7 OR n_conflicts > 0 THEN 3 WHEN rc * 0.7 + oc * 0.3 >= 0.85 THEN 1 ELSE 2 END AS next_action FROM t"


def _fused(spark, d):
    # differing values of these texts have a low ratio, so fuzzy agreement comes from equal ones alone and SQL can say it
    return U.fuse_observations(I.observations(spark, d), I.FIELDS, digits=9)


@query(f"WITH {I.OBSERVATIONS}, {_REL} SELECT case_id, source, round(reliability, 6) AS reliability FROM r")
def fus01_reliability(spark, d):
    o = I.observations(spark, d)
    r = U.reliability(*(F.col(c) for c in ("source", "mean_confidence", "quality_index", "regex_matches", "total_fields", "violations")))
    return o.select("case_id", "source", F.round(r, 6).alias("reliability"))


@query(f"WITH {I.OBSERVATIONS}, {_REL}, {_CANDS} SELECT case_id, place, field, source, value FROM c")
def fus02_candidates(spark, d):
    return U.candidates(I.observations(spark, d), I.FIELDS).select("case_id", "place", "field", "source", "value")


@query(f"{_BASE} SELECT case_id, field, value, round(confidence, 6) AS confidence, decision, source, n_conflicts, decision = 5 AS review FROM f")
def fus03_fields(spark, d):
    f = _fused(spark, d)
    return f.select("case_id", "field", "value", F.round("confidence", 6).alias("confidence"), "decision", "source", F.col("n_conflicts").cast("long").alias("n_conflicts"), "review")


@query()
def fus04_fuzzy(spark, d):
    """Applicants' names seen with a letter wrong in one source: fuzzy agreement. The tests pin its rules."""
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("case_id"), F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))).alias("source"), "c_name")
    rows = c.select("case_id", F.lit(22).alias("place"), F.lit("NombreSolicitante").alias("field"), "source", F.when(F.col("source") == 2, F.regexp_replace("c_name", "e", "a")).otherwise(F.col("c_name")).alias("value"), (F.col("source") / 4.0).alias("reliability"))
    return U.fuse_fields(rows).select("case_id", "value", "decision", F.round("similarity", 6).alias("similarity"), F.round("confidence", 6).alias("confidence"))


@query(FLAGSHIP_SQL)
def fus05_07_cases(spark, d):
    out = U.fuse_cases(_fused(spark, d))
    return out.select("case_id", F.round("overall", 6).alias("overall"), "n_conflicts", F.array_join("conflicts", ",").alias("conflicts"), F.array_join("missing", ",").alias("missing"), "next_action")


@query(f"{_BASE} SELECT case_id, string_agg(field, ',' ORDER BY field) AS alerts FROM f WHERE decision IN (4, 5) GROUP BY 1")
def fus09_alerts(spark, d):
    f = _fused(spark, d).where("decision in (4, 5)")
    return f.groupBy("case_id").agg(F.array_join(F.array_sort(F.collect_list("field")), ",").alias("alerts"))


@query(f"{_BASE} SELECT case_id, round(avg(CASE decision WHEN 2 THEN 1.0 WHEN 3 THEN 1.0 WHEN 1 THEN 0.0 ELSE confidence END), 6)::double AS agreement, count(*) FILTER (decision <> 1) AS n_fields FROM f GROUP BY 1")
def fus10_view(spark, d):
    v = U.fused_view(_fused(spark, d))
    return v.groupBy("case_id").agg(F.round(F.avg("agreement"), 6).alias("agreement"), F.count_if(F.col("decision") != 1).alias("n_fields"))


_POLICY = """p AS (SELECT *, upper(trim(value)) AS norm, CASE source WHEN 'XML' THEN 1 WHEN 'DOCX' THEN 2 ELSE 3 END AS rank FROM vals WHERE trim(value) <> ''),
 g AS (SELECT case_id, norm, count(*) AS n, avg(confidence) AS mean, arg_min(struct_pack(r := rank, c := -confidence, p := place, v := value, s := source), struct_pack(r := rank, c := -confidence, p := place, v := value, s := source)) AS l FROM p GROUP BY 1, 2),
 b AS (SELECT * FROM g QUALIFY row_number() OVER (PARTITION BY case_id ORDER BY n DESC, l.r, l.c, l.p, mean DESC, l.v DESC, l.s DESC) = 1), t AS (SELECT case_id, sum(n) AS total, count(*) AS k, max(n) AS m FROM g GROUP BY 1)"""


@query(f"WITH {I.VALUES}, {_POLICY} SELECT case_id, l.v AS value, l.s AS source, round(CASE WHEN total = 1 THEN mean ELSE n / total * mean END, 6)::double AS confidence, round(n / total, 6)::double AS agreement, k > 1 AS conflict FROM b JOIN t USING (case_id)")
def fus11_policy(spark, d):
    return U.best_values(I.values(spark, d)).withColumn("confidence", F.round("confidence", 6)).withColumn("agreement", F.round("agreement", 6))


@query(f"WITH {I.VALUES}, {_POLICY} SELECT case_id, round(m / total, 6)::double AS agreement, total > 1 AND m / total <= 0.5 AS conflict FROM t")
def fus12_agg12_agreement(spark, d):
    return U.agreement(I.values(spark, d)).withColumn("agreement", F.round("agreement", 6))


@query()
def fus13_names(spark, d):
    """The most central of three spellings of each customer's name."""
    c = table(spark, d, "customer")
    spell = F.array(F.col("c_name"), F.regexp_replace("c_name", "Customer", "Custumer"), F.col("c_name"))
    rows = c.select(F.col("c_custkey").alias("case_id"), F.posexplode(spell).alias("place", "value"))
    return U.best_names(rows).withColumn("agreement", F.round("agreement", 6))


@query(f"WITH {I.VALUES}, {_POLICY} SELECT case_id, 'Estado' AS field, l.v AS value, round(n / total, 6)::double AS agreement, k > 1 AS conflict FROM b JOIN t USING (case_id)")
def fus14_router(spark, d):
    """Fields sent to the policy for them. This field is no name."""
    return U.match_fields(I.values(spark, d).withColumn("field", F.lit("Estado"))).withColumn("agreement", F.round("agreement", 6))


@query("SELECT o_orderkey AS case_id, CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE (o_orderdate + to_days((1 + o_orderkey % 20)::int))::date END AS due FROM orders")
def fus15_due(spark, d):
    """The date in calendar days from what a case says of its term, if it does."""
    k = F.col("o_orderkey")
    return table(spark, d, "orders").select(k.alias("case_id"), F.when(k % 4 != 0, F.date_add(F.to_date("o_orderdate"), (1 + k % 20).cast("int"))).alias("due"))


@query(
    """SELECT o_orderkey AS case_id, o_orderstatus AS status, CASE WHEN o_orderkey % 3 = 0 THEN o_orderpriority ELSE 'known' END AS priority, 'new' AS extra, CASE WHEN o_orderkey % 5 = 0 THEN 'status' ELSE '' END AS conflicts FROM orders"""
)
def fus16_merge_maps(spark, d):
    k = F.col("o_orderkey")
    first = F.create_map(F.lit("status"), F.col("o_orderstatus"), F.lit("priority"), F.when(k % 3 == 0, " ").otherwise("known"))
    second = F.create_map(F.lit("status"), F.when(k % 5 == 0, "?").otherwise(F.lower("o_orderstatus")), F.lit("priority"), F.when(k % 3 == 0, F.col("o_orderpriority")).otherwise("KNOWN"), F.lit("extra"), F.lit("new"))
    m = U.merge_maps(first, second)
    return table(spark, d, "orders").select(k.alias("case_id"), m["merged"]["status"].alias("status"), m["merged"]["priority"].alias("priority"), m["merged"]["extra"].alias("extra"), F.array_join(m["conflicts"], ",").alias("conflicts"))


_TRACKS = "tr AS (SELECT l_orderkey AS case_id, 'Monto' AS field, CASE WHEN l_linenumber = 1 THEN 'rules' ELSE 'model' END AS track, CASE WHEN l_linenumber = 1 AND l_orderkey % 3 = 0 THEN '' ELSE l_returnflag END AS value FROM lineitem)"


@query(
    f"""WITH {_TRACKS}, g AS (SELECT case_id, field, min(value) FILTER (track = 'rules') AS r, min(value) FILTER (track = 'model') AS m, count(DISTINCT value) FILTER (track = 'model') AS k FROM tr WHERE trim(value) <> '' GROUP BY 1, 2)
    SELECT case_id, field, coalesce(r, CASE WHEN k = 1 THEN m END) AS value, CASE WHEN r IS NOT NULL THEN 'rules' WHEN k = 1 THEN 'model' END AS origin,
      CASE WHEN r IS NULL AND k > 1 THEN 'models_disagree' WHEN r IS NOT NULL AND k > 0 AND (k > 1 OR m <> r) THEN 'differs_from_rules' END AS flag FROM g"""
)
def fus17_20_tracks(spark, d):
    n, k = F.col("l_linenumber"), F.col("l_orderkey")
    rows = table(spark, d, "lineitem").select(k.alias("case_id"), F.lit("Monto").alias("field"), F.when(n == 1, "rules").otherwise("model").alias("track"), F.when((n == 1) & (k % 3 == 0), "").otherwise(F.col("l_returnflag")).alias("value"))
    return U.reconcile_tracks(rows)


@query(f"WITH {I.VALUES} SELECT case_id, 'f' AS field, arg_min(value, struct_pack(p := place, v := value)) AS value, count(DISTINCT value) > 1 AS conflict FROM vals WHERE trim(value) <> '' GROUP BY 1")
def fus18_merge(spark, d):
    return U.merge_first(I.values(spark, d).withColumn("field", F.lit("f")))


@query(
    """WITH s AS (SELECT l_orderkey AS case_id, 'f' || l_linenumber AS field, l_returnflag AS strategy, CASE l_returnflag WHEN 'A' THEN 90 WHEN 'N' THEN 75 ELSE 0 END AS confidence, l_linestatus AS value FROM lineitem),
      t AS (SELECT case_id, arg_max(strategy, struct_pack(c := confidence, s := strategy)) AS strategy FROM s WHERE confidence > 0 GROUP BY 1)
    SELECT case_id, field, value, 'best' AS mode FROM s JOIN t USING (case_id, strategy) UNION ALL SELECT case_id, field, arg_max(value, struct_pack(c := confidence, s := strategy, v := value)), 'merge' FROM s WHERE confidence > 0 GROUP BY 1, 2"""
)
def fus19_strategies(spark, d):
    flag = F.col("l_returnflag")
    rows = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("case_id"), F.concat(F.lit("f"), F.col("l_linenumber")).alias("field"), flag.alias("strategy"), F.when(flag == "A", 90).when(flag == "N", 75).otherwise(0).alias("confidence"), F.col("l_linestatus").alias("value"))
    return U.choose_strategy(rows, "best").withColumn("mode", F.lit("best")).unionByName(U.choose_strategy(rows, "merge").withColumn("mode", F.lit("merge")))
