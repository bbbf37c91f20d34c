"""Image quality models on numbers of the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import imaging as M
from .registry import query, table

#: Weights of a quadratic model in four features, as a rule: small and alternating.
WEIGHTS = [((-1) ** i) * (i + 1) / 20 for i in range(15)]
_F = "f AS (SELECT p_partkey, p_retailprice * 2 AS blur, (p_size % 60)::double AS noise, (p_partkey % 100)::double / 100 AS contrast, (p_partkey % 37)::double / 37 AS edge FROM part)"
_LEVEL = "CASE WHEN blur >= 1000 AND noise <= 10 AND contrast >= 0.6 THEN 5 WHEN blur < 100 OR noise > 50 THEN 1 WHEN blur < 200 OR noise > 25 THEN 2 WHEN blur < 500 OR noise > 10 THEN 3 ELSE 4 END"


def _features(spark, d):
    k = F.col("p_partkey")
    return table(spark, d, "part").select(k, (F.col("p_retailprice") * 2).alias("blur"), (F.col("p_size") % 60).cast("double").alias("noise"), (k % 100 / 100.0).alias("contrast"), (k % 37 / 37.0).alias("edge"))


@query(
    f"""WITH {_F}, l AS (SELECT *, {_LEVEL} AS level FROM f) SELECT p_partkey, level, CASE WHEN blur < 200 THEN 1 WHEN blur < 500 THEN 2 WHEN blur < 1500 THEN 3 WHEN blur < 3000 THEN 4 ELSE 5 END AS blur_level,
      CASE level WHEN 1 THEN CASE WHEN noise > 50 THEN 'opencv' ELSE 'pil' END WHEN 2 THEN CASE WHEN blur < 150 THEN 'opencv' ELSE 'pil' END WHEN 3 THEN CASE WHEN contrast < 0.4 THEN 'pil' ELSE 'none' END ELSE 'none' END AS filter FROM l"""
)
def img01_02_levels(spark, d):
    b, n, c = F.col("blur"), F.col("noise"), F.col("contrast")
    level = M.quality_level(b, n, c)
    return _features(spark, d).select("p_partkey", level.alias("level"), M.blur_level(b).alias("blur_level"), M.filter_choice(level, b, n, c).alias("filter"))


def _sql_terms(x):
    return ["1.0", *x, *(f"{x[i]} * {x[j]}" for i in range(len(x)) for j in range(i, len(x)))]


_Z = ["((blur - 2500) / 400)", "((noise - 25) / 15)", "((contrast - 0.5) / 0.3)", "((edge - 0.5) / 0.3)"]


@query(f"WITH {_F} SELECT p_partkey, round(greatest(0.5, least(2.5, 1.0 + {' + '.join(f'{t} * ({w}::double)' for t, w in zip(_sql_terms(_Z), WEIGHTS))})), 6)::double AS contrast FROM f")
def img04_quadratic(spark, d):
    x = M.scale([F.col(c) for c in ("blur", "noise", "contrast", "edge")], (2500, 25, 0.5, 0.5), (400, 15, 0.3, 0.3))
    return _features(spark, d).select("p_partkey", F.round(M.predict(M.quadratic_terms(x), WEIGHTS, 0.5, 2.5, 1.0), 6).alias("contrast"))


@query(f"WITH {_F} SELECT p_partkey, round(greatest(-50, least(50, 0.1 + 0.2 * contrast - 0.3 * edge + 0.4 * contrast * contrast - 0.5 * edge * edge + 0.6 * contrast * edge - 0.7 * contrast * contrast * contrast + 0.8 * edge * edge * edge)), 6)::double AS cubic, 1.5::double AS untrained FROM f")
def img05_polynomial(spark, d):
    terms = M.basis([F.col("contrast"), F.col("edge")], 3)
    return _features(spark, d).select("p_partkey", F.round(M.predict(terms, [0.1, 0.2, -0.3, 0.4, -0.5, 0.6, -0.7, 0.8], -50, 50), 6).alias("cubic"), M.predict(terms, [], 1, 2).alias("untrained"))


@query(f"WITH {_F} SELECT p_partkey, round(greatest(0, least(1, blur / 5000)), 6)::double AS blur, round(greatest(0, least(1, (contrast * 127.5 - 10) / 60)), 6)::double AS contrast FROM f")
def img06_normalise(spark, d):
    return _features(spark, d).select("p_partkey", F.round(M.unit_range(F.col("blur"), 0, 5000), 6).alias("blur"), F.round(M.unit_range(F.col("contrast"), 10, 70, 127.5), 6).alias("contrast"))


@query(f"WITH {_F} SELECT p_partkey, CASE WHEN edge > 0.7 THEN 5 ELSE 3 END AS median, round(CASE WHEN contrast < 0.3 THEN least((1 + edge) * 1.2, 2.5) ELSE 1 + edge END, 6)::double AS factor FROM f")
def img07_refine(spark, d):
    r = M.refine(F.lit("pil"), F.col("edge"), F.col("contrast"), 1 + F.col("edge"))
    return _features(spark, d).select("p_partkey", r["median"].alias("median"), F.round(r["contrast"], 6).alias("factor"))


@query(f"WITH {_F}, e AS (SELECT p_partkey, 800 + 100 * ((blur - {M.EDIT_MEAN[0]}) / {M.EDIT_SCALE[0]}) + 300 * ((noise - {M.EDIT_MEAN[1]}) / {M.EDIT_SCALE[1]}) AS edits FROM f) SELECT p_partkey, CASE WHEN edits < 200 THEN 'NO_FILTER' WHEN edits < 1000 THEN 'OPENCV' ELSE 'PIL' END AS choice FROM e")
def img09_edits(spark, d):
    z = M.scale([F.col("blur"), F.col("noise")], M.EDIT_MEAN, M.EDIT_SCALE)
    return _features(spark, d).select("p_partkey", M.recommend(M.dot(z, (100, 300)) + 800).alias("choice"))


@query("SELECT p.p_partkey FROM part p WHERE NOT EXISTS (SELECT 1 FROM part q WHERE (q.p_retailprice < p.p_retailprice AND q.p_size <= p.p_size) OR (q.p_retailprice <= p.p_retailprice AND q.p_size < p.p_size))")
def img10_pareto(spark, d):
    return M.pareto_front(table(spark, d, "part"), "p_retailprice", "p_size").select("p_partkey")


@query()
def img10_training(spark, d):
    """A ridge polynomial fitted and applied, and clusters of the features."""
    rows = _features(spark, d).withColumn("label", F.col("contrast") * 2 + F.col("edge"))
    model = M.train_polynomial(rows, ["blur", "noise", "contrast", "edge"], "label", 2, 0.01)
    return M.cluster(model.transform(rows).select("p_partkey", "contrast", "edge", F.round("prediction", 4).alias("fitted")), ["contrast", "edge"], 3)
