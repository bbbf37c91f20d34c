"""Identity, joins, statistics and the query surface."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.validate import blank
from ..operators import identity as D
from ..operators import manifest as M
from ..operators import query as Q
from ..operators import statistics as S
from ..operators import templates as T
from . import inputs as I
from .registry import query, table

_CLEAN = "trim(regexp_replace(rfc, '[-. ]', '', 'g'))"
_CANON = f"CASE WHEN length({_CLEAN}) = 13 AND regexp_matches(substr({_CLEAN}, 4, 1), '\\p{{L}}') THEN substr({_CLEAN}, 1, 3) || substr({_CLEAN}, 5) ELSE {_CLEAN} END"
_PERSONS = """persons AS (SELECT c_custkey AS place, CASE WHEN c_custkey % 5 = 0 THEN '' ELSE (['ABC-850101-X1', 'ABCD850101X1', 'ABC 850101 X1', 'abc850101x1'])[c_custkey % 4 + 1] || (c_custkey % 7) END AS rfc, 'Name ' || (c_custkey % 11) AS name FROM customer)"""


def _persons(spark, d):
    k = F.col("c_custkey")
    rfc = F.when(k % 5 == 0, "").otherwise(F.concat(I._pick(("ABC-850101-X1", "ABCD850101X1", "ABC 850101 X1", "abc850101x1"), k % 4), (k % 7).cast("string")))
    return table(spark, d, "customer").select(k.alias("place"), rfc.alias("rfc"), F.concat(F.lit("Name "), (k % 11).cast("string")).alias("name"))


@query(
    f"""WITH {_PERSONS}, c AS (SELECT *, {_CLEAN} AS bare, {_CANON} AS short FROM persons)
    SELECT place, short AS canonical, array_to_string(list_sort(list_distinct(list_filter([nullif(trim(rfc), ''), nullif(bare, ''), CASE WHEN length(short) = 12 THEN substr(short, 1, 3) || '-' || substr(short, 4, 6) || '-' || substr(short, 10, 3) END,
      CASE WHEN length(short) = 12 THEN substr(short, 1, 3) || ' ' || substr(short, 4, 6) || ' ' || substr(short, 10, 3) END], lambda x: x IS NOT NULL))), ',') AS variants FROM c"""
)
def idn01_02_rfc(spark, d):
    return _persons(spark, d).select("place", D.canonical_rfc(F.col("rfc")).alias("canonical"), F.array_join(F.array_sort(D.rfc_variants(F.col("rfc"))), ",").alias("variants"))


@query(f"WITH {_PERSONS}, k AS (SELECT *, CASE WHEN trim(rfc) <> '' THEN 'R:' || upper({_CANON}) ELSE 'N:' || upper(name) END AS k FROM persons) SELECT place, rfc, name FROM k QUALIFY row_number() OVER (PARTITION BY k ORDER BY place) = 1")
def idn03_persons(spark, d):
    return D.distinct_persons(_persons(spark, d)).select("place", "rfc", "name")


@query(f"WITH {_PERSONS}, w AS (SELECT DISTINCT 'ABC850101X1' || (n_nationkey % 9) AS rfc FROM nation), k AS (SELECT upper({_CANON}) AS short, min(place) AS person_id FROM persons WHERE rfc <> '' GROUP BY 1) SELECT w.rfc AS asked, coalesce(person_id::varchar, 'new-' || left(md5(upper(w.rfc)), 12)) AS person_id, person_id IS NULL AS created FROM w LEFT JOIN k ON k.short = w.rfc")
def idn04_05_find_or_create(spark, d):
    wanted = table(spark, d, "nation").select(F.concat(F.lit("ABC850101X1"), (F.col("n_nationkey") % 9).cast("string")).alias("rfc")).distinct()
    return D.find_or_create(_persons(spark, d).withColumnRenamed("place", "person_id"), wanted)


@query("WITH f AS (SELECT doc_id, sha256(text) AS digest, source AS url FROM documents), j AS (SELECT digest, url, min('store/' || doc_id) AS stored FROM f WHERE doc_id % 3 = 0 GROUP BY 1, 2) SELECT doc_id, stored, stored IS NOT NULL AS duplicate FROM f LEFT JOIN j USING (digest, url) WHERE doc_id % 3 <> 0")
def idn06_07_ingest(spark, d):
    f = table(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("digest"), F.col("source").alias("url"))
    journal = f.where("doc_id % 3 = 0").select("digest", "url", F.concat(F.lit("store/"), F.col("doc_id").cast("string")).alias("stored"))
    return D.mark_duplicates(f.where("doc_id % 3 <> 0"), journal).select("doc_id", "stored", "duplicate")


_FILES = "files AS (SELECT l_orderkey AS case_id, min(l_linenumber) AS place, 'f' || l_linenumber || '.' || l_returnflag AS name, CASE l_returnflag WHEN 'A' THEN 'PDF' WHEN 'N' THEN 'xml' ELSE 'docx' END AS format FROM lineitem GROUP BY 1, 3, 4)"


def _files(spark, d):
    flag = F.col("l_returnflag")
    rows = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("case_id"), F.col("l_linenumber").alias("place"), F.concat(F.lit("f"), F.col("l_linenumber").cast("string"), F.lit("."), flag).alias("name"), F.when(flag == "A", "PDF").when(flag == "N", "xml").otherwise("docx").alias("format"))
    return rows.groupBy("case_id", "name", "format").agg(F.min("place").alias("place"))


@query(f"WITH {_FILES} SELECT case_id, name, format FROM files QUALIFY row_number() OVER (PARTITION BY case_id ORDER BY (lower(format) <> 'pdf')::int, place, name) = 1")
def idn08_primary_file(spark, d):
    return D.primary_file(_files(spark, d))


@query("SELECT o_orderkey AS case_id, left(md5(o_orderkey::varchar), 8) || '-' || substr(md5(o_orderkey::varchar), 9, 4) || '-' || substr(md5(o_orderkey::varchar), 13, 4) || '-' || substr(md5(o_orderkey::varchar), 17, 4) || '-' || substr(md5(o_orderkey::varchar), 21) AS guid FROM orders")
def idn09_guid(spark, d):
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("case_id"), D.case_guid(F.col("o_orderkey").cast("string")).alias("guid"))


def _catalogue(spark, d):
    k = F.col("p_partkey")
    name = F.concat(I._pick(("Juzgado Quinto ", "JUZGADO QUINTO ", "Juzgado Qinto ", "Tribunal "), k % 4), (k % 13).cast("string"))
    return table(spark, d, "part").select(k.alias("place"), (k % 3).cast("string").alias("type"), name.alias("name"), F.when(k % 5 == 0, F.col("p_brand")).alias("region"))


@query()
def idn10_11_catalogue(spark, d):
    """Catalogue names clustered within their type, with the spelling that survives. The tests pin it."""
    return D.survivors(D.cluster_names(_catalogue(spark, d), 90))


@query(
    """WITH e AS (SELECT o_orderkey AS id, 'Case-' || o_orderkey AS case_id, ['A', 'N'] AS formats FROM orders WHERE o_orderkey % 5 <> 0), a AS (SELECT l_orderkey AS id, list_sort(list_distinct(list(l_returnflag))) AS formats FROM lineitem WHERE l_orderkey % 7 <> 0 GROUP BY 1),
      b AS (SELECT e.id AS eid, a.id AS aid, coalesce(e.case_id, 'CASE-' || a.id) AS case_id, list_sort(list_filter(coalesce(e.formats, []), lambda x: NOT list_contains(coalesce(a.formats, []), x))) AS missing, list_sort(list_filter(coalesce(a.formats, []), lambda x: NOT list_contains(coalesce(e.formats, []), x))) AS extra FROM e FULL JOIN a ON e.id = a.id)
    SELECT case_id, CASE WHEN eid IS NULL THEN 'Extra' WHEN aid IS NULL THEN 'Missing' WHEN len(missing) = 0 THEN 'Complete' ELSE 'Partial' END AS state, array_to_string(missing, ',') AS missing, array_to_string(extra, ',') AS extra FROM b"""
)
def jon01_manifest(spark, d):
    k = F.col("o_orderkey")
    e = table(spark, d, "orders").where(k % 5 != 0).select(F.concat(F.lit("Case-"), k.cast("string")).alias("case_id"), F.array(F.lit("A"), F.lit("N")).alias("formats"))
    a = table(spark, d, "lineitem").where("l_orderkey % 7 <> 0").groupBy("l_orderkey").agg(F.collect_set("l_returnflag").alias("formats")).select(F.concat(F.lit("CASE-"), F.col("l_orderkey").cast("string")).alias("case_id"), "formats")
    return M.reconcile(e, a).select("case_id", "state", F.array_join("missing", ",").alias("missing"), F.array_join("extra", ",").alias("extra"))


@query("SELECT r_regionkey, r_name, string_agg(n_name, ',' ORDER BY n_name) AS nations FROM region LEFT JOIN nation ON n_regionkey = r_regionkey GROUP BY 1, 2")
def jon02_include(spark, d):
    n = table(spark, d, "nation").groupBy(F.col("n_regionkey").alias("r_regionkey")).agg(F.array_join(F.array_sort(F.collect_list("n_name")), ",").alias("nations"))
    return Q.Specification(include=[(n, "r_regionkey")]).apply(table(spark, d, "region")).select("r_regionkey", "r_name", "nations")


@query("SELECT c_custkey, CASE WHEN c_acctbal > 5000 THEN 'active' WHEN c_mktsegment = 'BUILDING' THEN 'at_risk' ELSE 'breached' END AS origin FROM customer WHERE c_acctbal > 5000 OR c_mktsegment = 'BUILDING' OR c_acctbal < 0")
def jon05_09_union(spark, d):
    c = table(spark, d, "customer")
    part = lambda cond, name: c.where(cond).select("c_custkey", F.lit(name).alias("origin"))
    return M.union_by_priority("c_custkey", part("c_acctbal > 5000", "active"), part("c_mktsegment = 'BUILDING'", "at_risk"), part("c_acctbal < 0", "breached"))


@query("WITH a AS (SELECT DISTINCT lower(n_name) AS n_name FROM nation WHERE n_nationkey % 2 = 0), b AS (SELECT DISTINCT lower(n_name) AS n_name FROM nation WHERE n_nationkey % 3 = 0) SELECT n_name, 'left' AS side FROM a WHERE n_name NOT IN (SELECT n_name FROM b) UNION ALL SELECT n_name, 'right' FROM b WHERE n_name NOT IN (SELECT n_name FROM a)")
def jon06_except(spark, d):
    n = table(spark, d, "nation")
    return M.differences(n.where("n_nationkey % 2 = 0"), n.where("n_nationkey % 3 = 0").select(F.upper("n_name").alias("n_name")), "n_name")


@query(
    """WITH l AS (SELECT DISTINCT left(n_name, 6) AS field FROM nation), r AS (SELECT n_nationkey::bigint AS place, n_name AS name FROM nation),
      s AS (SELECT field, place, name, CASE WHEN lower(field) = lower(name) THEN 1.0 WHEN contains(lower(name), lower(field)) OR contains(lower(field), lower(name)) THEN greatest(least(length(field), length(name))::double / greatest(length(field), length(name)), 0.7) ELSE round(1 - levenshtein(lower(field), lower(name))::double / greatest(length(field), length(name)), 2) END AS score FROM l, r)
    SELECT field, name, score::double AS score FROM s WHERE score >= 0.7 QUALIFY row_number() OVER (PARTITION BY field ORDER BY score DESC, place) = 1"""
)
def jon07_best_match(spark, d):
    n = table(spark, d, "nation")
    right = n.select(F.col("n_nationkey").cast("long").alias("place"), F.col("n_name").alias("name"))
    out = M.renamed_fields(n.select(F.left("n_name", F.lit(6)).alias("field")).distinct(), right)
    return out.select("field", F.col("best.name").alias("name"), F.col("score").cast("double").alias("score"))


@query(f"WITH {I.OBSERVATIONS}, f AS (SELECT case_id, list(Folio ORDER BY source) AS fs FROM observations GROUP BY 1) SELECT case_id, unnest(fs) AS folio FROM f")
def jon08_flatten(spark, d):
    f = I.observations(spark, d).groupBy("case_id").agg(F.collect_list("Folio").alias("fs"))
    return f.select("case_id", F.explode("fs").alias("folio"))


@query("SELECT o_orderkey, c_name, n_name FROM orders LEFT JOIN customer ON c_custkey = o_custkey LEFT JOIN nation ON n_nationkey = c_nationkey")
def jon10_11_lookup(spark, d):
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_name", "c_nationkey")
    n = table(spark, d, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    return table(spark, d, "orders").join(c, "o_custkey", "left").join(n, "c_nationkey", "left").select("o_orderkey", "c_name", "n_name")


def _events(spark, d):
    e = table(spark, d, "events")
    return e.select("event_id", F.col("ts").cast("timestamp").alias("ts"), (F.col("event_type") != "error").alias("success"), F.col("value").alias("seconds"), F.when(F.col("event_type") == "error", F.concat(F.lit("code "), (F.col("user_id") % 9).cast("string"))).alias("message"), F.col("event_type"))


_TS = "timestamp '2024-01-20 00:00:00'"


@query("SELECT event_type AS format, count(*) AS files, sum(length(props))::bigint AS bytes FROM events WHERE ts BETWEEN timestamp '2024-01-05' AND timestamp '2024-01-15' GROUP BY ROLLUP (event_type)")
def agg01_downloads(spark, d):
    f = table(spark, d, "events").select(F.col("event_type").alias("format"), F.col("ts").cast("timestamp").alias("ts"), F.length("props").cast("long").alias("bytes"))
    return S.download_statistics(f, F.lit("2024-01-05").cast("timestamp"), F.lit("2024-01-15").cast("timestamp"))


def _sessions(spark, d):
    k = F.col("p_partkey")
    return table(spark, d, "part").select(k.alias("session_id"), (k % 2 == 0).alias("reviewed"), (k % 3 == 0).alias("training"), F.when(k % 4 != 0, (k % 5 + 1).cast("int")).alias("rating"), (F.col("p_size") / 10.0).alias("improvement"), F.col("p_brand").alias("model"), F.when(k % 7 == 0, "").otherwise(F.col("p_name")).alias("truth"), F.col("p_type").alias("filter"))


_SESS = "sess AS (SELECT p_partkey AS session_id, p_partkey % 2 = 0 AS reviewed, p_partkey % 3 = 0 AS training, CASE WHEN p_partkey % 4 <> 0 THEN (p_partkey % 5 + 1)::int END AS rating, p_size / 10.0::double AS improvement, p_brand AS model, CASE WHEN p_partkey % 7 = 0 THEN '' ELSE p_name END AS truth, p_type AS filter FROM part)"


@query(f"WITH {_SESS} SELECT count(*) AS sessions, count(*) FILTER (reviewed) AS reviewed, count(*) FILTER (training) AS training, coalesce(avg(rating), 0) AS mean_rating, coalesce(avg(improvement), 0) AS mean_improvement FROM sess")
def agg02_sessions(spark, d):
    return S.session_statistics(_sessions(spark, d))


@query(f"WITH {_SESS} SELECT 'model' AS name, model AS value, count(*) AS n FROM sess GROUP BY 2 UNION ALL SELECT 'rating', rating::varchar, count(*) FROM sess GROUP BY 2 UNION ALL SELECT 'filter', filter, count(*) FROM sess GROUP BY 2")
def agg02_histograms(spark, d):
    return S.histograms(_sessions(spark, d), "model", "rating", "filter")


@query("SELECT count(*) AS total, count(*) FILTER (event_type <> 'error') AS succeeded, count(*) FILTER (event_type = 'error') AS failed, avg(value) AS mean_seconds FROM events")
def agg03_13_processing(spark, d):
    return S.processing(_events(spark, d))


@query("WITH l AS (SELECT * FROM events ORDER BY ts DESC, event_id DESC LIMIT 100) SELECT count(*) AS total, count(*) FILTER (event_type <> 'error') AS succeeded, count(*) FILTER (event_type = 'error') AS failed, avg(value) AS mean_seconds FROM l")
def agg04_last_hundred(spark, d):
    return S.processing(S.latest(_events(spark, d), 100))


_THR = f"t AS (SELECT count(*) AS total, count(*) FILTER (event_type <> 'error') AS succeeded, count(*) FILTER (event_type = 'error') AS failed, coalesce(avg(value), 0) AS mean_seconds, count(*) / 24.0::double AS per_hour, CASE WHEN count(*) > 0 THEN count(*) FILTER (event_type <> 'error')::double / count(*) ELSE 0 END AS success_rate FROM events WHERE ts > {_TS} - interval 24 hours AND ts <= {_TS})"


def _throughput(spark, d):
    return S.throughput(_events(spark, d), F.lit("2024-01-20 00:00:00").cast("timestamp"), 24)


@query(f"WITH {_THR} SELECT * FROM t")
def agg05_str10_throughput(spark, d):
    return _throughput(spark, d)


@query(f"WITH {_THR} SELECT concat_ws(',', CASE WHEN per_hour < 100 THEN 'throughput' END, CASE WHEN mean_seconds > 30 THEN 'latency' END, CASE WHEN 4 < 5 THEN 'concurrency' END, CASE WHEN success_rate < 0.99 THEN 'success' END) AS reasons FROM t")
def agg06_requirements(spark, d):
    return S.shortfalls(_throughput(spark, d), F.lit(4)).select(F.array_join("reasons", ",").alias("reasons"))


@query("SELECT ts::date AS day, count(*) AS total, count(*) FILTER (event_type <> 'error') AS succeeded, avg(value) AS mean_seconds FROM events GROUP BY 1")
def agg07_daily(spark, d):
    return S.daily(_events(spark, d))


@query("SELECT 'code ' || (user_id % 9) AS message, count(*) AS n FROM events WHERE event_type = 'error' GROUP BY 1 ORDER BY n DESC, message LIMIT 5")
def agg08_top_errors(spark, d):
    return S.top_errors(_events(spark, d))


@query("SELECT strftime(ts, '%H:00') AS hour, count(*) AS total, avg(value) AS mean_seconds FROM events GROUP BY 1")
def agg09_hourly(spark, d):
    return S.hourly(_events(spark, d))


@query("SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M') AS ts FROM (SELECT * FROM events WHERE event_type = 'error' ORDER BY ts DESC, event_id DESC LIMIT 5)")
def agg10_lim02_recent_errors(spark, d):
    return S.latest(_events(spark, d).where("not success"), 5).select("event_id", F.date_format("ts", "yyyy-MM-dd HH:mm").alias("ts"))


@query("SELECT count(DISTINCT user_id) AS correlations FROM events")
def agg11_distinct(spark, d):
    return table(spark, d, "events").agg(F.count_distinct("user_id").alias("correlations"))


@query("SELECT p_brand AS model, count(*) AS runs, avg(p_retailprice) AS mean_score, min(p_retailprice) AS min_score, max(p_retailprice) AS max_score, stddev_samp(p_retailprice) AS sd_score, avg(p_size::double) AS mean_seconds, min(p_size::double) AS min_seconds, max(p_size::double) AS max_seconds, stddev_samp(p_size::double) AS sd_seconds FROM part GROUP BY 1")
def agg14_models(spark, d):
    runs = table(spark, d, "part").select(F.col("p_brand").alias("model"), F.col("p_retailprice").alias("score"), F.col("p_size").cast("double").alias("seconds"))
    return S.model_summary(runs)


@query("WITH s AS (SELECT CASE WHEN o_orderdate + to_days((o_orderkey % 20)::int) <= timestamp '1995-06-15' THEN 3 WHEN o_orderkey % 3 = 0 THEN 2 ELSE 0 END AS level FROM orders) SELECT count(*) FILTER (level = 0) AS none, count(*) FILTER (level = 1) AS warning, count(*) FILTER (level = 2) AS critical, count(*) FILTER (level = 3) AS breached, count(*) FILTER (level <> 3) AS active FROM s")
def agg15_levels(spark, d):
    k = F.col("o_orderkey")
    due = F.date_add(F.to_date("o_orderdate"), (k % 20).cast("int"))
    level = F.when(due <= F.to_date(F.lit("1995-06-15")), 3).when(k % 3 == 0, 2).otherwise(0)
    return S.level_counts(table(spark, d, "orders").select(level.alias("level"), (level == 3).alias("breached")))


@query("SELECT l_orderkey AS page, coalesce(avg(CASE WHEN l_linenumber <> 4 THEN l_quantity END), 0) AS mean, coalesce(median(CASE WHEN l_linenumber <> 4 THEN l_quantity END), 0) AS median FROM lineitem GROUP BY 1")
def agg16_word_confidence(spark, d):
    words = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("page"), F.when(F.col("l_linenumber") == 4, -1.0).otherwise(F.col("l_quantity")).alias("confidence"))
    return S.word_confidence(words, "page")


@query("SELECT event_id, row_number() OVER (ORDER BY ts DESC, event_id) AS rank FROM events WHERE user_id % 50 = 3 ORDER BY ts DESC, event_id LIMIT 20")
def srt01_audit_order(spark, d):
    rows = Q.Specification(where=[F.col("user_id") % 50 == 3], order=[F.col("ts").desc(), F.col("event_id")], take=20).apply(table(spark, d, "events"))
    return rows.select("event_id", F.expr("row_number() over (order by ts desc, event_id)").cast("long").alias("rank"))


@query(f"WITH {I.VALUES} SELECT case_id, place, source, confidence FROM vals QUALIFY row_number() OVER (PARTITION BY case_id ORDER BY CASE source WHEN 'XML' THEN 1 WHEN 'DOCX' THEN 2 ELSE 3 END, confidence DESC, place, value) = 1")
def srt02_priority(spark, d):
    rank = F.when(F.col("source") == "XML", 1).when(F.col("source") == "DOCX", 2).otherwise(3)
    best = F.min(F.struct(rank.alias("r"), (-F.col("confidence")).alias("c"), F.col("place"), F.col("value"), F.col("source"))).alias("b")
    return I.values(spark, d).groupBy("case_id").agg(best).select("case_id", "b.place", "b.source", (-F.col("b.c")).alias("confidence"))


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F' ORDER BY o_totalprice DESC, o_orderkey LIMIT 25 OFFSET 50")
def lim01_qry01_page(spark, d):
    spec = Q.Specification(where=Q.only(o_orderstatus="F", o_orderpriority=None), order=[F.col("o_totalprice").desc(), F.col("o_orderkey")], skip=50, take=25)
    return Q.Repository(table(spark, d, "orders"), "o_orderkey").list(spec).select("o_orderkey", "o_totalprice")


_TEMPL = "templ AS (SELECT p_partkey AS id, p_brand AS type, (p_partkey % 12) || '.' || (p_partkey % 3) || '.0' AS version, date '2024-01-01' + (p_partkey % 400)::int AS effective, CASE WHEN p_partkey % 3 = 0 THEN date '2024-01-01' + (p_partkey % 400 + 90)::int END AS expires, p_partkey % 4 <> 0 AS active FROM part)"


def _templates(spark, d):
    k = F.col("p_partkey")
    start = F.date_add(F.to_date(F.lit("2024-01-01")), (k % 400).cast("int"))
    return table(spark, d, "part").select(k.alias("id"), F.col("p_brand").alias("type"), F.concat((k % 12).cast("string"), F.lit("."), (k % 3).cast("string"), F.lit(".0")).alias("version"), start.alias("effective"), F.when(k % 3 == 0, F.date_add(start, 90)).alias("expires"), (k % 4 != 0).alias("active"))


@query(f"WITH {_TEMPL} SELECT type, version, effective FROM templ WHERE active AND effective <= date '2024-10-01' AND (expires IS NULL OR expires > date '2024-10-01') QUALIFY row_number() OVER (PARTITION BY type ORDER BY effective DESC, version DESC) = 1")
def lim03_effective(spark, d):
    return Q.effective(_templates(spark, d), F.to_date(F.lit("2024-10-01"))).select("type", "version", "effective")


@query(f"WITH {_TEMPL} SELECT type, max(version) AS by_text, arg_max(version, list_transform(string_split(version, '.'), lambda x: x::int)) AS by_number FROM templ GROUP BY 1")
def lim04_versions(spark, d):
    return _templates(spark, d).groupBy("type").agg(F.max("version").alias("by_text"), F.max_by("version", Q.version_key(F.col("version"))).alias("by_number"))


@query(f"WITH {_SESS} SELECT session_id, rating FROM sess WHERE reviewed AND training AND rating >= 3 AND length(truth) > 0")
def lim05_snk07_training(spark, d):
    from ..sinks.exports import training_data

    return training_data(_sessions(spark, d), 3).select("session_id", "rating")


@query("SELECT l_orderkey AS case_id, arg_max(l_linenumber, struct_pack(q := l_quantity, l := -l_linenumber)) AS best FROM lineitem GROUP BY 1")
def lim06_first_best(spark, d):
    """The first of the greatest."""
    return table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("case_id")).agg(F.max_by("l_linenumber", F.struct("l_quantity", (-F.col("l_linenumber")).alias("p"))).alias("best"))


@query("SELECT event_id, event_type FROM events WHERE ts >= timestamp '2024-01-10' AND ts <= timestamp '2024-01-12' AND event_type = 'view'")
def qry02_05_filters(spark, d):
    spec = Q.Specification(where=[*Q.between("ts", Q_TIME("2024-01-10"), Q_TIME("2024-01-12")), *Q.only(event_type="view", user_id=None)])
    return spec.apply(table(spark, d, "events")).select("event_id", "event_type")


def Q_TIME(day):
    from datetime import datetime

    return datetime.fromisoformat(day)


@query("SELECT n_nationkey, CASE WHEN n_nationkey % 5 = 0 THEN upper(n_name) || '!' ELSE n_name END AS n_name FROM nation WHERE n_nationkey % 7 <> 3 UNION ALL SELECT 100, 'NEW'")
def qry03_04_repository(spark, d):
    n = table(spark, d, "nation").select("n_nationkey", "n_name")
    repo = Q.Repository(n, "n_nationkey").update(n.where("n_nationkey % 5 = 0").withColumn("n_name", F.concat(F.upper("n_name"), F.lit("!"))))
    new = spark.range(1).select(F.lit(100).alias("n_nationkey"), F.lit("NEW").alias("n_name"))
    return repo.remove(n.where("n_nationkey % 7 = 3")).add(new).rows


@query("SELECT o_orderkey FROM orders WHERE o_orderstatus = 'O' AND o_totalprice >= 100000 AND o_orderpriority = '1-URGENT' ORDER BY o_orderdate DESC, o_orderkey LIMIT 50")
def qry06_07_queue(spark, d):
    spec = Q.Specification(where=[*Q.only(o_orderstatus="O", o_orderpriority="1-URGENT"), F.col("o_totalprice") >= 100000], order=[F.col("o_orderdate").desc(), F.col("o_orderkey")], take=50)
    return spec.apply(table(spark, d, "orders")).select("o_orderkey")


@query("SELECT o_orderkey AS file_id, o_orderstatus AS status, o_custkey AS customer FROM orders")
def qry08_json_store(spark, d):
    """Records as one JSON text each, read back."""
    packed = table(spark, d, "orders").select(F.col("o_orderkey").alias("file_id"), F.to_json(F.struct(F.col("o_orderstatus").alias("status"), F.col("o_custkey").alias("customer"))).alias("json"))
    return packed.withColumn("r", F.from_json("json", "status string, customer long")).select("file_id", "r.status", "r.customer")


MAPPINGS = [T.Mapping("o_orderkey", "id", 1, required=True, transform="PadLeft(8,0)"), T.Mapping("o_orderstat", "status", 2, required=True), T.Mapping("o_custkey", "customer", 3), T.Mapping("o_weight", "weight", 4)]


@query("SELECT 'missing' AS change, 'o_weight' AS field, 'Medium' AS severity UNION ALL SELECT 'renamed', 'o_orderstat', 'Medium' UNION ALL SELECT 'new', unnest(['o_totalprice', 'o_orderdate', 'o_orderpriority']), 'Medium'")
def qry09_10_drift(spark, d):
    found = T.drift(table(spark, d, "orders"), MAPPINGS)
    rows = [("new", f) for f in found["new"]] + [("missing", f) for f in found["missing"]] + [("renamed", f) for f in found["renamed"]]
    return spark.createDataFrame([(c, f, found["severity"]) for c, f in rows], "change string, field string, severity string")


@query(
    """SELECT o_orderkey, lpad(o_orderkey::varchar, greatest(8, length(o_orderkey::varchar))::int, '0') AS id, strftime(o_orderdate, '%d/%m/%Y') AS day, lower(replace(substr(o_orderpriority, 3), 'I', 'y')) AS priority, coalesce(nullif(CASE WHEN o_orderstatus = 'P' THEN '' ELSE o_orderstatus END, ''), 'none') AS status,
      concat_ws(',', CASE WHEN length(o_orderpriority) > 8 THEN 'priority:MaxLength' END, CASE WHEN NOT regexp_matches(o_orderkey::varchar, '^[0-9]{1,3}$') THEN 'id:Regex' END) AS problems FROM orders"""
)
def qry11_12_val16_templates(spark, d):
    m = [
        T.Mapping("o_orderkey", "id", 1, transform="PadLeft(8,0)"),
        T.Mapping("o_orderdate", "day", 2, format="dd/MM/yyyy"),
        T.Mapping("o_orderpriority", "priority", 3, transform="Substring(2, 50) | Replace(I, y) | ToLower()"),
        T.Mapping("status", "status", 4, default="none"),
    ]
    rows = table(spark, d, "orders").withColumn("status", F.when(F.col("o_orderstatus") == "P", "").otherwise(F.col("o_orderstatus")))
    tests = [T.Mapping("o_orderpriority", "priority", 1, rules=["MaxLength:8"]), T.Mapping("o_orderkey", "id", 2, required=True, rules=["Regex:^[0-9]{1,3}$"])]
    wrong = T.problems(rows, tests, "o_orderkey").select("o_orderkey", F.array_join("problems", ",").alias("problems"))
    return T.project(rows, m, "o_orderkey").join(wrong, "o_orderkey")


@query(f"WITH {_TEMPL}, a AS (SELECT *, CASE WHEN type = 'Brand#11' THEN version = '1.1.0' ELSE active END AS now_active FROM templ) SELECT id, now_active AS active, NOT now_active AS deletable FROM a")
def qry13_activate(spark, d):
    rows = Q.activate(_templates(spark, d), "Brand#11", "1.1.0")
    free = Q.deletable(rows).select("id", F.lit(True).alias("deletable"))
    return rows.join(free, "id", "left").select("id", "active", F.coalesce("deletable", F.lit(False)).alias("deletable"))


@query("SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 2 ELSE 3 END AS status, CASE o_orderstatus WHEN 'F' THEN 'Final' WHEN 'O' THEN 'Open' ELSE 'Partial' END AS label FROM orders")
def qry14_lookup(spark, d):
    """Enumerations as dimensions of a few rows."""
    dim = spark.createDataFrame([("F", 1, "Final"), ("O", 2, "Open"), ("P", 3, "Partial")], "o_orderstatus string, status int, label string")
    return table(spark, d, "orders").join(F.broadcast(dim), "o_orderstatus").select("o_orderkey", "status", "label")
