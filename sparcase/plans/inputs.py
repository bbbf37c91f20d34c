"""Case data read out of the given tables, each as a DataFrame and as a SQL common table expression.

The tables hold no case files, so identifiers, notices and observations are derived from orders and customers by plain
rules, the same in both languages.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..workers import spread
from .registry import table

DIRECTIVES = (
    "Se ordena el BLOQUEO y embargo de fondos",
    "Se solicita el desbloqueo y liberar los recursos del oficio anterior",
    "Favor de expedir documentos: estado de cuenta y contrato de apertura",
    "Realizar la transferencia y giro de recursos",
    "Se requiere información y reportar movimientos ante el Juzgado Segundo",
    "Atender el asunto turnado sin mayor trámite",
    "Aseguramiento precautorio por operaciones con recursos de procedencia ilícita",
    "Recordatorio del oficio previo sobre el embargo hasta por el monto señalado",
    "Alcance al oficio: se amplía el requerimiento de documentación de la TARJETA",
    "Se aclara y corrige el desembargo de la cuenta",
    "Inmovilizar y congelar, retener y asegurar en dólares",
    "Reporte de operaciones inusuales del SAT para el tribunal",
)
MONTHS = ("enero", "febrero", "marzo", "abril", "mayo", "junio", "julio", "agosto", "septiembre", "octubre", "noviembre", "diciembre")


def _pick(values: tuple[str, ...], index: Column) -> Column:
    return F.element_at(F.array(*(F.lit(v) for v in values)), (index + 1).cast("int"))


def _sql_list(values: tuple[str, ...]) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


def identifiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """case_id, rfc, curp, clabe, account, amount and case numbers, some of them malformed, one row an order."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    day = F.date_format("o_orderdate", "yyMMdd")
    pad = lambda x, n: F.lpad(x.cast("string"), n, "0")
    letters = F.substring(F.lit("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), (k % 20 + 1).cast("int"), F.when(k % 3 == 0, 3).otherwise(4))
    return spread(table(spark, sf_dir, "orders")).select(
        k.alias("case_id"),
        F.when(k % 11 == 0, F.lit(None).cast("string")).when(k % 7 == 0, F.concat(F.lower(letters), day, F.lit("X1"), pad(k % 10, 1))).otherwise(F.concat(letters, day, F.lit("X1"), pad(k % 10, 1))).alias("rfc"),
        F.when(k % 5 == 0, "").otherwise(F.concat(F.lit("PEGJ"), day, F.when(k % 2 == 0, "H").otherwise("M"), F.lit("DFRRN0"), pad(k % 10, 1))).alias("curp"),
        F.when(k % 4 == 0, pad(k, 10)).otherwise(pad(k, 18)).alias("clabe"),
        F.concat(_pick(("CUENTA: ", "Cta. ", "", "NO DE CUENTA "), k % 4), pad(c, 10), F.when(k % 6 == 0, " / 01").otherwise("")).alias("account"),
        F.concat(_pick(("$", "", "MXN ", "-", "usd "), k % 5), F.format_number(F.floor("o_totalprice"), 0), _pick((".50", ".49", "", ".5 "), k % 4)).alias("amount"),
        F.concat(_pick(("A/AS1-", "a/AS-", "H/IN"), k % 3), pad(k % 10000, 4), F.lit("-"), pad(c, 6), F.lit("-AAA")).alias("case_number"),
        F.date_format("o_orderdate", "yyyyMMdd").alias("day"),
        _pick(("SWIFT: bcmrmxmm", "BIC CODE BNMX-MXMMX", "bnmx mxmmx", "", "ABC"), k % 5).alias("swift"),
        _pick(("MXN", "usd", "", "PESOS"), k % 4).alias("currency"),
        _pick(("Block", "Unblock", "Transfer", "Information"), k % 4).alias("action"),
    )


IDENTIFIERS = f"""identifiers AS (SELECT o_orderkey AS case_id,
  CASE WHEN o_orderkey % 11 = 0 THEN NULL WHEN o_orderkey % 7 = 0 THEN lower(substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ', o_orderkey % 20 + 1, CASE WHEN o_orderkey % 3 = 0 THEN 3 ELSE 4 END)) || strftime(o_orderdate, '%y%m%d') || 'X1' || (o_orderkey % 10)
       ELSE substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ', o_orderkey % 20 + 1, CASE WHEN o_orderkey % 3 = 0 THEN 3 ELSE 4 END) || strftime(o_orderdate, '%y%m%d') || 'X1' || (o_orderkey % 10) END AS rfc,
  CASE WHEN o_orderkey % 5 = 0 THEN '' ELSE 'PEGJ' || strftime(o_orderdate, '%y%m%d') || CASE WHEN o_orderkey % 2 = 0 THEN 'H' ELSE 'M' END || 'DFRRN0' || (o_orderkey % 10) END AS curp,
  CASE WHEN o_orderkey % 4 = 0 THEN lpad(o_orderkey::varchar, 10, '0') ELSE lpad(o_orderkey::varchar, 18, '0') END AS clabe,
  ['CUENTA: ', 'Cta. ', '', 'NO DE CUENTA '][o_orderkey % 4 + 1] || lpad(o_custkey::varchar, 10, '0') || CASE WHEN o_orderkey % 6 = 0 THEN ' / 01' ELSE '' END AS account,
  ['$', '', 'MXN ', '-', 'usd '][o_orderkey % 5 + 1] || format('{{:,}}', floor(o_totalprice)::bigint) || ['.50', '.49', '', '.5 '][o_orderkey % 4 + 1] AS amount,
  ['A/AS1-', 'a/AS-', 'H/IN'][o_orderkey % 3 + 1] || lpad((o_orderkey % 10000)::varchar, 4, '0') || '-' || lpad(o_custkey::varchar, 6, '0') || '-AAA' AS case_number,
  strftime(o_orderdate, '%Y%m%d') AS day,
  ['SWIFT: bcmrmxmm', 'BIC CODE BNMX-MXMMX', 'bnmx mxmmx', '', 'ABC'][o_orderkey % 5 + 1] AS swift,
  ['MXN', 'usd', '', 'PESOS'][o_orderkey % 4 + 1] AS currency, ['Block', 'Unblock', 'Transfer', 'Information'][o_orderkey % 4 + 1] AS action
  FROM orders)"""


def notices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """case_id and text: a notice in Spanish with account, amount, identifiers, dates and references, one row an order."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    pad = lambda x, n: F.lpad(x.cast("string"), n, "0")
    later = F.date_add(F.to_date("o_orderdate"), (k % 90 + 1).cast("int"))
    text = F.concat(
        _pick(DIRECTIVES, k % len(DIRECTIVES)),
        F.when(k % 3 == 0, F.concat(F.lit(" de la cuenta "), pad(c, 10))).otherwise(""),
        F.when(k % 4 != 1, F.concat(F.lit(" por un monto de $"), F.format_number(F.floor("o_totalprice"), 0), F.lit(".50 pesos"))).otherwise(""),
        F.lit(". RFC ABCD"), F.date_format("o_orderdate", "yyMMdd"), F.lit("X1"), pad(k % 10, 1),
        F.lit(". Del "), F.date_format("o_orderdate", "yyyy-MM-dd"),
        F.when(k % 5 != 0, F.concat(F.lit(" al "), F.dayofmonth(later).cast("string"), F.lit(" de "), _pick(MONTHS, F.month(later) - 1), F.lit(" de "), F.year(later).cast("string"))).otherwise(""),
        F.when(k % 7 == 0, F.concat(F.lit(". CLABE "), pad(k, 18))).otherwise(""),
        F.lit(". Oficio AGAFADAFSON/2025/"), pad(k % 1000000, 6),
        F.lit(". Expediente A/AS1-"), pad(k % 10000, 4), F.lit("-"), pad(c % 1000000, 6), F.lit("-AAA"),
        F.lit(". Acuerdo "), (k % 900 + 1).cast("string"), F.lit("/2021 y Ley "), (k % 90 + 1).cast("string"), F.lit("/2019"),
        F.lit(". Plazo de "), (k % 20 + 1).cast("string"), F.lit(" días. Correo: caso"), k.cast("string"), F.lit("@Ejemplo.gob.mx Tel. 55 1234-"), pad(k % 10000, 4), F.lit(" C.P. 0"), pad(k % 10000, 4),
    )
    return spread(table(spark, sf_dir, "orders")).select(k.alias("case_id"), text.alias("text"))


NOTICES = f"""notices AS (SELECT o_orderkey AS case_id, {_sql_list(DIRECTIVES)}[o_orderkey % {len(DIRECTIVES)} + 1]
  || CASE WHEN o_orderkey % 3 = 0 THEN ' de la cuenta ' || lpad(o_custkey::varchar, 10, '0') ELSE '' END
  || CASE WHEN o_orderkey % 4 <> 1 THEN ' por un monto de $' || format('{{:,}}', floor(o_totalprice)::bigint) || '.50 pesos' ELSE '' END
  || '. RFC ABCD' || strftime(o_orderdate, '%y%m%d') || 'X1' || (o_orderkey % 10) || '. Del ' || strftime(o_orderdate, '%Y-%m-%d')
  || CASE WHEN o_orderkey % 5 <> 0 THEN ' al ' || day(o_orderdate + to_days((o_orderkey % 90 + 1)::int)) || ' de ' || {_sql_list(MONTHS)}[month(o_orderdate + to_days((o_orderkey % 90 + 1)::int))] || ' de ' || year(o_orderdate + to_days((o_orderkey % 90 + 1)::int)) ELSE '' END
  || CASE WHEN o_orderkey % 7 = 0 THEN '. CLABE ' || lpad(o_orderkey::varchar, 18, '0') ELSE '' END
  || '. Oficio AGAFADAFSON/2025/' || lpad((o_orderkey % 1000000)::varchar, 6, '0') || '. Expediente A/AS1-' || lpad((o_orderkey % 10000)::varchar, 4, '0') || '-' || lpad((o_custkey % 1000000)::varchar, 6, '0') || '-AAA'
  || '. Acuerdo ' || (o_orderkey % 900 + 1) || '/2021 y Ley ' || (o_orderkey % 90 + 1) || '/2019' || '. Plazo de ' || (o_orderkey % 20 + 1) || ' días. Correo: caso' || o_orderkey || '@Ejemplo.gob.mx Tel. 55 1234-' || lpad((o_orderkey % 10000)::varchar, 4, '0') || ' C.P. 0' || lpad((o_orderkey % 10000)::varchar, 4, '0') AS text
  FROM orders)"""


#: Fields that observations carry: their place in the order of fusion, whether they are sanitised, whether required.
FIELDS = (
    (1, "NumeroExpediente", False),
    (2, "NumeroOficio", False),
    (3, "AreaDescripcion", False),
    (4, "AutoridadNombre", False),
    (5, "SolicitudSiara", True),
    (7, "FechaPublicacion", False),
    (20, "DiasPlazo", False),
    (22, "NombreSolicitante", True),
    (24, "Folio", False),
    (30, "Referencia", True),
)


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three observations of each case, sources 1 (XML), 2 (PDF) and 3 (DOCX), with the figures of their extraction."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    orders = spread(table(spark, sf_dir, "orders")).withColumn("source", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))))
    s = F.col("source")
    return orders.select(
        k.alias("case_id"),
        s,
        F.when((s == 2) & (k % 7 == 0), F.concat(F.lit("A/AS1-"), (k + 1).cast("string"))).when((s == 3) & (k % 29 == 0), None).otherwise(F.concat(F.lit("A/AS1-"), k.cast("string"))).alias("NumeroExpediente"),
        F.when((s == 3) & (k % 11 == 0), F.concat(F.lit("OF/"), (k + 3).cast("string"))).otherwise(F.concat(F.lit("OF/"), k.cast("string"))).alias("NumeroOficio"),
        F.when((s == 1) & (k % 13 == 0), "").otherwise(_pick(("ASEGURAMIENTO", "HACENDARIO", "JUDICIAL"), c % 3)).alias("AreaDescripcion"),
        F.when((s == 2) & (k % 17 == 0), "ZZZ").otherwise(_pick(("SAT", "JUZGADO QUINTO", "CNBV", "UIF"), c % 4)).alias("AutoridadNombre"),
        F.when(s == 1, F.concat(F.lit(" AGAFADAFSON/"), k.cast("string"), F.lit("&nbsp;"))).when(k % 5 == 0, "NO APLICA").otherwise(F.concat(F.lit("AGAFADAFSON/"), k.cast("string"))).alias("SolicitudSiara"),
        F.date_format(F.date_add(F.to_date("o_orderdate"), F.when((s == 3) & (k % 19 == 0), 1).otherwise(0)), "yyyyMMdd").alias("FechaPublicacion"),
        (k % 20 + F.when((s != 1) & (k % 23 == 0), 1).otherwise(0)).cast("string").alias("DiasPlazo"),
        F.when(s == 3, F.lit(None).cast("string")).when(k % 2 == 0, F.col("o_orderpriority")).otherwise("____").alias("NombreSolicitante"),
        (k + F.when(k % 31 == 0, s).otherwise(0)).cast("string").alias("Folio"),
        F.concat(F.lit("OF/"), k.cast("string")).alias("Referencia"),
        (0.5 + (k + s) % 50 / 100.0).alias("mean_confidence"),
        F.when(k % 9 == 0, None).otherwise(0.6 + (c + s) % 40 / 100.0).alias("quality_index"),
        ((k + s) % 10).cast("int").alias("regex_matches"),
        (F.lit(10) * (k % 37 != 0).cast("int")).alias("total_fields"),
        (c % 3).cast("int").alias("violations"),
    )


OBSERVATIONS = """observations AS (SELECT o_orderkey AS case_id, s AS source,
  CASE WHEN s = 2 AND o_orderkey % 7 = 0 THEN 'A/AS1-' || (o_orderkey + 1) WHEN s = 3 AND o_orderkey % 29 = 0 THEN NULL ELSE 'A/AS1-' || o_orderkey END AS NumeroExpediente,
  CASE WHEN s = 3 AND o_orderkey % 11 = 0 THEN 'OF/' || (o_orderkey + 3) ELSE 'OF/' || o_orderkey END AS NumeroOficio,
  CASE WHEN s = 1 AND o_orderkey % 13 = 0 THEN '' ELSE ['ASEGURAMIENTO', 'HACENDARIO', 'JUDICIAL'][o_custkey % 3 + 1] END AS AreaDescripcion,
  CASE WHEN s = 2 AND o_orderkey % 17 = 0 THEN 'ZZZ' ELSE ['SAT', 'JUZGADO QUINTO', 'CNBV', 'UIF'][o_custkey % 4 + 1] END AS AutoridadNombre,
  CASE WHEN s = 1 THEN ' AGAFADAFSON/' || o_orderkey || '&nbsp;' WHEN o_orderkey % 5 = 0 THEN 'NO APLICA' ELSE 'AGAFADAFSON/' || o_orderkey END AS SolicitudSiara,
  strftime(o_orderdate + CASE WHEN s = 3 AND o_orderkey % 19 = 0 THEN INTERVAL 1 DAY ELSE INTERVAL 0 DAY END, '%Y%m%d') AS FechaPublicacion,
  (o_orderkey % 20 + CASE WHEN s <> 1 AND o_orderkey % 23 = 0 THEN 1 ELSE 0 END)::varchar AS DiasPlazo,
  CASE WHEN s = 3 THEN NULL WHEN o_orderkey % 2 = 0 THEN o_orderpriority ELSE '____' END AS NombreSolicitante,
  (o_orderkey + CASE WHEN o_orderkey % 31 = 0 THEN s ELSE 0 END)::varchar AS Folio, 'OF/' || o_orderkey AS Referencia,
  0.5::double + ((o_orderkey + s) % 50)::double / 100 AS mean_confidence, CASE WHEN o_orderkey % 9 = 0 THEN NULL ELSE 0.6::double + ((o_custkey + s) % 40)::double / 100 END AS quality_index,
  (o_orderkey + s) % 10 AS regex_matches, CASE WHEN o_orderkey % 37 <> 0 THEN 10 ELSE 0 END AS total_fields, o_custkey % 3 AS violations
  FROM orders, (SELECT unnest([1, 2, 3]) AS s))"""


def values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values of one field of each case by source with their confidence: the lines of an order."""
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("case_id"),
        F.col("l_linenumber").alias("place"),
        F.when(F.col("l_returnflag") == "A", "XML").when(F.col("l_returnflag") == "N", "DOCX").otherwise("PDF").alias("source"),
        F.when(F.col("l_linenumber") == 5, " ").otherwise(F.concat(F.when(F.col("l_linenumber") % 2 == 0, " ").otherwise(""), F.col("l_linestatus"))).alias("value"),
        (1 - F.col("l_discount")).alias("confidence"),
    )


VALUES = """vals AS (SELECT l_orderkey AS case_id, l_linenumber AS place, CASE l_returnflag WHEN 'A' THEN 'XML' WHEN 'N' THEN 'DOCX' ELSE 'PDF' END AS source,
  CASE WHEN l_linenumber = 5 THEN ' ' ELSE CASE WHEN l_linenumber % 2 = 0 THEN ' ' ELSE '' END || l_linestatus END AS value, 1 - l_discount AS confidence FROM lineitem)"""
