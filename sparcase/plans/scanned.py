"""Scanned pages, bank statements, images, and files read from a folder."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import functions as F

from ..functions import statements as T
from ..functions.pixels import METRICS, pixel_metrics
from ..sources import cases as C
from ..workers import shared_folder, spread
from . import inputs as I
from .registry import query, table


def _pages(spark, d):
    """A page's text for each order, in four forms, one of them empty."""
    k = F.col("o_orderkey").cast("string")
    iso, slashes = F.date_format("o_orderdate", "yyyy-MM-dd"), F.date_format("o_orderdate", "dd/MM/yyyy")
    amount = F.col("o_totalprice").cast("decimal(18,2)").cast("string")
    forms = (
        F.concat(F.lit("Comisión CNBV\n  Fecha: "), iso, F.lit("\nExpediente: A/"), k, F.lit("\nOficio de solicitud\nmonto $ "), amount),
        F.concat(F.lit("banxico informa\n"), F.dayofmonth("o_orderdate").cast("string"), F.lit(" de enero de "), F.year("o_orderdate").cast("string"), F.lit("\nExp. B-"), k, F.lit("\nREQUERIMIENTO DE INFORMACIÓN\nPESOS "), amount),
        F.lit(""),
        F.concat(F.lit("HSBC y Banco Norte\nexpediente 77/"), k, F.lit("\n\nEXPEDIENTE: 88/"), k, F.lit("\n"), slashes),
    )
    return spread(table(spark, d, "orders")).select(F.col("o_orderkey").alias("case_id"), F.element_at(F.array(*forms), (F.col("o_orderkey") % 4 + 1).cast("int")).alias("text"))


@query(
    """WITH o AS (SELECT o_orderkey AS case_id, o_orderkey % 4 AS v, o_orderkey::varchar AS k, strftime(o_orderdate, '%Y-%m-%d') AS iso, strftime(o_orderdate, '%d/%m/%Y') AS slashes, day(o_orderdate)::varchar AS dd, year(o_orderdate)::varchar AS yy, o_totalprice::decimal(18,2)::double AS x FROM orders),
      f AS (SELECT 'linewise' AS engine, case_id, CASE v WHEN 0 THEN iso WHEN 1 THEN dd || ' de enero de ' || yy END AS date, CASE v WHEN 0 THEN 'CNBV' WHEN 1 THEN 'BANXICO' END AS authority, CASE v WHEN 0 THEN 'A/' || k WHEN 1 THEN 'B-' || k WHEN 3 THEN '77/' || k END AS number,
          CASE v WHEN 0 THEN 'SOLICITUD' WHEN 1 THEN 'REQUERIMIENTO DE INFORMACIÓN' END AS kind, CASE v WHEN 0 THEN x END AS amount, '' AS entities FROM o
        UNION ALL SELECT 'whole', case_id, CASE v WHEN 0 THEN iso WHEN 1 THEN dd || ' DE ENERO DE ' || yy WHEN 3 THEN slashes END, CASE v WHEN 0 THEN 'CNBV' WHEN 1 THEN 'BANXICO' END, CASE v WHEN 0 THEN 'A/' || k WHEN 1 THEN 'B-' || k WHEN 3 THEN '77/' || k END,
          CASE v WHEN 0 THEN 'SOLICITUD' WHEN 1 THEN 'REQUERIMIENTO' END, CASE WHEN v < 2 THEN x END, CASE v WHEN 3 THEN 'BANCO NORTE,HSBC' ELSE '' END FROM o
        UNION ALL SELECT 'batch', case_id, CASE v WHEN 0 THEN iso WHEN 1 THEN dd || ' DE ENERO DE ' || yy END, CASE v WHEN 0 THEN 'CNBV' WHEN 1 THEN 'BANXICO' END, CASE v WHEN 0 THEN 'A/' || k WHEN 1 THEN 'B-' || k WHEN 3 THEN '77/' || k END, CASE v WHEN 0 THEN 'OFICIO' WHEN 1 THEN 'REQUERIMIENTO' END, NULL, '' FROM o
        UNION ALL SELECT 'brief', case_id, CASE v WHEN 0 THEN iso WHEN 3 THEN slashes END, CASE v WHEN 0 THEN 'CNBV' WHEN 1 THEN 'BANXICO' END, CASE v WHEN 0 THEN 'A/' || k WHEN 3 THEN '88/' || k END, CASE v WHEN 0 THEN 'SOLICITUD' WHEN 1 THEN 'REQUERIMIENTO' END, NULL, '' FROM o)
    SELECT *, CASE WHEN amount IS NOT NULL THEN 'MXN' END AS currency FROM f"""
)
def ext36_38_scanned_fields(spark, d):
    """Fields of pages read by OCR engines, by the rules for each of three and of batches."""
    rows, out = _pages(spark, d), None
    for name, rules in (("linewise", T.LINEWISE), ("whole", T.WHOLE), ("batch", T.BATCH), ("brief", T.BRIEF)):
        f = T.scanned_fields(F.col("text"), rules)
        one = rows.select(F.lit(name).alias("engine"), "case_id", *(f[n].alias(n) for n in ("date", "authority", "number", "kind", "amount", "currency")), F.array_join(f["entities"], ",").alias("entities"))
        out = one if out is None else out.unionByName(one)
    return out


def _statements(spark, d):
    """A bank statement for each order: a heading, and a line for each of its items."""
    amount = (F.col("l_extendedprice") * F.when(F.col("l_orderkey") % 50 == 0, 100).otherwise(1)).cast("decimal(18,2)").cast("string")
    line = F.concat(F.date_format("l_shipdate", "yyyy-MM-dd"), F.lit(" pago "), F.col("l_linenumber").cast("string"), F.lit(" $ "), amount)
    lines = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("case_id")).agg(F.transform(F.array_sort(F.collect_list(F.struct(F.col("l_linenumber").alias("n"), line.alias("line")))), lambda x: x["line"]).alias("lines"))
    k = F.col("o_orderkey")
    head = F.concat(
        F.when(k % 6 < 4, F.concat(F.lit("Banco "), I._pick(("BBVA", "HSBC", "del Norte", "banorte"), F.least(k % 6, F.lit(3))), F.lit(".\n"))).otherwise("Caja rural.\n"),
        F.when(k % 4 != 0, "Titular: Juan Peña.\n").otherwise(""),
        F.when(k % 5 == 0, "Cuenta: 12345.\n").otherwise(F.concat(F.lit("Cuenta: "), F.lpad(F.col("o_custkey").cast("string"), 12, "7"), F.lit(".\n"))),
        F.when(k % 7 == 0, "BORRADOR.\n").otherwise(""),
        F.when(k % 3 == 0, "Saldo a la fecha.\n").otherwise(""),
    )
    return table(spark, d, "orders").select(k.alias("case_id"), head.alias("head")).join(lines, "case_id", "left").select("case_id", F.concat(F.col("head"), F.coalesce(F.array_join("lines", "\n"), F.lit(""))).alias("text"))


_STATEMENTS = """l AS (SELECT l_orderkey AS case_id, count(*) AS n, sum((l_extendedprice * CASE WHEN l_orderkey % 50 = 0 THEN 100 ELSE 1 END)::decimal(18,2)::double) AS credits, count(*) FILTER ((l_extendedprice * CASE WHEN l_orderkey % 50 = 0 THEN 100 ELSE 1 END)::decimal(18,2) > 1000000) AS odd,
    string_agg(strftime(l_shipdate, '%Y-%m-%d') || ' pago ' || l_linenumber || ' $ ' || (l_extendedprice * CASE WHEN l_orderkey % 50 = 0 THEN 100 ELSE 1 END)::decimal(18,2), chr(10) ORDER BY l_linenumber) AS body FROM lineitem GROUP BY 1),
  s AS (SELECT o_orderkey AS case_id, o_custkey, coalesce(n, 0)::int AS n, coalesce(credits, 0) AS credits, coalesce(odd, 0) AS odd, o_orderkey % 4 <> 0 AS holder, o_orderkey % 5 = 0 AS bad, ['BBVA', 'HSBC', NULL, 'BANORTE', NULL, NULL][o_orderkey % 6 + 1] AS bank, coalesce(body, '') AS body FROM orders LEFT JOIN l ON l.case_id = o_orderkey)"""


@query(
    f"""WITH {_STATEMENTS}, w AS (SELECT *, (n < 5)::int + bad::int + (odd > 0)::int AS warned FROM s),
      q AS (SELECT *, round((CASE WHEN holder THEN 4 ELSE 0 END + 4 + CASE WHEN bank IS NULL THEN 0 ELSE 2 END) / 10.0::double * 0.25 + least(n / 20.0::double, 1) * 0.35 + CASE WHEN case_id % 3 <> 0 THEN 1.0::double ELSE 0.7::double END * 0.2
        + (1.0::double - CASE WHEN odd > 0 THEN 0.3 ELSE 0 END - CASE WHEN bad THEN 0.3 ELSE 0 END - CASE WHEN warned > 2 THEN 0.2 ELSE 0 END) * 0.2, 9) AS quality FROM w)
    SELECT case_id, CASE WHEN holder THEN 'JUAN PEÑA' END AS holder, CASE WHEN bad THEN '12345' ELSE lpad(o_custkey::varchar, 12, '7') END AS account, bank, n, round(credits, 2) AS credits, 0.0::double AS debits, round(CASE WHEN n > 0 THEN credits / n ELSE 0 END, 6) AS mean, round(quality, 6) AS quality,
      CASE WHEN quality > 0.8 THEN 'high' WHEN quality > 0.6 THEN 'medium' ELSE 'low' END AS trust,
      concat_ws(',', CASE WHEN quality < 0.7 THEN 'QUALITY_BELOW_THRESHOLD' END, CASE WHEN n < 5 THEN 'LOW_TRANSACTION_COUNT' END, CASE WHEN NOT holder THEN 'MISSING_ACCOUNT_HOLDER' END, CASE WHEN n < 5 THEN 'FINANCIAL_LOW_TRANSACTION_COUNT:_' || n END,
        CASE WHEN bad THEN 'FINANCIAL_INVALID_ACCOUNT_NUMBER_FORMAT' END, CASE WHEN odd > 0 THEN 'FINANCIAL_SUSPICIOUS_AMOUNTS_DETECTED:_' || odd END) AS flags FROM q"""
)
def ext33_statements(spark, d):
    """Account, transactions, totals and quality of bank statements."""
    rows = _statements(spark, d).select("case_id", T.account_info(F.col("text")).alias("info"), T.transactions(F.col("text")).alias("rows"))
    c = T.statement_checks(F.col("info"), F.col("rows"), F.col("case_id") % 3 != 0)
    return rows.select("case_id", "info.holder", "info.account", "info.bank", c["n"].alias("n"), F.round(c["credits"], 2).alias("credits"), F.round(c["debits"], 2).alias("debits"), F.round(c["mean"], 6).alias("mean"), F.round(c["quality"], 6).alias("quality"), c["trust"].alias("trust"), F.array_join(c["flags"], ",").alias("flags"))


@query(
    f"""WITH {_STATEMENTS}, t AS (SELECT *, CASE WHEN case_id % 6 < 4 THEN 'Banco ' || ['BBVA', 'HSBC', 'del Norte', 'banorte'][case_id % 6 + 1] || '.' || chr(10) ELSE 'Caja rural.' || chr(10) END || CASE WHEN case_id % 4 <> 0 THEN 'Titular: Juan Peña.' || chr(10) ELSE '' END
        || CASE WHEN case_id % 5 = 0 THEN 'Cuenta: 12345.' || chr(10) ELSE 'Cuenta: ' || lpad(o_custkey::varchar, 12, '7') || '.' || chr(10) END || CASE WHEN case_id % 7 = 0 THEN 'BORRADOR.' || chr(10) ELSE '' END || CASE WHEN case_id % 3 = 0 THEN 'Saldo a la fecha.' || chr(10) ELSE '' END || body AS text FROM s)
    SELECT case_id, concat_ws(',', CASE WHEN case_id % 3 <> 0 THEN 'statement_period' END, CASE WHEN case_id % 3 <> 0 THEN 'transaction_table' END, CASE WHEN case_id % 6 >= 4 THEN 'bank_info' END, CASE WHEN case_id % 3 <> 0 THEN 'balance_info' END) AS missing,
      (5 - 3 * (case_id % 3 <> 0)::int - (case_id % 6 >= 4)::int) / 5.0::double AS completeness, concat_ws(',', CASE WHEN case_id % 7 = 0 THEN 'DRAFT_WATERMARK' END, CASE WHEN length(text) < 500 THEN 'INSUFFICIENT_CONTENT' END) AS flags FROM t"""
)
def ext34_content(spark, d):
    """Which sections a statement has."""
    c = T.content_checks(F.col("text"))
    return _statements(spark, d).select("case_id", c.alias("c")).select("case_id", F.array_join("c.missing", ",").alias("missing"), "c.completeness", F.array_join("c.flags", ",").alias("flags"))


@query()
def img03_pixels(spark, d):
    """Figures of small grey images, one for each embedding (its values as grey, eight in a row). The tests hold them
    against loops over pixels."""
    e = table(spark, d, "embeddings")
    hexes = F.array_join(F.transform("embedding", lambda x: F.lpad(F.hex(F.greatest(F.lit(0), F.least(F.lit(255), F.floor(x * 127 + 128))).cast("long")), 2, "0")), "")
    head = F.concat(F.lit("P5 8 "), F.floor(F.size("embedding") / 8).cast("string"), F.lit(" 255\n"))
    rows = e.select("vec_id", pixel_metrics(F.concat(F.encode(head, "UTF-8"), F.unhex(hexes))).alias("m"))
    return rows.select("vec_id", "m.width", "m.height", *(F.round(f"m.{n}", 6).alias(n) for n in METRICS))


_SEEN = "f AS (SELECT n_nationkey AS k, unnest(['pdf', 'xml', 'docx', 'txt']) AS e FROM nation)"


@query(f"WITH {_SEEN} SELECT 'c-' || k AS key, count(*) AS n, string_agg(e, ',' ORDER BY e) AS formats FROM f WHERE e <> 'txt' AND NOT (e = 'xml' AND k % 3 = 0) AND NOT (e = 'docx' AND k % 2 = 0) GROUP BY 1")
def src01_discover(spark, d):
    """Cases found in a folder by their files: each nation's, of which text files are none of a case."""
    folder = f"{shared_folder(spark)}/portal-{uuid.uuid4().hex}"
    keys = [r["n_nationkey"] for r in table(spark, d, "nation").select("n_nationkey").collect()]  # 25 rows at any scale
    C.put(spark, folder, {f"C-{k}/file.{e}": b"x" for k in keys for e in ("pdf", "xml", "docx", "txt") if not (e == "xml" and k % 3 == 0) and not (e == "docx" and k % 2 == 0)})
    return C.discover(spark, folder).select("key", "n", F.array_join("formats", ",").alias("formats"))


@query("WITH f AS (SELECT n_nationkey AS k, ['png', 'JPG', 'tiff', 'bmp', 'gif', 'Pdf', 'txt'][n_nationkey % 7 + 1] AS e, length(n_name) AS size FROM nation) SELECT 'f' || k || '.' || e AS name, size FROM f WHERE lower(e) IN ('png', 'jpg', 'jpeg', 'tif', 'tiff', 'bmp', 'pdf')")
def src10_images(spark, d):
    """Images found below a folder by their endings."""
    folder = f"{shared_folder(spark)}/images-{uuid.uuid4().hex}"
    rows = table(spark, d, "nation").select("n_nationkey", "n_name").collect()  # 25 rows at any scale
    endings = ("png", "JPG", "tiff", "bmp", "gif", "Pdf", "txt")
    C.put(spark, folder, {f"s{r['n_nationkey'] % 2}/f{r['n_nationkey']}.{endings[r['n_nationkey'] % 7]}": r["n_name"].encode() for r in rows})
    return C.images(spark, folder).select(F.regexp_extract("path", r"([^/]+)$", 1).alias("name"), "size")


@query("SELECT CASE WHEN n_nationkey % 6 = 5 THEN '' ELSE 'C' || n_nationkey END AS case_id, CASE n_nationkey % 3 WHEN 0 THEN 'Pdf,Xml' WHEN 1 THEN 'Docx,Unknown' ELSE '' END AS formats FROM nation")
def src12_manifest(spark, d):
    """The cases that a manifest names, with the formats expected."""
    folder = f"{shared_folder(spark)}/manifest-{uuid.uuid4().hex}"
    keys = [r["n_nationkey"] for r in table(spark, d, "nation").select("n_nationkey").collect()]  # 25 rows at any scale
    formats = (["Pdf", "Xml"], ["Docx", "pdf"], None)
    cases = [{"caseId": None if k % 6 == 5 else f"C{k}", "expectedFormats": formats[k % 3]} for k in keys]
    C.put(spark, folder, {"manifest.json": json.dumps({"oficios": cases}, indent=1).encode()})
    return C.manifest(spark, f"{folder}/manifest.json").select("case_id", F.array_join("formats", ",").alias("formats"))


@query(
    """SELECT o_orderkey AS case_id, 'A/AS1-' || o_orderkey AS case_number, 'OF-' || o_orderkey AS office, 'SI/' || o_orderkey AS request, CASE WHEN o_orderkey % 4 = 0 THEN 'Unknown' ELSE 'OperacionesIlicitas' END AS subdivision, strftime(o_orderdate, '%d/%m/%Y') AS published, (o_orderkey % 30)::varchar AS term, 'SAT' AS authority,
      CASE WHEN o_orderkey % 2 = 0 THEN 'Aseguramiento' WHEN o_orderkey % 3 = 0 THEN 'Desbloqueo' WHEN o_orderkey % 3 = 1 THEN 'Documentacion' ELSE 'Informacion' END AS measure, CASE WHEN o_orderkey % 3 = 0 THEN (1000000 + o_orderkey) || ',7654321' WHEN o_orderkey % 3 = 1 THEN (1000000 + o_orderkey)::varchar END AS accounts,
      CASE WHEN o_orderkey % 3 < 2 THEN 'Calle 1' END AS address, CASE WHEN o_orderkey % 3 < 2 THEN 'Perez Ana' END AS description, CASE WHEN o_orderkey % 3 < 2 THEN 'PEPA800101AB1,XYZ900101CD2' ELSE 'PEPA800101AB1' END AS rfcs,
      CASE WHEN o_orderkey % 3 = 0 THEN 'PEGJ800101HDFRRN09' WHEN o_orderkey % 3 = 1 THEN 'ABCD800101HDFRRN' END AS curp FROM orders"""
)
def src05_xml_fields(spark, d):
    """Fields read flat out of case records."""
    k = F.col("o_orderkey")
    text = k.cast("string")
    asked = F.when(k % 3 == 0, F.concat(F.lit("Dejar sin efectos la cuenta "), (1000000 + k).cast("string"), F.lit(" y 7654321, 7654321"))).otherwise(F.concat(F.lit("Copia certificada de "), (1000000 + k).cast("string")))
    curp = F.when(k % 3 == 0, "curp pegj800101hdfrrn09 fin").otherwise("CURP: ABCD800101HDFRRN")
    special = F.when(k % 3 < 2, F.concat(F.lit("<SolicitudEspecifica><InstruccionesCuentasPorConocer>"), asked, F.lit("</InstruccionesCuentasPorConocer><PersonasSolicitud><Paterno>Perez</Paterno><Materno> </Materno><Nombre>Ana</Nombre><Rfc>pepa800101ab1</Rfc><Domicilio>Calle 1</Domicilio></PersonasSolicitud><PersonasSolicitud><Rfc>XYZ900101CD2</Rfc><Complementarios>"), curp, F.lit("</Complementarios></PersonasSolicitud></SolicitudEspecifica>"))).otherwise("")
    xml = F.concat(
        F.lit('<Expediente xmlns="http://example.org/x"><Cnbv_NumeroExpediente> A/AS1-'), text, F.lit("</Cnbv_NumeroExpediente><Cnbv_NumeroOficio>OF-"), text, F.lit("</Cnbv_NumeroOficio><Cnbv_SolicitudSiara>SI/"), text, F.lit("</Cnbv_SolicitudSiara>"),
        F.when(k % 4 == 0, "").otherwise("<Cnbv_AreaDescripcion>OPERACIONES ILÍCITAS</Cnbv_AreaDescripcion>"), F.lit("<Cnbv_FechaPublicacion>"), F.date_format("o_orderdate", "dd/MM/yyyy"), F.lit("</Cnbv_FechaPublicacion><Cnbv_DiasPlazo>"), (k % 30).cast("string"),
        F.lit("</Cnbv_DiasPlazo><AutoridadNombre>SAT</AutoridadNombre><TieneAseguramiento>"), F.when(k % 2 == 0, "true").otherwise("false"), F.lit("</TieneAseguramiento><SolicitudPartes><Rfc>PEPA800101AB1</Rfc></SolicitudPartes><SolicitudPartes><Rfc> </Rfc></SolicitudPartes>"), special, F.lit("</Expediente>"),
    )
    return C.xml_fields(spread(table(spark, d, "orders")).select(k.alias("case_id"), xml.alias("xml"))).drop("xml")
