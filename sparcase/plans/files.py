"""Reading cases and files, and exports."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sinks import exports as E
from ..sources import cases as C
from .registry import query, table
from .relational import _FILES, _files

_PARTS = "list_filter(string_split(regexp_replace(regexp_replace(url, '^[a-z]+://', ''), '[?#].*$', ''), '/'), lambda x: x <> '')"


@query(f"WITH p AS (SELECT page_id, url, {_PARTS} AS ps FROM pages) SELECT lower(CASE WHEN len(ps) >= 2 THEN ps[len(ps) - 1] ELSE ps[1] END) AS key, count(*) AS n, min(page_id) AS first FROM p GROUP BY 1")
def src02_group_by_case(spark, d):
    return C.group_by_case(table(spark, d, "pages"), "url", "page_id")


def _records(spark, d):
    """A case record in XML for each order: padded, with and without prefixes, with a nil and an unknown element."""
    k = F.col("o_orderkey")
    xml = F.concat(
        F.lit('<Expediente xmlns="http://example.org/x" xmlns:xsi="http://www.w3.org/2001/XMLSchema-instance"><Cnbv_NumeroExpediente>A/AS1-'), k.cast("string"), F.lit("   </Cnbv_NumeroExpediente><NumeroOficio>OF-"), k.cast("string"),
        F.lit("</NumeroOficio><Cnbv_Folio>"), F.when(k % 5 == 0, F.lit("x/1")).otherwise((k % 1000).cast("string")), F.lit('</Cnbv_Folio><NombreSolicitante xsi:nil="true"/><Referencia>  </Referencia><Cnbv_FechaPublicacion>'),
        F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit("</Cnbv_FechaPublicacion><TieneAseguramiento>"), F.when(k % 2 == 0, "true").otherwise("false"), F.lit("</TieneAseguramiento><Canal>web</Canal>"),
        F.lit("<SolicitudPartes><ParteId>1</ParteId><Nombre>Ana</Nombre><Rfc> </Rfc></SolicitudPartes><SolicitudPartes><ParteId>2</ParteId><Nombre>Luis</Nombre></SolicitudPartes></Expediente>"),
    )
    return table(spark, d, "orders").select(k.alias("case_id"), xml.alias("xml"))


@query("SELECT o_orderkey AS case_id, 'A/AS1-' || o_orderkey AS number, 'OF-' || o_orderkey AS office, CASE WHEN o_orderkey % 5 = 0 THEN 0 ELSE (o_orderkey % 1000)::int END AS folio, 2025 AS year, NULL::varchar AS applicant, NULL::varchar AS reference, o_orderdate::date AS published, o_orderkey % 2 = 0 AS seized, 2 AS parties, 'Ana' AS first_name, NULL::varchar AS first_rfc FROM orders")
def src03_parse_cases(spark, d):
    r = C.parse_cases(_records(spark, d))
    first = F.get("SolicitudPartes", F.lit(0))
    return r.select("case_id", F.col("NumeroExpediente").alias("number"), F.col("NumeroOficio").alias("office"), F.col("Folio").alias("folio"), F.col("OficioYear").alias("year"), F.col("NombreSolicitante").alias("applicant"), F.col("Referencia").alias("reference"), F.col("FechaPublicacion").alias("published"), F.col("TieneAseguramiento").alias("seized"), F.size("SolicitudPartes").alias("parties"), first["Nombre"].alias("first_name"), first["Rfc"].alias("first_rfc"))


@query("SELECT o_orderkey AS case_id, 'Canal' AS name, 'web' AS value FROM orders")
def src04_additional_fields(spark, d):
    return _records(spark, d).select("case_id", F.explode(C.additional_fields(F.col("xml"))).alias("name", "value"))


@query("SELECT doc_id, (['pdf', 'xml', 'docx', 'zip', NULL])[doc_id % 5 + 1] AS format FROM documents")
def src09_file_format(spark, d):
    k = F.col("doc_id")
    ending = F.element_at(F.array(*(F.lit(x) for x in ("PDF", "xml", "Docx", "zip", "bin"))), (k % 5 + 1).cast("int"))
    return table(spark, d, "documents").select("doc_id", C.file_format(F.lit(None).cast("binary"), F.concat(F.lit("doc"), k.cast("string"), F.lit("."), ending)).alias("format"))


@query(f"WITH {_FILES}, b AS (SELECT case_id FROM files GROUP BY 1 HAVING bool_or(format = 'xml') AND bool_or(format = 'PDF')) SELECT least(count(*), 4) AS n FROM b")
def src11_sample(spark, d):
    """Four cases that have both formats; how many there are is what SQL can check."""
    return C.sample_cases(_files(spark, d).withColumn("format", F.lower("format")), 4).agg(F.count("*").alias("n"))


@query("SELECT sha256(text) AS digest, source AS url, min(doc_id) AS doc_id FROM documents GROUP BY 1, 2")
def src13_15_journal(spark, d):
    return C.first_entries(table(spark, d, "documents").select(F.sha2("text", 256).alias("digest"), F.col("source").alias("url"), "doc_id"), order="doc_id")


@query("SELECT 'orders' AS name, count(*) AS n FROM orders UNION ALL SELECT 'events', count(*) FROM events UNION ALL SELECT 'pages', count(*) FROM pages")
def src14_tables(spark, d):
    one = lambda n: table(spark, d, n).agg(F.lit(n).alias("name"), F.count("*").alias("n"))
    return one("orders").unionByName(one("events")).unionByName(one("pages"))


@query(f"WITH p AS (SELECT page_id, html, {_PARTS} AS ps FROM pages) SELECT page_id, CASE WHEN ltrim(html) LIKE '<%' THEN 'xml' END AS format, '2024/03/01/' || regexp_replace(lower(CASE WHEN len(ps) >= 2 THEN ps[len(ps) - 1] ELSE ps[1] END), '[\\\\/:*?\"<>|]', '_', 'g') || '/' || page_id || '.xml' AS path FROM p")
def src16_intake(spark, d):
    """Pages as files: format by first bytes, fields, safe names and dated paths."""
    p = table(spark, d, "pages")
    kind = C.file_format(F.encode("html", "UTF-8"), F.lit("page.html"))
    return p.select("page_id", kind.alias("format"), E.dated_path(F.to_date(F.lit("2024-03-01")), C.case_key(F.col("url")), F.concat(F.col("page_id").cast("string"), F.lit(".xml"))).alias("path"))


@query("""SELECT o_orderkey AS case_id, '<Expediente>' || chr(10) || '    <NumeroExpediente>A/AS1-' || o_orderkey || '</NumeroExpediente>' || chr(10) || CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE '    <Prioridad>' || replace(replace(replace(trim(o_orderpriority), '&', '&amp;'), '<', '&lt;'), '>', '&gt;') || '</Prioridad>' || chr(10) END
  || '    <Estado>' || o_orderstatus || '</Estado>' || chr(10) || '</Expediente>' AS xml FROM orders""")
def snk01_case_xml(spark, d):
    """Regulator records, blank elements left out."""
    fields = {"NumeroExpediente": F.concat(F.lit("A/AS1-"), F.col("o_orderkey").cast("string")), "Prioridad": F.when(F.col("o_orderkey") % 3 == 0, " ").otherwise(F.col("o_orderpriority")), "Estado": F.col("o_orderstatus")}
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("case_id"), E.case_xml(fields).alias("xml"))


def _cases(spark, d):
    k = F.col("o_orderkey")
    party = F.struct(F.concat(F.lit("RFC"), k.cast("string")).alias("rfc"), F.lit("Lopez").alias("paterno"), F.when(k % 2 == 0, "Diaz").alias("materno"), F.lit("Ana").alias("nombre"))
    return table(spark, d, "orders").select(k.alias("case_id"), F.concat(F.lit(" a/as1-"), k.cast("string")).alias("case_number"), F.concat(F.lit("OF-"), k.cast("string")).alias("office"), F.when(k % 4 == 0, "").otherwise("Hacendario").alias("area"), F.lit("SAT Norte").alias("authority"), F.to_date("o_orderdate").alias("received"), (k % 30).cast("int").alias("term_days"), F.array(party, party).alias("parties"), F.lit("BLOQUEO").alias("subject"), F.col("o_custkey").alias("amount"), F.when(k % 3 == 0, 'a "b", c').alias("note"))


@query(
    """SELECT ' a/as1-' || o_orderkey AS c01_case, 'OF-' || o_orderkey AS c02_office, CASE WHEN o_orderkey % 4 = 0 THEN '' ELSE 'Hacendario' END AS c03_area, 'SAT Norte' AS c04_authority, strftime(o_orderdate, '%Y-%m-%d') AS c05_received, (o_orderkey % 30)::varchar AS c06_term, 'RFC' || o_orderkey AS c07_rfc,
      CASE WHEN o_orderkey % 2 = 0 THEN 'Lopez Diaz Ana' ELSE 'Lopez Ana' END AS c08_name, '2' AS c09_parties, 'BLOQUEO' AS c10_subject, o_custkey::varchar AS c11_amount, CASE WHEN o_orderkey % 3 = 0 THEN 'a "b", c' ELSE '' END AS c12_note FROM orders"""
)
def snk02_layout(spark, d):
    return E.layout_row(_cases(spark, d))


@query("SELECT o_orderkey AS case_id, 'OF-' || o_orderkey AS OFICIO, 'A/AS1-' || o_orderkey AS EXPEDIENTE, strftime(o_orderdate, '%d/%m/%Y') AS RECEPCION, CASE WHEN o_orderkey % 4 = 0 THEN 'INFORMACIÓN' ELSE 'HACENDARIO' END AS AREA, lpad((o_orderkey % 30)::varchar, 3, '0') AS PLAZO, left('Servicio de Administración Norte', 20) AS AUTORIDAD FROM orders")
def snk03_04_upload(spark, d):
    return E.upload_layout(_cases(spark, d), "case_id")


@query("SELECT l_orderkey AS case_id, 'Criterion_' || l_linenumber AS name, min(l_returnflag) AS description FROM lineitem GROUP BY 1, 2")
def snk05_criteria(spark, d):
    one = table(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_returnflag").alias("description"))
    req = one.groupBy(F.col("l_orderkey").alias("case_id")).agg(F.collect_list(F.struct(F.col("l_linenumber").alias("id"), "description")).alias("r"))
    return req.select("case_id", F.explode(E.criteria(F.col("r"))).alias("name", "description"))


@query("""SELECT o_orderkey AS case_id, o_orderkey || ',' || CASE WHEN o_orderkey % 3 = 0 THEN '"a ""b"", c"' ELSE '' END || ',' || o_orderstatus AS line FROM orders""")
def snk06_csv(spark, d):
    return _cases(spark, d).join(table(spark, d, "orders").select(F.col("o_orderkey").alias("case_id"), "o_orderstatus"), "case_id").select("case_id", E.csv_line(F.col("case_id"), F.col("note"), F.col("o_orderstatus")).alias("line"))


@query("SELECT o_orderkey AS case_id, sha256(o_orderkey || ':' || o_orderstatus) AS digest FROM orders")
def snk10_digest(spark, d):
    """The digest that a signature would be made of; signing itself isn't part of this engine."""
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("case_id"), F.sha2(F.concat_ws(":", F.col("o_orderkey").cast("string"), "o_orderstatus"), 256).alias("digest"))


@query("SELECT o_orderkey AS case_id, strftime(o_orderdate, '%Y/%m/%d') || '/A_AS1-' || o_orderkey || '/f_1.pdf' AS path FROM orders")
def snk08_11_paths(spark, d):
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("case_id"), E.dated_path(F.col("o_orderdate"), F.concat(F.lit("A/AS1-"), F.col("o_orderkey").cast("string")), F.lit("f:1.pdf")).alias("path"))
