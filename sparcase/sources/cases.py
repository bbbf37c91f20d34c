"""Files, folders and case records as DataFrames."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType

#: Elements of a case record. Every leaf is read as text; types come later, with defaults.
PERSON = "ParteId: string, Caracter: string, Persona: string, Paterno: string, Materno: string, Nombre: string, Rfc: string"
ASKED = "PersonaId: string, Caracter: string, Persona: string, Paterno: string, Materno: string, Nombre: string, Rfc: string, Relacion: string, Domicilio: string, Complementarios: string"
SCALARS = (
    "NumeroOficio", "NumeroExpediente", "SolicitudSiara", "Folio", "OficioYear", "AreaClave", "AreaDescripcion", "FechaPublicacion", "DiasPlazo",
    "AutoridadNombre", "NombreSolicitante", "Referencia", "Referencia1", "Referencia2", "TieneAseguramiento",
)
INTEGERS = ("Folio", "OficioYear", "AreaClave", "DiasPlazo")
SCHEMA = ", ".join(f"{p}{n} string" for n in SCALARS for p in ("", "Cnbv_")) + f", SolicitudPartes array<struct<{PERSON}>>, SolicitudEspecifica array<struct<SolicitudEspecificaId: string, InstruccionesCuentasPorConocer: string, PersonasSolicitud: array<struct<{ASKED}>>>>"


def files(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """path, modified, size and content of all files below a folder."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(folder).select("path", F.col("modificationTime").alias("modified"), F.col("length").alias("size"), "content")


def put(spark: SparkSession, folder: str, contents: dict[str, bytes]) -> None:
    """Writes small files below a folder of any store that Spark knows. For fixtures and manifests, not for data."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    for name, content in contents.items():
        path = hadoop.Path(f"{folder}/{name}")
        out = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(path, True)
        out.write(bytearray(content))
        out.close()


#: The files of a case that a portal offers; images that can be loaded; file formats by name.
CASE_FILES = "*.{pdf,xml,docx}"
IMAGES = ("png", "jpg", "jpeg", "tif", "tiff", "bmp", "pdf")
FORMATS = ("Pdf", "Xml", "Docx", "Zip", "Other")


def discover(spark: SparkSession, folder: str) -> DataFrame:
    """key, n and formats of the cases below a folder: its PDF, XML and word-processor files by their folder."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", CASE_FILES).load(folder).select("path")
    ending = F.regexp_extract("path", r"\.([a-z]+)$", 1)
    return found.groupBy(case_key(F.col("path")).alias("key")).agg(F.count("*").alias("n"), F.array_sort(F.collect_set(ending)).alias("formats"))


def images(spark: SparkSession, folder: str) -> DataFrame:
    """path, size and content of all files below a folder whose ending, in any case, is one of IMAGES."""
    return files(spark, folder).where(F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)).isin(*IMAGES)).select("path", "size", "content")


def xml_fields(rows: DataFrame, xml: str = "xml") -> DataFrame:
    """rows with the fields read out of a case record as they stand: identifiers, area, measure, accounts, people."""
    from ..functions import extract as X

    record = rows.withColumn("_r", F.from_xml(F.col(xml), SCHEMA + ", AutoridadEspecificaNombre string", {"ignoreNamespace": "true"}))
    text = lambda c: F.nullif(F.trim(c), F.lit(""))
    of = lambda n: text(F.col(f"_r.Cnbv_{n}"))
    asked = F.get("_r.SolicitudEspecifica", F.lit(0))
    people = F.coalesce(asked["PersonasSolicitud"], F.expr("cast(array() as array<struct<" + ASKED + ">>)"))
    orders = text(asked["InstruccionesCuentasPorConocer"])
    first = F.get(people, F.lit(0))
    rfcs = F.filter(F.concat(F.transform(F.coalesce(F.col("_r.SolicitudPartes"), F.expr("cast(array() as array<struct<" + PERSON + ">>)")), lambda p: text(p["Rfc"])), F.transform(people, lambda p: text(p["Rfc"]))), lambda r: r.isNotNull())
    once = F.filter(rfcs, lambda r, i: F.lower(r) != F.coalesce(F.get(F.filter(F.transform(F.slice(rfcs, F.lit(1), F.greatest(i, F.lit(1))), F.lower), lambda x: (x == F.lower(r)) & (i > 0)), F.lit(0)), F.lit("")))
    curps = F.filter(F.transform(people, lambda p: F.coalesce(X.first(p["Complementarios"], X.CURP_STRICT), X.first(p["Complementarios"], CURP_LOOSE, 1))), lambda c: c.isNotNull())
    seized = F.lower(text(F.col("_r.TieneAseguramiento"))) == "true"
    return record.select(
        *rows.columns,
        of("NumeroExpediente").alias("case_number"),
        of("NumeroOficio").alias("office"),
        of("SolicitudSiara").alias("request"),
        F.when(of("AreaDescripcion").isNotNull(), X.subdivision_hint(of("AreaDescripcion"))).otherwise("Unknown").alias("subdivision"),
        of("FechaPublicacion").alias("published"),
        of("DiasPlazo").alias("term"),
        text(F.col("_r.AutoridadNombre")).alias("authority"),
        X.measure_hint(F.coalesce(seized, F.lit(False)), orders).alias("measure"),
        F.nullif(F.array_join(F.array_distinct(X.every(F.coalesce(orders, F.lit("")), X.ACCOUNT)), ","), F.lit("")).alias("accounts"),
        text(first["Domicilio"]).alias("address"),
        F.nullif(F.concat_ws(" ", text(first["Paterno"]), text(first["Materno"]), text(first["Nombre"])), F.lit("")).alias("description"),
        F.nullif(F.array_join(once, ","), F.lit("")).alias("rfcs"),
        F.substring(F.upper(F.get(curps, F.lit(0))), 1, 18).alias("curp"),
    )


#: Fixed value: a population number that may lack its check digits.
CURP_LOOSE = r"(?i)\b([A-Z]{4}[0-9]{6}[A-Z0-9]{6}(?:[0-9]{2})?)\b"


def case_key(path: Column) -> Column:
    """The last folder of a path or address, in lower case; else the file's name, else the whole."""
    bare = F.regexp_replace(F.regexp_replace(path, r"^[a-z]+://", ""), r"[?#].*$", "")
    parts = F.filter(F.split(bare, "/"), lambda x: x != "")
    return F.lower(F.coalesce(F.when(F.size(parts) >= 2, F.element_at(parts, -2)), F.when(F.size(parts) >= 1, F.element_at(parts, -1)), F.nullif(path, F.lit("")), F.lit("__unknown__")))


def group_by_case(rows: DataFrame, path: str = "url", order: str = "place") -> DataFrame:
    """key, n, first (the place of its first file) of each case."""
    return rows.groupBy(case_key(F.col(path)).alias("key")).agg(F.count("*").alias("n"), F.min(order).alias("first"))


def file_format(content: Column, name: Column) -> Column:
    """pdf, xml, docx or zip by the first bytes, else by the name's ending, else null."""
    head = F.hex(F.substring(content, 1, 4))
    text = F.trim(F.substring(content.cast("string"), 1, 64))
    ending = F.lower(F.regexp_extract(name, r"\.([^.]+)$", 1))
    by_name = F.when(ending.isin("pdf", "xml", "docx", "zip"), ending)
    return F.when(head == "25504446", "pdf").when(head == "504B0304", F.when(F.substring(content, 1, 4096).cast("string").contains("word/"), "docx").otherwise("zip")).when(text.startswith("<"), "xml").otherwise(by_name)


def parse_cases(rows: DataFrame, xml: str = "xml", year: int = 2025) -> DataFrame:
    """rows with the fields of their case record.

    An element may carry the prefix Cnbv_; blanks and nil are null; whole numbers default to 0, the year to `year`."""
    record = rows.withColumn("_r", F.from_xml(F.col(xml), SCHEMA, {"ignoreNamespace": "true"}))
    text = lambda c: F.nullif(F.trim(c), F.lit(""))
    out = record
    for n in SCALARS:
        c = F.coalesce(text(F.col(f"_r.Cnbv_{n}")), text(F.col(f"_r.{n}")))
        if n in INTEGERS:
            c = F.coalesce(c.try_cast("int"), F.lit(year if n == "OficioYear" else 0))
        elif n == "TieneAseguramiento":
            c = F.coalesce(F.lower(c).isin("true", "1"), F.lit(False))
        elif n == "FechaPublicacion":
            c = F.coalesce(F.try_to_date(c, "yyyy-MM-dd"), F.try_to_date(c, "dd/MM/yyyy"))
        out = out.withColumn(n, c)
    people = F.transform("_r.SolicitudPartes", lambda p: F.struct(F.coalesce(text(p["ParteId"]).try_cast("int"), F.lit(0)).alias("ParteId"), *(text(p[x]).alias(x) for x in ("Caracter", "Persona", "Paterno", "Materno", "Nombre", "Rfc"))))
    return out.withColumn("SolicitudPartes", people).withColumn("SolicitudEspecifica", F.col("_r.SolicitudEspecifica")).drop("_r")


def additional_fields(xml: Column) -> Column:
    """map of a record's elements that hold text alone and aren't known fields."""
    found = F.regexp_extract_all(xml, F.lit(r"<(?:\w+:)?(\w+)(?:\s[^>]*)?>([^<]*)</"), F.lit(1))
    values = F.regexp_extract_all(xml, F.lit(r"<(?:\w+:)?(\w+)(?:\s[^>]*)?>([^<]*)</"), F.lit(2))
    known = [*SCALARS, *(f"Cnbv_{n}" for n in SCALARS), *(x.split(":")[0].strip() for x in f"{PERSON}, {ASKED}, SolicitudEspecificaId: s, InstruccionesCuentasPorConocer: s".split(","))]
    pairs = F.filter(F.arrays_zip(found.alias("k"), values.alias("v")), lambda p: ~p["k"].isin(known) & (F.trim(p["v"]) != ""))
    distinct = F.aggregate(pairs, F.expr("cast(map() as map<string, string>)"), lambda m, p: F.when(F.map_contains_key(m, p["k"]), m).otherwise(F.map_concat(m, F.create_map(p["k"], F.trim(p["v"])))))
    return distinct


def sample_cases(rows: DataFrame, n: int, seed: int = 7, case: str = "case_id") -> DataFrame:
    """At most n cases that have both an XML and a PDF file, drawn by a digest of case and seed."""
    both = rows.groupBy(case).agg(F.array_contains(F.collect_set("format"), "xml").alias("x"), F.array_contains(F.collect_set("format"), "pdf").alias("p")).where("x and p").select(case)
    return both.orderBy(F.xxhash64(F.col(case), F.lit(seed)), case).limit(n)


def first_entries(journal: DataFrame, keys: tuple[str, ...] = ("digest", "url"), order: str = "place") -> DataFrame:
    """The first entry of each key of a journal that is only ever appended to."""
    cols = F.struct(F.col(order), *(F.col(c) for c in journal.columns if c not in keys and c != order))
    return journal.groupBy(*keys).agg(F.min(cols).alias("e")).select(*keys, "e.*")


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """case_id and formats of expected cases, from files of one JSON object a line ({"case_id", "formats"}) or from whole
    objects ({"oficios": [{"caseId", "expectedFormats"}]}). Of the latter a missing id is empty, and a format that isn't
    a known name is Unknown."""
    entry = "array<struct<caseId: string, expectedFormats: array<string>>>"
    raw = spark.read.schema(f"case_id string, formats array<string>, oficios {entry}").option("multiLine", _is_whole(spark, path)).json(path)
    whole = raw.where("oficios is not null").select(F.explode("oficios").alias("o")).select(F.coalesce("o.caseId", F.lit("")).alias("case_id"), F.transform(F.coalesce("o.expectedFormats", F.array().cast("array<string>")), lambda f: F.when(f.isin(*FORMATS), f).otherwise("Unknown")).alias("formats"))
    return raw.where("oficios is null").select("case_id", "formats").unionByName(whole)


def _is_whole(spark: SparkSession, path: str) -> bool:
    return spark.read.text(path).where(F.col("value").contains('"oficios"')).limit(1).count() > 0


def text_layer(rows: DataFrame, extract, content: str = "content") -> DataFrame:
    """rows with the text that a function (bytes to str) of the caller's finds in their content: the hook for PDF and
    word-processor readers and for OCR engines, which are no part of this engine. Batches of a task go to it in order."""
    @pandas_udf(StringType())
    def run(c: pd.Series) -> pd.Series:
        return c.map(lambda b: None if b is None else extract(bytes(b)))

    return rows.withColumn("text", run(F.col(content)))
