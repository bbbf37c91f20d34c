"""Regulator records, layouts, reports and partitioned storage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.templates import Mapping, project


def case_xml(fields: dict[str, Column], people: Column | None = None, root: str = "Expediente") -> Column:
    """A case as XML: elements in order, blank ones left out, people as repeated elements."""
    parts = [F.nullif(F.trim(c.cast("string")), F.lit("")).alias(n) for n, c in fields.items()]
    if people is not None:
        parts.append(people.alias("Parte"))
    return F.to_xml(F.struct(*parts), {"rowTag": root})


def layout_row(rows: DataFrame) -> DataFrame:
    """The twelve columns of the spreadsheet layout."""
    first = F.get("parties", F.lit(0))
    return rows.select(
        F.col("case_number").alias("c01_case"), F.col("office").alias("c02_office"), F.col("area").alias("c03_area"), F.col("authority").alias("c04_authority"), F.date_format("received", "yyyy-MM-dd").alias("c05_received"),
        F.col("term_days").cast("string").alias("c06_term"), first["rfc"].alias("c07_rfc"), F.concat_ws(" ", first["paterno"], first["materno"], first["nombre"]).alias("c08_name"), F.size("parties").cast("string").alias("c09_parties"),
        F.col("subject").alias("c10_subject"), F.col("amount").cast("string").alias("c11_amount"), F.coalesce("note", F.lit("")).alias("c12_note"),
    )


UPLOAD = [
    Mapping("case_number", "EXPEDIENTE", 2, required=True, transform="Trim() | ToUpper()"),
    Mapping("office", "OFICIO", 1, required=True, rules=["MaxLength:30"]),
    Mapping("received", "RECEPCION", 3, format="dd/MM/yyyy"),
    Mapping("area", "AREA", 4, default="INFORMACIÓN", transform="ToUpper()"),
    Mapping("term_days", "PLAZO", 5, default="0", transform="PadLeft(3,0)", rules=["Range:0,20"]),
    Mapping("authority", "AUTORIDAD", 6, transform="Replace(SAT, Servicio de Administración) | Substring(0, 20)"),
]


def upload_layout(rows: DataFrame, key: str) -> DataFrame:
    return project(rows, UPLOAD, key)


def criteria(requirements: Column) -> Column:
    """map Criterion_<id> -> description of an array of (id, description)."""
    return F.map_from_entries(F.transform(requirements, lambda r: F.struct(F.concat(F.lit("Criterion_"), r["id"].cast("string")), r["description"])))


def quoted(c: Column) -> Column:
    """A CSV field as RFC 4180 has it: quoted where it holds a comma, a quote or a line break."""
    c = F.coalesce(c.cast("string"), F.lit(""))
    return F.when(c.rlike('[",\r\n]'), F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(c)


def csv_line(*columns: Column) -> Column:
    return F.concat_ws(",", *(quoted(c) for c in columns))


def write_report(rows: DataFrame, path: str, form: str, order: str) -> None:
    """A report as CSV or JSON files in order."""
    sorted_ = rows.orderBy(order)
    if form == "csv":
        sorted_.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)
    else:
        sorted_.write.mode("overwrite").json(path)


def training_data(sessions: DataFrame, least: int = 3, model: str | None = None) -> DataFrame:
    """Reviewed sessions for training: with a truth and a rating of at least `least`, best first."""
    rows = sessions.where(F.col("reviewed") & F.col("training") & (F.col("rating") >= least) & (F.length("truth") > 0))
    rows = rows if model is None else rows.where(F.col("model") == model)
    return rows.orderBy(F.col("rating").desc(), "session_id")


def safe_name(c: Column) -> Column:
    """A file name without characters that file systems refuse."""
    return F.substring(F.regexp_replace(F.regexp_replace(c, r'[\\/:*?"<>|\x00-\x1f]', "_"), r"^[. ]+|[. ]+$", ""), 1, 120)


def dated_path(day: Column, case: Column, name: Column) -> Column:
    return F.concat_ws("/", F.date_format(day, "yyyy"), F.date_format(day, "MM"), F.date_format(day, "dd"), safe_name(case), safe_name(name))


def store(rows: DataFrame, path: str, day: str) -> None:
    """rows as Parquet by year, month and day."""
    rows.withColumns({"year": F.year(day), "month": F.month(day), "day": F.dayofmonth(day)}).repartition("year", "month", "day").write.mode("append").partitionBy("year", "month", "day").parquet(path)


def sealed(c: Column, key: str) -> Column:
    """Content encrypted by AES-GCM, as Spark does it."""
    return F.aes_encrypt(c, F.lit(key), F.lit("GCM"))
