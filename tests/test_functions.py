"""Known values of single functions and operators."""

import datetime

import pytest
from pyspark.sql import functions as F

from sparcase.functions import extract as X
from sparcase.functions import normalize as N
from sparcase.functions import similarity as S
from sparcase.operators import calendar, classify, fusion, identity, semantic, templates
from sparcase.sinks import exports
from sparcase.sources import cases


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values()) or (1,)], ", ".join(f"{k} {'string' if isinstance(v, str) or v is None else 'int'}" for k, v in values.items()) or "x int")
    return row.select(column.alias("out")).head()[0]


@pytest.mark.parametrize(
    "raw, clean",
    [("  SUBDELEGACION&nbsp;8\r\nSAN    ANGEL   ", "SUBDELEGACION 8 SAN ANGEL"), ("no se cuenta", None), ("   ", None), (None, None), ("_ __", None), ("&amp;nbsp;", None), ("a &LT; b", "a b")],
)
def test_sanitize(spark, raw, clean):
    assert one(spark, N.sanitize(F.col("v")), v=raw) == clean


@pytest.mark.parametrize("raw, clean", [("$1,234.50", "1235"), ("1,234.49 MXN", "1234"), ("-5", None), ("abc", None), ("0", "0"), (None, None), ("usd 2.5", "3")])
def test_amount(spark, raw, clean):
    assert one(spark, N.sanitize_amount(F.col("v")), v=raw) == clean


@pytest.mark.parametrize("a, b, ratio", [("PEREZ LOPEZ", "PERES LOPEZ", 91), ("JUAN", "JUANA", 89), ("", "", 100), ("a", "", 0), ("abc", "abc", 100), ("abc", "xyz", 0)])
def test_ratio(spark, a, b, ratio):
    assert one(spark, S.ratio(F.col("a"), F.col("b")), a=a, b=b) == ratio


def test_ratio_like_brute_force(spark):
    import random

    rng = random.Random(3)
    rows = [("".join(rng.choice("abc ") for _ in range(rng.randrange(9))), "".join(rng.choice("abc ") for _ in range(rng.randrange(9)))) for _ in range(60)]
    for a, b, got in spark.createDataFrame(rows, "a string, b string").select("a", "b", S.common_subsequence(F.col("a"), F.col("b"))).collect():
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
        assert got == table[-1][-1]


def test_best_window(spark):
    best = one(spark, S.best_window(F.lit("bloqueo de cuenta"), F.col("t")), t="se pide el bloqeo de cuenta hoy")
    assert best["words"] == 3 and best["start"] == 4 and best["score"] > 0.9
    assert one(spark, S.best_window(F.lit("bloqueo de cuenta"), F.col("t")), t="nada que ver con eso aqui") is None


def test_semantic(spark):
    rows = spark.createDataFrame([("Ordena el aseguramiento precautoro y la transferencia de fondos",)], "t string")
    found = rows.select(semantic.semantic_directives(F.col("t"))).head()[0]
    assert [x["kind"] for x in found] == ["Block", "Transfer"]


@pytest.mark.parametrize("text, kinds", [("Ordena el desbloqueo de cuenta", {"Unblock": 1.0, "Block": 0.92}), ("aseguramiento de los fondos", {"Block": 0.92, "Unblock": 0.87}), ("", {}), (None, {}), ("pide REPORTE DE SALDOS", {"Information": 1.0})])
def test_semantic_scores(spark, text, kinds):
    found = spark.createDataFrame([(text,)], "t string").select(semantic.semantic_directives(F.col("t"))).head()[0]
    assert {x["kind"]: x["score"] for x in found} == kinds


def test_semantic_like_brute_force(spark):
    import random

    from sparcase.functions.sequence import common_length

    assert {k: len(v) for k, v in semantic.PHRASES.items()} == {"Unblock": 23, "Block": 27, "Transfer": 14, "Document": 23, "Information": 17}
    rng = random.Random(7)
    some = [w for phrases in semantic.PHRASES.values() for p in phrases for w in p.split()]

    def bad(w):
        i = rng.randrange(len(w))
        return w[:i] + w[i + 1 :] if rng.random() < 0.3 and len(w) > 3 else w

    texts = [" ".join(bad(rng.choice(some)) for _ in range(rng.randrange(1, 25))) for _ in range(60)]
    scores = semantic.PhraseScores([p for phrases in semantic.PHRASES.values() for p in phrases])
    for t in texts:
        words, want = t.upper().split(), []
        for kind, phrases in semantic.PHRASES.items():
            best = (0.0, "")
            for p in phrases:
                up, n = p.upper(), len(p.split())
                for size in range(max(1, n - 1), n + 3):
                    for i in range(len(words) - size + 1):
                        w = " ".join(words[i : i + size])
                        score = int(200 * common_length(up, w) / (len(up) + len(w)) + 0.5) / 100 if len(up) <= len(t) else 0.0
                        best = (score, p) if score > best[0] else best
            if best[0] >= 0.85:
                want.append((kind, *best))
        assert semantic.directives_of(t, scores) == want


@pytest.mark.parametrize(
    "answer, value",
    [('{"a": {"b": 1}}', '{"a": {"b": 1}}'), ('x {"a": {"b": 1}} y', '{"b": 1}'), ("```json\n[1, 2]\n```", "[1, 2]"), ("{'a': 'x',}", '{"a": "x"}'), ("{a: 1}", '{"a": 1}'), ('"a": 1', '{"a": 1}'), ('a = "x" b = 2', '{"a": "\\"x\\"", "b": "2"}'), ("no", "{}"), (None, None), ("{'note': 'it''s'}", "{}"), ("[1, {\"a\": 2}, ", '{"a": 2}')],
)
def test_json(spark, answer, value):
    from sparcase.functions.jsontext import json_repaired

    assert one(spark, json_repaired(F.col("t")), t=answer) == value


def test_case_numbers(spark):
    found = lambda t: [(float(x["score"]), x["value"]) for x in one(spark, X.scored_case_numbers(F.col("t")), t=t)]
    assert found("Tribunal: expediente no. 12/2023") == [(0.6, "NO."), (0.6, "NO.")]
    assert found("expediente: abc-12/2023 y exp. no. 77/23")[:2] == [(0.9, "ABC-12/2023"), (0.8, "77/23")]
    assert found("expediente de la cuenta") == [] and found("Expediente 5 de la Corte") == []


def test_sections(spark):
    part = lambda t, header: one(spark, X.section(F.col("t"), ["OFICIO", "RFC"], ["PLAZO"], header), t=t)
    assert part("x Oficio:: uno\nPlazo 3", True) == "Oficio:: uno" and part("x Oficio:: uno\nPlazo 3", False) == "uno"
    assert part("nada", True) is None and part("oficio:", False) is None


@pytest.mark.parametrize("name, kind", [("SUBDELEGACIÓN 8", "Delegación"), ("Subadministración 3", "Administración"), ("Fiscal General", "Fiscalía"), ("Juzgado del Tribunal", "Juzgado"), ("Antesala", "Otro"), ("Sala Superior", "Sala"), ("SAT", "Otro"), ("Órgano", "Órgano")])
def test_authority_types(spark, name, kind):
    assert one(spark, X.authority_type(F.col("n")), n=name) == kind


@pytest.mark.parametrize("text, measure", [("DESBLOQUEO", "Aseguramiento"), ("liberar", "Desbloqueo"), (" ", "Informacion"), (None, "Informacion"), ("algo", "Otro"), ("REANUDAR", "Desbloqueo"), ("ignorar", "Ignorar")])
def test_measure(spark, text, measure):
    assert one(spark, X.measure_hint(F.lit(False), F.col("t")), t=text) == measure


def test_names_kept(spark):
    rows = spark.createDataFrame([("Juzgado Quinto de lo Penal",), ("JUZGADO QUINTO CON RESIDENCIA EN X",), ("Juzgado con residencia en Morelia",), ("Juzgado 5",), ("x" * 81,)], "n string")
    assert [r[0] for r in rows.select(identity.name_quality(F.col("n"))).collect()] == [15, 3, 18, 0, -5]


def test_action_traps(spark):
    assert one(spark, X.action_kind(F.col("t")), t="DESBLOQUEO") == "Block"
    rows = spark.createDataFrame([("DESEMBARGO", "", "", False)], "t string, a string, n string, s boolean")
    assert classify.classify_cases(rows, "s", "a", "n", "t").head()["level1"] == "Unknown"


@pytest.mark.parametrize("text, value, currency", [("por $1,500.00 pesos", 1500.0, "MXN"), ("monto de 20,000 en dólares", 20000.0, "USD"), ("folio 1234567890", 123.0, None), ("nada", None, None)])
def test_money(spark, text, value, currency):
    got = one(spark, X.amount(F.col("t")), t=text)
    if text.startswith("folio"):
        assert got["value"] is None or got["currency"] is None
    else:
        assert (got["value"] and float(got["value"])) == value and got["currency"] == currency


@pytest.mark.parametrize("start, n, due", [("2025-06-06", 1, "2025-06-09"), ("2025-09-15", 1, "2025-09-17"), ("2025-04-30", 1, "2025-05-02"), ("2025-06-06", 0, "2025-06-06"), ("2025-06-06", 7, "2025-06-17")])
def test_working_days(spark, start, n, due):
    rows = spark.createDataFrame([(datetime.date.fromisoformat(start), n)], "start date, n int")
    days = calendar.working_days(spark, "2025-01-01", "2025-12-31")
    assert str(calendar.add_working_days(rows, "start", "n", days).head()["due"]) == due


def fused(spark, field, *values):
    rows = [(1, 22, field, s, v, r) for s, v, r in values]
    return fusion.fuse_fields(spark.createDataFrame(rows, "case_id int, place int, field string, source int, value string, reliability double")).head()


def test_fusion(spark):
    assert fused(spark, "Folio", (1, None, 0.6), (2, " ", 0.8))["decision"] == fusion.ALL_NULL
    agreed = fused(spark, "Folio", (1, "a", 0.6), (2, "A", 0.8))
    assert (agreed["decision"], agreed["value"], agreed["confidence"]) == (fusion.ALL_AGREE, "a", 0.8)
    assert fused(spark, "Folio", (1, "a", 0.6), (2, "b", 0.8))["decision"] == fusion.CONFLICT
    voted = fused(spark, "Folio", (1, "a", 0.6), (2, "b", 0.8), (3, "b", 0.7))
    assert (voted["decision"], voted["value"], voted["source"]) == (fusion.VOTING, "b", 2)
    assert fused(spark, "Folio", (1, "a", 0.9), (2, "b", 0.8), (3, "b", 0.7))["decision"] == fusion.CONFLICT
    alike = fused(spark, "NombreSolicitante", (1, "JUAN PEREZ LOPEZ", 0.6), (2, "JUAN PERES LOPEZ", 0.8))
    assert alike["decision"] == fusion.FUZZY and alike["value"] == "JUAN PERES LOPEZ" and 0.7 < alike["confidence"] < 0.8
    assert fused(spark, "Titular_Nombre", (1, "JUAN PEREZ LOPEZ", 0.6), (2, "JUAN PERES LOPEZ", 0.8))["decision"] == fusion.CONFLICT


def test_names(spark):
    rows = spark.createDataFrame([(1, 0, "Juan Perez"), (1, 1, "JUAN PERES"), (1, 2, "Pedro Gil")], "case_id int, place int, value string")
    best = fusion.best_names(rows).head()
    assert best["value"] == "Juan Perez" and best["conflict"]


def test_clusters(spark):
    rows = spark.createDataFrame([(1, "t", "JUZGADO QUINTO", None), (2, "t", "Juzgado Quinto", "MX"), (3, "t", "Juzgado Qinto", None), (4, "t", "Tribunal Uno", "X"), (5, "u", "Juzgado Quinto", None)], "place long, type string, name string, region string")
    out = {(r["type"], r["seed"]): r for r in identity.survivors(identity.cluster_names(rows, 85)).collect()}
    assert {k: r["n"] for k, r in out.items()} == {("t", 1): 3, ("t", 4): 1, ("u", 5): 1}
    assert out[("t", 1)]["name"] == "Juzgado Quinto" and out[("t", 1)]["region"] == "MX"


@pytest.mark.parametrize("expression, out", [("ToUpper()", "ABC"), ("PadLeft(5,0)", "00abc"), ("PadLeft(2,0)", "abc"), ("Substring(1,2)", "bc"), ("Substring(9,2)", "abc"), ("Replace(b,X) | PadRight(5,*)", "aXc**"), ("Trim()", "abc")])
def test_transform(spark, expression, out):
    assert one(spark, templates.transform(F.col("v"), expression), v="abc") == out


@pytest.mark.parametrize("rule, value, ok", [("Required", " ", False), ("Regex:^a", "abc", True), ("Range:1,5", "7", False), ("MinLength:4", "abc", False), ("MaxLength:3", "abc", True), ("EmailAddress", "a@b.c", True), ("EmailAddress", "ab", False)])
def test_rule(spark, rule, value, ok):
    assert one(spark, templates.rule(F.col("v"), rule), v=value) is ok


def test_configuration(spark):
    given = {"language": F.lit("spa"), "confidence": F.lit(1.5), "max_concurrency": F.lit(64), "max_retries": F.lit(-1), "oem": F.lit(4), "psm": F.lit(13), "timeout_seconds": F.lit(3601), "batch_size": F.lit(101)}
    out = spark.range(1).select(templates.configuration_problems(given).alias("o")).head()["o"]
    assert out["errors"] == ["oem", "confidence", "timeout_seconds", "max_retries"] and out["warnings"] == ["confidence", "max_concurrency", "batch_size"]
    assert spark.range(1).select(templates.configuration_problems({"language": F.lit(" ")})["errors"]).head()[0] == ["language"]


def test_xml(spark):
    out = one(spark, exports.case_xml({"A": F.col("a"), "B": F.lit(" ")}), a="x")
    assert "<A>x</A>" in out and "<B>" not in out


@pytest.mark.parametrize("content, name, kind", [(b"%PDF-1.4", "x", "pdf"), (b"PK\x03\x04....word/document.xml", "x", "docx"), (b"PK\x03\x04....", "x", "zip"), (b"  <a/>", "x", "xml"), (b"zzz", "a.DOCX", "docx"), (b"zzz", "a", None)])
def test_file_format(spark, content, name, kind):
    row = spark.createDataFrame([(bytearray(content), name)], "c binary, n string")
    assert row.select(cases.file_format(F.col("c"), F.col("n"))).head()[0] == kind


def test_drift(spark):
    rows = spark.createDataFrame([("a", 1)], "caseNumber string, extra int")
    m = [templates.Mapping("case_number", "n", 1, required=True), templates.Mapping("zzz", "z", 2, required=True)]
    assert templates.drift(rows, m)["severity"] == "High"


def test_write_report(spark, tmp_path):
    rows = spark.createDataFrame([(2, 'a "b"'), (1, "c,d")], "k int, v string")
    exports.write_report(rows, f"{tmp_path}/r", "csv", "k")
    assert [r["v"] for r in spark.read.option("header", True).option("escape", '"').csv(f"{tmp_path}/r").orderBy("k").collect()] == ["c,d", 'a "b"']


def test_manifest_and_files(spark, tmp_path):
    (tmp_path / "c1").mkdir()
    (tmp_path / "c1" / "a.pdf").write_bytes(b"%PDF")
    (tmp_path / "m.json").write_text('{"case_id": "C1", "formats": ["pdf"]}\n')
    assert cases.files(spark, f"{tmp_path}/c1").select("size").head()[0] == 4
    assert cases.manifest(spark, f"{tmp_path}/m.json").head()["formats"] == ["pdf"]
    assert cases.text_layer(cases.files(spark, f"{tmp_path}/c1"), lambda b: b.decode()).head()["text"] == "%PDF"
