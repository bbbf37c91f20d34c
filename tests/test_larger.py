"""What only larger tables or rare rows show."""

import itertools
import time

import pytest
from pyspark.sql import functions as F

from sparcase.catalog import ORACLES, QUERIES
from sparcase.functions import extract as X
from sparcase.functions.sequence import whole_ratio
from sparcase.operators import fusion, semantic
from sparcase.plans import inputs
from .compare import connect, difference

#: Two values of three observations each, alike in all but the value. Their means are equal; sums in doubles differ by order.
EQUAL = {"F": (0.92, 0.92, 0.98), "O": (0.98, 0.90, 0.94)}


def tied(spark):
    """A case for each order in which the confidences can be added up."""
    orders = {v: sorted(set(itertools.permutations(c))) for v, c in EQUAL.items()}
    rows = [(i, 1 if c == 0.98 else 2, "XML", v, c) for i, both in enumerate(itertools.product(*orders.values())) for v, cs in zip(EQUAL, both) for c in cs]
    return spark.createDataFrame(rows, "case_id long, place int, source string, value string, confidence double").coalesce(1)


def test_equal_means(spark):
    got = fusion.best_values(tied(spark)).collect()
    assert len(got) == 18 and {(r["value"], r["source"], round(r["confidence"], 9), r["agreement"], r["conflict"]) for r in got} == {("O", "XML", 0.47, 0.5, True)}


def test_equal_means_of_routed_fields(spark):
    got = fusion.match_fields(tied(spark).withColumn("field", F.lit("Estado"))).collect()
    assert len(got) == 18 and {(r["field"], r["value"], r["agreement"], r["conflict"]) for r in got} == {("Estado", "O", 0.5, True)}


#: Discounts of three lines each. Confidences, lead and decimal means are the same, but in doubles F's mean is the greater in every order.
ALMOST = {"F": (0.0, 0.02, 0.09), "O": (0.0, 0.04, 0.07)}


@pytest.mark.parametrize("name", ["fus11_policy", "fus14_router"])
def test_means_that_no_order_makes_equal(spark, tmp_path, name):
    orders = itertools.product(*(itertools.permutations(c) for c in ALMOST.values()))
    rows = [(i, 3 if c else 1, c, "A", v) for i, both in enumerate(orders) for v, cs in zip(ALMOST, both) for c in cs]
    spark.createDataFrame(rows, "l_orderkey long, l_linenumber int, l_discount double, l_returnflag string, l_linestatus string").coalesce(1).write.parquet(f"{tmp_path}/lineitem.parquet")
    assert difference(spark, connect(tmp_path), QUERIES[name], ORACLES[name], str(tmp_path)) == ""
    assert {r["value"] for r in QUERIES[name](spark, str(tmp_path)).collect()} == {"F"}


def test_sections_read_each_text_once(spark):
    plan = QUERIES["ext24_section"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("translate(") == 1 and plan.count("btrim(") <= 2


def test_sections_of_odd_texts(spark):
    texts = [None, "", "nada", "OFICIO", "rfc::", "x óficio: a ACUERDO b", "RFC 1 oficio 2 plazo", "acuerdo OFICIO\t plazo", "OFICIOACUERDO", " rfc \n: x\x0b", "RFCRFC PLAZO ACUERDO"]
    want = [(None, None), (None, None), (None, None), ("OFICIO", None), ("rfc::", None), ("óficio: a", "óficio: a"), ("RFC 1 oficio 2", "1 oficio 2"), ("OFICIO", None), ("OFICIO", None), ("rfc \n: x", ": x"), ("RFCRFC", "RFC")]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", X.sections(F.col("t"), ["OFICIO", "RFC"], ["ACUERDO", "PLAZO"]).alias("s"))
    assert [(r["s"]["whole"], r["s"]["body"]) for r in rows.orderBy("i").collect()] == want


def slow_scores(text):
    """Best scores of all windows with all phrases, none left out."""
    up, out = text.upper(), {}
    words = up.split()
    for p, phrase in enumerate(semantic._ALL):
        n = len(phrase.split())
        for size in range(max(1, n - 1), n + 3) if len(phrase) <= len(up) else ():
            for k in range(len(words) - size + 1):
                s = whole_ratio(phrase.upper(), " ".join(words[k : k + size])) / 100
                if s >= semantic.THRESHOLD:
                    out[p] = max(out.get(p, 0), s)
    return out


def test_phrases_of_many_texts(spark, monkeypatch):
    """Texts scored together, also in pieces of few words, against each on its own; and what a notice costs."""
    texts = [r["text"] for r in inputs.notices(spark, "/root/testdata/sf0.001").collect()]
    began = time.process_time()
    semantic.PhraseScores(semantic._ALL)(texts)
    assert (time.process_time() - began) / len(texts) < 400e-6  # one by one it took twice as long
    odd = ["", " \t", "giro", "x" * 400 + " girar fondos", "desbloqeo  de\ncuentas y giro bancari", "12,345.50 BLOQUEO DE LA CUENTA ß liberación fondos", "estados de\U0001f600 cuenta congelar recursos", "y " * 50 + "embargar cuentas"] + texts[:12]
    want = [slow_scores(t) for t in odd]
    reach = lambda found: [{p: s for p, s in f.items() if s >= semantic.THRESHOLD} for f in found]
    assert sum(map(bool, want)) > 5 and reach(semantic.PhraseScores(semantic._ALL)(odd)) == want
    monkeypatch.setattr(semantic, "WORDS", 3)
    assert reach(semantic.PhraseScores(semantic._ALL)(odd)) == want
