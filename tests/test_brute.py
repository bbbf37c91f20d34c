"""Whole results of queries that have no SQL, against brute force on the smallest tables."""

import re
import unicodedata
from difflib import SequenceMatcher

import pytest

from sparcase.catalog import QUERIES
from sparcase.functions import extract as X
from sparcase.functions import validate as V
from sparcase.operators import semantic
from sparcase.plans import inputs, relational

from .test_whole import slow_clusters

SF = "/root/testdata/sf0.001"


def rows(spark, name):
    return [r.asDict() for r in QUERIES[name](spark, SF).collect()]


def column(spark, table, key, *columns):
    return {r[key]: tuple(r[c] for c in columns) for r in spark.read.parquet(f"{SF}/{table}.parquet").select(key, *columns).collect()}


def common(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[-1]))
        row = new
    return row[-1]


def ratio(a, b):
    if not a or not b:
        return 100 if a == b else 0
    return int(200 * common(a, b) / (len(a) + len(b)) + 0.5)


def token_sort(t):
    return " ".join(sorted(re.sub(r"[\W_]+", " ", t.lower()).split()))


def normal(t):
    t = re.sub(r"\s+", " ", t).strip().upper()
    return "".join(c for c in unicodedata.normalize("NFD", t) if not unicodedata.combining(c))


def score(a, b):
    x, y = normal(a), normal(b)
    return 1.0 if x == y else (ratio(x, y) + ratio(token_sort(x), token_sort(y))) / 200


def test_ratios(spark):
    s, c = column(spark, "supplier", "s_suppkey", "s_name"), column(spark, "customer", "c_custkey", "c_name")
    got = rows(spark, "sim03_04_ratios")
    assert len(got) == len(set(s) & set(c))
    for r in got:
        a, b = s[r["k"]][0], c[r["k"]][0]
        assert (r["ratio"], r["sorted"]) == (ratio(a, b), ratio(token_sort(a), token_sort(b))) and r["score"] == pytest.approx(score(a, b))


def test_sequence_match(spark):
    parts = column(spark, "part", "p_partkey", "p_name", "p_type")
    got = rows(spark, "sim11_sequence_match")
    assert len(got) == len(parts)
    for r in got:
        s = SequenceMatcher(None, *parts[r["p_partkey"]]).ratio()
        assert r["score"] == pytest.approx(s, abs=1e-6) and r["grade"] == ("exact" if s >= 0.9 else "partial" if s >= 0.5 else "none")


def test_names_match(spark):
    kinds = ["Juan Pérez", "Customer {}", None, "ABCD850101XY1", "$1,000", "maria lopez", "Ana-Lisa O'Hara", "2024-01-05", "Smith Jones"]
    names = column(spark, "customer", "c_custkey", "c_name")

    def is_name(t):
        letters = sum(c.isalpha() or c in " '-" for c in t) / len(t)
        return not any(re.search(p, t) for p in V.NO_NAME) and "/" not in t and "$" not in t and letters >= 0.8

    def hispanic(t):
        words = normal(t).lower().split()
        return bool(re.search("[áéíóúñÁÉÍÓÚÑ]", t)) or any(w in V.GIVEN_NAMES + V.SURNAMES or w.endswith(("ez", "es")) for w in words)

    got = rows(spark, "sim07_names_match")
    assert len(got) == len(names)
    for r in got:
        k = r["c_custkey"]
        t = kinds[k % 9].format(k) if kinds[k % 9] else names[k][0]
        x, y = normal(t), "JUAN PERES"
        assert r["same"] == (is_name(t) and (ratio(x, y) >= 85 if hispanic(t) else x == y)), t


def test_central_names(spark):
    names = column(spark, "customer", "c_custkey", "c_name")
    got = rows(spark, "fus13_names")
    assert len(got) == len(names)
    for r in got:
        n = names[r["case_id"]][0]
        some = [n, n.replace("Customer", "Custumer"), n]
        each = [sum(score(a, b) for b in some) for a in some]
        least = min(score(a, b) for a in some for b in some)
        assert r["value"] == some[each.index(max(each))] and r["agreement"] == pytest.approx(least, abs=1e-6)
        assert (r["conflict"], r["review"]) == (least < 0.80, least < 0.95)


def test_fuzzy_fusion(spark):
    names = column(spark, "customer", "c_custkey", "c_name")
    got = rows(spark, "fus04_fuzzy")
    assert len(got) == len(names)
    for r in got:
        n = names[r["case_id"]][0]
        other = n.replace("e", "a")
        if n.lower() == other.lower():
            want = (n, 2, None, 0.75)
        else:
            s = ratio(n, other) / 100  # the first pair; the same names of sources 1 and 3 make the second
            want = (n, 3, s, 0.75 * s) if s >= 0.85 else (n, 3, 1.0, 0.75)
        assert (r["value"], r["decision"]) == want[:2]
        assert r["similarity"] == (want[2] if want[2] is None else pytest.approx(want[2], abs=1e-6)) and r["confidence"] == pytest.approx(want[3], abs=1e-6)


def test_requirements(spark):
    texts = {r["case_id"]: r["text"] for r in inputs.notices(spark, SF).collect()}
    got = rows(spark, "ext28_requirements")
    assert len(got) == len(texts)

    def kind(whole):
        low = whole.lower()
        for name, words in (("desbloqueo", ("desbloqueo", "desbloquear")), ("bloqueo", ("bloqueo", "bloquear")), ("transferencia", ("transferencia", "transferir")), ("documentacion", ("documentación", "documento")), ("informacion", ("información", "informar"))):
            if any(w in low for w in words):
                return name
        return "general"

    for r in got:
        found = [(kind(m[0]), m[1].strip()) for p in X.REQUIREMENTS for m in re.finditer(p, texts[r["case_id"]])]
        found = [f for f in found if f[1]]
        known = sum(k != "general" for k, _ in found)
        want = min(100, 100 * known // len(found) + min(20, 2 * len(found))) if found else 0
        assert (r["n"], r["confidence"]) == (len(found), want)


def test_phrases(spark):
    """Each distinct opening of a notice by comparing all windows with all phrases."""
    texts = {r["case_id"]: r["text"] for r in inputs.notices(spark, SF).where("case_id < 60").collect()}
    got = {}
    for r in rows(spark, "cla14_15_semantic"):
        got.setdefault(r["case_id"], []).append((r["kind"], r["confidence"]))
    known = {}
    for i, t in texts.items():
        words, want = t.upper().split(), []
        for name, phrases in semantic.PHRASES.items():
            best = 0
            for p in phrases:
                up, n = p.upper(), len(p.split())
                for size in range(max(1, n - 1), n + 3):
                    for k in range(len(words) - size + 1):
                        w = " ".join(words[k : k + size])
                        if 2 * min(len(w), len(up)) / (len(w) + len(up)) >= 0.84:
                            if (up, w) not in known:
                                known[up, w] = ratio(up, w)
                            best = max(best, known[up, w])
            if best >= 85:
                want.append((name, best))
        assert sorted(got[i]) == sorted(want or [("Ignore", 50)]), t


def test_catalogue(spark):
    names = [tuple(r) for r in relational._catalogue(spark, SF).select("place", "type", "name", "region").collect()]
    seed = slow_clusters([n[:3] for n in names], 90)
    groups = {}
    for place, kind, name, region in sorted(names):
        groups.setdefault((kind, seed[place]), []).append((place, name, region))

    def quality(n):
        mixed = n != n.upper() and n != n.lower()
        return (5 if mixed else -10 if n == n.upper() else 0) + (10 if 20 <= len(n) <= 80 else -5 if len(n) > 80 else 0) - (5 if re.search("[0-9]+$", n) else 0)

    got = {(r["type"], r["seed"]): (r["name"], r["region"], r["n"]) for r in rows(spark, "idn10_11_catalogue")}
    assert set(got) == set(groups)
    for key, some in groups.items():
        best = max(some, key=lambda x: (quality(x[1]), len(x[1]), -x[0]))
        assert got[key] == (best[1], next((r for _, _, r in some if r is not None), None), len(some))
