"""Queries that once read a part of their input, against brute force on small tables."""

import random
import re

from pyspark.sql import functions as F

from sparcase.catalog import QUERIES
from sparcase.functions import normalize as N
from sparcase.functions import sequence
from sparcase.functions import similarity as S
from sparcase.operators import identity, manifest
from sparcase.plans import inputs
from sparcase.plans import text as text_plans


def plain_upper(t):
    return re.sub(r"\s+", " ", t, flags=re.ASCII).strip(" ").upper()


def test_names_and_truth_of_whole_texts(spark, tmp_path):
    rows = [(1, "en", "a  b\n" * 80 + "Último — fin – ñ"), (2, "es", "corto  año — x"), (3, None, "straße " * 60 + "ende"), (4, "de", None), (5, "en", "")]
    spark.createDataFrame(rows, "doc_id long, lang string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    names = {r["doc_id"]: r["name"] for r in QUERIES["san07_name"](spark, str(tmp_path)).collect()}
    truths = {r["doc_id"]: r["text"] for r in QUERIES["san10_truth"](spark, str(tmp_path)).collect()}
    bare = str.maketrans(N.ACCENTED, N.PLAIN)
    assert names == {i: t if t is None else plain_upper(t).translate(bare) for i, _, t in rows}
    assert truths == {i: t if t is None else plain_upper(t).translate(str.maketrans("–—", "--")) for i, _, t in rows}


def slow_window(phrase, text, threshold):
    phrase, words, best = phrase.upper(), text.upper().split(), None
    for size in range(max(1, len(phrase.split()) - 1), len(phrase.split()) + 3):
        for i in range(len(words) - size + 1):
            w = " ".join(words[i : i + size])
            row = [0] * (len(w) + 1)
            for x in phrase:
                row = [0, *row[1:]] if not w else row
                new = [0]
                for j, y in enumerate(w):
                    new.append(row[j] + 1 if x == y else max(row[j + 1], new[-1]))
                row = new
            score = int(200 * row[-1] / (len(w) + len(phrase)) + 0.5) / 100
            if score >= threshold and (best is None or score > best[0]):
                best = (score, i + 1, size)
    return best


def test_best_window_like_brute_force(spark):
    rng = random.Random(5)
    words = ["bloqueo", "bloqeo", "de", "d", "fondos", "fondo", "los", "x"]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randrange(14))) for _ in range(60)]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    for least in (0.5, 0.85):
        got = dict(rows.select("i", S.best_window(F.lit("bloqueo de fondos"), F.col("t"), least).alias("w")).collect())
        assert {i: w and tuple(w) for i, w in got.items()} == {i: slow_window("bloqueo de fondos", t, least) for i, t in enumerate(texts)}


def test_best_window_of_a_late_phrase(spark, monkeypatch):
    late = "x " * 50 + "bloqeo de fondos " + "y " * 50 + "bloqueo de fondos"
    notices = spark.createDataFrame([(1, late), (2, "nada"), (3, None)], "case_id long, text string")
    monkeypatch.setattr(inputs, "notices", lambda *_: notices)
    got = {r["case_id"]: (r["score"], r["start"], r["words"]) for r in text_plans.sim05_best_window(spark, "").collect()}
    assert got == {1: (1.0, 104, 3), 2: (None, None, None), 3: (None, None, None)}


def slow_clusters(names, threshold):
    """The seed's place of each (place, type, name), by comparing every name with every seed before it."""
    key = lambda n: " ".join(sorted(re.sub(r"[^A-Z0-9 ]", " ", n.upper()).split()))
    seeds, out = [], {}
    for place, kind, name in sorted(names):
        for p, k, other in seeds:
            a, b = key(name), key(other)
            total = len(a) + len(b)
            if k == kind and (a == b or (a and b and int(200 * sequence.common_length(a, b) / total + 0.5) >= threshold)):
                out[place] = p
                break
        else:
            seeds.append((place, kind, name))
            out[place] = place
    return out


def test_clusters_across_first_letters(spark):
    rows = [(1, "t", "1 JUZGADO QUINTO"), (2, "t", "2 Juzgado Quinto"), (3, "t", "JUZGADO QUINTO"), (4, "t", "EL JUZGADO QUINTO"), (5, "u", "EL JUZGADO QUINTO")]
    got = identity.cluster_names(spark.createDataFrame(rows, "place long, type string, name string"), 90)
    assert {r["place"]: r["seed"] for r in got.collect()} == {1: 1, 2: 1, 3: 1, 4: 1, 5: 5} == slow_clusters(rows, 90)


def test_clusters_like_brute_force(spark):
    rng = random.Random(8)
    words = ["JUZGADO", "Juzgdo", "QUINTO", "Qinto", "EL", "1", "2", "Tribunal", "de", "lo"]
    rows = [(i, rng.choice("tu"), " ".join(rng.choice(words) for _ in range(rng.randrange(5)))) for i in range(150)]
    df = spark.createDataFrame(rows, "place long, type string, name string")
    for threshold in (70, 90):
        for block in (1000, 9):
            got = {r["place"]: r["seed"] for r in identity.cluster_names(df, threshold, block=block).collect()}
            assert got == slow_clusters(rows, threshold)


def test_best_matches_of_any_size(spark):
    left = spark.createDataFrame([(f"name{i}",) for i in range(12)], "field string")
    right = spark.createDataFrame([(i, f"name{i % 20}x") for i in range(60)], "place long, name string")
    similarity = S.similarity(F.col("field"), F.col("name"))
    got = [sorted(map(tuple, manifest.best_matches(left, right, similarity, "field", short=short).select("field", "best.place", "score").collect())) for short in (100, 7)]
    assert got[0] == got[1] == sorted((f"name{i}", i, 1 - 1 / (5 + len(str(i)))) for i in range(12))
