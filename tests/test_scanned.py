"""Scanned pages, statements and images against known values and loops."""

import math
import random

import pytest
from pyspark.sql import functions as F

from sparcase.functions import pixels
from sparcase.functions import statements as T
from sparcase.sources import cases


def fields(spark, text, rules):
    f = T.scanned_fields(F.col("t"), rules)
    return spark.createDataFrame([(text,)], "t string").select(*(c.alias(n) for n, c in f.items())).head().asDict()


def test_scanned_fields(spark):
    text = "OFICIO 12/A\nFecha: 05/06/2024\nexp. 77-B\nBanco Azteca contra CONDUSEF $ ,\n$1,200.5 MXN 7\nresolucion"
    got = fields(spark, text, T.LINEWISE)
    assert (got["number"], got["date"], got["authority"], got["kind"], got["amount"], got["currency"]) == ("12/A", "05/06/2024", "CONDUSEF", "OFICIO", 1200.5, "MXN")
    got = fields(spark, text, T.WHOLE)
    assert (got["number"], got["kind"], got["amount"], got["entities"]) == ("77-B", "OFICIO", 7.0, ["BANCO AZTECA"])
    got = fields(spark, "Expediente 1/A\nEXPEDIENTE: 2/B", T.BRIEF)
    assert (got["number"], got["amount"], got["kind"]) == ("2/B", None, None)
    assert set(map(str, fields(spark, None, T.WHOLE).values())) == {"None", "[]"}


def test_statement(spark):
    text = "HSBC\nNOMBRE: ANA Ñ.\n1234 5678 9012 3456\n05/06/2024 x , $ 12.50 y 3.00\n2024-06-05 1,000\nsin fecha 5.00\n5 junio 2024 nada\n"
    row = spark.createDataFrame([(text,)], "t string").select(T.account_info(F.col("t")).alias("i"), T.transactions(F.col("t")).alias("r")).head()
    assert tuple(row["i"]) == ("ANA Ñ", "1234 5678 9012 3456", "HSBC")
    assert [(r["date"], r["amount"]) for r in row["r"]] == [("05/06/2024", 12.5), ("2024-06-05", 6.0), ("5 junio 2024", 5.0)]
    empty = spark.createDataFrame([(None,)], "t string").select(T.account_info(F.col("t")).alias("i"), T.transactions(F.col("t")).alias("r"), T.content_checks(F.col("t")).alias("c")).head()
    assert tuple(empty["i"]) == (None, None, None) and empty["r"] == [] and empty["c"]["completeness"] == 0.0 and len(empty["c"]["missing"]) == 5


def slow_metrics(image):
    h, w = len(image), len(image[0])

    def at(i, j):
        mirror = lambda k, n: 0 if n == 1 else (-k if k < 0 else 2 * n - 2 - k if k >= n else k)
        return image[mirror(i, h)][mirror(j, w)]

    cells = [(i, j) for i in range(h) for j in range(w)]
    lap = [at(i - 1, j) + at(i + 1, j) + at(i, j - 1) + at(i, j + 1) - 4 * at(i, j) for i, j in cells]
    line = [math.exp(-(k**2) / (2 * 1.1**2)) for k in range(-2, 3)]
    total = sum(line) ** 2
    diff = [abs(at(i, j) - round(sum(line[a + 2] * line[b + 2] * at(i + a, j + b) for a in range(-2, 3) for b in range(-2, 3)) / total)) for i, j in cells]
    side = (1, 2, 1)
    slope = [math.hypot(sum(side[a + 1] * (at(i + a, j + 1) - at(i + a, j - 1)) for a in (-1, 0, 1)), sum(side[b + 1] * (at(i + 1, j + b) - at(i - 1, j + b)) for b in (-1, 0, 1))) for i, j in cells]
    flat = [at(i, j) for i, j in cells]
    mean = lambda x: sum(x) / len(x)
    var = lambda x: mean([(v - mean(x)) ** 2 for v in x])
    return [var(lap), math.sqrt(var(diff)), min(1, math.sqrt(var(flat)) / 127.5), min(1, mean(slope) / 50), math.sqrt(var(flat)), mean(list(map(abs, lap))), slow_edges(image) / (h * w)]


def slow_edges(image):
    h, w = len(image), len(image[0])
    px = lambda i, j: image[min(max(i, 0), h - 1)][min(max(j, 0), w - 1)]
    gx = {(i, j): sum((1, 2, 1)[a + 1] * (px(i + a, j + 1) - px(i + a, j - 1)) for a in (-1, 0, 1)) for i in range(h) for j in range(w)}
    gy = {(i, j): sum((1, 2, 1)[b + 1] * (px(i + 1, j + b) - px(i - 1, j + b)) for b in (-1, 0, 1)) for i in range(h) for j in range(w)}
    m = {k: abs(gx[k]) + abs(gy[k]) for k in gx}
    crest = set()
    for (i, j), v in m.items():
        x, y = gx[i, j], gy[i, j]
        angle = math.degrees(math.atan2(abs(y), abs(x)))
        if angle < 22.5:
            di, dj, equal = 0, 1, True
        elif angle > 67.5:
            di, dj, equal = 1, 0, True
        else:
            di, dj, equal = 1, 1 if (x < 0) == (y < 0) else -1, False
        a, b = m.get((i - di, j - dj), 0), m.get((i + di, j + dj), 0)
        if v > 100 and v > a and (v >= b if equal else v > b):
            crest.add((i, j))
    todo = [k for k in crest if m[k] > 200]
    found = set(todo)
    while todo:
        i, j = todo.pop()
        for a in (-1, 0, 1):
            for b in (-1, 0, 1):
                k = (i + a, j + b)
                if k in crest and k not in found:
                    found.add(k)
                    todo.append(k)
    return len(found)


def test_pixels(spark):
    rng = random.Random(2)
    rows, want = [(0, None), (1, b"\x89PNG"), (2, b"P5 9 9 255\nshort"), (3, b"P5 0 0 255\n")], {}
    for k, (w, h) in enumerate(((8, 8), (5, 12), (3, 3), (20, 7))):
        image = [[rng.randrange(256) for _ in range(w)] for _ in range(h)]
        rows.append((10 + k, b"P5\n# a remark\n%d %d\n255\n" % (w, h) + bytes(v for line in image for v in line)))
        want[10 + k] = (w, h, slow_metrics(image))
    for k, step in enumerate((12, 30)):  # a soft disc, whose edge is partly weak
        image = [[max(0, min(255, round(128 + step * (6 - math.hypot(i - 9, j - 10))))) for j in range(22)] for i in range(20)]
        rows.append((30 + k, b"P5 22 20 255\n" + bytes(v for line in image for v in line)))
        want[30 + k] = (22, 20, slow_metrics(image))
    assert want[31][2][-1] > 0
    rows.append((20, b"P6 2 1 255\n" + bytes([255, 0, 0, 0, 0, 255])))
    got = {r["k"]: r["m"] for r in spark.createDataFrame([(k, None if c is None else bytearray(c)) for k, c in rows], "k int, c binary").select("k", pixels.pixel_metrics(F.col("c")).alias("m")).collect()}
    for k, (w, h, m) in want.items():
        assert (got[k]["width"], got[k]["height"]) == (w, h) and [got[k][n] for n in pixels.METRICS] == pytest.approx(m)
    assert all(got[k]["width"] is None for k in range(4)) and got[20]["spread"] == pytest.approx((76 - 29) / 2)


def test_folders(spark, tmp_path):
    cases.put(spark, f"{tmp_path}", {"a/1.pdf": b"x", "a/2.XML": b"y", "b/c/3.xml": b"z", "d/4.Png": b"12"})
    assert {r["key"]: (r["n"], r["formats"]) for r in cases.discover(spark, f"{tmp_path}").collect()} == {"a": (1, ["pdf"]), "c": (1, ["xml"])}
    assert sorted(r["size"] for r in cases.images(spark, f"{tmp_path}").collect()) == [1, 2]
