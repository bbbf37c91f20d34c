"""The pipeline stage by stage against brute-force versions."""

import hashlib

import corpus_pipeline
from sparcase.llm import near_dedup, quality_model, secret_scan
from sparcase.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    seen = [docs]
    for _, stage in corpus_pipeline.STAGES:
        seen.append(stage(spark, seen[-1], SF).cache())
    raw, good, exact, near, clean, packed = seen
    assert all(x.columns == raw.columns for x in seen[:-1])
    accepted = {r["doc_id"] for r in quality_model.quality_scores(raw, labels).where("score >= 0.7").collect()}
    assert {r["doc_id"] for r in good.collect()} == accepted
    largest = {}
    for r in good.collect():
        largest[r["text"]] = max(largest.get(r["text"], -1), r["doc_id"])
    assert {r["doc_id"] for r in exact.collect()} == set(largest.values())
    first = {r["class_id"] for r in near_dedup.near_dedup(exact).collect()}
    assert {r["doc_id"] for r in near.collect()} == first
    texts = {r["doc_id"]: r["text"] for r in near.collect()}
    for r in clean.collect():
        t = texts[r["doc_id"]]
        base = secret_scan.base_spans(t)
        assert r["text"] == secret_scan.redact(t, base + secret_scan.linked_spans(t, base)) and r["n_chars"] == len(r["text"])
    assert {r["doc_id"] for r in packed.collect()} == set(texts)


AWKWARD = "doc_id long, text string, lang string, source string, n_chars long, node string, kept boolean, _text string, comp string, score double"


def awkward(spark):
    """Nulls, empty and very long texts, ties, repeated rows and near copies, with columns whose names the stages use."""
    words = " ".join(f"w{i}" for i in range(60))
    texts = [None, None, "", "a", "a", words, words + " end", words, "token = abcdefgh1234", "x " * 100_000, "y" * 60_000, None]
    rows = [(i if i < 11 else None, t, None if i % 3 else "en", "s", len(t or ""), "n", True, "t", "c", 0.1) for i, t in enumerate(texts)]
    return spark.createDataFrame([*rows, rows[5], rows[5]], AWKWARD)


def test_awkward_stages(spark):
    rows = awkward(spark)
    columns = list(corpus_pipeline.COLUMNS)
    stages = dict(corpus_pipeline.STAGES)
    ids = lambda df: sorted((-1 if r["doc_id"] is None else r["doc_id"]) for r in df.collect())
    good = stages["quality"](spark, rows, SF)
    assert good.columns == columns and set(ids(good)) <= {-1, *range(11)}
    exact = stages["exact_duplicates"](spark, rows, SF)
    assert exact.columns == columns and ids(exact) == [2, 4, 6, 7, 8, 9, 10]
    near = stages["near_duplicates"](spark, rows, SF)
    assert near.columns == columns and ids(near) == [0, 3, 5, 8, 9, 10]
    clean = stages["secrets"](spark, rows, SF)
    assert clean.columns == columns and clean.count() == rows.count() and clean.where("doc_id = 8").head()["text"] == "[SECRET]"
    assert clean.where("text is null").count() == 3 and clean.where("text is not null and n_chars <> length(text)").count() == 0
    pieces = stages["packed"](spark, rows, SF)
    assert set(ids(pieces)) == {-1, *range(11)} and pieces.groupBy("doc_id").sum("length").where("doc_id = 2").head()[1] == 1


def test_empty_stages(spark):
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, spark.createDataFrame([], AWKWARD), SF)
        assert out.count() == 0 and (name == "packed" or out.columns == list(corpus_pipeline.COLUMNS)), name


def test_run(spark):
    assert corpus_pipeline.run(spark, SF).count() > 0


def test_rows_of_every_query(spark):
    n = {t: spark.read.parquet(f"{SF}/{t}.parquet").count() for t in ("documents", "pages")}
    for name, query in QUERIES.items():
        rows = query(spark, SF).count()
        assert rows >= n["documents"] if name.startswith("op3_") else rows == n["pages" if name.startswith("op7_") else "documents"], name


def test_exact_dedup_sql(spark):
    from sparcase.llm.queries import ORACLES
    from tests.compare import connect, difference

    for name, sql in ORACLES.items():
        assert difference(spark, connect(SF), QUERIES[name], sql, SF) == ""
    assert hashlib.sha256(b"").hexdigest().startswith("e3b0")
