"""The pipeline and its queries on small tables."""

import json

import pytest

pytest.importorskip("public_tokenizers")

import __spark_entry__ as entry  # noqa: E402
import corpus_pipeline  # noqa: E402


def test_all_thirteen_are_registered():
    names = entry.queries()
    assert all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 14)) and "pipeline" in names


def save(spark, folder, docs, labels):
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, event_id int").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return str(folder)


def test_stages_keep_columns_and_drop_what_they_should(spark, tmp_path):
    words = ["alpha", "beta", "gamma", "delta", "epsilon", "zeta", "eta", "theta"]
    text = lambda i: " ".join(f"{words[(i * k) % 8]}{(i * 31 + k * 17) % 97}" for k in range(1, 60))
    docs = [(i, text(i), "en", "s", 1) for i in range(1, 40)] + [(100, text(1), "en", "s", 1), (101, None, "en", "s", 1), (102, "123 456", None, None, None)]
    sf = save(spark, tmp_path, docs, [(i, 1, 0) for i in range(1, 10)])
    table = spark.read.parquet(f"{sf}/documents.parquet")
    kept = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        table = stage(spark, table, sf)
        assert table.columns == ["doc_id", "text", "lang", "source", "event_id"]
        kept.append({r["doc_id"] for r in table.select("doc_id").collect()})
    assert 101 not in kept[0] and 102 not in kept[1] and 100 not in kept[2]
    assert kept[2] == set(range(1, 40))
    out = corpus_pipeline.run(spark, sf)
    assert {r["doc_id"] for r in out.select("doc_id").distinct().collect()} == kept[2]


def test_empty_tables(spark, tmp_path):
    sf = save(spark, tmp_path, [], [])
    assert corpus_pipeline.run(spark, sf).count() == 0


def test_held_out_languages(spark, sf):
    got = entry.queries()["op9_language_id"](spark, sf).join(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang"), "doc_id")
    rows = got.where("held_out AND lang IS NOT NULL AND lang_pred <> 'und'").selectExpr("avg(CAST(lang = lang_pred AS DOUBLE)) a").first()
    assert rows["a"] > 0.95


def test_quality_follows_the_labels(spark, sf):
    """On the second smallest tables: the smallest have too few labels for any word to tell."""
    sf = sf.replace("sf0.001", "sf0.01")
    got = entry.queries()["op8_quality_classifier"](spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id")
    shares = {(r[0], r[1]): r[2] for r in got.groupBy("quality", "toxic").agg({"selected": "max", "tail_probability": "avg"}).select("quality", "toxic", "avg(tail_probability)").collect()}
    assert shares[(1, 0)] > 0.8, json.dumps({str(k): v for k, v in shares.items()})
    assert shares[(0, 0)] < 0.5
