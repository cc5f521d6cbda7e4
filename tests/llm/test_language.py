"""Language identification: held-out accuracy and defined cases."""

import numpy as np
from conftest import SF
from pyspark.sql import functions as F

from tracemill.llm import language


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = language.held_out_identified(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in got if r.held_out]
    assert len(got) == docs.count() and held
    assert sum(r.lang == r.lang_pred for r in held) >= 0.95 * len(held)
    assert all(0 <= r.score <= 1 for r in got)


def test_defined_cases(spark):
    rows = [(i, "der die das und ist nicht " * 5, "de", 1) for i in range(30)] + [(100 + i, "the and that is not of " * 5, "en", 1) for i in range(30)]
    rows += [(500, None, "de", 1), (501, "", "en", 1), (502, "12 34 !!", "en", 1), (None, "the and that", None, 1), (503, "x" * 300_000 + "\U0001f600 é", None, 1)]
    got = language.held_out_identified(spark.createDataFrame(rows, "doc_id long, text string, lang string, score int")).collect()
    by = {r.doc_id: r for r in got}
    assert len(got) == len(rows) and all((by[i].lang_pred, by[i].score) == ("und", 0.0) for i in (500, 501, 502))
    assert by[3].lang_pred == "de" and by[103].lang_pred == "en" and by[None].lang_pred == "en" and not by[None].held_out
    assert by[503].lang_pred in ("de", "en") and by[503].rejected


def test_nothing_to_learn(spark):
    df = spark.createDataFrame([(1, "some text", None)], "doc_id long, text string, lang string")
    assert [r.lang_pred for r in language.held_out_identified(df).collect()] == ["und"]
    assert language.held_out_identified(df.limit(0)).count() == 0


def test_sample_is_bounded(spark):
    df = spark.createDataFrame([(i, f"text {i}", "ab"[i % 3 == 0]) for i in range(3000)], "doc_id long, text string, lang string")
    got = language.sampled(language.taught(df), 100).groupBy("lang").count().collect()
    assert {r.lang: r["count"] for r in got} == {"a": 50, "b": 50}


def test_repeated_rows_teach_once(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang")
    one = docs.where("lang = 'fr' and crc32(cast(doc_id as string)) % 5 != 0").orderBy("doc_id").limit(1)
    more = docs.unionByName(one.crossJoin(spark.range(100_000).select(F.col("id").alias("copy"))).select("doc_id", "text", "lang"))
    once, many = language.trained(docs), language.trained(more)
    assert "fr" in many.langs and once.langs == many.langs
    for a, b in ((once.idf, many.idf), (once.centroids, many.centroids), (once.farthest, many.farthest)):
        assert np.allclose(a, b)


def test_statistics_cover_all_training_rows(spark):
    rows = [(i, " ".join(["abc", "bcd", "cde"][: 1 + i % 3]), "xy"[i % 2]) for i in range(400)] + [(400, "1 2", "x"), (401, None, "x"), (402, "abc", None), (None, "abc", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    known = language.taught(df)
    got, texts = language.document_frequencies(known)
    n, letters = language.counts([t for i, t, lang in rows if i is not None and t is not None and lang is not None])
    assert texts == 400 and (got == (n > 0).sum(0)).all()
    model = language.trained(df, sample=20, kept=0.9)
    near = language.vectors(n[:400], model.idf) @ model.centroids.T
    for lang in "xy":
        mine = near[[r[2] == lang for r in rows[:400]]][:, [x == lang for x in model.langs]].max(1)
        d = np.sort(1 - mine)
        far = {f for f, x in zip(model.farthest, model.langs) if x == lang}
        assert len(far) == 1 and (d <= max(far) + 1e-12).mean() >= 0.9
    assert len(model.langs) <= 8
