"""Language identification and quality: accuracy on rows that were held out, and odd rows."""

import numpy as np
from pyspark.sql import functions as F

import __spark_entry__ as entry
from merchgrid.llm import language_id, quality
from merchgrid.llm.vec import codes, grams, span_hashes, words

SF = "/root/testdata/sf0.001"


def test_languages_held_out(spark):
    out = entry.queries()["op10_language_id"](spark, SF).join(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang"), "doc_id")
    held = out.where("held_out")
    assert held.count() > 30 and held.where("lang_pred = lang").count() >= 0.95 * held.count()
    assert out.where("score < 0 or score > 1").count() == 0


def test_language_counts_equal_plain_naive_bayes(spark):
    rows = [("ab ba", "x"), ("ab", "x"), ("cc dd", "y"), (None, "y"), ("zz", None)]
    df = spark.createDataFrame(rows, "text string, lang string")
    model = language_id.fit(df, buckets=64)
    assert model.languages == ["x", "y"]
    counts = np.full((64, 2), 0.5)
    for t, lang in rows:
        if lang:
            for b in language_id.buckets_of(t or "", buckets=64):
                np.add.at(counts[:, model.languages.index(lang)], b, 1)
    assert np.allclose(model.logp, np.log(counts / counts.sum(0)))
    docs = spark.createDataFrame([(1, "ab ab", "q"), (2, None, "q"), (3, "12 !?", "q"), (4, "CC", "q"), (4, "CC", "q")], "doc_id long, text string, score string")
    got = [(r.doc_id, r.lang_pred) for r in language_id.identify(docs, model).orderBy("doc_id").collect()]
    assert got == [(1, "x"), (2, "und"), (3, "und"), (4, "y"), (4, "y")]
    assert language_id.identify(docs.limit(0), model).count() == 0
    assert {r.lang_pred for r in language_id.identify(docs, language_id.fit(df.limit(0))).collect()} == {"und"}


def test_windows_see_every_gram_once(monkeypatch):
    text = "Der Hund, die Katze; l'été à Genève 12 " * 40
    whole = np.sort(np.concatenate(list(language_id.buckets_of(text))))
    for w in (1, 2, 7, 64):
        monkeypatch.setattr(language_id, "WINDOW", w)
        assert np.array_equal(np.sort(np.concatenate(list(language_id.buckets_of(text)))), whole)


def test_quality_held_out(spark):
    sf = "/root/testdata/sf0.01"
    out = entry.queries()["op1_quality"](spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out")
    assert out.where("predicted = quality").count() >= 0.9 * out.count()


def test_quality_odd_rows(spark):
    docs = spark.createDataFrame([(1, "good text here", 1), (2, None, 0), (3, "", 1), (4, "x " * 300000, 0)], "doc_id long, text string, label int")
    model = quality.fit(docs)
    got = quality.score(docs.withColumn("score", F.lit("clash")), model).collect()
    assert len(got) == 4 and all(0 <= r.score <= 1 for r in got)
    assert [r.score for r in quality.score(docs, quality.fit(docs.limit(0))).collect()] == [0.5] * 4
    assert quality.score(docs.limit(0), model).count() == 0
    assert {round(r.score) for r in quality.score(docs, quality.fit(docs.where("label = 1"))).collect()} == {1}


def test_hashes_depend_on_content_only():
    x = codes("one two  one\ttwo")
    lo, hi = words(x)
    h = span_hashes(x, lo, hi)
    assert h[0] == h[2] and h[1] == h[3] and h[0] != h[1]
    assert len(grams(h, 2)) == 3 and grams(h, 2)[0] == grams(h, 2)[2] and len(grams(h, 5)) == 0
