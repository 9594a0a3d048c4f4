"""Scores of languages: calibrated on documents that weren't learned from, low for unknown scripts, bounded examples."""

import zlib

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from fluvia.llm import language
from fluvia.llm.base import fold

SF = "/root/testdata/sf0.01"


def test_ambiguous_texts_are_the_doubtful_ones(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("lang IS NOT NULL")
    held = fold("doc_id", 3) == 1
    model = language.learn(docs, held)
    rows = docs.where(held).select("text", "lang").collect()
    right, flagged, scores = [], [], []
    for size in (4, 8, 20):
        pieces = [(r.text[at : at + size], r.lang) for r in rows for at in [zlib.crc32(r.text.encode()) % max(1, len(r.text) - size)]]
        pieces = [(t, y) for t, y in pieces if language.has_letter(t)]
        for (_, y), (guess, score, ambiguous) in zip(pieces, model.predict([t for t, _ in pieces]), strict=True):
            right.append(guess == y)
            flagged.append(ambiguous)
            scores.append(score)
    right, flagged, scores = np.array(right), np.array(flagged), np.array(scores)
    assert 20 < flagged.sum() < 0.1 * len(flagged)
    assert right[flagged].mean() < 0.6 < 0.9 < right[~flagged].mean()
    assert abs(scores.mean() - right.mean()) < 0.03  # a score of 0.9 is right nine times in ten
    whole = model.predict([r.text for r in rows])
    assert np.mean([x[0] == r.lang for x, r in zip(whole, rows, strict=True)]) > 0.99 and sum(x[2] for x in whole) < 0.01 * len(rows)


def test_unknown_scripts(spark):
    rows = [("the house and the garden are here " * 3, "en"), ("das haus und der garten sind hier " * 3, "de")] * 6
    model = language.fit(rows)
    for text in ("中文", "Привет мир", "中文 the"[:3] + " ни"):
        found = model.predict([text])[0]
        assert found[0] in ("de", "en") and found[1] < 0.5 and found[2]
    assert model.known("the GARDEN") == 1.0 and model.known("тhe") == 2 / 3 and model.known("12 3") == 0.0
    assert model.predict(["the house and the garden"])[0][::2] == ("en", False)


def test_learning_in_tasks_equals_learning_from_texts(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    held = fold("doc_id", 3) == 1
    one, two = language.learn(docs, held), language.fit(language.labelled_sample(docs, held))
    assert one.languages == two.languages and one.sharpness == two.sharpness
    assert np.array_equal(one.weights, two.weights) and np.array_equal(one.letters, two.letters)
    long = language.example("ab c" * 500_000, "en")
    assert sum(a.nbytes + b.nbytes for a, b in long.grams) < 10_000 and long.grams[0][1].sum() == 3 * (4 * 500_000 + 2)


def test_nothing_to_learn_from(spark):
    docs = spark.createDataFrame([(1, "some words", None), (2, "12", None), (3, None, None)], "doc_id long, text string, lang string")
    model = language.learn(docs, F.lit(False))
    assert model.languages == [] and {r.lang_pred for r in language.identify(docs, model).collect()} == {"und"}
    only = language.learn(docs.withColumn("lang", F.lit("en")), F.lit(False))
    assert [tuple(r)[1:] for r in language.identify(docs, only).orderBy("doc_id").collect()] == [("en", 1.0, False), ("und", 0.0, True), ("und", 0.0, True)]
    kept = corpus_pipeline.reject_unknown_language(spark, docs, SF)
    assert [r.doc_id for r in kept.collect()] == [1] and kept.columns == docs.columns
