"""Models of the pipeline are fitted on every labelled row, not on some of them."""

import random

import corpus_pipeline
import numpy as np
import pyarrow as pa
import pytest
from pyspark.ml.classification import RandomForestClassifier
from pyspark.sql import functions as F

from relops.llm import language_id
from relops.llm.language_id import ORDER, PARTS, _entropies, _grams, _medians, _points, identify, train, train_on_all
from relops.llm.secrets import FEATURES, train_forest


def test_languages_are_learned_from_every_document(spark):
    rng = random.Random(3)
    rows = [(i, "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=12)), "en") for i in range(4000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = train(docs, "doc_id", "text", "lang")
    counted = docs.filter(F.pmod(F.xxhash64(F.col("doc_id").cast("string"), F.lit("part")), F.lit(5)) > 0)
    texts = pa.array([r["text"] for r in counted.collect()], pa.string())
    assert len(texts) > 3100
    grams, contexts, _ = _grams(*_points(texts, 0, len(texts)), ORDER)
    for n in range(ORDER):
        assert np.isin(grams[n], model.hashes[n]).all() and np.isin(contexts[n], model.contexts[n]).all() == (n > 0)


def test_pipeline_counts_every_labelled_document(spark, monkeypatch):
    rng = random.Random(11)
    texts = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=40)) for _ in range(300)]
    rows = [(None if i % 10 == 0 else i // 2, text, ("en", "de")[i % 2]) for i, text in enumerate(texts)]
    rows += [(7, None, "en"), (8, "no label", None), (None, "", "de"), (9, "abc", "de")]
    models = []
    monkeypatch.setattr(corpus_pipeline, "identify", lambda docs, model, **options: models.append(model) or identify(docs, model, **options))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    corpus_pipeline.keep_known_languages(spark, docs, "")
    (model,) = models
    grams, contexts, _ = _grams(*_points(pa.array(texts, pa.string()), 0, len(texts)), ORDER)
    for n in range(ORDER):
        assert np.isin(grams[n], model.hashes[n]).all() and np.isin(contexts[n], model.contexts[n]).all() == (n > 0)


def test_every_document_calibrates_by_models_of_the_other_parts(spark, monkeypatch):
    rng = random.Random(13)
    words = {x: ["".join(rng.choices(letters, k=6)) for _ in range(60)] for x, letters in (("en", "abcdefghijklmnop"), ("de", "klmnopqrstuvwxyz"))}
    rows = [(" ".join(rng.choices(words[x], k=rng.randint(1, 30))), x) for i in range(90) for x in [("en", "de")[i % 2]]]
    # Of one text only, so no other part knows its language.
    rows += [("κείμενο " * 4, "el")] * 7
    docs = spark.createDataFrame(rows, "text string, lang string")
    place = docs.withColumn("part", F.pmod(F.xxhash64("text", F.lit("part")), F.lit(PARTS)))
    model = train_on_all(docs, "text", "lang")
    own = {x: [] for x in ("de", "en")}
    with monkeypatch.context() as patch:
        patch.setattr(language_id, "_calibrate", lambda *_: None)
        for part in range(PARTS):
            rest = train_on_all(place.filter(F.col("part") != part), "text", "lang")
            apart = place.filter((F.col("part") == part) & (F.col("lang") != "el")).collect()
            mean, count = _entropies(rest, pa.array([r["text"] for r in apart], pa.string()))
            for r, values, places in zip(apart, mean, count):
                own[r["lang"]].append((values[rest.languages.index(r["lang"])], places))
    assert model.languages == ["de", "el", "en"] and sum(map(len, own.values())) == 90
    for lang, found in own.items():
        values, places = map(np.array, zip(*found))
        centre = np.median(values)
        spread = 1.4826 * np.median(np.abs(values - centre) * np.sqrt(np.minimum(places, 400)))
        at = model.languages.index(lang)
        assert (model.centre[at], model.spread[at]) == (pytest.approx(centre), pytest.approx(spread))
    assert np.isinf(model.spread[1])
    assert not train_on_all(docs.filter("lang is null"), "text", "lang").languages


def test_folded_models_hold_every_text_in_bounded_memory(spark):
    rng = random.Random(5)
    words = {x: ["".join(rng.choices(letters, k=6)) for _ in range(300)] for x, letters in (("en", "abcdefghijklmnop"), ("de", "klmnopqrstuvwxyz"))}
    rows = [(i, " ".join(rng.choices(words[x], k=30)), x) for i in range(400) for x in [("en", "de")[i % 2]]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    whole = train(docs, "doc_id", "text", "lang")
    most = 2048
    model = train(docs, "doc_id", "text", "lang", most_numbers=most)
    assert not any(whole.folds) and sum(s.size for s in whole.scores) > most
    assert any(model.folds) and not all(model.folds) and sum(s.size for s in model.scores) <= most
    got = {r["doc_id"]: r["lang_pred"] for r in identify(docs, model).collect()}
    assert np.mean([got[i] == x for i, _, x in rows]) >= 0.98


def test_medians_are_exact(spark):
    rng = random.Random(7)
    for sizes in ({"a": 1, "é": 6, "Z": 2, "日": 501}, {}):
        values = {lang: [round(rng.gauss(0, 1), 1) for _ in range(n)] for lang, n in sizes.items()}
        rows = [(lang, x, i) for lang, xs in values.items() for i, x in enumerate(xs)]
        got = _medians(spark.createDataFrame(rows, "lang string, value double, tie long").repartition(5))
        assert got == {lang: (pytest.approx(np.median(xs)), len(xs)) for lang, xs in values.items()}


def test_forest_is_fitted_on_every_finding(spark, monkeypatch):
    seen, fit = [], RandomForestClassifier.fit

    def counted(self, rows, *args):
        seen.append(rows.count())
        return fit(self, rows, *args)

    monkeypatch.setattr(RandomForestClassifier, "fit", counted)
    number = 20_500
    features = F.struct(*[(F.col("id") if name == "length" else F.col("id") % 2).cast("double").alias(name) for name in FEATURES])
    rows = spark.range(number).select(features.alias("features"), (F.col("id") % 2).cast("double").alias("label"))
    score = train_forest(rows.unionByName(rows), trees=2, depth=2)
    assert seen == [number]
    assert rows.select(score(F.col("features")).alias("s"), "label").filter("(s >= 0.5) <> (label = 1)").isEmpty()
