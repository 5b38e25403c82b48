"""Figures on rows the classifiers did not learn from, and the language models against explicit Kneser-Ney."""

import math
import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from relops.llm.language_id import DISCOUNT, ORDER, _entropies, train
from relops.llm.queries import LLM_QUERIES, held_out
from relops.llm.quality import judge_quality

SF_DIR = "/root/testdata/sf0.01"


def test_languages_of_held_out_documents(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet").filter(held_out() & F.col("lang").isNotNull()).select("doc_id", "lang")
    found = LLM_QUERIES["op3_language_id"](spark, SF_DIR).join(docs, "doc_id").filter("lang_pred <> 'und'").collect()
    assert len(found) > 150 and np.mean([r["lang"] == r["lang_pred"] for r in found]) >= 0.98


def test_quality_of_held_out_documents(spark):
    """Learned from even ids alone, the score ranks the odd ones nearly right."""

    docs, labels = (spark.read.parquet(f"{SF_DIR}/{n}.parquet") for n in ("documents", "labels"))
    scored = judge_quality(docs, labels.filter("doc_id % 2 = 0")).select("doc_id", "score")
    rows = scored.join(labels.filter("doc_id % 2 = 1 and quality is not null").select("doc_id", "quality"), "doc_id").collect()
    good, bad = ([r["score"] for r in rows if r["quality"] == q] for q in (1, 0))
    ranked = np.mean([(g > b) + 0.5 * (g == b) for g in good for b in bad])
    assert len(good) > 20 and len(bad) > 20 and ranked >= 0.9


def kneser_ney(texts):
    """Probability of a character after a context, written out: discounted counts, lower orders by continuation."""

    raw = [Counter() for _ in range(ORDER + 1)]
    for text in texts:
        for end in range(ORDER - 1, len(text)):
            for n in range(1, ORDER + 1):
                raw[n][text[end - n + 1 : end + 1]] += 1
    counts = [None] * (ORDER + 1)
    counts[ORDER] = raw[ORDER]
    for n in range(1, ORDER):
        before = defaultdict(set)
        for gram in raw[n + 1]:
            before[gram[1:]].add(gram[0])
        counts[n] = Counter({gram: len(kinds) for gram, kinds in before.items()})
    letters = len(raw[1])

    def probability(context, char, n=ORDER):
        if n == 1:
            total = sum(counts[1].values())
            kinds = sum(c > 0 for c in counts[1].values())
            return (max(counts[1][char] - DISCOUNT, 0) + DISCOUNT * kinds / (letters + 1)) / total
        context = context[-(n - 1) :]
        after = {g: c for g, c in counts[n].items() if g[:-1] == context}
        total = sum(after.values())
        shorter = probability(context, char, n - 1)
        if not total:
            return shorter
        return max(after.get(context + char, 0) - DISCOUNT, 0) / total + DISCOUNT * len(after) / total * shorter

    return probability


def test_models_are_kneser_ney(spark):
    rng = random.Random(12)
    words = ["the", "then", "hen", "tea", "eat", "ten", "net", "a"]
    texts = [" ".join(rng.choices(words, k=12)) for _ in range(60)]
    frame = spark.createDataFrame([(i, t, "en") for i, t in enumerate(texts)], "doc_id long, text string, lang string")
    part = frame.filter(F.pmod(F.xxhash64(F.col("doc_id").cast("string"), F.lit("part")), F.lit(5)) > 0)
    learned = [r["text"] for r in part.collect()]
    model = train(frame, "doc_id", "text", "lang")
    probability = kneser_ney(learned)
    for context in (" the", "ten ", "hen", "at e", "nnn", "a a"):
        for char in "thena ":
            text = context + char
            want = [-math.log2(probability(text[:i], text[i])) for i in range(ORDER - 1, len(text))]
            mean, count = _entropies(model, pa.array([text]))
            assert count[0] == len(want) or "  " in text
            if count[0] == len(want):
                assert mean[0, 0] == pytest.approx(np.mean(want), rel=1e-4), (text, want)


def test_entropies_do_not_depend_on_the_batch(spark):
    frame = spark.createDataFrame([(i, "the house with and thing " * 3, "en") for i in range(40)], "doc_id long, text string, lang string")
    model = train(frame, "doc_id", "text", "lang")
    texts = ["the house", None, " with  thing", "", "x", "Thing!"]
    together = _entropies(model, pa.array(texts))
    for i, text in enumerate(texts):
        alone = _entropies(model, pa.array([text], pa.string()))
        assert alone[1][0] == together[1][i] and alone[0][0] == pytest.approx(together[0][i], rel=1e-5)
