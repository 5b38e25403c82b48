"""Deduplication over shards: ids that cluster, documents without an id, many shards and few quantiles."""

import hashlib
import random
import re

import numpy as np
import pytest

from relops.llm import shards
from relops.llm.substring_dedup import remove_repeated_windows
from relops.llm.suffix_dedup import remove_repeated_bytes

SPACED = "[^\x20\x09-\x0d]+"


def removed(rows, units, window):
    """For each row which units go: covered by a window that also starts in a row of a smaller id; no id is smaller than none."""

    first = {}
    cut = [units(text) for _, text in rows]
    for (doc, _), sequence in zip(rows, cut):
        for i in range(len(sequence) - window + 1):
            key = sequence[i : i + window]
            if doc is not None:
                first[key] = min(first.get(key, doc), doc)
    out = []
    for (doc, _), sequence in zip(rows, cut):
        gone = np.zeros(len(sequence), bool)
        for i in range(len(sequence) - window + 1):
            least = first.get(sequence[i : i + window])
            if least is not None and (doc is None or least < doc):
                gone[i : i + window] = True
        out.append([u for u, g in zip(sequence, gone) if not g])
    return out


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(11)
    vocabulary = ["".join(rng.choices("abcdefé", k=rng.randint(2, 7))) for _ in range(400)]
    make = lambda n: " ".join(rng.choices(vocabulary, k=n))
    passages = [make(60) for _ in range(3)]
    ids = [rng.choice([i, 10**15 + i, -(10**12) - i]) for i in range(60)] + [None] * 25
    out = []
    for number, doc in enumerate(ids):
        parts = [make(rng.randint(0, 60))]
        if number % 3 == 0:
            parts.insert(rng.randint(0, 1), rng.choice(passages))
        out.append((doc, " ".join(parts)))
    return out + [(None, out[70][1]), (None, None), (5 * 10**9, None), (None, ""), (out[3][0], out[0][1])]


@pytest.mark.parametrize("quantiles", [1000, 2])
@pytest.mark.parametrize("shard_bytes", [1 << 22, 900])
def test_removal(spark, rows, monkeypatch, quantiles, shard_bytes):
    monkeypatch.setattr(shards, "QUANTILES", quantiles)
    monkeypatch.setattr(shards, "BUCKET_KEYS", 300)
    frame = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, shard string, range int").repartition(5)
    words = removed(rows, lambda t: tuple(re.findall(SPACED, t or "")), 50)
    got = remove_repeated_windows(frame, shard_bytes=shard_bytes).collect()
    key = lambda r: (str(r["doc_id"]), r["n_words"], r["n_removed"], r["kept_text"])
    want = [(str(d), len(re.findall(SPACED, t or "")), len(re.findall(SPACED, t or "")) - len(k), " ".join(k)) for (d, t), k in zip(rows, words)]
    assert sorted(map(key, got)) == sorted(want)
    assert sum(w[2] for w in want) > 500
    kept = removed(rows, lambda t: (t or "").encode(), 50)
    got = remove_repeated_bytes(frame, shard_bytes=shard_bytes).collect()
    assert sorted((str(r["doc_id"]), hashlib.sha256(r["kept"]).hexdigest()) for r in got) == sorted((str(d), hashlib.sha256(bytes(k)).hexdigest()) for (d, _), k in zip(rows, kept))


def test_shards_are_even_however_ids_cluster(spark, monkeypatch):
    """Half of the ids in one narrow range: no shard holds much more than its share, and shards ascend with ids."""

    monkeypatch.setattr(shards, "QUANTILES", 4)
    ids = [*range(1000), *(10**15 + i * 10**9 for i in range(1000)), *[None] * 500]
    frame = spark.createDataFrame([(i, "x" * 100) for i in ids], "doc_id long, text string")
    rows, total = shards.sharded(frame, "doc_id", "text", 5000)
    got = [(r["shard"], r["id"]) for r in rows.collect()]
    sizes = {}
    for shard, _ in got:
        sizes[shard] = sizes.get(shard, 0) + 100
    with_id = sorted((i, s) for s, i in got if i is not None)
    assert total == 250_000 and [s for _, s in with_id] == sorted(s for _, s in with_id)
    assert max(size for s, size in sizes.items() if s < shards.NO_ID_SHARD) <= 12_000 and len(sizes) > 30
    assert all((i is None) == (s >= shards.NO_ID_SHARD) for s, i in got)
