"""Chat formatting, hard negatives and collocations against brute force: nulls, ties, repeated rows, empty tables, clashing names."""

import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from relops.llm import chat
from relops.llm.collocations import mine_collocations
from relops.llm.counting_filters import ESCAPE, Packing, count, decode, encode, merge, slices
from relops.llm.hard_negatives import mine_hard_negatives

TEMPLATE = chat.Template()
RECORD = (
    "id long, prompt string, response string, system string, instruction string, input string, output string, "
    "messages array<struct<role:string,content:string,extra:int>>, conversations array<struct<from:string,value:string>>, "
    "turns string, formatted string, _written string, source string"
)


def record(i, **fields):
    names = [f.split()[0] for f in re.sub("<[^ ]*>", "", RECORD).split(", ")]
    return tuple([i, *[fields.get(n) for n in names[1:-4]], "t", "f", "w", "src"])


def test_layouts(spark):
    """Each record takes the layout that its filled fields fit, unknown fields aside; others keep their row."""

    rows = [
        record(1, prompt="p", response="r"),
        record(2, prompt="p", response="", system="s"),
        record(3, instruction="i", input="x", output="o"),
        record(4, instruction="i", output="o"),
        record(5, messages=[("user", "a", 1), (None, None, None), None, ("assistant", "b", None), ("human", "c", 2)]),
        record(6, conversations=[("human", "a"), ("gpt", None), ("tool", "c")]),
        record(7, prompt="p"),
        record(8, prompt="p", response="r", output="o"),
        record(9),
        record(10, messages=[]),
    ]
    frame = spark.createDataFrame(rows, RECORD)
    made = chat.format_chats(frame, keep=["id", "source", "turns", "_written", "formatted"])
    got = {r["id"]: r for r in made.collect()}
    turns = {i: (r["layout"], [tuple(t) for t in r["turns"]]) for i, r in got.items()}
    assert turns == {
        1: ("prompt_response", [("user", "p"), ("assistant", "r")]),
        2: ("prompt_response", [("system", "s"), ("user", "p"), ("assistant", "")]),
        3: ("instruction", [("user", "i\nx"), ("assistant", "o")]),
        4: ("instruction", [("user", "i"), ("assistant", "o")]),
        5: ("messages", [("user", "a"), ("", ""), ("", ""), ("assistant", "b"), ("human", "c")]),
        6: ("conversations", [("user", "a"), ("assistant", ""), ("tool", "c")]),
        7: (None, []),
        8: (None, []),
        9: (None, []),
        10: (None, []),
    }
    assert len({got[i]["fingerprint"] for i in (1, 2, 3, 4, 5, 6, 7, 8, 9)}) == 9 and got[9]["fingerprint"] == got[10]["fingerprint"]
    assert got[1]["source"] == "src" and got[7]["formatted"] == "" and got[1]["_written"] == "w"
    assert chat.format_chats(frame.limit(0)).count() == 0


def test_two_layouts_of_one_kind_are_refused(spark):
    twice = [*chat.LAYOUTS, chat.Layout("other", ("prompt", "response"))]
    with pytest.raises(ValueError, match="both claim"):
        chat.to_turns(spark.createDataFrame([], RECORD), twice)
    for bad in ({"open": "<|a<"}, {"close": "x"}, {"middle": "<|turn|>"}, {"escape": "ab"}, {"foreign": ("\\n",)}):
        with pytest.raises(ValueError):
            chat.Template(**bad)


def test_texts_come_back_whatever_they_hold(spark):
    """Any text and role can be read back, no text holds a control string, and the mask covers the learned texts alone."""

    rng = random.Random(3)
    bits = [*TEMPLATE.controls(), "\\", "<", "[", "|", "<|", "|>", "\n", "$1", "é", "😀", "word ", "\\E", "</", "INST]", "\x00", " "]
    made = lambda: "".join(rng.choices(bits, k=rng.randint(0, 9)))
    rows = [(i, [(rng.choice(["user", "assistant", made()]), made()) for _ in range(rng.randint(0, 6))]) for i in range(300)]
    rows += [(900, None), (901, [(None, None), ("assistant", None)]), (902, [("assistant", "x" * 300_000 + "<|end|>")])]
    frame = spark.createDataFrame(rows, f"id long, turns {chat.TURNS}")
    formatted = chat.format_turns(frame)
    back = formatted.select("id", "formatted", "loss_spans", chat.read_turns(F.col("formatted")).alias("back"), chat.learned_text(F.col("formatted"), F.col("loss_spans")).alias("learned"))
    for row in back.collect():
        turns = [(r or "", t or "") for r, t in dict(rows)[row["id"]] or []]
        assert [tuple(t) for t in row["back"]] == turns
        assert row["learned"] == "".join(t for r, t in turns if r == "assistant")
        spans = [row["formatted"][s["start"] : s["end"]] for s in row["loss_spans"]]
        assert len(spans) == sum(r == "assistant" for r, _ in turns)
        rest = row["formatted"]
        for mark in (TEMPLATE.open, TEMPLATE.middle, TEMPLATE.close):
            assert rest.count(mark) == len(turns)
            rest = rest.replace(mark, "\n\n")
        assert not any(control in piece for control in TEMPLATE.controls() for piece in [*spans, rest])


def test_rows_of_turns(spark):
    rows = [(1, 2, "assistant", "b"), (1, 1, "user", "a"), (1, 2, "assistant", "b"), (1, None, "system", None), (None, 0, None, "x"), (None, 0, "user", "x")]
    got = chat.rows_to_records(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    assert {r["conv_id"]: [tuple(m) for m in r["messages"]] for r in got} == {
        1: [("system", ""), ("user", "a"), ("assistant", "b"), ("assistant", "b")],
        None: [("", "x"), ("user", "x")],
    }


def test_chat_formatting_runs_without_python(spark):
    from relops.llm.queries import LLM_QUERIES

    plan = LLM_QUERIES["op12_chat_formatting"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def negatives(rows, anchors, positives=5, count=5, low=80, high=100):
    """All windows by hand: (anchor id, positive id, rank, negative id, scores) of rows (id, label, vector)."""

    usable = [(n, i, x, [int(np.floor(256 * float(c))) for c in v]) for n, (i, x, v) in enumerate(rows) if x is not None and v is not None and all(c is not None and np.isfinite(c) for c in v)]
    last = lambda i: (i is None, i or 0)
    out = []
    for n, i, label, v in usable:
        if i is None or not anchors(i):
            continue
        scored = [(sum(a * b for a, b in zip(v, w)), j, m, other) for m, j, other, w in usable if m != n]
        scored.sort(key=lambda s: (-s[0], last(s[1]), s[2]))
        for score, j, _, _ in [s for s in scored if s[3] == label][:positives]:
            fits = [s for s in scored if s[3] != label and low * score <= 100 * s[0] <= high * score]
            out += [(i, j, rank, k, score, s) for rank, (s, k, _, _) in enumerate(fits[:count], 1)]
    return sorted(out, key=str)


@pytest.mark.parametrize("cell", [1 << 18, 7])
@pytest.mark.parametrize("low, high", [(80, 100), (55, 93), (-50, 120)])
def test_hard_negatives(spark, cell, low, high):
    rng = np.random.default_rng(1)
    vectors = np.round(rng.normal(size=(90, 4)), 1)
    vectors[20:40] = vectors[0]
    rows = [(int(i), int(rng.integers(0, 3)), [float(c) for c in v]) for i, v in enumerate(vectors)]
    rows += [(3, 0, [1.0, 0.5, 0.0, 0.0]), (10, 1, rows[10][2]), (None, 1, rows[0][2]), (None, 2, rows[0][2]), (50, 1, [0.5, 0.25]), (60, 2, [])]
    rows += [(70, None, [1.0] * 4), (70, 1, None), (70, 1, [1.0, None, 0.0, 0.0]), (70, 1, [float("nan")] * 4), (70, 1, [float("inf")] * 4)]
    frame = spark.createDataFrame([(*r, 0, "x") for r in rows], "vec_id long, label int, embedding array<float>, row long, anchor string")
    floats = [(i, x, v and [None if c is None else float(np.float32(c)) for c in v]) for i, x, v in rows]
    want = negatives(floats, lambda i: i % 10 == 0, low=low, high=high)
    got = mine_hard_negatives(frame, F.col("vec_id") % 10 == 0, low_percent=low, high_percent=high, cell=cell)
    assert sorted([tuple(r) for r in got.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect()], key=str) == want
    assert len(want) > 50


def test_hard_negatives_of_little(spark):
    schema = "vec_id long, label int, embedding array<float>"
    anchor = F.col("vec_id") % 10 == 0
    assert mine_hard_negatives(spark.createDataFrame([], schema), anchor).count() == 0
    assert mine_hard_negatives(spark.createDataFrame([(0, 1, [1.0])], schema), anchor).count() == 0
    assert mine_hard_negatives(spark.createDataFrame([(1, 1, [1.0]), (2, 1, [1.0])], schema), anchor).count() == 0
    wide = spark.createDataFrame([(0, 1, [8e6, 1.0]), (1, 1, [8e6, 0.0]), (2, 2, [7e6, 0.0])], schema)
    row = mine_hard_negatives(wide, anchor).collect()[0]
    assert (row["positive_score"], row["negative_score"]) == ((256 * 8 * 10**6) ** 2, 256 * 256 * 56 * 10**12)


@pytest.mark.parametrize("words, bits", [(2, 1), (2, 17), (2, 42), (3, 1), (3, 9), (3, 21), (3, 22), (3, 33), (3, 42)])
def test_counting_filters_lose_nothing(words, bits):
    rng = np.random.default_rng(bits)
    packing = Packing(words, bits)
    ids = [rng.integers(0, min(1 << bits, 1 << 40), 4000) % (1 << bits) for _ in range(words)]
    for column in ids:
        column[:900] = column[0]
        column[900:1800] = column[900:1800] % 5
    high, low = packing.permute(*packing.pack(ids))
    want = Counter(zip(*[c.tolist() for c in ids]))
    counts = count(packing, high, low)
    cut = min(5, packing.high_bits)
    stored = [decode(packing, encode(packing, part, cut)) for _, part in slices(packing, counts, cut)]
    assert np.array_equal(np.concatenate([s.high for s in stored]), counts.high) and np.array_equal(np.concatenate([s.low for s in stored]), counts.low)
    assert np.array_equal(np.concatenate([s.times for s in stored]), counts.times) and counts.times.max() >= ESCAPE
    halves = [count(packing, high[a:b], low[a:b]) for a, b in ((0, 1500), (1500, 1500), (1500, 4000))]
    merged = merge(packing, halves)
    back = packing.unpack(*packing.restore(merged.high, merged.low))
    assert dict(zip(zip(*[c.tolist() for c in back]), merged.times.tolist())) == want


def collocations(rows, least, top, inside):
    f, n = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\x0a-\x0d]", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")):
            words = re.findall("[^\x20\x09]+", piece)
            n[lang] += len(words)
            for k in (1, 2, 3):
                for i in range(len(words) - k + 1):
                    f[lang, tuple(words[i : i + k])] += 1
    out = []
    for lang in n:
        found = []
        candidates = {g: a for (x, g), a in f.items() if x == lang and len(g) > 1 and a >= least}
        for g, a in candidates.items():
            score, _, left, right = min((1000000 * a * a // (f[lang, g[:k]] * f[lang, g[k:]]), k, f[lang, g[:k]], f[lang, g[k:]]) for k in range(1, len(g)))
            longer = [b for h, b in candidates.items() if len(h) > len(g) and g in (h[:-1], h[1:])]
            if not any(100 * b >= inside * a for b in longer):
                found.append((-score, -a, " ".join(g).encode(), left, right))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(found)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, n[lang], -score))
    return sorted(out)


@pytest.mark.parametrize("shard_bytes, top, inside", [(8 << 20, 2000, 50), (300, 7, 80)])
def test_collocations(spark, shard_bytes, top, inside, monkeypatch):
    rng = random.Random(2)
    vocabulary = ["The", "of", "É", "ñu", "x", " ", "a b", "\x00"] + ["".join(rng.choices("abcé", k=3)) for _ in range(10)]
    make = lambda n: "".join(rng.choice(vocabulary) + rng.choice([" ", " ", "\t ", " ", ", ", ".", "\n", "\x0b"]) for _ in range(n))
    rows = [(make(rng.randint(0, 120)), rng.choice(["en", "de", None, "und"])) for _ in range(120)]
    rows += [(None, "en"), ("", "fr"), (" .,", "fr"), ("one", "it"), *[("New York City is big", "en")] * 40, (make(5000), "en")]
    frame = spark.createDataFrame([(*r, "s", 1) for r in rows], "text string, lang string, shard string, word int")
    got = mine_collocations(frame, least=6, top=top, inside_percent=inside, shard_bytes=shard_bytes)
    names = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(tuple(r) for r in got.select(*names).collect()) == collocations(rows, 6, top, inside)
    assert mine_collocations(frame.limit(0)).count() == 0


def test_collocations_in_several_rounds(spark, monkeypatch):
    """With a small fan the filters go through several rounds of merging, and the counts are the same."""

    from relops.llm import collocations as module

    monkeypatch.setattr(module, "FAN_BITS", 2)
    rng = random.Random(9)
    rows = [(" ".join(rng.choices("abcdefgh", k=60)), "en") for _ in range(100)]
    frame = spark.createDataFrame(rows, "text string, lang string")
    got = module.mine_collocations(frame, least=3, shard_bytes=150)
    names = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(tuple(r) for r in got.select(*names).collect()) == collocations(rows, 3, 2000, 50)
