"""Quality rules: statistics of whole texts, and boosted trees over them trained from labelled documents."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from relops.columns import col
from relops.llm import bytewise as B
from relops.llm.boosted_trees import Forest, fit
from relops.llm.rowwise import annotate
from relops.staging import stage

REPEAT_WINDOW = 8
# Labelled rows the classifier is fitted on at most, drawn by a hash of the id.
SAMPLE_ROWS = 20_000
SHARES = 1 << 20
# Documents below this probability of good quality go.
THRESHOLD = 0.3

COUNTS = (
    "n_chars n_words word_chars n_symbols n_lines n_dup_lines n_repeat_words n_upper n_digits n_punct n_distinct_words n_long_words"
).split()
# What may only lower the score when it grows: symbols, repeated lines, repeated words.
CONSTRAINTS = [0, 0, -1, -1, -1, 0, 0, 0, 0, 0]

_SYMBOLS = np.zeros(256, bool)
_SYMBOLS[list(b"#*$%&|<>")] = True
_UPPER = np.zeros(256, bool)
_UPPER[0x41:0x5B] = True
_DIGITS = np.zeros(256, bool)
_DIGITS[0x30:0x3A] = True
_PUNCT = np.zeros(256, bool)
_PUNCT[list(b".,;:!?\"'()-")] = True
_LEADS = (np.arange(256) & 0xC0) != 0x80
LONG_WORD = 20


def text_counts(docs: DataFrame, text_col: str = "text", keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    """Counts over every whole text, as named in ``COUNTS``; a null or empty text has none of anything.

    Words are cut at ASCII white space; lines at line feeds, and only lines with a word count. ``n_dup_lines`` are
    lines equal to an earlier one of the text, ``n_repeat_words`` the words inside windows of eight words that occur
    twice or more in the text, first occurrences included, ``n_symbols`` the characters ``#*$%&|<>``.
    """

    def compute(texts: pa.Array) -> list[pa.Array]:
        data, offsets = B.text_bytes(texts)
        parts = [_counts(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]) for a, b in B.pieces(offsets)]
        table = np.concatenate(parts) if parts else np.zeros((0, len(COUNTS)), np.int64)
        return [pa.array(np.ascontiguousarray(table[:, i]), pa.int64()) for i in range(len(COUNTS))]

    return annotate(docs, text_col, compute, [(name, "bigint") for name in COUNTS], keep)


def _counts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    words = B.words_of(data, offsets, B.SPACED)
    leads = _LEADS[data]
    upto = np.concatenate([[0], np.cumsum(leads & B.SPACED[data])])
    lengths = upto[words.ends] - upto[words.starts]
    sums = np.concatenate([[0], np.cumsum(lengths)])
    opens, closes, first_line = B.cut(data, offsets, B.LINES)
    spoken = np.searchsorted(words.starts, closes) > np.searchsorted(words.starts, opens)
    line_doc = np.repeat(np.arange(len(offsets) - 1), np.diff(first_line))[spoken]
    lines = B.slice_hashes(B.byte_values(data), opens[spoken], closes[spoken])
    count = len(offsets) - 1
    n_lines = np.bincount(line_doc, minlength=count)
    fits = np.flatnonzero(words.whole(REPEAT_WINDOW))
    grams = B.gram_hashes(words.hashes, REPEAT_WINDOW)[fits]
    repeated = fits[_repeated(words.doc[fits], grams)]
    covered = B.cover(repeated, repeated + REPEAT_WINDOW, len(words.starts))
    columns = [
        B.per_document(leads, offsets),
        words.counts,
        sums[words.first[1:]] - sums[words.first[:-1]],
        B.per_document(_SYMBOLS[data], offsets),
        n_lines,
        n_lines - _kinds(line_doc, lines, count),
        B.per_document(covered, words.first),
        B.per_document(_UPPER[data], offsets),
        B.per_document(_DIGITS[data], offsets),
        B.per_document(_PUNCT[data], offsets),
        _kinds(words.doc, words.hashes, count),
        B.per_document(lengths >= LONG_WORD, words.first),
    ]
    return np.stack(columns, 1).astype(np.int64)


def _fresh(doc: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order by document and hash, and which places in it begin a new pair."""

    order = np.lexsort((hashes, doc))
    doc, hashes = doc[order], hashes[order]
    fresh = np.ones(len(doc), bool)
    fresh[1:] = (doc[1:] != doc[:-1]) | (hashes[1:] != hashes[:-1])
    return order, fresh


def _kinds(doc: np.ndarray, hashes: np.ndarray, count: int) -> np.ndarray:
    order, fresh = _fresh(doc, hashes)
    return np.bincount(doc[order[fresh]], minlength=count)


def _repeated(doc: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Which (document, hash) pairs occur more than once."""

    order, fresh = _fresh(doc, hashes)
    alone = fresh.copy()
    alone[:-1] &= fresh[1:]
    out = np.zeros(len(doc), bool)
    out[order] = ~alone
    return out


def features(counts: dict[str, np.ndarray]) -> np.ndarray:
    c = {name: values.astype(float) for name, values in counts.items()}
    words, chars, lines = np.maximum(c["n_words"], 1), np.maximum(c["n_chars"], 1), np.maximum(c["n_lines"], 1)
    return np.stack(
        [
            np.log1p(c["n_words"]),
            c["word_chars"] / words,
            c["n_symbols"] / chars,
            c["n_dup_lines"] / lines,
            c["n_repeat_words"] / words,
            c["n_upper"] / chars,
            c["n_digits"] / chars,
            c["n_punct"] / words,
            c["n_distinct_words"] / words,
            c["n_long_words"] / words,
        ],
        1,
    )


def train_quality(
    counted: DataFrame, labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality", sample_rows: int = SAMPLE_ROWS
) -> Forest:
    """Trees from the counts of at most ``sample_rows`` labelled documents (null labels and ids are left out)."""

    known = labels.filter(col(label_col).isNotNull()).select(col(id_col).alias("labelled"), col(label_col).cast("int").alias("label"))
    rows = stage(counted.join(known, counted[id_col] == known["labelled"]).select(id_col, "label", *COUNTS), "labelled")
    # A share of about twice the bound by a hash of the id is left to be sorted and cut to it.
    draw = F.pmod(F.xxhash64(col(id_col).cast("string")), F.lit(SHARES))
    share = -(-SHARES * 2 * sample_rows // max(rows.count(), 1))
    drawn = rows.filter(draw < share).orderBy(draw, col(id_col), *COUNTS).limit(sample_rows).toPandas()
    table = features({name: drawn[name].to_numpy() for name in COUNTS})
    return fit(table, drawn["label"].to_numpy().astype(float), CONSTRAINTS)


def base_failed(min_words: int = 20, most_repeated: int = 30):
    """The plain rules: too few words, or too many of them in repeated windows."""

    return (F.col("n_words") < min_words) | (F.col("n_repeat_words") * 100 > F.col("n_words") * most_repeated)


def judge_quality(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", threshold: float = THRESHOLD
) -> DataFrame:
    """Counts of every document, ``base_failed``, ``score`` (probability of good quality) and ``kept``.

    A document is kept unless the plain rules fail it or its score is below ``threshold``. The counts are written
    once and read for training and scoring, so texts are read once. Without labels every score is 1.
    """

    counted = stage(text_counts(docs, text_col, [id_col]), "counts")
    forest = counted.sparkSession.sparkContext.broadcast(train_quality(counted, labels, id_col, label_col))

    def score(batches):
        for batch in batches:
            rows = features({name: np.asarray(batch[name]) for name in COUNTS})
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(forest.value.probability(rows))], [*batch.schema.names, "score"])

    shape = T.StructType([*counted.schema.fields, T.StructField("score", T.DoubleType())])
    scored = counted.mapInArrow(score, shape)
    return scored.withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & (F.col("score") >= threshold))
