"""From raw documents to a training mix: language, near duplicates, benchmark passages, secrets, source weights.

Each stage takes all that its predecessor kept, written as Parquet and read again, and returns the columns of
``documents``; the last returns the mix. No stage can be stated in SQL as a whole, so there is no oracle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from relops.llm.decontamination import contaminated, mark_benchmark
from relops.llm.jaccard_join import link_similar
from relops.llm.language_id import identify, train_on_all
from relops.llm.mixing import mix_sources
from relops.llm.queries import LLM_QUERIES, table
from relops.llm.rowwise import small_batches
from relops.llm.secrets import redact_secrets
from relops.staging import stage


# Names a row while near duplicates are looked for.
ROW_KEY = "__relops_row_key"


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the language models do not reject, by models learned from all labelled ones.

    A null text, or one without a letter, is rejected. Without any labelled document all are.
    """

    small_batches(spark)
    return identify(docs, train_on_all(docs, "text", "lang"), keep=docs.columns).filter(~F.col("rejected")).select(*docs.columns)


def keep_one_of_similar(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by a Jaccard similarity of 0.8 or more over five words, the one with the smallest id.

    A row is known by its id and its text: rows equal in both are one document, of which the first by its other
    columns stays, while rows of one id with texts that are not similar all stay. A document without an id goes where
    one with an id is linked with it; of those alone one stays. Documents without words are linked with nothing and
    all stay. An empty table stays empty.
    """

    small_batches(spark)
    key = F.xxhash64("doc_id", "text")
    linked = link_similar(docs.select(key.alias(ROW_KEY), "text"), id_col=ROW_KEY, shingle=5, percent=80)
    named = docs.select(key.alias("key"), "doc_id").distinct()
    linked = linked.filter("n_shingles > 0").select(F.col(ROW_KEY).alias("key"), "component_id").distinct()
    first = named.join(linked, "key").groupBy("component_id").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "key")).alias("first"))
    kept = first.select(F.col("first.key").alias("kept_key"))
    worded = F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    rows = docs.filter(worded).withColumn(ROW_KEY, key)
    rows = rows.join(kept, rows[ROW_KEY] == kept["kept_key"], "left_semi").groupBy(ROW_KEY)
    rows = rows.agg(F.min_by(F.struct(*docs.columns), F.struct(*others)).alias("row")).select("row.*")
    return rows.select(*docs.columns).unionByName(docs.filter(~worded))


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which less than a twentieth of the words stand in benchmark phrases, whole.

    A null or empty text stays; every row is judged on its own, whatever its id.
    """

    small_batches(spark)
    return mark_benchmark(docs, table(spark, sf_dir, "benchmark"), keep=docs.columns).filter(~contaminated()).select(*docs.columns)


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets in their texts masked; a null text stays null, equal rows are masked alike."""

    return redact_secrets(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """How often each document of the mix is taken; documents that are not taken at all are left out.

    A null text has no words, a null source is a source of its own; rows of one id are rounded each on its own.
    """

    small_batches(spark)
    return mix_sources(docs).filter("copies > 0")


STAGES = [
    ("language_id", keep_known_languages),
    ("ngram_jaccard_join", keep_one_of_similar),
    ("benchmark_decontamination", drop_benchmark),
    ("secret_scan", redact),
    ("source_mixing", mix),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""

    docs = table(spark, sf_dir, "documents")
    for name, apply in STAGES[:-1]:
        docs = stage(apply(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)


LLM_QUERIES["pipeline"] = run
