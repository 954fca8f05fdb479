"""A training corpus from raw documents: five stages, each one operator, each written and read again."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kindred.llm import langid, ngramjoin, packing, substrings, toxicity
from kindred.llm.shared import free_name, written

#: A text is rejected as toxic from this score on.
TOXIC = 0.5
#: A text is rejected if no language has at least this share of its bytes' labels, or if it has no letter.
LEAST_LANGUAGE = 0.4


#: Rows that go to a Python worker at once: texts can be long, and a worker's and a JVM's copies of a batch come on top of all else an executor holds.
ROWS = 1000


def small_batches(spark: SparkSession) -> None:
    """The pipeline's own session setting, for its stages' results are computed after they have returned; operators alone leave settings as they are. A smaller one stays."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= ROWS:
        spark.conf.set(key, str(ROWS))


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, trained on the labels of these documents, doesn't find toxic."""
    small_batches(spark)
    model, score = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")), free_name(docs.columns, "score")
    return toxicity.with_scores(docs, model, score).where(F.col(score) < TOXIC).drop(score)


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in an identified language."""
    small_batches(spark)
    language, share = (free_name(docs.columns, x) for x in ("language", "share"))
    found = langid.with_languages(docs, langid.fit(docs), language, share)
    return found.where((F.col(language) != langid.UNKNOWN) & (F.col(share) >= LEAST_LANGUAGE)).drop(language, share)


def ngram_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the least id, of each group of near-duplicates. Rows without words or id stay."""
    small_batches(spark)
    return ngramjoin.without_near_duplicates(docs)


def substring_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages that also stand earlier; ``n_chars`` follows the text."""
    small_batches(spark)
    done = substrings.without_repeats(docs, counts=None)
    return done.select(*(F.length("text").cast("long").alias(c) if c == "n_chars" else done[c] for c in docs.columns))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their places in sequences of at most 4096 tokens."""
    small_batches(spark)
    return packing.packed(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", toxicity_stage),
    ("language_id", language_stage),
    ("ngram_jaccard_join", ngram_stage),
    ("substring_dedup", substring_stage),
    ("best_fit_packing", packing_stage),
]

#: SQL can't express the trained stages.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows over the table ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
