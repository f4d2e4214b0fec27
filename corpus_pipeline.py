"""A training-data pipeline over the documents table.

STAGES are (name, function) pairs in order; each function takes (spark, docs, sf_dir) and returns a DataFrame,
which is written as Parquet and read again as the next one's docs.

Defined cases, for every stage: rows with null or empty columns stay rows, an empty table gives an empty table, other
columns than those of documents are dropped. Null and empty texts have no language (the second stage rejects them) and
are never near-duplicates or contaminated; repeated rows are judged alike, and the third stage keeps one of them; rows
without an id are judged by their text alone and never dropped as copies.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridlake.llm import common, decontaminate, langid, mixing, neardup, toxicity

#: The columns of documents, which all stages but the last return.
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: A text is rejected as toxic from this score on. It is rejected for its language without a letter, or below this value
#: of the best language's own regression, which is about 0 for texts unlike all examples and 1 for texts like the best
#: language's, however many languages are learned.
TOXIC_FROM, LIKENESS_FROM = 0.5, 0.05


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the nearest labelled examples call toxic go."""
    model = toxicity.fit(docs, common.read(spark, sf_dir, "labels"))
    score, evidence = common.fresh(docs, "score", "evidence")
    scored = toxicity.score(docs, model, score_col=score, evidence_col=evidence)
    del model  # the executors have it; the driver shares its memory with a JVM
    common.give_back(spark)
    return scored.where(F.col(score) < TOXIC_FROM).select(*COLUMNS)


def drop_unknown_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without letters, or like no language that the labels name, go."""
    lang, score, likeness = common.fresh(docs, "lang", "score", "likeness")
    out = langid.identify(docs, langid.fit(docs), lang_col=lang, score_col=score, likeness_col=likeness)
    return out.where((F.col(lang) != "und") & (F.col(likeness) >= LIKENESS_FROM)).select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays, that of the smallest id."""
    return neardup.deduplicate(docs).select(*COLUMNS)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which benchmark windows cover a twentieth or more go."""
    return decontaminate.decontaminate(docs, common.read(spark, sf_dir, "benchmark")).select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The sample that meets the target weights, with each document's weight and probability."""
    return mixing.mix(docs, {"topic": mixing.TOPIC_TARGETS}).where("kept").select(*COLUMNS, "topic", "n_tokens", "weight", "prob")


STAGES = [
    ("toxicity", drop_toxic),
    ("language_id", drop_unknown_language),
    ("near_dedup", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("mixing", mix_sources),
]

#: Kernel classification and nearest examples cannot be written in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table; each result is a written table in the shared folder of the cluster, and goes
    once the next one is written."""
    docs = common.read(spark, sf_dir, "documents")
    for _, stage in STAGES:
        done = common.cut(stage(spark, docs, sf_dir))
        common.discard(docs)
        docs = done
    return docs
