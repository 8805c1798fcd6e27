"""From raw documents to token ids in five stages, each written as Parquet and read again by the next.

Every stage takes (spark, docs, sf_dir) and works on all rows that the one before kept. All but the last return the
columns of ``documents``. Nulls, empty texts, repeated rows, empty tables and further columns are handled as the
operators document it.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from bookflow.llm import bpe, decontaminate, langid, pii, simhash
from bookflow.llm.common import free_name, prepare, table
from bookflow.llm.queries import PII_KEY, fold
from bookflow.settings import stage

#: Below this score neither family nor language is told apart better than by chance.
LEAST_LANGUAGE_SCORE = 0.3


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Language ID: documents of no language (null, or no letter) or of an undecided one go; ``lang`` becomes what was found."""
    prepare(spark)
    found, score = free_name(docs, "_lang", "_score")
    out = langid.identify(docs, langid.fit(docs, fold("doc_id", 4) != 2), lang_pred=found, score=score)
    kept = out.where((F.col(found) != "und") & (F.col(score) >= LEAST_LANGUAGE_SCORE))
    return kept.withColumn("lang", F.col(found)).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """SimHash near-dedup: of each component the document with the smallest id stays (a null id is the smallest; of equal ids the
    smallest text hash; of repeated rows one)."""
    prepare(spark)
    key, place = free_name(docs, "_key", "_place")
    keyed = docs.withColumn(key, F.struct(F.col("doc_id"), F.xxhash64(F.col("text").isNull(), "text").alias("h")))
    found = simhash.near_duplicates(keyed, doc_id=key)
    first = found.where(F.col("doc_id") == F.col("component_id")).select(F.col("doc_id").alias(key)).distinct()
    # Rows of one key are copies of one document.
    return (keyed.join(first, key, "left_semi")
            .withColumn(place, F.row_number().over(Window.partitionBy(key).orderBy("source", "lang")))
            .where(F.col(place) == 1).select(*docs.columns))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark decontamination: documents of which at least one word in 20 is inside a test phrase go, others stay as they are."""
    out = decontaminate.contamination(docs, table(spark, sf_dir, "benchmark"))
    return out.where(~F.col("contaminated")).select(*[c for c in docs.columns if c in out.columns])


def replace_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """PII: entities become surrogates; ``n_chars`` follows the text."""
    prepare(spark)
    out = pii.replace_entities(docs, PII_KEY)
    return out.withColumn("n_chars", F.length("text").cast("bigint")).select(*[c for c in docs.columns if c in out.columns])


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """BPE: the ids of every text, and digests of the ids and of the text that they decode to."""
    prepare(spark)
    return bpe.encode(docs, public_tokenizers.path("byte_bpe_50k.json"), decoded="", keep=[c for c in docs.columns if c != "text"])


STAGES = [
    ("language_id", identify_language),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("pii", replace_personal_data),
    ("bpe", encode),
]

#: Trained separators, fingerprint components and byte-pair merges are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, f in STAGES[:-1]:
        docs = stage(f(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
