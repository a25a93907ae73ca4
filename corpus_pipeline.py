"""The corpus pipeline: five stages over ``documents``, each stored before the next reads it.

1. quality rules: documents that the base rules or the proven cutoffs reject go.
2. near duplicates: one document of each group of linked ones (five-word shingles, similarity from 0.8) stays.
3. decontamination: benchmark passages are cut out; a document that is mostly benchmark goes.
4. personal data: spans are replaced by what kind they are.
5. token ids: byte-level BPE, with the decoded text beside the ids.

Stages 1 to 4 return the columns of ``documents``, extra ones too; an empty table passes through all of
them. Rows are decided one by one: ids may be NULL or repeat, and texts of any length are read whole.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlens.llm import byte_bpe
from cohortlens.llm.common import table
from cohortlens.llm.decontaminate import decontaminate
from cohortlens.llm.pii import sanitise
from cohortlens.llm.quality_rules import keep_good
from cohortlens.llm.queries import BYTE_BPE
from cohortlens.llm.shingle_join import one_of_each
from cohortlens.session import cut_lineage

#: Near copies of stage 2: words of a shingle, and intersection in percent of the union from which on.
NEAR_WORDS, NEAR_PERCENT = 5, 80


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that pass the rules. A NULL or empty text has no words and goes; repeated rows are judged alike."""
    return keep_good(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of linked texts, that of the smallest id (a NULL one only if there is no other).

    Rows are told apart by id and text; of rows equal in both one stays. Texts without words all stay.
    """
    return one_of_each(docs, NEAR_WORDS, NEAR_PERCENT)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows without benchmark passages; NULL and empty texts, and those without a hit, stay as they are."""
    return decontaminate(docs, table(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows with spans replaced; NULL and empty texts, and those without a span, stay as they are."""
    return sanitise(docs)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Per row only: ``doc_id``, ``n_tokens``, ``ids`` and ``text``, decoded from the ids (a NULL text is empty)."""
    done = byte_bpe.round_trip(docs, public_tokenizers.path(BYTE_BPE), public_tokenizers.PATTERN)
    return done.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", F.col("decoded").cast("string").alias("text")
    )


STAGES = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("personal_data", personal_data),
    ("token_ids", token_ids),
]

#: The stages are beyond SQL; ``tests/llm`` compares them with brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written as Parquet and read by the next stage."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut_lineage(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
