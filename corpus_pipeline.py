"""Training-corpus pipeline: five stages over ``documents``, in order.

Each stage takes (spark, docs, sf_dir) and works on all rows that the one before
it kept.  All but the last return the columns of ``docs``, whatever they are called
beside ``doc_id``, ``text`` and ``source``.  Every stage takes an empty table and
gives one (the last too), and texts of any length.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sitegrain.llm import decontamination, jaccard, mixing, packing, quality
from sitegrain.llm.common import discard, read, staged, staging


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose posterior quality, voted by rules, is high enough.

    Null and empty texts, and others below ten words, go; equal texts stay or go
    together.
    """
    return quality.keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by 80 % of five-word shingles: the smallest id.

    Texts without words link with nothing and stay; so do rows with a null id; rows
    repeated with their id all stay or all go.
    """
    return jaccard.one_of_each(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage that holds 80 % of a test item.

    Null and empty texts stay, and without items all do; equal texts stay or go
    together.
    """
    return decontamination.remove_contaminated(docs, read(spark, sf_dir, "benchmark"))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them: not at all, once or twice.

    A null source is one of its own, last in order; null texts have size 0; repeated
    rows are taken equally often.
    """
    return mixing.mixed_documents(docs)


def token_files(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files of the mix, read back: place, length and CRC of each document.

    A null text is its end id alone; null ids come first; repeated rows are written
    one by one.
    """
    return packing.digest(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("benchmark_decontamination", benchmark_decontamination),
    ("source_mix", source_mix),
    ("token_files", token_files),
]

#: Fitted models, sketches and tokenizers have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each but the last written and read again.

    What a stage staged for itself, and its input, go as soon as its result is
    written.
    """
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        before = docs
        with staging(spark) as keep:
            docs = keep(staged(stage(spark, before, sf_dir), name))
        discard(before)
    return STAGES[-1][1](spark, docs, sf_dir)
