"""The corpus pipeline: quality, near copies, benchmark leaks, personal data, packing.

Each stage takes (spark, docs, sf_dir), works on all rows that the stage before it
kept and returns a DataFrame, which is written and read again before the next one.
All but the last return the columns of ``documents``. No SQL expresses the stages
(a fitted model, exact similarity groups, BM25 packing); tests hold each against a
plain version instead.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pagewright.llm import decontaminate, jaccard, packing, pii, quality
from pagewright.llm.common import saved, table
from pagewright.llm.tokens import vocabulary


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 9: documents that the classifier rejects go.

    Null and empty texts are rejected, as nothing speaks for them; equal texts get the same
    verdict, whatever their ids; a null id stays with its row; texts of any length are
    scored whole; columns of other names, also those that the operator uses, come through
    unchanged; no documents give none.
    """
    return quality.keep_good(docs)


def jaccard_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 7: one document of each group of similar ones stays, the one of least id.

    Texts without words, null ones too, are in no group and stay, but of equal rows one
    stays, whatever their text; null ids come after all others, of equal ids the text's
    hash decides; texts of any length count with all their shingles; other columns come
    through unchanged; no documents give none.
    """
    return jaccard.one_of_each(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 6: documents that hold a benchmark item go.

    Texts without words, null ones too, hold none and stay, as does everything when there
    are no items; equal rows go or stay together; null ids stay with their rows; texts of
    any length are searched whole; other columns come through unchanged.
    """
    return decontaminate.without_leaks(docs, table(spark, sf_dir, "benchmark"))


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 3: personal data and the terms that disclose it leave the texts.

    No row goes. Null texts stay null, empty ones empty; equal texts are changed alike;
    ``n_chars`` follows the text where there is such a column of whole numbers; texts of
    any length are read whole; other columns come through unchanged.
    """
    return pii.sanitise(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 10: the texts packed into sequences.

    A null or empty text is its end token alone; equal rows are packed each; null ids
    stay; texts of any length are cut over as many sequences as they fill; other columns
    end here; no documents give no pieces.
    """
    return packing.pack(docs, vocabulary())


STAGES = [
    ("quality classifier", quality_stage),
    ("n-gram Jaccard join", jaccard_stage),
    ("benchmark decontamination", decontamination_stage),
    ("personal data", pii_stage),
    ("retrieval packing", packing_stage),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = saved(docs, f"stage{i}")
    return docs
