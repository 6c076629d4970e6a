"""The corpus pipeline: STAGES in order, each over all that the one before kept.

Rows pass from stage to stage with the columns of documents; n_chars follows the text where lines are taken out. Other
columns, if a table has any, pass through up to the last stage, which has tokens in place of the text.

Defined results: documents with a null, empty or blank text have no quality score and go in the first stage, as do those
that it rejects. Rows equal in doc_id and text keep the same lines and become one in near-dedup; a null doc_id is a
document like others. Long texts are handled whole by all stages. Mixing may draw a document several times; its copies
come out as equal rows. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vexil.llm import bpe, line_dedup, minhash_dedup, mixing, quality_classifier
from vexil.llm.common import materialise, read_table

#: Shares of words after mixing, of as many words as come in: clean documents are drawn at rates above 1, toxic ones seldom; low ones went in the first stage.
TARGETS = {"clean": 0.95, "low": 0.0, "toxic": 0.05}


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 1: documents that the classifier rejects go."""
    return quality_classifier.classify(docs, read_table(spark, sf_dir, "labels")).select(docs.columns)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 5: lines stay at their first place only; documents that lose all go."""
    left = line_dedup.deduplicate(docs)
    return left.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else left


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 7: one document of each group stays."""
    return minhash_dedup.deduplicate(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 4: documents are drawn at their rates, as often as these say."""
    return mixing.sample(docs, read_table(spark, sf_dir, "labels"), TARGETS)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 10: doc_id, lang, source, n_chars and the tokens."""
    return bpe.encode(docs)


STAGES = [
    ("quality classifier", quality),
    ("line dedup", lines),
    ("MinHash near-dedup", near_duplicates),
    ("mixing sources to target weights", mixture),
    ("BPE encoding and decoding", tokens),
]

#: The classifier, the signatures and the merges can't be said in SQL; tests/llm/test_pipeline.py compares with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; each stage is written to the shared folder and read again."""
    docs = read_table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = materialise(docs, "stage")
    return docs
