"""From raw documents to packed training sequences.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents, and columns
that documents don't have pass through as they are. Rows that a stage keeps are kept whole, repeated ones each unless the
stage says otherwise; texts have any length; an empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from stemma.llm import decontaminate as _decontaminate, neardup as _neardup, packing as _packing, quality as _quality, toxicity as _toxicity
from stemma.llm._spark import cut_columnar
from stemma.llm.queries import fold, vocabulary

#: No stage has an exact SQL form (robust estimates, a trained model, hashed candidates).
ORACLE_SQL = None


def _restored(rows: DataFrame, columns: list[str]) -> DataFrame:
    return rows.select(*[F.col(f"kept_{c}").alias(c) for c in columns])


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep: 50 words or more, not half of them in repeated phrases, and no outlier of its
    language and source. Null and empty texts go; null lang and source are groups of their own; equal rows are judged alike.
    """
    return _restored(_quality.judge(docs, tuple(docs.columns)).where("kept"), docs.columns)


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents below the toxicity threshold; learnt from the same folds as the scoring query, from labels of rows that are
    still there. Without labels of either class, all stay unless every label is toxic. Null texts have the intercept's score.
    """
    learnt = fold(4) != 2
    model = _toxicity.train(docs.where(learnt), spark.read.parquet(f"{sf_dir}/labels.parquet").where(learnt))
    return _restored(_toxicity.score(docs, model, tuple(docs.columns)).where(F.col("score") < _toxicity.THRESHOLD), docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class, that of the smallest doc_id. Null and wordless texts are no copies of each other and all
    stay; of rows that share the smallest doc_id, or of a class without any, one stays.
    """
    return _neardup.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark window. Null and wordless texts stay; an empty benchmark removes nothing."""
    return _decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents, with their sequence and place in it. A null or empty text is its end token; null and repeated
    doc_ids are packed each.
    """
    return _packing.pack(docs, vocabulary())


STAGES = [("quality", quality), ("toxicity", toxicity), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("packing", packing)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each stage's rows are written as Parquet and read again by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = cut_columnar(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
