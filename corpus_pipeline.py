"""From raw documents to packed sequences: five stages, each written as Parquet and read by the next one.

Every stage works on all documents that its predecessor kept, and all but the last return the columns
of ``documents``. ``n_chars`` is the length of the text after each stage that changes it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arborlens.llm import near, packing, pseudonyms, quality, templates
from arborlens.session import hand_over


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, learnt from ``labels``, gives a score of 0.5 or more."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality.keep_good(docs, quality.fit(quality.labelled_statistics(docs, labels)))


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without recurring lines; those that consisted of such lines only go."""
    lean = templates.drop_recurring_lines(docs)
    left = F.col("text").rlike(r"[^\x20\x09-\x0D]") | (F.col("n_dropped") == 0)
    n_chars = F.when(F.col("n_dropped") > 0, F.length("text")).otherwise(F.col("n_chars"))
    return lean.where(left).withColumn("n_chars", n_chars.cast("long")).select(*docs.columns)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each group of near copies. Rows without an id stay.

    Rows that are equal in id and text are one; an id that stays keeps all its texts.
    """
    found = near.near_components(docs.where("doc_id IS NOT NULL"))
    kept = found.where("doc_id = component_id").select("doc_id").distinct()
    one = docs.join(kept, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"])
    return one.select(*docs.columns).union(docs.where("doc_id IS NULL"))


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with validated numbers, dates and addresses replaced by pseudonyms; see ``pseudonyms.KEY_SETTING``."""
    changed = pseudonyms.pseudonymize_documents(docs, pseudonyms.job_key(spark))
    n_chars = F.when(F.size("pii_spans") > 0, F.length("text")).otherwise(F.col("n_chars"))
    return changed.withColumn("n_chars", n_chars.cast("long")).select(*docs.columns)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Place of every piece of every document in sequences of 2048 tokens."""
    import public_tokenizers

    return packing.pack(packing.token_pieces(docs, public_tokenizers.path("byte_bpe_50k.json")))


STAGES = [
    ("quality classifier", quality_stage),
    ("line dedup", line_stage),
    ("n-gram Jaccard join", near_stage),
    ("PII", pii_stage),
    ("best-fit packing", packing_stage),
]

#: Classifier, near copies and packing are not SQL; tests/llm holds each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = hand_over(stage(spark, docs, sf_dir), f"stage-{name.split()[0]}")
    return STAGES[-1][1](spark, docs, sf_dir)
