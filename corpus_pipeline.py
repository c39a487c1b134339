"""A training corpus from the documents: classified, filtered by rules, deduplicated, redacted, and packed.

Each stage takes (spark, docs, sf_dir) and works on all documents that its predecessor kept. All stages but the last
return the columns of documents. Empty tables pass through every stage; null and empty texts are rejected by the
first two stages. Verdicts of the rules and of near-dedup are those of the row, whatever its doc_id: a row without one
is rejected like others. After near-dedup each doc_id has one row; of equal rows that all lack a doc_id all stay.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from loomkv.llm.common import materialize, once, row_key, without_rows
from loomkv.llm.near_dup import near_duplicates
from loomkv.llm.packing import pack
from loomkv.llm.quality_knn import fit, kept_by_quality
from loomkv.llm.quality_rules import quality_rules
from loomkv.llm.secrets import redacted


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score 0.7 or more by their labelled nearest neighbours."""
    return kept_by_quality(docs, fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")), threshold=0.7)


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that neither fail the base rules nor lie outside their language's and source's robust ellipsoid."""
    keyed = docs.withColumn("_row", row_key("doc_id", "lang", "source", "text"))
    found = quality_rules(docs.withColumn("doc_id", row_key("doc_id", "lang", "source", "text")))
    return without_rows(keyed, found.where("not kept").withColumnRenamed("doc_id", "_row"), "_row").select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (five-word shingles, similarity 0.8): that of the smallest doc_id."""
    keyed = docs.withColumn("_row", row_key("doc_id", "text"))
    found = near_duplicates(keyed, k=5, percent=80, carry="_row")
    return once(without_rows(keyed, found.where("not kept"), "_row").select(*docs.columns))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets and linked parts of credentials replaced by a mark."""
    return redacted(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces with their ids, placed in sequences of 2048 tokens."""
    import public_tokenizers

    return pack(docs, public_tokenizers.path("word_bpe_49k.json"), end_id=1, length=2048, with_ids=True)


STAGES = [("quality classifier", quality_classifier), ("quality rules", rules), ("minhash near-dedup", near_dedup), ("secret scans", secret_scan), ("packing", packing)]

#: The classifier, the robust estimates and the tokenizer can't be written in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialize(docs, name.replace(" ", "-"))
    return docs
