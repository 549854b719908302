"""From raw documents to packed training sequences: five stages, each over all that the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from snapfold.llm import mixture, near_dup, packing, quality, secrets
from snapfold.llm.common import WORD, columns_of, cut, fresh, release, table, written
from snapfold.llm.queries import quality_model

#: The pipeline trains a model and tokenises: no SQL gives its rows. Tests hold it against a brute-force version.
ORACLE_SQL = None


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score is at least 0.3.

    Null and empty texts go by the score of an empty text. Rows are judged one by one, so null and repeated ids and
    repeated rows stay or go with their own text. Columns pass through, whatever their names; no row, no result.
    """
    score = fresh(docs, "score")
    scored = quality.score_quality(docs, quality_model(spark, docs, sf_dir), score=score)
    return scored.where(F.col(score) >= 0.3).select(columns_of(docs))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (similarity of 0.8 or more), the one of least doc_id.

    Different texts of one or no doc_id count apart. Of rows equal in id and text one stays; texts without words stay,
    one for each id, all of those without one.
    """
    return near_dup.one_per_component(docs, percent=80)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets masked. Null texts stay null; every row stays, with n_chars as its new length (null: null)."""
    return secrets.redact(docs).withColumn("n_chars", F.length("text").cast("long")).select(columns_of(docs))


def source_mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it. Ids may be null or repeat, so copies are known by id, source and text.

    Rows equal in all three are one row with the copies of all. A text without words has one copy and needs no mix. A
    null source is a source of its own.
    """
    key, n, copy = fresh(docs, "_key"), fresh(docs, "_copies"), fresh(docs, "_copy")
    words = F.coalesce(F.col("text").rlike(WORD), F.lit(False))
    keyed = docs.where(words).withColumn(key, F.struct("doc_id", "source", near_dup.text_key(F.col("text")).alias("text")))
    copies = mixture.mix(keyed, key).where("copies > 0").groupBy(F.col("doc_id").alias(key)).agg(F.sum("copies").alias(n))
    joined = keyed.dropDuplicates([key]).join(copies, key)
    taken = joined.withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(n).cast("int"))))
    return taken.select(columns_of(docs)).union(docs.where(~words).select(columns_of(docs)))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents, packed into sequences of 2048 tokens.

    A sequence holds 48 documents at most, and attention work (the sum of squared lengths) of three quarters of a full
    one; a longer piece has a sequence of its own. Null and empty texts are their end id alone; repeated rows are
    documents of their own.
    """
    return packing.pack_documents(docs, packing.Capacity(documents=48, attention=3 * packing.LENGTH**2 // 4))


STAGES = [
    ("quality classifier", quality_filter),
    ("MinHash near-dedup", near_dedup),
    ("secret scans", secret_scan),
    ("mixing sources to target weights", source_mixture),
    ("best-fit packing", packing_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        before = written()
        docs = cut(stage(spark, docs, sf_dir))
        release(spark, keep=before, but=1)
    return STAGES[-1][1](spark, docs, sf_dir)
