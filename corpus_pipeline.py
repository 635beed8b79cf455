"""From raw documents to token ids, in five stages.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes
each stage's rows as Parquet to the shared folder and reads them again for the
next. All but the last keep the columns of ``documents``.

Rows: a null or empty text is scored, compared and encoded like any empty text
(such texts are near copies of one another) and stays null until the last
stage; rows without doc_id pass every stage unless their text is rejected, and
never stand for near copies; an id on several rows names each of them apart;
rows repeated as a whole are near copies; of near copies the smallest doc_id
stays, so ties can't arise; further columns are kept until the last stage; an
empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from waymill.llm import bpe, decontam, nearcopies, pii, quality
from waymill.llm.common import Scratch, table


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Quality classifier (operator 7): documents that it rejects go. It learns
    from this stage's input and the labels of its training rows."""
    return quality.keep_good(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """SimHash near-dedup (operator 1 over 5-word shingles): one document of each
    group of near copies stays. Links are a Jaccard similarity of at least 0.8,
    which fingerprints alone can't reach; MinHash proposes what they miss."""
    return nearcopies.keep_one(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark decontamination (operator 5): documents that hold a test item go."""
    return decontam.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """PII (operator 8): personal data is replaced by its kind."""
    return pii.redact(docs)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """BPE encoding and decoding (operator 2): counts and digests of the ids."""
    return bpe.digests(bpe.encode_documents(docs, bpe.default_vocabulary()))


STAGES = [
    ("quality", good_quality),
    ("near_dedup", near_dedup),
    ("decontamination", without_benchmark),
    ("pii", without_personal_data),
    ("bpe", token_ids),
]

#: SQL can express neither the trained classifier nor the tokens; tests/llm holds the stages against plain versions
#: (scores above the threshold, Jaccard groups, containment, patterns, the tokenizers library).
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch, docs = Scratch(spark), table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        new = scratch.keep(stage(spark, docs, sf_dir), name)
        scratch.drop(docs)
        docs = new
    return docs
