"""Corpus preparation: stages over ``documents``, each written and read again by the next.

Every stage is ``(spark, docs, sf_dir) -> DataFrame``. The first four return
rows of ``documents`` they keep; the last returns the encoded documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spendlens.llm.bpe_chunks import encode_by_chunks
from spendlens.llm.common import keyed, new_folder, table
from spendlens.llm.decontaminate import drop_contaminated
from spendlens.llm.jaccard_forest import keep_one
from spendlens.llm.pu_quality import score_of, train
from spendlens.llm.q_token_files import tokenizer_path
from spendlens.llm.quality_rules import keep_good

#: scores below it are rejected by the first stage
QUALITY_THRESHOLD = 0.3


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents the positive-unlabelled classifier scores at or above the threshold."""
    rows = keyed(docs, doc_id="doc_id", text="text").select(F.col("doc_id").cast("long"), "text")
    model = train(rows, table(spark, sf_dir, "labels"))
    return docs.where(score_of(model)("text") >= QUALITY_THRESHOLD)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and do not diverge from their language."""
    return keep_good(docs)


def jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (the least doc_id)."""
    return keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any window of a benchmark item."""
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def bpe_encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every whole text, with digests of the ids and of the text decoded from them."""
    return encode_by_chunks(docs, tokenizer_path("byte_bpe_50k.json"), columns=["ids", "n_tokens", "ids_sha256", "decoded_sha256"])


STAGES = [
    ("quality classifier", quality_classifier),
    ("quality rules", quality_rules),
    ("n-gram Jaccard join", jaccard_join),
    ("benchmark decontamination", decontamination),
    ("BPE encoding and decoding", bpe_encoding),
]

#: the learnt first stage has no SQL; the pipeline is tested against brute force instead
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; every stage but the last is stored in the shared folder."""
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            path = new_folder(spark, f"stage-{i + 1}")
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
    return docs
