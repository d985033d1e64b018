"""The corpus pipeline: documents through stages of the training-data operators.

Each stage takes all that the one before it kept. All but the last return the
columns of ``documents``; what a stage rejects or rewrites is gone or rewritten
for those after it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from radiomap.llm import bpe, decontam, pii, quality, simhash
from radiomap.llm.queries import read, tokenizer
from radiomap.llm.text import named
from radiomap.session import materialize, ship


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, trained on ``labels``, accepts."""
    scored = quality.classify(docs, read(spark, sf_dir, "labels"))
    return scored.where("keep").select(*[F.col(named(c)) for c in docs.columns])


def keep_distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    return simhash.keep_one(docs, size=3, max_bits=2)


def keep_clean_of_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no item of ``benchmark``."""
    return decontam.clean(docs, read(spark, sf_dir, "benchmark"))


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by marks."""
    return pii.redact(docs)


def encode_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, lang, source, n_tokens, ids, decoded_sha256): the training tokens,
    and the digest of the text that they decode to."""
    coded = bpe.encode(docs.select("doc_id", "lang", "source", "text"), tokenizer(), digest="decoded_sha256")
    return coded.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids", "decoded_sha256")


def _shipped(stage):
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        return stage(ship(spark), docs, sf_dir)

    run_stage.__name__, run_stage.__doc__ = stage.__name__, stage.__doc__
    return run_stage


STAGES = [
    ("quality classifier", _shipped(keep_quality)),
    ("SimHash near-dedup", _shipped(keep_distinct)),
    ("benchmark decontamination", _shipped(keep_clean_of_benchmark)),
    ("PII", _shipped(redact_personal_data)),
    ("BPE encoding and decoding", _shipped(encode_texts)),
]

#: No stage but the plainest can be stated in SQL; tests compare with brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows for the ``documents`` of ``sf_dir``."""
    docs = read(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialize(docs, f"stage{k}")
    return docs
