"""A training corpus from raw documents: each stage reads what the last one kept.

Toxic documents go, one document of each near-duplicate component stays,
documents that hold benchmark questions go, secrets are masked in the texts, and
what is left is packed into sequences. All stages but the last return the
columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from columnary.llm import decontam, neardup, packing, secret_scan, toxicity
from columnary.llm.common import cut
from columnary.llm.queries import TOXIC_FROM, read, tokenizer_path, toxicity_model

#: Chunks of a cache generation in the packing stage (see ``packing.GENERATION``).
PACKING_CACHE = 200_000


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = toxicity_model(docs, read(spark, sf_dir, "labels"))
    return toxicity.keep_below(docs, model, TOXIC_FROM)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return neardup.keep_first(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontam.clean(docs, read(spark, sf_dir, "benchmark"), inconsistent=True)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    masked = secret_scan.redacted(docs, any_two=True)
    return masked.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else masked


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    # the executors of the earlier stages have grown: leave them more memory
    pieces = packing.token_pieces(docs, tokenizer_path(), cache=PACKING_CACHE)
    digests = pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens")
    return packing.pack(digests, docs.count())


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("secrets", mask_secrets),
    ("packing", pack_sequences),
]

#: The stages learn a model, follow links and read a tokenizer: not SQL. Tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
