"""The corpus pipeline: quality, near duplicates, repeated passages, source mixture, tokens.

``STAGES`` lists (name, function). Each function takes (spark, docs, sf_dir) and returns a
DataFrame; between stages it is written as Parquet and read again, so a lost executor
costs no earlier stage. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import byte_bpe, near_dedup, rule_ensemble, source_mixing, suffix_dedup
from tidemark.llm.common import Stash, table
from tidemark.llm.queries import tokenizer_path

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts. It learns from the labelled rows of its input that are not held out.

    Null and empty texts are scored like any other; repeated rows have the same verdict. Without labels nothing is accepted.
    """
    model = rule_ensemble.train(docs, table(spark, sf_dir, "labels"))
    return rule_ensemble.score(docs, model).where("predicted = 1").select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class: the one of the least id. A document without an id stays, as does one without words;
    rows that share an id are judged by its first text, and stay or go together."""
    others = near_dedup.near_duplicates(docs).where("doc_id <> class_id").select("doc_id")
    return docs.join(others, "doc_id", "left_anti").select(*COLUMNS)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts less the bytes of passages that stand elsewhere too; documents of which nothing is left go. Null and empty texts stay as they are."""
    out = suffix_dedup.dedup_substrings(docs).where("n_removed = 0 or length(text) > 0")
    return out.withColumn("n_chars", F.char_length("text").cast("long")).select(*COLUMNS)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated by their Poisson counts towards equal shares of the sources, in shuffled order. A null source is one of its own."""
    return source_mixing.mix(docs).select(*COLUMNS)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The ids of each document and their byte offsets, with digests of ids and of what they decode to. A null text has no ids."""
    return byte_bpe.encode_documents(docs.select("doc_id", "source", "text"), tokenizer_path("byte_bpe_multi_50k.tiktoken")).drop("text")


STAGES = [
    ("quality classifier", quality),
    ("near-duplicate removal", near_duplicates),
    ("repeated passage removal", repeated_passages),
    ("source mixture", mixture),
    ("byte-level BPE", tokens),
]

#: No SQL: the classifier is learned, and near duplicates are found by hashing.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; the last one's rows."""
    stash = Stash(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if k == len(STAGES) - 1:
            return out
        docs = stash.save(out, f"stage-{k}")
    return docs
