"""Corpus pipeline: quality, near duplicates, benchmark contamination, personal data, tokens.

Defined results of all stages: a null text is empty (and stays null where a stage keeps it as it is); rows with a null
doc_id are judged by their text and never lost to a missing id; repeated rows are judged alike and kept or dropped
together; ties are broken by the smaller doc_id; a very long text is read whole; an empty table gives an empty result;
columns other than COLUMNS are dropped, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinlink.llm import bpe_dropout, bradley_terry, decontam, sanitise, simhash_trie
from kinlink.llm.common import materialise

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts. Scores travel with their rows, so nothing is joined. Without labels of
    both kinds every score is 0.5, and all documents are kept."""
    model = bradley_terry.fitted(docs, _table(spark, sf_dir, "labels"), bradley_terry._fold("doc_id", 5) != 0, 0.3)
    return bradley_terry.accepted(docs, model).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each near-duplicate component; documents without an id stay, as none can be
    named to stand for them."""
    return simhash_trie.representatives(docs, width=5, similarity=0.8).select(*COLUMNS)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item. Documents of one id are judged each by its own text."""
    return decontam.clean(docs, _table(spark, sf_dir, "benchmark")).select(*COLUMNS)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data generalised and disclosing terms removed wherever they occur."""
    clean = sanitise.sanitised(docs, sanitise.find_spans(docs))
    return clean.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id with its pieces; an empty text has none."""
    return bpe_dropout.tokenise(docs).select("doc_id", "n_pieces", "pieces", "lossless")


STAGES = [
    ("quality classifier", quality),
    ("near duplicates", near_duplicates),
    ("benchmark decontamination", decontaminate),
    ("personal data", personal_data),
    ("tokens", tokens),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = materialise(docs, f"stage{k}")
    return docs
