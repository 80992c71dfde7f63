"""From raw documents to packed training sequences.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame; its result
is written as Parquet and read again as the next stage's documents. All but the
last stage return the columns of ``documents``. SQL cannot express the stages;
``tests/llm/test_pipeline.py`` holds them against brute force.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factgrid.llm.common import call, stash
from factgrid.llm.minhash import near_duplicates
from factgrid.llm.packing import pack
from factgrid.llm.pii import redact
from factgrid.llm.queries import vocabulary
from factgrid.llm.suffix import remove_repeats
from factgrid.llm.toxicity import held_out, score, train

ORACLE_SQL = None


def _columns(docs: DataFrame) -> list:
    """All columns by name, whatever the names are."""
    return [F.col(f"`{c}`") for c in docs.columns]


def _recount(before: DataFrame, after: DataFrame) -> DataFrame:
    """``n_chars`` follows the text where both columns are there."""
    if "n_chars" in before.columns:
        after = after.withColumn("n_chars", F.coalesce(F.length("text").cast("long"), F.col("n_chars")))
    return after.select(*_columns(before))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored 0.5 or more go; texts are scored whole.

    Null and empty texts have no toxic word and stay; rows with a null doc_id
    and repeated rows are judged each by their text. All columns are kept as
    they are, one named ``score`` too. An empty table stays empty; without
    labels no document goes.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = train(docs.where(~held_out("doc_id")), labels.where(~held_out("doc_id")))
    return score(docs, model, out="__toxic").where("__toxic < 0.5").select(*_columns(docs))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of 5-word shingle sets at Jaccard 0.8 the smallest doc_id stays.

    Documents without words and rows with a null doc_id stay; rows that share a
    doc_id stay or go together. All columns are kept as they are.
    """
    gone = near_duplicates(docs, size=5, percent=80).where("not kept").select("doc_id").distinct()
    return docs.join(stash(gone), "doc_id", "left_anti").select(*_columns(docs))


def drop_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bytes covered by 50-byte strings of earlier documents go; emptied documents stay, empty.

    Null texts stay null; rows with a null doc_id are neither compared nor cut;
    rows that share a doc_id do not take from each other. All columns are kept
    as they are but ``text`` and ``n_chars``.
    """
    return _recount(docs, remove_repeats(docs, keep_text=True))


def redact_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by the name of its kind.

    Null texts stay null; rows with a null doc_id lose their base spans only;
    of rows that share a doc_id each is redacted by its own text. All columns
    are kept as they are but ``text`` and ``n_chars``.
    """
    return _recount(docs, redact(docs))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces with their place in sequences of 1024 tokens.

    Null and empty texts are an end token; rows with a null doc_id and repeated
    rows are packed each; an empty table gives no piece.
    """
    return pack(docs, vocabulary())


STAGES = [
    ("toxicity", drop_toxic),
    ("minhash", drop_near_duplicates),
    ("suffix", drop_repeats),
    ("pii", redact_pii),
    ("packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        with call(spark):  # what a stage has written on its way goes with it
            docs = stash(stage(spark, docs, sf_dir), outer=True)
    return STAGES[-1][1](spark, docs, sf_dir)
