"""A corpus pipeline of five of the training-data operators, from ``documents`` to token ids.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next one's docs.
All but the last return the columns of documents, and further columns, whatever their names, as they are. Texts of any length
are worked on whole; an empty table goes through as an empty table.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sieveframe.functions.lineage import ensure_checkpoint_dir
from sieveframe.llm import linededup, mixing, ngram_join, sentencepiece, toxicity
from sieveframe.llm.common import read, texts


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the nearest labelled examples call toxic go; all others stay as they are.

    Null and empty texts have no terms and stay, as rows with a null doc_id do unless their text is toxic. Repeated rows go or stay
    together. Without labels nothing goes.
    """
    model = toxicity.train(texts(docs), read(spark, sf_dir, "labels"))
    return toxicity.without_toxic(model, docs)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that an earlier document holds go; every document stays, if need be with an empty text (so does one with a null text).

    Rows with a null doc_id keep all their lines. Repeated rows are one document and lose the same lines.
    """
    new = {"text": F.col("kept_text"), "n_chars": F.char_length("kept_text").cast("long")}
    out = linededup.dedup_lines(docs, keep=tuple(c for c in docs.columns if c not in new))
    return out.select(*[new.get(c, F.col("row")[c]).alias(c) for c in docs.columns])


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document of the smallest doc_id stays; rows equal in doc_id and text are one document.

    Texts without words and rows with a null doc_id are no copies of anything and stay. Rows with one doc_id and different texts are
    different documents: they go or stay each for itself.
    """
    gone = ngram_join.near_duplicates(docs).where("not kept").select(F.col("doc_id").alias("gone_id"), "text_hash").distinct()
    return docs.join(gone, (docs["doc_id"].cast("long") == gone["gone_id"]) & (F.xxhash64(docs["text"].cast("string")) == gone["text_hash"]), "left_anti")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mixture takes them, partly taken ones with the words taken.

    Texts without words are taken 0 times. A null source is a source of its own. Repeated rows and rows with null or repeated ids count each for themselves.
    """
    return mixing.mix(docs)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_tokens, n_bytes and ids of each row; null and empty texts have no ids."""
    return sentencepiece.encode(docs, keep=("lang", "source"), decode=False).select("doc_id", "lang", "source", "n_tokens", "n_bytes", "ids")


STAGES = [("toxicity", drop_toxic), ("line_dedup", dedup_lines), ("ngram_jaccard_join", drop_near_copies), ("mixing", mix_sources), ("sentencepiece", tokenize)]

#: Nearest-neighbour scores and token ids are beyond SQL; the stages are tested against brute force.
ORACLE_SQL = None


def _remove(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows for the documents of sf_dir; what lies between stages goes to the shared checkpoint folder.

    A stage's rows are removed once the next stage has written its own; those that the returned plan reads stay.
    """
    ensure_checkpoint_dir(spark)
    docs = read(spark, sf_dir, "documents")
    root, before = f"{spark.sparkContext.getCheckpointDir()}/pipeline-{uuid.uuid4().hex}", None
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            path = f"{root}/{k}-{name}"
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
            if before is not None:
                _remove(spark, before)
            before = path
    return docs
