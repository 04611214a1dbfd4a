"""The corpus pipeline: five stages from raw documents to token ids.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last
return the columns of documents.  Between stages the rows are written as Parquet
in the folder that all executors share.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.llm.byte_bpe import byte_bpe
from corvane.llm.decontaminate import decontaminate
from corvane.llm.language_id import fit, predict
from corvane.llm.simhash import simhash_groups
from corvane.llm.substring_dedup import substring_dedup
from corvane.llm.textkit import crc_remainder, shared_path


def sealed(docs: DataFrame) -> DataFrame:
    """docs with doc_id and text, and its other columns under numbered names, which no operator returns."""
    return docs.select("doc_id", "text", *[F.col(f"`{c}`").alias(f"_sealed_{i}") for i, c in enumerate(docs.columns) if c not in ("doc_id", "text")])


def opened(rows: DataFrame, docs: DataFrame, **new: Column) -> DataFrame:
    """The columns of docs from rows that carry the sealed ones; new ones replace those of their name."""
    found = [new.get(c, F.col(c if c in ("doc_id", "text") else f"_sealed_{i}")) for i, c in enumerate(docs.columns)]
    return rows.select(*[value.alias(c) for c, value in zip(docs.columns, found, strict=True)])


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents whose text is in one of the languages that the model has learned.

    A text that is null, empty, without a letter or not known goes; repeated
    rows are judged alike; an empty table stays empty; columns of any name pass.
    Where no lang is given, nothing is learned and nothing kept.
    """
    model = fit(docs.where(crc_remainder(F.col("doc_id"), 4) != 2))
    return opened(predict(sealed(docs), model, with_known=True).where("known"), docs)


def simhash_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps of each group of near-duplicates the document with the least id.

    Rows that repeat an id are one document and stay or go together; rows
    without an id stay, as nothing orders them; texts without words are copies
    of each other.  An empty table stays empty; columns of any name pass.
    """
    groups = simhash_groups(docs.select("doc_id", "text"))
    copies = groups.where("doc_id > component_id").select("doc_id").distinct()
    return docs.join(copies, "doc_id", "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])


def substring_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes passages that an earlier document has; a document of which nothing is left goes.

    n_chars follows the text, where there is such a column.  A null text stays
    as an empty one; rows that repeat an id lose the same words; rows without an
    id lose nothing.  An empty table stays empty; columns of any name pass.
    """
    closed = sealed(docs)
    found = substring_dedup(closed, carry=tuple(c for c in closed.columns if c.startswith("_sealed_"))).where("n_removed < n_words or n_removed = 0")
    new = {"text": F.col("clean_text")} | ({"n_chars": F.length("clean_text").cast(dict(docs.dtypes)["n_chars"])} if "n_chars" in docs.columns else {})
    return opened(found, docs, **new)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents that no benchmark item contaminates.

    Null and empty texts stay; repeated rows are judged alike, with an id or
    without.  An empty table stays empty; columns of any name pass.
    """
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    closed = sealed(docs)
    return opened(decontaminate(closed, benchmark, carry=tuple(closed.columns)).where(~F.col("contaminated")), docs)


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token ids of each document, with the digests of ids and decoded bytes.

    A null or empty text has no ids; every row gets its row; an empty table
    gives none; other columns are not read.
    """
    return byte_bpe(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [
    ("language_id", language_stage),
    ("simhash", simhash_stage),
    ("substring_dedup", substring_stage),
    ("decontamination", decontamination_stage),
    ("byte_bpe", encoding_stage),
]

#: Three stages have no SQL form; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table documents.

    What a stage has written is read by the next one only; the folders lie in
    the session's checkpoint folder and are cleared with it.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = shared_path(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
