"""Corpus pipeline: documents to packed training sequences, one stage after the other.

Each stage takes (spark, docs, sf_dir), works on all rows of docs and returns a DataFrame; all but the last return the
columns of documents.  Stages make no assumption on unique ids: rows are filtered by their own text, rows that repeat an id
or have none are told apart when copies are dropped (the mix repeats rows of one id alike), and null texts count as empty
(the quality rules reject them).  An empty table passes through every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from episodica.llm import mixing, ngram_join, packing, quality_classifier, quality_rules
from episodica.llm.common import BROADCAST_ROWS, bound_batches, cut, write_table
from episodica.llm.queries import held_out, table, tokenizer_path

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _texts(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """The columns of documents, to be handed to workers in batches that suit whole texts."""
    bound_batches(spark)
    return docs.select(*COLUMNS)


def apply_quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the weighed rules keep."""
    return quality_rules.keep(_texts(spark, docs))


def apply_quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier predicts as good; trained on labelled ones of docs."""
    docs = _texts(spark, docs)
    return quality_classifier.keep(docs, quality_classifier.fit(docs, table(spark, sf_dir, "labels").where(~held_out())))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of rows that share word shingles the one of least id (null last), of equal ids the first row."""
    # a written table, so that rows keep their numbers however often they are read
    docs = write_table(_texts(spark, docs).withColumn("_row", F.monotonically_increasing_id()), "numbered-rows")
    found = ngram_join.jaccard_components(docs, key="_row").select(F.col("doc_id").alias("_row"), F.col("component_id").alias("_group"))
    found = cut(found.join(docs.select("_row", "doc_id"), "_row"))
    first = found.groupBy("_group").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "_row")).alias("_first"), F.count("*").alias("_n"))
    first = cut(first.where("_n > 1").select("_group", F.col("_first._row").alias("_kept")))
    dropped = cut(found.join(_small(first), "_group").where("_row <> _kept").select("_row"))
    return docs.join(_small(dropped), "_row", "left_anti").select(*COLUMNS)


def _small(rows: DataFrame) -> DataFrame:
    """rows to be broadcast if they are few, else shuffled."""
    return F.broadcast(rows) if rows.count() <= BROADCAST_ROWS else rows.hint("merge")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    docs = _texts(spark, docs)
    plan = mixing.mixing_plan(docs.select("doc_id", "source", mixing.word_count(F.col("text")).alias("size")), "size")
    return mixing.repeat_rows(mixing.apply_plan(docs, plan)).select(*COLUMNS)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each piece of a document in a sequence of 4096 tokens."""
    return packing.pack(packing.pieces(_texts(spark, docs), tokenizer_path("word_bpe_49k.json"), end_id=2))


STAGES = [
    ("quality rules", apply_quality_rules),
    ("quality classifier", apply_quality_classifier),
    ("n-gram jaccard join", drop_near_duplicates),
    ("mixing sources", mix_sources),
    ("packing", pack_sequences),
]

#: EM, the classifier and tokenisation can't be expressed in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = write_table(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
