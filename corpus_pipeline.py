"""A corpus pipeline from the operators of ``axonframe.llm``: five stages, each over all that the one before it kept.

``run(spark, sf_dir)`` applies ``STAGES`` to the ``documents`` table. Each stage's result is written as Parquet into the
folder that driver and executors share, and read again for the next one, so a lost executor never costs more than a
stage. All stages but the last return the columns of ``documents``; what a stage rejects doesn't come back. Very long texts
are taken whole, columns of any other name are carried along, and an empty table gives an empty one in every stage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from axonframe.llm._common import saved, table
from axonframe.llm.langid import held_out, prediction, train
from axonframe.llm.minhash import duplicate_groups, text_key
from axonframe.llm.mixing import mixed_documents
from axonframe.llm.packing import pack
from axonframe.llm.quality import decided

#: A document stays if its likeliest language has at least this share of the likelihood.
SURE = 0.5


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Word-first backoff; rejects documents without a letter (``und``) and those of no clear language.

    The model learns from all rows that are not held out; the column ``lang`` is left as it was. Null and empty texts are ``und``; repeated
    rows are judged alike. Without a labelled row nothing can be told, and all documents go.
    """
    model = train(docs, ~held_out() & F.col("doc_id").isNotNull())
    judged = docs.select(F.struct("*").alias("doc"), prediction(spark, model).alias("p"))
    return judged.filter((F.col("p.lang_pred") != "und") & (F.col("p.score") >= SURE)).select("doc.*")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Importance resampling against all documents labelled good; rejects what the Gumbel top-k doesn't draw.

    All of them are counted, and the threshold comes from all of them, each judged without its own n-grams.

    Null and empty texts weigh like a text of unseen n-grams; repeated rows are kept or rejected alike. Without good labels all stay.
    """
    return decided(docs, table(spark, sf_dir, "labels"), whole=True).filter("kept").select(*[F.col(f"c{k}").alias(c) for k, c in enumerate(docs.columns)])


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Shingles of five words, similarity 0.8; of each group the document with the smallest id stays (ties: by a hash of the text).

    Rows that are equal in id and text are one document, of which the first by a hash of all columns stays. Rows of one id with
    other texts are documents of their own. Null and empty texts are linked with nothing and stay. Rows without an id stay.
    """
    groups = duplicate_groups(docs).filter("id is not null")
    first = groups.filter("group is not null").groupBy("group").agg(F.min(F.struct("id", "t")).alias("first")).select("first.id", "first.t")
    stays = first.union(groups.filter("group is null").select("id", "t")).distinct()
    known = docs.select(F.col("doc_id").cast("long").alias("id"), text_key("text").alias("t"), F.struct("*").alias("doc")).join(stays, ["id", "t"], "left_semi")
    order = F.xxhash64(*[F.col("doc").getField(c) for c, kind in docs.dtypes if "map<" not in kind])
    once = known.withColumn("nth", F.row_number().over(W.partitionBy("id", "t").orderBy(order))).filter("nth = 1").select("doc.*")
    return once.union(docs.filter("doc_id is null"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources by their target weights: a row for each document and pass with the words that the mix takes.

    Null and empty texts have no words to take and aren't in the mix. A null source is one of its own. Repeated rows are mixed each.
    """
    return mixed_documents(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces in sequences of at most 2048 tokens; a null or empty text is its end id alone. Repeated rows are packed each."""
    return pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("language_id", language_id), ("quality", quality), ("near_dedup", near_dedup), ("mixing", mixing), ("packing", packing)]

#: Models, hashes and online packing aren't SQL; the tests hold the stages against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = saved(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
