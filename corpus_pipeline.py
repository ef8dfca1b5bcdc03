"""From raw documents to packed training sequences.

``STAGES``: (name, function) in order; a function takes (spark, docs, sf_dir) and
returns a DataFrame.  All but the last return the columns of ``documents``; each
works on all that the one before it kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sheetlens.llm import mixing, neardup, packing, quality, suffix
from sheetlens.llm.common import own_names, set_aside, written
from sheetlens.llm.queries import RANKS, TOKENIZER


def drop_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier keeps.  A null or blank text is no fault and stays;
    repeated rows stay or go together; an empty table stays empty."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    docs, back = set_aside(docs, quality.COLUMNS)
    return back(quality.classify(docs, labels).where("kept"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component: the one with the smallest id, once if its row is
    repeated.  Documents without words all stay; an empty table stays empty."""
    docs, back = set_aside(docs, neardup.COLUMNS)
    copy = own_names(docs, ["_copy"])["_copy"]
    return back(neardup.near_duplicates(docs, copy=copy).where(F.col("kept") & (F.col(copy) == 1)))


#: A repeated passage is one of more than 50 words; 200 bytes are 50 words of three letters.
PASSAGE_WORDS, PASSAGE_BYTES = 51, 200


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, its text without the passages of at least ``PASSAGE_WORDS`` words that
    strings of ``PASSAGE_BYTES`` bytes repeated anywhere cover (what is left of a character
    that was cut is left out) and ``n_chars`` counted anew.  A text from which nothing is
    removed stays as it is, null too; an empty table stays empty."""
    docs, back = set_aside(docs, suffix.COLUMNS)
    left = own_names(docs, ["_left"])["_left"]
    out = suffix.remove_repeats(docs, length=PASSAGE_BYTES, least_words=PASSAGE_WORDS, decode=left)
    cut = F.col("n_removed") > 0
    out = out.withColumn("text", F.when(cut, F.col(left)).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(cut, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return back(out)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The curriculum: as many copies of each document as the mix takes whole, in training
    order.  Documents without words have no training position and are left out, as are
    those beyond the target of their source; an empty table stays empty."""
    docs, back = set_aside(docs, mixing.COLUMNS)
    return back(mixing.mixed_copies(docs))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents packed into sequences of 1024 tokens, one row a piece.  A
    null or empty text is one piece with the end token; an empty table gives no piece."""
    return packing.pack_documents(docs, TOKENIZER, RANKS)


STAGES = [
    ("quality_classifier", drop_low_quality),
    ("minhash_near_dedup", drop_near_duplicates),
    ("suffix_array_dedup", drop_repeated_passages),
    ("mixing_to_target_weights", mix_sources),
    ("best_fit_packing", pack_sequences),
]

#: The stages cannot be said in SQL; tests hold each against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; every stage but the last is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs, name)
    return docs
