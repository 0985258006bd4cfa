"""A corpus from raw documents to packed token sequences, one operator a stage.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written and read
again as the next one's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from doclathe.llm import mixing, packing, quality_rules, simhash, suffix_dedup
from doclathe.llm._shared import WORD, bounded_batches, scratch, stored, unused

#: A passage has over 50 words, however short; strings of so many bytes go as well, whatever
#: their words, so that text without spaces is covered.
PASSAGE_WORDS = 51
PASSAGE_BYTES = 250


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail their own rule, or whose host is rejected, go.

    Null and empty texts fail; null hosts are a host; rows alike are judged alike and stay as
    often as they came; no rows give none; columns of any name stay as they are.
    """
    bounded_batches(spark)
    return quality_rules.keep_good(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: five-word shingles, likeness 0.8 or more.

    That of least doc_id, null last. Null and blank texts are one group, and so are rows alike;
    no rows give none; columns of any name stay as they are.
    """
    bounded_batches(spark)
    return simhash.near_dedup(docs)


def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that repeat are cut out, all copies; documents of which no word is left go.

    Null and empty texts have no word. Rows alike are copies: from PASSAGE_BYTES on nothing is
    left of them. A text that is cut has its new n_chars. No rows give none; other columns of
    any name stay as they are.
    """
    bounded_batches(spark)
    cut = unused("cut", docs.columns)
    out = suffix_dedup.dedup(docs, PASSAGE_BYTES, PASSAGE_WORDS, cut)
    changed, kept = F.col(f"{cut}.n_removed") > 0, F.col(f"{cut}.kept_text")
    text = F.when(changed, kept).otherwise(F.col("text"))
    n_chars = F.when(changed, F.length(kept).cast("long")).otherwise(F.col("n_chars"))
    left = F.rlike(text, F.lit(WORD))
    return out.where(left).withColumns({"text": text, "n_chars": n_chars}).select(*docs.columns)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it, repeats as rows of their own; shorter texts have better odds.

    Null and blank texts have size 0 and fill no target: they are taken as their source's
    whole copies say. Null sources are a source; rows alike are taken alike; no rows give
    none; columns of any name stay as they are.
    """
    mix = unused("mix", docs.columns)
    out = mixing.pareto_mix(docs, prefer=mixing.shorter_first, name=mix).where(F.col(f"{mix}.copies") > 0)
    return out.withColumn(mix, F.explode(F.sequence(F.lit(1).cast("long"), F.col(f"{mix}.copies")))).select(*docs.columns)


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' pieces and their places in sequences of 2048 tokens.

    Null and empty texts are one token; rows alike are pieces of their own; no rows give none;
    other columns don't matter.
    """
    bounded_batches(spark)
    return packing.pack(packing.pieces(docs, packing.word_tokenizer()))


STAGES = [("quality rules", quality), ("SimHash near-dedup", near_copies), ("suffix-array dedup", passages), ("mixing sources to target weights", mixture), ("best-fit packing", sequences)]

#: Hashing, sampling and token counts aren't expressible in SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages on documents, each stage's frame written and read again; earlier ones are deleted."""
    with scratch(spark):
        docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
        for _, stage in STAGES[:-1]:
            docs = stored(stage(spark, docs, sf_dir), "stage")
        return STAGES[-1][1](spark, docs, sf_dir)
