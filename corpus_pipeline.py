"""The corpus pipeline: toxicity, line dedup, SimHash near-dedup, source mixing, packing, each on what the one before kept.

Every stage takes any extra columns, whatever their names, and all but the last return the columns of its input. An empty table
gives an empty table of the same columns.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reviewlake.llm import lines, mixing, packing, similar, toxicity
from reviewlake.llm.common import delete, scratch, shared_dir, table


def whole_rows(docs: DataFrame) -> DataFrame:
    """doc_id, text, and all columns as one struct, so that no name can clash with an operator's."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.struct(*(docs[f"`{c}`"] for c in docs.columns)).alias("row"))


def unfolded(rows: DataFrame, docs: DataFrame) -> DataFrame:
    return rows.select(*(F.col("row").getField(c).alias(c) for c in docs.columns))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored at toxicity.REJECT or more go.

    A null or empty text scores as one without terms; repeated rows all stay or all go; a null doc_id is judged like others.
    """
    machine = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return unfolded(toxicity.toxicity(whole_rows(docs), machine, keep=("row",)).where(F.col("score") < toxicity.REJECT), docs)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that many documents hold go from the text; n_chars follows.

    A null text stays null; a document that loses all lines stays with the empty text; repeated rows lose the same lines; a
    null doc_id loses nothing.
    """
    kept = lines.drop_lines(docs)
    text = F.when(F.col("row.text").isNotNull(), F.col("kept"))
    new = kept.select(F.col("row").withField("text", text).alias("row"))
    if "n_chars" in docs.columns:
        new = new.select(F.col("row").withField("n_chars", F.char_length("row.text").cast(docs.schema["n_chars"].dataType)).alias("row"))
    return unfolded(new, docs)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: the one with the smallest id.

    Near copies are documents whose sets of five-word shingles have a similarity of 0.8 or more, by SimHash fingerprints of 256 bits.
    Null and empty texts are near copies of each other; rows that share the doc_id that stays all stay; documents without an id all stay.
    """
    groups = similar.similar_documents(docs).where("doc_id <> component_id").select(F.col("doc_id").alias("gone")).distinct()
    rows = whole_rows(docs).alias("d")
    return unfolded(rows.join(groups.alias("g"), F.col("d.doc_id") == F.col("g.gone"), "left_anti"), docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of small sources come up to mixing.MAX_REPETITION times and a part of one more; every row stays at least once.

    A null or empty text counts as one token; a null source is a source of its own; repeated rows are each dealt.
    """
    return unfolded(mixing.mix_sources(docs), docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 2048 ids. A null or empty text is the end id alone; repeated rows are packed each."""
    path = public_tokenizers.path
    return packing.pack(docs, path("byte_bpe_50k.json"), path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, with_ids=False)


STAGES = [("toxicity", drop_toxic), ("line_dedup", drop_lines), ("simhash", one_of_each_group), ("mixing", mix), ("packing", pack)]
#: A learned score and a tokenizer are not SQL; tests hold every stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on documents. What a stage wrote on the side goes when it is done, its result when the next one is written."""
    docs, last = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        with scratch(spark):
            stage(spark, docs, sf_dir).write.parquet(path)
        if last:
            delete(spark, last)
        docs, last = spark.read.parquet(path), path
    return docs
