"""From raw documents to token ids: the stages of the training-data pipeline."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from jalur.llm.common import Table, ship


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score as toxic go."""
    from jalur.llm.toxicity import clean

    return clean(docs, ship(spark).read.parquet(f"{sf_dir}/labels.parquet"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of repeated runs of lines are cut; documents that this leaves without a word go."""
    from pyspark.sql import functions as F

    from jalur.llm.line_dedup import without_copies

    rows = without_copies(docs, report=True)
    cut = F.size("cut_places") > 0
    left = rows.where(~(cut & (F.col("text") == "")))
    return left.withColumn("n_chars", F.when(cut, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays."""
    from jalur.llm.simhash import one_of_each

    ship(spark)
    return one_of_each(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark passage go."""
    from jalur.llm.decontaminate import clean

    return clean(docs, ship(spark).read.parquet(f"{sf_dir}/benchmark.parquet"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every text gets its token ids (little-endian 32-bit numbers) and their count."""
    import public_tokenizers
    from pyspark.sql import functions as F

    from jalur.llm.bpe import encode

    ship(spark)
    # beside the other stages' workers there is memory for a smaller cache than operator 1 has alone
    rows = encode(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, pieces=200_000)
    return rows.withColumn("n_tokens", (F.octet_length("token_ids") / 4).cast("long"))


STAGES = [("toxicity", toxicity), ("line_dedup", line_dedup), ("simhash", near_duplicates), ("decontamination", benchmark), ("byte_bpe", tokens)]

#: Tries, automata and merges aren't SQL; tests/llm compares the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder and read again."""
    docs, last = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            table = Table(docs)
            if last:
                last.drop()  # what it held is in the new table
            docs, last = table.df, table
    return docs
