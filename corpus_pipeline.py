"""Corpus pipeline: quality, near duplicates, repeated passages, benchmark contamination, packing.

Columns have plain names while an operator works, so none of the input clashes with one it adds.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarn.llm import contamination, neardup, packing, passages, quality, tokens
from tarn.llm.queries import tokenizer_path
from tarn.shared import discard, written


def _plain(docs: DataFrame) -> tuple[DataFrame, dict[str, str], list[str]]:
    """The documents with columns c0, c1, ..., the plain name of each column, and all plain names."""
    names = [f"c{i}" for i in range(len(docs.columns))]
    return docs.toDF(*names), dict(zip(docs.columns, names)), names


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    plain, of, names = _plain(docs)
    judged = quality.quality_rules(plain, names, of["text"], of["lang"], of["source"])
    return judged.filter("quality.kept").select(*names).toDF(*docs.columns)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates stays, that of the least id."""
    plain, of, names = _plain(docs)
    return neardup.near_duplicates(plain, names, of["text"], of["doc_id"]).filter("stays").select(*names).toDF(*docs.columns)


def repeated_passage_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words in passages of earlier documents go; a document that loses words is the rest, joined by
    one space, and goes if nothing is left. Others stay as they are."""
    plain, of, names = _plain(docs)
    left = passages.remove_repeats(plain, names, of["text"], of["doc_id"]).filter("n_removed = 0 or n_removed < n_words")
    now = {of["text"]: F.col("kept"), of["n_chars"]: F.length("kept").cast(docs.schema["n_chars"].dataType)}
    return left.select(*(F.when(F.col("n_removed") > 0, now[c]).otherwise(F.col(c)).alias(c) if c in now else c for c in names)).toDF(*docs.columns)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which a twentieth or more lies in benchmark windows go."""
    plain, of, names = _plain(docs)
    found = contamination.find_benchmark(plain, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), names, of["text"])
    return found.filter(~contamination.is_contaminated()).select(*names).toDF(*docs.columns)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 4096 ids and their places in sequences."""
    encoded = tokens.encode_texts(docs, tokenizer_path(), ["doc_id"], end_id=1)
    pieces = packing.cut(encoded, ["doc_id"]).withColumn("ids_crc32", F.crc32("ids"))
    return packing.pack(pieces, ["doc_id", "piece", "start", "length", "ids_crc32"])


STAGES = [
    ("quality rules", quality_stage),
    ("near duplicates", near_duplicate_stage),
    ("repeated passages", repeated_passage_stage),
    ("benchmark decontamination", decontamination_stage),
    ("best-fit packing", packing_stage),
]
#: Alignment, sketches and tokenization are beyond SQL; tests/llm compares run() with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        before, docs = docs, stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs, f"stage{k}")
            discard(before)  # the documents themselves were not written here, so they stay
    return docs
