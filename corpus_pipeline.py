"""The corpus pipeline: toxicity, line dedup, near-duplicates, decontamination, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet
and read again as the next one's docs; all but the last return the columns of documents.

Cases: a null or empty text is a document like any other (of those that hold no words one
stays, and it packs to its end id); a very long text is judged whole; rows are judged by
doc_id and text, so a doc_id with two texts can lose either, and rows repeated whole leave
one; an empty table gives no rows; columns besides those of documents are not carried.
run() keeps the stages' tables in a folder of its own under spark.checkpoint.dir, as the
rows it returns are read from there.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm import decontaminate, linededup, nearcopies, packing, toxicity
from quillspark.llm.common import shared_folder, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the chain rejects go."""
    return toxicity.keep_clean(docs.select(*COLUMNS), table(spark, sf_dir, "labels"))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated chunks and passages of lines stay where they are first; documents all stay, with what is left of them."""
    return linededup.line_dedup(docs.select(*COLUMNS), passages=True).select(*COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of linked documents the one with the least doc_id stays (then the least hash, and one of equal rows); those without words are linked with each other."""
    docs = docs.select(*COLUMNS)
    kept = docs.withColumn("th", F.xxhash64("text")).join(nearcopies.others(docs), ["doc_id", "th"], "left_anti")
    return kept.dropDuplicates(["doc_id", "th"]).select(*COLUMNS)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with any whole window of 13 benchmark words go, and those of which shorter items make up a twentieth of the words or more."""
    docs = docs.select(*COLUMNS)
    bad = decontaminate.report(docs, table(spark, sf_dir, "benchmark")).where("full or contaminated").select("doc_id", "th").distinct()
    return docs.withColumn("th", F.xxhash64("text")).join(bad, ["doc_id", "th"], "left_anti").select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of power-of-two length."""
    return packing.pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_repeated_lines),
    ("near_duplicates", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("packing", pack),
]

#: Several stages are beyond SQL; the tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what lies between them is written to the cluster's shared folder."""
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.mode("overwrite").parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
