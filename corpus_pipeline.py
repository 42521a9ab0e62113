"""Corpus preparation in five stages; counted as part of the subpackage tidemill.llm.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read
again as the next one's docs. All but the last return the columns of documents.

Decisions: documents scored as toxic go; of each group of near-duplicates the smallest id stays; bytes
that repeat an earlier 100-byte string are cut from texts (a document that is nothing but such bytes
keeps its row with an empty text; a character cut in two goes); documents that share a 10-word window
with the benchmark go; what is left is packed into sequences.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.llm import decontaminate, packing, simhash, suffix_dedup, toxicity
from tidemill.llm._shared import fresh_dir
from tidemill.llm.queries import held_out

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Train on the labels outside the held-out fold; documents with a score of 0.5 or more go. Decided row by row: a
    null or empty text scores like a text without a toxic word, repeated rows alike; without labels of both classes all stay."""
    docs = docs.select(*COLUMNS)
    model = toxicity.train(docs, _table(spark, sf_dir, "labels").where(~held_out()))
    return toxicity.keep_below(docs, model)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of fingerprints within 3 bits one row stays: that of the smallest doc_id, or where ids are
    null or repeat, the first row in order of id (nulls first), then text."""
    docs = docs.select(*COLUMNS)
    found = docs.agg(F.count("*").alias("rows"), F.countDistinct("doc_id").alias("ids")).first()
    if found["rows"] == found["ids"]:
        rows = docs.withColumn("_rid", F.col("doc_id"))
    else:
        rows = suffix_dedup.numbered(docs.withColumn("_bytes", F.coalesce("text", F.lit("")).cast("binary")), "doc_id").drop("_bytes")
    near = simhash.near_duplicates(rows, id_column="_rid", shingle=3, radius=3)
    stay = near.where(F.col("id") == F.col("component")).select(F.col("id").alias("_id"))
    return rows.join(stay, F.col("_rid") == F.col("_id"), "left_semi").select(*COLUMNS)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the bytes that an earlier 100-byte string covers; n_chars follows. Earlier is by doc_id (null
    first), then by text; of equal rows all but one lose what is repeated. A null text becomes an empty one."""
    cut = suffix_dedup.remove_repeats(docs, length=100, keep=("lang", "source"), as_text=True)
    return cut.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that share a 10-word window with a benchmark item go (for an item of fewer words, all of them in a
    row). Decided row by row; null and empty texts stay; an empty benchmark drops nothing."""
    return decontaminate.remove_contaminated(docs.select(*COLUMNS), _table(spark, sf_dir, "benchmark"), window=10)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 1024 tokens, each with its sequence and place. A null or empty text is one piece, its end mark;
    repeated rows are packed each, null ids stay null; an empty table gives no pieces."""
    return packing.pack_documents(docs, capacity=1024, end=2)


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash_near_dedup", drop_near_duplicates),
    ("suffix_array_dedup", cut_repeats),
    ("benchmark_decontamination", drop_contaminated),
    ("best_fit_packing", pack),
]

#: The classifier and the suffix sort have no SQL form; the stages are tested one by one against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        at = fresh_dir(spark, name)
        stage(spark, docs, sf_dir).write.parquet(at)
        docs = spark.read.parquet(at)
    return docs
