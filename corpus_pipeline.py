"""A corpus pipeline: toxicity, line dedup, SimHash near-dedup, benchmark decontamination, best-fit packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as the next
stage's docs. All stages but the last return the columns of documents; the last returns the packed pieces.

In every stage a null text is an empty one (and stays null), a null doc_id is as good as any and comes last, very long texts
are worked on whole, an empty table gives no rows, and columns of other names pass untouched. Rows that repeat doc_id and
text share their fate in toxicity, line dedup and decontamination; near dedup keeps one of them, packing packs each. Of
documents that resemble each other the first by doc_id, then by the hash of its text, stays.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from fieldloom.llm import decontaminate, linededup, packing, similar, toxicity
from fieldloom.llm.common import saved, table
from fieldloom.llm.tokens import default_path
from fieldloom.session import ship


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the labelled examples call toxic go."""
    return toxicity.without_toxic(docs, table(ship(spark), sf_dir, "labels"))


def cut_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of passages of 50 words or more are cut out of the texts; every document stays."""
    return linededup.without_repeated_lines(docs)


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """SimHash near dedup: of each group of documents that five-word shingles link at 0.8 or more the first stays."""
    ship(spark)
    return similar.without_similar(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which benchmark windows cover a 20th of the words or more go."""
    return decontaminate.decontaminated(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is left is packed into sequences of 4096 tokens."""
    ship(spark)
    return packing.packed(docs, default_path())


STAGES = [
    ("toxicity", reject_toxic),
    ("line_dedup", cut_repeated_lines),
    ("simhash_near_dedup", keep_one_of_each),
    ("decontamination", drop_contaminated),
    ("packing", pack),
]

#: SQL has no nearest-neighbour classifier with this calibration, no XXH64 and no tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = saved(stage(spark, docs, sf_dir), name)
    return docs
