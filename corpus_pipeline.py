"""A corpus pipeline: drop toxic documents, repeated passages, near copies and contaminated documents, then encode.

Each stage takes ``(spark, docs, sf_dir)``; what it returns is written as Parquet and reread as the
next stage's ``docs``. All stages but the last pass on the columns of ``documents`` as they are; ``n_chars`` follows
the text where a stage changes it. The last one returns ids, counts and digests by document.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrafold.llm import bpe, decontaminate, line_dedup, simhash, toxicity
from terrafold.llm.common import materialize
from terrafold.llm.queries import table, vocabulary


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents that aren't predicted toxic; the labels are those of the tables."""
    return toxicity.drop_toxic(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def _free(name: str, docs: DataFrame) -> str:
    """``name``, with as many underscores before it as it takes to clash with no column, however it is spelt."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Deletes aligned common blocks from later documents; a document of which nothing is left goes."""
    lost = _free("lost", docs)
    out = line_dedup.line_dedup(docs, out_col=lost)
    chars = F.when(F.col(f"{lost}.n_deleted") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")).alias("n_chars")
    return out.where(f"{lost}.n_deleted = 0 or trim(text) <> ''").select(*(chars if c == "n_chars" else F.col(f"`{c}`") for c in docs.columns))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash group stays: the first by row number, so that repeated and null ids are no special case."""
    row = _free("row", docs)
    numbered = materialize(docs.withColumn(row, F.monotonically_increasing_id()), "numbered")
    groups = simhash.simhash_groups(numbered, id_col=row)
    return numbered.join(groups.where("doc_id = component_id").select(F.col("doc_id").alias(row)), row, "left_semi").select(*(F.col(f"`{c}`") for c in docs.columns))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.bpe_round_trip(docs, vocabulary("byte_bpe_50k.json"), with_ids=True)


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", drop_repeated_passages),
    ("near copies", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("encoding", encode),
]
#: SQL can't express these stages; the tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name.replace(' ', '-')}")
    return docs
