"""What the operators of this subpackage share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The bytes of ``[\x20\x09-\x0D]``; ``bytes.split()`` splits at exactly these.
BLANK = b" \t\n\x0b\x0c\r"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    The cluster names it in ``spark.checkpoint.dir``. Only a session without that setting (a local
    test) gets a temporary folder.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    named = tempfile.mkdtemp(prefix="spark-terrafold-")
    spark.conf.set("spark.checkpoint.dir", named)
    return named


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it again: the lineage ends there and a lost executor costs nothing."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def id_and_bytes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id`` and the text's UTF-8 bytes (null: empty); other columns of ``docs`` play no part."""
    return docs.select(
        F.col(f"`{id_col}`").cast("long").alias("doc_id"),
        F.coalesce(F.col(f"`{text_col}`"), F.lit("")).cast("binary").alias("text"),
    )


def per_document(docs: DataFrame, make: Callable[[], Callable[[list[bytes]], list[list]]], columns: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document with ``doc_id`` and ``columns``.

    ``make()`` runs once a task and returns a function from a batch of texts to one list per column.
    """
    schema = f"doc_id long, {columns}"
    source = id_and_bytes(docs, id_col, text_col)
    arrow = arrow_schema(source.sparkSession, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in batches:
            # pieces, so that a batch of long texts doesn't become one large block of Python objects
            for at in range(0, batch.num_rows, 512):
                piece = batch.slice(at, 512)
                out = work(piece.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([piece.column(0), *(pa.array(x, f.type) for x, f in zip(out, list(arrow)[1:], strict=True))], schema=arrow)

    return source.mapInArrow(run, schema)


def keep_rows(docs: DataFrame, make: Callable[[], Callable[[list[bytes]], list[bool]]], text_col: str = "text") -> DataFrame:
    """The rows whose text ``make()``'s function keeps, with all their columns: a filter in place, without a join."""
    place = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                piece = batch.slice(at, 512)
                texts = [x or b"" for x in piece.column(place).cast(pa.binary()).to_pylist()]
                yield piece.filter(pa.array(work(texts), pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def arrow_schema(spark: SparkSession, ddl: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(ddl))


def bucket(id_column: str, n: int):
    """crc32 of the id as text, modulo n (the folds of the labelled rows)."""
    return F.crc32(F.col(id_column).cast("string").cast("binary")) % n


def components(edges: DataFrame) -> DataFrame:
    """Connected components of edges ``(a, b)``: ``(node, root)`` for every node with an edge, root the smallest node.

    Alternating large-star and small-star steps (Kiveris et al., 2014). Minima are aggregated with a
    map-side part and joined back, so a node with very many neighbours is split by the skew join and
    never gathered. Each round ends in the shared folder.
    """
    edges = edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    edges = materialize(edges, "edges")
    before = None
    while True:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b")))).alias("e")).select("e.*").where("a != b").distinct()
        edges = materialize(small, "edges")
        now = tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if now == before:
            break
        before = now
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
