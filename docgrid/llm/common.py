"""Shared helpers: reading tables, cutting lineage, connected components."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir`` of
    the session, or a folder in the warehouse where that is unset."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    return found or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_shared"


def slices(batch: pa.RecordBatch, column: str, most: int) -> Iterator[pa.RecordBatch]:
    """A batch in parts of about ``most`` bytes of the string ``column``; a longer text is a part of its own."""
    end = np.cumsum(pc.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < batch.num_rows:
        before = int(end[at - 1]) if at else 0
        z = max(at + 1, int(np.searchsorted(end, before + most, "right")))
        yield batch.slice(at, z - at)
        at = z


def fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` has not, with or without regard to case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def row_key() -> Column:
    """rid: a digest of a row's id and text; rows with one id and one text share it."""
    return F.xxhash64(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("rid")


def first_of_each(docs: DataFrame, found: DataFrame) -> DataFrame:
    """``docs``, all columns, with one row of each class of ``found`` (doc_id, rid, component):
    that with the smallest doc_id; null ids come last, and of equal ids the text decides by a digest.

    Decided on ids and digests; texts are joined once, with the rows to remove, or with
    nothing where these are few enough to broadcast."""
    last = F.struct(F.col("doc_id").isNull(), "doc_id", "rid")
    rows = found.groupBy("component", "doc_id", "rid").agg(F.count("*").alias("n"))
    first = rows.groupBy("component").agg(F.min(last).alias("first")).select("component", F.col("first.rid").alias("stays"))
    marks = written(rows.join(first, "component").select("rid", (F.col("rid") == F.col("stays")).alias("keep"), "n"), "marks")
    key = fresh(docs, "rid")
    keyed = docs.withColumn(key, row_key())
    gone = marks.where("not keep or n > 1").select(F.col("rid").alias(key)).distinct()
    twice = marks.where("keep and n > 1").select(F.col("rid").alias(key)).distinct()
    once = keyed.join(gone, key, "left_anti")
    again = keyed.join(twice, key, "left_semi").dropDuplicates([key])
    return once.unionByName(again).select(*docs.columns)


@contextmanager
def small_batches(spark: SparkSession, rows: int = 1000) -> Iterator[None]:
    """Inside, tasks hand at most ``rows`` rows at a time to Python: batches of whole texts are held by the JVM and by each Python
    worker at once, and neither gives that memory back before it ends."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(rows if int(before) <= 0 else min(rows, int(before))))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


#: The tables that ``written`` makes within ``collected``, for the run that asked; other runs have lists of their own.
_OWN: ContextVar[list[str] | None] = ContextVar("own tables", default=None)


@contextmanager
def collected() -> Iterator[list[str]]:
    """The paths of the tables that ``written`` makes inside, in order."""
    own: list[str] = []
    token = _OWN.set(own)
    try:
        yield own
    finally:
        _OWN.reset(token)


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as a Parquet table in the shared folder and read again.

    The rows survive lost executors, and later plans start from the table. It stays until
    ``release``, as results that are not yet read may need it."""
    spark = df.sparkSession
    path = new_path(spark, name)
    own = _OWN.get()
    if own is not None:
        own.append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession, paths: list[str]) -> None:
    """Removes tables of ``written`` that nothing will read any more."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for path in paths:
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(conf).delete(where, True)


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Connected components of ``edges`` (u long, v long): node, root (the
    smallest node of the component). Nodes without an edge don't appear.

    Alternates large-star and small-star rounds. Each round is two partial
    aggregations (smallest neighbour) and joins on the node, so that a hub with
    very many neighbours is never gathered in one task. Rounds grow with the
    logarithm of the longest chain."""

    def star(links: DataFrame) -> DataFrame:
        """links (a, b) both ways or downwards: adds the smallest b of each a, or a itself."""
        least = links.groupBy("a").agg(F.least("a", F.min("b")).alias("m"))
        return links.join(least, "a")

    current = written(
        edges.where("u <> v").select(F.greatest("u", "v").alias("a"), F.least("u", "v").alias("b")).distinct(), "edges"
    )
    sign = None
    for _ in range(max_rounds):
        both = current.unionByName(current.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = star(both).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        down = star(large)
        small = (
            down.select(F.col("b").alias("a"), F.col("m").alias("b"))
            .unionByName(down.select("a", F.col("m").alias("b")))
            .where("a <> b")
            .distinct()
        )
        current = written(small, "edges")
        row = current.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()
        if tuple(row) == sign:
            return current.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
                current.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
            )
        sign = tuple(row)
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
