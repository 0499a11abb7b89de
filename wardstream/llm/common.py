"""Small helpers that several training-data operators share."""

from __future__ import annotations

import pickle
import tempfile
import uuid
from collections.abc import Callable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: A word is a run of anything but space, tab, line feed, vertical tab, form feed and carriage return.
WORD = r"[^\x20\x09-\x0D]+"
A_TO_Z = {i: i + 32 for i in range(65, 91)}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows and bytes that a function of map_rows sees at once: what a Python worker needs beside Spark's own batch.
PIECE_ROWS, PIECE_BYTES = 1000, 8 << 20


def pieces(batch: pa.RecordBatch, most: int) -> Iterator[pa.RecordBatch]:
    """The batch in slices of at most `most` rows and, as far as its rows are alike in size, PIECE_BYTES."""
    step = max(1, min(most, batch.num_rows * PIECE_BYTES // max(1, batch.nbytes)))
    return (batch.slice(a, step) for a in range(0, batch.num_rows, step))


def map_rows(df: DataFrame, rows: Callable[[pa.RecordBatch], dict], schema: StructType, most: int = PIECE_ROWS) -> DataFrame:
    """`mapInArrow` with one function from a piece of a batch to a dict of equally long columns.

    Spark bounds a batch by rows and by bytes (spark.sql.execution.arrow.maxBytesPerBatch), and a
    piece is smaller yet, so that memory doesn't depend on how the input is split.
    """
    names = [(f.name, f.dataType) for f in schema]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        to = to_arrow_schema(schema)
        for batch in batches:
            for piece in pieces(batch, most):
                out = rows(piece)
                yield pa.RecordBatch.from_arrays([c if isinstance(c := out[name], pa.Array) else pa.array(c, type=to.field(name).type) for name, _ in names], schema=to)

    return df.mapInArrow(run, schema)


def shared_folder(spark: SparkSession) -> str:
    """The folder for checkpoints that the session or the cluster names. One is made only where neither does and Spark runs on this machine alone."""
    sc = spark.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        named = sc.getConf().get("spark.checkpoint.dir", None)
        if not named and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="spark-"))
    return sc._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame, spark: SparkSession | None = None) -> DataFrame:
    """Cuts lineage with a checkpoint in the shared folder."""
    shared_folder(spark or df.sparkSession)
    return df.checkpoint()


def lower_ascii(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def crc_of_id(c: Column) -> Column:
    """crc32 of the id written as text; null ids count as the empty text."""
    return F.crc32(F.coalesce(c.cast("string"), F.lit("")).cast("binary"))


def fitted(sample: DataFrame, fit: Callable[[list[tuple]], object]) -> object:
    """What fit makes of the rows of a bounded sample, in one task of an executor: the driver gets the model alone.

    The rows come sorted, whatever the order in which they arrive; nulls come first.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [tuple(r.values()) for b in batches for r in b.to_pylist()]
        rows.sort(key=lambda r: [(x is not None, x if x is not None else 0) for x in r])
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(fit(rows))], pa.binary())], names=["model"])

    row = sample.repartition(1).mapInArrow(run, "model binary").first()
    return pickle.loads(row["model"]) if row else fit([])


def few_rows(df: DataFrame, most: int) -> bool:
    """True if there are at most that many rows; looks at no more than one row beyond."""
    return df.limit(most + 1).count() <= most


def all_of(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for each node of an undirected edge list; component is the smallest node reachable.

    Each round hangs every node below its smallest neighbour if that is smaller, follows the
    parents once more, and contracts the edges. Hubs aren't gathered: a node's smallest neighbour
    is a minimum, taken on both sides of the shuffle. Loops and null ends are left out.
    """
    e = edges.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).where("a < b").distinct()
    e = cut(e)
    nodes = e.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    labels = nodes.select("node", F.col("node").alias("component"))
    while not e.isEmpty():
        up = e.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("p"))
        upper = up.select(F.col("node").alias("p"), F.col("p").alias("pp"))
        up = cut(up.join(upper, "p", "left").select("node", F.coalesce("pp", "p").alias("p")))
        moved = up.select(F.col("node").alias("component"), "p")
        labels = cut(labels.join(moved, "component", "left").select("node", F.coalesce("p", "component").alias("component")))
        for side in ("a", "b"):
            e = e.join(up.select(F.col("node").alias(side), "p"), side, "left").select(
                *[F.coalesce("p", side).alias(side) if x == side else F.col(x) for x in ("a", "b")]
            )
        e = cut(e.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct())
    return labels


def written(df: DataFrame) -> DataFrame:
    """The rows written as Parquet beside the checkpoints, where all executors see them, and read again."""
    to = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(to)
    return df.sparkSession.read.parquet(to)


def packed(df: DataFrame, *beside: str) -> DataFrame:
    """Each row as a struct `row`, with some of its columns beside it: lets an operator that knows ids carry whole rows."""
    return df.select(F.struct(*df.columns).alias("row"), *beside)
