"""Small helpers that the training-data operators share."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: What separates words: space, tab, line feed, vertical tab, form feed, carriage return.
SPACES = r"[\x20\x09-\x0D]+"

#: Rows that a worker holds as Python objects at once. Spark bounds the Arrow batch itself, by rows and bytes.
PIECE_ROWS = 256


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words_of(text: Column) -> Column:
    """Words of a text; null and blank texts have none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACES), "")


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; a local folder where the session names none and all tasks run on this machine."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
    return "/tmp/folioframe-checkpoints"


def tidy() -> None:
    """Gives freed memory back to the system, so that a worker doesn't keep what its last task needed."""
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of the GNU C library
    if trim:
        trim(0)
    pa.default_memory_pool().release_unused()


def tidied(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """run, with a tidy worker at its end."""

    def out(batches: Iterator) -> Iterator:
        yield from run(batches)
        tidy()

    return out


def map_rows(df: DataFrame, make: Callable[[], Callable[[list], list]], schema: str) -> DataFrame:
    """Applies ``make()(rows)`` to pieces of batches; ``make`` runs once in a task.

    ``rows`` is a list of tuples in the order of df's columns, the result is a
    list of tuples in the order of ``schema``.
    """
    names = [x.split()[0] for x in schema.split(", ")]
    arrow = [_ARROW[x.split()[1]] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for b in (x.slice(at, PIECE_ROWS) for x in batches for at in range(0, x.num_rows, PIECE_ROWS)):
            out = work(list(zip(*(c.to_pylist() for c in b.columns))))
            cols = list(zip(*out)) if out else [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(list(c), type=t) for c, t in zip(cols, arrow)], names=names)

    return df.mapInArrow(tidied(run), schema)


_ARROW = {
    "long": pa.int64(),
    "int": pa.int32(),
    "double": pa.float64(),
    "boolean": pa.bool_(),
    "string": pa.string(),
    "binary": pa.binary(),
    "array<long>": pa.list_(pa.int64()),
    "array<int>": pa.list_(pa.int32()),
}


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, with as many underscores before them as it takes to clash with no column of df."""
    taken = {c.lower() for c in df.columns}
    lead = "__"
    while any(lead + n in taken for n in names):
        lead += "_"
    return [lead + n for n in names]


#: Rows of one or two numbers up to which a table is sent to all tasks.
SMALL = 500_000


def small(df: DataFrame) -> DataFrame:
    """df, marked for broadcast where it has few rows; beyond, joins shuffle."""
    return F.broadcast(df) if df.limit(SMALL + 1).count() <= SMALL else df


def checkpointed(df: DataFrame) -> DataFrame:
    """Cuts the lineage by a reliable checkpoint in ``spark.checkpoint.dir``.

    Sets a folder of its own only where the session names none, as in tests.
    """
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(shared_folder(spark))
    return df.checkpoint()


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder that this library wrote, in whatever store it is."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
