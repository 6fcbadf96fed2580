"""What the text operators share: table access, batch size, checkpoints, temporary column names."""

from __future__ import annotations

import contextlib
import gc
import time
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.session import shared_folder

#: Rows that a Python worker takes from a batch at once: texts are long, so far fewer than a batch holds.
BATCH_ROWS = 1000

#: The word definition of every operator here: runs of anything but ASCII white space.
SPACE = r"[\x20\x09-\x0D]+"
BLANKS = " \t\n\x0b\x0c\r"

FILE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sliced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches in slices of BATCH_ROWS, which bounds the Python objects made of one."""
    for batch in batches:
        for at in range(0, batch.num_rows, BATCH_ROWS):
            yield batch.slice(at, BATCH_ROWS)


def field(df: DataFrame, name: str) -> T.StructField:
    """The named column's field, nullable."""
    found = df.schema[name]
    return T.StructField(found.name, found.dataType, True)


def place(id_col: str) -> Column:
    """An id of any type as what documents are ordered by: null ids come last and are equal."""
    return F.struct(F.col(id_col).isNull().alias("late"), F.col(id_col).alias("id"))


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder in whatever file system it is."""
    found = spark._jvm.org.apache.hadoop.fs.Path(path)
    found.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(found, True)


def cut(df: DataFrame) -> DataFrame:
    """Computes df once and cuts its lineage, with files in the shared folder.

    Where spark.cleaner.referenceTracking.cleanCheckpoints is true, Spark deletes
    them when the driver no longer holds df.
    """
    shared_folder(df.sparkSession)
    return df.checkpoint()


def release(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files, and what else the driver no longer holds, now: else they stay until its memory runs short.

    The last job's are held until Python's objects have been let go of, which a
    thread does, and until another job has run.
    """
    gc.collect()
    time.sleep(0.5)
    spark.range(1).count()
    spark._jvm.System.gc()


@contextlib.contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of a query that is both planned and run within go when it ends, not when the driver next collects its garbage.

    What is run again from such a plan computes its shuffles anew.
    """
    before = spark.conf.get(FILE_CLEANUP, "false")
    spark.conf.set(FILE_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(FILE_CLEANUP, before)


def computed(df: DataFrame, **columns) -> DataFrame:
    """df with the columns added, each computed once for each row.

    They pass through a generator of one row, as the optimizer would move a
    later filter below a projection, and so write an expression out wherever it
    is used, into the bodies of lambda functions too. Columns that have the
    names are replaced.
    """
    return df.select(*(c for c in df.columns if c not in columns), F.inline(F.array(F.struct(*(c.alias(name) for name, c in columns.items())))))
