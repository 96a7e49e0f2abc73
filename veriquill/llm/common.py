"""What the operators of this subpackage share: reading, batching, cutting lineage."""

from __future__ import annotations

import os
import tempfile
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Words are runs of characters other than these (ASCII white space).
WHITE = r"[\x20\x09-\x0D]+"
#: Rows and bytes of one Arrow batch: long texts must not meet by the thousand in one worker.
BATCH_ROWS, BATCH_BYTES = 512, 16 << 20
#: Rows up to which the planner may send a table to all executors through the driver.
SENT_ROWS = 50_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the data directory, by a path that only Spark needs to understand."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bounded_batches(spark: SparkSession) -> None:
    """Keep Arrow batches small, whatever the length of the texts in them."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def map_batches(df: DataFrame, make: Callable[[pa.RecordBatch], dict[str, list]], schema: T.StructType, rows: int = BATCH_ROWS) -> DataFrame:
    """mapInArrow with a function from a batch, of so many rows at most, to columns; the number of rows may change."""
    from pyspark.sql.pandas.types import to_arrow_schema

    bounded_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = to_arrow_schema(schema)
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                columns = make(batch.slice(at, rows))
                yield pa.RecordBatch.from_arrays([pa.array(columns[f.name], type=f.type) for f in out], schema=out)

    return df.mapInArrow(run, schema)


def id_field(df: DataFrame, id_col: str, name: str | None = None) -> T.StructField:
    """The identifier's field as the input has it, nullable."""
    return T.StructField(name or id_col, df.schema[id_col].dataType, True)


def shared_folder(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: the session's spark.checkpoint.dir.

    Only on a single machine, where the setting may be absent, is one chosen here; a cluster without it is an error, as
    no folder of one machine can hold what executors write.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = os.path.join(tempfile.gettempdir(), "veriquill")
    return folder


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage by a checkpoint in the shared folder."""
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def merged(rows: int, *sides: DataFrame) -> tuple[DataFrame, ...]:
    """The sides of a join, of which the smaller has so many rows: with many it is a merge join, and nothing goes through the driver.

    The planner's threshold is of compressed bytes, and the driver holds each broadcast table several times over.
    """
    return tuple(df.hint("merge") for df in sides) if rows > SENT_ROWS else sides


def removed(spark: SparkSession, folder: str) -> None:
    """Delete a folder that nothing reads any more, by whatever file system it is on."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def narrow(df: DataFrame, **columns: str) -> DataFrame:
    """Only the named columns, under fixed names; other columns of the input cannot clash."""
    return df.select(*[F.col(f"`{old}`").alias(new) for new, old in columns.items()])


def positional(df: DataFrame, *columns: str) -> tuple[DataFrame, list[str]]:
    """df with columns c0, c1, ... in place of its own names, and the new names of the given ones.

    Whatever an operator adds cannot clash then; `renamed_back` undoes it.
    """
    return df.toDF(*[f"c{i}" for i in range(len(df.columns))]), [f"c{df.columns.index(c)}" for c in columns]


def renamed_back(df: DataFrame, like: DataFrame, *added: str) -> DataFrame:
    """The positional columns under the names of `like`, and the added ones, which take the place of any of the same name."""
    taken = {a.lower() for a in added}
    own = [F.col(f"c{i}").alias(c) for i, c in enumerate(like.columns) if c.lower() not in taken]
    return df.select(*own, *added)
