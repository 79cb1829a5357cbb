"""What the operators of this subpackage share."""

from __future__ import annotations

import sys
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Rows of an Arrow batch that carries texts; Spark also ends a batch at 64 MB.
BATCH_ROWS = 1000
#: Keys that occur more than once and are broadcast at most.
BROADCAST_KEYS = 1 << 20


def shipped(module: str) -> None:
    """Send this module's functions to the executors by value, so that no path has to be shared."""
    cloudpickle.register_pickle_by_value(sys.modules[module])


shipped(__name__)


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which all executors share. Where it is unset, a local session gets one of its own; a cluster must name it."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp("checkpoints"))
    return context.getCheckpointDir()


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut the lineage in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """df as a Parquet table in the shared folder, and the table's path."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def removed(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def once(df: DataFrame, keys: list[str], limit: int = BROADCAST_KEYS) -> DataFrame:
    """df with one row for each value of keys, which aren't null. Only rows that share their keys are shuffled whole, unless over ``limit`` values are shared."""
    twice = checkpoint(df.groupBy(*keys).count().where("count > 1").select(*keys))
    n = twice.count()
    if n == 0 or n > limit:
        return df.dropDuplicates(keys) if n else df
    return df.join(F.broadcast(twice), keys, "left_anti").unionByName(df.join(F.broadcast(twice), keys, "left_semi").dropDuplicates(keys))


def fold(doc_id: str | Column, modulus: int) -> Column:
    """Whether crc32 of the id as text leaves 2; a null id is in no fold, so it is learned from."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string") if isinstance(doc_id, str) else doc_id.cast("string")) % modulus == 2, F.lit(False))


def map_texts(df: DataFrame, function: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str | StructType) -> DataFrame:
    """mapInArrow in small batches, as a row may hold a long text. The session's settings stay as they are."""
    rows = BATCH_ROWS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return function(b.slice(i, rows) for b in batches for i in range(0, max(1, b.num_rows), rows))

    return df.mapInArrow(run, schema)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def type_of(df: DataFrame, column: str) -> str:
    return dict(df.dtypes)[column]
