"""Where tables that queries make for themselves are kept, and how they go."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Tasks that what one split of an input gives is dealt out to.
TASKS_A_SPLIT = 16
_made: dict[str, SparkSession] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; where it is unset (tests, local mode), a temporary one."""
    path = spark.sparkContext.getConf().get("spark.checkpoint.dir") or getattr(spark, "_tables_dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a shared folder on a cluster")
        path = spark._tables_dir = "file://" + tempfile.mkdtemp(prefix="scriptorium-")
    return path


def new_table(spark: SparkSession, name: str) -> str:
    """A path in the shared folder for a table that goes when the driver's process ends, or earlier by drop()."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _made[path] = spark
    return path


def written(df: DataFrame, name: str, **options: str) -> DataFrame:
    """df as a Parquet table in the shared folder."""
    path = new_table(df.sparkSession, name)
    df.write.options(**options).parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._table = path
    return out


def shuffle_tasks(scan: DataFrame) -> int:
    """How many tasks to deal out what is made of a scan: more where it has more splits, so that none of them grows with it."""
    return max(int(scan.sparkSession.conf.get("spark.sql.shuffle.partitions")), TASKS_A_SPLIT * scan.rdd.getNumPartitions())


def drop(*tables: DataFrame) -> None:
    """Deletes tables of written(). Nothing may read them any more."""
    for table in tables:
        _delete(table._table, _made.pop(table._table))


def _delete(path: str, spark: SparkSession) -> None:
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


@atexit.register
def _leave() -> None:
    for path, spark in _made.items():
        with contextlib.suppress(Exception):  # a stopped session's tables stay
            _delete(path, spark)
    _made.clear()
