"""Where intermediate tables go, and how the operators read their inputs."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Ids handed to a broadcast semi join: 2 million longs are about 32 MB as a hashed relation.
BROADCAST_ROWS = 2_000_000


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only where that is unset on one machine, as in tests, a temporary folder is set; on a
    cluster that is an error, as executors would write to their own disks.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        found = spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="markloom-"))
        found = spark.sparkContext.getCheckpointDir()
    return found.rstrip("/")


def clean_up(spark: SparkSession) -> None:
    """Delete all tables that operators wrote to the shared folder; results not yet written elsewhere are lost."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/markloom")
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def new_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/markloom/{tag}-{uuid.uuid4().hex}"


#: Rows of an Arrow batch in eager steps: whole texts of the default 10,000 rows would take too much at once.
BATCH_ROWS = 2_000
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def materialise(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back.

    This cuts the lineage: a lost executor re-reads files instead of recomputing, and
    values such as partition numbers can't change between two uses.
    """
    spark = df.sparkSession
    path = new_path(spark, tag)
    before = spark.conf.get(_BATCH)
    spark.conf.set(_BATCH, str(min(BATCH_ROWS, int(before)) if int(before) > 0 else BATCH_ROWS))
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_BATCH, before)
    return spark.read.schema(df.schema).parquet(path)


def trimmed(run):
    """A mapInArrow function that gives freed memory back to the system when a task is done."""

    def whole(batches):
        yield from run(batches)
        import ctypes

        import pyarrow as pa

        pa.default_memory_pool().release_unused()
        libc = ctypes.CDLL(None)
        if hasattr(libc, "malloc_trim"):
            libc.malloc_trim(0)

    return whole


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def semi_by_id(big: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Rows of ``big`` whose ``key`` is in ``ids`` (distinct, already materialised).

    The id list is broadcast only when its counted rows stay under BROADCAST_ROWS;
    beyond that it is an ordinary shuffled semi join.
    """
    n = ids.count()
    return big.join(F.broadcast(ids) if n <= BROADCAST_ROWS else ids, key, "left_semi")


def without(docs: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    """Rows of ``docs`` whose ``key`` is not in the one column of ``gone`` (distinct, materialised); columns unchanged, whatever their names."""
    name = f"_gone_{uuid.uuid4().hex}"
    gone = gone.toDF(name)
    ids = F.broadcast(gone) if gone.count() <= BROADCAST_ROWS else gone
    return docs.join(ids, docs[key] == ids[name], "left_anti")
