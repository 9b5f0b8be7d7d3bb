"""Tables in the folder that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``.

    Only where that is unset and the master is local, as in tests on one machine,
    a temporary folder is made and set; on a cluster every executor would write to
    a disk of its own, so there it raises.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError(f"spark.checkpoint.dir must name a folder that driver and executors share (master {master})")
        found = "file://" + tempfile.mkdtemp(prefix="cellquarry-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` to a table in the shared folder and reads it back.

    This cuts the lineage at a copy that outlives lost executors.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Rows of a partition that a task sorts or groups.
TASK_ROWS = 1_000_000


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` dealt by ``keys`` to so many partitions that each has about `TASK_ROWS` rows.

    The size of a partition is else chosen by its bytes on disk, and rows that
    compress well are many times larger in a task's memory.
    """
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(max(least, -(-df.count() // TASK_ROWS)), *keys)


def drop_stored(*tables: DataFrame) -> None:
    """Deletes the files of tables made by `stored` that nothing reads any more."""
    for df in tables:
        spark = df.sparkSession
        root = shared_dir(spark)
        jvm = spark._jvm
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            path = jvm.org.apache.hadoop.fs.Path(folder)
            if path.toUri().getPath().startswith(jvm.org.apache.hadoop.fs.Path(root).toUri().getPath()):
                path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
