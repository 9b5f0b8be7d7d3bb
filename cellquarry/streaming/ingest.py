"""Keyed ingestion that can stop and resume.

A sink table holds one row per key.  The same row again is nothing new; another
row under a known key is an error.  A fingerprint beside the table refuses to
resume under other settings.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Conflict(RuntimeError):
    pass


class KeyedTable:
    """A parquet table of rows by key with a settings fingerprint."""

    def __init__(self, spark: SparkSession, path: str, key: str, fingerprint: str) -> None:
        self.spark, self.path, self.key = spark, path, key
        self._guard(fingerprint)

    def _exists(self, path: str) -> bool:
        place = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return place.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(place)

    def _guard(self, fingerprint: str) -> None:
        mark = f"{self.path}/fingerprint"
        if self._exists(mark):
            if (found := self.spark.read.text(mark).first()[0]) != fingerprint:
                raise Conflict(f"made with other settings: {found}")
        else:
            self.spark.createDataFrame([(fingerprint,)], "value string").coalesce(1).write.text(mark)

    def read(self) -> DataFrame | None:
        return self.spark.read.parquet(f"{self.path}/rows") if self._exists(f"{self.path}/rows") else None

    def pending(self, rows: DataFrame) -> DataFrame:
        """Rows whose key is not done yet."""
        done = self.read()
        return rows if done is None else rows.join(done.select(self.key), self.key, "left_anti")

    def add(self, rows: DataFrame) -> None:
        """Appends new keys; equal rows are skipped, a changed row of a known key raises."""
        columns = sorted(rows.columns)
        mark = lambda df: df.select(self.key, F.xxhash64(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})).alias("h"))
        distinct = rows.dropDuplicates()
        if not mark(distinct).groupBy(self.key).count().where("count > 1").isEmpty():
            raise Conflict("a key has several rows")
        done = self.read()
        if done is not None:
            changed = mark(distinct).join(mark(done).withColumnRenamed("h", "h2"), self.key).where("h <> h2")
            if (row := changed.first()) is not None:
                raise Conflict(f"changed under a known key: {row[self.key]}")
        self.pending(distinct).write.mode("append").parquet(f"{self.path}/rows")

    def consolidate(self) -> DataFrame:
        """All rows in key order."""
        done = self.read()
        if done is None:
            raise ValueError("nothing is done yet")
        return done.orderBy(self.key)


def run_available(stream: DataFrame, table: KeyedTable, checkpoint: str, transform: Callable[[DataFrame], DataFrame] = lambda df: df) -> None:
    """Drains what a stream has now into the table; bounded by the source's maxFilesPerTrigger."""

    def each(batch: DataFrame, _: int) -> None:
        table.add(transform(batch))

    query = stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def windowed_counts(events: DataFrame, time: str, key: str, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts per window and key with a watermark (an extension for unbounded sources)."""
    return events.withWatermark(time, late).groupBy(F.window(time, width).alias("w"), key).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), key, "n")
