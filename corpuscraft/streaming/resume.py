"""Incremental processing: a file stream that resumes where its checkpoint stands."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..operators.shared import passing, shared_folder


#: Fixed value: the state store that keyed state with timers needs.
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def base_of(spark: SparkSession, name: str | None) -> str:
    """Where a stream's checkpoint and rows are: those of a named stream stay, others go when the driver's process ends."""
    base = f"{shared_folder(spark)}/stream-{name or uuid.uuid4().hex}"
    if not name:
        passing(spark, base)
    return base


class Stream:
    """A stream over a folder of Parquet files that takes what is there and stops. Under one ``name`` every run continues the last one:
    files, watermark, state and timers stand in its checkpoint in the shared folder, and results are appended exactly once."""

    def __init__(self, spark: SparkSession, folder: str, schema: str | StructType, name: str | None = None, files: str = "*.parquet"):
        self.spark, self.source = spark, (folder, schema, files)
        self.base = base_of(spark, name)

    @classmethod
    def over(cls, table: DataFrame, name: str | None = None) -> Stream:
        """A stream over a table's own files."""
        files = table.inputFiles()
        folder, _, first = files[0].rpartition("/")
        return cls(table.sparkSession, folder, table.schema, name, first if len(files) == 1 else "*.parquet")

    def run(self, plan: Callable[[DataFrame], DataFrame]) -> int:
        """Runs ``plan`` over what is new; the number of rows that came too late for it."""
        folder, schema, files = self.source
        store, key = self.spark.conf.get("spark.sql.streaming.stateStore.providerClass"), "spark.sql.streaming.stateStore.providerClass"
        self.spark.conf.set(key, ROCKSDB)  # the query takes the setting it starts with
        try:
            rows = plan(self.spark.readStream.schema(schema).option("pathGlobFilter", files).parquet(folder))
            self.schema = rows.schema
            query = rows.writeStream.format("parquet").option("path", f"{self.base}/rows").option("checkpointLocation", f"{self.base}/checkpoint").trigger(availableNow=True).start()
        finally:
            self.spark.conf.set(key, store)
        query.awaitTermination()
        return sum(o["numRowsDroppedByWatermark"] for p in query.recentProgress for o in p["stateOperators"])

    @property
    def rows(self) -> DataFrame:
        """All that the runs so far have given."""
        return self.spark.read.schema(self.schema).parquet(f"{self.base}/rows")


def once_each(rows: DataFrame, key: str, at: str, lateness: str) -> DataFrame:
    """Each key once, in event time: a row that comes again within ``lateness`` of the newest one is known, an older one is late, and
    both change nothing. Keys are forgotten when the watermark has passed them, so the state stays bounded."""
    return rows.withWatermark(at, lateness).dropDuplicatesWithinWatermark([key])


def final_state(events: DataFrame, name: str | None = None) -> DataFrame:
    """Per user, count and best value, built by a stream over the table's files that resumes where it stood.

    The stream takes what is available and stops. Its checkpoint and state live under ``name`` in the shared folder: a second run
    under the same name reads new files only and adds to the state (a new name starts afresh). Each batch's partial sums go to a
    folder of the batch's own number, so a batch that is repeated after a failure replaces itself and nothing counts twice.
    """
    spark = events.sparkSession
    base = base_of(spark, name)
    files = events.inputFiles()
    folder = files[0].rsplit("/", 1)[0]
    pattern = files[0].rsplit("/", 1)[1] if len(files) == 1 else "*.parquet"
    stream = spark.readStream.schema(events.schema).option("pathGlobFilter", pattern).parquet(folder)

    def save(batch: DataFrame, number: int) -> None:
        part = batch.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.max("value").alias("best"))
        part.write.mode("overwrite").parquet(f"{base}/state/batch={number}")

    run = stream.writeStream.foreachBatch(save).option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start()
    run.awaitTermination()
    state = spark.read.schema("user_id " + events.schema["user_id"].dataType.simpleString() + ", n bigint, best double, batch int").parquet(f"{base}/state")
    return state.groupBy("user_id").agg(F.sum("n").alias("n"), F.round(F.max("best"), 6).alias("best"))


def new_rows(source: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Batch resume: the rows whose key the output does not have yet."""
    return source.join(done.select(key), key, "left_anti")
