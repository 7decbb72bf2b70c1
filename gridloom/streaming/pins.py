"""Streams bound to a sheet: each micro-batch becomes the pinned table, formulas over it are evaluated anew."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..plans.scratch import place


def stream_of(spark: SparkSession, path: str) -> DataFrame:
    """A Parquet table read as a stream, with the schema of the files there. A table may be a folder or a single file."""
    folder_, name = path.rstrip("/").rsplit("/", 1)
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    single = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(where).isFile()
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    return reader.option("pathGlobFilter", name).parquet(folder_) if single else reader.parquet(path)


def windowed(events: DataFrame, width: str, late: str, *keys: str) -> DataFrame:
    """Counts and sums of value by event-time window; rows later than `late` behind the newest are dropped by the watermark."""
    out = events.withWatermark("ts", late).groupBy(F.window("ts", width), *keys)
    return out.agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), *keys, "n", "total")


def pinned(stream: DataFrame, evaluate: Callable[[DataFrame], DataFrame], path: str, merge_keys: list[str], order: str, buckets: int = 64) -> StreamingQuery:
    """Keeps the latest row of each key as snapshots at path/batch=N and the formulas' results at path/result=N.

    A batch is written to folders of its own number, so a batch that is run
    again after a failure replaces what it wrote.
    """
    spark = stream.sparkSession
    fs = spark.sparkContext._jvm.org.apache.hadoop.fs

    def there(at: str) -> bool:
        where = fs.Path(at)
        return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)

    def step(batch: DataFrame, number: int) -> None:
        before = f"{path}/batch={number - 1}"
        rows = batch if number == 0 or not there(before) else spark.read.schema(batch.schema).parquet(before).unionByName(batch)
        fields = F.struct(*[F.col(c) for c in batch.columns if c not in merge_keys])
        latest = rows.groupBy(*merge_keys).agg(F.max_by(fields, F.col(order)).alias("_last")).select(*merge_keys, "_last.*").select(*batch.columns)
        latest.write.mode("overwrite").parquet(f"{path}/batch={number}")
        evaluate(spark.read.schema(batch.schema).parquet(f"{path}/batch={number}")).write.mode("overwrite").parquet(f"{path}/result={number}")

    return stream.writeStream.foreachBatch(step).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()


def run_to_end(df: DataFrame, name: str, mode: str = "complete") -> DataFrame:
    """All of a stream's present input, as a table: written by its sink, then read."""
    spark = df.sparkSession
    path = place(spark, f"stream-{name}")

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/out")

    query = df.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(df.schema).parquet(f"{path}/out")
