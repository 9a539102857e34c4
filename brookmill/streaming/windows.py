"""Streams of events from files: windowed counts, dropping of repeated events, and what a stream emits as a table."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brookmill.session import shared_folder


def events(spark: SparkSession, path: str) -> DataFrame:
    """A stream of the file or folder of files at path, with `ts` as the time zone aware type that watermarks ask for."""
    schema = spark.read.parquet(path).schema
    return spark.readStream.schema(schema).parquet(f"{path}*").withColumn("ts", F.col("ts").cast("timestamp"))


def in_batches(df: DataFrame, time: str, batches: int) -> DataFrame:
    """df as a stream of so many batches, each a stretch of the time from its first to its last row, in order.

    Rows are written to a folder of its own for each stretch, one after the
    other, and read as files, as many at a time as a stretch has: a source that
    goes on from where it stopped if it is run again.
    """
    spark, micros = df.sparkSession, F.unix_micros(F.col(time).cast("timestamp"))
    ends = df.agg(F.min(micros).alias("low"), F.max(micros).alias("high")).first()
    low, high = ends["low"] or 0, ends["high"] or 0
    folder = f"{shared_folder(spark)}/batches-{uuid.uuid4().hex}"
    stretch = F.least(F.floor((micros - low) * batches / F.lit(high - low + 1)), F.lit(batches - 1))
    # one file a stretch and task, so that a trigger takes files of one stretch only
    for n in range(batches):
        df.where(stretch == n).coalesce(1).write.parquet(f"{folder}/{n}")
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/*").withColumn(time, F.col(time).cast("timestamp"))


def counts_by_window(stream: DataFrame, time: str, width: str, late: str, by: list[str]) -> DataFrame:
    """Numbers of rows by time window and further columns. Rows of windows that ended `late` before the
    latest time of the batches up to the last but one are left out, so with several batches what counts as
    late depends on the order in which files are read."""
    return stream.withWatermark(time, late).groupBy(F.window(time, width), *by).agg(F.count("*").alias("n"))


def without_repeats(stream: DataFrame, time: str, late: str, key: list[str]) -> DataFrame:
    """The first row of each key; keys are remembered for `late` and dropped from the state then."""
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark(key)


def emitted(result: DataFrame, mode: str = "append") -> DataFrame:
    """Run a stream over all that is there now, and return every row that it emits, with the number of its batch.

    Each batch is written to a folder of its own, so a batch that is run again replaces what it wrote.
    The stream's state is removed at the end. A stream without a batch gives an empty table.
    """
    spark = result.sparkSession
    folder = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    batches = []

    def keep(batch: DataFrame, number: int) -> None:
        batches.append(number)
        batch.write.mode("overwrite").parquet(f"{folder}/out/batch={number}")

    query = result.writeStream.outputMode(mode).foreachBatch(keep).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    state = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/state")
    state.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(state, True)
    fields = [*result.schema.fields, T.StructField("batch", T.IntegerType())]
    if not batches:
        return spark.createDataFrame([], T.StructType(fields))
    return spark.read.schema(T.StructType(fields)).option("basePath", f"{folder}/out").parquet(f"{folder}/out")


def run_all(result: DataFrame, mode: str, key: list[str]) -> DataFrame:
    """Run a stream over all that is there now, and return its table: for each key what the last batch said."""
    table = emitted(result, mode)
    last = F.max_by(F.struct(*result.columns), "batch").alias("last")
    return table.groupBy(*key).agg(last).select("last.*")
