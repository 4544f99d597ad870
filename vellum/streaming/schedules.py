"""Batch jobs at a fixed rate, as a streaming query: its checkpoint remembers which runs are done, so a restart repeats none."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from vellum.sources import files


def periodic(spark: SparkSession, job: Callable[[int], int], every: str, checkpoint: str, log: str | None = None) -> StreamingQuery:
    """Runs job(number of the run) every `every` (an interval such as "6 hours"); stop() ends it.

    A run that is due while another one lasts waits for it. With a folder `log`, each run that has ended leaves a file with what it
    returned there, and a run that is replayed after a crash is skipped if its file is there. A job that fails ends the query, and the
    next start repeats that run.
    """

    def run(_: DataFrame, number: int) -> None:
        if log and files.exists(spark, f"{log}/{number}"):
            return
        done = job(number)
        if log:
            files.create_absent(spark, f"{log}/{number}", str(done))

    ticks = spark.readStream.format("rate").option("rowsPerSecond", 1).option("numPartitions", 1).load()
    return ticks.writeStream.foreachBatch(run).trigger(processingTime=every).option("checkpointLocation", checkpoint).start()


def scheduled_clean_up(spark: SparkSession, folder: str, hours: int, prefix: str, extension: str, every: str, checkpoint: str, log: str | None = None) -> StreamingQuery:
    """clean_up() of a folder at a fixed rate."""
    return periodic(spark, lambda _: files.clean_up(spark, folder, hours, prefix, extension), every, checkpoint, log)
