"""Files put in place at once, through the file system that the path names: markers, replaced files, batches of a stream, clean-up.

Only Hadoop's file systems are used, so the paths may be on any store that Spark writes to. A rename is atomic where the store's
rename is (HDFS and local disks); where it copies, a reader may see the old file a little longer, never half of the new one.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.sources.documents import outdated


def _at(spark: SparkSession, path: str):
    """The file system of a path, and the path in it."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def _put(fs, p, text: str) -> None:
    out = fs.create(p, False)
    try:
        out.write(bytearray(text.encode()))
        out.hsync()
    finally:
        out.close()


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _at(spark, path)
    return fs.exists(p)


def create_absent(spark: SparkSession, path: str, text: str = "") -> bool:
    """Creates a file; False, and nothing changed, where there is one."""
    fs, p = _at(spark, path)
    if fs.exists(p):
        return False
    try:
        _put(fs, p, text)
    except Py4JJavaError as e:
        # another one was quicker
        if "AlreadyExists" in type(e.java_exception).__name__ or "AlreadyExists" in e.java_exception.getClass().getName():
            return False
        raise
    return True


def replace(spark: SparkSession, path: str, text: str) -> None:
    """Writes a file beside and renames it over: readers see the old content or the new, also if the writer dies."""
    fs, p = _at(spark, path)
    beside = f"{path}.{uuid.uuid4().hex}.tmp"
    tmp = _at(spark, beside)[1]
    _put(fs, tmp, text)
    jvm = spark._jvm
    kind = jvm.org.apache.hadoop.fs.Options.Rename
    how = spark.sparkContext._gateway.new_array(kind, 1)
    how[0] = kind.OVERWRITE
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark._jsc.hadoopConfiguration())
    context.rename(fs.makeQualified(tmp), fs.makeQualified(p), how)


def run_once(spark: SparkSession, marker: str, job: Callable[[], int]) -> int:
    """What job() returns, or 0 if the marker says that it has run to its end before.

    The marker is written after the job, so a job that died runs again; it must only add what is not there yet.
    """
    if exists(spark, marker):
        return 0
    done = job()
    create_absent(spark, marker, str(done))
    return done


def commit_batch(folder: str, write: Callable[[DataFrame, str], None] | None = None) -> Callable[[DataFrame, int], None]:
    """A function for foreachBatch: each batch is written aside and put into <folder>/batch=<id> by one rename; a batch that is there is left alone.

    A write that dies leaves nothing that a reader of the folder sees, and a batch that is replayed adds nothing.
    """
    put = write or (lambda df, path: df.write.parquet(path))

    def run(df: DataFrame, batch: int) -> None:
        spark = df.sparkSession
        target, aside = f"{folder}/batch={batch}", f"{folder}/_aside/{uuid.uuid4().hex}"
        if exists(spark, target):
            return
        put(df, aside)
        fs, p = _at(spark, target)
        tmp = _at(spark, aside)[1]
        # some stores move into a folder that has come up meanwhile; its presence is looked at last
        if fs.exists(p) or not fs.rename(tmp, p):
            fs.delete(tmp, True)

    return run


def listed(spark: SparkSession, folder: str) -> DataFrame:
    """name, path, modified, length of the files below a folder; their content is not read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    return found.select(F.element_at(F.split("path", "/"), -1).alias("name"), "path", F.col("modificationTime").alias("modified"), "length")


def clean_up(spark: SparkSession, folder: str, hours: int, prefix: str, extension: str, now: str | None = None) -> int:
    """Deletes the files of a kind that were last changed more than `hours` ago; their number. Names pass the driver a partition at a time."""
    moment = F.lit(now).cast("timestamp") if now else F.current_timestamp()
    gone = 0
    for row in outdated(listed(spark, folder), moment, hours, prefix, extension).select("path").toLocalIterator():
        fs, p = _at(spark, row["path"])
        gone += bool(fs.delete(p, False))
    return gone
