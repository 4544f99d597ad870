"""Tables that are kept between queries in the folder that the cluster shares."""

from __future__ import annotations

import tempfile
import uuid
from hashlib import md5

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where that is unset a local session gets a folder of its own, others an error."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not named:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = tempfile.mkdtemp(prefix="vellum-tables-")
        sc.setCheckpointDir(named)
    return f"{named.rstrip('/')}/vellum-tables/{sc.applicationId}"


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, lengthened until no column of df has them in either case."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a table was written there to its end."""
    done = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return done.getFileSystem(spark._jsc.hadoopConfiguration()).exists(done)


def size(spark: SparkSession, path: str) -> int:
    """Bytes of a table's files, by Spark's own file systems."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(at).getLength()


def version(df: DataFrame) -> str:
    """A name for the state of the files that df reads: it changes with any file's name, size or time of modification.

    Only the files' status is read, by Spark's own file systems; a table of very many files is listed once.
    """
    spark = df.sparkSession
    conf, jvm = spark._jsc.hadoopConfiguration(), spark._jvm
    seen = md5()
    for name in sorted(df.inputFiles()):
        at = jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(name))
        status = at.getFileSystem(conf).getFileStatus(at)
        seen.update(f"{name} {status.getLen()} {status.getModificationTime()}\n".encode())
    return seen.hexdigest()


def stored(df: DataFrame, name: str) -> DataFrame:
    """Writes df into the shared folder and reads it back, so that several steps read what was computed once and lost executors cost only their tasks."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
