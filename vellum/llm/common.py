"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster shares: spark.checkpoint.dir. Where that is unset a local session gets one of its own, others an error."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not named:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = tempfile.mkdtemp(prefix="vellum-shared-")
        sc.setCheckpointDir(named)
    return named.rstrip("/")


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


def own_dir(spark: SparkSession) -> str:
    """This application's part of the shared folder."""
    return f"{shared_dir(spark)}/vellum/{spark.sparkContext.applicationId}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Writes df as Parquet into the shared folder and reads it back: cuts the lineage, survives lost executors.

    Results may still read the files later, so they stay until discard(), clear() or until the folder is emptied. The lowest
    zstd level takes hundreds of MB less of an executor's memory beside the heap than the default one or lz4, for files 3 % larger.
    """
    spark = df.sparkSession
    path = f"{own_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").option("parquet.compression.codec.zstd.level", 1).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Deletes what stored() wrote for df; only for tables that nothing reads any more."""
    spark = df.sparkSession
    for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def clear(spark: SparkSession) -> None:
    """Deletes what this application has stored; results that were not written elsewhere can't be read afterwards."""
    path = spark._jvm.org.apache.hadoop.fs.Path(own_dir(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def spread_join(rows: DataFrame, keyed: DataFrame, key: str, n: str, total: int, most: int = 100_000) -> DataFrame:
    """rows joined to keyed, which has one row a key and in column n how many rows have that key; total: the number of rows.

    Keys of more than total / most rows, of which there are fewer than `most`, are broadcast, so that no such key's
    rows meet in one task; all others are joined as Spark sees fit.
    """
    least = max(64, total // most)
    hot, cold = keyed.where(F.col(n) > least), keyed.where(F.col(n) <= least)
    # looked for first, as a plan without such keys is a third of the size
    if not hot.select(key).head(1):
        return rows.join(keyed, key).drop(n)
    rest = rows.join(F.broadcast(hot.select(key)), key, "left_anti")
    return rows.join(F.broadcast(hot), key).unionByName(rest.join(cold, key)).drop(n)


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
