"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import hashlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset, a temporary folder, but only for a local master, which has no other machines."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='quillstone-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """The table, written to the shared folder and read again: cuts lineage and survives lost executors."""
    path = f"{shared_folder(df.sparkSession)}/written-{uuid.uuid4().hex}/{name}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a table was written there in full."""
    fs, at = filesystem(spark, f"{path}/_SUCCESS")
    return fs.exists(at)


def filesystem(spark: SparkSession, path: str) -> tuple:
    """Hadoop's file system of a path, and the path for it."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def listed(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder, none if there is no such folder."""
    fs, at = filesystem(spark, path)
    return [f.getPath().getName() for f in fs.listStatus(at)] if fs.exists(at) else []


def removed(*tables: DataFrame) -> None:
    """Remove tables that written() made and nothing lazy reads any more; any other table is left alone."""
    for table in tables:
        for path in {f.rsplit("/", 2)[0] for f in table.inputFiles()}:
            if path.rsplit("/", 1)[-1].startswith("written-"):
                remove_folder(table.sparkSession, path)


def remove_folder(spark: SparkSession, path: str) -> None:
    fs, at = filesystem(spark, path)
    fs.delete(at, True)


def fingerprint(spark: SparkSession, path: str) -> str:
    """A digest of the names, sizes and times of the files of a table: another one as soon as it is written anew."""
    fs, at = filesystem(spark, path)
    found, files = [], fs.listFiles(at, True)
    while files.hasNext():
        f = files.next()
        found.append(f"{f.getPath()} {f.getLen()} {f.getModificationTime()}")
    return hashlib.md5("\n".join(sorted(found)).encode()).hexdigest()


def widened(df: DataFrame, key: str, rows: int | None = None) -> DataFrame:
    """Dealt out by a key, over the cores at least: a file has as many tasks as it has row groups, which may be one, whatever its size. With rows, about so many a task at most."""
    parts = max(df.sparkSession.sparkContext.defaultParallelism, df.rdd.getNumPartitions())
    return df.repartition(max(parts, -(-df.count() // rows)) if rows else parts, key)
