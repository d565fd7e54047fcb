"""Where plans cut their lineage: written tables in the folder that all executors share."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession

_own: dict[str, str] = {}
_marked: set[str] = set()


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir.

    Where it is unset, a session in one process (master local or local[n])
    gets a temporary folder of its own that goes with the process. Any other
    master has executors that couldn't see such a folder: there it is an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own:
        _own[app] = tempfile.mkdtemp(prefix="tidewright-")
        atexit.register(shutil.rmtree, _own[app], ignore_errors=True)
    return _own[app]


def _files(spark: SparkSession, path: str):
    """The file system that holds a path, and the path, as the cluster knows them."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def scratch_dir(spark: SparkSession) -> str:
    """The application's part of shared_dir, which goes when its driver ends; one that a lost driver left has the application's id in its name."""
    path = f"{shared_dir(spark)}/tidewright-{spark.sparkContext.applicationId}"
    if path not in _marked:
        _marked.add(path)
        system, at = _files(spark, path)
        system.mkdirs(at)
        system.deleteOnExit(at)
    return path


def written(df: DataFrame, label: str) -> DataFrame:
    """Write df as Parquet below scratch_dir and return a scan of it.

    The scan has no lineage to recompute: a lost executor costs a re-read.
    """
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table.scratch_path = path
    return table


def observed(df: DataFrame, label: str, **asked: Column) -> tuple[DataFrame, dict]:
    """written() with aggregates of its rows, gathered in the pass that writes them.

    A stage that runs again after a lost executor may count rows twice, so these
    answer whether there are any, not how many.
    """
    seen = Observation()
    table = written(df.observe(seen, *[c.alias(name) for name, c in asked.items()]), label)
    return table, {name: seen.get.get(name) for name in asked}


def discarded(*tables: DataFrame) -> None:
    """Delete written tables that nothing reads any more, as the last round's of an iteration."""
    for table in tables:
        path = getattr(table, "scratch_path", None)
        if path:
            system, at = _files(table.sparkSession, path)
            system.delete(at, True)
