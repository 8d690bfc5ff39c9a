"""Intermediate tables and files in the folder that the driver and all executors share.

The folder is the session's ``spark.checkpoint.dir``. Only where a session has none (tests, local runs)
is a folder of this machine used. Every table is written through Spark's commit protocol, so a lost
executor only repeats tasks, and reading the table back cuts the lineage.
"""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The shared folder, without a trailing slash."""
    set_dir = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if set_dir:
        return set_dir.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir names the folder shared by driver and executors; it is unset")
    return _LOCAL.setdefault("dir", tempfile.mkdtemp(prefix="meshlake-"))


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing has used."""
    return f"{shared_dir(spark)}/meshlake/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """``df`` as a written table, read again."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.option("compression", codec).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_at = path
    return out


def discard(df: DataFrame) -> None:
    """Removes a written table that nothing will read again, and lets Spark drop the shuffle files of finished queries."""
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(df._written_at)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    gc.collect()
    spark._jvm.System.gc()


def local_path(path: str) -> str:
    """A file:// URI or plain path as a path for open()."""
    if path.startswith("file:"):
        return "/" + path[5:].lstrip("/")
    if "://" in path:
        raise ValueError(f"{path}: archives need a shared folder that is mounted on every machine")
    return path


def join_bounded(big: DataFrame, small: DataFrame, on, how: str, rows: int, max_rows: int) -> DataFrame:
    """Broadcast ``small`` while its counted ``rows`` stay within ``max_rows``; a shuffled join beyond that."""
    from pyspark.sql import functions as F

    return big.join(F.broadcast(small) if rows <= max_rows else small.hint("merge"), on, how)
