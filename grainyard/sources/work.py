"""Tables in the shared folder, between the steps of an operator."""

from __future__ import annotations

import tempfile
import uuid
import weakref

from pyspark.sql import DataFrame, SparkSession

_roots: dict[str, str] = {}


def work_path(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder that spark.checkpoint.dir names; a temporary one where it is unset and Spark is one local JVM."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        sc = spark.sparkContext
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = _roots.setdefault(sc.applicationId, "") or "file://" + tempfile.mkdtemp(prefix="spark-grainyard-")
        _roots[sc.applicationId] = root
    return f"{root.rstrip('/')}/grainyard-{label}-{uuid.uuid4().hex}"


def saved(df: DataFrame, label: str) -> DataFrame:
    """df written to the shared folder and read from there: a cut in its lineage."""
    path = work_path(df.sparkSession, label)
    df.write.parquet(path)
    back = df.sparkSession.read.schema(df.schema).parquet(path)
    _places[back] = path
    return back


_places: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()


def forget(df: DataFrame) -> None:
    """Delete what `saved` wrote for df. Nothing that is still to be read may depend on it."""
    deleted(df.sparkSession, _places.pop(df))


def deleted(spark: SparkSession, path: str) -> None:
    """Delete a folder if it is there."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    path = jvm.org.apache.hadoop.fs.Path(path)
    path.getFileSystem(conf).delete(path, True)
