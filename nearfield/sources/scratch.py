"""Tables in the folder that the cluster shares, which end the lineage of what is read from them.

The folder is the one in ``spark.checkpoint.dir``; the tables are ordinary Parquet, so a lost
executor costs nothing but a re-read.  Only where that setting is absent and Spark runs in one
local process is a folder of our own used.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_OWN: dict[str, str] = {}
#: Tables of this process that nothing has deleted yet.
_LEFT: dict[str, SparkSession] = {}


def scratch_root(spark: SparkSession) -> str:
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir")
    if not named:
        held = sc._jsc.sc().getCheckpointDir()
        named = held.get() if held.isDefined() else None
    if named:
        return named.rstrip("/")
    if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if sc.applicationId not in _OWN:
        _OWN[sc.applicationId] = tempfile.mkdtemp(prefix="nearfield-scratch-")
    return "file://" + _OWN[sc.applicationId]


def new_path(spark: SparkSession, tag: str) -> str:
    return f"{scratch_root(spark)}/nearfield/{tag}-{uuid.uuid4().hex}"


def leased_path(spark: SparkSession, tag: str) -> str:
    """A new path that is deleted when the driver ends."""
    path = new_path(spark, tag)
    _LEFT[path] = spark
    return path


def written(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` to the scratch folder and read it back: lineage ends at shared files."""
    path = new_path(df.sparkSession, tag)
    _LEFT[path] = df.sparkSession
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._nearfield_path = path
    return out


def _delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    _LEFT.pop(path, None)


def dropped(df: DataFrame) -> None:
    """Delete a table made by :func:`written` that no later plan reads."""
    path = getattr(df, "_nearfield_path", None)
    if path:
        _delete(df.sparkSession, path)


@atexit.register
def released() -> None:
    """Delete every table that is left.  Results may still read them while the driver lives, so
    this runs when it ends; a driver that wants the space earlier may call it after its actions."""
    for path, spark in list(_LEFT.items()):
        try:
            _delete(spark, path)
        except Exception:  # the session is gone: the folder is the cluster's to empty
            _LEFT.pop(path, None)
