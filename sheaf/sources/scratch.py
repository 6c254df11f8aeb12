"""Tables written on the way: results that a plan reads more than once, and sinks that are read back."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def scratch_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Where none is set, a local session, as in tests, gets a temporary one; a cluster is an error."""
    sc = spark.sparkContext
    if sc.getConf().get("spark.checkpoint.dir"):
        return sc.getConf().get("spark.checkpoint.dir")
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        if not sc._jsc.sc().isLocal():
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="spark-checkpoint-"))
    return sc._jsc.sc().getCheckpointDir().get()


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in that folder."""
    return f"{scratch_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, *by: str) -> DataFrame:
    """df, written to the folder as Parquet, partitioned by the columns named, and read from there: what reads it several times does the work once, and lost executors lose nothing."""
    path = scratch_path(df.sparkSession, name)
    df.write.partitionBy(*by).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: What `kept` has made, by session, table and name.
_kept: dict[tuple, object] = {}


def kept(spark: SparkSession, path: str, name: str, make: Callable[[], object]) -> object:
    """What `make` gives, such as tables written for it, made once for a session and a state of the table at path.

    The state is its files' total length, their number and the newest time of change; other states are other tables.
    """
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = where.getFileSystem(spark._jsc.hadoopConfiguration())
    files = [f for f in system.listStatus(where) if f.isFile()]
    state = (sum(f.getLen() for f in files), len(files), max((f.getModificationTime() for f in files), default=0))
    key = (spark.sparkContext.applicationId, path, name, state)
    if key not in _kept:
        for old in [k for k in _kept if k[0] != key[0] or k[:3] == key[:3]]:  # of ended sessions, and of former states
            del _kept[old]
        _kept[key] = make()
    return _kept[key]
