"""Tables that are made once and read often, kept as Parquet.

A graph's edges are derived by joins over fact tables; every neighbourhood query
would repeat them.  ``kept`` writes such a table to the shared folder that the
cluster names in ``spark.checkpoint.dir`` and reads it from there afterwards.  Its
name holds a fingerprint of the files that it is made from (names, sizes and times
of change), so changed input makes a new table.  Tables go when the driver ends.
"""

from __future__ import annotations

import atexit
import hashlib
import tempfile
import threading
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

_KEPT: dict[tuple[str, str], str] = {}
_ROOTS: dict[str, str] = {}
_LOCK = threading.RLock()  # a table may be made from other kept ones


def shared_root(spark: SparkSession) -> str:
    """The shared folder of the session.  Only a local master may do without the
    setting: executors of a cluster don't see the driver's disk."""
    set_to = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if set_to:
        return set_to.rstrip("/")
    master, app = spark.sparkContext.master, spark.sparkContext.applicationId
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if app not in _ROOTS:
        _ROOTS[app] = "file://" + tempfile.mkdtemp(prefix="graphloom-kept-")
    return _ROOTS[app]


def fingerprint(spark: SparkSession, paths: list[str]) -> str:
    """Of the files in the given folders: names, sizes and times of change."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    seen = []
    for p in paths:
        path = jvm.org.apache.hadoop.fs.Path(p)
        for s in path.getFileSystem(conf).listStatus(path):
            seen.append(f"{s.getPath()}|{s.getLen()}|{s.getModificationTime()}")
    return hashlib.md5("\n".join(sorted(seen)).encode()).hexdigest()


def kept(spark: SparkSession, name: str, inputs: list[str], make: Callable[[], DataFrame]) -> DataFrame:
    """The table ``name`` made from ``inputs``, written on first use."""
    app = spark.sparkContext.applicationId
    key = (app, f"{name}-{fingerprint(spark, inputs)}")
    with _LOCK:
        if key not in _KEPT:
            path = f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"
            make().write.parquet(path)
            if not any(k[0] == app for k in _KEPT):
                atexit.register(drop_kept, spark)
            _KEPT[key] = path
    return spark.read.parquet(_KEPT[key])


def written(df: DataFrame, name: str) -> DataFrame:
    """A table written once and read again by a plan that runs over it many times."""
    spark, app = df.sparkSession, df.sparkSession.sparkContext.applicationId
    path = f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    with _LOCK:
        if not any(k[0] == app for k in _KEPT):
            atexit.register(drop_kept, spark)
        _KEPT[app, path] = path
    return spark.read.schema(df.schema).parquet(path)


#: Rows that a task sorts or counts, and what it may reach where partitions are few.
TASK_ROWS, MOST_ROWS = 250_000, 1_000_000


def dealt(df: DataFrame, rows: int | None, *by: str) -> DataFrame:
    """``df``, of some ``rows`` rows (None: unknown), by the values of ``by``: a partition for each
    TASK_ROWS, the session's shuffle partitions at most, but never so few that one has more than MOST_ROWS.

    What sorts or counts by these columns afterwards does so where the rows lie, in
    one task's even share.  Left to itself Spark sorts or counts each file's rows
    before the shuffle too, where nothing is cut if a group is in many files, and
    merges partitions by their packed bytes, of which a task's memory holds fewer."""
    spark = df.sparkSession
    most = int(spark.conf.get("spark.sql.shuffle.partitions"))
    n = most if rows is None else min(max(most, -(-rows // MOST_ROWS)), max(spark.sparkContext.defaultParallelism, -(-rows // TASK_ROWS)))
    return df.repartition(n, *by)


def drop_kept(spark: SparkSession) -> int:
    """Deletes this application's kept tables; returns how many there were."""
    context = spark.sparkContext
    if context._jsc is None:  # the session has ended
        return 0
    jvm, conf = context._jvm, context._jsc.hadoopConfiguration()
    own = [k for k in _KEPT if k[0] == context.applicationId]
    for k in own:
        path = jvm.org.apache.hadoop.fs.Path(_KEPT.pop(k))
        path.getFileSystem(conf).delete(path, True)
    return len(own)
