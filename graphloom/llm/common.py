"""What the training-data operators share: staging, Arrow slicing, hashing.

Staging cuts lineage by writing Parquet into the folder that the cluster
names in ``spark.checkpoint.dir``; Parquet is columnar and compressed, and
survives the loss of an executor.  Only where that setting is absent and the
master is local (tests) is a folder made up; a cluster without it is refused,
since executors would write to disks that nothing else reads.  Staged tables go
when the driver ends, or by ``drop_stages``.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_OWN: dict[str, str] = {}
#: Staged tables by application.
_STAGES: dict[str, list[str]] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stage_root(spark: SparkSession) -> str:
    """The shared folder of the session; its own temporary one if none is set."""
    set_to = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if set_to:
        return set_to.rstrip("/")
    app = spark.sparkContext.applicationId
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if app not in _OWN:
        _OWN[app] = "file://" + tempfile.mkdtemp(prefix="graphloom-stage-")
    return _OWN[app]


def staged(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read again."""
    spark = df.sparkSession
    path = f"{stage_root(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    app = spark.sparkContext.applicationId
    if app not in _STAGES:
        _STAGES[app] = []
        atexit.register(_drop_at_end, spark)
    _STAGES[app].append(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_stages(spark: SparkSession) -> int:
    """Deletes what ``staged`` has written for this application, once no result
    that reads it is needed; returns the number of tables.  Any Hadoop file system."""
    context = spark.sparkContext
    jvm, conf, own = context._jvm, context._jsc.hadoopConfiguration(), _STAGES.get(context.applicationId, [])
    n = len(own)
    while own:
        path = jvm.org.apache.hadoop.fs.Path(own.pop())
        path.getFileSystem(conf).delete(path, True)
    return n


def dropped(df: DataFrame) -> None:
    """Deletes one staged table, once what was made from it has been written."""
    context = df.sparkSession.sparkContext
    own = _STAGES.get(context.applicationId, [])
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        mine = next((p for p in own if path.endswith(p.rsplit("/", 1)[1])), None)
        if mine:
            own.remove(mine)
            at = context._jvm.org.apache.hadoop.fs.Path(mine)
            at.getFileSystem(context._jsc.hadoopConfiguration()).delete(at, True)


def _drop_at_end(spark: SparkSession) -> None:
    if spark.sparkContext._jsc is not None:  # a stopped session has none
        drop_stages(spark)


def crc32_of(key: Column) -> Column:
    """Unsigned crc32 of a key's decimal text; null keys count as empty text."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary"))


def hash_of_row(docs: DataFrame, but: tuple[str, ...] = ()) -> Column:
    """A hash of all columns but some, by which ties end alike in every run.  Maps
    count by their sorted entries."""
    rest = sorted((f for f in docs.schema.fields if f.name not in but), key=lambda f: f.name)
    plain = [F.to_json(F.struct(F.array_sort(F.map_entries(F.col(f.name))).alias("m"))) if isinstance(f.dataType, T.MapType) else F.col(f.name) for f in rest]
    return F.xxhash64(*plain, F.lit(0))


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The batches cut so that ``column`` holds about ``most`` bytes in each
    (one row at least), which bounds what a kernel allocates."""
    for batch in batches:
        col = batch.column(batch.schema.get_field_index(column))
        if not len(col):
            continue
        sizes = lengths(col)
        group = (np.cumsum(sizes) - sizes) // most
        cuts = np.flatnonzero(np.diff(group)) + 1
        for lo, hi in zip([0, *cuts], [*cuts, len(col)], strict=True):
            yield batch.slice(int(lo), int(hi - lo))
    _give_back()  # the worker may idle for long after this task


_KEPT: dict[str, dict] = {}


def worker_memory(owner: str) -> dict:
    """What an operator keeps in a Python worker between tasks.  Workers are
    used again by whatever runs next, so one operator's memory ends where
    another's begins."""
    if owner not in _KEPT:
        had = bool(_KEPT)
        _KEPT.clear()
        if had:
            _give_back()
        _KEPT[owner] = {}
    return _KEPT[owner]


def _give_back() -> None:
    """Returns freed memory to the system, where that can be asked for."""
    import contextlib
    import ctypes
    import gc

    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only glibc has it
        ctypes.CDLL(None).malloc_trim(0)


def lengths(col: pa.Array) -> np.ndarray:
    """Bytes of each value of a string or binary column, null as 0."""
    import pyarrow.compute as pc

    return pc.fill_null(pc.binary_length(col), 0).to_numpy(zero_copy_only=False).astype(np.int64)


def utf8(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column as one array, and the len+1 offsets."""
    n = lengths(col)
    at = np.zeros(len(n) + 1, np.int64)
    np.cumsum(n, out=at[1:])
    width, raw = (np.int64 if pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type) else np.int32), col.buffers()
    if raw[2] is None:
        return np.zeros(0, np.uint8), at
    offsets = np.frombuffer(raw[1], width)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    data = np.frombuffer(raw[2], np.uint8)
    if (offsets[1:] - offsets[:-1] == n).all():
        return data[offsets[0] : offsets[-1]], at
    return np.concatenate([data[a : a + k] for a, k in zip(offsets[:-1], n, strict=True)] or [data[:0]]), at


def spans_union(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of the union of half-open spans; touching spans join."""
    if not len(lo):
        return lo, hi
    order = np.argsort(lo, kind="stable")
    lo, hi = lo[order], np.maximum.accumulate(hi[order])
    first = np.concatenate([[True], lo[1:] > hi[:-1]])
    last = np.concatenate([first[1:], [True]])
    return lo[first], hi[last]
