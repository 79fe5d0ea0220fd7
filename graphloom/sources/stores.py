"""Run logs, checkpoints and memory as append-only tables and versioned stores.

Nothing is rewritten in place.  A log appends, and what is current is the latest
entry of its key.  A ``Store`` holds several tables and goes from one version to the
next by one small manifest file: data are written first, under names of their
own, and then version n + 1 is put in place if nobody else has; a writer who
comes second puts its data on top of what the first one wrote.  A reader names a
version, or takes the last, and sees all tables of it or none.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def append(rows: DataFrame, path: str, kind: str = "parquet", by: list[str] | None = None) -> None:
    """kind: parquet or json (one object a line)."""
    w = rows.write.mode("append").format(kind)
    (w.partitionBy(*by) if by else w).save(path)


def latest(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*[F.desc(c) for c in order])
    return rows.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def save_checkpoint(spark: SparkSession, path: str, task: str, iteration: int, state: str) -> None:
    """state: a JSON document."""
    append(spark.createDataFrame([(task, iteration, state)], "task string, iteration long, state string"), path)


def load_checkpoint(spark: SparkSession, path: str, task: str) -> tuple[int, str]:
    """The last checkpoint of a task; one of another task only is an error."""
    row = spark.read.parquet(path).where(F.col("task") == task).orderBy(F.desc("iteration")).first()
    if row is None:
        raise ValueError(f"no checkpoint of task {task!r} in {path}")
    return row.iteration, row.state


def migrated(document: DataFrame) -> DataFrame:
    """Memory documents (json) of any version as version 2: an old one, without
    a version, is taken as the table of its tasks."""
    version = F.get_json_object("json", "$.version")
    wrapped = F.concat(F.lit('{"version":"2.0","tasks":'), "json", F.lit(',"global_edge_effects":{},"task_edge_effects":{}}'))
    return document.withColumn("json", F.when(version.isNull(), wrapped).otherwise(F.col("json")))


class Conflict(RuntimeError):
    """Another writer made the version that was to be replaced."""


class Store:
    """Named tables with versions, in one folder of any Hadoop file system.

    The folder holds ``data`` (a Parquet folder for each write) and ``versions`` (a
    manifest for each version: which data make up which table).  A version is
    put in place by a hard link on local disks and by a rename elsewhere, both
    of which fail where the name is taken (HDFS; object stores without an atomic
    rename need a lock of their own)."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._jvm, self._conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()

    def _at(self, *names: str):
        return self._jvm.org.apache.hadoop.fs.Path("/".join((self.path, *names)))

    def versions(self) -> list[int]:
        folder = self._at("versions")
        fs = folder.getFileSystem(self._conf)
        if not fs.exists(folder):
            return []
        return sorted(int(n[1:-5]) for n in (s.getPath().getName() for s in fs.listStatus(folder)) if n.startswith("v") and n.endswith(".json"))

    def manifest(self, version: int | None = None) -> dict:
        """version and tables (lists of data folders) of a version, or of the last."""
        known = self.versions()
        if version is None:
            version = known[-1] if known else 0
        if version == 0:
            return {"version": 0, "tables": {}}
        if version not in known:
            raise ValueError(f"{self.path} has no version {version}")
        at = self._at("versions", f"v{version:012}.json")
        stream = at.getFileSystem(self._conf).open(at)
        try:
            return json.loads(self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _put(self, manifest: dict) -> bool:
        """Whether the manifest became its version; False if another did."""
        new, final = self._at("versions", f".{uuid.uuid4().hex}"), self._at("versions", f"v{manifest['version']:012}.json")
        fs = final.getFileSystem(self._conf)
        fs.mkdirs(self._at("versions"))
        out = fs.create(new, False)
        out.write(bytearray(json.dumps(manifest, sort_keys=True).encode()))
        out.close()
        if fs.getScheme() == "file":
            import os

            own, to = (p.toUri().getPath() for p in (new, final))
            try:
                os.link(own, to)
                return True
            except FileExistsError:
                return False
            finally:
                fs.delete(new, False)
        done = not fs.exists(final) and fs.rename(new, final)
        if not done:
            fs.delete(new, False)
        return done

    def commit(self, tables: dict[str, DataFrame], mode: str = "append", expected: int | None = None) -> int:
        """Writes tables and makes them one new version, which it returns.

        append: rows come on top of whatever is last by then.  overwrite: they take
        the place of the tables named.  expected: the version that must be last,
        else ``Conflict``."""
        if mode not in ("append", "overwrite"):
            raise ValueError(f"no mode {mode!r}")
        new = {}
        for name, rows in tables.items():
            new[name] = f"data/{name}-{uuid.uuid4().hex}"
            rows.write.parquet(f"{self.path}/{new[name]}")
        while True:
            last = self.manifest()
            if expected is not None and last["version"] != expected:
                raise Conflict(f"{self.path} is at version {last['version']}, not {expected}")
            parts = dict(last["tables"])
            for name, folder in new.items():
                parts[name] = [*(parts.get(name, []) if mode == "append" else []), folder]
            if self._put({"version": last["version"] + 1, "tables": parts}):
                return last["version"] + 1

    def read(self, name: str, version: int | None = None) -> DataFrame:
        folders = self.manifest(version)["tables"].get(name)
        if not folders:
            raise ValueError(f"{self.path} has no table {name!r}")
        return self.spark.read.option("mergeSchema", "true").parquet(*[f"{self.path}/{f}" for f in folders])

    def has(self, name: str) -> bool:
        return name in self.manifest()["tables"]

    def compacted(self, name: str) -> int:
        """A version in which the table's many writes are one folder; it fails where
        rows came meanwhile."""
        now = self.manifest()["version"]
        return self.commit({name: self.read(name, now)}, "overwrite", now)


MEMORY = "task string, key string, json string, at long"


def book(store: Store, task: str, entries: dict[str, dict]) -> int:
    """Books documents under keys of a task's memory; the latest of a key counts.
    The first entry of a task makes it."""
    rows = [(task, k, json.dumps(v, sort_keys=True)) for k, v in sorted(entries.items())]
    while True:  # numbered by the version they are to be; another writer's turn is waited out
        now = store.manifest()["version"]
        try:
            return store.commit({"memory": store.spark.createDataFrame([(*r, now + 1) for r in rows], MEMORY)}, "append", now)
        except Conflict:
            continue


def remembered(store: Store, task: str | None = None, version: int | None = None) -> DataFrame:
    """task, key, json: the latest entries, of one task or of all."""
    rows = store.read("memory", version)
    rows = rows if task is None else rows.where(F.col("task") == task)
    return latest(rows, ["task", "key"], ["at"]).drop("at")


def save_index(triplets: DataFrame, vectors: DataFrame, path: str) -> int:
    """An index of triplets (triplet_id, src, dst, edge_type, text) with unit vectors
    (triplet_id, emb), and its counts by type, as one version of a store."""
    rows = triplets.join(vectors.select("triplet_id", "emb"), "triplet_id")
    counts = rows.groupBy("edge_type").agg(F.count("*").alias("n"), F.max(F.size("emb")).alias("dim"))
    return Store(triplets.sparkSession, path).commit({"triplets": rows, "counts": counts}, "overwrite")


def load_index(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """The index as it was saved; one whose counts tell of other rows is an error."""
    store = Store(spark, path)
    version = store.manifest(version)["version"]
    rows, counts = store.read("triplets", version), store.read("counts", version)
    wanted, got = counts.agg(F.sum("n")).first()[0] or 0, rows.count()
    if wanted != got:
        raise ValueError(f"{path} has {got} triplets, its counts {wanted}")
    return rows


class RunLog:
    """A run's events as a table of a store: run, at (a number of the event), kind,
    iteration, body (a JSON document).

    Events are held and written ``every`` so many at once, by ``flush``, at the end
    of a ``with``, and before anything is read.  A run that is opened again goes on
    counting where it was."""

    KINDS = ("baseline", "strategy", "description", "evaluation", "feedback", "reflection", "critique", "advantage", "reward", "summary", "best_strategy", "report")
    SCHEMA = "run string, at long, kind string, iteration long, body string"

    def __init__(self, spark: SparkSession, path: str, run: str, every: int = 50):
        self.spark, self.store, self.run, self.every, self.held = spark, Store(spark, path), run, every, []
        known = self._stored().agg(F.max("at")).first()[0] if self.store.has("events") else None
        self.at = known or 0

    def _stored(self) -> DataFrame:
        return self.store.read("events").where(F.col("run") == self.run)

    def __enter__(self) -> RunLog:
        return self

    def __exit__(self, *failure) -> None:
        self.flush()

    def log(self, kind: str, iteration: int, **body) -> None:
        if kind not in self.KINDS:
            raise ValueError(f"no kind {kind!r} of event")
        self.at += 1
        self.held.append((self.run, self.at, kind, iteration, json.dumps(body, sort_keys=True)))
        if len(self.held) >= self.every:
            self.flush()

    def flush(self) -> None:
        if self.held:
            self.store.commit({"events": self.spark.createDataFrame(self.held, self.SCHEMA)})
            self.held = []

    def events(self) -> DataFrame:
        self.flush()
        return self._stored()

    def best(self, metric: str = "metric") -> dict | None:
        """The body of the evaluation with the largest metric, the first if tied."""
        value = F.get_json_object("body", f"$.{metric}").cast("double")
        row = self.events().where("kind = 'evaluation'").orderBy(F.desc_nulls_last(value), "at").first()
        return json.loads(row["body"]) if row else None

    def iterations(self) -> DataFrame:
        """One row for each iteration: what was logged of each kind, the last if
        there were several, as a column of its own."""
        last = latest(self.events(), ["iteration", "kind"], ["at"])
        return last.groupBy("iteration").agg(*[F.max(F.when(F.col("kind") == k, F.col("body"))).alias(k) for k in self.KINDS])

    def report(self) -> DataFrame:
        """kind, n, first and last iteration of the run's events."""
        return self.events().groupBy("kind").agg(F.count("*").alias("n"), F.min("iteration").alias("first"), F.max("iteration").alias("last"))
