"""Sharding by size-tiered compaction.

A store is a folder of immutable runs (folders of Parquet shards) and of numbered manifests. Arrivals are appended as
small runs. Where ``FANOUT`` runs of similar size have gathered (from the smallest on, none over one and a half of the
mean of the smaller ones), they are merged into one run of shards of about ``target_bytes``; runs whose shards have that
size are left alone. So a row is rewritten once per tier, a logarithmic number of times. Merging reads and writes without
a shuffle.

Every change is a new manifest, written aside in full and then given its name only if no manifest has it: readers see
the version before or after, and of two writers one raises ``CommitConflict`` and may try again. Runs that a commit
replaced stay for ``retain_seconds``, so that running readers end in peace; ``vacuum`` removes only runs that an expired
manifest names and no retained one does. Runs that no manifest names (of a writer that is still at work, or that
failed) are never touched by it; ``remove_orphans`` removes those older than a given age.

Defined cases: empty arrivals commit no run; nulls, equal rows and any columns are stored as they are; a run whose
columns differ from the store's (but for what may be null) raises ValueError; a store without a version reads as an
error, one that has only empty arrivals as an empty frame. ``arrivals`` cuts by ranges of doc_id, which must be numeric.
"""

from __future__ import annotations

import json
import math
import os
import time
import uuid
from urllib.parse import urlparse

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import hadoop_path, remove, table, tidy, work_dir

FANOUT, TARGET_BYTES, ARRIVALS = 4, 128 << 20, 12
RETAIN_SECONDS = 24 * 3600


class CommitConflict(RuntimeError):
    pass


def _loose(kind):
    """A schema's JSON in which everything may be null."""
    if isinstance(kind, dict):
        return {k: True if k in ("nullable", "containsNull", "valueContainsNull") else _loose(v) for k, v in kind.items() if k != "metadata"} | ({"metadata": {}} if "metadata" in kind else {})
    return [_loose(x) for x in kind] if isinstance(kind, list) else kind


def _claim(spark: SparkSession, aside: str, final: str) -> bool:
    """Give the file ``aside`` the name ``final`` if no file has it; whether it was given. The file ``aside`` is gone afterwards.

    A link on a local disk and a rename without overwriting on HDFS are one step each. Elsewhere (object stores) the file
    is created anew without overwriting, which such stores do when it is closed.
    """
    fs, a = hadoop_path(spark, aside)
    _, z = hadoop_path(spark, final)
    jvm = spark.sparkContext._jvm
    local = urlparse(fs.resolvePath(a).toString())
    try:
        if local.scheme in ("", "file"):
            os.link(local.path, f"{os.path.dirname(local.path)}/{z.getName()}")
        elif fs.getUri().getScheme() in ("hdfs", "viewfs", "webhdfs"):
            none = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
            none[0] = jvm.org.apache.hadoop.fs.Options.Rename.NONE
            jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark.sparkContext._jsc.hadoopConfiguration()).rename(a, z, none)
        else:
            stream, out = fs.open(a), fs.create(z, False)
            out.write(stream.readAllBytes())
            out.close()
            stream.close()
    except FileExistsError:
        return False
    except Py4JJavaError as e:
        if "FileAlreadyExists" in e.java_exception.getClass().getName():
            return False
        raise
    finally:
        fs.delete(a, False)
    return True


class ShardStore:
    def __init__(self, spark: SparkSession, path: str, target_bytes: int = TARGET_BYTES, fanout: int = FANOUT, retain_seconds: float = RETAIN_SECONDS):
        self.spark, self.path, self.target_bytes, self.fanout, self.retain_seconds = spark, path.rstrip("/"), target_bytes, fanout, retain_seconds

    def versions(self) -> list[int]:
        fs, p = hadoop_path(self.spark, f"{self.path}/_manifests")
        names = [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []
        return sorted(int(n[1:-5]) for n in names if n.startswith("v") and n.endswith(".json"))

    def manifest(self, version: int | None = None) -> dict:
        found = self.versions()
        if not found:
            return {"version": 0, "schema": None, "runs": []}
        fs, p = hadoop_path(self.spark, f"{self.path}/_manifests/v{version or found[-1]:08d}.json")
        stream = fs.open(p)
        try:
            return json.loads(bytes(b & 255 for b in stream.readAllBytes()).decode())
        finally:
            stream.close()

    def commit(self, manifest: dict) -> int:
        """Make ``manifest`` the version after the one it was read as."""
        version = manifest["version"] + 1
        fs, aside = hadoop_path(self.spark, f"{self.path}/_manifests/.{uuid.uuid4().hex}")
        stream = fs.create(aside, False)
        stream.write(bytearray(json.dumps(manifest | {"version": version}).encode()))
        stream.close()
        if not _claim(self.spark, aside.toString(), f"{self.path}/_manifests/v{version:08d}.json"):
            raise CommitConflict(f"version {version} exists")
        return version

    def _write(self, df: DataFrame) -> dict | None:
        name = f"run-{uuid.uuid4().hex}"
        df.write.parquet(f"{self.path}/{name}")
        fs, p = hadoop_path(self.spark, f"{self.path}/{name}")
        shards = [s.getLen() for s in fs.listStatus(p) if s.getPath().getName().endswith(".parquet")]
        rows = self.spark.read.schema(df.schema).parquet(f"{self.path}/{name}").count()
        if not rows:
            remove(self.spark, f"{self.path}/{name}")
            return None
        return {"name": name, "rows": rows, "bytes": sum(shards), "shards": len(shards)}

    def append(self, arrivals: DataFrame) -> int:
        """One small run for ``arrivals``; returns the version that holds it."""
        manifest = self.manifest()
        schema = _loose(json.loads(arrivals.schema.json()))
        if manifest["schema"] and manifest["schema"] != schema:
            raise ValueError("the arrivals' columns are not the store's")
        run = self._write(arrivals)
        return self.commit(manifest | {"schema": schema, "runs": manifest["runs"] + ([run] if run else [])})

    def _tier(self, runs: list[dict]) -> list[dict]:
        """The smallest runs of similar size that are enough for a merge."""
        bucket: list[dict] = []
        for run in sorted((r for r in runs if r["bytes"] / r["shards"] < self.target_bytes / 2), key=lambda r: r["bytes"]):
            if bucket and run["bytes"] > 1.5 * sum(r["bytes"] for r in bucket) / len(bucket):
                if len(bucket) >= self.fanout:
                    break
                bucket = []
            bucket.append(run)
        return bucket if len(bucket) >= self.fanout else []

    def compact(self) -> int:
        """Merge tiers until none is full; returns the current version."""
        manifest = self.manifest()
        while tier := self._tier(manifest["runs"]):
            size = sum(r["bytes"] for r in tier)
            old = self._read(manifest, tier)
            run = self._write(old.coalesce(max(1, math.ceil(size / self.target_bytes))))
            gone = {r["name"] for r in tier}
            self.commit(manifest | {"runs": [r for r in manifest["runs"] if r["name"] not in gone] + [run]})
            self.vacuum()
            manifest = self.manifest()
        return manifest["version"]

    def vacuum(self) -> None:
        """Remove manifests replaced over ``retain_seconds`` ago, and the runs that only they name."""
        fs, p = hadoop_path(self.spark, f"{self.path}/_manifests")
        at = {s.getPath().getName(): s.getModificationTime() / 1000 for s in fs.listStatus(p)}
        versions = self.versions()
        # a version is replaced when the next one is committed
        over = [v for v, after in zip(versions, versions[1:]) if at.get(f"v{after:08d}.json", time.time()) + self.retain_seconds <= time.time()]
        names = {v: {r["name"] for r in self.manifest(v)["runs"]} for v in versions}
        live = set().union(*(names[v] for v in versions if v not in over))
        for v in over:
            for name in names[v] - live:
                remove(self.spark, f"{self.path}/{name}")
            remove(self.spark, f"{self.path}/_manifests/v{v:08d}.json")

    def remove_orphans(self, older_seconds: float) -> None:
        """Remove runs that no manifest names and that were written over ``older_seconds`` ago, longer than any writer takes."""
        named = {r["name"] for v in self.versions() for r in self.manifest(v)["runs"]}
        fs, p = hadoop_path(self.spark, self.path)
        for s in fs.listStatus(p):
            name = s.getPath().getName()
            if name.startswith("run-") and name not in named and s.getModificationTime() / 1000 + older_seconds < time.time():
                fs.delete(s.getPath(), True)

    def _read(self, manifest: dict, runs: list[dict]) -> DataFrame:
        schema = StructType.fromJson(manifest["schema"])
        if not runs:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[f"{self.path}/{r['name']}" for r in runs])

    def read(self, version: int | None = None) -> DataFrame:
        manifest = self.manifest(version)
        if not manifest["schema"]:
            raise ValueError("the store has no version yet")
        return self._read(manifest, manifest["runs"])


def arrivals(docs: DataFrame, n: int = ARRIVALS) -> list[DataFrame]:
    """``docs`` as ``n`` successive arrivals by ranges of doc_id, which reach the scan as filters."""
    low, high = docs.agg(F.min("doc_id"), F.max("doc_id")).first()
    if low is None:
        return [docs]
    edges = [low + (high - low + 1) * k // n for k in range(n + 1)]
    parts = [docs.filter((F.col("doc_id") >= a) & (F.col("doc_id") < b)) for a, b in zip(edges, edges[1:]) if a < b]
    return [docs.filter(F.col("doc_id").isNull()), *parts]


def compacted(docs: DataFrame, path: str, n: int = ARRIVALS, target_bytes: int = TARGET_BYTES) -> ShardStore:
    """A store that took ``docs`` as ``n`` arrivals, compacted after each."""
    tidy(docs.sparkSession)
    store = ShardStore(docs.sparkSession, path, target_bytes)
    for part in arrivals(docs, n):
        store.append(part)
        store.compact()
    return store


def op5_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = compacted(table(spark, sf_dir, "documents"), work_dir(spark, "shards"))
    text = F.coalesce("text", F.lit(""))
    return store.read().select(F.col("doc_id").cast("long").alias("doc_id"), "lang", "source", F.octet_length(text).cast("long").alias("n_bytes"), F.md5(text).alias("text_md5"))


OP5_SQL = "SELECT doc_id, lang, source, octet_length(encode(coalesce(text, '')))::BIGINT AS n_bytes, md5(coalesce(text, '')) AS text_md5 FROM documents"
