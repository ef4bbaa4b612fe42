"""Tables of immutable Parquet files with versions: a delete rewrites only the files that hold a match.

A version is a small JSON file in ``_versions``: the schema and the names of its data files. It is written under a name of its own
and renamed to its number, which fails if that number is taken, so of two writers one has to start over. That needs a
file system whose rename without overwriting is atomic (HDFS and the like; an object store only with such a committer).
Old versions stay readable, as no data file is ever changed or removed.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


class Conflict(RuntimeError):
    """Another writer has committed the version."""


class VersionedTable:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._fs = spark.sparkContext._jvm.org.apache.hadoop.fs

    def _path(self, *names: str):
        return self._fs.Path("/".join((self.path, *names)))

    def versions(self) -> list[int]:
        fs = self._path().getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        if not fs.exists(self._path("_versions")):
            return []
        names = [f.getPath().getName() for f in fs.listStatus(self._path("_versions"))]
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())

    def _state(self, version: int | None) -> tuple[StructType, list[str]]:
        now = version or self.versions()[-1]
        text = self.spark.read.text(str(self._path("_versions", f"{now:020d}.json")), wholetext=True).first().value
        found = json.loads(text)
        return StructType.fromJson(found["schema"]), found["files"]

    def _commit(self, version: int, schema: StructType, files: Sequence[str]) -> int:
        sc = self.spark.sparkContext
        fs = self._path().getFileSystem(sc._jsc.hadoopConfiguration())
        fs.mkdirs(self._path("_versions"))
        draft = self._path("_versions", f".draft-{uuid.uuid4().hex}")
        out = fs.create(draft, False)
        out.write(bytearray(json.dumps({"schema": schema.jsonValue(), "files": list(files)}).encode()))
        out.close()
        no_option = sc._gateway.new_array(self._fs.Options.Rename, 0)
        context = self._fs.FileContext.getFileContext(fs.getUri(), sc._jsc.hadoopConfiguration())
        try:
            context.rename(draft, self._path("_versions", f"{version:020d}.json"), no_option)
        except Exception as e:
            fs.delete(draft, False)
            if "FileAlreadyExists" in str(e):
                raise Conflict(f"version {version} of {self.path} exists") from None
            raise
        return version

    def _written(self, df: DataFrame, by: Sequence[str] = ()) -> list[str]:
        """The new data files with the rows of ``df``; ``by``: columns whose values have files of their own."""
        folder = f"{self.path}/data-{uuid.uuid4().hex}"
        (df.repartition(*map(F.col, by)).sortWithinPartitions(*by) if by else df).write.parquet(folder)
        return sorted(self.spark.read.schema(df.schema).parquet(folder).inputFiles())

    def _read(self, schema: StructType, files: Sequence[str]) -> DataFrame:
        return self.spark.read.schema(schema).parquet(*files) if files else self.spark.createDataFrame([], schema)

    def read(self, version: int | None = None) -> DataFrame:
        """The table as of ``version`` (the latest by default)."""
        return self._read(*self._state(version))

    def files(self, version: int | None = None) -> list[str]:
        return self._state(version)[1]

    def create(self, df: DataFrame, by: Sequence[str] = ()) -> int:
        return self._commit(1, df.schema, self._written(df, by))

    def append(self, df: DataFrame) -> int:
        """Add rows; columns that ``df`` lacks are null."""
        now = self.versions()[-1]
        schema, files = self._state(now)
        rows = df.select(*[(F.col(f"`{f.name}`") if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema])
        return self._commit(now + 1, schema, [*files, *self._written(rows)])

    def delete(self, condition: Column) -> int:
        """DELETE WHERE: rows for which ``condition`` is true go, those for which it is null stay. The files without such rows are kept."""
        now = self.versions()[-1]
        schema, files = self._state(now)
        name = lambda f: f.rsplit("/", 2)[1:]  # noqa: E731  folder and file; the folder is unique
        hit = self._read(schema, files).filter(condition).select(F.col("_metadata.file_path").alias("file")).distinct() if files else None
        hit = {tuple(name(r.file)) for r in hit.collect()} if files else set()  # file names only
        old = [f for f in files if tuple(name(f)) in hit]
        if not old:
            return self._commit(now + 1, schema, files)
        rest = self._read(schema, old).filter(~F.coalesce(condition, F.lit(False)))
        return self._commit(now + 1, schema, [f for f in files if f not in set(old)] + self._written(rest))

    def add_field(self, name: str, kind: str) -> int:
        """A nullable column more, without touching a file: what lacks it reads as null."""
        now = self.versions()[-1]
        schema, files = self._state(now)
        if name in schema.names:
            raise ValueError(f"{name} exists")
        return self._commit(now + 1, StructType(schema.fields).add(name, kind), files)
