"""Several tables that change as one: data files of a new version first, then one manifest that names them.

Readers follow the newest manifest, so they see all of a change or nothing.  A manifest gets its
name by a rename that fails where the name is taken: of two writers that saw the same version one
wins, the other must read again.  Data of a change that never got its manifest is never read.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


class Conflict(RuntimeError):
    """Another writer has committed since."""


class TableSet:
    """Tables under a folder that all readers and writers share (any Hadoop file system with a rename that does not overwrite)."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        self._new = jvm.org.apache.hadoop.fs.Path
        self._fs = self._new(self.path).getFileSystem(conf)
        self._files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), conf)
        self._options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)

    def _manifest(self, version: int) -> str:
        return f"{self.path}/manifests/{version:012d}.json"

    def version(self) -> int:
        """Number of the newest manifest; 0 before the first change."""
        folder = self._new(f"{self.path}/manifests")
        if not self._fs.exists(folder):
            return 0
        names = [s.getPath().getName() for s in self._fs.listStatus(folder)]
        return max((int(n.removesuffix(".json")) for n in names if n.removesuffix(".json").isdigit()), default=0)

    def tables(self, version: int | None = None) -> dict[str, dict]:
        """Place and schema of each table."""
        n = self.version() if version is None else version
        return json.loads(self.spark.read.text(self._manifest(n), wholetext=True).first()[0]) if n else {}

    def read(self, name: str, version: int | None = None) -> DataFrame:
        found = self.tables(version)[name]
        return self.spark.read.schema(StructType.fromJson(found["schema"])).parquet(f"{self.path}/{found['place']}")

    def commit(self, changes: dict[str, DataFrame], expected: int | None = None) -> int:
        """Writes the changed tables and then the manifest; raises ``Conflict`` if ``expected`` is not the newest version any more."""
        base = self.version() if expected is None else expected
        tables = dict(self.tables(base))
        for name, df in changes.items():
            place = f"data/{name}-{uuid.uuid4().hex}"
            df.write.parquet(f"{self.path}/{place}")
            tables[name] = {"place": place, "schema": json.loads(df.schema.json())}
        self._swap(json.dumps(tables), base + 1)
        return base + 1

    def _swap(self, text: str, version: int) -> None:
        draft = self._new(f"{self.path}/drafts/{uuid.uuid4().hex}")
        out = self._fs.create(draft, False)
        out.write(bytearray(text.encode()))
        out.close()
        target = self._new(self._manifest(version))
        self._fs.mkdirs(target.getParent())
        try:
            self._files.rename(draft, target, self._options)
        except Exception as e:
            if self._fs.exists(target):
                raise Conflict(f"version {version} is there already") from e
            raise

    def vacuum(self, keep: int = 2) -> int:
        """Deletes data that none of the ``keep`` newest manifests names, and returns how many folders went; writers must be at rest."""
        newest = self.version()
        named = {t["place"].split("/")[-1] for v in range(max(1, newest - keep + 1), newest + 1) for t in self.tables(v).values()}
        folder = self._new(f"{self.path}/data")
        gone = [s.getPath() for s in (self._fs.listStatus(folder) if self._fs.exists(folder) else []) if s.getPath().getName() not in named]
        for p in gone:
            self._fs.delete(p, True)
        return len(gone)
