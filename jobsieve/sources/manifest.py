"""Commits by manifest: what a table or a set of tables is made of, one small file per version.

Data is written first, to folders of its own; a version exists once its manifest does. The file is
created exclusively and counts only when whole, so a commit happens entirely or not at all, and of two
writers of one version one is refused.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession


class ConflictError(RuntimeError):
    """Another writer has committed in the meantime; the work has to be done again."""


class Manifests:
    """The versions kept under ``path``; a manifest is a dictionary with its ``version``."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        self._fs_path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._fs_path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def _versions(self) -> list[int]:
        folder = self._fs_path(f"{self.path}/manifests")
        if not self._fs.exists(folder):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(folder)]
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json"))

    def newest(self) -> dict:
        """The newest whole manifest; version 0 if there is none."""
        for version in reversed(self._versions()):
            text = self.spark.read.text(f"{self.path}/manifests/{version:012d}.json", wholetext=True).collect()
            try:
                return json.loads(text[0][0])
            except (json.JSONDecodeError, IndexError):  # its writer did not finish it
                continue
        return {"version": 0}

    def commit(self, after: dict, manifest: dict) -> dict:
        """Make ``manifest`` the version that follows ``after``, or raise ``ConflictError``."""
        if self.newest()["version"] != after["version"]:
            raise ConflictError("another version was committed meanwhile")
        made = manifest | {"version": (self._versions() or [0])[-1] + 1}
        file = self._fs_path(f"{self.path}/manifests/{made['version']:012d}.json")
        try:
            out = self._fs.create(file, False)
        except Exception as error:
            if "AlreadyExists" not in str(error):
                raise
            raise ConflictError(f"{file.toString()} is there already") from None
        out.write(bytearray(json.dumps(made).encode()))
        out.close()
        return made

    def write(self, rows: DataFrame) -> dict:
        """Write rows to a folder that no version names yet: its ``path`` and ``bytes``."""
        folder = f"{self.path}/data/{uuid.uuid4().hex}"
        rows.write.parquet(folder)
        return {"path": folder, "bytes": self._fs.getContentSummary(self._fs_path(folder)).getLength()}

    def delete(self, folder: str) -> None:
        self._fs.delete(self._fs_path(folder), True)


class TableSet:
    """Several tables that change together."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.manifests = Manifests(spark, path)

    def read(self) -> dict[str, DataFrame]:
        """All tables as of one version."""
        held = self.manifests.newest().get("tables", {})
        return {name: self.manifests.spark.read.schema(t["schema"]).parquet(t["path"]) for name, t in held.items()}

    def replace(self, tables: dict[str, DataFrame]) -> None:
        """Put new contents in place of these tables, all of them or none; other tables stay."""
        state = self.manifests.newest()
        staged = {}
        for name, rows in tables.items():
            schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
            staged[name] = self.manifests.write(rows) | {"schema": schema}
        held = state.get("tables", {})
        left = [t["path"] for name, t in held.items() if name in staged]
        self.manifests.commit(state, {"tables": held | staged, "left": left})
        for folder in state.get("left", []):  # readers of the version before this one may still be at theirs
            self.manifests.delete(folder)
