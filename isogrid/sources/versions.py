"""A store of tables whose changes become visible all together.

Data files are written to new folders and never changed. A manifest, one small JSON file with a number, says which folder holds
each part (a partition, or a whole table). A reader takes the manifest of the highest number and sees the state that it
describes, whatever a writer does meanwhile; a writer that fails leaves no manifest, so nothing of its work is seen. One writer
at a time: one that finds the number it was about to take in use fails.
"""

from __future__ import annotations

import json
import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession


class VersionedStore:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._at = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._at(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def versions(self) -> list[int]:
        """Numbers of the committed manifests, in order."""
        found = self._fs.globStatus(self._at(f"{self.path}/manifest/*.json"))
        return sorted(int(f.getPath().getName().split(".")[0]) for f in found or [])

    def manifest(self, version: int | None = None) -> dict[str, dict]:
        """Of the last commit or a given one: parts (table -> part -> the folder of its data) and written (how many parts a folder has)."""
        known = self.versions()
        if not known:
            return {"parts": {}, "written": {}}
        name = f"{self.path}/manifest/{known[-1] if version is None else version:012d}.json"
        return json.loads(self.spark.read.text(name, wholetext=True).first()[0])

    def commit(self, tables: dict[str, DataFrame], parts: dict[str, list[str]] | None = None) -> int:
        """Write the tables and make them visible together; the number of the new version.

        A table with ``parts`` (columns) is stored by partition, and only partitions that it has rows of are replaced. Others
        are replaced whole.
        """
        before = self.versions()
        state, folder = self.manifest(), uuid.uuid4().hex
        for name, df in tables.items():
            columns, target = (parts or {}).get(name, []), f"{self.path}/data/{folder}/{name}"
            writer = df.write.partitionBy(*columns) if columns else df.write
            writer.parquet(target)
            if columns:
                found = self._fs.globStatus(self._at("/".join([target, *(f"{c}=*" for c in columns)])))
                fresh = {"/".join(str(f.getPath()).split("/")[-len(columns) :]): folder for f in found or []}
                state["parts"][name] = {**state["parts"].get(name, {}), **fresh}
            else:
                fresh = state["parts"][name] = {"": folder}
            state["written"][f"{folder}/{name}"] = len(fresh)
        self._publish(state, (before[-1] if before else 0) + 1)
        return (before[-1] if before else 0) + 1

    def _publish(self, state: dict[str, dict], version: int) -> None:
        """The switch: the manifest is written under another name and renamed, which is one step of the file system."""
        draft, final = self._at(f"{self.path}/manifest/_draft-{uuid.uuid4().hex}"), self._at(f"{self.path}/manifest/{version:012d}.json")
        out = self._fs.create(draft, False)
        out.write(bytearray(json.dumps(state).encode()))
        out.close()
        if self._fs.exists(final) or not self._fs.rename(draft, final):
            self._fs.delete(draft, False)
            raise RuntimeError(f"version {version} was taken by another writer")

    def read(self, table: str, schema: str, version: int | None = None) -> DataFrame:
        """The table as of the last commit, or a given one; folders' names are columns, so filters on them reach the scan."""
        state, held = self.manifest(version), {}
        for part, folder in state["parts"].get(table, {}).items():
            held.setdefault(folder, []).append(part)
        scans = []
        for folder, parts in sorted(held.items()):
            root = f"{self.path}/data/{folder}/{table}"
            whole = len(parts) == state["written"][f"{folder}/{table}"]
            paths = [root] if whole else [f"{root}/{p}" for p in sorted(parts)]
            scans.append(self.spark.read.schema(schema).option("basePath", root).parquet(*paths))
        return reduce(DataFrame.unionByName, scans) if scans else self.spark.createDataFrame([], schema)

    def vacuum(self, keep: int = 2) -> None:
        """Delete data folders and manifests that none of the last ``keep`` versions needs."""
        known = self.versions()
        kept = {f for v in known[-keep:] for table in self.manifest(v)["parts"].values() for f in table.values()}
        for v in known[:-keep]:
            self._fs.delete(self._at(f"{self.path}/manifest/{v:012d}.json"), False)
        for found in self._fs.globStatus(self._at(f"{self.path}/data/*")) or []:
            if found.getPath().getName() not in kept:
                self._fs.delete(found.getPath(), True)
