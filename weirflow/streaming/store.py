"""A table kept as versioned snapshots, for file formats that can't be merged into."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession


class SnapshotStore:
    """Snapshots of named tables under one folder; a pointer, put in place by one rename, names the current ones.

    Every commit carries the id of its micro-batch. A batch that comes again after its commit is known
    and skipped, one that died before it left nothing that a reader sees. The file system's rename must
    be atomic and must not replace an existing file, as on HDFS.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._Path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._Path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def _pointer(self) -> dict:
        root = self._Path(f"{self.path}/pointers")
        names = [s.getPath().getName() for s in self._fs.listStatus(root)] if self._fs.exists(root) else []
        versions = sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json"))
        if not versions:
            return {"batch": -1, "tables": {}, "appended": {}}
        return json.loads(self.spark.read.text(f"{self.path}/pointers/{versions[-1]}.json", wholetext=True).take(1)[0].value)

    @property
    def last_batch(self) -> int:
        return self._pointer()["batch"]

    def read(self, name: str) -> DataFrame | None:
        """The current snapshot of a table, or all that was appended under a name."""
        at = self._pointer()
        paths = [at["tables"][name]] if name in at["tables"] else at["appended"].get(name, [])
        return self.spark.read.parquet(*paths) if paths else None

    def commit(self, batch: int, tables: dict[str, DataFrame], appended: dict[str, DataFrame] | None = None) -> None:
        """Replace the tables and add to the appended ones, all at once. A batch that isn't newer than the last commit changes nothing."""
        was = self._pointer()
        if batch <= was["batch"]:
            return
        tag = f"{batch}-{uuid.uuid4().hex}"
        now = {"batch": batch, "tables": dict(was["tables"]), "appended": {k: list(v) for k, v in was["appended"].items()}}
        for name, df in tables.items():
            now["tables"][name] = f"{self.path}/{name}/{tag}"
            df.write.parquet(now["tables"][name])
        for name, df in (appended or {}).items():
            now["appended"].setdefault(name, []).append(f"{self.path}/{name}/{tag}")
            df.write.parquet(now["appended"][name][-1])
        draft, final = self._Path(f"{self.path}/drafts/{tag}.json"), self._Path(f"{self.path}/pointers/{batch}.json")
        self._fs.mkdirs(final.getParent())
        stream = self._fs.create(draft)
        stream.write(bytearray(json.dumps(now).encode()))
        stream.close()
        if self._fs.exists(final) or not self._fs.rename(draft, final):
            raise RuntimeError(f"batch {batch} was committed by another query")
