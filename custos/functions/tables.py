"""Intermediate tables of iterative jobs, and atomic commits of written ones."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession

from custos.session import ensure_checkpoint_dir


class Workspace:
    """``with Workspace(spark) as w: t = w.table(df)`` writes ``df`` once and reads it back: lineage is cut, and a lost executor
    costs no more than its own tasks. Tables go when the block ends; those written with ``keep`` when the session ends."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.root = f"{ensure_checkpoint_dir(spark).rstrip('/')}/custos-work-{uuid.uuid4().hex[:12]}"
        self._drop: list[str] = []

    def _path(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p, p.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def table(self, df: DataFrame, *partition_by: str, keep: bool = False) -> DataFrame:
        path = f"{self.root}/{uuid.uuid4().hex[:12]}"
        df.write.partitionBy(*partition_by).parquet(path)
        if keep:
            p, fs = self._path(path)
            fs.deleteOnExit(p)
        else:
            self._drop.append(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def __enter__(self) -> Workspace:
        return self

    def __exit__(self, *exc) -> None:
        for path in self._drop:
            p, fs = self._path(path)
            fs.delete(p, True)
        self._drop.clear()


class CommitLog:
    """Numbered states of a table under ``root``, one small file each. A state names the folders that count, so writing
    folders changes nothing until the state that names them is there; it comes by a rename, which fails if its number exists."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")

    def fs(self):
        p = self.path("_commits")
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def newest(self) -> dict | None:
        fs, log = self.fs(), self.path("_commits")
        names = [s.getPath().getName() for s in fs.listStatus(log)] if fs.exists(log) else []
        names = sorted(n for n in names if n.endswith(".json"))
        return json.loads(self.spark.read.text(f"{self.root}/_commits/{names[-1]}", wholetext=True).first()[0]) if names else None

    def commit(self, state: dict) -> None:
        fs = self.fs()
        fs.mkdirs(self.path("_commits"))
        temporary, final = self.path(f"_commits/{uuid.uuid4().hex}.tmp"), self.path(f"_commits/{state['number']:08d}.json")
        out = fs.create(temporary, True)
        try:
            out.write(bytearray(json.dumps(state), "utf-8"))
        finally:
            out.close()
        if fs.exists(final) or not fs.rename(temporary, final):
            raise RuntimeError(f"another writer has committed number {state['number']}")
