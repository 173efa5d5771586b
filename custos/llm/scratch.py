"""Intermediate tables in the shared folder of ``spark.checkpoint.dir``.

A written table cuts lineage like a checkpoint: whoever reads it survives the
loss of any executor, and it is stored compressed and column by column. Tables
are deleted when the block ends (everything that read them has been written by
then), those that the returned frame still reads when the session ends.
"""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from collections.abc import Callable
from pathlib import Path

import custos
from custos.session import ensure_checkpoint_dir
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def ship(spark: SparkSession) -> None:
    """Make the package importable on the executors, once a session: Spark hands the archive out."""
    sc = spark.sparkContext
    if getattr(sc, "_custos_shipped", False):
        return
    root = Path(custos.__file__).parent
    archive = Path(tempfile.mkdtemp(prefix="custos-"), "custos.zip")
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f.relative_to(root.parent))
    sc.addPyFile(str(archive))
    sc._custos_shipped = True


def map_arrow(df: DataFrame, function: Callable, schema: str, passed: str | None = None) -> DataFrame:
    """``df.mapInArrow`` with this package at hand on every executor; the column ``passed`` of ``df``, if named,
    comes last in the result, as it is."""
    ship(df.sparkSession)
    kind = StructType.fromDDL(schema)
    return df.mapInArrow(function, kind if passed is None else StructType([*kind.fields, df.schema[passed]]))


def column(name: str) -> Column:
    """The column of that name, whatever characters it has."""
    return F.col("`" + name.replace("`", "``") + "`")


def packed_rest(df: DataFrame, columns: list[str]) -> Column:
    """The columns as one struct, whatever their names."""
    return F.struct(*[column(c) for c in columns])


class Scratch:
    """``with Scratch(spark) as s: t = s.table(df)`` writes ``df`` and reads it back."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.root = f"{ensure_checkpoint_dir(spark).rstrip('/')}/llm-{uuid.uuid4().hex}"
        self._drop: list[str] = []

    def table(self, df: DataFrame, keep: bool = False) -> DataFrame:
        path = f"{self.root}/{uuid.uuid4().hex[:12]}"
        df.write.parquet(path)
        if keep:
            self._fs(path).deleteOnExit(self._path(path))
        else:
            self._drop.append(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def _path(self, path: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(path)

    def _fs(self, path: str):
        return self._path(path).getFileSystem(self.spark._jsc.hadoopConfiguration())

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *exc) -> None:
        for path in self._drop:
            self._fs(path).delete(self._path(path), True)
        self._drop.clear()


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names that ``df`` doesn't have yet, made from ``names``."""
    have, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in have:
            name = f"_{name}"
        have.add(name.lower())
        out.append(name)
    return out


def text_mark(doc_id: str = "doc_id", text: str = "text"):
    """Tells rows apart that share a doc_id (or have none) but not the text."""
    return F.when(F.col(doc_id).isNull(), F.xxhash64(text)).otherwise(F.hash(text).cast("long"))
