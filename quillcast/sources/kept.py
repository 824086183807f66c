"""A table that several jobs and streams add to, and that is folded from time to time.

Rows are added as parts, each a folder of its own under the name its writer gives it, so a
repeated run or micro-batch replaces its own part and nothing else. Folding writes the base
and all complete parts as a new base, bucketed and sorted by the key, and names it in a
manifest. The manifest with the highest number is the table; its number can be taken once,
so of two writers that fold at the same time one gives up and loses nothing.

What a fold replaces is deleted by the fold after the next one, so a reader that began
before still finds its files. The number of files stays bounded: buckets of two
bases, and the parts of three folds.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql.types import StructType

from quillcast.sources import folders

FOLD_AT = 20  # parts


class View(NamedTuple):
    """What is in the table: the bucketed base, if there is one yet, and the parts since."""

    base: DataFrame | None
    parts: DataFrame
    buckets: int

    def rows(self) -> DataFrame:
        return self.parts if self.base is None else self.base.unionByName(self.parts)


class KeptLog:
    """A table under ``root`` with this schema (as DDL), looked up by ``key``.

    ``reduce`` turns all rows into those worth keeping whenever parts are folded.
    """

    def __init__(
        self,
        spark: SparkSession,
        root: str,
        schema: str,
        key: list[str],
        buckets: int = 64,
        reduce: Callable[[DataFrame], DataFrame] | None = None,
    ):
        self.spark, self.root, self.schema, self.key = spark, root, schema, key
        self.buckets, self.reduce = buckets, reduce

    def _manifest(self) -> tuple[int, dict]:
        """The last manifest that was written to the end, and its number."""
        for name in reversed(folders.names(self.spark, f"{self.root}/manifest")):
            try:
                return int(name), json.loads(folders.read_text(self.spark, f"{self.root}/manifest/{name}"))
            except json.JSONDecodeError:  # still being written
                continue
        return 0, {"base": None, "folded": [], "before": []}

    def _parts(self, manifest: dict) -> list[str]:
        done = {*manifest["folded"], *manifest["before"]}
        found = folders.names(self.spark, f"{self.root}/parts")
        return [n for n in found if n not in done and folders.complete(self.spark, f"{self.root}/parts/{n}")]

    def _table(self, base: str) -> str:
        return "kept_" + hashlib.sha256(f"{self.root}/{base}".encode()).hexdigest()[:40]

    def _base(self, base: str) -> DataFrame:
        """The base as a bucketed table, which this session's catalog may not know yet."""
        keys = ", ".join(self.key)
        self.spark.sql(
            f"CREATE TABLE IF NOT EXISTS {self._table(base)} ({self.schema}) USING parquet CLUSTERED BY ({keys}) "
            f"SORTED BY ({keys}) INTO {self.buckets} BUCKETS LOCATION '{self.root}/bases/{base}'"
        )
        return self.spark.table(self._table(base))

    def _read(self, names: list[str]) -> DataFrame:
        if not names:
            return self.spark.createDataFrame([], StructType.fromDDL(self.schema))
        return self.spark.read.schema(self.schema).parquet(*[f"{self.root}/parts/{n}" for n in names])

    def view(self, without: str | None = None, where: Column | None = None) -> View:
        """The table as it is now, without the part of one name."""
        _, manifest = self._manifest()
        parts = self._read([n for n in self._parts(manifest) if n != without])
        base = self._base(manifest["base"]) if manifest["base"] else None
        if where is not None:
            parts, base = parts.where(where), base if base is None else base.where(where)
        return View(base, parts, self.buckets)

    def read(self) -> DataFrame:
        return self.view().rows()

    def append(self, name: str, rows: DataFrame) -> None:
        """Add a part, in place of an earlier one of this name. One that has been folded in stays as it is."""
        _, manifest = self._manifest()
        if name not in {*manifest["folded"], *manifest["before"]}:
            rows.write.mode("overwrite").parquet(f"{self.root}/parts/{name}")

    def fold(self, at: int = FOLD_AT) -> bool:
        """Fold the complete parts into a new base, if there are as many as ``at``."""
        number, manifest = self._manifest()
        names = self._parts(manifest)
        if len(names) < max(at, 1):
            return False
        rows = self._read(names)
        if manifest["base"]:
            rows = self._base(manifest["base"]).unionByName(rows)
        base = f"{number + 1:010d}-{uuid.uuid4().hex[:12]}"
        (
            (self.reduce(rows) if self.reduce else rows)
            .repartition(self.buckets, *self.key)  # one file per bucket
            .write.format("parquet")
            .bucketBy(self.buckets, *self.key)
            .sortBy(*self.key)
            .option("path", f"{self.root}/bases/{base}")
            .saveAsTable(self._table(base))
        )
        told = {"base": base, "folded": names, "before": manifest["folded"]}
        if not folders.write_new(self.spark, f"{self.root}/manifest/{number + 1:010d}", json.dumps(told)):
            self._drop(base)
            return False
        for name in manifest["folded"]:
            folders.delete(self.spark, f"{self.root}/parts/{name}")
        for old in folders.names(self.spark, f"{self.root}/bases"):
            if old < base[:10] and old != manifest["base"]:
                self._drop(old)
        for old in folders.names(self.spark, f"{self.root}/manifest"):
            if int(old) < number:
                folders.delete(self.spark, f"{self.root}/manifest/{old}")
        return True

    def _drop(self, base: str) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self._table(base)}")
        folders.delete(self.spark, f"{self.root}/bases/{base}")
