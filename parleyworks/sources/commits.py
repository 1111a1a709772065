"""Tables with commits: several writers may add rows, and readers always see a whole version.

A table is a folder of data files, none of which ever changes, and one manifest for each version, which lists for each bucket of ids the
folders that hold it. A commit writes its data first, then publishes the manifest of the next number in one step that fails where that
number is taken; a writer that comes second reads what the first has added and tries again. A writer that fails before it publishes leaves
folders that no manifest names and the old version as it is.

A null key is a key. ``add`` keeps what is stored: it reads the ids of the buckets that its rows fall into, and writes new rows alone. ``upsert`` rewrites those buckets
with the newest row of each id. Buckets are a hash of the id, ``buckets`` of them, a number that stays with the table.
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


class Taken(Exception):
    """Another writer has published this version."""


class Table:
    """The table at ``path`` with columns ``schema``, one row for each ``key``."""

    def __init__(self, spark: SparkSession, path: str, schema: str, key: Sequence[str], buckets: int = 64):
        self.spark, self.path, self.schema, self.key, self.buckets = spark, path, schema, list(key), buckets
        jvm = spark._jvm
        self._at = lambda name: jvm.org.apache.hadoop.fs.Path(f"{path}/{name}")
        self._fs = self._at("manifest").getFileSystem(spark._jsc.hadoopConfiguration())

    # ---- versions

    def version(self) -> int:
        """The number of the last version; 0 where nothing is stored yet."""
        if not self._fs.exists(self._at("manifest")):
            return 0
        names = [s.getPath().getName() for s in self._fs.listStatus(self._at("manifest"))]
        return max((int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit()), default=0)

    def _manifest(self, version: int) -> dict[str, list[str]]:
        if version == 0:
            return {}
        return json.loads(self.spark.read.text(f"{self.path}/manifest/{version:020d}.json", wholetext=True).first()[0])

    def _publish(self, version: int, manifest: dict[str, list[str]]) -> None:
        final, made = self._at(f"manifest/{version:020d}.json"), self._at(f"manifest/.{uuid.uuid4().hex}")
        self._fs.mkdirs(self._at("manifest"))
        out = self._fs.create(made, False)
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        try:
            if self._fs.getScheme() == "file":  # there a rename replaces; a link does not
                try:
                    os.link(made.toUri().getPath(), final.toUri().getPath())
                except FileExistsError as error:
                    raise Taken(version) from error
            elif self._fs.exists(final) or not self._fs.rename(made, final):
                raise Taken(version)
        finally:
            self._fs.delete(made, False)

    # ---- reading and writing

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of the last version, or of the one named."""
        return self._rows(self._manifest(self.version() if version is None else version))

    def _rows(self, manifest: dict[str, list[str]], only: Sequence[str] | None = None) -> DataFrame:
        folders = sorted({f for b, fs in manifest.items() if only is None or b in only for f in fs})
        if not folders:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*(f"{self.path}/{f}" for f in folders))

    def _bucketed(self, rows: DataFrame) -> DataFrame:
        return rows.withColumn("__bucket", F.pmod(F.xxhash64(*self.key), F.lit(self.buckets)).cast("int"))

    def _write(self, rows: DataFrame) -> dict[str, str]:
        """The folder of each bucket of ``rows``, in a new place."""
        place = f"data/{uuid.uuid4().hex}"
        self._bucketed(rows).repartition("__bucket").write.partitionBy("__bucket").parquet(f"{self.path}/{place}")
        names = [s.getPath().getName() for s in self._fs.listStatus(self._at(place))]
        return {n.partition("=")[2]: f"{place}/{n}" for n in names if n.startswith("__bucket=")}

    def _one_each(self, rows: DataFrame, first: list) -> DataFrame:
        rest = [c for c in rows.columns if c not in (*self.key, "__new")]
        w = Window.partitionBy(*self.key).orderBy(*first, *rest)
        return rows.withColumn("__rn", F.row_number().over(w)).where("__rn = 1").drop("__rn")

    def _commit(self, change, tries: int) -> int:
        for _ in range(tries):
            version = self.version()
            manifest = change(self._manifest(version))
            if manifest is None:
                return version
            try:
                self._publish(version + 1, manifest)
                return version + 1
            except Taken:
                continue
        raise RuntimeError(f"other writers were first {tries} times")

    def _touched(self, rows: DataFrame) -> list[str]:
        return [str(r[0]) for r in self._bucketed(rows).select("__bucket").distinct().collect()]  # one for each bucket at most

    def add(self, rows: DataFrame, tries: int = 20) -> int:
        """Store the rows whose key is not stored; of several with one key the smallest. Returns the version that has them."""
        touched = self._touched(rows)

        def change(manifest: dict[str, list[str]]) -> dict[str, list[str]] | None:
            known = self._rows(manifest, touched).select([F.col(k).alias(f"__{k}") for k in self.key])
            same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in self.key])
            new = self._write(self._one_each(rows.join(known, same, "left_anti"), []))
            return manifest | {b: [*manifest.get(b, []), f] for b, f in new.items()} if new else None

        return self._commit(change, tries)

    def upsert(self, rows: DataFrame, order: Sequence[str], tries: int = 20) -> int:
        """Store the newest row of each key by ``order``, of those stored and ``rows``; a new row wins a tie. Only the buckets of ``rows`` are read and written."""
        touched = self._touched(rows)

        def change(manifest: dict[str, list[str]]) -> dict[str, list[str]] | None:
            both = self._rows(manifest, touched).withColumn("__new", F.lit(0)).unionByName(rows.withColumn("__new", F.lit(1)))
            new = self._write(self._one_each(both, [*(F.desc(c) for c in order), F.desc("__new")]).drop("__new"))
            return {b: fs for b, fs in manifest.items() if b not in new} | {b: [f] for b, f in new.items()} if new else None

        return self._commit(change, tries)
