"""A set of tables that change together, and deletes that cascade through it.

Each table lies in buckets of a key, each bucket in a folder. A manifest names the folder of every bucket of every
table; a change writes new folders of the buckets it touches and then one new manifest, which makes all of them
current at once. A run that breaks off before leaves folders that no manifest names, and the old version current.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Mapping
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from snapfold.tables import cut

BUCKETS = 16
_BUCKET = "_bucket"


class Link(NamedTuple):
    """Rows of ``child`` go with the row of ``parent`` whose ``parent_key`` their ``child_key`` names."""

    child: str
    child_key: str
    parent: str
    parent_key: str


class Unused(NamedTuple):
    """Rows of ``table`` go once no row of any of ``used_by`` (table, column) names their ``key``."""

    table: str
    key: str
    used_by: tuple[tuple[str, str], ...]


class Conflict(RuntimeError):
    """Another change was made since this one began."""


class Tables:
    """A versioned set of tables in a folder that driver and executors share."""

    def __init__(self, spark: SparkSession, folder: str, buckets: int = BUCKETS):
        self.spark, self.folder, self.buckets = spark, folder.rstrip("/"), buckets

    # --- manifests

    def _path(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(name)
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def version(self) -> int:
        """The current version; 0 before the first."""
        path, fs = self._path(f"{self.folder}/manifests")
        if not fs.exists(path):
            return 0
        names = [s.getPath().getName() for s in fs.listStatus(path)]
        return max((int(n) for n in names if n.isdigit()), default=0)

    def manifest(self, version: int | None = None) -> dict:
        version = self.version() if version is None else version
        if not version:
            return {}
        lines = self.spark.read.text(f"{self.folder}/manifests/{version}", wholetext=True).first()
        return json.loads(lines[0])

    def _commit(self, manifest: dict, version: int) -> None:
        """Make a manifest the given version: written aside, then renamed, which fails if somebody else was first."""
        aside, fs = self._path(f"{self.folder}/manifests/.{uuid.uuid4().hex}")
        out = fs.create(aside)
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        final, _ = self._path(f"{self.folder}/manifests/{version}")
        if fs.exists(final) or not fs.rename(aside, final):
            fs.delete(aside, True)
            raise Conflict(f"version {version} is already there")

    # --- tables

    def read(self, name: str, version: int | None = None, buckets: list[int] | None = None) -> DataFrame:
        """A table of the current or of an earlier version, or some of its buckets."""
        return self._rows(name, self.manifest(version), None if buckets is None else {str(b) for b in buckets})

    def bucket(self, key: str) -> Column:
        return F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(self.buckets)).cast("int")

    def _write(self, name: str, rows: DataFrame, key: str) -> dict[str, str]:
        """Folders of the buckets of rows, by bucket.

        Spark joins small buckets in one task and deals a large one out over several, so a task's rows do not grow with
        the table.
        """
        folder = f"{name}/{uuid.uuid4().hex}"
        rows.withColumn(_BUCKET, self.bucket(key)).hint("rebalance", _BUCKET).write.partitionBy(_BUCKET).parquet(f"{self.folder}/{folder}")
        path, fs = self._path(f"{self.folder}/{folder}")
        names = [s.getPath().getName() for s in fs.listStatus(path)]
        return {n.split("=")[1]: f"{folder}/{n}" for n in names if n.startswith(_BUCKET)}

    def put(self, tables: Mapping[str, tuple[DataFrame, str]]) -> int:
        """Write whole tables, each with the key that its buckets go by, as the next version."""
        version = self.version()
        manifest = self.manifest(version) | {name: {"key": key, "schema": df.schema.json(), "folders": self._write(name, df, key)} for name, (df, key) in tables.items()}
        self._commit(manifest, version + 1)
        return version + 1

    def delete(self, table: str, removed: DataFrame, links: tuple[Link, ...] = (), unused: tuple[Unused, ...] = ()) -> dict[str, int]:
        """Remove rows of a table by the key of its buckets, all that hang on them, then what nobody uses any more.

        removed has one column, the key. Links are followed from parents to children, however deep; a table that is
        reached over several links loses the rows of each. Null keys hang on nothing. Only buckets that lose rows are
        written anew. Returns how many rows each table lost; a delete that finds no row makes no version.
        """
        version = self.version()
        manifest = self.manifest(version)
        fresh: dict[str, dict] = {}
        # The rows of a table that go are those with one of some values in one of some columns.
        going = {table: [(manifest[table]["key"], cut(removed.select(F.col(removed.columns[0]).alias(manifest[table]["key"])).dropna().distinct()))]}
        lost = {}
        for name in order_of(table, links):
            rows = self.read(name, version)
            gone = [rows.join(values, column, "left_semi") for column, values in going[name]]
            for link in (k for k in links if k.parent == name):
                values = [g.select(F.col(link.parent_key).alias(link.child_key)) for g in gone]
                going.setdefault(link.child, []).append((link.child_key, cut(reduce(DataFrame.unionByName, values).dropna().distinct())))
            lost[name] = self._rewrite(name, manifest, fresh, gone, lambda rows, name=name: reduce(lambda r, c: r.join(c[1], c[0], "left_anti"), going[name], rows))
        for u in unused:
            used = [self._rows(other, manifest | fresh).select(F.col(column).alias(u.key)) for other, column in u.used_by]
            used = cut(reduce(DataFrame.unionByName, used).dropna().distinct())
            idle = self._rows(u.table, manifest | fresh).join(used, u.key, "left_anti")
            lost[u.table] = lost.get(u.table, 0) + self._rewrite(u.table, manifest | fresh, fresh, [idle], lambda rows, u=u, used=used: rows.join(used, u.key, "left_semi"))
        if fresh:
            self._commit(manifest | fresh, version + 1)
        return lost

    def _rows(self, name: str, manifest: dict, buckets: set[str] | None = None) -> DataFrame:
        entry = manifest[name]
        schema = T.StructType.fromJson(json.loads(entry["schema"]))
        paths = [f"{self.folder}/{p}" for b, p in entry["folders"].items() if buckets is None or b in buckets]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def _rewrite(self, name: str, manifest: dict, fresh: dict, gone: list[DataFrame], rest) -> int:
        """Write the buckets of the rows that go without them; returns how many went."""
        entry = manifest[name]
        hit = reduce(DataFrame.unionByName, [g.select(self.bucket(entry["key"]).alias("b")) for g in gone]).distinct()
        touched = {str(r.b) for r in hit.collect()}  # as many as buckets at most
        if not touched:
            return 0
        rows = self._rows(name, manifest, touched)
        folders = self._write(name, rest(rows), entry["key"])
        fresh[name] = entry | {"folders": {b: p for b, p in entry["folders"].items() if b not in touched} | folders}
        return rows.count() - self._rows(name, fresh, touched).count()


def order_of(root: str, links: tuple[Link, ...]) -> list[str]:
    """The tables that hang on root, each after all it hangs on."""
    done, open_ = [], set()

    def visit(name: str) -> None:
        if name in open_:
            raise ValueError(f"{name} hangs on itself")
        if name not in done:
            open_.add(name)
            for link in links:
                if link.parent == name:
                    visit(link.child)
            open_.remove(name)
            done.append(name)

    visit(root)
    return done[::-1]
