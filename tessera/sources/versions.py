"""Tables that change: snapshots in a log, deletes as tombstones merged when read, commits by compare and swap.

A store is a folder. `log/<version>.json` names the parts and tombstones that make up a version; both are Parquet folders
called after the version that they were written for, each row with that version in AT. A commit is the renaming of its log
entry to a name that must be free, so of two writers who have read the same version one is refused, and a writer that is
lost before it leaves nothing that any version names. The renaming is atomic where the file system's is (HDFS); a local
file system looks first and renames then.
"""

from __future__ import annotations

import atexit
import json
import tempfile
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import spec

#: The version that a stored row or tombstone came with.
AT = "committed_at"
WIDTH = 20

#: What one change does: rows to add, and keys (or rows holding them) to delete.
Change = tuple[DataFrame | None, DataFrame | None]


class Conflict(RuntimeError):
    """Another writer has committed the version first."""


class Duplicate(RuntimeError):
    """Rows to insert have keys that are stored already, or that come twice."""


class Unsound(RuntimeError):
    """What was written doesn't pass its check when reread."""


@dataclass(frozen=True)
class Snapshot:
    version: int = 0
    key: tuple[str, ...] = ()
    parts: tuple[str, ...] = ()
    gone: tuple[str, ...] = field(default=())


@dataclass(frozen=True)
class Store:
    """A table of rows by key, in a folder that all executors share. Rows with a null in the key are refused by `insert`."""

    spark: SparkSession
    path: str
    key: tuple[str, ...]

    def versions(self) -> list[int]:
        """The versions that can be read, oldest first."""
        return sorted(int(n[:WIDTH]) for n in self._names("log") if n[:WIDTH].isdigit() and n.endswith(".json"))

    def snapshot(self, version: int | None = None) -> Snapshot:
        """What a version consists of; without one, the latest (an empty one if nothing was committed)."""
        known = self.versions()
        if version is None and not known:
            return Snapshot(key=self.key)
        at = known[-1] if version is None else version
        if at not in known:
            raise LookupError(f"version {at} isn't kept")
        found = json.loads("\n".join(r.value for r in self.spark.read.text(self._entry(at)).collect()))  # one small object
        made = Snapshot(at, *(tuple(found[n]) for n in ("key", "parts", "gone")))
        if made.key != self.key:
            raise ValueError(f"the store's key is {made.key}")
        return made

    def read(self, version: int | None = None) -> DataFrame | None:
        """The rows of a version; None before the first commit. Extra columns of later parts are null in earlier rows."""
        rows = self._stored(self.snapshot(version))
        return None if rows is None else rows.drop(AT)

    def present(self, keys: DataFrame) -> DataFrame:
        """keys with whether the latest version has them."""
        rows, asked = self.read(), keys.select(*self.key)
        if rows is None:
            return asked.withColumn("present", F.lit(False))
        marked = rows.select(*self.key).distinct().withColumn("present", F.lit(True))
        return asked.join(marked, list(self.key), "left").withColumn("present", F.coalesce("present", F.lit(False)))

    def commit(self, on: Snapshot, rows: DataFrame | None = None, deleted: DataFrame | None = None, check: Callable[[DataFrame], DataFrame] | None = None) -> Snapshot:
        """The version after `on`, with keys of deleted gone and then rows added; Conflict if `on` isn't the latest any more.

        Deleting keys that aren't there does nothing. check gives the unsound ones of the rows as reread, before they count.
        """
        new, made = replace(on, version=on.version + 1, key=self.key), []
        try:
            if deleted is not None:
                made.append(self._write(deleted.select(*self.key).distinct(), "gone", new.version))
                new = replace(new, gone=(*on.gone, made[-1]))
            if rows is not None:
                if AT in rows.columns:
                    raise ValueError(f"rows can't have a column {AT}")
                made.append(self._write(rows, "parts", new.version))
                new = replace(new, parts=(*on.parts, made[-1]))
                if check is not None and not check(self.spark.read.parquet(f"{self.path}/{made[-1]}")).isEmpty():
                    raise Unsound(f"{made[-1]} doesn't pass its check")
            self._swap(new)
        except BaseException:
            for part in made:
                self._remove(part)
            raise
        return new

    def insert(self, rows: DataFrame, tries: int = 3) -> Snapshot:
        """rows added if none of their keys is null, stored or twice among them; else Duplicate, and nothing is added."""

        def change(stored: DataFrame | None) -> Change:
            empty = stored if stored is not None else rows.limit(0)
            missing = F.lit(False)
            for k in self.key:
                missing = missing | F.col(k).isNull()
            if not rows.where(missing).isEmpty() or not spec.conflicts(rows, empty, list(self.key)).isEmpty():
                raise Duplicate("keys are null, stored or come twice")
            return rows, None

        return self.transact(change, tries)

    def upsert(self, rows: DataFrame, tries: int = 3) -> Snapshot:
        """rows in place of those of their keys."""
        return self.transact(lambda _: (rows, rows), tries)

    def delete(self, keys: DataFrame, tries: int = 3) -> Snapshot:
        return self.transact(lambda _: (None, keys), tries)

    def transact(self, change: Callable[[DataFrame | None], Change], tries: int = 3) -> Snapshot:
        """A change computed from the latest rows, and anew from the rows of whoever came first, up to so many times."""
        for left in reversed(range(tries)):
            on = self.snapshot()
            stored = self._stored(on)
            try:
                return self.commit(on, *change(None if stored is None else stored.drop(AT)))
            except Conflict:
                if not left:
                    raise
        raise ValueError("tries must be 1 or more")

    def compact(self) -> Snapshot:
        """A version of the same rows in one part, without tombstones; a store without any stays as it is."""
        on = self.snapshot()
        rows = self._stored(on)
        if rows is None:
            return on
        part = self._folder("parts", on.version + 1)
        try:
            rows.write.parquet(f"{self.path}/{part}")
            return self._swap(replace(on, version=on.version + 1, parts=(part,), gone=()))
        except BaseException:
            self._remove(part)
            raise

    def vacuum(self, keep: int = 1) -> list[str]:
        """Remove versions but the last `keep`, and all folders that none of those names; the folders.

        A folder written for a version that is still to come belongs to a writer at work and stays.
        """
        known = self.versions()
        if keep < 1 or not known:
            return []
        kept = [self.snapshot(v) for v in known[-keep:]]
        for v in known[:-keep]:
            self._remove(f"log/{v:0{WIDTH}}.json")
        named = {part for s in kept for part in (*s.parts, *s.gone)}
        made = [f"{kind}/{n}" for kind in ("parts", "gone") for n in self._names(kind)]
        idle = [part for part in made if part not in named and int(part.split("/")[1][:WIDTH]) <= known[-1]]
        for part in idle:
            self._remove(part)
        return idle

    def _stored(self, of: Snapshot) -> DataFrame | None:
        if not of.parts:
            return None
        rows = self.spark.read.option("mergeSchema", "true").parquet(*(f"{self.path}/{part}" for part in of.parts))
        if not of.gone:
            return rows
        gone = self.spark.read.parquet(*(f"{self.path}/{part}" for part in of.gone)).groupBy(*self.key).agg(F.max(AT).alias(AT)).alias("gone")
        same = [F.col(f"rows.{k}").eqNullSafe(F.col(f"gone.{k}")) for k in self.key]
        return rows.alias("rows").join(gone, [*same, F.col(f"gone.{AT}") > F.col(f"rows.{AT}")], "left_anti")

    def _folder(self, kind: str, version: int) -> str:
        return f"{kind}/{version:0{WIDTH}}-{uuid.uuid4().hex}"

    def _write(self, rows: DataFrame, kind: str, version: int) -> str:
        part = self._folder(kind, version)
        rows.withColumn(AT, F.lit(version).cast("long")).write.parquet(f"{self.path}/{part}")
        return part

    def _entry(self, version: int) -> str:
        return f"{self.path}/log/{version:0{WIDTH}}.json"

    def _swap(self, new: Snapshot) -> Snapshot:
        """The log entry written aside and renamed to its place, which must be free."""
        fs, jvm = self._files(), self.spark.sparkContext._jvm.org.apache.hadoop.fs
        aside, place = jvm.Path(f"{self.path}/log/{uuid.uuid4().hex}.tmp"), jvm.Path(self._entry(new.version))
        out = fs.create(aside, False)
        out.write(bytearray(json.dumps({"key": new.key, "parts": new.parts, "gone": new.gone}), "utf-8"))
        out.close()
        none = self.spark.sparkContext._gateway.new_array(jvm.Options.Rename, 1)
        none[0] = jvm.Options.Rename.NONE
        try:
            jvm.FileContext.getFileContext(fs.getUri(), self.spark.sparkContext._jsc.hadoopConfiguration()).rename(aside, place, none)
        except Exception as e:
            fs.delete(aside, False)
            if fs.exists(place):
                raise Conflict(f"version {new.version} is another writer's") from e
            raise
        return new

    def _files(self):
        at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
        return at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _names(self, folder: str) -> list[str]:
        fs, at = self._files(), self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{folder}")
        return [s.getPath().getName() for s in fs.listStatus(at)] if fs.exists(at) else []

    def _remove(self, what: str) -> None:
        self._files().delete(self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{what}"), True)


_made: list[Store] = []


def scratch(spark: SparkSession, *key: str) -> Store:
    """A store under spark.checkpoint.dir that goes when the program ends; a local session that has set none uses a folder of its own."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        root = f"file://{tempfile.gettempdir()}/tessera"
    _made.append(Store(spark, f"{root.rstrip('/')}/stores/{uuid.uuid4().hex}", key))
    return _made[-1]


@atexit.register
def _remove_scratch() -> None:
    for store in _made:
        if store.spark.sparkContext._jsc is not None:
            store._remove("")
