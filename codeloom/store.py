"""The index as versioned Parquet snapshots.

Relations lie in folders of their own, ``data/<relation>/<unique name>``; a
version is one small file, ``versions/<n>``, that says which folder each
relation has in it.  The version in force is the highest number, so a version
comes into force when its file is renamed into place: readers see a whole
version or the one before, and there is never a moment without one.  A version
that changes one relation points to the other folders of the version before.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Collection

from pyspark.sql import DataFrame, SparkSession

from codeloom.schema import RELATIONS, evolve
from codeloom.session import fs, publish

SORT = {"files": ["path"], "symbols": ["name"], "imports": ["source_file_id"], "references": ["symbol_id"]}


class NoIndex(RuntimeError):
    """There is no index at this place."""


class Store:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.fs, self.P = fs(spark, self.root)

    def _names(self, folder: str) -> list[str]:
        at = self.P(f"{self.root}/{folder}")
        return [s.getPath().getName() for s in self.fs.listStatus(at)] if self.fs.exists(at) else []

    def versions(self) -> list[int]:
        return sorted(int(n) for n in self._names("versions") if n.isdigit())

    def current(self) -> int | None:
        return (self.versions() or [None])[-1]

    def exists(self) -> bool:
        return self.current() is not None

    def folders(self, version: int) -> dict[str, str]:
        """Relation -> its folder below ``data`` in a version."""
        return json.loads(self.spark.read.text(f"{self.root}/versions/{version}").first()[0])

    def read(self, relation: str, version: int | None = None) -> DataFrame:
        """A relation, with columns that an older version lacks filled in."""
        v = self.current() if version is None else version
        if v is None:
            raise NoIndex(f"no index at {self.root}")
        at = self.folders(v).get(relation)
        if at is None:
            return self.spark.createDataFrame([], RELATIONS[relation])
        return evolve(self.spark.read.parquet(f"{self.root}/data/{at}"), relation)

    def all(self) -> dict[str, DataFrame]:
        return {r: self.read(r) for r in RELATIONS}

    def write(self, relations: dict[str, DataFrame], keep: Collection[str] = (), fail_at: str | None = None) -> int:
        """Write relations and put them in force as one version.

        The relations named in ``keep`` stay as they are in the version before;
        those in neither are empty.  Rows are sorted inside files (no shuffle),
        which gives row groups tight minima and maxima for point lookups.
        ``fail_at`` ("data" or "version") raises after that step and exists for
        crash tests.
        """
        before = self.current()
        made = {k: v for k, v in (self.folders(before) if before is not None else {}).items() if k in keep}
        for name, df in relations.items():
            made[name] = f"{name}/{uuid.uuid4().hex}"
            (df.sortWithinPartitions(*SORT[name]) if name in SORT else df).write.parquet(f"{self.root}/data/{made[name]}")
        if fail_at == "data":
            raise RuntimeError("stopped after the data")
        beside = f"{self.root}/_writing/{uuid.uuid4().hex}"
        out = self.fs.create(self.P(beside), False)
        out.write(bytearray(json.dumps(made).encode()))
        out.close()
        if fail_at == "version":
            raise RuntimeError("stopped before the version was put in force")
        version = (before or 0) + 1
        publish(self.spark, beside, f"{self.root}/versions/{version}")
        return version

    def drop_old(self, keep: int = 2) -> None:
        """Forget all but the last ``keep`` versions, and the folders that only they use.

        Not to be called while another writer is at work: folders of a version
        not yet in force are in no version.
        """
        versions = self.versions()
        used = {at for v in versions[-keep:] for at in self.folders(v).values()}
        for v in versions[:-keep]:
            self.fs.delete(self.P(f"{self.root}/versions/{v}"), False)
        for relation in self._names("data"):
            for name in self._names(f"data/{relation}"):
                if f"{relation}/{name}" not in used:
                    self.fs.delete(self.P(f"{self.root}/data/{relation}/{name}"), True)
