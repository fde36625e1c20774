"""Committed tables: runs that append to one table, each of them exactly once.

Layout of a table's folder::

    data/<run>-<attempt>/*.parquet     staged records of one attempt of a run
    heads/<run>-<attempt>/*.parquet    the last number (seq) of every key that the run touched
    commits/<version>.json             one manifest per commit, written last

A run stages its records in a folder of its own attempt and then publishes a manifest
that names it; readers list manifests and read only what they name. So

* an attempt that dies leaves files that nobody reads;
* a run that is tried again finds its id in the log and changes nothing;
* two runs at the same time race for the next version: the loser finds the version
  taken, numbers its records again after the winner's and publishes the next one. Neither
  is lost.

A manifest is written under another name and renamed, which must fail where the new name
exists (``FileContext.rename`` without overwrite, the guarantee that Spark's own
streaming logs rest on). New numbers come from the heads, one row for each key and run,
never from the records; every ``COMPACT`` versions a commit writes the heads of all keys and
the list of all earlier folders, and readers go back no further than that.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

COMPACT = 16


@dataclass
class Snapshot:
    """What is committed up to ``version`` (0: nothing): run ids, and data and heads folders."""

    version: int = 0
    runs: list[str] = field(default_factory=list)
    data: list[str] = field(default_factory=list)
    heads: list[str] = field(default_factory=list)


class CommittedTable:
    """A table of ``schema`` whose records are numbered by ``number`` within ``key``."""

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType, key: str = "repo_id",
                 number: str = "seq"):
        self.spark, self.path, self.schema = spark, path.rstrip("/"), schema
        self.key, self.number = key, number
        self._jvm = spark._jvm.org.apache.hadoop
        self._conf = spark._jsc.hadoopConfiguration()

    # -- the log ---------------------------------------------------------------------------

    def _at(self, name: str):
        return self._jvm.fs.Path(f"{self.path}/{name}")

    def _fs(self):
        return self._jvm.fs.Path(self.path).getFileSystem(self._conf)

    def _versions(self) -> list[int]:
        fs, folder = self._fs(), self._at("commits")
        if not fs.exists(folder):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(folder)]
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())

    def _manifest(self, version: int) -> dict:
        stream = self._fs().open(self._at(f"commits/{version:012d}.json"))
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _state(self, upto: int) -> Snapshot:
        """What the commits 1 .. ``upto`` say."""
        since: list[dict] = []
        for v in range(upto, 0, -1):       # back to the last compacted manifest
            since.append(self._manifest(v))
            if "earlier" in since[-1]:
                break
        out = Snapshot()
        for m in reversed(since):
            if "earlier" in m:
                out.runs, out.data = list(m["earlier"]["runs"]), list(m["earlier"]["data"])
            out.version = m["version"]
            out.runs.append(m["run"])
            out.data.append(m["data"])
            out.heads.append(m["heads"])
        return out

    def snapshot(self, before_run: str | None = None) -> Snapshot:
        """The committed state; with ``before_run``, if committed, the one that run was numbered on."""
        state = self._state(max(self._versions(), default=0))
        if before_run in state.runs:       # versions follow one another: the k-th run is version k
            return self._state(state.runs.index(before_run))
        return state

    def _publish(self, manifest: dict) -> bool:
        """Write the manifest of its version; False if another run has taken that version."""
        name = f"commits/{manifest['version']:012d}.json"
        fs = self._fs()
        if fs.exists(self._at(name)):
            return False
        draft = self._at(f"commits/.{manifest['version']}-{uuid.uuid4().hex}.draft")
        stream = fs.create(draft, False)
        try:
            stream.write(bytearray(json.dumps(manifest).encode()))
        finally:
            stream.close()
        context = self._jvm.fs.FileContext.getFileContext(draft.toUri(), self._conf)
        rename = self.spark._jvm.java.lang.reflect.Array.newInstance(
            self.spark._jvm.java.lang.Class.forName("org.apache.hadoop.fs.Options$Rename"), 0)
        try:
            context.rename(draft, self._at(name), rename)
        except Exception:
            fs.delete(draft, False)
            if fs.exists(self._at(name)):
                return False
            raise
        return True

    # -- reading ---------------------------------------------------------------------------

    def _read(self, folders: list[str], schema: T.StructType) -> DataFrame:
        if not folders:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[f"{self.path}/{f}" for f in folders])

    def _plain(self) -> bool:
        """Whether the folder also holds files that were written before there was a log."""
        fs = self._fs()
        found = fs.globStatus(self._at("*.parquet"))
        return found is not None and len(list(found)) > 0

    def read(self, snapshot: Snapshot | None = None) -> DataFrame:
        """All committed records; an absent table reads as empty."""
        snapshot = snapshot or self.snapshot()
        folders = [*snapshot.data, *(["*.parquet"] if self._plain() else [])]
        return self._read(folders, self.schema)

    def heads(self, snapshot: Snapshot | None = None) -> DataFrame:
        """(key, last): the last number of every key, from the heads alone."""
        snapshot = snapshot or self.snapshot()
        schema = T.StructType([self.schema[self.key], T.StructField("last", T.LongType())])
        rows = self._read(snapshot.heads, schema)
        if self._plain():
            rows = rows.unionByName(self._last(self._read(["*.parquet"], self.schema)))
        return rows.groupBy(self.key).agg(F.max("last").alias("last"))

    def _last(self, records: DataFrame) -> DataFrame:
        return records.groupBy(self.key).agg(F.max(self.number).cast("long").alias("last"))

    # -- committing ------------------------------------------------------------------------

    def commit(self, run: str, make: Callable[[DataFrame], DataFrame]) -> bool:
        """Append what ``make(heads)`` returns, once for run id ``run``.

        ``make`` numbers the run's records after the given heads; it is called again where
        another run was faster. Returns False where the run is already committed.
        """
        while True:
            state = self.snapshot()
            if run in state.runs:
                return False
            name = f"{run}-{uuid.uuid4().hex}"
            data, heads = f"data/{name}", f"heads/{name}"
            records = make(self.heads(state))
            records.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in self.schema]) \
                .write.mode("errorifexists").parquet(f"{self.path}/{data}")
            last = self._last(self._read([data], self.schema))
            manifest = {"version": state.version + 1, "run": run, "data": data, "heads": heads}
            if manifest["version"] % COMPACT == 0:
                last = last.unionByName(self.heads(state)).groupBy(self.key).agg(
                    F.max("last").alias("last"))
                manifest["earlier"] = {"runs": state.runs, "data": state.data}
            last.write.mode("errorifexists").parquet(f"{self.path}/{heads}")
            if self._publish(manifest):
                return True
