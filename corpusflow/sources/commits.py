"""Commit log of batch jobs (K1, K2, ST1): a batch's tables become visible together.

Every attempt at a batch writes its tables to folders of its own; one small
file, written aside and renamed into place, then names them all.  A batch is
visible iff that file exists, so a failure between two writes leaves the
earlier snapshot, and readers that list committed batches never see half of
one.  A committed batch is not run again.

The log lives in ``<root>/_commits/<op>`` (Spark skips such folders when it
scans ``root``).  :meth:`CommitLog.compact` merges a table of all committed
batches into one folder and records a snapshot, so neither the number of entries
to read nor the number of folders grows without end.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession


class CommitLog:
    """The committed batches of one operation; a batch is named by (run, batch_id)."""

    def __init__(self, spark: SparkSession, root: str, op: str):
        self.spark, self.op = spark, op
        self.folder = f"{root.rstrip('/')}/_commits/{op}"
        self._jvm = spark.sparkContext._jvm
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()

    def _path(self, path: str):
        p = self._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self._conf), p

    def _names(self, folder: str) -> list[str]:
        fs, p = self._path(folder)
        return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []

    def _load(self, name: str) -> dict:
        fs, p = self._path(f"{self.folder}/{name}")
        stream = fs.open(p)
        try:
            return json.loads(self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _publish(self, name: str, record: dict) -> None:
        aside, final = f"{self.folder}/.{uuid.uuid4().hex}", f"{self.folder}/{name}"
        fs, p = self._path(aside)
        out = fs.create(p, True)
        out.write(bytearray(json.dumps(record), "utf-8"))
        out.close()
        if not fs.rename(p, self._path(final)[1]):
            fs.delete(p, False)
            raise RuntimeError(f"{final} could not be committed")

    @staticmethod
    def _name(run: str, batch_id: int) -> str:
        return f"{run}.{batch_id}.json"

    def _snapshot(self) -> dict:
        found = [n for n in self._names(self.folder) if n.startswith("snapshot-")]
        return self._load(found[-1]) if found else {"entries": [], "merged": {}}

    def entries(self) -> list[dict]:
        """All committed batches: run, batch_id, tables (name -> folder) and info."""
        snapshot = self._snapshot()
        known = {self._name(e["run"], e["batch_id"]) for e in snapshot["entries"]}
        new = [self._load(n) for n in self._names(self.folder) if n.endswith(".json") and not n.startswith(("snapshot-", ".")) and n not in known]
        return [*snapshot["entries"], *new]

    def entry(self, run: str, batch_id: int) -> dict | None:
        """The committed batch, or None."""
        fs, p = self._path(f"{self.folder}/{self._name(run, batch_id)}")
        return self._load(self._name(run, batch_id)) if fs.exists(p) else None

    def begin(self, run: str, batch_id: int, folders: dict[str, str]) -> dict[str, str]:
        """Folders for a new attempt at the batch: table name -> path below ``folders[name]``.

        What earlier attempts at this batch left is removed: they never committed.
        """
        attempt, out = uuid.uuid4().hex[:12], {}
        for name, root in folders.items():
            batch = f"{root.rstrip('/')}/run={run}/batch_id={batch_id}"
            fs, p = self._path(batch)
            fs.delete(p, True)
            out[name] = f"{batch}/attempt={attempt}"
        return out

    def commit(self, run: str, batch_id: int, tables: dict[str, str], info: dict | None = None) -> None:
        """Make the batch visible."""
        if self.entry(run, batch_id):
            raise RuntimeError(f"batch {batch_id} of run {run} is committed already")
        self._publish(self._name(run, batch_id), {"run": run, "batch_id": batch_id, "tables": tables, "info": info or {}})

    def read(self, table: str, schema) -> DataFrame:
        """A table over all committed batches (an empty frame before the first)."""
        snapshot = self._snapshot()
        merged = snapshot["merged"].get(table)
        covered = {(r, b) for r, b in merged["batches"]} if merged else set()
        paths = [merged["path"]] if merged else []
        paths += [e["tables"][table] for e in self.entries() if table in e["tables"] and (e["run"], e["batch_id"]) not in covered]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def compact(self, table: str, schema, folder: str) -> None:
        """Merge ``table`` of all committed batches into a new folder below ``folder`` and record a snapshot.

        The batches' own folders stay until :meth:`vacuum`, for readers that listed them before.
        """
        entries, snapshot = self.entries(), self._snapshot()
        own = [e for e in entries if table in e["tables"]]
        path = f"{folder.rstrip('/')}/merged={uuid.uuid4().hex[:12]}"
        self.read(table, schema).write.parquet(path)
        merged = snapshot["merged"] | {table: {"path": path, "batches": [[e["run"], e["batch_id"]] for e in own]}}
        n = len([x for x in self._names(self.folder) if x.startswith("snapshot-")])
        self._publish(f"snapshot-{n:09d}.json", {"entries": entries, "merged": merged})

    def vacuum(self, table: str) -> int:
        """Delete the folders of ``table`` that the latest snapshot has merged; returns how many."""
        merged = self._snapshot()["merged"].get(table)
        covered, gone = ({(r, b) for r, b in merged["batches"]} if merged else set()), 0
        for e in self.entries():
            if table in e["tables"] and (e["run"], e["batch_id"]) in covered:
                fs, p = self._path(e["tables"][table])
                gone += bool(fs.delete(p, True))
        return gone
