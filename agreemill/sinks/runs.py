"""Keyed runs that can be killed and resumed.

A run is a folder of tables that belong together (rows and their arrays). Work is
done in batches: each batch's tables are staged, moved to ``<table>/batch=<id>``,
and then named by one commit record in ``_commits``. Only recorded batches exist
for a reader; what a killed run left behind is swept by the next one. Keys of
recorded batches are not scored again (an anti-join), so a resumed run ends with
the rows of an uninterrupted one.

Everything goes through the folder's own file system, so the folder must be one
that driver and executors share. One run writes a folder at a time.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from agreemill.streaming.resume import not_done


class Run:
    """``path`` with the tables ``rows`` and any others of the same batches.

    ``settings`` name what the rows depend on: a folder begun under others is
    refused.
    """

    def __init__(self, spark: SparkSession, path: str, keys: tuple[str, ...], settings: str = ""):
        self.spark, self.path, self.keys, self.settings = spark, path.rstrip("/"), keys, settings

    def _fs(self, where: str) -> tuple:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(where)
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), path

    def _children(self, where: str) -> list[str]:
        fs, path = self._fs(where)
        return sorted(s.getPath().getName() for s in fs.listStatus(path)) if fs.exists(path) else []

    def _move(self, source: str, target: str) -> None:
        fs, path = self._fs(source)
        to = self._fs(target)[1]
        fs.mkdirs(to.getParent())
        if not fs.rename(path, to):
            raise OSError(f"could not move {source} to {target}")

    def _delete(self, where: str) -> None:
        fs, path = self._fs(where)
        fs.delete(path, True)

    def table(self, name: str) -> str:
        """Where a table lies; ``rows`` is the run's own folder."""
        return self.path if name == "rows" else f"{self.path}_{name}"

    def records(self) -> list[dict]:
        """The commit records, in order of their batches."""
        out = []
        for name in self._children(f"{self.path}/_commits"):
            if name.endswith(".json"):
                fs, path = self._fs(f"{self.path}/_commits/{name}")
                stream = fs.open(path)
                try:
                    out.append(json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")))
                finally:
                    stream.close()
        return out

    def read(self, name: str = "rows") -> DataFrame | None:
        """The committed batches of a table; None before the first."""
        batches = [r["batch"] for r in self.records() if name in r["tables"]]
        if not batches:
            return None
        return self.spark.read.option("basePath", self.table(name)).parquet(*[f"{self.table(name)}/batch={b}" for b in batches]).drop("batch")

    def sweep(self) -> int:
        """Delete what no record names; how many batches there were."""
        known = {r["batch"] for r in self.records()}
        swept = set()
        for table in {"rows", *(t for r in self.records() for t in r["tables"]), *self._tables_beside()}:
            for name in self._children(self.table(table)):
                if name.startswith("batch=") and name[6:] not in known:
                    swept.add(name)
                    self._delete(f"{self.table(table)}/{name}")
        self._delete(f"{self.path}/_staged")
        return len(swept)

    def clear(self) -> None:
        """Forget everything: the records go first, so that a kill on the way
        leaves only batches to sweep."""
        self._delete(f"{self.path}/_commits")
        self.sweep()

    def _tables_beside(self) -> list[str]:
        parent, _, own = self.path.rpartition("/")
        return [n[len(own) + 1 :] for n in self._children(parent or ".") if n.startswith(f"{own}_")]

    def start(self) -> int:
        """Check the settings and sweep; how many batches were swept."""
        for r in self.records():
            if r["settings"] != self.settings:
                raise ValueError(f"{self.path} was begun under other settings; write elsewhere")
        return self.sweep()

    def pending(self, samples: DataFrame) -> DataFrame:
        """The samples whose key no committed row has."""
        done = self.read()
        return samples if done is None else not_done(samples, done, self.keys)

    def stage(self, name: str, frame: DataFrame, batch: str) -> DataFrame:
        """Write a table of a batch where no reader looks, and read it."""
        where = f"{self.path}/_staged/{batch}/{name}"
        frame.write.mode("overwrite").parquet(where)
        return self.spark.read.parquet(where)

    def commit(self, batch: str, tables: list[str], **extras: object) -> None:
        """Move staged tables to their places, then record the batch."""
        for name in tables:
            self._move(f"{self.path}/_staged/{batch}/{name}", f"{self.table(name)}/batch={batch}")
        record = {"batch": batch, "tables": tables, "settings": self.settings, "ts": datetime.now(UTC).isoformat(), **extras}
        fs, path = self._fs(f"{self.path}/_commits/{batch}.tmp")
        stream = fs.create(path, True)
        stream.write(bytearray(json.dumps(record).encode()))
        stream.close()
        self._move(f"{self.path}/_commits/{batch}.tmp", f"{self.path}/_commits/{batch}.json")

    def score(self, samples: DataFrame, scored: Callable[[DataFrame, Callable[[str, DataFrame], DataFrame]], DataFrame], batches: int = 1) -> int:
        """Score what is pending, a batch at a time, by a hash of the key; how many
        batches were committed. A batch without rows leaves no trace.

        ``scored`` gets a batch's samples and a function that stages a further
        table of the batch and gives it back; it returns the batch's rows.
        """
        self.start()
        todo = self.pending(samples)
        mine = F.pmod(F.xxhash64(*self.keys), F.lit(batches))
        counts = {r["b"]: r["n"] for r in todo.groupBy(mine.alias("b")).agg(F.count("*").alias("n")).collect()}
        committed = 0
        for b in sorted(counts):
            batch, others = f"{b:05}-{uuid.uuid4().hex[:12]}", []

            def further(name: str, frame: DataFrame, batch: str = batch, others: list[str] = others) -> DataFrame:
                others.append(name)
                return self.stage(name, frame, batch)

            n_rows = self.stage("rows", scored(todo.where(mine == b), further), batch).count()
            if n_rows:
                self.commit(batch, [*others, "rows"], n_samples=counts[b], n_rows=n_rows)
                committed += 1
        self._delete(f"{self.path}/_staged")
        return committed
