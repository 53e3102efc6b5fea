"""A log of observations in one folder, merged a partition at a time under numbered manifests.

Rows lie in folders of a UTC day each. A merge reads and writes the days that its rows
touch and no others; the manifest of a version names, for each day, the folder that
holds it. A reader of a version sees that version whole, whatever is merged meanwhile,
and a merge under a number that the log already has changes nothing.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from observatory.operators.ingest import upsert
from observatory.operators.temporal import dedup_last

_PART = "__day"


class ObservationLog:
    """Rows of ``schema``, one for each value of ``keys`` and instant ``at``, of which ``keys`` has at least one column."""

    def __init__(self, spark: SparkSession, path: str, schema: StructType, keys: list[str], at: str) -> None:
        self.spark, self.path, self.schema, self.keys, self.at = spark, path.rstrip("/"), schema, keys, at

    # ---- manifests

    def _file_system(self):
        jvm = self.spark._jvm
        root = jvm.org.apache.hadoop.fs.Path(self.path)
        return jvm, root.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _manifest(self, version: int) -> str:
        return f"{self.path}/manifests/{version:012d}.json"

    def version(self) -> int:
        """The newest version; 0 is the empty log."""
        jvm, fs = self._file_system()
        folder = jvm.org.apache.hadoop.fs.Path(f"{self.path}/manifests")
        if not fs.exists(folder):
            return 0
        names = [s.getPath().getName() for s in fs.listStatus(folder)]
        return max((int(n.removesuffix(".json")) for n in names if n.endswith(".json") and n[0].isdigit()), default=0)

    def manifest(self, version: int | None = None) -> dict:
        """{"parts": {day: folder}, "batches": {source: last batch merged}} of a version."""
        version = self.version() if version is None else version
        if not version:
            return {"parts": {}, "batches": {}}
        return json.loads("".join(r.value for r in self.spark.read.text(self._manifest(version)).collect()))

    def _commit(self, version: int, manifest: dict) -> None:
        """Writes the manifest aside and gives it its name, which fails if another writer has taken the version."""
        jvm, fs = self._file_system()
        made = jvm.org.apache.hadoop.fs.Path(f"{self.path}/manifests/.{uuid.uuid4().hex}")
        out = fs.create(made, False)
        out.write(bytearray(json.dumps(manifest, sort_keys=True).encode()))
        out.close()
        to = jvm.org.apache.hadoop.fs.Path(self._manifest(version))
        if fs.exists(to) or not fs.rename(made, to):
            fs.delete(made, False)
            raise RuntimeError(f"version {version} of {self.path} was written by another merge")

    # ---- rows

    def _read(self, folders: list[str]) -> DataFrame:
        if not folders:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*(f"{self.path}/{f}" for f in folders))

    def read(self, version: int | None = None, days: tuple[str, str] | None = None) -> DataFrame:
        """The rows of a version; ``days`` (first, last) leaves out the folders of other days before anything is listed."""
        parts = self.manifest(version)["parts"]
        return self._read([f for d, f in sorted(parts.items()) if days is None or days[0] <= d <= days[1]])

    def merge(self, rows: DataFrame, seq: str, source: str = "", batch: int | None = None, keep_if_null: tuple[str, ...] = ()) -> dict:
        """Merges rows of one batch: a new instant appends, the same one is replaced by the row of the largest ``seq``.

        A log that has ``seq`` as a column keeps the row of the largest one, whatever
        comes first; in one without it what comes in replaces what is stored.
        Returns what was done: {"version", "days", "folder"}. A ``batch`` not above the
        last one merged of its ``source`` is taken for a repeat and does nothing, so a
        batch whose commit was lost or whose merge was cut short can be tried again.
        Rows of null instants have no day and are an error.
        """
        version = self.version()
        manifest = self.manifest(version)
        if batch is not None and manifest["batches"].get(source, -1) >= batch:
            return {"version": version, "days": [], "folder": None}
        day = F.coalesce(F.date_format(F.date_trunc("day", self.at), "yyyy-MM-dd"), F.raise_error(F.lit("an observation without an instant")))
        # one scan of the batch; as many names as it has days
        days = sorted(r[0] for r in rows.select(day.alias("d")).distinct().collect())
        folder = f"data/{version + 1:012d}-{uuid.uuid4().hex}"
        if days:
            stored = self._read([manifest["parts"][d] for d in days if d in manifest["parts"]])
            if seq in self.schema.names:
                merged = dedup_last(stored.unionByName(rows.select(*self.schema.names)), [*self.keys, self.at], seq)
            else:
                merged = upsert(stored, rows.select(*self.schema.names, seq), [*self.keys, self.at], seq, keep_if_null)
            parted = merged.withColumn(_PART, day)
            # keys beside the day, so that a day with most rows is written by many tasks; AQE joins small ones
            parted.repartition(_PART, F.pmod(F.xxhash64(*self.keys), F.lit(16))).write.partitionBy(_PART).parquet(f"{self.path}/{folder}")
        parts = manifest["parts"] | {d: f"{folder}/{_PART}={d}" for d in days}
        batches = manifest["batches"] | ({source: batch} if batch is not None else {})
        self._commit(version + 1, {"parts": parts, "batches": batches})
        return {"version": version + 1, "days": days, "folder": folder if days else None}

    def vacuum(self, keep: int = 1) -> int:
        """Deletes the folders that none of the newest ``keep`` versions names, and says how many."""
        jvm, fs = self._file_system()
        newest = self.version()
        used = {f for v in range(max(1, newest - keep + 1), newest + 1) for f in self.manifest(v)["parts"].values()}
        gone = 0
        data = jvm.org.apache.hadoop.fs.Path(f"{self.path}/data")
        for version in fs.listStatus(data) if fs.exists(data) else []:
            for part in fs.listStatus(version.getPath()):
                name = f"data/{version.getPath().getName()}/{part.getPath().getName()}"
                if part.isDirectory() and name not in used:
                    fs.delete(part.getPath(), True)
                    gone += 1
        for v in range(1, newest - keep + 1):
            fs.delete(jvm.org.apache.hadoop.fs.Path(self._manifest(v)), False)
        return gone
