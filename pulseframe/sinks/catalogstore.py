"""A stored catalog whose upserts are atomic.

A version is a commit file that names, for every day, the folder that holds its entries.
An upsert reads and rewrites the days it touches into a new folder, and then adds a commit
in which only those days point elsewhere.  Readers see the last commit: a write that fails
before its commit leaves nothing but an unused folder, and the commit itself is a rename,
which fails when another writer took the number first.

The number of days bounds a commit; entries are never collected.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from pulseframe.operators.latest import upsert_segments

DAY = "day"


class CommitConflict(RuntimeError):
    """Another writer committed the same version."""


class CatalogStore:
    """The catalog below ``root``; entries carry ``device_id, day, hour, segment_file, created_at_ms``."""

    def __init__(self, spark: SparkSession, root: str, schema: StructType):
        self.spark, self.root, self.schema = spark, root.rstrip("/"), schema
        self._jvm = spark._jvm
        self._folder = self._path("commits")
        self._fs = self._folder.getFileSystem(spark._jsc.hadoopConfiguration())
        self._fs.mkdirs(self._folder)

    def _path(self, *parts: str):
        return self._jvm.org.apache.hadoop.fs.Path("/".join([self.root, *parts]))

    def versions(self) -> list[int]:
        """Committed versions, oldest first."""
        names = [s.getPath().getName() for s in self._fs.listStatus(self._folder)]
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json") and not n.startswith("."))

    def _days(self, version: int | None) -> dict[str, str]:
        """The folder of every day in a version."""
        if version is None:
            return {}
        rows = self.spark.read.text(f"{self.root}/commits/{version:012d}.json", wholetext=True).collect()
        return json.loads(rows[0]["value"])

    def _entries(self, days: dict[str, str]) -> DataFrame:
        if not days:
            return self.spark.createDataFrame([], self.schema)
        # Days are compared as written: no type is guessed from a folder name.
        folders = sorted(set(days.values()))
        parts = [
            self.spark.read.schema(self.schema).option("basePath", f).parquet(*[f"{f}/{DAY}={d}" for d in own])
            for f, own in ((f, [d for d, g in days.items() if g == f]) for f in folders)
        ]
        out = parts[0]
        for part in parts[1:]:
            out = out.unionByName(part)
        return out.select(self.schema.names)

    def read(self, version: int | None = None) -> DataFrame:
        """Entries of a version, the last one unless told."""
        known = self.versions()
        return self._entries(self._days(version if version is not None else (known[-1] if known else None)))

    def upsert(self, incoming: DataFrame) -> int:
        """Add entries; of one segment name the newest stays.  Returns the new version."""
        known = self.versions()
        version = known[-1] if known else 0
        days = self._days(version if known else None)
        incoming = incoming.select(self.schema.names)
        touched = sorted(r[DAY] for r in incoming.select(DAY).distinct().collect())
        if not touched:
            return version
        existing = self._entries({d: days[d] for d in touched if d in days})
        folder = f"{self.root}/data/{uuid.uuid4().hex}"
        merged = upsert_segments(existing, incoming).hint("rebalance", DAY)
        merged.sortWithinPartitions(DAY, "device_id", "hour").write.partitionBy(DAY).parquet(folder)
        self._commit(version + 1, days | dict.fromkeys(touched, folder))
        return version + 1

    def _commit(self, version: int, days: dict[str, str]) -> None:
        draft, final = self._path("commits", f".{uuid.uuid4().hex}"), self._path("commits", f"{version:012d}.json")
        out = self._fs.create(draft, False)
        out.write(bytearray(json.dumps(days, sort_keys=True).encode()))
        out.close()
        # A rename never replaces a file that is there.
        if self._fs.exists(final) or not self._fs.rename(draft, final):
            self._fs.delete(draft, False)
            raise CommitConflict(f"version {version} is taken")

    def expire(self, keep: int = 1) -> None:
        """Drop all but the last ``keep`` versions and the folders only they used."""
        known = self.versions()
        old, kept = known[: max(len(known) - keep, 0)], known[max(len(known) - keep, 0) :]
        used = {f for v in kept for f in self._days(v).values()}
        unused = {f for v in old for f in self._days(v).values()} - used
        for v in old:
            self._fs.delete(self._path("commits", f"{v:012d}.json"), False)
        for folder in unused:
            self._fs.delete(self._jvm.org.apache.hadoop.fs.Path(folder), True)


def segment_schema() -> StructType:
    """Entries as the manifests list them, by device, day and hour."""
    text = "device_id string, day string, hour string, segment_file string, min_ts bigint, max_ts bigint, rows bigint, created_at_ms bigint"
    return StructType.fromDDL(text)


def with_times(catalog: DataFrame) -> DataFrame:
    """Catalog entries of this schema; an entry is as old as its last row."""
    created = F.col("created_at_ms") if "created_at_ms" in catalog.columns else F.col("max_ts")
    return catalog.withColumn("created_at_ms", created).select(segment_schema().names)
