"""Sharding by size-tiered compaction, under a versioned manifest.

Arrivals are appended as small immutable Parquet shards. Shards are of tiers by size, each tier ``FAN_IN`` times the one
below; a tier that has ``FAN_IN`` runs or more is merged into files of about the target size, by reading the small
files into fewer tasks, without a shuffle. Files of half the target or more are never merged again, so that a row is
rewritten about once a tier.

A manifest lists the shards of a version: a table of one row a shard, and a small file that names it. The small file is
renamed into place, which fails if that version exists, so a commit is atomic and of two writers one must look again.
Shards are written before and deleted after what the manifests say, so a job that dies leaves files which no version
lists. Planning happens on the driver over the manifest alone, some 100 bytes a shard (40 MB for 100 TB).

Defined results: rows come back as they were, repeated rows, nulls and all columns included; an append of no rows adds
no shards but a version; a store without versions reads as an empty table only if a schema is given.
"""

from __future__ import annotations

import json
import math
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpoint_dir, free_name

FAN_IN = 4
SMALLEST = 1 << 20
TARGET = 64 << 20
WAVES = 8
ENTRY = "file string, bytes long, rows long, tier int, added long"


class Conflict(RuntimeError):
    """Another writer has committed this version."""


def tier(size: int, smallest: int = SMALLEST, fan_in: int = FAN_IN) -> int:
    return 0 if size <= smallest else 1 + int(math.log(size / smallest, fan_in))


class ShardStore:
    """Shards and manifests below a folder of any file system that Spark writes to."""

    def __init__(self, spark: SparkSession, root: str, target: int = TARGET, smallest: int = SMALLEST, fan_in: int = FAN_IN):
        self.spark, self.root, self.target, self.smallest, self.fan_in = spark, root.rstrip("/"), target, smallest, fan_in
        jvm = spark._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())
        for sub in ("shards", "manifests", "versions"):
            self._fs.mkdirs(self._path(f"{self.root}/{sub}"))

    # manifests

    def latest(self) -> int:
        """The number of the last version, 0 without any."""
        return max(self.versions(), default=0)

    def versions(self) -> list[int]:
        """The numbers of the versions that can be read."""
        found = self._fs.listStatus(self._path(f"{self.root}/versions"))
        names = [s.getPath().getName() for s in found]
        return sorted(int(n[1:-5]) for n in names if n.startswith("v") and n.endswith(".json"))

    def _pointer(self, version: int) -> dict:
        lines = self.spark.read.text(f"{self.root}/versions/v{version:08d}.json").collect()
        return json.loads("".join(r[0] for r in lines))

    def entries(self, version: int | None = None) -> list[dict]:
        """Shards of a version, by file."""
        version = self.latest() if version is None else version
        if not version:
            return []
        table = self.spark.read.schema(ENTRY).parquet(f"{self.root}/manifests/{self._pointer(version)['entries']}")
        return sorted((r.asDict() for r in table.collect()), key=lambda e: e["file"])

    def commit(self, entries: list[dict], schema: str, base: int) -> int:
        """Make ``entries`` version ``base + 1``; Conflict if there is one already."""
        name, version = uuid.uuid4().hex, base + 1
        rows = [tuple(e[c.split()[0]] for c in ENTRY.split(", ")) for e in entries]
        self.spark.createDataFrame(rows, ENTRY).coalesce(1).write.parquet(f"{self.root}/manifests/{name}")
        waiting, final = self._path(f"{self.root}/versions/.{name}"), self._path(f"{self.root}/versions/v{version:08d}.json")
        out = self._fs.create(waiting, True)
        out.write(json.dumps({"entries": name, "parent": base, "schema": schema}).encode())
        out.close()
        self._rename_new(waiting, final, version)
        return version

    def _rename_new(self, waiting, final, version: int) -> None:
        jvm, gateway = self.spark._jvm, self.spark.sparkContext._gateway
        kind = jvm.java.lang.Class.forName("org.apache.hadoop.fs.Options$Rename")
        options = jvm.java.lang.reflect.Array.newInstance(kind, 1)
        jvm.java.lang.reflect.Array.set(options, 0, jvm.java.lang.Enum.valueOf(kind, "NONE"))
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(final.toUri(), self.spark._jsc.hadoopConfiguration())
        try:
            context.rename(self._fs.makeQualified(waiting), self._fs.makeQualified(final), options)
        except Exception as e:
            if "FileAlreadyExists" in str(e) or "already exists" in str(e):
                raise Conflict(f"version {version} exists") from e
            raise

    # shards

    def _written(self, folder: str, added: int) -> list[dict]:
        """An entry for each file of rows below a folder."""
        meta = self.spark.read.option("recursiveFileLookup", "true").parquet(folder)
        found = meta.groupBy(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_size").alias("bytes")).count().collect()
        return [{"file": r["file"], "bytes": r["bytes"], "rows": r["count"], "tier": tier(r["bytes"], self.smallest, self.fan_in), "added": added} for r in found]

    def append(self, rows: DataFrame) -> int:
        """Add rows as shards of their own, one for each of the frame's partitions."""
        folder = f"{self.root}/shards/{uuid.uuid4().hex}"
        rows.write.parquet(folder)
        return self._add(folder, rows.schema.json())

    def append_waves(self, rows: DataFrame, wave, after=lambda: None) -> list[int]:
        """Add rows as several arrivals, one version for each value of ``wave``, written in one pass over ``rows``.

        ``after`` is called once each arrival is committed.
        """
        folder, name, versions = f"{self.root}/shards/{uuid.uuid4().hex}", free_name(rows, "wave"), []
        rows.withColumn(name, wave).write.partitionBy(name).parquet(folder)
        found = self._fs.listStatus(self._path(folder))
        for w in sorted(s.getPath().getName() for s in found if s.getPath().getName().startswith(f"{name}=")):
            versions.append(self._add(f"{folder}/{w}", rows.schema.json()))
            after()
        return versions or [self.append(rows)]

    def _add(self, folder: str, schema: str) -> int:
        while True:
            base = self.latest()
            try:
                return self.commit(self.entries(base) + self._written(folder, base + 1), schema, base)
            except Conflict:
                continue

    def plan(self, entries: list[dict]) -> list[list[dict]]:
        """Runs to merge: shards of like size, of each tier that has enough of them."""
        small = [e for e in entries if e["bytes"] < self.target / 2]
        tiers: dict[int, list[dict]] = {}
        for e in sorted(small, key=lambda e: (e["bytes"], e["file"])):
            tiers.setdefault(e["tier"], []).append(e)
        return [t for _, t in sorted(tiers.items()) if len(t) >= self.fan_in]

    def settle(self) -> int:
        """Compact until no tier is due, as merged files can make the next one so, and delete what no version needs."""
        while self.plan(self.entries()):
            self.compact()
        self.vacuum()
        return self.latest()

    def compact(self) -> int:
        """Merge every tier that is due and commit; the version then current."""
        base = self.latest()
        entries = self.entries(base)
        due = self.plan(entries)
        if not due:
            return base
        schema = self._schema(base)
        merged = []
        for run in due:
            folder = f"{self.root}/shards/{uuid.uuid4().hex}"
            n = max(1, round(sum(e["bytes"] for e in run) / self.target))
            self._read(run, schema).coalesce(n).write.parquet(folder)
            merged += self._written(folder, base + 1)
        gone = {e["file"] for run in due for e in run}
        while True:
            now = self.entries(base)
            if not gone <= {e["file"] for e in now}:
                raise Conflict("another writer has merged these shards")
            try:
                return self.commit([e for e in now if e["file"] not in gone] + merged, schema, base)
            except Conflict:
                base = self.latest()

    def vacuum(self, versions: int = 1) -> int:
        """Delete all but the last versions, and the shards that only those listed; how many shards."""
        known = self.versions()
        gone, stay = known[:-versions], known[-versions:]
        keep = {e["file"] for v in stay for e in self.entries(v)}
        old = {e["file"] for v in gone for e in self.entries(v)} - keep
        for v in gone:
            manifest = self._pointer(v)["entries"]
            self._fs.delete(self._path(f"{self.root}/versions/v{v:08d}.json"), False)
            self._fs.delete(self._path(f"{self.root}/manifests/{manifest}"), True)
        return sum(bool(self._fs.delete(self._path(f), False)) for f in sorted(old))

    # reading

    def _schema(self, version: int) -> str:
        return self._pointer(version)["schema"]

    def _read(self, entries: list[dict], schema: str) -> DataFrame:
        from pyspark.sql.types import StructType

        kind = StructType.fromJson(json.loads(schema))
        reader = self.spark.read.schema(kind).option("recursiveFileLookup", "true")
        if not entries:
            return self.spark.createDataFrame([], kind)
        return reader.parquet(*(e["file"] for e in entries))

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version (the last): exactly those of the shards that it lists."""
        version = self.latest() if version is None else version
        if not version:
            raise ValueError("the store has no version")
        return self._read(self.entries(version), self._schema(version))


def op4_sharding(spark, sf_dir) -> DataFrame:
    """Documents arrive in eight waves, each followed by compaction; where each row then is, and what it holds."""
    store = ShardStore(spark, f"{checkpoint_dir(spark)}/shards-{uuid.uuid4().hex}")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    store.append_waves(docs, F.pmod(F.xxhash64("doc_id"), F.lit(WAVES)), store.settle)
    version = store.latest()
    rows = store.read(version).select("doc_id", F.length("text").cast("long").alias("text_chars"), F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"), F.col("_metadata.file_path").alias("file"))
    # one row a shard, of a manifest that the driver holds anyway
    shards = spark.createDataFrame([(e["file"], e["rows"], e["bytes"], e["tier"]) for e in store.entries(version)], "file string, shard_rows long, shard_bytes long, tier int")
    return rows.join(F.broadcast(shards), "file").select("doc_id", "text_chars", "text_sha256", F.element_at(F.split("file", "/"), -1).alias("shard"), "shard_rows", "shard_bytes", "tier", F.lit(version).cast("long").alias("version"))


QUERIES = {"op4_sharding": op4_sharding}
#: Shard names and sizes are of this run; the tests hold the rows to the documents.
ORACLE_SQL = {}
