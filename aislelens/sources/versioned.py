"""A table of versions: upserts rewrite only the partitions they touch, replays do nothing, readers see whole versions."""

from __future__ import annotations

import hashlib
import json
import uuid
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


class Conflict(RuntimeError):
    """Another writer has committed the version meanwhile; nothing of this upsert is seen. Do it again."""


class VersionedTable:
    """Rows of unique `keys` in partitions by the column `part`, in `folder` (any Hadoop path). (K-03, ST-18)

    data/<version>/part_=<hex>/ holds a partition as one upsert left it. manifests/<version> is
    a JSON map of partitions to such folders, with the epochs that each stream has delivered and
    the schema, and its own digest in the last line. A version exists once its manifest is whole:
    it is created without overwriting, so of two writers one gets a Conflict, and one that a
    crash left half written doesn't count. Data without a manifest is never read, and vacuum()
    deletes it. Folders of partitions are named by a driver-side list: as many as there are
    partitions, not rows.
    """

    def __init__(self, spark: SparkSession, folder: str, keys: list[str], part: str):
        self.spark, self.folder, self.keys, self.part = spark, folder.rstrip("/"), keys, part

    # -------------------------------------------------------- files
    def _path(self, *names: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path("/".join((self.folder, *names)))
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _names(self, *names: str) -> list[str]:
        path, storage = self._path(*names)
        return sorted(s.getPath().getName() for s in storage.listStatus(path)) if storage.exists(path) else []

    def _manifest(self, name: str) -> dict[str, Any] | None:
        path, storage = self._path("manifests", name)
        stream = storage.open(path)
        try:
            text = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        body, _, digest = text.rpartition("\n")
        return json.loads(body) if body and hashlib.sha256(body.encode()).hexdigest() == digest else None

    def _commit(self, manifest: dict[str, Any]) -> None:
        body = json.dumps(manifest)
        path, storage = self._path("manifests", f"{manifest['version']:012d}")
        try:
            out = storage.create(path, False)
        except Exception as e:
            if "AlreadyExists" in str(e) or "already exists" in str(e):
                raise Conflict(f"version {manifest['version']} is there already") from e
            raise
        out.write(bytearray(f"{body}\n{hashlib.sha256(body.encode()).hexdigest()}".encode()))
        out.close()

    # -------------------------------------------------------- versions
    def manifest(self, version: int | None = None) -> dict[str, Any]:
        """That of the last whole version, or of the last one up to `version`."""
        for name in reversed(self._names("manifests")):
            if (version is None or int(name) <= version) and (found := self._manifest(name)) is not None:
                return found
        return {"version": 0, "parts": {}, "epochs": {}, "schema": None}

    def _free(self, version: int) -> int:
        """The number of the next version: after all manifests, whole or not."""
        return max([version, *map(int, self._names("manifests"))]) + 1

    def _read(self, manifest: dict[str, Any], parts: list[str] | None = None) -> DataFrame:
        schema = T.StructType.fromJson(manifest["schema"])
        folders = [f"{self.folder}/{d}" for p, d in sorted(manifest["parts"].items()) if parts is None or p in parts]
        return self.spark.read.schema(schema).parquet(*folders) if folders else self.spark.createDataFrame([], schema)

    def read(self, version: int | None = None) -> DataFrame:
        """The table as of its last version, or of an earlier one. Later upserts don't change what this reads."""
        known = self.manifest(version)
        if known["schema"] is None:
            raise ValueError(f"{self.folder} holds no version yet")
        return self._read(known)

    def upsert(self, new: DataFrame, stream: str, epoch: int) -> bool:
        """New rows replace stored ones of equal keys; of new ones the last loaded (load_no, if there is one) stays. False if the stream has delivered the epoch before.

        Each touched partition is read, merged by partial aggregation and written once; the
        others keep their files. Null keys are equal to each other, a null partition is one.
        """
        known = self.manifest()
        if epoch <= known["epochs"].get(stream, -1):
            return False
        new = new if "load_no" in new.columns else new.withColumn("load_no", F.lit(0).cast("long"))
        columns = [c for c in new.columns if c != "load_no"]
        schema = T.StructType([T.StructField(f.name, f.dataType) for f in new.select(*columns).schema.fields])
        old_schema = T.StructType.fromJson(known["schema"]) if known["schema"] else schema
        if {f.name: f.dataType for f in old_schema.fields} != {f.name: f.dataType for f in schema.fields}:
            raise ValueError("new rows have other columns than the table")
        new = new.withColumn("part_", self._name())
        touched = sorted(r["part_"] for r in new.select("part_").distinct().collect())
        version = self._free(known["version"])
        made: dict[str, str] = {}
        if touched:
            old = self._read(dict(known, schema=old_schema.jsonValue()), touched).select(*columns).withColumn("load_no", F.lit(None).cast("long")).withColumn("part_", self._name())
            rest = [c for c in columns if c not in self.keys]
            value = F.struct(*rest) if rest else F.lit(True)
            order = F.struct(F.col("load_no").isNotNull(), F.col("load_no"), value) if rest else F.struct(F.col("load_no").isNotNull(), F.col("load_no"))
            merged = old.unionByName(new).groupBy("part_", *self.keys).agg(F.max_by(value, order).alias("value_"))
            merged = merged.select("part_", *([F.col(k) for k in self.keys] + [F.col(f"value_.{c}").alias(c) for c in rest])).select("part_", *columns)
            made = self._write(merged, touched, version)
        self._commit({"version": version, "parts": known["parts"] | made, "epochs": known["epochs"] | {stream: epoch}, "schema": schema.jsonValue()})
        return True

    def delete(self, gone: DataFrame, stream: str, epoch: int) -> bool:
        """Rows whose keys and partition are those of a row of `gone` go; their partitions alone are rewritten. False if the stream has delivered the epoch before. (K-08)"""
        known = self.manifest()
        if epoch <= known["epochs"].get(stream, -1) or known["schema"] is None:
            return False
        gone = gone.withColumn("part_", self._name())
        touched = sorted(r["part_"] for r in gone.select("part_").distinct().collect())
        touched = [p for p in touched if p in known["parts"]]
        version = self._free(known["version"])
        on = [*self.keys, "part_"]
        old = self._read(known, touched).withColumn("part_", self._name())
        # Keys as one struct, so that null keys are equal to each other.
        left = old.join(gone.select(F.struct(*on).alias("gone_")).distinct(), F.struct(*(old[c] for c in on)) == F.col("gone_"), "left_anti")
        made = self._write(left, touched, version)
        # A partition of which nothing is left has no folder any more.
        parts = {p: d for p, d in (known["parts"] | made).items() if p not in made or self._names(*made[p].split("/"))}
        self._commit({"version": version, "parts": parts, "epochs": known["epochs"] | {stream: epoch}, "schema": known["schema"]})
        return True

    def _name(self):
        """The partition's folder: its text in hex."""
        return F.concat(F.lit("p"), F.coalesce(F.hex(F.encode(F.col(self.part).cast("string"), "UTF-8")), F.lit("null")))

    def _write(self, df: DataFrame, touched: list[str], version: int) -> dict[str, str]:
        """Partitions' new folders; df has part_."""
        if not touched:
            return {}
        data = f"data/{version:012d}-{uuid.uuid4().hex}"
        df.repartition("part_").write.partitionBy("part_").option("compression", "zstd").parquet(f"{self.folder}/{data}")
        return {p: f"{data}/part_={p}" for p in touched}

    def each_batch(self, stream: str):
        """A foreachBatch target: a micro-batch that is delivered again changes nothing."""
        return lambda df, epoch: self.upsert(df, stream, epoch) and None

    def vacuum(self, keep: int = 1) -> int:
        """Deletes folders of partitions that none of the last `keep` whole versions reads, and their manifests; returns how many folders. Not beside a running upsert."""
        whole = [(n, m) for n in self._names("manifests") if (m := self._manifest(n)) is not None][-keep:]
        live, gone = {d for _, m in whole for d in m["parts"].values()}, 0
        for run in self._names("data"):
            for leaf in self._names("data", run):
                if leaf.startswith("part_=") and f"data/{run}/{leaf}" not in live:
                    path, storage = self._path("data", run, leaf)
                    storage.delete(path, True)
                    gone += 1
        for n in self._names("manifests"):
            if whole and n < whole[0][0]:
                path, storage = self._path("manifests", n)
                storage.delete(path, False)
        return gone


def refresh(table: VersionedTable, events: DataFrame, stores: DataFrame, series, now: str, stream: str, epoch: int, hours_back: int = 24) -> bool:
    """Projects the last hours of the stores (store_id) of an ingested batch anew and upserts them. (ST-18)

    series: (events) -> rows of the table. The window begins at a full hour, so that its first
    bucket is whole. Events that came late change their bucket with the next batch of the store.
    """
    end = F.lit(now).cast("timestamp_ntz")
    start = F.date_trunc("hour", end - F.expr(f"interval {hours_back} hours")).cast("timestamp_ntz")
    recent = events.where((F.col("occurred_at") >= start) & (F.col("occurred_at") <= end)).join(stores.select("store_id").distinct(), "store_id", "left_semi")
    return table.upsert(series(recent), stream, epoch)
