"""Tables with versions: each commit writes files at a fresh path and then puts one manifest in place.

A manifest names the files of every bucket (rows by a hash of their key), so a commit rewrites only the
buckets that it touches, and every version stays readable until vacuum() takes it. The manifest of
version n is made once and never replaced: of two writers that began from one version the second
finds it there and gets a Conflict. A writer that fails leaves files that no manifest names, and the
table as it was. Needs a file system where a rename refuses to overwrite, as HDFS and local disks have.

Defined results: rows of a key replace those of the version before; rows that repeat a key in one commit
all stay; a null key is a key of its own; an empty commit makes a version that only says its reason.
"""

from __future__ import annotations

import json
import time
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Buckets of a new table; a table keeps its number.
BUCKETS = 64


class Conflict(Exception):
    """Another writer has committed since the version that this one began from."""


def _digests(rows: DataFrame) -> DataFrame:
    """A digest of each whole row: rows that are compared needn't be sent. JSON names the columns, so a null is none's neighbour."""
    whole = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}
    return rows.select(F.sha2(F.to_json(F.struct(*rows.columns), whole), 256).alias("digest"))


@dataclass
class Store:
    """A versioned table at ``path`` whose rows ``keys`` name."""

    spark: SparkSession
    path: str
    keys: list[str]
    buckets: int = BUCKETS

    def _fs(self, path: str):
        jvm, sc = self.spark.sparkContext._jvm, self.spark.sparkContext
        place = jvm.org.apache.hadoop.fs.Path(path)
        return place, place.getFileSystem(sc._jsc.hadoopConfiguration())

    def _manifest_path(self, version: int) -> str:
        return f"{self.path}/manifests/{version:010d}.json"

    def versions(self) -> list[int]:
        place, fs = self._fs(f"{self.path}/manifests")
        if not fs.exists(place):
            return []
        return sorted(int(n[:10]) for f in fs.listStatus(place) if (n := f.getPath().getName()).endswith(".json") and n[:10].isdigit())

    def latest(self) -> int:
        """The number of the newest version; 0 before the first."""
        return max(self.versions(), default=0)

    def manifest(self, version: int) -> dict:
        place, fs = self._fs(self._manifest_path(version))
        jvm = self.spark.sparkContext._jvm
        stream = fs.open(place)
        try:
            return json.loads(jvm.org.apache.commons.io.IOUtils.toString(stream, jvm.java.nio.charset.StandardCharsets.UTF_8))
        finally:
            stream.close()

    def _bucket(self):
        return F.pmod(F.xxhash64(*(F.col(k) for k in self.keys)), F.lit(self.buckets)).cast("int")

    def _read(self, manifest: dict, buckets: list[int] | None = None) -> DataFrame:
        kind = T.StructType.fromJson(manifest["schema"])
        names = [f"{self.path}/data/{name}/bucket={b}" for b, name in manifest["files"].items() if buckets is None or int(b) in buckets]
        return self.spark.read.schema(kind).parquet(*names) if names else self.spark.createDataFrame([], kind)

    def read(self, version: int | None = None, **key: object) -> DataFrame:
        """The rows of a version (None: the newest); with a whole key, only its bucket is read."""
        found = self.versions()
        if not found or (version is not None and version not in found):
            raise ValueError(f"{self.path} has no version {version}")
        manifest = self.manifest(found[-1] if version is None else version)
        self.buckets = manifest["buckets"]
        if not key:
            return self._read(manifest)
        kinds = {f.name: f.dataType for f in T.StructType.fromJson(manifest["schema"])}
        asked = self.spark.range(1).select(*(F.lit(key[k]).cast(kinds[k]).alias(k) for k in self.keys))
        rows = self._read(manifest, [asked.select(self._bucket().alias("b")).first()["b"]])
        for k in self.keys:
            rows = rows.where(F.col(k).eqNullSafe(F.lit(key[k]).cast(kinds[k])))
        return rows

    def history(self) -> DataFrame:
        """version, base, created_at (seconds), reason, about of each version that is kept."""
        rows = [tuple((m := self.manifest(v))[k] for k in ("version", "base", "created_at", "reason", "about")) for v in self.versions()]
        return self.spark.createDataFrame(rows, "version int, base int, created_at double, reason string, about string")

    def commit(self, rows: DataFrame, base: int, reason: str, about: str | None = None, expect: DataFrame | None = None) -> int:
        """Puts rows over those of version ``base`` and returns the new version; Conflict where base isn't the newest.

        expect: rows (keys and more) that have to be in base as they are, else Conflict too.
        """
        if self.latest() != base:
            raise Conflict(f"the table is at version {self.latest()}, not {base}")
        old = self.manifest(base) if base else None
        if old:
            self.buckets = old["buckets"]
            if expect is not None and _digests(expect).exceptAll(_digests(self._read(old).select(*expect.columns))).limit(1).count():
                raise Conflict("rows have changed since")
        name = uuid.uuid4().hex
        path = f"{self.path}/data/{name}"
        kind = T.StructType([T.StructField(f.name, f.dataType, True) for f in rows.schema.fields])
        # The new rows are made once, where they stay; what else has to be known of them is read from there.
        self._write(rows, path)
        place, fs = self._fs(path)
        named = [f.getPath().getName() for f in (fs.listStatus(place) if fs.exists(place) else [])]
        touched = sorted(int(n[7:]) for n in named if n.startswith("bucket="))
        if touched and old:
            kept = self._read(old, touched).select(*rows.columns)
            there = self.spark.read.schema(kind).parquet(*(f"{path}/bucket={b}" for b in touched)).select(*self.keys).distinct().alias("new")
            same = [kept[k].eqNullSafe(F.col(f"new.{k}")) for k in self.keys]
            on = same[0]
            for s in same[1:]:
                on = on & s
            self._write(kept.join(there, on, "left_anti"), path, "append")
        files = {**(old["files"] if old else {}), **{str(b): name for b in touched}}
        self._put({"version": base + 1, "base": base, "created_at": time.time(), "reason": reason, "about": about, "buckets": self.buckets, "schema": json.loads(kind.json()), "files": files})
        return base + 1

    def _write(self, rows: DataFrame, path: str, mode: str = "error") -> None:
        # Rebalancing splits a bucket that holds much over several tasks.
        rows.withColumn("bucket", self._bucket()).hint("rebalance", "bucket").write.mode(mode).partitionBy("bucket").parquet(path)

    def _put(self, manifest: dict) -> None:
        """The manifest, whole, at its place, unless there is one."""
        jvm = self.spark.sparkContext._jvm
        draft, fs = self._fs(f"{self.path}/drafts/{uuid.uuid4().hex}.json")
        out = fs.create(draft, False)
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        place, _ = self._fs(self._manifest_path(manifest["version"]))
        fs.mkdirs(place.getParent())
        try:
            if fs.getUri().getScheme() == "file":  # a rename on a local disk overwrites, a second link to a name can't
                local = [jvm.java.io.File(jvm.org.apache.hadoop.fs.Path.getPathWithoutSchemeAndAuthority(p).toString()).toPath() for p in (place, draft)]
                jvm.java.nio.file.Files.createLink(*local)
                fs.delete(draft, False)
            else:
                none = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
                jvm.org.apache.hadoop.fs.FileContext.getFileContext(place.toUri(), self.spark.sparkContext._jsc.hadoopConfiguration()).rename(draft, place, none)
        except Exception as e:
            if fs.exists(place):
                raise Conflict(f"version {manifest['version']} is there already") from e
            raise

    def vacuum(self, keep: int = 1) -> int:
        """Deletes all versions but the newest ``keep``, and the files that none of these names; returns how many folders went. No writer may be at work."""
        found = self.versions()
        stay = {name for v in found[-keep:] for name in self.manifest(v)["files"].values()}
        for v in found[:-keep]:
            place, fs = self._fs(self._manifest_path(v))
            fs.delete(place, False)
        data, fs = self._fs(f"{self.path}/data")
        gone = [f.getPath() for f in (fs.listStatus(data) if fs.exists(data) else []) if f.getPath().getName() not in stay]
        for p in gone:
            fs.delete(p, True)
        return len(gone)
