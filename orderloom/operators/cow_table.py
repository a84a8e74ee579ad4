"""Change feeds applied by bucketed copy-on-write.

A table is a folder of Parquet buckets (hash of the key) and of manifests.
``apply`` hashes the base by key, routes the changes to their buckets, merges
only the buckets that a change touches, writes replacement files beside the old
ones and commits a manifest that names the files which hold now. Every write has
a folder of its own, so no writer touches files of another, and a manifest's
name is taken once: of two writers that start from one manifest the second
raises and leaves the table as the first made it. A reader sees the old or the
new manifest, never a mixture; a job that dies before the commit leaves files
that no manifest names.
"""

from __future__ import annotations

import json
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Spellings that mean a delete, compared in lower case.
DELETES = ["d", "del", "delete", "deleted", "remove", "removed", "rm"]

STATE = "external_id string, version int, change_id long, deleted boolean, payload string"


def record_key(col: Column) -> Column:
    """Ids are compared trimmed and in upper case; a blank id is none."""
    key = F.upper(F.regexp_replace(col, r"^\s+|\s+$", ""))
    return F.when(key != "", key)


def latest_changes(changes: DataFrame) -> DataFrame:
    """One row per record: its highest version, of that the first to arrive.

    Repeated changes, changes out of order and versions sent again fold into
    one row in a map-side combine, before anything is shuffled. Rows without id,
    version or change_id are no changes. Columns besides those of the feed are
    ignored.
    """
    known = changes.select(
        record_key(F.col("external_id")).alias("external_id"),
        F.col("version").cast("int").alias("version"),
        F.col("change_id").cast("long").alias("change_id"),
        F.coalesce(F.lower(F.trim("op")).isin(DELETES), F.lit(False)).alias("deleted"),
        F.col("payload").cast("string").alias("payload"),
    ).where("external_id IS NOT NULL AND version IS NOT NULL AND change_id IS NOT NULL")
    best = F.max(F.struct("version", (-F.col("change_id")).alias("first"), "deleted", "payload")).alias("b")
    return known.groupBy("external_id").agg(best).select(
        "external_id", "b.version", (-F.col("b.first")).alias("change_id"), "b.deleted", "b.payload"
    )


class BucketedTable:
    """State per record, kept as buckets; deletes stay as tombstones.

    Tombstones keep a late change of a lower version from reviving a record.
    An empty feed commits nothing; an empty table reads as no rows.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int = 64):
        self.spark, self.path = spark, path.rstrip("/")
        jvm = spark._jvm
        self._hpath = jvm.org.apache.hadoop.fs.Path
        self._fs = self._hpath(self.path).getFileSystem(spark._jsc.hadoopConfiguration())
        found = self._manifest()
        self.buckets = found["buckets"] if found else buckets

    # manifests ----------------------------------------------------------
    def _manifest(self) -> dict | None:
        """The manifest of the highest number. One that is still being written (not whole JSON) is none yet."""
        folder = self._hpath(f"{self.path}/manifests")
        if not self._fs.exists(folder):
            return None
        names = [s.getPath().getName() for s in self._fs.listStatus(folder)]
        numbers = [int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit()]
        for number in sorted(numbers, reverse=True):
            stream = self._fs.open(self._hpath(f"{self.path}/manifests/{number}.json"))
            try:
                return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
            except json.JSONDecodeError:
                continue
            finally:
                stream.close()
        return None

    def _write(self, path, text: str) -> None:
        out = self._fs.create(path, False)
        try:
            out.write(bytearray(text.encode()))
        finally:
            out.close()

    def _commit(self, manifest: dict) -> None:
        """Takes the manifest's name if no other writer has it; else raises and changes nothing.

        On a local file system a whole draft is linked to the name, which fails
        where the name exists. Elsewhere the file is created without overwriting,
        which HDFS and object stores decide in one step.
        """
        target = self._hpath(f"{self.path}/manifests/{manifest['number']}.json")
        text = json.dumps(manifest, sort_keys=True)
        jvm = self.spark._jvm
        try:
            if self._fs.getUri().getScheme() == "file":
                draft = self._hpath(f"{self.path}/manifests/.{uuid.uuid4().hex}.draft")
                self._write(draft, text)
                local = lambda p: jvm.java.io.File(p.toUri().getPath()).toPath()
                try:
                    jvm.java.nio.file.Files.createLink(local(target), local(draft))
                finally:
                    self._fs.delete(draft, False)
            else:
                self._write(target, text)
        except Py4JJavaError as e:
            if self._fs.exists(target):
                raise RuntimeError(f"manifest {manifest['number']} of {self.path} was committed by another writer") from e
            raise

    # data -----------------------------------------------------------------
    def _files(self, manifest: dict | None, only: set[int] | None = None) -> DataFrame:
        folders = [f"{self.path}/{f}" for b, f in sorted((manifest or {"files": {}})["files"].items()) if only is None or int(b) in only]
        if not folders:
            return self.spark.createDataFrame([], STATE)
        return self.spark.read.schema(STATE).parquet(*folders)

    def read(self) -> DataFrame:
        """The records that live now."""
        return self._files(self._manifest()).where("NOT deleted").drop("deleted")

    def apply(self, changes: DataFrame) -> list[int]:
        """Applies a batch; returns the buckets it rewrote (at most ``buckets`` numbers)."""
        old = self._manifest() or {"number": 0, "buckets": self.buckets, "files": {}}
        write = f"{old['number'] + 1}-{uuid.uuid4().hex[:12]}"
        bucket = F.pmod(F.xxhash64("external_id"), F.lit(self.buckets)).cast("int").alias("bucket")
        routed, data = f"{self.path}/routed/{write}", f"data/{write}"
        try:
            latest_changes(changes).select("*", bucket).write.parquet(routed)
            incoming = self.spark.read.schema(f"{STATE}, bucket int").parquet(routed)
            touched = {r.bucket for r in incoming.select("bucket").distinct().collect()}
            if not touched:
                return []
            held = {b for b in touched if str(b) in old["files"]}
            merged = incoming
            if held:
                base = self._files(old, held).select("*", bucket)
                merged = self._merge(base, incoming)
            (
                merged.repartition(len(touched), "bucket")
                .sortWithinPartitions("bucket", "external_id")
                .write.partitionBy("bucket").parquet(f"{self.path}/{data}")
            )
            files = old["files"] | {str(b): f"{data}/bucket={b}" for b in touched}
            try:
                self._commit({"number": old["number"] + 1, "buckets": self.buckets, "files": files})
            except RuntimeError:
                self._fs.delete(self._hpath(f"{self.path}/{data}"), True)  # this writer's own files, which no manifest names
                raise
        finally:
            self._fs.delete(self._hpath(routed), True)
        return sorted(touched)

    def apply_in_batches(self, changes: DataFrame, batches: int) -> None:
        """Applies a feed by ranges of change_id, in order of arrival: the first is the base of the others.

        The ranges are of equal width. A range without changes commits nothing;
        changes without change_id are none.
        """
        low, high = changes.agg(F.min("change_id"), F.max("change_id")).first()
        if low is None:
            return
        edges = [low + (high - low + 1) * k // batches for k in range(batches + 1)]
        for a, b in zip(edges, edges[1:], strict=False):
            if b > a:
                self.apply(changes.where(F.col("change_id").between(a, b - 1)))

    @staticmethod
    def _merge(base: DataFrame, incoming: DataFrame) -> DataFrame:
        """Sort-merge of both sides on (bucket, key); either has one row per key."""
        b, i = base.alias("b"), incoming.hint("merge").alias("i")
        both = b.join(i, ["bucket", "external_id"], "full")
        rank = lambda t: F.struct(F.col(f"{t}.version"), -F.col(f"{t}.change_id"))
        newer = F.col("b.version").isNull() | (F.col("i.version").isNotNull() & (rank("i") > rank("b")))
        pick = lambda c: F.when(newer, F.col(f"i.{c}")).otherwise(F.col(f"b.{c}")).alias(c)
        return both.select("external_id", *(pick(c) for c in ("version", "change_id", "deleted", "payload")), "bucket")
