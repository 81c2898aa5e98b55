"""A table of the last row of each key that several writers may change at once.

Rows lie in buckets by a hash of the key. A version of the table is a manifest: which folders hold rows of which bucket, in
the order in which they were added. A writer first stages its rows as Parquet in a folder of their own, then puts the next
manifest in place, which only one writer can do; the others take up that version and try again, without staging anew. So
a reader sees all of a write or nothing of it, and a job that dies leaves only a folder that no manifest names.

Later folders go before earlier ones in a key, and within a folder the row with the highest order. Compaction puts the
folders of a bucket together. The path must be on a file system whose rename fails where the target exists (HDFS), or local.
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

BUCKETS = 16
#: A bucket with more folders than this is due for compaction.
FOLDERS = 8


@dataclass
class Manifest:
    """version; files: by bucket the (folder, version that added it) in order; done: by writer its last batch; schema as JSON."""

    version: int = 0
    files: dict[int, list[tuple[str, int]]] = field(default_factory=dict)
    done: dict[str, int] = field(default_factory=dict)
    schema: str | None = None

    def text(self) -> str:
        return json.dumps({"version": self.version, "files": self.files, "done": self.done, "schema": self.schema})

    @staticmethod
    def of(text: str) -> Manifest:
        d = json.loads(text)
        return Manifest(d["version"], {int(b): [tuple(f) for f in fs] for b, fs in d["files"].items()}, d["done"], d["schema"])


class Upserts:
    """The table at path, of rows with the columns key and, if given, order."""

    def __init__(self, spark: SparkSession, path: str, key: str, order: str | None = None, buckets: int = BUCKETS) -> None:
        self.spark, self.path, self.key, self.order, self.buckets = spark, path.rstrip("/"), key, order, buckets
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self.files = self._path(f"{self.path}/manifests").getFileSystem(spark._jsc.hadoopConfiguration())

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int")

    def manifest(self) -> Manifest:
        """The newest version."""
        at = self._path(f"{self.path}/manifests")
        if not self.files.exists(at):
            return Manifest()
        names = [s.getPath().getName() for s in self.files.listStatus(at)]
        newest = max((n for n in names if n.endswith(".json") and not n.startswith(".")), default=None)
        return Manifest.of(self._read(f"{self.path}/manifests/{newest}")) if newest else Manifest()

    def _read(self, path: str) -> str:
        return "\n".join(r["value"] for r in self.spark.read.text(path, wholetext=True).collect())

    def _put(self, m: Manifest) -> bool:
        """Whether this manifest has become the version of its number."""
        folder = f"{self.path}/manifests"
        self.files.mkdirs(self._path(folder))
        target, staged = self._path(f"{folder}/{m.version:012d}.json"), self._path(f"{folder}/.{uuid.uuid4().hex}")
        out = self.files.create(staged, False)
        out.write(bytearray(m.text().encode()))
        out.close()
        if self.files.getUri().getScheme() == "file":  # a local rename would overwrite; a link doesn't
            try:
                os.link(staged.toUri().getPath(), target.toUri().getPath())
            except FileExistsError:
                return False
            finally:
                self.files.delete(staged, False)
            return True
        if self.files.exists(target) or not self.files.rename(staged, target):
            self.files.delete(staged, False)
            return False
        return True

    def _commit(self, change: Callable[[Manifest], Manifest | None]) -> Manifest:
        """The version that change makes of the newest one, tried again while other writers are faster; None: nothing to do."""
        while True:
            m = self.manifest()
            base = m.version
            if change(m) is None:
                return m
            m.version = base + 1
            if self._put(m):
                return m

    def _stage(self, rows: DataFrame) -> tuple[str, list[int]]:
        """The rows in a folder of their own, and the buckets that they are in."""
        folder = f"{self.path}/rows/{uuid.uuid4().hex}"
        rows.withColumn("bucket", self.bucket()).repartition("bucket").write.partitionBy("bucket").parquet(folder)
        names = [s.getPath().getName() for s in self.files.listStatus(self._path(folder)) if s.isDirectory()]
        return folder.removeprefix(f"{self.path}/"), sorted(int(n.removeprefix("bucket=")) for n in names if n.startswith("bucket="))

    def write(self, rows: DataFrame, writer: str | None = None, batch: int | None = None) -> None:
        """Add rows, one for each key at most is kept. A batch number that the writer has written already is passed over."""
        if writer is not None and self.manifest().done.get(writer, -1) >= batch:
            return
        rows = self._last(rows)
        folder, used = self._stage(rows)

        def add(m: Manifest) -> Manifest | None:
            if writer is not None:
                if m.done.get(writer, -1) >= batch:
                    return None
                m.done[writer] = batch
            for b in used:
                m.files.setdefault(b, []).append((folder, m.version + 1))
            m.schema = rows.schema.json()
            return m

        self._commit(add)

    def _last(self, rows: DataFrame) -> DataFrame:
        """The row of each key with the highest order, of equal ones that of the later version, then the one with the greatest values."""
        others = [c for c in rows.columns if c not in (self.key, "_version")]
        if not others:
            return rows.select(self.key).distinct()
        by = [c for c in (self.order, "_version") if c in rows.columns]
        best = F.max_by(F.struct(*others), F.struct(*by, *(c for c in others if c not in by)))
        return rows.groupBy(self.key).agg(best.alias("_row")).select(*(F.col(self.key) if c == self.key else F.col("_row")[c].alias(c) for c in rows.columns if c != "_version"))

    def _rows(self, m: Manifest, buckets: list[int]) -> DataFrame | None:
        """All rows of the buckets, with the version that added them: only the folders of these buckets are read."""
        by_folder: dict[tuple[str, int], list[int]] = {}
        for b in buckets:
            for f in m.files.get(b, []):
                by_folder.setdefault(f, []).append(b)
        out = None
        for (folder, version), own in sorted(by_folder.items(), key=lambda x: x[0][1]):
            paths = [f"{self.path}/{folder}/bucket={b}" for b in own]
            part = self.spark.read.schema(StructType.fromJson(json.loads(m.schema))).parquet(*paths).withColumn("_version", F.lit(version))
            out = part if out is None else out.unionByName(part, allowMissingColumns=True)
        return out

    def read(self, keys: DataFrame | None = None) -> DataFrame | None:
        """The last row of each key, or of the keys given (a column of the key's name); None before the first write."""
        m = self.manifest()
        if m.schema is None:
            return None
        buckets = sorted(m.files)
        if keys is not None:
            buckets = sorted(r["b"] for r in keys.select(self.bucket().alias("b")).distinct().collect())  # so many buckets at most
        rows = self._rows(m, buckets)
        if rows is None:
            return self.spark.createDataFrame([], StructType.fromJson(json.loads(m.schema)))
        last = self._last(rows)
        return last if keys is None else last.join(keys.select(self.key).distinct(), self.key, "left_semi")

    def compact(self, most: int = FOLDERS) -> int:
        """Put the folders of each bucket with more than `most` of them together; how many buckets that were."""
        m = self.manifest()
        due = {b: list(fs) for b, fs in m.files.items() if len(fs) > most}
        if not due:
            return 0
        rows = self._rows(m, sorted(due))
        folder, _ = self._stage(self._last(rows))

        def replace(new: Manifest) -> Manifest | None:
            if any(new.files.get(b, [])[: len(fs)] != fs for b, fs in due.items()):
                return None  # someone else has compacted them meanwhile
            for b, fs in due.items():
                new.files[b] = [(folder, fs[-1][1]), *new.files[b][len(fs) :]]
            return new

        self._commit(replace)
        return len(due)
