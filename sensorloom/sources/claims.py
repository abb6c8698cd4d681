"""Extraction by several runs at once (S10, S14): claims with a lease, and a commit that only one run can make.

Files are dealt to buckets by a hash of their path. A run claims a bucket by creating ``claims/<bucket>-<generation>``, which
succeeds for one run only, writes its rows and the list of its files to a folder of its own, and commits a bucket by creating
``records/<bucket>-<generation>``. Readers look at folders that a record names, so the record publishes the rows.

A run that is lost leaves a claim without a record. When its lease has ended, another run creates that record itself, marked void,
and claims the next generation. Whichever of the two creates the record first wins: either the old run's rows are
published and its files are done, or its commit fails and its rows are never read. So no file is published twice, even if a run
that seemed lost goes on.

The folder has to be on a file system that creates files exclusively (HDFS, or an object store with conditional writes).
Markers are a few per bucket and run; the driver handles these only, never rows.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable, Sequence
from typing import NamedTuple

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession, functions as F

from sensorloom.operators.lookup import join_lookup
from sensorloom.session import materialise

BUCKETS = 64
LEASE_SECONDS = 6 * 3600


class Markers:
    """Small files below a folder, made once."""

    def __init__(self, spark: SparkSession, folder: str):
        self.jvm, self.folder = spark.sparkContext._jvm, folder
        self.hadoop = spark.sparkContext._jsc.hadoopConfiguration()
        self.system = self.path("").getFileSystem(self.hadoop)

    def path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}" if name else self.folder)

    def create(self, name: str, content: dict) -> bool:
        """False if it exists already."""
        try:
            out = self.system.create(self.path(name), False)
        except Py4JJavaError as problem:
            if "FileAlreadyExists" in problem.java_exception.getClass().getName() or self.system.exists(self.path(name)):
                return False
            raise
        out.write(bytearray(json.dumps(content).encode()))
        out.close()
        return True

    def read(self, name: str) -> dict:
        """Empty while the marker is being written."""
        stream = self.system.open(self.path(name))
        try:
            text = bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()
        return json.loads(text) if text else {}

    def names(self, folder: str) -> list[str]:
        if not self.system.exists(self.path(folder)):
            return []
        return [x.getPath().getName() for x in self.system.listStatus(self.path(folder)) if not x.getPath().getName().startswith(".")]


class Claim(NamedTuple):
    bucket: int
    generation: int

    @property
    def name(self) -> str:
        return f"{self.bucket}-{self.generation}"


def _parsed(names: Sequence[str]) -> dict[int, int]:
    """Latest generation of every bucket."""
    out: dict[int, int] = {}
    for name in names:
        bucket, generation = map(int, name.split("-"))
        out[bucket] = max(out.get(bucket, 0), generation)
    return out


def claim_buckets(markers: Markers, run: str, buckets: Sequence[int], lease_seconds: float = LEASE_SECONDS, now: Callable[[], float] = time.time) -> list[Claim]:
    """Those of the buckets that this run gets: free ones, and ones whose holder's lease has ended."""
    latest, closed, got = _parsed(markers.names("claims")), set(markers.names("records")), []
    for bucket in buckets:
        last = Claim(bucket, latest.get(bucket, 0))
        if last.generation and last.name not in closed:
            held = markers.read(f"claims/{last.name}")
            if not held or held["until"] > now():
                continue
            # Either the holder commits first, or it never can.
            markers.create(f"records/{last.name}", {"void": run})
        claim = Claim(bucket, last.generation + 1)
        if markers.create(f"claims/{claim.name}", {"run": run, "until": now() + lease_seconds}):
            got.append(claim)
    return got


def committed_folders(markers: Markers) -> list[str]:
    """<run>/bucket=<n> of every published bucket."""
    out = []
    for name in markers.names("records"):
        record = markers.read(f"records/{name}")
        if "run" in record:
            out.append(f"{record['run']}/bucket={name.split('-')[0]}")
    return sorted(out)


def _published(spark: SparkSession, target: str, kind: str, markers: Markers) -> DataFrame | None:
    folders = [f"{target}/{kind}/{f}" for f in committed_folders(markers)]
    folders = [f for f in folders if markers.system.exists(markers.jvm.org.apache.hadoop.fs.Path(f))]  # a bucket may have no rows
    return spark.read.parquet(*folders) if folders else None


def read_extracted(spark: SparkSession, target: str) -> DataFrame | None:
    """All published rows; None before the first commit."""
    return _published(spark, target, "rows", Markers(spark, target))


def files_done(spark: SparkSession, target: str) -> DataFrame | None:
    return _published(spark, target, "files", Markers(spark, target))


class Extraction:
    """One run: ``claim``, ``write``, ``commit``, in this order; each step may be the last one of a run that is lost."""

    def __init__(self, spark: SparkSession, catalog: DataFrame, target: str, buckets: int = BUCKETS, lease_seconds: float = LEASE_SECONDS,
                 now: Callable[[], float] = time.time):
        self.spark, self.target, self.run = spark, target, uuid.uuid4().hex
        self.markers, self.lease_seconds, self.now = Markers(spark, target), lease_seconds, now
        self.catalog = catalog.withColumn("_bucket", F.pmod(F.xxhash64("file_path"), F.lit(buckets)).cast("int"))
        self.claims: list[Claim] = []
        self.todo: DataFrame | None = None

    def pending(self) -> DataFrame:
        done = files_done(self.spark, self.target)
        return self.catalog if done is None else self.catalog.join(done.select("file_path"), "file_path", "left_anti")

    def claim(self) -> int:
        """Claims buckets with pending files; returns the number of files to extract."""
        wanted = [r["_bucket"] for r in self.pending().select("_bucket").distinct().collect()]  # at most as many as buckets
        self.claims = claim_buckets(self.markers, self.run, sorted(wanted), self.lease_seconds, self.now)
        # Looked up again: a bucket may have been committed before it was claimed.
        self.todo = materialise(self.pending().filter(F.col("_bucket").isin([c.bucket for c in self.claims])))
        return self.todo.count()

    def write(self, extract: Callable[[DataFrame], DataFrame]) -> None:
        """Writes rows and files of the claimed buckets to the folders of this run.

        The extracted rows have a column ``file_path``. Files with a row whose column ``error`` is set are not done; their rows are left out.
        """
        rows, done = extract(self.todo.drop("_bucket")), self.todo.select("file_path", "_bucket")
        if "error" in rows.columns:
            rows = materialise(rows)
            broken = rows.filter(F.col("error").isNotNull()).select("file_path").distinct()
            done = materialise(done.join(broken, "file_path", "left_anti"))
            rows = rows.join(broken, "file_path", "left_anti").drop("error")
        # Measured and broadcast or salted: a plain join would bring all rows of a file to one task.
        placed = join_lookup(rows, self.todo.select("file_path", F.col("_bucket").alias("bucket")), ["file_path"])
        placed.write.partitionBy("bucket").parquet(f"{self.target}/rows/{self.run}")
        done.withColumnRenamed("_bucket", "bucket").write.partitionBy("bucket").parquet(f"{self.target}/files/{self.run}")

    def commit(self) -> list[int]:
        """Publishes the buckets that are still this run's; returns them."""
        return [c.bucket for c in self.claims if self.markers.create(f"records/{c.name}", {"run": self.run})]


def extract_claimed(
    spark: SparkSession, catalog: DataFrame, target: str, extract: Callable[[DataFrame], DataFrame], buckets: int = BUCKETS,
    lease_seconds: float = LEASE_SECONDS, now: Callable[[], float] = time.time,
) -> int:
    """Extracts the files that are neither done nor claimed by another run; returns how many this run has published."""
    run = Extraction(spark, catalog, target, buckets, lease_seconds, now)
    if not run.claim():
        run.commit()  # gives the buckets back
        return 0
    run.write(extract)
    mine = run.commit()
    done = f"{target}/files/{run.run}"
    if not mine or not run.markers.system.exists(run.markers.path(f"files/{run.run}/_SUCCESS")):
        return 0
    files = spark.read.schema("file_path string, bucket int").parquet(done)
    return files.filter(F.col("bucket").isin(mine)).count()
