"""Intermediate results that survive the loss of an executor.

``materialize`` writes a DataFrame as Parquet under the folder that the
cluster names in ``spark.checkpoint.dir`` and reads it back: the lineage is
cut, later passes scan columns instead of recomputing, and nothing depends on
an executor's local disk.
"""

from __future__ import annotations

import atexit
import json
import re
import tempfile
import uuid
from typing import Any

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession

_written: dict[str, tuple[SparkSession, str]] = {}


class Conflict(RuntimeError):
    """What a writer has built on is no more."""


class Published(Conflict):
    """Another writer has published the same version."""


def shared_dir(spark: SparkSession) -> str:
    """The shared folder of the session.

    Where it is unset, a local master (all processes on this machine) gets a
    temporary one. On a cluster that is an error: each machine would write to a disk of its own, and what is
    read back would be a part of the result.
    """
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        set_already = spark.sparkContext._jsc.sc().getCheckpointDir()
        if set_already.isDefined():
            at = set_already.get()
        elif re.fullmatch(r"local(-cluster)?(\[.*\])?", spark.sparkContext.master):
            at = "file://" + tempfile.mkdtemp(prefix="facetcube-")
        else:
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


def delete(spark: SparkSession, path: str) -> None:
    """Remove a folder through Hadoop's file system API, so that any scheme works."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def scratch(spark: SparkSession, label: str) -> str:
    """A new path below the shared folder, removed when the driver ends."""
    path = f"{shared_dir(spark)}/facetcube/{label}-{uuid.uuid4().hex}"
    if not _written:
        atexit.register(cleanup)
    _written[path] = (spark, path)
    return path


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and return a scan of it."""
    spark = df.sparkSession
    path = scratch(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def cleanup() -> None:
    """Delete everything that ``materialize`` wrote."""
    for spark, path in list(_written.values()):
        try:
            delete(spark, path)
        except Exception:  # noqa: BLE001 - the session may be gone already
            pass
    _written.clear()


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return fs.exists(p)


def names(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder, sorted; none if it does not exist."""
    fs, p = _fs(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []


def folders(spark: SparkSession, path: str, older_than: float) -> list[str]:
    """Names of the folders in a folder that have not changed since a time (seconds)."""
    fs, p = _fs(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(p) if s.isDirectory() and s.getModificationTime() < older_than * 1000) if fs.exists(p) else []


def read_text(spark: SparkSession, path: str) -> str | None:
    fs, p = _fs(spark, path)
    if not fs.exists(p):
        return None
    stream = fs.open(p)
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """Replace a small file: written beside it first, so that a reader never sees half of it."""
    fs, p = _fs(spark, path)
    beside = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex}")
    stream = fs.create(beside, True)
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()
    if fs.exists(p):
        fs.delete(p, False)
    fs.rename(beside, p)


#: Published versions that are kept.
KEPT = 10


def published(spark: SparkSession, folder: str, stem: str) -> tuple[int, Any]:
    """The newest published version of a small document and its number; (0, None) if there is none."""
    pattern = re.compile(re.escape(stem) + r"-(\d+)\.json")
    for n in sorted((int(m[1]) for x in names(spark, folder) if (m := pattern.fullmatch(x))), reverse=True):
        try:
            return n, json.loads(read_text(spark, f"{folder}/{stem}-{n:08d}.json") or "")
        except json.JSONDecodeError:  # its writer is not through, or died: the version before it counts
            continue
    return 0, None


def publish(spark: SparkSession, folder: str, stem: str, n: int, document: Any) -> None:
    """Publish version ``n``, which follows the one that was read. Readers see the old version or the new one, never none.

    The file is created only if it is absent: of two writers that followed the
    same version one gets ``Published``.
    """
    path = f"{folder}/{stem}-{n:08d}.json"
    fs, p = _fs(spark, path)
    if fs.exists(p) and published(spark, folder, stem)[0] < n:  # half a file of a writer that died
        fs.delete(p, False)
    try:
        stream = fs.create(p, False)
    except Py4JJavaError as e:
        raise Published(path) from e
    try:
        stream.write(bytearray(json.dumps(document, indent=1, sort_keys=True).encode()))
    finally:
        stream.close()
    if n > KEPT:
        delete(spark, f"{folder}/{stem}-{n - KEPT:08d}.json")
