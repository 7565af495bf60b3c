"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import hashlib
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.errors import UnsupportedOperationException
from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir. Where the session names none, a local folder in local mode; RuntimeError on a cluster, whose machines don't share one."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        path = "file://" + tempfile.mkdtemp(prefix="shared-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


_scopes: list[list[str]] = []


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """What is parked inside is deleted at the end, so nothing that comes out may read it any more; write the result first."""
    _scopes.append([])
    try:
        yield
    finally:
        for path in _scopes.pop():
            delete(spark, path)


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing else uses; it ends with the scratch scope it was made in."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    if _scopes:
        _scopes[-1].append(path)
    return path


def park(df: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = path or new_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _file(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())


def write_text(spark: SparkSession, path: str, text: str, overwrite: bool = True) -> None:
    """A small file at a path. Without overwrite it fails where one is, so of two writers one wins."""
    at, fs = _file(spark, path)
    out = fs.create(at, overwrite)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def read_text(spark: SparkSession, path: str) -> str:
    """A small file's text; FileNotFoundError where there is none."""
    at, fs = _file(spark, path)
    if not fs.exists(at):
        raise FileNotFoundError(path)
    source = fs.open(at)
    try:
        return bytes(source.readAllBytes()).decode()
    finally:
        source.close()


def names(spark: SparkSession, path: str) -> list[str]:
    """Sorted names of what a folder holds; none where there is no folder."""
    at, fs = _file(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(at)) if fs.exists(at) else []


def join_files(spark: SparkSession, folder: str, path: str) -> None:
    """One file of the files of a folder in the order of their names; the folder goes.

    A file system that can (HDFS) only links the blocks together; elsewhere the bytes are copied one after another, in
    pieces, never as a whole.
    """
    hadoop = spark._jvm.org.apache.hadoop
    conf = spark._jsparkSession.sessionState().newHadoopConf()
    at, fs = _file(spark, path)
    parts = [hadoop.fs.Path(folder, n) for n in names(spark, folder) if n.startswith("part-")]
    fs.delete(at, False)
    try:
        fs.create(at).close()
        array = spark.sparkContext._gateway.new_array(hadoop.fs.Path, len(parts))
        for k, part in enumerate(parts):
            array[k] = part
        fs.concat(at, array)
    except UnsupportedOperationException:
        out = fs.create(at, True)
        try:
            for part in parts:
                source = fs.open(part)
                try:
                    hadoop.io.IOUtils.copyBytes(source, out, conf, False)
                finally:
                    source.close()
        finally:
            out.close()
    fs.delete(hadoop.fs.Path(folder), True)


def fingerprint(spark: SparkSession, paths: list[str]) -> str:
    """A digest of the files at some paths: names, sizes and times of change."""
    seen = []
    for path in paths:
        at, fs = _file(spark, path)
        files = fs.listStatus(at) if fs.exists(at) else []
        seen += [(path, s.getPath().getName(), s.getLen(), s.getModificationTime()) for s in files]
    return hashlib.sha256(repr(sorted(seen)).encode()).hexdigest()[:24]


def exists(spark: SparkSession, path: str) -> bool:
    at, fs = _file(spark, path)
    return fs.exists(at)


def delete(spark: SparkSession, path: str) -> None:
    """Remove what was written at a path; nothing happens where there is none."""
    at, fs = _file(spark, path)
    fs.delete(at, True)
