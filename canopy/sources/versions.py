"""Versioned folders: data files are written first, a small manifest that names them last, so readers see all of a version or none."""

from __future__ import annotations

import json
import re

from pyspark.sql import SparkSession

_NAME = re.compile(r"manifest-(\d{12})\.json$")


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def latest(spark: SparkSession, path: str, before: int | None = None) -> tuple[int, dict] | None:
    """(number, content) of the newest manifest in path, or of the newest with a number below before; None without any."""
    fs, p = _fs(spark, path)
    if not fs.exists(p):
        return None
    found = [(int(m.group(1)), f.getPath()) for f in fs.listStatus(p) if (m := _NAME.search(f.getPath().getName()))]
    found = [x for x in found if before is None or x[0] < before]
    if not found:
        return None
    number, file = max(found, key=lambda x: x[0])
    text = spark.read.text(file.toString(), wholetext=True).first()[0]
    return number, json.loads(text)


def publish(spark: SparkSession, path: str, number: int, content: dict) -> None:
    """Makes content version number of path: written aside, then renamed into place. The same number again replaces it."""
    fs, p = _fs(spark, path)
    fs.mkdirs(p)
    Path = spark._jvm.org.apache.hadoop.fs.Path
    aside, target = Path(p, f".manifest-{number:012d}.tmp"), Path(p, f"manifest-{number:012d}.json")
    out = fs.create(aside, True)
    try:
        out.write(bytearray(json.dumps(content, sort_keys=True).encode()))
    finally:
        out.close()
    if fs.exists(target):
        fs.delete(target, False)
    if not fs.rename(aside, target):
        raise OSError(f"could not publish {target.toString()}")


def has_files(spark: SparkSession, path: str, suffix: str) -> bool:
    """Whether path is a folder that holds a file with this ending."""
    fs, p = _fs(spark, path)
    return bool(fs.exists(p) and fs.getFileStatus(p).isDirectory() and any(f.getPath().getName().endswith(suffix) for f in fs.listStatus(p)))
