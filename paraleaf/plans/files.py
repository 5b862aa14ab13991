"""Small files beside tables, on the file system that Spark writes to: the driver and the executors see the same folder."""

from __future__ import annotations

import hashlib

from pyspark.sql import SparkSession
from pyspark.sql import functions as F


def _at(path: str):
    spark = SparkSession.active()
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def exists(path: str) -> bool:
    fs, p = _at(path)
    return bool(fs.exists(p))


def write_text(path: str, text: str) -> None:
    """The file with that text; one that is there is replaced."""
    fs, p = _at(path)
    fs.setWriteChecksum(False)  # no hidden checksum file beside it on a local disk
    try:
        out = fs.create(p, True)
        try:
            out.write(bytearray(text.encode("utf-8")))
        finally:
            out.close()
    finally:
        fs.setWriteChecksum(True)


def read_text(path: str) -> str:
    fs, p = _at(path)
    stream = fs.open(p)
    try:
        return bytes(stream.readAllBytes()).decode("utf-8")
    finally:
        stream.close()


def rename(old: str, new: str) -> None:
    fs, p = _at(old)
    if not fs.rename(p, _at(new)[1]):
        raise OSError(f"could not rename {old} to {new}")


def remove(path: str) -> None:
    fs, p = _at(path)
    fs.delete(p, True)


def hashes(folder: str, without: tuple[str, ...] = ()) -> dict[str, dict]:
    """sha256 and bytes of every file below ``folder`` by its path inside, but for names in ``without`` and names that start with a dot or underscore.

    Files are hashed where the tasks run; only names, hashes and sizes come back.
    """
    fs, p = _at(folder)
    root = fs.makeQualified(p).toUri().getPath().rstrip("/") + "/"
    spark = SparkSession.active()
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path", F.sha2("content", 256).alias("sha256"), F.col("length").alias("bytes")).collect()
    out = {r["path"].partition(root)[2]: {"sha256": r["sha256"], "bytes": r["bytes"]} for r in rows}
    walk = fs.listFiles(p, True)  # Spark passes over empty files
    while walk.hasNext():
        f = walk.next()
        inside = f.getPath().toUri().getPath().partition(root)[2]
        if not f.getLen() and not any(part.startswith((".", "_")) for part in inside.split("/")):
            out[inside] = {"sha256": hashlib.sha256(b"").hexdigest(), "bytes": 0}
    return {k: out[k] for k in sorted(out) if k.rpartition("/")[2] not in without}
