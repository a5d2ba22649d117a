"""Checksums of files and their verification."""

from __future__ import annotations

from collections.abc import Iterator
from fnmatch import fnmatchcase
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.runtime import ship
from corpusloom.sources.append_log import files_below, opened


def file_digests(spark: SparkSession, path: str, pattern: str = "*", chunk: int = 1 << 20) -> DataFrame:
    """(name, path, digest) of the files below a folder, or of one file, of any size: a task streams a file through SHA-256 in chunks.

    The driver lists the files, hidden ones aside, and deals their paths. In a store that Arrow doesn't know whole files pass through the JVM's SHA-256
    instead, which ends at 2 GB a file.
    """
    name = F.element_at(F.split("path", "/"), -1).alias("name")
    try:
        found = sorted(f for f in files_below(path) if fnmatchcase(f.rsplit("/", 1)[-1], pattern))
    except (ValueError, OSError, ImportError):
        files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path)
        return files.select(name, "path", F.sha2("content", 256).alias("digest"))
    ship(spark)

    def of_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = opened(path)
        for b in batches:
            for file in b.column("path").to_pylist():
                digest = sha256()
                with store.open_input_stream(file) as f:
                    while piece := f.read(chunk):
                        digest.update(piece)
                yield pa.RecordBatch.from_arrays([pa.array([file]), pa.array([digest.hexdigest()])], names=["path", "digest"])

    listed = spark.createDataFrame([(f,) for f in found], "path string").repartition("path")
    return listed.mapInArrow(of_batches, "path string, digest string").select(name, "path", "digest")


def manifest(expected: DataFrame, found: DataFrame) -> DataFrame:
    """(name, digest, status) for every expected name; a missing file is reported, not an error."""
    return expected.join(found.select("name", "digest"), "name", "left").withColumn("status", F.when(F.col("digest").isNull(), "missing").otherwise("ok"))


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """(name, expected) of the `hash  name` lines of a checksum file; other lines are left out."""
    lines = spark.read.text(path)
    parts = [F.regexp_extract("value", r"^([0-9a-fA-F]{64})\s+\*?(.+?)\s*$", k) for k in (1, 2)]
    return lines.select(parts[1].alias("name"), F.lower(parts[0]).alias("expected")).where("expected <> ''")


def verify(expected: DataFrame, found: DataFrame, key: str = "name") -> DataFrame:
    """(key, expected, status): ok, mismatch or missing. A mismatch is a row, never an exception."""
    joined = expected.join(found.select(key, "digest"), key, "left")
    status = F.when(F.col("digest").isNull(), "missing").when(F.col("digest") == F.col("expected"), "ok").otherwise("mismatch")
    return joined.select(key, "expected", status.alias("status"))
