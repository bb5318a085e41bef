"""Published tables: attempts write folders of their own, a version file names those that count.

A write that fails, or is repeated, leaves an attempt that no version names. The version file comes last
and is created, never overwritten, so readers see all of a write or none, and one of two writers that
start from the same version fails.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession


def _file_system(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def names(spark: SparkSession, path: str) -> list[str]:
    """What a folder holds; nothing if it isn't there."""
    fs, at = _file_system(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(at)) if fs.exists(at) else []


def delete(spark: SparkSession, path: str) -> None:
    fs, at = _file_system(spark, path)
    fs.delete(at, True)


def latest(spark: SparkSession, root: str) -> tuple[int, dict]:
    """The last version's number (-1: none), and what the last one that can be read whole holds."""
    numbers = sorted((int(n) for n in names(spark, f"{root}/versions") if n.isdigit()), reverse=True)
    for number in numbers:
        try:
            lines = spark.read.text(f"{root}/versions/{number}").collect()
            return numbers[0], json.loads("".join(r["value"] for r in lines))
        except ValueError:
            continue
    return (numbers or [-1])[0], {}


def commit(spark: SparkSession, root: str, number: int, content: dict) -> None:
    """Writes version number; an error if it is there."""
    fs, at = _file_system(spark, f"{root}/versions/{number}")
    out = fs.create(at, False)
    out.write(bytearray(json.dumps(content).encode()))
    out.close()


def publish(df: DataFrame, root: str, write_id: str | None = None) -> None:
    """Append df's rows to the published table at root, once for each write_id: a write that was
    published under the same id already is left alone, so a caller may simply try again."""
    spark = df.sparkSession
    number, held = latest(spark, root)
    parts = held.get("parts", [])
    if write_id is not None and any(p["write"] == write_id for p in parts):
        return
    name = f"attempt-{uuid.uuid4().hex}"
    df.write.parquet(f"{root}/{name}")
    commit(spark, root, number + 1, {"parts": [*parts, {"name": name, "write": write_id}]})


def published(spark: SparkSession, root: str) -> DataFrame | None:
    """The rows of all writes that count; None before the first."""
    parts = latest(spark, root)[1].get("parts", [])
    out = None
    for p in parts:
        rows = spark.read.parquet(f"{root}/{p['name']}")
        out = rows if out is None else out.unionByName(rows, allowMissingColumns=True)
    return out


def clean(spark: SparkSession, root: str) -> int:
    """Delete attempts that the last version doesn't name; how many there were. Not while others write."""
    kept = {p["name"] for p in latest(spark, root)[1].get("parts", [])} | {"versions"}
    lost = [n for n in names(spark, root) if n not in kept]
    for n in lost:
        delete(spark, f"{root}/{n}")
    return len(lost)
