"""Numbered versions in a folder, each published by one rename: a reader sees a whole version or the one before.

There is one writer at a time; a second one that publishes the same number gets an error and its version is not seen.
"""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession

from loomline.operators.stored import delete


def _system(spark: SparkSession, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()), target


def names(spark: SparkSession, path: str) -> list[str]:
    """What a folder holds; nothing if it is not there."""
    system, target = _system(spark, path)
    return sorted(x.getPath().getName() for x in system.listStatus(target)) if system.exists(target) else []


def numbers(spark: SparkSession, path: str) -> list[int]:
    """The versions that are published, ascending."""
    return [int(n) for n in names(spark, path) if n.isdigit()]


def place(path: str, number: int) -> str:
    return f"{path}/{number:010d}"


def draft(path: str) -> str:
    """Where a version is written before it is published."""
    return f"{path}/_draft-{uuid.uuid4().hex}"


def publish(spark: SparkSession, written: str, path: str, number: int) -> None:
    system, target = _system(spark, place(path, number))
    source = spark._jvm.org.apache.hadoop.fs.Path(written)
    if system.exists(target) or not system.rename(source, target):
        delete(spark, written)
        raise FileExistsError(f"version {number} of {path} is published already")


def drop_old(spark: SparkSession, path: str, keep: int) -> list[int]:
    """Deletes all but the newest ``keep`` versions, and drafts that were never published; gives the versions that are left."""
    there = numbers(spark, path)
    for n in there[:-keep]:
        delete(spark, place(path, n))
    for name in names(spark, path):
        if name.startswith("_draft-"):
            delete(spark, f"{path}/{name}")
    return there[-keep:]
