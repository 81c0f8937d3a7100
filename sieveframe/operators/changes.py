"""Change detection between snapshots of a tree."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def diff(current: DataFrame, previous: DataFrame) -> DataFrame:
    """current(file_path, content_hash) against previous: file_path, change_type added, modified or removed."""
    c = current.select("file_path", F.col("content_hash").alias("now"))
    p = previous.select("file_path", F.col("content_hash").alias("was"))
    kind = F.when(F.col("was").isNull(), F.lit("added")).when(F.col("now").isNull(), F.lit("removed")).when(F.col("now") != F.col("was"), F.lit("modified"))
    return c.join(p, "file_path", "full_outer").select("file_path", kind.alias("change_type")).where("change_type is not null")


def scope(changes: DataFrame, files: DataFrame) -> DataFrame:
    """Without any change the scan is a full one."""
    changed = changes.where("change_type in ('added', 'modified')").select("file_path")
    return files.select("file_path").distinct() if changed.isEmpty() else changed
