"""Intermediate tables in the cluster's shared folder (``spark.checkpoint.dir``)."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from sheetlens.session import ensure_checkpoint_dir

_WRITTEN: list[str] = []


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: cuts the lineage, so every
    reader sees the same rows whatever the optimizer reuses, and a lost executor
    costs no recomputation.  :func:`drop` or :func:`clean_scratch` removes it."""
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/sheetlens-{uuid.uuid4().hex}-{name}"
    df.write.parquet(path)
    _WRITTEN.append(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._sheetlens_path = path
    return out


def scratch_folder(spark: SparkSession, what: str) -> str:
    """A fresh folder under the session's shared checkpoint folder."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{what}-{uuid.uuid4().hex}"


def delete_folder(spark: SparkSession, path: str) -> None:
    """Delete a scratch folder whose rows are stored elsewhere.  Hadoop's file system takes seconds more for each
    100,000 files of a local folder."""
    from sheetlens.sources.files import resolve_filesystem

    try:
        filesystem, base = resolve_filesystem(path)
        filesystem.delete_dir(base)
    except (ImportError, OSError, ValueError):
        _delete(spark, path)


def _delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def drop(df: DataFrame) -> None:
    """Delete a table made by :func:`written` that no result reads any more."""
    path = getattr(df, "_sheetlens_path", None)
    if path in _WRITTEN:
        _WRITTEN.remove(path)
        _delete(df.sparkSession, path)


def clean_scratch(spark: SparkSession) -> None:
    """Delete every table :func:`written` still holds (call when the job's results are stored)."""
    while _WRITTEN:
        _delete(spark, _WRITTEN.pop())
