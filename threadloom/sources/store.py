"""Models as folders of Parquet tables."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession

SUFFIX = ".model"
OPTIONS = "options"


def _fs(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def with_suffix(path: str) -> str:
    return path if path.endswith(SUFFIX) else path + SUFFIX


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, with_suffix(path))
    return fs.exists(p)


def save(tables: dict[str, DataFrame], path: str, overwrite: bool = False, options: dict | None = None) -> str:
    """Write every table and the options below ``path``; FileExistsError if it exists and isn't to be overwritten.

    Tables that were read from ``path`` itself must be loaded again afterwards.

    The tables are written beside it and put in its place at the end, so a failed
    save leaves what was there.
    """
    path = with_suffix(path)
    spark = next(iter(tables.values())).sparkSession
    fs, target = _fs(spark, path)
    if fs.exists(target) and not overwrite:
        raise FileExistsError(path)
    _, fresh = _fs(spark, path + ".new")
    fs.delete(fresh, True)
    for name, df in tables.items():
        df.write.parquet(f"{path}.new/{name}")
    spark.createDataFrame([(json.dumps(options or {}),)], "options string").coalesce(1).write.parquet(f"{path}.new/{OPTIONS}")
    fs.delete(target, True)
    fs.rename(fresh, target)
    return path


def load(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """All tables of a saved model; FileNotFoundError if there is none."""
    path = with_suffix(path)
    fs, p = _fs(spark, path)
    if not fs.exists(p):
        raise FileNotFoundError(path)
    return {s.getPath().getName(): spark.read.parquet(s.getPath().toString()) for s in fs.listStatus(p) if s.isDirectory() and s.getPath().getName() != OPTIONS}


def load_options(spark: SparkSession, path: str) -> dict:
    """The options that a model was saved with; none if there is no model."""
    fs, p = _fs(spark, f"{with_suffix(path)}/{OPTIONS}")
    return json.loads(spark.read.parquet(p.toString()).first()["options"]) if fs.exists(p) else {}


def open_model(spark: SparkSession, path: str, on_existing: str = "stop") -> dict[str, DataFrame]:
    """The tables at ``path``: none yet, or by ``on_existing`` an error (stop), none (overwrite) or what is there (reuse)."""
    if on_existing not in ("stop", "overwrite", "reuse"):
        raise ValueError(f"unknown on_existing: {on_existing}")
    if not exists(spark, path):
        return {}
    if on_existing == "stop":
        raise FileExistsError(with_suffix(path))
    if on_existing == "overwrite":
        fs, p = _fs(spark, with_suffix(path))
        fs.delete(p, True)
        return {}
    return load(spark, path)
