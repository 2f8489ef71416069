"""Tables published by version: written aside, checked, and made current by one atomic rename of a pointer file."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_POINTER = "CURRENT"


class RefusedVersion(ValueError):
    """A version that failed its checks; the current one stays."""


def _files(spark: SparkSession, path: str):
    """The file context of a path's store, whatever store Spark reaches, and a maker of its paths."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop
    return hadoop.fs.FileContext.getFileContext(hadoop.fs.Path(path).toUri(), spark.sparkContext._jsc.hadoopConfiguration()), hadoop.fs


def current_version(spark: SparkSession, root: str) -> str | None:
    """The name of the current version; None before the first."""
    files, fs = _files(spark, root)
    if not files.util().exists(fs.Path(f"{root}/{_POINTER}")):
        return None
    return spark.read.text(f"{root}/{_POINTER}").first()[0]


def read_current(spark: SparkSession, root: str, table: str) -> DataFrame:
    """A table of the current version. A reader keeps that version's files, whatever is published meanwhile."""
    version = current_version(spark, root)
    if version is None:
        raise FileNotFoundError(f"nothing is published in {root}")
    return spark.read.parquet(f"{root}/{version}/{table}")


def publish(spark: SparkSession, root: str, tables: dict[str, DataFrame], keys: dict[str, list[str]] | None = None, faults: Callable[[dict[str, DataFrame]], DataFrame] | None = None) -> str:
    """Writes the tables as a new version, checks what was written, and makes it current; returns its name.

    Checks: each table has as many rows as its source; the key columns, if given, are not null and unique; and faults, a
    function of the written tables, gives no row. A version that fails stays unpublished, its files are removed, and
    RefusedVersion tells why. Before the rename readers see the old version, after it the new one, never parts of both.
    """
    version = f"v-{uuid.uuid4().hex}"
    files, fs = _files(spark, root)
    wrong, written = [], {}
    for name, df in tables.items():
        path = f"{root}/{version}/{name}"
        observed = F.count(F.lit(1)).alias("n")
        df.write.parquet(path)
        written[name] = spark.read.schema(df.schema).parquet(path)
        sent, there = df.agg(observed).first()["n"], written[name].count()
        if sent != there:
            wrong.append(f"{name}: {there} rows written of {sent}")
        key = (keys or {}).get(name)
        if key:
            missing = F.count_if(F.greatest(*[F.col(c).isNull().cast("int") for c in [*key, key[0]]]) == 1).alias("missing")
            blank = written[name].agg(missing).first()["missing"]
            twice = written[name].groupBy(*key).count().filter("count > 1").limit(1).count()
            wrong += [f"{name}: {blank} rows without a key"] if blank else []
            wrong += [f"{name}: a key occurs twice"] if twice else []
    if not wrong and faults is not None:
        wrong = [f"{r['gate']}: {r['n']}" for r in faults(written).groupBy("gate").agg(F.count("*").alias("n")).orderBy("gate").collect()]
    if wrong:
        files.delete(fs.Path(f"{root}/{version}"), True)
        raise RefusedVersion("; ".join(wrong))
    # One line in a file of its own, then renamed over the pointer in one step.
    aside = f"{root}/.next-{version}"
    spark.createDataFrame([(version,)], "name string").coalesce(1).write.text(aside)
    part = next(s.getPath() for s in files.util().listStatus(fs.Path(aside)) if s.getPath().getName().startswith("part-"))
    option = spark.sparkContext._gateway.new_array(fs.Options.Rename, 1)
    option[0] = fs.Options.Rename.OVERWRITE
    files.rename(part, fs.Path(f"{root}/{_POINTER}"), option)
    files.delete(fs.Path(aside), True)
    return version


def drop_old_versions(spark: SparkSession, root: str, keep: int = 2) -> int:
    """Removes the oldest versions but the current one and the newest `keep`; returns how many."""
    files, fs = _files(spark, root)
    now = current_version(spark, root)
    found = sorted(((s.getModificationTime(), s.getPath()) for s in files.util().listStatus(fs.Path(root)) if s.isDirectory() and s.getPath().getName().startswith("v-")), key=lambda x: -x[0])
    gone = [p for _, p in found[keep:] if p.getName() != now]
    for p in gone:
        files.delete(p, True)
    return len(gone)
