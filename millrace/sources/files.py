"""File sources and sinks: CSV with a byte-order mark, JSON lines, SQL dumps, text expositions, ZIP bundles."""

from __future__ import annotations

import io
import posixpath
import tempfile
import uuid
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def work_path(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder of spark.checkpoint.dir (a local session without it gets a temporary one)."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="millrace-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/millrace-{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex}"


def written(df: DataFrame, label: str) -> DataFrame:
    """df as a table in the shared folder, read back: cuts lineage, survives lost executors."""
    path = work_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def read_csv(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """CSV with a header; a byte-order mark does not matter, as columns come from the schema; broken rows get nulls."""
    return spark.read.schema(schema).option("header", True).option("enforceSchema", True).option("mode", "PERMISSIVE").csv(path)


def write_csv_report(df: DataFrame, path: str) -> None:
    """Few rows as one CSV file with a header, in UTF-8 with a byte-order mark and CR LF line ends.

    Spark's text sink writes the lines; a field with a comma, quote or line end is quoted.
    """
    quoted = lambda c: F.when(c.rlike('[",\r\n]'), F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(c)
    line = F.concat_ws(",", *[F.coalesce(quoted(F.col(f"`{c}`").cast("string")), F.lit("")) for c in df.columns])
    head = df.sparkSession.range(1).select(F.lit("\ufeff" + ",".join(df.columns)).alias("value"))
    head.unionByName(df.select(line.alias("value"))).coalesce(1).write.option("lineSep", "\r\n").text(path)


def json_lines(df: DataFrame, path: str) -> None:
    df.write.json(path)


def read_json_lines(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def read_sql_dump(spark: SparkSession, path: str, table: str) -> DataFrame:
    """Pairs of texts of `INSERT INTO table ... VALUES ('a','b')` lines, doubled quotes undone: first, second."""
    found = F.regexp_extract_all("value", F.lit(r"\('((?:[^']|'')*)','((?:[^']|'')*)'\)"), 0)
    rows = spark.read.text(path).filter(F.col("value").startswith(f"INSERT INTO {table} ")).select(F.explode(found).alias("row"))
    part = lambda i: F.replace(F.regexp_extract("row", r"^\('((?:[^']|'')*)','((?:[^']|'')*)'\)$", i), F.lit("''"), F.lit("'"))
    return rows.select(part(1).alias("first"), part(2).alias("second"))


def sql_dump_lines(df: DataFrame, table: str, a: str, b: str) -> DataFrame:
    quoted = lambda c: F.concat(F.lit("'"), F.replace(F.col(c), F.lit("'"), F.lit("''")), F.lit("'"))
    return df.select(F.concat(F.lit(f"INSERT INTO {table} VALUES ("), quoted(a), F.lit(","), quoted(b), F.lit(");")).alias("value"))


def exposition_lines(df: DataFrame, metric: str, labels: list[str], value: str, about: str, kind: str) -> DataFrame:
    """Text exposition: help and type of the metric once, then samples with labels sorted by name and escaped, values of up to four decimals."""

    def escaped(k: str) -> Column:
        c = F.coalesce(F.col(k).cast("string"), F.lit(""))
        for plain, written_ in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n")):
            c = F.replace(c, F.lit(plain), F.lit(written_))
        return F.concat(F.lit(f'{k}="'), c, F.lit('"'))

    head = df.sparkSession.range(1).select(F.explode(F.array(F.lit(f"# HELP {metric} {about}"), F.lit(f"# TYPE {metric} {kind}"))).alias("value"))
    return head.unionByName(df.select(F.concat(F.lit(metric + "{"), F.concat_ws(",", *map(escaped, sorted(labels))), F.lit("} "), F.round(F.col(value).cast("double"), 4).cast("decimal(30,4)").cast("string")).alias("value")))


def first_by_basename(files: DataFrame, path: Column | str) -> DataFrame:
    """Files indexed by base name; of equal names the smallest path."""
    base = F.element_at(F.split("path", "/"), -1)
    n = F.row_number().over(Window.partitionBy("basename").orderBy("path"))
    return files.select(F.col(path).alias("path")).withColumn("basename", base).withColumn("_n", n).filter("_n = 1").drop("_n")


def read_zip_bundles(spark: SparkSession, path: str, most_bytes: int = 1 << 28) -> DataFrame:
    """Members of the ZIP files at path: bundle, top (the inner top folder), member, size, content of members up to most_bytes."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for name, data in zip(pdf["path"], pdf["content"]):
                with zipfile.ZipFile(io.BytesIO(data)) as z:
                    rows = [(posixpath.basename(name), i.filename.split("/")[0], i.filename, i.file_size, z.read(i) if i.file_size <= most_bytes else None) for i in z.infolist() if not i.is_dir()]
                yield pd.DataFrame(rows, columns=["bundle", "top", "member", "size", "content"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "bundle string, top string, member string, size long, content binary")


def table_counts(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """Checks a copy: rows and largest key of both sides, and whether they agree."""
    side = lambda df, s: df.agg(F.count("*").alias(f"rows_{s}"), F.max(key).alias(f"max_{s}")).withColumn("k", F.lit(1))
    return side(before, "before").join(side(after, "after"), "k").drop("k").withColumn("same", F.expr("rows_before = rows_after and max_before <=> max_after"))


def caught_up(source: DataFrame, path: str, key: str) -> DataFrame:
    """Appends to the copy at path the rows of source above the copy's high-water mark (its largest key); a first call copies all.

    Returns mark (before; null at first), copied, rows_source, max_source, rows_copy, max_copy and same, which holds if
    the copy now has as many rows and the same largest key. Keys grow: rows below the mark that came later are not seen but
    leave same false. A source that is read twice must not change between.
    """
    spark = source.sparkSession
    try:
        mark = spark.read.schema(source.schema).parquet(path).agg(F.max(key)).first()[0]
    except AnalysisException:
        mark = None
    new = source if mark is None else source.filter(F.col(key) > F.lit(mark))
    n = new.count()
    new.write.mode("append").parquet(path)
    a = source.agg(F.count("*").alias("rows_source"), F.max(key).alias("max_source"))
    b = spark.read.schema(source.schema).parquet(path).agg(F.count("*").alias("rows_copy"), F.max(key).alias("max_copy"))
    both = a.withColumn("_one", F.lit(1)).join(b.withColumn("_one", F.lit(1)), "_one").drop("_one")
    same = (F.col("rows_source") == F.col("rows_copy")) & F.col("max_source").eqNullSafe(F.col("max_copy"))
    return both.select(F.lit(mark).cast(source.schema[key].dataType).alias("mark"), F.lit(n).cast("long").alias("copied"), "*", same.alias("same"))
