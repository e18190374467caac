"""Readers and writers of the corpus formats, with the checks that go with them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from quern.operators.corpus import assert_unique


def read_jsonl_strict(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """Fails on a line that is no record; blank lines are no lines."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def read_jsonl_lenient(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """(good records, (bad_lines) count). The schema is a DDL string."""
    raw = spark.read.schema(f"{schema}, _corrupt string").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt").json(path)
    # the corrupt column may not be read alone: the lines are parsed again for the count
    lines = spark.read.text(path).where(F.trim("value") != "")
    bad = lines.agg(F.count_if(F.try_parse_json("value").isNull()).alias("bad_lines"))
    return raw.where("_corrupt is null").drop("_corrupt"), bad


def write_jsonl(df: DataFrame, path: str, append: bool = False) -> None:
    """Non-ASCII characters stay as they are."""
    df.write.mode("append" if append else "overwrite").json(path)


def read_stats_csv(spark: SparkSession, path: str, key: str, numbers: dict[str, str]) -> DataFrame:
    """Text columns, with the named ones as numbers (what is no number counts 0); the key must be unique."""
    df = spark.read.option("header", True).option("encoding", "UTF-8").csv(path)
    first = df.columns[0]
    if first.startswith("﻿"):
        df = df.withColumnRenamed(first, first[1:])
    cast = {c: F.coalesce(F.col(c).try_cast(kind), F.lit(0).cast(kind)) for c, kind in numbers.items()}
    return assert_unique(df.withColumns(cast), key)


def write_csv(df: DataFrame, path: str, fields: list[str]) -> None:
    """A header and the fields in this order."""
    df.select(*fields).write.mode("overwrite").option("header", True).csv(path)


def write_summary(df: DataFrame, path: str) -> None:
    """One object of metrics."""
    df.select(F.to_json(F.struct("*")).alias("value")).coalesce(1).write.mode("overwrite").text(path)


def read_json_documents(spark: SparkSession, path: str) -> DataFrame:
    """(path, sha256, body, ok) of every file in a folder; a file that is no JSON is a row with ok = false."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    body = F.decode("content", "UTF-8")
    return files.select("path", F.sha2("content", 256).alias("sha256"), body.alias("body"), F.try_parse_json(body).isNotNull().alias("ok"))


def file_hashes(spark: SparkSession, path: str) -> DataFrame:
    """S17"""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", F.sha2("content", 256).alias("sha256"))


def folder_inventory(spark: SparkSession, path: str) -> DataFrame:
    """Per suffix the files and bytes; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "length")
    suffix = F.coalesce(F.nullif(F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1)), F.lit("")), F.lit("none"))
    return files.groupBy(suffix.alias("suffix")).agg(F.count(F.lit(1)).alias("files"), F.sum("length").alias("bytes"))


_BY_SUFFIX = {
    "csv": lambda r, p: r.option("header", True).csv(p),
    "tsv": lambda r, p: r.option("header", True).option("sep", "\t").csv(p),
    "jsonl": lambda r, p: r.json(p),
    "json": lambda r, p: r.option("multiLine", True).json(p),
    "parquet": lambda r, p: r.parquet(p),
    "txt": lambda r, p: r.text(p),
}


def inspect(spark: SparkSession, path: str, rows: int = 5) -> tuple[str, DataFrame]:
    """(schema, first rows) by suffix."""
    suffix = path.rstrip("/").rsplit(".", 1)[-1].lower()
    if suffix not in _BY_SUFFIX:
        raise ValueError(f"no reader for .{suffix}")
    df = _BY_SUFFIX[suffix](spark.read, path)
    return df.schema.simpleString(), df.limit(rows)


def first_present(spark: SparkSession, candidates: list[str]) -> str | None:
    """The first path that exists."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for c in candidates:
        p = jvm.org.apache.hadoop.fs.Path(c)
        if p.getFileSystem(conf).exists(p):
            return c
    return None


def to_upload(local: DataFrame, manifest: DataFrame) -> DataFrame:
    """Files that the manifest has not, or has with another hash."""
    return local.join(manifest.select("path", "sha256"), ["path", "sha256"], "left_anti")


def rows_by_id(table: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """The records of the wanted ids; the scan prunes by the key's statistics where the wanted ids are few."""
    return table.join(ids.select(key).distinct(), key, "left_semi")


def versioned(spark: SparkSession, path: str, version: int, build) -> DataFrame:
    """The table at `path` if it was built with this version, else a new one."""
    meta = f"{path}/meta"
    if first_present(spark, [f"{meta}/_SUCCESS"]) and spark.read.json(meta).where(F.col("version") == version).limit(1).count():
        return spark.read.parquet(f"{path}/data")
    df = build()
    df.write.mode("overwrite").parquet(f"{path}/data")
    out = spark.read.parquet(f"{path}/data")
    out.agg(F.lit(version).alias("version"), F.count(F.lit(1)).alias("row_count")).write.mode("overwrite").json(meta)
    return out
