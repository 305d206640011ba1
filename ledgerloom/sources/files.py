"""Readers and writers of the contract tables and of run folders."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.operators.rejects import ALLOCATIONS, BILLS, EVENTS

WINDOWS = ("window_id", "org_token", "source_system", "coverage_start", "coverage_end", "extracted_at", "coverage_status", "basis_ref")
LABELS = ("label_id", "left_record_id", "right_record_id", "same_lineage", "reviewer_token", "reviewed_at", "basis_ref", "adjudication_status")
DECISIONS = ("decision", "left_record_id", "right_record_id", "operator")
COLUMNS = {"bills": tuple(BILLS.columns), "events": tuple(EVENTS.columns), "allocations": tuple(ALLOCATIONS.columns), "observation_windows": WINDOWS, "reference_labels": LABELS, "manual_decisions": DECISIONS}


def text_schema(columns) -> T.StructType:
    return T.StructType([T.StructField(c, T.StringType()) for c in columns])


def _exists(spark: SparkSession, path: str) -> bool:
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop)


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """All columns as text, by the file's own header; RFC 4180 quotes, UTF-8, line feeds in quotes."""
    return spark.read.options(header=True, multiLine=True, quote='"', escape='"', encoding="UTF-8", inferSchema=False).csv(path)


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A contract table, from Parquet or CSV; an empty one with the contract's columns if there is no such file."""
    for suffix, read in ((".parquet", spark.read.parquet), (".csv", lambda p: read_csv(spark, p))):
        if _exists(spark, f"{folder}/{name}{suffix}"):
            return read(f"{folder}/{name}{suffix}")
    return spark.createDataFrame([], text_schema(COLUMNS[name]))


def with_row_numbers(rows: DataFrame, first: int = 2) -> DataFrame:
    """Adds row_no in file order, from `first`: counts per partition are added up, so no task numbers all rows."""
    placed = rows.withColumns({"_ll_id": F.monotonically_increasing_id(), "_ll_p": F.spark_partition_id()})
    sizes = placed.groupBy("_ll_p").agg(F.count(F.lit(1)).alias("_ll_n"))
    before = F.coalesce(F.sum("_ll_n").over(Window.orderBy("_ll_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # one row per partition
    starts = sizes.select("_ll_p", before.alias("_ll_before"))
    inside = F.col("_ll_id").bitwiseAND((1 << 33) - 1)
    return placed.join(F.broadcast(starts), "_ll_p").withColumn("row_no", F.col("_ll_before") + inside + first).drop("_ll_id", "_ll_p", "_ll_before")


def write_csv(rows: DataFrame, path: str) -> None:
    """CSV with header, in as many files as there are partitions; lists are joined by '|'."""
    flat = rows.select(*[F.array_join(c, "|").alias(c) if t.startswith("array<string") else F.col(c) for c, t in rows.dtypes])
    flat.write.mode("overwrite").options(header=True, escape='"').csv(path)


def write_parquet(rows: DataFrame, path: str, *partition_by: str) -> None:
    rows.write.mode("overwrite").partitionBy(*partition_by).parquet(path)


def write_json(facts: dict, path: str) -> None:
    """A small report."""
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    Path(path).write_text(json.dumps(facts, indent=2, sort_keys=True) + "\n", encoding="utf-8")


def read_json(path: str) -> dict:
    return json.loads(Path(path).read_text(encoding="utf-8"))


def digests(spark: SparkSession, pattern: str) -> DataFrame:
    """path, n_bytes, sha256 of files, each read where it lies."""
    return spark.read.format("binaryFile").load(pattern).select("path", F.col("length").alias("n_bytes"), F.sha2("content", 256).alias("sha256"))


def latest_runs(folder: str, n: int = 20) -> list[str]:
    """Names of run folders, newest first."""
    return sorted((p.name for p in Path(folder).glob("run-*") if p.is_dir()), reverse=True)[:n]


def remap(rows: DataFrame, org: str, prefix: str, columns) -> DataFrame:
    """A scenario under another organisation: its token, and the prefix of the identifiers in `columns`."""
    out = rows.withColumn("org_token", F.lit(org)) if "org_token" in rows.columns else rows
    return out.withColumns({c: F.when(F.col(c) != "", F.regexp_replace(c, r"\A[A-Z]+-", f"{prefix}-")).otherwise(F.col(c)) for c in columns})


def local_text(us, zone: str):
    """Microseconds as local wall clock text of a zone, to the second."""
    return F.date_format(F.from_utc_timestamp(F.timestamp_micros(us), zone), "yyyy-MM-dd'T'HH:mm:ss")
