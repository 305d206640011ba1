"""Session settings and the few helpers that every operator shares."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

#: Settings that let a plan adapt to skew and size at run time.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def build_session(master: str = "local[*]", name: str = "ledgerloom", **conf: str) -> SparkSession:
    """A session with DEFAULTS; conf keys use '__' for '.'."""
    builder = SparkSession.builder.master(master).appName(name)
    for key, value in (DEFAULTS | {k.replace("__", "."): v for k, v in conf.items()}).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def tune(spark: SparkSession) -> None:
    """Turn on skew splitting in a session that was built elsewhere; time zone UTC as every operator counts in UTC."""
    for key in ("spark.sql.adaptive.enabled", "spark.sql.adaptive.skewJoin.enabled", "spark.sql.adaptive.forceOptimizeSkewedJoin"):
        spark.conf.set(key, "true")
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    ship(spark)


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir of the session, else one set up here (tests, local mode only)."""
    context = spark.sparkContext
    found = context.getConf().get("spark.checkpoint.dir") or context._jsc.sc().getCheckpointDir().getOrElse(None)
    if found:
        return found
    if not context.master.startswith("local[") and context.master != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    found = tempfile.mkdtemp(prefix="ledgerloom-")
    context.setCheckpointDir(found)
    return found


def cut_counted(df: DataFrame) -> tuple[DataFrame, int]:
    """df, computed now and written to the shared folder, and its number of rows, which the same job counts.

    The lineage ends at the written table, so a lost executor costs nothing; the optimiser knows its real size, and scans read only
    the columns that are asked for. The table lives as long as the session's application: `drop_cuts` removes what was written.
    """
    spark = df.sparkSession
    root = shared_dir(spark)
    path = f"{root}/cut-{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"
    counted = Observation()
    df.observe(counted, F.count(F.lit(1)).alias("n")).write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), int(counted.get["n"])


def cut(df: DataFrame) -> DataFrame:
    """df, computed now and written to the shared folder, so that its lineage ends here."""
    return cut_counted(df)[0]


def drop_cuts(spark: SparkSession) -> None:
    """Remove every table that `cut` has written in this application; results that still read them can't be used any more."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/cut-{spark.sparkContext.applicationId}")
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def ship(spark: SparkSession) -> None:
    """Send this package to Python workers, once a session, unless PYTHONPATH already leads them to it."""
    root = Path(__file__).resolve().parent.parent
    context = spark.sparkContext
    if str(root) in os.environ.get("PYTHONPATH", "").split(os.pathsep) or getattr(context, "_ledgerloom_sent", False):
        return
    packed = Path(tempfile.mkdtemp(prefix="ledgerloom-")) / "ledgerloom.zip"
    with zipfile.ZipFile(packed, "w") as out:
        for source in sorted((root / "ledgerloom").rglob("*.py")):
            out.write(source, source.relative_to(root))
    context.addPyFile(str(packed))
    context._ledgerloom_sent = True


def fresh(df: DataFrame, base: str) -> str:
    """A column name that df doesn't have, for helper columns beside a caller's own."""
    taken = {c.lower() for c in df.columns}
    return base if base.lower() not in taken else f"{base}_{uuid.uuid4().hex[:8]}"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")
