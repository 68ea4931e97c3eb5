"""Session settings and the shared working folder."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


#: Frees shuffle files at the end of a statement, where Spark knows the setting.
FREES_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def build_session(app: str = "threadloom", cpus: int | str = "*", memory: str = "12g") -> SparkSession:
    """A local session for tests and benchmarks; on a cluster, spark-submit supplies the settings."""
    partitions = str(cpus if str(cpus).isdigit() else os.cpu_count() or 8)
    session = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", partitions)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    return session


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, as named by ``spark.checkpoint.dir``.

    Only a local session may fall back to a temporary folder: on a cluster that folder would live
    on one machine and be lost with it.
    """
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder all executors share")
    context.setCheckpointDir(tempfile.mkdtemp(prefix="threadloom-"))
    return context.getCheckpointDir()


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder; never reused, so a rerun meets no half-written files."""
    return f"{shared_dir(spark)}/{uuid.uuid4().hex}/{name}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: cuts lineage, survives lost executors.

    What the write shuffled is given free when it ends, as nothing else reads it.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    before = spark.conf.get(FREES_SHUFFLES, None)
    spark.conf.set(FREES_SHUFFLES, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(FREES_SHUFFLES, before) if before is not None else spark.conf.unset(FREES_SHUFFLES)
    return spark.read.schema(df.schema).parquet(path)


def removed(*tables: DataFrame) -> None:
    """Delete tables that ``written`` made and nothing reads any more; files elsewhere stay."""
    for table in tables:
        context = table.sparkSession.sparkContext
        root = shared_dir(table.sparkSession)
        for folder in {f.rsplit("/", 1)[0] for f in table.inputFiles()}:
            path = context._jvm.org.apache.hadoop.fs.Path(folder)
            system = path.getFileSystem(context._jsc.hadoopConfiguration())
            own = system.makeQualified(context._jvm.org.apache.hadoop.fs.Path(root)).toUri().getPath()
            if path.toUri().getPath().startswith(f"{own.rstrip('/')}/"):
                system.delete(path, True)


def placed(df: DataFrame, *keys: str) -> DataFrame:
    """Rows placed by key over the full number of shuffle partitions.

    The number is given, so adaptive execution does not merge partitions by their size: a few
    megabytes of text become gigabytes once taken apart into grams.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)
