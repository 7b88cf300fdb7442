"""Helpers shared by the corpus operators: reading tables, cutting lineage, session-safe names."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space, the separator of words everywhere in this subpackage.
SPACE = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``.

    Where it is unset, a local session gets a temporary folder (tests); a cluster session must set it.
    """
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        at = tempfile.mkdtemp(prefix="spark-shared-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


#: Bytes of texts in one Arrow batch; without a bound a batch holds 10,000 texts of whatever length.
BATCH = {"spark.sql.execution.arrow.maxBytesPerBatch": "4m", "spark.sql.execution.arrow.maxRecordsPerBatch": "1000"}


def small_batches(spark: SparkSession) -> None:
    """Bound what a Python worker holds at once, by settings of the session that any caller may replace."""
    for key, value in BATCH.items():
        if spark.conf.get(f"faunaflow.set.{key}", None) is None:
            spark.conf.set(f"faunaflow.set.{key}", "true")
            spark.conf.set(key, value)


def written(df: DataFrame, compression: str = "snappy") -> DataFrame:
    """Cut the lineage: write ``df`` as Parquet in the shared folder and read it back.

    A lost executor then costs a re-read, not a recomputation, and two readers see the same rows.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/faunaflow-{uuid.uuid4().hex}"
    df.write.parquet(path, compression=compression)
    back = spark.read.schema(df.schema).parquet(path)
    back.written_to = path
    return back


def dropped(*frames: DataFrame) -> None:
    """Delete what :func:`written` wrote, once nothing reads it any more."""
    for df in frames:
        jvm, conf = df.sparkSession._jvm, df.sparkSession._jsc.hadoopConfiguration()
        path = jvm.org.apache.hadoop.fs.Path(df.written_to)
        path.getFileSystem(conf).delete(path, True)
    if frames:
        settled(frames[0])


def settled(df: DataFrame) -> None:
    """Call after a phase whose result is written: Spark then removes the phase's shuffle files from disk.

    Spark removes them once the driver's garbage collection finds the plans that read them gone, which without
    this may take as long as the job. Spark's listeners keep the plan of the last query at hand until another one has run,
    so a query of one row comes first. It only saves disk; a session without a JVM at hand goes without it.
    """
    jvm = getattr(df.sparkSession, "_jvm", None)
    if jvm is not None:
        df.sparkSession.range(1).collect()
        jvm.System.gc()


def documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the two columns that an operator needs, null text as empty, under names of its own."""
    small_batches(df.sparkSession)
    return df.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def sha256(col: Column) -> Column:
    return F.sha2(col.cast("binary"), 256)


def sample_fraction(df: DataFrame, rows: int) -> float:
    """The fraction that draws about ``rows`` rows; the count is answered from file footers."""
    total = df.select(F.lit(1)).count()
    return 1.0 if total <= rows else rows / total
