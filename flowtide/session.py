"""Session set-up and the shared folder used for written tables."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.utils import AnalysisException


def build_session(app_name: str = "flowtide", master: str | None = None, **conf) -> SparkSession:
    """A session with the settings the operators rely on.

    Shuffle sizing is left to adaptive execution unless the caller sets it: start from
    many small partitions and let Spark coalesce them, and let it split skewed joins.
    """
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor can reach, named by ``spark.checkpoint.dir``.

    Only a local master (tests) may fall back to a folder of its own.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get(
        "spark.checkpoint.dir"
    )
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    folder = tempfile.mkdtemp(prefix="flowtide-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new path for one written table in the shared folder."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


#: Tables written within the innermost ``short_lived``.
_WRITTEN: ContextVar[list[DataFrame] | None] = ContextVar("written", default=None)


@contextmanager
def short_lived() -> Iterator[None]:
    """Tables that ``materialize`` writes inside are removed at the end, so a stream does not leave those of every batch."""
    written: list[DataFrame] = []
    token = _WRITTEN.set(written)
    try:
        yield
    finally:
        _WRITTEN.reset(token)
        discard(*written)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once and read it back, so that several consumers share one computation
    and a lost executor never forces the whole lineage to run again."""
    path = fresh_path(df.sparkSession, name)
    df.write.mode("overwrite").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._written_to = path
    if _WRITTEN.get() is not None:
        _WRITTEN.get().append(out)
    return out


#: Rows that one task may keep to itself where a table is read again and again.
ROWS_A_TASK = 10_000


def spread(df: DataFrame) -> DataFrame:
    """``df`` dealt over more tasks if it has many rows: a table that comes as one block of a file would be worked on
    by one task. The number grows with the rows, up to four times the cores there are; few rows stay as they lie."""
    wanted = -(-df.count() // ROWS_A_TASK)
    parts = min(wanted, 4 * df.sparkSession.sparkContext.defaultParallelism)
    return df.repartition(parts) if parts > 1 else df


def discard(*tables: DataFrame) -> None:
    """Remove tables written by ``materialize`` once all that read them has been written itself."""
    for table in tables:
        path, spark = table._written_to, table.sparkSession
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """Read one of the given tables."""
    return spark.read.parquet(os.path.join(folder, f"{name}.parquet"))


def path_exists(spark: SparkSession, path: str) -> bool:
    try:
        spark.read.format("binaryFile").load(path).schema
        return True
    except AnalysisException:
        return False
