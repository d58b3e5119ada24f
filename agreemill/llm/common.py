"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BATCH_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Read a whole table through Spark's reader, so any Hadoop path works."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for checkpoints and tables between stages."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        named = spark.conf.get("spark.checkpoint.dir", "")
        if not named and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="checkpoint-"))
    return sc._jsc.sc().getCheckpointDir().get()


def written(df: DataFrame) -> DataFrame:
    """Write a table in the shared folder and read it again."""
    path = f"{checkpoint_dir(df.sparkSession)}/table-{uuid.uuid4().hex}.parquet"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def forget(df: DataFrame) -> None:
    """Delete the files of a table that ``written`` gave and nobody reads any more."""
    jvm = df.sparkSession._jvm
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        where = jvm.org.apache.hadoop.fs.Path(path)
        if where.getName().startswith("table-"):
            where.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def checkpoint(df: DataFrame, files: int | None = None) -> DataFrame:
    """Cut the lineage with a reliable checkpoint of at most ``files`` files.

    The folder is the one the cluster names in ``spark.checkpoint.dir``; only
    where that is unset a local session (tests) uses a temporary one. By default there are
    at most four files a core: small files by the thousand cost more than the
    rows in them.
    """
    sc = df.sparkSession.sparkContext
    checkpoint_dir(df.sparkSession)
    return df.coalesce(max(1, files or 4 * sc.defaultParallelism)).checkpoint(eager=True)


def fresh(df: DataFrame) -> DataFrame:
    """The rows of a checkpointed table under a plan without its size estimate.

    A checkpoint keeps the estimate of the plan that made it, and a join's is the
    product of its sides: over the rounds of a loop its digits grow as a power of
    the rounds, until the driver's memory is full of one number.
    """
    spark = df.sparkSession
    return DataFrame(spark._jsparkSession.createDataFrame(df._jdf.javaRDD(), df._jdf.schema()), spark)


def small_batches() -> None:
    """Bound by bytes what a Python worker gets at once: texts may be long, and
    a default batch of 10,000 of them fills memory on both sides."""
    SparkSession.active().conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def fold(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo ``n``; a null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % n


def class_of(text: Column) -> Column:
    """The class of a text: equal texts have the same one."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def free_name(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have yet, whatever its case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def col(name: str) -> Column:
    """A column by its literal name, dots and back-ticks included."""
    return F.col("`" + name.replace("`", "``") + "`")
