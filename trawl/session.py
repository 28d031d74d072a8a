"""Session settings and lineage staging shared by all operators."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.functions import lit

_OWN_FOLDERS: dict[str, str] = {}
_STAGED: dict[str, list[str]] = {}

SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, **extra: str) -> SparkSession:
    """A local session for tests and benchmarks; clusters bring their own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("trawl")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    )
    for key, value in {**SETTINGS, **extra}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder for intermediates that all executors can read and write.

    It is the session's ``spark.checkpoint.dir``. A session that runs in one
    process (master ``local`` or ``local[n]``) and has no such setting gets one
    temporary folder for its life time; anywhere else the setting is required.
    Intermediates stay until `drop_stages` or the owner of the folder deletes them.
    """
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or _OWN_FOLDERS.get(context.applicationId)
    if folder is None:
        if context.master != "local" and not context.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = _OWN_FOLDERS[context.applicationId] = tempfile.mkdtemp(prefix="trawl-shared-")
    return folder.rstrip("/")


def stage(df: DataFrame) -> DataFrame:
    """Write an intermediate that several branches read, and cut its lineage.

    Uses a reliable checkpoint in `shared_folder`, so a lost executor costs a
    re-read and not a recomputation.
    """
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def use_rocksdb(spark: SparkSession) -> None:
    """Streams that start in this session keep their state in RocksDB, which operators with timers need."""
    spark.conf.set(
        "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    )


def shuffled(df: DataFrame) -> DataFrame:
    """df, which a join then meets by a shuffle and never by a broadcast.

    Spark guesses sizes: it counts a row for each one that an explode reads, eight
    bytes for an array and a compressed file's bytes for its rows. A table that grows
    with the input and is guessed under the broadcast threshold would fill the driver.
    """
    return df.hint("merge")


def with_session(df: DataFrame) -> DataFrame:
    """Rows without a session column all belong to the session ''."""
    return df if "session_id" in df.columns else df.withColumn("session_id", lit(""))


def scratch_folder(spark: SparkSession) -> str:
    """A new folder name for round trips and staged tables, below `shared_folder`."""
    name = f"{shared_folder(spark)}/trawl-{uuid.uuid4().hex}"
    _STAGED.setdefault(spark.sparkContext.applicationId, []).append(name)
    return name


def staged(spark: SparkSession) -> list[str]:
    """The folders that this session's `scratch_folder` calls named and that were not deleted."""
    return list(_STAGED.get(spark.sparkContext.applicationId, []))


def drop_stages(spark: SparkSession, among: list[str] | None = None, needed_by: DataFrame | None = None) -> int:
    """Delete the `staged` folders, or those of them that are in `among`; returns how many.

    Folders that `needed_by` reads stay. Call it when no other result that was
    not written elsewhere needs them any more.
    """
    names = [n for n in staged(spark) if among is None or n in among]
    files = needed_by.inputFiles() if needed_by is not None and names else []
    gone = [n for n in names if not any(n.rsplit("/", 1)[1] in f for f in files)]
    _STAGED[spark.sparkContext.applicationId] = [n for n in staged(spark) if n not in gone]
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for name in gone:
        path = jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(conf).delete(path, True)
    return len(gone)


def release_shuffles(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files that no plan needs any more, which it does when the driver collects its garbage."""
    gc.collect()
    spark._jvm.System.gc()


def stage_table(df: DataFrame) -> DataFrame:
    """Write a text-heavy intermediate as a Parquet table in the shared folder.

    Unlike a checkpoint it is compressed and columnar: later readers that only
    need keys do not read the texts again.
    """
    folder = scratch_folder(df.sparkSession)
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)
