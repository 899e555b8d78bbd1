"""Session settings and the shared folder used to cut lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession


def build_session(app: str = "cohortloom", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the adaptive settings this library is written for.

    ``master`` stays unset under spark-submit, so that the cluster decides.
    Shuffle partitions are left to the caller and to adaptive coalescing.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.parquet.filterPushdown": "true",
        "spark.ui.enabled": "false",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """Folder every executor can reach, as named in ``spark.checkpoint.dir``.

    Only a local session may fall back to a folder of its own: on a cluster a
    machine-local path would be lost with the machine.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="cohortloom-"))
    return context.getCheckpointDir()


def fresh_path(spark: SparkSession, label: str) -> str:
    return f"{shared_folder(spark)}/cohortloom/{label}-{uuid.uuid4().hex}"


def stage(df: DataFrame, label: str = "stage") -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    The result has no lineage to recompute when an executor is lost, keeps
    columnar pruning, and gives the optimizer its true size.
    """
    spark = df.sparkSession
    path = fresh_path(spark, label)
    df.write.parquet(path)
    stored = spark.read.schema(df.schema).parquet(path)
    stored._staged_at = path
    return stored


def _place(spark: SparkSession, path: str):
    """A path and its file system, whichever Spark knows."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark._jsc.hadoopConfiguration())


def put_text(spark: SparkSession, folder: str, name: str, text: str) -> None:
    """Write a small file under its final name in one step; it must not be there yet."""
    place, system = _place(spark, folder)
    system.mkdirs(place)
    part = spark._jvm.org.apache.hadoop.fs.Path(place, f".{name}.{uuid.uuid4().hex}")
    out = system.create(part, False)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()
    if not system.rename(part, spark._jvm.org.apache.hadoop.fs.Path(place, name)):
        system.delete(part, False)
        raise FileExistsError(f"{folder}/{name}")


def list_names(spark: SparkSession, folder: str) -> list[str]:
    """Names in a folder, hidden ones left out; none if it is absent."""
    place, system = _place(spark, folder)
    if not system.exists(place):
        return []
    return [n for s in system.listStatus(place) if not (n := s.getPath().getName()).startswith((".", "_"))]


def read_texts(spark: SparkSession, folder: str, names: list[str]) -> list[str]:
    """The contents of small files, in the order of their names."""
    out = []
    for name in names:
        place, system = _place(spark, f"{folder}/{name}")
        stream = system.open(place)
        try:
            out.append(spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()
    return out


def remove_folder(spark: SparkSession, path: str) -> None:
    """Delete a file or a folder with all it holds; an absent one is no error."""
    place, system = _place(spark, path)
    system.delete(place, True)


def discard(df: DataFrame) -> None:
    """Delete the files of a staged table that nothing reads any more; other tables stay."""
    path = getattr(df, "_staged_at", None)
    if path is not None:
        remove_folder(df.sparkSession, path)


def stage_measured(df: DataFrame, label: str, **metrics: Column) -> tuple[DataFrame, dict]:
    """``stage`` that also returns aggregates of the rows, taken while they are written."""
    seen = Observation()
    stored = stage(df.observe(seen, *[c.alias(name) for name, c in metrics.items()]), label)
    return stored, seen.get
