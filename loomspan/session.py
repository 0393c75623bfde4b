"""Session, table loading and lineage cutting shared by all operators."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str = "*", shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A session for tests and benches on one machine; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("loomspan")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", memory)
        .config("spark.driver.host", "127.0.0.1")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def ship(spark: SparkSession) -> None:
    """Give this package to Python workers that can't import it by themselves; once for each context."""
    sc = spark.sparkContext
    root = Path(__file__).resolve().parent.parent
    reachable = str(root) in os.environ.get("PYTHONPATH", "").split(os.pathsep) or (sc.master.startswith("local[") and Path.cwd() == root)
    if reachable or getattr(sc, "_has_loomspan", False):
        return
    packed = Path(tempfile.mkdtemp(prefix="loomspan-")) / "loomspan.zip"
    with zipfile.ZipFile(packed, "w") as z:
        for f in sorted((root / "loomspan").rglob("*.py")):
            z.write(f, f.relative_to(root))
    sc.addPyFile(str(packed))
    sc._has_loomspan = True


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors reach: spark.checkpoint.dir, and a folder of our own only where that is unset."""
    given, sc = spark.conf.get("spark.checkpoint.dir", None), spark.sparkContext
    if given:
        if sc.getCheckpointDir() is None:
            sc.setCheckpointDir(given)
        return given.rstrip("/")
    if sc.getCheckpointDir() is None:
        if not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors reach")
        sc.setCheckpointDir(os.path.join(tempfile.gettempdir(), "loomspan-checkpoints"))
    return sc.getCheckpointDir().rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """Run df, write it to the shared folder and go on from there; survives the loss of executors."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


class Scratch:
    """A folder for written tables in the shared folder, removed by ``close``."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"

    def at(self, name: str) -> str:
        return f"{self.path}/{name}"

    def close(self) -> None:
        delete_path(self.spark, self.path)


def _hadoop(spark: SparkSession, path: str) -> tuple:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def delete_path(spark: SparkSession, path: str) -> None:
    fs, p = _hadoop(spark, path)
    fs.delete(p, True)


def list_names(spark: SparkSession, path: str) -> list[str]:
    """The names in a folder of any file system that Spark reaches, in order; none if it isn't there."""
    fs, p = _hadoop(spark, path)
    return sorted(f.getPath().getName() for f in fs.listStatus(p)) if fs.exists(p) else []


def modified_ms(spark: SparkSession, path: str) -> int:
    fs, p = _hadoop(spark, path)
    return fs.getFileStatus(p).getModificationTime()


def read_text(spark: SparkSession, path: str) -> str | None:
    """The text of a small file; None if it isn't there."""
    fs, p = _hadoop(spark, path)
    if not fs.exists(p):
        return None
    stream = fs.open(p)
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """Put a small file in place of any before it, by renaming a finished one."""
    fs, p = _hadoop(spark, path)
    jvm = spark.sparkContext._jvm
    staged = jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex}")
    stream = fs.create(staged, True)
    stream.write(bytearray(text.encode()))
    stream.close()
    options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    options[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark.sparkContext._jsc.hadoopConfiguration()).rename(staged, p, options)
