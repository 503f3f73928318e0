"""Session settings and the shared folder for checkpoints and intermediate tables."""

from __future__ import annotations

import atexit
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark import SparkContext
from pyspark.sql import DataFrame, SparkSession

#: Settings of sessions made here; a session made elsewhere keeps its own.
CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
}


def build(master: str = "local[8]", partitions: int = 8, **conf: str) -> SparkSession:
    b = SparkSession.builder.master(master).config("spark.sql.shuffle.partitions", str(partitions))
    for k, v in (CONF | conf).items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ship(spark)
    return spark


def ship(spark: SparkSession) -> None:
    """Give Python workers this package, once a context, wherever they start: the driver's sources as an archive."""
    sc = spark.sparkContext
    if getattr(sc, "_spanforge_shipped", False):
        return
    root = Path(__file__).resolve().parent
    archive = Path(sc._temp_dir) / "spanforge.zip"
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f.relative_to(root.parent))
    sc.addPyFile(str(archive))
    sc._spanforge_shipped = True


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``, which all executors share.

    Only a local session without that setting gets a temporary folder; a
    cluster without it is an error, because a machine-local folder would not
    survive the loss of an executor.
    """
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not sc.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="spanforge-")
        spark.conf.set("spark.checkpoint.dir", folder)
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(folder)
    return folder.rstrip("/")


#: Paths made by this process and not yet removed.
_made: set[str] = set()


def scratch(spark: SparkSession, what: str) -> str:
    """A fresh path below the shared folder; ``discard`` removes it, at the latest when the process ends."""
    if not _made:
        atexit.register(discard)
    path = f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"
    _made.add(path)
    return path


def discard(*paths: str) -> None:
    """Remove the given paths, or all that this process made. Tables read from them are gone: call it when their results are written."""
    sc = SparkContext._active_spark_context
    if sc is None or sc._jsc is None:
        return
    for path in paths or tuple(_made):
        try:
            p = sc._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(sc._jsc.hadoopConfiguration()).delete(p, True)
        except Exception:  # noqa: BLE001 - a session that is going away
            return
        _made.discard(path)


def stored(df: DataFrame, what: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it again: cuts lineage and survives lost executors."""
    spark, path = df.sparkSession, scratch(df.sparkSession, what)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
