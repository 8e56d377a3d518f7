"""Session helpers shared by every operator: shared working folder, staged tables, code shipping."""

from __future__ import annotations

import gc
import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

ARROW_ROWS = 2000
ARROW_BYTES = "4m"
#: Bytes of a Parquet row group of a staged table: what a task that writes one holds in memory.
ROW_GROUP = 16 << 20
#: Options of a table that shall take little disk.
SMALL = {"compression": "zstd"}


def build_session(app: str = "loomgrid", master: str | None = None, **conf: str) -> SparkSession:
    """A local session for tests and benches; on a cluster the submitter's own session is used."""
    b = SparkSession.builder.appName(app).config("spark.sql.session.timeZone", "UTC")
    b = b.config("spark.ui.enabled", "false").config("spark.sql.adaptive.enabled", "true")
    if master:
        b = b.master(master)
    for k, v in conf.items():
        b = b.config(k, v)
    return b.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share (``spark.checkpoint.dir``).

    Only a local-mode session may go without the setting: it gets a temporary folder.
    """
    found = spark.conf.get("spark.checkpoint.dir", "") or spark.sparkContext.getConf().get("spark.checkpoint.dir", "")
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir: executors of local-cluster have folders of their own")
    made = f"file://{tempfile.mkdtemp(prefix='loomgrid-')}"
    spark.conf.set("spark.checkpoint.dir", made)
    return made


def staged(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and read it back: cuts lineage, survives lost executors.

    The table stays until ``discard`` or ``clear_staged``: a lazy result may still read it.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.options(**options).option("parquet.block.size", ROW_GROUP).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._loomgrid_path = path
    _staged.setdefault(spark.sparkContext.applicationId, set()).add(path)
    return out


_staged: dict[str, set[str]] = {}


def free_shuffles(spark: SparkSession) -> None:
    """Have Spark delete the shuffle files of plans that are done, which else stay until the driver's heap happens to be full."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def discard(*tables: DataFrame) -> None:
    """Delete staged tables that nothing reads any more; other DataFrames are left alone."""
    for t in tables:
        path = getattr(t, "_loomgrid_path", None)
        if path and path in _staged.get(t.sparkSession.sparkContext.applicationId, ()):
            _delete(t.sparkSession, path)


def clear_staged(spark: SparkSession) -> None:
    """Delete all staged tables of this application. Results that were not yet read or written are lost with them."""
    for path in list(_staged.get(spark.sparkContext.applicationId, ())):
        _delete(spark, path)


def _delete(spark: SparkSession, path: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    _staged[spark.sparkContext.applicationId].discard(path)


def prepared(df: DataFrame) -> SparkSession:
    """The session of ``df``, with this package on the executors' path and Arrow batches of bounded length."""
    spark = df.sparkSession
    sc = spark.sparkContext
    if getattr(sc, "_loomgrid_shipped", False) is False:
        root = Path(__file__).resolve().parent
        target = os.path.join(tempfile.mkdtemp(prefix="loomgrid-code-"), "loomgrid.zip")
        with zipfile.ZipFile(target, "w") as z:
            for p in sorted(root.rglob("*.py")):
                z.write(p, f"loomgrid/{p.relative_to(root)}")
        sc.addPyFile(target)
        sc._loomgrid_shipped = True
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", ARROW_BYTES)
    return spark
