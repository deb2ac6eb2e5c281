"""Making this package importable where Python tasks run."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_shipped: dict[str, str] = {}
#: Bytes of an Arrow batch, unless the session sets it: both sides of a Python task hold a few of them beside the heap.
ARROW_BATCH_BYTES = 8 << 20
_ARROW_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def ship(spark: SparkSession) -> SparkSession:
    """Send the package's sources to the executors, once for each application."""
    if spark.conf.get(_ARROW_BATCH, None) is None:
        spark.conf.set(_ARROW_BATCH, str(ARROW_BATCH_BYTES))
    app = spark.sparkContext.applicationId
    if app not in _shipped:
        root = Path(__file__).resolve().parent
        target = Path(tempfile.mkdtemp(prefix="gridloom-src-")) / "gridloom_src.zip"
        with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
            for p in sorted(root.rglob("*.py")):
                z.write(p, p.relative_to(root.parent))
        spark.sparkContext.addPyFile(str(target))
        _shipped[app] = str(target)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir of the session, or, only where that is unset and all of Spark runs on this machine, a temporary one."""
    set_for_all = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if set_for_all:
        return set_for_all.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    own = spark.conf.get("gridloom.shared.dir", None)
    if not own:
        own = tempfile.mkdtemp(prefix="gridloom-")
        spark.conf.set("gridloom.shared.dir", own)
    return own


def _own_dir(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/gridloom-{spark.sparkContext.applicationId}"


def kept(df: DataFrame, name: str = "kept") -> DataFrame:
    """Written to the shared folder and read back: iterations go on from files, so that plans stay short and a lost executor costs a read."""
    path = f"{_own_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def forget(spark: SparkSession) -> None:
    """Delete all tables that this application has kept, once no result that reads them is needed any more."""
    path = spark._jvm.org.apache.hadoop.fs.Path(_own_dir(spark))
    path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)
