"""Session helpers shared by every part of the library."""

from __future__ import annotations

import gc
import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession

_shipped: set[str] = set()
#: Whether Spark deletes the shuffle files of a plan at its end.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def ship(spark: SparkSession) -> None:
    """Make this package importable by Python workers, whatever their working folder is, and keep their Arrow batches of whole texts small."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) == 10_000:  # the default
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(4 << 20))
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    root = Path(__file__).resolve().parent
    folder = tempfile.mkdtemp(prefix="rulequarry-")
    target = os.path.join(folder, "rulequarry.zip")
    with zipfile.ZipFile(target, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    spark.sparkContext.addPyFile(target)
    _shipped.add(app)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir`` of the session.

    Only a plain local master may go without the setting; it then gets a temporary folder.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    root = tempfile.mkdtemp(prefix="rulequarry-shared-")
    spark.conf.set("spark.checkpoint.dir", root)
    return root


def give_back(spark: SparkSession) -> str | None:
    """Have the driver's JVM give native memory that its compilers and buffers have freed back to the system; what it says, or None where it can't."""
    jvm, array = spark.sparkContext._jvm, spark.sparkContext._gateway.new_array
    asked = array(jvm.java.lang.Object, 4)
    try:
        asked[0], asked[1] = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap"
        asked[2], asked[3] = array(jvm.java.lang.Object, 0), array(jvm.java.lang.String, 0)
        run = next(x for x in jvm.java.lang.Class.forName("javax.management.MBeanServer").getMethods() if x.getName() == "invoke")
        return run.invoke(jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer(), asked)
    except Py4JError:  # only some JVMs on Linux have the command
        return None


class Scratch:
    """Tables written to the shared folder to cut lineage; a lost executor rereads them."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        self.paths: list[str] = []

    def keep(self, df: DataFrame) -> DataFrame:
        """Write a table. The shuffle files of its plan go when it is written, and not only when the driver happens to collect its garbage."""
        path = f"{self.root}/{len(self.paths)}"
        self.paths.append(path)
        before = self.spark.conf.get(CLEANUP, None)
        self.spark.conf.set(CLEANUP, "true")
        try:
            df.write.option("compression", "zstd").parquet(path)
        finally:
            self.spark.conf.unset(CLEANUP) if before is None else self.spark.conf.set(CLEANUP, before)
        kept = self.spark.read.schema(df.schema).parquet(path)
        kept._scratch = path
        return kept

    def tidy(self) -> None:
        """Let Spark delete the shuffle files of plans that nothing refers to any more, and give freed memory of the driver back."""
        gc.collect()
        self.spark.sparkContext._jvm.System.gc()
        give_back(self.spark)

    def drop(self, kept: DataFrame) -> None:
        """Delete a table of this scratch space that nothing reads any more."""
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(kept._scratch)
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)

    def clear(self) -> None:
        """Delete all tables of this scratch space, and shuffle files that nothing refers to any more."""
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.root)
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
        self.tidy()
