"""What the operators of this subpackage share: the cluster's shared folder and worker imports."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid
from typing import ClassVar

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession

from ..session import ship  # noqa: F401  used by the operators


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Only where it is unset on a local master, as in tests, a temporary one is made; on a
    cluster each executor would write to its own disk, so there it is an error.
    """
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not re.match(r"local($|\[)", sc.master):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    own = getattr(sc, "_tidewell_shared", None)
    if own is None:
        own = tempfile.mkdtemp(prefix="tidewell-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        sc._tidewell_shared = own
    return f"file://{own}"


class Workspace:
    """A folder of its own in the shared folder, for tables that cut lineage.

    Tables are plain Parquet, so a lost executor costs nothing but a reread. Results read them
    lazily, so they stay until the process ends or, in a long session, clean() is called.
    """

    made: ClassVar[list[Workspace]] = []

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        if not Workspace.made:
            atexit.register(clean)
        Workspace.made.append(self)

    @classmethod
    def at(cls, spark: SparkSession, path: str) -> Workspace:
        """A folder that was made elsewhere and stays."""
        ws = cls.__new__(cls)
        ws.spark, ws.path = spark, path
        return ws

    def exists(self, name: str) -> bool:
        fs, p = self._found(f"{self.path}/{name}")
        return fs.exists(p)

    def put(self, df: DataFrame, name: str) -> DataFrame:
        """Write a table and return it as read back, with its schema given."""
        df.write.mode("overwrite").parquet(f"{self.path}/{name}")
        trim(self.spark)
        return self.get(name, df)

    def get(self, name: str, like: DataFrame) -> DataFrame:
        return self.spark.read.schema(like.schema).parquet(f"{self.path}/{name}")

    def drop(self, *names: str) -> None:
        """Delete tables no later step reads."""
        for name in names:
            self._delete(f"{self.path}/{name}")

    def remove(self) -> None:
        """Delete the whole workspace."""
        try:
            self._delete(self.path)
        except Exception:  # the session is already gone; the folder is named for cleaning
            shutil.rmtree(self.path.removeprefix("file://"), ignore_errors=True)

    def _found(self, path: str):
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def _delete(self, path: str) -> None:
        fs, p = self._found(path)
        fs.delete(p, True)


def clean() -> None:
    """Delete all workspaces; for when no result of an operator is read any more."""
    while Workspace.made:
        Workspace.made.pop().remove()


def trim(spark: SparkSession) -> None:
    """Give native memory that the driver's JVM has freed back to the machine.

    What planning and compiling one step takes is freed but kept by the C library, in one place
    for many threads, so a driver that goes through many steps would hold the most of all of them.
    """
    gateway, lang = spark.sparkContext._gateway, spark.sparkContext._jvm.java.lang

    def array(kind, *values):
        out = gateway.new_array(kind, len(values))
        for i, v in enumerate(values):
            out[i] = v
        return out

    # py4j sees no methods of the server's own class, only those of its interface
    kinds = array(lang.Class, *(lang.Class.forName(c) for c in ("javax.management.ObjectName", "java.lang.String", "[Ljava.lang.Object;", "[Ljava.lang.String;")))
    invoke = lang.Class.forName("javax.management.MBeanServer").getMethod("invoke", kinds)
    commands = gateway.jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand")
    try:
        invoke.invoke(lang.management.ManagementFactory.getPlatformMBeanServer(), array(lang.Object, commands, "systemTrimNativeHeap", array(lang.Object), array(lang.String)))
    except Py4JJavaError:  # a JVM or a system without it
        pass


def release(spark: SparkSession) -> None:
    """Let Spark's cleaner delete shuffle files of finished steps while a long operator goes on, and trim the driver."""
    import gc
    import time

    for _ in range(2):  # the cleaner works beside the driver, on what a collection has found
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.3)
    trim(spark)


def unused(df: DataFrame, stem: str) -> str:
    """A column name that df does not have, in any case."""
    have, name = {c.lower() for c in df.columns}, f"_{stem}"
    while name in have:
        name = f"_{name}"
    return name


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
