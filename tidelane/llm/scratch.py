"""Tables that cut lineage, written to the folder that all executors share."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_left: list[tuple[SparkSession, str]] = []


ARROW_BYTES = 4 << 20  # of a batch that goes to a Python worker, at most
PLAN_TEXT = 16 << 10  # letters of a plan's description, at most
HEAP_SHARE = 0.5  # of the driver's heap that may be held before it is collected and given back
HEAP_FREE = {"MinHeapFreeRatio": "10", "MaxHeapFreeRatio": "40"}  # percent of the heap left free after that


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; where that is unset, and all runs in this process, a new one is set.

    On a cluster a folder of this machine would be of no use to the others, so there the setting must be given.
    """
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        given = spark.conf.get("spark.checkpoint.dir", None)
        if not given and not sc.master.split("[")[0] == "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        sc.setCheckpointDir(given or tempfile.mkdtemp(prefix="tidelane-"))
    return sc.getCheckpointDir()


def _lower(spark: SparkSession, name: str, most: int) -> None:
    found = re.fullmatch(r"(\d+)([kmg]?)b?", spark.conf.get(name, f"{most + 1}b").lower())
    if not found or int(found[1]) << {"": 0, "k": 10, "m": 20, "g": 30}[found[2]] > most:
        spark.conf.set(name, f"{most}b")


def small_memory(spark: SparkSession) -> None:
    """From now on the session sends no batch of over ARROW_BYTES to Python, and keeps no description of over PLAN_TEXT.

    Rows hold whole texts, and a worker's memory is a few times its batch; the driver keeps the descriptions of many
    plans, which are long here. Smaller limits of the session's own stay.
    """
    _lower(spark, "spark.sql.execution.arrow.maxBytesPerBatch", ARROW_BYTES)
    _lower(spark, "spark.sql.maxPlanStringLength", PLAN_TEXT)


def return_heap(spark: SparkSession) -> bool:
    """Collects the driver's heap and gives free parts back to the system if the JVM holds over HEAP_SHARE of its limit.

    Jobs in a row leave plans and tasks behind that the JVM rather takes all of its heap for than collect them; what
    lives is a small part of that. Tells whether it has collected.
    """
    jvm = spark.sparkContext._jvm
    runtime = jvm.java.lang.Runtime.getRuntime()
    if runtime.totalMemory() <= HEAP_SHARE * runtime.maxMemory():
        return False
    try:
        bean = jvm.java.lang.Class.forName("com.sun.management.HotSpotDiagnosticMXBean")
        options = jvm.java.lang.management.ManagementFactory.getPlatformMXBean(bean)
        for name, percent in HEAP_FREE.items():
            options.setVMOption(name, percent)
    except Exception:  # noqa: BLE001  another JVM: its own ratios stay
        pass
    jvm.System.gc()
    return True


def _delete(spark: SparkSession, path: str) -> None:
    jvm, jsc = spark.sparkContext._jvm, spark.sparkContext._jsc
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(jsc.hadoopConfiguration()).delete(at, True)


@atexit.register
def _clean() -> None:
    for spark, path in _left:
        try:
            _delete(spark, path)
        except Exception:  # noqa: BLE001  the session has ended; its folder goes with it
            return


class Scratch:
    """Parquet tables under the shared folder. A lost executor loses none of them."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root, self.n = spark, f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}", 0
        _left.append((spark, self.root))
        small_memory(spark)

    def table(self, df: DataFrame) -> DataFrame:
        """df, written once and read again."""
        self.n += 1
        path = f"{self.root}/{self.n}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch = path
        return_heap(self.spark)
        return out

    def drop(self, *tables: DataFrame) -> None:
        """Deletes tables that nothing reads any more."""
        for t in tables:
            _delete(self.spark, t._scratch)
