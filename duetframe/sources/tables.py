"""Tables of a folder, and tables written into the folder that driver and executors share."""

from __future__ import annotations

import atexit
import os
import re
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from pathlib import Path

from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession


#: Spark's setting for the rows of an Arrow batch and what it is put to where it has its default.
BATCH_ROWS = ("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """One table of the folder, by Spark's own reader (the folder may be in a store that only Spark opens)."""
    ship_code(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def ship_code(spark: SparkSession) -> None:
    """Gives the workers this package, once for each session: they needn't have it installed or start where it lies."""
    sc = spark.sparkContext
    if getattr(sc, "_duetframe_shipped", False):
        return
    root = Path(__file__).resolve().parent.parent
    path = os.path.join(tempfile.mkdtemp(prefix="duetframe-"), f"{root.name}.zip")
    with zipfile.ZipFile(path, "w") as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f.relative_to(root.parent))
    sc.addPyFile(path)
    # rows hold whole texts: fewer of them in a batch keep workers small (a size that was chosen stays, whatever it is)
    if not spark._jsparkSession.sessionState().conf().contains(BATCH_ROWS[0]):
        spark.conf.set(*BATCH_ROWS)
    sc._duetframe_shipped = True


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Where that is unset, a master on this machine (local, as in tests) gets a temporary folder; a cluster gets an error,
    as its executors would each write to a disk of their own.
    """
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not re.match(r"local(\[|$)", sc.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not getattr(sc, "_duetframe_shared", None):
        sc._duetframe_shared = "file://" + tempfile.mkdtemp(prefix="duetframe-")
    return sc._duetframe_shared


def stored(df: DataFrame) -> DataFrame:
    """Write the rows as Parquet into the shared folder and read them again.

    This cuts the lineage: what reads the table later survives the loss of any executor. The files go at the end of the
    workspace in which they were written, or else when the driver's process ends.
    """
    spark = df.sparkSession
    ship_code(spark)
    path = scratch(spark)
    df.write.option("compression", "zstd").parquet(path)
    give_back(spark)
    return spark.read.schema(df.schema).parquet(path)


def scratch(spark: SparkSession) -> str:
    """A path in the shared folder that nothing else has; what is written there goes as stored() says."""
    path = f"{shared_dir(spark)}/duetframe-{uuid.uuid4().hex}"
    held = _open.get()
    if held:
        held[-1].append(path)
    else:
        atexit.register(_forget, spark, path)
    return path


#: Paths written in the workspaces that are open in this thread (or task of an event loop), innermost last.
_open: ContextVar[tuple[list[str], ...]] = ContextVar("workspaces", default=())


@contextmanager
def workspace(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Tables stored inside go at its end. What it gives stores a table that stays: what the block has been for.

    Nothing that reads a table of the block may be used after it.
    """
    mine: list[str] = []
    outer = _open.get()
    entered = _open.set((*outer, mine))

    def keep(df: DataFrame) -> DataFrame:
        inner = _open.set(outer)
        try:
            return stored(df)
        finally:
            _open.reset(inner)

    try:
        yield keep
    finally:
        _open.reset(entered)
        for path in mine:
            _forget(spark, path)


def give_back(spark: SparkSession) -> None:
    """Lets the driver's JVM drop what it doesn't need any more: shuffle files and broadcasts that nothing refers to,
    and memory that its compiler threads have freed (which the C library otherwise keeps)."""
    jvm = spark.sparkContext._jvm
    jvm.System.gc()
    try:
        _command(spark, "systemTrimNativeHeap")
    except Py4JError:  # not every JVM has that command
        pass


def _command(spark: SparkSession, name: str) -> str:
    """Runs a diagnostic command of the driver's JVM, through the interface (its class isn't open to callers)."""
    jvm, gateway = spark.sparkContext._jvm, spark.sparkContext._gateway

    def array(kind, *items):
        made = gateway.new_array(kind, len(items))
        for i, x in enumerate(items):
            made[i] = x
        return made

    of = jvm.java.lang.Class.forName
    kinds = array(jvm.java.lang.Class, *map(of, ("javax.management.ObjectName", "java.lang.String", "[Ljava.lang.Object;", "[Ljava.lang.String;")))
    server = jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer()
    commands = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand")
    return of("javax.management.MBeanServer").getMethod("invoke", kinds).invoke(server, array(jvm.Object, commands, name, array(jvm.Object), array(jvm.String)))


def _forget(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        if jvm is not None:
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the session has ended before: nothing is left to ask
        pass
