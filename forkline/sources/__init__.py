"""Reading the input tables and writing intermediate ones."""

from __future__ import annotations

import atexit
import functools
import os
import shutil
import tempfile
import threading
import uuid
from collections.abc import Callable
from pathlib import Path
from typing import ParamSpec, TypeVar

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from forkline.errors import StorageError

#: Rows up to which a side counts as small enough to send to every executor, for rows of a few numbers.
BROADCAST_ROWS = 1_000_000
P, R = ParamSpec("P"), TypeVar("R")
_SHIPPED: set[str] = set()
_OWN: dict[str, str] = {}


class _Open(threading.local):
    """Per thread, the tables written by each operator call that is under way, innermost last."""

    def __init__(self) -> None:
        self.calls: list[list[DataFrame]] = []


_OPEN = _Open()


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The Parquet table ``name`` of a data folder: one file or a folder of files."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def is_local(spark: SparkSession) -> bool:
    """Whether everything runs in one process on this machine."""
    master = spark.sparkContext.master
    return master == "local" or master.startswith("local[")


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir of the session, or the context's checkpoint folder.

    Only where neither is set and everything runs in one process, as in tests, it is a folder of our own on this machine;
    on a cluster that is an error.
    """
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if not is_local(spark):
        raise StorageError("set spark.checkpoint.dir to a folder that all executors share")
    if context.applicationId not in _OWN:
        _OWN[context.applicationId] = f"file://{tempfile.mkdtemp(prefix='forkline-')}"
    return _OWN[context.applicationId]


def _delete(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(where, True)
    except Exception:  # noqa: BLE001 - at exit the session may be gone
        pass


def written(df: DataFrame, at_exit: bool = True) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read again.

    This cuts the lineage, survives lost executors, and gives later plans true sizes. The files go when the operator that
    wrote them returns a result that does not read them (:func:`tidy`), through :func:`dropped`, or when Python ends.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/forkline-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if at_exit:
        atexit.register(_delete, spark, path)
    out = spark.read.schema(df.schema).parquet(path)
    out._forkline_path = path
    if _OPEN.calls:
        _OPEN.calls[-1].append(out)
    return out


def written_counting(df: DataFrame, cond: Column) -> tuple[DataFrame, int]:
    """Like :func:`written`, with the number of rows for which ``cond`` holds, counted while they are written."""
    seen = Observation()
    out = written(df.observe(seen, F.count(F.when(cond, 1)).alias("n")))
    return out, seen.get["n"]


def dropped(*frames: DataFrame) -> None:
    """Delete the files of frames that :func:`written` made and that no later plan reads."""
    for df in frames:
        if path := getattr(df, "_forkline_path", None):
            _delete(df.sparkSession, path)


def _read_paths(df: DataFrame) -> str:
    """The folders that a frame's plan reads, in one string."""
    leaves = df._jdf.queryExecution().analyzed().collectLeaves()
    found = []
    for i in range(leaves.size()):
        leaf = leaves.apply(i)
        if leaf.getClass().getSimpleName() == "LogicalRelation" and leaf.relation().getClass().getSimpleName() == "HadoopFsRelation":
            found.append(leaf.relation().location().rootPaths().mkString("\n"))
    return "\n".join(found)


def tidy(make: Callable[P, R]) -> Callable[P, R]:
    """For functions that return a frame or several: drop what they wrote on the way and their results do not read."""

    @functools.wraps(make)
    def run(*args: P.args, **kwargs: P.kwargs) -> R:
        _OPEN.calls.append([])
        try:
            out = make(*args, **kwargs)
            frames = [f for f in (out if isinstance(out, (tuple, list)) else [out]) if isinstance(f, DataFrame)]
            read = "\n".join(map(_read_paths, frames))
        except BaseException:
            read = ""
            raise
        finally:
            mine = _OPEN.calls.pop()
            kept = [df for df in mine if df._forkline_path.rpartition("/")[2] in read]
            dropped(*[df for df in mine if not any(df is k for k in kept)])
            if _OPEN.calls:
                _OPEN.calls[-1].extend(kept)
        return out

    return run


def small_side(df: DataFrame, rows: int = BROADCAST_ROWS) -> tuple[DataFrame, bool]:
    """``df`` with a broadcast hint if a count shows at most ``rows`` rows, and whether it has one.

    Pass a written table: its rows are counted from the file footers. Beyond the bound the plain frame comes back, and
    the join shuffles.
    """
    if df.count() <= rows:
        return F.broadcast(df), True
    return df, False


def shipped(spark: SparkSession) -> None:
    """See to it that Python workers can import this package: send it along unless they inherit a path that holds it."""
    root = Path(__file__).resolve().parents[2]
    inherited = [Path(p or ".").resolve() for p in [os.getcwd(), *os.environ.get("PYTHONPATH", "").split(os.pathsep)]]
    context = spark.sparkContext
    if root in inherited or context.applicationId in _SHIPPED:
        return
    base = Path(tempfile.mkdtemp(prefix="forkline-package-")) / "forkline_package"
    context.addPyFile(shutil.make_archive(str(base), "zip", root, "forkline"))
    _SHIPPED.add(context.applicationId)
