"""Shared pieces of the training-data operators: checkpoints, the shared folder, text helpers."""

from __future__ import annotations

import atexit
import sys
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession

# Functions of this package travel with the plan: executors need no installed copy.
cloudpickle.register_pickle_by_value(sys.modules[__name__.split(".")[0]])

#: A word: a run of characters other than blank and the five ASCII white-space controls.
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """URI of the folder that the driver and every executor can reach.

    ``spark.checkpoint.dir`` names it.  Where that is unset a folder is made here, but only for a local master:
    on a cluster others would not see it.
    """
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if found is None:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='trialbook-')}"
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(found)
    return found.rstrip("/")


def scratch_dir(spark: SparkSession, label: str) -> str:
    """A fresh folder below the shared one, for files that results may still read; it goes when the driver's process ends."""
    uri = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    atexit.register(_remove, uri)
    return uri


def _remove(uri: str) -> None:
    """Spark is gone by then: the store is reached as the executors reach it."""
    from pyarrow import fs

    try:
        files, path = fs.FileSystem.from_uri(uri)
        files.delete_dir(path)
    except (OSError, pa.ArrowInvalid):
        pass  # never written, removed already, or in a store that only Spark reaches


def discard(spark: SparkSession, uri: str) -> None:
    """Remove a folder of the shared store, through Spark's own file systems."""
    path = spark._jvm.org.apache.hadoop.fs.Path(uri)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def materialize(df: DataFrame) -> DataFrame:
    """Cut the lineage with a replicated, restartable checkpoint in the shared folder.

    The exchanges that led to it are removed at once: nothing reads them again, and Spark itself would only do so when
    the driver collects garbage.
    """
    shared_dir(df.sparkSession)
    own = df.select("*")  # a plan of its own, so that ``df`` can still be run
    found = own.checkpoint(eager=True)
    _forget_exchanges(own)
    return found


def _forget_exchanges(df: DataFrame) -> None:
    """Remove the shuffle files of a frame that has run and will not be run again."""
    plan, cleaner = df._jdf.queryExecution().executedPlan(), df.sparkSession.sparkContext._jsc.sc().cleaner()
    if not plan.getClass().getSimpleName() == "AdaptiveSparkPlanExec" or cleaner.isEmpty():
        return  # Spark's own cleaning does it later
    ids = plan.context().shuffleIds().keySet().iterator()
    while ids.hasNext():
        cleaner.get().doCleanupShuffle(ids.next(), False)


def dismiss(df: DataFrame) -> None:
    """Remove the files of a materialized frame.  Only where all that was made from it is materialized itself."""
    path = df._jdf.queryExecution().analyzed().rdd().getCheckpointFile()
    if path.isDefined():
        discard(df.sparkSession, path.get())


def read_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = 4 << 20, rows: int = 1 << 30) -> Iterator[pa.RecordBatch]:
    """Re-slice Arrow batches so that each holds about ``most`` bytes of ``column`` (one row at least) and ``rows`` rows at most."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(sizes, dtype=np.int64)
        at = 0
        while at < batch.num_rows:
            done = ends[at - 1] if at else 0
            stop = min(max(at + 1, int(np.searchsorted(ends, done + most, side="right"))), at + rows)
            yield batch.slice(at, stop - at)
            at = stop


def joined_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The column's UTF-8 bytes back to back, and the n+1 offsets of its rows (null: empty)."""
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]
