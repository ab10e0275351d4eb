"""Scratch folders that the driver and every executor can reach, and small files written into them."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession, label: str) -> str:
    """URI of a fresh folder below the one that ``spark.checkpoint.dir`` names; a local one only for a local master."""
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if shared is None:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        shared = f"file://{tempfile.mkdtemp(prefix='trialbook-')}"
    return f"{shared.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def write_files(files: DataFrame, uri: str) -> int:
    """Write (path, text) below ``uri``, each file under its name only when it is complete; the number of files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, base = fs.FileSystem.from_uri(uri)
        for b in batches:
            for path, text in zip(b.column("path").to_pylist(), b.column("text").to_pylist(), strict=True):
                whole = f"{base}/{path}"
                store.create_dir(whole.rsplit("/", 1)[0], recursive=True)
                hidden = f"{whole.rsplit('/', 1)[0]}/.{uuid.uuid4().hex}.part"
                with store.open_output_stream(hidden) as out:
                    out.write((text or "").encode())
                store.move(hidden, whole)
            yield pa.record_batch({"n": pa.array([b.num_rows], pa.int64())})

    return sum(r["n"] for r in files.select("path", "text").mapInArrow(run, "n long").collect())
