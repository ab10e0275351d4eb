"""A data source that lists directories, the empty ones included: ``spark.read.format("fs_listing")``."""

from __future__ import annotations

import sys

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "path string, name string, is_dir boolean, size long, mtime timestamp"

cloudpickle.register_pickle_by_value(sys.modules[__name__.split(".")[0]])


class ListingReader(DataSourceReader):
    def __init__(self, options):
        self.roots = [x for x in options.get("path", options.get("roots", "")).split(",") if x]
        self.depth = int(options.get("depth", "1"))

    def partitions(self):
        return [InputPartition(r) for r in self.roots] or [InputPartition(None)]

    def read(self, partition):
        from pyarrow import fs as files

        if partition.value is None:
            return
        root = partition.value
        store, base = files.FileSystem.from_uri(root if "://" in root else f"file://{root}")
        level = [base]
        for _ in range(self.depth):
            below = []
            for at in level:
                for x in store.get_file_info(files.FileSelector(at, allow_not_found=True)):
                    is_dir = x.type == files.FileType.Directory
                    yield (x.path, x.base_name, is_dir, None if is_dir else x.size, x.mtime)
                    below += [x.path] * is_dir
            level = below


class ListingSource(DataSource):
    """Entries below ``path`` (or several ``roots``, comma-separated) down to ``depth``; one task per root."""

    @classmethod
    def name(cls):
        return "fs_listing"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return ListingReader(self.options)


def listing(spark: SparkSession, *roots: str, depth: int = 1) -> DataFrame:
    spark.dataSource.register(ListingSource)
    return spark.read.format("fs_listing").option("roots", ",".join(roots)).option("depth", str(depth)).load()


