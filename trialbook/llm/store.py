"""Files in the shared folder, written and read by executors through whatever store its URI names."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyarrow import fs
from pyspark import TaskContext


class Folder:
    def __init__(self, uri: str):
        self.uri = uri
        self.files, self.path = fs.FileSystem.from_uri(uri)

    @contextmanager
    def create(self, name: str) -> Iterator[object]:
        """A new file that appears under its name only when it is complete."""
        self.files.create_dir(self.path, recursive=True)
        hidden = f"{self.path}/.{name}.part"
        with self.files.open_output_stream(hidden) as out:
            yield out
        self.files.move(hidden, f"{self.path}/{name}")

    def open(self, name: str):
        return self.files.open_input_file(f"{self.path}/{name}")


def own_name() -> str:
    """A name that no other attempt of any task has, so that a lost or doubled attempt disturbs nothing."""
    task = TaskContext.get()
    return f"{task.partitionId():06d}-{task.taskAttemptId()}"
